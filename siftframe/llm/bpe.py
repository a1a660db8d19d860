"""BPE encoding with a pair occurrence index, and decoding.

Texts are normalised and cut into pieces as the vocabulary file states; each
distinct piece of a batch is encoded once. All distinct pieces lie in one
symbol sequence with links to the neighbours inside a piece. The index maps
every adjacent pair that has a merge rank to the list of its positions; ranks
are taken in ascending order from a heap, all occurrences of the rank's pair
are merged left to right, and the lists of the pairs that vanish or appear are
updated. As a merge can only create pairs with a later symbol, a pair that
becomes active again is pushed again; stale positions are recognised by the
symbols they no longer hold.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftframe.llm.common import per_worker, small_batches

CACHE_PIECES = 250_000   # distinct pieces a worker remembers
CHUNK_BYTES = 3_000_000  # text coded at once by a task


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, extra = {b: chr(b) for b in plain}, 0
    for b in range(256):
        if b not in letters:
            letters[b] = chr(256 + extra)
            extra += 1
    return [letters[b] for b in range(256)]


def piece_pattern(spec: dict) -> str:
    """The regular expression of the file's Split step."""
    for step in spec["pre_tokenizer"].get("pretokenizers", [spec["pre_tokenizer"]]):
        if step["type"] == "Split":
            return step["pattern"]["Regex"]
    raise ValueError("the vocabulary file has no Split step")


class Codec:
    """Encoder and decoder of one vocabulary file (BPE with word ends over byte letters)."""

    def __init__(self, spec: dict):
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        vocab = model["vocab"]
        self.names = {i: t for t, i in vocab.items()}
        merges = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.rules = [(vocab[a], vocab[b], vocab[a + b]) for a, b in merges]  # by rank
        codes = np.array([(a << 16) | b for a, b, _ in self.rules], np.int64)
        self.code_rank = np.argsort(codes, kind="stable")
        self.codes = codes[self.code_rank]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names.update({i: t for t, i in self.special.items()})
        letters = _byte_letters()
        self.inner = np.array([vocab[c] for c in letters], np.int64)
        self.last = np.array([vocab[c + self.suffix] for c in letters], np.int64)
        self.pieces = regex.compile(piece_pattern(spec))
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.known: dict[str, tuple[bytes, str]] = {}

    def normalise(self, text: str) -> str:
        """NFC, then lower case letter by letter (a final sigma is no special case).

        Runs of white space are left as they are: no piece holds any.
        """
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return text.lower()

    def merge(self, pieces: list[str]) -> list[np.ndarray]:
        """Token ids of every piece, by the pair occurrence index over all of them."""
        raw = [p.encode() for p in pieces]
        sizes = np.array([len(r) for r in raw], np.int64)
        data = np.frombuffer(b"".join(raw), np.uint8)
        n, ends = len(data), np.cumsum(sizes)
        symbols = self.inner[data]
        symbols[ends - 1] = self.last[data[ends - 1]]
        right = np.arange(1, n + 1)
        right[ends - 1] = -1
        left = np.arange(-1, n - 1)
        left[ends - sizes] = -1
        where: dict[int, list[np.ndarray]] = defaultdict(list)
        heap: list[int] = []

        def index(at: np.ndarray) -> None:
            """Add the pairs that start at these positions to the lists of their ranks."""
            at = at[right[at] >= 0]
            code = (symbols[at] << 16) | symbols[right[at]]
            found = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
            ok = self.codes[found] == code
            at, rank = at[ok], self.code_rank[found[ok]]
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            cuts = np.flatnonzero(rank[1:] != rank[:-1]) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(rank)], strict=True):
                if hi > lo:
                    r = int(rank[lo])
                    if r not in where:
                        heapq.heappush(heap, r)
                    where[r].append(at[lo:hi])

        index(np.arange(n))
        while heap:
            rank = heapq.heappop(heap)
            a, b, made = self.rules[rank]
            at = np.sort(np.concatenate(where.pop(rank)))
            nxt = right[at]
            ok = (symbols[at] == a) & (nxt >= 0) & (symbols[nxt] == b)
            ok[1:] &= at[1:] != at[:-1]
            at = at[ok]
            if a == b and len(at) > 1:  # of overlapping pairs the left one goes first
                taken, last = [], -1
                for i, j in zip(at.tolist(), right[at].tolist(), strict=True):
                    if i != last:
                        taken.append(i)
                        last = j
                at = np.array(taken, np.int64)
            if not len(at):
                continue
            gone = right[at]
            symbols[at], symbols[gone] = made, -1
            after = right[gone]
            right[at] = after
            some = after >= 0
            left[after[some]] = at[some]
            before = left[at]
            index(np.concatenate((at, before[before >= 0])))
        kept = symbols >= 0
        counts = np.add.reduceat(kept, ends - sizes) if n else np.zeros(0, np.int64)
        flat, cuts = symbols[kept].astype("<u4"), np.concatenate(([0], np.cumsum(counts))).tolist()
        return [flat[lo:hi] for lo, hi in zip(cuts[:-1], cuts[1:], strict=True)]

    def learn(self, pieces: set[str]) -> None:
        """Encode the pieces that are not known yet."""
        new = [p for p in pieces if p not in self.known]
        if len(self.known) + len(new) > CACHE_PIECES:
            self.known.clear()
            new = list(pieces)
        for piece, ids in zip(new, self.merge(new) if new else [], strict=True):
            self.known[piece] = (ids.tobytes(), " ".join([self.names[i] for i in ids.tolist()]))

    def encode_batch(self, texts: list[str]) -> list[tuple[bytes, str]]:
        """(ids as little-endian unsigned 32-bit integers, decoded text) of every text."""
        cut_up: list[list] = []
        for text in texts:
            if self.cut is not None and any(s in text for s in self.special):
                parts = []
                for part in self.cut.split(text):
                    parts += [self.special[part]] if part in self.special else self.pieces.findall(self.normalise(part))
                cut_up.append(parts)
            else:
                cut_up.append(self.pieces.findall(self.normalise(text)))
        self.learn({p for parts in cut_up for p in parts if isinstance(p, str)})
        known, out = self.known, []
        for parts in cut_up:
            pairs = [known[p] if isinstance(p, str) else (np.uint32(p).tobytes(), self.names[p]) for p in parts]
            out.append((b"".join([p[0] for p in pairs]), " ".join([p[1] for p in pairs])))
        return out

    def decode(self, ids: bytes) -> str:
        """Without a decoder step in the file, tokens are joined by one space."""
        return " ".join([self.names[i] for i in np.frombuffer(ids, "<u4").tolist()])


def load_codec(path: str) -> Codec:
    """The codec of a vocabulary file, loaded once for a worker."""
    def load() -> Codec:
        with open(path, encoding="utf-8") as f:
            return Codec(json.load(f))

    return per_worker(("codec", path), load)


def default_vocabulary() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def encode_documents(docs: DataFrame, path: str | None = None, text: str = "text") -> DataFrame:
    """``docs`` with n_tokens, ids and decoded (replacing columns of these names).

    A null or empty text has no tokens and decodes to the empty text. Rows are
    independent: repeated rows and null ids stay as they are, and a lost
    executor costs only its own rows' work. No shuffle. ``path`` names the
    vocabulary file on every executor. The index spans the new pieces of about
    CHUNK_BYTES of texts of a partition.
    """
    small_batches(docs.sparkSession)
    rest = [c for c in docs.columns if c not in ("n_tokens", "ids", "decoded")]
    schema = T.StructType([docs.schema[c] for c in rest] + [
        T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = load_codec(path or default_vocabulary())

        def done(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            coded = codec.encode_batch([t or "" for b in held for t in b.column(text).to_pylist()])
            at = 0
            for b in held:
                part = coded[at: at + b.num_rows]
                at += b.num_rows
                yield pa.RecordBatch.from_arrays(
                    [*b.columns, pa.array([len(p[0]) // 4 for p in part], pa.int64()),
                     pa.array([p[0] for p in part], pa.binary()), pa.array([p[1] for p in part], pa.string())],
                    names=[*b.schema.names, "n_tokens", "ids", "decoded"])

        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.column(text).nbytes
            if size >= CHUNK_BYTES:
                yield from done(held)
                held, size = [], 0
        if held:
            yield from done(held)

    return docs.select(*rest).mapInArrow(run, schema)


def digests(encoded: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of encoded documents."""
    return encoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                          F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
