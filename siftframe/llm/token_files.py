"""Token ids as files of interleaved rANS blocks under one shared frequency table.

Documents are encoded, ordered by doc_id over range partitions and packed
into blocks of whole documents. All blocks use one static table: the counts of
every id of the corpus, scaled to sum 2**SCALE. Inside a block, ids are dealt
over lanes; each lane is a range asymmetric numeral system of its own (64-bit
state, 32-bit words), and all lanes share one word stream in the decoder's
order, so a step codes one id per lane with vector operations. Every
CHECKPOINT steps the states and the place in the stream are written down: a
decoder starts there as well, and ``decode`` runs all stretches between
checkpoints side by side. A checksum over a block's stream and one over its ids
are verified on reading.

A written corpus is a folder of two Parquet tables, ``blocks`` (one row a
block, payload in a binary column) and ``frequencies``; Spark's commit makes them
whole or absent when executors are lost.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftframe.llm.bpe import _byte_letters
from siftframe.llm.common import per_worker, shared_dir, small_batches, stage
from siftframe.llm.tokens import buffers

END_ID = 2
SCALE = 20              # the frequencies of a table sum to 2**SCALE
LOWEST = 1 << 31        # a state is at least this between two steps
BLOCK_TOKENS = 1 << 18  # ids after which a block is closed, at a document's end
LANES = 1024
FEW_LANES = 32          # for blocks under FEW_TOKENS
FEW_TOKENS = 1 << 14
CHECKPOINT = 128        # steps between two checkpoints
CHUNK_BYTES = 4_000_000  # text coded at once by a task
KNOWN_WORDS = 600_000   # words of a generation that a worker remembers, of two generations
KNOWN_LETTERS = 64      # longer words are not remembered
MARKS = ".,;:!?*#&$%()"  # marks behind a word's letters that make one piece of their own
LATIN = "".join(c for c in map(chr, range(256)) if c.isalpha())
# Fixed value: the pieces of the word vocabulary, as its file states them.
WORD_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

U64 = np.uint64


@dataclass(frozen=True)
class Table:
    """Static frequencies: ids ascending, their shares of 2**SCALE, and where each share starts."""

    ids: np.ndarray
    share: np.ndarray
    start: np.ndarray

    @staticmethod
    def of_shares(ids: np.ndarray, share: np.ndarray) -> Table:
        return Table(ids.astype(np.uint32), share.astype(U64), (np.cumsum(share) - share).astype(U64))

    @staticmethod
    def of_counts(ids: np.ndarray, counts: np.ndarray) -> Table:
        """Counts scaled to sum 2**SCALE, every id at least 1; the rest is settled on the largest shares."""
        order = np.argsort(ids)
        ids, counts = ids[order], counts[order].astype(np.float64)
        if len(ids) > 1 << (SCALE - 1):
            raise ValueError(f"a table holds at most {1 << (SCALE - 1)} ids")
        share = np.maximum(1, np.floor(counts / max(counts.sum(), 1) * (1 << SCALE))).astype(np.int64)
        rest = (1 << SCALE) - int(share.sum())
        by_size = np.argsort(-share, kind="stable")
        for k in by_size.tolist():
            if rest == 0:
                break
            give = rest if rest > 0 else max(rest, 1 - int(share[k]))
            share[k] += give
            rest -= give
        return Table.of_shares(ids, share)

    def slots(self) -> np.ndarray:
        """For each of the 2**SCALE values, the id whose share holds it; of 16 bits where they are enough."""
        narrow = np.uint16 if self.ids.max(initial=0) < 1 << 16 else np.uint32
        return np.repeat(self.ids.astype(narrow), self.share.astype(np.int64))

    @cached_property
    def by_id(self) -> tuple[np.ndarray, np.ndarray]:
        """Share and start of every number up to the largest id; 0 for those that are no ids."""
        out = np.zeros((2, int(self.ids.max(initial=0)) + 1), U64)
        out[0, self.ids], out[1, self.ids] = self.share, self.start
        return out[0], out[1]


@dataclass
class Block:
    n: int
    lanes: int
    words: bytes        # 32-bit words, little-endian, in the decoder's order
    states: bytes       # per checkpoint, from step 0 on: a 64-bit state a lane
    places: bytes       # per checkpoint: words read before it, 64-bit


def encode(values: np.ndarray, table: Table) -> Block:
    """A block of the ids ``values``; each must be in the table."""
    n = len(values)
    lanes = LANES if n >= FEW_TOKENS else FEW_LANES
    steps = -(-n // lanes)
    share, start = (of[values] for of in table.by_id)
    limit, gap = share << U64(63 - SCALE), U64(1 << SCALE) - share
    x = np.full(lanes, LOWEST, U64)
    streams: list[np.ndarray] = []
    states: list[bytes] = []
    places: list[int] = []
    written = 0
    half = U64(32)
    for step in range(steps - 1, -1, -1):
        lo, hi = step * lanes, min((step + 1) * lanes, n)
        now = x[: hi - lo]
        over = np.flatnonzero(now >= limit[lo:hi])
        if len(over):
            out = now[over]
            streams.append(out.astype("<u4"))  # the low half
            now[over] = out >> half
            written += len(out)
        # whole * 2**SCALE + (now - whole * share) + start
        whole = now // share[lo:hi]
        whole *= gap[lo:hi]
        now += whole
        now += start[lo:hi]
        if step % CHECKPOINT == 0:
            states.append(x.astype("<u8").tobytes())
            places.append(written)
    streams.reverse()
    places = written - np.array(places[::-1], np.int64)
    return Block(n, lanes, b"".join([s.tobytes() for s in streams]), b"".join(states[::-1]), places.astype("<i8").tobytes())


def decode(block: Block, table: Table, slots: np.ndarray, first: int = 0, last: int | None = None) -> np.ndarray:
    """The ids of a block, or only those of the stretches between checkpoints ``first`` and ``last`` (exclusive).

    All stretches run side by side, each from its own checkpoint.
    """
    n, lanes = block.n, block.lanes
    # states stay below 2**63, so signed numbers hold them and index without a cast
    words = np.frombuffer(block.words, "<u4").astype(np.int64)
    x = np.frombuffer(block.states, "<i8").reshape(-1, lanes)[first:last].astype(np.int64)
    place = np.frombuffer(block.places, "<i8")[first:last].copy()
    share, start = (of.view(np.int64) for of in table.by_id)
    base = first * CHECKPOINT * lanes
    end = n if last is None else min(n, last * CHECKPOINT * lanes)
    out = np.empty(end - base, np.uint32)
    length = CHECKPOINT * lanes
    mask = (1 << SCALE) - 1
    whole = (end - base) // length * length
    for full, lo, hi in ((True, 0, whole // length), (False, whole // length, len(x))):
        if lo == hi:
            continue
        state, at = x[lo:hi], place[lo:hi]
        size = length if full else (end - base) - whole
        target = out[lo * length: lo * length + size * (hi - lo)].reshape(hi - lo, size)
        for step in range(-(-size // lanes)):
            a, b = step * lanes, min((step + 1) * lanes, size)
            now = state[:, : b - a]
            value = now & mask
            found = slots[value]
            target[:, a:b] = found
            now = now >> SCALE
            now *= share[found]
            now += value
            now -= start[found]
            under = now < LOWEST
            lacking = np.flatnonzero(under)
            if len(lacking):
                # the words of a stretch follow one another; its lanes take them in order
                counts = under.sum(1)
                index = np.arange(len(lacking)) + np.repeat(at - np.cumsum(counts) + counts, counts)
                flat = now.reshape(-1)
                flat[lacking] = (flat[lacking] << 32) | words[index]
                at += counts
            state[:, : b - a] = now
    return out


class Recent:
    """Values by key of two generations of at most ``size`` keys: a full one ages, and the one before is given up.

    A key asked for again moves to the newer generation; keys of more than
    KNOWN_LETTERS letters are not remembered.
    """

    def __init__(self, size: int):
        self.size = size
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _value(self, key: str, make: Callable[[str], bytes]) -> bytes:
        found = self.old.get(key)
        if found is None:
            found = make(key)
        if len(key) <= KNOWN_LETTERS:
            if len(self.new) >= self.size:
                self.old, self.new = self.new, {}
            self.new[key] = found
        return found

    def values(self, keys: pa.Array, make: Callable[[str], bytes]) -> pa.Array:
        """The values of ``keys``; those not remembered are made."""
        keys = keys.to_numpy(zero_copy_only=False).tolist()
        found = list(map(self.new.get, keys))
        return pa.array([self._value(k, make) if v is None else v for k, v in zip(keys, found, strict=True)], pa.binary())


class Words:
    """Ids of texts by the tokenizers library, which sees each distinct word of a worker's texts once.

    Where the vocabulary's pieces hold no white space (``WORD_PIECES``), a text's
    ids are those of what stands between its ASCII white space, one after
    another; a word of Latin letters and the marks behind it are two pieces, and
    the library's model takes the letters without its text steps, which change
    nothing but their case. Texts of other vocabularies go whole to the library.
    Arrow cuts texts, tells words apart and lays their ids side by side, many
    texts at a time; Python sees the distinct words of those.
    """

    def __init__(self, path: str, kind: str):
        from tokenizers import Tokenizer
        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        self.letter = "H" if kind == "<u2" else "I"
        with open(path, encoding="utf-8") as f:
            steps = json.load(f)["pre_tokenizer"]
        steps = (steps or {}).get("pretokenizers", [])
        self.by_word = bool(steps) and steps[0].get("pattern", {}).get("Regex") == WORD_PIECES
        self.model = self.library.model
        letters = _byte_letters()
        self.letters = {b: letters[b] for b in range(256)}
        self.known = Recent(KNOWN_WORDS)

    def _packed(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{self.letter}", *ids)

    def stem(self, letters: str) -> bytes:
        """Ids of lower-case Latin letters that are a piece."""
        plain = letters if letters.isascii() else letters.encode().decode("latin-1").translate(self.letters)
        return self._packed([t.id for t in self.model.tokenize(plain)])

    def whole(self, text: str) -> bytes:
        return self._packed(self.library.encode(text, add_special_tokens=False).ids)

    def _of_words(self, words: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Ids of distinct words, and the place of each word's ids in that array.

        What goes whole to the library is never of Latin letters alone, so one memory serves both ways.
        """
        bare = pc.ascii_rtrim(words, characters=MARKS)
        rest = pc.binary_length(pc.utf8_ltrim(bare, characters=LATIN)).to_numpy()
        plain = (rest == 0) & (pc.binary_length(bare).to_numpy() > 0)
        place = np.empty(len(words), np.int64)
        place[plain], place[~plain] = np.arange(plain.sum()), np.arange(plain.sum(), len(words))
        chosen = pa.array(plain)
        stems = pc.utf8_lower(bare.filter(chosen)).dictionary_encode()
        marks = pc.utf8_ltrim(words.filter(chosen), characters=LATIN).dictionary_encode()
        of_stems = self.known.values(stems.dictionary, self.stem).take(stems.indices)
        of_marks = self.known.values(marks.dictionary, self.whole).take(marks.indices)
        of_others = self.known.values(words.filter(pa.array(~plain)), self.whole)
        return pa.concat_arrays([pc.binary_join_element_wise(of_stems, of_marks, b""), of_others]), place

    def coded(self, texts: pa.Array, end: bytes) -> pa.Array:
        """Ids of each text (a null is empty), and ``end`` behind them."""
        texts = texts.fill_null("")
        if not self.by_word:
            return pa.array([self.whole(t) + end for t in texts.to_pylist()], pa.binary())
        lists = pc.ascii_split_whitespace(texts)
        words = lists.flatten().dictionary_encode()
        found, place = self._of_words(words.dictionary)
        ends = np.cumsum(pc.list_value_length(lists).to_numpy(), dtype=np.int64)
        order = np.insert(place[words.indices.to_numpy()], ends, len(found))
        laid = pa.concat_arrays([found, pa.array([end], pa.binary())]).take(pa.array(order))
        data, offsets = buffers(laid)
        cuts = offsets[np.concatenate(([0], ends + np.arange(1, len(texts) + 1)))].astype(np.int32)
        return pa.BinaryArray.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(cuts), pa.py_buffer(data)])


def _words(path: str, kind: str) -> Words:
    return per_worker(("words", path, kind), lambda: Words(path, kind))


def _path(path: str | None) -> str:
    if path:
        return path
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def id_kind(path: str | None = None, end_id: int = END_ID) -> str:
    """The narrowest little-endian type of a vocabulary's ids: 16 bits, or 32."""
    from tokenizers import Tokenizer
    return "<u2" if max(Tokenizer.from_file(_path(path)).get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"


def token_ids(docs: DataFrame, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """(doc_id, ids) of ``docs``: the ids of each whole text and the end id, of the type that ``id_kind`` gives."""
    small_batches(docs.sparkSession)
    kind = id_kind(path, end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        words, end = _words(_path(path), kind), np.array([end_id], kind).tobytes()

        def done(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            coded = words.coded(pa.concat_arrays([b.column("text") for b in held]), end)
            doc_ids = pa.concat_arrays([b.column("doc_id").cast(pa.int64()) for b in held])
            yield pa.RecordBatch.from_arrays([doc_ids, coded], names=["doc_id", "ids"])

        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.column("text").nbytes
            if size >= CHUNK_BYTES:
                yield from done(held)
                held, size = [], 0
        if held:
            yield from done(held)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids binary")


def frequencies(coded: DataFrame, kind: str) -> Table:
    """The shared table of all ids (of type ``kind``); what reaches the driver is one row an id of the vocabulary."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(0, np.int64)
        for batch in batches:
            more = np.bincount(buffers(batch.column("ids"))[0].view(kind), minlength=len(counts))
            more[: len(counts)] += counts
            counts = more
        found = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(counts[found], pa.int64())], names=["id", "n"])

    rows = coded.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    return Table.of_counts(rows.column("id").to_numpy(), rows.column("n").to_numpy())


_BLOCK = ("part int, number int, n long, lanes int, words binary, states binary, places binary, stream_crc32 long, ids_crc32 long, "
          "doc_ids array<long>, lengths array<long>")


def _packed(ordered: DataFrame, table: Table, kind: str) -> DataFrame:
    """Blocks of the ordered documents (doc_id, ids, part)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        names: list[int | None] = []
        size = number = part = 0

        def block() -> pa.RecordBatch:
            values = np.concatenate(held)
            made = encode(values, table)
            row = {"part": [part], "number": [number], "n": [made.n], "lanes": [made.lanes], "words": [made.words],
                   "states": [made.states], "places": [made.places],
                   "stream_crc32": [zlib.crc32(made.places, zlib.crc32(made.states, zlib.crc32(made.words)))],
                   "ids_crc32": [zlib.crc32(values.astype("<u4").tobytes())],
                   "doc_ids": [names], "lengths": [[len(h) for h in held]]}
            long, raw = pa.int64(), pa.binary()
            kinds = [pa.int32(), pa.int32(), long, pa.int32(), raw, raw, raw, long, long, pa.list_(long), pa.list_(long)]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row.values(), kinds, strict=True)], names=list(row))

        for batch in batches:
            for doc_id, ids, at in zip(batch.column("doc_id").to_pylist(), batch.column("ids"), batch.column("part").to_pylist(), strict=True):
                part = at
                held.append(np.frombuffer(ids.as_buffer(), kind).astype(np.uint32))
                names.append(doc_id)
                size += len(held[-1])
                if size >= BLOCK_TOKENS:
                    yield block()
                    held, names, size = [], [], 0
                    number += 1
        if held:
            yield block()

    return ordered.mapInArrow(run, _BLOCK)


def write_tokens(docs: DataFrame, target: str, path: str | None = None, end_id: int = END_ID) -> None:
    """Write the ids of ``docs`` (doc_id, text) to the folder ``target``, in ascending doc_id order.

    A null doc_id comes first; rows that repeat a doc_id follow one another in
    any order. Null and empty texts are the end id alone. The order is that of
    range partitions over (doc_id, a row number), so that one id with many rows
    is spread; equal range sizes come from Spark's sample. Further columns are
    not read; an empty table gives empty files. Memory: a block and the longest
    document a task.
    """
    spark = docs.sparkSession
    coded = token_ids(docs, path, end_id).withColumn("row", F.monotonically_increasing_id())
    coded = stage(coded, "token-ids")
    kind = id_kind(path, end_id)
    table = frequencies(coded, kind)
    order = [F.col("doc_id").asc_nulls_first(), F.col("row")]
    ordered = coded.repartitionByRange(*order).sortWithinPartitions(*order)
    _packed(ordered.select("doc_id", "ids", F.spark_partition_id().alias("part")), table, kind).write.parquet(f"{target}/blocks")
    rows = pa.table({"id": pa.array(table.ids, pa.int64()), "share": pa.array(table.share, pa.int64())})
    spark.createDataFrame(rows).coalesce(1).write.parquet(f"{target}/frequencies")


def _blocks(spark, target: str) -> tuple[DataFrame, Table]:
    rows = spark.read.parquet(f"{target}/frequencies").orderBy("id").toArrow()
    return spark.read.schema(_BLOCK).parquet(f"{target}/blocks"), Table.of_shares(rows.column("id").to_numpy(), rows.column("share").to_numpy())


def _offsets(blocks: DataFrame) -> DataFrame:
    """(part, number, first): ids before each block.

    Running sums inside a part, and over the parts' totals: one row for each
    range partition of the writer.
    """
    small = blocks.select("part", "number", "n")
    totals = small.groupBy("part").agg(F.sum("n").alias("total"))
    before = totals.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("before"))
    inside = Window.partitionBy("part").orderBy("number")
    return small.withColumn("inside", F.sum("n").over(inside) - F.col("n")).join(before, "part").select(
        "part", "number", (F.col("before") + F.col("inside")).alias("first"))


def read_tokens(spark, target: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids): the documents of a folder that ``write_tokens`` wrote, decoded and verified.

    start counts the ids of all documents before. A block whose stream or ids
    differ from their checksums fails the read.
    """
    blocks, table = _blocks(spark, target)
    rows = blocks.join(_offsets(blocks), ["part", "number"])
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = table.slots()
        for batch in batches:
            for row in range(batch.num_rows):
                get = {c: batch.column(c)[row] for c in batch.schema.names}
                block = Block(get["n"].as_py(), get["lanes"].as_py(), *(get[c].as_py() for c in ("words", "states", "places")))
                if zlib.crc32(block.places, zlib.crc32(block.states, zlib.crc32(block.words))) != get["stream_crc32"].as_py():
                    raise ValueError(f"block {get['part']}/{get['number']}: the stream differs from its checksum")
                values = decode(block, table, slots).astype("<u4")
                if zlib.crc32(values.tobytes()) != get["ids_crc32"].as_py():
                    raise ValueError(f"block {get['part']}/{get['number']}: the ids differ from their checksum")
                lengths = np.asarray(get["lengths"].values, np.int64)
                ends = np.cumsum(lengths)
                starts = ends - lengths
                at = get["first"].as_py()
                pieces = [values[a:b].tobytes() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([get["doc_ids"].values, pa.array(starts + at), pa.array(lengths),
                                                  pa.array(pieces, pa.binary())], schema=schema)

    return rows.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def read_range(spark, target: str, start: int, count: int) -> np.ndarray:
    """``count`` ids of the written corpus from position ``start``: only blocks and stretches that hold some are decoded.

    The ids themselves are the result and reach the caller.
    """
    blocks, table = _blocks(spark, target)
    rows = blocks.join(_offsets(blocks), ["part", "number"])
    rows = rows.where((F.col("first") < start + count) & (F.col("first") + F.col("n") > start))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = table.slots()
        for batch in batches:
            for get in batch.to_pylist():
                block = Block(get["n"], get["lanes"], get["words"], get["states"], get["places"])
                length = CHECKPOINT * block.lanes
                lo, hi = max(start - get["first"], 0), min(start + count - get["first"], block.n)
                first, last = lo // length, -(-hi // length)
                values = decode(block, table, slots, first, last)[lo - first * length: hi - first * length]
                yield pa.RecordBatch.from_arrays([pa.array([get["first"] + lo]), pa.array([values.tobytes()], pa.binary())], names=["at", "ids"])

    found = rows.mapInArrow(run, "at long, ids binary").orderBy("at").toArrow()
    return np.concatenate([np.zeros(0, np.uint32), *[np.frombuffer(v, "<u4") for v in found.column("ids").to_pylist()]])


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of ``docs``, from files written for it in the shared folder and read back."""
    spark = docs.sparkSession
    target = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, target, path)
    return read_tokens(spark, target).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
