"""Spelling variants by dense prefix-suffix tiling.

Words of a corpus are counted, then words that differ by exactly one inserted,
deleted or replaced code point are found: two words are so near exactly if the
code points they share at the start and at the end reach the longer length less
one. A tile lays two blocks of words out as padded code-point matrices, once
aligned left and once right, and compares all their rows at once.

Only tiles that can hold near words are laid: with a longer length of L, one of
the two shared parts has at least half of L - 1 code points, so words meet that
have the same head or the same tail of that size. A set of words with one head
(or tail) is cut into blocks and every pair of its blocks is a cell of its own,
so a common head is spread over tasks. A cell returns one row a word, not its pairs.
"""

from __future__ import annotations

import re
import string
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftframe.llm.common import by_run, small_batches, stage
from siftframe.llm.components import roots

# Fixed values of the rules.
RUN = re.compile("[A-Za-zÀ-ÿ]+")
DAMAGE_MODULUS = 199

HELD_WORDS = 200_000  # distinct words a task counts before it hands them on
TILE_CELLS = 1 << 22  # compared code points of a step inside a tile
_LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


@dataclass(frozen=True)
class SpellingConfig:
    min_length: int = 6   # code points
    min_count: int = 5    # occurrences
    ratio: int = 5        # a form occurs at least this many times as often
    block: int = 512      # words of one side of a tile


def runs(text: str, doc_id: int | None) -> Counter:
    """Occurrences of each damaged, lower-cased run of a text; a null doc_id is written as nothing."""
    low: Counter = Counter()
    for run, n in Counter(RUN.findall(text)).items():
        low[run.lower() if run.isascii() else run.translate(_LOWER)] += n
    name = "" if doc_id is None else doc_id
    out: Counter = Counter()
    for run, n in low.items():
        h = zlib.crc32(f"{name}:{run}".encode())
        if h % DAMAGE_MODULUS == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1:]
        out[run] += n
    return out


def word_counts(docs: DataFrame, cfg: SpellingConfig) -> DataFrame:
    """(word, n) of all words of the corpus that are long and frequent enough."""
    least = cfg.min_length

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if text:
                    for word, n in runs(text, doc_id).items():
                        if len(word) >= least:
                            held[word] += n
                if len(held) >= HELD_WORDS:
                    yield rows()
                    held.clear()
        if held:
            yield rows()

    found = docs.select("doc_id", "text").mapInArrow(count, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= cfg.min_count)


def matrices(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(left-aligned, right-aligned, lengths): code points of the words, padded with zeros."""
    sizes = np.array([len(w) for w in words], np.int64)
    width = int(sizes.max(initial=1))
    left = np.zeros((len(words), width), np.uint32)
    right = np.zeros((len(words), width), np.uint32)
    for k, word in enumerate(words):
        points = np.frombuffer(word.encode("utf-32-le"), "<u4")
        left[k, : len(points)] = points
        right[k, width - len(points):] = points
    return left, right, sizes


def _shared(a: np.ndarray, b: np.ndarray, back: bool) -> np.ndarray:
    """Code points that each row of ``a`` and each of ``b`` share from the start (or the end), padding included."""
    same = a[:, None, :] == b[None, :, :]
    if back:
        same = same[:, :, ::-1]
    differs = ~same
    first = differs.argmax(2)
    return np.where(differs.any(2), first, a.shape[1])


def near(a: list[str], b: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row in ``a``, row in ``b``, shared head) of the pairs one edit apart, in steps of bounded memory."""
    left, right, sizes = matrices(a + b)
    n, width = len(a), left.shape[1]
    step = max(1, TILE_CELLS // max(1, len(b) * width))
    for lo in range(0, n, step):
        rows = slice(lo, min(lo + step, n))
        longer = np.maximum(sizes[rows, None], sizes[None, n:])
        shorter = np.minimum(sizes[rows, None], sizes[None, n:])
        head = np.minimum(_shared(left[rows], left[n:], False), shorter)
        tail = np.minimum(_shared(right[rows], right[n:], True), shorter)
        ok = (head < longer) & (longer - shorter <= 1) & (head + tail >= longer - 1)
        i, j = np.nonzero(ok)
        yield i + lo, j, head[i, j]


def _half(longer: Column) -> Column:
    """Code points that the larger of the two shared parts has at least."""
    return F.ceil((longer - 1) / 2).cast("int")


def _buckets(words: DataFrame) -> DataFrame:
    """(longer, tail, part, word, n): the sets in which a word of length L meets others: longer length L and L + 1, head and tail."""
    size = F.length("word")
    at = F.explode(F.array(*[F.struct((size + more).alias("longer"), F.lit(tail).alias("tail"))
                             for more in (0, 1) for tail in (False, True)]))
    rows = words.select("word", "n", at.alias("s")).select("word", "n", "s.*")
    half = _half(F.col("longer"))
    part = F.when(F.col("tail"), F.substring(F.col("word"), -half, half)).otherwise(F.substring(F.col("word"), F.lit(1), half))
    return rows.select("longer", "tail", part.alias("part"), "word", "n")


def partners(words: DataFrame, cfg: SpellingConfig) -> DataFrame:
    """(word, n_near, form_n, form): near words of each word that has some, and the most frequent of them."""
    rows = stage(_buckets(words), "spelling-buckets")
    sizes = rows.groupBy("longer", "tail", "part").agg(
        F.count("*").alias("k"), F.max(F.length("word") == F.col("longer")).alias("some")).where("k > 1 and some")
    rows = rows.join(sizes.drop("some"), ["longer", "tail", "part"])
    blocks = F.ceil(F.col("k") / cfg.block).cast("int")
    rows = rows.withColumn("blocks", blocks).withColumn("mine", F.pmod(F.xxhash64("word"), blocks).cast("int"))
    # block m meets every block: cell (m, other) with the smaller number first
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    low, high = F.least("mine", "other"), F.greatest("mine", "other")
    cells = rows.select(F.xxhash64("longer", "tail", "part", low, high).alias("cell"), "longer", "tail", "part",
                        low.alias("low"), "mine", "word", "n")

    def compare(cell: pa.Table) -> Iterator[tuple]:
        # cells whose numbers collide are told apart by what they stand for
        names = list(zip(*(cell.column(c).to_pylist() for c in ("longer", "tail", "part", "low")), strict=True))
        groups: dict[tuple, list[int]] = {}
        for k, name in enumerate(names):
            groups.setdefault(name, []).append(k)
        for (longer, tail, _, low), at in groups.items():
            part = cell.take(pa.array(at))
            yield from _tile(part.column("word").to_pylist(), np.asarray(part.column("n")),
                             np.asarray(part.column("mine")) == low, longer, tail)

    cells = cells.repartition("cell").sortWithinPartitions("cell")
    schema = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("form_n", pa.int64()), ("form", pa.string())])
    found = cells.mapInArrow(by_run("cell", compare, schema, 2), "word string, n_near long, form_n long, form string")
    best = F.min(F.struct((-F.col("form_n")).alias("n"), F.col("form").alias("w")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select(
        "word", "n_near", (-F.col("best.n")).alias("form_n"), F.col("best.w").alias("form"))


def _tile(words: list[str], counts: np.ndarray, low: np.ndarray, longer: int, tail: bool) -> Iterator[tuple]:
    """(word, n_near, form_n, form) of the words of a cell: its ``low`` block against the other, or against itself if there is none.

    Only pairs of this longer length count, and in a set of equal tails only
    those whose shared head is too short for a set of equal heads.
    """
    order = sorted(range(len(words)), key=lambda k: (-counts[k], words[k]))  # the best partner comes first
    words, counts, low = [words[k] for k in order], counts[order], low[order]
    is_long = np.array([len(w) == longer for w in words])
    alone = bool(low.all())
    right = np.arange(len(words)) if alone else np.flatnonzero(~low)
    left = np.flatnonzero(is_long & low)
    half = -(-(longer - 1) // 2)
    n_near = np.zeros(len(words), np.int64)
    best = np.full(len(words), len(words), np.int64)

    def meet(a: np.ndarray, b: np.ndarray, both: bool) -> None:
        if not len(a) or not len(b):
            return
        for i, j, head in near([words[k] for k in a], [words[k] for k in b]):
            fits = (head < half) if tail else np.ones(len(i), bool)
            i, j = a[i[fits]], b[j[fits]]
            for x, y in ((i, j), (j, i)) if both else ((i, j),):
                np.add.at(n_near, x, 1)
                np.minimum.at(best, x, y)

    if alone:
        meet(left, np.flatnonzero(is_long), False)     # equal lengths: each pair from both sides
        meet(left, np.flatnonzero(~is_long), True)
    else:
        meet(left, right, True)
        meet(np.flatnonzero(~is_long & low), right[is_long[right]], True)
    for k in np.flatnonzero(n_near).tolist():
        yield words[k], int(n_near[k]), int(counts[best[k]]), words[best[k]]


def spelling_variants(docs: DataFrame, cfg: SpellingConfig = SpellingConfig()) -> DataFrame:
    """(word, n, n_near, form, form_n, root) for every word of ``docs`` (doc_id, text) that is long and frequent enough.

    Words are the runs of letters of the whole texts, lower-cased in A-Z only, a
    stated share of them damaged by one deletion. form is the near word with the
    largest n (of equal ones the smallest in code-point order) if that n is at
    least ``ratio`` times the word's; form_n its n. root is where the forms lead
    to in the end. Null and empty texts hold no words; repeated rows count as
    often as they come; an empty table gives an empty result; further columns
    are not read.
    """
    small_batches(docs.sparkSession)
    words = stage(word_counts(docs, cfg), "spelling-words")
    judged = words.join(partners(words, cfg), "word", "left")
    is_form = F.col("form_n") >= F.col("n") * cfg.ratio
    judged = stage(judged.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                                 F.when(is_form, F.col("form")).alias("form"), F.when(is_form, F.col("form_n")).alias("form_n")),
                   "spelling-judged")
    # a form is more frequent than its word, so the forms make a forest
    top = roots(judged.where("form is not null").select(F.col("word").alias("a"), F.col("form").alias("b")))
    top = top.groupBy(F.col("node").alias("word")).agg(F.min("component").alias("root"))
    return judged.join(top, "word", "left").withColumn("root", F.coalesce("root", "word"))
