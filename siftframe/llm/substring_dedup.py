"""Repeated word windows across documents by super-k-mer partitioning.

A window is ``window`` consecutive words. Its minimiser is the smallest hash
of the ``anchor``-word grams inside it; consecutive windows of a document with
the same minimiser form one super-k-mer, a run that is a little longer than a
window and stands for all of its windows. Equal windows have equal minimisers,
so only runs whose minimiser occurs in two documents can hold a repeat.

1. Per text: runs (minimiser, start, words). 2. Minimisers met in several
documents, by a pre-aggregated count. 3. Runs with such a minimiser are packed
as one string; equal strings under one minimiser collapse to their smallest
document before the shuffle. 4. The owner of a bucket of minimisers sorts the
windows of its strings and finds each window's smallest document. A minimiser
with very many different strings is settled window by window in a second
exchange instead of in one bucket. 5. Every occurrence of a string whose
windows start in a smaller document gives back word ranges to remove.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftframe.llm import bloom
from siftframe.llm.common import small_batches, stage
from siftframe.llm.tokens import U, buffers, grams, sliding_min, window_starts, words


@dataclass(frozen=True)
class SubstringConfig:
    window: int = 50
    anchor: int = 20          # words of the gram that a minimiser is taken over
    hot_strings: int = 5_000  # strings of one minimiser settled in one bucket; beyond: window by window
    bucket_strings: int = 20_000  # strings a bucket should hold
    max_run: int = 2_000      # windows of one packed string; a longer run is cut, windows stay whole


def _runs(hashes: np.ndarray, first: np.ndarray, cfg: SubstringConfig):
    """(document, start word, words, minimiser) of every super-k-mer of a batch."""
    starts, ranges = window_starts(first, cfg.window)
    if not len(starts):
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, np.zeros(0, U)
    gram = grams(hashes, cfg.anchor, np.arange(len(hashes) - cfg.anchor + 1))
    low = sliding_min(gram, cfg.window - cfg.anchor + 1)[starts]
    new = np.ones(len(starts), bool)
    new[1:] = low[1:] != low[:-1]
    new[ranges[:-1][np.diff(ranges) > 0]] = True
    at = np.flatnonzero(new)
    lengths = np.diff(np.append(at, len(starts)))
    pieces = -(-lengths // cfg.max_run)
    if pieces.max() > 1:
        offset = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        at, left = np.repeat(at, pieces) + offset * cfg.max_run, np.repeat(lengths, pieces) - offset * cfg.max_run
        lengths = np.minimum(left, cfg.max_run)
    doc = np.searchsorted(ranges, at, side="right") - 1
    return doc, starts[at] - first[doc], lengths + cfg.window - 1, low[at]


def _run_rows(docs: DataFrame, cfg: SubstringConfig) -> DataFrame:
    """(row, doc_id, minimiser, start, words) of every super-k-mer."""
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = words(*buffers(batch.column("text")))
            doc, start, length, low = _runs(w.hashes(), w.first, cfg)
            yield pa.RecordBatch.from_arrays(
                [batch.column("row").take(doc), batch.column("doc_id").take(doc), pa.array(low.view(np.int64)),
                 pa.array(start.astype(np.int32)), pa.array(length.astype(np.int32))],
                names=["row", "doc_id", "low", "start", "words"])

    return docs.where("doc_id is not null and text is not null").mapInArrow(
        make, "row long, doc_id long, low long, start int, words int")


def _pack(docs: DataFrame) -> DataFrame:
    """(row, doc_id, low, start, words, packed) of the runs listed per row of ``docs``."""
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs = batch.column("runs")
            parent = runs.value_parent_indices().to_numpy()
            low, start, length = (runs.flatten().field(k) for k in ("low", "start", "words"))
            packed = []
            split = [t.as_py().encode().split() for t in batch.column("text")]
            for d, s, n in zip(parent.tolist(), start.to_pylist(), length.to_pylist(), strict=True):
                packed.append(b" ".join(split[d][s: s + n]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("row").take(parent), batch.column("doc_id").take(parent), low, start, length,
                 pa.array(packed, pa.binary())], names=["row", "doc_id", "low", "start", "words", "packed"])

    return docs.mapInArrow(make, "row long, doc_id long, low long, start int, words int, packed binary")


def _windows(packed: pa.Array, cfg: SubstringConfig) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """128-bit keys of all windows of the packed strings, and the strings' ranges in them."""
    w = words(*buffers(packed))
    starts, ranges = window_starts(w.first, cfg.window)
    return grams(w.hashes(0), cfg.window, starts, 0), grams(w.hashes(1), cfg.window, starts, 1), ranges


def _count_in_buckets(strings: DataFrame, cfg: SubstringConfig, buckets: int) -> DataFrame:
    """(low, string, mins): per string the smallest document of each of its windows, one bucket a group."""
    def count(group: pa.Table) -> pa.Table:
        k1, k2, ranges = _windows(group.column("packed").combine_chunks(), cfg)
        owner = np.repeat(np.arange(group.num_rows), np.diff(ranges))
        doc = np.asarray(group.column("first_doc"))[owner]
        order = np.lexsort((doc, k2, k1))
        a, b = k1[order], k2[order]
        head = np.ones(len(order), bool)
        head[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        least = np.empty(len(order), np.int64)
        least[order] = doc[order][head][np.cumsum(head) - 1]
        mins = pa.ListArray.from_arrays(pa.array(ranges.astype(np.int32)), pa.array(least))
        return pa.table({"low": group.column("low"), "string": group.column("string"), "mins": mins})

    dealt = strings.withColumn("bucket", F.pmod(F.xxhash64("low"), F.lit(buckets)))
    return dealt.groupBy("bucket").applyInArrow(count, "low long, string binary, mins array<long>")


def _count_by_window(strings: DataFrame, cfg: SubstringConfig) -> DataFrame:
    """As ``_count_in_buckets`` for minimisers with too many strings for one task."""
    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2, ranges = _windows(batch.column("packed"), cfg)
            owner = np.repeat(np.arange(batch.num_rows), np.diff(ranges))
            yield pa.RecordBatch.from_arrays(
                [batch.column("low").take(owner), batch.column("string").take(owner),
                 pa.array((np.arange(len(owner)) - ranges[owner]).astype(np.int32)),
                 pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), batch.column("first_doc").take(owner)],
                names=["low", "string", "at", "k1", "k2", "first_doc"])

    rows = strings.mapInArrow(expand, "low long, string binary, at int, k1 long, k2 long, first_doc long")
    least = rows.groupBy("k1", "k2").agg(F.min("first_doc").alias("least"))
    rows = rows.join(least, ["k1", "k2"]).groupBy("low", "string").agg(
        F.sort_array(F.collect_list(F.struct("at", "least"))).alias("w"))  # max_run windows at most
    return rows.select("low", "string", F.col("w.least").alias("mins"))


def _cut(docs: DataFrame, cfg: SubstringConfig) -> DataFrame:
    """Every document without its covered words; ``hits`` lists runs and each window's smallest document."""
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, removed, digest, kept_texts = [], [], [], []
            for i, text in enumerate(batch.column("text")):
                ws = (text.as_py() or "").encode().split()
                hits = batch.column("hits")[i].as_py()
                gone = 0
                if hits:
                    own = batch.column("doc_id")[i].as_py()
                    edge = np.zeros(len(ws) + 1, np.int32)
                    for hit in hits:
                        at = hit["start"] + np.flatnonzero(np.array(hit["mins"], np.int64) < own)
                        np.add.at(edge, at, 1)
                        np.add.at(edge, at + cfg.window, -1)
                    covered = np.cumsum(edge)[:-1] > 0
                    gone = int(covered.sum())
                    kept = b" ".join([ws[k] for k in np.flatnonzero(~covered)])
                else:
                    kept = b" ".join(ws)
                total.append(len(ws))
                removed.append(gone)
                kept_texts.append(kept)
                digest.append(hashlib.sha256(kept).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()),
                 pa.array(digest, pa.string()), pa.array(kept_texts, pa.binary()).cast(pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])

    return docs.mapInArrow(
        make, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")


def substring_dedup(docs: DataFrame, cfg: SubstringConfig = SubstringConfig()) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept_text) for every row of ``docs`` (doc_id, text).

    A word goes if a window that covers it has the word sequence of a window
    of a document with a smaller doc_id; windows are judged on the input. The
    kept words are joined by one space. Null texts count as empty. Rows with a
    null doc_id neither lose words nor cause a loss. Rows repeating a doc_id
    are judged each on its own text. An empty table gives an empty result;
    further columns are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    docs = docs.withColumn("row", F.xxhash64("doc_id", "text"))
    runs = stage(_run_rows(docs, cfg), "runs")
    lows = runs.groupBy("low").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("low")
    shared = stage(runs.join(lows, "low", "left_semi"), "shared")
    listed = stage(shared.distinct().groupBy("row").agg(F.collect_list(F.struct("low", "start", "words")).alias("runs")),
                   "listed")  # a document's own runs only
    wanted = bloom.prefilter(docs.where("doc_id is not null and text is not null"), "row", listed.select("row"))
    packed = _pack(wanted.join(listed, "row").select("row", "doc_id", "text", "runs"))
    packed = stage(packed.withColumn("string", F.unhex(F.md5("packed"))), "packed")
    strings = packed.groupBy("low", "string").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"),
                                                  F.first("packed").alias("packed"))
    strings = stage(strings, "strings")
    loads = strings.groupBy("low").agg(F.count("*").alias("k"))
    hot = stage(loads.where(F.col("k") > cfg.hot_strings).select("low"), "hot")
    buckets = max(1, -(-strings.count() // cfg.bucket_strings))
    mins = _count_in_buckets(strings.join(hot, "low", "left_anti"), cfg, buckets).union(
        _count_by_window(strings.join(hot, "low", "left_semi"), cfg))
    last = strings.select("low", "string", "last_doc")
    mins = mins.join(last, ["low", "string"]).where(F.exists("mins", lambda m: m < F.col("last_doc"))).drop("last_doc")
    hits = packed.select("row", "doc_id", "low", "string", "start").distinct().join(mins, ["low", "string"])
    hits = hits.where(F.exists("mins", lambda m: m < F.col("doc_id")))
    hits = hits.groupBy("row").agg(F.collect_list(F.struct("start", "mins")).alias("hits"))
    return _cut(docs.join(stage(hits, "hits"), "row", "left").select("doc_id", "text", "hits"), cfg)
