"""MinHash near-duplicate classes with sequential Bayesian verification.

1. One pass over the texts makes each document's shingle set, a 128-bit
   fingerprint of it and a MinHash signature. Equal sets collapse into one
   class (pre-aggregated before the shuffle), so a group of copies is one row.
2. Banding: classes that share a band's key are candidates. Every class is
   first compared with two pivots of its bucket (its smallest member and one
   chosen by hash), so a bucket of k yields 2k pairs, not k*k.
3. Signatures are compared in batches. After each batch the posterior
   probability that the similarity reaches the threshold, under a uniform
   prior, is P(Binomial(n + 1, t) <= matches); a pair is given up once it is
   below ``miss``.
4. Survivors are verified exactly on full shingle sets, the best pivot of each
   class first; linked classes become components.
5. Buckets that still hold several components are compared exhaustively
   between different components, in blocks of bounded size (a signature block
   against another inside one task) and verified in the same blocks. No
   bucket is capped: links are lost only with the banding's and the posterior's
   probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftframe.llm import bloom
from siftframe.llm.common import by_bytes, by_run, small_batches, stage
from siftframe.llm.components import components, roots
from siftframe.llm.tokens import LOWER, U, buffers, mix, shingle_sets, words

FEATURES = "doc_id long, n long, f1 long, f2 long, sig binary"


@dataclass(frozen=True)
class NearDupConfig:
    shingle: int = 5        # words a shingle
    percent: int = 80       # link when 100 * intersection >= percent * union
    bands: int = 32
    rows: int = 5           # hashes a band; a pair at 0.8 misses all bands with probability 3e-6
    batch: int = 32         # signature values compared between two looks at the posterior
    miss: float = 1e-7      # a pair is pruned when P(similarity >= threshold) is below this
    block: int = 512        # rows of one side of an exhaustive block


def _multipliers(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(7)
    return rng.integers(1, 2**64 - 1, n, dtype=U) | U(1), rng.integers(1, 2**64 - 1, n, dtype=U)


def min_matches(n: int, threshold: float, miss: float) -> int:
    """Fewest matches of ``n`` with which a pair goes on: P(Binomial(n + 1, threshold) <= m) >= miss."""
    total = 0.0
    for m in range(n + 1):
        total += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        if total >= miss:
            return m
    return n


def _keep(a: np.ndarray, b: np.ndarray, cfg: NearDupConfig) -> tuple[np.ndarray, np.ndarray]:
    """(indices of the pairs of signature rows that survive every look, their matches)."""
    alive = np.arange(len(a))
    matches = np.zeros(len(a), np.int64)
    for lo in range(0, a.shape[1], cfg.batch):
        hi = min(lo + cfg.batch, a.shape[1])
        matches += (a[alive, lo:hi] == b[alive, lo:hi]).sum(1)
        ok = matches >= min_matches(hi, cfg.percent / 100, cfg.miss)
        alive, matches = alive[ok], matches[ok]
    return alive, matches


def _sets(batch: pa.RecordBatch, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = buffers(batch.column("text"))
    return shingle_sets(words(LOWER[data], offsets), shingle)


def features(docs: DataFrame, cfg: NearDupConfig) -> DataFrame:
    """(doc_id, n shingles, 128-bit set fingerprint, signature) of every row."""
    hashes = cfg.bands * cfg.rows
    shingle = cfg.shingle

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mul, add = _multipliers(hashes)
        for batch in (part for whole in batches for part in by_bytes(whole, "text")):
            values, ranges = _sets(batch, shingle)
            sizes = np.diff(ranges)
            full = np.flatnonzero(sizes)
            sig = np.zeros((batch.num_rows, hashes), np.uint32)
            f1, f2 = np.zeros(batch.num_rows, U), np.zeros(batch.num_rows, U)
            if len(full):
                at = ranges[:-1][full]
                for j in range(hashes):
                    sig[full, j] = np.minimum.reduceat(((values * mul[j] + add[j]) >> U(32)).astype(np.uint32), at)
                f1[full] = np.add.reduceat(mix(values + U(1)), at)
                f2[full] = np.add.reduceat(mix(values ^ U(0x5851F42D4C957F2D)), at)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array(sizes), pa.array(f1.view(np.int64)),
                 pa.array(f2.view(np.int64)), pa.array([row.tobytes() for row in sig], pa.binary())],
                names=["doc_id", "n", "f1", "f2", "sig"])

    return docs.select("doc_id", "text").mapInArrow(make, FEATURES)


def _signatures(column: pa.Array, hashes: int) -> np.ndarray:
    data, _ = buffers(column)
    return data.view(np.uint32).reshape(len(column), hashes) if len(data) else np.zeros((0, hashes), np.uint32)


def _bands(classes: DataFrame, cfg: NearDupConfig) -> DataFrame:
    """(key, band, rep, n) for every band of every class; the key names band and content."""
    bands, rows = cfg.bands, cfg.rows

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig = _signatures(batch.column("sig"), bands * rows).astype(U).reshape(-1, bands, rows)
            key = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=U)), sig.shape[:2]).copy()
            for r in range(rows):
                key = mix(key ^ (sig[:, :, r] + U(r << 40)))
            rep = np.repeat(np.asarray(batch.column("rep")), bands)
            n = np.repeat(np.asarray(batch.column("n")), bands)
            band = np.tile(np.arange(bands, dtype=np.int16), batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(key.ravel().view(np.int64)), pa.array(band), pa.array(rep), pa.array(n)],
                names=["key", "band", "rep", "n"])

    return classes.select("rep", "n", "sig").mapInArrow(make, "key long, band short, rep long, n long")


def _judge_pairs(pairs: DataFrame, classes: DataFrame, cfg: NearDupConfig) -> DataFrame:
    """(a, b, matches) of the pairs (a, b) whose signatures survive the sequential comparison."""
    hashes = cfg.bands * cfg.rows

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, matches = _keep(_signatures(batch.column("sa"), hashes), _signatures(batch.column("sb"), hashes), cfg)
            yield pa.RecordBatch.from_arrays(
                [batch.column("a").take(kept), batch.column("b").take(kept), pa.array(matches)],
                names=["a", "b", "matches"])

    sig = classes.select("rep", "sig")
    both = pairs.join(sig.withColumnsRenamed({"rep": "a", "sig": "sa"}), "a")
    both = both.join(sig.withColumnsRenamed({"rep": "b", "sig": "sb"}), "b")
    return both.select("a", "b", "sa", "sb").mapInArrow(judge, "a long, b long, matches long")


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted shingle sets reach the similarity."""
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = np.sort(np.concatenate((x, y)), kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(x) + len(y) - common)


def _full_sets(ids: DataFrame, docs: DataFrame, cfg: NearDupConfig) -> DataFrame:
    """(doc_id, set) of the documents ``ids`` (doc_id, distinct), staged."""
    shingle = cfg.shingle

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in by_bytes(whole, "text")):
            values, ranges = _sets(batch, shingle)
            packed = [values[ranges[d]: ranges[d + 1]].tobytes() for d in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(packed, pa.binary())],
                                             names=["doc_id", "set"])

    ids = stage(ids, "ids")
    wanted = bloom.prefilter(docs.select("doc_id", "text").where("doc_id is not null"), "doc_id", ids)
    made = wanted.mapInArrow(sets, "doc_id long, set binary").join(ids, "doc_id", "left_semi")
    return stage(made.groupBy("doc_id").agg(F.first("set").alias("set")), "sets")  # one row for a repeated id


def _confirm(pairs: DataFrame, docs: DataFrame, cfg: NearDupConfig) -> DataFrame:
    """The pairs (a, b) that are links on their full shingle sets. ``pairs`` is staged and distinct."""
    percent = cfg.percent

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [i for i, (x, y) in enumerate(zip(batch.column("x"), batch.column("y"), strict=True))
                    if _linked(np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U), percent)]
            kept = pa.array(kept, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("a").take(kept), batch.column("b").take(kept)],
                                             names=["a", "b"])

    made = _full_sets(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), docs, cfg)
    both = pairs.select("a", "b").join(made.withColumnsRenamed({"doc_id": "a", "set": "x"}), "a")
    both = both.join(made.withColumnsRenamed({"doc_id": "b", "set": "y"}), "b")
    return both.select("a", "b", "x", "y").mapInArrow(compare, "a long, b long")


def _cross(bands: DataFrame, labels: DataFrame, classes: DataFrame, docs: DataFrame, cfg: NearDupConfig) -> DataFrame:
    """Links (a, b) between rows that share a bucket but not a component, compared block by block.

    In a bucket, the rows outside its main component (that of its smallest
    row) are dealt into chunks of about ``cfg.block`` and meet every chunk of
    the bucket; rows of the main component never meet each other. A pair is
    judged in the first band it shares only. The survivors of a cell stay
    packed with their row until its sets have arrived; of the links between a
    row and another component one is returned.
    """
    hashes, block = cfg.bands * cfg.rows, cfg.block
    rows = bands.join(labels, "rep", "left").withColumn("comp", F.coalesce("component", "rep"))
    heads = rows.groupBy("key").agg(F.count("*").alias("k"), F.min("comp").alias("main"), F.max("comp").alias("other"))
    heads = heads.where("main <> other and k > 2").select("key", "k", "main")
    rows = stage(rows.join(heads, "key").select("key", "band", "rep", "n", "comp", "k", "main"), "cross")
    out = rows.where("comp <> main").groupBy("key").agg(F.count("*").alias("u"))
    rows = rows.join(out, "key")
    chunks = lambda n: F.ceil(F.col(n) / block).cast("int")
    deal = lambda n: F.pmod(F.xxhash64("rep"), chunks(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), chunks(n) - 1))
    keep = ["key", "band", "rep", "n", "comp", "main"]
    as_all = rows.select(*keep, deal("k").alias("cm"), every("u").alias("cu"), F.lit(False).alias("out"))
    as_out = rows.where("comp <> main").select(*keep, every("k").alias("cm"), deal("u").alias("cu"), F.lit(True).alias("out"))
    dealt = as_all.union(as_out).join(classes.select("rep", "sig"), "rep")
    dealt = dealt.select(F.xxhash64("key", "cm", "cu").alias("cell"), "band", "rep", "n", "comp", "out",
                         (F.col("comp") == F.col("main")).alias("in_main"), "sig")

    def judge(cell: pa.Table) -> Iterator[tuple]:
        band, rep, n, comp, out, in_main = (np.asarray(cell.column(c)) for c in ("band", "rep", "n", "comp", "out", "in_main"))
        sig = _signatures(cell.column("sig").combine_chunks(), hashes)
        by_band = sig.reshape(len(sig), cfg.bands, cfg.rows)
        right = np.flatnonzero(~out)
        partners: dict[int, bytes] = {}
        for i in np.flatnonzero(out):
            fits = right[(comp[right] != comp[i]) & (in_main[right] | (rep[right] < rep[i]))
                         & (100 * np.minimum(n[right], n[i]) >= cfg.percent * np.maximum(n[right], n[i]))]
            if len(fits):
                kept, matches = _keep(np.broadcast_to(sig[i], (len(fits), hashes)), sig[fits], cfg)
                fits = fits[kept][np.argsort(-matches, kind="stable")]
                first = (by_band[fits] == by_band[i]).all(2).argmax(1) == band[i]
                fits = fits[first]
                if len(fits):
                    partners[int(rep[i])] = rep[fits].tobytes()
                    for r in rep[fits].tolist():
                        partners.setdefault(r, b"")
        if partners:
            of = dict(zip(rep.tolist(), comp.tolist(), strict=True))
            name = cell.column("cell")[0].as_py()
            for r, packed in partners.items():
                yield name, r, of[r], packed

    def verify(cell: pa.Table) -> Iterator[tuple]:
        rep, comp = cell.column("rep").to_pylist(), cell.column("comp").to_pylist()
        sets = {r: np.frombuffer(v.as_buffer(), U) for r, v in zip(rep, cell.column("set"), strict=True)}
        of = dict(zip(rep, comp, strict=True))
        for r, packed in zip(rep, cell.column("partners"), strict=True):
            done = set()
            for other in np.frombuffer(packed.as_buffer(), np.int64).tolist():
                if of[other] not in done and _linked(sets[r], sets[other], cfg.percent):
                    done.add(of[other])
                    yield max(r, other), min(r, other)

    dealt = dealt.repartition("cell").sortWithinPartitions("cell")
    long = pa.int64()
    kept = pa.schema([("cell", long), ("rep", long), ("comp", long), ("partners", pa.binary())])
    left = dealt.mapInArrow(by_run("cell", judge, kept, 2), "cell long, rep long, comp long, partners binary")
    left = stage(left, "survivors")
    sets = _full_sets(left.select(F.col("rep").alias("doc_id")).distinct(), docs, cfg)
    left = left.join(sets.withColumnRenamed("doc_id", "rep"), "rep").repartition("cell").sortWithinPartitions("cell")
    return left.mapInArrow(by_run("cell", verify, pa.schema([("a", long), ("b", long)]), 2), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, cfg: NearDupConfig = NearDupConfig()) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs`` (doc_id, text).

    component_id is the smallest doc_id reachable over links; kept is true for
    that document. Null and word-less texts have no shingles and are linked
    with nothing. A null doc_id is linked with nothing either: component_id
    null, kept true. Rows repeating a doc_id count as one document: where
    their texts differ, their sets are linked by that id. An empty table gives
    an empty result; further columns of ``docs`` are not read.
    """
    small_batches(docs.sparkSession)
    rows = stage(features(docs, cfg), "features")
    full = rows.where("n > 0 and doc_id is not null")
    classes = stage(full.groupBy("f1", "f2", "n").agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig")),
                    "classes")
    bands = _bands(classes, cfg)
    pivots = bands.groupBy("key").agg(F.min(F.struct("rep", "n")).alias("p"), F.count("*").alias("k"),
                                      F.min(F.struct(F.xxhash64("rep").alias("h"), "rep", "n")).alias("q"))
    pivots = pivots.where("k > 1").select("key", F.explode(F.array(
        F.struct(F.col("p.rep").alias("b"), F.col("p.n").alias("m")),
        F.struct(F.col("q.rep").alias("b"), F.col("q.n").alias("m")))).alias("p")).select("key", "p.b", "p.m")
    pairs = bands.join(pivots, "key").where("rep <> b").where(
        F.least("n", "m") * 100 >= F.greatest("n", "m") * cfg.percent)
    pairs = pairs.select(F.greatest("rep", "b").alias("a"), F.least("rep", "b").alias("b")).distinct()
    judged = stage(_judge_pairs(pairs, classes, cfg), "judged")
    best = judged.groupBy("a").agg(F.max_by("b", "matches").alias("b"))
    links = stage(_confirm(stage(best, "best"), docs, cfg), "links")
    labels = stage(roots(links), "labels")  # one best link for each class, to a smaller one: a forest
    of = lambda name: labels.select(F.col("node").alias(name), F.col("component").alias(f"c{name}"))
    rest = judged.select("a", "b").join(best, ["a", "b"], "left_anti").join(of("a"), "a", "left").join(of("b"), "b", "left")
    rest = rest.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")
    more = _confirm(stage(rest, "rest"), docs, cfg)
    cross = _cross(bands, labels.select(F.col("node").alias("rep"), "component"), classes, docs, cfg)
    # the later links join whole trees, so only their roots go through the star joins
    between = more.union(cross).join(of("a"), "a", "left").join(of("b"), "b", "left")
    merged = components(between.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")))
    tree = classes.join(labels, F.col("rep") == F.col("node"), "left").select(
        "f1", "f2", "n", F.coalesce("component", "rep").alias("root"))
    of_class = tree.join(merged, F.col("root") == F.col("node"), "left").select(
        F.col("f1").alias("g1"), F.col("f2").alias("g2"), F.col("n").alias("m"),
        F.coalesce("component", "root").alias("component"))
    same = (F.col("f1") == F.col("g1")) & (F.col("f2") == F.col("g2")) & (F.col("n") == F.col("m")) & F.col("doc_id").isNotNull()
    out = rows.drop("sig").join(of_class, same, "left").withColumn("component_id", F.coalesce("component", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id",
                      F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
