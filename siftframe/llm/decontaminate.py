"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact similarity.

A window as long as an item reaches the wanted similarity only if it holds
enough shingle places whose shingle is the item's too, and moving its start
on to the next such place loses none of them. So windows are laid at every
place where a document meets an item's shingle and enough further ones follow
within the item's length; no other window can be better. An item of fewer
words than a shingle is one shingle of its own size, and documents are read
in runs of that size as well.
Every window and item gets a 64-bit SimHash of its weighted shingles (weight:
occurrences). Items are indexed by eight blocks of eight bits, each with all
values within two bits: two fingerprints that differ in at most 23 bits differ
in at most two bits of some block, so the index misses nothing within RADIUS.
Candidates within RADIUS are verified by the exact weighted similarity of
their shingle multisets, sum of minima over sum of maxima. The native path is
DataFrame expressions only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftframe.llm.bloom import prefilter
from siftframe.llm.common import stage

BLOCKS, BLOCK_BITS, BLOCK_RADIUS = 8, 8, 2
RADIUS = BLOCKS * (BLOCK_RADIUS + 1) - 1


@dataclass(frozen=True)
class DecontaminationConfig:
    shingle: int = 5
    percent: int = 80


def _words(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    bare = F.btrim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^\\p{L}\\p{N}]++", " "))
    return F.when(bare != "", F.split(bare, " ")).otherwise(F.array().cast("array<string>"))


def _shingles(words: Column, size: int) -> Column:
    """Array of (at, h) of all runs of ``size`` words; none if there are fewer words."""
    last = F.size(words) - size
    runs = F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(
        i.alias("at"), F.xxhash64(*[F.get(words, i + k) for k in range(size)]).alias("h")))
    return F.when(last >= 0, runs).otherwise(F.array().cast("array<struct<at:int,h:bigint>>"))


def _own_shingles(words: Column, size: int) -> Column:
    """The shingles of an item or a window: one as a whole if it is shorter than a shingle."""
    made = _shingles(words, size)
    for short in range(1, size):
        made = F.when(F.size(words) == short, _shingles(words, short)).otherwise(made)
    return made


def _placed(texts: DataFrame, sizes: list[int]) -> DataFrame:
    """(doc_id, row, n, at, h): the runs of each of ``sizes`` words (descending) in ``texts`` (doc_id, row, words).

    The words of a place stand side by side in one row, so they are hashed by
    compiled code; a function over the array would be interpreted, word by word.
    """
    words, n = F.col("words"), F.size("words")
    places = F.greatest(n - sizes[-1] + 1, F.lit(0))
    side = F.arrays_zip(*[F.slice(words, F.lit(k + 1), places).alias(f"w{k}") for k in range(sizes[0])])
    rows = texts.select("doc_id", "row", n.alias("n"), F.posexplode(side).alias("at", "s"))
    runs = [F.xxhash64(*[F.col(f"s.w{k}") for k in range(size)]) for size in sizes]
    if len(runs) == 1:
        return rows.select("doc_id", "row", "n", "at", runs[0].alias("h"))
    whole = [F.when(F.col("at") + size <= F.col("n"), h) for size, h in zip(sizes, runs, strict=True)]
    return rows.select("doc_id", "row", "n", "at", F.explode(F.array_compact(F.array(*whole))).alias("h"))


def _fingerprints(shingles: DataFrame, *key: str) -> DataFrame:
    """(key.., fp): the SimHash of each key's shingles (h, weight)."""
    bit = lambda i: F.shiftrightunsigned("h", i).bitwiseAND(1)
    votes = shingles.groupBy(*key).agg(*[F.sum(F.col("weight") * (bit(i) * 2 - 1)).alias(f"v{i}") for i in range(64)])
    fp = F.lit(0).cast("long")
    for i in range(64):
        fp = fp.bitwiseOR(F.when(F.col(f"v{i}") > 0, F.shiftleft(F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    return votes.select(*key, fp.alias("fp"))


def _block(i: int) -> Column:
    return F.shiftrightunsigned("fp", i * BLOCK_BITS).bitwiseAND((1 << BLOCK_BITS) - 1)


def _blocks() -> Column:
    return F.explode(F.array(*[F.struct(F.lit(i).alias("block"), _block(i).alias("value")) for i in range(BLOCKS)]))


def _near_values() -> list[int]:
    return [m for m in range(1 << BLOCK_BITS) if m.bit_count() <= BLOCK_RADIUS]


def _starts(hits: DataFrame, cfg: DecontaminationConfig) -> DataFrame:
    """(doc_id, row, start, length): places of ``hits`` from which on enough hits stand within the item's length.

    With c common shingles of tw and ti, c / (tw + ti - c) >= percent asks for
    c >= percent * (tw + ti) / (100 + percent), and c is at most the number of
    places that the window shares with the item.
    """
    by_item = hits.groupBy("doc_id", "row", "item", "length", "n").agg(F.sort_array(F.collect_set("at")).alias("ats"))
    size = F.least(F.col("length"), F.lit(cfg.shingle))
    by_item = by_item.withColumn("full", F.col("length") - size + 1).withColumn("places", F.col("n") - size + 1)

    def enough(a: Column, i: Column) -> Column:
        held = F.least(F.col("full"), F.col("places") - a)
        least = F.ceil((held + F.col("full")) * F.lit(cfg.percent) / F.lit(100.0 + cfg.percent) - F.lit(1e-9)).cast("int")
        return F.coalesce(F.get("ats", i + least - 1) < a + F.col("full"), F.lit(False))

    return by_item.select("doc_id", "row", F.explode(F.filter("ats", enough)).alias("start"), "length").distinct()


def contaminated(docs: DataFrame, benchmark: DataFrame, cfg: DecontaminationConfig = DecontaminationConfig()) -> DataFrame:
    """(doc_id, item_id, similarity, start, n_words): documents that hold a window like a benchmark item.

    One row for each such document and item, with its most similar window
    (start in words). Texts are lower-cased and cut into runs of letters and
    digits. Windows are as long as the item, or reach to the document's end.
    Null or word-less texts and items match nothing; rows with a null doc_id
    or item_id are left aside; repeated rows count once; an item of fewer
    words than a shingle is found where all its words stand in a row. Empty
    tables give an empty result; further columns are not read.
    """
    size = cfg.shingle
    items = benchmark.where("item_id is not null").select("item_id", _words(F.col("text")).alias("words"))
    items = items.select("item_id", "words", F.size("words").alias("length")).where("length > 0").distinct()
    items = stage(items.withColumn("item", F.monotonically_increasing_id()), "items")
    shingles = items.select("item", "length", F.explode(_own_shingles(F.col("words"), size)).alias("s"))
    item_sets = stage(shingles.groupBy("item", "length", "s.h").agg(F.count("*").alias("weight")), "item-sets")
    index = stage(_fingerprints(item_sets, "item", "length").withColumnRenamed("fp", "item_fp"), "item-index")
    short = sorted(r["length"] for r in items.where(F.col("length") < size).select("length").distinct().collect())

    texts = docs.where("doc_id is not null").select("doc_id", _words(F.col("text")).alias("words"))
    texts = texts.withColumn("row", F.xxhash64("words"))
    hits = prefilter(_placed(texts, [size, *reversed(short)]), "h", item_sets.select("h")).join(item_sets.select("h", "item", "length"), "h")
    windows = stage(_starts(hits, cfg), "windows")
    of_row = stage(windows.groupBy("doc_id", "row").agg(F.collect_set(F.struct("start", "length")).alias("w")), "of-row")
    cut = prefilter(texts, "row", of_row.select("row")).join(of_row, ["doc_id", "row"]).dropDuplicates(["doc_id", "row"])
    cut = cut.select("doc_id", "words", F.explode("w").alias("w")).select(
        "doc_id", F.col("w.start").alias("start"), F.col("w.length").alias("length"),
        F.expr("slice(words, w.start + 1, w.length)").alias("words"))
    cut = stage(cut.withColumn("digest", F.md5(F.array_join("words", " "))), "cut")
    # equal windows, wherever they stand, are judged once
    distinct = cut.groupBy("digest", "length").agg(F.first("words").alias("words"))
    distinct = stage(distinct.withColumn("window", F.monotonically_increasing_id()), "distinct-windows")
    sets = distinct.select("window", "length", F.explode(_own_shingles(F.col("words"), size)).alias("s"))
    sets = stage(sets.groupBy("window", "length", "s.h").agg(F.count("*").alias("weight")), "window-sets")
    prints = _fingerprints(sets, "window", "length")

    near = F.array(*[F.lit(v).cast("long") for v in _near_values()])
    probes = index.select("item", "length", "item_fp", F.col("item_fp").alias("fp")).select("item", "length", "item_fp", _blocks())
    probes = probes.select("item", "length", "item_fp", F.col("col.block").alias("block"), F.col("col.value").alias("own"),
                           F.explode(near).alias("flip")).withColumn("value", F.col("own").bitwiseXOR(F.col("flip")))
    asked = prints.select("window", "length", "fp", _blocks()).select("window", "length", "fp", "col.block", "col.value")
    pairs = asked.join(probes, ["length", "block", "value"]).where(
        F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= RADIUS).select("window", "item").distinct()
    pairs = stage(pairs, "pairs")

    total_w = sets.groupBy("window").agg(F.sum("weight").alias("tw"))
    total_i = item_sets.groupBy("item").agg(F.sum("weight").alias("ti"))
    common = pairs.join(sets.select("window", "h", "weight"), "window").join(
        item_sets.select("item", "h", F.col("weight").alias("iw")), ["item", "h"])
    common = common.groupBy("window", "item").agg(F.sum(F.least("weight", "iw")).alias("c"))
    judged = common.join(total_w, "window").join(total_i, "item")
    judged = judged.where(F.col("c") * 100 >= (F.col("tw") + F.col("ti") - F.col("c")) * cfg.percent)
    judged = judged.select("window", "item", (F.col("c") / (F.col("tw") + F.col("ti") - F.col("c"))).alias("similarity"))
    found = cut.select("doc_id", "digest", "start", "length").join(
        distinct.select("digest", "length", "window"), ["digest", "length"]).join(judged, "window").join(
        items.select("item", "item_id"), "item")
    best = found.groupBy("doc_id", "item_id").agg(F.max(F.struct("similarity", -F.col("start"), "length")).alias("b"))
    return best.select("doc_id", "item_id", "b.similarity", (-F.col("b.col2")).alias("start"), F.col("b.length").alias("n_words"))
