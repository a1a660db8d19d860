"""Toxicity by a weighted finite-state pattern grammar over clauses.

Lexicon: weights of insult and threat words are learned from labelled
documents (a documented, bounded number), counted in Spark: the log odds of whole words and
of word beginnings (stems, for inflected words) between toxic and clean
documents. Equal and near-equal texts form one family, which counts once; an
entry is kept when an exact test on the families passes at a bounded share of
false finds. A word counts with its strongest entry. Target, negation and
reporting words are fixed values.

Grammar: each clause runs through one hand-composed finite-state machine (not
transducers composed by the code). Word classes are the input letters; its states carry whether a target, a negation
or a reporting verb is in force, and a hit (insult or threat word) is emitted
with the weight of the state it is matched in. A clause's score is the sum of
its hits' weights, a document's score a logistic function of its clause
scores, fitted on a bounded, documented sample of the labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftframe.llm.common import small_batches, stage
from siftframe.llm.near_dedup import _multipliers
from siftframe.llm.tokens import LOWER, SPACE, U, Words, buffers, mix, shingle_sets, words

# Closed word classes of the grammar.
TARGETS = "you your yours u ur he she they them we him her du ihr sie tu vous te votre usted tú ustedes"
NEGATIONS = "not no never isn't aren't don't nicht kein keine nie ne pas jamais nunca"
REPORTS = "said says called wrote told quoted claims sagte schrieb dit écrit dijo escribió"
THREATS = "kill hurt destroy beat töten tuer matar"
CLAUSE_END = b".!?;:\n"
THRESHOLD = 0.3

STEM_LETTERS = (4, 5, 6, 7)  # inflected words are caught by their beginnings
STEM_MARK = U(0x7374656D)
OTHER, TARGET, NEGATION, REPORT, THREAT, INSULT = range(6)
_TOKEN = np.ones(256, bool)
_TOKEN[SPACE] = False
for _b in b".,;:!?\"()[]{}<>|*%&$#=+/\\~^`_@":
    _TOKEN[_b] = False


@dataclass(frozen=True)
class ToxicityConfig:
    min_docs: int = 1           # independent toxic documents with an entry; the test decides how many are needed
    min_log_odds: float = 2.0
    false_share: float = 0.05   # share of kept entries that may stand in toxic documents by chance
    lexicon_size: int = 5_000   # heaviest words kept
    fit_rows: int = 100_000     # labelled rows that are learned from, smallest id hashes first; their ids
                                # and labels (some MB) are broadcast, so that no text is shuffled


@dataclass(frozen=True)
class ToxicityModel:
    lexicon: dict[str, float]
    coefficients: tuple[float, ...] = field(default=(-4.0, 1.0, 0.0, 0.0, 0.0, 0.0))

    def word_hashes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted entry hashes with class and weight of everything in the grammar; an entry "x*" is a stem."""
        listed: dict[str, tuple[int, float]] = {}
        for group, text in ((TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS), (THREAT, THREATS)):
            listed.update(dict.fromkeys(text.split(), (group, 1.0)))
        listed.update({w: (INSULT, x) for w, x in self.lexicon.items()})
        names = list(listed)
        data, offsets = buffers(pa.array([n.removesuffix("*") for n in names], pa.string()))
        h = words(data, offsets, np.ones(256, bool)).hashes()
        stem = np.array([n.endswith("*") for n in names])
        h[stem] = mix(h[stem] ^ STEM_MARK)
        order = np.argsort(h)
        return h[order], np.array([listed[n][0] for n in names])[order], np.array([listed[n][1] for n in names])[order]


def fold(data: np.ndarray) -> np.ndarray:
    """ASCII lower case; other letters stay as they are."""
    return LOWER[data]


#: Weight of a hit by what is in force in its clause: (target, negation, report).
FACTORS = {(False, False, False): 1.0, (True, False, False): 1.25, (False, True, False): 0.8, (True, True, False): 0.9,
           (False, False, True): 0.8, (True, False, True): 0.9, (False, True, True): 0.7, (True, True, True): 0.8}


def clause_scores(classes: list[int], weights: list[float]) -> float:
    """The sum of the weights that a clause's words emit."""
    return sum(weights[at] * factor for at, factor in emitted(classes))


def emitted(classes: list[int]) -> list[tuple[int, float]]:
    """Run one clause's classed words through the composed transducers: (place, factor) of each hit that counts.

    A target counts wherever it stands in the clause, so a hit waits in the
    state until the clause ends; negation and reporting hold from where they stand.
    """
    target, negated, reported, held = False, False, False, []
    for at, kind in enumerate(classes):
        if kind == TARGET:
            target = True
        elif kind == NEGATION:
            negated = True
        elif kind == REPORT:
            reported = True
        else:
            held.append((at, kind, negated, reported))
    # a threat needs someone it is aimed at
    return [(at, FACTORS[target, n, r]) for at, kind, n, r in held if target or kind != THREAT]


def entries(w: Words) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(start, end, hash, word) of what the lexicon may hold: whole words, and stems of STEM_LETTERS letters.

    A stem is a proper beginning of a word; it is hashed with its length's
    mark, so a stem and a whole word of the same letters are two entries.
    """
    yield w.starts, w.ends, w.hashes(), np.arange(len(w.starts))
    letter = np.flatnonzero((w.data & 0xC0) != 0x80)
    first = np.searchsorted(letter, w.starts)
    n = len(letter)
    for size in STEM_LETTERS:
        ends = letter[np.minimum(first + size, n - 1)]
        which = np.flatnonzero((first + size < n) & (ends < w.ends))
        starts, ends = w.starts[which], ends[which]
        yield starts, ends, mix(w.range_hashes(starts, ends) ^ STEM_MARK), which


def features(text: pa.Array, table: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """Per text: (sum of clause scores, hits, different hits, log words); hits count with the factor the grammar emits."""
    known, kinds, weights = table
    data, offsets = buffers(text)
    w = words(fold(data), offsets, _TOKEN)
    out = np.zeros((len(offsets) - 1, 4))
    out[:, 3] = np.log1p(w.counts)
    if not len(w.starts):
        return out
    kind, weight = np.zeros(len(w.starts), np.int64), np.zeros(len(w.starts))
    whole = None
    for _, _, h, which in entries(w):
        whole = h if whole is None else whole
        at = np.minimum(np.searchsorted(known, h), len(known) - 1)
        hit = np.flatnonzero(known[at] == h)
        word, at = which[hit], at[hit]
        better = (weights[at] > weight[word]) & ((kind[word] == OTHER) | (kind[word] == INSULT))
        kind[word[better]], weight[word[better]] = kinds[at[better]], weights[at[better]]
    listed = np.flatnonzero(kind)
    if not len(listed):
        return out
    kind, weight = kind[listed], weight[listed]
    clause = np.cumsum(np.isin(data, np.frombuffer(CLAUSE_END, np.uint8)))[w.starts[listed]]
    doc = np.searchsorted(w.first, listed, side="right") - 1
    cuts = np.flatnonzero((clause[1:] != clause[:-1]) | (doc[1:] != doc[:-1])) + 1
    edges = [0, *cuts.tolist(), len(listed)]
    seen: dict[int, dict[int, float]] = {}
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        if kind[lo:hi].max() < THREAT:
            continue
        d = int(doc[lo])
        for at, factor in emitted(kind[lo:hi].tolist()):
            at += lo
            out[d, 0] += weight[at] * factor
            out[d, 1] += factor
            word, strongest = int(whole[listed[at]]), seen.setdefault(d, {})
            strongest[word] = max(strongest.get(word, 0.0), factor)
    for d, strongest in seen.items():
        out[d, 2] = sum(strongest.values())
    return out


def _probability(x: np.ndarray, coefficients: tuple[float, ...]) -> np.ndarray:
    """Logistic of the clause scores' sum (dampened), the hits and the text's length; without a hit: the bias alone."""
    return 1 / (1 + np.exp(-np.clip(_design(x) @ np.array(coefficients), -30, 30)))


def _design(x: np.ndarray) -> np.ndarray:
    hits, different = np.minimum(x[:, 1], 8), np.minimum(x[:, 2], 8)
    return np.stack([np.ones(len(x)), np.log1p(x[:, 0]), hits, different, np.minimum(different, 2), x[:, 3] * (hits > 0)], 1)


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


SHINGLE, BANDS, HASHES = 5, 12, 48  # words a shingle; MinHash values, and bands they are looked up by
ALIKE = 32  # of HASHES values equal: a similarity of about two thirds


def sketches(rows: DataFrame) -> DataFrame:
    """(row, toxic, sig): the MinHash signature of each row's words, empty for a text without words."""
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mul, add = _multipliers(HASHES)
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            values, ranges = shingle_sets(words(fold(data), offsets, _TOKEN), SHINGLE)
            full = np.flatnonzero(np.diff(ranges))
            sig = np.zeros((batch.num_rows, HASHES), np.uint32)
            for j in range(HASHES if len(full) else 0):
                sig[full, j] = np.minimum.reduceat(((values * mul[j] + add[j]) >> U(32)).astype(np.uint32), ranges[:-1][full])
            held = set(full.tolist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("toxic"),
                 pa.array([x.tobytes() if i in held else b"" for i, x in enumerate(sig)], pa.binary())],
                names=["row", "toxic", "sig"])

    return rows.select("row", "toxic", "text").mapInArrow(make, "row long, toxic int, sig binary")


def families(sig: np.ndarray) -> np.ndarray:
    """For each signature the smallest index of its family of (near-)equal ones.

    Signatures that share a band are compared with the band's first and with
    the one before; those with ALIKE equal values are linked.
    """
    n, rows = len(sig), HASHES // BANDS
    label = np.arange(n)
    links = []
    for b in range(BANDS if n else 0):
        key = np.zeros(n, U)
        for r in range(rows):
            key = mix(key ^ (sig[:, b * rows + r].astype(U) + U(r << 40)))
        order = np.argsort(key, kind="stable")
        new = np.concatenate(([True], key[order][1:] != key[order][:-1]))
        first = order[np.maximum.accumulate(np.where(new, np.arange(n), 0))]
        later = np.flatnonzero(~new)
        for other in (first[later], order[later - 1]):
            links.append(np.stack([order[later], other], 1))
    pairs = np.unique(np.concatenate(links), axis=0) if links else np.zeros((0, 2), np.int64)
    alike = np.concatenate([np.zeros(0, bool), *[
        (sig[p[:, 0]] == sig[p[:, 1]]).sum(1) >= ALIKE for p in np.array_split(pairs, len(pairs) // 100_000 + 1)]])
    a, b = pairs[alike].T
    while True:
        low = np.minimum(label[a], label[b])
        made = label.copy()
        for end in (label[a], label[b], a, b):
            np.minimum.at(made, end, low)
        made = made[made]
        if np.array_equal(made, label):
            return label
        label = made


def _choose(n: int, of: np.ndarray) -> np.ndarray:
    """Logarithms of the binomials n over each of ``of``."""
    logs = np.concatenate(([0.0], np.cumsum(np.log(np.arange(1, n + 1)))))
    return logs[n] - logs[of] - logs[n - of]


def chance(bad: int, good: int, size: tuple[int, int]) -> float:
    """Probability that of bad + good documents drawn from ``size`` (toxic, clean) at least ``bad`` are toxic."""
    n = bad + good
    k = np.arange(max(bad, n - size[1]), min(n, size[0]) + 1)
    return float(np.exp(_choose(size[0], k) + _choose(size[1], n - k) - _choose(sum(size), np.array([n]))).sum())


def significance(pairs: list[tuple[int, int, int]], totals: list[tuple[int, int]], size: tuple[int, int], share: float) -> float:
    """Largest ``chance`` at which at most ``share`` of the accepted entries are expected to be false.

    ``pairs`` has (bad, good, entries) of the candidates, ``totals`` (bad +
    good, entries) of all entries. Benjamini-Hochberg; entries that stand in
    too few documents ever to reach a level are not tested at it (Tarone), so
    the level is as good for few documents as for many.
    """
    if not pairs or not min(size):
        return -1.0
    n, held = np.array(sorted(totals), np.int64).T
    k = np.minimum(n, size[0])
    least = np.exp(_choose(size[0], k) + _choose(size[1], n - k) - _choose(sum(size), n))
    order = np.argsort(least, kind="stable")
    least, held = least[order], np.cumsum(held[order])
    found, best = 0, -1.0
    scored = sorted((chance(b, g, size), c) for b, g, c in pairs)
    for i, (p, c) in enumerate(scored):
        found += c
        if i + 1 < len(scored) and scored[i + 1][0] == p:
            continue
        tested = held[max(np.searchsorted(least, p * (1 + 1e-9), side="right") - 1, 0)]
        if p * tested <= share * found:
            best = p
    return best


ROW = [("h", U), ("family", np.int64), ("bad", np.int64), ("good", np.int64), ("s", np.int64), ("e", np.int64), ("stem", np.int64)]


def learn_lexicon(labelled: DataFrame, size: tuple[int, int], cfg: ToxicityConfig) -> dict[str, float]:
    """Entry weights from (text, toxic, family) rows, counted over all of them.

    A family counts once for each label it has, with the entries of all its
    rows; a negative family stands for a row of its own. ``size`` has the
    toxic and the clean ones. Each task counts the documents with an entry by
    its hash before anything is shuffled; the letters of an entry travel with
    its count.
    """
    def tally(parts: list[np.ndarray]) -> np.ndarray:
        """Counts summed by hash and family: rows of ROW."""
        rows = np.concatenate(parts)
        rows = rows[np.lexsort((rows["family"], rows["h"]))]
        at = np.flatnonzero(np.concatenate(([True], (rows["h"][1:] != rows["h"][:-1]) | (rows["family"][1:] != rows["family"][:-1]))))
        out = rows[at]
        if len(at):
            out["bad"], out["good"] = np.add.reduceat(rows["bad"], at), np.add.reduceat(rows["good"], at)
        return out

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            w = words(fold(data), offsets, _TOKEN)
            if not len(w.starts):
                continue
            toxic, family = np.asarray(batch.column("toxic")) == 1, np.asarray(batch.column("family"))
            of = np.repeat(np.arange(batch.num_rows), w.counts)
            kept, names = [], w.data
            for starts, ends, h, which in entries(w):
                size = ends - starts
                pick = np.flatnonzero(size <= 40)
                order = pick[np.lexsort((of[which[pick]], h[pick]))]
                hs, ds = h[order], of[which[order]]
                first = np.concatenate(([True], (hs[1:] != hs[:-1]) | (ds[1:] != ds[:-1]))) if len(hs) else np.zeros(0, bool)
                rows = np.zeros(int(first.sum()), ROW)
                rows["h"], rows["s"], rows["e"] = hs[first], starts[order[first]], ends[order[first]]
                rows["stem"], rows["bad"] = len(kept) > 0, toxic[ds[first]]
                rows["good"], rows["family"] = 1 - rows["bad"], family[ds[first]]
                kept.append(rows)
            done = tally(kept)
            yield pa.RecordBatch.from_arrays(
                [pa.array(done["h"].view(np.int64)), pa.array(done["family"]), pa.array(done["bad"]), pa.array(done["good"]),
                 pa.array([names[s:e].tobytes() + b"*" * stem for s, e, stem in zip(
                     done["s"].tolist(), done["e"].tolist(), done["stem"].tolist(), strict=True)], pa.binary())],
                names=["h", "family", "bad", "good", "name"])

    found = labelled.select("text", "toxic", "family").mapInArrow(count, "h long, family long, bad long, good long, name binary")
    found = found.groupBy("h", "family").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"), F.first("name").alias("name"))
    once = lambda c: F.sum(F.when(F.col("family") < 0, F.col(c)).otherwise(F.least(F.col(c), F.lit(1)))).alias(c)
    by_entry = found.groupBy("h").agg(once("bad"), once("good"), F.first("name").alias("name"))
    by_entry = stage(by_entry.select(F.col("name").cast("string").alias("word"), "bad", "good"), "entries")
    odds = F.log((F.col("bad") + 0.5) / (size[0] + 1)) - F.log((F.col("good") + 0.5) / (size[1] + 1))
    kept = by_entry.withColumn("weight", odds).where((F.col("bad") >= cfg.min_docs) & (F.col("weight") >= cfg.min_log_odds))
    pairs = [tuple(r) for r in kept.groupBy("bad", "good").count().collect()]
    totals = [tuple(r) for r in by_entry.groupBy((F.col("bad") + F.col("good")).alias("n")).count().collect()]
    level = significance(pairs, totals, size, cfg.false_share)
    passed = [(b, g) for b, g, _ in pairs if chance(b, g, size) <= level]
    if not passed:
        return {}
    passed = labelled.sparkSession.createDataFrame(passed, "bad long, good long")
    kept = kept.join(F.broadcast(passed), ["bad", "good"], "left_semi")
    kept = kept.orderBy(F.desc(F.col("weight") * F.log1p("bad")), "word").limit(cfg.lexicon_size)
    return {r["word"]: float(r["weight"]) for r in kept.select("word", "weight").collect()}


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first row of each doc_id that a task meets, so that repeated rows are not written."""
    met: set[int] = set()
    for batch in batches:
        new = []
        for at, i in enumerate(batch.column("doc_id").to_pylist()):
            if i not in met:
                met.add(i)
                new.append(at)
        yield batch.take(pa.array(new, pa.int64()))


def fit(docs: DataFrame, labels: DataFrame, cfg: ToxicityConfig = ToxicityConfig()) -> ToxicityModel:
    """Learn from the labelled rows of ``docs`` that are not held out.

    Rows without text, label or id are left aside; of rows that repeat an id
    one is learned from, that of the smallest text hash. Equal and near-equal texts
    count as one, in the lexicon and (by weight) in the logistic model. Without
    a toxic row the lexicon is empty and the model gives every text the same
    low score.
    """
    spark = docs.sparkSession
    small_batches(spark)
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.where(~held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id").limit(cfg.fit_rows)
    docs = docs.select("doc_id", "text").where("text is not null")
    digest = F.xxhash64("text")
    rows = docs.join(F.broadcast(stage(known, "labels")), "doc_id")
    chosen = rows.groupBy("doc_id").agg(F.min(digest).alias("digest"), F.first("toxic").cast("int").alias("toxic"))
    rows = docs.join(F.broadcast(stage(chosen, "chosen")), "doc_id").where(digest == F.col("digest"))
    rows = rows.select("doc_id", "text", "toxic").mapInArrow(_once, "doc_id long, text string, toxic int")
    rows = stage(rows.withColumn("row", F.monotonically_increasing_id()), "labelled")
    first = rows.groupBy("doc_id").agg(F.min("row").alias("row")).select("row")
    rows = rows.join(F.broadcast(stage(first, "first")), "row")
    seen = sketches(rows).toPandas().sort_values("row")
    seen = seen[seen["sig"].str.len() > 0]
    sig = np.frombuffer(b"".join(seen["sig"]), np.uint32).reshape(-1, HASHES)
    seen["family"] = families(sig)
    toxic = seen["toxic"] == 1
    size = seen["family"][toxic].nunique(), seen["family"][~toxic].nunique()
    seen["share"] = 1.0 / seen.groupby(["family", toxic])["row"].transform("size")
    alone = ~seen["family"].duplicated(keep=False)
    of_row = spark.createDataFrame(pa.table({
        "row": seen["row"].to_numpy(np.int64), "family": np.where(alone, -1, seen["family"]).astype(np.int64),
        "share": seen["share"].to_numpy(float)}))
    rows = rows.join(F.broadcast(stage(of_row, "families")), "row")
    model = ToxicityModel(learn_lexicon(rows, size, cfg))
    table = model.word_hashes()

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features(batch.column("text"), table)
            yield pa.RecordBatch.from_arrays([batch.column("row"), *[pa.array(c) for c in x.T], batch.column("share"), batch.column("toxic")],
                                             names=["row", "x0", "x1", "x2", "x3", "share", "toxic"])

    made = rows.mapInArrow(measure, "row long, x0 double, x1 double, x2 double, x3 double, share double, toxic int")
    made = made.toPandas().sort_values("row")
    return ToxicityModel(model.lexicon, _fit_logistic(made[["x0", "x1", "x2", "x3"]].to_numpy(float),
                                                      made["toxic"].to_numpy(float), made["share"].to_numpy(float)))


def _fit_logistic(x: np.ndarray, y: np.ndarray, share: np.ndarray) -> tuple[float, ...]:
    """Newton steps with a small ridge; ``share`` weighs the rows."""
    if not len(y) or y.min() == y.max():
        return ToxicityModel({}).coefficients
    d = _design(x)
    beta = np.zeros(d.shape[1])
    ridge = np.diag([1e-6, *[0.1] * (d.shape[1] - 1)])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(d @ beta, -30, 30)))
        step = np.linalg.solve(d.T @ (d * (share * p * (1 - p))[:, None]) + ridge, d.T @ (share * (y - p)) - ridge @ beta)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return tuple(beta.tolist())


def toxicity(text: Column, model: ToxicityModel) -> Column:
    """Score of a text column, 0 to 1; null counts as empty."""
    table, coefficients = model.word_hashes(), model.coefficients

    @F.arrow_udf("double")
    def score(column: pa.Array) -> pa.Array:
        return pa.array(_probability(features(column, table), coefficients))

    return score(text)


def score_documents(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``.

    Null and empty texts get the score of a text without a hit. Rows are
    judged one by one, so repeated rows and null ids need no rule; further
    columns are not read.
    """
    small_batches(docs.sparkSession)
    out = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), toxicity(F.col("text"), model).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
