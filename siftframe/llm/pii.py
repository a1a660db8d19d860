"""Personal data: high-recall span generators, boosted trees, calibrated thresholds.

Generators are regular expressions whose matches keep their code-point
positions: the pieces between the matches and the matches themselves give
every start. Base kinds (email, ip, card, phone) carry their own check and
always stay. Further generators propose overlapping spans; gradient boosted
trees over format and context features, taught by the base kinds' checks,
score them, and one threshold for all of them, calibrated to the wanted precision
on held-out base spans, selects the redactions. Everything is a DataFrame expression.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftframe.llm.common import stage

# The base patterns. Repeats that no later part could need back
# are possessive, and a look-behind (or the end of the match before) stops a
# search from starting inside a run that has already failed.
BASE = {
    "email": (r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    "ip": (r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "."),
    "card": (r"[0-9](?:[\x20-]?[0-9])++", ""),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "+"),
}
# The generators that the trees judge.
MORE = {
    "number": r"(?<![0-9+])(?:\([0-9]{2,4}\)[\x20-]?|[0-9])(?:[\x20().-]{0,2}[0-9]){7,24}+(?![0-9])",
    "mailbox": r"(?i)(?<![a-z0-9._-])[a-z0-9][a-z0-9._-]{0,60}+\x20?(?:\(at\)|\[at\]|@)\x20?[a-z0-9-]{1,60}+(?:\x20?(?:\(dot\)|\[dot\]|\.)\x20?[a-z0-9-]{1,60}+){0,6}+",
    "secret": r"(?i)(?<![a-z])(?:password|passwd|secret|token|api[_-]?key)\x20{0,2}[=:]\x20{0,2}[^\x20\x09-\x0D]{4,200}+",
}
KINDS = (*BASE, *MORE)
CONTEXT = 24  # code points before a span that count as its context
FEATURES = ("f_len", "f_digits", "f_letters", "f_at", "f_plus", "f_dots", "f_seps", "f_groups", "f_word_before",
            "f_call", "f_mail", "f_pay", "f_net", "f_key", "f_line_start")


@dataclass(frozen=True)
class PiiConfig:
    fit_spans: int = 100_000    # labelled spans the trees are fitted on, smallest hashes first
    trees: int = 12
    depth: int = 4
    precision: float = 0.95     # wanted on held-out spans at the threshold
    seed: int = 11


def matches(text: Column, pattern: str) -> Column:
    """Array of (start, end, match) of all leftmost non-overlapping matches, in code points, end exclusive.

    Splitting at the pattern gives the pieces between its matches, so match i
    starts after i + 1 pieces and i matches.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.split(text, pattern, -1)
    both = F.arrays_zip(found.alias("m"), F.transform(pieces, lambda p: F.length(p)).alias("p"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,match:string>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        s = acc["at"] + x["p"]
        e = s + F.coalesce(F.length(x["m"]), F.lit(0))
        span = F.struct(s.alias("start"), e.alias("end"), x["m"].alias("match"))
        return F.struct(e.alias("at"), F.when(x["m"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(span))).alias("out"))

    return F.aggregate(both, start, step)["out"]


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def value(i: Column) -> Column:
        d = F.substr(digits, n - i, F.lit(1)).cast("int")
        twice = F.when(i % 2 == 1, d * 2).otherwise(d)
        return F.when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda a, i: a + value(i)) % 10 == 0


def valid(kind: str, m: Column) -> Column:
    """Whether a match of a base pattern passes its kind's check."""
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: F.ltrim(p, F.lit("0")).rlike("^(?:[0-9]{0,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    n = F.length(_digits(m))
    if kind == "card":
        return F.when(n.between(13, 19), _luhn(_digits(m))).otherwise(F.lit(False))
    if kind == "phone":
        return n.between(9, 15)
    return F.lit(True)


def _spans(kind: str, pattern: str, text: Column) -> Column:
    """Array of (kind, start, end, match, ok) for one generator."""
    def span(s: Column) -> Column:
        ok = valid(kind, s["match"]) if kind in BASE else F.lit(None).cast("boolean")
        return F.struct(F.lit(KINDS.index(kind)).alias("k"), s["start"].alias("start"), s["end"].alias("end"),
                        s["match"].alias("match"), ok.alias("ok"))

    return F.transform(matches(text, pattern), span)


def candidates(docs: DataFrame) -> DataFrame:
    """(row, doc_id, k, start, end, match, ok, before) of every generator's matches; ok is null outside the base kinds.

    A generator runs only on texts that hold a character it needs, and one
    kind at a time, so a text without digits and marks costs one look.
    """
    hints = {"email": "@", "ip": "[0-9]\\.[0-9]", "card": "[0-9]", "phone": "\\+[0-9]", "number": "[0-9]",
             "mailbox": "@|\\(at\\)|\\[at\\]", "secret": "[=:]"}
    text = F.col("text")
    none = F.array().cast("array<struct<k:int,start:int,end:int,match:string,ok:boolean>>")
    patterns = {**{k: p for k, (p, _) in BASE.items()}, **MORE}
    found = docs.where(F.col("text").rlike("[0-9@=:]|\\(at\\)|\\[at\\]"))
    lists = [F.when(text.rlike(hints[k]), _spans(k, p, text)).otherwise(none) for k, p in patterns.items()]
    spans = found.select("row", "doc_id", "text", F.explode(F.concat(*lists)).alias("s"))
    low = F.greatest(F.lit(0), F.col("s.start") - CONTEXT)
    return spans.select("row", "doc_id", "s.*", F.lower(F.substr("text", low + 1, F.col("s.start") - low)).alias("before"))


def with_features(spans: DataFrame) -> DataFrame:
    """Format features of the match and context features of what stands before it."""
    m, before = F.col("match"), F.col("before")
    count = lambda pattern: F.length(m) - F.length(F.regexp_replace(m, pattern, ""))
    has = lambda pattern: before.rlike(pattern).cast("double")
    made = {
        "f_len": F.length(m), "f_digits": count("[0-9]"), "f_letters": count("[A-Za-z]"), "f_at": count("@"),
        "f_plus": count("\\+"), "f_dots": count("\\."), "f_seps": count("[ ()-]"),
        "f_groups": F.size(F.split(m, "[^0-9A-Za-z]+")), "f_word_before": has("[a-z0-9]$"),
        "f_call": has("tel|phone|call|fax|mobil"), "f_mail": has("mail|contact|write"), "f_pay": has("card|visa|iban|konto|pay"),
        "f_net": has("\\bip\\b|host|server|addr"), "f_key": has("pass|key|token|secret"), "f_line_start": has("^$|\\n$"),
    }
    return spans.withColumns({k: v.cast("double") for k, v in made.items()})


def _assembled(spans: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(with_features(spans))


def _scores(model, spans: DataFrame) -> DataFrame:
    return model.transform(_assembled(spans)).withColumn("p", vector_to_array("probability")[1])


def select_more(spans: DataFrame, cfg: PiiConfig) -> DataFrame:
    """The rows of the further generators that the calibrated trees accept.

    The trees learn from the base generators' matches, with their checks as
    labels, on a bounded sample by hash; thresholds are calibrated on matches
    of other documents. Without both labels nothing is accepted.
    """
    taught = spans.where("ok is not null").withColumn("label", F.col("ok").cast("double"))
    part = F.pmod(F.xxhash64("doc_id", "row"), F.lit(4))
    seen = taught.where(part != 3).orderBy(F.xxhash64("row", "k", "start")).limit(cfg.fit_spans)
    if seen.select("label").distinct().count() < 2:
        return spans.where("ok is null").limit(0)
    model = GBTClassifier(maxIter=cfg.trees, maxDepth=cfg.depth, seed=cfg.seed, labelCol="label").fit(
        _assembled(stage(seen, "taught")))
    held = _scores(model, taught.where(part == 3)).select("label", F.round("p", 2).alias("p"))
    # calibration: on the 101 rounded scores, the lowest from which on the wanted precision holds
    curve = held.groupBy("p").agg(F.sum("label").alias("good"), F.count("*").alias("n")).orderBy(F.desc("p")).collect()
    good = n = 0.0
    threshold = 1.01
    for row in curve:
        good, n = good + row["good"], n + row["n"]
        if good >= cfg.precision * n:
            threshold = row["p"]
    return _scores(model, spans.where("ok is null")).where(F.col("p") >= threshold - 0.005)


def find_pii(docs: DataFrame, cfg: PiiConfig = PiiConfig()) -> DataFrame:
    """(doc_id, spans) for every row of ``docs`` (doc_id, text): spans as (k, start, end, base), k an index of KINDS.

    Spans of the base kinds always stay; spans of the further kinds are those
    the trees accept. Null and empty texts have none. Rows that repeat a
    doc_id are judged each on its own text; further columns are not read.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumn("row", F.xxhash64("doc_id", "text"))
    spans = stage(candidates(docs), "spans")
    base = spans.where("ok").select("row", "k", "start", "end", F.lit(True).alias("base"))
    more = select_more(spans, cfg).select("row", "k", "start", "end", F.lit(False).alias("base"))
    by_row = base.union(more).distinct().groupBy("row").agg(
        F.sort_array(F.collect_list(F.struct("k", "start", "end", "base"))).alias("spans"))  # one text's spans
    return docs.select("doc_id", "row").join(by_row, "row", "left").select("doc_id", "spans")


def redact(text: Column, spans: Column) -> Column:
    """``text`` with every span of ``spans`` (start, end) overwritten by asterisks."""
    def cover(acc: Column, s: Column) -> Column:
        return F.concat(F.substr(acc, F.lit(1), s["start"]), F.repeat(F.lit("*"), s["end"] - s["start"]),
                        F.substr(acc, s["end"] + 1))

    return F.when(spans.isNull(), text).otherwise(F.aggregate(spans, text, cover))


def digests(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, the digest of the base spans and all spans as text."""
    spans = F.coalesce("spans", F.array().cast("array<struct<k:int,start:int,end:int,base:boolean>>"))
    base = F.filter(spans, lambda s: s["base"])
    name = F.array(*[F.lit(k) for k in KINDS])
    text = lambda list_: F.array_join(F.transform(list_, lambda s: F.concat_ws(
        ":", F.element_at(name, s["k"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
    of = lambda i: F.filter(base, lambda s: s["k"] == i)
    counts = [F.size(of(i)).cast("long").alias(f"n_{k}") for i, k in enumerate(BASE)]
    return found.select("doc_id", *counts, F.sha2(text(base), 256).alias("base_sha256"), text(spans).alias("spans"))
