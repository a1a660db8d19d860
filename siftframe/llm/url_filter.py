"""URL filtering: a blocked Bloom filter of listed canonical URLs, then an exact hash join.

Listed entries are (host, path, verdict, rule): an entry fits its host and all
subdomains when the path starts with the entry's. A URL's candidate keys are
every suffix of its host at a dot with every beginning of its path whose
length some entry has. The Bloom filter passes the keys that may be listed;
they are joined exactly with the list, which removes false positives, and the
longest entry decides. Equal URLs are judged once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftframe.llm import bloom
from siftframe.llm.common import lower_ascii, stage

# The rules of the contract as (host, path, verdict).
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
# Listed spam hosts, judged by the method where no rule fits.
SPAM = ("casino-win.example.com", "spam-farm.example.com", "cheap-pills.example.com",
        "casino-win.example.org", "spam-farm.example.org", "cheap-pills.example.org")


def default_list(spark: SparkSession) -> DataFrame:
    """(host, path, verdict, is_rule) of the rules and the listed spam hosts."""
    values = ", ".join([f"('{h}', '{p}', '{v}', true)" for h, p, v in RULES] + [f"('{h}', '', 'block', false)" for h in SPAM])
    return spark.sql(f"SELECT * FROM VALUES {values} AS t(host, path, verdict, is_rule)")


def parts(urls: DataFrame) -> DataFrame:
    """``urls`` (url) with host (A-Z lower-cased) and path; both empty for null or without "://"."""
    rest = F.regexp_extract(F.coalesce("url", F.lit("")), r"(?s)^.*?://(.*)$", 1)
    return urls.withColumn("host", lower_ascii(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1))).withColumn(
        "path", F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1))


def judge_urls(pages: DataFrame, listed: DataFrame, default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row of ``pages`` (page_id, url).

    ``listed`` has host, path, verdict and is_rule. The longest rule that fits
    decides; where none does, the longest other entry, else ``default``. rule
    is the deciding rule's host and path, null without one. Null URLs and URLs
    without "://" have empty host and path and fit nothing. Repeated rows and
    null ids are kept as they are; further columns are not read.
    """
    listed = stage(listed.select("host", "path", "verdict", "is_rule").dropDuplicates(["host", "path", "is_rule"]), "listed")
    listed = listed.withColumn("key", F.concat_ws("\u0001", "host", "path"))
    lengths = sorted(r[0] for r in listed.select(F.length("path")).distinct().collect())  # as many as path lengths
    urls = stage(parts(pages.select("url").distinct()), "urls")
    labels = urls.where("host <> ''").select("url", "path", "host", F.explode(F.sequence(
        F.lit(1), F.size(F.split("host", r"\.")))).alias("n"))
    tail = labels.select("url", "path", F.expr("substring_index(host, '.', -n)").alias("tail"))
    starts = F.array(*[F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths])
    keys = tail.select("url", F.col("tail"), F.explode(F.filter(starts, lambda s: s.isNotNull())).alias("start"))
    keys = keys.select("url", F.concat_ws("\u0001", "tail", "start").alias("key")).distinct()
    hits = bloom.prefilter(keys, "key", listed.select("key")).join(listed, "key")
    best = hits.groupBy("url").agg(F.max(F.struct(
        "is_rule", (F.length("host") + F.length("path")).alias("size"), "host", "path", "verdict")).alias("best"))
    judged = urls.join(best.withColumnRenamed("url", "u"), F.col("url") == F.col("u"), "left").select(
        "url", "host", "path", F.when(F.col("best.is_rule"), F.concat("best.host", "best.path")).alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
    out = pages.select("page_id", F.col("url").alias("_url")).join(judged, F.col("_url").eqNullSafe(F.col("url")))
    return out.select("page_id", "host", "path", "rule", "verdict")
