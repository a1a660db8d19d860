"""Encoding audit (A2) over a folder of input files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftframe.sources.records import INSIDE, OUTSIDE, state_after

# Byte-order marks and the encodings they name.
BOMS = (("EFBBBF", "utf-8-sig"), ("FFFE", "utf-16-le"), ("FEFF", "utf-16-be"))
COMPRESSED = (".gz", ".bz2", ".deflate", ".lz4", ".snappy", ".zst", ".xz")


def encoding_audit(spark: SparkSession, path: str | list[str], delimiter: str | None = None) -> DataFrame:
    """``(path, length, bom, valid_utf8, suggested)`` per file.

    With a ``delimiter`` also ``open_quotes``: whether some line of the file, taken
    alone as a CSV row, ends inside a quoted field (the file then holds quoted
    line breaks, or stray quotes).

    Files are read through the (splittable) text source split on ``\\n``,
    which keeps each line's raw bytes, so a large file is checked by many
    tasks in parallel and no task ever holds a whole file. Every line is
    tested for valid UTF-8 (the whole file, not only its head). Per file,
    one grouped aggregate (partial aggregation: one row per file and task
    reaches the shuffle) gathers: the marker code of the first line of the
    split at offset 0, UTF-8 validity, and the bytes seen. The line reader
    drops a UTF-8 byte-order mark, so that mark is recognised exactly from
    the byte balance: file length - line bytes - separators is 3 (or 2 when
    the last line has no separator). The result is joined to the file
    listing.

    A byte-order mark decides first, then UTF-8 validity; anything else is
    suggested as ISO-8859-1 (which decodes every byte).
    """
    named = F.col("_metadata.file_path")  # percent-encoded on both sides of the join
    listing = spark.read.format("binaryFile").load(path).select(named.alias("path"), "length")  # no content read
    first = F.col("_metadata.file_block_start") == 0
    raw = F.col("value").cast("binary")
    code = F.lit(0)
    for i, (hexbom, _) in reversed(list(enumerate(BOMS))):
        n = len(hexbom) // 2
        code = F.when(F.substring(raw, 1, n) == F.unhex(F.lit(hexbom)), F.lit(i + 1)).otherwise(code)
    lines = spark.read.format("text").option("lineSep", "\n").load(path).select(
        named.alias("path"),
        # rows of one split arrive in file order: this id orders them
        F.when(first, F.monotonically_increasing_id()).alias("seq"),
        F.when(first, code).alias("code"),
        F.is_valid_utf8("value").alias("ok"),
        (F.lit(False) if delimiter is None else state_after(F.col("value"), delimiter, OUTSIDE) == INSIDE).alias("open"),
        F.octet_length("value").alias("nbytes"))
    per_file = lines.groupBy("path").agg(
        F.min_by("code", "seq").alias("code"),
        F.bool_and("ok").alias("valid_utf8"),
        F.bool_or("open").alias("open_quotes"),
        F.sum("nbytes").alias("nbytes"),
        F.count(F.lit(1)).alias("nlines"))
    plain = ~F.lower(F.col("path")).rlike("(" + "|".join(e.replace(".", r"\.") for e in COMPRESSED) + ")$")
    rest = F.col("length") - F.col("nbytes") - F.col("nlines")
    code = (F.when(F.col("code") > 0, F.col("code"))
            .when(plain & rest.isin(2, 3), F.lit(1))
            .otherwise(F.lit(0)))
    bom = F.lit(None).cast("string")
    for i, (_, name) in reversed(list(enumerate(BOMS))):
        bom = F.when(code == i + 1, F.lit(name)).otherwise(bom)
    valid = F.coalesce(F.col("valid_utf8"), F.lit(True))
    plain_path = F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B"))).alias("path")
    return listing.join(per_file, "path", "left").select(
        plain_path, "length", bom.alias("bom"), valid.alias("valid_utf8"),
        F.coalesce(bom, F.when(valid, F.lit("UTF-8")).otherwise(F.lit("ISO-8859-1"))).alias("suggested"),
        *([] if delimiter is None else [F.coalesce("open_quotes", F.lit(False)).alias("open_quotes")]))
