"""Date sniffing and conversion for text columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftframe.functions.exprs import q
from siftframe.operators.steplog import LogRow
from siftframe.settings import DEFAULT, Settings

# Candidate formats, tried in this order (ties keep the earlier).
DATE_FORMATS = (
    "yyyy-MM-dd",
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ss",
    "MM/dd/yyyy",
    "dd/MM/yyyy",
    "yyyy/MM/dd",
    "dd-MM-yyyy",
    "dd MMM yyyy",
    "yyyy-MM-dd'T'HH:mm:ss.SSS",
    "yyyy-MM-dd'T'HH:mm:ssXXX",
    "yyyy-MM-dd'T'HH:mm:ss.SSSXXX",
    "yyyy-MM-dd HH:mm",
    "yyyy-MM-dd HH:mm:ss.SSS",
    "MM/dd/yyyy HH:mm:ss",
    "yyyyMMdd",
    "MMM d, yyyy",
    "d-MMM-yyyy",
    "d MMM yyyy",
    "yyyy-MM-dd HH:mm:ss.SSSSSS",
    "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
    "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "yyyy/MM/dd HH:mm:ss",
    "MM/dd/yyyy hh:mm:ss a",
    "MMMM d, yyyy",
    "d MMMM yyyy",
)


# A loose shape for each format (a superset of what it parses);
# a failing parse costs far more than a failing regex.
DATE_SHAPES = {
    "yyyy-MM-dd": r"^\d{4}-\d{1,2}-\d{1,2}$",
    "yyyy-MM-dd HH:mm:ss": r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}$",
    "yyyy-MM-dd'T'HH:mm:ss": r"^\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{1,2}:\d{1,2}$",
    "MM/dd/yyyy": r"^\d{1,2}/\d{1,2}/\d{4}$",
    "dd/MM/yyyy": r"^\d{1,2}/\d{1,2}/\d{4}$",
    "yyyy/MM/dd": r"^\d{4}/\d{1,2}/\d{1,2}$",
    "dd-MM-yyyy": r"^\d{1,2}-\d{1,2}-\d{4}$",
    "dd MMM yyyy": r"^\d{2} \p{L}{3,} \d{4}$",
    "yyyy-MM-dd'T'HH:mm:ss.SSS": r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{3}$",
    "yyyy-MM-dd'T'HH:mm:ssXXX": r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(Z|[+-]\d{2}:\d{2})$",
    "yyyy-MM-dd'T'HH:mm:ss.SSSXXX": r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{3}(Z|[+-]\d{2}:\d{2})$",
    "yyyy-MM-dd HH:mm": r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}$",
    "yyyy-MM-dd HH:mm:ss.SSS": r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}\.\d{3}$",
    "MM/dd/yyyy HH:mm:ss": r"^\d{2}/\d{2}/\d{4} \d{2}:\d{2}:\d{2}$",
    "yyyyMMdd": r"^(19|20)\d{6}$",
    "MMM d, yyyy": r"^\p{L}{3} \d{1,2}, \d{4}$",
    "d-MMM-yyyy": r"^\d{1,2}-\p{L}{3}-\d{4}$",
    "d MMM yyyy": r"^\d{1,2} \p{L}{3} \d{4}$",
    "yyyy-MM-dd HH:mm:ss.SSSSSS": r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}\.\d{6}$",
    "yyyy-MM-dd'T'HH:mm:ss.SSSSSS": r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{6}$",
    "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX": r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{6}(Z|[+-]\d{2}:\d{2})$",
    "yyyy/MM/dd HH:mm:ss": r"^\d{4}/\d{2}/\d{2} \d{2}:\d{2}:\d{2}$",
    "MM/dd/yyyy hh:mm:ss a": r"^\d{2}/\d{2}/\d{4} \d{2}:\d{2}:\d{2} [AaPp][Mm]$",
    "MMMM d, yyyy": r"^\p{L}{3,} \d{1,2}, \d{4}$",
    "d MMMM yyyy": r"^\d{1,2} \p{L}{3,} \d{4}$",
}


def parse_expr(c, fmt: str, guard: bool = True):
    """Text -> TIMESTAMP_NTZ with ``fmt``; NULL when it does not parse.

    The session's time zone plays no part: text without a zone keeps its wall
    clock, text with one becomes the wall clock of UTC.
    """
    zoned = fmt.endswith("XXX")
    at = F.try_to_timestamp(c if zoned else F.concat(c, F.lit("Z")), F.lit(fmt if zoned else fmt + "XXX"))
    seconds = (F.unix_micros(at).cast("decimal(20,0)") / F.lit(1_000_000).cast("decimal(7,0)")).cast("decimal(18,6)")
    parsed = F.lit("1970-01-01").cast("timestamp_ntz") + F.make_dt_interval(secs=seconds)
    shape = DATE_SHAPES.get(fmt) if guard else None
    return F.when(c.rlike(shape), parsed) if shape else parsed


def sniff_date_columns(df: DataFrame, settings: Settings = DEFAULT, formats=DATE_FORMATS,
                       sample: int | None = None) -> dict[str, tuple[str, float]]:
    """``{column: (format, share)}`` for text columns whose best format parses
    more than ``date_share`` of the values.

    ``sample=None`` scores every value in one aggregate (deterministic under
    any partitioning); an integer scores that many non-missing values per
    column instead, like the reference's first-50 sniff.
    """
    strings = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not strings:
        return {}
    scores: dict[str, list[float]] = {}
    if sample is None:
        aggs = [F.count(q(c)).alias(f"n{i}") for i, c in enumerate(strings)]
        for i, c in enumerate(strings):
            aggs += [F.count(parse_expr(q(c), fmt)).alias(f"p{i}_{j}") for j, fmt in enumerate(formats)]
        row = df.agg(*aggs).first()
        for i, c in enumerate(strings):
            n = row[f"n{i}"]
            scores[c] = [row[f"p{i}_{j}"] / n if n else 0.0 for j in range(len(formats))]
    else:
        for c in strings:
            head = df.select(q(c).alias("v")).where(F.col("v").isNotNull()).limit(sample)
            row = head.agg(F.count("v").alias("n"), *[
                F.count(parse_expr(F.col("v"), fmt)).alias(f"p{j}") for j, fmt in enumerate(formats)]).first()
            n = row["n"]
            scores[c] = [row[f"p{j}"] / n if n else 0.0 for j in range(len(formats))]
    out = {}
    for c, s in scores.items():
        best = max(range(len(formats)), key=lambda j: (s[j], -j))
        if s[best] > settings.date_share:
            out[c] = (formats[best], s[best])
    return out


def convert_dates(df: DataFrame, formats_by_col: dict[str, str]) -> tuple[DataFrame, list[LogRow]]:
    """Parse each chosen column with its format; failures become missing."""
    if not formats_by_col:
        return df, []
    out = df.select(*[
        parse_expr(q(c), formats_by_col[c]).alias(c) if c in formats_by_col else q(c)
        for c in df.columns])
    return out, [LogRow("convert_dates", c, fmt, None) for c, fmt in formats_by_col.items()]
