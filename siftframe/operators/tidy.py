"""Early cleaning steps: names (C1), string trimming + null tokens (C2/C3), dedupe (C4)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftframe.functions.exprs import q
from siftframe.functions.names import standard_names
from siftframe.operators.steplog import LogRow
from siftframe.plans.repeats import is_wide, repeated_rows

# Text that becomes missing after trimming.
NULL_TOKENS = ("nan", "None", "")

# The characters Python's ``str.strip()`` removes, derived by rule from
# ``str.isspace`` (Spark's plain ``trim`` only strips spaces).
_WHITESPACE = "".join(chr(i) for i in range(0x110000) if chr(i).isspace())


def standardize_columns(df: DataFrame) -> tuple[DataFrame, list[LogRow]]:
    """Rename columns to lower snake case; logs how many names changed."""
    new = standard_names(df.columns)
    changed = sum(1 for a, b in zip(df.columns, new) if a != b)
    if not changed:
        return df, []
    return df.toDF(*new), [LogRow("standardize_columns", None, "renamed", changed)]


def trim_expr(c) -> F.Column:
    """Strip leading/trailing whitespace: a character-set trim, no regex."""
    return F.btrim(c, F.lit(_WHITESPACE))


def trim_strings(df: DataFrame, null_tokens: tuple[str, ...] = NULL_TOKENS) -> tuple[DataFrame, list[LogRow]]:
    """Strip whitespace in every string column; exact null tokens become missing.

    A pure projection: fuses into the scan stage with no extra job.
    """
    strings = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not strings:
        return df, []
    tokens = [F.lit(t) for t in null_tokens]
    out = df.select(*[
        (F.when(~trim_expr(q(f.name)).isin(*tokens), trim_expr(q(f.name))).alias(f.name)
         if f.name in strings else q(f.name))
        for f in df.schema.fields])
    return out, [LogRow("trim_strings", None, "trimmed", len(strings))]


def drop_duplicates(df: DataFrame, checkpoint: bool = False) -> tuple[DataFrame, list[LogRow]]:
    """Full-row dedupe (NULLs equal); logs the removed count when positive.

    Without ``checkpoint`` the count needs one grouped job and the returned
    frame stays lazy. With it, rows are grouped once (partial aggregation
    collapses repeats map-side), the grouped rows are checkpointed, and the
    removed count is read from that copy: one shuffle in total. Wide rows are
    told apart by fingerprint first: only those whose fingerprint repeats are
    shuffled whole and compared.
    """
    from siftframe.operators.profile import duplicate_count, repeats_beyond_first
    from siftframe.session import materialize
    if is_wide(df):
        parts = repeated_rows(df)
        removed = parts and repeats_beyond_first(parts[1]).first()["duplicate_rows"]
        out = parts[0].unionAll(parts[1].dropDuplicates()) if removed else df
        return (materialize(out) if checkpoint else out), (
            [LogRow("drop_duplicates", None, "removed_rows", removed)] if removed else [])
    if checkpoint:
        grouped = materialize(df.groupBy(*[q(c) for c in df.columns])
                              .agg(F.count(F.lit(1)).alias("_dup_n")))
        removed = grouped.agg(F.coalesce(F.sum(F.col("_dup_n") - 1), F.lit(0))).first()[0]
        out = grouped.drop("_dup_n")
        return out, ([LogRow("drop_duplicates", None, "removed_rows", removed)] if removed else [])
    removed = duplicate_count(df).first()["duplicate_rows"]
    if not removed:
        return df, []
    return df.dropDuplicates(), [LogRow("drop_duplicates", None, "removed_rows", removed)]
