"""The ordered cleaning pipeline (C22) and its summary.

Order is part of the contract: names -> trim -> dedupe -> impute -> dates ->
outliers -> narrowing -> features -> final checks. Each data-dependent step
runs one small aggregate job and turns its result into literals; the frame
is checkpointed after deduplication and after date conversion so later jobs
restart from a reliable copy rather than the whole lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftframe.functions.exprs import round_keep_sign
from siftframe.operators.dates import convert_dates, sniff_date_columns
from siftframe.operators.features import (date_parts, drop_all_null_columns, final_count_exprs, final_counts,
                                          infinities_to_null, read_final_counts, unit_price)
from siftframe.functions.classify import is_datetime
from siftframe.operators.impute import impute
from siftframe.operators.narrow import (footprint, footprint_exprs, integer_bound_exprs, narrow_floats,
                                        narrow_integers, read_integer_plan)
from siftframe.operators.outliers import add_flags, flag_outliers, iqr_fences, outlier_count_exprs
from siftframe.operators.steplog import LogRow, log_frame
from siftframe.operators.tidy import drop_duplicates, standardize_columns, trim_strings
from siftframe.session import materialize
from siftframe.settings import DEFAULT, Settings
from siftframe.plans.local import local_frame


class CleanResult:
    def __init__(self, df: DataFrame, log: list[LogRow], outliers: dict[str, int]):
        self.df = df
        self.log_rows = log
        self.outliers = outliers

    @property
    def log(self) -> DataFrame:
        return log_frame(self.df.sparkSession, self.log_rows)


def clean(df: DataFrame, settings: Settings = DEFAULT, order_by: list[str] | None = None,
          partition_keys: list[str] = (), date_sample: int | None = None,
          checkpoint: bool = True) -> CleanResult:
    """Run every cleaning step in order; returns the cleaned frame and the log."""
    log: list[LogRow] = []
    cur, rows = standardize_columns(df)
    log += rows
    if order_by:
        # order columns follow the rename
        from siftframe.functions.names import standard_names
        mapping = dict(zip(df.columns, standard_names(df.columns)))
        order_by = [mapping.get(c, c) for c in order_by]
        partition_keys = [mapping.get(c, c) for c in partition_keys]
    cur, rows = trim_strings(cur)
    log += rows
    cur, rows = drop_duplicates(cur, checkpoint=checkpoint)
    log += rows
    cur, rows = impute(cur, settings, order_by, partition_keys)
    log += rows
    fmts = sniff_date_columns(cur, settings, sample=date_sample)
    cur, rows = convert_dates(cur, {c: f for c, (f, _) in fmts.items()})
    log += rows
    if checkpoint:
        cur = materialize(cur)
    if settings.narrow_floats:
        cur, rows, outliers = flag_outliers(cur, None, settings)
        log += rows
        cur, rows = narrow_integers(cur)
        log += rows
        cur, rows = narrow_floats(cur, settings)
        log += rows
        log.append(LogRow("optimize_types", None, "done", None))
        cur, rows = date_parts(cur)
        log += rows
        cur, rows = unit_price(cur)
        log += rows
        infs, values = final_counts(cur)
    else:
        cur, outliers, infs, values = _finish_in_one_pass(cur, settings, log)
    cur, rows = infinities_to_null(cur, infs)
    log += rows
    # a column of only infinities is empty once they are nulled
    cur, rows = drop_all_null_columns(cur, values)
    log += rows
    return CleanResult(cur, log, outliers)


def _finish_in_one_pass(cur: DataFrame, settings: Settings, log: list[LogRow]):
    """Outlier flags, integer narrowing, date parts and unit price, with every
    number they and the final checks need read by ONE aggregate.

    None of these steps changes a value the others count: flags are new
    columns, narrowing casts within proven bounds, date parts and the unit
    price are new columns. So outlier counts, integer bounds and the
    infinite/finite counts of the finished columns are evaluated together
    over ``cur`` plus the derived columns -- one scan of the checkpointed
    frame instead of three. Only the IQR fences (quantiles) come first.
    """
    fences = iqr_fences(cur, None, settings)
    pre, _ = date_parts(cur)
    pre, priced = unit_price(pre)
    derived = {f"{f.name}_{part}" for f in cur.schema.fields if is_datetime(f.dataType) for part in ("year", "month", "day")}
    derived |= {f"is_outlier_{c}" for c in fences} | {r.column for r in priced}
    if derived & set(cur.columns):
        # a derived column replaces an existing one, which the other counts read: step by step
        cur, rows, outliers = flag_outliers(cur, None, settings)
        log += rows
        cur, rows = narrow_integers(cur)
        log += rows + [LogRow("optimize_types", None, "done", None)]
        cur, rows = date_parts(cur)
        log += rows
        cur, rows = unit_price(cur)
        log += rows
        infs, values = final_counts(cur)
        return cur, outliers, infs, values
    exprs = (outlier_count_exprs(cur, fences) + integer_bound_exprs(cur) + final_count_exprs(pre)
             + [F.count(F.lit(1)).alias("_rows")])
    row = pre.agg(*exprs).first()
    counts = {c: row[f"o{i}"] for i, c in enumerate(fences)}
    plan = read_integer_plan(cur, row)
    cur, rows, outliers = add_flags(cur, fences, counts)
    log += rows
    # the new 0/1 flags are tinyint already and stay out of the plan
    cur, rows = narrow_integers(cur, plan)
    log += rows + [LogRow("optimize_types", None, "done", None)]
    cur, rows = date_parts(cur)
    log += rows
    cur, rows = unit_price(cur)
    log += rows
    infs, values = read_final_counts(pre, row)
    for c in outliers:  # 0/1 flags: never infinite, never missing
        infs[f"is_outlier_{c}"], values[f"is_outlier_{c}"] = 0, row["_rows"]
    return cur, outliers, infs, values


SUMMARY_SCHEMA = ("steps_applied int, outliers_total long, outlier_columns int, rows_after long, "
                  "columns_after int, bytes_before long, bytes_after long, bytes_saved_mb double")


def clean_summary(before: DataFrame, result: CleanResult) -> DataFrame:
    """One row: steps applied, outliers found, shape after, data bytes saved."""
    b0 = footprint(before).agg(F.sum("bytes")).first()[0] or 0
    after = result.df
    # bytes and rows of the cleaned frame from one aggregate
    exprs = footprint_exprs(after)
    total = F.lit(0).cast("long")
    for e in exprs:
        total = total + e
    stats = after.agg(total.alias("b"), F.count(F.lit(1)).alias("n")).first()
    rows_after = stats["n"]
    b1 = stats["b"] or 0
    row = (len(result.log_rows), sum(result.outliers.values()), len(result.outliers), rows_after,
           len(after.columns), int(b0), int(b1), (b0 - b1) / (1024 * 1024))
    out = local_frame(before.sparkSession, [row], SUMMARY_SCHEMA)
    return out.withColumn("bytes_saved_mb", round_keep_sign(F.col("bytes_saved_mb"), 2))
