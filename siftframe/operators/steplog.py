"""Pipeline step log: small rows describing what each cleaning step did."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from siftframe.plans.local import local_frame

LOG_SCHEMA = "seq int, step string, column_name string, strategy string, affected long"


@dataclass(frozen=True)
class LogRow:
    step: str
    column: str | None = None
    strategy: str | None = None
    affected: int | None = None


def log_frame(spark: SparkSession, rows: list[LogRow]) -> DataFrame:
    return local_frame(spark, 
        [(i, r.step, r.column, r.strategy, None if r.affected is None else int(r.affected))
         for i, r in enumerate(rows)], LOG_SCHEMA)
