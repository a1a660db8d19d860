"""Session helpers: local sessions for tests/bench and lineage cutting."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", app: str = "siftframe",
                  shuffle_partitions: int | None = None) -> SparkSession:
    """A local session configured like the tests and bench expect."""
    parts = shuffle_partitions or (8 if cpus == "*" else max(int(cpus), 1))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        # one wide statistics aggregate keeps ~18 buffer fields per column;
        # the default of 100 would split eight columns into two scans
        .config("spark.sql.codegen.maxFields", "256")
        .config("spark.driver.memory", os.environ.get("SIFT_DRIVER_MEMORY", "8g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str | None:
    """The shared checkpoint folder named by the session.

    On a cluster this must be configured (``spark.checkpoint.dir``); only a
    local-mode session without one gets a private temporary folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir()
    if sc.master.startswith("local["):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="siftframe-ckpt-"))
        return sc.getCheckpointDir()
    return None


def shared_folder(spark: SparkSession) -> str:
    """``checkpoint_dir``, or an error on a cluster without one."""
    folder = checkpoint_dir(spark)
    if not folder:
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return folder


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage before a data-dependent step: write Parquet, read it back.

    The file lies in the session's shared checkpoint folder, so a lost
    executor does not force recomputing the upstream plan, and later scans
    read only the columns they need. A cluster session must name the folder
    in ``spark.checkpoint.dir``.
    """
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
