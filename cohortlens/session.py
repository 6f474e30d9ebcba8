"""Session helpers: checkpoint folder and bounded collects."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

# Rows above which a frame is no longer treated as a small side.
BROADCAST_ROWS = 200_000


def checkpoint_dir(spark: SparkSession) -> str:
    """Folder for checkpoints and intermediate tables.

    The cluster names a shared one in ``spark.checkpoint.dir``. Only a local
    session without that setting gets a folder of its own.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if configured is None and sc.getCheckpointDir() is not None:
        return sc.getCheckpointDir()
    if configured is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by the cluster")
        configured = tempfile.mkdtemp(prefix="cohortlens-ckpt-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(configured)
    return configured


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint, one that outlives lost executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def small_rows(df: DataFrame, limit: int, what: str) -> list:
    """Collect a model-sized frame; refuse when it has more rows than ``limit``."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{what}: more than {limit} rows")
    return rows
