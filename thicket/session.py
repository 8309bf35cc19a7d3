"""The folder that a cluster's executors share, for checkpoints."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """``spark.checkpoint.dir`` of the session; a folder of our own only where none is set."""
    if spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        return
    spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="thicket-"))


def cut(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut, kept where all executors can read it."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
