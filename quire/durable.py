"""Writing intermediate tables where all executors can read them."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. A session within one process, as in tests, may lack it
    and gets a temporary one; on a cluster no folder of one machine will do."""
    named = spark.conf.get(SETTING, None)
    if named:
        return named
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError(f"{SETTING} is not set: intermediate tables need a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="checkpoints-")


def settled(df: DataFrame) -> DataFrame:
    """The rows of df in the shared folder, the plan behind them cut off."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)
