"""Cutting lineage so that a job survives lost executors.

Data that a later step must see unchanged (row positions, partition offsets) or that is costly to make again is
written to the folder all executors share, named by ``spark.checkpoint.dir``. Only a local session that names none, as in
tests, gets a folder of its own; on a cluster that is an error.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder of the session; make one only where the session names none."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not configured:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="tessera-checkpoint-")
        atexit.register(shutil.rmtree, configured, True)
    context.setCheckpointDir(configured)


def cut(df: DataFrame) -> DataFrame:
    """The same rows, read from a reliable checkpoint (never a local one)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, which all executors share."""
    ensure_checkpoint_dir(spark)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()
