"""Lineage cuts in the storage that driver and executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared(spark: SparkSession) -> str:
    """The folder the session names for checkpoints. Where it names none, a session of one process gets a folder of its own; a
    cluster, whose machines share no such folder, is an error."""
    sc = spark.sparkContext
    own = sc._jsc.sc().getCheckpointDir()
    if own.isDefined():
        return own.get()
    named = sc.getConf().get("spark.checkpoint.dir")
    if not named and sc.master.partition("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="seqloom-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(rows: DataFrame) -> DataFrame:
    """rows, checkpointed in the shared folder."""
    shared(rows.sparkSession)
    return rows.checkpoint()
