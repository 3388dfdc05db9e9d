"""Session factory with the settings the operators are written for."""

from __future__ import annotations

import tempfile

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def session(master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC; ``conf`` wins over the defaults here."""
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    builder = SparkSession.builder.appName("tallyspark").config(map=defaults | conf)
    return (builder.master(master) if master else builder).getOrCreate()


def scratch(spark: SparkSession) -> str | None:
    """The folder that spark.checkpoint.dir names; a local session without one gets a temporary folder, a cluster None."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
            return None
        sc.setCheckpointDir(folder or "file://" + tempfile.mkdtemp(prefix="checkpoints-"))
    return sc.getCheckpointDir()


def kept(df: DataFrame) -> DataFrame:
    """``df`` computed once, for plans that read it several times and rely on the same rows in the same partitions.

    It is a checkpoint in the session's ``scratch`` folder. On a cluster where none is named it is
    persisted on the executors instead: what a lost one held is computed again from the same plan.
    """
    return df.checkpoint() if scratch(df.sparkSession) else df.persist(StorageLevel.MEMORY_AND_DISK)
