"""Sessions with the settings the library expects, and lineage cuts that survive lost executors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def session(name: str = "strataq", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC and skew-join splitting; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    return builder.config(map=settings).getOrCreate()


def checkpointed(df: DataFrame) -> DataFrame:
    """Checkpoint into the folder that the cluster names in ``spark.checkpoint.dir``; only where that is unset, a local one."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(folder or "/tmp/strataq-checkpoints")
    return df.checkpoint(eager=True)
