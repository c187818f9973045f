"""What the training-data operators share: words, shared-folder tables, packed exchanges."""

from __future__ import annotations

import gc
import math
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of characters other than the six ASCII white-space characters.
SPACES = r"[\x20\x09-\x0D]+"

#: Text bytes that one block of documents should hold; bounds the memory of a task, which is about twelve times as much.
BLOCK_BYTES = 4 << 20


_at_exit: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    A cluster names it in ``spark.checkpoint.dir``. Only where that is unset and all runs on
    one machine (tests), a folder of this machine is used.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        context = spark.sparkContext
        found = context.getCheckpointDir()
        if not found:
            if not context.master.startswith("local[") and context.master != "local":
                raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            context.setCheckpointDir("/tmp/strataq-checkpoints")
            found = context.getCheckpointDir()
    return found.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """``df.checkpoint()`` into the shared folder; Spark removes the files when they are no longer used."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back, which cuts the lineage and allows column pruning."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if spark.sparkContext.applicationId not in _at_exit:
        # The application's folder goes with the driver; nothing else reads it.
        _at_exit.add(spark.sparkContext.applicationId)
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{spark.sparkContext.applicationId}")
        folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).deleteOnExit(folder)
    return spark.read.parquet(path)


def removed(df: DataFrame) -> None:
    """Remove the files of a table that ``stored`` has written and that nothing reads any more."""
    spark = df.sparkSession
    root = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/"
    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        if jvm.org.apache.hadoop.fs.Path(root).toUri().getPath() in path.toUri().getPath():
            path.getFileSystem(conf).delete(path, True)


def collected(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of queries that are over: it does so when their objects are collected."""
    gc.collect()
    time.sleep(0.5)  # the JVM hears of collected Python objects a little later
    spark.sparkContext._jvm.System.gc()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def blocks_for(n_bytes: int, n_rows: int, block_bytes: int = BLOCK_BYTES) -> int:
    """Blocks so that each holds about ``block_bytes`` of text, and never more blocks than rows."""
    return max(1, min(n_rows, math.ceil(n_bytes / block_bytes)))


def block_of(n_blocks: int, *columns: str):
    """A block for each row; the text takes part, so rows without an id or with the same one are spread."""
    return F.pmod(F.xxhash64(*columns), F.lit(n_blocks)).cast("int")
