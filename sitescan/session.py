"""What the operators need from a session."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_DIR = "spark.checkpoint.dir"


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints, as the cluster names it.

    Only a local session may fall back to a folder of its own machine.
    """
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get(CHECKPOINT_DIR, None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_DIR} to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="sitescan-checkpoint-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def settled(df: DataFrame) -> DataFrame:
    """`df`, written once to the checkpoint folder, so that every use sees the same rows."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def restored(model, spark: SparkSession):
    """A fitted MLlib model as it comes back from the checkpoint folder, without its training summary.

    The summary of two classes holds the session, and a session that has observed a table cannot travel with tasks.
    """
    place = f"{checkpoint_dir(spark)}/model-{uuid.uuid4()}"
    model.write().save(place)
    return type(model).load(place)


def spread(df: DataFrame) -> DataFrame:
    """Share the rows of a scan out when it comes in fewer pieces than there are cores.

    For work that costs far more than moving a row, such as reading pages. A
    table of many files is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def broadcast_if_small(df: DataFrame, max_rows: int = 1_000_000, max_bytes: int = 64 << 20):
    """A broadcast hint, given only after `df` has been counted and weighed.

    Meant for tables that are small in every sane use. A larger one comes back
    without the hint and is joined by shuffle.
    """
    size = F.sum(F.length(F.to_json(F.struct("*")))).alias("bytes")
    found = df.agg(F.count("*").alias("rows"), size).first()
    if found["rows"] <= max_rows and (found["bytes"] or 0) <= max_bytes:
        return F.broadcast(df)
    return df
