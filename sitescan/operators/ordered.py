"""Order-dependent work without putting a whole table, or a whole key, in one task.

The table is range-partitioned by the wanted order. Each range partition is a
chunk; chunk totals are tiny, and a scan over them tells every chunk what came
before it.
"""

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import settled

# Up to this many rows per key, Spark itself prunes a row_number filter before the shuffle.
GROUP_LIMIT = 1000


def ordered_chunks(df: DataFrame, order_by, chunks: int | None = None) -> DataFrame:
    """`df` with a `chunk` column; chunks follow each other in the given order.

    Adds `tie`, which ends the order so that even equal rows can be split, and
    `place`, the row's number within its chunk.

    Range bounds are sampled, so the result is checkpointed: totals and rows
    must be read from the same chunks, also after an executor is lost.
    """
    count = chunks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [*order_by, "tie"]
    placed = (
        df.withColumn("tie", F.monotonically_increasing_id())
        .repartitionByRange(count, *order)
        .sortWithinPartitions(*order)
    )
    # The lower 33 bits of the id count the rows of a partition.
    within = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return settled(placed.withColumn("chunk", F.spark_partition_id()).withColumn("place", within))


def with_row_index(df: DataFrame, order_by, name: str = "row_index", chunks=None) -> DataFrame:
    """Number the rows 0, 1, 2 … in the given total order."""
    placed = ordered_chunks(df, order_by, chunks)
    totals = placed.groupBy("chunk").count()
    # One row per chunk, so this unpartitioned window and the broadcast stay tiny.
    before = W.orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(
        "chunk", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_offset")
    )
    return (
        placed.join(F.broadcast(offsets), "chunk")
        .withColumn(name, F.col("_offset") + F.col("place"))
        .drop("chunk", "tie", "place", "_offset")
    )


def top_per_key(df: DataFrame, keys, order_by, n: int, rank: str = "rank", salts: int = 64):
    """The first `n` rows of every key, ranked from 1.

    For small `n` Spark keeps only `n` rows per key and task before it
    shuffles. For larger `n` the same is done by hand, key by salted key.
    """
    if n > GROUP_LIMIT:
        salt = F.pmod(F.xxhash64(*df.columns), F.lit(salts))
        part = W.partitionBy(*keys, "_salt").orderBy(*order_by)
        df = (
            df.withColumn("_salt", salt)
            .withColumn("_part_rank", F.row_number().over(part))
            .where(F.col("_part_rank") <= n)
            .drop("_salt", "_part_rank")
        )
    whole = W.partitionBy(*keys).orderBy(*order_by)
    return df.withColumn(rank, F.row_number().over(whole)).where(F.col(rank) <= n)
