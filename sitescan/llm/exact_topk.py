"""Exact top-k by inner product: matrix products of query blocks and shards, merged in a tree.

Vectors become integers, floor(64 x). Shards and query blocks are packed into one
row each. Every shard meets every query block once (an equi-join on the
block's number, the shard repeated for each), so a task holds one tile at a time. A
tile keeps k candidates per query; lists of k are merged by `FAN_IN` per level.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import scratch, written

SHARD = 4096
QUERY_BLOCK = 1024
FAN_IN = 16
SCALE = 64
_PACKED = "part bigint, dim int, kind string, ids binary, vectors binary"
# Whole numbers below this are exact as doubles, and leave room for a place within a shard.
EXACT = 2.0**50
# Below every key of a candidate.
NONE = -(2**62)


def pack(vectors: DataFrame, rows: int) -> DataFrame:
    """(id, vector) as matrices of up to `rows` vectors of one length, in the smallest type that holds them.

    A vector that is null, or has a null or non-finite component, or no id,
    takes no part. `task` is the partition that a block is from; one with few rows makes one block per length.
    """

    def run(batches):
        waiting = {}
        for batch in batches:
            ids, lists = batch.column(0), batch.column(1)
            # from_arrays and offsets: no Python object per component
            lengths = np.where(lists.is_valid(), np.diff(lists.offsets), 0)
            values = lists.values
            flat = values.cast(pa.float64()).to_numpy(zero_copy_only=False)  # nulls become NaN
            starts = np.asarray(lists.offsets)[:-1]
            valid = np.asarray(lists.is_valid()) & np.asarray(ids.is_valid())
            for dim in np.unique(lengths[valid]):
                rows_of = np.flatnonzero(valid & (lengths == dim))
                matrix = np.floor(SCALE * flat[starts[rows_of][:, None] + np.arange(dim)])
                ok = np.isfinite(matrix).all(axis=1)
                own = ids.take(pa.array(rows_of[ok])).to_numpy(zero_copy_only=False).astype(np.int64)
                waiting.setdefault(int(dim), []).append((own, matrix[ok]))
            for dim, parts in waiting.items():
                while sum(len(own) for own, _ in parts) >= rows:
                    yield block(dim, parts)
        for dim, parts in waiting.items():
            while sum(len(own) for own, _ in parts):
                yield block(dim, parts)

    def block(dim, parts):
        """The first `rows` of the waiting rows as a block; the others wait on."""
        own, matrix = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
        parts[:] = [(own[rows:], matrix[rows:])]
        order = np.argsort(own[:rows], kind="stable")
        some = matrix[:rows][order]
        top = np.abs(some).max(initial=0)
        kind = "<i1" if top < 128 else "<i2" if top < 1 << 15 else "<f8"
        row = {"dim": [dim], "kind": [kind], "ids": [own[:rows][order].astype("<i8").tobytes()]}
        return pa.RecordBatch.from_pydict(row | {"vectors": [some.astype(kind).tobytes()]}, schema)

    schema = pa.schema([("dim", pa.int32()), ("kind", pa.string()), ("ids", pa.binary()), ("vectors", pa.binary())])
    packed = vectors.mapInArrow(run, "dim int, kind string, ids binary, vectors binary")
    return packed.select(F.monotonically_increasing_id().alias("part"), F.spark_partition_id().alias("task"), "*")


def tile(q_ids, queries, s_ids, shard, k):
    """For each query, the k best of the shard: (places in the shard, scores), best first, as lists.

    Both matrices hold whole numbers; `s_ids` ascend, so of equal scores the smaller place wins.
    """
    n = len(s_ids)
    low, high = np.searchsorted(s_ids, q_ids, "left"), np.searchsorted(s_ids, q_ids, "right")
    bound = float(np.abs(queries).max(initial=0)) * float(np.abs(shard).max(initial=0)) * max(1, shard.shape[1])
    if bound < EXACT:
        take = min(n, k)
        for i in range(0, len(q_ids), 256):
            scores = (queries[i : i + 256] @ shard.T).astype(np.int64)
            keys = scores * n + np.arange(n - 1, -1, -1)
            for j in range(len(keys)):
                keys[j, low[i + j] : high[i + j]] = NONE
            best = np.argpartition(-keys, take - 1, axis=1)[:, :take] if take < n else np.tile(np.arange(n), (len(keys), 1))
            best = np.take_along_axis(best, np.argsort(-np.take_along_axis(keys, best, 1), axis=1), 1)
            for j, row in enumerate(best):
                row = row[keys[j, row] != NONE]
                yield row, scores[j, row]
        return
    # Too large for doubles: Python's whole numbers.
    whole = [[int(x) for x in v] for v in shard.tolist()]
    limit = 2**63 - 1
    for i, v in enumerate(queries.tolist()):
        v = [int(x) for x in v]
        scores = [sum(a * b for a, b in zip(v, w)) for w in whole]
        places = sorted((j for j in range(n) if not low[i] <= j < high[i]), key=lambda j: (-scores[j], j))[:k]
        yield np.array(places, np.int64), np.array([max(-limit, min(limit, scores[j])) for j in places], np.int64)


def top_k(vectors: DataFrame, is_query, k: int = 20, id_col="vec_id", vector_col="embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each query its k highest scores, ties to smaller vec_id.

    `is_query` is a Column over `vectors`. A query meets every vector of its own
    length but those with its own id; a query without any gives no row. Rows that repeat an id
    are queries and candidates of their own. Scores beyond 64 bits are cut to the limit.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).alias("vector"), is_query.alias("asks"))
    shards = written(pack(rows.select("id", "vector"), SHARD), scratch(spark, "shards"))
    asking = rows.where("asks").select("id", "vector")
    # As many partitions as there are blocks, however many the table came in: a block's number is its partition's.
    n_blocks = -(-max(1, asking.count()) // QUERY_BLOCK)
    blocks = written(pack(asking.repartition(n_blocks), QUERY_BLOCK), scratch(spark, "query-blocks"))
    n_shards = max(1, shards.count())
    number = F.col("task").cast("bigint").alias("number")
    asked = blocks.select(number, "dim", *(F.col(c).alias(f"q_{c}") for c in ("part", "kind", "ids", "vectors")))
    every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_blocks - 1).cast("bigint"))).alias("number")
    pairs = asked.join(shards.drop("task").select(every, "*"), ["number", "dim"])

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                read = lambda p: np.frombuffer(row[p + "vectors"], row[p + "kind"]).astype(float).reshape(-1, row["dim"])
                q_ids, s_ids = (np.frombuffer(row[p + "ids"], "<i8") for p in ("q_", ""))
                if row["dim"]:
                    queries, shard = read("q_"), read("")
                else:
                    queries, shard = np.zeros((len(q_ids), 0)), np.zeros((len(s_ids), 0))
                found = list(tile(q_ids, queries, s_ids, shard, k))
                places = np.concatenate([p for p, _ in found])
                best = pa.StructArray.from_arrays(
                    [pa.array(-np.concatenate([s for _, s in found]), pa.int64()), pa.array(s_ids[places], pa.int64())],
                    ["loss", "vec_id"],
                )
                ends = np.concatenate([[0], np.cumsum([len(p) for p, _ in found])]).astype(np.int32)
                n = len(q_ids)
                columns = [pa.array(q_ids), pa.array(row["q_part"] * QUERY_BLOCK + np.arange(n)), pa.array([row["part"]] * n, pa.int64())]
                yield pa.record_batch([*columns, pa.ListArray.from_arrays(pa.array(ends), best)], ["query_id", "copy", "part", "best"])

    schema = "query_id bigint, copy bigint, part bigint, best array<struct<loss:bigint,vec_id:bigint>>"
    best = pairs.mapInArrow(run, schema).withColumn("node", F.pmod(F.xxhash64("part"), F.lit(n_shards))).drop("part")
    nodes = n_shards
    while True:
        nodes = -(-nodes // FAN_IN)
        merged = F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, k)
        best = best.groupBy("query_id", "copy", F.pmod("node", F.lit(nodes)).alias("node")).agg(merged.alias("best"))
        if nodes == 1:
            break
    return best.select("query_id", F.posexplode("best").alias("at", "b")).select(
        "query_id", (F.col("at") + 1).alias("rank"), F.col("b.vec_id").alias("vec_id"), (-F.col("b.loss")).alias("score")
    )
