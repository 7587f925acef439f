"""Merkle manifest of a table: a SHA-256 tree whose parents keep their states of hashing.

Digests go into a parent as 64 characters of hex, which is one block of SHA-256. So the state
before a child's slot is eight words: the first state before the left child, the state after
the left child before the right one. A node's path holds, level by level, that state and the
other child; folding resumes the state with the replaced digest, adds the right child if there
is one, and never reads the left one again. States have to travel between tasks, which
hashlib's cannot, so blocks are hashed here, many nodes at once.

Trees are built from runs of 4096 consecutive nodes: runs of leaves first, then runs of their
tops. No task holds a whole tree; paths above the leaves' runs are joined to the leaves by run.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import remove, scratch, written

LEVELS = 12
RUN = 1 << LEVELS

# A level of a path: which child the node is, the parent's state before it, the other child.
ALONE, LEFT, RIGHT = 0, 1, 2
LEVEL = np.dtype([("side", "u1"), ("state", ">u4", 8), ("other", "u1", 32)])


def _primes(n):
    found = []
    i = 2
    while len(found) < n:
        if all(i % p for p in found):
            found.append(i)
        i += 1
    return found


def _root_bits(x: int, power: int) -> int:
    """The first 32 bits behind the point of x ** (1 / power)."""
    x <<= 32 * power
    low, high = 0, 1 << 40
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (middle, high) if middle**power <= x else (low, middle)
    return low & 0xFFFFFFFF


FIRST = np.array([_root_bits(p, 2) for p in _primes(8)], np.uint32)
ROUND = np.array([_root_bits(p, 3) for p in _primes(64)], np.uint32)
HEX = np.frombuffer(b"0123456789abcdef", np.uint8)


def _turned(x, n):
    return (x >> np.uint32(n)) | (x << np.uint32(32 - n))


def absorbed(states: np.ndarray, words: np.ndarray) -> np.ndarray:
    """SHA-256 states (n, 8) after one more block of 16 words each; `words` is (n, 16) or (1, 16)."""
    w = [words[:, i] for i in range(16)]
    a, b, c, d, e, f, g, h = (states[:, i] for i in range(8))
    for t in range(64):
        if t >= 16:
            x, y = w[t - 15], w[t - 2]
            small = _turned(x, 7) ^ _turned(x, 18) ^ (x >> np.uint32(3))
            large = _turned(y, 17) ^ _turned(y, 19) ^ (y >> np.uint32(10))
            w.append(w[t - 16] + small + w[t - 7] + large)
        up = h + (_turned(e, 6) ^ _turned(e, 11) ^ _turned(e, 25)) + ((e & f) ^ (~e & g)) + ROUND[t] + w[t]
        down = (_turned(a, 2) ^ _turned(a, 13) ^ _turned(a, 22)) + ((a & b) ^ (a & c) ^ (b & c))
        a, b, c, d, e, f, g, h = up + down, a, b, c, d + up, e, f, g
    return states + np.stack(np.broadcast_arrays(a, b, c, d, e, f, g, h), axis=1)


def taken(states: np.ndarray, digests: np.ndarray) -> np.ndarray:
    """States after the hex of digests (n, 32 bytes)."""
    text = np.stack([HEX[digests >> 4], HEX[digests & 15]], axis=2).reshape(len(digests), 64)
    return absorbed(states, np.ascontiguousarray(text).view(">u4").astype(np.uint32))


def finished(states: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """Digests (n, 32 bytes) of states that have taken `blocks` whole blocks each."""
    words = np.zeros((len(states), 16), np.uint32)
    words[:, 0] = 1 << 31
    words[:, 14], words[:, 15] = np.asarray(blocks) * 512 >> 32, np.asarray(blocks) * 512 & 0xFFFFFFFF
    return absorbed(states, words).astype(">u4").view(np.uint8).reshape(-1, 32)


def first_states(n: int) -> np.ndarray:
    return np.tile(FIRST, (n, 1))


def climb(nodes: np.ndarray, levels: int):
    """The paths (n, levels) of consecutive nodes, and the digest of their top."""
    paths = np.zeros((len(nodes), levels), LEVEL)
    place = np.arange(len(nodes))  # of each node's ancestor in the level reached
    for level in range(levels):
        before_left = first_states((len(nodes) + 1) // 2)
        before_right = taken(before_left, nodes[::2])
        states, sides = np.empty((len(nodes), 8), np.uint32), np.full(len(nodes), LEFT)
        states[::2], states[1::2] = before_left, before_right[: len(nodes) // 2]
        sides[1::2] = RIGHT
        other = np.zeros_like(nodes)
        pairs = len(nodes) // 2
        other[: 2 * pairs : 2], other[1::2] = nodes[1::2], nodes[: 2 * pairs : 2]
        if len(nodes) % 2:
            sides[-1] = ALONE
        paths["side"][:, level], paths["state"][:, level], paths["other"][:, level] = sides[place], states[place], other[place]
        after = before_right.copy()
        if pairs:
            after[:pairs] = taken(before_right[:pairs], nodes[1::2])
        nodes = finished(after, np.where(np.arange(len(after)) < pairs, 2, 1))
        place //= 2
    return paths, nodes[0]


def fold(nodes, proofs, counts, paths):
    """Nodes resumed along their paths, and the running hashes of the other children met, with their numbers.

    `paths` is (n, levels); all are changed to where the paths end.
    """
    for level in paths.T:
        states = taken(level["state"].astype(np.uint32), nodes)
        blocks = np.where(level["side"] == ALONE, 1, 2)
        left = level["side"] == LEFT
        if left.any():
            states[left] = taken(states[left], level["other"][left])
        nodes = finished(states, blocks)
        met = level["side"] != ALONE
        if met.any():
            proofs[met] = taken(proofs[met], level["other"][met])
        counts = counts + met
    return nodes, proofs, counts


def _bytes(column, width: int) -> np.ndarray:
    """A column of binaries of one length as a matrix."""
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.frombuffer(b"".join(values.to_pylist()), np.uint8).reshape(-1, width)


def _binary(matrix: np.ndarray) -> pa.Array:
    n, width = matrix.shape
    ends = pa.array(np.arange(n + 1, dtype=np.int32) * width)
    return pa.Array.from_buffers(pa.binary(), n, [None, ends.buffers()[1], pa.py_buffer(np.ascontiguousarray(matrix))])


def _levels(n: int) -> int:
    """Levels above n nodes that a run climbs."""
    return min(LEVELS, (n - 1).bit_length())


def _leaf_runs(table: pa.Table) -> pa.Table:
    """Leaves of one run, folded to its top."""
    table = table.sort_by("pos")
    n = len(table)
    paths, top = climb(_bytes(table["node"], 32), _levels(table["n"][0].as_py()))
    nodes, proofs, counts = fold(_bytes(table["claimed"], 32), first_states(n), np.zeros(n, np.int64), paths)
    states = np.ascontiguousarray(proofs.astype(">u4")).view(np.uint8)
    tops = pa.array([top.tobytes()] + [None] * (n - 1), pa.binary())
    made = [_binary(nodes), _binary(states), pa.array(counts), tops]
    return pa.table([*(table[c] for c in ("tree", "n", "run", "id", "node")), *made], [*_LEAVES])


def _upper_runs(table: pa.Table) -> pa.Table:
    """Paths of the nodes of one run, and its top."""
    table = table.sort_by("pos")
    paths, top = climb(_bytes(table["node"], 32), _levels(table["n"][0].as_py()))
    made = [pa.array([p.tobytes() for p in paths], pa.binary()), pa.array([top.tobytes()] * len(table), pa.binary())]
    return pa.table([*(table[c] for c in ("tree", "pos", "run")), *made], ["tree", "pos", "run", "path", "top"])


_LEAVES = {"tree": "string", "n": "bigint", "run": "bigint", "id": "bigint", "leaf": "binary", "folded": "binary", "proof": "binary",
           "met": "bigint", "top": "binary"}


def placed(nodes: DataFrame, order_by, place: str) -> DataFrame:
    """`nodes` with `pos`, their number within `tree`, and `n`, the tree's size; written to `place`.

    The table is range-partitioned by tree and order, so a tree may span any number of tasks;
    what each task holds of a tree is counted first. Bounds are sampled, hence the written table.
    """
    order = [F.col("tree"), *order_by, "tie"]
    within = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    chunks = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = nodes.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(chunks, *order).sortWithinPartitions(*order)
    rows = written(rows.withColumn("chunk", F.spark_partition_id()).withColumn("place", within).drop("tie"), place)
    parts = rows.groupBy("tree", "chunk").agg(F.count("*").alias("rows"), F.min("place").alias("first"))
    # One row per tree and chunk
    tree = W.partitionBy("tree")
    before = F.coalesce(F.sum("rows").over(tree.orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("tree", "chunk", (before - F.col("first")).alias("shift"), F.sum("rows").over(tree).alias("n"))
    return rows.join(parts, ["tree", "chunk"]).withColumn("pos", F.col("place") + F.col("shift")).drop("chunk", "place", "shift")


def _run(pos):
    return F.floor(pos / RUN).cast("bigint")


def paths_to_roots(nodes: DataFrame, place) -> DataFrame:
    """tree, pos, path (all levels up to the tree's root) and root, for nodes(tree, n, pos, node).

    `place()` names a fresh folder.
    """
    found = written(nodes.select("tree", "pos", F.col("pos").alias("at"), "n", F.lit(b"").alias("path"), F.col("node").alias("root")), place())
    while True:
        if not (found.agg(F.max("n")).first()[0] or 0) > 1:
            return found.drop("at", "n")
        # Nodes of this level; a tree that has ended climbs no levels.
        level = found.groupBy("tree", "at").agg(F.first("n").alias("n"), F.first("root").alias("node"))
        level = level.select("tree", F.col("at").alias("pos"), _run(F.col("at")).alias("run"), "n", "node")
        runs = level.groupBy("tree", "run").applyInArrow(_upper_runs, "tree string, pos bigint, run bigint, path binary, top binary")
        runs = runs.select("tree", F.col("pos").alias("at"), F.col("run").alias("next"), F.col("path").alias("more"), "top")
        up = found.join(runs, ["tree", "at"]).select(
            "tree", "pos", F.col("next").alias("at"), F.ceil(F.col("n") / RUN).alias("n"), F.concat("path", "more").alias("path"), F.col("top").alias("root")
        )
        found = written(up, place())


def netstrings(*columns) -> Column:
    """Values one after the other, each as `-` if null, else its UTF-8 length, a colon and the value."""
    text = [c.cast("string") for c in columns]
    return F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text))


def digest(text: Column) -> Column:
    """The 32 bytes of a text's SHA-256."""
    return F.unhex(F.sha2(text.cast("binary"), 256))


def manifest(docs: DataFrame, leaf: Column, claimed: Column | None = None, tree_col="lang", id_col="doc_id") -> DataFrame:
    """id, leaf, subroot, root, proof_sha256, folded_root, verified, for every row of `docs`.

    `leaf` gives a row's content as text. Rows of one `tree_col` form a tree, in the order of
    id (null first) and, for equal ids, of the leaf's digest; trees come in the order of their key, null first.
    `claimed` is the content that is verified against the manifest, `leaf` itself by default: its
    digest takes the leaf's place and is folded along the leaf's path.

    Equal rows are leaves of their own. A null or empty value, text of any length, an empty table
    (no rows) and further columns are all fine; further columns are left out.
    """
    spark = docs.sparkSession
    base = scratch(spark, "merkle")
    made = []

    def place():
        made.append(f"{base}/{len(made)}")
        return made[-1]

    key = F.coalesce(F.concat(F.lit("="), F.col(tree_col)), F.lit(""))  # no null among the keys of joins
    whole = docs.select(
        key.alias("tree"), F.col(id_col).cast("bigint").alias("id"), digest(leaf).alias("node"),
        (digest(leaf) if claimed is None else digest(claimed)).alias("claimed"),
    )
    rows = placed(whole, [F.col("id").asc_nulls_first(), "node"], place()).withColumn("run", _run(F.col("pos")))
    schema = ", ".join(f"{c} {t}" for c, t in _LEAVES.items())
    leaves = written(rows.groupBy("tree", "run").applyInArrow(_leaf_runs, schema), place())

    tops = leaves.where(F.col("top").isNotNull())
    tops = tops.select("tree", F.col("run").alias("pos"), F.ceil(F.col("n") / RUN).alias("n"), F.col("top").alias("node"))
    within = paths_to_roots(tops, place)
    # The tree of all subroots
    subroots = within.where("pos = 0").select(F.lit("").alias("tree"), F.col("tree").alias("key"), F.col("root").alias("node"))
    subroots = placed(subroots, ["key"], place())
    across = paths_to_roots(subroots, place).select("pos", F.col("path").alias("across"), F.col("root").alias("whole"))
    across = subroots.join(across, "pos").select(F.col("key").alias("tree"), "across", "whole")
    upper = within.join(across, "tree").select(
        "tree", F.col("pos").alias("run"), F.concat("path", "across").alias("path"), F.col("root").alias("subroot"), F.col("whole").alias("root")
    )

    def rest(batches):
        for batch in batches:
            nodes, counts = _bytes(batch.column("folded"), 32), batch.column("met").to_numpy(zero_copy_only=False)
            proofs = _bytes(batch.column("proof"), 32).copy().view(">u4").astype(np.uint32)
            lengths = np.array([len(p) for p in batch.column("path").to_pylist()], np.int64) // LEVEL.itemsize
            nodes, counts = nodes.copy(), counts.copy()
            for length in np.unique(lengths[lengths > 0]):
                some = lengths == length
                paths = np.frombuffer(b"".join(batch.column("path").filter(pa.array(some)).to_pylist()), LEVEL).reshape(-1, length)
                nodes[some], proofs[some], counts[some] = fold(nodes[some], proofs[some], counts[some], paths)
            columns = [batch.column(c) for c in ("id", "leaf", "subroot", "root")]
            yield pa.record_batch([*columns, _binary(finished(proofs, counts)), _binary(nodes)], ["id", "leaf", "subroot", "root", "proof", "folded"])

    both = leaves.drop("n", "top").join(upper, ["tree", "run"])
    ended = both.mapInArrow(rest, "id bigint, leaf binary, subroot binary, root binary, proof binary, folded binary")
    text = {"leaf": "leaf", "subroot": "subroot", "root": "root", "proof": "proof_sha256", "folded": "folded_root"}
    ended = ended.select("id", *(F.lower(F.hex(a)).alias(b) for a, b in text.items()), (F.col("folded") == F.col("root")).alias("verified"))
    result = written(ended.withColumnRenamed("id", id_col), scratch(spark, "manifest"))
    remove(spark, base)
    return result
