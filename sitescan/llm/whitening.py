"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation.

Vectors become whole numbers, floor(64 c) + 1000000, and are packed into blocks of rows. With
X the centred rows, each step is one pass: a task forms w = X b for its rows and returns only
X'w, the products of w with the earlier u, and w'w. Every u is X a for some short a, so a pass
makes the u it needs anew from a: nothing as long as the table is kept, and a lost executor
loses nothing. Both sequences are orthogonalised against all earlier ones: the u with the
products the pass brings along, the v on the driver. After as many steps as there are
dimensions X V = U B holds with a small bidiagonal B, whose SVD gives components and deviations.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import scratch, written

SCALE, OFFSET = 64, 1_000_000
# 64 c is cut to this, so that all that follows is exact.
LARGEST = 2.0**52
BLOCK_BYTES = 4 << 20
# Of the norm of all centred rows: what is shorter is rounding.
ROUNDING = 1e-13
RESULT = "id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"


def pack(vectors: DataFrame) -> DataFrame:
    """(id, vector) as blocks: dim, n_rows, ids, cells (whole numbers of 64 bits, row by row)."""

    def run(batches):
        for batch in batches:
            ids, lists = batch.column(0), batch.column(1)
            valid = np.asarray(lists.is_valid())
            offsets = np.asarray(lists.offsets).astype(np.int64)
            lengths = np.where(valid, np.diff(offsets), 0)
            flat = lists.values.cast(pa.float64()).to_numpy(zero_copy_only=False)  # nulls become NaN
            for dim in np.unique(lengths[lengths > 0]):
                rows = np.flatnonzero(lengths == dim)
                step = max(1, BLOCK_BYTES // (8 * int(dim)))
                for i in range(0, len(rows), step):
                    some = rows[i : i + step]
                    matrix = flat[offsets[:-1][some][:, None] + np.arange(dim)]
                    finite = np.isfinite(matrix).all(axis=1)
                    with np.errstate(over="ignore"):
                        cells = np.floor(np.clip(SCALE * matrix[finite], -LARGEST, LARGEST)).astype("<i8") + OFFSET
                    own = pa.ListArray.from_arrays(pa.array([0, len(cells)], pa.int32()), ids.take(pa.array(some[finite])))
                    columns = [pa.array([dim], pa.int32()), pa.array([len(cells)], pa.int64()), own, pa.array([cells.tobytes()], pa.binary())]
                    yield pa.record_batch(columns, ["dim", "n_rows", "ids", "cells"])

    return vectors.mapInArrow(run, "dim int, n_rows bigint, ids array<bigint>, cells binary").where("n_rows > 0")


def matrices(batch: pa.RecordBatch):
    """(ids, whole numbers) of each block of a batch."""
    for i in range(batch.num_rows):
        dim = batch.column("dim")[i].as_py()
        yield batch.column("ids")[i].values, np.frombuffer(batch.column("cells")[i].as_buffer(), "<i8").reshape(-1, dim)


class Centre:
    """n x - S, exactly, and x - S / n, from rows of whole numbers."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.sums = n, sums
        # Whole numbers of 64 bits do, or Python's.
        self.fits = n * (LARGEST + OFFSET) < 2**62 or max(map(abs, sums), default=0) < 2**61

    def numerators(self, cells):
        if self.fits and self.n * int(np.abs(cells).max(initial=0)) < 2**62:
            return self.n * cells - np.array(self.sums, np.int64)
        return self.n * cells.astype(object) - np.array(self.sums, object)

    def rows(self, cells):
        return (self.numerators(cells) / self.n).astype(float)

    def deviations(self, cells):
        """Sums over the dimensions of (n x - S)^2, cut to the largest long."""
        top = self.numerators(cells)
        if top.dtype != object and int(np.abs(top).max(initial=0)) ** 2 * top.shape[1] < 2**63:
            return np.einsum("ij,ij->i", top, top)
        squares = (top.astype(object) ** 2).sum(axis=1)
        return np.array([min(int(x), 2**63 - 1) for x in squares], np.int64)


def summed(blocks: DataFrame, part, kind: str) -> list:
    """The sum over all blocks of the short vector part(whole numbers): added up per task, then by place."""

    def run(batches):
        total = None
        for batch in batches:
            for _, cells in matrices(batch):
                found = part(cells)
                total = found if total is None else total + found
        if total is not None:
            yield pa.record_batch([pa.array(np.arange(len(total)), pa.int32()), pa.array(total)], ["place", "value"])

    rows = blocks.mapInArrow(run, f"place int, value {kind}").groupBy("place").agg(F.sum("value").alias("value")).collect()
    return [r["value"] for r in sorted(rows, key=lambda r: r["place"])]


def orthogonal(vector, basis):
    """`vector` without its parts along the basis; done twice, which is enough."""
    for _ in range(2):
        vector = vector - basis @ (basis.T @ vector)
    return vector


def bidiagonalise(product, dim: int, steps: int, norm: float, seed: int = 0):
    """(V, B): orthonormal columns V and the upper bidiagonal B of X V = U B.

    `product(A, b)` gives X'w, (X A)'w and w'w for w = X b. Where a sequence ends early, as
    equal deviations make it do, it goes on from a random vector orthogonal to all earlier ones.
    """
    rng = np.random.default_rng(seed)
    least = ROUNDING * norm
    basis, images = np.zeros((dim, 0)), np.zeros((dim, 0))  # the v, and X'u of every u
    made = np.zeros((dim, 0))  # u = X a
    alphas, betas = [], []
    v = rng.normal(size=dim)
    v /= np.linalg.norm(v)
    beta = 0.0
    for _ in range(steps):
        b = v - beta * made[:, -1] if beta else v
        image, along, square = product(made, b)
        alpha = float(np.sqrt(max(0.0, square - along @ along)))
        if alpha > least:
            a, u_image = (b - made @ along) / alpha, (image - images @ along) / alpha
        else:
            alpha, a, u_image = 0.0, np.zeros(dim), np.zeros(dim)
        basis = np.column_stack([basis, v])
        made, images = np.column_stack([made, a]), np.column_stack([images, u_image])
        alphas.append(alpha)
        rest = orthogonal(u_image - alpha * v, basis)
        beta = float(np.linalg.norm(rest))
        if beta <= least:
            beta, rest = 0.0, orthogonal(rng.normal(size=dim), basis)
        betas.append(beta)
        length = np.linalg.norm(rest)
        if length < 1e-8:
            break  # nothing is left: V spans all dimensions
        v = orthogonal(rest / length, basis)
        v /= np.linalg.norm(v)
    return basis, np.diag(alphas) + np.diag(betas[: len(alphas) - 1], 1)


def whiten(vectors: DataFrame, k: int = 32, steps: int | None = None, id_col="vec_id", vector_col="embedding") -> DataFrame:
    """id, component (from 1), n, deviation, whitened, explained, identity_error of every vector and component.

    Vectors that are null or empty, or hold a null or non-finite entry, take no part; nor do those
    of another length than most (of two as frequent, the longer). Rows that repeat, and null
    ids, stay. A component whose deviation is only rounding has no scale and is left out, so equal
    rows, a single one or none give no rows. 64 c is cut to 52 bits, `deviation` to the largest
    long. Other columns of `vectors` are left out.

    `steps` bounds the passes for wide vectors; the default, one per dimension, misses nothing.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).alias("vector"))
    blocks = written(pack(rows), scratch(spark, "whitening"))
    sizes = blocks.groupBy("dim").agg(F.sum("n_rows").alias("n")).orderBy(F.desc("n"), F.desc("dim")).first()
    nothing = spark.createDataFrame([], RESULT).withColumnRenamed("id", id_col)
    if sizes is None:
        return nothing
    dim, n = sizes["dim"], sizes["n"]
    blocks = blocks.where(F.col("dim") == dim)

    # Two halves, so that no sum leaves 64 bits.
    halves = summed(blocks, lambda x: np.concatenate([(x >> 20).sum(axis=0), (x & 0xFFFFF).sum(axis=0)]), "bigint")
    centre = Centre(n, [(high << 20) + low for high, low in zip(halves[:dim], halves[dim:])])
    squares = float(summed(blocks, lambda x: np.array([(centre.rows(x) ** 2).sum()]), "double")[0])
    if squares == 0:
        return nothing

    def product(made, b):
        def part(cells):
            x = centre.rows(cells)
            w = x @ b
            return np.concatenate([x.T @ w, (x @ made).T @ w, [w @ w]])

        found = np.array(summed(blocks, part, "double"))
        return found[:dim], found[dim:-1], found[-1]

    basis, small = bidiagonalise(product, dim, min(dim, steps or dim), squares**0.5)
    _, lengths, turned = np.linalg.svd(small)
    real = lengths[:k] > 1e-9 * lengths[0]
    lengths = lengths[:k][real]
    # In X V P / sqrt(e), e = length^2 / n
    weights = (basis @ turned[:k][real].T) * (n**0.5 / lengths)
    k = len(lengths)

    def moments(cells):
        w = centre.rows(cells) @ weights
        return np.concatenate([w.sum(axis=0), (w.T @ w).ravel()])

    found = np.array(summed(blocks, moments, "double")) / n
    error = float(np.abs(found[k:].reshape(k, k) - np.outer(found[:k], found[:k]) - np.eye(k)).max())
    shares = lengths**2 / squares

    def run(batches):
        for batch in batches:
            for ids, cells in matrices(batch):
                for i in range(0, len(cells), 2048):
                    some = cells[i : i + 2048]
                    m = len(some) * k
                    again = pa.array(np.repeat(np.arange(len(some)), k))
                    yield pa.record_batch(
                        [
                            ids.slice(i, len(some)).take(again), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(some))),
                            pa.array(np.full(m, n)), pa.array(np.repeat(centre.deviations(some), k)),
                            pa.array((centre.rows(some) @ weights).ravel()), pa.array(np.tile(shares, len(some))), pa.array(np.full(m, error)),
                        ],
                        ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                    )

    return blocks.mapInArrow(run, RESULT).withColumnRenamed("id", id_col)
