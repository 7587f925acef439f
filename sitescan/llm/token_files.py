"""Token ids in binary files: ids ranked by frequency, in one to four bytes each.

A file row is one block of whole documents in ascending order of their ids. It
holds `control`, two bits per token (bytes used less one, four tokens to a
byte), `data`, the bytes of the tokens' ranks, and per document its id and
number of tokens. The rank table lies beside the blocks. Frequent ids have small
ranks, so most tokens take one byte.

The container is Parquet, so that Spark commits each file as a whole, on any
file system, also when tasks are run again.
"""

import functools
import os
import string
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import Codebook, remove, scratch, slices, spread_out, written

BLOCK_TOKENS = 1 << 20
_BLOCK = "part int, seq int, n_tokens long, docs array<bigint>, sizes binary, control binary, data binary"


@functools.cache
def tokenizer(path: str) -> Codebook:
    """A codebook over a file of the tokenizers library; one per Python worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    from tokenizers.pre_tokenizers import ByteLevel, CharDelimiterSplit

    library = Tokenizer.from_file(path)
    library.model._resize_cache(0)  # the codebook remembers what the library would
    # For words that the vocabulary's own pattern does not cut any further, and whose bytes are their letters.
    uncut = Tokenizer(library.model)
    uncut.pre_tokenizer = CharDelimiterSplit("\n")

    def ids_of(texts, model=library):
        found = [np.asarray(e.ids, np.uint32) for e in model.encode_batch_fast(texts, add_special_tokens=False)]
        return np.concatenate([np.zeros(0, np.uint32), *found]), np.array([len(x) for x in found], np.int64)

    def ids_of_joined(texts, space, between, model, together=64):
        # A tail follows a space and holds none, so many are encoded as one text and told apart
        # by the tokens that begin with a space. Should one be missing, each goes by itself.
        groups = [space + between.join(texts[i : i + together]) for i in range(0, len(texts), together)]
        ids, sizes = ids_of(groups, model)
        cuts = np.flatnonzero(spaced[ids])
        ends = np.cumsum(sizes)
        expected = np.minimum(together * np.arange(1, len(groups) + 1), len(texts))
        if np.array_equal(np.searchsorted(cuts, ends), expected):
            return ids, np.diff(np.append(cuts, len(ids)))
        return ids_of([" " + t for t in texts])

    def ids_of_tails(texts):
        plain = np.fromiter((byte_level and t.isascii() and t.isalpha() for t in texts), bool, len(texts))
        words = ids_of_joined([t for t, p in zip(texts, plain) if p], "Ġ", "\nĠ", uncut)
        others = ids_of_joined([t for t, p in zip(texts, plain) if not p], " ", " ", library)
        sizes = np.concatenate([words[1], others[1]])
        place = np.argsort(~plain, kind="stable").argsort()
        return np.concatenate([words[0], others[0]])[spread_out((np.cumsum(sizes) - sizes)[place], sizes[place])], sizes[place]

    size = library.get_vocab_size(with_added_tokens=True)
    spaced = np.zeros(max(library.get_vocab(with_added_tokens=True).values()) + 1, bool)
    for token, i in library.get_vocab(with_added_tokens=False).items():
        spaced[i] = token.startswith("Ġ")  # how byte-level vocabularies write a space
    # Their pattern keeps letters together and cuts between them and marks, apostrophes aside. Added tokens must not be in the way.
    added = [t.content for t in library.get_added_tokens_decoder().values()]
    pre = library.pre_tokenizer
    pattern = isinstance(pre, ByteLevel) and pre.use_regex and not pre.add_prefix_space and library.normalizer is None
    byte_level = pattern and library.token_to_id("Ġ") is not None and not any(t.isalnum() for t in added)
    marks = set(string.punctuation).difference("'", *added) if byte_level else ()
    book = Codebook(ids_of, ids_of_tails, marks="".join(sorted(marks)))
    book.vocabulary = max(size, len(spaced))
    return book


def encode_documents(
    docs: DataFrame, path: str, end_id: int = 0, id_col="doc_id", text_col="text", kind: str = "<u4"
) -> DataFrame:
    """(counts, doc, ids binary): the ids of each whole text as little-endian integers of type `kind`, then `end_id`.

    A null text is empty: its only id is `end_id`. One row out per row in;
    repeated rows and null ids stay. Besides, each task returns one row marked
    `counts`: how often it met each id, as 64-bit integers.
    """
    width = np.dtype(kind).itemsize

    def run(batches):
        book = tokenizer(path)
        counts = np.zeros(max(book.vocabulary, end_id + 1), np.int64)
        for batch in batches:
            for part in slices(batch, "_text", 4 << 20):
                ids, ends = book.encode_texts(part.column("_text"))
                n = part.num_rows
                out = np.full(len(ids) + n, end_id, kind)
                shift = np.repeat(np.arange(n), np.diff(ends))
                out[np.arange(len(ids)) + shift] = ids
                counts += np.bincount(out, minlength=len(counts))
                offsets = (ends + np.arange(n + 1)) * width
                yield pa.record_batch([pa.array([False] * n), part.column("_doc"), binaries(out, offsets)], names)
        yield pa.record_batch([pa.array([True]), pa.array([None], pa.int64()), pa.array([counts.tobytes()])], names)

    names = ["counts", "doc", "ids"]
    rows = docs.select(F.col(id_col).cast("bigint").alias("_doc"), F.col(text_col).alias("_text"))
    return rows.mapInArrow(run, "counts boolean, doc bigint, ids binary")


def binaries(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """An array of binary values from one buffer; `offsets` in bytes."""
    kind = pa.large_binary() if offsets[-1] > 2**31 - 1 else pa.binary()
    width = np.int64 if kind == pa.large_binary() else np.int32
    buffers = [None, pa.py_buffer(offsets.astype(width)), pa.py_buffer(np.ascontiguousarray(values))]
    return pa.Array.from_buffers(kind, len(offsets) - 1, buffers)


def flat(values: pa.Array, kind):
    """(numbers, offsets) of binary values that hold numbers of type `kind`."""
    width = np.int64 if pa.types.is_large_binary(values.type) else np.int32
    offsets = np.frombuffer(values.buffers()[1], width)[values.offset : values.offset + len(values) + 1].astype(np.int64)
    size = np.dtype(kind).itemsize
    data = np.frombuffer(values.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]] if len(values) else b""
    return np.frombuffer(data, kind), (offsets - offsets[0]) // size


def frequencies(counts: DataFrame) -> DataFrame:
    """(id, n): how often each token id occurs, from the counts of the tasks."""

    def run(batches):
        total = 0
        for batch in batches:
            for row in batch.column("ids"):
                total = total + np.frombuffer(row.as_buffer(), np.int64)
        seen = np.flatnonzero(total) if np.ndim(total) else np.zeros(0, np.int64)
        yield pa.record_batch([pa.array(seen, pa.int64()), pa.array(np.take(total, seen), pa.int64())], ["id", "n"])

    return counts.select("ids").mapInArrow(run, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))


def pack(ranks: np.ndarray):
    """(control, data) of 32-bit numbers."""
    size = 1 + (ranks > 0xFF) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    codes = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    codes[: len(ranks)] = size - 1
    control = codes[0::4] | codes[1::4] << 2 | codes[2::4] << 4 | codes[3::4] << 6
    wide = np.ascontiguousarray(ranks, "<u4").view(np.uint8).reshape(-1, 4)
    return control, wide[np.arange(4) < size[:, None]]


# For each control byte, the lengths of its four numbers.
LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3).astype(np.uint8) + 1


def unpack(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    """The `n` numbers that `pack` was given, by looking control bytes up in a table."""
    size = LENGTHS[control].ravel()[:n]
    at = np.cumsum(size, dtype=np.int64) - size
    data = np.concatenate([data, np.zeros(3, np.uint8)])
    out = data[at].astype(np.uint32)
    for k in range(1, int(size.max(initial=1))):
        more = np.flatnonzero(size > k)
        out[more] |= data[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def write_token_files(docs: DataFrame, path: str, place: str, end_id: int = 0, id_col="doc_id", text_col="text") -> None:
    """Encode every text and write the files to `place`, in ascending order of document ids (nulls first)."""
    spark = docs.sparkSession
    vocabulary = max(tokenizer(path).vocabulary, end_id + 1)
    kind = "<u2" if vocabulary <= 1 << 16 else "<u4"
    store = scratch(spark, "token-ids")
    ids = written(encode_documents(docs, path, end_id, id_col, text_col, kind), store, ["counts"])
    # Collected: at most one row per entry of the vocabulary.
    counted = frequencies(ids.where("counts")).orderBy(F.desc("n"), "id").collect()
    by_rank = np.array([r["id"] for r in counted], np.uint32)
    rank_of = np.zeros(vocabulary, np.uint32)
    rank_of[by_rank] = np.arange(len(by_rank), dtype=np.uint32)
    ranks = spark.createDataFrame([(i, r["id"], r["n"]) for i, r in enumerate(counted)], "rank int, id bigint, n bigint")
    ranks.coalesce(1).write.parquet(f"{place}/ranks")
    known = spark.sparkContext.broadcast(rank_of)

    def run(batches):
        part, seq = TaskContext.get().partitionId(), 0
        for batch in batches:
            for piece in slices(batch, "ids", BLOCK_TOKENS * np.dtype(kind).itemsize):
                values, offsets = flat(piece.column(1), kind)
                control, data = pack(known.value[values])
                row = [part, seq, len(values), piece.column(0).to_pylist()]
                row += [np.diff(offsets).astype("<i8").tobytes(), control.tobytes(), data.tobytes()]
                yield pa.RecordBatch.from_pylist([dict(zip(names, row))], schema)
                seq += 1

    names = [x.split()[0] for x in _BLOCK.split(", ")]
    types = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary()]
    schema = pa.schema(list(zip(names, types)))
    ordered = ids.where("not counts").select("doc", "ids").repartitionByRange("doc").sortWithinPartitions("doc", "ids")
    ordered.mapInArrow(run, _BLOCK).write.option("compression", "zstd").parquet(f"{place}/blocks")
    known.unpersist()
    remove(spark, store)


def read_token_files(spark: SparkSession, place: str) -> DataFrame:
    """(part, seq, place, doc, n_tokens, ids binary): every document of the files, decoded."""
    by_rank = np.zeros(0, np.uint32)
    ranks = spark.read.parquet(f"{place}/ranks").orderBy("rank").collect()  # at most the vocabulary
    by_rank = np.array([r["id"] for r in ranks], "<u4")
    known = spark.sparkContext.broadcast(by_rank)
    out = ["part", "seq", "place", "doc", "n_tokens", "ids"]

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                control, data = (np.frombuffer(row[x], np.uint8) for x in ("control", "data"))
                ids = known.value[unpack(control, data, row["n_tokens"])]
                sizes = np.frombuffer(row["sizes"], "<i8")
                n = len(sizes)
                ends = np.concatenate([[0], np.cumsum(sizes)]) * 4
                columns = [np.full(n, row["part"], np.int32), np.full(n, row["seq"], np.int32), np.arange(n)]
                columns += [pa.array(row["docs"], pa.int64()), sizes, binaries(ids, ends)]
                yield pa.record_batch([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns], out)

    blocks = spark.read.schema(_BLOCK).parquet(f"{place}/blocks")
    return blocks.mapInArrow(run, "part int, seq int, place bigint, doc bigint, n_tokens bigint, ids binary")


def token_index(spark: SparkSession, place: str, id_col="doc_id") -> DataFrame:
    """One row per document of the files: doc_id, start, n_tokens, ids_crc32.

    `start` counts the ids of all documents before it. Totals are taken per
    block and per file part first, so no task sees all documents.
    """

    def run(batches):
        for batch in batches:
            sums = [zlib.crc32(x.as_buffer()) for x in batch.column("ids")]
            yield batch.drop_columns(["ids"]).append_column("ids_crc32", pa.array(sums, pa.int64()))

    rows = read_token_files(spark, place).mapInArrow(
        run, "part int, seq int, place bigint, doc bigint, n_tokens bigint, ids_crc32 bigint"
    )
    blocks = spark.read.schema(_BLOCK).parquet(f"{place}/blocks").select("part", "seq", "n_tokens")
    parts = blocks.groupBy("part").agg(F.sum("n_tokens").alias("_all"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # one row per part
    parts = parts.select("part", F.coalesce(F.sum("_all").over(before), F.lit(0)).alias("_part_start"))
    earlier = W.partitionBy("part").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    starts = blocks.join(F.broadcast(parts), "part").select(
        "part", "seq", (F.col("_part_start") + F.coalesce(F.sum("n_tokens").over(earlier), F.lit(0))).alias("_start")
    )
    within = W.partitionBy("part", "seq").orderBy("place").rowsBetween(W.unboundedPreceding, -1)
    return (
        rows.withColumn("_before", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
        .join(starts, ["part", "seq"])
        .select(F.col("doc").alias(id_col), (F.col("_start") + F.col("_before")).alias("start"), "n_tokens", "ids_crc32")
    )
