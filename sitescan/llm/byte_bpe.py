"""Byte-level BPE: every distinct word of the corpus is encoded once.

1. Documents become blocks of up to `BLOCK_BYTES` of text. A block lists its
   distinct pre-tokens and holds, per document, their positions as numbers in that
   list. The lists go to word buckets by a hash of the word, so a word that occurs
   everywhere is one entry per block, however often it is used.
2. In its bucket each distinct word is encoded once; the ids go back to the blocks.
3. A block puts its documents' ids together by position.

Blocks are written before they are used twice, so that both uses see the same ones.
"""

import base64
import functools
import zlib

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Words, scratch, slices, spread_out, written
from .token_files import binaries, flat

BLOCK_BYTES = 20 << 20
# Words whose ids a bucket keeps at hand, twice at most.
KNOWN = 300_000
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_BLOCKS = "kind int, block bigint, docs array<bigint>, sizes binary, spots binary, bucket int, at binary, words binary"


@functools.cache
def ranks_of(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


@functools.cache
def encoder(path: str, pattern: str):
    import tiktoken

    return tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks_of(path), special_tokens={})


def packed(data: bytes, level: int = 3) -> bytes:
    """Compressed, with the length before it; shuffles compress less well."""
    return len(data).to_bytes(8, "little") + pa.Codec("zstd", level).compress(data, asbytes=True)


def unpacked(data: bytes) -> bytes:
    size = int.from_bytes(data[:8], "little")
    return pa.Codec("zstd").decompress(data[8:], size, asbytes=True) if size else b""


def planes(numbers: np.ndarray, level: int = 3) -> bytes:
    """32-bit numbers, all lowest bytes first: the higher bytes are mostly zero and compress well."""
    return packed(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), level)


def from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(unpacked(data), np.uint8).reshape(4, -1).T).view("<u4").ravel()


def tiers(numbers: np.ndarray) -> bytes:
    """Numbers most of which are small: a byte each, 255 standing for those that follow in planes."""
    small = packed(np.minimum(numbers, 255).astype(np.uint8).tobytes(), 9)
    return len(small).to_bytes(8, "little") + small + planes(numbers[numbers >= 255] - 255, 9)


def from_tiers(data: bytes) -> np.ndarray:
    cut = 8 + int.from_bytes(data[:8], "little")
    numbers = np.frombuffer(unpacked(data[8:cut]), np.uint8).astype(np.uint32)
    numbers[numbers == 255] += from_planes(data[cut:])
    return numbers


def steps(numbers: np.ndarray) -> bytes:
    """Ascending numbers as their differences."""
    return planes(np.diff(numbers.astype(np.int64), prepend=0))


def from_steps(data: bytes) -> np.ndarray:
    return np.cumsum(from_planes(data), dtype=np.int64)


def word_list(words) -> bytes:
    """Words one after the other, with their lengths in bytes before them."""
    data = [w.encode("utf-8", "surrogatepass") for w in words]
    lengths = np.fromiter(map(len, data), "<u4", len(data))
    return packed(len(data).to_bytes(8, "little") + lengths.tobytes() + b"".join(data), 9)


def from_word_list(data: bytes) -> list[str]:
    data = unpacked(data)
    n = int.from_bytes(data[:8], "little")
    ends = 8 + 4 * n + np.cumsum(np.frombuffer(data, "<u4", n, 8), dtype=np.int64)
    starts = [8 + 4 * n, *ends[:-1].tolist()]
    return [data[a:b].decode("utf-8", "surrogatepass") for a, b in zip(starts, ends.tolist())]


class Block:
    """Documents with their pre-tokens as numbers: the most frequent first, equally frequent ones by their text."""

    def __init__(self, pattern):
        self.words = Words(regex.compile(pattern).findall)
        self.docs, self.sizes, self.spots, self.bytes = [], [], [], 0

    def add(self, docs: pa.Array, texts: pa.Array):
        spots, ends = self.words.codes(texts)
        self.spots.append(spots)
        self.sizes.append(np.diff(ends))
        self.docs += docs.to_pylist()
        self.bytes += texts.nbytes

    def rows(self, number: int, buckets: int):
        """The block's own row, then its words, a row per bucket."""
        spots = np.concatenate(self.spots)
        names = list(self.words.index)
        by_text = np.array(sorted(range(len(names)), key=names.__getitem__), np.int64)
        order = by_text[np.argsort(-np.bincount(spots, minlength=len(names))[by_text], kind="stable")]
        place = np.empty(len(order), np.uint32)
        place[order] = np.arange(len(order))
        sizes = np.concatenate(self.sizes)
        yield {"kind": 0, "block": number, "docs": self.docs, "sizes": sizes.astype("<i8").tobytes(), "spots": tiers(place[spots])}
        words = np.array(names, object)[order]
        bucket = np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in words), np.int64, len(words)) % buckets
        by_bucket = np.argsort(bucket, kind="stable")
        cuts = np.flatnonzero(np.diff(bucket[by_bucket])) + 1
        for at in np.split(by_bucket, cuts) if len(by_bucket) else []:
            yield {"kind": 1, "block": number, "bucket": int(bucket[at[0]]), "at": steps(at), "words": word_list(words[at])}


def to_blocks(docs: DataFrame, buckets: int, pattern: str) -> DataFrame:
    """docs(_doc, _text) as blocks and their word lists."""
    schema = pa.schema(
        [("kind", pa.int32()), ("block", pa.int64()), ("docs", pa.list_(pa.int64())), ("sizes", pa.binary()), ("spots", pa.binary())]
        + [("bucket", pa.int32()), ("at", pa.binary()), ("words", pa.binary())]
    )

    def run(batches):
        number = TaskContext.get().partitionId() << 32
        block = Block(pattern)
        for batch in batches:
            for part in slices(batch, "_text", 4 << 20):
                block.add(part.column("_doc"), part.column("_text"))
                if block.bytes >= BLOCK_BYTES:
                    rows = list(block.rows(number, buckets))
                    block, number = Block(pattern), number + 1
                    yield from out(rows)
        if block.docs:
            yield from out(list(block.rows(number, buckets)))

    def out(rows, together=64):
        for i in range(0, len(rows), together):
            yield pa.RecordBatch.from_pylist(rows[i : i + together], schema)

    return docs.mapInArrow(run, _BLOCKS)


def encode_words(words: DataFrame, path: str, pattern: str) -> DataFrame:
    """(block, at, sizes, ids) for rows of (block, bucket, at, words); a bucket's rows lie in one partition.

    A bucket with more distinct words than `KNOWN` forgets those that no block has used for longest, and
    encodes them again if one does, so its memory does not grow with the corpus.
    """
    width = "<u2" if max(ranks_of(path).values()) < 1 << 16 else "<u4"

    def run(batches):
        encode = encoder(path, pattern).encode_ordinary
        known, before = {}, {}
        for batch in batches:
            for row in batch.to_pylist():
                ids = []
                for w in from_word_list(row["words"]):
                    got = known.get(w)
                    if got is None:
                        got = before.get(w)
                        if got is None:
                            got = np.array(encode(w), width).tobytes()
                        known[w] = got
                    ids.append(got)
                if len(known) > KNOWN:
                    known, before = {}, known
                size = np.fromiter(map(len, ids), np.uint32, len(ids)) // np.dtype(width).itemsize
                out = {"block": [row["block"]], "at": [row["at"]], "sizes": [planes(size)], "ids": [packed(b"".join(ids), 9)]}
                yield pa.RecordBatch.from_pydict(out, schema)

    schema = pa.schema([("block", pa.int64()), ("at", pa.binary()), ("sizes", pa.binary()), ("ids", pa.binary())])
    return words.mapInArrow(run, "block bigint, at binary, sizes binary, ids binary")


def encode_documents(docs: DataFrame, path: str, pattern: str = PATTERN, id_col="doc_id", text_col="text") -> DataFrame:
    """(doc, n_tokens, ids binary): one row per row of `docs`, ids as little-endian 32-bit integers.

    A null or empty text has no ids. Null and repeated document ids stay, a
    row each. Special tokens are not looked for. Other columns are left out.
    """
    spark = docs.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    width = "<u2" if max(ranks_of(path).values()) < 1 << 16 else "<u4"
    rows = docs.select(F.col(id_col).cast("bigint").alias("_doc"), F.col(text_col).alias("_text"))
    blocks = written(to_blocks(rows, buckets, pattern), scratch(spark, "bpe-blocks"), ["kind"])
    words = blocks.where("kind = 1").select("block", "bucket", "at", "words").repartitionById(buckets, "bucket")
    encoded = encode_words(words, path, pattern)

    def assemble(key, left, right):
        row = left.to_pylist()[0]
        spots = from_tiers(row["spots"])
        at = np.concatenate([np.zeros(0, np.int64), *(from_steps(x) for x in right.column("at").to_pylist())])
        sizes = np.concatenate([np.zeros(0, np.uint32), *(from_planes(x) for x in right.column("sizes").to_pylist())]).astype(np.int64)
        ids = np.frombuffer(b"".join(map(unpacked, right.column("ids").to_pylist())), width)
        starts, lengths = np.zeros(len(at), np.int64), np.zeros(len(at), np.int32)
        starts[at], lengths[at] = np.cumsum(sizes) - sizes, sizes
        ends = np.concatenate([[0], np.cumsum(lengths[spots], dtype=np.int64)])
        whole = np.empty(ends[-1], "<u4")
        for i in range(0, len(spots), 1 << 18):  # a little at a time, for the sake of memory
            some = spots[i : i + (1 << 18)]
            whole[ends[i] : ends[i + len(some)]] = ids[spread_out(starts[some], lengths[some])]
        ends = ends[np.concatenate([[0], np.cumsum(np.frombuffer(row["sizes"], "<i8"))])]
        columns = [pa.array(row["docs"], pa.int64()), pa.array(np.diff(ends)), binaries(whole, ends * 4)]
        return pa.Table.from_arrays(columns, ["doc", "n_tokens", "ids"])

    own = blocks.where("kind = 0").select("block", "docs", "sizes", "spots")
    return own.groupBy("block").cogroup(encoded.groupBy("block")).applyInArrow(assemble, "doc bigint, n_tokens bigint, ids binary")


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """`encoded` with `decoded`, the bytes of its ids, looked up in the table of token bytes.

    The table is the vocabulary, of fixed size, which each task reads from the rank file.
    """

    def run(batches):
        by_rank = sorted(ranks_of(path).items(), key=lambda x: x[1])
        lengths = np.zeros(by_rank[-1][1] + 1, np.int64)
        lengths[[r for _, r in by_rank]] = [len(t) for t, _ in by_rank]
        table = np.frombuffer(b"".join(t for t, _ in by_rank), np.uint8)
        starts = np.cumsum(lengths) - lengths
        for batch in batches:
            for part in slices(batch, "ids"):
                ids, offsets = flat(part.column("ids"), "<u4")
                n = lengths[ids]
                ends = np.concatenate([[0], np.cumsum(n)])[offsets]
                decoded = binaries(table[spread_out(starts[ids], n)], ends)
                yield part.append_column("decoded", decoded)

    schema = ", ".join(f"`{c}` {t}" for c, t in encoded.dtypes)
    return encoded.mapInArrow(run, schema + ", decoded binary")
