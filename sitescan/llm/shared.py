"""Files in the shared folder, and texts as codes of distinct pieces."""

import itertools
import re
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir

# A space next to any white space, in the widest sense of the pattern languages used here.
WHITE = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]"
UNSAFE = f" {WHITE}|{WHITE} |^ | $"
# ASCII letters and digits, Latin, Greek and Cyrillic letters, as bytes of UTF-8: letters in every version of Unicode.
LETTER = (
    r"(?:[0-9A-Za-z]|\xC3[\x80-\x96\x98-\xB6\xB8-\xBF]|[\xC4-\xC8][\x80-\xBF]|\xC9[\x80-\x8F]"
    r"|\xCE[\xB1-\xBF]|\xCF[\x80-\x89]|[\xD0\xD1][\x80-\xBF]|\xD2[\x80\x81])"
)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh place in the folder that all executors share."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4()}"


def written(df: DataFrame, place: str, partition_by=()) -> DataFrame:
    """`df`, written to `place` and read again: later uses see the same rows, whatever is lost."""
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(place)
    return df.sparkSession.read.schema(df.schema).parquet(place)


def bucketed(df: DataFrame, place: str, column: str) -> DataFrame:
    """`df`, dealt by `column` and written to `place` so that joins on it move only their other side.

    There are as many buckets as spark.sql.shuffle.partitions says. `df` has to give the same rows again
    when a task is repeated, as what `written` returns does.
    """
    spark = df.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"bucketed_{uuid.uuid4().hex}"
    dealt = df.repartition(buckets, column).write.option("compression", "zstd").option("path", place)
    dealt.bucketBy(buckets, column).format("parquet").saveAsTable(name)
    table = spark.table(name)
    # Only the name goes; the files stay at `place`.
    spark.sql(f"DROP TABLE {name}")
    return table


def remove(spark: SparkSession, place: str) -> None:
    """Delete a folder that `scratch` named."""
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def slices(batch: pa.RecordBatch, column: str, size: int = 2 << 20):
    """Pieces of a batch with about `size` bytes in `column`; a longer value is a piece of its own."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths, dtype=np.int64)
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + size, side="right")))
        yield batch.slice(start, stop - start)
        start = stop
    pa.default_memory_pool().release_unused()  # Python workers live on from task to task


def pieces(texts: pa.Array):
    """`cut`, with its heads and tails as lists."""
    codes, offsets, heads, tails = cut(texts)
    return codes, offsets, heads.to_pylist(), listed(tails)


def cut(texts: pa.Array):
    """Texts cut before each single space: (codes, offsets, heads, tails).

    `codes[offsets[i]:offsets[i + 1]]` are the pieces of text i; codes below
    len(heads) stand for `heads`, pieces at a text's start, the others for
    `tails`, pieces that follow a space. The space is not in `tails`. Cuts lie
    between non-space and a single space only, where every tokenizer used here
    cuts too. A text with a space next to other white space, or at its ends, is
    one head as a whole.
    """
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    whole = pc.match_substring_regex(texts, UNSAFE)
    if pc.any(whole).as_py():
        split = pc.split_pattern(pc.if_else(whole, pa.scalar("", pa.large_string()), texts), " ")
    else:
        split = pc.split_pattern(texts, " ")
    offsets = split.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    offsets -= offsets[0]
    values = split.flatten()
    first = values.take(pa.array(offsets[:-1])) if len(texts) else values
    heads = pc.if_else(whole, texts, first).dictionary_encode()
    is_tail = np.ones(len(values), bool)
    is_tail[offsets[:-1]] = False
    tails = values.filter(pa.array(is_tail)).dictionary_encode()
    codes = np.empty(len(values), np.int32)
    codes[offsets[:-1]] = heads.indices.to_numpy(zero_copy_only=False)
    codes[is_tail] = tails.indices.to_numpy(zero_copy_only=False) + len(heads.dictionary)
    return codes, offsets, heads.dictionary, tails.dictionary


def listed(values: pa.Array) -> list[str]:
    """Texts without spaces as a list; far faster than one by one."""
    if not len(values):
        return []
    one = pa.LargeListArray.from_arrays(pa.array([0, len(values)], pa.int64()), values)
    return pc.binary_join(one, pa.scalar(" ", values.type))[0].as_py().split(" ")


def apart(tails: pa.Array, marks: str):
    """Tails cut before their first mark behind a letter or digit: (stems, stem_of, ends, end_of).

    `stems` and `ends` are distinct, `stem_of` and `end_of` number them; the end of an uncut tail is empty.
    """
    starts = np.frombuffer(tails.buffers()[1], np.int64)[tails.offset : tails.offset + len(tails) + 1]
    data = np.frombuffer(tails.buffers()[2] or b"", np.uint8)
    kept = np.diff(starts)
    if marks:
        # Where the letter begins, in bytes; those above 0x7F have two.
        at = pc.find_substring_regex(tails.cast(pa.large_binary()), f"{LETTER}[{re.escape(marks)}]").to_numpy(zero_copy_only=False)
        found = np.flatnonzero(at >= 0)
        kept[found] = at[found] + 1 + (data[starts[found] + at[found]] > 0x7F)

    def encoded(begin, sizes):
        buffers = [None, pa.py_buffer(np.concatenate([[0], np.cumsum(sizes)])), pa.py_buffer(data[spread_out(begin, sizes)])]
        return pa.Array.from_buffers(tails.type, len(sizes), buffers).dictionary_encode()

    stems, ends = encoded(starts[:-1], kept), encoded(starts[:-1] + kept, np.diff(starts) - kept)
    stem_of, end_of = (x.indices.to_numpy(zero_copy_only=False) for x in (stems, ends))
    return listed(stems.dictionary), stem_of, ends.dictionary.to_pylist(), end_of


def spread_out(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices starts[i] … starts[i] + lengths[i] - 1, one run after the other."""
    ends = np.cumsum(lengths, dtype=np.int64)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


class Codebook:
    """Token ids of distinct pieces, kept from block to block up to a number of pieces; the most used ones stay.

    `heads` and `tails` are functions from pieces to (all their ids, the number
    of ids of each); tails are given without the space before them. `marks` are
    characters that are encoded apart from a letter or digit before them, with
    all that follows them; none, if the tokenizer may join them.
    """

    def __init__(self, heads, tails, limit: int = 400_000, marks: str = ""):
        self.heads, self.tails, self.limit, self.marks = heads, tails, limit, marks
        self.index, self.used = {}, 0
        self.starts, self.lengths = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids, self.hits = np.zeros(0, np.uint32), np.zeros(0, np.float32)

    def forget(self):
        """Keep the half of the limit that was met in most blocks; older meetings count less."""
        n = min(len(self.index), self.limit // 2)
        keep = np.sort(np.argsort(-self.hits, kind="stable")[:n])
        keys = list(self.index)
        self.index = {}  # gone before the next one is made, for the sake of memory
        self.index = {keys[i]: at for at, i in enumerate(keep.tolist())}
        self.hits = self.hits[keep] / 2
        ids = self.ids[spread_out(self.starts[keep], self.lengths[keep])]
        self.lengths = self.lengths[keep]
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.ids, self.used = ids, len(ids)

    def learn(self, keys, found):
        ids, lengths = found
        self.index.update(zip(keys, range(len(self.index), len(self.index) + len(keys))))
        self.starts = np.concatenate([self.starts, self.used + np.cumsum(lengths) - lengths])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.hits = np.concatenate([self.hits, np.zeros(len(keys), np.float32)])
        if self.used + len(ids) > len(self.ids):
            self.ids = np.resize(self.ids, 2 * (self.used + len(ids)))
        self.ids[self.used : self.used + len(ids)] = ids
        self.used += len(ids)

    def find(self, keys: list[str]) -> np.ndarray:
        """The entry of each piece, -1 for unknown ones."""
        return np.fromiter(map(self.index.get, keys, itertools.repeat(-1)), np.int64, len(keys))

    def rows(self, heads: list[str], tails: list[str]) -> np.ndarray:
        """The entry of each piece, tails being distinct; unknown ones are encoded first."""
        keys = heads + [" " + t for t in tails]
        found = self.find(keys)
        if len(self.index) + np.count_nonzero(found < 0) > self.limit:
            self.hits[found[found >= 0]] += 1
            self.forget()
            found = self.find(keys)
        n = len(heads)
        new = np.flatnonzero(found[n:] < 0)
        if len(new):
            found[n + new] = len(self.index) + np.arange(len(new))
            self.learn([keys[n + i] for i in new.tolist()], self.tails([tails[i] for i in new.tolist()]))
        if (found[:n] < 0).any():
            # Not those that a tail has brought along with its space.
            new = list(dict.fromkeys(t for t in heads if t not in self.index))
            if new:
                self.learn(new, self.heads(new))
            found[:n] = self.find(heads)
        self.hits[found] += 1
        return found

    def encode_texts(self, texts: pa.Array):
        """(ids, offsets): the ids of all texts, and where each text's ids begin and end."""
        codes, offsets, heads, tails = cut(texts)
        n = len(heads)
        # The entries of each piece: of a head, or of a tail's stem and of the marks behind that.
        stems, stem_of, ends, end_of = apart(tails, self.marks)
        known, end, stem = np.split(self.rows(heads.to_pylist() + ends, stems), [n, n + len(ends)])
        entries = np.zeros((n + len(tails), 2), np.int64)
        entries[:n, 0], entries[n:, 0], entries[n:, 1] = known, stem[stem_of], end[end_of]
        sizes = self.lengths[entries]
        sizes[:n, 1] = 0
        own = self.ids[spread_out(self.starts[entries].ravel(), sizes.ravel())]
        bounds = np.concatenate([[0], np.cumsum(sizes.sum(axis=1))]) * own.itemsize
        own = pa.Array.from_buffers(pa.large_binary(), len(entries), [None, pa.py_buffer(bounds), pa.py_buffer(own)])
        whole = own.take(pa.array(codes))
        at = np.frombuffer(whole.buffers()[1], np.int64)[: len(codes) + 1] // self.ids.itemsize
        return np.frombuffer(whole.buffers()[2] or b"", self.ids.dtype)[: at[-1]], at[offsets]


class Words:
    """The words of texts as numbers into the list of the distinct ones.

    `find` is a pattern's findall; no match may begin before a space and end behind it.
    """

    def __init__(self, find):
        self.find, self.index = find, {}

    def codes(self, texts: pa.Array):
        """(codes, offsets): the word numbers of all texts, and where each text's words begin and end."""
        codes, offsets, heads, tails = pieces(texts)
        found = [self.find(t) for t in heads] + [self.find(" " + t) for t in tails]
        n = np.fromiter(map(len, found), np.int64, len(found))
        index = self.index
        words = list(itertools.chain.from_iterable(found))
        for w in words:
            if w not in index:
                index[w] = len(index)
        local = np.fromiter(map(index.__getitem__, words), np.int32, len(words))
        lengths = n[codes]
        ends = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
        return local[spread_out((np.cumsum(n) - n)[codes], lengths)], ends[offsets]


class Plain:
    """A table under names of our own, so that none of its columns can clash with an operator's.

    `rows` has _id, _text and the other columns as _c0, _c1 …; `back` restores the names. A
    column that has the name of a result is replaced by the result.
    """

    def __init__(self, docs: DataFrame, id_col: str, text_col: str):
        known = {id_col: "_id", text_col: "_text"}
        self.names = [(c, known.get(c, f"_c{i}")) for i, c in enumerate(docs.columns)]
        self.rows = docs.select(*(F.col("`" + c.replace("`", "``") + "`").alias(n) for c, n in self.names))

    def back(self, df: DataFrame, **results) -> DataFrame:
        old = [F.col(n).alias(c) for c, n in self.names if c not in results]
        return df.select(*old, *(x.alias(c) for c, x in results.items()))
