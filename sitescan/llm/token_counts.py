"""Token counts through a cache of content digests.

The cache is a Parquet folder of (version, digest, n_bytes, n_tokens); `version`
digests the tokenizer's file and the library's version. Only texts whose digest
is not in the cache are encoded, each once, and their counts are appended.
"""

import functools
import hashlib

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.email_checks import one_per_key

# Digests a task keeps at hand before the shuffle, to drop copies.
REMEMBERED = 300_000
CACHE = "version string, digest string, n_bytes bigint, n_tokens bigint"


@functools.cache
def library(path: str):
    """A function from texts to numbers of tokens; .json is read by tokenizers, .model by sentencepiece."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.no_truncation()
    model.no_padding()
    return lambda texts: [len(x) for x in model.encode_batch_fast(texts, add_special_tokens=False)]


def version_of(path: str) -> str:
    kind = "sentencepiece" if path.endswith(".model") else "tokenizers"
    module = __import__(kind)
    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + f"{kind} {module.__version__}".encode()).hexdigest()


def open_cache(spark: SparkSession, place: str) -> DataFrame:
    """The cache at `place`, made if there is none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        spark.createDataFrame([], CACHE).write.mode("ignore").parquet(place)
    return spark.read.schema(CACHE).parquet(place)


def _first_of_each(batches):
    """Rows whose digest this task has not seen lately; it remembers up to twice `REMEMBERED`."""
    seen, before = set(), set()
    for batch in batches:
        fresh = []
        for i, digest in enumerate(batch.column("digest").to_pylist()):
            key = bytes.fromhex(digest)
            if key not in seen:
                seen.add(key)
                if key not in before:
                    fresh.append(i)
        if len(seen) > REMEMBERED:
            seen, before = set(), seen
        yield batch.take(pa.array(fresh, pa.int64()))


def _first_of_run(batches):
    """The first row of each run of one digest."""
    last = None
    for batch in batches:
        fresh = []
        for i, digest in enumerate(batch.column("digest").to_pylist()):
            if digest != last:
                fresh.append(i)
            last = digest
        yield batch.take(pa.array(fresh, pa.int64()))


def append_misses(docs: DataFrame, cache_place: str, path: str) -> None:
    """Encode the distinct texts of docs(digest, text) that the cache does not hold, and append their counts.

    Copies are dropped per task before the shuffle by digest, so a text that
    makes up a third of all rows arrives a few times per task at most. Behind the shuffle rows are sorted by digest, so
    that neither the cache nor the digests of a task need to fit into memory.
    """
    spark = docs.sparkSession
    version = version_of(path)
    known = open_cache(spark, cache_place).where(F.col("version") == version).select("digest")

    def encode(batches):
        count = library(path)
        for batch in _first_of_run(batches):
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                n = count(part.column("text").to_pylist())
                size = pc.binary_length(part.column("text")).cast(pa.int64())
                yield pa.record_batch([part.column("digest"), size, pa.array(n, pa.int64())], ["digest", "n_bytes", "n_tokens"])

    texts = docs.select("digest", "text").mapInArrow(_first_of_each, "digest string, text string")
    misses = texts.repartition("digest").join(known, "digest", "left_anti").sortWithinPartitions("digest")
    counted = misses.mapInArrow(encode, "digest string, n_bytes bigint, n_tokens bigint")
    counted.select(F.lit(version).alias("version"), "*").write.mode("append").parquet(cache_place)


def count_tokens(docs: DataFrame, cache_place: str, path: str, limit: int, id_col="doc_id", text_col="text") -> DataFrame:
    """One row per row of `docs`: id, n_bytes, n_tokens, over_limit.

    A null text counts as empty, with no tokens. Null ids and repeated rows
    stay. Other columns are left out.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(F.col(id_col).alias("_id"), F.sha2(text, 256).alias("digest"), text.alias("text"))
    append_misses(keyed, cache_place, path)
    # Two jobs that run at once may both append a digest. The side with hot digests can be split by adaptive execution.
    cached = open_cache(spark, cache_place).where(F.col("version") == version_of(path))
    known = one_per_key(cached, "digest", n_bytes=F.max("n_bytes"), n_tokens=F.max("n_tokens"))
    return keyed.select("_id", "digest").join(known, "digest", "left").select(
        F.col("_id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
