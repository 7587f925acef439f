"""The incremental steps as streams. Every function takes and returns a streaming
DataFrame; `run_available` drives one to its end and can be resumed.
"""

from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.classify import classify_sites
from ..operators.crawl_log import MAX_ATTEMPTS, attempt_outcome, first_deciding, with_status
from ..operators.pages import page_facts
from .resolver import OUTPUT_TYPE, RECORD, STATE, resolver

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
# Parts of the state of `stream_attempt_resolve`.
BUCKETS = 1 << 15


def read_files(spark: SparkSession, folder: str, schema, pattern: str = "*.parquet",
               files_per_trigger: int | None = None) -> DataFrame:
    """Parquet files as they arrive in a folder."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def _thin(stream: DataFrame, keys) -> DataFrame:
    """Drop rows that repeat another in all of `keys` and meet it in one Arrow batch.

    Later steps drop the rest; this keeps a key that fills the stream from
    sending every copy to the one task that owns it.
    """
    names = [c for c in stream.columns if c in keys]

    def first_copies(batches):
        for batch in batches:
            once = pa.Table.from_batches([batch]).group_by(names).aggregate([]).select(names)
            yield from once.to_batches()

    return stream.select(*names).mapInArrow(first_copies, stream.select(*names).schema)


def stream_enrich(pages: DataFrame) -> DataFrame:
    """Page facts and classification of each arriving page. Nothing is kept between pages."""
    return classify_sites(page_facts(pages))


def stream_url_dedupe(urls: DataFrame, ts: str = "ts", delay: str | None = None) -> DataFrame:
    """First sighting of each URL, for good.

    Every URL seen is a key of the state, which lies in RocksDB, spread over the tasks by URL, and is
    committed with each batch. With a `delay` the state is dropped once the watermark passes, and a URL
    that comes again after that is a new sighting.
    """
    if delay is None:
        return _thin(urls, urls.columns).dropDuplicates(["url"])
    return urls.withWatermark(ts, delay).dropDuplicatesWithinWatermark(["url"])


def stream_attempt_resolve(attempts: DataFrame, delay: str = "10 minutes",
                           timeout_s: int = 86_400, keep_s: int = 86_400,
                           max_attempts: int = MAX_ATTEMPTS, buckets: int | None = BUCKETS) -> DataFrame:
    """One status per URL, as soon as it is settled; the columns are those of `attempt_resolve`.

    Settled by a final attempt, by the last allowed failure, or by `timeout_s`
    of event time without news. Only then attempts beyond the allowed ones, or without a number,
    decide, where a URL has no others. A settled URL is remembered for `keep_s`,
    and attempts that come later are ignored. Attempts need a time.

    The state lies in `buckets` of URLs, each read and written as a whole by a batch that brings news of one of its
    URLs. With None every URL has a state of its own: better where small batches meet a state that is many times
    larger, far slower where a batch brings many URLs. A checkpoint belongs to one number of buckets.
    """
    judged = attempt_outcome(attempts).select("url", *(F.col("ts").cast("timestamp").alias("ts") if c == "ts" else c for c in RECORD))
    timed = _thin(judged, judged.columns).withWatermark("ts", delay)
    if buckets is None:
        groups = timed.groupBy("url")
    else:
        said = F.to_json(F.struct("url", *(c for c in RECORD if c != "ts"))).alias("said")
        groups = timed.select(F.pmod(F.xxhash64("url"), F.lit(buckets)).alias("bucket"), "ts", said).groupBy("bucket")
    judge = resolver(max_attempts, timeout_s, keep_s, in_buckets=buckets is not None)
    settled = groups.transformWithState(judge, OUTPUT_TYPE, "append", "eventTime")
    return with_status(settled)


def open_attempts(spark: SparkSession, checkpoint: str) -> DataFrame:
    """What a stopped `stream_attempt_resolve` still holds: the deciding records of URLs that are not settled."""
    state = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", STATE).load()
    if "urls" in state.select("value.*").columns:
        urls = state.select(F.explode("value.urls").alias("_url")).select("_url.url", "_url.records")
    else:
        urls = state.select("key.url", "value.records")
    return urls.select("url", F.explode("records").alias("_record")).select("url", "_record.*")


def flush_attempts(spark: SparkSession, checkpoint: str, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """One status per URL that a stopped `stream_attempt_resolve` has left open, as a batch over all of the log would give it.

    The state is only read, so the stream may go on later and settle the same URLs.
    """
    return first_deciding(open_attempts(spark, checkpoint), max_attempts)


def stream_progress(done: DataFrame, status: str = "status", ts: str = "ts",
                    every: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Completions per status and interval. Works on tables as well as on streams."""
    timed = done.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)
    return (
        timed.groupBy(F.window(ts, every), status)
        .agg(F.count("*").alias("n"))
        .select(F.col("window.start").alias("start"), status, "n")
    )


def follow_progress(counts: DataFrame, place: str, checkpoint: str, timeout_s: int | None = None) -> None:
    """Write what changes in the counts of `stream_progress`, batch by batch, to a folder of its own each.

    Windows that are still open are in it, and counted anew when late rows come. A batch
    that runs again after a failure replaces its own folder, so nothing counts twice.
    """

    def put(changed: DataFrame, number: int) -> None:
        changed.write.mode("overwrite").parquet(f"{place}/batch={number}")

    query = counts.writeStream.outputMode("update").foreachBatch(put)
    _run_to_end(query, counts.sparkSession, checkpoint, timeout_s)


def read_progress(spark: SparkSession, place: str, status: str = "status") -> DataFrame:
    """The newest count of each interval and status."""
    return spark.read.parquet(place).groupBy("start", status).agg(F.max_by("n", "batch").alias("n"))


@contextmanager
def _state_in_rocksdb(spark):
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


def _run_to_end(writer, spark, checkpoint, timeout_s):
    with _state_in_rocksdb(spark):
        query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    if timeout_s is None:
        query.awaitTermination()
    elif not query.awaitTermination(timeout_s):
        query.stop()
        raise TimeoutError(f"the stream was stopped after {timeout_s} seconds")


def run_available(stream: DataFrame, out: str, checkpoint: str, timeout_s: int | None = None) -> None:
    """Process what has arrived, append it as parquet, and stop; a TimeoutError if `timeout_s` do not suffice.

    Run again with the same checkpoint to go on where the last run ended, also
    after a failure: files and state are committed together.
    """
    writer = stream.writeStream.format("parquet").option("path", out).outputMode("append")
    _run_to_end(writer, stream.sparkSession, checkpoint, timeout_s)
