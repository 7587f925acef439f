"""What the plans look like, and what happens when one key holds much of the data."""

import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from checks.queries import QUERIES
from sitescan.functions import nodes
from sitescan.operators import crawl_log, discovery, email_checks, pages, urls
from sitescan.plans import profile
from sitescan.session import broadcast_if_small, spread

SF_DIR = "/root/testdata/sf0.001"


def plan_of(df, run=False):
    if run:
        df.write.format("noop").mode("overwrite").save()
        df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def conf(spark):
    """Set options for one test."""
    before = {}

    def put(**options):
        for name, value in options.items():
            key = "spark.sql." + name.replace("__", ".")
            before.setdefault(key, spark.conf.get(key, None))
            spark.conf.set(key, value)

    yield put
    for key, value in before.items():
        if value is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, value)


ROW_LOCAL = (
    "page_title", "page_description", "body_text", "enrich_pages", "page_author", "cms_fingerprint",
    "email_rank", "email_matches", "best_email", "classify_sites", "outlinks", "language_id", "clean_name",
)


@pytest.mark.parametrize("name", ROW_LOCAL)
def test_page_work_needs_no_shuffle(spark, name):
    plan = plan_of(QUERIES[name](spark, SF_DIR))
    # The only exchange shares out the rows of the one small input file.
    assert set(re.findall(r"Exchange (\w+)", plan)) <= {"RoundRobinPartitioning"}


@pytest.mark.parametrize("name", [n for n in QUERIES if not n.startswith("stream_") and not n.startswith("learned_")])
def test_no_nested_loops(spark, name):
    plan = plan_of(QUERIES[name](spark, SF_DIR))
    assert "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("name", ["cms_fingerprint", "email_rank", "quick_body", "clean_name", "attempt_resolve"])
def test_no_python_where_none_is_needed(spark, name):
    assert "Python" not in plan_of(QUERIES[name](spark, SF_DIR)) and "ArrowEval" not in plan_of(QUERIES[name](spark, SF_DIR))


def test_scans_read_only_what_is_asked_for(spark):
    table = spark.read.parquet(f"{SF_DIR}/pages.parquet")
    assert "ReadSchema: struct<page_id:bigint,html:string>" in plan_of(pages.page_title(table))
    shown = plan_of(profile.profile_sites(table).select("url", "status"))
    assert "ReadSchema: struct<url:string>" in shown and "Python" not in shown and "ArrowEval" not in shown


def test_status_filter_reaches_the_index_files(spark, rows, tmp_path):
    schema = "crawl_index string, index_rank int, url string, status_code int, digest string"
    rows(schema, ("i", 0, "https://travel.org", 200, "x")).write.parquet(str(tmp_path / "i"))
    index = spark.read.parquet(str(tmp_path / "i"))
    patterns = discovery.query_patterns(rows("query_id int, query string", (1, "travel")))
    plan = plan_of(discovery.index_pattern_scan(index, patterns, 5))
    assert "EqualTo(status_code,200)" in plan and "digest" not in plan


def test_rows_of_one_key_are_merged_before_the_shuffle(spark, rows):
    for df in (
        urls.url_dedupe(rows("url string, pos bigint", ("a", 1))),
        crawl_log.attempt_resolve(rows("url string, attempt int, status_code int, error_class string, ts timestamp")),
    ):
        assert plan_of(df).count("Aggregate") == 2


def test_top_n_is_cut_before_the_shuffle(rows):
    plan = plan_of(discovery.top_per_key(rows("k int, v int", (1, 1)), ["k"], ["v"], 10))
    assert plan.count("WindowGroupLimit") == 2


def test_a_hot_mail_domain_is_split(spark, conf):
    conf(
        autoBroadcastJoinThreshold="-1",
        adaptive__autoBroadcastJoinThreshold="-1",
        adaptive__coalescePartitions__enabled="false",
        adaptive__skewJoin__skewedPartitionThresholdInBytes="2k",
        adaptive__skewJoin__skewedPartitionFactor="2",
        adaptive__advisoryPartitionSizeInBytes="4k",
        shuffle__partitions="16",
    )
    n = 60_000
    domain = F.when(F.col("id") % 3 == 0, "hot.org").otherwise(F.concat(F.lit("d"), (F.col("id") % 5000).cast("string"), F.lit(".org")))
    found = spark.range(n).repartition(8).select(F.concat(F.lit("u"), F.col("id").cast("string"), F.lit("@"), domain).alias("email"))
    mx = spark.range(2500).select(F.concat(F.lit("d"), F.col("id").cast("string"), F.lit(".org")).alias("domain"), F.lit(1).alias("mx_count"))
    mx = mx.unionByName(spark.createDataFrame([("hot.org", 2)], "domain string, mx_count int"))
    checked = email_checks.email_mx(email_checks.email_format(found), mx)
    got = checked.groupBy("mx_valid").count().collect()
    want = sum(1 for i in range(n) if i % 3 == 0 or i % 5000 < 2500)
    assert {r.mx_valid: r["count"] for r in got} == {True: want, False: n - want}
    checked.collect()
    assert "skew=true" in plan_of(checked)


def test_rows_without_a_key_are_spread(spark, rows):
    """No address, no domain: such rows must not meet in one task."""
    table = spark.range(20_000).select(
        F.concat(F.lit("https://s"), F.col("id").cast("string")).alias("url"), F.lit(None).cast("string").alias("email")
    )
    checked = email_checks.email_mx(email_checks.email_format(table), rows("domain string, mx_count int", ("a.org", 1)))
    text = checked._jdf.queryExecution().optimizedPlan().toString()
    assert "xxhash64" in text and checked.where("mx_valid").isEmpty() and checked.count() == 20_000


def test_broadcast_only_below_a_checked_size(spark):
    small = spark.range(10).select(F.col("id").alias("k"))
    hinted = lambda df: "broadcast" in spark.range(5).withColumnRenamed("id", "k").join(df, "k")._jdf.queryExecution().analyzed().toString().lower()
    assert hinted(broadcast_if_small(small))
    assert not hinted(broadcast_if_small(small, max_rows=5))
    assert not hinted(broadcast_if_small(small, max_bytes=5))


def test_spread_leaves_large_tables_alone(spark):
    assert spread(spark.range(100).repartition(50)).rdd.getNumPartitions() == 50
    assert spread(spark.range(100).coalesce(1)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_nodes_leave_a_worker_in_small_portions(monkeypatch):
    """One batch of many pages, and of long ones, must not become nodes as a whole."""
    monkeypatch.setattr(nodes.F, "arrow_udf", lambda _: lambda function: lambda html: function)
    read = nodes.parse_html(None)
    pages_ = [f"<p>{i}</p>" for i in range(1000)] + [None, "", "<b>" + "x" * nodes.PORTION_CHARS, "<i>last</i>"]
    portions = list(read(iter([pa.array(pages_, pa.string()), pa.array([], pa.string())])))
    assert max(map(len, portions)) <= nodes.PORTION_PAGES and len(portions[-1]) == 1
    got = [row["nodes"] and row["nodes"][-1]["text"][:4] for part in portions for row in part.to_pylist()]
    assert got == [str(i) for i in range(1000)] + [None, None, "xxxx", "last"]
