import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from sitescan.operators import crawl_log
from sitescan.operators.classify import classify_sites
from sitescan.operators.pages import page_facts
from sitescan.streaming import jobs
from sitescan.streaming.resolver import resolver

T0 = datetime(2024, 1, 1)
ATTEMPTS = "url string, attempt int, status_code int, error_class string, ts timestamp"


class Feed:
    """A folder that tables are dropped into, and a stream over it."""

    def __init__(self, spark, tmp_path, schema, transform):
        self.spark, self.schema, self.transform = spark, schema, transform
        self.base = str(tmp_path)
        self.n = 0

    def put(self, table):
        self.n += 1
        table.coalesce(1).write.parquet(f"{self.base}/in/part{self.n}")

    def run(self):
        stream = jobs.read_files(self.spark, f"{self.base}/in/*", self.schema)
        jobs.run_available(self.transform(stream), f"{self.base}/out", f"{self.base}/checkpoint", 120)
        return self.spark.read.parquet(f"{self.base}/out")


def test_enrich_equals_batch_and_resumes(spark, tmp_path):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    feed = Feed(spark, tmp_path, pages.schema, jobs.stream_enrich)
    feed.put(pages.where("page_id < 20"))
    assert feed.run().count() == 20
    feed.put(pages.where("page_id >= 20"))
    got = feed.run()
    want = classify_sites(page_facts(pages))
    assert got.count() == want.count() and got.select(*want.columns).exceptAll(want).isEmpty()


def test_dedupe(spark, rows, tmp_path):
    schema = "url string, ts timestamp"
    feed = Feed(spark, tmp_path, schema, lambda s: jobs.stream_url_dedupe(s, delay="1 hour"))
    feed.put(rows(schema, ("a", T0), ("a", T0), ("b", T0)))
    feed.run()
    feed.put(rows(schema, ("a", T0 + timedelta(minutes=5)), ("c", T0)))
    assert sorted(r.url for r in feed.run().collect()) == ["a", "b", "c"]


def test_dedupe_is_for_good_without_a_delay(spark, rows, tmp_path):
    schema = "url string, ts timestamp"
    feed = Feed(spark, tmp_path, schema, jobs.stream_url_dedupe)
    feed.put(rows(schema, ("a", T0), ("a", T0), ("b", T0)))
    assert feed.run().count() == 2
    feed.put(rows(schema, ("a", T0 + timedelta(days=366)), ("c", T0)))
    assert sorted(r.url for r in feed.run().collect()) == ["a", "b", "c"]
    # Nothing new: a run over what has been seen adds nothing.
    feed.put(rows(schema, ("b", T0 - timedelta(days=900)), ("c", T0)))
    assert feed.run().count() == 3


def attempts(rows, *values):
    return rows(ATTEMPTS, *[(u, n, code, err, T0 + timedelta(minutes=m)) for u, n, code, err, m in values])


ALL = [
    ("ok", 1, 500, None, 1), ("ok", 2, 200, None, 2), ("ok", 3, 404, None, 3),
    ("fail", 1, 500, None, 1), ("fail", 2, None, "timeout", 2), ("fail", 3, 503, None, 3),
    ("slow", 1, 500, None, 1), ("slow", 2, 500, None, 2), ("slow", 3, None, "timeout", 3),
    ("blocked", 1, 403, None, 1),
]


def resolved(table):
    return sorted((r.url, r.attempt, r.fetch_status, r.fetch_error) for r in table.collect())


def test_attempts_in_one_or_three_batches(spark, rows, tmp_path):
    want = resolved(crawl_log.attempt_resolve(attempts(rows, *ALL)))
    for name, parts in (("one", [ALL]), ("three", [[a for a in ALL if a[1] == n] for n in (1, 2, 3)])):
        feed = Feed(spark, tmp_path / name, ATTEMPTS, jobs.stream_attempt_resolve)
        for part in parts:
            feed.put(attempts(rows, *part))
            got = feed.run()
        assert resolved(got) == want


def test_late_attempt_after_the_verdict_is_ignored(spark, rows, tmp_path):
    feed = Feed(spark, tmp_path, ATTEMPTS, jobs.stream_attempt_resolve)
    feed.put(attempts(rows, ("u", 2, 200, None, 2)))
    feed.run()
    feed.put(attempts(rows, ("u", 1, 404, None, 1), ("u", 3, 200, None, 3)))
    assert resolved(feed.run()) == [("u", 2, "OK", None)]


def test_silence_ends_a_url(spark, rows, tmp_path):
    run = lambda s: jobs.stream_attempt_resolve(s, "1 minute", timeout_s=60)
    feed = Feed(spark, tmp_path, ATTEMPTS, run)
    feed.put(attempts(rows, ("u", 1, None, "timeout", 1)))
    assert feed.run().count() == 0
    feed.put(attempts(rows, ("other", 1, 200, None, 60)))
    feed.run()
    feed.put(attempts(rows, ("third", 1, 200, None, 61)))
    assert ("u", 1, "TIMEOUT", "Request timed out") in resolved(feed.run())


def test_attempts_beyond_the_allowed_decide_where_there_are_no_others(spark, rows, tmp_path):
    log = ALL + [
        ("only4", 4, 200, None, 4), ("fails4", 4, 500, None, 4), ("fails4", 5, None, "timeout", 5),
        ("ends5", 4, 500, None, 4), ("ends5", 6, 404, None, 6), ("ends5", 5, 200, None, 5),
        ("both", 4, 200, None, 4), ("both", 1, None, "timeout", 5),
    ]
    want = resolved(crawl_log.attempt_resolve(attempts(rows, *log)))
    for name, parts in (("one", [log]), ("two", [[a for a in log if a[4] <= 4], [a for a in log if a[4] > 4]])):
        run = lambda s: jobs.stream_attempt_resolve(s, timeout_s=3600)
        feed = Feed(spark, tmp_path / name, ATTEMPTS, run)
        for part in parts:
            feed.put(attempts(rows, *part))
            feed.run()
        # Later news flushes what is open.
        feed.put(attempts(rows, ("flush1", 1, 200, None, 300)))
        feed.run()
        feed.put(attempts(rows, ("flush2", 1, 200, None, 301)))
        got = feed.run().where("url not like 'flush%'")
        assert resolved(got) == want


ODD = ALL + [
    ("zero", 0, 500, None, 1), ("zero", 1, 200, None, 2), ("zero_ends", 0, 404, None, 3), ("zero_ends", 1, 200, None, 1),
    ("only_zero", 0, 500, None, 1), ("below", -3, 500, None, 2), ("below", -1, None, "timeout", 1),
    ("no_number", None, 200, None, 1), ("no_number_and_one", None, 200, None, 1), ("no_number_and_one", 1, 500, None, 2),
    ("no_number_and_many", None, 404, None, 1), ("no_number_and_many", 7, None, "timeout", 5), ("no_number_and_many", 9, 500, None, 4),
    ("open", 1, 500, None, 1), ("open", 2, None, "timeout", 2), ("gap", 1, 500, None, 1), ("gap", 3, 503, None, 2),
    # Two final records of one attempt: the earlier counts, whichever comes first.
    ("twice", 1, 404, None, 9), ("twice", 1, 200, None, 4), ("twice", 1, 403, None, 8),
    ("redirects", 1, 301, "too_many_redirects", 1), ("odd_error", 2, None, "request_error", 3),
]


def all_of(table):
    return sorted(map(tuple, table.select("url", "attempt", "status_code", "fetch_status", "fetch_error").collect()), key=repr)


def test_attempts_of_any_number_with_a_flush_equal_batch(spark, rows, tmp_path):
    want = all_of(crawl_log.attempt_resolve(attempts(rows, *ODD)))
    assert len({r[0] for r in want}) == len(want)
    feed = Feed(spark, tmp_path, ATTEMPTS, lambda s: jobs.stream_attempt_resolve(s, "1 day"))
    feed.put(attempts(rows, *ODD))
    settled = feed.run()
    left = jobs.flush_attempts(spark, f"{feed.base}/checkpoint")
    assert {r.url for r in left.collect()} == {
        "only_zero", "below", "no_number", "no_number_and_one", "no_number_and_many", "open", "gap", "odd_error", "slow"
    } - {"slow"}
    assert all_of(settled.unionByName(left)) == want
    # The flush only reads: the stream goes on, and what it settles is open no more.
    feed.put(attempts(rows, ("open", 3, 200, None, 5), ("no_number", 1, 404, None, 6)))
    got = {r.url: r.fetch_status for r in feed.run().collect()}
    assert (got["open"], got["no_number"]) == ("OK", "FAILED")
    assert not {r.url for r in jobs.flush_attempts(spark, f"{feed.base}/checkpoint").collect()} & {"open", "no_number"}


def test_state_of_an_open_url_is_bounded(spark, rows, tmp_path):
    many = [("u", n, 500, None, n % 50) for n in (*range(-40, 1), *range(4, 200))] + [("u", None, 200, None, 3)]
    feed = Feed(spark, tmp_path, ATTEMPTS, lambda s: jobs.stream_attempt_resolve(s, "1 day"))
    feed.put(attempts(rows, *many[:100]))
    feed.run()
    feed.put(attempts(rows, *many[100:]))
    feed.run()
    assert jobs.open_attempts(spark, f"{feed.base}/checkpoint").count() == 2
    left = jobs.flush_attempts(spark, f"{feed.base}/checkpoint")
    assert all_of(left) == all_of(crawl_log.attempt_resolve(attempts(rows, *many)))


def test_progress_is_live_and_counts_late_rows(spark, rows, tmp_path):
    schema = "status string, ts timestamp"
    values = [(("OK", "FAILED")[i % 2], T0 + timedelta(minutes=7 * i)) for i in range(40)]
    base = str(tmp_path)
    feed = Feed(spark, tmp_path, schema, None)

    def run():
        stream = jobs.read_files(spark, f"{base}/in/*", schema)
        jobs.follow_progress(jobs.stream_progress(stream, delay="1 day"), f"{base}/progress", f"{base}/marks", 120)
        return sorted(map(tuple, jobs.read_progress(spark, f"{base}/progress").collect()))

    def batch(some):
        return sorted(map(tuple, jobs.stream_progress(rows(schema, *some)).collect()))

    feed.put(rows(schema, *values[::2]))
    # Open windows are there at once.
    assert run() == batch(values[::2])
    # The other half is late, but within the delay.
    feed.put(rows(schema, *values[1::2]))
    assert run() == batch(values)
    # A batch that runs again replaces what it wrote.
    import shutil

    last = max(int(p.name.removesuffix(".crc").split(".")[-1]) for p in (tmp_path / "marks" / "commits").iterdir() if "crc" not in p.name)
    shutil.rmtree(tmp_path / "marks" / "commits")
    assert last >= 1 and run() == batch(values)


def test_progress_equals_batch_on_closed_windows(spark, rows, tmp_path):
    schema = "status string, ts timestamp"
    values = [(("OK", "FAILED")[i % 2], T0 + timedelta(minutes=7 * i)) for i in range(40)]
    table = rows(schema, *values)
    feed = Feed(spark, tmp_path, schema, jobs.stream_progress)
    feed.put(table.where(F.col("ts") < T0 + timedelta(hours=2)))
    feed.run()
    feed.put(table.where(F.col("ts") >= T0 + timedelta(hours=2)))
    got = feed.run()
    closed = got.agg(F.max("start")).first()[0]
    want = jobs.stream_progress(table).where(F.col("start") <= F.lit(closed))
    assert got.count() > 0 and got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_a_new_url_takes_three_calls_of_the_state():
    calls = []

    class Store:
        def __getattr__(self, name):
            return lambda *a: calls.append(name) or (self if name.startswith("get") and a else None)

    judge = resolver(3, 60, 60)
    judge.init(Store())
    calls.clear()
    seen = lambda n, outcome, final: Row(attempt=n, outcome=outcome, terminal=final, error=None, status_code=200, ts=T0)
    assert [r.outcome for r in judge.handleInputRows(("u",), iter([seen(1, "server_error", False), seen(2, "ok", True)]), None)] == ["ok"]
    assert calls == ["get", "update", "registerTimer"]
    calls.clear()
    assert list(judge.handleInputRows(("v",), iter([seen(1, "server_error", False), seen(2, "timeout", False)]), None)) == []
    assert calls == ["get", "update", "registerTimer"]


@pytest.mark.parametrize("buckets", [None, 1, 5])
def test_buckets_settle_and_flush_like_urls(spark, rows, tmp_path, buckets):
    want = all_of(crawl_log.attempt_resolve(attempts(rows, *ODD)))
    feed = Feed(spark, tmp_path, ATTEMPTS, lambda s: jobs.stream_attempt_resolve(s, "1 minute", timeout_s=600, keep_s=60, buckets=buckets))
    feed.put(attempts(rows, *ODD))
    settled = feed.run()
    assert all_of(settled.unionByName(jobs.flush_attempts(spark, f"{feed.base}/checkpoint"))) == want
    # Time ends the open URLs, those with more news later; settled ones are forgotten and may come again.
    feed.put(attempts(rows, ("later", 1, 200, None, 100), ("open", 2, None, "timeout", 95)))
    feed.run()
    feed.put(attempts(rows, ("latest", 1, 200, None, 101)))
    got = all_of(feed.run().where("url not like 'late%'"))
    assert got == [r for r in want if r[0] != "open"]
    feed.put(attempts(rows, ("ok", 1, 404, None, 102)))
    assert [r[3] for r in all_of(feed.run()) if r[0] == "ok"] == ["FAILED", "OK"]
    assert {r[0] for r in all_of(jobs.flush_attempts(spark, f"{feed.base}/checkpoint"))} == {"open"}


def test_a_bucket_takes_three_calls_of_the_state_for_all_its_urls():
    calls = []

    class Store:
        def __getattr__(self, name):
            return lambda *a: calls.append(name) or (self if name.startswith("get") and a else None)

    judge = resolver(3, 60, 60, in_buckets=True)
    judge.init(Store())
    calls.clear()
    said = lambda url, final: Row(ts=T0, said=json.dumps({"url": url, "attempt": 1, "outcome": "ok" if final else "timeout", "terminal": final}))
    got = list(judge.handleInputRows((0,), iter([said(f"u{i}", i % 2 == 0) for i in range(100)]), None))
    assert [r.url for r in got] == [f"u{i}" for i in range(0, 100, 2)]
    assert calls == ["get", "update", "registerTimer"]
