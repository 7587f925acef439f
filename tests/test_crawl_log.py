import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sitescan.operators import crawl_log
from sitescan.operators.ordered import with_row_index

T0 = datetime(2024, 1, 1)
SCHEMA = "url string, attempt int, status_code int, error_class string, ts timestamp"


def attempt(url, n, code=None, error=None):
    return (url, n, code, error, T0 + timedelta(minutes=n))


def resolve(rows, *attempts, **options):
    out = crawl_log.attempt_resolve(rows(SCHEMA, *attempts), **options).collect()
    return {r.url: (r.fetch_status, r.fetch_error, r.attempt, r.status_code) for r in out}


def test_outcomes(rows):
    table = rows(
        SCHEMA, *[attempt("u", i, code) for i, code in enumerate((200, 301, 403, 429, 404, 500, 599, None))],
        attempt("u", 8, None, "timeout"), attempt("u", 9, None, "too_many_redirects"), attempt("u", 10, None, "reset"),
    )
    out = crawl_log.attempt_outcome(table).orderBy("attempt").collect()
    assert [(r.outcome, r.terminal, r.error) for r in out] == [
        ("ok", True, None), ("ok", True, None), ("blocked", True, "HTTP 403"), ("blocked", True, "HTTP 429"),
        ("client_error", True, "HTTP 404"), ("server_error", False, "HTTP 500"), ("server_error", False, "HTTP 599"),
        ("ok", True, None), ("timeout", False, "Request timed out"), ("redirects", True, "Too many redirects"),
        ("request_error", False, "reset"),
    ]


def test_resolve(rows):
    got = resolve(
        rows,
        attempt("ok2", 1, 500), attempt("ok2", 2, 200), attempt("ok2", 3, 404),
        attempt("last-timeout", 1, 500), attempt("last-timeout", 2, 502), attempt("last-timeout", 3, None, "timeout"),
        attempt("last-error", 1, None, "timeout"), attempt("last-error", 2, None, "timeout"), attempt("last-error", 3, 503),
        attempt("late", 1, 500), attempt("late", 2, 500), attempt("late", 3, 500), attempt("late", 4, 200),
        attempt("blank", 3, None, ""), attempt("said so", 1, None, "read timed out"),
        attempt("loop", 1, None, "too_many_redirects"), attempt("blocked", 1, 429),
    )
    assert got == {
        "ok2": ("OK", None, 2, 200),
        "last-timeout": ("TIMEOUT", "Request timed out", 3, None),
        "last-error": ("FAILED", "HTTP 503", 3, None),
        "late": ("FAILED", "HTTP 500", 3, None),
        "blank": ("FAILED", "Unknown error after all retries", 3, None),
        "said so": ("TIMEOUT", "read timed out", 1, None),
        "loop": ("FAILED", "Too many redirects", 1, None),
        "blocked": ("BLOCKED", "HTTP 429", 1, 429),
    }


def test_backoff(rows):
    table = rows(SCHEMA, *[attempt("u", n, 500) for n in (1, 2, 3)], attempt("v", 1, 500), attempt("v", 2, 200))
    waits = lambda kind: [
        (r.url, r.wait_s, r.total_wait_s)
        for r in crawl_log.retry_backoff(table, kind=kind).orderBy("url", "attempt").collect()
    ]
    assert waits("fetch") == [("u", 1, 1), ("u", 2, 3), ("u", 0, 3), ("v", 1, 1), ("v", 0, 1)]
    assert waits("classifier") == [("u", 2, 2), ("u", 4, 6), ("u", 8, 14), ("v", 2, 2), ("v", 0, 2)]
    with pytest.raises(ValueError):
        crawl_log.retry_backoff(table, kind="other")


def test_render(rows):
    rendered = rows(
        "url string, status_code int, error_class string",
        ("a", 200, None), ("b", 404, None), ("c", 500, None), ("d", 403, None), ("e", None, "timeout"), ("f", None, "crash"),
    )
    out = crawl_log.render_outcome(rendered).orderBy("url").collect()
    assert [(r.fetch_status, r.http_error) for r in out] == [
        ("OK", False), ("OK", True), ("OK", True), ("BLOCKED", False), ("TIMEOUT", False), ("FAILED", False),
    ]


def test_fallback(rows):
    schema = "url string, status_code int, fetch_status string, fetch_error string, html_chars int, html string"
    plain = rows(
        schema,
        ("short", 200, "OK", None, 10, "p"), ("long", 200, "OK", None, 50_000, "p"), ("empty", 200, "OK", None, 0, "p"),
        ("blocked", 403, "BLOCKED", "HTTP 403", None, None), ("alone", 403, "BLOCKED", "HTTP 403", None, None),
        ("bad", 200, "OK", None, 49_999, "p"), ("blank", 200, "OK", None, 10, "p"), ("gone", 404, "FAILED", "HTTP 404", None, None),
    )
    rendered = rows(
        schema, *[(u, 200, "OK", None, 5, "r") for u in ("short", "long", "empty", "gone")],
        ("blocked", 403, "BLOCKED", "still", None, None), ("bad", None, "TIMEOUT", "t", None, None), ("blank", 200, "OK", None, 0, "r"),
    )
    out = crawl_log.render_fallback(plain, rendered).collect()
    assert {r.url: (r.source, r.fetch_status, r.html) for r in out} == {
        "short": ("rendered", "OK", "r"), "long": ("plain", "OK", "p"), "empty": ("plain", "OK", "p"),
        "blocked": ("rendered", "BLOCKED", None), "alone": ("none", "FAILED", None),
        "bad": ("plain", "OK", "p"), "blank": ("plain", "OK", "p"), "gone": ("plain", "FAILED", None),
    }


def step_by_step(requests, gap):
    """One host at a time, one request after the other."""
    free, start = {}, {}
    for host, url, arrival, dur in sorted(requests, key=lambda r: (r[0], r[2], r[1], r[3])):
        begin = max(arrival, free.get(host, arrival))
        free[host] = begin + dur + gap
        start[url] = begin
    return start


@pytest.mark.parametrize("chunks", [1, 7])
def test_politeness_with_a_hot_host(rows, chunks):
    rng = random.Random(chunks)
    requests = [
        (rng.choice(["hot"] * 6 + ["a", "b", "c"]), f"u{i:04}", rng.choice([0, rng.randint(0, 10**9)]), rng.randint(0, 3 * 10**6))
        for i in range(600)
    ]
    table = rows("host string, url string, arrival_us bigint, dur_us bigint", *requests)
    out = crawl_log.politeness_plan(table, 2.0, chunks).collect()
    assert {r.url: r.start_us for r in out} == step_by_step(requests, 2_000_000)


def test_politeness_splits_a_hot_host(rows):
    """No task gets a whole host: window keys are host and chunk."""
    requests = [("hot", f"u{i:04}", 0, 1) for i in range(2000)]
    table = rows("host string, url string, arrival_us bigint, dur_us bigint", *requests)
    from sitescan.operators.ordered import ordered_chunks

    sizes = ordered_chunks(table, ["host", "arrival_us", "url"], 8).groupBy("chunk").count().collect()
    assert len(sizes) == 8 and max(r["count"] for r in sizes) < 600


def test_equal_rows_can_be_split_too(rows):
    from sitescan.operators.ordered import ordered_chunks

    table = rows("host string, arrival_us bigint", *[("hot", 0)] * 2000)
    sizes = ordered_chunks(table, ["host", "arrival_us"], 8).groupBy("chunk").count().collect()
    assert max(r["count"] for r in sizes) < 600


def test_row_index(spark):
    table = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v")).repartition(5)
    out = with_row_index(table, ["v"], chunks=6)
    assert out.where(F.col("row_index") != F.col("v")).isEmpty() and out.count() == 1000


def test_split(rows):
    table = rows("url string, fetch_status string", ("a", "OK"), ("b", "FAILED"), ("c", "TIMEOUT"))
    good, failed = crawl_log.fetch_split(table)
    assert [r.url for r in good.collect()] == ["a"] and sorted(r.url for r in failed.collect()) == ["b", "c"]
