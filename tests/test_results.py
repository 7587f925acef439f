from datetime import datetime

import pytest
from pyspark.sql import functions as F

from sitescan import lookups as L
from sitescan.operators import results, urls
from sitescan.plans import profile
from sitescan.sources import tables

FIELDS = [name for name, _ in L.RESULT_COLUMNS]


def facts(rows, *values):
    return rows("url string, fetch_status string, fetch_error string, author string, emails array<string>, cms string", *values)


def classified(rows, *values):
    return rows(
        "url string, niche string, site_type string, language string, author string,"
        " confidence struct<niche:int,site_type:int,language:int,author:int>, ai_error string", *values,
    )


def test_merge(rows):
    pages = facts(
        rows, ("a", "OK", None, "Page Author", ["x@y.zz", "b@y.zz"], "Wix"), ("b", "OK", None, "Page Author", [], None),
        ("c", "OK", None, "Page Author", [], None), ("d", "OK", None, None, [], None), ("e", "OK", "", "P", [], None),
    )
    answers = classified(
        rows, ("a", "N", "Blog", "English (en)", "Class Author", (0, 60, 70, 10), None), ("b", None, "News", None, "", (5, 0, 0, 49), None),
        ("c", None, "News", None, None, (5, 0, 0, 50), None), ("e", None, "Unknown", None, None, (0, 0, 0, 0), "broken"),
    )
    out = {r.url: r for r in results.result_merge(pages, answers).collect()}
    assert (out["a"].author, out["a"].email, out["a"].confidence_niche, out["a"].confidence_type) == ("Class Author", "x@y.zz", None, 60)
    assert out["b"].author == "Page Author" and out["b"].email is None and out["b"].confidence_author == 49
    assert out["c"].author is None  # sure that there is none
    assert (out["d"].status, out["d"].error) == ("AI_ERROR", results.NO_CLASSIFICATION)
    assert (out["e"].status, out["e"].error, out["e"].author) == ("AI_ERROR", "broken", "P")


def test_format(rows):
    table = rows(
        results.RESULT_SCHEMA,
        ("u", None, None, None, None, None, None, None, None, None, None, "FAILED", None),
        ("v", "n", "Blog", "l", "a", "e", True, 1, 2, 3, "c", "OK", "x"),
        ("w", "n", "Blog", "l", "a", "e", False, 1, 2, 3, "c", "OK", "x"),
    )
    out = results.result_format(table).orderBy("URL")
    assert out.columns == [heading for _, heading in L.RESULT_COLUMNS]
    got = [tuple(r) for r in out.collect()]
    assert got[0] == ("u",) + ("",) * 10 + ("FAILED", "")
    assert got[1] == ("v", "n", "Blog", "l", "a", "e", "True", "1", "2", "3", "c", "OK", "x")
    assert got[2][6] == "False"


def test_summary(rows):
    table = rows("status string", "OK", "AI_ERROR", "FAILED", "TIMEOUT", "BLOCKED")
    assert results.run_summary(table, 1.5).first() == (5, 2, 3, 1.5)
    assert results.run_summary(table.limit(0)).first() == (0, 0, 0)


def test_sinks(spark, rows, tmp_path):
    table = rows(results.RESULT_SCHEMA, ("u", 'a "b", c\nd', None, None, None, None, None, None, None, None, None, "OK", None))
    place = str(tmp_path / "csv")
    shown = results.result_format(table)
    tables.csv_sink(shown.limit(0), place)
    assert not (tmp_path / "csv").exists()
    tables.csv_sink(shown, place)
    tables.csv_sink(shown, place)
    back = spark.read.csv(place, header=True, multiLine=True, escape='"').collect()
    assert [r["Niche/Topic"] for r in back] == ['a "b", c\nd'] * 2
    tables.json_archive(table, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).columns == sorted(FIELDS)


def runs_in(spark, place, *names):
    return sorted((r.run_id, r.url) for r in tables.read_runs(spark, place, *names).collect())


def test_runs(spark, rows, tmp_path):
    place = str(tmp_path / "runs")
    table = rows("url string, status string", ("a", "OK"), ("b", "OK"))
    assert [tables.write_run(table, place, name) for name in ("one", "two", "007", "a/b=c d")] == [2] * 4
    assert tables.write_run(table.where("url = 'a'"), place, "two") == 1
    assert runs_in(spark, place) == sorted([(n, u) for n in ("one", "007", "a/b=c d") for u in "ab"] + [("two", "a")])
    assert runs_in(spark, place, "007", "two") == [("007", "a"), ("007", "b"), ("two", "a")]
    assert tables.read_runs(spark, place).columns == ["url", "status", "run_id"]
    with pytest.raises(FileNotFoundError):
        tables.read_runs(spark, place, "none")
    assert tables.run_stamp(at=datetime(2026, 4, 10, 14, 30, 22)) == "results_2026-04-10_143022"


def test_a_failed_rewrite_leaves_the_old_rows(spark, rows, tmp_path):
    place = str(tmp_path / "runs")
    table = rows("url string", "a", "b")
    tables.write_run(table, place, "one")
    broken = table.withColumn("url", F.when(F.col("url") == "b", F.raise_error(F.lit("stopped"))).otherwise(F.col("url")))
    with pytest.raises(Exception, match="stopped"):
        tables.write_run(broken, place, "one")
    assert runs_in(spark, place) == [("one", "a"), ("one", "b")]
    # Rows that were written but never committed count as little: a first write that fails makes no run.
    with pytest.raises(Exception, match="stopped"):
        tables.write_run(broken, place, "never")
    table.write.parquet(f"{place}/rows/run_id=torn/version=1")
    assert runs_in(spark, place) == [("one", "a"), ("one", "b")]
    tables.write_run(table.where("url = 'a'"), place, "one")
    assert tables.clean_runs(spark, place) >= 2
    assert runs_in(spark, place) == [("one", "a")] and tables.clean_runs(spark, place) == 0
    # New columns of a later run are null in the others.
    tables.write_run(table.withColumn("extra", F.lit(1)), place, "two")
    assert sorted((r.url, r.extra) for r in tables.read_runs(spark, place).collect() if r.run_id == "one") == [("a", None)]


def counted(spark, table):
    """The table, and an accumulator of the rows that have been read from it."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    return table.mapInPandas(count, table.schema), seen


def test_sinks_and_audits_run_their_input_once(spark, rows, tmp_path):
    table, seen = counted(spark, rows("pos bigint, raw string", *[(i, t) for i, t in enumerate(["a.com", "a.com", "nan", None, "b.com", "junk"])]))
    assert tables.csv_sink(table, str(tmp_path / "csv")) == 6 and seen.value == 6
    assert tables.write_run(table, str(tmp_path / "runs"), "r") == 6 and seen.value == 12
    loaded, counts = urls.url_load(table)
    assert sorted(loaded.collect()) == [("https://a.com", 0), ("https://b.com", 4)] and seen.value == 18
    assert counts.get() == {"unique_urls": 2, "invalid": 3, "duplicates": 1} and seen.value == 18
    assert tuple(counts.get().values()) == tuple(urls.url_load_audit(table).first())
    empty, counts = urls.url_load(table.limit(0))
    assert empty.collect() == [] and counts.get() == {"unique_urls": 0, "invalid": 0, "duplicates": 0}


def crawl(rows):
    return rows(
        "url string, html string, fetch_status string, fetch_error string",
        ("https://a.org", '<title>A shop</title><body>write to info@a.org in our shop</body>', "OK", None),
        ("https://b.org", "<title>half</title>", "TIMEOUT", "Request timed out"),
        ("https://c.org", None, "OK", None),
    )


@pytest.mark.parametrize("accepted", [True, False])
def test_profile(rows, accepted):
    urls = rows("pos bigint, raw string", *enumerate(["a.org", "https://b.org", "c.org", "d.org", "a.org", "junk"]))
    mx = rows("domain string, mx_count int", ("a.org", 1))
    probes = rows("email string, code int", ("info@a.org", 250 if accepted else 550))
    out = profile.profile_sites(crawl(rows), urls, mx, probes=probes)
    assert out.columns == FIELDS
    got = {r.url: r for r in out.collect()}
    # one row per wanted URL
    assert sorted(got) == [f"https://{x}.org" for x in "abcd"] and out.count() == 4
    a = got["https://a.org"]
    assert (a.site_type, a.email, a.email_valid, a.status) == ("E-commerce", "info@a.org", accepted, "OK")
    b = got["https://b.org"]
    assert (b.status, b.error, b.site_type, b.email_valid) == ("TIMEOUT", "Request timed out", None, None)
    assert (got["https://c.org"].status, got["https://c.org"].site_type) == ("OK", "Unknown")
    assert (got["https://d.org"].status, got["https://d.org"].error) == ("FAILED", profile.NOT_CRAWLED)


def test_copies_of_a_page_give_one_row(rows):
    pages = rows(
        "url string, html string, fetch_status string, fetch_error string",
        *[("https://a.org", None, "FAILED", "HTTP 500")] * 50,
        *[("https://a.org", "<title>our shop</title>", "OK", None)] * 50,
    )
    out = profile.profile_sites(pages, rows("pos bigint, raw string", (0, "a.org"))).collect()
    assert [(r.url, r.status, r.site_type) for r in out] == [("https://a.org", "OK", "E-commerce")]


def test_profile_crawl(rows):
    from datetime import datetime

    log = rows(
        "url string, attempt int, status_code int, error_class string, ts timestamp",
        *[(u, 1, c, e, datetime(2024, 1, 1)) for u, c, e in (
            ("a", 200, None), ("b", 403, None), ("c", 403, None), ("d", None, "timeout"), ("e", 200, None))],
    )
    plain = rows("url string, html string", ("a", "<title>blog</title>"), ("e", "<title>blog</title>"))
    rendered = rows("url string, html string, status_code int", ("a", "<title>our shop</title>", 200), ("b", "<title>news</title>", 404), ("e", "", 200))
    out = {r.url: (r.status, r.site_type, r.error) for r in profile.profile_crawl(log, plain, rendered).collect()}
    assert out == {
        "a": ("OK", "E-commerce", None), "b": ("OK", "News", None), "c": ("FAILED", None, "Renderer not available"),
        "d": ("TIMEOUT", None, "Request timed out"), "e": ("OK", "Blog", None),
    }


def test_pages_are_read_once(rows):
    mx = rows("domain string, mx_count int", ("a.org", 1))
    plan = profile.profile_sites(crawl(rows), None, mx)._jdf.queryExecution().executedPlan().toString()
    # HTML goes through one function, the text it holds through another, that for languages.
    assert plan.count("ArrowEvalPython [run(html") == 1 and plan.count("ArrowEvalPython") == 2


def test_failed_rows(rows):
    table = rows("url string, fetch_status string, fetch_error string", ("a", "TIMEOUT", "t"), ("b", "FAILED", None))
    assert sorted(results.failed_rows(table).collect()) == [("a", "TIMEOUT", "t"), ("b", "FAILED", None)]
    merged = rows(results.RESULT_SCHEMA, ("u", "n", None, None, None, None, None, 1, None, None, None, "OK", None))
    both = results.with_failed(merged, table)
    assert both.columns == FIELDS and both.count() == 3
