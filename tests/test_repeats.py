"""Repeated URLs and attempts, and runs without rows."""

import pytest

from sitescan.operators.pages import page_facts
from sitescan.operators import classify, crawl_log
from sitescan.plans.profile import profile_sites
from sitescan.sources.tables import read_runs, write_run


def test_a_url_requested_three_times_gets_one_answer(rows):
    requests = rows("batch_id bigint, url string", *[(0, "a")] * 3, (0, "b"), (1, "a"))
    replies = rows("batch_id bigint, reply string", (0, '[{"url": "a", "niche": "x"}, {"url": "b"}]'))
    got = classify.read_replies(requests, replies).orderBy("url").collect()
    assert [(r["url"], r["niche"]) for r in got] == [("a", "x"), ("b", None)]
    assert [r["ai_error"] is None for r in got] == [True, True]


def test_a_payload_holds_each_url_once(rows):
    schema = "batch_id bigint, url string, title string, description string, body_text string, cms string, detected_language_hint string, rule_based_author_hint string"
    contexts = rows(schema, *[(0, "a", str(i), "", "", None, None, None) for i in range(50)])
    payload = classify.request_payload(contexts).first()["payload"]
    assert payload.count('"url"') == 1 and '"title":"0"' in payload


def test_copies_of_a_page_give_one_row(rows):
    pages = rows("url string, html string", ("u", "<title>x</title>"), ("u", "<title>x</title>"), ("v", ""))
    assert sorted(r["url"] for r in profile_sites(pages).select("url").collect()) == ["u", "v"]


def test_every_logged_url_is_resolved_and_every_attempt_kept(spark):
    from checks.views import spark_view

    log = spark_view(spark, "/root/testdata/sf0.001", "attempts")
    late = log.withColumn("attempt", log["attempt"] + 5)
    assert crawl_log.attempt_resolve(late).count() == log.select("url").distinct().count()
    twice = log.unionByName(log).unionByName(late)
    assert crawl_log.retry_backoff(twice).count() == twice.count()


def test_an_empty_run_replaces_the_old_one(spark, rows, tmp_path):
    some = rows("url string", "a", "b")
    write_run(some, str(tmp_path), "r_1")
    write_run(some, str(tmp_path), "r_2")
    write_run(some.where("false"), str(tmp_path), "r_1")
    got = read_runs(spark, str(tmp_path))
    assert {(r["url"], r["run_id"]) for r in got.collect()} == {("a", "r_2"), ("b", "r_2")}


@pytest.mark.parametrize("kind", ["fetch", "classifier"])
def test_waits_add_up(spark, kind):
    from checks.views import spark_view

    log = spark_view(spark, "/root/testdata/sf0.001", "attempts")
    got = crawl_log.retry_backoff(log, kind=kind).collect()
    by_url = {}
    for r in sorted(got, key=lambda r: (r["url"], r["attempt"])):
        by_url[r["url"]] = by_url.get(r["url"], 0) + r["wait_s"]
        assert r["total_wait_s"] == by_url[r["url"]]


def test_words_late_in_a_long_page_count(spark):
    html = f"<html><body><article>{'plain text of the page ' * 200}<p>casino poker betting</p></article></body></html>"
    pages = spark.createDataFrame([("http://a.com", html)], "url string, html string")
    row = classify.classify_sites(page_facts(pages)).first()
    assert row["niche"] == "Online Gambling" and len(row["body_text"]) == 3000
