import fnmatch
import json
import random

import pytest
from pyspark.sql import functions as F

from sitescan.operators import discovery


def patterns_of(rows, *queries):
    table = rows("query_id int, query string", *enumerate(queries))
    out = discovery.query_patterns(table).orderBy("query_id", "pattern_rank").collect()
    found = [[] for _ in queries]
    for r in out:
        assert r.pattern_rank == len(found[r.query_id]) + 1
        found[r.query_id].append(r.pattern)
    return found


def test_patterns(rows):
    got = patterns_of(rows, "personal finance blog", "Travel", "blog", "a an", "", "news NEWS", "one two")
    assert got[0] == [
        "*personal*finance*blog*", "*.personalfinance.*", "*personalfinance*",
        "*.financeblog.*", "*financeblog*", "*personal*blog*",
    ]
    assert got[1] == ["*travel*", "*travel*blog*"]
    assert got[2] == ["*blog*"]
    assert got[3] == got[4] == got[6] == []
    assert got[5] == ["*news*news*", "*.newsnews.*", "*newsnews*"]


@pytest.mark.parametrize("seed", [1, 2])
def test_match_equals_glob(rows, seed, tmp_path):
    """The lookup by pieces finds what testing every pattern on every URL finds."""
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choice("ab%_.c\\") for _ in range(n))
    urls = sorted({text(rng.randint(0, 14)) for _ in range(150)})
    globs = sorted({rng.choice(["*", ""]) + "*".join(text(rng.randint(0, 6)) for _ in range(3)) + "*" for _ in range(60)})
    globs += ["*", "**", "*a*"]
    table, wanted = rows("url string", *urls), rows("pattern string", *globs)
    want = sorted(
        (g, u) for g in globs for u in urls if fnmatch.fnmatchcase(u, g.replace("[", "[[]").replace("?", "[?]"))
    )
    discovery.write_piece_index(table, str(tmp_path))
    for out in (discovery.match_patterns(table, wanted), discovery.match_patterns(table, wanted, str(tmp_path))):
        assert sorted((r.pattern, r.url) for r in out.collect()) == want


def test_repeated_urls_are_matched_each(rows):
    table = rows("i int, url string", (1, "https://travel.org"), (2, "https://travel.org"), (3, "https://other.org"))
    out = discovery.match_patterns(table, rows("pattern string", "*travel*", "*travel*")).collect()
    assert sorted(r.i for r in out) == [1, 2]


def test_the_rarest_piece_is_chosen(rows):
    urls = rows("url string", *[f"https://site{i}.example.com/blog/{'zebra' if i == 7 else 'page'}" for i in range(50)])
    patterns = rows("pattern string", "https://*.example.com/blog/zebra", "*blog*", "*nowhere*blog*")
    counts = discovery.url_pieces(urls).groupBy("piece").agg(F.count("*").alias("n"))
    got = {r.pattern: r.piece for r in discovery.chosen_pieces(patterns, counts).collect()}
    # Pieces that all URLs share, as http and .com, are never looked up where there is another; a pattern with an unknown one not at all.
    assert set(got) == {"https://*.example.com/blog/zebra", "*blog*"} and "z" in got["https://*.example.com/blog/zebra"]


def test_only_pieces_and_ids_are_exploded(rows, spark, tmp_path):
    urls = rows("url string, wide string", ("https://travel.org", "x"))
    discovery.write_piece_index(urls, str(tmp_path))
    out = discovery.match_patterns(urls, rows("pattern string", "*travel*"), str(tmp_path))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    # One explosion, that of short patterns' pieces; the others come from the index.
    assert plan.count("Generate explode") == 2 and "wide" not in discovery.url_pieces(urls)._jdf.queryExecution().optimizedPlan().toString().split("LogicalRDD")[0]
    assert out.first().wide == "x"


def test_match_plan_has_no_nested_loop(rows):
    out = discovery.match_patterns(rows("url string", "abcdef"), rows("pattern string", "*bcde*"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_first_hit_takes_the_newest_index_and_stops(rows):
    scan = rows(
        "query_id int, pattern_rank int, pattern string, crawl_index string, index_rank int, url_rank int, url string",
        *[(1, 1, "p", "new", 0, i, f"a{i}") for i in (1, 2, 3)],
        (1, 1, "p", "old", 1, 1, "zz"),
        (1, 2, "q", "old", 1, 1, "b1"),
        (1, 3, "r", "new", 0, 1, "c1"),
        (2, 2, "q", "old", 1, 1, "d1"),
    )
    top = lambda n: [tuple(r) for r in discovery.index_first_hit(scan, n).orderBy("query_id", "rank").collect()]
    assert top(10) == [(1, 1, "a1"), (1, 2, "a2"), (1, 3, "a3"), (1, 4, "b1"), (1, 5, "c1"), (2, 1, "d1")]
    assert top(4) == [(1, 1, "a1"), (1, 2, "a2"), (1, 3, "a3"), (1, 4, "b1"), (2, 1, "d1")]
    # with n = 1, two URLs are enough: the second pattern is not asked
    assert top(1) == [(1, 1, "a1"), (2, 1, "d1")]


def page(*links, field="organic_results"):
    return json.dumps({field: [{"link": x} if x is not None else {} for x in links]})


def test_search_results(rows):
    archive = rows(
        "query_id int, page int, json string",
        (1, 0, page("a", "", None, "b")), (1, 1, page("c", "d")), (1, 9, page("z")),
        (2, 0, page("e")), (2, 1, "{broken"), (2, 2, page("f")),
        (3, 0, "{}"), (3, 1, page("g")),
    )
    out = discovery.search_results_explode(archive, 20).orderBy("query_id", "rank").collect()
    assert [tuple(r) for r in out] == [
        (1, 1, "a"), (1, 2, "b"), (1, 3, "c"), (1, 4, "d"), (1, 5, "z"), (2, 1, "e"), (3, 1, "g"),
    ]
    # Links of later pages fill up what earlier ones lack.
    assert discovery.search_results_explode(archive, 3).where("query_id = 1").count() == 3


def test_all_archived_pages_and_ranks_count(rows):
    short = [(1, p, page(f"https://s{p}.a/", None, f"https://t{p}.a/")) for p in range(15)]
    archive = rows("query_id int, page int, json string", *short)
    out = discovery.search_results_explode(archive, 30).orderBy("rank").collect()
    assert [r.url for r in out] == [f"https://{x}{p}.a/" for p in range(15) for x in "st"]
    items = rows("query_id int, page int, json string", *[(q, p, j.replace("organic_results", "items")) for q, p, j in short])
    for provider, table in (("serpapi", archive), ("cse", items)):
        assert discovery.discover(table, 28, provider).count() == 28
    noisy = [(1, i, "https://x.com/%d" % i) for i in range(1, 200)] + [(1, 200 + i, f"https://u{i}.b/") for i in range(5)]
    links = rows("query_id int, rank int, href string", *noisy)
    assert [r.url for r in discovery.discover(links, 5, "ddg").orderBy("rank").collect()] == [f"https://u{i}.b" for i in range(5)]


def test_discover_providers(rows):
    archive = rows("query_id int, page int, json string", (1, 0, page("https://a.b/1", "https://a.b/2", "https://c.d/", "x", field="items")))
    for name in ("cse", " Google_CSE "):
        out = discovery.discover(archive, 5, name).orderBy("rank").collect()
        assert [(r.rank, r.url) for r in out] == [(1, "https://a.b"), (2, "https://c.d")]
    links = rows("query_id int, rank int, href string", (1, 1, "https://x.com/1"), (1, 2, "https://a.b/"), (1, 3, ""), (1, 4, None))
    assert [r.url for r in discovery.discover(links, 5, "ddg").collect()] == ["https://a.b"]
    with pytest.raises(ValueError):
        discovery.discover(links, 5, "nobody")
    with pytest.raises(ValueError):
        discovery.discover(links, 5, "cc")


@pytest.mark.parametrize("n", [3, 1500])
def test_top_per_key_for_small_and_large_n(spark, n):
    table = spark.range(9000).select((F.col("id") % 3 % 2).alias("k"), (F.col("id") * 7919 % 9000).alias("v"))
    out = discovery.top_per_key(table, ["k"], ["v"], n)
    got = out.groupBy("k").agg(F.count("*").alias("n"), F.max("rank").alias("r"), F.sum("v").alias("s")).orderBy("k").collect()
    for k, row in enumerate(got):
        values = sorted(i * 7919 % 9000 for i in range(9000) if i % 3 % 2 == k)[:n]
        assert (row.n, row.r, row.s) == (n, n, sum(values))
