import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sitescan.functions import urls as U
from sitescan.operators import urls
from sitescan.sources import tables


def test_normalize(evaluate):
    cases = {
        "example.com": "https://example.com",
        "http://example.com": "http://example.com",
        " \t https://a.org/x \n": "https://a.org/x",
        "not a url": None,
        "HTTP://x.com": None,  # becomes https://HTTP://x.com, whose authority has no dot
        "ftp://a.com": None,
        "hello world. foo": "https://hello world. foo",
        "u@h.co": "https://u@h.co",
        "https://[::1/a.b": None,
        "https:///a.b": None,
        "localhost/a.b": None,
        "NaN": None, "none": None, "NULL": None, "": None, "  ": None, None: None,
    }
    assert evaluate(U.normalize_url, *cases) == list(cases.values())


def test_strict_host(evaluate):
    strict = lambda c: U.normalize_url(c, strict_host=True)
    assert evaluate(strict, "hello world. foo", "u@h.co", "a.com:80/x", "a.com") == [
        None, None, "https://a.com:80/x", "https://a.com",
    ]


def test_origin_and_host(evaluate):
    assert evaluate(U.url_origin, "HTTP://A.com/x", "//h/p", "foo/bar", "https://a.b?q#f", "mailto:x@y") == [
        "http://A.com", "://h", "://", "https://a.b", "mailto://",
    ]
    assert evaluate(U.host_key, "https://u:p@A.com:8/x", "http://[::1]:8/", "https:///x") == [
        "a.com", "::1", "https:///x",
    ]


def test_noise(evaluate):
    links = ["https://netflix.com/", "https://x.com/a", "https://m.x.com", "https://a.org/?r=youtube.com"]
    assert evaluate(U.is_noise, *links) == [True, True, True, True]
    assert evaluate(lambda c: U.is_noise(c, "host_suffix"), *links) == [False, True, True, False]
    with pytest.raises(ValueError):
        U.is_noise(F.lit("x"), "nearly")


def test_dedupe_is_exact_and_keeps_the_first(rows):
    raw = rows("pos bigint, raw string", (0, "b.com"), (1, "a.com/"), (2, "a.com"), (3, "https://b.com"), (4, "B.com"))
    out = urls.url_dedupe(urls.url_normalize(raw)).orderBy("pos").collect()
    assert [(r.pos, r.url) for r in out] == [
        (0, "https://b.com"), (1, "https://a.com/"), (2, "https://a.com"), (4, "https://B.com"),
    ]


def test_audit(rows):
    raw = rows("pos bigint, raw string", (0, "a.com"), (1, "a.com"), (2, "nan"), (3, None), (4, "b.com"))
    assert urls.url_load_audit(raw).first() == (2, 2, 1)
    assert urls.url_load_audit(raw.limit(0)).first() == (0, 0, 0)


def test_merge(rows):
    known = rows("url string, pos bigint", ("a", 0), ("b", 7))
    found = rows("url string, pos bigint", ("b", 0), ("c", 1), ("c", 2), ("d", 3))
    assert sorted(urls.url_merge(known, found).collect()) == [("a", 0), ("b", 7), ("c", 9), ("d", 11)]
    assert sorted(urls.url_merge(known.limit(0), found).collect()) == [("b", 0), ("c", 1), ("d", 3)]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ahtps:/. ?#[]@\t ", max_size=14), min_size=1, max_size=40))
def test_normalize_is_idempotent(evaluate, texts):
    once = evaluate(U.normalize_url, *texts)
    # a NULL stays a NULL, a URL stays itself
    assert evaluate(U.normalize_url, *once) == once


@pytest.mark.parametrize(
    "columns, chosen",
    [
        (["name", "URL", "url"], "url"),
        (["Name", "Website"], "Website"),
        (["a", "LINK"], "LINK"),
        (["a", "b"], "a"),
        (["LINKS", "DoMaIn"], "DoMaIn"),
    ],
)
def test_url_column(columns, chosen):
    assert tables.url_column(columns) == chosen


def _file(tmp_path, text):
    path = tmp_path / "in.csv"
    path.write_text(text)
    return str(path)


def test_scan(spark, tmp_path):
    path = _file(tmp_path, 'notes;Website\n"x;y";a.com\n1;b.com\n')
    out = tables.url_scan(spark, path, keep_columns=True).orderBy("pos").collect()
    assert [(r.raw, r.notes) for r in out] == [("a.com", "x;y"), ("b.com", "1")]
    path = _file(tmp_path, "url\na.com\n007\n")
    assert [r.raw for r in tables.url_scan(spark, path).orderBy("pos").collect()] == ["a.com", "007"]


def test_scan_of_files_with_headers_of_their_own(spark, tmp_path):
    folder = tmp_path / "lists with blanks"
    folder.mkdir()
    (folder / "a.csv").write_text('url,notes\na.com,"two\nlines, one ""cell"""\nb.com,x\n')
    (folder / "b.csv").write_text("notes;Website\ny;c.com\nz;d.com;more\nonly\n")
    (folder / "c.csv").write_text("\n\ufeffname\tURL\tname\nn\te.com\tm\n")
    (folder / "d.csv").write_text("url,notes\nf.com,w\n")
    got = tables.url_scan(spark, str(folder), keep_columns=True, ragged="odd").collect()
    assert {(r.raw, r.notes, r.name) for r in got} == {
        ("a.com", 'two\nlines, one "cell"', None), ("b.com", "x", None), ("c.com", "y", None), ("d.com", "z", None), (None, "only", None),
        ("e.com", None, "n"), ("f.com", "w", None),
    }
    assert {r.odd for r in got} == {None, "z;d.com;more", "only"}
    assert len({r.pos for r in got}) == len(got) == 7
    order = [r.raw for r in sorted(got, key=lambda r: r.pos) if r.raw in ("a.com", "b.com")]
    assert order == ["a.com", "b.com"]
    headers = {r.file.rsplit("/")[-1]: (r.header, r.split) for r in tables.csv_headers(spark, str(folder)).collect()}
    assert headers["a.csv"] == ("url,notes", True) and headers["d.csv"] == ("url,notes", False)


def test_large_files_without_broken_cells_are_read_in_pieces(spark, tmp_path):
    path = _file(tmp_path, "url,n\n" + "".join(f"site{i}.org,{i}\n" for i in range(50_000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
    try:
        scan = tables.url_scan(spark, path, keep_columns=True)
        assert scan.rdd.getNumPartitions() > 4
        assert scan.agg({"raw": "count"}).first()[0] == 50_000 == scan.select("raw").distinct().count()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_scan_warns_when_no_column_has_a_known_name(spark, tmp_path):
    with pytest.warns(UserWarning, match="the first one is taken"):
        assert [r.raw for r in tables.url_scan(spark, _file(tmp_path, "who,what\na.com,b\n")).collect()] == ["a.com"]


def test_scan_errors(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        tables.url_scan(spark, str(tmp_path / "none.csv"))
    for text in ("", "url\n", "\n\n", "url\nnan\nnone\n"):
        with pytest.raises(ValueError):
            tables.url_scan(spark, _file(tmp_path, text))


def test_resolve_link(spark, rows):
    page = "https://a.org/x/y.html?q=1"
    links = {
        "/p": "https://a.org/p", "p": "https://a.org/x/p", "?z": "https://a.org/x/y.html?z",
        "//b.org/q": "https://b.org/q", "HTTP://c.org": "HTTP://c.org", "#top": None,
        "mailto:x@y.z": None, "javascript:void(0)": None, " ": None,
    }
    out = rows("h string", *links).select(U.resolve_link(F.col("h"), F.lit(page))).collect()
    assert [r[0] for r in out] == list(links.values())
