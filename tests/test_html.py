import pytest
from pyspark.sql import functions as F

from sitescan.functions import html as H
from sitescan.functions.labels import language_guess
from sitescan.functions.nodes import QUIET_TAGS, read_nodes
from sitescan.operators import pages


def test_tree():
    page = read_nodes("<div><p>a<b>b</div>c<br>d</p>")
    rows = list(zip(page.tag, page.parent, page.last, page.text))
    assert rows == [
        ("div", -1, 4, None), ("p", 0, 4, None), ("#text", 1, 2, "a"), ("b", 1, 4, None),
        ("#text", 3, 4, "b"), ("#text", -1, 5, "c"), ("br", -1, 6, None), ("#text", -1, 7, "d"),
    ]


def test_entities_and_quiet_strings():
    page = read_nodes("a&nbsp;&eacute;&#233;&#x93;&nope;&#xd800;<script>x<b></script><template><i>t</i></template>")
    texts = [(k, t) for k, t in zip(page.kind, page.text) if t]
    assert texts == [
        ("", "a\xa0éé“&nope\N{REPLACEMENT CHARACTER}"), ("script", "x<b>"), ("template", "t"),
    ]


def test_title(on_nodes):
    cases = {
        '<meta property="og:title" content=" A "><title>B</title>': "A",
        '<meta property="og:title" content=""><meta property="og:title" content="A"><title>B</title>': "B",
        '<meta property="og:title" content="  "><title>B</title>': "",
        "<title> B &amp; C </title><h1>H</h1>": "B & C",
        "<title><b>B</b></title>": "B",
        "<title>a<b>B</b></title><h1> H<i>1 </i> 2</h1>": "H12",
        "<!-- <title>X</title> --><title>Y</title>": "Y",
        '<script>"<title>X</title>"</script><h1>H</h1>': "H",
        "<title></title><p>x": None,
        "<title></title><h1></h1>": "",
        "": None, None: None,
    }
    assert on_nodes(H.page_title, *cases) == list(cases.values())


def test_description(on_nodes):
    cases = {
        '<meta name="description" content=" d "><meta property="og:description" content="o">': "o",
        '<meta name="description" content=" d "><meta property="og:description" content="">': "d",
        '<meta name="description"><meta name="description" content="late">': None,
        '<meta content="d" name=description>': "d",
    }
    assert on_nodes(H.page_description, *cases) == list(cases.values())


def test_body(on_nodes):
    cases = {
        "<p>no body</p>": "",
        "<body><main>m</main><article>a</article></body>": "m",
        "<body><article>a</article><main>m</main></body>": "m",
        '<body><div class="entry">e</div><div id="Post-12">p</div></body>': "p",
        '<body>x<div class="big entry">e</div></body>': "e",
        "<body> x <nav>n<p>m</body>": "x",
        "<body><div><nav>abc</div>def</nav>ghi</body>": "def ghi",
        "<body>fo<!-- c -->o\n b  a<b>r</b></body>": "fo o b a r",
        "<body><nav><main>hidden</main></nav><article>a</article></body>": "a",
        "<body><header>h</header><form><form>x</form>y</form>z</body>": "z",
        '<body class="post"><p>all</p></body>': "all",
        "<body>" + "ab " * 2000 + "</body>": ("ab " * 1000)[:3000],
        None: None,
    }
    assert on_nodes(H.page_body, *cases) == list(cases.values())


def test_unclosed_nav_swallows_the_rest(on_nodes):
    assert on_nodes(H.page_body, "<body>a<nav>b<article>c</article></body>") == ["a"]


def test_quick_entities(evaluate):
    cases = {"a&amp;b &amp c&ampd &amp": "a&b & c&ampd &", "&amp;lt;": "&lt;", "&copy;&copy": "©©", "x": "x", None: None}
    assert evaluate(H.decode_entities, *cases) == list(cases.values())


def test_cut_comes_after_entities(on_nodes):
    text = on_nodes(H.page_body, "<body>" + "&amp;" * 4000 + "</body>")[0]
    assert text == "&" * 3000


def test_cms(evaluate):
    cases = {
        'x /wp-content/ y ghost.io': "WordPress", "ghost.io": "Ghost", "WEBFLOW.COM": None,
        '<meta name="generator" content="Ghost 5">': "Ghost", "a myshopify.com b": "Shopify", None: None,
    }
    assert evaluate(H.cms_name, *cases) == list(cases.values())


def test_nodes_table(rows):
    table = rows("page_id bigint, html string", (1, '<a href="/x" data-q="1">t<!-- c --></a>'), (2, None))
    out = pages.html_nodes(table).orderBy("page_id", "node_id").collect()
    assert [(r.page_id, r.tag, r.parent_id, r.last_descendant_id, r.attrs, r.text) for r in out] == [
        (1, "a", -1, 2, {"href": "/x", "data-q": "1"}, None),
        (1, "#text", 0, 1, None, "t"),
        (2, None, None, None, None, None),
    ]


def test_broken_page_is_a_row(rows, monkeypatch):
    from sitescan.functions import nodes

    def fail(self, data):
        raise AssertionError("bad markup")

    monkeypatch.setattr(nodes._NodeReader, "handle_comment", fail)
    table = rows("page_id bigint, html string", (1, "<p>a<!-- c -->"), (2, "<title>ok</title>"))
    out = pages.enrich_pages(table).orderBy("page_id").collect()
    assert out[0].parse_error == "AssertionError: bad markup" and out[0].title is None
    assert out[1].parse_error is None and out[1].title == "ok"


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_short_cuts_agree_with_nodes(spark, sf):
    table = spark.read.parquet(f"/root/testdata/{sf}/pages.parquet")
    quick = table.select("page_id", H.quick_title(F.col("html")).alias("t"), H.quick_body(F.col("html")).alias("b"))
    exact = pages.enrich_pages(table).select("page_id", F.col("title").alias("t"), F.col("body_text").alias("b"))
    assert quick.exceptAll(exact).isEmpty() and exact.exceptAll(quick).isEmpty()


def test_outlinks(rows):
    html = '<a href="https://b.org/1">x</a><a href="//b.org/2">y</a><a href="z">z</a><a>n</a><a href="mailto:a@b.c">m</a>'
    # //b.org takes the page's scheme
    out = pages.outlinks(rows("page_id bigint, url string, html string", (1, "https://a.org/p", html)))
    assert sorted((r.link_origin, r.links) for r in out.collect()) == [("https://a.org", 1), ("https://b.org", 2)]


def test_texts_of_pages_reach_python_functions(rows):
    words = "der Hund und die Katze sind nicht im Haus, " * 3
    # Many columns first: Spark's numbers of columns and of lambda variables must not meet by chance.
    wide = rows("i int, html string", (1, f"<body><h1>{words}</h1><main>{words}</main></body>")).select("*", *(F.lit(i).alias(f"c{i}") for i in range(50)))
    nodes = F.col("nodes")
    told = pages.with_nodes(wide.select("i", "html")).select(
        language_guess(H.page_body(nodes))["label"].alias("body"), language_guess(H.page_title(nodes))["label"].alias("title")
    )
    assert told.collect() == [("de", "de")]


@pytest.mark.parametrize("tag", sorted(QUIET_TAGS))
def test_quiet_elements_have_their_own_texts(on_nodes, tag):
    inner = "a<b>b</b>" if tag in ("template", "rt", "rp") else "a"
    page = f'<body>x<{tag} id="content">{inner}</{tag}>y</body>'
    whole, body = on_nodes(lambda n: H.inner_text(n, F.get(F.filter(n, lambda m: m["tag"] == tag), F.lit(0)), "|"), page), on_nodes(H.page_body, page)
    assert whole == ["a|b" if inner != "a" else "a"]
    assert body == ["x y" if tag in pages.BOILERPLATE_TAGS else inner.replace("<b>", " ").replace("</b>", "")]
