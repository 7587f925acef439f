from sitescan.functions import authors as A


def ld(json):
    return f'<script type="application/ld+json">{json}</script>'


def test_clean_name(evaluate):
    cases = {
        "By Jane Smith": "Jane Smith",
        "by  jane smith": None,  # no capital
        "author: Jo X": "Jo X",
        "Posted by Ann Lee": "Ann Lee",
        "Juan Pablo BeltranIWT": "Juan Pablo Beltran IWT",
        "Juan Pablo BeltranIWT Reader": None,
        "José": "Jos é",
        "McDonald": "Mc Donald",
        "April Smith": None,
        "One Two Three Four Five": None,
        "@handle": None,
        "J": None,
        "Jo": "Jo",
        "Иван Петров": "Иван Петров",
        "O'Neil-Smith Jr.": "O'Neil-Smith Jr.",
        "Jane3": None,
        "X" * 51: None,
        "": None, "   ": None, None: None,
    }
    assert evaluate(A.clean_name, *cases) == list(cases.values())
    by_case = lambda c: A.clean_name(c, unicode_split=True)
    assert evaluate(by_case, "José", "JoséÁlvarez") == ["José", "José Álvarez"]


def test_jsonld(on_nodes):
    cases = {
        ld('{"author":"Ann Lee"}'): "Ann Lee",
        ld('{"author":{"name":"Ann Lee"}}'): "Ann Lee",
        ld('{"author":["Ann Lee","Bo Do"]}'): "Ann Lee",
        ld('{"author":[{"name":"staff"},{"name":"Bo Do"}]}'): None,  # only the first counts
        ld('[{"a":1},{"author":"staff"},{"author":"Bo Do"}]'): "Bo Do",
        ld("") + ld("{broken") + ld('{"author":"Ann Lee"}'): "Ann Lee",
        ld('{"@graph":[{"author":"Ann Lee"}]}'): None,
        ld('[5,"x",{"author":"Ann Lee"}]'): "Ann Lee",  # what is no object is skipped
        ld('{"author":{"name":7}}') + ld('{"author":"Ann Lee"}'): "Ann Lee",
        ld('{"author":null}'): None,
        ld("[]"): None,
        '<script type="text/javascript">{"author":"Ann Lee"}</script>': None,
    }
    assert on_nodes(A.author_from_jsonld, *cases) == list(cases.values())


def test_meta(on_nodes):
    cases = {
        '<meta name="author" content="Ann Lee"><meta property="article:author" content="Bo Do">': "Bo Do",
        '<meta property="article:author" content="https://x.org/bo"><meta name="author" content="Ann Lee">': "Ann Lee",
        '<meta name="author" content=""><meta name="author" content="Ann Lee">': None,
        '<meta name="twitter:creator" content="@ann"><meta name="sailthru.author" content="Bo Do">': "Bo Do",
    }
    assert on_nodes(A.author_from_meta, *cases) == list(cases.values())


def test_every_byline_selector(on_nodes):
    hits = [
        '<a rel="author">Ann Lee</a>', '<p class="x authors">Ann Lee</p>', '<p class="byline">Ann Lee</p>',
        '<p class="writer-1">Ann Lee</p>', '<p class="journalist">Ann Lee</p>', '<p id="the-author">Ann Lee</p>',
        '<p id="byline2">Ann Lee</p>', '<div class="vcard"><p><b class="a fn">Ann Lee</b></p></div>',
        '<p class="p-author">Ann Lee</p>', '<p class="entry-author">Ann Lee</p>',
        '<p class="post-author">Ann Lee</p>', '<p class="article-author">Ann Lee</p>',
    ]
    assert on_nodes(A.author_from_byline, *hits) == ["Ann Lee"] * len(hits)
    misses = [
        '<a rel="author nofollow">Ann Lee</a>', '<div class="vcard fn">Ann Lee</div>', '<b class="fn">Ann Lee</b>',
        '<p class="Author">Ann Lee</p>', '<p class="author"><script>Ann Lee</script></p>',
    ]
    assert on_nodes(A.author_from_byline, *misses) == [None] * len(misses)


def test_byline_order_and_inner_text(on_nodes):
    cases = {
        '<p class="byline">Bo Do</p><p class="author">Ann Lee</p>': "Ann Lee",  # by selector, then by place
        '<p class="author">staff</p><p class="author">Ann Lee</p>': "Ann Lee",
        '<p class="author">By <b>Ann</b><i>Lee</i></p>': None,  # joined without a blank: ByAnnLee
        '<p class="author"><b>Ann</b> <i>Lee</i></p>': "Ann Lee",  # split again at the capital
    }
    got = on_nodes(A.author_from_byline, *cases)
    assert got[0] == "Ann Lee" and got[1] == "Ann Lee" and got[3] == "Ann Lee"
    assert got[2] == "By Ann Lee"


def test_structured_data_with_repeated_keys_and_numbers_that_are_none(on_nodes):
    ld = lambda t: f'<script type="application/ld+json">{t}</script>'
    pages = {
        ld('{"author":"Old Name","author":"Jane Smith"}'): "Jane Smith",
        ld('{"rating":NaN,"author":{"name":"Bob Lee"}}'): "Bob Lee",
        ld('[{"x":Infinity},{"author":[{"name":"Ana Cruz","name":"Ana Maria Cruz"}]}]'): "Ana Maria Cruz",
        ld('{"author":"Old Name","author":NaN}'): None,
        ld('{"author":"Jane Smith",NaN}'): None,
        ld('{"x":NaN}') + ld('{"author":"Second Block"}'): "Second Block",
        '<script>{"author":"Not Data","author":NaN}</script>': None,
    }
    assert on_nodes(A.author_from_jsonld, *pages) == list(pages.values())
