"""Page facts as expressions on a page's node array (see `nodes.py`)."""

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..lookups import CMS_SIGNATURES, CONTENT_CLASS, CONTENT_ID
from .nodes import QUIET_TAGS
from .text import bind, blank_to_null, first_of, first_where, squeeze, strip


def attr(node, name) -> Column:
    return node["attrs"][name]


def subtree(nodes, node) -> Column:
    return F.slice(nodes, node["id"] + 2, node["last"] - node["id"])


def has_class(node, name) -> Column:
    return attr(node, "class").rlike(rf"(?:^|\s){name}(?:\s|$)")


def texts(nodes, kind="") -> Column:
    """Trimmed, non-empty strings in document order."""
    found = F.filter(nodes, lambda n: (n["tag"] == "#text") & (n["kind"] == kind))
    return F.filter(F.transform(found, lambda n: strip(n["text"])), lambda t: t != "")


def own_texts(nodes, node) -> Column:
    """Those strings among `nodes` that are of the kind that counts as text of this element.

    The kinds are spelled out, since `node` is mostly the variable of a lambda: where a lambda within uses it, Spark
    takes it for a column of the table and then leaves a Python function of the text in the plan, which fails.
    """
    quiet = reduce(lambda chain, k: chain.when(node["tag"] == k, texts(nodes, k)), sorted(QUIET_TAGS), F)
    return quiet.otherwise(texts(nodes))


def inner_text(nodes, node, separator="") -> Column:
    return F.array_join(own_texts(subtree(nodes, node), node), separator)


def single_string(nodes, node) -> Column:
    """The element's text if it holds exactly one string, however deep; else NULL."""
    return bind(
        subtree(nodes, node),
        lambda below: F.when(
            F.forall(below, lambda n: n["parent"] == n["id"] - 1),
            F.try_element_at(below, F.lit(-1))["text"],
        ),
    )


def _meta_content(nodes, name, value) -> Column:
    """Content of the first such meta tag, as an array that is empty if there is none."""
    tag = first_where(nodes, lambda n: (n["tag"] == "meta") & (attr(n, name) == value))
    return F.filter(F.transform(tag, lambda n: attr(n, "content")), lambda c: c != "")


def meta_content(nodes, name, value) -> Column:
    """Content of the first meta tag with this name; NULL if that one is empty."""
    return first_of(_meta_content(nodes, name, value))


def page_title(nodes) -> Column:
    title = F.transform(
        first_where(nodes, lambda n: n["tag"] == "title"), lambda n: single_string(nodes, n)
    )
    heading = F.transform(
        first_where(nodes, lambda n: n["tag"] == "h1"), lambda n: inner_text(nodes, n)
    )
    return F.coalesce(
        strip(meta_content(nodes, "property", "og:title")),
        strip(first_of(F.filter(title, lambda t: t != ""))),
        first_of(heading),
    )


def page_description(nodes) -> Column:
    return F.coalesce(
        strip(meta_content(nodes, "property", "og:description")),
        strip(meta_content(nodes, "name", "description")),
    )


def content_root(nodes) -> Column:
    """The element that holds the content; boilerplate is looked through as if cut out."""
    tests = (
        lambda n: n["tag"] == "main",
        lambda n: n["tag"] == "article",
        lambda n: attr(n, "id").rlike(CONTENT_ID),
        lambda n: attr(n, "class").rlike(CONTENT_CLASS),
        lambda n: n["tag"] == "body",
    )

    def first_kept(test):
        return first_of(F.filter(nodes, lambda n: test(n) & ~n["cut"]))

    return F.coalesce(*(first_kept(test) for test in tests))


def body_text(nodes, root, limit: int = 3000) -> Column:
    """Visible text below the content root, cut to `limit` characters."""
    kept = F.filter(subtree(nodes, root), lambda n: ~n["cut"])
    text = squeeze(F.array_join(own_texts(kept, root), " "))
    return F.when(nodes.isNotNull(), F.coalesce(F.substring(text, 1, limit), F.lit("")))


def page_body(nodes, limit: int = 3000) -> Column:
    return bind(content_root(nodes), lambda root: body_text(nodes, root, limit))


def cms_name(html, signatures=CMS_SIGNATURES) -> Column:
    """First publishing system with a signature in the raw HTML."""
    return F.coalesce(
        *(
            F.when(reduce(lambda a, b: a | b, (html.contains(s) for s in marks)), name)
            for name, marks in signatures
        )
    )


# Short cuts for well-formed pages: no Python, but no tree either. They agree
# with the node form when boilerplate elements are closed and not nested.

def drop_quiet(html) -> Column:
    """Remove comments, scripts and styles."""
    return F.regexp_replace(html, r"(?is)<!--.*?-->|<(script|style)\b[^>]*>.*?</\1\s*>", "")


def drop_boilerplate(html) -> Column:
    """Remove comments and the subtrees that are not content."""
    cuts = r"(?is)<(nav|footer|header|aside|noscript|iframe|form)\b[^>]*>.*?</\1\s*>"
    return F.regexp_replace(drop_quiet(html), cuts, "")


def quick_meta(html, name, value) -> Column:
    tag = F.regexp_extract(html, rf'(?i)<meta\s[^>]*{name}="{value}"[^>]*>', 0)
    content = F.regexp_extract(tag, r'(?i)content="([^"]*)"', 1)
    return blank_to_null(strip(decode_entities(content)))


def quick_title(html) -> Column:
    return F.coalesce(
        quick_meta(html, "property", "og:title"),
        blank_to_null(
            strip(decode_entities(F.regexp_extract(html, r"(?is)<title[^>]*>([^<]*)</title", 1)))
        ),
    )


def quick_description(html) -> Column:
    return F.coalesce(
        quick_meta(html, "property", "og:description"), quick_meta(html, "name", "description")
    )


def quick_body(html, limit: int = 3000) -> Column:
    """Text of the first main or article element; NULL when there is neither."""
    kept = drop_boilerplate(html)
    inner = F.coalesce(
        *(
            blank_to_null(F.regexp_extract(kept, rf"(?is)<{t}\b[^>]*>(.*?)(?:</{t}\s*>|\z)", 1))
            for t in ("main", "article")
        )
    )
    return F.substring(squeeze(decode_entities(F.regexp_replace(inner, r"<[^>]*>", " "))), 1, limit)


# The entities the short cuts decode; the node form knows all of them.
QUICK_ENTITIES = (
    ("nbsp", "\xa0"), ("copy", "©"), ("middot", "·"), ("quot", '"'), ("apos", "'"),
    ("lt", "<"), ("gt", ">"), ("amp", "&"),
)


def decode_entities(text) -> Column:
    """Decode the common entities, also where the semicolon was forgotten."""

    def decode(t, entity):
        name, char = entity
        return F.regexp_replace(t, rf"&{name}(?:;|(?![\-.a-zA-Z0-9;]))", char)

    return F.when(text.contains("&"), reduce(decode, QUICK_ENTITIES, text)).otherwise(text)
