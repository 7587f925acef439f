"""Page facts. A page is read once; every fact is an expression on its nodes."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions.authors import author_from_byline, author_from_jsonld, author_from_meta
from ..functions.labels import language_guess
from ..functions.nodes import USED_ATTRS, parse_html
from ..functions.text import bind, squeeze
from ..functions.urls import resolve_link, url_origin
from ..lookups import BOILERPLATE_TAGS
from .emails import ranked_emails

BODY_LIMIT = 3000
# A limit that cuts nothing.
WHOLE = (1 << 31) - 1


def with_nodes(pages: DataFrame, attrs=USED_ATTRS, cut_tags=BOILERPLATE_TAGS) -> DataFrame:
    """Adds `nodes` and `parse_error`. No shuffle, one Arrow pass."""
    return (
        pages.withColumn("_parsed", parse_html(F.col("html"), cut_tags, attrs))
        .withColumn("nodes", F.col("_parsed.nodes"))
        .withColumn("parse_error", F.col("_parsed.error"))
        .drop("_parsed")
    )


def html_nodes(pages: DataFrame) -> DataFrame:
    """The node table: one row per element or text, comments left out.

    A page that cannot be read gives one row with its error.
    """
    rows = with_nodes(pages, attrs=None).select("page_id", "parse_error", F.explode_outer("nodes").alias("n"))
    return rows.where(F.col("n.tag").isNull() | (F.col("n.tag") != "#comment")).select(
        "page_id",
        F.col("n.id").alias("node_id"),
        F.col("n.parent").alias("parent_id"),
        F.col("n.last").alias("last_descendant_id"),
        F.col("n.tag").alias("tag"),
        F.col("n.kind").alias("kind"),
        F.col("n.cut").alias("cut"),
        F.col("n.attrs").alias("attrs"),
        F.col("n.text").alias("text"),
        "parse_error",
    )


def page_title(pages: DataFrame) -> DataFrame:
    return with_nodes(pages).select("page_id", H.page_title(F.col("nodes")).alias("title"))


def page_description(pages: DataFrame) -> DataFrame:
    return with_nodes(pages).select("page_id", H.page_description(F.col("nodes")).alias("meta_description"))


def strip_boilerplate(pages: DataFrame) -> DataFrame:
    """All page text outside scripts, navigation, footers and the like."""
    kept = F.array_join(H.texts(F.filter("nodes", lambda n: ~n["cut"])), " ")
    return with_nodes(pages).select("page_id", squeeze(kept).alias("kept_text"))


def content_root(pages: DataFrame) -> DataFrame:
    root = with_nodes(pages).select("page_id", H.content_root(F.col("nodes")).alias("root"))
    return root.select(
        "page_id",
        F.col("root.id").alias("node_id"),
        F.col("root.last").alias("last_descendant_id"),
        F.col("root.tag").alias("tag"),
    )


def body_text(pages: DataFrame, limit: int = BODY_LIMIT) -> DataFrame:
    return with_nodes(pages).select("page_id", H.page_body(F.col("nodes"), limit).alias("body_text"))


def cms_fingerprint(pages: DataFrame) -> DataFrame:
    """Needs only the raw HTML: stays inside the JVM."""
    return pages.select("page_id", H.cms_name(F.col("html")).alias("cms"))


def language_id(texts: DataFrame, column: str = "body_text", key: str = "page_id") -> DataFrame:
    guess = texts.select(key, language_guess(F.col(column)).alias("g"))
    return guess.select(key, F.col("g.label").alias("detected_language"))


def _told_by_nodes(pages: DataFrame, body_limit: int) -> DataFrame:
    nodes = F.col("nodes")
    return (
        with_nodes(pages)
        .withColumn("title", H.page_title(nodes))
        .withColumn("meta_description", H.page_description(nodes))
        .withColumn("full_text", H.page_body(nodes, WHOLE))
        .withColumn("body_text", F.substring("full_text", 1, body_limit))
        .withColumn("cms", F.when(nodes.isNotNull(), H.cms_name(F.col("html"))))
    )


def _with_language(facts: DataFrame) -> DataFrame:
    guess = facts.withColumn("_language", language_guess(F.col("full_text")))
    return guess.withColumn("detected_language", F.col("_language.label")).withColumn(
        "language_confidence", F.col("_language.confidence")
    ).drop("_language")


def enrich_pages(pages: DataFrame, body_limit: int = BODY_LIMIT) -> DataFrame:
    """Title, description, body, CMS and language next to the page's other columns.

    Pages without HTML pass through with NULL facts; so do unreadable ones,
    with the reason in `parse_error`. The language is that of the whole text (`full_text`); `body_text`
    is its first `body_limit` characters. `html` and `nodes` stay for later steps
    and are pruned when nobody asks for them.
    """
    return _with_language(_told_by_nodes(pages, body_limit))


def page_facts(pages: DataFrame, body_limit: int = BODY_LIMIT) -> DataFrame:
    """Everything the rules can say about a page, HTML dropped: one row in, one row out.

    The author of a page is looked for in its structured data, then in its
    meta tags, then in its bylines; later places cost nothing once found.
    """
    nodes = F.col("nodes")

    def found_in(place, source):
        return bind(
            place(nodes),
            lambda name: F.when(
                name.isNotNull(), F.struct(name.alias("name"), F.lit(source).alias("source"))
            ),
        )

    found = F.coalesce(
        found_in(author_from_jsonld, "jsonld"),
        found_in(author_from_meta, "meta"),
        found_in(author_from_byline, "byline"),
    )
    facts = (
        ranked_emails(_told_by_nodes(pages, body_limit))
        .withColumn("_author", found)
        .withColumn("author", F.col("_author.name"))
        .withColumn("author_source", F.col("_author.source"))
        .withColumn("emails", F.transform("ranked", lambda e: e["email"]))
        .drop("_author", "ranked", "nodes", "html")
    )
    # Last, so that only texts and facts go through the function, and neither nodes nor HTML.
    return _with_language(facts)


def outlinks(pages: DataFrame) -> DataFrame:
    """Links per page and target origin: (page_id, link_origin, links).

    Counted inside the page's row by the length of runs of equal origins, so
    nothing is shuffled.
    """
    anchors = F.filter("nodes", lambda n: n["tag"] == "a")
    targets = F.filter(
        F.transform(anchors, lambda n: resolve_link(H.attr(n, "href"), F.col("url"))),
        lambda link: link.isNotNull(),
    )

    def runs(origins):
        first = F.filter(
            F.transform(origins, lambda o, i: F.when(F.get(origins, i - 1).eqNullSafe(o), None).otherwise(i)),
            lambda i: i.isNotNull(),
        )
        return bind(
            first,
            lambda starts: F.transform(
                starts,
                lambda i, k: F.struct(
                    F.get(origins, i).alias("link_origin"),
                    (F.coalesce(F.get(starts, k + 1), F.size(origins)) - i).cast("bigint").alias("links"),
                ),
            ),
        )

    counted = bind(F.array_sort(F.transform(targets, url_origin)), runs)
    rows = with_nodes(pages).select("page_id", F.explode_outer(counted).alias("o"))
    return rows.where(F.col("o").isNotNull()).select("page_id", "o.*")


def outlink_totals(pages: DataFrame) -> DataFrame:
    """Links and linking pages per target origin: (link_origin, links, pages)."""
    return outlinks(pages).groupBy("link_origin").agg(
        F.sum("links").alias("links"), F.count("*").alias("pages")
    )
