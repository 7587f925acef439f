"""The whole job: a URL list and crawled pages to one result row per URL."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip
from ..operators.classify import CLASS_COLUMNS, classify_sites
from ..operators.crawl_log import attempt_resolve, render_fallback, render_outcome
from ..operators.email_checks import email_format, email_mx, probe_answers
from ..operators.learned import LearnedClassifier
from ..operators.pages import page_facts
from ..operators.results import merge_in_place, result_merge
from ..operators.urls import url_dedupe, url_normalize

NOT_CRAWLED = "no crawl result"
PAGE_COLUMNS = ("author", "emails", "cms")


def crawl_facts(pages: DataFrame) -> DataFrame:
    """Facts of every crawled page; html is gone before anything is shuffled.

    pages(url, html) may bring fetch_status and fetch_error from the crawl log.
    """
    if "fetch_status" not in pages.columns:
        pages = pages.withColumn("fetch_status", F.lit("OK")).withColumn(
            "fetch_error", F.lit(None).cast("string")
        )
    # Only good pages are read.
    return page_facts(pages.withColumn("html", F.when(F.col("fetch_status") == "OK", F.col("html"))))


def one_per_url(facts: DataFrame) -> DataFrame:
    """One row per URL, a good one if there is one.

    Copies of a URL are merged before the shuffle, and the join by URL that
    follows uses that shuffle. Status and error decide first and are merged by
    themselves, so that whoever asks for no more never reads a page.
    """
    decisive = [c for c in ("fetch_status", "fetch_error") if c in facts.columns]
    rest = [c for c in facts.columns if c != "url" and c not in decisive]
    first = F.struct((F.col("fetch_status") != "OK").alias("_bad"), *decisive)
    order = F.struct(first, F.xxhash64(*rest))
    best = facts.groupBy("url").agg(F.min(first).alias("_first"), F.min_by(F.struct(*rest), order).alias("_best"))
    return best.select("url", *(F.col(f"_first.{c}") for c in decisive), "_best.*")


def profile_sites(pages: DataFrame, urls: DataFrame | None = None,
                  mx_snapshot: DataFrame | None = None, classified: DataFrame | None = None,
                  probes: DataFrame | None = None, classifier: LearnedClassifier | None = None) -> DataFrame:
    """One result row per URL.

    urls(pos, raw) is a raw list; without it every page's URL counts.
    classified holds replies read by `read_replies`; without it the word-list
    scorer runs, in the same pass over the page; a learned classifier, if given, names the site types.
    """
    facts = crawl_facts(pages)
    if classified is None:
        facts = classify_sites(facts)
        if classifier is not None:
            facts = classifier.site_types(facts)
    # Texts have served their purpose; only what the result shows goes on. The scorer makes no errors to carry.
    shown = ["url", "fetch_status", "fetch_error", *PAGE_COLUMNS]
    facts = facts.select(*shown, *(c for c in CLASS_COLUMNS if classified is None and c != "ai_error"))
    facts = one_per_url(facts)
    if classified is None:
        facts = facts.withColumn("ai_error", F.lit(None).cast("string"))
    if urls is not None:
        wanted = url_dedupe(url_normalize(urls)).select("url")
        missing = F.col("fetch_status").isNull()
        facts = (
            wanted.join(facts, "url", "left")
            .withColumn("fetch_error", F.when(missing, NOT_CRAWLED).otherwise(F.col("fetch_error")))
            .withColumn("fetch_status", F.coalesce("fetch_status", F.lit("FAILED")))
        )
    rows = merge_in_place(facts) if classified is None else result_merge(facts, classified)
    if mx_snapshot is None:
        return rows
    return validate_rows(rows, mx_snapshot, probes)


def profile_crawl(attempts: DataFrame, plain: DataFrame, rendered: DataFrame,
                  mx_snapshot: DataFrame | None = None) -> DataFrame:
    """The same from a crawl log with a plain and a rendered page per URL.

    attempts as for `attempt_resolve`; plain(url, html); rendered(url, html,
    status_code). Facts are drawn on both sides first, so the joins by URL move
    facts and never HTML.
    """
    size = F.coalesce(F.length("html"), F.lit(0)).alias("html_chars")
    facts = [*PAGE_COLUMNS, *CLASS_COLUMNS]

    def read(pages):
        known = classify_sites(page_facts(pages)).select("url", *pages.columns[2:], *facts)
        return one_per_url(known)

    status = attempt_resolve(attempts)
    plain_pages = plain.select("url", "html", size, F.lit("OK").alias("fetch_status"))
    plain_side = status.join(read(plain_pages).drop("fetch_status"), "url", "left")
    rendered_side = read(render_outcome(rendered).select("url", "html", size, "status_code", "fetch_status", "fetch_error"))
    rows = merge_in_place(render_fallback(plain_side, rendered_side, carry=facts))
    return rows if mx_snapshot is None else validate_rows(rows, mx_snapshot)


def validate_rows(rows: DataFrame, mx_snapshot: DataFrame, probes: DataFrame | None = None) -> DataFrame:
    """Note on every row with an address whether it can be written to.

    The verdict depends on the address alone, so it is worked out on the rows
    as they pass: one join by domain, and the pages are read only once.
    """
    checked = email_mx(email_format(rows), mx_snapshot)
    verdict = F.col("format_valid") & F.col("mx_valid")
    if probes is not None:
        answers = probe_answers(probes).withColumnRenamed("email", "_email")
        key = F.coalesce(F.col("email"), F.col("url"))
        checked = checked.join(answers, key == F.col("_email"), "left")
        verdict = verdict & F.coalesce(F.col("accepted"), F.lit(False))
    valid = F.when(F.col("email").isNotNull(), verdict)
    return checked.withColumn("email_valid", valid).select(*rows.columns)
