"""The result table: one row per site."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lookups import RESULT_COLUMNS

SURE_AUTHOR = 50
GOOD = ("OK", "AI_ERROR")
RESULT_SCHEMA = (
    "url string, niche string, site_type string, language string, author string, email string,"
    " email_valid boolean, confidence_niche int, confidence_type int, confidence_author int,"
    " cms string, status string, error string"
)
NO_CLASSIFICATION = "no classification returned"


def _empty_to_null(column):
    return F.when(column != "", column)


def author_precedence(class_author, page_author, confidence):
    """The classifier's author; the page's own only where the classifier has none and is unsure."""
    return F.when(class_author != "", class_author).when(confidence < SURE_AUTHOR, page_author).otherwise(class_author)


def merge_columns(c, best_email, fetch_status="fetch_status", fetch_error="fetch_error"):
    """Result columns from a row's page facts and its classification struct `c`."""
    ai_error = _empty_to_null(c["ai_error"])
    status = F.col(fetch_status)
    return [
        F.col("url"),
        c["niche"].alias("niche"),
        c["site_type"].alias("site_type"),
        c["language"].alias("language"),
        author_precedence(c["author"], F.col("author"), c["confidence"]["author"]).alias("author"),
        best_email.alias("email"),
        F.lit(None).cast("boolean").alias("email_valid"),
        F.nullif(c["confidence"]["niche"], F.lit(0)).alias("confidence_niche"),
        F.nullif(c["confidence"]["site_type"], F.lit(0)).alias("confidence_type"),
        F.nullif(c["confidence"]["author"], F.lit(0)).alias("confidence_author"),
        F.col("cms"),
        F.when((status == "OK") & ai_error.isNotNull(), "AI_ERROR").otherwise(status).alias("status"),
        F.coalesce(_empty_to_null(F.col(fetch_error)), c["ai_error"]).alias("error"),
    ]


_CLASS_FIELDS = ("niche", "site_type", "language", "author", "confidence", "ai_error")


def result_merge(facts: DataFrame, classified: DataFrame) -> DataFrame:
    """One result row per page: page facts joined with their classification.

    A good page without a classification gets an error; of a failed page only
    URL, status and error are shown.

    facts(url, fetch_status, fetch_error, author, emails, cms);
    classified(url, niche, site_type, language, author, confidence, ai_error).
    """
    side = classified.select(F.col("url"), F.struct(*_CLASS_FIELDS).alias("_c"))
    none = F.struct(
        F.lit(None).cast("string").alias("niche"),
        F.lit("Unknown").alias("site_type"),
        F.lit(None).cast("string").alias("language"),
        F.lit(None).cast("string").alias("author"),
        F.struct(*(F.lit(0).alias(s) for s in ("niche", "site_type", "language", "author"))).alias("confidence"),
        F.lit(NO_CLASSIFICATION).alias("ai_error"),
    )
    return _one_pass(facts.join(side, "url", "left").withColumn("_c", F.coalesce("_c", none)))


def merge_in_place(classified_facts: DataFrame) -> DataFrame:
    """Result rows, good and failed ones alike, from facts that `classify_sites` has
    already extended: no join, no union, one pass.
    """
    c = F.struct(
        "niche", "site_type", F.col("class_language").alias("language"),
        F.col("class_author").alias("author"), "confidence", "ai_error",
    )
    return _one_pass(classified_facts.withColumn("_c", c))


def _one_pass(rows: DataFrame) -> DataFrame:
    good = F.col("fetch_status") == "OK"
    merged = rows.withColumn("_good", good).select(
        "_good", F.col("fetch_error").alias("_failure"),
        *merge_columns(F.col("_c"), F.get(F.col("emails"), F.lit(0))),
    )
    kept = ("url", "status")
    return merged.select(
        *(
            F.col(n) if n in kept
            else F.when(F.col("_good"), F.col(n)).otherwise(F.col("_failure")).alias(n) if n == "error"
            else F.when(F.col("_good"), F.col(n)).alias(n)
            for n, _ in RESULT_COLUMNS
        )
    )


def failed_rows(failed: DataFrame) -> DataFrame:
    """Only URL, status and error are known of these."""
    return failed.select("url", F.col("fetch_status").alias("status"), F.col("fetch_error").alias("error"))


def with_failed(merged: DataFrame, failed: DataFrame) -> DataFrame:
    return merged.unionByName(failed_rows(failed), allowMissingColumns=True)


def result_format(rows: DataFrame) -> DataFrame:
    """The 13 display columns in order, blank where nothing is known."""

    def show(name):
        text = F.col(name).cast("string")
        if name == "email_valid":
            text = F.initcap(text)
        return F.coalesce(text, F.lit(""))

    return rows.select(*(show(name).alias(heading) for name, heading in RESULT_COLUMNS))


def run_summary(rows: DataFrame, elapsed_s: float | None = None) -> DataFrame:
    good = F.col("status").isin(*GOOD)
    summary = rows.agg(
        F.count("*").alias("total"),
        F.count_if(good).alias("successful"),
        F.count_if(~good).alias("failed"),
    )
    return summary if elapsed_s is None else summary.withColumn("elapsed_s", F.lit(float(elapsed_s)))


def status_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("status").agg(F.count("*").alias("sites"))
