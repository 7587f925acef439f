"""Crawl logs: what each attempt meant, what each URL came to, when to ask again."""

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ordered import ordered_chunks

MAX_ATTEMPTS = 3
TIMED_OUT = "Request timed out"
REDIRECTS = "Too many redirects"
UNKNOWN = "Unknown error after all retries"


def outcome_column(status="status_code", error="error_class"):
    status, error = F.col(status), F.col(error)
    return (
        F.when(error == "timeout", "timeout")
        .when(error == "too_many_redirects", "redirects")
        .when(error.isNotNull(), "request_error")
        .when(status.isin(403, 429), "blocked")
        .when(status.between(400, 499), "client_error")
        .when(status >= 500, "server_error")
        .otherwise("ok")
    )


def attempt_outcome(attempts: DataFrame) -> DataFrame:
    """Adds outcome, terminal and error to every attempt.

    A blocked attempt is final here and is handed to the renderer.
    """
    status = F.col("status_code").cast("string")
    message = F.col("error_text") if "error_text" in attempts.columns else F.col("error_class")
    return (
        attempts.withColumn("outcome", outcome_column())
        .withColumn("terminal", F.col("outcome").isin("ok", "blocked", "client_error", "redirects"))
        .withColumn(
            "error",
            F.when(F.col("outcome") == "timeout", TIMED_OUT)
            .when(F.col("outcome") == "redirects", REDIRECTS)
            .when(F.col("outcome") == "request_error", message)
            .when(F.col("outcome") != "ok", F.concat(F.lit("HTTP "), status)),
        )
    )


def final_status(outcome, terminal, error):
    """Fetch status of a URL, from the attempt that decides it."""
    return (
        F.when(outcome == "ok", "OK")
        .when(outcome == "blocked", "BLOCKED")
        .when(terminal, "FAILED")
        .when(F.lower(error).contains("timed out"), "TIMEOUT")
        .otherwise("FAILED")
    )


def attempt_resolve(attempts: DataFrame, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """One status per URL of the log: its first final attempt, else its last allowed one.

    Attempts beyond the allowed ones decide only where a URL has no others, and those without a
    number only where there are none with one. Of two records of an attempt the earlier one counts.
    """
    return first_deciding(attempt_outcome(attempts), max_attempts)


def first_deciding(judged: DataFrame, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """`attempt_resolve` for attempts that have their outcome.

    An aggregate rather than a window: attempts are merged before the shuffle,
    however many a URL has.
    """
    allowed = F.coalesce(F.col("attempt") <= max_attempts, F.lit(False))
    rank = F.when(F.col("terminal"), F.col("attempt")).otherwise(max_attempts - F.col("attempt"))
    order = F.struct(~allowed, F.col("attempt").isNull(), ~F.col("terminal"), rank, F.col("ts"))
    deciding = F.struct("attempt", "status_code", "outcome", "terminal", "error")
    return with_status(judged.groupBy("url").agg(F.min_by(deciding, order).alias("d")).select("url", "d.*"))


def with_status(decided: DataFrame) -> DataFrame:
    """url, attempt, status_code, fetch_status, fetch_error of the attempts that decide."""
    outcome, terminal, error = F.col("outcome"), F.col("terminal"), F.col("error")
    return decided.select(
        "url",
        "attempt",
        F.when(terminal & (outcome != "redirects"), F.col("status_code")).alias("status_code"),
        final_status(outcome, terminal, error).alias("fetch_status"),
        F.when(outcome != "ok", F.coalesce(F.when(error != "", error), F.lit(UNKNOWN))).alias("fetch_error"),
    )


def retry_backoff(attempts: DataFrame, max_attempts: int = MAX_ATTEMPTS,
                  kind: str = "fetch") -> DataFrame:
    """Seconds to wait after each attempt, and in total up to and including it; one row per attempt logged.

    fetch: 1, 2, 4 … after a failure worth retrying, nothing after the last
    attempt. classifier: 2, 4, 8 …, also after the last.
    """
    retry = ~F.col("terminal")
    if kind == "fetch":
        wait = F.when(retry & (F.col("attempt") < max_attempts), F.pow(F.lit(2), F.col("attempt") - 1))
    elif kind == "classifier":
        wait = F.when(retry, F.pow(F.lit(2), F.col("attempt")))
    else:
        raise ValueError(f"unknown kind of retry: {kind!r}")
    judged = attempt_outcome(attempts).withColumn("wait_s", F.coalesce(wait, F.lit(0)).cast("bigint"))

    # A running sum keeps every row, also repeated and unusual attempt numbers; the window spills.
    so_far = W.partitionBy("url").orderBy("attempt", "ts", "outcome").rowsBetween(W.unboundedPreceding, 0)
    return judged.select("url", "attempt", "outcome", "wait_s", F.sum("wait_s").over(so_far).alias("total_wait_s"))


def render_outcome(rendered: DataFrame) -> DataFrame:
    """Status of a rendered page. Apart from 403 and 429 any answer counts as OK,
    also 404 and 500; `http_error` marks those.
    """
    status = F.col("status_code")
    error = F.col("error_class") if "error_class" in rendered.columns else F.lit(None).cast("string")
    blocked = status.isin(403, 429)
    return (
        rendered.withColumn(
            "fetch_status",
            F.when(error == "timeout", "TIMEOUT")
            .when(error.isNotNull(), "FAILED")
            .when(blocked, "BLOCKED")
            .otherwise("OK"),
        )
        .withColumn(
            "fetch_error",
            F.when(error == "timeout", "Page load timed out")
            .when(error.isNotNull(), F.concat(F.lit("Render error: "), error))
            .when(blocked, F.concat(F.lit("HTTP "), status.cast("string"), F.lit(" - blocked even when rendered"))),
        )
        .withColumn("http_error", F.coalesce((F.col("fetch_status") == "OK") & (status >= 400), F.lit(False)))
    )


def render_fallback(plain: DataFrame, rendered: DataFrame, carry=("html",),
                    threshold: int = 50_000) -> DataFrame:
    """Choose the plain or the rendered crawl of every URL.

    Both sides hold one row per URL with fetch_status, fetch_error,
    status_code, `html_chars` (NULL or 0: no page) and the `carry` columns.
    Extract facts first and carry those: then no HTML goes through the shuffle.
    """
    fields = ["status_code", "fetch_status", "fetch_error", *carry]
    left = plain.select("url", "html_chars", F.struct(*fields).alias("p"))
    right = rendered.select(
        "url", F.col("html_chars").alias("r_chars"), F.struct(*fields).alias("r")
    )
    both = left.join(right, "url", "left")
    blocked = F.col("p.fetch_status") == "BLOCKED"
    short = (F.col("p.fetch_status") == "OK") & (F.col("html_chars") > 0) & (F.col("html_chars") < threshold)
    better = (F.col("r.fetch_status") == "OK") & (F.col("r_chars") > 0)
    no_renderer = F.col("p").withField("fetch_status", F.lit("FAILED")).withField(
        "fetch_error", F.lit("Renderer not available")
    ).withField("status_code", F.lit(None).cast("int"))
    source = (
        F.when(blocked & F.col("r").isNull(), "none")
        .when(blocked | (short & better), "rendered")
        .otherwise("plain")
    )
    pick = (
        F.when(F.col("source") == "none", no_renderer)
        .when(F.col("source") == "rendered", F.col("r"))
        .otherwise(F.col("p"))
    )
    return both.withColumn("source", source).withColumn("_pick", pick).select("url", "source", "_pick.*")


def politeness_plan(requests: DataFrame, delay_s: float = 2.0, chunks: int | None = None) -> DataFrame:
    """Earliest start of every request so that a host gets one at a time, with a
    pause after each answer.

    requests(host, url, arrival_us, dur_us, …) gains start_us. Requests of a
    host are served by arrival, then by the remaining columns.

    With P the time that all earlier requests take, start = P + max(arrival - P)
    over the requests so far. Both parts are scans, so a host is split into
    chunks: totals per chunk first, then the carry of earlier chunks, then the
    rows. No task ever holds a whole host.
    """
    gap = int(round(delay_s * 1_000_000))
    order = ["host", "arrival_us", *[c for c in requests.columns if c not in ("host", "arrival_us")]]
    placed = ordered_chunks(requests, order, chunks)
    here = W.partitionBy("host", "chunk").orderBy(*order[1:], "tie")
    before = here.rowsBetween(W.unboundedPreceding, -1)
    so_far = here.rowsBetween(W.unboundedPreceding, 0)
    cost = F.col("dur_us") + gap
    local = (
        placed.withColumn("_busy", F.coalesce(F.sum(cost).over(before), F.lit(0)))
        .withColumn("_slack", F.col("arrival_us") - F.col("_busy"))
        .withColumn("_top", F.max("_slack").over(so_far))
    )
    totals = local.groupBy("host", "chunk").agg(
        F.sum(cost).alias("chunk_cost"), F.max("_slack").alias("chunk_top")
    )
    # One row per host and chunk.
    earlier = W.partitionBy("host").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    carried = (
        totals.withColumn("_offset", F.coalesce(F.sum("chunk_cost").over(earlier), F.lit(0)))
        .withColumn("_before", F.max(F.col("chunk_top") - F.col("_offset")).over(earlier))
        .select("host", "chunk", "_offset", "_before")
    )
    top = F.greatest(F.col("_top") - F.col("_offset"), F.col("_before"))
    return (
        local.join(carried, ["host", "chunk"])
        .withColumn("start_us", F.col("_offset") + F.col("_busy") + top)
        .select(*requests.columns, "start_us")
    )


def fetch_split(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good pages and failed ones."""
    good = F.col("fetch_status") == "OK"
    return pages.where(good), pages.where(~good)
