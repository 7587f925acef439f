"""One query per operator, over whole tables."""

import uuid

from pyspark.sql import functions as F

from sitescan.functions import emails as E
from sitescan.functions import html as H
from sitescan.functions import urls as U
from sitescan.operators import authors, classify, crawl_log, discovery, email_checks, emails, learned, pages, results, urls
from sitescan.plans import profile
from sitescan.session import checkpoint_dir
from sitescan.sources import tables
from sitescan.streaming import jobs

from .views import spark_view

N = 10
QUERIES = {}


def query(function):
    """Register a query. Its parameters after the session are the tables or views it reads
    (`pages_` is the table where `pages` is the module).
    """
    names = function.__code__.co_varnames[1 : function.__code__.co_argcount]

    def run(spark, sf_dir):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return function(spark, *(spark_view(spark, sf_dir, name.rstrip("_")) for name in names))

    QUERIES[function.__name__] = run
    return function


def scratch(spark):
    """A fresh place in the shared folder."""
    return f"{checkpoint_dir(spark)}/{uuid.uuid4()}"


def unpack(df):
    """The confidence struct as flat columns."""
    pairs = (("niche", "niche"), ("site_type", "type"), ("language", "language"), ("author", "author"))
    for field, name in pairs:
        df = df.withColumn(f"confidence_{name}", F.col(f"confidence.{field}"))
    return df.drop("confidence")


# URLs

@query
def url_scan(spark, pages):
    place = scratch(spark)
    pages.select("page_id", F.col("url").alias("Website")).write.option("header", True).csv(place)
    return tables.url_scan(spark, place, keep_columns=True).select(
        F.col("page_id").cast("bigint").alias("pos"), F.col("raw").alias("url")
    )


@query
def url_scan_mixed(spark, pages):
    """Files with headers of their own: other names, other separators, quoted line breaks."""
    place = scratch(spark)
    kinds = [
        pages.select("page_id", F.col("url").alias("Website"), F.lit("a;b").alias("note")),
        pages.select(F.col("url").alias("URL"), F.concat(F.lit("two\nlines "), "url").alias("note"), "page_id"),
        pages.select(F.lit("x,y").alias("note"), "page_id", F.col("url").alias("link")),
    ]
    for i, (kind, sep) in enumerate(zip(kinds, ",;\t")):
        kind.where(F.col("page_id") % 3 == i).write.option("header", True).option("sep", sep).csv(f"{place}/{i}")
    scan = tables.url_scan(spark, f"{place}/*", keep_columns=True, ragged="odd")
    return scan.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("raw").alias("url"), "note", "odd")


@query
def url_load(spark, raw_urls):
    """The load and its audit from one pass: every URL with the counts of all."""
    place = scratch(spark)
    loaded, counts = urls.url_load(raw_urls)
    loaded.write.parquet(place)
    return spark.read.parquet(place).select("url", "pos", *(F.lit(n).cast("bigint").alias(name) for name, n in counts.get().items()))


@query
def url_normalize(spark, raw_urls):
    return urls.url_normalize(raw_urls).select("pos", "url")


@query
def url_dedupe(spark, raw_urls):
    return urls.url_dedupe(urls.url_normalize(raw_urls))


@query
def url_load_audit(spark, raw_urls):
    return urls.url_load_audit(raw_urls)


@query
def url_merge(spark, raw_urls, pages):
    found = pages.select(U.url_origin(F.col("url")).alias("url"), F.col("page_id").alias("pos")).unionByName(
        pages.select("url", F.col("page_id").alias("pos"))
    )
    return urls.url_merge(urls.url_dedupe(urls.url_normalize(raw_urls)), found)


# Discovery

@query
def query_patterns(spark, queries):
    return discovery.query_patterns(queries)


@query
def index_pattern_scan(spark, queries, url_index):
    return discovery.index_pattern_scan(url_index, discovery.query_patterns(queries), N)


@query
def index_pattern_scan_stored(spark, queries, url_index):
    """The same through an index of pieces that is stored first."""
    place = scratch(spark)
    discovery.write_piece_index(url_index, place)
    return discovery.index_pattern_scan(url_index, discovery.query_patterns(queries), N, place)


@query
def index_first_hit(spark, queries, url_index):
    scan = discovery.index_pattern_scan(url_index, discovery.query_patterns(queries), N)
    return discovery.index_first_hit(scan, N)


@query
def noise_domain_filter(spark, links):
    return discovery.noise_domain_filter(links)


@query
def url_origin(spark, links):
    return links.select("query_id", "rank", U.url_origin(F.col("href")).alias("origin"))


@query
def origin_dedupe(spark, pages):
    return discovery.origin_dedupe(pages.select("url", F.col("page_id").alias("rank")))


@query
def search_results_explode(spark, links):
    # Archived result pages, ten links each.
    archive = (
        links.groupBy("query_id", F.floor((F.col("rank") - 1) / 10).cast("int").alias("page"))
        .agg(F.array_sort(F.collect_list(F.struct("rank", F.col("href").alias("link")))).alias("found"))
        .select("query_id", "page", F.to_json(F.struct(F.col("found").alias("organic_results"))).alias("json"))
    )
    return discovery.search_results_explode(archive, 2 * N)


@query
def discover(spark, queries, url_index):
    return discovery.discover(url_index, N, "commoncrawl", queries)


@query
def discover_links(spark, links):
    return discovery.discover(links, N, "ddg")


# Crawl log

@query
def attempt_outcome(spark, attempts):
    return crawl_log.attempt_outcome(attempts).select("url", "attempt", "outcome", "terminal", "error")


@query
def attempt_resolve(spark, attempts):
    return crawl_log.attempt_resolve(attempts)


@query
def attempt_resolve_any(spark, attempts_any):
    return crawl_log.attempt_resolve(attempts_any)


@query
def retry_backoff(spark, attempts):
    return crawl_log.retry_backoff(attempts)


def _sides(plain, rendered):
    p = plain.select(
        "url", "status_code",
        F.when(F.col("status_code") == 200, "OK").when(F.col("status_code") == 403, "BLOCKED").otherwise("FAILED").alias("fetch_status"),
        F.when(F.col("status_code") != 200, F.concat(F.lit("HTTP "), F.col("status_code").cast("string"))).alias("fetch_error"),
        F.length("html").alias("html_chars"),
    )
    r = crawl_log.render_outcome(rendered).withColumn("html_chars", F.length("html"))
    return p.withColumn("chars", F.col("html_chars")), r.withColumn("chars", F.col("html_chars"))


@query
def render_fallback(spark, plain, rendered):
    chosen = crawl_log.render_fallback(*_sides(plain, rendered), carry=("chars",))
    return chosen.withColumnRenamed("chars", "html_chars")


@query
def render_outcome(spark, rendered):
    return crawl_log.render_outcome(rendered).select("url", "fetch_status", "fetch_error", "http_error")


@query
def politeness_plan(spark, attempts):
    requests = attempts.select(
        "host", "url", "attempt",
        F.unix_micros(F.col("ts").cast("timestamp")).alias("arrival_us"),
        (F.col("dur_s") * 1_000_000).alias("dur_us"),
    )
    return crawl_log.politeness_plan(requests)


@query
def fetch_split(spark, attempts):
    good, failed = crawl_log.fetch_split(crawl_log.attempt_resolve(attempts))
    both = good.withColumn("side", F.lit("good")).unionByName(failed.withColumn("side", F.lit("failed")))
    return both.groupBy("side", "fetch_status").agg(F.count("*").alias("urls"))


# Pages

@query
def html_nodes(spark, pages_):
    nodes = pages.html_nodes(pages_).where(F.col("tag") != "#text")
    return nodes.groupBy("tag").agg(F.count("*").alias("nodes"))


@query
def page_title(spark, pages_decorated):
    return pages.page_title(pages_decorated)


@query
def page_description(spark, pages_decorated):
    return pages.page_description(pages_decorated)


@query
def quick_title(spark, pages_decorated):
    return pages_decorated.select("page_id", H.quick_title(F.col("html")).alias("title"))


@query
def quick_body(spark, pages_):
    return pages_.select("page_id", H.quick_body(F.col("html")).alias("body_text"))


@query
def strip_boilerplate(spark, pages_):
    return pages.strip_boilerplate(pages_)


@query
def content_root(spark, pages_):
    # A third of the pages has its text in another element that counts, a third in none that does.
    name = F.when(F.col("page_id") % 3 == 1, "main").when(F.col("page_id") % 3 == 2, "section").otherwise("article")
    varied = pages_.withColumn("html", F.replace(F.replace("html", F.lit("<article>"), F.concat(F.lit("<"), name, F.lit(">"))), F.lit("</article>"), F.concat(F.lit("</"), name, F.lit(">"))))
    return pages.content_root(varied).select("page_id", "tag")


@query
def body_text(spark, pages_decorated):
    return pages.body_text(pages_decorated)


@query
def cms_fingerprint(spark, pages_decorated):
    return pages.cms_fingerprint(pages_decorated)


@query
def language_id(spark, documents):
    return pages.language_id(documents, "text", "doc_id")


@query
def language_accuracy(spark, documents):
    guess = documents.select("lang", H.strip(F.col("text")).alias("text"), "doc_id")
    labelled = pages.language_id(documents, "text", "doc_id").join(guess.select("doc_id", "lang"), "doc_id")
    return labelled.groupBy("lang", "detected_language").agg(F.count("*").alias("docs"))


@query
def enrich_pages(spark, pages_decorated):
    return pages.enrich_pages(pages_decorated).select(
        "page_id", "url", "title", "meta_description", "body_text", "cms", "detected_language"
    )


# Authors

@query
def author_jsonld(spark, pages_decorated):
    return authors.author_jsonld(pages_decorated)


@query
def author_jsonld_odd(spark, pages_odd):
    return authors.author_jsonld(pages_odd)


@query
def author_meta(spark, pages_decorated):
    return authors.author_meta(pages_decorated)


@query
def author_byline(spark, pages_decorated):
    return authors.author_byline(pages_decorated)


@query
def page_author(spark, pages_decorated):
    return authors.page_author(pages_decorated)


@query
def clean_name(spark, documents):
    first = F.trim(F.regexp_extract("text", "^[^ ]+ [^ ]+", 0))
    kind = F.col("doc_id") % 4
    raw = F.when(kind == 0, F.concat(F.lit("By "), first)).when(kind == 1, F.concat(F.lit("author: "), first))
    names = documents.select("doc_id", raw.otherwise(first).alias("raw"))
    return authors.clean_names(names).select("doc_id", "name")


# E-mails

@query
def email_deobfuscate(spark, pages_):
    return emails.email_deobfuscate(pages_).select("page_id", "clear")


@query
def email_matches(spark, pages_decorated):
    return emails.email_matches(pages_decorated)


@query
def email_matches_documents(spark, documents):
    return emails.email_matches(documents, "doc_id", "text")


@query
def email_blocklist(spark, pages_decorated):
    return emails.email_blocklist(emails.email_matches(pages_decorated)).select("page_id", "start", "email")


@query
def email_score(spark, pages_decorated):
    kept = emails.email_blocklist(emails.email_matches(pages_decorated))
    return emails.email_score(kept).select("page_id", "start", "email", "score")


@query
def email_rank(spark, pages_decorated):
    return emails.email_rank(pages_decorated)


@query
def email_rank_documents(spark, documents):
    return emails.email_rank(documents, "doc_id", "text")


@query
def best_email(spark, pages_decorated):
    return emails.best_email(pages_decorated)


def _addresses(documents):
    found = emails.email_rank(documents, "doc_id", "text").select("email")
    return found.unionByName(found.select(F.concat("email", F.lit(".")).alias("email"))).distinct()


@query
def email_format(spark, documents):
    return email_checks.email_format(_addresses(documents))


@query
def email_mx(spark, documents, mx_snapshot):
    return email_checks.email_mx(email_checks.email_format(_addresses(documents)), mx_snapshot).select("email", "mx_valid")


@query
def email_verdict(spark, documents, mx_snapshot):
    found = _addresses(documents)
    probes = found.select("email", F.when(F.length("email") % 3 == 0, 250).otherwise(550).alias("code"))
    return email_checks.email_verdict(found, mx_snapshot, probes)


@query
def email_validate_bulk(spark, documents, mx_snapshot):
    found = _addresses(documents)
    return email_checks.email_validate_bulk(found.unionByName(found), mx_snapshot)


@query
def email_valid_backfill(spark, pages_decorated, mx_snapshot):
    found = E.tidy_address(F.col("email"))
    rows = emails.best_email(pages_decorated, "url").select("url", found.alias("email"), F.lit(None).cast("boolean").alias("email_valid"))
    return email_checks.email_valid_backfill(rows, email_checks.email_validate_bulk(rows, mx_snapshot))


# Classification

@query
def batch_assign(spark, pages):
    return classify.batch_assign(pages.select("page_id", "url"))


@query
def request_context(spark, pages_decorated):
    return classify.request_context(pages.page_facts(pages_decorated)).drop("page_id")


@query
def request_payload(spark, pages_decorated):
    contexts = classify.request_context(classify.batch_assign(pages.page_facts(pages_decorated)))
    schema = "array<struct<url:string,title:string,body_text:string>>"
    sites = classify.request_payload(contexts).select("batch_id", F.from_json("payload", schema).alias("s"))

    def chars(field):
        return F.aggregate("s", F.lit(0).cast("bigint"), lambda acc, x: acc + F.length(x[field]))

    return sites.select(
        "batch_id",
        F.size("s").cast("bigint").alias("sites"),
        chars("title").alias("title_chars"),
        chars("body_text").alias("body_chars"),
        F.array_join("s.url", " ").alias("urls"),
    )


@query
def reply_unfence(spark, replies):
    return classify.reply_unfence(replies)


@query
def reply_explode(spark, replies):
    return unpack(classify.reply_explode(replies)).drop("ai_error")


@query
def site_type_coerce(spark, reply_items):
    raw = reply_items.select("page_id", F.get_json_object("item", "$.site_type").alias("site_type"))
    return classify.site_type_coerce(raw)


@query
def confidence_clamp(spark, reply_items):
    return classify.confidence_clamp(reply_items).select("page_id", "confidence.*")


def _requests(pages):
    return pages.select(F.floor(F.col("page_id") / 10).alias("batch_id"), "url")


@query
def reply_gap_fill(spark, pages, replies):
    return unpack(classify.reply_gap_fill(_requests(pages), classify.reply_explode(replies)))


@query
def batch_error_spread(spark, pages, replies):
    return classify.batch_error_spread(_requests(pages), replies)


@query
def read_replies(spark, pages, replies):
    return unpack(classify.read_replies(_requests(pages), replies))


@query
def read_replies_odd(spark, pages, replies_odd):
    # Every site is asked for in two batches; nobody answers the second.
    asked = _requests(pages)
    return unpack(classify.read_replies(asked.unionByName(asked.withColumn("batch_id", F.col("batch_id") + 1_000_000)), replies_odd))


@query
def classify_sites(spark, pages_decorated):
    rows = classify.classify_sites(pages.page_facts(pages_decorated))
    return unpack(
        rows.select("page_id", "niche", "site_type", F.col("class_language").alias("language"),
                    F.col("class_author").alias("author"), "confidence")
    )


@query
def learned_classifier(spark, documents, labels):
    train = documents.join(labels, "doc_id").select("doc_id", "text", F.col("quality").cast("double").alias("label"))
    model = classify.train_classifier(train, features=1 << 12)
    return model.transform(documents).select("doc_id", F.col("prediction").cast("int").alias("quality"))


@query
def learned_classifier_report(spark, documents):
    """One row on a classifier that is trained, stored and read again: what it has answered, and whether it held on texts it never saw.

    It learns the language, since the texts' quality can hardly be told from single words.
    """
    place = scratch(spark)
    rows = documents.select("doc_id", "text", F.col("lang").alias("truth"))
    unseen = F.pmod(F.crc32(F.col("text").cast("binary")), F.lit(4)) == 0
    learned.LearnedClassifier.train(rows.where(~unseen), label="truth", features=1 << 12).save(place)
    answers = learned.LearnedClassifier.load(place).predict(rows)
    right = F.when(unseen, (F.col("label") == F.col("truth")).cast("double"))
    sure = F.when(unseen & F.col("truth").isNotNull(), F.col("confidence") / 100)
    return answers.agg(
        F.count("*").alias("documents"),
        F.count("label").alias("answered"),
        F.count_if(F.col("confidence").between(0, 100)).alias("within"),
        F.count("truth").alias("labelled"),
        (F.avg(right) >= 0.8).alias("accurate"),
        (F.abs(F.avg(right) - F.avg(sure)) <= 0.1).alias("calibrated"),
    )


# Results

def _crawled(pages_decorated):
    kind = F.col("page_id") % 5
    return pages_decorated.withColumn(
        "fetch_status", F.when(kind == 0, "FAILED").when(kind == 1, "TIMEOUT").otherwise("OK")
    ).withColumn("fetch_error", F.when(kind == 0, "HTTP 500").when(kind == 1, "Request timed out"))


def _results(pages_decorated, replies):
    answers = classify.read_replies(_requests(pages_decorated), replies)
    return profile.profile_sites(_crawled(pages_decorated), classified=answers)


@query
def author_precedence(spark, pages_decorated, replies):
    good, _ = crawl_log.fetch_split(profile.crawl_facts(_crawled(pages_decorated)))
    answers = classify.read_replies(_requests(pages_decorated), replies)
    return results.result_merge(good, answers).select("url", "author")


@query
def result_merge(spark, pages_decorated, replies):
    good, _ = crawl_log.fetch_split(profile.crawl_facts(_crawled(pages_decorated)))
    answers = classify.read_replies(_requests(pages_decorated), replies)
    return results.result_merge(good, answers).drop("email_valid")


@query
def failed_rows(spark, pages_decorated, replies):
    good, failed = crawl_log.fetch_split(profile.crawl_facts(_crawled(pages_decorated)))
    answers = classify.read_replies(_requests(pages_decorated), replies)
    return results.with_failed(results.result_merge(good, answers), failed).drop("email_valid")


@query
def site_results(spark, pages_decorated, replies, mx_snapshot):
    return profile.validate_rows(_results(pages_decorated, replies), mx_snapshot)


@query
def result_format(spark, pages_decorated, replies, mx_snapshot):
    return results.result_format(profile.validate_rows(_results(pages_decorated, replies), mx_snapshot))


@query
def csv_sink(spark, pages_decorated, replies, mx_snapshot):
    place = scratch(spark)
    shown = results.result_format(profile.validate_rows(_results(pages_decorated, replies), mx_snapshot))
    tables.csv_sink(shown, place)
    return spark.read.csv(place, header=True, escape='"').na.fill("")


@query
def result_rewrite(spark, pages_decorated, replies, mx_snapshot):
    """A run written twice, one emptied, and a rewrite that fails: readers see the last complete rows."""
    place = scratch(spark)
    rows = _results(pages_decorated, replies)
    tables.write_run(rows, place, "run")
    tables.write_run(rows, place, "emptied")
    tables.write_run(rows.where("false"), place, "emptied")
    tables.write_run(profile.validate_rows(tables.read_runs(spark, place, "run"), mx_snapshot), place, "run")
    broken = rows.withColumn("url", F.when(F.length("url") > 0, F.raise_error(F.lit("stopped half-way"))).otherwise(F.col("url")))
    try:
        tables.write_run(broken, place, "run")
    except Exception as exc:  # the error of the rows, from Spark
        if "stopped half-way" not in str(exc):
            raise
    tables.clean_runs(spark, place)
    return tables.read_runs(spark, place).drop("run_id")


@query
def run_stamp(spark, events):
    stamp = tables.run_stamp_of(F.col("ts"), "crawl")
    return events.groupBy(stamp.alias("run_id")).agg(F.count("*").alias("n"))


@query
def json_archive(spark, pages_decorated, replies):
    place = scratch(spark)
    rows = _results(pages_decorated, replies)
    tables.json_archive(rows, place)
    return spark.read.schema(rows.schema).json(place).drop("email_valid")


@query
def run_summary(spark, pages_decorated, replies):
    return results.run_summary(_results(pages_decorated, replies))


@query
def status_counts(spark, pages_decorated, replies):
    return results.status_counts(_results(pages_decorated, replies))


@query
def profile_sites(spark, pages_decorated, raw_urls, mx_snapshot):
    return profile.profile_sites(pages_decorated, raw_urls, mx_snapshot)


@query
def profile_crawl(spark, plain, rendered, mx_snapshot):
    log = plain.select(
        "url", F.lit(1).alias("attempt"), "status_code", F.lit(None).cast("string").alias("error_class"),
        F.timestamp_seconds("page_id").alias("ts"),
    )
    return profile.profile_crawl(log, plain, rendered, mx_snapshot)


@query
def outlinks(spark, pages_):
    return pages.outlinks(pages_)


@query
def outlink_totals(spark, pages_):
    return pages.outlink_totals(pages_)


# Streams

def _through_stream(spark, table, transform, place=None):
    """Store the table in the shared folder, stream it, and read what the stream wrote."""
    place = place or scratch(spark)
    table.write.parquet(f"{place}/in")
    stream = jobs.read_files(spark, f"{place}/in", table.schema)
    jobs.run_available(transform(stream), f"{place}/out", f"{place}/checkpoint")
    return spark.read.parquet(f"{place}/out")


@query
def stream_enrich(spark, pages):
    return _through_stream(spark, pages, jobs.stream_enrich).select(
        "page_id", "title", "body_text", "detected_language"
    )


@query
def stream_url_dedupe(spark, pages):
    # Every URL once more a year later
    year = F.explode(F.array(F.lit(0), F.lit(0), F.lit(31_622_400))).alias("later")
    sightings = pages.select("url", "page_id", year).select("url", F.timestamp_seconds(F.col("page_id") + F.col("later")).alias("ts"))
    return _through_stream(spark, sightings, jobs.stream_url_dedupe).select("url")


def _resolved_by_stream(spark, attempts):
    """What the stream settles, and what it has left open at its end."""
    place, year = scratch(spark), 366 * 86_400
    settled = _through_stream(
        spark, attempts, lambda s: jobs.stream_attempt_resolve(s, "40 days", timeout_s=year, keep_s=year), place
    )
    return settled.unionByName(jobs.flush_attempts(spark, f"{place}/checkpoint"))


@query
def stream_attempt_resolve(spark, attempts):
    return _resolved_by_stream(spark, attempts)


@query
def stream_attempt_resolve_any(spark, attempts_any):
    return _resolved_by_stream(spark, attempts_any)


@query
def stream_progress(spark, events):
    # Four batches, so that most windows are counted more than once.
    place = scratch(spark)
    events.repartition(4, "event_id").write.parquet(f"{place}/in")
    stream = jobs.read_files(spark, f"{place}/in", events.schema, files_per_trigger=1)
    jobs.follow_progress(jobs.stream_progress(stream, "event_type", delay="400 days"), f"{place}/out", f"{place}/checkpoint")
    counts = jobs.read_progress(spark, f"{place}/out", "event_type")
    return counts.select(F.col("start").cast("timestamp_ntz").alias("hour"), "event_type", "n")
