"""Finding sites in a crawl index or in archived search results."""

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import strip
from ..functions.urls import is_noise, url_origin
from ..lookups import GENERIC_QUERY_WORDS, WS
from ..session import broadcast_if_small, settled
from .ordered import top_per_key

MAX_PATTERNS = 6
GRAM = 4
PROVIDERS = {
    "commoncrawl": "index", "cc": "index",
    "duckduckgo": "links", "ddg": "links",
    "serpapi": "organic_results",
    "google_cse": "items", "cse": "items",
}


def query_patterns(queries: DataFrame, most: int = MAX_PATTERNS) -> DataFrame:
    """Keyword queries to at most `most` URL patterns each, most specific first.

    queries(query_id, query) -> (query_id, pattern_rank, pattern)
    """
    words = F.transform(
        F.filter(F.split(F.col("query"), f"{WS}+"), lambda w: F.length(w) > 3), F.lower
    )
    pairs = F.zip_with(
        "words",
        F.slice("words", 2, F.greatest(F.size("words") - 1, F.lit(0))),
        lambda a, b: F.concat(a, b),
    )
    chained = F.array(F.concat(F.lit("*"), F.array_join("words", "*"), F.lit("*")))
    joined = F.flatten(
        F.transform(
            F.filter(pairs, lambda p: p.isNotNull()),
            lambda p: F.array(F.concat(F.lit("*."), p, F.lit(".*")), F.concat(F.lit("*"), p, F.lit("*"))),
        )
    )
    single = F.flatten(
        F.transform(
            F.filter("words", lambda w: ~w.isin(*GENERIC_QUERY_WORDS)),
            lambda w: F.array(F.concat(F.lit("*"), w, F.lit("*blog*")), F.concat(F.lit("*"), w, F.lit("*"))),
        )
    )
    none = F.array().cast("array<string>")
    patterns = F.when(
        F.size("words") > 0,
        F.slice(F.array_distinct(F.concat(chained, joined, single)), 1, most),
    ).otherwise(none)
    return (
        queries.withColumn("words", words)
        .select("query_id", F.posexplode(patterns).alias("pattern_rank", "pattern"))
        .withColumn("pattern_rank", F.col("pattern_rank") + 1)
    )


def _like(pattern):
    """A glob as a LIKE pattern: `*` is the only wildcard."""
    return F.replace(F.regexp_replace(pattern, r"([\\%_])", r"\\$1"), F.lit("*"), F.lit("%"))


def _pieces(pattern, size):
    """All pieces of `size` characters of the pattern's literal parts; every match contains each of them."""
    parts = F.filter(F.split(pattern, r"\*"), lambda p: F.length(p) >= size)
    return F.array_distinct(F.flatten(F.transform(parts, lambda p: _grams(p, size))))


def _grams(url, size):
    starts = F.sequence(F.lit(1), F.length(url) - (size - 1))
    cut = F.array_distinct(F.transform(starts, lambda i: F.substring(url, i, F.lit(size))))
    return F.when(F.length(url) >= size, cut)


def _url_id(url):
    # Equal ids of different URLs do no harm: every hit is tested.
    return F.xxhash64(url)


def url_pieces(urls: DataFrame) -> DataFrame:
    """(piece, url_id): an inverted index of the four-character pieces of URLs. Nothing else of the rows is exploded."""
    return urls.select(_url_id(F.col("url")).alias("url_id"), F.explode(_grams(F.col("url"), GRAM)).alias("piece")).select("piece", "url_id")


def write_piece_index(urls: DataFrame, path: str) -> None:
    """Store the index of a crawl index for any number of searches: postings in the order of the pieces, and their counts.

    A search reads only the row groups that hold its pieces. A piece that all URLs share is spread over
    several files.
    """
    pieces = url_pieces(urls.select("url").distinct())
    pieces.repartitionByRange("piece", "url_id").sortWithinPartitions("piece", "url_id").write.mode("overwrite").parquet(f"{path}/postings")
    postings = urls.sparkSession.read.parquet(f"{path}/postings")
    postings.groupBy("piece").agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{path}/counts")


def chosen_pieces(patterns: DataFrame, counts: DataFrame) -> DataFrame:
    """(pattern, piece): for each pattern the piece of it that fewest URLs hold, by `counts(piece, n)`.

    A pattern with a piece that no URL holds has no match, and gives no row.
    """
    every = patterns.select("pattern", F.explode(_pieces(F.col("pattern"), GRAM)).alias("piece"))
    rarity = F.struct(F.coalesce("n", F.lit(0)).alias("n"), "piece")
    best = every.join(counts, "piece", "left").groupBy("pattern").agg(F.min(rarity).alias("best"))
    return best.where(F.col("best.n") > 0).select("pattern", F.col("best.piece").alias("piece"))


def match_patterns(urls: DataFrame, patterns: DataFrame, index: str | None = None) -> DataFrame:
    """Pairs of (pattern, row of `urls`) where the glob matches the whole URL.

    An equi-join on short pieces of text instead of testing every pattern on
    every URL: a pattern is looked up by the rarest piece all its matches must contain. Only pieces and
    ids of URLs meet the patterns; URLs themselves are fetched last, by id, and tested.
    `index` is where `write_piece_index` has stored the pieces of these URLs, if it has; otherwise
    those pieces that occur in any pattern are worked out and written once.

    Patterns whose literal parts are all shorter than a piece go a second
    way, by the pieces of their own length.
    """
    every = patterns.select("pattern").distinct()
    is_long = F.size(_pieces(F.col("pattern"), GRAM)) > 0
    usual, short = every.where(is_long), every.where(~is_long)
    if index is None:
        asked = usual.select(F.explode(_pieces(F.col("pattern"), GRAM)).alias("piece")).distinct()
        postings = settled(url_pieces(urls).join(broadcast_if_small(asked), "piece", "left_semi"))
        counts = postings.groupBy("piece").agg(F.count("*").alias("n"))
    else:
        postings, counts = (urls.sparkSession.read.parquet(f"{index}/{name}") for name in ("postings", "counts"))
    found = postings.join(chosen_pieces(usual, counts), "piece").select("pattern", "url_id").distinct()
    hits = urls.withColumn("url_id", _url_id(F.col("url"))).join(found, "url_id").drop("url_id")

    pieces = F.array_distinct(
        F.flatten(
            F.array(
                F.array(F.lit("")),
                *(
                    F.coalesce(_grams(F.col("url"), k), F.array().cast("array<string>"))
                    for k in range(1, GRAM)
                ),
            )
        )
    )
    parts = F.transform(F.split("pattern", r"\*"), lambda p: F.struct((-F.length(p)).alias("n"), p.alias("p")))
    keyed = broadcast_if_small(short.withColumn("_piece", F.array_min(parts)["p"]))
    hits = hits.unionByName(urls.withColumn("_piece", F.explode(pieces)).join(keyed, "_piece").drop("_piece"))
    return hits.where(F.like("url", _like(F.col("pattern"))))


def index_pattern_scan(url_index: DataFrame, patterns: DataFrame, n: int, index: str | None = None) -> DataFrame:
    """Up to `n` URLs per query, crawl index and pattern, in URL order.

    url_index(crawl_index, index_rank, url, status_code); only status 200 counts. `index` as for `match_patterns`.
    """
    good = url_index.where(F.col("status_code") == 200).select("crawl_index", "index_rank", "url")
    # Distinct patterns are matched and cut once, then handed to the queries that share them.
    hits = top_per_key(
        match_patterns(good, patterns, index), ["pattern", "crawl_index", "index_rank"], ["url"], n,
        "url_rank",
    )
    wanted = patterns.select("query_id", "pattern_rank", "pattern")
    return wanted.join(hits, "pattern").select(
        "query_id", "pattern_rank", "pattern", "crawl_index", "index_rank", "url_rank", "url"
    )


def index_first_hit(scan: DataFrame, n: int) -> DataFrame:
    """Per query: each pattern's newest index with hits, patterns taken until 2n
    URLs are held, then the first `n` URLs.
    """
    # A query holds at most six patterns times n URLs per index: a bounded group.
    # Spread by query once; both windows use that.
    newest = F.min("index_rank").over(W.partitionBy("query_id", "pattern_rank"))
    before = (
        W.partitionBy("query_id").orderBy("pattern_rank").rangeBetween(W.unboundedPreceding, -1)
    )
    held = (
        scan.repartition("query_id")
        .withColumn("_newest", newest)
        .where(F.col("index_rank") == F.col("_newest"))
        .withColumn("_held", F.count("*").over(before))
    )
    rank = F.col("_held") + F.col("url_rank")
    return (
        held.where((F.col("_held") < 2 * n) & (rank <= n))
        .select("query_id", rank.alias("rank"), "url")
    )


def noise_domain_filter(links: DataFrame, column: str = "href", mode: str = "contains") -> DataFrame:
    return links.where(~is_noise(F.col(column), mode))


def origin_dedupe(links: DataFrame, keys=(), rank: str = "rank") -> DataFrame:
    """Origins at their first rank (per key); links without any origin are dropped."""
    origin = links.withColumn("origin", url_origin(F.col("url"))).where(F.col("origin") != "://")
    return origin.groupBy(*keys, "origin").agg(F.min(rank).alias(rank))


def search_results_explode(pages: DataFrame, n: int, field: str = "organic_results") -> DataFrame:
    """Archived result pages to ranked links, first `n` per query.

    pages(query_id, page, json). All archived pages count. A page that cannot be read ends its query, as
    does the page on which `n` links are reached.
    """
    schema = f"{field} array<struct<link:string>>"
    read = pages.withColumn("ok", F.try_parse_json("json").isNotNull()).withColumn("links", F.from_json("json", schema)[field])
    broken = (
        read.where(~F.col("ok")).groupBy("query_id").agg(F.min("page").alias("_broken"))
    )
    links = (
        read.join(broken, "query_id", "left")
        .where(F.col("_broken").isNull() | (F.col("page") < F.col("_broken")))
        .select("query_id", "page", F.posexplode("links").alias("pos", "item"))
        .select("query_id", "page", "pos", F.col("item.link").alias("url"))
        .where(F.col("url") != "")
    )
    return top_per_key(links, ["query_id"], ["page", "pos"], n).select("query_id", "rank", "url")


def discover(source: DataFrame, n: int = 50, provider: str = "duckduckgo",
             queries: DataFrame | None = None) -> DataFrame:
    """Up to `n` site origins per query, best first: (query_id, rank, url).

    `source` is what the provider's archive holds: a crawl index (needs
    `queries`), ranked links (query_id, rank, href), or result pages. Twice as
    many raw links are taken, since origins repeat.
    """
    kind = PROVIDERS.get(provider.lower().strip())
    raw_n = 2 * n
    if kind is None:
        raise ValueError(f"unknown provider: {provider!r}; choose from {', '.join(PROVIDERS)}")
    if kind == "index":
        if queries is None:
            raise ValueError("a crawl index is searched by patterns: pass queries")
        raw = index_first_hit(index_pattern_scan(source, query_patterns(queries), raw_n), raw_n)
    elif kind == "links":
        # All archived links count: the noise is dropped, then cut.
        asked = source.where(strip(F.col("href")) != "")
        clean = noise_domain_filter(asked).select(
            "query_id", F.col("rank").alias("found_rank"), F.col("href").alias("url")
        )
        raw = top_per_key(clean, ["query_id"], ["found_rank", "url"], raw_n)
    else:
        raw = search_results_explode(source, raw_n, kind)
    origins = origin_dedupe(raw, ["query_id"])
    return top_per_key(
        origins.withColumnRenamed("rank", "first_rank"), ["query_id"], ["first_rank"], n
    ).select("query_id", "rank", F.col("origin").alias("url"))
