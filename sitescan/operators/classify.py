"""Classification: requests, replies, and a scorer that runs inside Spark."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import replies as R
from ..functions.labels import best_label, language_name, tokens
from ..lookups import NICHE_WORDS, SITE_TYPE_WORDS
from ..session import restored
from .ordered import with_row_index

BATCH_SIZE = 10
CONTEXT_FIELDS = (
    "url", "title", "description", "body_text", "cms",
    "detected_language_hint", "rule_based_author_hint",
)
# What `classify_sites` adds.
CLASS_COLUMNS = ("niche", "site_type", "class_language", "class_author", "confidence", "ai_error")
# How sure a rule-based author is, by the place it was found in.
AUTHOR_CONFIDENCE = (("jsonld", 95), ("meta", 85), ("byline", 60))


def batch_assign(sites: DataFrame, size: int = BATCH_SIZE, chunks: int | None = None, key: str = "page_id") -> DataFrame:
    """Adds batch_id: groups of `size` in URL order, the last may be short.

    Pages of one URL are sites of their own, in the order of their `key`; without such a column a URL
    is one site. Only URLs and keys are numbered, chunk by chunk, so no task sorts all sites and
    nothing else of the sites is worked out for it.
    """
    if not 1 <= size <= 20:
        raise ValueError(f"batch size must be from 1 to 20, not {size}")
    order = ["url", key] if key in sites.columns else ["url"]
    numbered = with_row_index(sites.select(*order).distinct(), order, "_row", chunks)
    batches = numbered.select(*(F.col(c).alias(f"_{c}") for c in order), F.floor(F.col("_row") / size).alias("batch_id"))
    # A key may be NULL, a URL may not.
    same = [F.col("url") == F.col("_url"), *(F.col(c).eqNullSafe(F.col(f"_{c}")) for c in order[1:])]
    return sites.join(batches, same).select(*order[:1], *(c for c in sites.columns if c != "url"), "batch_id")


def request_context(facts: DataFrame) -> DataFrame:
    """The seven fields a classifier gets to see, cut to size."""

    def cut(column, size):
        return F.substring(F.coalesce(F.col(column), F.lit("")), 1, size)

    extra = [c for c in ("batch_id", "page_id") if c in facts.columns]
    return facts.select(
        *extra,
        "url",
        cut("title", 200).alias("title"),
        cut("meta_description", 300).alias("description"),
        cut("body_text", 2500).alias("body_text"),
        "cms",
        F.col("detected_language").alias("detected_language_hint"),
        F.col("author").alias("rule_based_author_hint"),
    )


def request_payload(contexts: DataFrame) -> DataFrame:
    """One JSON array per batch, with each URL once; of several contexts of a URL the smallest is sent.

    Copies of a URL meet before the batch does, so a batch is bounded by its size.
    """
    rest = [c for c in CONTEXT_FIELDS if c != "url"]
    once = contexts.groupBy("batch_id", "url").agg(F.min(F.struct(*rest)).alias("_c")).select("batch_id", "url", "_c.*")
    items = F.array_sort(F.collect_list(F.struct(*CONTEXT_FIELDS)))
    return once.groupBy("batch_id").agg(
        F.to_json(items, {"ignoreNullFields": "false"}).alias("payload")
    )


def reply_unfence(replies: DataFrame) -> DataFrame:
    return replies.withColumn("reply", R.unfence(F.col("reply")))


def reply_explode(replies: DataFrame) -> DataFrame:
    """One row per object of a usable reply.

    replies(batch_id, reply) -> (batch_id, pos, url, niche, site_type, language,
    author, confidence, ai_error). A field of a wrong type spoils only its own row; a
    repeated key or a number that is none spoils nothing.
    """
    return _exploded(_read(replies))


def _read(replies: DataFrame) -> DataFrame:
    """Adds _value, the reply as a variant, read once."""
    return replies.withColumn("_value", R.reply_value(F.col("reply")))


def _exploded(read: DataFrame) -> DataFrame:
    items = F.try_variant_get("_value", "$", "array<variant>")
    rows = read.select("batch_id", F.posexplode(items).alias("pos", "item")).where(
        R.kind_of(F.col("item")).startswith("OBJECT")
    )
    item = F.col("item")
    sound = (
        R.is_text_or_null(item, "niche")
        & R.is_text_or_null(item, "language")
        & R.is_text_or_null(item, "author")
    )
    return rows.select(
        "batch_id",
        "pos",
        F.coalesce(R.text_field(item, "url"), F.lit("")).alias("url"),
        R.text_field(item, "niche").alias("niche"),
        R.site_type(F.try_variant_get(item, "$.site_type", "string")).alias("site_type"),
        R.text_field(item, "language").alias("language"),
        R.text_field(item, "author").alias("author"),
        R.confidence(item).alias("confidence"),
        F.when(~sound, R.BAD_ITEM).alias("ai_error"),
    )


def site_type_coerce(rows: DataFrame, column: str = "site_type") -> DataFrame:
    return rows.withColumn(column, R.site_type(F.col(column)))


def confidence_clamp(items: DataFrame, column: str = "item") -> DataFrame:
    """Adds confidence, from a JSON object as text."""
    return items.withColumn("confidence", R.confidence(F.try_parse_json(column)))


def batch_errors(replies: DataFrame) -> DataFrame:
    """(batch_id, batch_error), NULL where the reply can be read.

    A column `error`, if there is one, holds the reason why a call has failed; it comes first.
    """
    return _errors(_read(replies))


def _errors(read: DataFrame) -> DataFrame:
    error = R.reply_error(F.col("reply"), F.col("_value"))
    if "error" in read.columns:
        error = F.coalesce(F.when(F.col("error") != "", F.col("error")), error)
    return read.select("batch_id", error.alias("batch_error"))


def batch_error_spread(requests: DataFrame, replies: DataFrame) -> DataFrame:
    """(batch_id, url, batch_error): a batch's error goes to every site of the batch."""
    errors = batch_errors(replies).withColumn("_answered", F.lit(True))
    return requests.select("batch_id", "url").join(errors, "batch_id", "left").select(
        "batch_id", "url",
        F.when(F.col("_answered").isNull(), R.NO_REPLY).otherwise(F.col("batch_error")).alias("batch_error"),
    )


def reply_gap_fill(requests: DataFrame, items: DataFrame) -> DataFrame:
    """One classification per requested site.

    The last object for a URL wins; URLs nobody asked for are dropped; sites
    without an object are reported as missing.
    """
    fields = ["niche", "site_type", "language", "author", "confidence", "ai_error"]
    last = items.groupBy("batch_id", "url").agg(F.max_by(F.struct(*fields), "pos").alias("c"))
    zero = F.struct(*(F.lit(0).alias(s) for s in R.SCORES))
    missing = F.col("c").isNull()
    return requests.select("batch_id", "url").join(last, ["batch_id", "url"], "left").select(
        "batch_id",
        "url",
        "c.niche",
        F.coalesce("c.site_type", F.lit("Unknown")).alias("site_type"),
        "c.language",
        "c.author",
        F.coalesce("c.confidence", zero).alias("confidence"),
        F.when(missing, R.MISSING_ITEM).otherwise(F.col("c.ai_error")).alias("ai_error"),
    )


def read_replies(requests: DataFrame, replies: DataFrame) -> DataFrame:
    """Replies to classifications, whole-batch errors included: one row per URL.

    Of a URL that was requested in several batches an answer without an error counts, of several the
    one in the last batch. replies may have a column `error`, see `batch_errors`.
    """
    read = _read(replies)
    asked = requests.select("batch_id", "url").distinct()
    errors = _errors(read).withColumn("_answered", F.lit(True))
    error = F.when(F.col("_answered").isNull(), R.NO_REPLY).otherwise(F.col("batch_error"))
    fields = ["niche", "site_type", "language", "author", "confidence", "ai_error"]
    rows = reply_gap_fill(asked, _exploded(read)).join(errors, "batch_id", "left").withColumn("ai_error", F.coalesce(error, "ai_error"))
    best = F.min_by(F.struct(*fields), F.struct(F.col("ai_error").isNotNull(), -F.col("batch_id")))
    return rows.groupBy("url").agg(best.alias("_c")).select("url", "_c.*")


def classify_sites(facts: DataFrame, site_types=SITE_TYPE_WORDS, niches=NICHE_WORDS) -> DataFrame:
    """Adds a classification to every row, scored by word lists over whole texts. No shuffle.

    niche, site_type, class_language, class_author, confidence, ai_error.
    """
    body = "full_text" if "full_text" in facts.columns else "body_text"
    text = F.concat_ws(" ", "url", "title", "meta_description", body)
    source = F.col("author_source")
    certainty = F.coalesce(*(F.when(source == s, F.lit(c)) for s, c in AUTHOR_CONFIDENCE), F.lit(0))

    def score(guess):
        return F.coalesce(F.col(guess)["confidence"], F.lit(0))

    return (
        facts.withColumn("_words", tokens(text))
        .withColumn("_type", best_label(F.col("_words"), site_types))
        .withColumn("_niche", best_label(F.col("_words"), niches))
        .withColumn("niche", F.col("_niche.label"))
        .withColumn("site_type", F.coalesce("_type.label", F.lit("Unknown")))
        .withColumn("class_language", language_name(F.col("detected_language")))
        .withColumn("class_author", F.col("author"))
        .withColumn(
            "confidence",
            F.struct(
                score("_niche").alias("niche"),
                score("_type").alias("site_type"),
                F.coalesce("language_confidence", F.lit(0)).alias("language"),
                certainty.alias("author"),
            ),
        )
        .withColumn("ai_error", F.lit(None).cast("string"))
        .drop("_words", "_type", "_niche")
    )


def train_classifier(texts: DataFrame, text: str = "text", label: str = "label", features: int = 1 << 16):
    """A learned alternative to the word lists: TF-IDF and logistic regression from MLlib."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import HashingTF, IDF, RegexTokenizer

    model = Pipeline(
        stages=[
            RegexTokenizer(inputCol=text, outputCol="words", pattern=r"[^\p{L}\p{N}]+"),
            HashingTF(inputCol="words", outputCol="counts", numFeatures=features),
            IDF(inputCol="counts", outputCol="features"),
            LogisticRegression(featuresCol="features", labelCol=label, maxIter=20),
        ]
    ).fit(texts.select(text, label))
    return restored(model, texts.sparkSession)
