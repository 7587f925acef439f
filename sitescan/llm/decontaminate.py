"""Benchmark passages in documents, found by spaced seeds and verified word by word.

A seed is a window of words of which only some places count. All windows of
documents and of benchmark items are hashed under every mask; equal hashes
give a document, an item and the shift between them. Only hashes, ids and places meet; the texts of documents
with a hit are fetched after that. Along the shift the item's words are compared with the document's, so
replaced words do not hide a leak.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import broadcast_if_small
from .shared import Plain, remove, scratch, written

# Places that count, from the window's first word on. Wherever a fifth of ten to twenty words is
# replaced, one of these windows is untouched; a test goes through all ways to replace them.
MASKS = ((0, 1, 2, 3, 4), (0, 1, 2, 4, 5), (0, 1, 4, 6, 7))
SHORTEST = max(len(m) for m in MASKS)
# Items of fewer words have to be equal in all of them.
TOLERANT = 10
WINDOW = 20
LEAST = 0.8


def words(text: Column) -> Column:
    """Runs of letters, marks and digits, in lower case; none for a null text."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{M}\p{N}]+"), F.lit(0))


def seeds(tokens: str, at: str) -> Column:
    """The hashes of the windows that begin at place `at`, one per mask whose window fits."""
    whole = F.size(tokens)
    each = (
        F.when(F.col(at) + m[-1] < whole, F.xxhash64(F.lit(i), *(F.get(tokens, F.col(at) + o) for o in m))) for i, m in enumerate(MASKS)
    )
    return F.array(*each)


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, least: float = LEAST,
    id_col="doc_id", text_col="text", item_col="item_id", item_text_col="text",
) -> DataFrame:
    """doc_id, text_hash, item_id, shift, n_words, n_equal: one row per document, item and shift that share a passage.

    They share one if among `window` words in a row of the item (all of it, if
    shorter) at least the part `least` equals the document's words at the same
    places; n_words and n_equal are of the best such window, and `shift` is where
    in the document the item would begin. Items of five to nine words have to be there word by word; shorter ones
    prove nothing and are left out, as are null ids of items. Null texts hold no words. Documents that repeat an id are told
    apart by `text_hash`; equal rows give one row. Every passage with `window` = 20 and `least` = 0.8
    or more is found; for smaller parts one that no seed reaches may be missed.
    """
    spark = docs.sparkSession
    items = (
        benchmark.select(F.col(item_col).alias("item_id"), words(F.col(item_text_col)).alias("item"))
        .where((F.size("item") >= SHORTEST) & F.col("item_id").isNotNull())
        .withColumn("item_key", F.xxhash64("item"))
        .distinct()
    )
    planted = items.select("item_id", "item_key", "item", F.posexplode("item").alias("item_at", "_w")).select(
        "item_id", "item_key", "item_at", F.explode(seeds("item", "item_at")).alias("seed")
    ).where(F.col("seed").isNotNull())
    slim = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_hash"), F.col(text_col).alias("text"))
    windows = slim.select("doc_id", "text_hash", words(F.col("text")).alias("doc")).select(
        "doc_id", "text_hash", "doc", F.posexplode("doc").alias("at", "_w")
    ).select("doc_id", "text_hash", "at", F.explode(seeds("doc", "at")).alias("seed"))
    met = windows.join(broadcast_if_small(planted), "seed")
    place = scratch(spark, "seed-hits")
    hits = written(met.select("doc_id", "text_hash", "item_id", "item_key", (F.col("at") - F.col("item_at")).alias("shift")).distinct(), place)

    found = hits.select(F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_hash")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("text_hash") == F.col("_hash"))
    texts = slim.join(broadcast_if_small(found), same, "left_semi").select(
        F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_hash"), words(F.col("text")).alias("doc")
    )
    both = texts.join(broadcast_if_small(hits), same).join(broadcast_if_small(items), ["item_id", "item_key"])
    # The item's words as the document has them; places outside the document are null.
    seen = F.transform("item", lambda w, k: (w == _word("doc", F.col("shift") + k)))
    equal = F.transform(seen, lambda e: F.coalesce(e, F.lit(False)).cast("int"))
    best = F.array_max(
        F.transform(
            F.sequence(F.lit(0), F.size("equal") - F.col("n_words")),
            lambda s: F.aggregate(F.slice("equal", s + 1, F.col("n_words")), F.lit(0), lambda a, b: a + b),
        )
    )
    enough = F.when(F.col("n_words") < TOLERANT, F.col("n_words")).otherwise(F.ceil(F.col("n_words") * least))
    leaks = (
        both.select("doc_id", "text_hash", "item_id", "shift", equal.alias("equal"), F.least(F.lit(window), F.size("item")).alias("n_words"))
        .select("doc_id", "text_hash", "item_id", "shift", "n_words", best.alias("n_equal"))
        .where(F.col("n_equal") >= enough)
        .dropDuplicates(["doc_id", "text_hash", "item_id", "shift"])
    )
    leaks = written(leaks, scratch(spark, "leaks"))
    remove(spark, place)
    return leaks


def _word(tokens: str, at: Column) -> Column:
    return F.when(at >= 0, F.get(tokens, at))


def drop_leaks(docs: DataFrame, benchmark: DataFrame, id_col="doc_id", text_col="text", **options) -> DataFrame:
    """`docs` without the rows that share a passage with an item of `benchmark`; all columns stay."""
    found = find_leaks(docs, benchmark, id_col=id_col, text_col=text_col, **options)
    found = found.select(F.col("doc_id").alias("_leak_doc"), F.col("text_hash").alias("_leak_text")).distinct()
    plain = Plain(docs, id_col, text_col)
    same = F.col("_id").eqNullSafe(F.col("_leak_doc")) & (F.xxhash64("_text") == F.col("_leak_text"))
    return plain.back(plain.rows.join(found, same, "left_anti"))
