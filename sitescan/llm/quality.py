"""Importance resampling of documents towards good text.

Two bags of hashed n-grams (words and pairs of words) are counted: the target's, from
documents labelled good, and the raw text's, from all documents. A document's log weight is the sum
over its n-grams of the log ratio of their frequencies. Documents are sampled without
replacement in proportion to their weights by adding Gumbel noise and taking the k highest keys.
"""

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Plain, Words, scratch, slices, written

BUCKETS = 1 << 14
FIND = regex.compile(r"\w+|[^\w\s]+").findall
# A word that repeats the one before it counts as this token, whichever word it is.
AGAIN = np.uint64(0x9E3779B97F4A7C15)


def _hashes(words: list[str]) -> np.ndarray:
    """64-bit hashes of texts, the same on every machine."""
    from xxhash import xxh3_64_intdigest

    return np.array([xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) for w in words], np.uint64)


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * np.uint64(0xBF58476D1CE4E5B9) ^ (b + np.uint64(0x94D049BB133111EB)) * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x * np.uint64(0xD6E8FEB86659FD93)


def ngram_buckets(texts: pa.Array):
    """(buckets, owner): a bucket per word and per pair of neighbours, and the text each is from."""
    words = Words(FIND)
    codes, ends = words.codes(texts)
    token = _hashes(list(words.index))[codes] if len(codes) else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(texts)), np.diff(ends))
    inside = owner[1:] == owner[:-1]
    again = np.flatnonzero(inside & (codes[1:] == codes[:-1])) + 1
    token[again] = AGAIN
    pairs = _mixed(token[:-1], token[1:])[inside]
    shift = np.uint64(64 - (BUCKETS.bit_length() - 1))
    # Spread before taking the high bits, so that words and pairs fall evenly.
    spread = np.concatenate([token, pairs]) * np.uint64(0x9E3779B97F4A7C15)
    return (spread >> shift).astype(np.int32), np.concatenate([owner, owner[1:][inside]])


def count_ngrams(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(raw, target) counts per bucket over docs(text, good). Two numbers per bucket reach the driver."""

    def run(batches):
        total = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                buckets, owner = ngram_buckets(part.column("text"))
                good = part.column("good").to_numpy(zero_copy_only=False)
                total[0] += np.bincount(buckets, minlength=BUCKETS)
                total[1] += np.bincount(buckets[good[owner]], minlength=BUCKETS)
        seen = np.flatnonzero(total[0])
        yield pa.record_batch([pa.array(seen, pa.int32()), pa.array(total[0, seen]), pa.array(total[1, seen])], ["bucket", "raw", "target"])

    sums = docs.mapInArrow(run, "bucket int, raw bigint, target bigint").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for r in sums.collect():
        raw[r["bucket"]], target[r["bucket"]] = r["raw"], r["target"]
    return raw, target


def log_ratios(raw: np.ndarray, target: np.ndarray, prior: float = 20.0) -> np.ndarray:
    """Per bucket, the log of target's over raw's frequency; 0 everywhere if there is no target.

    Both counts are as if the target were as large as it is, with `prior` more n-grams at raw's rate:
    a bucket seldom met says little, however small the corpus.
    """
    if not target.sum():
        return np.zeros(len(raw))
    expected = raw * (target.sum() / raw.sum())
    return np.log(target + prior) - np.log(expected + prior)


def labelled(labels: DataFrame, most: int, id_col: str, good_col: str) -> DataFrame:
    """(_lid, good, held_out): of each class at most `most` ids, by hash; every fifth is held out of the target.

    An id labelled more than once is good if any label says so.
    """
    marks = labels.where(F.col(id_col).isNotNull() & F.col(good_col).isin(0, 1))
    marks = marks.groupBy(F.col(id_col).alias("_lid")).agg((F.max(good_col) == 1).alias("good"))
    order = [F.xxhash64("_lid"), F.col("_lid")]
    chosen = [marks.where(which).orderBy(*order).limit(most) for which in (F.col("good"), ~F.col("good"))]
    return chosen[0].unionByName(chosen[1]).withColumn("held_out", F.pmod(F.xxhash64(F.lit(3), "_lid"), F.lit(5)) == 0)


def weigh(docs: DataFrame, labels: DataFrame, most_labelled: int = 20_000, id_col="doc_id", text_col="text", good_col="quality") -> DataFrame:
    """`docs` with `log_weight` and `n_grams`, the number of n-grams that it is the sum over.

    The target is the documents that `labels` marks 1 but for every fifth, a sample by hash of
    their id of at most `most_labelled`; raw counts cover all documents. Null texts have no
    n-grams: their weight is 1 (log 0).
    """
    spark = docs.sparkSession
    plain = Plain(docs, id_col, text_col)
    marks = labelled(labels, most_labelled, id_col, good_col).where("good AND NOT held_out").select("_lid")
    text = F.coalesce("_text", F.lit("")).alias("text")
    marked = plain.rows.select("_id", text).join(F.broadcast(marks), F.col("_id") == F.col("_lid"), "left")
    ratios = log_ratios(*count_ngrams(marked.select("text", F.col("_lid").isNotNull().alias("good"))))
    table = spark.sparkContext.broadcast(ratios)

    def summed(texts: pa.Array) -> pa.Array:
        weights, sizes = [np.zeros(0)], [np.zeros(0, np.int64)]
        for part in slices(pa.record_batch([texts], ["text"]), "text"):
            buckets, owner = ngram_buckets(part.column(0))
            weights.append(np.bincount(owner, table.value[buckets], part.num_rows))
            sizes.append(np.bincount(owner, minlength=part.num_rows))
        return pa.StructArray.from_arrays([pa.array(np.concatenate(weights)), pa.array(np.concatenate(sizes))], ["w", "n"])

    rows = plain.rows.withColumn("_s", F.arrow_udf(summed, "struct<w:double,n:bigint>")(F.coalesce("_text", F.lit(""))))
    return plain.back(rows, log_weight=F.col("_s.w"), n_grams=F.col("_s.n"))


def draw(weighted: DataFrame, k: int, seed: int = 7, temperature: float = 1.0, keys=("doc_id", "text")) -> DataFrame:
    """`weighted` with draw_key and drawn: k rows, without replacement, in proportion to their importance.

    The importance of a row is exp(log_weight / sqrt(n_grams)): a sum over many n-grams spreads with the root of
    their number, so long and short texts compare, and no text is so heavy that chance has no say.
    The noise comes from a hash of `keys`, so rows alike in them are drawn or left together, beyond k if need be.
    The threshold needs the rows twice: hand in a written table.
    """
    names = {c: f"_c{i}" for i, c in enumerate(weighted.columns)}
    rows = weighted.select(*(F.col("`" + c.replace("`", "``") + "`").alias(n) for c, n in names.items()))
    scaled = F.col(names["log_weight"]) / F.sqrt(F.greatest(F.col(names["n_grams"]), F.lit(1)))
    key = scaled / temperature + gumbel(seed, F.lit("draw"), *(F.col(names[c]) for c in keys))
    rows = rows.withColumn("_draw", key)
    bound = kth_largest(rows.select("_draw"), k) if k else float("inf")
    back = [F.col(n).alias(c) for c, n in names.items() if c not in ("draw_key", "drawn")]
    return rows.select(*back, F.col("_draw").alias("draw_key"), (F.col("_draw") >= bound).alias("drawn"))


def gumbel(seed: int, *columns) -> Column:
    """Gumbel noise from a hash of the columns, the same whenever a row is computed again."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *columns), 11)
    uniform = (bits.cast("double") + 0.5) / F.lit(float(1 << 53))
    return -F.log(-F.log(uniform))


def kth_largest(values: DataFrame, k: int, bins: int = 4096, few: int = 10_000) -> float:
    """The k-th largest of a column of finite doubles, by counting in ever narrower bins.

    Only counts per bin, and at the end up to `few` values, reach the driver.
    """
    (name,) = values.columns
    x = F.col(name)
    found = values.agg(F.min(x).alias("low"), F.max(x).alias("high"), F.count(x).alias("n")).first()
    low, high, n = found["low"], found["high"], found["n"]
    if not n:
        return float("inf")
    k = min(k, n)
    inside = values
    while n > few and low < high:
        width = (high - low) / bins
        if not width or low + width == low:
            break
        place = F.least(F.floor((x - low) / width), F.lit(bins - 1))
        counts = inside.groupBy(place.alias("bin")).agg(F.count("*").alias("n"), F.min(x).alias("low"), F.max(x).alias("high")).orderBy(F.desc("bin")).collect()
        for row in counts:
            if k <= row["n"]:
                break
            k -= row["n"]
        low, high, n = row["low"], row["high"], row["n"]
        inside = inside.where((x >= low) & (x <= high))
    if low == high:
        return low
    if n > few:  # equal but for rounding
        return low
    return inside.orderBy(F.desc(name)).limit(k).collect()[-1][0]


def least_weight(good: np.ndarray, bad: np.ndarray, dear: float = 5.0) -> float:
    """The log weight that parts good from bad held-out documents at the least cost.

    A good document lost costs `dear` times as much as a bad one kept. Of a range of
    equal cost the middle is taken; without bad ones, three below the lowest good one.
    """
    if not len(bad) or not len(good):
        return float(good.min()) - 3 if len(good) else -np.inf
    points = np.unique(np.concatenate([good, bad]))
    points = np.concatenate([[points[0] - 6], points, [points[-1] + 6]])
    cuts = (points[1:] + points[:-1]) / 2
    cost = dear * np.searchsorted(np.sort(good), cuts) + len(bad) - np.searchsorted(np.sort(bad), cuts)
    return float(cuts[np.argmin(cost)])


def resample(
    docs: DataFrame, labels: DataFrame, k: int | None = None, temperature: float = 1.0, seed: int = 7, most_labelled: int = 20_000,
    id_col="doc_id", text_col="text", good_col="quality",
) -> DataFrame:
    """`docs` with log_weight, n_grams, gumbel_key and sampled, for the k documents with the highest keys.

    A key is the log weight and Gumbel noise, so documents are sampled in proportion to target over raw. Without `k`,
    as many are sampled as have at least the log weight that best parts the labelled good
    documents held out of the target from the bad ones (at most `most_labelled` ids of each, the lowest weight of an
    id that has several texts). These weights lie so far apart that chance only decides near the bound, as a filter
    wants it; `draw` samples where it should decide everywhere.
    `temperature` scales the noise. Rows of one id and text, null ids among them, share their noise and are
    sampled or left together, beyond k if need be. Columns of `docs` that have the name of a result are replaced.
    """
    spark = docs.sparkSession
    plain = Plain(weigh(docs, labels, most_labelled, id_col, text_col, good_col), id_col, text_col)
    weight = F.col(dict(plain.names)["log_weight"])
    # Written, so that the threshold and the decisions come from the same keys.
    keyed = plain.rows.withColumn("_key", weight + temperature * gumbel(seed, "_id", "_text"))
    keyed = written(keyed, scratch(spark, "quality-keys"))
    if k is None:
        marks = labelled(labels, most_labelled, id_col, good_col).where("NOT good OR held_out")
        seen = keyed.join(F.broadcast(marks), F.col("_id") == F.col("_lid")).groupBy("_id", "good").agg(F.min(weight).alias("w"))
        found = seen.select("good", "w").collect()
        parted = [np.array([r["w"] for r in found if r["good"] == g]) for g in (True, False)]
        k = keyed.where(weight >= least_weight(*parted)).count()
    bound = kth_largest(keyed.select("_key"), k) if k else float("inf")
    return plain.back(keyed, gumbel_key=F.col("_key"), sampled=F.col("_key") >= bound)
