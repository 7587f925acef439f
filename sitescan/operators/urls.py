"""From raw cells to a clean list of URLs."""

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.urls import normalize_url


def url_normalize(raw: DataFrame, column: str = "raw", strict_host: bool = False) -> DataFrame:
    """Usable URLs; rows without one are dropped. Other columns stay."""
    url = normalize_url(F.col(column), strict_host)
    return raw.withColumn("url", url).where(F.col("url").isNotNull())


def url_dedupe(urls: DataFrame, pos: str = "pos") -> DataFrame:
    """One row per exact URL, at its first position. Repeats are merged before the shuffle."""
    return urls.groupBy("url").agg(F.min(pos).alias(pos))


def url_load_audit(raw: DataFrame, column: str = "raw") -> DataFrame:
    """Unique, invalid and duplicate counts of a load, as one row.

    Counted in two steps (per URL, then overall), so a URL that fills a third
    of the file is merged before anything is shuffled.
    """
    per_url = (
        raw.select(normalize_url(F.col(column)).alias("url")).groupBy("url").agg(F.count("*").alias("n"))
    )
    valid = F.col("url").isNotNull()
    return per_url.agg(
        F.count_if(valid).alias("unique_urls"),
        F.coalesce(F.sum(F.when(~valid, F.col("n"))), F.lit(0)).alias("invalid"),
        F.coalesce(F.sum(F.when(valid, F.col("n") - 1)), F.lit(0)).alias("duplicates"),
    )


class LoadCounts:
    """Counts of a load, taken while it runs. They are there once its rows have been used."""

    def __init__(self):
        self.read, self.kept = Observation(), Observation()

    def get(self) -> dict[str, int]:
        """unique_urls, invalid, duplicates; waits for the load to be used."""
        read, kept = ({"rows": 0, "invalid": 0} | self._of(x) for x in (self.read, self.kept))
        valid = read["rows"] - read["invalid"]
        return {"unique_urls": kept["rows"], "invalid": read["invalid"], "duplicates": valid - kept["rows"]}

    @staticmethod
    def _of(observation) -> dict[str, int]:
        try:
            return observation.get
        except Py4JJavaError:
            # Where Spark knows that there are no rows it leaves out the plan with its counts, which gives no row of them.
            return {}


def url_load(raw: DataFrame, column: str = "raw", pos: str = "pos") -> tuple[DataFrame, LoadCounts]:
    """`url_dedupe` of `url_normalize`, and its audit without a second pass.

    The counts are observed on the rows as they pass, before and after repeats are merged. They count
    the first use of the rows.
    """
    counts = LoadCounts()
    url = raw.select(normalize_url(F.col(column)).alias("url"), pos)
    invalid = F.coalesce(F.count_if(F.col("url").isNull()), F.lit(0))
    seen = url.observe(counts.read, F.count(F.lit(1)).alias("rows"), invalid.alias("invalid"))
    once = url_dedupe(seen.where(F.col("url").isNotNull()), pos)
    return once.observe(counts.kept, F.count(F.lit(1)).alias("rows")), counts


def url_merge(urls: DataFrame, discovered: DataFrame) -> DataFrame:
    """Append the discovered URLs that are not in the list yet. Both sides: url, pos.

    One aggregate over both lists: a URL keeps its place in the first list if
    it has one. Repeats are merged before the shuffle, so no URL can be hot.
    """
    none = F.lit(None).cast("bigint")
    listed = urls.select("url", F.col("pos").cast("bigint").alias("listed"), none.alias("found"))
    found = discovered.select("url", none.alias("listed"), F.col("pos").cast("bigint").alias("found"))
    merged = listed.unionByName(found).groupBy("url").agg(F.min("listed").alias("listed"), F.min("found").alias("found"))
    shift = urls.agg(F.coalesce(F.max("pos"), F.lit(-1)) + 1).scalar()
    return merged.select("url", F.coalesce(F.col("listed"), F.col("found") + shift).alias("pos"))
