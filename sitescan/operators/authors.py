"""Author per page, by place and overall."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import authors as A
from .pages import with_nodes


def _author(pages, *places):
    name = F.coalesce(*(place(F.col("nodes")) for place in places))
    return with_nodes(pages).select("page_id", name.alias("author"))


def author_jsonld(pages: DataFrame) -> DataFrame:
    return _author(pages, A.author_from_jsonld)


def author_meta(pages: DataFrame) -> DataFrame:
    return _author(pages, A.author_from_meta)


def author_byline(pages: DataFrame) -> DataFrame:
    return _author(pages, A.author_from_byline)


def page_author(pages: DataFrame) -> DataFrame:
    """The first place that yields a clean name; later places are not even looked at."""
    return _author(pages, A.author_from_jsonld, A.author_from_meta, A.author_from_byline)


def clean_names(names: DataFrame, column: str = "raw", unicode_split: bool = False) -> DataFrame:
    return names.withColumn("name", A.clean_name(F.col(column), unicode_split))
