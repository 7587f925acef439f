"""Reading URL lists and writing results."""

import csv
import time
import uuid
import warnings
from datetime import datetime
from functools import reduce
from urllib.parse import quote, unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.urls import normalize_url
from ..lookups import URL_COLUMNS
from ..session import spread

DELIMITERS = (",", ";", "\t", "|")


def url_column(columns) -> str:
    """The column that holds URLs: by exact name, then by any case, else the first, with a warning."""
    exact = [c for c in URL_COLUMNS if c in columns]
    lower = {c.lower(): c for c in columns}
    loose = [lower[c.lower()] for c in URL_COLUMNS if c.lower() in lower]
    found = exact + loose
    if not found:
        warnings.warn(f"no column of URLs among {', '.join(columns)}: the first one is taken", stacklevel=2)
    return (found + list(columns))[0]


def _delimiter(header: str) -> str:
    """Comma if the header has one; else the mark it has most of."""
    if "," in header:
        return ","
    return max(DELIMITERS, key=header.count)


def _names(header: str, sep: str) -> list[str]:
    """Column names of a header, each once."""
    names = []
    for i, name in enumerate(next(csv.reader([header], delimiter=sep))):
        name = name.strip() or f"_c{i}"
        while name in names:
            name += f"_{i}"
        names.append(name)
    return names


def csv_headers(spark: SparkSession, path: str) -> DataFrame:
    """file, header, split: each file's first line that is not empty, and whether a quoted cell holds a line break.

    One pass over the lines, merged per file before the shuffle.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"))
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    first = F.min_by("value", F.struct("at", "line"))
    return (
        lines.withColumn("line", F.monotonically_increasing_id())
        .withColumn("at", F.col("_metadata.file_block_start"))
        .where(F.trim("value") != "")
        .groupBy("file")
        .agg(first.alias("header"), F.coalesce(F.bool_or(quotes % 2 == 1), F.lit(False)).alias("split"))
    )


def _csv_groups(spark: SparkSession, path: str):
    """(files, header, split) for files that can be read alike. Headers are few, so they come to the driver; files come as a list."""
    rows = csv_headers(spark, path).groupBy("header", "split").agg(F.sort_array(F.collect_list("file")).alias("files"))
    found = rows.orderBy(F.col("files")[0]).collect()
    # Names come as parts of a URI.
    return [([unquote(f) for f in r["files"]], r["header"].removeprefix("\ufeff"), r["split"]) for r in found]


def _read_csv(spark, files, header, split, sep, ragged) -> tuple[DataFrame, str]:
    sep = sep or _delimiter(header)
    names = _names(header, sep)
    # By place, since names of a header may be anything.
    schema = ", ".join([*(f"c{i} string" for i in range(len(names))), "corrupt string"])
    table = spark.read.schema(schema).csv(
        files, header=True, sep=sep, quote='"', escape='"', multiLine=split, columnNameOfCorruptRecord="corrupt", mode="PERMISSIVE"
    )
    columns = [F.col(f"c{i}").alias(name) for i, name in enumerate(names)]
    if ragged:
        columns.append(F.col("corrupt").alias(ragged))
    return table.select(*columns), url_column(names)


def url_scan(spark: SparkSession, path: str, format: str = "csv", sep: str | None = None,
             keep_columns: bool = False, ragged: str | None = None) -> DataFrame:
    """(pos, raw) from CSV files with a header each, or from a parquet table; all cells are text.

    Files of a folder may have different headers, separators and columns of URLs. Quoted cells may
    hold line breaks: files that have some are read as a whole, all others in pieces. `keep_columns`
    passes the other columns through, with NULL for files that lack them. `ragged` names a column that holds
    the text of rows with more or fewer cells than their header; they are kept in any case. `pos`
    follows the order of rows within a file. A missing or an empty input and one without any valid URL are errors.
    """
    try:
        if format == "parquet":
            table = spark.read.parquet(path)
            parts = [(table, url_column(table.columns))]
        else:
            parts = [_read_csv(spark, *group, sep, ragged) for group in _csv_groups(spark, path)]
    except AnalysisException as exc:
        if "PATH_NOT_FOUND" in str(exc):
            raise FileNotFoundError(path) from exc
        raise ValueError(f"cannot read {path}: {exc}") from exc
    if not parts:
        raise ValueError(f"{path} is empty")

    def named(table, url):
        other = [F.col(f"`{c.replace('`', '``')}`") for c in table.columns if c == ragged or keep_columns and c != url]
        return table.select(F.col(f"`{url.replace('`', '``')}`").cast("string").alias("raw"), *other)

    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [named(*p) for p in parts])
    if rows.where(normalize_url(F.col("raw")).isNotNull()).isEmpty():
        raise ValueError(f"{path} has no valid URL")
    return rows.select(F.monotonically_increasing_id().alias("pos"), "*")


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """A parquet table of pages or texts, in enough pieces to keep all cores busy."""
    return spread(spark.read.parquet(path))


STAMP = "%Y-%m-%d_%H%M%S"


def run_stamp(prefix: str = "results", at: datetime | None = None) -> str:
    """`prefix_YYYY-MM-DD_HHMMSS`, the name of a run."""
    return f"{prefix}_{at or datetime.now():{STAMP}}"


def run_stamp_of(at, prefix: str = "results") -> Column:
    """The same for a column of times."""
    return F.concat(F.lit(f"{prefix}_"), F.date_format(at, "yyyy-MM-dd_HHmmss"))


# A run's rows lie in rows/run_id=…/version=…; commits holds a line for each version that is complete.
COMMIT_TYPE = "run_id string, version string, rows bigint"


def write_run(rows: DataFrame, path: str, run_id: str) -> int:
    """Put a run's rows in a new version of the run, and make it the one that counts; returns their number.

    The version is written first and committed by one line after that, so readers (`read_runs`) see the old
    rows until all new ones are there, and go on seeing them if the write fails. Rows are
    counted as they are written. Other runs are not touched.
    """
    version = f"{time.time_ns() // 1000:020d}-{uuid.uuid4().hex[:8]}"
    seen = Observation()
    counted = rows.drop("run_id", "version").observe(seen, F.count(F.lit(1)).alias("rows"))
    counted.write.parquet(f"{path}/rows/run_id={quote(run_id, safe='')}/version={version}")
    number = seen.get["rows"]
    commit = rows.sparkSession.createDataFrame([(run_id, version, number)], COMMIT_TYPE)
    commit.coalesce(1).write.mode("append").json(f"{path}/commits")
    return number


def committed_runs(spark: SparkSession, path: str) -> DataFrame:
    """run_id, version, rows: the newest complete version of every run."""
    commits = spark.read.schema(COMMIT_TYPE).json(f"{path}/commits")
    return commits.groupBy("run_id").agg(F.max("version").alias("version"), F.max_by("rows", "version").alias("rows"))


def read_runs(spark: SparkSession, path: str, *run_ids: str) -> DataFrame:
    """The rows of all runs, or of those named, with `run_id`. A run without a commit has no rows."""
    runs = committed_runs(spark, path)
    if run_ids:
        runs = runs.where(F.col("run_id").isin(*run_ids))
    # One line per run
    places = [f"{path}/rows/run_id={quote(r['run_id'], safe='')}/version={r['version']}" for r in runs.collect()]
    if not places:
        raise FileNotFoundError(f"no such run in {path}")
    reader = spark.read.option("basePath", f"{path}/rows").option("mergeSchema", True)
    schema = reader.parquet(*places).schema
    # Names of runs are text, also where they look like numbers.
    names = StructType([f if f.name not in ("run_id", "version") else StructField(f.name, StringType()) for f in schema])
    return reader.schema(names).parquet(*places).drop("version")


def clean_runs(spark: SparkSession, path: str) -> int:
    """Remove versions that no reader follows any more: replaced ones and those that were never completed. Returns their number.

    Not for a time when runs are being written or read.
    """
    kept = {(quote(r["run_id"], safe=""), r["version"]) for r in committed_runs(spark, path).collect()}
    root = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/rows")
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    gone = 0
    for found in files.globStatus(spark._jvm.org.apache.hadoop.fs.Path(root, "run_id=*/version=*")):
        place = found.getPath()
        run = place.getParent().getName().removeprefix("run_id=")
        if (run, place.getName().removeprefix("version=")) not in kept:
            files.delete(place, True)
            gone += 1
    return gone


def csv_sink(formatted: DataFrame, path: str) -> int:
    """Append to a folder of CSV files, each with a header; returns the number of rows. Nothing is written for no rows.

    The input runs once: rows are counted as they are written to a folder beside, whose files move into place at the end.
    """
    spark = formatted.sparkSession
    seen = Observation()
    staged = f"{path.rstrip('/')}.staged-{uuid.uuid4()}"
    counted = formatted.observe(seen, F.count(F.lit(1)).alias("rows"))
    counted.write.option("header", True).option("escape", '"').csv(staged)
    number = seen.get["rows"]
    place = spark._jvm.org.apache.hadoop.fs.Path(staged)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if number:
        files.mkdirs(spark._jvm.org.apache.hadoop.fs.Path(path))
        for part in files.globStatus(spark._jvm.org.apache.hadoop.fs.Path(place, "part-*")):
            files.rename(part.getPath(), spark._jvm.org.apache.hadoop.fs.Path(path, part.getPath().getName()))
    files.delete(place, True)
    return number


def json_archive(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").option("ignoreNullFields", False).json(path)


def union_all(tables) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), tables)
