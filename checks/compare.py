"""Run queries against their SQL twins: python -m checks.compare [sf_dir] [name ...]"""

import sys
import time

import duckdb
import pandas as pd
from pyspark.sql import SparkSession

from . import oracles, queries

TABLES = "pages documents events labels".split()


def session(cores=8, partitions=8):
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def duck(sf_dir):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def _canonical(frame):
    frame = frame[sorted(frame.columns)]
    text = frame.astype(object).where(frame.notna(), None).map(_cell)
    return sorted(map(tuple, text.itertuples(index=False)))


def _cell(value):
    if value is None or value is pd.NaT or value is pd.NA:
        return "~"
    if isinstance(value, float) and value.is_integer():
        return str(int(value))
    return str(value)


def differences(got, want):
    """Problems found between two pandas frames, as text."""
    if sorted(got.columns) != sorted(want.columns):
        return [f"columns {sorted(got.columns)} != {sorted(want.columns)}"]
    a, b = _canonical(got), _canonical(want)
    if a == b:
        return []
    only_a, only_b = [r for r in a if r not in set(b)], [r for r in b if r not in set(a)]
    return [f"{len(a)} rows != {len(b)} rows", f"spark only {len(only_a)}: {only_a[:2]}", f"sql only {len(only_b)}: {only_b[:2]}"]


def main(sf_dir="/root/testdata/sf0.01", *names):
    spark = session()
    spark.sparkContext.setLogLevel("ERROR")
    con, sql = duck(sf_dir), oracles.oracle_sql()
    bad = 0
    for name, run in queries.QUERIES.items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            got = run(spark, sf_dir).toPandas()
            problems = differences(got, con.sql(sql[name]).df()) if name in sql else []
        except Exception as exc:
            problems = [f"{type(exc).__name__}: {str(exc)[:600]}"]
        bad += bool(problems)
        print(f"{'BAD' if problems else 'ok '} {name} {time.time() - start:.1f}s", *(p[:1200] for p in problems), sep="\n      " if problems else " ")
    print("without sql:", sorted(set(queries.QUERIES) - set(sql)), "bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(bool(main(*sys.argv[1:])))
