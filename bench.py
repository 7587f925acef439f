"""Wall time of the headline queries. Prints one JSON line.

    BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8)
"""

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from checks.queries import QUERIES

HEADLINE = (
    "url_dedupe", "url_merge", "index_first_hit", "discover", "attempt_resolve", "retry_backoff",
    "politeness_plan", "render_fallback", "html_nodes", "enrich_pages", "page_author",
    "cms_fingerprint", "language_id", "email_rank", "email_rank_documents", "email_validate_bulk",
    "batch_assign", "request_payload", "read_replies", "classify_sites", "site_results",
    "profile_sites", "outlinks", "stream_progress",
)


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/pages.parquet").write.format("noop").mode("overwrite").save()
    chosen = sys.argv[1:] or HEADLINE
    times = {}
    for name in chosen:
        runs = []
        for _ in range(2):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        times[name] = round(min(runs), 3)
    print(
        json.dumps(
            {
                "metric": "total seconds, better of two runs per query",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
