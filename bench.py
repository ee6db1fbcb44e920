"""Time the headline queries; prints one JSON line.

Each query is run to completion over every output column (no-op sink), and builds all that it reads.
"""

import json
import os
import shutil
import sys
import tempfile
import time

os.environ.setdefault("PYSPARK_PYTHON", sys.executable)

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from jobflow.fixtures import INPUT_PARTITIONS  # noqa: E402
from jobflow.plans import catalog  # noqa: E402

HEADLINE = [
    "flagship", "company_results", "dedup_two_pass", "dedup_entities", "broad_results", "restricted_filter",
    "keyword_relevance", "text_keys", "url_normalize", "posted_date_company", "mail_candidates", "company_evidence",
    "registry_votes", "registry_merge", "page_text", "page_links", "page_posting", "landed_greenhouse",
    "board_search_top40", "result_metrics_lineitem", "source_counts", "row_index", "text_chunks", "csv_roundtrip",
    "score_prompts", "score_rank", "log_progress", "log_tail", "log_stream",
]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    shared = tempfile.mkdtemp(prefix="bench-")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", shared)
        .config(INPUT_PARTITIONS, cpus)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, _ = catalog.load_all()
    spark.range(1000).selectExpr("sum(id)").collect()  # start the executors
    times = {}
    for name in HEADLINE:
        begin = time.time()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - begin, 3)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()
    shutil.rmtree(shared, ignore_errors=True)


if __name__ == "__main__":
    main()
