"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

``customer_table`` derives the customer table from the raw tables. The other queries read
that table once it is written, as every request of a running system does; the time to
write it is ``write_customer_table``. Every query runs to completion into a no-op sink.
Fits that several queries share are timed by their own names, ``fit_...``, before them;
other queries that fit models or build thresholds do so inside their own time.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession

#: Timed last, dearest at the end; none is begun once $BENCH_SECONDS have passed.
DEAR = [
    "dbscan_labels", "kmeans_grid", "gmm_memberships", "score_table", "scored_stream", "segment_classifier", "kmeans_stability",
    "dbscan_tune", "answer_density_tuned", "ltv_benchmark", "automl_board", "gmm_bic", "training_run",
]


def session() -> SparkSession:
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("clientlens-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="clientlens-bench-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main() -> None:
    from clientlens.plans import queries
    from clientlens.session import discard_stages

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    only = os.environ.get("BENCH_QUERIES", "").split()
    spark = session()
    spark.range(1000).selectExpr("sum(id)").collect()  # start the executors

    times: dict[str, float] = {}

    def timed(name, action) -> None:
        start = time.perf_counter()
        action()
        times[name] = round(time.perf_counter() - start, 3)

    budget, began = float(os.environ.get("BENCH_SECONDS", "600")), time.perf_counter()
    names = only or [n for n in queries.ALL if n not in DEAR] + DEAR
    untimed = []
    run = lambda name: queries.ALL[name](spark, folder).write.format("noop").mode("overwrite").save()
    if "customer_table" in names:
        timed("customer_table", lambda: run("customer_table"))
    timed("write_customer_table", lambda: queries.customers(spark, folder))
    for name, fit in {} if only else queries.SHARED_FITS.items():
        timed(f"fit_{name}", lambda: fit(spark, folder))
    for name in names:
        if time.perf_counter() - began > budget:
            untimed.append(name)
        elif name != "customer_table":
            timed(name, lambda: run(name))
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": folder.rstrip("/").rsplit("sf", 1)[-1], "untimed": untimed,
    }))
    discard_stages(spark)
    spark.stop()


if __name__ == "__main__":
    main()
