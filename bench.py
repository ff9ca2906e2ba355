"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, HERE)
os.environ["PYTHONPATH"] = HERE + os.pathsep + os.environ.get("PYTHONPATH", "")

QUERIES = (
    "flagship", "where_compare", "group_aggregates", "join_group", "exists_correlated", "count_subquery", "topk", "array_filter", "md_headings", "md_tasks", "content_prefilter",
)


def main() -> None:
    from pyspark.sql import SparkSession

    from mdframe import catalog_queries

    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.log.level", "ERROR").getOrCreate()
    )
    known = catalog_queries.queries() | {"topk": lambda s, d: catalog_queries.run(s, d, "order_limit")}
    took = {}
    for name in QUERIES:
        times = []
        for _ in range(3):
            began = time.time()
            known[name](spark, folder).write.format("noop").mode("overwrite").save()
            times.append(time.time() - began)
        took[name] = round(statistics.median(times[1:] or times), 3)
    print(json.dumps({"metric": "total seconds of headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(folder).removeprefix("sf")}))


if __name__ == "__main__":
    main()
