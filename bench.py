"""Times the engine's headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one line of JSON."""

import json
import os
import time

from pyspark.sql import SparkSession

from termweave.queries import QUERIES

HEADLINE = ("s01_simplify_lineitem", "s01_simplify_rtol", "c03_parse_labels", "p01_render_labels", "u01_add", "j01_matmul_raw", "j01_matmul_simplify", "j06_commutes_pairs", "g01_count_total", "g04_conflict_degrees", "g08_topk_conflicts", "k02_group_qwc", "k03_group_full", "e01_expectation_embeddings", "e06_z_counts")


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "12g").config("spark.ui.enabled", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    for name in ("s01_simplify_lineitem", "k03_group_full"):  # starts the JVM's compiler and the Python workers
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    took = {}
    for name in HEADLINE:
        began = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
        spark.catalog.clearCache()
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
