"""Time the headline queries: one JSON line on standard output."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from corpusloom.plans import catalog

HEADLINE = (
    "hybrid_search bm25_topk vector_topk weighted_rrf_grid recall_precision_at_k term_df text_keys text_tokenize_stats chunk_blocks sentence_claims literal_candidates exact_dedupe overlap_audit round_robin_sample "
    "rubric_verdict confusion_metrics current_version aggregate_status revision_cycles relational_smoke"
).split()


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    os.environ["PYTHONPATH"] = os.path.dirname(os.path.abspath(__file__)) + os.pathsep + os.environ.get("PYTHONPATH", "")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "16g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    took = {}
    for name in HEADLINE:
        began = time.time()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
