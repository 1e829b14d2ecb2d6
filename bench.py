"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from tablelens.plans import load_all
from tablelens.session import local_session

HEADLINE = (
    "lineitem_profile",
    "events_findings",
    "revenue_by_region",
    "top_parts_by_revenue",
    "correlation_matrix",
    "spearman_size_price",
    "anomaly_ensemble",
    "window_outliers",
    "association_rules",
    "frequent_brand_sets",
    "moving_average_forecast",
    "double_smoothing_forecast",
    "automatic_forecast",
    "corpus_word_table",
    "page_text",
    "document_chunks",
    "hybrid_search",
    "graph_traversal",
    "chart_box_plot",
    "quota_admission",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    queries, _ = load_all()
    spark = local_session(cpus, app="bench")
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/nation.parquet").count()
    times: dict[str, float] = {}
    for name in HEADLINE:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(json.dumps({
        "metric": "total wall time of the headline queries",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(sf_dir).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
