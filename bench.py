"""Time the headline queries and print one JSON line.

Payload fixtures are built before the clock starts. ``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the cores, ``BENCH_QUERIES`` a
comma-separated choice of queries.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from wattframe.plans import views  # noqa: E402
from wattframe.plans.registry import QUERIES  # noqa: E402
from wattframe.session import build_session  # noqa: E402
from wattframe.workspace import use_local_folder  # noqa: E402

HEADLINE = [
    "ingest_positional",
    "normalize_pjm",
    "clean_prices",
    "quality_report",
    "hourly_filled",
    "window_sequences",
    "feature_matrix",
    "feature_overview",
    "split_train_test",
    "standardize",
    "rf_forecast",
    "forecast_bulk",
    "eval_baselines",
    "error_profile",
    "docs_all",
    "docs_upsert",
    "embed_documents",
    "cosine_topk",
    "cosine_topk_lsh",
    "render_hits",
    "clean_answer",
    "nearest_feature",
    "qa_pairs",
    "model_comparison",
    "stream_hourly",
    "stream_dedupe",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = build_session(
        "bench",
        master=f"local[{cpus}]",
        conf={
            "spark.sql.shuffle.partitions": cpus if cpus.isdigit() else "8",
            "spark.driver.memory": "12g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    use_local_folder(spark)
    views.keep_fixtures(spark, sf_dir)
    QUERIES["top_hub"](spark, sf_dir).collect()

    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(sf_dir).name.removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
