"""Headline queries, timed one by one; prints one JSON line.

``panel_build`` writes the master panel from the source tables. The forecasting
queries start from it, as the published backtest and sweep times do, and share
what the first of them writes (trend fits, vectors, cones); the others start
from the sources. Output goes to Spark's noop sink, so every row is computed.
"""

from __future__ import annotations

import json
import os
import sys
import time

from acrescope.plans import load_catalog
from acrescope.plans.fixtures import Fixtures
from acrescope.plans.forecasting import Forecasting
from acrescope.session import get_session

HEADLINE = [
    "state_season", "season_features", "asof_strict", "left_join_checked", "min_history", "ols_trend", "standardizer_fit",
    "lookback_state", "knn_join", "knn_join_same_entity", "knn_join_past", "percentile_cone", "backtest_sweep", "score_slices",
    "recalibrate", "gates", "chip_sequence", "topk_per_group", "season_ndvi", "best_window_2d", "zonal_mean", "bbox_overlap_join",
    "emissions_agg", "simulate_intervention", "rank_interventions", "corpus_class_stats", "confusion_iou", "tta_argmax",
    "grid_sweep", "gbt_predict", "tree_attribution", "pca_reduce", "ridge_probe", "state_forecast_doc", "profile_lines", "progress_metrics",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session("acrescope-bench", cpus=cpus, **{"spark.driver.memory": "16g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    queries = load_catalog()[0]
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_suppkey").count().count()  # start the JVM and its code paths
    seconds, start = {}, time.perf_counter()
    Forecasting.of(Fixtures(spark, sf_dir)).ready
    seconds["panel_build"] = round(time.perf_counter() - start, 3)
    for name in sys.argv[1:] or HEADLINE:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
