"""Time the headline queries; prints one JSON line.

Each query is run once to warm up and then BENCH_RUNS times (default 3); the
median is reported.  Results are written to the noop sink, so nothing is
collected.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from panelkit import registry  # noqa: E402
from panelkit.session import builder  # noqa: E402

HEADLINE = [
    "b3_resample_subhourly",
    "b4_gap_segments",
    "b9_usable_window",
    "b12_audit_report",
    "d1_origin_lags",
    "d2_rolling_means",
    "d5_d7_design_causal",
    "e3_baselines",
    "e3_hourly_naive_scores",
    "e4_direct_ridge",
    "e6_residual_naive",
    "f2_scores",
    "f7_repeatability",
    "g1_g2_diebold_mariano",
    "g7_panel_rollup",
    "g8_split_conformal",
    "g11_signed_rank",
    "g15_bootstrap_mean",
    "g16_bootstrap_corr",
    "g17_block_bootstrap",
    "h3_cost_sensitivity",
    "i1_error_profile",
    "i4_perturb",
    "j3_accuracy_table",
    "j5_budget_table",
    "j7_descriptive_cells",
    "k_top_k_per_group",
]


def exchanges(df) -> int:
    """Shuffles in the final plan (reused ones are printed differently)."""
    text = df._jdf.queryExecution().executedPlan().toString()
    return text.split("== Initial Plan ==")[0].count(" Exchange ")


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = os.environ.get("BENCH_QUERIES", "").split(",") if os.environ.get("BENCH_QUERIES") else HEADLINE
    spark = (
        builder("bench", f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "12g")
        # small tables, many cores: let AQE keep small partitions apart
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = registry.all_queries()
    seconds, shuffles = {}, {}
    for name in names:
        df = queries[name](spark, sf)
        df.write.format("noop").mode("overwrite").save()
        took = []
        for _ in range(runs):
            start = time.perf_counter()
            df = queries[name](spark, sf)
            df.write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(took), 3)
        shuffles[name] = exchanges(df)
    tables = {t: spark.read.parquet(f"{sf}/{t}.parquet").count() for t in ("events", "lineitem")}
    suppliers = spark.read.parquet(f"{sf}/supplier.parquet").count()
    out = {
        "metric": "total_seconds_headline_queries",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf"),
        "exchanges": shuffles,
    }
    if "b9_usable_window" in seconds:
        out["gate_rows_per_sec"] = round(tables["events"] / seconds["b9_usable_window"])
    if "e3_baselines" in seconds:
        out["naive_series_per_sec"] = round(suppliers / seconds["e3_baselines"], 1)
    if "e4_direct_ridge" in seconds:
        out["ridge_series_per_sec"] = round(suppliers / seconds["e4_direct_ridge"], 1)
    spark.stop()
    print(json.dumps(out))


if __name__ == "__main__":
    main()
