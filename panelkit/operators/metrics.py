"""Accuracy, cost and energy measures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelkit.plans.ordered import over_rows

KEY = ["series_id"]
FLOOR = 1e-9
JOULES_PER_KWH = 3.6e6


def mase_scale(panel: DataFrame, train_end: Column, season: int = 24) -> DataFrame:
    """Mean absolute seasonal difference over the train rows, floored."""
    t = panel.filter(F.col("pos") < train_end)
    d = over_rows(
        t, KEY, lambda w: {"_d": F.abs(F.col("y") - F.lag("y", season).over(w))}, before=season
    )
    scale = F.greatest(F.avg("_d"), F.lit(FLOOR))
    return d.groupBy(*KEY).agg(scale.alias("scale"))


def error_sums(preds: DataFrame, keys: Sequence[str]) -> DataFrame:
    e = F.col("y_true") - F.col("y_pred")
    return preds.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_points"),
        F.avg(F.abs(e)).alias("MAE"),
        F.sqrt(F.avg(e * e)).alias("RMSE"),
        F.stddev_pop("y_true").alias("_sd"),
        F.avg("y_true").alias("_mean"),
    )


def score(
    preds: DataFrame, scale: DataFrame, keys: Sequence[str] = ("series_id", "model")
) -> DataFrame:
    """MAE, RMSE, MASE, nRMSE and RMSE as percent of the mean.

    One aggregate with map-side partials; the per-series scale is joined to
    the scores, not to the predictions.
    """
    s = error_sums(preds, keys).join(scale.select(*KEY, "scale"), KEY)
    mean = F.when(F.col("_mean") == 0, F.lit(FLOOR)).otherwise(F.col("_mean"))
    return s.select(
        *keys,
        "n_points",
        "MAE",
        "RMSE",
        (F.col("MAE") / F.col("scale")).alias("MASE"),
        F.when(F.col("_sd") > 0, F.col("RMSE") / F.col("_sd")).alias("nRMSE"),
        (F.lit(100.0) * F.col("RMSE") / mean).alias("RMSE_pct_mean"),
    )


def per_thousand(n_forecasts: Column) -> Column:
    return F.lit(1000.0) / F.greatest(n_forecasts, F.lit(1))


def proxy_cost(
    runs: DataFrame,
    gpu_prefixes: Sequence[str],
    cpu_watts: float = 65.0,
    gpu_watts: float = 200.0,
    pue: float = 1.4,
    price_kwh: float = 0.15,
) -> DataFrame:
    """Energy and money per 1,000 forecasts from latency and device power."""
    on_gpu = F.lit(False)
    for p in gpu_prefixes:
        on_gpu = on_gpu | F.col("model").startswith(p)
    watts = F.when(on_gpu, F.lit(float(gpu_watts))).otherwise(F.lit(float(cpu_watts)))
    joules = F.col("latency_s") * watts * pue * per_thousand(F.col("n_forecasts"))
    return runs.withColumns(
        {
            "energy_j_per_1k": joules,
            "usd_per_1k": joules / JOULES_PER_KWH * price_kwh,
            "per_forecast_ms": F.lit(1000.0)
            * F.col("latency_s")
            / F.greatest(F.col("n_forecasts"), F.lit(1)),
        }
    )


def measured_cost(runs: DataFrame, price_kwh: float = 0.15) -> DataFrame:
    """Metered energy per 1,000 forecasts; the money column excludes PUE."""
    k = per_thousand(F.col("n_forecasts"))
    return runs.withColumns(
        {
            "measured_j_per_1k": F.col("kwh") * JOULES_PER_KWH * k,
            "measured_cpu_j_per_1k": F.col("cpu_kwh") * JOULES_PER_KWH * k,
            "measured_gpu_j_per_1k": F.col("gpu_kwh") * JOULES_PER_KWH * k,
            "measured_usd_per_1k": F.col("kwh") * k * price_kwh,
        }
    )


def table_cost(mean_joules: Column, price_kwh: float = 0.15, pue: float = 1.4) -> Column:
    """Money per 1,000 forecasts for reports; unlike the measured column, with PUE."""
    return mean_joules / JOULES_PER_KWH * price_kwh * pue


def repeatability(
    reps: DataFrame, keys: Sequence[str], value: str, gate: float = 0.2
) -> DataFrame:
    """Replicate spread per cell and whether it exceeds the gate."""
    g = reps.groupBy(*keys).agg(
        F.count(value).alias("n_reps"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("sd"),
        F.min(value).alias("lo"),
        F.max(value).alias("hi"),
    )
    rel = F.when(F.col("mean") != 0, F.col("sd") / F.col("mean"))
    return g.withColumn("rel_sd", rel).withColumn("gate", F.coalesce(rel > gate, F.lit(False)))


def range_or_mean(cells: DataFrame) -> DataFrame:
    """Gated cells report their range, the others mean and deviation."""
    gate = F.col("gate")
    return cells.withColumns(
        {
            "shown_lo": F.when(gate, F.col("lo")),
            "shown_hi": F.when(gate, F.col("hi")),
            "shown_mean": F.when(~gate, F.col("mean")),
            "shown_sd": F.when(~gate, F.col("sd")),
        }
    )


def amortisation(
    reps: DataFrame, keys: Sequence[str], folds: int = 6, horizon: int = 24
) -> DataFrame:
    """Training energy per fit and the forecast count where training pays off."""
    g = reps.groupBy(*keys).agg(
        F.avg("e_retrain_j").alias("_retrain"),
        F.avg("e_once_j").alias("_once"),
        F.avg("e_zeroshot_j").alias("_zero"),
    )
    fits = float(folds - 1)
    points = float(folds * horizon)
    train = (F.col("_retrain") - F.col("_once")) / fits
    g = g.withColumn("train_per_fit_j", train)
    g = g.withColumns(
        {
            "infer_local_j": (F.col("_once") - F.col("train_per_fit_j")) / points,
            "infer_zeroshot_j": F.col("_zero") / points,
        }
    )
    gap = F.col("infer_zeroshot_j") - F.col("infer_local_j")
    return g.withColumns(
        {
            "local_cheaper": gap > 0,
            "crossover": F.when(gap > 0, F.col("train_per_fit_j") / gap),
        }
    ).drop("_retrain", "_once", "_zero")


def model_sizes(runs: DataFrame) -> DataFrame:
    return runs.groupBy("model").agg(F.max("n_params").alias("n_params"))


def cost_ratio(runs: DataFrame, a: str, b: str, value: str = "usd_per_1k") -> DataFrame:
    """Ratio of two models' mean cost."""
    mean_a = F.avg(F.when(F.col("model") == a, F.col(value)))
    mean_b = F.avg(F.when(F.col("model") == b, F.col(value)))
    return runs.agg(mean_a.alias("mean_a"), mean_b.alias("mean_b")).withColumn(
        "ratio", F.col("mean_a") / F.col("mean_b")
    )
