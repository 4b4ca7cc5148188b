"""Cost-adjusted winners, decision tables and win rates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def seed_mean_first(df: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Average the seed replicates before anything else looks at the models."""
    return df.groupBy(*keys).agg(*[F.avg(v).alias(v) for v in values])


def penalised_winner(
    runs: DataFrame,
    regime: Sequence[str],
    wtps: Sequence[float],
    metric: str = "MASE",
    cost: str = "usd_per_1k",
    cost_scale: Column | None = None,
) -> DataFrame:
    """argmin over models of metric + wtp * cost, per regime and wtp.

    Ties go to the first model in the alphabet: the minimum is taken over
    (objective, model), a plain aggregate without a sort.
    """
    means = seed_mean_first(runs, [*regime, "model"], [metric, cost])
    g = means.withColumn("wtp", F.explode(F.array(*[F.lit(float(w)) for w in wtps])))
    scale = F.lit(1.0) if cost_scale is None else cost_scale
    objective = F.col(metric) + F.col("wtp") * F.col(cost) * scale
    best = F.min(F.struct(objective.alias("objective"), F.col("model").alias("model"))).alias("_m")
    return g.groupBy(*regime, "wtp").agg(best).select(
        *regime, "wtp", F.col("_m.model").alias("winner"), F.col("_m.objective").alias("objective")
    )


def decision_table(winners: DataFrame, regime: Sequence[str], wtps: Sequence[float]) -> DataFrame:
    """Regime by wtp, one column per wtp value."""
    return winners.groupBy(*regime).agg(
        *[
            F.max(F.when(F.col("wtp") == float(w), F.col("winner"))).alias(f"wtp_{w:g}".replace(".", "p"))
            for w in wtps
        ]
    )


def cost_sensitivity(
    runs: DataFrame,
    regime: Sequence[str],
    wtps: Sequence[float],
    prices: Sequence[float],
    pues: Sequence[float],
    base_price: float = 0.15,
    base_pue: float = 1.4,
    metric: str = "MASE",
    cost: str = "usd_per_1k",
) -> DataFrame:
    """Share of decision cells that flip under another price and PUE.

    Base and alternative objective are evaluated side by side in one pass over
    the model means.
    """
    means = seed_mean_first(runs, [*regime, "model"], [metric, cost])
    for name, values in (("wtp", wtps), ("price", prices), ("pue", pues)):
        means = means.withColumn(name, F.explode(F.array(*[F.lit(float(v)) for v in values])))
    factor = (F.col("price") / base_price) * (F.col("pue") / base_pue)

    def argmin(scale: Column, name: str) -> Column:
        objective = F.col(metric) + F.col("wtp") * F.col(cost) * scale
        return F.min(F.struct(objective.alias("o"), F.col("model").alias("m")))["m"].alias(name)

    cells = means.groupBy(*regime, "wtp", "price", "pue").agg(
        argmin(F.lit(1.0), "base"), argmin(factor, "alt")
    )
    g = cells.groupBy("price", "pue").agg(
        F.count(F.lit(1)).alias("cells"), F.count_if(F.col("base") != F.col("alt")).alias("flipped")
    )
    return g.withColumns(
        {"wtp_multiplier": factor, "flip_rate": F.col("flipped") / F.col("cells")}
    )


def winner_counts(winners: DataFrame) -> DataFrame:
    return winners.groupBy("winner").agg(F.count(F.lit(1)).alias("n_cells"))


def wide_scores(
    scores: DataFrame, models: Sequence[str], value: str = "MASE", keys: Sequence[str] = ("series_id",)
) -> DataFrame:
    """One row per series with a column per named model (seed mean)."""
    return scores.groupBy(*keys).agg(
        *[F.avg(F.when(F.col("model") == m, F.col(value))).alias(m) for m in models]
    )


def win_rates(wide: DataFrame, a: str, b: str, keys: Sequence[str] = ()) -> DataFrame:
    """Share of series where ``a`` is strictly lower than ``b``."""
    ok = wide.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    wins = F.count_if(F.col(a) < F.col(b))
    return ok.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_series"), wins.alias("wins"), (wins / F.count(F.lit(1))).alias("win_rate")
    )


def win_rates_overall_and_by(wide: DataFrame, a: str, b: str, group: str) -> DataFrame:
    """Overall and per-group rates from one pass (grouping sets)."""
    ok = wide.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    wins = F.count_if(F.col(a) < F.col(b))
    g = ok.rollup(group).agg(
        F.grouping(group).alias("_all"),
        F.count(F.lit(1)).alias("n_series"),
        (wins / F.count(F.lit(1))).alias("win_rate"),
    )
    label = F.when(F.col("_all") == 1, F.lit("overall")).otherwise(F.col(group))
    return g.select(label.alias(group), "n_series", "win_rate")


def advantage(wide: DataFrame, a: str, b: str) -> DataFrame:
    """Per-series a - b (positive: b is better), sorted."""
    return (
        wide.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
        .select("series_id", (F.col(a) - F.col(b)).alias("advantage"))
        .orderBy("advantage", "series_id")
    )


def best_model(scores: DataFrame, value: str = "MASE") -> DataFrame:
    """Best model per series, first in the alphabet on a tie."""
    best = F.min(F.struct(F.col(value).alias("v"), F.col("model").alias("m"))).alias("_b")
    return scores.groupBy("series_id").agg(best).select(
        "series_id", F.col("_b.m").alias("best_model"), F.col("_b.v").alias("best_value")
    )


def graft(base: DataFrame, other: DataFrame, model: str) -> DataFrame:
    """``base`` with one model's rows taken from ``other`` instead."""
    return base.filter(F.col("model") != model).unionByName(
        other.filter(F.col("model") == model), allowMissingColumns=True
    )
