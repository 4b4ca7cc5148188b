"""Report frames and the claims audit."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelkit.functions.columns import slug
from panelkit.operators import stats
from panelkit.plans.ordered import group_quantiles
from panelkit.session import settled


def audit_claims(claims: DataFrame, metrics: DataFrame) -> DataFrame:
    """Expected against recomputed values.

    ``claims``: check_id, expected (text), tol (null = exact text).
    ``metrics``: check_id, recomputed (text).  A claim without a recomputed
    value fails.
    """
    j = claims.join(metrics, "check_id", "left")
    e = F.expr("try_cast(expected AS double)")
    r = F.expr("try_cast(recomputed AS double)")
    ok = F.when(F.col("tol").isNotNull(), F.abs(e - r) <= F.col("tol")).otherwise(
        F.col("expected") == F.col("recomputed")
    )
    return j.withColumn("status", F.when(F.coalesce(ok, F.lit(False)), "PASS").otherwise("FAIL"))


def audit_summary(audited: DataFrame) -> DataFrame:
    return audited.agg(
        F.count(F.lit(1)).alias("checks"),
        F.count_if(F.col("status") == "PASS").alias("passed"),
        (F.count_if(F.col("status") == "FAIL") == 0).alias("all_pass"),
    )


def panel_stats(
    scores: DataFrame, keys: Sequence[str], value: str = "MASE", series: str = "series_id"
) -> DataFrame:
    """Mean and deviation over series of the per-series seed mean."""
    per = scores.groupBy(*keys, series).agg(F.avg(value).alias("_v"))
    return per.groupBy(*keys).agg(
        F.avg("_v").alias("mean"),
        F.stddev_samp("_v").alias("sd"),
        F.count(F.lit(1)).alias("n_series"),
    )


def raw_row_stats(scores: DataFrame, keys: Sequence[str], value: str = "MASE") -> DataFrame:
    """Mean and deviation over the raw rows, seeds included."""
    return scores.groupBy(*keys).agg(
        F.avg(value).alias("mean_rows"), F.stddev_samp(value).alias("sd_rows"), F.count(value).alias("n_rows")
    )


def oriented_wins(rollup: DataFrame, reference: str, block: Sequence[str] = ()) -> DataFrame:
    """Pair wins seen from the reference model: one row per other model (and block)."""
    a_is_ref = F.col("model_a") == reference
    r = rollup.filter(a_is_ref | (F.col("model_b") == reference))
    return r.select(
        *block,
        F.when(a_is_ref, F.col("model_b")).otherwise(F.col("model_a")).alias("model"),
        F.when(a_is_ref, F.col("a_wins_fdr")).otherwise(F.col("b_wins_fdr")).alias("ref_wins_fdr"),
        F.when(a_is_ref, F.col("b_wins_fdr")).otherwise(F.col("a_wins_fdr")).alias("model_wins_fdr"),
    )


def accuracy_table(rows: DataFrame, ranks: DataFrame, wins: DataFrame) -> DataFrame:
    """Mean and deviation, average rank and oriented wins per model."""
    return (
        rows.join(ranks.select("model", "avg_rank", "critical_difference"), "model", "left")
        .join(wins, "model", "left")
    )


def accuracy_by_block(
    preds: DataFrame,
    scores: DataFrame,
    block: Sequence[str],
    models: Sequence[str],
    reference: str,
    h: int = 24,
    values: Sequence[str] = ("MASE", "MAE", "RMSE"),
) -> DataFrame:
    """One accuracy table over all blocks, such as domain x covariate configuration.

    ``preds`` and ``scores`` carry the ``block`` columns beside series and model;
    rows of other models are left out.  Per block and model: mean and deviation
    over series of every value (seed means first), average rank over the series
    that have all models, and the wins of the reference and of the model after
    false-discovery control inside the block (null for the reference itself).
    All blocks go through one pass: a series in a block is the tested unit, so no
    block is a job of its own.
    """
    block, keys = list(block), [*block, "model"]
    scores = scores.filter(F.col("model").isin(list(models)))
    per = scores.groupBy(*keys, "series_id").agg(*[F.avg(v).alias(v) for v in values])
    cells = [c for v in values for c in (F.avg(v).alias(f"mean_{v}"), F.stddev_samp(v).alias(f"sd_{v}"))]
    out = per.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_series"), *cells)
    ranks = stats.average_ranks(stats.model_ranks(scores, block, models), block, len(models))
    unit = F.struct(*block, "series_id").alias("series_id")
    tests = stats.paired_summary(preds.select(unit, "model", "fold", "lead", "pos", "y_true", "y_pred"), models, h)
    tests = settled(tests.select("series_id.*", "model_a", "model_b", "p_value", "better"), "tests")
    adjusted = settled(stats.benjamini_hochberg(tests, [*block, "model_a", "model_b"]), "adjusted")
    wins = oriented_wins(stats.panel_rollup(adjusted, block=block), reference, block)
    return out.join(ranks.select(*keys, "avg_rank"), keys, "left").join(wins, keys, "left")


def panel_table(quality: DataFrame, manifest: DataFrame) -> DataFrame:
    """The series that passed, with what the manifest knows of them, by tier and name.

    ``quality``: city (a slug), tier, usable_from, usable_to, usable_hours, PASS.
    ``manifest``: city (as written), country, sensor_id; one row a slug.  A city
    that the manifest lacks stays, with nulls.
    """
    known = manifest.select(slug("city").alias("_slug"), "country", "sensor_id")
    q = quality.filter("PASS").withColumn("_slug", F.col("city")).join(known, "_slug", "left")
    name = F.initcap(F.replace("city", F.lit("_"), F.lit(" "))).alias("city")
    q = q.select(name, "country", "tier", "sensor_id", "usable_from", "usable_to", "usable_hours")
    return q.orderBy("tier", "city")


def recency_table(rows: DataFrame, scores: DataFrame, models: Sequence[str], value: str = "MASE") -> DataFrame:
    """Per series, its rows after the cutoff and each model's score on them; models that did not run are null.

    ``rows``: the panel cut at the cutoff.  A series that no model scored is left out.
    """
    n = rows.groupBy("series_id").agg(F.count(F.lit(1)).alias("rows_since"))
    return n.join(pivoted(scores, ["series_id"], "model", models, {value: F.col(value)}), "series_id").orderBy("series_id")


def pivoted(
    df: DataFrame, keys: Sequence[str], column: str, values: Sequence, cells: dict[str, Column]
) -> DataFrame:
    """Pivot with named values: one conditional aggregate, no pass to find them."""
    out = []
    for v in values:
        hit = F.col(column) == F.lit(v)
        for name, c in cells.items():
            out.append(F.avg(F.when(hit, c)).alias(f"{name}_{v}"))
    return df.groupBy(*keys).agg(*out)


def describe(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """count, mean, median, deviation and range per group."""
    g = df.groupBy(*keys).agg(
        F.count(value).alias("n"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("sd"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
    )
    med = group_quantiles(df, keys, value, {"median": 0.5}).drop("n")
    return g.join(med, list(keys), "left")


def descriptive_cells(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Mean, deviation, quartiles, n and share of all rows per group."""
    g = df.groupBy(*keys).agg(
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("sd"),
        F.count(F.lit(1)).alias("n"),
    )
    q = group_quantiles(df, keys, value, {"q1": 0.25, "median": 0.5, "q3": 0.75}).drop("n")
    g = g.join(q, list(keys), "left")
    return _beside(g, df.agg(F.count(F.lit(1)).alias("_total"))).withColumn("pct", F.lit(100.0) * F.col("n") / F.col("_total")).drop("_total")


def _beside(rows: DataFrame, one: DataFrame) -> DataFrame:
    """``rows`` with the columns of ``one``, an aggregate without keys: its single row is what is broadcast."""
    at = F.lit(0).alias("_one")
    return rows.select("*", at).join(F.broadcast(one.select("*", at)), "_one").drop("_one")


def budget_table(
    means: DataFrame, base_strategy: str, tests: DataFrame, intervals: DataFrame, keys: Sequence[str]
) -> DataFrame:
    """Mean per strategy and budget, difference to the base, tests and CI.

    The base mean is one scalar, an aggregate that stands beside every row.
    """
    base = means.agg(F.max(F.when(F.col("strategy") == base_strategy, F.col("mean"))).alias("_base"))
    s = _beside(means, base).withColumn("delta", F.col("mean") - F.col("_base")).drop("_base")
    return s.join(tests, list(keys), "left").join(intervals, list(keys), "left")


def coverage_summary(df: DataFrame, affected: Column) -> DataFrame:
    """Panel span and the share of hours in affected series."""
    return df.agg(
        F.min("usable_from").alias("first_day"),
        F.max("usable_to").alias("last_day"),
        F.count(F.lit(1)).alias("n_series"),
        F.count_if(affected).alias("n_affected"),
        F.sum("usable_hours").alias("hours"),
        F.sum(F.when(affected, F.col("usable_hours")).otherwise(0)).alias("affected_hours"),
        (F.sum(F.when(affected, F.col("usable_hours")).otherwise(0)) / F.sum("usable_hours")).alias(
            "affected_share"
        ),
    )


def ordered_by_list(df: DataFrame, column: str, order: Sequence[str], *then: str) -> DataFrame:
    """Sort by a fixed category order; unknown categories come last."""
    place = F.array_position(F.array(*[F.lit(v) for v in order]), F.col(column))
    return df.orderBy(F.when(place > 0, place).otherwise(len(order) + 1), *then)


def top_rows(df: DataFrame, by: str, k: int, ascending: bool = False, tie: str = "series_id") -> DataFrame:
    """The k first rows by a column; a TakeOrdered, no full sort."""
    return df.orderBy(F.asc(by) if ascending else F.desc(by), F.asc(tie)).limit(k)
