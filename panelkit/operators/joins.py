"""Alignment of panels, dimensions and prediction sources.

No broadcast hints: sizes are known to the optimizer and AQE picks broadcast
only below its threshold.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelkit.operators.quality import carry_both_ways, interpolate

KEY = ["series_id"]


def attach_covariates(
    panel: DataFrame, covs: DataFrame, keys: Sequence[str] = ("series_id", "ts")
) -> DataFrame:
    """Left equi join on the stamp; a missing stamp gives null covariates."""
    return panel.join(covs, list(keys), "left")


def attach_covariates_filled(
    panel: DataFrame,
    covs: DataFrame,
    columns: Sequence[str],
    limit: int = 6,
    strict: bool = True,
    keys: Sequence[str] = ("series_id", "ts"),
) -> DataFrame:
    """Join, interpolate small gaps, and (not strict) carry values both ways.

    Carried values are flagged in ``<column>_is_filled``: they may extend past
    the covariate's real coverage.
    """
    out = attach_covariates(panel, covs, keys)
    for c in columns:
        out = interpolate(out, limit, value=c)
        if not strict:
            out = carry_both_ways(out, KEY, c, flag=f"{c}_is_filled")
    return out


def lookup(df: DataFrame, dim: DataFrame, on: str, value: str, default: str = "?") -> DataFrame:
    """Dimension value with a default for unknown keys."""
    return df.join(dim.select(on, value), on, "left").withColumn(
        value, F.coalesce(value, F.lit(default))
    )


def side_by_side(
    a: DataFrame, b: DataFrame, keys: Sequence[str], suffixes: tuple[str, str] = ("_a", "_b")
) -> DataFrame:
    """Inner merge with both sides' other columns suffixed."""
    keys = list(keys)

    def tag(d: DataFrame, s: str) -> DataFrame:
        return d.select(*keys, *[F.col(c).alias(c + s) for c in d.columns if c not in keys])

    return tag(a, suffixes[0]).join(tag(b, suffixes[1]), keys)


def aligned(frames: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Keys present in every frame, their columns next to each other."""
    return reduce(lambda x, y: x.join(y, list(keys)), frames)


def merge_checked(
    sources: dict[str, DataFrame], models: dict[str, Sequence[str]], tol: float = 1e-6
) -> tuple[DataFrame, DataFrame]:
    """Take each model from its source after checking that the truths agree.

    Returns (merged predictions, refused series with the reason).  A series is
    refused when a source lacks it, when position counts differ, or when the
    truths differ by more than ``tol``.  One aggregate per position and one per
    series; no pairwise joins.
    """
    tagged = [
        df.withColumn("source", F.lit(name)).filter(F.col("model").isin(list(models[name])))
        for name, df in sources.items()
    ]
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    truth = every.groupBy("series_id", "pos", "source").agg(F.max("y_true").alias("y"))
    spread = truth.groupBy("series_id", "pos").agg(
        F.count(F.lit(1)).alias("k"), (F.max("y") - F.min("y")).alias("gap")
    )
    n_src = len(sources)
    present = truth.groupBy("series_id").agg(F.countDistinct("source").alias("n_src"))
    facts = spread.groupBy("series_id").agg(
        F.count_if(F.col("k") != n_src).alias("ragged"), F.max("gap").alias("max_gap")
    ).join(present, KEY)
    reason = (
        F.when(F.col("n_src") < n_src, "source missing")
        .when(F.col("ragged") > 0, "windows differ")
        .when(F.col("max_gap") > tol, "truth differs")
    )
    facts = facts.withColumn("reject_reason", reason)
    good = facts.filter("reject_reason IS NULL").select("series_id")
    bad = facts.filter("reject_reason IS NOT NULL").select("series_id", "reject_reason", "max_gap")
    return every.join(good, KEY, "left_semi"), bad


def remaining(todo: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Work not finished yet; null key parts match null (resume)."""
    d = done.select(*[F.col(k).alias(f"_d_{k}") for k in keys])
    cond = reduce(
        lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_d_{k}")) for k in keys]
    )
    return todo.join(d, cond, "left_anti")


def era_overlap(df: DataFrame, lo: str, hi: str, start: str = "start", end: str = "end") -> DataFrame:
    """Days of [start, end] inside the era, and their share."""
    a = F.greatest(F.col(start), F.lit(lo).cast("date"))
    b = F.least(F.col(end), F.lit(hi).cast("date"))
    days = F.greatest(F.datediff(b, a), F.lit(0))
    span = F.datediff(F.col(end), F.col(start))
    return df.withColumns(
        {
            "overlap_days": days,
            "span_days": span,
            "overlap_frac": F.when(span > 0, days / span),
        }
    )


def missing_ids(cited: DataFrame, ledger: DataFrame, on: str) -> DataFrame:
    """Cited ids that the ledger does not know."""
    return cited.select(on).distinct().join(ledger.select(on), on, "left_anti")


def cited_superseded(cited: DataFrame, superseded: DataFrame, on: str) -> DataFrame:
    return cited.select(on).distinct().join(superseded.select(on), on, "left_semi")


def replace_by_key(previous: DataFrame, current: DataFrame, key: str) -> DataFrame:
    """Current rows plus the previous rows of keys this run did not cover."""
    covered = current.select(key).distinct()
    return current.unionByName(previous.join(covered, key, "left_anti"), allowMissingColumns=True)
