"""Quality of covariate forecasts and controlled perturbation."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelkit.functions.columns import circular_difference, hashed_normal, nan_to_null
from panelkit.plans.ordered import SCAN_ROWS, affine_scan, chunk_of, group_quantiles, over_rows, spread, with_position

MIN_PAIRS = 48
# Physical bounds per covariate; null means open on that side.
BOUNDS = {
    "relative_humidity_2m": (0.0, 100.0),
    "cloud_cover": (0.0, 100.0),
    "precipitation": (0.0, None),
    "shortwave_radiation": (0.0, None),
    "wind_speed_10m": (0.0, None),
}
CIRCULAR = {"wind_direction_10m": 360.0}


def long_variables(df: DataFrame, ids: Sequence[str], variables: Sequence[str]) -> DataFrame:
    """One row per (id columns, variable)."""
    return df.unpivot(list(ids), list(variables), "variable", "value")


_LEAD = re.compile(r"(.+)_previous_day([0-9]+)")


def archive_leads(columns: Sequence[str]) -> list[tuple[str, int, str]]:
    """(variable, lead day, forecast column) of the names ``<variable>_previous_day<N>`` whose variable is a column, too."""
    known = set(columns)
    found = [(m[1], int(m[2]), c) for c in columns if (m := _LEAD.fullmatch(c)) and m[1] in known]
    return sorted(found, key=lambda f: f[:2])


def archive_pairs(wide: DataFrame, key: str = "series_id", time: str = "ts", bucket_seconds: int = 86_400 * 64) -> DataFrame:
    """series, variable, lead_day, ts, pos, actual and predicted of a forecast archive.

    ``wide`` has one row per series and stamp; for each variable a column with what
    came and, for each lead, a column ``<variable>_previous_day<N>`` with what was
    forecast N days before.  The leads are read off the names.  Only complete pairs
    stay (NaN is null) and are numbered by ``pos`` in time order for each lead.
    Archives without any such column give an empty table.
    """
    number = lambda c: nan_to_null(F.col(f"`{c}`").cast("double"))
    leads = archive_leads(wide.columns)
    empty = F.array().cast("array<struct<variable:string,lead_day:int,actual:double,predicted:double>>")
    melted = [
        F.struct(F.lit(v).alias("variable"), F.lit(k).alias("lead_day"), number(v).alias("actual"), number(c).alias("predicted"))
        for v, k, c in leads
    ]
    pairs = wide.select(F.col(key), F.col(time), F.inline(F.array(*melted) if melted else empty))
    pairs = pairs.filter("actual IS NOT NULL AND predicted IS NOT NULL")
    pairs = pairs.withColumn("_bucket", F.floor(F.unix_seconds(F.col(time)) / F.lit(bucket_seconds)))
    return with_position(pairs, [key, "variable", "lead_day"], "_bucket", time, total=None).drop("_bucket")


def _difference(a: Column, b: Column, circular: Sequence[str]) -> Column:
    plain = a - b
    if not circular:
        return plain
    return F.when(F.col("variable").isin(list(circular)), circular_difference(a, b)).otherwise(plain)


def error_profile(
    pairs: DataFrame,
    keys: Sequence[str] = ("series_id", "variable", "lead_day"),
    circular: Sequence[str] = tuple(CIRCULAR),
    min_pairs: int = MIN_PAIRS,
) -> DataFrame:
    """MAE, RMSE, bias, spread and lag-1 autocorrelation of forecast errors.

    ``pairs`` hold actual, predicted and ``pos`` (0-based per key, complete
    pairs).  The lag-1 products are summed along with the moments, so the
    autocorrelation needs no second pass.
    """
    keys = list(keys)
    e = _difference(F.col("predicted"), F.col("actual"), circular)
    rows = pairs.withColumn("_e", e)
    rows = over_rows(rows, keys, lambda w: {"_e1": F.lag("_e", 1).over(w)}, before=1)
    x, x1 = F.col("_e"), F.col("_e1")
    g = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.abs(x)).alias("mae"),
        F.sqrt(F.avg(x * x)).alias("rmse"),
        F.avg(x).alias("bias"),
        F.stddev_pop(x).alias("sd"),
        F.stddev_pop("actual").alias("actual_sd"),
        F.sum(x * x1).alias("_s11"),
        F.sum(F.when(x1.isNotNull(), x)).alias("_sa"),
        F.sum(x1).alias("_sb"),
        F.var_pop(x).alias("_v"),
    ).filter(F.col("n") >= min_pairs)
    n, m = F.col("n"), F.col("bias")
    num = F.col("_s11") - m * (F.col("_sa") + F.col("_sb")) + (n - 1) * m * m
    ar1 = F.when(F.col("_v") > 0, num / (n * F.col("_v")))
    return g.withColumn("err_ar1", ar1).drop("_s11", "_sa", "_sb", "_v")


def error_model(
    profile: DataFrame, lead_hours: float = 12.0, floor: float = 0.02
) -> DataFrame:
    """Error fraction at the target lead, from a line over the measured leads.

    Clipped to [floor, smallest measured]; a single lead is taken as is.
    """
    p = profile.filter(F.col("actual_sd") > 0).withColumns(
        {
            "frac": F.col("rmse") / F.col("actual_sd"),
            "bfrac": F.col("bias") / F.col("actual_sd"),
            "lead_hours": F.col("lead_day") * 24.0 + 12.0,
        }
    )
    lead = p.groupBy("variable", "lead_hours").agg(
        F.avg("frac").alias("frac"),
        F.avg("bfrac").alias("bfrac"),
        F.avg("err_ar1").alias("ar1"),
        F.sum("n").alias("n"),
    )
    g = lead.groupBy("variable").agg(
        F.count(F.lit(1)).alias("_leads"),
        F.regr_slope("frac", "lead_hours").alias("_slope"),
        F.regr_intercept("frac", "lead_hours").alias("_icept"),
        F.min("frac").alias("_lo"),
        F.min_by("frac", "lead_hours").alias("measured_lead1_frac"),
        F.avg("bfrac").alias("bias_frac"),
        F.coalesce(F.avg("ar1"), F.lit(0.0)).alias("ar1"),
        F.sum("n").alias("n_obs"),
    )
    line = F.col("_icept") + F.col("_slope") * lead_hours
    clipped = F.least(F.greatest(line, F.lit(floor)), F.col("_lo"))
    fitted = F.when(F.col("_leads") >= 2, clipped).otherwise(F.col("measured_lead1_frac"))
    return g.select(
        "variable",
        fitted.alias("sigma_frac"),
        "bias_frac",
        "ar1",
        "measured_lead1_frac",
        "n_obs",
    )


def error_model_report(profile: DataFrame, lead_hours: float = 12.0) -> DataFrame:
    """Fitted fraction next to the between-series spread at the first lead."""
    first = (
        profile.filter((F.col("actual_sd") > 0) & (F.col("lead_day") == 1))
        .withColumn("frac", F.col("rmse") / F.col("actual_sd"))
        .groupBy("variable")
        .agg(
            F.countDistinct("series_id").alias("n_series"),
            F.stddev_samp("frac").alias("frac_sd"),
            F.min("frac").alias("frac_min"),
            F.max("frac").alias("frac_max"),
        )
    )
    return error_model(profile, lead_hours).join(first, "variable", "left")


def persistence_fraction(
    long: DataFrame,
    horizon: int = 24,
    keys: Sequence[str] = ("series_id", "variable"),
    circular: Sequence[str] = tuple(CIRCULAR),
    min_pairs: int = MIN_PAIRS,
) -> DataFrame:
    """RMSE of holding the value for ``horizon`` rows, relative to its spread."""
    keys = list(keys)
    rows = over_rows(long, keys, lambda w: {"_b": F.lag("value", horizon).over(w)}, before=horizon)
    rows = rows.filter(F.col("value").isNotNull() & F.col("_b").isNotNull())
    d = _difference(F.col("value"), F.col("_b"), circular)
    g = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.sqrt(F.avg(d * d)).alias("_rmse"),
        F.stddev_pop("value").alias("_sd"),
    )
    g = g.filter((F.col("n") >= min_pairs) & (F.col("_sd") > 0))
    return g.select(*keys, "n", (F.col("_rmse") / F.col("_sd")).alias("persist_frac"))


def persistence_alpha(fractions: DataFrame, model: DataFrame) -> DataFrame:
    """Error level at which a perturbed forecast is as bad as persistence."""
    j = fractions.join(model.select("variable", "sigma_frac"), "variable")
    j = j.filter(F.col("sigma_frac") > 0).withColumn("ratio", F.col("persist_frac") / F.col("sigma_frac"))
    return group_quantiles(j, ["variable"], "ratio", {"alpha_equivalent": 0.5})


def perturb(
    long: DataFrame,
    params: DataFrame,
    alpha: float,
    seed: int = 42,
    bounds: dict[str, tuple] | None = None,
    circular: dict[str, float] | None = None,
    rows: int = SCAN_ROWS,
) -> DataFrame:
    """Add stationary AR(1) error and bias to covariates, within their bounds.

    ``long`` holds series_id, variable, pos, value; ``params`` holds variable,
    sigma_frac, bias_frac, ar1.  alpha = 0 returns the input.  Innovations are
    hashed from (seed, series, variable, pos), so any task can recompute them.
    The recursion e = rho * e_before + sqrt(1 - rho**2) * z is an affine scan.
    """
    if alpha == 0:
        return long
    bounds = BOUNDS if bounds is None else bounds
    circular = CIRCULAR if circular is None else circular
    keys = ["series_id", "variable"]
    rho = F.least(F.greatest(F.coalesce(F.when(~F.isnan("ar1"), F.col("ar1")), F.lit(0.0)), F.lit(-0.99)), F.lit(0.99))
    facts = long.groupBy(*keys).agg(
        F.count("value").alias("_n"), F.stddev_pop("value").alias("_sd")
    )
    facts = facts.filter((F.col("_n") >= 2) & (F.col("_sd") > 0)).join(
        params.select("variable", "sigma_frac", "bias_frac", rho.alias("_rho")), "variable"
    )
    known = spread(long.withColumn("_b", chunk_of("pos")), facts, keys, "_b", "left")
    z = hashed_normal(seed, F.col("series_id"), F.col("variable"), F.col("pos"))
    first = F.col("pos") == 0
    step = F.sqrt(1.0 - F.col("_rho") * F.col("_rho"))
    j = affine_scan(known, keys, F.when(first, F.lit(0.0)).otherwise(F.col("_rho")), F.when(first, F.lit(1.0)).otherwise(step) * z, "_err", rows=rows)
    noisy = F.col("value") + alpha * F.col("_sd") * (
        F.coalesce("sigma_frac", F.lit(0.0)) * F.col("_err") + F.coalesce("bias_frac", F.lit(0.0))
    )
    kept = noisy
    for name, (lo, hi) in bounds.items():
        inside = noisy
        if lo is not None:
            inside = F.greatest(inside, F.lit(lo))
        if hi is not None:
            inside = F.least(inside, F.lit(hi))
        kept = F.when(F.col("variable") == name, inside).otherwise(kept)
    for name, period in circular.items():
        kept = F.when(F.col("variable") == name, F.pmod(noisy, F.lit(period))).otherwise(kept)
    value = F.when(F.col("_rho").isNotNull() & F.col("value").isNotNull(), kept).otherwise(F.col("value"))
    return j.select(*[value.alias(c) if c == "value" else F.col(c) for c in long.columns])


# --- sweeps over the error level --------------------------------------------


def sweep_cells(scores: DataFrame, cell: Sequence[str] = ("domain", "alpha", "seed")) -> DataFrame:
    """Mean of the per-series means, per cell and model."""
    per_series = scores.groupBy(*cell, "model", "series_id").agg(F.avg("MASE").alias("_m"))
    return per_series.groupBy(*cell, "model").agg(
        F.avg("_m").alias("mean_mase"), F.count(F.lit(1)).alias("n_series")
    )


def sweep_summary(cells: DataFrame) -> DataFrame:
    """Mean and spread over seeds of the cell means."""
    return cells.groupBy("domain", "model", "alpha").agg(
        F.avg("mean_mase").alias("mean_mase"),
        F.stddev_samp("mean_mase").alias("sd_across_seeds"),
        F.countDistinct("seed").alias("n_seeds"),
        F.max("n_series").alias("n_series"),
    )


def incomplete_cells(cells: DataFrame) -> DataFrame:
    """Cells that cover fewer series than the fullest cell of their domain.

    Empty means the sweep may be reported.
    """
    full = cells.groupBy("domain").agg(F.max("n_series").alias("expected"))
    return cells.join(full, "domain").filter(F.col("n_series") < F.col("expected"))


def invariance(summary: DataFrame, covariate_free: Sequence[str], tol: float = 1e-6) -> DataFrame:
    """Models without covariates must not move with the error level."""
    g = summary.filter(F.col("model").isin(list(covariate_free))).groupBy("domain", "model").agg(
        (F.max("mean_mase") - F.min("mean_mase")).alias("spread")
    )
    return g.withColumn("ok", F.col("spread") < tol)
