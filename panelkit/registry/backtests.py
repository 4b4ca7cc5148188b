"""Queries of the backtest and metric families."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from panelkit.functions import forecasters
from panelkit.operators import backtest as b
from panelkit.operators import boosting, features, metrics, report
from panelkit.operators import decide
from panelkit.registry.common import (
    CYCLES,
    DAILY_PANEL,
    FOLDS,
    H_FOLDS,
    H_HOURS,
    H_MIN_TRAIN,
    HORIZON,
    HOURLY_PANEL,
    LONG,
    MIN_TRAIN,
    MODELS,
    PREDS,
    SCORED,
    SEASON,
    SUPPLIER_PANEL,
    SUPPLIER_WEEKS,
    TIERS,
    WIDE,
    Registry,
    baseline_preds,
    folds,
    hourly_panel,
    panel,
    predicted,
    predictions,
    r,
    scale_cte,
    scored,
    scores,
    supplier_tiers,
    t,
    train_end,
    SCORES,
)
from panelkit.session import settled
from panelkit.sources import panels

reg = Registry()
QUERIES, ORACLES = reg.queries, reg.oracles

PRED_COLS = f"series_id, model, fold, lead, pos, {t('ts')}, {r('y_true')}, {r('y_pred')}"
SCORE_COLS = ", ".join(r(c) for c in ("MAE", "RMSE", "MASE", "nRMSE", "RMSE_pct_mean"))


@reg.add(
    "e1_folds",
    f"""WITH {SUPPLIER_PANEL}, s AS (SELECT series_id, max(n) AS n FROM panel GROUP BY series_id)
    SELECT series_id, n, fold, n - (6 - fold) * 4 AS pos_lo, n - (6 - fold) * 4 + 4 AS pos_hi, n - (6 - fold) * 4 - 1 AS origin_pos
    FROM s CROSS JOIN (SELECT unnest(range(6)) AS fold) WHERE n - (6 - fold) * 4 > {MIN_TRAIN}""",
)
def e1(spark, sf):
    return b.fold_table(panels.supplier_panel(spark, sf), HORIZON, FOLDS, MIN_TRAIN)


@reg.add(
    "e2_test_windows",
    f"""WITH {HOURLY_PANEL}, hist AS (SELECT * FROM panel),
    {folds(H_HOURS, H_FOLDS, H_MIN_TRAIN)}
    SELECT series_id, fold, lead, pos, {t("ts")}, {r("y")} FROM test""",
)
def e2(spark, sf):
    out = b.test_rows(hourly_panel(spark, sf), H_HOURS, H_FOLDS, H_MIN_TRAIN)
    return out.select("series_id", "fold", "lead", "pos", "ts", "y")


@reg.add(
    "e2_train_region",
    f"""WITH {SUPPLIER_PANEL} SELECT series_id, count(*) AS n_train, {r("sum(y)", "sum_y")} FROM panel
    WHERE pos < {train_end(HORIZON, FOLDS, MIN_TRAIN)} GROUP BY series_id""",
)
def e2_train(spark, sf):
    tr = b.train_rows(panels.supplier_panel(spark, sf), HORIZON, FOLDS, MIN_TRAIN)
    return tr.groupBy("series_id").agg(F.count(F.lit(1)).alias("n_train"), F.sum("y").alias("sum_y"))


@reg.add("e3_seasonal_naive", f"WITH {PREDS} SELECT {PRED_COLS} FROM preds WHERE model = 'seasonal_naive'")
def e3(spark, sf):
    p = panels.supplier_panel(spark, sf)
    return b.seasonal_naive(p, HORIZON, FOLDS, MIN_TRAIN, LONG)


@reg.add("e3_baselines", f"WITH {PREDS} SELECT {PRED_COLS} FROM preds")
def e3_all(spark, sf):
    """Three baselines from one pass over the panel."""
    return predictions(spark, sf)


@reg.add(
    "e3_hourly_naive_scores",
    f"""WITH {HOURLY_PANEL},
    {baseline_preds(H_HOURS, H_FOLDS, H_MIN_TRAIN, 24, 7, 168)},
    {scale_cte(H_HOURS, H_FOLDS, H_MIN_TRAIN, 24)},
    {SCORES}
    SELECT series_id, model, n_points, {SCORE_COLS} FROM scores WHERE model = 'seasonal_naive'""",
)
def flagship(spark, sf):
    """Raw events to scored seasonal-naive forecasts, end to end."""
    p = settled(hourly_panel(spark, sf), "gated")
    preds = b.seasonal_naive(p, H_HOURS, H_FOLDS, H_MIN_TRAIN)
    scale = metrics.mase_scale(p, b.first_train_end(H_HOURS, H_FOLDS, H_MIN_TRAIN))
    return metrics.score(preds, scale)


# --- ridge ------------------------------------------------------------------

# One feature has a closed form, so SQL can check the whole direct path.
RIDGE_SQL = f"""{SUPPLIER_PANEL},
ahead AS MATERIALIZED (SELECT series_id, pos, n, y AS x,
    lead(y, 1) OVER w AS y1, lead(y, 2) OVER w AS y2, lead(y, 3) OVER w AS y3, lead(y, 4) OVER w AS y4,
    lead(ts, 1) OVER w AS t1, lead(ts, 2) OVER w AS t2, lead(ts, 3) OVER w AS t3, lead(ts, 4) OVER w AS t4
  FROM panel WINDOW w AS (PARTITION BY series_id ORDER BY pos)),
rows AS MATERIALIZED (
  SELECT series_id, pos, n, 1 AS lead, x, y1 AS target, t1 AS target_ts FROM ahead WHERE y1 IS NOT NULL
  UNION ALL SELECT series_id, pos, n, 2, x, y2, t2 FROM ahead WHERE y2 IS NOT NULL
  UNION ALL SELECT series_id, pos, n, 3, x, y3, t3 FROM ahead WHERE y3 IS NOT NULL
  UNION ALL SELECT series_id, pos, n, 4, x, y4, t4 FROM ahead WHERE y4 IS NOT NULL),
sums AS MATERIALIZED (SELECT series_id, lead, fold, count(*) AS c, avg(x) AS mx, avg(target) AS my, stddev_pop(x) AS sx,
    covar_pop(x, target) AS cxy
  FROM rows CROSS JOIN (SELECT unnest(range(6)) AS fold) f
  WHERE pos + lead < n - 24 + fold * 4 GROUP BY ALL),
fit AS MATERIALIZED (SELECT *, CASE WHEN sx > 0 THEN c * cxy / sx / (c + 1.0) / sx ELSE 0 END AS beta FROM sums),
origins AS MATERIALIZED (SELECT *, CAST((pos + 1 - (n - 24)) // 4 AS BIGINT) AS fold FROM rows
  WHERE pos + 1 >= n - 24 AND (pos + 1 - (n - 24)) % 4 = 0 AND pos + 1 < n)"""


@reg.add(
    "e4_direct_ridge",
    f"""WITH {RIDGE_SQL}
    SELECT f.series_id, 'direct_ridge' AS model, f.fold, f.lead, r.pos + r.lead AS pos, {t("r.target_ts", "ts")},
      {r("r.target", "y_true")}, {r("f.my + f.beta * (r.x - f.mx)", "y_pred")}
    FROM fit f JOIN origins r ON r.series_id = f.series_id AND r.lead = f.lead AND r.fold = f.fold
    WHERE r.pos + 1 > {MIN_TRAIN}""",
)
def e4_one(spark, sf):
    """Per series, lead and fold; one feature, so that SQL has a closed form."""
    d = features.design(
        panel(spark, sf), range(1, HORIZON + 1), mode="none", lags=(0,), rolls=(), cal=False
    )
    return b.direct_ridge(d, ["ylag_0"], HORIZON, FOLDS, MIN_TRAIN)


FEATURES = [
    "ylag_0",
    "ylag_1",
    "ylag_4",
    "ylag_13",
    "rollmean_4",
    "rollmean_13",
    "futcal_month",
    "cov0_wx_discount",
]


def _full_design(spark, sf):
    return _full_rows(panel(spark, sf))


def _full_rows(p):
    return features.design(
        p,
        range(1, HORIZON + 1),
        ["wx_discount"],
        "causal",
        lags=(0, 1, 4, 13),
        rolls=(4, 13),
    )


@reg.add("e4_direct_ridge_full")
def e4_full(spark, sf):
    """Eight features; checked against a dense solve in the tests."""
    p = panel(spark, sf)
    # origins need the tail of a series only: the row before the first fold, and the 13 before that
    tail = _full_rows(b.recent_rows(p, HORIZON, FOLDS, 14))
    return b.ridge_forecasts(tail, _full_moments(p, FOLDS), FEATURES, HORIZON, FOLDS, MIN_TRAIN, 1.0, F.lit("direct_ridge"))


def _full_wide(p):
    return features.wide_design(p, range(1, HORIZON + 1), ["wx_discount"], lags=(0, 1, 4, 13), rolls=(4, 13))


#: The features as ``wide_design`` names them.
WIDE_FEATURES = [f"{f}_{{lead}}" if f == "futcal_month" else f for f in FEATURES]


def _full_moments(p, used):
    """Moments of every series and lead for the ``used`` first of the folds."""
    sums = b.moments_by_lead(_full_wide(p), {"": WIDE_FEATURES}, range(1, HORIZON + 1), HORIZON, FOLDS)
    return sums.filter(F.col("fold") < used)


@reg.add("e4_pooled_trees")
def e4_trees(spark, sf):
    """Pooled boosted trees, fitted before the first fold; scored from the origin of every fold, one row per series and fold."""
    d = _full_design(spark, sf)
    target_pos = F.col("pos") + F.col("lead")
    into = F.col("pos") + 1 - b.first_test_pos(HORIZON, FOLDS)
    train = d.filter(target_pos < b.first_test_pos(HORIZON, FOLDS))
    test = d.filter((into >= 0) & (into % HORIZON == 0) & (F.col("pos") + 1 > MIN_TRAIN) & F.col("target").isNotNull())
    test = test.withColumn("fold", F.floor(into / HORIZON).cast("int"))
    scored, _ = b.pooled_trees(train, test, [*FEATURES, "lead"])
    e = F.abs(F.col("target") - F.col("y_pred"))
    return scored.groupBy("series_id", "fold").agg(F.avg(e).alias("MAE"), F.count(F.lit(1)).alias("n_points"))


@reg.add("e4_direct_trees")
def e4_direct(spark, sf):
    """Boosted trees of every series and lead, 250 rounds, fitted before the first fold; forecasts of every fold."""
    return boosting.direct_trees(_full_design(spark, sf), FEATURES, HORIZON, FOLDS, MIN_TRAIN)


EFFECT_SQL = """sums AS (SELECT series_id, fold, count(*) AS c, avg(wx_discount) AS mx, avg(y) AS my,
    stddev_pop(wx_discount) AS sx, covar_pop(wx_discount, y) AS cxy
  FROM panel CROSS JOIN (SELECT unnest(range(6)) AS fold) f
  WHERE pos < n - 24 + fold * 4 AND wx_discount IS NOT NULL GROUP BY ALL),
fit AS (SELECT *, CASE WHEN c >= 48 AND sx > 0 THEN c * cxy / sx / (c + 1.0) / sx ELSE 0 END AS beta,
    c >= 48 AND sx > 0 AS usable FROM sums)"""


@reg.add(
    "e5_covariate_ridge",
    f"""WITH {SUPPLIER_PANEL}, {EFFECT_SQL}
    SELECT series_id, fold, CAST(c AS DOUBLE) AS n_rows, {r("beta")},
      {r("CASE WHEN usable THEN my - beta * mx ELSE 0 END", "intercept")} FROM fit""",
)
def e5(spark, sf):
    out = b.covariate_effect(panel(spark, sf), ["wx_discount"], HORIZON, FOLDS)
    return out.select("series_id", "fold", "n_rows", F.get("beta", F.lit(0)).alias("beta"), "intercept")


@reg.add(
    "e6_residual_naive",
    f"""WITH {SUPPLIER_PANEL}, {EFFECT_SQL},
    hist AS (SELECT *, lag(y, {LONG}) OVER w AS y0, lag(wx_discount, {LONG}) OVER w AS x0 FROM panel
      WINDOW w AS (PARTITION BY series_id ORDER BY pos)),
    {folds(HORIZON, FOLDS, MIN_TRAIN)}
    SELECT t.series_id, 'residual_naive' AS model, t.fold, t.lead, t.pos, {t("ts")}, {r("y", "y_true")},
      {r("y0 - f.beta * x0 + f.beta * wx_discount", "y_pred")}
    FROM test t JOIN fit f ON f.series_id = t.series_id AND f.fold = t.fold""",
)
def e6(spark, sf):
    p = panel(spark, sf)
    effects = b.covariate_effect(p, ["wx_discount"], HORIZON, FOLDS)
    return b.residual_naive(p, effects, ["wx_discount"], HORIZON, FOLDS, MIN_TRAIN, LONG)


@reg.add(
    "e6_residual_plugin",
    f"""WITH {SUPPLIER_PANEL}, {EFFECT_SQL}, hist AS (SELECT * FROM panel),
    {folds(HORIZON, FOLDS, MIN_TRAIN)},
    ends AS MATERIALIZED (SELECT f.series_id, f.fold, p.n - 24 + f.fold * 4 AS stop, greatest(p.n - 24 + f.fold * 4 - 672, 0) AS start, f.beta,
        CASE WHEN usable THEN my - beta * mx ELSE 0 END AS icept
      FROM fit f JOIN panel p ON p.series_id = f.series_id AND p.pos = 0),
    lines AS MATERIALIZED (SELECT e.*, z.y - e.icept - e.beta * z.wx_discount AS rz, a.y - e.icept - e.beta * a.wx_discount AS ra
      FROM ends e JOIN panel z ON z.series_id = e.series_id AND z.pos = e.stop - 1 JOIN panel a ON a.series_id = e.series_id AND a.pos = e.start)
    SELECT t.series_id, 'residual_drift' AS model, t.fold, t.lead, t.pos, {t("t.ts", "ts")}, {r("t.y", "y_true")},
      {r("l.rz + (l.rz - l.ra) / (l.stop - l.start - 1) * t.lead + l.icept + l.beta * t.wx_discount", "y_pred")}
    FROM test t JOIN lines l ON l.series_id = t.series_id AND l.fold = t.fold""",
)
def e6_plugin(spark, sf):
    """A plug-in on the covariate residual, with up to 672 rows of context."""
    p = panel(spark, sf)
    effects = b.covariate_effect(p, ["wx_discount"], HORIZON, FOLDS)
    done, _ = b.residual_plugin(
        p, effects, ["wx_discount"], forecasters.drift, HORIZON, FOLDS, MIN_TRAIN, model="residual_drift"
    )
    return done


CUTOFF, SINCE_ROWS = "1998-11-02", 125
SINCE_SQL = f"""{SUPPLIER_WEEKS},
late AS (SELECT series_id, TIMESTAMP '1995-01-02 00:00:00' + to_days(CAST(week * 7 AS INTEGER)) AS ts, y, wx_discount FROM weeks),
counted AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts) - 1 AS pos, count(*) OVER (PARTITION BY series_id) AS n
  FROM late WHERE ts >= TIMESTAMP '{CUTOFF}'),
panel AS MATERIALIZED (SELECT * FROM counted WHERE n >= {SINCE_ROWS})"""


@reg.add(
    "b13_since_cutoff_backtest",
    f"""WITH {SINCE_SQL}, {baseline_preds()}, {scale_cte(HORIZON, FOLDS, MIN_TRAIN, SEASON)}, {SCORES}
    SELECT series_id, model, n_points, {r("MAE")}, {r("RMSE")}, {r("MASE")} FROM scores""",
)
def b13_backtest(spark, sf):
    """Accuracy on what came after a cutoff only, with scales and folds of that part."""
    late, _ = b.rows_since(panel(spark, sf), CUTOFF, SINCE_ROWS)
    late = settled(late, "late")
    return scored(late, predicted(late)).select("series_id", "model", "n_points", "MAE", "RMSE", "MASE")


@reg.add(
    "b13_since_cutoff_rejects",
    f"""WITH {SUPPLIER_PANEL}, f AS (SELECT series_id, count_if(ts >= TIMESTAMP '{CUTOFF}') AS k FROM panel GROUP BY series_id)
    SELECT series_id, k AS rows_since, 'rows since cutoff ' || k || ' < {SINCE_ROWS}' AS reject_reason FROM f WHERE k < {SINCE_ROWS}""",
)
def b13_rejects(spark, sf):
    return b.rows_since(panel(spark, sf), CUTOFF, SINCE_ROWS)[1]


@reg.add(
    "e7_plugin_forecaster",
    f"""WITH {SUPPLIER_PANEL}, hist AS (SELECT * FROM panel),
    {folds(HORIZON, FOLDS, MIN_TRAIN)}
    SELECT t.series_id, 'drift' AS model, t.fold, t.lead, t.pos, {t("t.ts", "ts")}, {r("t.y", "y_true")},
      {r("z.y + (z.y - a.y) / 51.0 * t.lead", "y_pred")}
    FROM test t JOIN panel z ON z.series_id = t.series_id AND z.pos = t.pos - t.lead
    JOIN panel a ON a.series_id = t.series_id AND a.pos = t.pos - t.lead - 51""",
)
def e7(spark, sf):
    p = panel(spark, sf)
    f = b.plugin_forecast(p, forecasters.drift, HORIZON, FOLDS, MIN_TRAIN, context=52)
    return b.attach_truth(f, p, HORIZON, FOLDS, MIN_TRAIN, "drift")


def _fails_on_high(context: np.ndarray, horizon: int) -> np.ndarray:
    if context[-1] > 60:
        raise ValueError("level too high")
    return np.full(horizon, context[-1])


@reg.add(
    "e15_fault_isolation",
    f"""WITH {SUPPLIER_PANEL}
    SELECT series_id, fold, 'level too high' AS error
    FROM panel CROSS JOIN (SELECT unnest(range(6)) AS fold) f
    WHERE pos = n - 24 + fold * 4 - 1 AND n - 24 + fold * 4 > {MIN_TRAIN} AND y > 60""",
)
def e15(spark, sf):
    """A failing group yields its error; the others go on."""
    p = panels.supplier_panel(spark, sf)
    return b.failures(b.plugin_forecast(p, _fails_on_high, HORIZON, FOLDS, MIN_TRAIN, context=8))


@reg.add(
    "e8_attribution",
    f"""WITH {RIDGE_SQL},
    one AS (SELECT * FROM fit WHERE fold = 0 AND lead = 1)
    SELECT 'ylag_0' AS feature, {r("avg(abs(o.beta * (r.x - o.mx)))", "mean_abs")}
    FROM rows r JOIN one o ON o.series_id = r.series_id WHERE r.lead = 1 AND r.pos + 1 < r.n - 24""",
)
def e8(spark, sf):
    d = features.design(panels.supplier_panel(spark, sf), (1,), mode="none", lags=(0,), rolls=(), cal=False)
    d = d.filter(F.col("pos") + 1 < b.first_test_pos(HORIZON, FOLDS))
    fits = b.solve_ridge(b.moments(d, ["series_id", "lead"], ["ylag_0"], "target"), 1)
    return b.contributions(d, fits, ["ylag_0"], ["series_id", "lead"], top=10)


@reg.add("e8_attribution_full")
def e8_full(spark, sf):
    p = panel(spark, sf)
    fits = b.solve_ridge(_full_moments(p, 1).drop("fold"), len(FEATURES))
    named = dict(zip(FEATURES, WIDE_FEATURES, strict=True))
    return b.contributions_by_lead(_full_wide(p), fits, named, range(1, HORIZON + 1), b.first_test_pos(HORIZON, FOLDS), top=5)


POOL_SQL = f"""{SUPPLIER_PANEL}, {TIERS},
rows AS (SELECT a.series_id, a.pos, a.n, tier, a.y AS x, b.y AS target FROM panel a
  JOIN panel b ON b.series_id = a.series_id AND b.pos = a.pos + 1 JOIN tiers t ON t.series_id = a.series_id),
pool AS (SELECT count(*) * covar_pop(x, target) / (count(*) * var_pop(x) + 1.0) AS beta, avg(x) AS mx, avg(target) AS my
  FROM rows WHERE tier = 'rich' AND pos + 1 < n - 24),
own_rows AS (SELECT r.*, target - (p.my + p.beta * (x - p.mx)) AS res FROM rows r CROSS JOIN pool p
  WHERE tier = 'scarce' AND pos + 1 < n - 24 AND pos + 1 >= n - 24 - greatest(CAST(floor((n - 24) * 10.0 / 100.0) AS BIGINT), 18)),
own AS (SELECT series_id, count(*) AS c, count(*) * covar_pop(x, res) / (count(*) * var_pop(x) + 10.0) AS beta,
    avg(x) AS mx, avg(res) AS mr FROM own_rows GROUP BY series_id)"""


@reg.add(
    "e9_pooled_then_adapted",
    f"""WITH {POOL_SQL}
    SELECT series_id, CAST(1 AS BIGINT) AS lead, CAST(c AS DOUBLE) AS n_rows, {r("o.beta + p.beta", "beta")},
      {r("o.mr - o.beta * o.mx + p.my - p.beta * p.mx", "intercept")}
    FROM own o CROSS JOIN pool p""",
)
def e9(spark, sf):
    """Pooled on the rich tier, adapted on 10 % of each scarce series."""
    d = features.design(panel(spark, sf), (1,), mode="none", lags=(0,), rolls=(), cal=False)
    d = d.join(supplier_tiers(spark, sf), "series_id")
    end = b.first_test_pos(HORIZON, FOLDS)
    target_pos = F.col("pos") + F.col("lead")
    rich = d.filter((F.col("tier") == "rich") & F.col("target").isNotNull())
    pooled = b.pooled_fit(rich, ["ylag_0"], target_pos < end)
    budget = F.greatest(F.floor(end * 10.0 / 100.0), F.lit(18))
    scarce = d.filter((F.col("tier") == "scarce") & (target_pos < end) & (target_pos >= end - budget))
    out = b.adapted_fit(scarce, pooled, ["ylag_0"], kappa=10.0)
    return out.select("series_id", "lead", "n_rows", F.get("beta", F.lit(0)).alias("beta"), "intercept")


GRID_SQL = f"""{SUPPLIER_PANEL}, {TIERS},
mo AS (SELECT series_id, avg(y) AS mu, coalesce(nullif(stddev_samp(y), 0), 1) AS sd FROM panel WHERE pos < n - 24 GROUP BY series_id),
zp AS (SELECT p.series_id, p.pos, p.n, m.mu, m.sd, t.tier, CAST(CAST((p.y - m.mu) / m.sd AS FLOAT) AS DOUBLE) AS z
  FROM panel p JOIN mo m ON m.series_id = p.series_id JOIN tiers t ON t.series_id = p.series_id),
rows AS (SELECT a.*, g.lead, b.z AS target FROM zp a CROSS JOIN (SELECT unnest([1, 2, 3, 4]) AS lead) g
  JOIN zp b ON b.series_id = a.series_id AND b.pos = a.pos + g.lead),
pool AS (SELECT lead, count(*) * covar_pop(z, target) / (count(*) * var_pop(z) + 1.0) AS beta, avg(z) AS mx, avg(target) AS my
  FROM rows WHERE tier = 'rich' AND pos + lead < n - 24 GROUP BY lead),
tr AS (SELECT r.*, fr, target - (p.my + p.beta * (r.z - p.mx)) AS res FROM rows r JOIN pool p ON p.lead = r.lead
  CROSS JOIN (SELECT unnest([1.0, 10.0, 100.0]::DOUBLE[]) AS fr)
  WHERE tier = 'scarce' AND pos + r.lead < n - 24 AND pos + r.lead >= n - 24 - greatest(CAST(floor((n - 24) * fr / 100.0) AS BIGINT), 27)),
fits AS (SELECT series_id, lead, fr, 'transfer' AS strategy, count(*) * covar_pop(z, res) / (count(*) * var_pop(z) + 10.0) AS beta, avg(z) AS mx, avg(res) AS my, true AS add
    FROM tr GROUP BY series_id, lead, fr
  UNION ALL SELECT series_id, lead, fr, 'refit', CASE WHEN var_pop(z) > 0 THEN count(*) * covar_pop(z, target) / var_pop(z) / (count(*) + 1.0) ELSE 0 END, avg(z), avg(target), false
    FROM tr GROUP BY series_id, lead, fr),
orig AS (SELECT * FROM rows WHERE tier = 'scarce' AND pos + 1 >= n - 24 AND (pos + 1 - (n - 24)) % 4 = 0 AND pos + 1 > {MIN_TRAIN}),
out AS (SELECT o.series_id, f.strategy, f.fr AS fraction, (o.target - (f.my + f.beta * (o.z - f.mx) + CASE WHEN add THEN p.my + p.beta * (o.z - p.mx) ELSE 0 END)) * o.sd AS e,
    least(greatest(CAST(floor((o.n - 24) * f.fr / 100.0) AS BIGINT), 27), o.n - 24) AS h
  FROM orig o JOIN fits f ON f.series_id = o.series_id AND f.lead = o.lead JOIN pool p ON p.lead = o.lead
  UNION ALL SELECT o.series_id, 'transfer', 0, (o.target - (p.my + p.beta * (o.z - p.mx))) * o.sd, 0 FROM orig o JOIN pool p ON p.lead = o.lead)"""


@reg.add(
    "e9_transfer_grid",
    f"""WITH {GRID_SQL}, {scale_cte(HORIZON, FOLDS, MIN_TRAIN, SEASON)}
    SELECT o.series_id, strategy, {r("fraction")}, count(*) AS n_points, {r("avg(abs(e)) / any_value(scale)", "MASE")}, max(h) AS n_train_hours
    FROM out o JOIN scale s ON s.series_id = o.series_id GROUP BY o.series_id, strategy, fraction""",
)
def e9_grid(spark, sf):
    """Pool the rich tier on z-scores; transfer or refit the scarce series at
    four budgets, on one test window and one scale."""
    p = panel(spark, sf)
    end = b.first_test_pos(HORIZON, FOLDS)
    z = features.zscore(p, end).join(supplier_tiers(spark, sf), "series_id")
    level = z.select("series_id", "pos", "ts", "n", "tier", "mu_y", "sd_y", F.col("z_y").alias("y"))
    d = features.design(level, range(1, HORIZON + 1), mode="none", lags=(0,), rolls=(), cal=False)
    d = settled(d.filter(F.col("target").isNotNull()), "design")
    target_pos = F.col("pos") + F.col("lead")
    pooled = settled(b.pooled_fit(d.filter("tier = 'rich'"), ["ylag_0"], target_pos < end), "pooled")
    scarce = d.filter("tier = 'scarce'")
    out = b.transfer_grid(
        scarce, pooled, ["ylag_0"], HORIZON, FOLDS, MIN_TRAIN, (0, 1, 10, 100), LONG + HORIZON + 10
    )
    facts = scarce.groupBy("series_id").agg(F.max("sd_y").alias("sd_y"))
    scale = metrics.mase_scale(p, b.first_train_end(HORIZON, FOLDS, MIN_TRAIN), SEASON)
    e = F.abs(F.col("y_true") - F.col("y_pred"))
    g = out.groupBy("series_id", "strategy", "fraction").agg(
        F.count(F.lit(1)).alias("n_points"), F.avg(e).alias("_mae"), F.max("n_train_hours").alias("n_train_hours")
    )
    g = g.join(facts, "series_id").join(scale, "series_id")
    mase = F.col("_mae") * F.col("sd_y") / F.col("scale")
    return g.select("series_id", "strategy", "fraction", "n_points", mase.alias("MASE"), "n_train_hours")


@reg.add("e8_tree_importance")
def e8_trees(spark, sf):
    """Importance of each feature in the pooled trees."""
    d = _full_design(spark, sf)
    names = [*FEATURES, "lead"]
    train = d.filter(F.col("pos") + F.col("lead") < b.first_test_pos(HORIZON, FOLDS))
    _, weights = b.pooled_trees(train, d, names)
    pairs = list(zip(names, weights))
    return spark.createDataFrame(pairs, "feature string, importance double").orderBy(F.desc("importance"), "feature")


@reg.add("e8_tree_attribution")
def e8_attribution_of_trees(spark, sf):
    """Mean absolute Shapley value of each feature in the one-step trees of every series."""
    return boosting.tree_attribution(_full_design(spark, sf), FEATURES, HORIZON, FOLDS, MIN_TRAIN)


@reg.add(
    "e10_budget_refit",
    f"""WITH {RIDGE_SQL.replace("WHERE pos + lead <", "WHERE pos >= n - 24 - greatest(CAST(floor((n - 24) * 25.0 / 100.0) AS BIGINT), 27) AND pos + lead <")}
    SELECT f.series_id, 'budget_ridge' AS model, f.fold, f.lead, r.pos + r.lead AS pos, {t("r.target_ts", "ts")},
      {r("r.target", "y_true")}, {r("f.my + f.beta * (r.x - f.mx)", "y_pred")}
    FROM fit f JOIN origins r ON r.series_id = f.series_id AND r.lead = f.lead AND r.fold = f.fold
    WHERE r.pos + 1 > {MIN_TRAIN}""",
)
def e10(spark, sf):
    d = features.design(
        panel(spark, sf), range(1, HORIZON + 1), mode="none", lags=(0,), rolls=(), cal=False
    )
    end = b.first_test_pos(HORIZON, FOLDS)
    lo = end - F.greatest(F.floor(end * 25.0 / 100.0), F.lit(LONG + HORIZON + 10))
    return b.direct_ridge(
        d, ["ylag_0"], HORIZON, FOLDS, MIN_TRAIN, since_pos=lo, model="budget_ridge"
    )


@reg.add(
    "e11_history_regimes",
    f"""WITH {DAILY_PANEL},
    scale AS (SELECT series_id, greatest(avg(abs(y - y0)), 1e-9) AS scale FROM (
      SELECT *, lag(y, 7) OVER (PARTITION BY series_id ORDER BY pos) AS y0 FROM panel) WHERE pos < n - 42 GROUP BY series_id),
    g AS (SELECT series_id, y, w AS train_weeks, pos - (n - (w * 28 + 42)) AS pos, w * 28 + 42 AS n
      FROM panel CROSS JOIN (SELECT unnest([4, 12, 26, 52, 104]) AS w)
      WHERE w * 28 + 42 <= n AND pos >= n - (w * 28 + 42)),
    p AS (SELECT *, lag(y, 28) OVER (PARTITION BY series_id, train_weeks ORDER BY pos) AS y_pred FROM g)
    SELECT p.series_id, train_weeks, {r("avg(abs(y - y_pred)) / any_value(s.scale)", "MASE")}
    FROM p JOIN scale s ON s.series_id = p.series_id WHERE pos >= n - 42 GROUP BY p.series_id, train_weeks""",
)
def e11(spark, sf):
    """Naive accuracy under several history lengths, on one shared scale."""
    p = panels.daily_orders(spark, sf)
    scale = metrics.mase_scale(p, b.first_test_pos(7, 6), 7)
    g = b.history_regimes(p, [4, 12, 26, 52, 104], 7, 6, long_season=28)
    keyed = g.withColumn("series_id", F.concat_ws("|", "series_id", F.col("train_weeks").cast("string")))
    preds = b.seasonal_naive(keyed, 7, 6, 0, long_season=28)
    e = preds.withColumns(
        {
            "train_weeks": F.element_at(F.split("series_id", "[|]"), -1).cast("long"),
            "series_id": F.regexp_replace("series_id", r"\|\d+$", ""),
        }
    )
    return metrics.score(e, scale, ["series_id", "train_weeks"]).select("series_id", "train_weeks", "MASE")


@reg.add(
    "e12_seed_grid",
    f"""WITH {PREDS} SELECT series_id, model, seed, count(*) AS n_points, {r("avg(y_pred + seed * 0.5)", "mean_pred")}
    FROM preds CROSS JOIN (SELECT unnest([41, 42, 43]) AS seed) GROUP BY ALL""",
)
def e12(spark, sf):
    """Seed replicates as rows of one grid."""
    g = b.with_grid(predictions(spark, sf), seed=[41, 42, 43])
    return g.groupBy("series_id", "model", "seed").agg(
        F.count(F.lit(1)).alias("n_points"), F.avg(F.col("y_pred") + F.col("seed") * 0.5).alias("mean_pred")
    )


@reg.add(
    "e13_sweep_summary",
    f"""WITH {SCORED} SELECT model, count(MASE) AS n, {r("avg(MASE)", "mean")}, {r("median(MASE)", "median")},
      {r("stddev_samp(MASE)", "sd")}, {r("min(MASE)", "min")}, {r("max(MASE)", "max")} FROM scores GROUP BY model""",
)
def e13(spark, sf):
    return report.describe(settled(scores(spark, sf), "scores"), ["model"], "MASE")


@reg.add(
    "e14_panel_run",
    f"""WITH {SCORED}, {TIERS},
    best AS (SELECT series_id, arg_min(model, (MASE, model)) AS best_model FROM scores GROUP BY series_id)
    SELECT s.series_id, s.model, coalesce(t.tier, '?') AS tier, {r("s.MASE", "MASE")}, b.best_model
    FROM scores s JOIN best b ON b.series_id = s.series_id LEFT JOIN tiers t ON t.series_id = s.series_id""",
)
def e14(spark, sf):
    s = settled(scores(spark, sf), "scores")
    best = decide.best_model(s).select("series_id", "best_model")
    out = s.join(best, "series_id").join(supplier_tiers(spark, sf), "series_id", "left")
    return out.select("series_id", "model", F.coalesce("tier", F.lit("?")).alias("tier"), "MASE", "best_model")


@reg.add(
    "e14_mean_by_tier",
    f"""WITH {SCORED}, {TIERS}
    SELECT s.model, {r("avg(MASE) FILTER (tier = 'rich')", "mase_rich")}, {r("avg(MASE) FILTER (tier = 'scarce')", "mase_scarce")}
    FROM scores s JOIN tiers t ON t.series_id = s.series_id GROUP BY s.model""",
)
def e14_tier(spark, sf):
    j = scores(spark, sf).join(supplier_tiers(spark, sf), "series_id")
    return report.pivoted(j, ["model"], "tier", ["rich", "scarce"], {"mase": F.col("MASE")})


# --- metrics ----------------------------------------------------------------


@reg.add(
    "f1_mase_scale",
    f"WITH {SUPPLIER_PANEL}, {scale_cte(HORIZON, FOLDS, MIN_TRAIN, SEASON)} SELECT series_id, {r('scale')} FROM scale",
)
def f1(spark, sf):
    p = panels.supplier_panel(spark, sf)
    return metrics.mase_scale(p, b.first_train_end(HORIZON, FOLDS, MIN_TRAIN), SEASON)


@reg.add("f2_scores", f"WITH {SCORED} SELECT series_id, model, n_points, {SCORE_COLS} FROM scores")
def f2(spark, sf):
    return scores(spark, sf)


@reg.add(
    "f3_shared_scale",
    f"""WITH {PREDS}, {scale_cte(HORIZON, FOLDS, MIN_TRAIN, SEASON)}
    SELECT p.series_id, model, fold, {r("avg(abs(y_true - y_pred)) / any_value(scale)", "MASE")}
    FROM preds p JOIN scale s ON s.series_id = p.series_id GROUP BY p.series_id, model, fold""",
)
def f3(spark, sf):
    """Every fold is scored on the one scale of its series."""
    p = panel(spark, sf)
    preds = b.baselines(p, HORIZON, FOLDS, MIN_TRAIN, SEASON, CYCLES, LONG)
    scale = metrics.mase_scale(p, b.first_train_end(HORIZON, FOLDS, MIN_TRAIN), SEASON)
    return metrics.score(preds, scale, ["series_id", "model", "fold"]).select("series_id", "model", "fold", "MASE")


RUNS_SQL = """runs AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'A' THEN 'zeroshot_small'
    WHEN l_returnflag = 'R' THEN 'gru_s42' ELSE 'direct_trees' END AS model,
  l_quantity AS latency_s, CAST(l_linenumber * 24 AS BIGINT) AS n_forecasts, l_tax AS kwh, l_tax * 0.75 AS cpu_kwh, l_tax * 0.25 AS gpu_kwh,
  l_extendedprice AS n_params FROM lineitem)"""


def _runs(spark, sf):
    """Telemetry rows: quantity as latency, tax as metered energy."""
    flag = F.col("l_returnflag")
    model = F.when(flag == "A", "zeroshot_small").when(flag == "R", "gru_s42").otherwise("direct_trees")
    return panels.table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        model.alias("model"),
        F.col("l_quantity").alias("latency_s"),
        (F.col("l_linenumber") * 24).alias("n_forecasts"),
        F.col("l_tax").alias("kwh"),
        (F.col("l_tax") * 0.75).alias("cpu_kwh"),
        (F.col("l_tax") * 0.25).alias("gpu_kwh"),
        F.col("l_extendedprice").alias("n_params"),
    )


J = "latency_s * (CASE WHEN model LIKE 'zeroshot%' OR model LIKE 'gru%' THEN 200.0::DOUBLE ELSE 65.0 END) * 1.4::DOUBLE * (1000.0::DOUBLE / greatest(n_forecasts, 1))"


@reg.add(
    "f4_f6_proxy_cost",
    f"""WITH {RUNS_SQL} SELECT l_orderkey, l_linenumber, model, {r(J, "energy_j_per_1k")},
      {r(f"{J} / 3.6e6 * 0.15", "usd_per_1k")}, {r("1000.0::DOUBLE * latency_s / greatest(n_forecasts, 1)", "per_forecast_ms")} FROM runs""",
)
def f4(spark, sf):
    out = metrics.proxy_cost(_runs(spark, sf), ["zeroshot", "gru"])
    return out.select(
        "l_orderkey", "l_linenumber", "model", "energy_j_per_1k", "usd_per_1k", "per_forecast_ms"
    )


K = "(1000.0::DOUBLE / greatest(n_forecasts, 1))"


@reg.add(
    "f5_measured_cost",
    f"""WITH {RUNS_SQL} SELECT l_orderkey, l_linenumber, {r(f"kwh * 3.6e6 * {K}", "measured_j_per_1k")},
      {r(f"cpu_kwh * 3.6e6 * {K}", "measured_cpu_j_per_1k")}, {r(f"gpu_kwh * 3.6e6 * {K}", "measured_gpu_j_per_1k")},
      {r(f"kwh * {K} * 0.15", "measured_usd_per_1k")} FROM runs""",
)
def f5(spark, sf):
    out = metrics.measured_cost(_runs(spark, sf))
    return out.select("l_orderkey", "l_linenumber", *[c for c in out.columns if c.startswith("measured")])


REPS = """cells AS (SELECT l_suppkey, l_returnflag, count(l_tax) AS n_reps, avg(l_tax) AS mean, stddev_samp(l_tax) AS sd,
    min(l_tax) AS lo, max(l_tax) AS hi, stddev_samp(l_tax) / CASE WHEN avg(l_tax) <> 0 THEN avg(l_tax) END AS rel_sd
  FROM lineitem GROUP BY ALL),
gated AS (SELECT *, coalesce(rel_sd > 0.65, false) AS gate FROM cells)"""


@reg.add(
    "f7_repeatability",
    f"""WITH {REPS} SELECT l_suppkey, l_returnflag, n_reps, {r("mean")}, {r("sd")}, {r("lo")}, {r("hi")}, {r("rel_sd")}, gate FROM gated""",
)
def f7(spark, sf):
    li = panels.table(spark, sf, "lineitem")
    return metrics.repeatability(li, ["l_suppkey", "l_returnflag"], "l_tax", gate=0.65)


@reg.add(
    "f8_amortisation",
    f"""WITH g AS (SELECT l_suppkey, l_returnflag, avg(l_extendedprice) AS a, avg(l_quantity) AS o, avg(l_linenumber) AS z
      FROM lineitem GROUP BY ALL),
    h AS (SELECT *, (a - o) / 5.0 AS train FROM g),
    i AS (SELECT *, (o - train) / 144.0 AS il, z / 144.0 AS iz FROM h)
    SELECT l_suppkey, l_returnflag, {r("train", "train_per_fit_j")}, {r("il", "infer_local_j")}, {r("iz", "infer_zeroshot_j")},
      iz - il > 0 AS local_cheaper, {r("CASE WHEN iz - il > 0 THEN train / (iz - il) END", "crossover")} FROM i""",
)
def f8(spark, sf):
    li = panels.table(spark, sf, "lineitem").select(
        "l_suppkey",
        "l_returnflag",
        F.col("l_extendedprice").alias("e_retrain_j"),
        F.col("l_quantity").alias("e_once_j"),
        F.col("l_linenumber").cast("double").alias("e_zeroshot_j"),
    )
    return metrics.amortisation(li, ["l_suppkey", "l_returnflag"])


@reg.add(
    "f9_range_or_mean",
    f"""WITH {REPS} SELECT l_suppkey, l_returnflag, gate, {r("CASE WHEN gate THEN lo END", "shown_lo")},
      {r("CASE WHEN gate THEN hi END", "shown_hi")}, {r("CASE WHEN NOT gate THEN mean END", "shown_mean")},
      {r("CASE WHEN NOT gate THEN sd END", "shown_sd")} FROM gated""",
)
def f9(spark, sf):
    li = panels.table(spark, sf, "lineitem")
    cells = metrics.range_or_mean(metrics.repeatability(li, ["l_suppkey", "l_returnflag"], "l_tax", 0.65))
    shown = [c for c in cells.columns if c.startswith("shown")]
    return cells.select("l_suppkey", "l_returnflag", "gate", *shown)


@reg.add(
    "f10_table_cost",
    f"""WITH {RUNS_SQL} SELECT model, {r(f"avg({J}) / 3.6e6 * 0.15 * 1.4", "usd_with_pue")} FROM runs GROUP BY model""",
)
def f10(spark, sf):
    out = metrics.proxy_cost(_runs(spark, sf), ["zeroshot", "gru"])
    return out.groupBy("model").agg(metrics.table_cost(F.avg("energy_j_per_1k")).alias("usd_with_pue"))


@reg.add("f11_model_sizes", f"WITH {RUNS_SQL} SELECT model, {r('max(n_params)', 'n_params')} FROM runs GROUP BY model")
def f11(spark, sf):
    return metrics.model_sizes(_runs(spark, sf))


@reg.add(
    "f11_cost_ratio",
    f"""WITH {RUNS_SQL}, c AS (SELECT model, {J} / 3.6e6 * 0.15 AS u FROM runs),
    m AS (SELECT avg(u) FILTER (model = 'gru_s42') AS mean_a, avg(u) FILTER (model = 'direct_trees') AS mean_b FROM c)
    SELECT {r("mean_a")}, {r("mean_b")}, {r("mean_a / mean_b", "ratio")} FROM m""",
)
def f11_ratio(spark, sf):
    out = metrics.proxy_cost(_runs(spark, sf), ["zeroshot", "gru"])
    return metrics.cost_ratio(out, "gru_s42", "direct_trees")
