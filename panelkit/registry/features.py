"""Queries of the feature family."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelkit.operators import backtest, features as f, quality
from panelkit.registry.common import (
    DAILY_PANEL,
    FOLDS,
    HORIZON,
    HOURLY_PANEL,
    LONG,
    MIN_TRAIN,
    READINGS,
    SUPPLIER_PANEL,
    Registry,
    folds,
    hourly_panel,
    r,
    t,
    train_end,
)
from panelkit.sources import panels

reg = Registry()
QUERIES, ORACLES = reg.queries, reg.oracles

LAGS, ROLLS = (0, 1, 2, 3, 4, 5, 13), (4, 13)
W = "WINDOW w AS (PARTITION BY series_id ORDER BY pos)"
CAL = "hour({0}) AS {1}hour, isodow({0}) - 1 AS {1}dow, month({0}) AS {1}month, CAST(isodow({0}) >= 6 AS BIGINT) AS {1}is_weekend"


def sql_lags(lags, value="y"):
    return ", ".join(r(f"lag({value}, {k}) OVER w", f"ylag_{k}") for k in lags)


def sql_rolls(widths, inclusive=True):
    out = []
    for w in widths:
        frame = f"ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW" if inclusive else f"ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING"
        over = f"OVER (PARTITION BY series_id ORDER BY pos {frame})"
        out.append(r(f"CASE WHEN count(y) {over} = {w} THEN avg(y) {over} END", f"rollmean_{w}"))
    return ", ".join(out)


@reg.add(
    "d1_origin_lags",
    f"WITH {SUPPLIER_PANEL} SELECT series_id, pos, {sql_lags(LAGS)} FROM panel {W}",
)
def d1(spark, sf):
    p = panels.supplier_panel(spark, sf)
    out = f.origin_features(p, LAGS, ())
    return out.select("series_id", "pos", *[f"ylag_{k}" for k in LAGS])


@reg.add(
    "d2_rolling_means",
    f"WITH {HOURLY_PANEL} SELECT series_id, pos, {sql_lags(f.LAGS)}, {sql_rolls(f.ROLLS)} FROM panel {W}",
)
def d2(spark, sf):
    """The full hourly feature set on the gated panel."""
    out = f.origin_features(hourly_panel(spark, sf))
    cols = [f"ylag_{k}" for k in f.LAGS] + [f"rollmean_{w}" for w in f.ROLLS]
    return out.select("series_id", "pos", *cols)


@reg.add(
    "d2b_exclusive_features",
    f"WITH {SUPPLIER_PANEL} SELECT series_id, pos, {sql_lags(LAGS[1:])}, {sql_rolls(ROLLS, False)} FROM panel {W}",
)
def d2b(spark, sf):
    out = f.origin_features(panels.supplier_panel(spark, sf), LAGS[1:], ROLLS, inclusive=False)
    cols = [f"ylag_{k}" for k in LAGS[1:]] + [f"rollmean_{w}" for w in ROLLS]
    return out.select("series_id", "pos", *cols)


@reg.add(
    "d3_calendar",
    f"WITH {READINGS} SELECT series_id, seq, {t('ts')}, {CAL.format('ts', '')} FROM readings",
)
def d3(spark, sf):
    e = panels.event_readings(spark, sf).drop("y")
    return f.with_calendar(e)


@reg.add(
    "d4_lead_targets",
    f"WITH {SUPPLIER_PANEL} SELECT series_id, pos, "
    + ", ".join(r(f"lead(y, {h}) OVER w", f"y_lead_{h}") for h in range(1, HORIZON + 1))
    + f" FROM panel {W}",
)
def d4(spark, sf):
    out = f.lead_targets(panels.supplier_panel(spark, sf), HORIZON)
    return out.select("series_id", "pos", *[f"y_lead_{h}" for h in range(1, HORIZON + 1)])


def _design_sql(mode_cols: str) -> str:
    return f"""WITH {SUPPLIER_PANEL},
    feats AS (SELECT *, {sql_lags((0, 1, 13))}, {sql_rolls((4,))} FROM panel {W})
    SELECT a.series_id, a.pos, g.lead, a.ylag_0, a.ylag_1, a.ylag_13, a.rollmean_4,
      {r("b.y", "target")}, {t("b.ts", "target_ts")}, {CAL.format("b.ts", "futcal_")}, {mode_cols}
    FROM feats a CROSS JOIN (SELECT unnest([1, 2, 4]) AS lead) g
    LEFT JOIN panel b ON b.series_id = a.series_id AND b.pos = a.pos + g.lead"""


def _design(spark, sf, mode):
    d = f.design(
        panels.supplier_panel(spark, sf), (1, 2, 4), ["wx_discount"], mode, lags=(0, 1, 13), rolls=(4,)
    )
    return d.drop("ts", "y", "n")


@reg.add("d5_d7_design_causal", _design_sql(r("a.wx_discount", "cov0_wx_discount")))
def d7(spark, sf):
    """Calendar at the target stamp, covariates at the origin."""
    return _design(spark, sf, "causal")


@reg.add("d5_d6_design_perfect", _design_sql(r("b.wx_discount", "fut_wx_discount")))
def d6(spark, sf):
    """Calendar and covariates at the target stamp."""
    return _design(spark, sf, "perfect")


@reg.add(
    "d8_freeze_covariates",
    f"""WITH {SUPPLIER_PANEL}, hist AS (SELECT * FROM panel),
    marked AS (SELECT *, CASE WHEN pos >= n - 24 THEN n - 24 + CAST(floor((pos - (n - 24)) / 4.0) AS BIGINT) * 4 - 1 ELSE pos END AS src
      FROM hist)
    SELECT m.series_id, m.pos, {r("coalesce(s.wx_discount, m.wx_discount)", "wx_discount")}
    FROM marked m LEFT JOIN panel s ON s.series_id = m.series_id AND s.pos = m.src""",
)
def d8(spark, sf):
    out = f.freeze_covariates(panels.supplier_panel(spark, sf), ["wx_discount"], FOLDS, HORIZON)
    return out.select("series_id", "pos", "wx_discount")


@reg.add(
    "d9_zscore",
    f"""WITH {SUPPLIER_PANEL},
    m AS (SELECT series_id, avg(y) AS mu, stddev_samp(y) AS sd FROM panel
      WHERE pos < {train_end(HORIZON, FOLDS, MIN_TRAIN)} GROUP BY series_id)
    SELECT p.series_id, p.pos, {r("mu", "mu_y")}, {r("CASE WHEN sd > 0 THEN sd ELSE 1 END", "sd_y")},
      {r("CAST((y - mu) / CASE WHEN sd > 0 THEN sd ELSE 1 END AS FLOAT)", "z_y")}
    FROM panel p JOIN m ON m.series_id = p.series_id""",
)
def d9(spark, sf):
    p = panels.supplier_panel(spark, sf)
    out = f.zscore(p, backtest.first_train_end(HORIZON, FOLDS, MIN_TRAIN))
    return out.select("series_id", "pos", "mu_y", "sd_y", "z_y")


@reg.add(
    "d10_window_arrays",
    f"""WITH {SUPPLIER_PANEL},
    w AS (SELECT series_id, pos, n,
      list(y) OVER (PARTITION BY series_id ORDER BY pos ROWS BETWEEN {LONG} PRECEDING AND 1 PRECEDING) AS x,
      list(y) OVER (PARTITION BY series_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND {HORIZON - 1} FOLLOWING) AS tg
    FROM panel)
    SELECT series_id, pos, len(x) AS n_x, len(tg) AS n_target, {r("x[1]", "x_first")}, {r("x[-1]", "x_last")},
      {r("list_sum(x)", "x_sum")}, {r("tg[1]", "target_first")}, {r("list_sum(tg)", "target_sum")}
    FROM w WHERE pos >= {LONG} AND pos < n - {HORIZON}""",
)
def d10(spark, sf):
    w = f.window_arrays(panels.supplier_panel(spark, sf), LONG, HORIZON)

    def total(c):
        return F.aggregate(c, F.lit(0.0), lambda a, v: a + v)

    return w.select(
        "series_id",
        "pos",
        F.size("x").alias("n_x"),
        F.size("target").alias("n_target"),
        F.element_at("x", 1).alias("x_first"),
        F.element_at("x", -1).alias("x_last"),
        total("x").alias("x_sum"),
        F.element_at("target", 1).alias("target_first"),
        total("target").alias("target_sum"),
    )


@reg.add(
    "d11_budget_slice",
    f"""WITH {SUPPLIER_PANEL},
    e AS (SELECT *, n - 24 AS te, greatest(CAST(floor((n - 24) * 10.0 / 100.0) AS BIGINT), {LONG + HORIZON + 1}) AS cut FROM panel),
    s AS (SELECT *, greatest(te - cut, 0) AS lo FROM e),
    v AS (SELECT *, te - lo AS n_hours, CAST(floor((te - lo) * 0.15) AS BIGINT) AS n_val FROM s)
    SELECT series_id, pos, n_hours, CAST(10.0 AS DOUBLE) AS fraction,
      CASE WHEN (n_hours - n_val <= {LONG + 1}) OR (n_val < {HORIZON + 1}) OR pos < te - n_val THEN 'train' ELSE 'val' END AS split
    FROM v WHERE pos >= lo AND pos < te""",
)
def d11(spark, sf):
    p = panels.supplier_panel(spark, sf)
    out = f.budget_slice(p, backtest.first_test_pos(HORIZON, FOLDS), 10.0, LONG, HORIZON)
    return out.select("series_id", "pos", "n_hours", "fraction", "split")


@reg.add(
    "d12_train_val_split",
    f"""WITH {SUPPLIER_PANEL}
    SELECT series_id, pos, CASE WHEN pos < n - 24 - greatest(CAST(floor((n - 24) * 0.1) AS BIGINT), {LONG + HORIZON + 1})
      THEN 'train' ELSE 'val' END AS split FROM panel WHERE pos < n - 24""",
)
def d12(spark, sf):
    p = panels.supplier_panel(spark, sf)
    out = f.train_val_split(p, backtest.first_test_pos(HORIZON, FOLDS), LONG, HORIZON)
    return out.select("series_id", "pos", "split")


@reg.add(
    "d13_complete_cases",
    f"""WITH {SUPPLIER_PANEL}, fe AS (SELECT series_id, pos, {sql_lags((1, 13))}, {sql_rolls((13,))} FROM panel {W})
    SELECT * FROM fe WHERE ylag_1 IS NOT NULL AND ylag_13 IS NOT NULL AND rollmean_13 IS NOT NULL""",
)
def d13(spark, sf):
    out = f.origin_features(panels.supplier_panel(spark, sf), (1, 13), (13,))
    cols = ["ylag_1", "ylag_13", "rollmean_13"]
    return f.complete_cases(out, cols).select("series_id", "pos", *cols)


@reg.add(
    "d14_observation_gaps",
    f"""WITH {READINGS} SELECT series_id, seq, {t("ts")},
      {r("(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY series_id ORDER BY ts))) / 1e6", "gap_s")} FROM readings""",
)
def d14(spark, sf):
    return quality.observation_gaps(panels.event_readings(spark, sf)).drop("y")
