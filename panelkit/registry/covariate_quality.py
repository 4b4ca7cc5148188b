"""Queries of the covariate-quality family."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelkit.operators import covariates as c
from panelkit.operators import joins
from panelkit.operators import backtest
from panelkit.plans.ordered import over_rows
from panelkit.registry.common import SCORED, SUPPLIER_PANEL, Registry, panel, r, scores, t, write_series_files
from panelkit.session import settled, shared_dir
from panelkit.sources import files, panels

reg = Registry()
QUERIES, ORACLES = reg.queries, reg.oracles

LEADS = (1, 2, 3)
LONG_SQL = f"""{SUPPLIER_PANEL},
long AS (SELECT series_id, pos, 'precipitation' AS variable, y AS value FROM panel
  UNION ALL SELECT series_id, pos, 'wind_direction_10m', CAST(CAST(y AS BIGINT) * 7 % 360 AS DOUBLE) FROM panel)"""


def _long(spark, sf):
    """Weekly quantity as a bounded variable, and a circular one made of it."""
    p = panel(spark, sf)
    wide = p.select(
        "series_id",
        "pos",
        F.col("y").alias("precipitation"),
        F.pmod(F.col("y").cast("long") * 7, F.lit(360)).cast("double").alias("wind_direction_10m"),
    )
    return c.long_variables(wide, ["series_id", "pos"], ["precipitation", "wind_direction_10m"])


PROFILE_SQL = f"""{LONG_SQL},
pairs AS (SELECT a.series_id, a.variable, g.k AS lead_day, a.pos - g.k AS pos, a.value AS actual, b.value AS predicted
  FROM long a CROSS JOIN (SELECT unnest([1, 2, 3]) AS k) g
  JOIN long b ON b.series_id = a.series_id AND b.variable = a.variable AND b.pos = a.pos - g.k),
errs AS (SELECT *, CASE WHEN variable = 'wind_direction_10m' THEN ((predicted - actual + 180) % 360 + 360) % 360 - 180 ELSE predicted - actual END AS e FROM pairs),
cent AS (SELECT *, e - avg(e) OVER (PARTITION BY series_id, variable, lead_day) AS x FROM errs),
lagx AS (SELECT *, lag(x) OVER (PARTITION BY series_id, variable, lead_day ORDER BY pos) AS x1 FROM cent),
profile AS (SELECT series_id, variable, lead_day, count(*) AS n, avg(abs(e)) AS mae, sqrt(avg(e * e)) AS rmse, avg(e) AS bias,
    stddev_pop(e) AS sd, stddev_pop(actual) AS actual_sd, sum(x * x1) / sum(x * x) AS err_ar1
  FROM lagx GROUP BY ALL HAVING count(*) >= 48)"""


def _profile(spark, sf, long=None):
    """Persistence at 1 to 3 rows plays the forecast of each lead."""
    long = _long(spark, sf) if long is None else long
    rows = over_rows(
        long,
        ["series_id", "variable"],
        lambda w: {"_p": F.array(*[F.lag("value", k).over(w) for k in LEADS])},
        before=max(LEADS),
    )
    pairs = rows.select(
        "series_id", "variable", "pos", F.col("value").alias("actual"), F.posexplode("_p").alias("_i", "predicted")
    ).filter(F.col("predicted").isNotNull())
    pairs = pairs.withColumn("lead_day", F.col("_i") + 1)
    pairs = pairs.withColumn("pos", F.col("pos") - F.col("lead_day")).drop("_i")
    return settled(c.error_profile(pairs), "profile")


PROFILE_COLS = f"series_id, variable, lead_day, n, {r('mae')}, {r('rmse')}, {r('bias')}, {r('sd')}, {r('actual_sd')}, {r('err_ar1')}"


@reg.add("i1_error_profile", f"WITH {PROFILE_SQL} SELECT {PROFILE_COLS} FROM profile")
def i1(spark, sf):
    return _profile(spark, sf)


# --- a forecast archive in wide files ----------------------------------------

ARCHIVE_SQL = """obs AS (SELECT date_trunc('day', l_shipdate)::TIMESTAMP AS ts, 'l' || l_linenumber AS series_id, avg(l_discount) * 100 AS cloud_cover,
    CAST(CAST(sum(l_quantity) AS BIGINT) * 7 % 360 AS DOUBLE) AS wind_direction_10m FROM lineitem GROUP BY ALL),
long AS (SELECT series_id, ts, 'cloud_cover' AS variable, cloud_cover AS value FROM obs
  UNION ALL SELECT series_id, ts, 'wind_direction_10m', wind_direction_10m FROM obs),
pairs AS (SELECT a.series_id, a.variable, CAST(g.k AS INTEGER) AS lead_day, a.ts, round(a.value, 6) AS actual, round(b.value, 6) AS predicted
  FROM long a CROSS JOIN (SELECT unnest([1, 2, 3]) AS k) g
  JOIN long b ON b.series_id = a.series_id AND b.variable = a.variable AND b.ts = a.ts - to_days(CAST(g.k AS INTEGER))
  WHERE g.k = 1 OR a.series_id NOT IN ('l1', 'l2') AND (g.k = 2 OR a.variable = 'cloud_cover')),
errs AS (SELECT *, CASE WHEN variable = 'wind_direction_10m' THEN ((predicted - actual + 180) % 360 + 360) % 360 - 180 ELSE predicted - actual END AS e FROM pairs),
cent AS (SELECT *, e - avg(e) OVER (PARTITION BY series_id, variable, lead_day) AS x FROM errs),
lagx AS (SELECT *, lag(x) OVER (PARTITION BY series_id, variable, lead_day ORDER BY ts) AS x1 FROM cent),
profile AS (SELECT series_id, variable, lead_day, count(*) AS n, avg(abs(e)) AS mae, sqrt(avg(e * e)) AS rmse, avg(e) AS bias,
    stddev_pop(e) AS sd, stddev_pop(actual) AS actual_sd, sum(x * x1) / sum(x * x) AS err_ar1
  FROM lagx GROUP BY ALL HAVING count(*) >= 48)"""


def _archive(spark, sf):
    """Files of daily weather-like columns by line number; what came k days before plays the forecast of lead k.

    Two series have one lead only, the others leads 1 and 2, and 3 for one variable.
    """
    base = shared_dir(spark, "archive")
    day = F.to_date("l_shipdate").cast("timestamp").alias("ts")
    obs = panels.table(spark, sf, "lineitem").groupBy(F.concat(F.lit("l"), F.col("l_linenumber").cast("string")).alias("series_id"), day)
    obs = obs.agg(
        F.round(F.avg("l_discount") * 100, 6).alias("cloud_cover"),
        (F.sum("l_quantity").cast("long") * 7 % 360).cast("double").alias("wind_direction_10m"),
    )
    wide = settled(obs, "observed")
    for k in LEADS:
        names = [F.col(v).alias(f"{v}_previous_day{k}") for v in ("cloud_cover", "wind_direction_10m")]
        earlier = obs.select("series_id", (F.col("ts") + F.expr(f"INTERVAL {k} DAYS")).alias("ts"), *names)
        wide = wide.join(earlier, ["series_id", "ts"], "left")
    wide = settled(wide.withColumn("timestamp", F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).drop("ts"), "archive-wide")
    short = F.col("series_id").isin("l1", "l2")
    for folder, rows, lacking in (
        ("short", wide.filter(short), [f"{v}_previous_day{k}" for v in ("cloud_cover", "wind_direction_10m") for k in (2, 3)]),
        ("long", wide.filter(~short), ["wind_direction_10m_previous_day3"]),
    ):
        write_series_files(rows.drop(*lacking), base, folder)
    return files.archive_csv(spark, f"{base}/files")


def _archive_pairs(spark, sf):
    return settled(c.archive_pairs(_archive(spark, sf)), "pairs")


@reg.add("i1_archive_pairs", f"WITH {ARCHIVE_SQL} SELECT series_id, variable, lead_day, {t('ts')}, row_number() OVER (PARTITION BY series_id, variable, lead_day ORDER BY ts) - 1 AS pos, {r('actual')}, {r('predicted')} FROM pairs")
def i1_pairs(spark, sf):
    """Forecasts of every lead that a file has, beside what came."""
    return _archive_pairs(spark, sf)


@reg.add("i1_archive_profile", f"WITH {ARCHIVE_SQL} SELECT {PROFILE_COLS} FROM profile")
def i1_archive(spark, sf):
    return c.error_profile(_archive_pairs(spark, sf))


MODEL_SQL = f"""{PROFILE_SQL},
lead AS (SELECT variable, lead_day * 24.0::DOUBLE + 12 AS x, avg(rmse / actual_sd) AS f, avg(bias / actual_sd) AS bf, avg(err_ar1) AS ar1, sum(n) AS n
  FROM profile WHERE actual_sd > 0 GROUP BY variable, lead_day),
model AS (SELECT variable, least(greatest(regr_intercept(f, x) + regr_slope(f, x) * 12, 0.02), min(f)) AS sigma_frac, avg(bf) AS bias_frac,
    coalesce(avg(ar1), 0) AS ar1, arg_min(f, x) AS measured_lead1_frac, CAST(sum(n) AS BIGINT) AS n_obs FROM lead GROUP BY variable)"""
MODEL_COLS = f"variable, {r('sigma_frac')}, {r('bias_frac')}, {r('ar1')}, {r('measured_lead1_frac')}, n_obs"


@reg.add("i2_error_model", f"WITH {MODEL_SQL} SELECT {MODEL_COLS} FROM model")
def i2(spark, sf):
    return c.error_model(_profile(spark, sf))


PERSIST_SQL = """held AS (SELECT a.series_id, a.variable, a.value, CASE WHEN a.variable = 'wind_direction_10m'
    THEN ((a.value - b.value + 180) % 360 + 360) % 360 - 180 ELSE a.value - b.value END AS d
  FROM long a JOIN long b ON b.series_id = a.series_id AND b.variable = a.variable AND b.pos = a.pos - 13),
persist AS (SELECT series_id, variable, count(*) AS n, sqrt(avg(d * d)) / stddev_pop(value) AS persist_frac FROM held GROUP BY ALL HAVING count(*) >= 48)"""


@reg.add(
    "i3_persistence_fraction",
    f"WITH {LONG_SQL}, {PERSIST_SQL} SELECT series_id, variable, n, {r('persist_frac')} FROM persist",
)
def i3(spark, sf):
    return c.persistence_fraction(_long(spark, sf), horizon=13)


@reg.add(
    "i3_persistence_alpha",
    f"""WITH {MODEL_SQL}, {PERSIST_SQL} SELECT p.variable, count(*) AS n, {r("median(persist_frac / sigma_frac)", "alpha_equivalent")}
    FROM persist p JOIN model m ON m.variable = p.variable GROUP BY p.variable""",
)
def i3_alpha(spark, sf):
    long = settled(_long(spark, sf), "long")
    frac = c.persistence_fraction(long, horizon=13)
    return c.persistence_alpha(frac, c.error_model(_profile(spark, sf, long)))


def _uniform(tag: str) -> str:
    text = f"'42|' || l.series_id || '|' || l.variable || '|' || l.pos || '|{tag}'"
    return f"((CAST('0x' || substr(md5({text}), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE)"


@reg.add(
    "i4_perturb",
    f"""WITH RECURSIVE {SUPPLIER_PANEL},
    long AS MATERIALIZED (SELECT series_id, pos, 'precipitation' AS variable, y AS value FROM panel
      UNION ALL SELECT series_id, pos, 'wind_direction_10m', CAST(CAST(y AS BIGINT) * 7 % 360 AS DOUBLE) FROM panel),
    params AS (SELECT * FROM (VALUES ('precipitation', 0.4::DOUBLE, 0.1::DOUBLE, 0.6::DOUBLE), ('wind_direction_10m', 0.3::DOUBLE, 0.0::DOUBLE, 0.8::DOUBLE)) v(variable, sg, bi, rho)),
    z AS MATERIALIZED (SELECT l.series_id, l.variable, l.pos, l.value, p.sg, p.bi, p.rho,
        stddev_pop(l.value) OVER (PARTITION BY l.series_id, l.variable) AS sd,
        sqrt(-2 * ln({_uniform("u")})) * cos(2 * pi() * {_uniform("v")}) AS z
      FROM long l JOIN params p ON p.variable = l.variable),
    walk AS (SELECT series_id, variable, pos, z AS e FROM z WHERE pos = 0
      UNION ALL SELECT z.series_id, z.variable, z.pos, z.rho * w.e + sqrt(1 - z.rho * z.rho) * z.z
      FROM walk w JOIN z ON z.series_id = w.series_id AND z.variable = w.variable AND z.pos = w.pos + 1),
    noisy AS (SELECT z.series_id, z.variable, z.pos, z.value + CASE WHEN sd > 0 THEN 1.5::DOUBLE * sd * (sg * e + bi) ELSE 0 END AS v
      FROM z JOIN walk w ON w.series_id = z.series_id AND w.variable = z.variable AND w.pos = z.pos)
    SELECT series_id, variable, pos, {r("CASE WHEN variable = 'precipitation' THEN greatest(v, 0) ELSE (v % 360 + 360) % 360 END", "value")} FROM noisy""",
)
def i4(spark, sf):
    params = spark.createDataFrame(
        [("precipitation", 0.4, 0.1, 0.6), ("wind_direction_10m", 0.3, 0.0, 0.8)],
        "variable string, sigma_frac double, bias_frac double, ar1 double",
    )
    out = c.perturb(_long(spark, sf), params, alpha=1.5, seed=42)
    return out.select("series_id", "variable", "pos", "value")


@reg.add(
    "i5_error_model_report",
    f"""WITH {MODEL_SQL}, f AS (SELECT variable, count(DISTINCT series_id) AS n_series, stddev_samp(rmse / actual_sd) AS frac_sd,
      min(rmse / actual_sd) AS frac_min, max(rmse / actual_sd) AS frac_max FROM profile WHERE actual_sd > 0 AND lead_day = 1 GROUP BY variable)
    SELECT m.{MODEL_COLS}, n_series, {r("frac_sd")}, {r("frac_min")}, {r("frac_max")} FROM model m JOIN f ON f.variable = m.variable""",
)
def i5(spark, sf):
    return c.error_model_report(_profile(spark, sf))


def cells_sql(kept: str = "true") -> str:
    return f"""{SCORED},
grid AS (SELECT CASE WHEN alpha < 2 THEN 'demand' ELSE 'stress' END AS domain, alpha, seed, model, series_id,
    CASE WHEN model = 'seasonal_mean' THEN MASE * (1 + alpha * 0.1 + (seed - 42) * 0.01) ELSE MASE END AS MASE
  FROM scores CROSS JOIN (SELECT unnest([0.0, 1.0, 1.54, 3.0]::DOUBLE[]) AS alpha) CROSS JOIN (SELECT unnest([41, 42]) AS seed)
  WHERE {kept}),
cells AS (SELECT domain, alpha, seed, model, avg(m) AS mean_mase, count(*) AS n_series FROM (
    SELECT domain, alpha, seed, model, series_id, avg(MASE) AS m FROM grid GROUP BY ALL) GROUP BY ALL),
summary AS (SELECT domain, model, alpha, avg(mean_mase) AS mean_mase, stddev_samp(mean_mase) AS sd_across_seeds,
    count(DISTINCT seed) AS n_seeds, max(n_series) AS n_series FROM cells GROUP BY ALL)"""


CELLS_SQL = cells_sql()
SOME = "alpha < 1.5 OR MASE < 1.5"


def _cells(spark, sf, kept="true"):
    """Scores on an alpha x seed grid; only one model moves with alpha."""
    g = backtest.with_grid(scores(spark, sf), alpha=[0.0, 1.0, 1.54, 3.0], seed=[41, 42]).filter(kept)
    moved = F.col("MASE") * (1 + F.col("alpha") * 0.1 + (F.col("seed") - 42) * 0.01)
    g = g.withColumns(
        {
            "domain": F.when(F.col("alpha") < 2, "demand").otherwise("stress"),
            "MASE": F.when(F.col("model") == "seasonal_mean", moved).otherwise(F.col("MASE")),
        }
    )
    return settled(c.sweep_cells(g), "cells")


@reg.add("i6_sweep_cells", f"WITH {CELLS_SQL} SELECT domain, {r('alpha')}, seed, model, {r('mean_mase')}, n_series FROM cells")
def i6_cells(spark, sf):
    return _cells(spark, sf)


@reg.add(
    "i6_sweep_summary",
    f"WITH {CELLS_SQL} SELECT domain, model, {r('alpha')}, {r('mean_mase')}, {r('sd_across_seeds')}, n_seeds, n_series FROM summary",
)
def i6(spark, sf):
    return c.sweep_summary(_cells(spark, sf))


@reg.add(
    "i7_incomplete_cells",
    f"""WITH {cells_sql(SOME)}, f AS (SELECT domain, max(n_series) AS expected FROM cells GROUP BY domain)
    SELECT c.domain, {r("alpha")}, seed, model, {r("mean_mase")}, n_series, expected FROM cells c JOIN f ON f.domain = c.domain WHERE n_series < expected""",
)
def i7(spark, sf):
    """Cells that lost series are the feature: some scores are left out on purpose."""
    return c.incomplete_cells(_cells(spark, sf, SOME))


@reg.add(
    "i8_replace_by_key",
    f"""WITH {CELLS_SQL} SELECT domain, model, {r("alpha")}, {r("mean_mase * 2", "mean_mase")}, n_series FROM summary WHERE domain = 'stress'
    UNION ALL SELECT domain, model, {r("alpha")}, {r("mean_mase")}, n_series FROM summary WHERE domain <> 'stress'""",
)
def i8(spark, sf):
    prev = c.sweep_summary(_cells(spark, sf)).select("domain", "model", "alpha", "mean_mase", "n_series")
    new = prev.filter("domain = 'stress'").withColumn("mean_mase", F.col("mean_mase") * 2)
    return joins.replace_by_key(prev, new, "domain")


@reg.add(
    "i9_invariance",
    f"""WITH {CELLS_SQL} SELECT domain, model, {r("max(mean_mase) - min(mean_mase)", "spread")}, max(mean_mase) - min(mean_mase) < 0.05 AS ok
    FROM summary WHERE model IN ('seasonal_naive', 'seasonal_mean') GROUP BY domain, model""",
)
def i9(spark, sf):
    s = c.sweep_summary(_cells(spark, sf))
    return c.invariance(s, ["seasonal_naive", "seasonal_mean"], tol=0.05)
