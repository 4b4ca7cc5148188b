"""Shared panels, parameters and SQL fragments of the registered queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelkit.functions.output import rounded
from panelkit.operators import backtest, metrics, quality
from panelkit.session import settled
from panelkit.sources import panels

# Weekly supplier panel: month-like season, quarter-like long season.
SEASON, LONG, HORIZON, FOLDS, MIN_TRAIN, CYCLES = 4, 13, 4, 6, 52, 3
MODELS = ("seasonal_naive", "seasonal_mean", "last_value")
# Hourly event panel.
H_HOURS, H_FOLDS, H_MIN_TRAIN = 24, 3, 336
LO, HI = 0.0, 250.0


class Registry:
    """Collects query functions with their oracle text."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.oracles: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None):
        def wrap(fn):
            def run(spark: SparkSession, sf_dir: str) -> DataFrame:
                return rounded(fn(spark, sf_dir))

            run.__name__ = name
            run.__doc__ = fn.__doc__
            self.queries[name] = run
            if sql is not None:
                self.oracles[name] = sql
            return fn

        return wrap


def r(expr: str, name: str | None = None) -> str:
    """SQL twin of ``rounded`` for a double; adding zero clears the sign of -0."""
    return f"round(CAST({expr} AS DOUBLE) + 1e-10, 6) + 0.0::DOUBLE AS {name or expr}"


def t(expr: str, name: str | None = None) -> str:
    return f"strftime({expr}, '%Y-%m-%d %H:%M:%S.%f') AS {name or expr}"


def d(expr: str, name: str | None = None) -> str:
    return f"strftime({expr}, '%Y-%m-%d') AS {name or expr}"


# --- Spark side -------------------------------------------------------------


def hourly(spark: SparkSession, sf: str) -> DataFrame:
    """Sanitised hourly means per event type."""
    clean = quality.sanitize(panels.event_readings(spark, sf), LO, HI)
    return settled(panels.hourly_means(clean.filter(F.col("y").isNotNull())), "hourly")


def hourly_panel(spark: SparkSession, sf: str) -> DataFrame:
    """The hourly means through the gate."""
    h = hourly(spark, sf).withColumn("seq", F.lit(0))
    return quality.usable_window(h, lo=None, hi=None, min_rows=400)


def panel(spark: SparkSession, sf: str) -> DataFrame:
    """The weekly supplier panel, written once for the branches that follow."""
    return settled(panels.supplier_panel(spark, sf), "panel")


def predicted(p: DataFrame) -> DataFrame:
    return backtest.baselines(p, HORIZON, FOLDS, MIN_TRAIN, SEASON, CYCLES, LONG)


def scored(p: DataFrame, preds: DataFrame) -> DataFrame:
    scale = metrics.mase_scale(p, backtest.first_train_end(HORIZON, FOLDS, MIN_TRAIN), SEASON)
    return metrics.score(preds, scale)


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    return predicted(panels.supplier_panel(spark, sf))


def scores(spark: SparkSession, sf: str) -> DataFrame:
    p = panel(spark, sf)
    return scored(p, predicted(p))


def supplier_tiers(spark: SparkSession, sf: str) -> DataFrame:
    """Series dimension: tier by the sign of the supplier's balance rank."""
    s = panels.table(spark, sf, "supplier")
    return s.select(
        F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("series_id"),
        F.when(F.col("s_acctbal") >= 5000, "rich").otherwise("scarce").alias("tier"),
        F.col("s_acctbal").alias("acctbal"),
    )


def write_series_files(rows: DataFrame, base: str, name: str) -> None:
    """One CSV file for each ``series_id`` of ``rows``, named after it, in ``base``/files; every series' rows are few."""
    spark = rows.sparkSession
    rows.repartition("series_id").write.partitionBy("series_id").option("header", True).csv(f"{base}/{name}")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    root, goal = path(f"{base}/{name}"), path(f"{base}/files")
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(goal)
    for folder in fs.globStatus(path(f"{base}/{name}/series_id=*")):
        series = folder.getPath().getName().split("=", 1)[1]
        (part,) = [f.getPath() for f in fs.listStatus(folder.getPath())]
        fs.rename(part, path(goal, f"{series}.csv"))


# --- SQL side ---------------------------------------------------------------

READINGS = """readings AS (
  SELECT event_type AS series_id, ts, value AS y, event_id AS seq FROM events)"""

USER_READINGS = """readings AS (
  SELECT 'u' || user_id AS series_id, ts, value AS y, event_id AS seq FROM events)"""

HOURLY = f"""hourly AS (
  SELECT event_type AS series_id, date_trunc('hour', ts) AS ts, avg(value) AS y
  FROM events WHERE value > {LO} AND value < {HI} GROUP BY ALL)"""


def segments(src: str, prefix: str = "") -> str:
    """CTEs gaps, seg and best over a table (series_id, ts, y)."""
    return f"""gaps AS (
  SELECT *, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY series_id ORDER BY ts)) AS gap_us
  FROM {src}),
seg AS (
  SELECT *, sum(CASE WHEN gap_us > 48 * 3600000000 THEN 1 ELSE 0 END)
    OVER (PARTITION BY series_id ORDER BY ts) AS segment FROM gaps),
sizes AS (
  SELECT series_id, segment, count(*) AS n_obs, min(ts) AS first_ts, max(ts) AS last_ts
  FROM seg GROUP BY ALL),
best AS (
  SELECT * FROM sizes
  QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY n_obs DESC, segment) = 1)"""


def grid_fill(limit: int = 6) -> str:
    """CTEs grid, near and filled: hourly grid and bounded interpolation."""
    return f"""grid AS (
  SELECT series_id, unnest(generate_series(first_ts, last_ts, INTERVAL 1 HOUR)) AS ts FROM best),
obs AS (
  SELECT g.series_id, g.ts, s.y,
    row_number() OVER (PARTITION BY g.series_id ORDER BY g.ts) - 1 AS k
  FROM grid g LEFT JOIN seg s ON s.series_id = g.series_id AND s.ts = g.ts),
near AS (
  SELECT *,
    last_value(CASE WHEN y IS NOT NULL THEN k END IGNORE NULLS) OVER b AS pk,
    last_value(y IGNORE NULLS) OVER b AS py,
    first_value(CASE WHEN y IS NOT NULL THEN k END IGNORE NULLS) OVER f AS nk,
    first_value(y IGNORE NULLS) OVER f AS ny
  FROM obs
  WINDOW b AS (PARTITION BY series_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         f AS (PARTITION BY series_id ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
filled AS (
  SELECT series_id, ts, k, y IS NULL AS is_filled,
    CASE WHEN y IS NOT NULL THEN y
         WHEN k - pk <= {limit} AND nk IS NULL THEN py
         WHEN k - pk <= {limit} THEN py + (ny - py) / (nk - pk) * (k - pk) END AS y
  FROM near)"""


def gate(min_rows: int, min_cov: float = 0.6) -> str:
    """CTEs facts and panel after ``filled``."""
    return f"""facts AS (
  SELECT series_id, count(*) AS n, min(ts) AS usable_from, max(ts) AS usable_to,
    count(*) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 3600000000.0 + 1) AS coverage
  FROM filled WHERE y IS NOT NULL GROUP BY series_id),
panel AS (
  SELECT f.series_id, f.ts, f.y, f.is_filled,
    row_number() OVER (PARTITION BY f.series_id ORDER BY f.ts) - 1 AS pos, a.n
  FROM filled f JOIN facts a ON a.series_id = f.series_id
  WHERE f.y IS NOT NULL AND a.n >= {min_rows} AND a.coverage >= {min_cov})"""


HOURLY_PANEL = ",\n".join([HOURLY, segments("hourly"), grid_fill(), gate(400)])

SUPPLIER_WEEKS = """weeks AS (
  SELECT 's' || l_suppkey AS series_id,
    CAST(floor(date_diff('day', DATE '1995-01-02', CAST(l_shipdate AS DATE)) / 7.0) AS BIGINT) AS week,
    sum(l_quantity) AS y, avg(l_discount) AS wx_discount
  FROM lineitem GROUP BY ALL)"""

SUPPLIER_PANEL = f"""{SUPPLIER_WEEKS},
panel AS (
  SELECT series_id, TIMESTAMP '1995-01-02 00:00:00' + to_days(CAST(week * 7 AS INTEGER)) AS ts, y, wx_discount,
    row_number() OVER (PARTITION BY series_id ORDER BY week) - 1 AS pos,
    count(*) OVER (PARTITION BY series_id) AS n
  FROM weeks)"""

DAILY_PANEL = """daily AS (
  SELECT o_orderpriority AS series_id, date_trunc('day', o_orderdate)::TIMESTAMP AS ts, sum(o_totalprice) AS y
  FROM orders GROUP BY ALL),
panel AS (
  SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts) - 1 AS pos,
    count(*) OVER (PARTITION BY series_id) AS n
  FROM daily)"""


def folds(horizon: int, k: int, min_train: int, cols: str = "*") -> str:
    """CTE test over ``hist`` rows carrying pos and n."""
    return f"""test AS (
  SELECT {cols}, CAST(floor((pos - (n - {k * horizon})) / {horizon}.0) AS BIGINT) AS fold,
    (pos - (n - {k * horizon})) % {horizon} + 1 AS lead
  FROM hist WHERE pos >= n - {k * horizon}
    AND n - {k * horizon} + floor((pos - (n - {k * horizon})) / {horizon}.0) * {horizon} > {min_train})"""


def train_end(horizon: int, k: int, min_train: int) -> str:
    ends = [f"CASE WHEN n - {j * horizon} > {min_train} THEN n - {j * horizon} END" for j in range(k, 0, -1)]
    return f"coalesce({', '.join(ends)})"


def baseline_preds(
    horizon: int = HORIZON,
    k: int = FOLDS,
    min_train: int = MIN_TRAIN,
    season: int = SEASON,
    cycles: int = CYCLES,
    long_season: int = LONG,
) -> str:
    """CTEs hist, test and preds over ``panel``."""
    steps = [season * j for j in range(1, cycles + 1)]
    lags = ", ".join(f"lag(y, {s}) OVER w AS l{s}" for s in steps)
    seen = ", ".join(f"CASE WHEN lead <= {s} THEN l{s} END" for s in steps)
    return f"""hist AS (
  SELECT *, lag(y, {long_season}) OVER w AS naive,
    last_value(CASE WHEN (pos - (n - {k * horizon}) + 1) % {horizon} = 0 THEN y END IGNORE NULLS) OVER (
      PARTITION BY series_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS origin,
    {lags}
  FROM panel WINDOW w AS (PARTITION BY series_id ORDER BY pos)),
{folds(horizon, k, min_train)},
preds AS (
  SELECT series_id, 'seasonal_naive' AS model, fold, lead, pos, ts, y AS y_true,
    CASE WHEN pos - lead + 1 >= {long_season} THEN naive ELSE origin END AS y_pred FROM test
  UNION ALL
  SELECT series_id, 'seasonal_mean', fold, lead, pos, ts, y, list_avg([{seen}]) FROM test
  UNION ALL
  SELECT series_id, 'last_value', fold, lead, pos, ts, y, origin FROM test)"""


def scale_cte(horizon: int, k: int, min_train: int, season: int) -> str:
    return f"""scale AS (
  SELECT series_id, greatest(avg(abs(y - y0)), 1e-9) AS scale FROM (
    SELECT series_id, pos, n, y, lag(y, {season}) OVER (PARTITION BY series_id ORDER BY pos) AS y0 FROM panel)
  WHERE pos < {train_end(horizon, k, min_train)} GROUP BY series_id)"""


SCORES = """scores AS (
  SELECT p.series_id, p.model, count(*) AS n_points, avg(abs(y_true - y_pred)) AS MAE,
    sqrt(avg((y_true - y_pred) * (y_true - y_pred))) AS RMSE,
    avg(abs(y_true - y_pred)) / any_value(s.scale) AS MASE,
    CASE WHEN stddev_pop(y_true) > 0 THEN sqrt(avg((y_true - y_pred) * (y_true - y_pred))) / stddev_pop(y_true) END AS nRMSE,
    100 * sqrt(avg((y_true - y_pred) * (y_true - y_pred))) / CASE WHEN avg(y_true) = 0 THEN 1e-9 ELSE avg(y_true) END AS RMSE_pct_mean
  FROM preds p JOIN scale s ON s.series_id = p.series_id GROUP BY p.series_id, p.model)"""

PREDS = f"{SUPPLIER_PANEL},\n{baseline_preds()}"
SCORED = f"{PREDS},\n{scale_cte(HORIZON, FOLDS, MIN_TRAIN, SEASON)},\n{SCORES}"
TIERS = """tiers AS (
  SELECT 's' || s_suppkey AS series_id, CASE WHEN s_acctbal >= 5000 THEN 'rich' ELSE 'scarce' END AS tier,
    s_acctbal AS acctbal FROM supplier)"""
WIDE = """wide AS (
  SELECT series_id, avg(MASE) FILTER (model = 'seasonal_naive') AS seasonal_naive,
    avg(MASE) FILTER (model = 'seasonal_mean') AS seasonal_mean,
    avg(MASE) FILTER (model = 'last_value') AS last_value
  FROM scores GROUP BY series_id)"""
