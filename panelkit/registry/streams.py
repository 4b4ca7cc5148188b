"""Streaming queries, each compared with its batch twin in SQL.

Streams read the driver's parquet files and are driven to completion
(``availableNow``).  Windows that the final watermark does not close stay in
state, so a late sentinel row is appended where the result must be complete.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelkit.registry.common import PREDS, READINGS, SUPPLIER_PANEL, USER_READINGS, Registry, predictions, r, t
from panelkit.session import shared_dir
from panelkit.sources import panels
from panelkit.streaming import ingest as s

reg = Registry()
QUERIES, ORACLES = reg.queries, reg.oracles


def _events(spark: SparkSession, sf: str) -> DataFrame:
    schema = panels.table(spark, sf, "events").schema
    e = s.file_stream(spark, sf, schema, "events.parquet")
    return e.select(
        F.col("event_type").alias("series_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("value").alias("y"),
        F.col("event_id").alias("seq"),
    )


def _landed(spark: SparkSession, sf: str, e: DataFrame | None = None) -> DataFrame:
    """The readings as landed files, with a last file that moves the watermark.

    The sentinel lies beyond every window and belongs to a series of its own,
    which the queries drop.
    """
    base = shared_dir(spark, "landed")
    e = panels.event_readings(spark, sf) if e is None else e
    e.write.parquet(f"{base}/day=0")
    last = e.agg(F.max("ts").alias("ts")).select(
        F.lit("~end").alias("series_id"),
        (F.col("ts") + F.expr("INTERVAL 60 DAYS")).alias("ts"),
        F.lit(0.0).alias("y"),
        F.lit(-1).cast("long").alias("seq"),
    )
    last.write.parquet(f"{base}/day=1")
    return s.file_stream(spark, f"{base}/day=*", e.schema, "*.parquet")


def _without_sentinel(df: DataFrame) -> DataFrame:
    return df.filter(F.col("series_id") != "~end")


@reg.add("m1_incremental_ingest", f"WITH {READINGS} SELECT series_id, {t('ts')}, {r('y')}, seq FROM readings")
def m1(spark, sf):
    """Every reading exactly once, over a restart of the query."""
    base = shared_dir(spark, "ingest")
    first = _events(spark, sf)
    s.run_once(first, "ingest", checkpoint=f"{base}/cp", out=f"{base}/rows")
    # the second start finds nothing new
    return s.run_once(_events(spark, sf), "ingest", checkpoint=f"{base}/cp", out=f"{base}/rows")


@reg.add(
    "m2_keyed_dedupe",
    f"WITH {READINGS} SELECT DISTINCT series_id, {t('ts')} FROM readings",
)
def m2(spark, sf):
    """Readings delivered twice are kept once."""
    e = _events(spark, sf)
    twice = e.withColumn("_copy", F.explode(F.array(F.lit(0), F.lit(1)))).drop("_copy")
    return s.run_once(s.deduplicated(twice, "1 hour"), "dedupe").select("series_id", "ts")


@reg.add(
    "m2_upsert_latest",
    f"""SELECT event_type AS series_id, {t("date_trunc('hour', ts)", "ts")}, {r("arg_max(value, event_id)", "y")} FROM events GROUP BY event_type, date_trunc('hour', ts)""",
)
def m2_last(spark, sf):
    """Last delivery per hour wins, merged batch by batch."""
    from panelkit.operators.quality import last_reading

    base = shared_dir(spark, "upsert")
    e = _events(spark, sf).withColumn("ts", F.date_trunc("hour", "ts"))

    def latest(df: DataFrame) -> DataFrame:
        best = F.max(F.struct("seq", "y")).alias("b")
        return df.groupBy("series_id", "ts").agg(best).select("series_id", "ts", "b.seq", "b.y")

    s.upsert_latest(e, f"{base}/log", f"{base}/cp", latest)
    return last_reading(spark.read.parquet(f"{base}/log"), "seq")


@reg.add(
    "m3_hourly_mean",
    f"SELECT event_type AS series_id, {t('''date_trunc('hour', ts)''', 'ts')}, {r('avg(value)', 'y')}, count(*) AS n FROM events GROUP BY event_type, date_trunc('hour', ts)",
)
def m3(spark, sf):
    out = s.run_once(s.hourly_mean(_landed(spark, sf), "40 days"), "hourly")
    return _without_sentinel(out)


def _sliding_sql(hours: int) -> str:
    return f"""WITH e AS (SELECT event_type, value, date_trunc('hour', ts) AS h FROM events)
    SELECT event_type AS series_id, {t("h + to_hours(CAST(k AS INTEGER))", "ts")}, {r("avg(value)", "y")}, count(*) AS n
    FROM e CROSS JOIN (SELECT unnest(range(1, {hours + 1})) AS k) GROUP BY event_type, h + to_hours(CAST(k AS INTEGER))"""


@reg.add("m4_sliding_mean", _sliding_sql(24))
def m4(spark, sf):
    out = s.run_once(s.trailing_mean(_landed(spark, sf), delay="40 days"), "sliding")
    return _without_sentinel(out)


@reg.add("m4_sliding_week", _sliding_sql(168))
def m4_week(spark, sf):
    """A week's mean at every hour; 168 windows hold each pane, none holds readings."""
    out = s.run_once(s.trailing_mean(_landed(spark, sf), "168 hours", delay="40 days"), "sliding-week")
    return _without_sentinel(out)


def _sessions_sql(hours: int, rows: str) -> str:
    return f"""WITH {rows}, g AS (SELECT *, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY series_id ORDER BY ts)) AS gap FROM readings),
    s AS (SELECT *, sum(CASE WHEN gap > {hours} * 3600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY series_id ORDER BY ts) AS sid FROM g)
    SELECT series_id, count(*) AS n_obs, {t("min(ts)", "first_ts")}, {t("max(ts)", "last_ts")} FROM s GROUP BY series_id, sid"""


@reg.add("m5_gap_sessions", _sessions_sql(2, READINGS))
def m5(spark, sf):
    out = s.run_once(s.gap_sessions(_landed(spark, sf), "2 hours", "40 days"), "sessions")
    return _without_sentinel(out)


@reg.add("m5_user_sessions", _sessions_sql(48, USER_READINGS))
def m5_users(spark, sf):
    """Silences of more than 48 hours part the readings of each user."""
    out = s.run_once(s.gap_sessions(_landed(spark, sf, panels.user_readings(spark, sf)), "48 hours", "40 days"), "user-sessions")
    return _without_sentinel(out)


@reg.add(
    "m6_running_scores",
    f"""WITH {PREDS} SELECT series_id, model, count(*) AS n_points, {r("sum(abs(y_true - y_pred))", "abs_error_sum")}, {r("avg(abs(y_true - y_pred))", "MAE")}, {r("sqrt(avg((y_true - y_pred) * (y_true - y_pred)))", "RMSE")}
    FROM preds GROUP BY series_id, model""",
)
def m6(spark, sf):
    """Predictions arrive as files; the state holds sums, not predictions."""
    base = shared_dir(spark, "preds-stream")
    p = predictions(spark, sf)
    p.write.parquet(base)
    stream = s.file_stream(spark, base, spark.read.parquet(base).schema, "*.parquet", files_per_batch=4)
    return s.run_latest(s.running_scores(stream), ["series_id", "model"], "scores")


@reg.add(
    "m7_completeness",
    """SELECT event_type AS series_id, strftime(ts, '%Y-%m') AS month, greatest(count(*), 2000) AS found, count(*) AS received, count(*) >= 2000 AS complete
    FROM events GROUP BY event_type, strftime(ts, '%Y-%m')""",
)
def m7(spark, sf):
    received = s.run_latest(s.received_by_month(_events(spark, sf)), ["series_id", "month"], "months")
    month = F.date_format("ts", "yyyy-MM").alias("month")
    expected = panels.event_readings(spark, sf).groupBy("series_id", month).agg(
        F.greatest(F.count(F.lit(1)), F.lit(2000)).alias("found")
    )
    return s.completeness(received, expected)
