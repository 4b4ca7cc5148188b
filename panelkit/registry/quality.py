"""Queries of the cleaning and gating family."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelkit.operators import quality as q
from panelkit.registry.common import (
    DAILY_PANEL,
    HI,
    HOURLY,
    HOURLY_PANEL,
    LO,
    READINGS,
    SUPPLIER_PANEL,
    USER_READINGS,
    Registry,
    d,
    gate,
    grid_fill,
    hourly,
    hourly_panel,
    r,
    segments,
    t,
)
from panelkit.session import settled
from panelkit.sources import panels

reg = Registry()
QUERIES, ORACLES = reg.queries, reg.oracles


@reg.add(
    "b1_sanitize",
    f"""WITH {READINGS}
    SELECT series_id, seq, {t("ts")}, {r(f"CASE WHEN y > {LO} AND y < {HI} THEN y END", "y")} FROM readings""",
)
def b1(spark, sf):
    return q.sanitize(panels.event_readings(spark, sf), LO, HI).select("series_id", "seq", "ts", "y")


@reg.add(
    "b2_first_reading",
    f"""WITH {READINGS}
    SELECT series_id, {t("h", "ts")}, {r("y")} FROM (
      SELECT series_id, date_trunc('hour', ts) AS h, y,
        row_number() OVER (PARTITION BY series_id, date_trunc('hour', ts) ORDER BY seq) AS rn FROM readings)
    WHERE rn = 1""",
)
def b2(spark, sf):
    """Stamps are truncated to the hour, so that they do repeat."""
    e = panels.event_readings(spark, sf).withColumn("ts", F.date_trunc("hour", "ts"))
    return q.first_reading(e, "seq")


@reg.add(
    "b2_last_reading",
    f"""WITH {READINGS}
    SELECT series_id, {t("h", "ts")}, {r("arg_max(y, seq)", "y")} FROM (
      SELECT series_id, date_trunc('hour', ts) AS h, y, seq FROM readings)
    GROUP BY series_id, h""",
)
def b2_last(spark, sf):
    e = panels.event_readings(spark, sf).withColumn("ts", F.date_trunc("hour", "ts"))
    return q.last_reading(e, "seq")


PROFILE = """gaps AS (
  SELECT *, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY series_id ORDER BY ts))) / 1e6 AS gap_s
  FROM readings),
profile AS (
  SELECT series_id, count(*) AS n_obs,
    count(*) >= 3 AND coalesce(median(gap_s) < 2700, false) AS is_subhourly
  FROM gaps GROUP BY series_id)"""


@reg.add(
    "b3_sampling_profile",
    f"WITH {READINGS},\n{PROFILE} SELECT series_id, n_obs, is_subhourly FROM profile",
)
def b3_profile(spark, sf):
    return q.sampling_profile(panels.event_readings(spark, sf).select("series_id", "ts", "y"))


@reg.add(
    "b3_resample_subhourly",
    f"""WITH {READINGS},
    {PROFILE}
    SELECT series_id, {t("stamp", "ts")}, {r("avg(y)", "y")} FROM (
      SELECT g.series_id, CASE WHEN is_subhourly THEN date_trunc('hour', ts) ELSE ts END AS stamp, y
      FROM gaps g JOIN profile p ON p.series_id = g.series_id)
    GROUP BY series_id, stamp""",
)
def b3(spark, sf):
    e = panels.event_readings(spark, sf)
    return q.resample_subhourly(q.first_reading(e, "seq"))


@reg.add(
    "b4_gap_segments",
    f"""WITH {USER_READINGS},
    {segments("readings")}
    SELECT series_id, {t("ts")}, {r("y")}, {r("gap_us / 1e6", "gap_s")}, CAST(segment AS BIGINT) AS segment FROM seg""",
)
def b4(spark, sf):
    e = panels.user_readings(spark, sf).drop("seq")
    return q.gap_segments(e)


@reg.add(
    "b5_longest_segment",
    f"""WITH {USER_READINGS},
    {segments("readings")}
    SELECT series_id, CAST(segment AS BIGINT) AS segment, n_obs, {t("first_ts")}, {t("last_ts")} FROM best""",
)
def b5(spark, sf):
    return q.longest_segments(q.gap_segments(panels.user_readings(spark, sf)))


@reg.add(
    "b6_regular_grid",
    f"""WITH {HOURLY},
    {segments("hourly")},
    {grid_fill()}
    SELECT series_id, {t("ts")}, k AS pos, {r("y")} FROM obs""",
)
def b6(spark, sf):
    h = hourly(spark, sf)
    return q.on_grid(q.longest_segments(q.gap_segments(h)), h)


@reg.add(
    "b7_interpolate",
    f"""WITH {HOURLY},
    {segments("hourly")},
    {grid_fill(2)}
    SELECT series_id, {t("ts")}, k AS pos, {r("y")} FROM filled""",
)
def b7(spark, sf):
    h = hourly(spark, sf)
    return q.interpolate(q.on_grid(q.longest_segments(q.gap_segments(h)), h), limit=2)


@reg.add(
    "b8_drop_missing",
    f"""WITH {HOURLY},
    {segments("hourly")},
    {grid_fill()}
    SELECT series_id, {t("ts")}, k AS grid_pos,
      row_number() OVER (PARTITION BY series_id ORDER BY k) - 1 AS pos,
      count(*) OVER (PARTITION BY series_id) AS n, {r("y")} FROM obs WHERE y IS NOT NULL""",
)
def b8(spark, sf):
    h = hourly(spark, sf)
    return q.drop_missing(q.on_grid(q.longest_segments(q.gap_segments(h)), h))


@reg.add(
    "b9_usable_window",
    f"WITH {HOURLY_PANEL} SELECT series_id, {t('ts')}, {r('y')}, is_filled, pos, n FROM panel",
)
def b9(spark, sf):
    return hourly_panel(spark, sf)


@reg.add(
    "b9_usable_window_raw",
    f"""WITH readings AS (
      SELECT 'u' || user_id AS series_id, ts, value AS y FROM events WHERE value > {LO} AND value < {HI}),
    {segments("readings")},
    {grid_fill()},
    {gate(12, 0.1)}
    SELECT series_id, {t("ts")}, {r("y")}, is_filled, pos, n FROM panel""",
)
def b9_raw(spark, sf):
    """Raw readings: the grid is anchored at each series' first reading."""
    e = panels.user_readings(spark, sf)
    return q.usable_window(e, lo=LO, hi=HI, min_rows=12, min_cov=0.1)


@reg.add(
    "b9_rejected_series",
    f"""WITH {USER_READINGS.replace("readings AS", "raw AS")},
    readings AS (SELECT * FROM raw WHERE y > {LO} AND y < {HI}),
    {segments("readings")},
    {grid_fill()},
    {gate(400)}
    SELECT r.series_id, count(*) AS raw_rows, coalesce(any_value(f.n), 0) AS n,
      CASE WHEN any_value(f.n) IS NULL THEN 'no valid reading'
           WHEN any_value(f.n) < 400 THEN 'too few rows' ELSE 'too sparse' END AS reject_reason
    FROM raw r LEFT JOIN facts f ON f.series_id = r.series_id
    WHERE f.n IS NULL OR f.n < 400 OR f.coverage < 0.6 GROUP BY r.series_id""",
)
def b9_rejected(spark, sf):
    return q.rejected_series(panels.user_readings(spark, sf), lo=LO, hi=HI, min_rows=400)


AUDIT = f"""tiers AS (SELECT DISTINCT event_type AS series_id,
    CASE WHEN event_type IN ('click', 'view') THEN 'rich' ELSE 'scarce' END AS tier FROM events
    WHERE event_type <> 'error'),
readings AS (SELECT event_type AS series_id, date_trunc('hour', ts) AS ts, avg(value) AS y
  FROM events WHERE value > {LO} AND value < {HI} GROUP BY ALL),
{segments("readings")},
{grid_fill()},
{gate(700)},
raw AS (SELECT series_id, count(*) AS raw_rows,
    100.0 * count(*) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 3600000000.0 + 1) AS raw_cov_pct
  FROM readings GROUP BY series_id),
report AS (SELECT w.series_id, coalesce(t.tier, '?') AS tier, raw_rows, raw_cov_pct,
    CASE WHEN ok THEN n ELSE 0 END AS usable_hours,
    CASE WHEN ok THEN usable_from END AS usable_from, CASE WHEN ok THEN usable_to END AS usable_to,
    coalesce(ok, false) AS passed
  FROM raw w LEFT JOIN (SELECT *, n >= 700 AND coverage >= 0.6 AS ok FROM facts) f ON f.series_id = w.series_id
  LEFT JOIN tiers t ON t.series_id = w.series_id)"""


def _audit(spark, sf):
    """error has no tier on purpose: the default label must show."""
    h = hourly(spark, sf).withColumn("seq", F.lit(0))
    known = panels.table(spark, sf, "events").filter("event_type <> 'error'")
    tiers = known.groupBy(F.col("event_type").alias("series_id")).agg(
        F.max(F.when(F.col("event_type").isin("click", "view"), "rich").otherwise("scarce")).alias("tier")
    )
    return q.audit_report(h, tiers, lo=None, hi=None, min_rows=700)


@reg.add(
    "b12_audit_report",
    f"""WITH {AUDIT} SELECT series_id, tier, raw_rows, {r("raw_cov_pct")}, usable_hours,
    {d("usable_from")}, {d("usable_to")}, passed FROM report""",
)
def b12(spark, sf):
    return q.audit_order(_audit(spark, sf))


@reg.add(
    "b12_pass_counts",
    f"WITH {AUDIT} SELECT tier, count(*) AS n_series, count_if(passed) AS n_pass FROM report GROUP BY tier",
)
def b12_counts(spark, sf):
    return q.pass_counts(_audit(spark, sf))


@reg.add(
    "b10_clip_to_window",
    f"""WITH {HOURLY_PANEL},
    target AS (SELECT event_type AS series_id, date_trunc('hour', ts) AS ts,
        avg(CAST(json_extract(props, '$.k') AS DOUBLE)) AS temp
      FROM events GROUP BY ALL),
    cover AS (SELECT series_id, min(ts) AS lo, max(ts) AS hi FROM target GROUP BY series_id),
    idx AS (SELECT p.series_id, p.ts, p.pos AS k, t.temp AS y FROM panel p JOIN cover c ON c.series_id = p.series_id
      LEFT JOIN target t ON t.series_id = p.series_id AND t.ts = p.ts
      WHERE p.ts BETWEEN c.lo AND c.hi),
    near2 AS (SELECT *,
        last_value(CASE WHEN y IS NOT NULL THEN k END IGNORE NULLS) OVER b AS pk,
        last_value(y IGNORE NULLS) OVER b AS py,
        first_value(CASE WHEN y IS NOT NULL THEN k END IGNORE NULLS) OVER f AS nk,
        first_value(y IGNORE NULLS) OVER f AS ny
      FROM idx
      WINDOW b AS (PARTITION BY series_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
             f AS (PARTITION BY series_id ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
    done AS (SELECT series_id, ts, k, CASE WHEN y IS NOT NULL THEN y WHEN k - pk <= 6 AND nk IS NULL THEN py
        WHEN k - pk <= 6 THEN py + (ny - py) / (nk - pk) * (k - pk) END AS temp FROM near2),
    verdict AS (SELECT series_id, CASE WHEN count(*) < 500 THEN 'too few rows'
        WHEN bool_or(temp IS NULL) THEN 'hole inside coverage' END AS reject_reason FROM done GROUP BY series_id)
    SELECT d.series_id, {t("ts")}, k AS pos, {r("temp")}, reject_reason
    FROM done d JOIN verdict v ON v.series_id = d.series_id""",
)
def b10(spark, sf):
    """Second domain: the payload's k value on the gated value panel's stamps."""
    k = F.get_json_object("props", "$.k").cast("double")
    target = (
        panels.table(spark, sf, "events")
        .groupBy(F.col("event_type").alias("series_id"), F.date_trunc("hour", "ts").alias("ts"))
        .agg(F.avg(k).alias("temp"))
    )
    out = q.clip_to_window(settled(target), settled(hourly_panel(spark, sf)), ["temp"], min_rows=500)
    return out.select("series_id", "ts", "pos", "temp", "reject_reason")


@reg.add(
    "b11_min_length",
    f"""WITH {SUPPLIER_PANEL}
    SELECT series_id, count(*) AS n, CASE WHEN count(*) <= 280 THEN 'shorter than the minimum history'
      WHEN count(*) - 24 <= 0 THEN 'no fold fits' END AS reject_reason FROM panel GROUP BY series_id""",
)
def b11(spark, sf):
    return q.min_length(panels.supplier_panel(spark, sf), season=4, weeks=10, horizon=4, folds=6)


@reg.add(
    "b13_since_cutoff",
    f"WITH {READINGS} SELECT series_id, seq, {t('ts')}, {r('y')} FROM readings WHERE ts >= TIMESTAMP '2024-01-15'",
)
def b13(spark, sf):
    return q.since(panels.event_readings(spark, sf), "2024-01-15").select("series_id", "seq", "ts", "y")


@reg.add(
    "b14_tail_rows",
    f"""WITH {DAILY_PANEL} SELECT series_id, {t("ts")}, {r("y")}, pos, n FROM panel
    QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY ts DESC) <= 365""",
)
def b14(spark, sf):
    return q.tail_rows(panels.daily_orders(spark, sf), 365)


@reg.add(
    "b15_predicates",
    f"""SELECT l_returnflag, count(*) AS n, {r("avg(l_quantity)", "mean_qty")} FROM lineitem
    WHERE l_returnflag IN ('A', 'R') AND l_discount > 0.03 AND l_linestatus <> 'O' GROUP BY l_returnflag""",
)
def b15(spark, sf):
    li = panels.table(spark, sf, "lineitem")
    li = li.filter(F.col("l_returnflag").isin("A", "R") & (F.col("l_discount") > 0.03))
    li = li.filter(F.col("l_linestatus") != "O")
    return li.groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("n"), F.avg("l_quantity").alias("mean_qty")
    )


@reg.add(
    "b16_expectations",
    """WITH g AS (SELECT l_suppkey, count(*) AS n,
        100.0 * (count_if(l_returnflag = 'A') + count_if(l_returnflag = 'R')) / count(*) AS pct,
        avg(CASE WHEN l_linestatus = 'F' THEN 1.0 ELSE 0.0 END) AS prev,
        avg(l_discount) AS est, avg(l_discount) - 2 * stddev_samp(l_discount) / sqrt(count(*)) AS lo,
        avg(l_discount) + 2 * stddev_samp(l_discount) / sqrt(count(*)) AS hi, avg(l_tax) AS p
      FROM lineitem GROUP BY l_suppkey),
    c AS (SELECT count_if(NOT (n >= 590)) AS min_rows, count_if(NOT (abs(pct - 100.0) <= 35.0)) AS percentages,
        count_if(NOT (est * est <= prev * (1 - prev) + 0.005)) AS brier,
        count_if(NOT ((p < 0.05) <> (lo <= 0.05 AND 0.05 <= hi))) AS ci_agrees,
        count_if(NOT (est < 0.05)) AS direction FROM g)
    UNPIVOT c ON min_rows, percentages, brier, ci_agrees, direction INTO NAME rule VALUE violations""",
)
def b16(spark, sf):
    li = panels.table(spark, sf, "lineitem")
    n = F.count(F.lit(1))
    half = 2 * F.stddev_samp("l_discount") / F.sqrt(n)
    share = F.count_if(F.col("l_returnflag") == "A") + F.count_if(F.col("l_returnflag") == "R")
    g = li.groupBy("l_suppkey").agg(
        n.alias("n"),
        (100.0 * share / n).alias("pct"),
        F.avg(F.when(F.col("l_linestatus") == "F", 1.0).otherwise(0.0)).alias("prev"),
        F.avg("l_discount").alias("est"),
        (F.avg("l_discount") - half).alias("lo"),
        (F.avg("l_discount") + half).alias("hi"),
        F.avg("l_tax").alias("p"),
    )
    c = F.col
    return q.check_rules(
        g,
        {
            "min_rows": q.rule_min_rows(c("n"), 590),
            "percentages": q.rule_percentages(c("pct"), 35.0),
            "brier": q.rule_brier(c("est") * c("est"), c("prev")),
            "ci_agrees": q.rule_ci_agrees_with_p(c("p"), c("lo"), c("hi"), null_value=0.05),
            "direction": q.rule_direction(c("est"), "protective", null_value=0.05),
        },
    )


@reg.add(
    "b16_calibration_bins",
    f"""WITH o AS (SELECT l_returnflag, CASE WHEN l_returnflag = 'A' THEN l_discount * 8 ELSE l_discount * 10 END AS p, l_linestatus = 'F' AS hit FROM lineitem),
    c AS (SELECT l_returnflag, least(floor(p * 10), 9) AS bin, count(*) AS n, abs(avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END) - avg(p)) AS miss
      FROM o WHERE p BETWEEN 0 AND 1 GROUP BY ALL)
    SELECT l_returnflag, count(*) AS n_bins, CAST(sum(n) AS BIGINT) AS n, {r("max(miss)", "widest_miss")}, count(*) >= 10 AS enough_bins FROM c GROUP BY l_returnflag""",
)
def b16_bins(spark, sf):
    """A key whose predictions reach four fifths of the range has too few bins."""
    li = panels.table(spark, sf, "lineitem")
    p = F.when(F.col("l_returnflag") == "A", F.col("l_discount") * 8).otherwise(F.col("l_discount") * 10)
    rows = li.select("l_returnflag", p.alias("p"), (F.col("l_linestatus") == "F").cast("int").alias("hit"))
    return q.calibration_bins(rows, ["l_returnflag"], "p", "hit")
