"""Queries of the report and audit family."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelkit.functions.columns import slug
from panelkit.operators import joins, metrics, report, stats
from panelkit.operators import backtest
from panelkit.registry.backtests import CUTOFF, SINCE_ROWS, SINCE_SQL
from panelkit.registry.common import (
    FOLDS,
    HORIZON,
    MIN_TRAIN,
    MODELS,
    SCORED,
    SCORES,
    SEASON,
    SUPPLIER_PANEL,
    TIERS,
    Registry,
    baseline_preds,
    d,
    panel,
    predicted,
    predictions,
    r,
    scale_cte,
    scored,
    scores,
    supplier_tiers,
    t,
)
from panelkit.registry.comparisons import (
    BH,
    CONFIG_SQL,
    CONFIGS,
    CONFORMAL,
    DM,
    DRAWS,
    LOSSES,
    PREDS,
    RANKS,
    ROLL,
    WEIGHT,
    _config_predictions,
    _ranks,
    _rollup,
    _seeded,
    dm_sql,
    signed_rank_exact_sql,
)
from panelkit.registry.decisions import RUNS_SQL
from panelkit.registry.decisions import _runs as _flag_runs
from panelkit.session import settled
from panelkit.sources import panels

reg = Registry()
QUERIES, ORACLES = reg.queries, reg.oracles

# claim values: (check, what SQL recomputes)
CLAIMS_SQL = """facts AS (SELECT l_returnflag AS f, count(*) AS n, avg(l_discount) AS m FROM lineitem GROUP BY l_returnflag),
metrics AS (SELECT 'count_' || f AS check_id, CAST(n AS VARCHAR) AS recomputed FROM facts
  UNION ALL SELECT 'disc_' || f, CAST(m AS VARCHAR) FROM facts),
claims AS (SELECT 'count_' || f AS check_id, CAST(n AS VARCHAR) AS expected, CAST(NULL AS DOUBLE) AS tol FROM facts
  UNION ALL SELECT 'disc_' || f, '0.05', 0.0004 FROM facts UNION ALL SELECT 'absent', '1', 0.1),
audited AS (SELECT c.check_id, CASE WHEN coalesce(CASE WHEN tol IS NOT NULL THEN abs(CAST(expected AS DOUBLE) - TRY_CAST(recomputed AS DOUBLE)) <= tol
    ELSE expected = recomputed END, false) THEN 'PASS' ELSE 'FAIL' END AS status FROM claims c LEFT JOIN metrics m ON m.check_id = c.check_id)"""


def _audit(spark, sf):
    li = panels.table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("f"))
    facts = li.agg(F.count(F.lit(1)).alias("n"), F.avg("l_discount").alias("m"))
    count = F.struct(F.concat(F.lit("count_"), "f").alias("check_id"), F.col("n").cast("string").alias("recomputed"))
    disc = F.struct(F.concat(F.lit("disc_"), "f").alias("check_id"), F.col("m").cast("string").alias("recomputed"))
    values = facts.select(F.inline(F.array(count, disc)))
    is_disc = F.col("check_id").startswith("disc_")
    claims = values.select(
        "check_id",
        F.when(is_disc, "0.05").otherwise(F.col("recomputed")).alias("expected"),
        F.when(is_disc, 0.0004).alias("tol"),
    )
    extra = spark.createDataFrame([("absent", "1", 0.1)], "check_id string, expected string, tol double")
    return report.audit_claims(claims.unionByName(extra), values)


@reg.add("j1_claims_audit", f"WITH {CLAIMS_SQL} SELECT check_id, status FROM audited")
def j1(spark, sf):
    return _audit(spark, sf).select("check_id", "status")


@reg.add(
    "j1_audit_summary",
    f"""WITH {CLAIMS_SQL} SELECT count(*) AS checks, count_if(status = 'PASS') AS passed, count_if(status = 'FAIL') = 0 AS all_pass FROM audited""",
)
def j1_summary(spark, sf):
    return report.audit_summary(_audit(spark, sf))


PER = "per AS (SELECT model, regime, avg(MASE) AS v FROM runs GROUP BY model, regime)"


@reg.add(
    "j2_panel_stats",
    f"WITH {RUNS_SQL}, {PER} SELECT model, {r('avg(v)', 'mean')}, {r('stddev_samp(v)', 'sd')}, count(*) AS n_series FROM per GROUP BY model",
)
def j2(spark, sf):
    return report.panel_stats(_flag_runs(spark, sf), ["model"], series="regime")


@reg.add(
    "j2_raw_row_stats",
    f"WITH {RUNS_SQL} SELECT model, {r('avg(MASE)', 'mean_rows')}, {r('stddev_samp(MASE)', 'sd_rows')}, count(MASE) AS n_rows FROM runs GROUP BY model",
)
def j2_raw(spark, sf):
    return report.raw_row_stats(_flag_runs(spark, sf), ["model"])


@reg.add(
    "j3_accuracy_table",
    f"""WITH {DM}, {BH}, {ROLL}, scale AS (SELECT series_id, greatest(avg(abs(y - y0)), 1e-9) AS scale FROM (
        SELECT *, lag(y, 4) OVER (PARTITION BY series_id ORDER BY pos) AS y0 FROM panel) WHERE pos < n - 24 GROUP BY series_id),
    scores AS (SELECT p.series_id, p.model, avg(abs(y_true - y_pred)) / any_value(s.scale) AS MASE FROM preds p JOIN scale s ON s.series_id = p.series_id GROUP BY p.series_id, p.model),
    {RANKS},
    st AS (SELECT model, avg(MASE) AS mean, stddev_samp(MASE) AS sd, count(*) AS n_series FROM scores GROUP BY model),
    rk AS (SELECT model, avg(rk) AS avg_rank FROM ranked GROUP BY model),
    w AS (SELECT CASE WHEN model_a = 'seasonal_mean' THEN model_b ELSE model_a END AS model,
        CASE WHEN model_a = 'seasonal_mean' THEN a_wins_fdr ELSE b_wins_fdr END AS ref_wins_fdr,
        CASE WHEN model_a = 'seasonal_mean' THEN b_wins_fdr ELSE a_wins_fdr END AS model_wins_fdr
      FROM roll WHERE model_a = 'seasonal_mean' OR model_b = 'seasonal_mean')
    SELECT st.model, {r("mean")}, {r("sd")}, n_series, {r("avg_rank")}, coalesce(ref_wins_fdr, -1) AS ref_wins_fdr, coalesce(model_wins_fdr, -1) AS model_wins_fdr
    FROM st LEFT JOIN rk ON rk.model = st.model LEFT JOIN w ON w.model = st.model""",
)
def j3(spark, sf):
    """Panel and predictions are built once, for scores and tests alike."""
    p = panel(spark, sf)
    preds = settled(predicted(p), "preds")
    s = settled(scored(p, preds), "scores")
    out = report.accuracy_table(
        report.panel_stats(s, ["model"]),
        stats.average_ranks(_ranks(spark, sf, s), ["panel"], len(MODELS)),
        report.oriented_wins(_rollup(spark, sf, preds), "seasonal_mean"),
    )
    return out.drop("critical_difference").fillna(-1, ["ref_wins_fdr", "model_wins_fdr"])


# The two baselines stand in every covariate configuration, the ridge differs between them.
BLOCK_MODELS = ("seasonal_naive", "seasonal_mean", "ridge")
BLOCK_SQL = f"""{PREDS.replace("preds AS", "bpreds AS")},{CONFIG_SQL.removeprefix(SUPPLIER_PANEL + ",").replace("preds AS", "cpreds AS")},
{TIERS}, parts AS (SELECT series_id, model AS config, 'ridge' AS model, fold, lead, pos, y_true, y_pred FROM cpreds
  UNION ALL SELECT series_id, config, model, fold, lead, pos, y_true, y_pred FROM bpreds
    CROSS JOIN (SELECT unnest(['none', 'causal', 'perfect']) AS config) WHERE model <> 'last_value'),
preds AS MATERIALIZED (SELECT t.tier || '|' || p.config || '|' || p.series_id AS series_id, p.* EXCLUDE (series_id, config) FROM parts p JOIN tiers t ON t.series_id = p.series_id),
{scale_cte(HORIZON, FOLDS, MIN_TRAIN, SEASON)},
scores AS (SELECT p.series_id, p.model, avg(abs(y_true - y_pred)) AS MAE, sqrt(avg((y_true - y_pred) * (y_true - y_pred))) AS RMSE,
    avg(abs(y_true - y_pred)) / any_value(s.scale) AS MASE FROM preds p JOIN scale s ON s.series_id = split_part(p.series_id, '|', 3) GROUP BY ALL),
{LOSSES.replace("last_value", "ridge")}, {dm_sql()},
fam AS (SELECT *, split_part(series_id, '|', 1) AS domain, split_part(series_id, '|', 2) AS config FROM tests),
fam_n AS (SELECT domain, config, model_a, model_b, count(*) AS m_all FROM fam GROUP BY ALL),
fam_r AS (SELECT f.*, m_all, row_number() OVER (PARTITION BY f.domain, f.config, f.model_a, f.model_b ORDER BY p_value) AS rn
  FROM fam f JOIN fam_n USING (domain, config, model_a, model_b) WHERE p_value IS NOT NULL),
fam_bh AS (SELECT *, min(p_value * m_all / rn) OVER (PARTITION BY domain, config, model_a, model_b ORDER BY rn DESC
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS p_bh FROM fam_r),
roll AS (SELECT f.domain, f.config, f.model_a, f.model_b, count_if(p_bh < 0.05 AND f.better = f.model_a) AS a_wins, count_if(p_bh < 0.05 AND f.better = f.model_b) AS b_wins
  FROM fam f LEFT JOIN fam_bh b USING (series_id, model_a, model_b) GROUP BY ALL),
w AS (SELECT domain, config, CASE WHEN model_a = 'seasonal_mean' THEN model_b ELSE model_a END AS model,
    CASE WHEN model_a = 'seasonal_mean' THEN a_wins ELSE b_wins END AS ref_wins_fdr, CASE WHEN model_a = 'seasonal_mean' THEN b_wins ELSE a_wins END AS model_wins_fdr
  FROM roll WHERE model_a = 'seasonal_mean' OR model_b = 'seasonal_mean'),
marks AS (SELECT split_part(series_id, '|', 1) AS domain, split_part(series_id, '|', 2) AS config, *, count(*) OVER (PARTITION BY series_id) AS k,
    rank() OVER (PARTITION BY series_id ORDER BY MASE) + (count(*) OVER (PARTITION BY series_id, MASE) - 1) / 2.0 AS rk FROM scores),
cells AS (SELECT domain, config, model, count(*) AS n_series, avg(MASE) AS mean_MASE, stddev_samp(MASE) AS sd_MASE, avg(MAE) AS mean_MAE, stddev_samp(MAE) AS sd_MAE,
    avg(RMSE) AS mean_RMSE, stddev_samp(RMSE) AS sd_RMSE, avg(rk) FILTER (k = 3) AS avg_rank FROM marks GROUP BY ALL)"""


@reg.add(
    "j3_accuracy_by_config",
    f"""WITH {BLOCK_SQL} SELECT domain, config, model, n_series, {", ".join(r(f"{a}_{v}") for v in ("MASE", "MAE", "RMSE") for a in ("mean", "sd"))},
      {r("avg_rank")}, coalesce(ref_wins_fdr, -1) AS ref_wins_fdr, coalesce(model_wins_fdr, -1) AS model_wins_fdr
    FROM cells LEFT JOIN w USING (domain, config, model)""",
)
def j3_blocks(spark, sf):
    """The main table by domain (here the suppliers' tier) and covariate configuration."""
    p = panel(spark, sf)
    ridge = _config_predictions(p).withColumnRenamed("model", "config").withColumn("model", F.lit("ridge"))
    base = predicted(p).filter(F.col("model").isin(*BLOCK_MODELS))
    base = base.withColumn("config", F.explode(F.array(*[F.lit(c) for c in CONFIGS])))
    preds = ridge.unionByName(base, allowMissingColumns=True)
    preds = preds.join(supplier_tiers(spark, sf).select("series_id", F.col("tier").alias("domain")), "series_id")
    preds = settled(preds.select("domain", "config", "series_id", "model", "fold", "lead", "pos", "y_true", "y_pred"), "preds")
    # a configuration's rows score as a model of its own, so one scale serves all
    named = preds.withColumn("model", F.concat_ws("|", "domain", "config", "model"))
    part = F.split("model", r"\|")
    s = settled(scored(p, named), "scores").select(
        part[0].alias("domain"), part[1].alias("config"), "series_id", part[2].alias("model"), "MASE", "MAE", "RMSE"
    )
    out = report.accuracy_by_block(preds, s, ["domain", "config"], BLOCK_MODELS, "seasonal_mean", HORIZON)
    return out.fillna(-1, ["ref_wins_fdr", "model_wins_fdr"])


@reg.add(
    "j4_coverage_pivot",
    f"""WITH {PREDS}, {CONFORMAL} SELECT series_id, {", ".join(r(f"avg({v}) FILTER (model = '{m}')", f"{v}_{m}") for m in MODELS for v in ("coverage", "width"))}
    FROM conf GROUP BY series_id""",
)
def j4(spark, sf):
    c = stats.split_conformal(predictions(spark, sf))
    return report.pivoted(
        c, ["series_id"], "model", MODELS, {"coverage": F.col("coverage"), "width": F.col("width")}
    )


@reg.add(
    "j4_horizon_table",
    f"""WITH {PREDS}, {TIERS} SELECT p.model, p.lead, {r("avg(abs(y_true - y_pred)) FILTER (tier = 'rich')", "mae_rich")},
      {r("avg(abs(y_true - y_pred)) FILTER (tier = 'scarce')", "mae_scarce")} FROM preds p JOIN tiers t ON t.series_id = p.series_id GROUP BY p.model, p.lead""",
)
def j4_horizon(spark, sf):
    p = predictions(spark, sf).join(supplier_tiers(spark, sf), "series_id")
    e = F.abs(F.col("y_true") - F.col("y_pred"))
    return report.pivoted(p, ["model", "lead"], "tier", ["rich", "scarce"], {"mae": e})


@reg.add(
    "j4_dm_matrix",
    f"""WITH {DM} SELECT series_id, {", ".join(r(f"avg(p_value) FILTER (model_a || '/' || model_b = '{a}/{b}')", f"p_{a}/{b}") .replace(f" AS p_{a}/{b}", f' AS "p_{a}/{b}"') for a, b in stats.model_pairs(MODELS))}
    FROM tests GROUP BY series_id""",
)
def j4_dm(spark, sf):
    tests = stats.paired_summary(predictions(spark, sf), MODELS, 4)
    tests = tests.withColumn("pair", F.concat_ws("/", "model_a", "model_b"))
    names = [f"{a}/{b}" for a, b in stats.model_pairs(MODELS)]
    return report.pivoted(tests, ["series_id"], "pair", names, {"p": F.col("p_value")})


BUDGET_SQL = f"""{SCORED},
g AS (SELECT series_id, CASE WHEN model = 'last_value' THEN 'base' ELSE model END AS strategy,
    CASE WHEN model = 'last_value' THEN -1 ELSE fr END AS fraction, MASE * (1 + CASE WHEN model = 'last_value' THEN 0 ELSE 0.1 / fr END) AS MASE
  FROM scores CROSS JOIN (SELECT unnest([1.0, 10.0, 100.0]::DOUBLE[]) AS fr) WHERE model <> 'last_value' OR fr = 1),
per AS (SELECT strategy, fraction, series_id, avg(MASE) AS v FROM g GROUP BY ALL),
st AS (SELECT strategy, fraction, avg(v) AS mean, stddev_samp(v) AS sd, count(*) AS n_series FROM per GROUP BY ALL),
b AS (SELECT series_id, v AS base FROM per WHERE strategy = 'base'),
ws AS (SELECT p.strategy, p.fraction, count(*) AS n, count_if(v - base < 0) AS wins FROM per p JOIN b ON b.series_id = p.series_id WHERE strategy <> 'base' GROUP BY ALL)"""


@reg.add(
    "j5_budget_table",
    f"""WITH {BUDGET_SQL} SELECT st.strategy, {r("st.fraction", "fraction")}, {r("mean")}, {r("sd")}, n_series,
      {r("mean - (SELECT mean FROM st WHERE strategy = 'base')", "delta")}, coalesce(wins, -1) AS wins
    FROM st LEFT JOIN ws ON ws.strategy = st.strategy AND ws.fraction = st.fraction""",
)
def j5(spark, sf):
    return _budget(spark, sf).drop("p_wilcoxon", "p_holm", "n", "ci_lo", "ci_hi")


# Weights as the bootstraps of single groups draw them: by series and replicate, whatever the group.
BUDGET_TESTS_SQL = f"""{BUDGET_SQL},
jd AS MATERIALIZED (SELECT p.strategy, p.fraction, p.series_id, v - base AS d FROM per p JOIN b ON b.series_id = p.series_id WHERE strategy <> 'base' AND v - base IS NOT NULL),
{signed_rank_exact_sql("jd", "strategy, fraction", "d")},
hm AS (SELECT strategy, fraction, p_wilcoxon, count(p_wilcoxon) OVER () - rank() OVER (ORDER BY p_wilcoxon NULLS LAST) + 1 AS k FROM srx),
adj AS (SELECT *, least(1.0, max(p_wilcoxon * k) OVER (ORDER BY p_wilcoxon NULLS LAST)) AS p_holm FROM hm),
hashes AS MATERIALIZED (SELECT series_id, q, md5('7|' || q || '|' || series_id) AS h FROM (SELECT DISTINCT series_id FROM jd) CROSS JOIN (SELECT unnest(range({DRAWS // 4})) AS q) t),
draws AS (SELECT series_id, q * 4 + i AS rep, (CAST('0x' || substr(h, CAST(8 * i + 1 AS BIGINT), 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE AS u
  FROM hashes CROSS JOIN (SELECT unnest(range(4)) AS i) t),
weights AS MATERIALIZED (SELECT series_id, rep, CAST({WEIGHT} AS DOUBLE) AS w FROM draws),
reps AS (SELECT strategy, fraction, rep, count(*) AS n, CASE WHEN sum(w) > 0 THEN sum(w * d) / sum(w) END AS m FROM jd JOIN weights USING (series_id) GROUP BY ALL),
ci AS (SELECT strategy, fraction, max(n) AS n, quantile_cont(m, 0.025) AS ci_lo, quantile_cont(m, 0.975) AS ci_hi FROM reps GROUP BY ALL)"""


@reg.add(
    "j5_budget_table_tests",
    f"""WITH RECURSIVE {BUDGET_TESTS_SQL} SELECT strategy, {r("fraction")}, {r("mean")}, {r("sd")}, n_series,
      {r("mean - (SELECT mean FROM st WHERE strategy = 'base')", "delta")}, {r("p_wilcoxon")}, {r("p_holm")}, coalesce(wins, -1) AS wins, ci.n, {r("ci_lo")}, {r("ci_hi")}
    FROM st LEFT JOIN adj USING (strategy, fraction) LEFT JOIN ws USING (strategy, fraction) LEFT JOIN ci USING (strategy, fraction)""",
)
def j5_tests(spark, sf):
    """With signed-rank p, Holm adjustment and bootstrap interval."""
    return _budget(spark, sf)


def _budget(spark, sf):
    s = backtest.with_grid(settled(scores(spark, sf), "scores"), fraction=[1.0, 10.0, 100.0])
    base = F.col("model") == "last_value"
    s = s.filter(~base | (F.col("fraction") == 1.0))
    s = s.select(
        "series_id",
        F.when(base, "base").otherwise(F.col("model")).alias("strategy"),
        F.when(base, -1.0).otherwise(F.col("fraction")).alias("fraction"),
        F.when(base, F.col("MASE")).otherwise(F.col("MASE") * (1 + 0.1 / F.col("fraction"))).alias("MASE"),
    )
    keys = ["strategy", "fraction"]
    st = report.panel_stats(s, keys)
    ref = s.filter("strategy = 'base'").select("series_id", F.col("MASE").alias("_base"))
    d = s.filter("strategy <> 'base'").join(ref, "series_id").withColumn("d", F.col("MASE") - F.col("_base"))
    d = settled(d, "paired")
    tests = settled(stats.signed_rank(d, keys, "d").select(*keys, "p_wilcoxon"), "tests")
    tests = stats.holm(tests.withColumn("family", F.lit("all")), ["family"], "p_wilcoxon").drop("family")
    wins = d.groupBy(*keys).agg(F.count_if(F.col("d") < 0).alias("wins"))
    ci = stats.bootstrap_mean(d, keys, "series_id", "d")
    out = report.budget_table(st, "base", tests.join(wins, keys), ci, keys)
    return out.fillna(-1, ["wins"])


@reg.add(
    "j6_exposure_table",
    f"""WITH w AS (SELECT l_suppkey, count(*) AS usable_hours, CAST(min(l_shipdate) AS DATE) AS s, CAST(max(l_shipdate) AS DATE) AS e FROM lineitem GROUP BY l_suppkey),
    o AS (SELECT *, greatest(date_diff('day', greatest(s, DATE '2001-06-01'), least(e, DATE '2002-12-31')), 0) AS od, date_diff('day', s, e) AS sd FROM w)
    SELECT l_suppkey, usable_hours, {d("s", "usable_from")}, {d("e", "usable_to")}, od AS overlap_days, sd AS span_days, {r("od / CAST(sd AS DOUBLE)", "overlap_frac")}
    FROM o WHERE od > 0""",
)
def j6(spark, sf):
    out = joins.era_overlap(_windows(spark, sf), "2001-06-01", "2002-12-31", "usable_from", "usable_to")
    return out.filter("overlap_days > 0").orderBy(F.desc("overlap_frac"), "l_suppkey")


def _windows(spark, sf):
    return panels.table(spark, sf, "lineitem").groupBy("l_suppkey").agg(
        F.count(F.lit(1)).alias("usable_hours"),
        F.to_date(F.min("l_shipdate")).alias("usable_from"),
        F.to_date(F.max("l_shipdate")).alias("usable_to"),
    )


@reg.add(
    "j6_panel_table",
    f"""WITH w AS (SELECT l_suppkey, count(*) AS usable_hours, min(l_shipdate) AS s, max(l_shipdate) AS e FROM lineitem GROUP BY l_suppkey)
    SELECT array_to_string(list_transform(string_split(replace(replace(lower(s_name), ' ', '_'), '_', ' '), ' '), lambda x: upper(x[1]) || lower(x[2:])), ' ') AS city,
      n_name AS country, CASE WHEN s_acctbal >= 5000 THEN 'rich' ELSE 'scarce' END AS tier, s_suppkey AS sensor_id,
      {d("s", "usable_from")}, {d("e", "usable_to")}, usable_hours
    FROM w JOIN supplier ON s_suppkey = l_suppkey LEFT JOIN nation ON n_nationkey = s_nationkey WHERE usable_hours >= 550""",
)
def j6_panel(spark, sf):
    """Suppliers as sensors: those with enough rows, with nation and key from the manifest."""
    s = panels.table(spark, sf, "supplier")
    n = panels.table(spark, sf, "nation").select("n_nationkey", F.col("n_name").alias("country"))
    manifest = s.join(n, s["s_nationkey"] == n["n_nationkey"], "left").select(
        F.col("s_name").alias("city"), "country", F.col("s_suppkey").alias("sensor_id")
    )
    tier = F.when(F.col("s_acctbal") >= 5000, "rich").otherwise("scarce").alias("tier")
    names = s.select(F.col("s_suppkey").alias("l_suppkey"), slug("s_name").alias("city"), tier)
    q = _windows(spark, sf).join(names, "l_suppkey").withColumn("PASS", F.col("usable_hours") >= 550)
    return report.panel_table(q, manifest)


@reg.add(
    "j6_recency_table",
    f"""WITH {SINCE_SQL}, {baseline_preds()}, {scale_cte(HORIZON, FOLDS, MIN_TRAIN, SEASON)}, {SCORES},
    c AS (SELECT series_id, count(*) AS rows_since FROM panel GROUP BY series_id)
    SELECT c.series_id, any_value(rows_since) AS rows_since, {", ".join(r(f"avg(MASE) FILTER (model = '{m}')", f"MASE_{m}") for m in MODELS)}
    FROM c JOIN scores s ON s.series_id = c.series_id GROUP BY c.series_id""",
)
def j6_recency(spark, sf):
    """Accuracy after a cutoff beside the rows it rests on."""
    late = settled(backtest.rows_since(panel(spark, sf), CUTOFF, SINCE_ROWS)[0], "late")
    return report.recency_table(late, scored(late, predicted(late)), MODELS)


@reg.add(
    "j6_energy_table",
    f"""SELECT l_returnflag AS model, {r("avg(l_extendedprice)", "mean_j")}, {r("stddev_samp(l_extendedprice)", "sd_j")}, {r("avg(l_extendedprice) / 3.6e6 * 0.15 * 1.4", "usd_with_pue")}
    FROM lineitem GROUP BY l_returnflag""",
)
def j6_energy(spark, sf):
    li = panels.table(spark, sf, "lineitem")
    return li.groupBy(F.col("l_returnflag").alias("model")).agg(
        F.avg("l_extendedprice").alias("mean_j"),
        F.stddev_samp("l_extendedprice").alias("sd_j"),
        metrics.table_cost(F.avg("l_extendedprice")).alias("usd_with_pue"),
    )


@reg.add(
    "j7_descriptive_cells",
    f"""SELECT l_returnflag, l_linestatus, {r("avg(l_extendedprice)", "mean")}, {r("stddev_samp(l_extendedprice)", "sd")}, count(*) AS n,
      {r("quantile_cont(l_extendedprice, 0.25::DOUBLE)", "q1")}, {r("median(l_extendedprice)", "median")}, {r("quantile_cont(l_extendedprice, 0.75::DOUBLE)", "q3")},
      {r("100.0 * count(*) / (SELECT count(*) FROM lineitem)", "pct")} FROM lineitem GROUP BY l_returnflag, l_linestatus""",
)
def j7(spark, sf):
    """Quartiles of groups that hold a large share of the whole table."""
    li = panels.table(spark, sf, "lineitem")
    return report.descriptive_cells(li, ["l_returnflag", "l_linestatus"], "l_extendedprice")


@reg.add(
    "j8_coverage_summary",
    f"""WITH w AS (SELECT l_suppkey, count(*) AS h, min(l_shipdate) AS s, max(l_shipdate) AS e FROM lineitem GROUP BY l_suppkey)
    SELECT {d("min(s)", "first_day")}, {d("max(e)", "last_day")}, count(*) AS n_series, count_if(e >= TIMESTAMP '2001-09-01') AS n_affected, CAST(sum(h) AS BIGINT) AS hours,
      CAST(sum(CASE WHEN e >= TIMESTAMP '2001-09-01' THEN h ELSE 0 END) AS BIGINT) AS affected_hours,
      {r("sum(CASE WHEN e >= TIMESTAMP '2001-09-01' THEN h ELSE 0 END) / sum(h)", "affected_share")} FROM w""",
)
def j8(spark, sf):
    late = F.col("usable_to") >= F.lit("2001-09-01").cast("date")
    return report.coverage_summary(_windows(spark, sf), late)
