"""Queries of the paired-comparison family."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelkit.functions import tails
from panelkit.operators import decide, features, metrics, report, stats
from panelkit.operators import backtest as b
from panelkit.operators.resample import POISSON
from panelkit.registry.common import (
    FOLDS,
    HORIZON,
    LONG,
    MIN_TRAIN,
    MODELS,
    PREDS,
    SCORED,
    SCORES,
    SEASON,
    SUPPLIER_PANEL,
    TIERS,
    WIDE,
    Registry,
    panel,
    predictions,
    r,
    scale_cte,
    scored,
    scores,
    supplier_tiers,
    t,
)
from panelkit.session import settled
from panelkit.sources import panels

reg = Registry()
QUERIES, ORACLES = reg.queries, reg.oracles

PAIRS = stats.model_pairs(MODELS)
PAIR_VALUES = ", ".join(f"('{a}', '{c}')" for a, c in PAIRS)


def simpson(f: str, lo: str, hi: str, n: int = 600) -> str:
    """SQL integral of f(u) over [lo, hi]; f uses the token U."""
    u = f"(({lo}) + (({hi}) - ({lo})) * i / {n}.0)"
    weight = f"(CASE WHEN i = 0 OR i = {n} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)"
    return (
        f"(list_sum(list_transform(range({n + 1}), lambda i: {weight} * ({f.replace('U', u)})))"
        f" * (({hi}) - ({lo})) / {3 * n}.0)"
    )


def t_tail(t: str, df: str) -> str:
    """SQL upper tail of |t|."""
    area = simpson(f"pow(cos(U), ({df}) - 1)", f"atan(abs({t}) / sqrt({df}))", "pi() / 2")
    return f"({area} * exp(lgamma((({df}) + 1) / 2.0) - lgamma(({df}) / 2.0)) / sqrt(pi()))"


def normal_two_sided(z: str) -> str:
    """Substituting x = z + s keeps the grid where the mass is."""
    area = simpson(f"exp(-(abs({z}) + U) * (abs({z}) + U) / 2.0)", "0", "12")
    return f"(2 * {area} / sqrt(2 * pi()))"


def sign_p(w: str, n: str) -> str:
    k = f"CAST(least({w}, ({n}) - ({w})) AS BIGINT)"
    terms = f"exp(lgamma(({n}) + 1) - lgamma(i + 1) - lgamma(({n}) - i + 1) - ({n}) * ln(2.0))"
    return f"least(1.0, 2 * list_sum(list_transform(range({k} + 1), lambda i: {terms})))"


LOSSES = f"""losses AS (SELECT series_id, fold, lead, pos,
    max(abs(y_true - y_pred)) FILTER (model = 'seasonal_naive') AS seasonal_naive,
    max(abs(y_true - y_pred)) FILTER (model = 'seasonal_mean') AS seasonal_mean,
    max(abs(y_true - y_pred)) FILTER (model = 'last_value') AS last_value
  FROM preds GROUP BY ALL),
diffs AS (SELECT series_id, fold, lead, pos, a AS model_a, b AS model_b,
    (CASE a WHEN 'seasonal_naive' THEN seasonal_naive WHEN 'seasonal_mean' THEN seasonal_mean ELSE last_value END)
    - (CASE b WHEN 'seasonal_naive' THEN seasonal_naive WHEN 'seasonal_mean' THEN seasonal_mean ELSE last_value END) AS d
  FROM losses CROSS JOIN (VALUES {PAIR_VALUES}) v(a, b))"""


def dm_sql(h: int = HORIZON) -> str:
    """CTEs centred, gammas, dm over diffs."""
    return f"""centred AS (SELECT *, d - avg(d) OVER (PARTITION BY series_id, model_a, model_b) AS c,
    row_number() OVER (PARTITION BY series_id, model_a, model_b ORDER BY pos) AS i FROM diffs),
gammas AS (SELECT x.series_id, x.model_a, x.model_b, g.k, avg(x.c * y.c) AS gamma
  FROM centred x CROSS JOIN (SELECT unnest(range({h})) AS k) g
  JOIN centred y ON y.series_id = x.series_id AND y.model_a = x.model_a AND y.model_b = x.model_b AND y.i = x.i + g.k
  GROUP BY ALL),
hac AS (SELECT series_id, model_a, model_b, sum(CASE WHEN k = 0 THEN gamma ELSE 2 * (1 - k / {h}.0) * gamma END) AS v
  FROM gammas GROUP BY ALL),
base AS (SELECT series_id, model_a, model_b, count(*) AS n, avg(d) AS m FROM diffs GROUP BY ALL),
dm AS (SELECT b.*, CASE WHEN n >= 10 AND v > 1e-12 THEN m / sqrt(v / n) * sqrt((n + 1 - 2 * {h} + {h} * ({h} - 1) / CAST(n AS DOUBLE)) / n) END AS dm_stat
  FROM base b JOIN hac h USING (series_id, model_a, model_b)),
tests AS (SELECT *, CASE WHEN dm_stat IS NOT NULL THEN 2 * {t_tail("dm_stat", "n - 1")} END AS p_value,
    CASE WHEN m < 0 THEN model_a ELSE model_b END AS better FROM dm)"""


BH = """fam AS (SELECT *, row_number() OVER (PARTITION BY model_a, model_b ORDER BY p_value) AS rn,
    count(*) OVER (PARTITION BY model_a, model_b) AS mm FROM tests WHERE p_value IS NOT NULL),
allm AS (SELECT model_a, model_b, count(*) AS m_all FROM tests GROUP BY ALL),
bh AS (SELECT f.*, least(1.0, min(p_value * m_all / rn) OVER (PARTITION BY f.model_a, f.model_b ORDER BY rn DESC
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS p_bh,
    least(1.0, max(p_value * (mm - rn + 1)) OVER (PARTITION BY f.model_a, f.model_b ORDER BY rn
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS p_holm
  FROM fam f JOIN allm a ON a.model_a = f.model_a AND a.model_b = f.model_b),
adjusted AS (SELECT t.*, b.p_bh, b.p_holm FROM tests t LEFT JOIN bh b USING (series_id, model_a, model_b))"""

DM = f"{PREDS}, {LOSSES}, {dm_sql()}"


def _tests(spark, sf):
    return stats.paired_summary(predictions(spark, sf), MODELS, HORIZON)


@reg.add(
    "g1_g2_diebold_mariano",
    f"""WITH {DM} SELECT series_id, model_a, model_b, n, {r("m", "mean_loss_diff")}, {r("dm_stat")}, {r("p_value")},
      better, coalesce(p_value < 0.05, false) AS significant FROM tests""",
)
def g1(spark, sf):
    return _tests(spark, sf)


@reg.add(
    "g1_dm_squared_loss",
    f"""WITH {PREDS}, {LOSSES.replace("abs(y_true - y_pred)", "(y_true - y_pred) * (y_true - y_pred)")}, {dm_sql(1)}
    SELECT series_id, model_a, model_b, n, {r("m", "mean_loss_diff")}, {r("dm_stat")}, {r("p_value")},
      better, coalesce(p_value < 0.05, false) AS significant FROM tests""",
)
def g1_se(spark, sf):
    return stats.paired_summary(predictions(spark, sf), MODELS, h=1, loss="se")


SEEDED = f"""{PREDS},
seeded AS (SELECT series_id, model, fold, lead, pos, y_true, y_pred, CAST(NULL AS BIGINT) AS seed FROM preds WHERE model <> 'seasonal_mean'
  UNION ALL SELECT series_id, model, fold, lead, pos, y_true, y_pred + (seed - 42) * (lead - 2.5), seed FROM preds
    CROSS JOIN (SELECT unnest([41, 42, 43]) AS seed) WHERE model = 'seasonal_mean')"""


def _seeded(spark, sf):
    """seasonal_mean with three deterministic variants as its seeds."""
    p = predictions(spark, sf)
    seeds = F.when(
        F.col("model") == "seasonal_mean", F.array(F.lit(41), F.lit(42), F.lit(43))
    ).otherwise(F.array(F.lit(None).cast("int")))
    p = p.withColumn("seed", F.explode(seeds))
    shift = F.coalesce((F.col("seed") - 42) * (F.col("lead") - 2.5), F.lit(0.0))
    return p.withColumn("y_pred", F.col("y_pred") + shift)


@reg.add(
    "g3_seed_ensemble",
    f"""WITH {SEEDED} SELECT series_id, model, fold, lead, pos, {r("any_value(y_true)", "y_true")}, {r("avg(y_pred)", "y_pred")}
    FROM seeded GROUP BY series_id, model, fold, lead, pos""",
)
def g3(spark, sf):
    return stats.seed_ensemble(_seeded(spark, sf))


G4_SQL = f"""{SEEDED},
named AS (SELECT series_id, fold, lead, pos, coalesce(model || '_s' || seed, model) AS model, abs(y_true - y_pred) AS l FROM seeded),
diffs AS (SELECT a.series_id, a.fold, a.lead, a.pos, a.model AS model_a, b.model AS model_b, a.l - b.l AS d
  FROM named a JOIN named b ON a.series_id = b.series_id AND a.pos = b.pos
  WHERE a.model LIKE 'seasonal_mean_s%' AND b.model IN ('seasonal_naive', 'last_value')), {dm_sql()}"""


@reg.add(
    "g4_dm_by_seed",
    f"""WITH {G4_SQL} SELECT series_id, model_a, model_b, n, {r("m", "mean_loss_diff")}, {r("dm_stat")}, {r("p_value")},
      better, coalesce(p_value < 0.05, false) AS significant, CAST(right(model_a, 2) AS BIGINT) AS seed FROM tests""",
)
def g4(spark, sf):
    return stats.dm_by_seed(
        _seeded(spark, sf), "seasonal_mean", [41, 42, 43], ["seasonal_naive", "last_value"], HORIZON
    )


@reg.add(
    "g5_benjamini_hochberg",
    f"WITH {DM}, {BH} SELECT series_id, model_a, model_b, {r('p_value')}, {r('p_bh')} FROM adjusted",
)
def g5(spark, sf):
    t = settled(_tests(spark, sf).select("series_id", "model_a", "model_b", "p_value"), "tests")
    return stats.benjamini_hochberg(t, ["model_a", "model_b"])


@reg.add(
    "g6_holm",
    f"WITH {DM}, {BH} SELECT series_id, model_a, model_b, {r('p_value')}, {r('p_holm')} FROM adjusted",
)
def g6(spark, sf):
    t = settled(_tests(spark, sf).select("series_id", "model_a", "model_b", "p_value"), "tests")
    return stats.holm(t, ["model_a", "model_b"])


ROLL = """roll AS (SELECT model_a, model_b, count(*) AS n_series, count_if(coalesce(p_value < 0.05, false)) AS n_sig,
    count_if(coalesce(p_bh < 0.05, false)) AS n_sig_fdr,
    count_if(coalesce(p_value < 0.05, false) AND better = model_a) AS a_wins,
    count_if(coalesce(p_value < 0.05, false) AND better <> model_a) AS b_wins,
    count_if(coalesce(p_bh < 0.05, false) AND better = model_a) AS a_wins_fdr,
    count_if(coalesce(p_bh < 0.05, false) AND better <> model_a) AS b_wins_fdr, median(p_value) AS median_p
  FROM adjusted GROUP BY model_a, model_b)"""


def _rollup(spark, sf, preds=None):
    t = _tests(spark, sf) if preds is None else stats.paired_summary(preds, MODELS, HORIZON)
    t = settled(stats.benjamini_hochberg(settled(t, "tests"), ["model_a", "model_b"]), "adjusted")
    return stats.panel_rollup(t)


@reg.add(
    "g7_panel_rollup",
    f"""WITH {DM}, {BH}, {ROLL} SELECT model_a, model_b, n_series, n_sig, n_sig_fdr, a_wins, b_wins, a_wins_fdr,
      b_wins_fdr, {r("median_p")} FROM roll""",
)
def g7(spark, sf):
    return _rollup(spark, sf)


CONFORMAL = """res AS (SELECT series_id, model, abs(y_true - y_pred) AS e,
    row_number() OVER (PARTITION BY series_id, model ORDER BY pos) AS i, count(*) OVER (PARTITION BY series_id, model) AS n FROM preds),
cal AS (SELECT series_id, model, n // 2 AS n_cal, n - n // 2 AS n_test, list_sort(list(e) FILTER (i <= n // 2)) AS s FROM res GROUP BY series_id, model, n),
q AS (SELECT *, s[least(CAST(ceil(round((n_cal + 1) * 0.95, 9)) AS BIGINT), n_cal)] AS q FROM cal),
conf AS (SELECT r.series_id, r.model, q.n_cal, q.n_test, q.q, avg(CASE WHEN r.e <= q.q THEN 1.0 ELSE 0.0 END) AS coverage, 2 * q.q AS width
  FROM res r JOIN q ON q.series_id = r.series_id AND q.model = r.model WHERE r.i > q.n_cal GROUP BY ALL)"""


@reg.add(
    "g8_split_conformal",
    f"WITH {PREDS}, {CONFORMAL} SELECT series_id, model, n_cal, n_test, {r('q')}, {r('coverage')}, {r('width')} FROM conf",
)
def g8(spark, sf):
    return stats.split_conformal(predictions(spark, sf))


@reg.add(
    "g9_pooled_conformal",
    f"""WITH {PREDS}, {CONFORMAL}, {TIERS} SELECT t.tier, c.model, {r("avg(coverage)", "mean_coverage")},
      {r("avg(width)", "mean_width")}, count(*) AS n_series
    FROM conf c JOIN tiers t ON t.series_id = c.series_id GROUP BY t.tier, c.model""",
)
def g9(spark, sf):
    c = stats.split_conformal(predictions(spark, sf)).join(supplier_tiers(spark, sf), "series_id")
    return stats.pooled_conformal(c, ["tier", "model"])


# --- tests over series ------------------------------------------------------

PAIRED = f"""{SCORED}, {WIDE}, {TIERS},
paired AS (SELECT w.series_id, coalesce(t.tier, '?') AS tier, w.seasonal_naive AS a, w.seasonal_mean AS b, w.last_value AS c,
    w.seasonal_naive - w.seasonal_mean AS d, t.acctbal FROM wide w LEFT JOIN tiers t ON t.series_id = w.series_id)"""


def _paired(spark, sf):
    w = decide.wide_scores(scores(spark, sf), MODELS)
    w = w.join(supplier_tiers(spark, sf), "series_id", "left")
    w = w.withColumns(
        {
            "tier": F.coalesce("tier", F.lit("?")),
            "d": F.col("seasonal_naive") - F.col("seasonal_mean"),
        }
    )
    return settled(w, "paired")


@reg.add(
    "g10_sign_test",
    f"""WITH {PAIRED}, g AS (SELECT tier, count(*) AS n, count_if(d < 0) AS wins FROM paired WHERE d IS NOT NULL GROUP BY tier)
    SELECT tier, n, wins, {r(sign_p("wins", "n"), "p_sign")} FROM g""",
)
def g10(spark, sf):
    return stats.sign_test(_paired(spark, sf), ["tier"], "d")


# Ways to reach each rank sum with the first n ranks, n up to 50: the exact null distribution. Needs WITH RECURSIVE.
RANK_WAYS = """rank_ways(m, ways) AS (SELECT 0, list_transform(range(1276), lambda i: CASE WHEN i = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)
  UNION ALL SELECT m + 1, list_transform(range(1276), lambda i: ways[i + 1] + CASE WHEN i > m THEN ways[i - m] ELSE 0.0::DOUBLE END) FROM rank_ways WHERE m < 50)"""


def t_quantile_sql(src: str, keys: str, n: str, p_upper: float = 0.05) -> str:
    """CTE tq: (keys, tc) with P(T > tc) = p_upper at n - 1 degrees of freedom, by bisection. Needs WITH RECURSIVE."""
    return f"""tq_step AS (SELECT {keys}, {n} - 1 AS dof, 0.0::DOUBLE AS lo, 64.0::DOUBLE AS hi, 0 AS i FROM {src} WHERE {n} > 1
  UNION ALL SELECT {keys}, dof, CASE WHEN {t_tail("((lo + hi) / 2)", "dof")} > {p_upper} THEN (lo + hi) / 2 ELSE lo END,
    CASE WHEN {t_tail("((lo + hi) / 2)", "dof")} > {p_upper} THEN hi ELSE (lo + hi) / 2 END, i + 1 FROM tq_step WHERE i < 52),
tq AS (SELECT {keys}, (lo + hi) / 2 AS tc FROM tq_step WHERE i = 52)"""


def signed_rank_exact_sql(src: str, keys: str, d: str) -> str:
    """``signed_rank_sql`` and CTE srx: exact where at most 50 ranks have no ties and no zeros. Needs WITH RECURSIVE."""
    return f"""{RANK_WAYS}, {signed_rank_sql(src, keys, d)},
srx AS (SELECT s.* EXCLUDE (p_wilcoxon), CASE WHEN n_used <= 50 AND tie_sum = 0 AND n_zero = 0
    THEN least(1.0, 2 * list_sum(w.ways[1:CAST(floor(t_stat) AS BIGINT) + 1]) / pow(2.0, n_used)) ELSE p_wilcoxon END AS p_wilcoxon
  FROM sr s LEFT JOIN rank_ways w ON w.m = s.n_used)"""


def signed_rank_sql(src: str, keys: str, d: str) -> str:
    """CTE sr: normal approximation with tie correction (n > 50)."""
    return f"""sr_ranked AS (SELECT {keys}, {d} AS d, rank() OVER (PARTITION BY {keys} ORDER BY abs({d}))
    + (count(*) OVER (PARTITION BY {keys}, abs({d})) - 1) / 2.0 AS rk, count(*) OVER (PARTITION BY {keys}, abs({d})) AS tc
  FROM {src} WHERE {d} <> 0),
sr_sums AS (SELECT {keys}, coalesce(sum(rk) FILTER (d > 0), 0) AS w_plus, coalesce(sum(rk) FILTER (d < 0), 0) AS w_minus,
    count(*) AS n_used, sum(CAST(tc AS DOUBLE) * tc - 1) AS tie_sum FROM sr_ranked GROUP BY {keys}),
sr_n AS (SELECT {keys}, count({d}) AS n, count_if({d} = 0) AS n_zero FROM {src} GROUP BY {keys}),
sr AS (SELECT s.*, z.n, z.n_zero, least(w_plus, w_minus) AS t_stat,
    {normal_two_sided("(least(w_plus, w_minus) - n_used * (n_used + 1) / 4.0) / sqrt(n_used * (n_used + 1) * (2 * n_used + 1) / 24.0 - tie_sum / 48.0)")} AS p_wilcoxon
  FROM sr_sums s JOIN sr_n z USING ({keys}))"""


@reg.add(
    "g11_signed_rank",
    f"""WITH {PAIRED}, one AS (SELECT 'all' AS panel, * FROM paired), {signed_rank_sql("one", "panel", "d")}
    SELECT panel, n, n_zero, {r("w_plus")}, {r("w_minus")}, n_used, {r("tie_sum")}, {r("t_stat")}, {r("p_wilcoxon")} FROM sr""",
)
def g11(spark, sf):
    p = _paired(spark, sf).withColumn("panel", F.lit("all"))
    return stats.signed_rank(p, ["panel"], "d")


@reg.add(
    "g11_signed_rank_line_items",
    f"""WITH li AS (SELECT l_returnflag, round(l_discount - l_tax, 2) AS d FROM lineitem), {signed_rank_sql("li", "l_returnflag", "d")}
    SELECT l_returnflag, n, n_zero, {r("w_plus")}, {r("w_minus")}, n_used, {r("tie_sum")}, {r("t_stat")}, {r("p_wilcoxon")} FROM sr""",
)
def g11_rows(spark, sf):
    """Row-level test: heavy ties, and groups that grow with the table."""
    li = panels.table(spark, sf, "lineitem")
    li = li.select("l_returnflag", F.round(F.col("l_discount") - F.col("l_tax"), 2).alias("d"))
    return stats.signed_rank(li, ["l_returnflag"], "d")


RANKS = """ranked AS (SELECT 'all' AS panel, series_id, model, MASE, rank() OVER (PARTITION BY series_id ORDER BY MASE)
    + (count(*) OVER (PARTITION BY series_id, MASE) - 1) / 2.0 AS rk, count(*) OVER (PARTITION BY series_id, MASE) AS tc FROM scores)"""


def _ranks(spark, sf, known=None):
    s = scores(spark, sf) if known is None else known
    s = s.withColumn("panel", F.lit("all"))
    return settled(stats.model_ranks(s, ["panel"], MODELS), "ranks")


@reg.add(
    "g12_friedman",
    f"""WITH {SCORED}, {RANKS}, m AS (SELECT panel, model, sum(rk) AS rs, count(*) AS n, sum(CAST(tc AS DOUBLE) * tc - 1) AS ties FROM ranked GROUP BY ALL),
    g AS (SELECT panel, max(n) AS n, (12.0::DOUBLE / (max(n) * 3 * 4) * sum(rs * rs) - 3.0 * max(n) * 4) / (1 - sum(ties) / (max(n) * 3 * 8)) AS chi2 FROM m GROUP BY panel)
    SELECT panel, n, {r("chi2")}, {r("exp(-chi2 / 2)", "p_friedman")} FROM g""",
)
def g12(spark, sf):
    """Three models: the chi-square has two degrees of freedom."""
    return stats.friedman(_ranks(spark, sf), ["panel"], len(MODELS))


@reg.add(
    "g13_average_ranks",
    f"""WITH {SCORED}, {RANKS} SELECT panel, model, {r("avg(rk)", "avg_rank")}, count(*) AS n,
      {r("3.3144931525 / sqrt(2.0) * sqrt(3 * 4 / 6.0) / sqrt(count(*))", "critical_difference")} FROM ranked GROUP BY panel, model""",
)
def g13(spark, sf):
    return stats.average_ranks(_ranks(spark, sf), ["panel"], len(MODELS))


@reg.add(
    "g14_pearson",
    f"""WITH {PAIRED}, g AS (SELECT tier, corr(acctbal, d) AS r, count(*) AS n FROM paired WHERE d IS NOT NULL AND acctbal IS NOT NULL GROUP BY tier),
    h AS (SELECT *, r * sqrt((n - 2) / (1 - r * r)) AS tt FROM g)
    SELECT tier, {r("r", "r")}, n, {r("2 * " + t_tail("tt", "n - 2"), "p_value")} FROM h""",
)
def g14(spark, sf):
    return stats.pearson(_paired(spark, sf), ["tier"], "acctbal", "d")


DRAWS = 10_000


def draw(seed: int, *parts: str) -> str:
    text = " || '|' || ".join([f"'{seed}'", *[f"CAST({p} AS VARCHAR)" for p in parts]])
    return f"CAST('0x' || substr(md5({text}), 1, 8) AS BIGINT)"


WEIGHT = " + ".join(f"CAST(u > {p!r} AS INTEGER)" for p in POISSON)
BOOT = f"""idx AS MATERIALIZED (SELECT tier, series_id, d, acctbal - avg(acctbal) OVER (PARTITION BY tier) AS x,
    d - avg(d) OVER (PARTITION BY tier) AS y FROM paired WHERE d IS NOT NULL AND acctbal IS NOT NULL),
hashes AS MATERIALIZED (SELECT tier, d, x, y, b, md5('7|' || b || '|' || series_id) AS h
  FROM idx CROSS JOIN (SELECT unnest(range({DRAWS // 4})) AS b) t),
draws AS (SELECT tier, d, x, y, b * 4 + i AS rep, (CAST('0x' || substr(h, CAST(8 * i + 1 AS BIGINT), 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE AS u
  FROM hashes CROSS JOIN (SELECT unnest(range(4)) AS i) t),
weighted AS (SELECT tier, d, x, y, rep, CAST({WEIGHT} AS DOUBLE) AS w FROM draws),
sums AS (SELECT tier, rep, count(*) AS n, sum(w) AS w, sum(w * d) AS sd, sum(w * x) AS sx, sum(w * y) AS sy,
    sum(w * x * x) AS sxx, sum(w * y * y) AS syy, sum(w * x * y) AS sxy FROM weighted GROUP BY ALL),
spread AS (SELECT *, w * sxx - sx * sx AS vx, w * syy - sy * sy AS vy FROM sums),
reps AS (SELECT tier, rep, n, CASE WHEN w > 0 THEN sd / w END AS m,
    CASE WHEN vx > 1e-12 * w * sxx AND vy > 1e-12 * w * syy THEN (w * sxy - sx * sy) / sqrt(vx * vy) END AS c FROM spread)"""


@reg.add(
    "g15_bootstrap_mean",
    f"""WITH {PAIRED}, {BOOT} SELECT tier, max(n) AS n, {r("quantile_cont(m, 0.025)", "ci_lo")},
      {r("quantile_cont(m, 0.975)", "ci_hi")} FROM reps GROUP BY tier""",
)
def g15(spark, sf):
    return stats.bootstrap_mean(_paired(spark, sf), ["tier"], "series_id", "d", DRAWS)


@reg.add(
    "g16_bootstrap_corr",
    f"""WITH {PAIRED}, {BOOT} SELECT tier, max(n) AS n, {r("quantile_cont(c, 0.025)", "ci_lo")},
      {r("quantile_cont(c, 0.975)", "ci_hi")} FROM reps GROUP BY tier""",
)
def g16(spark, sf):
    return stats.bootstrap_corr(_paired(spark, sf), ["tier"], "series_id", "acctbal", "d", DRAWS)


BLOCK, BLOCK_DRAWS = 12, 10_000
KEYTEXT = "series_id || '|' || model_a || '|' || model_b"


def block_sql(block: int, name: str = "mbb") -> str:
    return f"""{name} AS (SELECT series_id, model_a, model_b, n, quantile_cont(mean, 0.025) AS ci_lo, quantile_cont(mean, 0.975) AS ci_hi FROM (
  SELECT series_id, model_a, model_b, n, rep, sum(list_sum(list_slice(ds, st + 1, st + least({block}, n - m * {block})))) / n AS mean FROM (
    SELECT a.*, rep, m, {draw(7, KEYTEXT, str(block), "rep", "m")} % (n - {block} + 1) AS st
    FROM arr a CROSS JOIN (SELECT unnest(range({BLOCK_DRAWS})) AS rep) b CROSS JOIN (SELECT unnest(range(8)) AS m) c
    WHERE n >= {block + 1} AND m < ceil(n / {block}.0))
  GROUP BY series_id, model_a, model_b, n, rep) GROUP BY ALL)"""


MBB = f"""arr AS (SELECT series_id, model_a, model_b, list(d ORDER BY pos) AS ds, count(*) AS n FROM diffs GROUP BY ALL),
blocks AS (SELECT a.*, rep, m, {draw(7, KEYTEXT, str(BLOCK), "rep", "m")} % (n - {BLOCK} + 1) AS st
  FROM arr a CROSS JOIN (SELECT unnest(range({BLOCK_DRAWS})) AS rep) b CROSS JOIN (SELECT unnest(range(5)) AS m) c
  WHERE n >= {BLOCK + 1} AND m < ceil(n / {BLOCK}.0)),
sums AS (SELECT series_id, model_a, model_b, n, rep, sum(list_sum(list_slice(ds, st + 1, st + least({BLOCK}, n - m * {BLOCK})))) / n AS mean
  FROM blocks GROUP BY series_id, model_a, model_b, n, rep),
mbb AS (SELECT series_id, model_a, model_b, n, quantile_cont(mean, 0.025) AS ci_lo, quantile_cont(mean, 0.975) AS ci_hi FROM sums GROUP BY ALL)"""


def _diffs(spark, sf):
    wide = stats.losses_wide(predictions(spark, sf), MODELS)
    return settled(stats.pair_differences(wide, PAIRS), "diffs")


@reg.add(
    "g17_block_bootstrap",
    f"""WITH {PREDS}, {LOSSES}, {MBB} SELECT series_id, model_a, model_b, n, {r("ci_lo")}, {r("ci_hi")},
      CAST({BLOCK} AS BIGINT) AS block, coalesce(ci_lo > 0 OR ci_hi < 0, false) AS significant FROM mbb""",
)
def g17(spark, sf):
    return stats.block_bootstrap(_diffs(spark, sf), BLOCK, draws=BLOCK_DRAWS)


@reg.add(
    "g17_block_lengths",
    f"""WITH {PREDS}, {LOSSES}, arr AS MATERIALIZED (SELECT series_id, model_a, model_b, list(d ORDER BY pos) AS ds, count(*) AS n
      FROM diffs WHERE model_a = 'seasonal_naive' AND model_b = 'seasonal_mean' GROUP BY ALL), {block_sql(12, "b12")}, {block_sql(24, "b24")}, {block_sql(48, "b48")},
    every AS (SELECT series_id, model_a, model_b, n, CAST(unnest([12, 24, 48]) AS BIGINT) AS block FROM arr),
    found AS (SELECT *, 12 AS block FROM b12 UNION ALL SELECT *, 24 FROM b24 UNION ALL SELECT *, 48 FROM b48)
    SELECT e.series_id, e.model_a, e.model_b, e.n, e.block, {r("ci_lo")}, {r("ci_hi")}, coalesce(ci_lo > 0 OR ci_hi < 0, false) AS significant
    FROM every e LEFT JOIN found f ON f.series_id = e.series_id AND f.model_a = e.model_a AND f.model_b = e.model_b AND f.block = e.block""",
)
def g17_lengths(spark, sf):
    """Longer folds would fill the longer blocks; too short a series has a row without an interval."""
    pair = _diffs(spark, sf).filter("model_a = 'seasonal_naive' AND model_b = 'seasonal_mean'")
    return stats.block_bootstrap(pair, (12, 24, 48), draws=BLOCK_DRAWS)


TOST_SQL = f"""RECURSIVE {PAIRED}, g AS (SELECT tier, count(*) AS n, avg(d) AS m, stddev_samp(d) / sqrt(count(*)) AS se FROM paired WHERE d IS NOT NULL GROUP BY tier),
    h AS (SELECT *, (m + 0.05) / se AS tl, -(m - 0.05) / se AS tu FROM g),
    k AS (SELECT *, CASE WHEN tl >= 0 THEN {t_tail("tl", "n - 1")} ELSE 1 - {t_tail("tl", "n - 1")} END AS pl,
      CASE WHEN tu >= 0 THEN {t_tail("tu", "n - 1")} ELSE 1 - {t_tail("tu", "n - 1")} END AS pu FROM h),
    {t_quantile_sql("g", "tier", "n")},
    tost AS (SELECT k.*, greatest(pl, pu) AS p_tost, m - tc * se AS ci90_lo, m + tc * se AS ci90_hi FROM k LEFT JOIN tq ON tq.tier = k.tier)"""


@reg.add(
    "g18_tost",
    f"""WITH {TOST_SQL} SELECT tier, n, {r("m", "mean_diff")}, {r("se")}, {r("p_tost")}, {r("ci90_lo")}, {r("ci90_hi")},
      coalesce(ci90_lo > -0.05 AND ci90_hi < 0.05, false) AS equivalent FROM tost""",
)
def g18(spark, sf):
    return stats.tost(_paired(spark, sf), ["tier"], "d")


@reg.add(
    "g18_tost_intervals",
    f"""WITH {TOST_SQL} SELECT tier, {r("ci90_lo")}, {r("ci90_hi")}, {r("(ci90_hi - ci90_lo) / 2", "half_width")} FROM tost""",
)
def g18_ci(spark, sf):
    """The 90 % intervals and half their width."""
    g = stats.tost(_paired(spark, sf), ["tier"], "d")
    return g.select("tier", "ci90_lo", "ci90_hi", ((F.col("ci90_hi") - F.col("ci90_lo")) / 2).alias("half_width"))


@reg.add(
    "g19_margin_sweep",
    f"""WITH {TOST_SQL} SELECT tier, {r("mg", "margin")}, {r("greatest(abs(ci90_lo), abs(ci90_hi))", "min_margin")},
      greatest(abs(ci90_lo), abs(ci90_hi)) < mg AS equivalent_at
    FROM tost CROSS JOIN (SELECT unnest([0.02, 0.05, 0.1]::DOUBLE[]) AS mg)""",
)
def g19(spark, sf):
    """The sweep over the intervals of the two one-sided tests."""
    tests = stats.tost(_paired(spark, sf), ["tier"], "d")
    return stats.margin_sweep(tests, [0.02, 0.05, 0.1]).select("tier", "margin", "min_margin", "equivalent_at")


TRAJ = f"""fold_means AS (SELECT series_id, model_a, model_b, fold, avg(d) AS fm, count(*) AS c FROM diffs GROUP BY ALL),
traj AS (SELECT series_id, model_a, model_b, count(*) AS n, avg(fm) AS mean_diff, stddev_samp(fm) AS sd, count_if(fm < 0) AS wins
  FROM fold_means GROUP BY ALL HAVING sum(c) = {FOLDS * HORIZON}),
traj_t AS (SELECT *, CASE WHEN sd > 0 THEN mean_diff / (sd / sqrt(n)) END AS t_stat FROM traj)"""


@reg.add(
    "g20_trajectory_tests",
    f"""WITH {PREDS}, {LOSSES}, {TRAJ} SELECT series_id, model_a, model_b, n, {r("mean_diff")}, {r("t_stat")},
      {r("CASE WHEN t_stat IS NOT NULL THEN 2 * " + t_tail("t_stat", "n - 1") + " END", "p_t")}, wins, {r(sign_p("wins", "n"), "p_sign")} FROM traj_t""",
)
def g20(spark, sf):
    return stats.trajectory_tests(_diffs(spark, sf), FOLDS, HORIZON)


LEADS = """lead_m AS (SELECT series_id, model_a, model_b, lead, avg(d) AS m, avg(abs(d)) AS size FROM diffs GROUP BY ALL),
lead_d AS (SELECT series_id, model_a, model_b, lead, CASE WHEN size = 0 THEN 0.0 ELSE
    round(m * pow(10.0, 12 - ceil(log10(CASE WHEN size > 0 THEN size END)))) / pow(10.0, 12 - ceil(log10(CASE WHEN size > 0 THEN size END))) END AS d FROM lead_m),
lead_c AS (SELECT model_a, model_b, lead, avg(d) AS mean_diff, count_if(d < 0) AS n_favouring_a, count_if(d > 0) AS n_favouring_b FROM lead_d GROUP BY ALL)"""


@reg.add(
    "g21_lead_tests",
    f"""WITH {PREDS}, {LOSSES}, {LEADS}, {signed_rank_sql("lead_d", "model_a, model_b, lead", "d")}
    SELECT model_a, model_b, lead, {r("c.mean_diff", "mean_diff")}, n_favouring_a, n_favouring_b, n, n_zero, {r("w_plus")}, {r("w_minus")},
      n_used, {r("tie_sum")}, {r("t_stat")}, {r("p_wilcoxon")} FROM lead_c c JOIN sr USING (model_a, model_b, lead)""",
)
def g21(spark, sf):
    return stats.lead_tests(_diffs(spark, sf))


@reg.add(
    "g22_verdict_agreement",
    f"""WITH {DM}, {MBB}
    SELECT t.model_a, t.model_b, count(*) AS n,
      count_if(coalesce(p_value < 0.05, false) = coalesce(ci_lo > 0 OR ci_hi < 0, false)) AS n_agree,
      count_if(coalesce(p_value < 0.05, false) AND NOT coalesce(ci_lo > 0 OR ci_hi < 0, false)) AS only_first,
      count_if(NOT coalesce(p_value < 0.05, false) AND coalesce(ci_lo > 0 OR ci_hi < 0, false)) AS only_second
    FROM tests t JOIN mbb m USING (series_id, model_a, model_b) GROUP BY ALL""",
)
def g22(spark, sf):
    p = settled(predictions(spark, sf), "preds")
    dm = stats.paired_summary(p, MODELS, HORIZON).select(*stats.PAIR, F.col("significant").alias("dm_sig"))
    wide = stats.losses_wide(p, MODELS)
    mbb = stats.block_bootstrap(stats.pair_differences(wide, PAIRS), BLOCK, draws=BLOCK_DRAWS)
    j = dm.join(mbb.select(*stats.PAIR, F.col("significant").alias("mbb_sig")), list(stats.PAIR))
    return stats.agreement(j, ["model_a", "model_b"], "dm_sig", "mbb_sig")


@reg.add(
    "g22_sign_consistency",
    f"""WITH {PREDS}, {LOSSES}, {LEADS} SELECT model_a, model_b, count(*) AS n_leads, count_if(mean_diff < 0) AS n_negative,
      count_if(mean_diff > 0) AS n_positive FROM lead_c GROUP BY model_a, model_b""",
)
def g22_signs(spark, sf):
    d = _diffs(spark, sf).groupBy("model_a", "model_b", "series_id", "lead").agg(F.avg("d").alias("d"))
    means = d.groupBy("model_a", "model_b", "lead").agg(F.avg("d").alias("mean_diff"))
    return stats.sign_consistency(means, ["model_a", "model_b"])


@reg.add(
    "g23_family_outcome",
    f"""WITH {DM} SELECT series_id, count(*) AS n_tests, count_if(p_value < 0.3) AS n_true,
      CASE WHEN bool_and(coalesce(p_value < 0.3, false)) THEN 'all' WHEN NOT bool_or(coalesce(p_value < 0.3, false)) THEN 'none' ELSE 'mixed' END AS outcome
    FROM tests GROUP BY series_id""",
)
def g23(spark, sf):
    t = _tests(spark, sf).withColumn("flag", F.coalesce(F.col("p_value") < 0.3, F.lit(False)))
    return stats.classify_family(t, ["series_id"], "flag")


@reg.add(
    "g24_stratified_contrasts",
    f"""WITH {PAIRED}, st AS (SELECT unnest(list_filter(['all', CASE WHEN tier = 'rich' THEN 'rich' END, CASE WHEN acctbal > 0 THEN 'positive' END],
        lambda x: x IS NOT NULL)) AS stratum, a, b, d FROM paired WHERE d IS NOT NULL)
    SELECT stratum, count(*) AS n, {r("avg(a)", "mean_a")}, {r("avg(b)", "mean_b")}, {r("avg(d)", "mean_diff")}, {r("median(d)", "median_diff")},
      count_if(d > 0) AS n_b_better, count(*) < 8 AS underpowered, {r("count(*) / CAST((SELECT count(*) FROM paired) AS DOUBLE)", "share_of_panel")}
    FROM st GROUP BY stratum""",
)
def g24(spark, sf):
    out = stats.stratified_contrasts(
        _paired(spark, sf),
        {"all": F.lit(True), "rich": F.col("tier") == "rich", "positive": F.col("acctbal") > 0},
        "seasonal_naive",
        "seasonal_mean",
    )
    return out.drop("t_stat", "p_wilcoxon")


@reg.add(
    "g24_stratified_tests",
    f"""WITH RECURSIVE {PAIRED}, st AS (SELECT unnest(list_filter(['all', CASE WHEN tier = 'rich' THEN 'rich' END, CASE WHEN tier = 'scarce' THEN 'scarce' END],
        lambda x: x IS NOT NULL)) AS stratum, a, b, d FROM paired WHERE d IS NOT NULL), {signed_rank_exact_sql("st", "stratum", "d")},
    g AS (SELECT stratum, count(*) AS n, avg(a) AS mean_a, avg(b) AS mean_b, avg(d) AS mean_diff, median(d) AS median_diff, count_if(d > 0) AS n_b_better,
      count(*) / CAST((SELECT count(*) FROM paired) AS DOUBLE) AS share_of_panel FROM st GROUP BY stratum)
    SELECT g.stratum, g.n, {r("mean_a")}, {r("mean_b")}, {r("mean_diff")}, {r("median_diff")}, n_b_better, g.n < 8 AS underpowered, {r("share_of_panel")},
      {r("CASE WHEN g.n >= 3 THEN t_stat END", "t_stat")}, {r("CASE WHEN g.n >= 3 THEN p_wilcoxon END", "p_wilcoxon")}
    FROM g LEFT JOIN srx ON srx.stratum = g.stratum""",
)
def g24_tests(spark, sf):
    """With the signed-rank test per stratum (exact or approximate by size)."""
    p = _paired(spark, sf)
    strata = {"all": F.lit(True), "rich": F.col("tier") == "rich", "scarce": F.col("tier") == "scarce"}
    return stats.stratified_contrasts(p, strata, "seasonal_naive", "seasonal_mean")


@reg.add(
    "g25_foresight_ablation",
    f"""WITH {PAIRED}, x AS (SELECT 'demand' AS domain, c - b AS gain, b - a AS pf, c - a AS ca, a, b, c FROM paired WHERE a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL)
    SELECT domain, count(*) AS n, {r("avg(b)", "mean_perfect")}, {r("avg(c)", "mean_causal")}, {r("avg(a)", "mean_base")},
      {r("avg(gain)", "foresight_gain")}, count_if(pf < 0) AS perfect_wins, count_if(ca < 0) AS causal_wins FROM x GROUP BY domain""",
)
def g25(spark, sf):
    """seasonal_mean stands for perfect, last_value for causal covariates."""
    p = _paired(spark, sf).withColumn("domain", F.lit("demand"))
    out = stats.foresight_ablation(p, ["domain"], "seasonal_mean", "last_value", "seasonal_naive")
    return out.drop("p_gain", "p_perfect", "p_causal", "verdict")


# Two features have a 2 x 2 closed form, so SQL follows the covariate configurations end to end.
CONFIG_SQL = f"""{SUPPLIER_PANEL},
rows AS MATERIALIZED (SELECT a.series_id, a.pos, a.n, g.lead, m.mode, a.y AS x1,
    CASE m.mode WHEN 'causal' THEN a.wx_discount WHEN 'perfect' THEN b.wx_discount ELSE 0.0 END AS x2, b.y AS target, b.ts AS target_ts
  FROM panel a CROSS JOIN (SELECT unnest([1, 2, 3, 4]) AS lead) g CROSS JOIN (SELECT unnest(['none', 'causal', 'perfect']) AS mode) m
  JOIN panel b ON b.series_id = a.series_id AND b.pos = a.pos + g.lead),
sums AS (SELECT series_id, lead, mode, fold, count(*) AS c, avg(x1) AS m1, avg(x2) AS m2, avg(target) AS my, stddev_pop(x1) AS s1,
    stddev_pop(x2) AS s2, covar_pop(x1, x2) AS c12, covar_pop(x1, target) AS c1y, covar_pop(x2, target) AS c2y
  FROM rows CROSS JOIN (SELECT unnest(range(6)) AS fold) f
  WHERE pos + lead < n - 24 + fold * 4 AND x2 IS NOT NULL GROUP BY ALL),
normed AS (SELECT *, CASE WHEN s1 > 0 THEN c ELSE 0 END + 1.0::DOUBLE AS z11, CASE WHEN s2 > 0 THEN c ELSE 0 END + 1.0::DOUBLE AS z22,
    CASE WHEN s1 > 0 AND s2 > 0 THEN c * c12 / s1 / s2 ELSE 0 END AS z12,
    CASE WHEN s1 > 0 THEN c * c1y / s1 ELSE 0 END AS r1, CASE WHEN s2 > 0 THEN c * c2y / s2 ELSE 0 END AS r2 FROM sums),
fit AS (SELECT *, CASE WHEN s1 > 0 THEN (r1 * z22 - z12 * r2) / (z11 * z22 - z12 * z12) / s1 ELSE 0 END AS b1,
    CASE WHEN s2 > 0 THEN (r2 * z11 - z12 * r1) / (z11 * z22 - z12 * z12) / s2 ELSE 0 END AS b2 FROM normed),
preds AS MATERIALIZED (SELECT f.series_id, f.mode AS model, f.fold, f.lead, r.pos + r.lead AS pos, r.target_ts AS ts, r.target AS y_true,
    f.my + f.b1 * (r.x1 - f.m1) + f.b2 * (r.x2 - f.m2) AS y_pred
  FROM fit f JOIN rows r ON r.series_id = f.series_id AND r.lead = f.lead AND r.mode = f.mode AND r.pos = r.n - 24 + f.fold * 4 - 1
  WHERE r.pos + 1 > {MIN_TRAIN})"""
CONFIGS = ("none", "causal", "perfect")


def _config_rows(p):
    """Every origin and lead once per configuration: without the covariate, with its value at the origin and at the target."""
    d = features.design(p, range(1, HORIZON + 1), ["wx_discount"], "both", lags=(0,), rolls=(), cal=False)
    # a feature without spread has no effect
    values = zip(CONFIGS, (F.lit(0.0), F.col("cov0_wx_discount"), F.col("fut_wx_discount")), strict=True)
    d = d.select("*", F.inline(F.array(*[F.struct(F.lit(c).alias("model"), v.alias("x_discount")) for c, v in values])))
    return d.drop("cov0_wx_discount", "fut_wx_discount")


def _config_predictions(p):
    """The same direct ridge in every configuration; one pass over the panel serves all, the origins need its tail only."""
    leads = range(1, HORIZON + 1)
    wide = features.wide_design(p, leads, ["wx_discount"], lags=(0,), rolls=()).withColumn("_zero", F.lit(0.0))
    variants = {c: ["ylag_0", x] for c, x in zip(CONFIGS, ("_zero", "cov0_wx_discount", "fut_wx_discount_{lead}"), strict=True)}
    sums = b.moments_by_lead(wide, variants, leads, HORIZON, FOLDS, "model")
    tail = _config_rows(b.recent_rows(p, HORIZON, FOLDS, 1))
    return b.ridge_forecasts(tail, sums, ["ylag_0", "x_discount"], HORIZON, FOLDS, MIN_TRAIN, 1.0, F.col("model"))


@reg.add(
    "e4_covariate_configs",
    f"""WITH {CONFIG_SQL} SELECT series_id, model, fold, lead, pos, {t("ts")}, {r("y_true")}, {r("y_pred")} FROM preds""",
)
def e4_configs(spark, sf):
    return _config_predictions(panel(spark, sf))


@reg.add(
    "g25_foresight_configs",
    f"""WITH {CONFIG_SQL}, {scale_cte(HORIZON, FOLDS, MIN_TRAIN, SEASON)}, {SCORES},
    wide AS MATERIALIZED (SELECT 'demand' AS domain, series_id, avg(MASE) FILTER (model = 'none') AS a,
        avg(MASE) FILTER (model = 'perfect') AS b, avg(MASE) FILTER (model = 'causal') AS c FROM scores GROUP BY series_id),
    x AS MATERIALIZED (SELECT domain, a, b, c FROM wide WHERE a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL),
    tests AS (SELECT domain, 'gain' AS test, c - b AS d FROM x UNION ALL SELECT domain, 'perfect', b - a FROM x UNION ALL SELECT domain, 'causal', c - a FROM x),
    {signed_rank_sql("tests", "domain, test", "d")},
    p AS (SELECT domain, max(p_wilcoxon) FILTER (test = 'gain') AS p_gain, max(p_wilcoxon) FILTER (test = 'perfect') AS p_perfect,
        max(p_wilcoxon) FILTER (test = 'causal') AS p_causal FROM sr GROUP BY domain),
    g AS (SELECT domain, count(*) AS n, avg(b) AS mean_perfect, avg(c) AS mean_causal, avg(a) AS mean_base, avg(c - b) AS foresight_gain,
        count_if(b - a < 0) AS perfect_wins, count_if(c - a < 0) AS causal_wins FROM x GROUP BY domain)
    SELECT domain, n, {r("mean_perfect")}, {r("mean_causal")}, {r("mean_base")}, {r("foresight_gain")}, perfect_wins, causal_wins,
      {r("p_gain")}, {r("p_perfect")}, {r("p_causal")},
      CASE WHEN p_perfect < 0.05 AND p_causal >= 0.05 THEN 'depends on foresight' WHEN p_causal < 0.05 THEN 'robust to causal covariates'
        ELSE 'no significant lead' END AS verdict
    FROM g JOIN p USING (domain)""",
)
def g25_configs(spark, sf):
    """Backtest by covariate configuration, scored on one scale, tested across series."""
    p = panel(spark, sf)
    s = scored(p, settled(_config_predictions(p), "configs"))
    wide = settled(decide.wide_scores(s, list(CONFIGS)).withColumn("domain", F.lit("demand")), "wide")
    return stats.foresight_ablation(wide, ["domain"], "perfect", "causal", "none")
