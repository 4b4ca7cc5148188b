"""Queries of the join family."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelkit.operators import joins as j
from panelkit.operators import backtest, decide
from panelkit.registry.common import (
    DAILY_PANEL,
    PREDS,
    SCORED,
    SUPPLIER_PANEL,
    TIERS,
    WIDE,
    MODELS,
    Registry,
    d,
    predictions,
    r,
    scores,
    supplier_tiers,
    t,
)
from panelkit.session import settled
from panelkit.sources import panels

reg = Registry()
QUERIES, ORACLES = reg.queries, reg.oracles

COVS_SQL = """covs AS (SELECT date_trunc('day', l_shipdate)::TIMESTAMP AS ts, avg(l_discount) AS wx_discount,
    sum(CASE WHEN l_discount >= 0.1 THEN l_quantity END) AS wx_qty FROM lineitem GROUP BY ALL)"""


def _covs(spark, sf):
    """Daily covariates; the quantity at the deepest discounts is missing on many days."""
    li = panels.table(spark, sf, "lineitem")
    return li.groupBy(F.to_date("l_shipdate").cast("timestamp").alias("ts")).agg(
        F.avg("l_discount").alias("wx_discount"),
        F.sum(F.when(F.col("l_discount") >= 0.1, F.col("l_quantity"))).alias("wx_qty"),
    )


@reg.add(
    "c1_covariate_join",
    f"""WITH {DAILY_PANEL}, {COVS_SQL} SELECT p.series_id, {t("p.ts", "ts")}, pos, {r("y")}, {r("wx_discount")}, {r("wx_qty")}
    FROM panel p LEFT JOIN covs c ON c.ts = p.ts""",
)
def c1(spark, sf):
    out = j.attach_covariates(panels.daily_orders(spark, sf), _covs(spark, sf), ["ts"])
    return out.drop("n")


@reg.add(
    "c2_covariates_filled",
    f"""WITH {DAILY_PANEL}, {COVS_SQL},
    jn AS (SELECT p.series_id, p.pos AS k, c.wx_qty AS y FROM panel p LEFT JOIN covs c ON c.ts = p.ts),
    near AS (SELECT *, last_value(CASE WHEN y IS NOT NULL THEN k END IGNORE NULLS) OVER b AS pk, last_value(y IGNORE NULLS) OVER b AS py,
        first_value(CASE WHEN y IS NOT NULL THEN k END IGNORE NULLS) OVER f AS nk, first_value(y IGNORE NULLS) OVER f AS ny FROM jn
      WINDOW b AS (PARTITION BY series_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
             f AS (PARTITION BY series_id ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
    lim AS (SELECT series_id, k, CASE WHEN y IS NOT NULL THEN y WHEN k - pk <= 1 AND nk IS NULL THEN py
        WHEN k - pk <= 1 THEN py + (ny - py) / (nk - pk) * (k - pk) END AS y FROM near),
    done AS (SELECT series_id, k, y, last_value(y IGNORE NULLS) OVER b AS fy, first_value(y IGNORE NULLS) OVER f AS ny FROM lim
      WINDOW b AS (PARTITION BY series_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
             f AS (PARTITION BY series_id ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
    SELECT series_id, k AS pos, {r("coalesce(y, fy, ny)", "wx_qty")}, y IS NULL AND coalesce(fy, ny) IS NOT NULL AS wx_qty_is_filled FROM done""",
)
def c2(spark, sf):
    p = panels.daily_orders(spark, sf)
    c = _covs(spark, sf).drop("wx_discount")
    out = j.attach_covariates_filled(p, c, ["wx_qty"], 1, strict=False, keys=["ts"])
    return out.select("series_id", "pos", "wx_qty", "wx_qty_is_filled")


@reg.add(
    "c3_dim_lookup",
    """SELECT s_suppkey, s_name, CASE WHEN n_regionkey IN (0, 1) THEN n_name ELSE '?' END AS n_name
    FROM supplier JOIN nation ON n_nationkey = s_nationkey""",
)
def c3(spark, sf):
    """Nations outside two regions are absent from the dimension."""
    dim = panels.table(spark, sf, "nation").filter("n_regionkey in (0, 1)")
    dim = dim.withColumnRenamed("n_nationkey", "s_nationkey")
    s = panels.table(spark, sf, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    return j.lookup(s, dim, "s_nationkey", "n_name").drop("s_nationkey")


@reg.add(
    "c4_left_merge_keys",
    f"""SELECT c_custkey, c_name, count(o_orderkey) AS n_orders, {r("coalesce(sum(o_totalprice), 0)", "spent")}
    FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_name""",
)
def c4(spark, sf):
    """Orders are reduced per customer before the join."""
    o = panels.table(spark, sf, "orders").groupBy("o_custkey").agg(
        F.count("o_orderkey").alias("n_orders"), F.sum("o_totalprice").alias("spent")
    )
    c = panels.table(spark, sf, "customer").select("c_custkey", "c_name")
    m = c.join(o, F.col("c_custkey") == F.col("o_custkey"), "left").drop("o_custkey")
    return m.fillna({"n_orders": 0, "spent": 0.0})


@reg.add(
    "c5_side_by_side",
    f"""WITH {SCORED} SELECT a.series_id, {r("a.MASE", "MASE_a")}, {r("a.RMSE", "RMSE_a")}, {r("b.MASE", "MASE_b")}, {r("b.RMSE", "RMSE_b")}
    FROM scores a JOIN scores b ON a.series_id = b.series_id WHERE a.model = 'seasonal_naive' AND b.model = 'last_value'""",
)
def c5(spark, sf):
    s = settled(scores(spark, sf).select("series_id", "model", "MASE", "RMSE"), "scores")
    a = s.filter("model = 'seasonal_naive'").drop("model")
    return j.side_by_side(a, s.filter("model = 'last_value'").drop("model"), ["series_id"])


@reg.add(
    "c6_aligned_complete",
    f"""WITH {SCORED}, {WIDE} SELECT series_id, {r("seasonal_naive")}, {r("seasonal_mean")}, {r("last_value")} FROM wide
    WHERE seasonal_naive IS NOT NULL AND seasonal_mean IS NOT NULL AND last_value IS NOT NULL""",
)
def c6(spark, sf):
    """Multi-way alignment as one conditional aggregate."""
    return decide.wide_scores(scores(spark, sf), MODELS).dropna()


@reg.add(
    "c7_index_intersection",
    f"""WITH {SCORED}, {TIERS} SELECT s.series_id FROM (SELECT DISTINCT series_id FROM scores WHERE MASE < 0.9) s
    JOIN tiers t ON t.series_id = s.series_id WHERE tier = 'rich'""",
)
def c7(spark, sf):
    a = scores(spark, sf).filter("MASE < 0.9").select("series_id").distinct()
    b = supplier_tiers(spark, sf).filter("tier = 'rich'").select("series_id")
    return j.aligned([a, b], ["series_id"])


@reg.add(
    "c8_quality_join",
    f"""WITH {SCORED}, {WIDE}, {TIERS} SELECT w.series_id, {r("acctbal")}, {r("seasonal_naive - seasonal_mean", "advantage")}
    FROM wide w JOIN tiers t ON t.series_id = w.series_id WHERE acctbal IS NOT NULL AND seasonal_naive - seasonal_mean IS NOT NULL""",
)
def c8(spark, sf):
    w = decide.wide_scores(scores(spark, sf), MODELS)
    out = j.aligned([decide.advantage(w, "seasonal_naive", "seasonal_mean"), supplier_tiers(spark, sf)], ["series_id"])
    return out.select("series_id", "acctbal", "advantage").dropna()


@reg.add(
    "c9_model_pairs",
    f"""WITH {PREDS}, l AS (SELECT series_id, pos, model, abs(y_true - y_pred) AS e,
      list_position(['seasonal_naive', 'seasonal_mean', 'last_value'], model) AS o FROM preds)
    SELECT a.series_id, a.model AS model_a, b.model AS model_b, {r("avg(a.e - b.e)", "mean_loss_diff")}, count(*) AS n
    FROM l a JOIN l b ON a.series_id = b.series_id AND a.pos = b.pos AND a.o < b.o GROUP BY ALL""",
)
def c9(spark, sf):
    from panelkit.operators import stats

    wide = stats.losses_wide(predictions(spark, sf), MODELS)
    diffs = stats.pair_differences(wide, stats.model_pairs(MODELS))
    return diffs.groupBy(*stats.PAIR).agg(F.avg("d").alias("mean_loss_diff"), F.count(F.lit(1)).alias("n"))


MERGE_SQL = f"""{PREDS}, kept AS MATERIALIZED (SELECT * FROM preds),
truths AS MATERIALIZED (SELECT series_id, pos, max(y_true) FILTER (model = 'seasonal_naive') AS main,
    max(y_true + CASE WHEN series_id LIKE '%7' THEN 1 ELSE 0 END) FILTER (model = 'last_value' AND series_id NOT LIKE '%3') AS other
  FROM kept GROUP BY series_id, pos),
gap AS MATERIALIZED (SELECT series_id, max(abs(main - other)) AS gap, count(other) AS c FROM truths GROUP BY series_id)"""


def _sources(spark, sf):
    """One source lacks the series ending in 3 and shifts those ending in 7."""
    p = settled(predictions(spark, sf), "preds")
    alt = p.filter((F.col("model") == "last_value") & ~F.col("series_id").endswith("3"))
    shift = F.when(F.col("series_id").endswith("7"), 1.0).otherwise(0.0)
    alt = alt.withColumn("y_true", F.col("y_true") + shift)
    return j.merge_checked(
        {"main": p, "other": alt}, {"main": ["seasonal_naive", "seasonal_mean"], "other": ["last_value"]}
    )


@reg.add(
    "c10_merge_checked",
    f"""WITH {MERGE_SQL} SELECT p.series_id, model, fold, lead, pos, {r("y_true")}, {r("y_pred")}
    FROM kept p JOIN gap g ON g.series_id = p.series_id WHERE g.c > 0 AND g.gap <= 1e-6""",
)
def c10(spark, sf):
    merged, _ = _sources(spark, sf)
    return merged.drop("source", "ts")


@reg.add(
    "c10_refused_series",
    f"""WITH {MERGE_SQL} SELECT series_id, CASE WHEN c = 0 THEN 'source missing' ELSE 'truth differs' END AS reject_reason,
      {r("coalesce(gap, 0)", "max_gap")} FROM gap WHERE c = 0 OR gap > 1e-6""",
)
def c10_refused(spark, sf):
    return _sources(spark, sf)[1]


@reg.add(
    "c11_resume",
    f"""WITH {SUPPLIER_PANEL}, todo AS (SELECT DISTINCT series_id, s AS seed FROM panel CROSS JOIN (SELECT unnest([NULL, 41, 42]::BIGINT[]) AS s)),
    done AS (SELECT 's' || s_suppkey AS series_id, CASE WHEN s_acctbal < 3000 THEN NULL ELSE 42::BIGINT END AS seed FROM supplier)
    SELECT series_id, coalesce(seed, -1) AS seed FROM todo t WHERE NOT EXISTS (SELECT 1 FROM done d WHERE d.series_id = t.series_id AND d.seed IS NOT DISTINCT FROM t.seed)""",
)
def c11(spark, sf):
    ids = panels.supplier_weeks(spark, sf).select("series_id").distinct()
    seeds = F.array(F.lit(None).cast("long"), F.lit(41).cast("long"), F.lit(42).cast("long"))
    todo = ids.withColumn("seed", F.explode(seeds))
    done = supplier_tiers(spark, sf).select(
        "series_id", F.when(F.col("acctbal") >= 3000, F.lit(42).cast("long")).alias("seed")
    )
    return j.remaining(todo, done, ["series_id", "seed"]).select(
        "series_id", F.coalesce("seed", F.lit(-1)).alias("seed")
    )


@reg.add(
    "c12_era_overlap",
    f"""WITH w AS (SELECT l_suppkey, l_returnflag, CAST(min(l_shipdate) AS DATE) AS s, CAST(max(l_shipdate) AS DATE) AS e FROM lineitem GROUP BY ALL),
    o AS (SELECT *, greatest(date_diff('day', greatest(s, DATE '1999-06-01'), least(e, DATE '2001-05-31')), 0) AS od, date_diff('day', s, e) AS sd FROM w)
    SELECT l_suppkey, l_returnflag, {d("s", '"start"')}, {d("e", '"end"')}, od AS overlap_days, sd AS span_days,
      {r("CASE WHEN sd > 0 THEN od / CAST(sd AS DOUBLE) END", "overlap_frac")} FROM o""",
)
def c12(spark, sf):
    w = panels.table(spark, sf, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(
        F.to_date(F.min("l_shipdate")).alias("start"), F.to_date(F.max("l_shipdate")).alias("end")
    )
    return j.era_overlap(w, "1999-06-01", "2001-05-31")


@reg.add(
    "c13_parameter_grid",
    f"""SELECT o_orderpriority, {r("price")}, {r("pue")}, {r("wtp")}, {r("avg(o_totalprice) * price / 0.15 * pue / 1.4 * wtp", "weighted")}
    FROM orders CROSS JOIN (SELECT unnest([0.05, 0.15]::DOUBLE[]) AS price) CROSS JOIN (SELECT unnest([1.1, 1.4]::DOUBLE[]) AS pue)
    CROSS JOIN (SELECT unnest([0.0, 1.0, 2.0]::DOUBLE[]) AS wtp) GROUP BY o_orderpriority, orders.o_orderpriority, price, pue, wtp""",
)
def c13(spark, sf):
    m = panels.table(spark, sf, "orders").groupBy("o_orderpriority").agg(F.avg("o_totalprice").alias("m"))
    g = backtest.with_grid(m, price=[0.05, 0.15], pue=[1.1, 1.4], wtp=[0.0, 1.0, 2.0])
    weighted = F.col("m") * F.col("price") / 0.15 * F.col("pue") / 1.4 * F.col("wtp")
    return g.select("o_orderpriority", "price", "pue", "wtp", weighted.alias("weighted"))


CITED = """cited AS (SELECT DISTINCT 'L-' || x AS id FROM (
  SELECT unnest(regexp_extract_all(text, '(\\d{3})', 1)) AS x FROM documents)),
ledger AS (SELECT DISTINCT 'L-' || (100 + p_size) AS id, p_size < 10 AS superseded FROM part)"""


def _cited(spark, sf):
    """Three-digit numbers of the whole texts play the cited ids."""
    docs = panels.table(spark, sf, "documents")
    ids = F.array_distinct(F.regexp_extract_all("text", F.lit(r"(\d{3})"), 1))
    cited = docs.select(F.explode(ids).alias("_id")).select(F.concat(F.lit("L-"), "_id").alias("id"))
    p = panels.table(spark, sf, "part")
    ledger = p.select(
        F.concat(F.lit("L-"), (F.col("p_size") + 100).cast("string")).alias("id"),
        (F.col("p_size") < 10).alias("superseded"),
    ).distinct()
    return cited, ledger


@reg.add("c14_missing_ids", f"WITH {CITED} SELECT id FROM cited WHERE id NOT IN (SELECT id FROM ledger)")
def c14(spark, sf):
    cited, ledger = _cited(spark, sf)
    return j.missing_ids(cited, ledger, "id")


@reg.add("c14_cited_superseded", f"WITH {CITED} SELECT id FROM cited WHERE id IN (SELECT id FROM ledger WHERE superseded)")
def c14_sup(spark, sf):
    cited, ledger = _cited(spark, sf)
    return j.cited_superseded(cited, ledger.filter("superseded"), "id")


@reg.add(
    "c15_lag_pairs",
    f"""WITH {SUPPLIER_PANEL}, c AS (SELECT *, y - avg(y) OVER (PARTITION BY series_id) AS c FROM panel)
    SELECT a.series_id, g.k, count(*) AS n_pairs, {r("avg(a.c * b.c)", "autocov")}
    FROM c a CROSS JOIN (SELECT unnest([1, 2, 4, 13]) AS k) g JOIN c b ON b.series_id = a.series_id AND b.pos = a.pos - g.k GROUP BY ALL""",
)
def c15(spark, sf):
    """Lag-k self pairing from one bounded look-back, sums centred afterwards."""
    from panelkit.plans.ordered import over_rows

    ks = [1, 2, 4, 13]
    p = settled(panels.supplier_panel(spark, sf), "panel")
    rows = over_rows(
        p, ["series_id"], lambda w: {"_l": F.array(*[F.lag("y", k).over(w) for k in ks])}, before=max(ks)
    )
    rows = rows.select("series_id", "y", F.posexplode("_l").alias("_i", "_y"))
    mean = rows.filter("_i = 0").groupBy("series_id").agg(F.avg("y").alias("_m"))
    s = rows.filter(F.col("_y").isNotNull()).groupBy("series_id", "_i").agg(
        F.count(F.lit(1)).alias("n_pairs"),
        F.sum(F.col("y") * F.col("_y")).alias("_s"),
        F.sum(F.col("y") + F.col("_y")).alias("_t"),
    )
    cov = (F.col("_s") - F.col("_m") * F.col("_t")) / F.col("n_pairs") + F.col("_m") * F.col("_m")
    k = F.get(F.array(*[F.lit(v) for v in ks]), F.col("_i"))
    return s.join(mean, "series_id").select("series_id", k.alias("k"), "n_pairs", cov.alias("autocov"))
