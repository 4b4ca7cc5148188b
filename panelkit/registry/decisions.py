"""Queries of the decision family and of set, sort and top-k operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelkit.operators import decide, report
from panelkit.registry.common import (
    MODELS,
    SCORED,
    TIERS,
    WIDE,
    Registry,
    r,
    scores,
    supplier_tiers,
)
from panelkit.sources import panels

reg = Registry()
QUERIES, ORACLES = reg.queries, reg.oracles

WTPS = (0.0, 0.1, 0.5, 1.0)
# Score-like rows: metric and cost per priority (regime), return flag (model).
RUNS_SQL = """runs AS (SELECT o_orderpriority AS regime, l_returnflag || l_linestatus AS model, l_linenumber AS seed,
    avg(l_discount) AS MASE, avg(l_tax) AS usd_per_1k
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL)"""
MEANS_SQL = f"""{RUNS_SQL},
means AS (SELECT regime, model, avg(MASE) AS m, avg(usd_per_1k) AS c FROM runs GROUP BY regime, model),
obj AS (SELECT *, m + wtp * c AS o FROM means CROSS JOIN (SELECT unnest({list(WTPS)}::DOUBLE[]) AS wtp)),
winners AS (SELECT regime, wtp, model AS winner, o AS objective FROM obj
  QUALIFY row_number() OVER (PARTITION BY regime, wtp ORDER BY o, model) = 1)"""


def _runs(spark, sf):
    li = panels.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_returnflag", "l_linestatus", "l_linenumber", "l_discount", "l_tax"
    )
    o = panels.table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    j = li.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    return j.groupBy(
        F.col("o_orderpriority").alias("regime"),
        F.concat("l_returnflag", "l_linestatus").alias("model"),
        F.col("l_linenumber").alias("seed"),
    ).agg(F.avg("l_discount").alias("MASE"), F.avg("l_tax").alias("usd_per_1k"))


@reg.add("h1_penalised_winner", f"WITH {MEANS_SQL} SELECT regime, {r('wtp')}, winner, {r('objective')} FROM winners")
def h1(spark, sf):
    return decide.penalised_winner(_runs(spark, sf), ["regime"], WTPS)


@reg.add(
    "h2_decision_table",
    f"""WITH {MEANS_SQL} SELECT regime, max(winner) FILTER (wtp = 0) AS wtp_0, max(winner) FILTER (wtp = 0.1::DOUBLE) AS wtp_0p1,
      max(winner) FILTER (wtp = 0.5) AS wtp_0p5, max(winner) FILTER (wtp = 1) AS wtp_1 FROM winners GROUP BY regime""",
)
def h2(spark, sf):
    w = decide.penalised_winner(_runs(spark, sf), ["regime"], WTPS)
    return decide.decision_table(w, ["regime"], WTPS)


@reg.add(
    "h3_cost_sensitivity",
    f"""WITH {RUNS_SQL},
    means AS (SELECT regime, model, avg(MASE) AS m, avg(usd_per_1k) AS c FROM runs GROUP BY regime, model),
    grid AS (SELECT *, (price / 0.15::DOUBLE) * (pue / 1.4::DOUBLE) AS f FROM means
      CROSS JOIN (SELECT unnest({list(WTPS)}::DOUBLE[]) AS wtp) CROSS JOIN (SELECT unnest([0.05, 0.15, 0.4]::DOUBLE[]) AS price)
      CROSS JOIN (SELECT unnest([1.1, 1.4, 2.0]::DOUBLE[]) AS pue)),
    cells AS (SELECT regime, wtp, price, pue, f, arg_min(model, (m + wtp * c, model)) AS base, arg_min(model, (m + wtp * c * f, model)) AS alt
      FROM grid GROUP BY ALL)
    SELECT {r("price")}, {r("pue")}, count(*) AS cells, count_if(base <> alt) AS flipped, {r("any_value(f)", "wtp_multiplier")},
      {r("count_if(base <> alt) / CAST(count(*) AS DOUBLE)", "flip_rate")} FROM cells GROUP BY cells.price, cells.pue""",
)
def h3(spark, sf):
    return decide.cost_sensitivity(_runs(spark, sf), ["regime"], WTPS, (0.05, 0.15, 0.4), (1.1, 1.4, 2.0))


@reg.add("h4_winner_counts", f"WITH {MEANS_SQL} SELECT winner, count(*) AS n_cells FROM winners GROUP BY winner")
def h4(spark, sf):
    return decide.winner_counts(decide.penalised_winner(_runs(spark, sf), ["regime"], WTPS))


@reg.add(
    "h5_win_rates",
    f"""WITH {SCORED}, {WIDE}, {TIERS}, j AS (SELECT w.*, t.tier FROM wide w JOIN tiers t ON t.series_id = w.series_id)
    SELECT coalesce(tier, 'overall') AS tier, count(*) AS n_series, {r("avg(CASE WHEN seasonal_mean < seasonal_naive THEN 1.0 ELSE 0.0 END)", "win_rate")}
    FROM j GROUP BY GROUPING SETS ((), (tier))""",
)
def h5(spark, sf):
    w = decide.wide_scores(scores(spark, sf), MODELS).join(supplier_tiers(spark, sf), "series_id")
    return decide.win_rates_overall_and_by(w, "seasonal_mean", "seasonal_naive", "tier")


@reg.add(
    "h6_advantage",
    f"WITH {SCORED}, {WIDE} SELECT series_id, {r('seasonal_naive - seasonal_mean', 'advantage')} FROM wide",
)
def h6(spark, sf):
    w = decide.wide_scores(scores(spark, sf), MODELS)
    return decide.advantage(w, "seasonal_naive", "seasonal_mean")


@reg.add(
    "h6_top_advantage",
    f"""WITH {SCORED}, {WIDE} SELECT series_id, {r('seasonal_naive - seasonal_mean', 'advantage')} FROM wide
    ORDER BY round(seasonal_naive - seasonal_mean, 9) DESC, series_id LIMIT 10""",
)
def h6_top(spark, sf):
    w = decide.wide_scores(scores(spark, sf), MODELS)
    a = decide.advantage(w, "seasonal_naive", "seasonal_mean")
    return report.top_rows(a.withColumn("advantage", F.round("advantage", 9)), "advantage", 10)


# --- sets, sort, top-k ------------------------------------------------------


@reg.add(
    "k_union_all",
    f"""SELECT 'line' AS part, l_orderkey, {r("l_quantity", "v")} FROM lineitem
    UNION ALL SELECT 'order', o_orderkey, {r("o_totalprice", "v")} FROM orders""",
)
def k_union(spark, sf):
    a = panels.table(spark, sf, "lineitem")
    a = a.select(F.lit("line").alias("part"), "l_orderkey", F.col("l_quantity").alias("v"))
    o = panels.table(spark, sf, "orders")
    o = o.select(F.lit("order").alias("part"), F.col("o_orderkey").alias("l_orderkey"), F.col("o_totalprice").alias("v"))
    return a.unionByName(o)


@reg.add(
    "k_graft_model",
    f"""WITH {RUNS_SQL} SELECT regime, model, seed, {r("MASE")}, {r("usd_per_1k")} FROM runs WHERE model <> 'AF'
    UNION ALL SELECT regime, model, seed, {r("MASE * 0.5", "MASE")}, {r("usd_per_1k")} FROM runs WHERE model = 'AF'""",
)
def k_graft(spark, sf):
    runs = _runs(spark, sf)
    return decide.graft(runs, runs.withColumn("MASE", F.col("MASE") * 0.5), "AF")


@reg.add(
    "k_except_ids",
    "SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'",
)
def k_except(spark, sf):
    """Customers without an urgent order."""
    c = panels.table(spark, sf, "customer").select("c_custkey")
    o = panels.table(spark, sf, "orders").filter("o_orderpriority = '1-URGENT'")
    return c.subtract(o.select(F.col("o_custkey").alias("c_custkey")))


@reg.add("k_intersect_ids", "SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A' INTERSECT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R'")
def k_intersect(spark, sf):
    li = panels.table(spark, sf, "lineitem")
    a = li.filter("l_returnflag = 'A'").select("l_partkey")
    return a.intersect(li.filter("l_returnflag = 'R'").select("l_partkey"))


@reg.add(
    "k_distinct_counts",
    """SELECT l_returnflag, count(DISTINCT l_suppkey) AS n_suppliers, count(DISTINCT l_partkey) AS n_parts FROM lineitem GROUP BY l_returnflag""",
)
def k_distinct(spark, sf):
    li = panels.table(spark, sf, "lineitem")
    return li.groupBy("l_returnflag").agg(
        F.countDistinct("l_suppkey").alias("n_suppliers"), F.countDistinct("l_partkey").alias("n_parts")
    )


@reg.add(
    "k_mixed_sort",
    f"""SELECT o_orderpriority, o_orderstatus, count(*) AS n, {r("avg(o_totalprice)", "mean_price")} FROM orders GROUP BY ALL""",
)
def k_sort(spark, sf):
    o = panels.table(spark, sf, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(
        F.count(F.lit(1)).alias("n"), F.avg("o_totalprice").alias("mean_price")
    )
    order = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    return report.ordered_by_list(o, "o_orderpriority", order, "o_orderstatus")


@reg.add(
    "k_top_k_per_group",
    f"""SELECT l_suppkey, l_orderkey, l_linenumber, {r("l_extendedprice")} FROM lineitem
    QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) <= 3""",
)
def k_top(spark, sf):
    """Top 3 per supplier; Spark trims each group before the shuffle."""
    from pyspark.sql import Window

    w = Window.partitionBy("l_suppkey").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber")
    li = panels.table(spark, sf, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice")
    return li.withColumn("_rn", F.row_number().over(w)).filter("_rn <= 3").drop("_rn")


@reg.add(
    "k_pivot",
    f"""SELECT l_suppkey, {r("avg(l_quantity) FILTER (l_returnflag = 'A')", "qty_A")}, {r("avg(l_quantity) FILTER (l_returnflag = 'N')", "qty_N")},
      {r("avg(l_quantity) FILTER (l_returnflag = 'R')", "qty_R")} FROM lineitem GROUP BY l_suppkey""",
)
def k_pivot(spark, sf):
    li = panels.table(spark, sf, "lineitem")
    return report.pivoted(li, ["l_suppkey"], "l_returnflag", ["A", "N", "R"], {"qty": F.col("l_quantity")})


@reg.add(
    "k_grouping_sets",
    f"""SELECT coalesce(l_returnflag, 'overall') AS l_returnflag, l_linenumber IS NULL AS all_lines, coalesce(l_linenumber, 0) AS l_linenumber,
      count(*) AS n, {r("avg(l_tax)", "mean_tax")} FROM lineitem GROUP BY GROUPING SETS ((), (l_returnflag), (l_returnflag, l_linenumber))""",
)
def k_sets(spark, sf):
    g = panels.table(spark, sf, "lineitem").rollup("l_returnflag", "l_linenumber").agg(
        F.count(F.lit(1)).alias("n"), F.avg("l_tax").alias("mean_tax")
    )
    return g.select(
        F.coalesce("l_returnflag", F.lit("overall")).alias("l_returnflag"),
        F.col("l_linenumber").isNull().alias("all_lines"),
        F.coalesce("l_linenumber", F.lit(0)).alias("l_linenumber"),
        "n",
        "mean_tax",
    )


@reg.add(
    "l_scalar_functions",
    f"""SELECT p_partkey, lower(replace(p_name, ' ', '_')) AS slug, upper(p_type) AS kind,
      CAST(regexp_extract(p_brand, '#(\\d+)', 1) AS BIGINT) AS brand_no, p_name LIKE '%ring' AS is_ring,
      {r("abs(p_retailprice - 900)", "dist")}, {r("sqrt(p_retailprice)", "root")}, {r("((p_size - 25) % 7 + 7) % 7", "size_mod")},
      {r("greatest(least(p_retailprice, 1000), 905)", "clipped")}, CAST(sign(p_size - 25) AS BIGINT) AS side,
      CAST(ceil(p_retailprice / 7) AS BIGINT) AS up, CAST(floor(p_retailprice / 7) AS BIGINT) AS down FROM part""",
)
def l_scalars(spark, sf):
    p = panels.table(spark, sf, "part")
    size, price = F.col("p_size"), F.col("p_retailprice")
    return p.select(
        "p_partkey",
        F.lower(F.replace("p_name", F.lit(" "), F.lit("_"))).alias("slug"),
        F.upper("p_type").alias("kind"),
        F.regexp_extract("p_brand", r"#(\d+)", 1).cast("long").alias("brand_no"),
        F.col("p_name").endswith("ring").alias("is_ring"),
        F.abs(price - 900).alias("dist"),
        F.sqrt(price).alias("root"),
        F.pmod(size - 25, F.lit(7)).cast("double").alias("size_mod"),
        F.greatest(F.least(price, F.lit(1000.0)), F.lit(905.0)).alias("clipped"),
        F.signum(size - 25).cast("long").alias("side"),
        F.ceil(price / 7).alias("up"),
        F.floor(price / 7).alias("down"),
    )
