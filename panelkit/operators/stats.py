"""Paired comparison statistics over predictions and scores.

Everything is reduced to one row per test in Spark; only the final tail
probability runs in Python, on those rows.  Predictions of one (series, model)
number at most folds * horizon; where arrays are built from them that product
bounds their length.  Families over series have no bound and use the exact
distributed ranks of ``panelkit.plans.ordered``.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelkit.functions import tails
from panelkit.functions.columns import significant
from panelkit.operators import resample
from panelkit.operators.resample import POISSON as POISSON
from panelkit.plans.ordered import (
    group_quantiles,
    ranked_values,
    running_extreme,
)

ALPHA = 0.05


# --- aligned losses ---------------------------------------------------------


def seed_ensemble(preds: DataFrame) -> DataFrame:
    """Mean prediction over seed replicates at each position."""
    return preds.groupBy("series_id", "model", "fold", "lead", "pos").agg(
        F.first("y_true").alias("y_true"), F.avg("y_pred").alias("y_pred")
    )


def losses_wide(preds: DataFrame, models: Sequence[str], loss: str = "ae") -> DataFrame:
    """One row per (series, position) with a loss column per model.

    Replaces the model self-join: a single aggregate aligns any number of
    models.  Positions missing a model drop out.
    """
    e = F.abs(F.col("y_true") - F.col("y_pred"))
    value = e if loss == "ae" else e * e
    wide = preds.filter(F.col("model").isin(list(models)))
    wide = wide.groupBy("series_id", "fold", "lead", "pos").agg(
        *[F.max(F.when(F.col("model") == m, value)).alias(f"loss_{m}") for m in models]
    )
    return wide.dropna(subset=[f"loss_{m}" for m in models])


def model_pairs(models: Sequence[str]) -> list[tuple[str, str]]:
    return list(combinations(models, 2))


def pair_differences(wide: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Loss differences d = loss_a - loss_b, one row per named model pair."""
    items = [
        F.struct(
            F.lit(a).alias("model_a"),
            F.lit(b).alias("model_b"),
            (F.col(f"loss_{a}") - F.col(f"loss_{b}")).alias("d"),
        )
        for a, b in pairs
    ]
    return wide.select("series_id", "fold", "lead", "pos", F.inline(F.array(*items)))


PAIR = ["series_id", "model_a", "model_b"]


def dm_statistics(
    preds: DataFrame,
    models: Sequence[str],
    h: int,
    loss: str = "ae",
    pairs: Sequence[tuple[str, str]] | None = None,
) -> DataFrame:
    """Diebold-Mariano statistic per series and model pair.

    Autocovariances up to lag h - 1 average over the n - k available pairs and
    get Bartlett weights; the Harvey-Leybourne-Newbold factor corrects for
    small samples.  Lags count the rows that hold all models, so a position that
    lacks one closes up, wherever it lies.  A series has folds * horizon rows at
    most, which is what its window holds; all lags of a pair are summed in one
    aggregate, with map-side partials and no row per lag.  Differences are
    centred by their pair's mean before they are multiplied, so a mean that is
    large against the spread costs no digits.  The mean is summed by position: where
    losses cancel, its sign must not depend on the order in which rows arrive.
    """
    used = preds.filter(F.col("model").isin(list(models))).select("series_id", "model", "fold", "lead", "pos", "y_true", "y_pred")
    # a series' rows, few as they are, move once for the pivot, the window and the sums
    wide = losses_wide(used.repartition("series_id"), models, loss)
    series = Window.partitionBy("series_id")
    w = series.orderBy("pos")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    lags = range(0, max(h, 1))
    pairs = list(pairs or model_pairs(models))

    def diff(a: str, b: str) -> Column:
        return F.col(f"loss_{a}") - F.col(f"loss_{b}")

    def centred(a: str, b: str, mean: Column) -> Column:
        return F.array(*[F.col(f"_l{k}_{a}") - F.col(f"_l{k}_{b}") - mean for k in lags])

    rows = wide.select(
        "series_id",
        *[F.lag(f"loss_{m}", k).over(w).alias(f"_l{k}_{m}") for m in models for k in lags],
        *[F.avg(diff(a, b)).over(whole).alias(f"_m_{i}") for i, (a, b) in enumerate(pairs)],
    )
    items = [
        F.struct(
            F.lit(a).alias("model_a"),
            F.lit(b).alias("model_b"),
            F.col(f"_m_{i}").alias("centre"),
            F.greatest(F.abs(f"_l0_{a}"), F.abs(f"_l0_{b}")).alias("size"),
            centred(a, b, F.col(f"_m_{i}")).alias("dk"),
        )
        for i, (a, b) in enumerate(pairs)
    ]
    rows = rows.select("series_id", F.inline(F.array(*items))).withColumn("d", F.get("dk", F.lit(0)))
    sums = [F.max("centre").alias("_centre"), F.max("size").alias("_size")]
    for k in lags:
        back = F.get("dk", F.lit(k))
        sums += [
            F.count(back).alias(f"_c{k}"),
            F.sum(F.when(back.isNotNull(), F.col("d"))).alias(f"_a{k}"),
            F.sum(back).alias(f"_b{k}"),
            F.sum(F.col("d") * back).alias(f"_s{k}"),
        ]
    g = rows.groupBy(*PAIR).agg(*sums)

    def weighted(value) -> Column:
        """Sum over the lags that have pairs, with their Bartlett weights."""
        total = F.lit(0.0)
        for k in lags:
            weight = 1.0 if k == 0 else 2.0 * (1.0 - k / float(max(h, 1)))
            total = total + F.when(F.col(f"_c{k}") > 0, weight * value(k)).otherwise(0.0)
        return total

    g = g.select(
        *PAIR,
        F.col("_c0").alias("n"),
        (F.col("_a0") / F.col("_c0")).alias("_left"),
        F.col("_centre").alias("mean_loss_diff"),
        "_size",
        weighted(lambda k: F.col(f"_s{k}") / F.col(f"_c{k}")).alias("_ss"),
        weighted(lambda k: (F.col(f"_a{k}") + F.col(f"_b{k}")) / F.col(f"_c{k}")).alias("_cross"),
        weighted(lambda k: F.lit(1.0)).alias("_w"),
    )
    m, left, n = F.col("mean_loss_diff"), F.col("_left"), F.col("n").cast("double")
    var = (F.col("_ss") - left * F.col("_cross") + left * left * F.col("_w")) / n
    # what differences of rounded losses leave must not pass for variance
    enough = (n >= 10) & (var > F.lit(1e-24) * F.col("_size") * F.col("_size") / n)
    hln = F.sqrt((n + 1 - 2 * h + F.lit(h * (h - 1.0)) / n) / n)
    stat = F.when(enough, m / F.sqrt(F.when(enough, var)) * hln)
    return g.select(*PAIR, "n", "mean_loss_diff", stat.alias("dm_stat"))


def paired_summary(
    preds: DataFrame,
    models: Sequence[str],
    h: int = 24,
    loss: str = "ae",
    alpha: float = ALPHA,
    pairs: Sequence[tuple[str, str]] | None = None,
) -> DataFrame:
    """All model pairs: statistic, p, the better model (b on a tie), significance."""
    g = dm_statistics(preds, models, h, loss, pairs)
    g = g.withColumn("p_value", tails.p_t_two_sided(F.col("dm_stat"), F.col("n") - 1))
    better = F.when(F.col("mean_loss_diff") < 0, F.col("model_a")).otherwise(F.col("model_b"))
    return g.withColumns(
        {"better": better, "significant": F.coalesce(F.col("p_value") < alpha, F.lit(False))}
    )


def dm_by_seed(
    preds: DataFrame, seeded: str, seeds: Sequence[int], others: Sequence[str], h: int = 24
) -> DataFrame:
    """Each seed replicate of one model against every other model.

    The seeds become model names, so all of them go through one pass.
    """
    label = F.concat(F.lit(f"{seeded}_s"), F.col("seed").cast("string"))
    named = preds.withColumn("model", F.when(F.col("model") == seeded, label).otherwise(F.col("model")))
    replicas = [f"{seeded}_s{s}" for s in seeds]
    pairs = [(r, o) for r in replicas for o in others]
    g = paired_summary(named, [*replicas, *others], h, pairs=pairs)
    return g.withColumn("seed", F.regexp_extract("model_a", r"_s(\d+)$", 1).cast("int"))


# --- multiplicity -----------------------------------------------------------


def benjamini_hochberg(
    df: DataFrame, family: Sequence[str], p: str = "p_value", count_null: bool = True, name: str = "p_bh"
) -> DataFrame:
    """FDR-adjusted p within each family; null p stays null.

    Ties share the rank of the last of them, which is what the running minimum
    yields for every member.  ``count_null`` keeps missing tests in m.
    """
    family = list(family)
    m = df.groupBy(*family).agg(F.count(F.lit(1) if count_null else F.col(p)).alias("_m"))
    v = ranked_values(df.select(*family, p), family, p, near_zero=True).join(m, family)
    raw = F.col(p) * F.col("_m") / (F.col("before") + F.col("cnt"))
    v = running_extreme(v, family, p, raw, name, smallest=True, descending=True)
    v = v.select(*family, p, F.least(F.col(name), F.lit(1.0)).alias(name))
    return df.join(v, [*family, p], "left")


def holm(
    df: DataFrame, family: Sequence[str], p: str = "p_value", name: str = "p_holm"
) -> DataFrame:
    """Holm step-down adjustment within each family; null p stays null."""
    family = list(family)
    v = ranked_values(df.select(*family, p), family, p, near_zero=True)
    raw = F.col(p) * (F.col("total") - F.col("before"))
    v = running_extreme(v, family, p, raw, name, smallest=False, descending=False)
    v = v.select(*family, p, F.least(F.col(name), F.lit(1.0)).alias(name))
    return df.join(v, [*family, p], "left")


def panel_rollup(tests: DataFrame, alpha: float = ALPHA, block: Sequence[str] = ()) -> DataFrame:
    """Per model pair (and block): series, significant counts, wins raw and FDR, median p."""
    raw = F.coalesce(F.col("p_value") < alpha, F.lit(False))
    fdr = F.coalesce(F.col("p_bh") < alpha, F.lit(False))
    a_better = F.col("better") == F.col("model_a")
    keys = [*block, "model_a", "model_b"]
    counts = tests.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_series"),
        F.count_if(raw).alias("n_sig"),
        F.count_if(fdr).alias("n_sig_fdr"),
        F.count_if(raw & a_better).alias("a_wins"),
        F.count_if(raw & ~a_better).alias("b_wins"),
        F.count_if(fdr & a_better).alias("a_wins_fdr"),
        F.count_if(fdr & ~a_better).alias("b_wins_fdr"),
    )
    med = group_quantiles(tests, keys, "p_value", {"median_p": 0.5}, near_zero=True).drop("n")
    return counts.join(med, keys, "left")


# --- conformal --------------------------------------------------------------


def split_conformal(preds: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """Calibrate on the first half of the backtest, evaluate on the second.

    One row per (series, model): quantile, coverage and width.  The arrays hold
    folds * horizon values at most.
    """
    point = F.struct("pos", F.abs(F.col("y_true") - F.col("y_pred")).alias("e"))
    g = preds.groupBy("series_id", "model").agg(F.sort_array(F.collect_list(point)).alias("_p"))
    g = g.withColumn("_e", F.transform("_p", lambda s: s["e"]))
    n_cal = F.floor(F.size("_e") / 2).cast("int")
    g = g.withColumns({"n_cal": n_cal, "n_test": F.size("_e") - n_cal})
    g = g.filter(F.col("n_cal") > 0)
    k = F.ceil(F.round((F.col("n_cal") + 1) * F.lit(1.0 - alpha), 9)).cast("int")
    cal = F.sort_array(F.slice("_e", F.lit(1), F.col("n_cal")))
    g = g.withColumn("q", F.element_at(cal, F.least(k, F.col("n_cal"))))
    test = F.slice("_e", F.col("n_cal") + 1, F.col("n_test"))
    hits = F.size(F.filter(test, lambda x: x <= F.col("q")))
    return g.select(
        "series_id",
        "model",
        "n_cal",
        "n_test",
        "q",
        (hits / F.col("n_test")).alias("coverage"),
        (F.col("q") * 2).alias("width"),
    )


def pooled_conformal(per_series: DataFrame, keys: Sequence[str]) -> DataFrame:
    return per_series.groupBy(*keys).agg(
        F.avg("coverage").alias("mean_coverage"),
        F.avg("width").alias("mean_width"),
        F.count(F.lit(1)).alias("n_series"),
    )


# --- paired tests over series -----------------------------------------------


def sign_test(df: DataFrame, keys: Sequence[str], d: str, ties_win: bool = False) -> DataFrame:
    """Exact sign test: wins are negative differences (ties as chosen)."""
    win = F.col(d) <= 0 if ties_win else F.col(d) < 0
    g = df.filter(F.col(d).isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(win).alias("wins")
    )
    return g.withColumn("p_sign", tails.p_sign(F.col("wins"), F.col("n")))


def signed_rank(df: DataFrame, keys: Sequence[str], d: str) -> DataFrame:
    """Wilcoxon signed-rank: zeros dropped, average ranks, T = min(W+, W-)."""
    keys = list(keys)
    x = df.filter(F.col(d).isNotNull())
    zeros = x.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(d) == 0).alias("n_zero")
    )
    a = x.filter(F.col(d) != 0).select(*keys, F.abs(d).alias("_a"), (F.col(d) > 0).alias("_up"))
    up = F.when(F.col("_up"), 1).otherwise(0)
    v = ranked_values(a, keys, "_a", {"_pos": up})
    rank = F.col("before") + (F.col("cnt") + 1) / 2.0
    t = F.col("cnt").cast("double")
    g = v.groupBy(*keys).agg(
        F.sum(rank * F.col("_pos")).alias("w_plus"),
        F.sum(rank * (F.col("cnt") - F.col("_pos"))).alias("w_minus"),
        F.max("total").alias("n_used"),
        F.sum(t * t * t - t).alias("tie_sum"),
    )
    g = zeros.join(g, keys, "left").withColumn("t_stat", F.least("w_plus", "w_minus"))
    p = tails.p_signed_rank(F.col("t_stat"), F.col("n_used"), F.col("tie_sum"), F.col("n_zero"))
    return g.withColumn("p_wilcoxon", p)


def model_ranks(
    scores: DataFrame, family: Sequence[str], models: Sequence[str], value: str = "MASE"
) -> DataFrame:
    """Average ranks of the models inside each series (complete cases only).

    The window spans the models of one series, a handful of rows.
    """
    keys = [*family, "series_id"]
    s = scores.filter(F.col("model").isin(list(models)) & F.col(value).isNotNull())
    s = s.groupBy(*keys, "model").agg(F.avg(value).alias(value))
    whole = Window.partitionBy(*keys)
    by_value = whole.orderBy(value)
    same = Window.partitionBy(*keys, value)
    s = s.withColumns(
        {
            "_k": F.count(F.lit(1)).over(whole),
            "_t": F.count(F.lit(1)).over(same),
            "_r": F.rank().over(by_value),
        }
    ).filter(F.col("_k") == len(models))
    return s.withColumn("rank", F.col("_r") + (F.col("_t") - 1) / 2.0).select(
        *keys, "model", value, "rank", F.col("_t").alias("ties")
    )


def friedman(ranks: DataFrame, family: Sequence[str], k: int) -> DataFrame:
    """Friedman chi-square over k models with tie correction."""
    family = list(family)
    t = F.col("ties").cast("double")
    per_model = ranks.groupBy(*family, "model").agg(
        F.sum("rank").alias("_r"),
        F.count(F.lit(1)).alias("_n"),
        # every member of a tie group adds its share of t**3 - t
        F.sum(t * t - 1.0).alias("_ties"),
    )
    g = per_model.groupBy(*family).agg(
        F.max("_n").alias("n"),
        F.sum(F.col("_r") * F.col("_r")).alias("_rr"),
        F.sum("_ties").alias("_tt"),
    )
    n = F.col("n").cast("double")
    raw = F.lit(12.0) / (n * k * (k + 1)) * F.col("_rr") - 3.0 * n * (k + 1)
    fix = F.lit(1.0) - F.col("_tt") / (n * k * (k * k - 1))
    g = g.withColumn("chi2", F.when(fix > 0, raw / fix))
    g = g.withColumn("p_friedman", tails.p_chi2(F.col("chi2"), F.lit(k - 1)))
    return g.select(*family, "n", "chi2", "p_friedman")


def average_ranks(ranks: DataFrame, family: Sequence[str], k: int) -> DataFrame:
    """Mean rank per model and the Nemenyi critical difference."""
    factor = tails.studentised_range_q(k) / math.sqrt(2.0) * math.sqrt(k * (k + 1) / 6.0)
    return ranks.groupBy(*family, "model").agg(
        F.avg("rank").alias("avg_rank"),
        F.count(F.lit(1)).alias("n"),
        (F.lit(factor) / F.sqrt(F.count(F.lit(1)))).alias("critical_difference"),
    )


def pearson(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Correlation with its t-based p; fewer than three points give null."""
    ok = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    g = ok.groupBy(*keys).agg(F.corr(x, y).alias("r"), F.count(F.lit(1)).alias("n"))
    r = F.when((F.col("n") >= 3) & ~F.isnan("r"), F.col("r"))
    room = F.when(F.abs(r) < 1, F.lit(1.0) - r * r)
    t = r * F.sqrt((F.col("n") - 2) / room)
    return g.withColumn("r", r).withColumn("p_value", tails.p_t_two_sided(t, F.col("n") - 2))


def one_sample_t(df: DataFrame, keys: Sequence[str], d: str) -> DataFrame:
    g = df.filter(F.col(d).isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(d).alias("mean_diff"), F.stddev_samp(d).alias("_sd")
    )
    t = F.when(F.col("_sd") > 0, F.col("mean_diff") / (F.col("_sd") / F.sqrt("n")))
    g = g.withColumn("t_stat", t)
    return g.withColumn("p_t", tails.p_t_two_sided(F.col("t_stat"), F.col("n") - 1)).drop("_sd")


def tost(df: DataFrame, keys: Sequence[str], d: str, delta: float = 0.05) -> DataFrame:
    """Two one-sided tests: 90 % interval, p and the equivalence verdict."""
    g = df.filter(F.col(d).isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(d).alias("mean_diff"),
        (F.stddev_samp(d) / F.sqrt(F.count(F.lit(1)))).alias("se"),
    )
    se = F.when(F.col("se") > 0, F.col("se"))
    dof = F.when(F.col("n") > 1, F.col("n") - 1)
    g = g.withColumns(
        {
            "_pl": tails.p_t_upper((F.col("mean_diff") + delta) / se, dof),
            "_pu": tails.p_t_upper(-(F.col("mean_diff") - delta) / se, dof),
            "_tc": tails.t_quantile(0.95, dof),
        }
    )
    g = g.withColumns(
        {
            "p_tost": F.when(F.col("_pl").isNotNull(), F.greatest("_pl", "_pu")),
            "ci90_lo": F.col("mean_diff") - F.col("_tc") * F.col("se"),
            "ci90_hi": F.col("mean_diff") + F.col("_tc") * F.col("se"),
        }
    )
    verdict = (F.col("ci90_lo") > -delta) & (F.col("ci90_hi") < delta)
    return g.withColumn("equivalent", F.coalesce(verdict, F.lit(False))).drop("_pl", "_pu", "_tc")


def margin_sweep(tests: DataFrame, margins: Sequence[float]) -> DataFrame:
    """Smallest margin that would give equivalence, and the verdict at each."""
    need = F.greatest(F.abs("ci90_lo"), F.abs("ci90_hi"))
    t = tests.withColumn("min_margin", need)
    t = t.withColumn("margin", F.explode(F.array(*[F.lit(float(m)) for m in margins])))
    return t.withColumn("equivalent_at", F.col("min_margin") < F.col("margin"))


# --- bootstraps -------------------------------------------------------------


def _percentile_interval(reps: DataFrame, keys: Sequence[str], stat: Column, level: float) -> DataFrame:
    """Percentile interval; a group holds one value per replicate."""
    tail = (1.0 - level) / 2.0
    g = reps.withColumn("_stat", stat).groupBy(*keys).agg(
        F.max("n").alias("n"),
        F.percentile("_stat", F.lit(tail)).alias("ci_lo"),
        F.percentile("_stat", F.lit(1.0 - tail)).alias("ci_hi"),
    )
    return g


def bootstrap_mean(
    df: DataFrame, keys: Sequence[str], id_col: str, value: str, draws: int = 10_000, seed: int = 7, level: float = 0.95
) -> DataFrame:
    """iid (Poisson) bootstrap percentile interval of a mean; empty replicates drop out."""
    ok = df.filter(F.col(value).isNotNull())
    reps = resample.replicates(ok, keys, id_col, {"_x": F.col(value)}, draws, seed)
    return _percentile_interval(reps, keys, F.col("_x") / F.when(F.col("_w") > 0, F.col("_w")), level)


def bootstrap_corr(
    df: DataFrame, keys: Sequence[str], id_col: str, x: str, y: str, draws: int = 10_000, seed: int = 7, level: float = 0.95
) -> DataFrame:
    """Bootstrap percentile interval of a correlation; undefined replicates drop out.

    Both values are centred by their group's mean first, so that their sums of
    squares keep their digits.
    """
    ok = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    means = ok.groupBy(*keys).agg(F.avg(x).alias("_mx"), F.avg(y).alias("_my"))
    ok = ok.join(means, list(keys))
    cx, cy = F.col(x) - F.col("_mx"), F.col(y) - F.col("_my")
    terms = {"_x": cx, "_y": cy, "_xx": cx * cx, "_yy": cy * cy, "_xy": cx * cy}
    reps = resample.replicates(ok, keys, id_col, terms, draws, seed)
    w = F.col("_w")
    vx = w * F.col("_xx") - F.col("_x") * F.col("_x")
    vy = w * F.col("_yy") - F.col("_y") * F.col("_y")
    # a replicate that drew one point only has no correlation
    defined = (vx > F.lit(1e-12) * w * F.col("_xx")) & (vy > F.lit(1e-12) * w * F.col("_yy"))
    cov = w * F.col("_xy") - F.col("_x") * F.col("_y")
    r = F.when(defined, cov / F.sqrt(F.when(defined, vx * vy)))
    return _percentile_interval(reps, keys, r, level)


def block_bootstrap(
    diffs: DataFrame,
    block: int | Sequence[int],
    draws: int = 10_000,
    seed: int = 7,
    level: float = 0.95,
    keys: Sequence[str] = tuple(PAIR),
) -> DataFrame:
    """Moving-block bootstrap interval of mean(d) per series and pair, for one or several block lengths.

    The differences of one group, folds * horizon at most, travel as an array;
    ceil(n / block) blocks are drawn and cut to n.  Too short groups give null.
    """
    keys = list(keys)
    lengths = [block] if isinstance(block, int) else list(block)
    g = diffs.groupBy(*keys).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("pos", "d"))), lambda s: s["d"]).alias("_d")
    )
    g = g.withColumns({"n": F.size("_d"), "_key": F.concat_ws("|", *[F.col(k).cast("string") for k in keys])})
    ci = resample.block_intervals(g, lengths, draws, seed, level)
    out = g.drop("_d").withColumn("block", F.explode(F.array(*[F.lit(b) for b in lengths]))).join(ci, ["_key", "block"], "left")
    excludes = (F.col("ci_lo") > 0) | (F.col("ci_hi") < 0)
    out = out.select(*keys, "n", "ci_lo", "ci_hi", "block")
    return out.withColumn("significant", F.coalesce(excludes, F.lit(False)))


# --- aggregated views -------------------------------------------------------


def trajectory_tests(diffs: DataFrame, folds: int, horizon: int) -> DataFrame:
    """Per-fold mean differences tested as one observation each.

    A fold holds ``horizon`` differences at most.  They are summed by position: where
    they cancel, the sign of their mean must not depend on the order of rows.
    """
    known = F.collect_list(F.when(F.col("d").isNotNull(), F.struct("pos", "d")))
    f = diffs.groupBy(*PAIR, "fold").agg(F.sort_array(known).alias("_d"), F.count(F.lit(1)).alias("_c"))
    total = F.aggregate("_d", F.lit(0.0), lambda a, s: a + s["d"])
    f = f.withColumn("fold_mean", F.when(F.size("_d") > 0, total / F.size("_d"))).drop("_d")
    full = f.groupBy(*PAIR).agg(F.sum("_c").alias("_n")).filter(F.col("_n") == folds * horizon)
    f = f.join(full.drop("_n"), PAIR, "left_semi")
    t = one_sample_t(f, PAIR, "fold_mean").drop("n")
    return t.join(sign_test(f, PAIR, "fold_mean"), PAIR)


def lead_tests(diffs: DataFrame) -> DataFrame:
    """Mean difference per series and lead, then signed-rank across series.

    The means are rounded to twelve digits of the mean |d|: whether two of them tie,
    or one is zero, must not depend on the order in which a task summed them.
    """
    lead = diffs.groupBy(*PAIR, "lead").agg(significant(F.avg("d"), F.avg(F.abs("d"))).alias("d"))
    keys = ["model_a", "model_b", "lead"]
    counts = lead.groupBy(*keys).agg(
        F.avg("d").alias("mean_diff"),
        F.count_if(F.col("d") < 0).alias("n_favouring_a"),
        F.count_if(F.col("d") > 0).alias("n_favouring_b"),
    )
    return counts.join(signed_rank(lead, keys, "d"), keys)


def agreement(df: DataFrame, keys: Sequence[str], a: str, b: str) -> DataFrame:
    """How often two verdicts agree."""
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col(a) == F.col(b)).alias("n_agree"),
        F.count_if(F.col(a) & ~F.col(b)).alias("only_first"),
        F.count_if(~F.col(a) & F.col(b)).alias("only_second"),
    )


def sign_consistency(lead_means: DataFrame, keys: Sequence[str], value: str = "mean_diff") -> DataFrame:
    """Share of leads whose mean difference has the overall sign."""
    return lead_means.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_leads"),
        F.count_if(F.col(value) < 0).alias("n_negative"),
        F.count_if(F.col(value) > 0).alias("n_positive"),
    )


def classify_family(df: DataFrame, family: Sequence[str], flag: str) -> DataFrame:
    """all / none / mixed outcome of a family of verdicts."""
    label = (
        F.when(F.bool_and(flag), "all").when(~F.bool_or(flag), "none").otherwise("mixed")
    )
    return df.groupBy(*family).agg(
        F.count(F.lit(1)).alias("n_tests"), F.count_if(flag).alias("n_true"), label.alias("outcome")
    )


def stratified_contrasts(
    paired: DataFrame, strata: dict[str, Column], a: str, b: str, min_n: int = 8
) -> DataFrame:
    """Contrast of two score columns inside overlapping strata.

    Each row is emitted once per stratum it belongs to, so all strata share
    one aggregate; the panel size is counted in the same pass.
    """
    panel = "__panel"
    names = F.array_compact(
        F.array(F.lit(panel), *[F.when(c, F.lit(k)) for k, c in strata.items()])
    )
    every = paired.withColumn("stratum", F.explode(names))
    every = every.withColumn("d", F.col(a) - F.col(b))
    has = F.col("d").isNotNull()
    g = every.groupBy("stratum").agg(
        F.count("d").alias("n"),
        F.avg(F.when(has, F.col(a))).alias("mean_a"),
        F.avg(F.when(has, F.col(b))).alias("mean_b"),
        F.avg("d").alias("mean_diff"),
        F.count_if(F.col("d") > 0).alias("n_b_better"),
        F.count(F.lit(1)).alias("_rows"),
    )
    # one row per named stratum, so the unpartitioned window is bounded
    total = F.max(F.when(F.col("stratum") == panel, F.col("_rows"))).over(Window.partitionBy())
    g = g.withColumn("_total", total).filter(F.col("stratum") != panel).drop("_rows")
    s = every.filter(F.col("stratum") != panel)
    med = group_quantiles(s, ["stratum"], "d", {"median_diff": 0.5}).drop("n")
    w = signed_rank(s, ["stratum"], "d").select("stratum", "t_stat", "p_wilcoxon")
    g = g.join(med, "stratum", "left").join(w, "stratum", "left")
    return g.withColumns(
        {
            "underpowered": F.col("n") < min_n,
            "share_of_panel": F.col("n") / F.col("_total"),
            "p_wilcoxon": F.when(F.col("n") >= 3, F.col("p_wilcoxon")),
            "t_stat": F.when(F.col("n") >= 3, F.col("t_stat")),
        }
    ).drop("_total")


def foresight_ablation(
    paired: DataFrame, keys: Sequence[str], perfect: str, causal: str, base: str
) -> DataFrame:
    """Gain from perfect covariates and the tests with and without them."""
    keys = list(keys)
    d = paired.dropna(subset=[perfect, causal, base])
    d = d.withColumns(
        {
            "_gain": F.col(causal) - F.col(perfect),
            "_pf": F.col(perfect) - F.col(base),
            "_ca": F.col(causal) - F.col(base),
        }
    )
    g = d.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(perfect).alias("mean_perfect"),
        F.avg(causal).alias("mean_causal"),
        F.avg(base).alias("mean_base"),
        F.avg("_gain").alias("foresight_gain"),
        F.count_if(F.col("_pf") < 0).alias("perfect_wins"),
        F.count_if(F.col("_ca") < 0).alias("causal_wins"),
    )
    for col, name in (("_gain", "p_gain"), ("_pf", "p_perfect"), ("_ca", "p_causal")):
        g = g.join(signed_rank(d, keys, col).select(*keys, F.col("p_wilcoxon").alias(name)), keys)
    verdict = (
        F.when((F.col("p_perfect") < ALPHA) & (F.col("p_causal") >= ALPHA), "depends on foresight")
        .when(F.col("p_causal") < ALPHA, "robust to causal covariates")
        .otherwise("no significant lead")
    )
    return g.withColumn("verdict", verdict)
