"""Goldens of published results and brute-force checks."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelkit.functions import tails
from panelkit.operators import backtest, covariates, decide, features, metrics, resample, stats


def test_tail_goldens():
    assert tails.signed_rank_p(25, 15, 0, False) == pytest.approx(0.04791259765625, abs=1e-15)
    assert tails.signed_rank_p(12, 15, 0, False) == pytest.approx(0.0042724609375, abs=1e-15)
    assert tails.signed_rank_p(9, 15, 0, False) == pytest.approx(0.00201416015625, abs=1e-15)
    assert tails.signed_rank_p(137, 29, 0, False) == pytest.approx(0.0836756, abs=1e-7)
    assert tails.sign_test_p(11, 15) == pytest.approx(0.1184692383, abs=1e-10)
    assert tails.sign_test_p(14, 15) == pytest.approx(0.0009765625, abs=1e-12)
    assert tails.sign_test_p(8, 29) == pytest.approx(0.0241195, abs=1e-7)
    assert float(tails.chi2_sf(54.841379, 4)) == pytest.approx(3.507e-11, rel=1e-3)
    q = tails.studentised_range_q(5)
    assert q / math.sqrt(2) * math.sqrt(5 * 6 / (6 * 29)) == pytest.approx(1.132647, abs=1e-6)


@pytest.mark.parametrize("df,t,p", [(1, 1.0, 0.25), (2, math.sqrt(2), 0.5 * (1 - 1 / math.sqrt(2))), (28, 1.701131, 0.05), (1e7, 1.959964, 0.025)])
def test_t_tail(df, t, p):
    assert float(tails.t_sf(t, df)) == pytest.approx(p, abs=2e-7)
    assert float(tails.t_sf(-t, df)) == pytest.approx(1 - p, abs=2e-7)
    assert float(tails.t_ppf(1 - p, df)) == pytest.approx(t, abs=2e-5)


def test_pearson_golden_p():
    r, n = -0.0309806, 29
    t = r * math.sqrt((n - 2) / (1 - r * r))
    assert 2 * float(tails.t_sf(abs(t), n - 2)) == pytest.approx(0.8732473, abs=1e-6)


def test_tost_golden_interval():
    """n = 29, mean and interval as published; the p follows from both."""
    mean, lo, hi, n, delta = 0.03284208, -0.0040112, 0.06969536, 29, 0.05
    se = (hi - lo) / 2 / float(tails.t_ppf(0.95, n - 1))
    p = max(float(tails.t_sf((mean + delta) / se, n - 1)), 1 - float(tails.t_sf((mean - delta) / se, n - 1)))
    assert p == pytest.approx(0.21750921, abs=1e-6)


def test_tost_of_rows(frame):
    rng = np.random.default_rng(0)
    d = rng.normal(0.01, 0.05, 40)
    got = stats.tost(frame("k string, d double", [("a", float(v)) for v in d]), ["k"], "d").collect()[0]
    se = d.std(ddof=1) / math.sqrt(40)
    half = float(tails.t_ppf(0.95, 39)) * se
    assert got["ci90_lo"] == pytest.approx(d.mean() - half) and got["ci90_hi"] == pytest.approx(d.mean() + half)
    assert got["equivalent"] == (abs(d.mean()) + half < 0.05)


def test_holm_and_bh(frame):
    p = [0.0479126, 0.0832520, 0.4212036, 0.1688232]
    df = frame("f string, i int, p_value double", [("a", i, v) for i, v in enumerate(p)] + [("b", 9, 0.0), ("b", 10, None)])
    h = {r["i"]: r["p_holm"] for r in stats.holm(df, ["f"]).collect()}
    assert [h[i] for i in range(4)] == pytest.approx([0.1916504, 0.2497559, 0.4212036, 0.3376465], abs=1e-6)
    b = {r["i"]: r["p_bh"] for r in stats.benjamini_hochberg(df, ["f"]).collect()}
    m = 4
    order = np.argsort(p)
    want = np.minimum.accumulate((np.array(p)[order] * m / np.arange(1, 5))[::-1])[::-1]
    assert [b[int(i)] for i in order] == pytest.approx(want)
    assert b[9] == 0.0 and b[10] is None and h[10] is None


def test_bh_counts_missing_tests(frame):
    df = frame("f string, i int, p_value double", [("a", 0, 0.02), ("a", 1, None)])
    one = {r["i"]: r["p_bh"] for r in stats.benjamini_hochberg(df, ["f"]).collect()}
    two = {r["i"]: r["p_bh"] for r in stats.benjamini_hochberg(df, ["f"], count_null=False).collect()}
    assert (one[0], two[0]) == (0.04, 0.02)


def _dm(y, a, b, h):
    d = np.abs(y - a) - np.abs(y - b)
    n, c = len(d), d - d.mean()
    var = np.mean(c * c) + sum(2 * (1 - k / h) * np.mean(c[k:] * c[:-k]) for k in range(1, h))
    var /= n
    if n < 10 or var <= 0:
        return None
    return d.mean() / math.sqrt(var) * math.sqrt((n + 1 - 2 * h + h * (h - 1) / n) / n)


@pytest.mark.parametrize("n,h", [(144, 24), (60, 6), (9, 1), (30, 1)])
def test_diebold_mariano_brute_force(frame, n, h):
    rng = np.random.default_rng(n)
    rows, want = [], {}
    for sid in ("a", "b"):
        y = rng.normal(size=n)
        p = {m: y + rng.normal(size=n) * s for m, s in (("x", 1.0), ("z", 1.4))}
        p["c"] = p["x"].copy()
        want[sid] = {("x", "z"): _dm(y, p["x"], p["z"], h), ("x", "c"): None}
        rows += [(sid, m, 0, i + 1, i, float(y[i]), float(v[i])) for m, v in p.items() for i in range(n)]
    df = frame("series_id string, model string, fold int, lead int, pos long, y_true double, y_pred double", rows)
    got = stats.paired_summary(df, ["x", "z", "c"], h).collect()
    for r in got:
        key = (r["model_a"], r["model_b"])
        if key in want[r["series_id"]]:
            w = want[r["series_id"]][key]
            assert (r["dm_stat"] is None) if w is None else r["dm_stat"] == pytest.approx(w, rel=1e-9)
        if key == ("x", "c"):
            assert r["better"] == "c" and not r["significant"]


def test_signed_rank_with_ties_and_zeros(frame):
    d = [0.0, 1.0, -1.0, 2.0, 2.0, -3.0, 4.0]
    r = stats.signed_rank(frame("k string, d double", [("a", v) for v in d]), ["k"], "d").collect()[0]
    assert (r["n"], r["n_zero"], r["n_used"]) == (7, 1, 6)
    assert (r["w_plus"], r["w_minus"]) == (1.5 + 3.5 + 3.5 + 6.0, 1.5 + 5.0)
    assert r["tie_sum"] == 12.0 and 0 < r["p_wilcoxon"] < 1


def test_friedman_and_ranks(frame):
    rng = np.random.default_rng(5)
    vals = rng.normal(size=(12, 4)) + np.array([0, 0.5, 1.0, 1.5])
    rows = [("p", f"s{i}", f"m{j}", float(vals[i, j])) for i in range(12) for j in range(4)]
    rows.append(("p", "partial", "m0", 1.0))
    df = frame("panel string, series_id string, model string, MASE double", rows)
    ranks = stats.model_ranks(df, ["panel"], [f"m{j}" for j in range(4)])
    rk = vals.argsort(axis=1).argsort(axis=1) + 1
    chi2 = 12 / (12 * 4 * 5) * (rk.sum(axis=0) ** 2).sum() - 3 * 12 * 5
    got = stats.friedman(ranks, ["panel"], 4).collect()[0]
    assert got["n"] == 12 and got["chi2"] == pytest.approx(chi2)
    avg = {r["model"]: r["avg_rank"] for r in stats.average_ranks(ranks, ["panel"], 4).collect()}
    assert [avg[f"m{j}"] for j in range(4)] == pytest.approx(rk.mean(axis=0))


def test_conformal_brute_force(frame):
    rng = np.random.default_rng(2)
    n = 41
    y, p = rng.normal(size=n), rng.normal(size=n)
    rows = [("s", "m", i, float(y[i]), float(p[i])) for i in range(n)]
    df = frame("series_id string, model string, pos long, y_true double, y_pred double", rows)
    got = stats.split_conformal(df, 0.1).collect()[0]
    e = np.abs(y - p)
    half = n // 2
    k = math.ceil((half + 1) * 0.9)
    q = np.sort(e[:half])[min(k, half) - 1]
    assert got["q"] == pytest.approx(q) and got["coverage"] == pytest.approx((e[half:] <= q).mean())


def test_bootstrap_draws_do_not_depend_on_partitions_or_offset(frame):
    rng = np.random.default_rng(1)
    rows = [(k, f"id{i}", float(rng.normal()), float(rng.normal())) for k in ("a", "b") for i in range(23)]
    df = frame("k string, id string, x double, y double", rows)
    far = df.selectExpr("k", "id", "x + 1e8 AS x", "y - 1e8 AS y")
    one = stats.bootstrap_corr(df, ["k"], "id", "x", "y", draws=60).orderBy("k").collect()
    for other in (stats.bootstrap_corr(d, ["k"], "id", "x", "y", draws=60).orderBy("k").collect() for d in (df.repartition(9), far)):
        for p, q in zip(one, other):
            assert (p["ci_lo"], p["ci_hi"]) == pytest.approx((q["ci_lo"], q["ci_hi"]), abs=1e-6)
    plain = []
    for rep in range(60):
        w = []
        for _, i, *_ in rows[:23]:
            h = hashlib.md5(f"7|{rep // 4}|{i}".encode()).hexdigest()[8 * (rep % 4) : 8 * (rep % 4) + 8]
            w.append(sum((int(h, 16) + 0.5) / 2**32 > p for p in stats.POISSON))
        plain.append(np.average([r[2] for r in rows[:23]], weights=w))
    got = stats.bootstrap_mean(df.filter("k = 'a'"), ["k"], "id", "x", draws=60).collect()[0]
    assert (got["ci_lo"], got["ci_hi"]) == pytest.approx(tuple(np.quantile(plain, [0.025, 0.975])))


def test_bootstrap_close_to_theory(frame):
    x = np.random.default_rng(4).normal(2, 1, 200)
    df = frame("k string, id string, x double", [("a", str(i), float(v)) for i, v in enumerate(x)])
    r = stats.bootstrap_mean(df, ["k"], "id", "x", draws=2000).collect()[0]
    half = 1.96 * x.std() / math.sqrt(200)
    assert r["ci_lo"] == pytest.approx(x.mean() - half, abs=0.02)
    assert r["ci_hi"] == pytest.approx(x.mean() + half, abs=0.02)


def test_block_bootstrap_short_group_is_null(frame):
    df = frame("series_id string, model_a string, model_b string, pos long, d double", [("s", "a", "b", i, 1.0) for i in range(5)])
    r = stats.block_bootstrap(df, block=5, draws=20).collect()[0]
    assert r["ci_lo"] is None and not r["significant"]
    r = stats.block_bootstrap(df, block=2, draws=20).collect()[0]
    assert (r["ci_lo"], r["ci_hi"], r["significant"]) == (1.0, 1.0, True)


def test_winner_tie_and_seed_mean(frame):
    rows = [("r", "b", 1.0, 0.0), ("r", "a", 0.5, 0.0), ("r", "a", 1.5, 0.0), ("r", "z", 0.9, 5.0)]
    df = frame("regime string, model string, MASE double, usd_per_1k double", rows)
    got = {r["wtp"]: r["winner"] for r in decide.penalised_winner(df, ["regime"], [0.0, 1.0]).collect()}
    assert got == {0.0: "z", 1.0: "a"}


def test_price_and_pue_equal_a_scaled_wtp(frame):
    rng = np.random.default_rng(9)
    rows = [(r, m, float(rng.uniform()), float(rng.uniform())) for r in "pq" for m in "abc"]
    df = frame("regime string, model string, MASE double, usd_per_1k double", rows)
    s = decide.cost_sensitivity(df, ["regime"], [0.5, 2.0], [0.15, 0.3], [1.4, 2.8]).collect()
    base = {(r["regime"], r["wtp"]): r["winner"] for r in decide.penalised_winner(df, ["regime"], [0.5, 1.0, 2.0, 4.0, 8.0]).collect()}
    for row in s:
        f = row["price"] / 0.15 * row["pue"] / 1.4
        flips = sum(base[(r, w)] != base[(r, w * f)] for r in "pq" for w in (0.5, 2.0))
        assert (row["flipped"], row["cells"]) == (flips, 4)


def _ridge(x, y, alpha=1.0):
    mu, sd = x.mean(axis=0), x.std(axis=0)
    sd = np.where(sd > 0, sd, 1.0)
    z = (x - mu) / sd
    beta = np.linalg.solve(z.T @ z + alpha * np.eye(x.shape[1]), z.T @ (y - y.mean())) / sd
    return beta, y.mean() - beta @ mu


def test_ridge_from_sums(frame):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(80, 3)) * [1, 10, 0] + [0, 5, 3]
    y = x[:, 0] * 2 - x[:, 1] + rng.normal(size=80)
    df = frame("k string, a double, b double, c double, t double", [("k", *map(float, r), float(v)) for r, v in zip(x, y)])
    fit = backtest.solve_ridge(backtest.moments(df, ["k"], ["a", "b", "c"], "t"), 3).collect()[0]
    beta, icept = _ridge(x, y)
    np.testing.assert_allclose(fit["beta"], beta, rtol=1e-8, atol=1e-10)
    assert fit["intercept"] == pytest.approx(icept, rel=1e-8)


def test_direct_ridge_brute_force(frame):
    rng = np.random.default_rng(8)
    n, h, k, min_train = 60, 3, 2, 20
    y = np.cumsum(rng.normal(size=n))
    rows = [("s", i, n, float(v)) for i, v in enumerate(y)]
    p = frame("series_id string, pos long, n long, y double", rows).withColumn(
        "ts", F.timestamp_seconds(F.col("pos") * 3600)
    )
    d = features.design(p, range(1, h + 1), mode="none", lags=(0, 1, 4), rolls=(3,), cal=False)
    cols = ["ylag_0", "ylag_1", "ylag_4", "rollmean_3"]
    got = {(r["fold"], r["lead"]): r["y_pred"] for r in backtest.direct_ridge(d, cols, h, k, min_train).collect()}
    feats = {t: [y[t], y[t - 1], y[t - 4], y[t - 2 : t + 1].mean()] for t in range(4, n)}
    for fold in range(k):
        end = n - (k - fold) * h
        for lead in range(1, h + 1):
            ts = [t for t in range(4, n) if t + lead < end]
            beta, icept = _ridge(np.array([feats[t] for t in ts]), np.array([y[t + lead] for t in ts]))
            assert got[(fold, lead)] == pytest.approx(icept + beta @ np.array(feats[end - 1]), rel=1e-6)


def test_baselines_equal_single_forecasters(frame):
    rng = np.random.default_rng(3)
    rows = [(s, i, 90, float(rng.normal())) for s in "ab" for i in range(90)]
    p = frame("series_id string, pos long, n long, y double", rows).withColumn("ts", F.timestamp_seconds("pos"))
    every = backtest.baselines(p, 4, 5, 30, 4, 3, 13)
    singles = [
        backtest.seasonal_naive(p, 4, 5, 30, 13),
        backtest.seasonal_mean(p, 4, 5, 30, 4, 3),
        backtest.last_value(p, 4, 5, 30),
    ]
    for s in singles:
        model = s.first()["model"]
        key = ["series_id", "fold", "lead", "y_true", "y_pred"]
        a = sorted(map(tuple, every.filter(F.col("model") == model).select(*key).collect()))
        assert a == sorted(map(tuple, s.select(*key).collect())) and len(a) == 40


def test_naive_rejects_long_horizon(frame):
    p = frame("series_id string, pos long, n long, y double", [("a", 0, 1, 1.0)])
    with pytest.raises(ValueError):
        backtest.seasonal_naive(p, 200, 2, 0)


def test_early_folds_are_dropped(frame):
    p = frame("series_id string, pos long, n long, y double", [("a", i, 40, 1.0) for i in range(40)])
    folds = sorted(r["fold"] for r in backtest.fold_table(p, 5, 4, 24).collect())
    assert folds == [1, 2, 3]


def _long(frame, n=60):
    rng = np.random.default_rng(12)
    rows = [(s, v, i, float(rng.uniform(0, 350))) for s in "ab" for v in ("precipitation", "wind_direction_10m", "other") for i in range(n)]
    rows[5] = (*rows[5][:3], None)
    return frame("series_id string, variable string, pos long, value double", rows)


PARAMS = "variable string, sigma_frac double, bias_frac double, ar1 double"


def test_perturb_level_zero_is_the_input(frame):
    df = _long(frame)
    p = frame(PARAMS, [("precipitation", 0.5, 0.0, 0.9)])
    assert covariates.perturb(df, p, alpha=0) is df


def test_perturb_keeps_nulls_bounds_and_unmeasured(frame):
    df = _long(frame)
    p = frame(PARAMS, [("precipitation", 5.0, -1.0, 0.9), ("wind_direction_10m", 2.0, 0.0, None)])
    a = {(r["series_id"], r["variable"], r["pos"]): r["value"] for r in df.collect()}
    b = {(r["series_id"], r["variable"], r["pos"]): r["value"] for r in covariates.perturb(df, p, 1.0).collect()}
    assert a.keys() == b.keys()
    for k, v in b.items():
        assert (v is None) == (a[k] is None)
        if k[1] == "other":
            assert v == a[k]
        elif v is not None:
            assert v >= 0 and (k[1] == "precipitation" or v < 360)


def test_perturb_does_not_depend_on_chunks(frame):
    rows = [("a", "x", i, float(i % 17)) for i in range(9000)]
    df = frame("series_id string, variable string, pos long, value double", rows)
    p = frame(PARAMS, [("x", 0.5, 0.1, 0.95)])
    out = []
    for size in (1, 100_000):
        r = covariates.perturb(df, p, 1.0, rows=size).orderBy("pos").collect()
        out.append(np.array([x["value"] for x in r]))
    np.testing.assert_allclose(out[0], out[1], atol=1e-9)
    err = out[0] - np.array([r[3] for r in rows])
    assert np.corrcoef(err[1:], err[:-1])[0, 1] == pytest.approx(0.95, abs=0.02)


def test_amortisation(frame):
    rows = [("c", 1900.0, 320.0, 16.0), ("c", 1916.0, 324.0, 16.2), ("d", 100.0, 90.0, 1.0)]
    got = {r["city"]: r for r in metrics.amortisation(frame("city string, e_retrain_j double, e_once_j double, e_zeroshot_j double", rows), ["city"]).collect()}
    train = (1908.0 - 322.0) / 5
    gap = 16.1 / 144 - (322.0 - train) / 144
    assert got["c"]["train_per_fit_j"] == pytest.approx(train)
    assert got["c"]["crossover"] == pytest.approx(train / gap)
    assert got["d"]["crossover"] is None and not got["d"]["local_cheaper"]


def test_plugin_failure_is_isolated(frame):
    p = frame("series_id string, pos long, n long, y double", [(s, i, 30, float(i)) for s in "ab" for i in range(30)])

    def f(ctx, h):
        if len(ctx) == 10:
            raise RuntimeError("boom")
        return np.full(h, ctx[-1])

    ok = backtest.plugin_forecast(p, f, 4, 2, 0, context=8)
    assert backtest.failures(ok).count() == 0 and ok.count() == 16
    bad = backtest.plugin_forecast(p, f, 4, 2, 0, context=10)
    assert backtest.failures(bad).count() == 4


def test_plugin_forecasters_equal_window_ones(frame):
    from panelkit.functions import forecasters as fc

    rng = np.random.default_rng(2)
    rows = [(s, i, 60, float(rng.normal())) for s in "ab" for i in range(60)]
    p = frame("series_id string, pos long, n long, y double", rows).withColumn("ts", F.timestamp_seconds("pos"))
    key = ["series_id", "fold", "lead", "y_pred"]
    pairs = [
        (fc.seasonal(13), backtest.seasonal_naive(p, 4, 3, 20, 13)),
        (fc.repeat_last, backtest.last_value(p, 4, 3, 20)),
        (fc.recursive(lambda v: v[-1]), backtest.last_value(p, 4, 3, 20)),
        (fc.seasonal_average(4), backtest.seasonal_mean(p, 4, 3, 20, 4, 5)),
    ]
    for f, want in pairs:
        got = backtest.plugin_forecast(p, f, 4, 3, 20, context=20).select(*key).orderBy(*key[:3]).collect()
        ref = want.select(*key).orderBy(*key[:3]).collect()
        assert [tuple(r)[:3] for r in got] == [tuple(r)[:3] for r in ref]
        assert [r["y_pred"] for r in got] == pytest.approx([r["y_pred"] for r in ref])


def _backtest_rows(rng, series, models, level=0.0, spread=1.0):
    rows = []
    for s in range(series):
        for p in range(24):
            y = rng.gauss(0, 1)
            for i, m in enumerate(models):
                rows.append((f"s{s}", m, p // 4, p % 4 + 1, p, y, y + level * i + spread * rng.gauss(0, 1 + i)))
    return rows


BACKTEST = "series_id string, model string, fold int, lead int, pos long, y_true double, y_pred double"


def test_dm_with_a_mean_large_against_its_spread(spark):
    rng = random.Random(3)
    e = [(1e6 + rng.gauss(0, 1e-3), rng.gauss(0, 1e-3)) for _ in range(40)]
    rows = [("s", m, i // 4, i % 4 + 1, i, 0.0, v) for i, pair in enumerate(e) for m, v in zip("ab", pair)]
    got = stats.dm_statistics(spark.createDataFrame(rows, BACKTEST), ["a", "b"], 4).collect()[0]
    d = np.array([abs(a) - abs(b) for a, b in e], dtype=np.longdouble)
    c, n, h = d - d.mean(), len(d), 4
    var = sum((1 if k == 0 else 2 * (1 - k / h)) * (c[k:] * c[: n - k]).mean() for k in range(h)) / n
    want = float(d.mean() / np.sqrt(var) * np.sqrt((n + 1 - 2 * h + h * (h - 1) / n) / n))
    assert got["mean_loss_diff"] == pytest.approx(float(d.mean()))
    assert got["dm_stat"] == pytest.approx(want, rel=1e-5)


def test_dm_of_a_constant_difference_has_no_statistic(spark):
    rng = random.Random(4)
    e = [rng.uniform(1, 1e6) for _ in range(40)]
    rows = [("s", m, i // 4, i % 4 + 1, i, 0.0, v) for i, x in enumerate(e) for m, v in zip("ab", (x + 0.1, x))]
    got = stats.dm_statistics(spark.createDataFrame(rows, BACKTEST), ["a", "b"], 4).collect()[0]
    assert got["dm_stat"] is None


def test_accuracy_by_block_is_the_table_of_each_block(spark):
    from panelkit.operators import report

    rng, models = random.Random(9), ["a", "b", "c"]
    blocks = {("x", "causal"): 0.0, ("x", "perfect"): 0.5, ("y", "causal"): 2.0}
    parts = {k: _backtest_rows(rng, 9, models, level) for k, level in blocks.items()}
    preds = spark.createDataFrame([(*k, *r) for k, rows in parts.items() for r in rows], "domain string, config string, " + BACKTEST)
    err = F.abs(F.col("y_true") - F.col("y_pred"))
    keys = ["domain", "config", "series_id", "model"]
    scores = preds.groupBy(*keys).agg(F.avg(err).alias("MASE"), F.avg(err).alias("MAE"), F.sqrt(F.avg(err * err)).alias("RMSE"))
    got = report.accuracy_by_block(preds, scores, ["domain", "config"], models, "a", 4).toPandas()
    assert len(got) == 9
    assert {(r.domain, r.config) for r in got.itertuples()} == set(parts)
    for dom, cfg in [("x", "perfect")]:
        rows = parts[dom, cfg]
        one = spark.createDataFrame(rows, BACKTEST)
        s = scores.filter((F.col("domain") == dom) & (F.col("config") == cfg))
        adjusted = stats.benjamini_hochberg(stats.paired_summary(one, models, 4), ["model_a", "model_b"])
        ranks = stats.average_ranks(stats.model_ranks(s.withColumn("p", F.lit(1)), ["p"], models), ["p"], 3)
        want = report.accuracy_table(report.panel_stats(s, ["model"]), ranks, report.oriented_wins(stats.panel_rollup(adjusted), "a"))
        want = want.toPandas().sort_values("model", ignore_index=True)
        here = got[(got.domain == dom) & (got.config == cfg)].sort_values("model", ignore_index=True)
        np.testing.assert_allclose(here[["mean_MASE", "sd_MASE", "avg_rank"]], want[["mean", "sd", "avg_rank"]])
        for c in ("ref_wins_fdr", "model_wins_fdr"):
            assert here[c].fillna(-1).tolist() == want[c].fillna(-1).tolist()


def test_panel_and_recency_tables(spark):
    from panelkit.operators import report

    q = spark.createDataFrame(
        [("new_delhi", "b", "d1", "d2", 9, True), ("oslo", "a", "d1", "d2", 8, True), ("rome", "a", "d1", "d2", 1, False), ("kyiv", "a", "d1", "d2", 7, True)],
        "city string, tier string, usable_from string, usable_to string, usable_hours long, PASS boolean",
    )
    m = spark.createDataFrame([("New Delhi", "IN", 1), ("Oslo", "NO", 2), ("Rome", "IT", 3)], "city string, country string, sensor_id long")
    got = [(r["city"], r["country"], r["sensor_id"]) for r in report.panel_table(q, m).collect()]
    assert got == [("Kyiv", None, None), ("Oslo", "NO", 2), ("New Delhi", "IN", 1)]
    rows = spark.createDataFrame([("s1", i) for i in range(3)] + [("s2", 0)], "series_id string, pos long")
    sc = spark.createDataFrame([("s1", "a", 0.5), ("s1", "b", 0.25)], "series_id string, model string, MASE double")
    assert [tuple(r) for r in report.recency_table(rows, sc, ["a", "b", "c"]).collect()] == [("s1", 3, 0.5, 0.25, None)]


def test_blocks_are_summed_value_by_value():
    """Values that cancel inside a block leave nothing of what stands before it; the last block is cut."""
    values = np.array([0.1, 0.7, 1e6 / 3, 5.3, -5.3, 2.2, -2.2, 0.3, -0.3])
    for block in (2, 4, 6):
        n, blocks = len(values), -(-len(values) // block)
        want = []
        for rep in range(50):
            total = 0.0
            for m in range(blocks):
                at = int(hashlib.md5(f"7|k|{block}|{rep}|{m}".encode()).hexdigest()[:8], 16) % (n - block + 1)
                part = 0.0
                for v in values[at : at + min(block, n - m * block)].tolist():
                    part += v
                total += part
            want.append(total / n)
        assert resample.block_means(values, "k", block, 50, 7).tolist() == want


#: Summed in this order 0.1 + 0.2 - 0.3 leaves 5.6e-17; in other orders nothing or less than nothing.
CANCELLING = (0.1, 0.2, -0.3, 0.0)


@pytest.mark.parametrize("seed", range(3))
def test_mean_loss_difference_does_not_depend_on_row_order(frame, seed):
    ds = [v + 0.37 * i * (-1) ** i for i, v in enumerate(CANCELLING * 5)]
    ds[-1] -= math.fsum(ds)
    rows = [("s", m, 0, 1, i, 10.0 + max(d, 0.0) if m == "a" else 10.0 - min(d, 0.0), 10.0) for i, d in enumerate(ds) for m in "ab"]
    random.Random(seed).shuffle(rows)
    preds = frame("series_id string, model string, fold int, lead int, pos long, y_pred double, y_true double", rows)
    by_pos = sorted((r for r in rows if r[1] == "a"), key=lambda r: r[4]), sorted((r for r in rows if r[1] == "b"), key=lambda r: r[4])
    total = 0.0
    for x, y in zip(*by_pos, strict=True):
        total += abs(x[6] - x[5]) - abs(y[6] - y[5])
    (got,) = stats.dm_statistics(preds.repartition(3), ["a", "b"], 4).collect()
    assert got["mean_loss_diff"] == total / len(ds)


def test_fold_means_are_summed_by_position(frame):
    """By position 1e16 - 1 - 1e16 is 0; in the order of these rows it is -1, which would count as a win."""
    rows = [("s", "a", "b", fold, lead, fold * 3 + lead, d) for fold in range(3) for lead, d in ((0, 1e16), (2, -1e16), (1, -1.0))]
    diffs = frame("series_id string, model_a string, model_b string, fold int, lead int, pos long, d double", rows).coalesce(1)
    (got,) = stats.trajectory_tests(diffs, 3, 3).collect()
    assert (got["n"], got["wins"]) == (3, 0)


def test_losses_of_a_series_move_once(frame):
    """Pivot, window and sums of the paired test share one exchange, and no lambda runs for every row."""
    rows = [(f"s{i}", m, 0, k + 1, k, float(k), float((k * 7 + j) % 5)) for i in range(3) for j, m in enumerate("ab") for k in range(12)]
    df = frame("series_id string, model string, fold int, lead int, pos long, y_true double, y_pred double", rows)
    plan = stats.dm_statistics(df, ["a", "b"], 4)._jdf.queryExecution()
    assert plan.executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert "lambdafunction" not in plan.optimizedPlan().toString()


def test_blocks_are_drawn_without_a_python_hash_for_each(monkeypatch):
    """Heads of every length modulo a block of md5, so that draws end in its first or second block, and letters of two bytes."""
    for length in (0, 1, 3, 20, *range(44, 66), 118, 121):
        for head in ("x" * length, "é" + "x" * length):
            got = resample.first_words(head, 12, 3)
            want = [[int(hashlib.md5(f"{head}{rep}|{m}".encode()).hexdigest()[:8], 16) for m in range(3)] for rep in range(12)]
            assert got.tolist() == want
    values = np.arange(24.0) ** 1.5
    starts = [[int(hashlib.md5(f"7|s1|a|b|12|{rep}|{m}".encode()).hexdigest()[:8], 16) % 13 for m in range(2)] for rep in range(1001)]
    monkeypatch.setattr(resample.hashlib, "md5", None)
    got = resample.block_means(values, "s1|a|b", 12, 1001, 7)
    assert np.allclose(got, [sum(values[s : s + 12].sum() for s in own) / 24 for own in starts], rtol=1e-12, atol=0)
