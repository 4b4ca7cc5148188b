"""The linear core and the baselines where naive sums or shared fallbacks would fail."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelkit.operators import backtest, stats


def dense(x, y, alpha):
    sd = x.std(axis=0)
    sd[sd == 0] = 1
    z = (x - x.mean(axis=0)) / sd
    beta = np.linalg.solve(z.T @ z + alpha * np.eye(x.shape[1]), z.T @ (y - y.mean())) / sd
    return y.mean() - beta @ x.mean(axis=0), beta


@pytest.mark.parametrize("offset", [0.0, 1e8])
def test_ridge_with_large_offset_over_folds(spark, frame, offset):
    r = np.random.default_rng(4)
    x = r.normal(0, 1, (240, 2)) + offset
    y = 3 * (x[:, 0] - offset) - 2 * (x[:, 1] - offset) + r.normal(0, 0.1, 240) + offset
    rows = [("s", i, float(a), float(b), float(t)) for i, ((a, b), t) in enumerate(zip(x, y))]
    df = frame("k string, i int, a double, b double, t double", rows).repartition(7)
    first = F.when(F.col("i") < 120, F.lit(0)).otherwise(F.floor((F.col("i") - 120) / 40) + 1).cast("int")
    sums = backtest.moments_by_fold(df, ["k"], ["a", "b"], "t", first, 3)
    for fit in backtest.solve_ridge(sums, 2, 1.0).collect():
        n = 120 + 40 * fit["fold"]
        level, beta = dense(x[:n], y[:n], 1.0)
        assert fit["n_rows"] == n
        assert np.allclose(fit["beta"], beta, rtol=1e-6)
        assert fit["intercept"] + np.dot(fit["beta"], x[0]) == pytest.approx(level + beta @ x[0], rel=1e-9)


def test_flat_features(frame):
    df = frame("k string, a double, t double", [("flat", 5.0, 5.0)] * 40 + [("same_x", 1e8, float(i)) for i in range(40)])
    got = {r["k"]: r for r in backtest.solve_ridge(backtest.moments(df, ["k"], ["a"], "t"), 1).collect()}
    assert (got["flat"]["intercept"], got["flat"]["beta"]) == (5.0, [0.0])
    assert (got["same_x"]["intercept"], got["same_x"]["beta"]) == (19.5, [0.0])
    zero = backtest.solve_ridge(backtest.moments(df, ["k"], ["a"], "t"), 1, flat_mean=False).collect()
    assert {r["intercept"] for r in zero} == {0.0}


def test_trees_name_rows_without_prediction(frame):
    rows = [(i, float(i % 7), float(i), float(i % 7)) for i in range(60)]
    train = frame("i int, a double, b double, target double", rows)
    test = frame("i int, a double, b double, target double", [(1, 1.0, 2.0, 1.0), (2, None, 2.0, 1.0), (3, 1.0, float("nan"), 1.0)])
    scored, weights = backtest.pooled_trees(train, test, ["a", "b"], max_iter=2, max_depth=2)
    got = {r["i"]: (r["y_pred"] is not None, r["reason"]) for r in scored.collect()}
    assert got == {1: (True, None), 2: (False, "missing a"), 3: (False, "missing b")}
    assert len(weights) == 2


def test_training_rows_of_trees_are_dealt_over_tasks(spark, frame, monkeypatch):
    """However few partitions the rows come in, none that is fit holds many more rows than TREE_ROWS."""
    from pyspark.ml.regression import GBTRegressor

    whole, held = GBTRegressor.fit, []

    def fit(self, rows, *args):
        held.extend(rows.rdd.mapPartitions(lambda part: [sum(1 for _ in part)]).collect())
        return whole(self, rows, *args)

    monkeypatch.setattr(GBTRegressor, "fit", fit)
    monkeypatch.setattr(backtest, "TREE_ROWS", 25, raising=False)
    train = frame("a double, target double", [(float(i % 7), float(i % 7)) for i in range(500)]).coalesce(1)
    backtest.pooled_trees(train, train, ["a"], max_iter=1, max_depth=1)
    assert sum(held) == 500 and len(held) == 20 and max(held) <= 2 * 25


def short_panel(frame, n):
    start = dt.datetime(2024, 1, 1)
    rows = [("s", start + dt.timedelta(hours=i), float(i), i, n) for i in range(n)]
    return frame("series_id string, ts timestamp, y double, pos long, n long", rows)


def test_short_history_repeats_each_folds_origin(frame):
    p = short_panel(frame, 30)
    want = [23.0, 23.0, 25.0, 25.0, 27.0, 27.0]
    one = backtest.seasonal_naive(p, 2, 3, 0, long_season=29).orderBy("pos").collect()
    assert [r["y_pred"] for r in one] == want
    every = backtest.baselines(p, 2, 3, 0, season=2, cycles=2, long_season=29)
    assert [r["y_pred"] for r in every.filter("model = 'seasonal_naive'").orderBy("pos").collect()] == want


def test_history_that_reaches_the_season_uses_it(frame):
    got = backtest.seasonal_naive(short_panel(frame, 30), 2, 3, 0, long_season=26).orderBy("pos").collect()
    assert [r["y_pred"] for r in got] == [23.0, 23.0, 0.0, 1.0, 2.0, 3.0]


def predictions(n, missing=(), shift=0):
    r = np.random.default_rng(9)
    rows = []
    for i in range(n):
        y = float(r.normal())
        for model, noise in (("a", 1.0), ("b", 1.3)):
            if not (model == "b" and i in missing):
                rows.append(("s", model, 0, 1, i + shift, y, y + noise * float(r.normal())))
    return rows


def plain_dm(rows, h):
    loss = {}
    for _, model, _, _, pos, y, p in rows:
        loss.setdefault(pos, {})[model] = abs(y - p)
    d = np.array([v["a"] - v["b"] for _, v in sorted(loss.items()) if len(v) == 2])
    n, c = len(d), d - d.mean()
    v = sum((1 if k == 0 else 2 * (1 - k / h)) * np.mean(c[k:] * c[: n - k]) for k in range(h))
    return d.mean() / np.sqrt(v / n) * np.sqrt((n + 1 - 2 * h + h * (h - 1) / n) / n)


PREDS = "series_id string, model string, fold int, lead int, pos long, y_true double, y_pred double"


@pytest.mark.parametrize("shift", [0, 16384 - 60, 16384 * 3 - 5])
def test_dm_with_missing_positions_ignores_absolute_place(frame, shift):
    rows = predictions(140, missing=(50, 51, 52, 53, 57, 58, 60), shift=shift)
    got = stats.dm_statistics(frame(PREDS, rows), ["a", "b"], 6).collect()[0]
    assert got["n"] == 133
    assert got["dm_stat"] == pytest.approx(plain_dm(rows, 6), rel=1e-9)


def test_small_lead_means_are_not_zeros(frame):
    rows = [(f"s{i}", "a", "b", 1, i, (i + 1) * 1e-11) for i in range(20)]
    diffs = frame("series_id string, model_a string, model_b string, lead int, pos long, d double", rows)
    got = stats.lead_tests(diffs).collect()[0]
    assert got["n_favouring_b"] == 20 and got["n_used"] == 20


def test_tree_queries_do_the_whole_job(spark, monkeypatch):
    """Every kept fold of every series is scored, and no query fits less than the operator's default."""
    from inspect import signature

    from panelkit.registry import all_queries

    whole, kinds, fits = backtest.pooled_trees, signature(backtest.pooled_trees), []

    def small(train, test, features, **given):
        call = kinds.bind(train, test, features, **given)
        call.apply_defaults()
        fits.append((call.arguments["max_iter"], call.arguments["max_depth"]))
        return whole(train, test, features, max_iter=1, max_depth=2)

    monkeypatch.setattr(backtest, "pooled_trees", small)
    sf, queries = "/root/testdata/sf0.01", all_queries()
    got = {(r["series_id"], r["fold"]): r["n_points"] for r in queries["e4_pooled_trees"](spark, sf).collect()}
    want = {(r["series_id"], r["fold"]) for r in queries["e1_folds"](spark, sf).collect()}
    assert set(got) == want and {fold for _, fold in want} == set(range(6)) and set(got.values()) == {4}
    assert queries["e8_tree_importance"](spark, sf).count() == 9
    default = tuple(kinds.parameters[p].default for p in ("max_iter", "max_depth"))
    assert fits == [default, default]
