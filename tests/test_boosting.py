"""Direct boosted trees and their attribution against plain loops and enumeration."""

from __future__ import annotations

import datetime as dt
from itertools import combinations
from math import factorial

import numpy as np
import pandas as pd
import pytest

from panelkit.operators import boosting, features
from panelkit.operators.boosting import Boosting

FEW = Boosting(rounds=12, depth=3, min_rows=4, bins=8)
H, K, MIN = 3, 4, 60


def plain(codes, target, p, keep):
    """One group's boosted trees by loops; returns nested trees and the fitted values."""
    fitted, trees = np.full(len(target), target.mean()), []

    def build(rows, used, rest, depth):
        own = [i for i in rows if used[i]]
        node = {"n": len(own), "value": p.rate * np.mean([rest[i] for i in own]) if own else 0.0}
        if depth == p.depth or not own:
            return node
        best = (0.0, None, None)
        for f in range(codes.shape[1]):
            for b in range(p.bins):
                left = [rest[i] for i in own if codes[i, f] <= b]
                right = [rest[i] for i in own if codes[i, f] > b]
                if len(left) < p.min_rows or len(right) < p.min_rows:
                    continue
                gain = sum(left) ** 2 / len(left) + sum(right) ** 2 / len(right) - (sum(left) + sum(right)) ** 2 / len(own)
                if gain > best[0] + 1e-12:
                    best = (gain, f, b)
        if best[1] is not None:
            f, b = best[1:]
            node |= {"f": f, "b": b, "kids": [
                build([i for i in rows if codes[i, f] <= b], used, rest, depth + 1),
                build([i for i in rows if codes[i, f] > b], used, rest, depth + 1),
            ]}
        return node

    for t in range(p.rounds):
        tree = build(range(len(target)), keep[t], target - fitted, 0)
        trees.append(tree)
        fitted = fitted + np.array([leaf(tree, row) for row in codes])
    return trees, fitted


def leaf(node, row):
    while "f" in node:
        node = node["kids"][int(row[node["f"]] > node["b"])]
    return node["value"]


def expected(node, row, known):
    """Value of a tree if only the features in ``known`` are known."""
    if "f" not in node:
        return node["value"]
    if node["f"] in known:
        return expected(node["kids"][int(row[node["f"]] > node["b"])], row, known)
    return sum(expected(k, row, known) * k["n"] for k in node["kids"]) / node["n"]


def sample(n=160, seed=3):
    r = np.random.default_rng(seed)
    x = np.round(r.normal(0, 1, (n, 3)), 1)
    return x, 2 * x[:, 0] - x[:, 1] * (x[:, 2] > 0) + r.normal(0, 0.1, n)


def test_trees_equal_plain_loops():
    x, y = sample()
    edges = boosting.bin_edges(x, FEW.bins)
    codes = boosting.binned(x, edges)
    assert codes.max() < FEW.bins
    group = np.arange(len(y)) % 2
    trees = boosting.grow(codes, group, y, 2, FEW, [7])
    draw = np.random.default_rng([FEW.seed, 7])
    keep = [draw.random(len(y)) < FEW.subsample for _ in range(FEW.rounds)]
    got = boosting.values(trees, codes, group)
    for g in range(2):
        mine = group == g
        _, want = plain(codes[mine], y[mine], FEW, [k[mine] for k in keep])
        assert np.allclose(got[mine], want, rtol=1e-9)
    assert np.mean((got - y) ** 2) < 0.5 * np.var(y)


def test_shapley_equals_enumeration():
    x, y = sample(90)
    codes = boosting.binned(x, boosting.bin_edges(x, FEW.bins))
    trees = boosting.grow(codes, np.zeros(len(y), int), y, 1, FEW)
    draw = np.random.default_rng([FEW.seed])
    nested, fitted = plain(codes, y, FEW, [draw.random(len(y)) < FEW.subsample for _ in range(FEW.rounds)])
    got, mean = boosting.shapley(trees, codes)
    assert np.allclose(got.sum(axis=1) + mean, fitted, rtol=1e-9)
    for row in range(0, 90, 13):
        for f in range(3):
            others, want = [j for j in range(3) if j != f], 0.0
            for size in range(3):
                for known in combinations(others, size):
                    weight = factorial(size) * factorial(2 - size) / factorial(3)
                    want += weight * sum(expected(t, codes[row], {*known, f}) - expected(t, codes[row], known) for t in nested)
            assert got[row, f] == pytest.approx(want, abs=1e-10)


def test_flat_and_tiny_data():
    one = np.zeros((1, 2))
    trees = boosting.grow(boosting.binned(one, boosting.bin_edges(one, 4)), np.zeros(1, int), np.array([5.0]), 1, FEW)
    assert boosting.values(trees, np.zeros((2, 2), int), np.zeros(2, int)).tolist() == [5.0, 5.0]
    assert boosting.shapley(trees, np.zeros((1, 2), int))[0].tolist() == [[0.0, 0.0]]


NAMES = ["ylag_0", "ylag_1", "rollmean_4"]


def designed(frame, lengths, missing=()):
    start, rows = dt.datetime(2024, 1, 1), []
    for s, n in lengths.items():
        for i in range(n):
            y = None if (s, i) in missing else float(np.sin(i / 3) * 5 + (i * 7919 % 13) / 13)
            rows.append((s, start + dt.timedelta(hours=i), y, i, n))
    p = frame("series_id string, ts timestamp, y double, pos long, n long", rows)
    return features.design(p, range(1, H + 1), mode="none", lags=(0, 1), rolls=(4,), cal=False)


def by_hand(rows, limit_of):
    """Predictions of one block per series and fold, the trees grown outside Spark."""
    out = {}
    for (s, fold), asked in rows[rows["fold"].notna()].groupby(["series_id", "fold"]):
        own = rows[(rows["series_id"] == s) & rows[[*NAMES, "target"]].notna().all(axis=1)]
        own = own[own["pos"] + own["lead"] < limit_of(asked["n"].iloc[0], fold)].sort_values(["lead", "pos"])
        x, group = own[NAMES].to_numpy(float), own["lead"].to_numpy() - 1
        edges = boosting.bin_edges(x, FEW.bins)
        fit = 0 if limit_of(100, 0) == limit_of(100, 1) else int(fold)
        trees = boosting.grow(boosting.binned(x, edges), group, own["target"].to_numpy(float), H, FEW, boosting._seed(s, fit, 0))
        y = boosting.values(trees, boosting.binned(asked[NAMES].to_numpy(float), edges), asked["lead"].to_numpy() - 1)
        out |= {(s, int(fold), int(h)): v for h, v in zip(asked["lead"], y)}
    return out


@pytest.mark.parametrize("per_fold", [False, True])
def test_direct_trees_by_series_and_fold(frame, per_fold):
    d = designed(frame, {"a": 120, "b": 90, "short": 40})
    got = boosting.direct_trees(d, NAMES, H, K, MIN, FEW, per_fold).collect()
    rows = d.toPandas()
    into = rows["pos"] + 1 - (rows["n"] - H * K)
    asked = (into >= 0) & (into % H == 0) & rows["target"].notna() & (rows["pos"] + 1 > MIN)
    rows["fold"] = np.where(asked, into // H, np.nan)
    want = by_hand(rows, lambda n, fold: n - H * K + (int(fold) * H if per_fold else 0))
    assert {(r["series_id"], r["fold"], r["lead"]): pytest.approx(r["y_pred"], rel=1e-12) for r in got} == want
    assert len(want) == 2 * H * K


def test_blocks_share_a_long_series_and_keep_every_row(frame):
    d = designed(frame, {"a": 400})
    seen = boosting._training(d, NAMES).select("pos", boosting._block_of(H, 300).alias("b")).toPandas()
    assert seen["b"].nunique() == 4 and seen.groupby("b").size().max() < 600
    split = boosting.direct_trees(d, NAMES, H, K, MIN, FEW, block_rows=300).toPandas()
    whole = boosting.direct_trees(d, NAMES, H, K, MIN, FEW).toPandas()
    both = pd.merge(split, whole, on=["series_id", "fold", "lead"])
    assert len(both) == len(whole) == H * K and both["y_pred_x"].notna().all()
    assert np.abs(both["y_pred_x"] - both["y_pred_y"]).mean() < 1.5


def test_missing_values_and_empty_tables(frame):
    d = designed(frame, {"a": 100}, missing={("a", 87), ("a", 20)})
    got = boosting.direct_trees(d, NAMES, H, K, MIN, FEW).toPandas()
    assert got.loc[got["fold"] == 0, "y_pred"].isna().all()  # the reading at its origin is missing
    assert got.loc[got["fold"] > 1, "y_pred"].notna().all()
    assert boosting.direct_trees(d.limit(0), NAMES, H, K, MIN, FEW).count() == 0
    assert boosting.tree_attribution(d.limit(0), NAMES, H, K, MIN, FEW).count() == 0


def test_attribution_ranks_what_drives_the_series(frame):
    start = dt.datetime(2024, 1, 1)
    r = np.random.default_rng(1)
    rows = []
    for s in "ab":
        u = r.normal(0, 1, 300)
        rows += [(s, start + dt.timedelta(hours=i), i, 300, 1, float(3 * u[i]), float(u[i]), float(r.normal())) for i in range(300)]
    d = frame("series_id string, ts timestamp, pos long, n long, lead int, target double, driver double, noise double", rows)
    got = boosting.tree_attribution(d, ["noise", "driver"], H, K, MIN, FEW).toPandas()
    assert got[got["rank"] == 1]["feature"].tolist() == ["driver"] * 2
    assert set(got["n_rows"]) == {300 - H * K - 1} and len(got) == 4


def test_blocks_grown_together_are_those_grown_alone():
    parts, blocks = [sample(n, n) for n in (90, 41, 160)], []
    codes = [boosting.binned(x, boosting.bin_edges(x, FEW.bins)) for x, _ in parts]
    group = [np.arange(len(y)) % 2 + 2 * i for i, (_, y) in enumerate(parts)]
    blocks = [(len(y), [i]) for i, (_, y) in enumerate(parts)]
    both = boosting.grow_blocks(np.concatenate(codes), np.concatenate(group), np.concatenate([y for _, y in parts]), 6, FEW, blocks)
    for i, (_, y) in enumerate(parts):
        alone = boosting.grow(codes[i], group[i] - 2 * i, y, 2, FEW, [i])
        for name in ("feature", "cut", "value", "cover"):
            assert np.array_equal(getattr(both, name)[:, 2 * i : 2 * i + 2], getattr(alone, name))


def test_batches_hold_whole_blocks(monkeypatch):
    monkeypatch.setattr(boosting, "BATCH_ROWS", 10)
    sizes = [3, 25, 1, 1, 9, 14, 2]
    key = np.repeat(np.arange(len(sizes)), sizes)
    names = [None, "a", "a", "b", "b", "c", "d"]
    rows = pd.DataFrame({"series_id": [names[k] for k in key], "_fit": key % 2, "_block": 0, "at": np.arange(len(key))})
    for step in (1, 4, 100):
        got = list(boosting._batches(iter([rows[i : i + step] for i in range(0, len(rows), step)]), 2))
        assert [len(b) for batch in got for b in batch] == sizes
        assert pd.concat([b for batch in got for b in batch])["at"].tolist() == rows["at"].tolist()
        assert [len(batch) for batch in got] == [2, 3, 1, 1]
    assert list(boosting._batches(iter([]), 2)) == []


def test_leaves_of_all_trees_are_explained_together(monkeypatch):
    x, y = sample(90)
    codes = boosting.binned(x, boosting.bin_edges(x, FEW.bins))
    trees = boosting.grow(codes, np.zeros(len(y), int), y, 1, FEW)
    calls, tables = [], boosting._leaf_tables
    monkeypatch.setattr(boosting, "_leaf_tables", lambda outside: calls.append(len(outside)) or tables(outside))
    got, _ = boosting.shapley(trees, codes)
    assert len(calls) <= FEW.depth and sum(calls) > 30
    monkeypatch.setattr(boosting, "SHAPLEY_CELLS", 1)  # one leaf at a time
    assert np.allclose(boosting.shapley(trees, codes)[0], got, rtol=1e-12, atol=1e-12) and len(calls) > 30


@pytest.mark.parametrize("params", [FEW, Boosting(rounds=7, depth=6, min_rows=1, bins=300, subsample=0.5)])
def test_trees_grow_outside_python_and_are_the_same(frame, monkeypatch, params):
    """Forecasts to the bit, Shapley values to rounding; blocks share a series, one is flat, one has too few rows to split."""
    flat = [(r[0].replace("a", "flat"), *r[1:5], 4.0, *r[6:]) for r in designed(frame, {"a": 90}).collect()]
    d = designed(frame, {"a": 400, "b": 75, "c": 90}, missing={("b", 20)})
    d = d.unionByName(frame(d.schema, flat)).repartition(3)

    def both() -> tuple[list, dict]:
        got = boosting.direct_trees(d, NAMES, H, K, MIN, params, True, block_rows=300).collect()
        shares = boosting.tree_attribution(d, NAMES, H, K, MIN, params, block_rows=300).collect()
        return sorted(map(repr, got)), {(r["series_id"], r["feature"]): (r["mean_abs_shap"], r["n_rows"]) for r in shares}

    with monkeypatch.context() as m:
        for name in ("grow_blocks", "values", "shapley"):
            m.setattr(boosting, name, None)
        made, shares = both()
    monkeypatch.setattr(boosting.native, "trees", lambda spark: None)
    want, want_shares = both()
    assert made == want and len({r for r in made if "y_pred=None" not in r}) == 4 * H * K
    assert {k: pytest.approx(v, rel=1e-9, abs=1e-12) for k, v in shares.items()} == want_shares
