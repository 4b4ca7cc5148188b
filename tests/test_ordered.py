"""Bucketed plans give what plain windows and pandas give."""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from panelkit.operators import features, quality
from panelkit.plans import ordered as o


def _series(seed, n=400, series=3, holes=0.3):
    rng = random.Random(seed)
    rows = []
    for s in range(series):
        for i in range(n if s else 2 * n):
            rows.append((f"s{s}", i, None if rng.random() < holes else round(rng.gauss(0, 5), 1)))
    return rows


@pytest.fixture
def panel(frame):
    return frame("series_id string, pos long, y double", _series(1))


def _sorted(df, cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_position_and_total(panel):
    rows = panel.withColumn("b", F.floor(F.col("pos") / 37)).withColumnRenamed("pos", "k")
    got = o.with_position(rows, ["series_id"], "b", "k")
    assert all(r["pos"] == r["k"] for r in got.collect())
    assert {(r["series_id"], r["n"]) for r in got.collect()} == {("s0", 800), ("s1", 400), ("s2", 400)}


@pytest.mark.parametrize("ahead", [False, True])
def test_previous_equals_window(panel, ahead):
    rows = panel.withColumn("b", F.floor(F.col("pos") / 7))
    w = Window.partitionBy("series_id").orderBy("pos")
    want = panel.withColumn("x", (F.lead if ahead else F.lag)("y").over(w))
    got = o.previous(rows, ["series_id"], "b", "pos", {"x": "y"}, ahead)
    key = ["series_id", "pos"]
    a, b = got.select(*key, "x").toPandas(), want.select(*key, "x").toPandas()
    a, b = a.sort_values(key, ignore_index=True), b.sort_values(key, ignore_index=True)
    pd.testing.assert_frame_equal(a, b)


@pytest.mark.parametrize("rows", [16, 50, 10_000])
def test_over_rows_equals_window(panel, rows):
    def cols(w):
        return {
            "a": F.lag("y", 9).over(w),
            "b": F.lead("y", 5).over(w),
            "c": F.avg("y").over(w.rowsBetween(-8, 0)),
        }

    want = panel.select("*", *[c.alias(k) for k, c in cols(Window.partitionBy("series_id").orderBy("pos")).items()])
    got = o.over_rows(panel, ["series_id"], cols, before=9, after=5, rows=rows)
    key = ["series_id", "pos"]
    a = got.toPandas().sort_values(key, ignore_index=True)
    b = want.toPandas().sort_values(key, ignore_index=True)
    pd.testing.assert_frame_equal(a[b.columns], b)


@pytest.mark.parametrize("limit", [1, 2, 6])
def test_interpolation_equals_pandas(spark, frame, monkeypatch, limit):
    monkeypatch.setattr(quality, "chunk_of", lambda pos="pos": F.floor(F.col(pos) / 13))
    rows = _series(7, n=60, holes=0.6)
    got = quality.interpolate(frame("series_id string, pos long, y double", rows), limit).toPandas()
    src = pd.DataFrame(rows, columns=["series_id", "pos", "y"])
    for sid, g in src.groupby("series_id"):
        want = g.sort_values("pos")["y"].astype(float).interpolate(limit=limit).to_numpy()
        have = got[got.series_id == sid].sort_values("pos")["y"].to_numpy(float)
        np.testing.assert_allclose(have, want, equal_nan=True)


def test_interpolation_fixture(frame):
    y = [None, 1.0, None, None, None, 9.0, None, None, None]
    rows = [("s", i, v) for i, v in enumerate(y)]
    got = quality.interpolate(frame("series_id string, pos long, y double", rows), 2)
    out = [r["y"] for r in sorted(got.collect(), key=lambda r: r["pos"])]
    assert out == [None, 1.0, 3.0, 5.0, None, 9.0, 9.0, 9.0, None]


def test_full_window_mean_fixture(frame):
    y = [0.0, 1.0, 2.0, None, 4.0, 5.0, 6.0, 7.0]
    df = frame("series_id string, pos long, y double", [("s", i, v) for i, v in enumerate(y)])
    got = features.origin_features(df, (0,), (3,))
    out = [r["rollmean_3"] for r in sorted(got.collect(), key=lambda r: r["pos"])]
    assert out == [None, None, 1.0, None, None, None, 5.0, 6.0]


def test_quantiles_equal_numpy(frame):
    rng = np.random.default_rng(3)
    values = {
        "ties": np.round(rng.normal(size=301), 1),
        "spread": np.exp(rng.normal(size=200) * 5) * rng.choice([-1, 1], 200),
        "one": np.array([4.0]),
    }
    rows = [(k, float(v)) for k, a in values.items() for v in a]
    probs = {"lo": 0.025, "q1": 0.25, "med": 0.5, "hi": 0.975}
    got = o.group_quantiles(frame("k string, v double", rows), ["k"], "v", probs)
    for r in got.collect():
        for name, p in probs.items():
            assert r[name] == pytest.approx(np.quantile(values[r["k"]], p), abs=1e-12)


def test_quantile_fixture(frame):
    got = o.group_quantiles(
        frame("k string, v double", [("a", float(i)) for i in range(10)]), ["k"], "v", {"a": 0.25, "b": 0.025, "c": 0.975}
    ).collect()[0]
    assert (got["a"], round(got["b"], 9), round(got["c"], 9)) == (2.25, 0.225, 8.775)


def test_ranks_handle_negative_and_zero(frame):
    v = [-3.0, -1e-9, 0.0, 0.0, 1e-9, 2.0, 2.0, 1e300, -1e300]
    got = o.ranked_values(frame("k string, v double", [("a", x) for x in v]), ["k"], "v")
    before = {r["v"]: (r["before"], r["cnt"], r["total"]) for r in got.collect()}
    for x in v:
        assert before[x] == (sum(y < x for y in v), v.count(x), len(v))


def test_partition_invariance(spark, panel):
    def run():
        f = features.origin_features(panel.withColumn("y", F.coalesce("y", F.lit(0.0))), (1, 5), (9,))
        return _sorted(f, ["series_id", "pos", "ylag_1", "ylag_5", "rollmean_9"])

    def key(rows):
        return [str(r) for r in rows]

    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        out = []
        for n in ("1", "64"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            f = features.origin_features(panel.withColumn("y", F.coalesce("y", F.lit(0.0))), (1, 5), (9,))
            rows = f.select("series_id", "pos", "ylag_1", "ylag_5", "rollmean_9").collect()
            out.append(sorted(map(str, rows)))
        assert out[0] == out[1]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("rows", [1, 16, 500])
@pytest.mark.parametrize("kind", ["mild", "tiny", "negative", "growing", "mixed"])
def test_affine_scan_equals_the_recursion(frame, rows, kind):
    rng = random.Random(rows)
    factor = {"mild": lambda: 0.9, "tiny": lambda: 1e-30, "negative": lambda: -0.7, "growing": lambda: 1.001, "mixed": lambda: rng.choice([0.0, 1.0, -1.5, 0.3, None])}[kind]
    data = [(s, i, factor(), rng.choice([rng.gauss(0, 1), None]) if kind == "mixed" else rng.gauss(0, 1), f"{s}{i}") for s, n in (("a", 700), ("b", 1), ("c", 70)) for i in range(n)]
    df = frame("k string, pos long, f double, add double, tag string", data).repartition(5)
    got = {(r["k"], r["pos"]): r for r in o.affine_scan(df, ["k"], F.col("f"), F.col("add"), "x", rows=rows).collect()}
    assert len(got) == len(data)
    last = {}
    for k, pos, f, add, tag in data:
        x = last.get(k, 0.0)
        last[k] = x if f is None or add is None else f * x + add
        assert got[k, pos]["x"] == pytest.approx(last[k], rel=1e-9, abs=1e-12) and got[k, pos]["tag"] == tag
    empty = o.affine_scan(df.limit(0), ["k"], F.col("f"), F.col("add"), "x")
    assert empty.collect() == [] and empty.columns == [*df.columns, "x"]


def test_affine_scan_needs_no_python(panel):
    plan = o.affine_scan(panel, ["series_id"], F.lit(0.5), F.col("y"), "x")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan


def test_freeze_takes_the_row_before_each_block(frame):
    rng = random.Random(4)
    data = [(s, i, n, rng.random(), rng.choice([None, rng.random()])) for s, n in (("a", 40), ("b", 12), ("c", 7), ("d", 13)) for i in range(n)]
    df = frame("series_id string, pos long, n long, w double, v double", data).repartition(4)
    out = features.freeze_covariates(df, ["w", "v"], folds=3, horizon=4)
    got = {(r["series_id"], r["pos"]): (r["w"], r["v"]) for r in out.collect()}
    assert out.columns == df.columns and len(got) == len(data)
    value = {(s, i): (w, v) for s, i, _, w, v in data}
    for s, i, n, w, v in data:
        into = i - (n - 12)
        origin = (s, i - into % 4 - 1)
        assert got[s, i] == (value[origin] if into >= 0 and origin in value else (w, v))
    assert "collect_list" not in out._jdf.queryExecution().toString()


def test_value_cells_follow_values_far_from_zero(spark):
    n = 1_000_000
    df = spark.range(n).select(F.lit("a").alias("k"), (F.lit(1e9) + F.hash("id") / F.lit(2.0**31)).alias("x"))
    cells = o.value_cells(df, ["k"], "x").groupBy("_bucket").agg(F.count("*").alias("c"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    rows = cells.orderBy("_bucket").collect()
    assert len(rows) > 10_000 and max(r["c"] for r in rows) < n / 1000
    assert all(a["hi"] < b["lo"] for a, b in zip(rows, rows[1:]))
    got = o.group_quantiles(df, ["k"], "x", {"q": 0.37}).collect()[0]
    assert got["n"] == n
    assert got["q"] == pytest.approx(np.quantile(df.toPandas()["x"], 0.37), abs=1e-6)


def test_value_cells_keep_order_over_odd_values(spark):
    rng = random.Random(5)
    values = [float("inf"), float("-inf"), 0.0, -0.0, 5e-324, 1.7e308, -1.7e308, *[3.0] * 40, *[rng.gauss(0, 1) * 10 ** rng.randint(-200, 200) for _ in range(600)]]
    df = spark.createDataFrame([(k, v) for k in ("a", "b") for v in (values if k == "a" else values[:5])], "k string, x double")
    rows = o.value_cells(df, ["k"], "x", rows=50, edges=8, steps=4, copies=3).toPandas().sort_values(["k", "x"])
    assert len(rows) == df.count()
    a = rows[rows.k == "a"]
    assert a["_bucket"].is_monotonic_increasing and a["_bucket"].nunique() > 8
    assert set(rows[rows.k == "b"]["_bucket"]) == {0}


def test_affine_scan_works_out_its_steps_once(panel):
    dear = F.log(F.cos("y"))
    scanned = o.affine_scan(panel, ["series_id"], F.lit(0.5), F.when(F.col("pos") == 0, 1.0).otherwise(0.5) * dear, "x")
    plan = scanned._jdf.queryExecution().optimizedPlan().toString().lower()
    assert plan.count("cos(") <= 3  # one for each reading of the chunks


def test_borders_are_copied_in_generated_code(frame):
    """Where a chunk is shorter than both borders a row belongs to three; no lambda runs for every row."""
    df = frame("k string, pos long, v long", [("a", i, i * i) for i in range(23)])
    out = o.over_rows(df, ["k"], lambda w: {"p": F.lag("v", 3).over(w), "q": F.lead("v", 3).over(w)}, before=3, after=3, rows=4)
    want = {i: ((i - 3) ** 2 if i >= 3 else None, (i + 3) ** 2 if i + 3 < 23 else None) for i in range(23)}
    assert {r["pos"]: (r["p"], r["q"]) for r in out.collect()} == want
    assert "lambdafunction" not in out._jdf.queryExecution().optimizedPlan().toString()
