from __future__ import annotations

from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelkit.functions.columns import circular_difference, floor_mod, hashed_integer
from panelkit.operators import features, joins, quality

T0 = datetime(2024, 1, 1)
RAW = "series_id string, ts timestamp, y double, seq long"


def _hours(sid, offsets, y=None):
    return [(sid, T0 + timedelta(hours=h), float(y[i] if y else i + 1), i) for i, h in enumerate(offsets)]


def test_gap_of_exactly_48_hours_stays(frame):
    df = frame(RAW, _hours("a", [0, 48, 96.0001]))
    got = quality.gap_segments(df).orderBy("ts").collect()
    assert [r["segment"] for r in got] == [0, 0, 1]


def test_segment_tie_goes_to_earliest(frame):
    df = frame(RAW, _hours("a", [0, 1, 2, 100, 101, 102]))
    best = quality.longest_segments(quality.gap_segments(df)).collect()[0]
    assert (best["segment"], best["n_obs"]) == (0, 3)


def test_first_reading_before_sanitising(frame):
    df = frame(RAW, [("a", T0, 5.0, 2), ("a", T0, 9.0, 1), ("a", T0 + timedelta(hours=1), 3.0, 3)])
    got = {r["ts"]: r["y"] for r in quality.first_reading(df, "seq").collect()}
    assert got == {T0: 9.0, T0 + timedelta(hours=1): 3.0}


@pytest.mark.parametrize(
    "minutes,fast",
    [([0, 30, 60, 90], True), ([0, 60, 120, 180], False), ([0, 30], False), ([0, 30, 90], False), ([0, 20, 80], True)],
)
def test_subhourly_flag(frame, minutes, fast):
    """Even gap counts put the limit between the two middle gaps."""
    df = frame(RAW, _hours("a", [m / 60 for m in minutes]))
    want = len(minutes) >= 3 and np.median(np.diff(minutes)) < 45
    assert want == fast
    assert quality.sampling_profile(df).collect()[0]["is_subhourly"] == fast


def _pandas_window(s, limit=6, break_h=48):
    """Brute force on one series, straight from the definition."""
    s = s.sort_index()
    seg = (s.index.to_series().diff() > pd.Timedelta(hours=break_h)).cumsum()
    sizes = seg.value_counts().sort_index()
    best = s[seg == sizes.idxmax()]
    return best.asfreq("h").interpolate(limit=limit).dropna()


@pytest.mark.parametrize("seed", range(4))
def test_usable_window_against_brute_force(frame, seed):
    rng = np.random.default_rng(seed)
    rows, want = [], {}
    for sid in ("a", "b", "c"):
        gaps = rng.choice([1, 1, 1, 2, 3, 9, 20, 60], size=150)
        at = np.cumsum(gaps)
        off = rng.random(150) < 0.1
        ts = [T0 + timedelta(hours=int(h), minutes=20 if o else 0) for h, o in zip(at, off)]
        y = np.round(rng.uniform(1, 50, 150), 2)
        rows += [(sid, t, float(v), i) for i, (t, v) in enumerate(zip(ts, y))]
        want[sid] = _pandas_window(pd.Series(y, index=pd.DatetimeIndex(ts)))
    got = quality.usable_window(frame(RAW, rows), min_rows=1, min_cov=0.0).toPandas()
    for sid, w in want.items():
        g = got[got.series_id == sid].sort_values("pos")
        assert list(g["pos"]) == list(range(len(w))) and set(g["n"]) == {len(w)}
        assert list(pd.DatetimeIndex(g["ts"])) == list(w.index)
        np.testing.assert_allclose(g["y"].to_numpy(), w.to_numpy())


def test_gate_rejects_with_reason(frame):
    rows = _hours("short", range(5)) + _hours("sparse", range(0, 400, 20)) + _hours("bad", range(3), [0, -1, 999])
    df = frame(RAW, rows)
    got = {r["series_id"]: r["reject_reason"] for r in quality.rejected_series(df, min_rows=10).collect()}
    assert got == {"short": "too few rows", "sparse": "too sparse", "bad": "no valid reading"}
    assert quality.usable_window(df, min_rows=10).count() == 0


def test_strict_and_filled_covariates(frame):
    panel = frame("series_id string, ts timestamp, y double, pos long, n long",
                  [("a", T0 + timedelta(hours=h), 1.0, h, 12) for h in range(12)])
    cov = frame("series_id string, ts timestamp, w double", [("a", T0 + timedelta(hours=2), 5.0), ("a", T0 + timedelta(hours=3), 6.0)])
    strict = joins.attach_covariates_filled(panel, cov, ["w"], limit=2).orderBy("pos").collect()
    assert [r["w"] for r in strict] == [None, None, 5.0, 6.0, 6.0, 6.0] + [None] * 6
    loose = joins.attach_covariates_filled(panel, cov, ["w"], limit=2, strict=False).orderBy("pos").collect()
    assert [r["w"] for r in loose] == [5.0, 5.0, 5.0] + [6.0] * 9
    assert [r["w_is_filled"] for r in loose] == [True, True] + [False] * 4 + [True] * 6


def test_calendar_and_modulus(frame):
    df = frame("series_id string, ts timestamp", [("a", datetime(2024, 1, 6, 13))])
    r = features.with_calendar(df).collect()[0]
    assert (r["dow"], r["is_weekend"], r["hour"], r["month"]) == (5, 1, 13, 1)
    m = df.select(
        floor_mod(F.lit(-5), 360).alias("m"), circular_difference(F.lit(350.0), F.lit(10.0)).alias("c")
    ).collect()[0]
    assert (m["m"], m["c"]) == (355, -20.0)


def test_hashed_draws(spark):
    got = spark.range(5).select((hashed_integer(7, F.col("id")) % 29).alias("d"), "id").orderBy("id").collect()
    assert [r["d"] for r in got] == [3, 9, 25, 15, 0]


def _hot_and_cold(frame):
    """One series holds most rows, packed into a few hours."""
    rng = np.random.default_rng(11)
    hot = np.sort(rng.choice(6 * 3600, 4000, replace=False))
    rows = [("hot", T0 + timedelta(seconds=int(s)), float(i % 50 + 1), i) for i, s in enumerate(hot)]
    for sid in ("cold", "mild"):
        at = np.cumsum(rng.choice([1, 1, 2, 60], 40))
        rows += [(sid, T0 + timedelta(hours=int(h)), float(h % 9 + 1), i) for i, h in enumerate(at)]
    return frame(RAW, rows)


@pytest.mark.parametrize("width", [60, 3600, 30 * 86400])
def test_bucket_width_does_not_change_results(frame, width):
    """Buckets are a matter of load, never of the answer."""
    df = _hot_and_cold(frame)
    plain = df.drop("seq")

    def rows(d):
        return sorted(map(str, d.collect()))

    wide = 365 * 86400
    for op in (quality.observation_gaps, quality.sampling_profile, quality.resample_subhourly):
        assert rows(op(plain, bucket_seconds=width)) == rows(op(plain, bucket_seconds=wide))
    assert rows(quality.gap_segments(plain, bucket_seconds=width)) == rows(
        quality.gap_segments(plain, bucket_seconds=wide)
    )
    hourly = quality.resample_subhourly(plain).withColumn("seq", F.lit(0))
    a = quality.usable_window(hourly, min_rows=1, min_cov=0.0, bucket_seconds=width)
    b = quality.usable_window(hourly, min_rows=1, min_cov=0.0, bucket_seconds=wide)
    assert rows(a) == rows(b)


def test_suggested_buckets_follow_density(frame):
    df = _hot_and_cold(frame)
    narrow = quality.suggest_bucket_seconds(df, target_rows=100)
    assert 60 <= narrow <= 1200
    assert quality.suggest_bucket_seconds(df, target_rows=10_000_000) == 86400


def test_rows_never_meet_a_whole_series_window(spark, frame):
    """Every window over rows is keyed by the bucket as well as the series."""
    df = _hot_and_cold(frame)
    plan = quality.resample_subhourly(df.drop("seq"))._jdf.queryExecution().executedPlan().toString()
    row_windows = [x for x in plan.splitlines() if " Window " in x and "lag(ts" in x]
    assert row_windows and all("_b#" in x.split("windowspecdefinition(")[1].split(" ASC")[0] for x in row_windows)


def test_dense_series_get_narrow_buckets(frame, monkeypatch):
    """One hot series: by default no (series, bucket) holds more than the target rows."""
    rows = [("hot", datetime(2024, 1, 1, 0, i // 60, i % 60), float(i), i) for i in range(1200)]
    rows += [("cold", datetime(2024, 1, 1, i), float(i), i) for i in range(12)]
    df = frame("series_id string, ts timestamp, y double, seq long", rows)
    choose = quality.suggest_bucket_seconds
    monkeypatch.setattr(quality, "suggest_bucket_seconds", lambda d, target_rows=60, widest=86400: choose(d, 60, widest))
    width = quality.bucket_width(df, None, 86400)
    most = df.groupBy("series_id", quality.time_bucket("ts", width).alias("b")).count().agg({"count": "max"}).first()[0]
    assert most <= 180 and width < 3600
    same = [sorted(map(tuple, op.collect())) for op in (quality.gap_segments(df), quality.gap_segments(df, bucket_seconds=86400))]
    assert same[0] == same[1]
