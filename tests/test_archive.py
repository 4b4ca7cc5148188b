"""Forecast archives, recency cuts, calibration bins and map-side bootstrap sums."""

from __future__ import annotations

import datetime as dt
import hashlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from panelkit.functions import forecasters
from panelkit.operators import backtest, covariates, quality, resample
from panelkit.sources import files


def test_leads_are_read_off_the_names():
    columns = ["series_id", "ts", "t2m", "t2m_previous_day1", "t2m_previous_day12", "rain_previous_day1", "t2m_previous_dayx", "wind"]
    assert covariates.archive_leads(columns) == [("t2m", 1, "t2m_previous_day1"), ("t2m", 12, "t2m_previous_day12")]


def test_pairs_of_files_with_different_leads(spark, tmp_path):
    days = [dt.datetime(2024, 1, 1) + dt.timedelta(hours=6 * i) for i in range(300)]
    with open(tmp_path / "oslo.csv", "w") as f:
        f.write("time,t2m,t2m_previous_day1,t2m_previous_day2,wind_direction_10m\n")
        for i, day in enumerate(days):
            f.write(f"{day:%Y-%m-%d %H:%M:%S},{i},{'' if i % 10 == 3 else i + 0.5},{'NaN' if i % 7 == 2 else i - 1},{i % 360}\n")
    with open(tmp_path / "rome.csv", "w") as f:
        f.write("time,wind_direction_10m,wind_direction_10m_previous_day3\n")
        for i, day in enumerate(days):
            f.write(f"{day:%Y-%m-%d %H:%M:%S},{350},{10}\n")
    wide = files.archive_csv(spark, str(tmp_path))
    pairs = covariates.archive_pairs(wide)
    got = {}
    for r in pairs.collect():
        got.setdefault((r["series_id"], r["variable"], r["lead_day"]), []).append((r["pos"], r["ts"], r["actual"], r["predicted"]))
    assert {k: len(v) for k, v in got.items()} == {
        ("oslo", "t2m", 1): 270, ("oslo", "t2m", 2): sum(i % 7 != 2 for i in range(300)), ("rome", "wind_direction_10m", 3): 300,
    }
    for rows in got.values():
        rows.sort()
        assert [p for p, *_ in rows] == list(range(len(rows))) and rows == sorted(rows, key=lambda x: x[1])
    assert all(p - a == 0.5 for _, _, a, p in got["oslo", "t2m", 1])
    profile = {(r["series_id"], r["lead_day"]): r for r in covariates.error_profile(pairs).collect()}
    assert profile["rome", 3]["bias"] == pytest.approx(20.0)  # across north


def test_archives_without_forecasts_are_empty(frame):
    wide = frame("series_id string, ts timestamp, t2m double", [("a", dt.datetime(2024, 1, 1), 1.0)])
    assert covariates.archive_pairs(wide).collect() == []


def test_rows_since_a_cutoff(frame):
    start = dt.datetime(2024, 1, 1)
    data = [(s, start + dt.timedelta(days=i), float(i), i, n) for s, n in (("long", 50), ("short", 33), ("old", 20)) for i in range(n)]
    panel = frame("series_id string, ts timestamp, y double, pos long, n long", data)
    rows, rejects = backtest.rows_since(panel, "2024-01-31", 10)
    kept = sorted(map(tuple, rows.collect()))
    assert [r[3] for r in kept] == list(range(20)) and {r[4] for r in kept} == {20} and kept[0][1] == dt.datetime(2024, 1, 31)
    assert sorted((r["series_id"], r["rows_since"], r["reject_reason"]) for r in rejects.collect()) == [
        ("old", 0, "rows since cutoff 0 < 10"), ("short", 3, "rows since cutoff 3 < 10"),
    ]


def test_residual_plugin_adds_the_effect_back_and_isolates_failures(frame):
    rng = np.random.default_rng(3)
    data = []
    for s in ("a", "b"):
        for i in range(120):
            w = float(rng.normal())
            data.append((s, dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), 5.0 * w + 100.0, w, i, 120))
    panel = frame("series_id string, ts timestamp, y double, w double, pos long, n long", data)
    effects = backtest.covariate_effect(panel, ["w"], 4, 3)
    done, failed = backtest.residual_plugin(panel, effects, ["w"], forecasters.repeat_last, 4, 3, 52)
    rows = done.collect()
    # nothing but the covariate moves the series: the residual is flat up to the ridge's shrinkage
    assert len(rows) == 24 and all(abs(r["y_pred"] - r["y_true"]) < 0.5 for r in rows) and failed.collect() == []

    def breaks(context, horizon):
        raise ValueError("no model")

    done, failed = backtest.residual_plugin(panel, effects, ["w"], breaks, 4, 3, 52)
    assert done.collect() == [] and len(failed.collect()) == 6


def test_calibration_needs_ten_bins(frame):
    rows = [("full", i / 100, i % 2) for i in range(101)] + [("half", i / 200, 1) for i in range(100)] + [("half", None, 1), ("half", 1.5, 1), ("half", 0.9, None)]
    got = {r["k"]: r for r in quality.calibration_bins(frame("k string, p double, hit int", rows), ["k"], "p", "hit").collect()}
    assert got["full"]["n_bins"] == 10 and got["full"]["enough_bins"] and got["full"]["n"] == 101
    assert got["half"]["n_bins"] == 5 and not got["half"]["enough_bins"] and got["half"]["widest_miss"] == pytest.approx(1 - 0.0475, abs=1e-6)


def test_weights_follow_the_hashes():
    got = resample.weights(["x", None], 6, 7)
    for row, tail in enumerate(("|x", "")):
        for rep in range(6):
            h = hashlib.md5(f"7|{rep // 4}{tail}".encode()).hexdigest()[8 * (rep % 4) : 8 * (rep % 4) + 8]
            u = (int(h, 16) + 0.5) / 2**32
            assert got[row, rep] == sum(u > p for p in resample.POISSON)


def test_replicates_hand_on_many_groups(frame, monkeypatch):
    rows = [(i % 40, None if i % 9 == 0 else i % 5, f"r{i}", float(i)) for i in range(300)]
    df = frame("g long, h int, id string, x double", rows).repartition(3)
    got = {(r["g"], r["h"], r["_rep"]): r for r in resample.replicates(df, ["g", "h"], "id", {"s": F.col("x")}, 10, 7).collect()}
    w = resample.weights([r[2] for r in rows], 10, 7)
    want = {}
    for i, (g, h, _, x) in enumerate(rows):
        for rep in range(10):
            n, weight, s = want.get((g, h, rep), (0, 0.0, 0.0))
            want[g, h, rep] = n + 1, weight + w[i, rep], s + w[i, rep] * x
    assert got.keys() == want.keys()
    for k, (n, weight, s) in want.items():
        assert (got[k]["n"], got[k]["_w"]) == (n, weight) and got[k]["s"] == pytest.approx(s)


def test_weights_are_drawn_once_for_all_groups(frame, monkeypatch):
    """The rows of an id meet in one task, where its weights serve every group."""
    df = frame("g long, id string, x double", [(g, f"r{i}", float(g * i)) for g in range(6) for i in range(50)])
    plan = resample.replicates(df, ["g"], "id", {"s": F.col("x")}, 10, 7)._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [_id" in plan
    drawn, own = [], resample.weights
    monkeypatch.setattr(resample, "weights", lambda ids, *a: drawn.extend(ids) or own(ids, *a))
    batch = pa.RecordBatch.from_pandas(df.orderBy("id").toPandas(), preserve_index=False)
    fields = [("g", pa.int64()), ("_rep", pa.int32()), ("n", pa.int64()), ("_w", pa.float64()), ("s", pa.float64())]
    out = pa.Table.from_batches(resample._sums(1, 1, 10, 7, pa.schema(fields))(iter([batch]))).to_pydict()
    assert sorted(drawn) == sorted(f"r{i}" for i in range(50))
    w = own([f"r{i}" for i in range(50)], 10, 7)
    assert out["s"] == pytest.approx([g * sum(w[i, rep] * i for i in range(50)) for g in out["g"][::10] for rep in range(10)])
