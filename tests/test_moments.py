"""Moments summed in the tasks, and designs of one row per origin, against the row-by-lead forms."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelkit.operators import backtest as b
from panelkit.operators import features, moments

HORIZON, FOLDS = 2, 3


@pytest.fixture
def panel(frame):
    """Three series, one of them with gaps in both columns, one too short for every fold."""
    r = np.random.default_rng(11)
    start, rows = dt.datetime(2024, 1, 1), []
    for s, n in (("a", 60), ("b", 50), ("c", 5)):
        for i in range(n):
            y, x = float(r.normal()) + 1e6, float(r.normal())
            gap = s == "b" and i % 7 == 3
            rows.append((s, start + dt.timedelta(days=9 * i), None if gap else y, None if s == "b" and i % 11 == 5 else x, i, n))
    return frame("series_id string, ts timestamp, y double, x double, pos long, n long", rows).repartition(5)


def by_key(df, *keys):
    return {tuple(r[k] for k in keys): r for r in df.collect()}


@pytest.mark.parametrize("held", [moments.HELD, 3])
def test_wide_rows_give_the_fits_of_rows_by_lead(spark, panel, monkeypatch, held):
    monkeypatch.setattr(moments, "HELD", held)
    leads = (1, 2)
    long = features.design(panel, leads, ["x"], "both", lags=(0, 1), rolls=())
    first = b.first_fold(HORIZON, FOLDS, F.col("lead"))
    wide = features.wide_design(panel, leads, ["x"], lags=(0, 1), rolls=())
    names = {"causal": ["ylag_1", "futcal_month_{lead}", "cov0_x"], "perfect": ["ylag_1", "futcal_month_{lead}", "fut_x_{lead}"]}
    both = b.solve_ridge(b.moments_by_lead(wide, names, leads, HORIZON, FOLDS, "model"), 3)
    for model, cov in (("causal", "cov0_x"), ("perfect", "fut_x")):
        want = by_key(b.solve_ridge(b.moments_by_fold(long, ["series_id", "lead"], ["ylag_1", "futcal_month", cov], "target", first, FOLDS), 3), "series_id", "lead", "fold")
        got = by_key(both.filter(F.col("model") == model), "series_id", "lead", "fold")
        assert set(got) == set(want) and len(got) >= 12
        for k, w in want.items():
            assert got[k]["n_rows"] == w["n_rows"]
            assert np.allclose(got[k]["beta"], w["beta"], rtol=1e-9, atol=1e-9)
        for (s, lead, fold), g in got.items():
            rows = long.filter((F.col("series_id") == s) & (F.col("lead") == lead) & (first <= fold))
            assert g["n_rows"] == rows.dropna(subset=["ylag_1", "futcal_month", cov, "target"]).count()


def test_contributions_of_wide_rows(panel):
    leads, end = (1, 2), b.first_test_pos(HORIZON, FOLDS)
    named = {"ylag_1": "ylag_1", "futcal_month": "futcal_month_{lead}", "cov0_x": "cov0_x"}
    long = features.design(panel, leads, ["x"], "causal", lags=(0, 1), rolls=()).filter(F.col("pos") + F.col("lead") < end)
    wide = features.wide_design(panel, leads, ["x"], lags=(0, 1), rolls=())
    fits = b.solve_ridge(b.moments(long, ["series_id", "lead"], list(named), "target"), 3)
    want = by_key(b.contributions(long, fits, list(named), ["series_id", "lead"], top=3), "feature")
    got = by_key(b.contributions_by_lead(wide, fits, named, leads, end, top=3), "feature")
    assert set(got) == set(want) and len(got) == 3
    for k, w in want.items():
        assert got[k]["mean_abs"] == pytest.approx(w["mean_abs"], rel=1e-9)


def test_configs_of_the_ridge_share_their_passes(spark):
    """The panel goes by twice, for the moments and for the origins, not twice for each configuration."""
    from panelkit.registry import common, comparisons

    plan = comparisons._config_predictions(common.panel(spark, "/root/testdata/sf0.001"))
    assert plan._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 2
