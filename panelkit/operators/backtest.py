"""Rolling-origin folds and forecasters.

Test blocks are the last K * H rows of a series, so everything a forecaster
needs at prediction time is bounded per series (K * H rows plus its look-back)
and is cut out by a filter on ``pos`` before any shuffle.  Training statistics
are sums with map-side partials.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelkit.operators.moments import Fit, merged_parts, numbers, partial_moments
from panelkit.plans.ordered import chunk_of, spread
from panelkit.session import fanned_out, settled

KEY = ["series_id"]
#: Training rows that one task of the pooled trees holds and reads in every pass.
TREE_ROWS = 500_000


def first_test_pos(horizon: int, folds: int, n: str = "n") -> Column:
    """Train rows end where the first scheduled fold begins."""
    return F.col(n) - folds * horizon


def first_train_end(horizon: int, folds: int, min_train: int, n: str = "n") -> Column:
    """Train end of the first fold that is kept (null when none is)."""
    ends = [
        F.when(F.col(n) - k * horizon > min_train, F.col(n) - k * horizon)
        for k in range(folds, 0, -1)
    ]
    return F.coalesce(*ends)


def fold_table(panel: DataFrame, horizon: int, folds: int, min_train: int) -> DataFrame:
    """One row per series and fold: origin and test positions."""
    sizes = panel.groupBy(*KEY).agg(F.max("n").alias("n"))
    f = sizes.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    end = F.col("n") - (F.lit(folds) - F.col("fold")) * horizon
    f = f.withColumns({"pos_lo": end, "pos_hi": end + horizon, "origin_pos": end - 1})
    return f.filter(F.col("pos_lo") > min_train)


def test_rows(panel: DataFrame, horizon: int, folds: int, min_train: int) -> DataFrame:
    """Rows of the kept test blocks with fold (0-based) and lead (1-based)."""
    into = F.col("pos") - first_test_pos(horizon, folds)
    t = panel.filter(into >= 0)
    t = t.withColumns(
        {
            "fold": F.floor(into / horizon).cast("int"),
            "lead": (into % horizon + 1).cast("int"),
        }
    )
    train_end = first_test_pos(horizon, folds) + F.col("fold") * horizon
    return t.filter(train_end > min_train)


def train_rows(panel: DataFrame, horizon: int, folds: int, min_train: int) -> DataFrame:
    return panel.filter(F.col("pos") < first_train_end(horizon, folds, min_train))


def recent_rows(panel: DataFrame, horizon: int, folds: int, lookback: int) -> DataFrame:
    """The test rows and ``lookback`` rows before them: bounded per series."""
    return panel.filter(F.col("pos") >= first_test_pos(horizon, folds) - lookback)


def _as_predictions(df: DataFrame, model: str) -> DataFrame:
    return df.select(
        "series_id",
        F.lit(model).alias("model"),
        "fold",
        "lead",
        "pos",
        "ts",
        F.col("y").alias("y_true"),
        "y_pred",
    )


def seasonal_naive(
    panel: DataFrame,
    horizon: int,
    folds: int,
    min_train: int,
    long_season: int = 168,
    model: str = "seasonal_naive",
) -> DataFrame:
    """The value one long season (in rows) before the target.

    A fold whose history is shorter than the season repeats the value at its origin.
    """
    if horizon > long_season:
        raise ValueError("horizon must not exceed the long season")
    r = recent_rows(panel, horizon, folds, long_season)
    # bounded partition: folds * horizon + long_season rows per series
    w = Window.partitionBy(*KEY).orderBy("pos")
    r = r.withColumns({"_lag": F.lag("y", long_season).over(w), "_origin": _at_origin(horizon, folds, w)})
    t = test_rows(r, horizon, folds, min_train)
    return _as_predictions(t.withColumn("y_pred", _naive_value("_lag", "_origin", long_season)), model)


def _at_origin(horizon: int, folds: int, w: Window) -> Column:
    """The value at the origin of a test row's fold, over the rows of a series in order."""
    into = F.col("pos") - first_test_pos(horizon, folds)
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    return F.last(F.when((into + 1) % horizon == 0, F.col("y")), True).over(past)


def _naive_value(lagged: str, origin: str, long_season: int) -> Column:
    train_end = F.col("pos") - F.col("lead") + 1
    return F.when(train_end >= long_season, F.col(lagged)).otherwise(F.col(origin))


def seasonal_mean(
    panel: DataFrame,
    horizon: int,
    folds: int,
    min_train: int,
    season: int = 24,
    cycles: int = 7,
    model: str = "seasonal_mean",
) -> DataFrame:
    """Mean of the values ``season * 1 .. season * cycles`` rows back.

    Offsets shorter than the distance to the origin are skipped, so no value
    of the test block is used.
    """
    r = recent_rows(panel, horizon, folds, season * cycles)
    w = Window.partitionBy(*KEY).orderBy("pos")
    lags = [(season * j, F.lag("y", season * j).over(w)) for j in range(1, cycles + 1)]
    r = r.select("*", *[c.alias(f"_l{k}") for k, c in lags])
    t = test_rows(r, horizon, folds, min_train)
    seen = F.array(*[F.when(F.col("lead") <= k, F.col(f"_l{k}")) for k, _ in lags])
    seen = F.array_compact(seen)
    total = F.aggregate(seen, F.lit(0.0), lambda a, x: a + x)
    mean = F.when(F.size(seen) > 0, total / F.size(seen))
    return _as_predictions(t.withColumn("y_pred", mean), model)


def last_value(
    panel: DataFrame, horizon: int, folds: int, min_train: int, model: str = "last_value"
) -> DataFrame:
    """The value at each fold's origin."""
    r = recent_rows(panel, horizon, folds, 1)
    w = Window.partitionBy(*KEY).orderBy("pos")
    t = test_rows(r.withColumn("y_pred", _at_origin(horizon, folds, w)), horizon, folds, min_train)
    return _as_predictions(t, model)


def baselines(
    panel: DataFrame,
    horizon: int,
    folds: int,
    min_train: int,
    season: int = 24,
    cycles: int = 7,
    long_season: int = 168,
) -> DataFrame:
    """seasonal_naive, seasonal_mean and last_value from one window pass.

    The same rows as the three single forecasters; the bounded tail of each
    series is shuffled and sorted once, then emitted once per model.
    """
    if horizon > long_season:
        raise ValueError("horizon must not exceed the long season")
    r = recent_rows(panel, horizon, folds, max(long_season, season * cycles))
    w = Window.partitionBy(*KEY).orderBy("pos")
    steps = [season * j for j in range(1, cycles + 1)]
    r = r.select(
        "*",
        F.lag("y", long_season).over(w).alias("_naive"),
        _at_origin(horizon, folds, w).alias("_origin"),
        *[F.lag("y", k).over(w).alias(f"_l{k}") for k in steps],
    )
    t = test_rows(r, horizon, folds, min_train)
    seen = F.array_compact(F.array(*[F.when(F.col("lead") <= k, F.col(f"_l{k}")) for k in steps]))
    mean = F.when(
        F.size(seen) > 0, F.aggregate(seen, F.lit(0.0), lambda a, x: a + x) / F.size(seen)
    )
    items = [
        F.struct(F.lit(m).alias("model"), c.alias("y_pred"))
        for m, c in (
            ("seasonal_naive", _naive_value("_naive", "_origin", long_season)),
            ("seasonal_mean", mean),
            ("last_value", F.col("_origin")),
        )
    ]
    t = t.select(
        "series_id", "fold", "lead", "pos", "ts", F.col("y").alias("y_true"), F.inline(F.array(*items))
    )
    return t.select("series_id", "model", "fold", "lead", "pos", "ts", "y_true", "y_pred")


# --- linear models from sums ------------------------------------------------


def moments(df: DataFrame, keys: Sequence[str], features: Sequence[str], target: str) -> DataFrame:
    """Moments of complete rows; every task hands on parts, which the solver merges."""
    parts = partial_moments(df, keys, [Fit((), tuple(features), target)])
    return parts.groupBy(*keys).agg(F.collect_list("m_part").alias("m_parts"))


def first_fold(horizon: int, folds: int, ahead: Column | int = 0) -> Column:
    """The first fold that may train on a row whose target lies ``ahead`` rows on."""
    into = F.col("pos") + ahead - first_test_pos(horizon, folds)
    return F.when(into < 0, F.lit(0)).otherwise(F.floor(into / horizon) + 1).cast("int")


def moments_by_fold(
    df: DataFrame,
    keys: Sequence[str],
    features: Sequence[str],
    target: str,
    first_fold: Column,
    folds: int,
) -> DataFrame:
    """Cumulative moments: fold f holds every row usable by fold f or earlier."""
    fit = Fit((), tuple(features), target, "_fold")
    return _cumulative(partial_moments(df.withColumn("_fold", first_fold), keys, [fit], folds=folds), keys, folds)


def moments_by_lead(
    origins: DataFrame, variants: dict[str, Sequence[str]], leads: Sequence[int], horizon: int, folds: int, name: str | None = None
) -> DataFrame:
    """``moments_by_fold`` of every series and lead from one row per origin (``features.wide_design``).

    ``variants`` are feature sets of equal length, told apart by the column ``name``;
    ``{lead}`` in a feature's name stands for the lead.  The rows go by once for all of them.
    """
    rows = origins.withColumns({f"_fold_{h}": first_fold(horizon, folds, h) for h in leads})
    fits = [
        Fit((h, v) if name else (h,), tuple(f.format(lead=h) for f in features), f"target_{h}", f"_fold_{h}")
        for h in leads
        for v, features in variants.items()
    ]
    labels = [T.StructField("lead", T.IntegerType()), *([T.StructField(name, T.StringType())] if name else [])]
    keys = [*KEY, "lead", *([name] if name else [])]
    return _cumulative(partial_moments(rows, KEY, fits, labels, folds), keys, folds)


def _cumulative(parts: DataFrame, keys: Sequence[str], folds: int) -> DataFrame:
    """The parts of every fold, those of earlier folds included.

    Each row is reduced once, at the first fold that may train on it.  The parts of a
    key (few for each fold and task) meet once; later folds take them over and the
    solver merges them.
    """
    m = parts.groupBy(*keys).agg(F.collect_list(F.struct("fold", "m_part")).alias("_parts"))
    earliest = F.array_min(F.transform("_parts", lambda p: p["fold"]))
    m = m.withColumn("fold", F.explode(F.sequence(earliest, F.lit(folds - 1))))
    usable = F.filter("_parts", lambda p: p["fold"] <= F.col("fold"))
    return m.select(*keys, "fold", F.transform(usable, lambda p: p["m_part"]).alias("m_parts"))


_FIT = T.StructType(
    [
        T.StructField("n_rows", T.DoubleType()),
        T.StructField("intercept", T.DoubleType()),
        T.StructField("beta", T.ArrayType(T.DoubleType())),
        T.StructField("mean_x", T.ArrayType(T.DoubleType())),
    ]
)


def solve_ridge(
    sums: DataFrame,
    n_features: int,
    alpha: float = 1.0,
    min_rows: int = 1,
    standardise: bool = True,
    flat_mean: bool = True,
) -> DataFrame:
    """Ridge coefficients from moment rows, on the raw feature scale.

    Features are standardised with the population deviation (0 counts as 1),
    the intercept is not penalised.  A feature without spread has no effect; a key
    whose features all lack it is fit by the mean of its target (``flat_mean``) or by
    zero, as is a key of fewer than ``min_rows`` rows always.  The solve is a k x k
    system per row, done batch-wise on already aggregated rows.
    """
    k = n_features

    @F.arrow_udf(_FIT)
    def fit(m: pa.Array) -> pa.Array:
        offsets = m.offsets.to_numpy()
        one = merged_parts(numbers(m.flatten(), k), offsets[:-1] - offsets[0], k)
        n, my, mx, xy = one[:, 0], one[:, 1], one[:, 2 : 2 + k], one[:, 2 + k : 2 + 2 * k]
        gram = np.zeros((len(one), k, k))
        upper = np.triu_indices(k)
        gram[:, upper[0], upper[1]] = gram[:, upper[1], upper[0]] = one[:, 2 + 2 * k :]
        var = np.maximum(np.einsum("nii->ni", gram) / n[:, None], 0.0)
        flat = var <= 1e-24 * mx * mx
        sd = np.where(flat, 1.0, np.sqrt(var)) if standardise else np.ones_like(var)
        z = gram / (sd[:, :, None] * sd[:, None, :])
        z[np.repeat(flat[:, :, None], k, 2) | np.repeat(flat[:, None, :], k, 1)] = 0.0
        rhs = np.where(flat, 0.0, xy / sd)
        beta = np.linalg.solve(z + alpha * np.eye(k), rhs[:, :, None])[:, :, 0] / sd
        enough = n >= min_rows
        usable = enough & ~flat.all(axis=1)
        beta = np.where(usable[:, None], beta, 0.0)
        level = np.where(usable, my - (beta * mx).sum(axis=1), np.where(enough & flat_mean, my, 0.0))
        ends = pa.array(np.arange(0, mx.size + 1, k, dtype=np.int32))
        lists = [pa.ListArray.from_arrays(ends, pa.array(np.ascontiguousarray(v).ravel())) for v in (beta, mx)]
        return pa.StructArray.from_arrays([pa.array(n), pa.array(level), *lists], names=["n_rows", "intercept", "beta", "mean_x"])

    keys = [c for c in sums.columns if c != "m_parts"]
    return sums.select(*keys, fit("m_parts").alias("fit")).select(*keys, "fit.n_rows", "fit.intercept", "fit.beta", "fit.mean_x")


def linear_value(features: Sequence[str]) -> Column:
    """intercept + sum(beta_i * x_i) over the joined coefficients."""
    total = F.col("intercept")
    for i, f in enumerate(features):
        total = total + F.get("beta", F.lit(i)) * F.col(f).cast("double")
    return total


def direct_ridge(
    design_rows: DataFrame,
    features: Sequence[str],
    horizon: int,
    folds: int,
    min_train: int,
    alpha: float = 1.0,
    per_fold: bool = True,
    since_pos: Column | None = None,
    model: str = "direct_ridge",
) -> DataFrame:
    """One linear model per series, lead and fold, predicted at the origins.

    ``design_rows`` come from ``features.design``.  A row trains a fold when
    its target lies before the fold (pos + lead < train end); all folds are fit
    from a single pass.  ``per_fold=False`` fits once, on the first fold.
    ``since_pos`` restricts training to recent rows (budget refits).
    """
    rows = design_rows if since_pos is None else design_rows.filter(F.col("pos") >= since_pos)
    if per_fold:
        opened = first_fold(horizon, folds, F.col("lead"))
        sums = moments_by_fold(rows, ["series_id", "lead"], features, "target", opened, folds)
    else:
        limit = first_train_end(horizon, folds, min_train)
        m = moments(rows.filter(F.col("pos") + F.col("lead") < limit), ["series_id", "lead"], features, "target")
        sums = m.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    return ridge_forecasts(design_rows, sums, features, horizon, folds, min_train, alpha, F.lit(model))


def ridge_forecasts(
    design_rows: DataFrame,
    sums: DataFrame,
    features: Sequence[str],
    horizon: int,
    folds: int,
    min_train: int,
    alpha: float,
    model: Column,
) -> DataFrame:
    """Forecasts at the origins of every fold by the fits of ``sums``; of the ``design_rows`` only the origins' are used."""
    fits = solve_ridge(sums, len(features), alpha)
    origin = F.col("pos") + 1 - first_test_pos(horizon, folds)
    origins = design_rows.filter((origin >= 0) & (origin % horizon == 0) & F.col("target").isNotNull())
    origins = origins.withColumn("fold", F.floor(origin / horizon).cast("int"))
    origins = origins.filter(F.col("pos") + 1 > min_train)
    j = origins.join(fits, [c for c in sums.columns if c != "m_parts"])
    return j.select(
        "series_id",
        model.alias("model"),
        "fold",
        "lead",
        (F.col("pos") + F.col("lead")).alias("pos"),
        F.col("target_ts").alias("ts"),
        F.col("target").alias("y_true"),
        linear_value(features).alias("y_pred"),
    )


def covariate_effect(
    panel: DataFrame,
    features: Sequence[str],
    horizon: int,
    folds: int,
    alpha: float = 1.0,
    min_rows: int = 48,
) -> DataFrame:
    """Ridge effect of calendar and covariates per (series, fold).

    Returns the coefficients fit on the rows before each fold.
    """
    sums = moments_by_fold(panel, KEY, features, "y", first_fold(horizon, folds), folds)
    return solve_ridge(sums, len(features), alpha, min_rows, flat_mean=False)


def residual_naive(
    panel: DataFrame,
    effects: DataFrame,
    features: Sequence[str],
    horizon: int,
    folds: int,
    min_train: int,
    long_season: int = 168,
    model: str = "residual_naive",
) -> DataFrame:
    """Seasonal-naive on the covariate residual, effect added back.

    The base value sits one long season before the target, so only the test
    rows and one season of history are read.
    """
    r = recent_rows(panel, horizon, folds, long_season)
    w = Window.partitionBy(*KEY).orderBy("pos")
    names = {f: F.lag(f, long_season).over(w) for f in features}
    r = r.select(
        "*",
        F.lag("y", long_season).over(w).alias("_y0"),
        *[c.alias(f"_past_{f}") for f, c in names.items()],
    )
    t = test_rows(r, horizon, folds, min_train).join(effects, ["series_id", "fold"])
    past = linear_value([f"_past_{f}" for f in features])
    t = t.withColumn("y_pred", F.col("_y0") - past + linear_value(features))
    return _as_predictions(t, model)


def contributions(
    design_rows: DataFrame, fits: DataFrame, features: Sequence[str], keys: Sequence[str], top: int
) -> DataFrame:
    """Mean absolute contribution beta_j * (x_j - mean_j) per feature, top k."""
    return _mean_contributions(design_rows.join(fits, list(keys)), features, top)


def contributions_by_lead(
    origins: DataFrame, fits: DataFrame, features: dict[str, str], leads: Sequence[int], end: Column, top: int
) -> DataFrame:
    """``contributions`` from one row per origin (``features.wide_design``), over the targets before ``end``.

    ``features`` names the column of each feature, ``{lead}`` in it standing for the lead.
    The fits of a series meet its origins once for all leads.
    """
    own = F.collect_list(F.struct("lead", F.struct("beta", "mean_x")))
    j = origins.join(fits.groupBy(*KEY).agg(F.map_from_entries(own).alias("_fits")), KEY)
    targets = [
        F.struct(
            (F.col("pos") + h < end).alias("_used"),
            F.element_at("_fits", F.lit(h)).alias("_fit"),
            *[F.col(c.format(lead=h)).alias(f) for f, c in features.items()],
        )
        for h in leads
    ]
    rows = j.select(F.inline(F.array(*targets))).filter(F.col("_used") & F.col("_fit").isNotNull())
    return _mean_contributions(rows.select("*", "_fit.beta", "_fit.mean_x"), list(features), top)


def _mean_contributions(rows: DataFrame, features: Sequence[str], top: int) -> DataFrame:
    j = rows.dropna(subset=list(features))
    items = [
        F.abs(F.get("beta", F.lit(i)) * (F.col(f).cast("double") - F.get("mean_x", F.lit(i))))
        for i, f in enumerate(features)
    ]
    means = j.agg(*[F.avg(c).alias(f"_c{i}") for i, c in enumerate(items)])
    pairs = [
        F.struct(F.lit(f).alias("feature"), F.col(f"_c{i}").alias("mean_abs"))
        for i, f in enumerate(features)
    ]
    return (
        means.select(F.inline(F.array(*pairs)))
        .orderBy(F.desc("mean_abs"), F.asc("feature"))
        .limit(top)
    )


# --- pooled and adapted models ----------------------------------------------


def pooled_fit(
    design_rows: DataFrame, features: Sequence[str], train: Column, alpha: float = 1.0
) -> DataFrame:
    """One linear model per lead over all given series."""
    m = moments(design_rows.filter(train), ["lead"], features, "target")
    return solve_ridge(m, len(features), alpha, standardise=False)


def adapted_fit(
    design_rows: DataFrame,
    pooled: DataFrame,
    features: Sequence[str],
    kappa: float,
    keys: Sequence[str] = ("series_id", "lead"),
) -> DataFrame:
    """Per-series refit shrunk towards the pooled coefficients.

    Ridge on the residual of the pooled model is the same problem, so the
    pooled prediction is subtracted first and the moment solver reused.
    """
    # one row per lead, so the broadcast side is bounded by the horizon
    j = design_rows.join(F.broadcast(pooled.drop("n_rows", "mean_x")), ["lead"])
    r = j.withColumn("_res", F.col("target") - linear_value(features)).drop("intercept", "beta")
    m = moments(r, keys, features, "_res")
    own = solve_ridge(m, len(features), kappa, standardise=False)
    p = pooled.select(
        "lead", F.col("intercept").alias("_pi"), F.col("beta").alias("_pb")
    )
    both = own.join(F.broadcast(p), ["lead"])
    return both.select(
        *keys,
        "n_rows",
        (F.col("intercept") + F.col("_pi")).alias("intercept"),
        F.zip_with("beta", "_pb", lambda a, b: a + b).alias("beta"),
    )


def transfer_grid(
    design_rows: DataFrame,
    pooled: DataFrame,
    features: Sequence[str],
    horizon: int,
    folds: int,
    min_train: int,
    fractions: Sequence[float],
    floor_rows: int,
    kappa: float = 10.0,
    alpha: float = 1.0,
) -> DataFrame:
    """Transfer and local refit under data budgets, on the same test blocks.

    ``fractions`` are percents of the train rows, most recent first, floored at
    ``floor_rows``; 0 uses the pooled coefficients as they are.  A train row is
    emitted once per budget that holds it, so all budgets share one pass.
    n_train_hours is what a budget really used.
    """
    end = first_test_pos(horizon, folds)
    target_pos = F.col("pos") + F.col("lead")

    def budget(fraction: Column | float) -> Column:
        return F.greatest(F.floor(end * fraction / 100.0), F.lit(floor_rows))

    positive = [float(f) for f in fractions if f > 0]
    holds = [F.when(target_pos >= end - budget(f), F.lit(f)) for f in positive]
    train = design_rows.filter(target_pos < end)
    train = train.withColumn("fraction", F.explode(F.array_compact(F.array(*holds))))
    keys = ["series_id", "lead", "fraction"]
    coef = ["intercept", "beta"]
    moved = adapted_fit(train, pooled, features, kappa, keys).select(
        *keys, F.lit("transfer").alias("strategy"), *coef
    )
    local = solve_ridge(moments(train, keys, features, "target"), len(features), alpha).select(
        *keys, F.lit("refit").alias("strategy"), *coef
    )
    step = F.col("pos") + 1 - end
    origins = design_rows.filter((step >= 0) & (step % horizon == 0) & F.col("target").isNotNull())
    origins = origins.filter(F.col("pos") + 1 > min_train)
    out = origins.join(moved.unionByName(local), ["series_id", "lead"])
    if any(f == 0 for f in fractions):
        # one row per lead
        zero = origins.join(F.broadcast(pooled.select("lead", *coef)), ["lead"])
        zero = zero.withColumns({"fraction": F.lit(0.0), "strategy": F.lit("transfer")})
        out = out.unionByName(zero)
    used = F.when(F.col("fraction") > 0, F.least(budget(F.col("fraction")), end)).otherwise(F.lit(0))
    return out.select(
        "series_id",
        "strategy",
        "fraction",
        F.floor(step / horizon).cast("int").alias("fold"),
        "lead",
        target_pos.alias("pos"),
        F.col("target").alias("y_true"),
        linear_value(features).alias("y_pred"),
        used.alias("n_train_hours"),
    )


def pooled_trees(
    train: DataFrame,
    test: DataFrame,
    features: Sequence[str],
    max_iter: int = 20,
    max_depth: int = 5,
    seed: int = 42,
):
    """Pooled gradient-boosted trees; lead is one of the features.

    Fit by the ML library over all series at once, on complete rows.  These are written
    and dealt over tasks of about ``TREE_ROWS`` each, since every level of every tree reads
    a task's rows again, as vectors, which are far larger than a shuffle's bytes.  Returns the
    test rows with ``y_pred`` and the feature importances in feature order; a test row
    with a missing feature has no prediction and says so in ``reason``.
    """
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    va = VectorAssembler(inputCols=list(features), outputCol="_features")
    gbt = GBTRegressor(
        featuresCol="_features",
        labelCol="target",
        predictionCol="y_pred",
        maxIter=max_iter,
        maxDepth=max_depth,
        seed=seed,
        subsamplingRate=0.8,
    )
    rows = settled(train.dropna(subset=["target", *features]).select("target", *features), "tree-rows")
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // TREE_ROWS))
    fitted = gbt.fit(va.transform(rows.repartition(parts)).select("_features", "target"))
    missing = F.array_compact(F.array(*[F.when(F.col(f).isNull() | F.isnan(F.col(f).cast("double")), F.lit(f)) for f in features]))
    judged = test.withColumn("_missing", missing)
    whole = judged.filter(F.size("_missing") == 0)
    scored = fitted.transform(va.transform(whole)).drop("_features").withColumn("reason", F.lit(None).cast("string"))
    left = judged.filter(F.size("_missing") > 0).withColumns(
        {"y_pred": F.lit(None).cast("double"), "reason": F.concat(F.lit("missing "), F.array_join("_missing", ", "))}
    )
    scored = scored.unionByName(left).drop("_missing")
    return scored, [float(v) for v in fitted.featureImportances.toArray()]


# --- plug-in forecasters ----------------------------------------------------

def fold_contexts(panel: DataFrame, horizon: int, folds: int, min_train: int, context: int) -> DataFrame:
    """Rows of each fold's context, as (series, fold) groups.

    A row can serve several folds; every group holds at most ``context`` rows.
    """
    r = panel.filter(F.col("pos") >= first_test_pos(horizon, folds) - context)
    r = r.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    end = first_test_pos(horizon, folds) + F.col("fold") * horizon
    keep = (F.col("pos") < end) & (F.col("pos") >= end - context) & (end > min_train)
    return r.filter(keep)


def plugin_forecast(
    panel: DataFrame,
    forecaster: Callable[[np.ndarray, int], np.ndarray],
    horizon: int,
    folds: int,
    min_train: int,
    context: int = 672,
) -> DataFrame:
    """Run any ``f(context_values, horizon) -> values`` per series and fold, on the fold's last ``context`` rows."""
    return forecast_contexts(fold_contexts(panel, horizon, folds, min_train, context), forecaster, horizon)


def forecast_contexts(contexts: DataFrame, forecaster: Callable[[np.ndarray, int], np.ndarray], horizon: int) -> DataFrame:
    """Forecasts of (series, fold) groups of rows with pos and y.

    Each group is one row with its context as an array, which ``fold_contexts`` bounds;
    batches of such rows go to Python.  A failing series yields
    one row with the error text instead of stopping the job.
    """

    def forecast(values: np.ndarray) -> tuple[list, str | None]:
        try:
            out = np.asarray(forecaster(np.array(values, float), horizon), float)
            if out.shape != (horizon,):
                raise ValueError(f"expected {horizon} values, got shape {out.shape}")
            return out.tolist(), None
        except Exception as exc:
            return [], str(exc)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            done = [forecast(v) for v in pdf["_y"]]
            yield pdf[["series_id", "fold"]].assign(y=[v for v, _ in done], error=[e for _, e in done])

    points = F.sort_array(F.collect_list(F.struct("pos", "y")))
    rows = contexts.groupBy("series_id", "fold").agg(F.transform(points, lambda x: x["y"]).alias("_y"))
    rows = fanned_out(rows, "series_id", "fold")
    done = rows.mapInPandas(run, "series_id string, fold int, y array<double>, error string")
    # a failed row has no values and keeps its error
    return done.select("series_id", "fold", "error", F.posexplode_outer("y").alias("_i", "y_pred")).select(
        "series_id", "fold", (F.col("_i") + 1).alias("lead"), "y_pred", "error"
    )


def residual_plugin(
    panel: DataFrame,
    effects: DataFrame,
    features: Sequence[str],
    forecaster: Callable[[np.ndarray, int], np.ndarray],
    horizon: int,
    folds: int,
    min_train: int,
    context: int = 672,
    model: str = "residual_plugin",
) -> tuple[DataFrame, DataFrame]:
    """(predictions, failures) of a plug-in on what the covariates leave, their effect added back.

    ``effects`` are those of ``covariate_effect``: one linear model a series and fold.  Its
    value is taken from the fold's context, the forecaster continues the rest, and
    the value at the test rows comes on top.  Without a usable effect the forecaster sees the
    series itself.
    """
    cov = F.coalesce(linear_value(features), F.lit(0.0))
    own = effects.select("series_id", "fold", "intercept", "beta")
    contexts = fold_contexts(panel, horizon, folds, min_train, context).join(own, ["series_id", "fold"], "left")
    contexts = contexts.select("series_id", "fold", "pos", (F.col("y") - cov).alias("y"))
    done = forecast_contexts(contexts, forecaster, horizon)
    ok = done.filter("error IS NULL").select("series_id", "fold", "lead", F.col("y_pred").alias("_rest"))
    t = test_rows(panel, horizon, folds, min_train).join(ok, ["series_id", "fold", "lead"]).join(own, ["series_id", "fold"], "left")
    return _as_predictions(t.withColumn("y_pred", F.col("_rest") + cov), model), failures(done)


def attach_truth(
    forecasts: DataFrame, panel: DataFrame, horizon: int, folds: int, min_train: int, model: str
) -> DataFrame:
    """Turn plug-in output into prediction rows; failed groups drop out."""
    t = test_rows(panel, horizon, folds, min_train)
    ok = forecasts.filter("error IS NULL").select("series_id", "fold", "lead", "y_pred")
    return _as_predictions(t.join(ok, ["series_id", "fold", "lead"]), model)


def failures(forecasts: DataFrame) -> DataFrame:
    return forecasts.filter("error IS NOT NULL").select("series_id", "fold", "error")


# --- recency ----------------------------------------------------------------


def rows_since(panel: DataFrame, cutoff: str, min_rows: int) -> tuple[DataFrame, DataFrame]:
    """(panel of the rows from ``cutoff`` on, rejected series) of a gated panel.

    The rows' positions and counts start anew.  Series with fewer than ``min_rows``
    such rows, none included, are rejected with their count and the reason.
    """
    late = F.col("ts") >= F.lit(cutoff).cast("timestamp")
    facts = panel.groupBy("series_id").agg(F.count_if(late).alias("_kept"))
    few = facts.filter(F.col("_kept") < min_rows)
    reason = F.concat(F.lit("rows since cutoff "), F.col("_kept").cast("string"), F.lit(f" < {min_rows}"))
    rejects = few.select("series_id", F.col("_kept").alias("rows_since"), reason.alias("reject_reason"))
    rows = panel.filter(late).withColumn("_b", chunk_of("pos"))
    rows = spread(rows, facts.filter(F.col("_kept") >= min_rows), ["series_id"], "_b")
    rows = rows.withColumns({"pos": F.col("pos") - (F.col("n") - F.col("_kept")), "n": F.col("_kept")})
    return rows.select(panel.columns), rejects


# --- grids ------------------------------------------------------------------


def with_grid(df: DataFrame, **axes: Sequence) -> DataFrame:
    """Every row once per cell of a literal parameter grid (an explode, no join)."""
    for name, values in axes.items():
        df = df.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return df


def history_regimes(
    panel: DataFrame, weeks: Sequence[int], horizon: int, folds: int, long_season: int = 168
) -> DataFrame:
    """The last W long seasons plus the test rows, per regime; too long is skipped.

    ``pos`` and ``n`` restart within each regime.
    """
    g = with_grid(panel, train_weeks=list(weeks))
    need = F.col("train_weeks") * long_season + folds * horizon
    g = g.filter((need <= F.col("n")) & (F.col("pos") >= F.col("n") - need))
    return g.withColumn("pos", F.col("pos") - (F.col("n") - need)).withColumn("n", need)
