"""Lag, rolling, calendar, lead and covariate features.

All offsets count rows, not hours: after gap removal a panel is irregular, and
"lag 168" means 168 rows back.  The panel carries ``pos`` and ``n``; bounded
offsets run through ``over_rows``, one exchange for any number of features.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelkit.functions.columns import calendar
from panelkit.plans.ordered import chunk_of, over_rows, spread

KEY = ["series_id"]
# The feature set of the reference protocol (hourly data).
LAGS = (0, 1, 2, 3, 24, 25, 168)
LAGS_EXCLUSIVE = (1, 2, 3, 24, 25, 168)
ROLLS = (24, 168)
SEASON = 24
LONG_SEASON = 168


def lag_columns(w: Window, lags: Sequence[int], value: str = "y") -> dict[str, Column]:
    return {f"ylag_{k}": F.lag(value, k).over(w) if k else F.col(value) for k in lags}


def rolling_columns(
    w: Window, widths: Sequence[int], value: str = "y", inclusive: bool = True
) -> dict[str, Column]:
    """Trailing means, null until the frame holds ``width`` values."""
    out = {}
    for width in widths:
        frame = w.rowsBetween(-(width - 1), 0) if inclusive else w.rowsBetween(-width, -1)
        full = F.count(value).over(frame) == width
        out[f"rollmean_{width}"] = F.when(full, F.avg(value).over(frame))
    return out


def origin_features(
    panel: DataFrame,
    lags: Sequence[int] = LAGS,
    rolls: Sequence[int] = ROLLS,
    inclusive: bool = True,
) -> DataFrame:
    """Features known at the origin: lags and trailing means."""
    reach = max([*lags, *rolls])
    return over_rows(
        panel,
        KEY,
        lambda w: {**lag_columns(w, lags), **rolling_columns(w, rolls, inclusive=inclusive)},
        before=reach,
    )


def with_calendar(df: DataFrame, ts: str = "ts", prefix: str = "") -> DataFrame:
    return df.withColumns(calendar(ts, prefix))


def lead_targets(panel: DataFrame, horizon: int) -> DataFrame:
    """Wide targets ``y_lead_1..y_lead_H``; null where the series ends."""
    return over_rows(
        panel,
        KEY,
        lambda w: {f"y_lead_{h}": F.lead("y", h).over(w) for h in range(1, horizon + 1)},
        after=horizon,
    )


def design(
    panel: DataFrame,
    leads: Sequence[int],
    covariates: Sequence[str] = (),
    mode: str = "causal",
    lags: Sequence[int] = LAGS,
    rolls: Sequence[int] = ROLLS,
    cal: bool = True,
) -> DataFrame:
    """Direct multi-horizon design: one row per origin and lead.

    Adds lead, target, target_ts, the origin features, ``futcal_*`` at the
    target stamp and the covariates: ``mode="causal"`` takes them at the origin
    (``cov0_*``), ``"perfect"`` at the target row (``fut_*``, leakage by
    design), ``"both"`` gives either, ``"none"`` leaves them out.

    The look-ahead rows of an origin come from bounded leads in the same pass
    as its lags, then explode: no join on pos + h.
    """
    if mode not in ("causal", "perfect", "both", "none"):
        raise ValueError(f"unknown covariate mode {mode!r}")
    leads = [int(h) for h in leads]
    ahead = ["ts", "y", *(covariates if mode in ("perfect", "both") else ())]

    def targets(w: Window) -> dict[str, Column]:
        found = [F.struct(F.lit(h).alias("lead"), F.lead(F.struct(*ahead), h).over(w).alias("t")) for h in leads]
        return {"_ahead": F.array(*found)}

    d = _with_ahead(panel, leads, targets, lags, rolls)
    d = d.select("*", F.inline("_ahead").alias("lead", "_t")).drop("_ahead")
    d = d.withColumns({"target": F.col("_t.y"), "target_ts": F.col("_t.ts")})
    if cal:
        d = d.withColumns(calendar("target_ts", "futcal_"))
    if mode in ("perfect", "both"):
        d = d.withColumns({f"fut_{c}": F.col(f"_t.{c}") for c in covariates})
    if mode in ("causal", "both"):
        d = d.withColumns({f"cov0_{c}": F.col(c) for c in covariates})
    drop = ["_t", *(covariates if mode != "none" else ())]
    return d.drop(*drop)


def _with_ahead(panel: DataFrame, leads: Sequence[int], targets, lags: Sequence[int], rolls: Sequence[int]) -> DataFrame:
    """Origin features and what ``targets`` takes from the rows ahead, in one pass."""

    def columns(w: Window) -> dict[str, Column]:
        return {**lag_columns(w, lags), **rolling_columns(w, rolls), **targets(w)}

    return over_rows(panel, KEY, columns, before=max([0, *lags, *rolls]), after=max(leads))


def wide_design(
    panel: DataFrame,
    leads: Sequence[int],
    covariates: Sequence[str] = (),
    lags: Sequence[int] = LAGS,
    rolls: Sequence[int] = ROLLS,
) -> DataFrame:
    """The rows of ``design`` before they part by lead: one row per origin.

    Adds the origin features, ``cov0_*`` and, for every lead h, ``target_h``,
    ``futcal_month_h`` and ``fut_*_h``; what lies beyond the series' end is null.
    """

    def targets(w: Window) -> dict[str, Column]:
        found = {f"target_{h}": F.lead("y", h).over(w) for h in leads}
        found |= {f"_ts_{h}": F.lead("ts", h).over(w) for h in leads}
        return found | {f"fut_{c}_{h}": F.lead(c, h).over(w) for c in covariates for h in leads}

    d = _with_ahead(panel, leads, targets, lags, rolls)
    d = d.withColumns({f"futcal_month_{h}": F.month(f"_ts_{h}") for h in leads} | {f"cov0_{c}": F.col(c) for c in covariates})
    return d.drop(*[f"_ts_{h}" for h in leads], *covariates)


def freeze_covariates(panel: DataFrame, covariates: Sequence[str], folds: int, horizon: int) -> DataFrame:
    """Test-block covariates replaced by the last value before the block.

    Missing values were filled beforehand (forward, then backward).  Rows before the
    test blocks pass by as they are; the folds' rows, folds * horizon of a series at
    most, meet their one origin row on (series, fold).  A block without a row before
    it keeps its values.
    """
    start = F.col("n") - folds * horizon
    fold = F.floor((F.col("pos") - start) / F.lit(horizon))
    tail = panel.filter(F.col("pos") >= start).withColumn("_fold", fold)
    # the last row before a block belongs to the fold that starts one row later
    next_fold = F.floor((F.col("pos") + 1 - start) / F.lit(horizon))
    origins = panel.filter((F.col("pos") >= start - 1) & ((F.col("pos") + 1 - start) % horizon == 0) & (next_fold < folds))
    origins = origins.select(*KEY, next_fold.alias("_fold"), F.struct(*covariates).alias("_origin"))
    frozen = tail.join(origins, [*KEY, "_fold"], "left").withColumns(
        {c: F.when(F.col("_origin").isNotNull(), F.col(f"_origin.{c}")).otherwise(F.col(c)) for c in covariates}
    )
    head = panel.filter(F.col("pos") < start)
    return head.unionByName(frozen.select(panel.columns))


def train_moments(panel: DataFrame, train_end: Column, columns: Sequence[str]) -> DataFrame:
    """Mean and sample standard deviation per series on rows before ``train_end``."""
    t = panel.filter(F.col("pos") < train_end)
    aggs = []
    for c in columns:
        sd = F.stddev_samp(c)
        aggs.append(F.avg(c).alias(f"mu_{c}"))
        aggs.append(F.when(sd > 0, sd).otherwise(F.lit(1.0)).alias(f"sd_{c}"))
    return t.groupBy(*KEY).agg(*aggs)


def zscore(panel: DataFrame, train_end: Column, columns: Sequence[str] = ("y",)) -> DataFrame:
    """Standardise with train-region statistics; a zero spread counts as 1."""
    facts = train_moments(panel, train_end, columns)
    rows = spread(panel.withColumn("_b", chunk_of()), facts, KEY, "_b")
    for c in columns:
        z = (F.col(c) - F.col(f"mu_{c}")) / F.col(f"sd_{c}")
        rows = rows.withColumn(f"z_{c}", z.cast("float").cast("double"))
    return rows.drop("_b")


def window_arrays(
    panel: DataFrame,
    lookback: int,
    horizon: int,
    columns: Sequence[str] = ("y",),
    lo: Column | int = 0,
    hi: Column | None = None,
) -> DataFrame:
    """Look-back and horizon arrays per origin, origins in [lo + L, hi - H).

    The label window starts at the origin row itself.  ``columns[0]`` is the
    target; with several columns the look-back holds structs.
    """
    hi = F.col("n") if hi is None else hi
    item = F.col(columns[0]) if len(columns) == 1 else F.struct(*columns)

    def arrays(w: Window) -> dict[str, Column]:
        return {
            "x": F.collect_list(item).over(w.rowsBetween(-lookback, -1)),
            "target": F.collect_list(columns[0]).over(w.rowsBetween(0, horizon - 1)),
        }

    out = over_rows(panel, KEY, arrays, before=lookback, after=horizon)
    p = F.col("pos")
    return out.filter((p >= lo + F.lit(lookback)) & (p < hi - horizon))


def budget_slice(
    panel: DataFrame, train_end: Column, fraction: float, lookback: int, horizon: int
) -> DataFrame:
    """Most recent ``fraction`` percent of the train rows, labelled train/val.

    The cut is floored at one full window; the last 15 % are validation unless
    the slice is too small, then all rows train.  n_hours is the actual size.
    """
    floor_rows = lookback + horizon + 1
    cut = F.greatest(F.floor(train_end * fraction / 100.0), F.lit(floor_rows))
    lo = F.greatest(train_end - cut, F.lit(0))
    rows = train_end - lo
    n_val = F.floor(rows * 0.15)
    no_val = (rows - n_val <= lookback + 1) | (n_val < horizon + 1)
    p = F.col("pos")
    out = panel.filter((p >= lo) & (p < train_end)) if fraction > 0 else panel.filter(F.lit(False))
    split = F.when(no_val | (p < train_end - n_val), "train").otherwise("val")
    return out.withColumns({"split": split, "n_hours": rows, "fraction": F.lit(float(fraction))})


def train_val_split(
    panel: DataFrame, train_end: Column, lookback: int, horizon: int, share: float = 0.1
) -> DataFrame:
    """Last ``share`` of the train rows (at least one window) as validation."""
    n_val = F.greatest(F.floor(train_end * share), F.lit(lookback + horizon + 1))
    t = panel.filter(F.col("pos") < train_end)
    return t.withColumn("split", F.when(F.col("pos") < train_end - n_val, "train").otherwise("val"))


def complete_cases(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.dropna(subset=list(columns))
