"""Cleaning, segmentation, gap filling and the usable-window gate.

Readings are ``(series_id, ts, y, ...)``.  Order-dependent steps work per
(series, time bucket), see ``panelkit.plans.ordered``; a dense series is never
sorted as a whole in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelkit.functions.columns import DAY, HOUR, micros, nan_to_null, seconds_between, time_bucket
from panelkit.plans.ordered import chunk_of, neighbours, previous, spread, with_position
from panelkit.session import settled

KEY = ["series_id"]
SEGMENT_BREAK_HOURS = 48
INTERP_LIMIT = 6
MIN_ROWS = 2160
MIN_COVERAGE = 0.6
SUBHOURLY_MINUTES = 45


def sanitize(df: DataFrame, lo: float = 0.0, hi: float = 985.0, value: str = "y") -> DataFrame:
    """Readings at or outside the open interval (lo, hi) become null; rows stay."""
    v = F.col(value)
    return df.withColumn(value, F.when((v > lo) & (v < hi), v))


def first_reading(
    df: DataFrame, seq: str, keys: Sequence[str] = ("series_id", "ts"), values: Sequence[str] = ("y",)
) -> DataFrame:
    """Keep, per key, the values of the row that came first by ``seq``.

    An aggregate rather than a window: repeated copies of one stamp collapse
    before the shuffle.
    """
    if len(values) == 1:
        return df.groupBy(*keys).agg(F.min_by(values[0], seq).alias(values[0]))
    row = F.min_by(F.struct(*values), F.col(seq)).alias("_r")
    return df.groupBy(*keys).agg(row).select(*keys, *[F.col(f"_r.{v}").alias(v) for v in values])


def last_reading(
    df: DataFrame, seq: str, keys: Sequence[str] = ("series_id", "ts"), value: str = "y"
) -> DataFrame:
    """Keyed upsert: the latest non-null value by ``seq`` wins."""
    v = df.filter(F.col(value).isNotNull())
    return v.groupBy(*keys).agg(F.max_by(value, seq).alias(value))


def observation_gaps(df: DataFrame, bucket_seconds: int | None = None) -> DataFrame:
    """Seconds since the previous reading of the series (null on the first)."""
    width = bucket_width(df, bucket_seconds, HOUR)
    out = previous(
        df.withColumn("_b", time_bucket("ts", width)), KEY, "_b", "ts", {"_prev": "ts"}
    )
    return out.withColumn("gap_s", seconds_between("ts", "_prev")).drop("_b", "_prev")


def suggest_bucket_seconds(
    readings: DataFrame, target_rows: int = 1_000_000, widest: int = DAY
) -> int:
    """Bucket width that keeps the densest (series, bucket) near ``target_rows``.

    One aggregate over (series, hour) and one scalar on the driver.  Readings
    are unique per microsecond, so even one-second buckets stay bounded.
    """
    cells = readings.groupBy(*KEY, time_bucket("ts", HOUR).alias("_b")).agg(
        F.count(F.lit(1)).alias("_n")
    )
    densest = cells.agg(F.max("_n").alias("m")).first()["m"] or 1
    return int(max(1, min(widest, HOUR * target_rows // densest)))


def bucket_width(readings: DataFrame, given: int | None, widest: int) -> int:
    """The caller's width, or else one that follows the densest hour of the readings.

    No result depends on it: it bounds the rows that a (series, bucket) sorts.
    """
    return given or suggest_bucket_seconds(readings, widest=widest)


def _sampling(
    df: DataFrame, minutes: float, bucket_seconds: int | None
) -> tuple[DataFrame, DataFrame]:
    """Rows with their bucket, and one row per (series, bucket) with the verdict.

    The test needs no median.  With more than half of the gaps below the limit
    the median is below it, with fewer it is not; on an exact half the median
    is the mean of the two middle gaps, the largest below and the smallest at
    or above the limit.  All of that is counts, minima and maxima, so buckets
    are reduced first and only the bucket rows are combined per series.
    """
    limit = minutes * 60.0
    part = [*KEY, "_b"]
    rows = df.withColumn("_b", time_bucket("ts", bucket_width(df, bucket_seconds, HOUR)))
    inside = rows.withColumn(
        "_g", seconds_between("ts", F.lag("ts").over(Window.partitionBy(*part).orderBy("ts")))
    )
    g, e = F.col("_g"), F.col("_edge")
    cells = inside.groupBy(*part).agg(
        F.count(F.lit(1)).alias("_n"),
        F.count_if(g < limit).alias("_below"),
        F.max(F.when(g < limit, g)).alias("_lo"),
        F.min(F.when(g >= limit, g)).alias("_hi"),
        F.min("ts").alias("_first"),
        F.max("ts").alias("_last"),
    )
    by_bucket = Window.partitionBy(*KEY).orderBy("_b")
    every = Window.partitionBy(*KEY)
    cells = cells.withColumn("_edge", seconds_between("_first", F.lag("_last").over(by_bucket)))
    cells = cells.select(
        *part,
        F.sum("_n").over(every).alias("n_obs"),
        F.sum(F.col("_below") + F.when(e < limit, 1).otherwise(0)).over(every).alias("_below"),
        F.max(F.greatest("_lo", F.when(e < limit, e))).over(every).alias("_lo"),
        F.min(F.least("_hi", F.when(e >= limit, e))).over(every).alias("_hi"),
    )
    twice, gaps = F.col("_below") * 2, F.col("n_obs") - 1
    fast = (
        F.when(F.col("n_obs") < 3, F.lit(False))
        .when(twice > gaps, F.lit(True))
        .when(twice < gaps, F.lit(False))
        .otherwise((F.col("_lo") + F.col("_hi")) / 2 < limit)
    )
    return rows, cells.select(*part, "n_obs", fast.alias("is_subhourly"))


def sampling_profile(
    df: DataFrame, minutes: float = SUBHOURLY_MINUTES, bucket_seconds: int | None = None
) -> DataFrame:
    """Per series: reading count and whether the median gap is below ``minutes``."""
    _, cells = _sampling(df, minutes, bucket_seconds)
    return cells.groupBy(*KEY).agg(
        F.max("n_obs").alias("n_obs"), F.bool_or("is_subhourly").alias("is_subhourly")
    )


def resample_subhourly(
    df: DataFrame, minutes: float = SUBHOURLY_MINUTES, bucket_seconds: int | None = None
) -> DataFrame:
    """Hourly means for the series that report faster than hourly.

    Other series pass through unchanged.  Input must hold one row per stamp.
    Each row's output stamp is chosen first, so both kinds go through a single
    aggregate with map-side partial means.
    """
    rows, cells = _sampling(df, minutes, bucket_seconds)
    stamp = F.when(F.col("is_subhourly"), F.date_trunc("hour", "ts")).otherwise(F.col("ts"))
    return (
        rows.join(cells, [*KEY, "_b"])
        .withColumn("ts", stamp)
        .groupBy("series_id", "ts")
        .agg(F.avg("y").alias("y"))
        .filter(F.col("y").isNotNull())
    )


def _segments(
    df: DataFrame, break_hours: float, bucket_seconds: int | None
) -> tuple[DataFrame, DataFrame]:
    """Rows with their piece, and one row per piece with its segment.

    A piece is a run of readings inside one bucket without a long gap.  Pieces
    are linked to segments over the piece rows only.
    """
    part = [*KEY, "_b"]
    w = Window.partitionBy(*part).orderBy("ts")
    far = break_hours * HOUR
    rows = df.withColumn("_b", time_bucket("ts", bucket_width(df, bucket_seconds, DAY))).withColumn(
        "_g", seconds_between("ts", F.lag("ts").over(w))
    )
    rows = rows.withColumn("_piece", F.sum(F.when(F.col("_g") > far, 1).otherwise(0)).over(w))
    pieces = rows.groupBy(*part, "_piece").agg(
        F.count(F.lit(1)).alias("_n"), F.min("ts").alias("_first"), F.max("ts").alias("_last")
    )
    order = Window.partitionBy(*KEY).orderBy("_b", "_piece")
    pieces = pieces.withColumn("_edge", seconds_between("_first", F.lag("_last").over(order)))
    pieces = pieces.withColumn(
        "segment", F.sum(F.when(F.col("_edge") > far, 1).otherwise(0)).over(order)
    )
    return rows, pieces


def gap_segments(
    df: DataFrame, break_hours: float = SEGMENT_BREAK_HOURS, bucket_seconds: int | None = None
) -> DataFrame:
    """Segment number per reading; a gap strictly above ``break_hours`` starts one.

    Adds gap_s and segment (0-based).
    """
    rows, pieces = _segments(df, break_hours, bucket_seconds)
    first = F.col("ts") == F.col("_first")
    out = rows.join(pieces, [*KEY, "_b", "_piece"])
    gap = F.when(first, F.col("_edge")).otherwise(F.col("_g")).alias("gap_s")
    return out.select(*df.columns, gap, "segment")


def segment_sizes(segmented: DataFrame) -> DataFrame:
    return segmented.groupBy("series_id", "segment").agg(
        F.count(F.lit(1)).alias("n_obs"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")
    )


def longest_segments(segmented: DataFrame) -> DataFrame:
    """Per series the segment with most readings; the earliest wins a tie."""
    best = F.max(
        F.struct(
            F.col("n_obs"),
            (-F.col("segment")).alias("neg"),
            F.col("first_ts"),
            F.col("last_ts"),
        )
    ).alias("m")
    return (
        segment_sizes(segmented)
        .groupBy("series_id")
        .agg(best)
        .select(
            "series_id",
            (-F.col("m.neg")).alias("segment"),
            F.col("m.n_obs").alias("n_obs"),
            F.col("m.first_ts").alias("first_ts"),
            F.col("m.last_ts").alias("last_ts"),
        )
    )


def keep_longest_segment(
    df: DataFrame, break_hours: float = SEGMENT_BREAK_HOURS, bucket_seconds: int | None = None
) -> DataFrame:
    """Readings of each series' longest segment, with the segment's bounds."""
    rows, pieces = _segments(df, break_hours, bucket_seconds)
    seg = Window.partitionBy(*KEY, "segment")
    pieces = pieces.withColumns(
        {
            "_size": F.sum("_n").over(seg),
            "first_ts": F.min("_first").over(seg),
            "last_ts": F.max("_last").over(seg),
        }
    )
    best = F.max(F.struct("_size", (-F.col("segment")).alias("neg"))).over(Window.partitionBy(*KEY))
    pieces = pieces.withColumn("_best", -best["neg"]).filter(F.col("segment") == F.col("_best"))
    keep = pieces.select(*KEY, "_b", "_piece", "segment", "first_ts", "last_ts")
    out = rows.join(keep, [*KEY, "_b", "_piece"])
    return out.select(*df.columns, "segment", "first_ts", "last_ts", "_b")


def regular_grid(bounds: DataFrame, step_seconds: int = HOUR, cells: int = 4096) -> DataFrame:
    """Every stamp of [first_ts, last_ts] at the step, anchored at first_ts.

    Two explodes, coarse then fine, keep each generated array below ``cells``.
    """
    step = F.make_interval(secs=F.lit(step_seconds))
    coarse = F.make_interval(secs=F.lit(step_seconds * cells))
    last_in_cell = F.least(
        F.col("_start") + F.make_interval(secs=F.lit(step_seconds * (cells - 1))), F.col("last_ts")
    )
    return (
        bounds.withColumn("_start", F.explode(F.sequence("first_ts", "last_ts", coarse)))
        .withColumn("ts", F.explode(F.sequence(F.col("_start"), last_in_cell, step)))
        .drop("_start")
    )


def on_grid(bounds: DataFrame, readings: DataFrame, step_seconds: int = HOUR) -> DataFrame:
    """Left join of the readings to the regular grid; off-grid readings vanish."""
    grid = regular_grid(bounds.select("series_id", "first_ts", "last_ts"), step_seconds)
    pos = (micros("ts") - micros("first_ts")) / F.lit(step_seconds * 1_000_000)
    grid = grid.withColumn("pos", pos.cast("long")).drop("first_ts", "last_ts")
    return grid.join(readings.select("series_id", "ts", "y"), ["series_id", "ts"], "left")


def linear_fill(value: str, pos: str, limit: int) -> Column:
    """Value after bounded interpolation, from the ``neighbours`` columns."""
    p = F.col(pos)
    since = p - F.col("prev_at")
    slope = (F.col("next_value") - F.col("prev_value")) / (F.col("next_at") - F.col("prev_at"))
    filled = F.when(F.col("next_at").isNull(), F.col("prev_value")).otherwise(
        F.col("prev_value") + slope * since
    )
    return F.when(F.col(value).isNotNull(), F.col(value)).when(since <= limit, filled)


def interpolate(
    df: DataFrame,
    limit: int = INTERP_LIMIT,
    keys: Sequence[str] = ("series_id",),
    value: str = "y",
    pos: str = "pos",
) -> DataFrame:
    """Fill at most the first ``limit`` rows of each gap, by row position.

    Linear between the surrounding values, the last value carried past the
    end, nothing before the first.
    """
    keys = list(keys)
    n = neighbours(df.withColumn("_c", chunk_of(pos)), keys, "_c", pos, value)
    n = n.withColumn(value, linear_fill(value, pos, limit))
    return n.drop("_c", "prev_at", "prev_value", "next_at", "next_value")


def carry_both_ways(
    df: DataFrame, keys: Sequence[str], value: str, pos: str = "pos", flag: str = "is_filled"
) -> DataFrame:
    """Forward then backward fill of what is still missing; fills are flagged."""
    keys = list(keys)
    n = neighbours(df.withColumn("_c", chunk_of(pos)), keys, "_c", pos, value)
    n = n.withColumn(flag, F.col(value).isNull() & F.coalesce("prev_value", "next_value").isNotNull())
    n = n.withColumn(value, F.coalesce(value, "prev_value", "next_value"))
    return n.drop("_c", "prev_at", "prev_value", "next_at", "next_value")


def drop_missing(df: DataFrame, keys: Sequence[str] = ("series_id",), order: str = "pos") -> DataFrame:
    """Remove null rows and number the remaining ones; the series turns irregular."""
    kept = df.filter(F.col("y").isNotNull()).withColumn("_c", chunk_of(order))
    kept = kept.withColumnRenamed(order, "grid_pos")
    return with_position(kept, list(keys), "_c", "grid_pos").drop("_c")


def _filled(
    rows: DataFrame, limit: int, step_seconds: int
) -> tuple[DataFrame, DataFrame]:
    """Readings with their fill count, and one row per bucket with positions.

    After the null rows are dropped only readings and their fills remain, so
    the fills can be emitted straight from each pair of consecutive on-grid
    readings: at most ``limit`` rows each, no grid table and no grid join.
    """
    step = F.lit(step_seconds * 1_000_000)
    part = [*KEY, "_b"]
    offset = micros("ts") - micros("first_ts")
    g = rows.filter(offset % step == 0).withColumn("_k", (offset / step).cast("long"))
    w = Window.partitionBy(*part).orderBy("_k")
    room_inside = F.col("_nk") - 1 - F.col("_k")
    fills = F.when(F.col("_nk").isNotNull(), F.least(room_inside, F.lit(limit)))
    g = g.withColumns({"_nk": F.lead("_k").over(w), "_ny": F.lead("y").over(w)})
    g = g.withColumn("_f", fills)
    g = g.withColumn(
        "_at",
        F.coalesce(
            F.sum(F.col("_f") + 1).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ),
    )
    cells = g.groupBy(*part).agg(
        F.count(F.lit(1)).alias("_n"),
        F.sum("_f").alias("_inner"),
        F.min("_k").alias("_first_k"),
        F.min_by("y", "_k").alias("_first_y"),
        F.max("_k").alias("_last_k"),
        F.first("first_ts").alias("usable_from"),
        F.first("last_ts").alias("_end"),
    )
    order = Window.partitionBy(*KEY).orderBy("_b")
    every = Window.partitionBy(*KEY)
    cells = cells.withColumns(
        {"_edge_k": F.lead("_first_k").over(order), "_edge_y": F.lead("_first_y").over(order)}
    )
    # past the last reading the grid still runs to the segment end
    end_k = F.floor((micros("_end") - micros("usable_from")) / step)
    room = F.coalesce(F.col("_edge_k") - 1, end_k) - F.col("_last_k")
    cells = cells.withColumn("_edge_f", F.least(room, F.lit(limit)))
    cells = cells.withColumn(
        "_rows", F.col("_n") + F.coalesce("_inner", F.lit(0)) + F.col("_edge_f")
    )
    cells = cells.withColumns(
        {
            "_base": F.coalesce(
                F.sum("_rows").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
            ),
            "n": F.sum("_rows").over(every),
            "_to_k": F.max(F.col("_last_k") + F.when(F.col("_edge_k").isNull(), F.col("_edge_f"))).over(every),
        }
    )
    cells = cells.withColumn("usable_to", F.timestamp_micros(micros("usable_from") + F.col("_to_k") * step))
    cells = cells.withColumn("coverage", F.col("n") / (F.col("_to_k") + 1))
    return g, cells


def _emit(g: DataFrame, cells: DataFrame, step_seconds: int) -> DataFrame:
    step = F.lit(step_seconds * 1_000_000)
    j = g.join(cells.drop("usable_from", "_n"), [*KEY, "_b"])
    j = j.withColumns(
        {
            "_nk": F.coalesce("_nk", "_edge_k"),
            "_ny": F.coalesce("_ny", "_edge_y"),
            "_f": F.coalesce("_f", "_edge_f").cast("int"),
        }
    )
    j = j.withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_f"))))
    slope = F.coalesce((F.col("_ny") - F.col("y")) / (F.col("_nk") - F.col("_k")), F.lit(0.0))
    return j.select(
        "series_id",
        F.timestamp_micros(micros("ts") + F.col("_i") * step).alias("ts"),
        F.when(F.col("_i") == 0, F.col("y")).otherwise(F.col("y") + slope * F.col("_i")).alias("y"),
        (F.col("_i") > 0).alias("is_filled"),
        (F.col("_base") + F.col("_at") + F.col("_i")).alias("pos"),
        "n",
    )


def fill_small_gaps(
    rows: DataFrame, limit: int = INTERP_LIMIT, step_seconds: int = HOUR
) -> DataFrame:
    """Regular grid, bounded interpolation, null removal and numbering at once.

    ``rows`` come from ``keep_longest_segment``.
    """
    g, cells = _filled(rows, limit, step_seconds)
    return _emit(g, cells, step_seconds)


def reject_reason(min_rows: int, min_cov: float) -> Column:
    return F.when(F.col("n") < min_rows, F.lit("too few rows")).when(
        F.col("coverage") < min_cov, F.lit("too sparse")
    )


def window_facts(
    readings: DataFrame,
    break_hours: float = SEGMENT_BREAK_HOURS,
    limit: int = INTERP_LIMIT,
    min_rows: int = MIN_ROWS,
    min_cov: float = MIN_COVERAGE,
    step_seconds: int = HOUR,
    bucket_seconds: int | None = None,
) -> DataFrame:
    """Per series: size, bounds and coverage of the cleaned window, and why it fails.

    Derived from the bucket rows alone; the filled panel is never produced.
    """
    kept = keep_longest_segment(readings, break_hours, bucket_seconds)
    _, cells = _filled(kept, limit, step_seconds)
    facts = cells.groupBy("series_id").agg(
        *[F.max(c).alias(c) for c in ("n", "usable_from", "usable_to", "coverage")]
    )
    return facts.withColumn("reject_reason", reject_reason(min_rows, min_cov))


def usable_window(
    readings: DataFrame,
    seq: str = "seq",
    lo: float | None = 0.0,
    hi: float | None = 985.0,
    break_hours: float = SEGMENT_BREAK_HOURS,
    limit: int = INTERP_LIMIT,
    min_rows: int = MIN_ROWS,
    min_cov: float = MIN_COVERAGE,
    step_seconds: int = HOUR,
    bucket_seconds: int | None = None,
) -> DataFrame:
    """The gate: sanitize, de-duplicate, longest segment, fill, accept or drop.

    Returns the panel ``series_id, ts, y, is_filled, pos, n``; series that fail
    are absent (``rejected_series`` lists them with the reason).  Rows move
    once for the de-duplication and once on (series, bucket); acceptance and
    positions are decided on the bucket rows.
    """
    clean = _gate_input(readings, seq, lo, hi)
    kept = keep_longest_segment(clean, break_hours, bucket_width(readings, bucket_seconds, DAY))
    g, cells = _filled(kept, limit, step_seconds)
    accepted = cells.filter(reject_reason(min_rows, min_cov).isNull())
    return _emit(g, accepted, step_seconds)


def _gate_input(readings: DataFrame, seq: str, lo: float | None, hi: float | None) -> DataFrame:
    readings = readings.withColumn("y", nan_to_null(F.col("y").cast("double")))
    if lo is not None and hi is not None:
        readings = sanitize(readings, lo, hi)
    return first_reading(readings.filter(F.col("y").isNotNull()), seq)


def rejected_series(
    readings: DataFrame,
    seq: str = "seq",
    lo: float | None = 0.0,
    hi: float | None = 985.0,
    break_hours: float = SEGMENT_BREAK_HOURS,
    limit: int = INTERP_LIMIT,
    min_rows: int = MIN_ROWS,
    min_cov: float = MIN_COVERAGE,
) -> DataFrame:
    """Series the gate drops, with the reason."""
    clean = _gate_input(readings, seq, lo, hi)
    facts = window_facts(clean, break_hours, limit, min_rows, min_cov)
    known = readings.groupBy("series_id").agg(F.count(F.lit(1)).alias("raw_rows"))
    out = known.join(facts.select("series_id", "n", "reject_reason"), "series_id", "left")
    out = out.withColumn(
        "reject_reason",
        F.when(F.col("n").isNull(), F.lit("no valid reading")).otherwise(F.col("reject_reason")),
    )
    return out.filter("reject_reason IS NOT NULL").fillna(0, ["n"])


def audit_report(
    readings: DataFrame,
    tiers: DataFrame | None = None,
    seq: str = "seq",
    lo: float | None = 0.0,
    hi: float | None = 985.0,
    min_rows: int = MIN_ROWS,
    min_cov: float = MIN_COVERAGE,
) -> DataFrame:
    """Per series: raw rows and coverage, usable hours and dates, PASS."""
    span_h = seconds_between(F.max("ts"), F.min("ts")) / F.lit(float(HOUR)) + 1
    raw = readings.groupBy("series_id").agg(
        F.count(F.lit(1)).alias("raw_rows"),
        (F.lit(100.0) * F.count(F.lit(1)) / span_h).alias("raw_cov_pct"),
    )
    facts = window_facts(
        _gate_input(readings, seq, lo, hi), min_rows=min_rows, min_cov=min_cov
    )
    passed = facts.filter("reject_reason IS NULL").select("series_id", "n", "usable_from", "usable_to")
    out = raw.join(passed, "series_id", "left")
    if tiers is not None:
        out = out.join(tiers.select("series_id", "tier"), "series_id", "left")
    else:
        out = out.withColumn("tier", F.lit(None).cast("string"))
    return out.select(
        "series_id",
        F.coalesce("tier", F.lit("?")).alias("tier"),
        "raw_rows",
        "raw_cov_pct",
        F.coalesce("n", F.lit(0)).alias("usable_hours"),
        F.to_date("usable_from").alias("usable_from"),
        F.to_date("usable_to").alias("usable_to"),
        F.col("n").isNotNull().alias("passed"),
    )


def audit_order(report: DataFrame) -> DataFrame:
    return report.orderBy(F.desc("passed"), F.asc("tier"), F.desc("usable_hours"), F.asc("series_id"))


def pass_counts(report: DataFrame) -> DataFrame:
    return report.groupBy("tier").agg(
        F.count(F.lit(1)).alias("n_series"), F.count_if("passed").alias("n_pass")
    )


def clip_to_window(
    target: DataFrame,
    window: DataFrame,
    columns: Sequence[str],
    limit: int = INTERP_LIMIT,
    min_rows: int = MIN_ROWS,
) -> DataFrame:
    """Second-domain values on the first domain's stamps, inside own coverage.

    Rows of ``window`` (a gated panel) between the first and last target stamp
    are kept, target columns joined and interpolated by row.  A series that is
    too short, or still has a hole, is refused with a reason instead of padded.
    """
    cover = target.groupBy("series_id").agg(F.min("ts").alias("_lo"), F.max("ts").alias("_hi"))
    idx = window.select("series_id", "ts", F.col("pos").alias("_wpos")).withColumn(
        "_b", chunk_of("_wpos")
    )
    idx = spread(idx, cover, KEY, "_b").filter(F.col("ts").between(F.col("_lo"), F.col("_hi")))
    # the kept rows are consecutive, so the window's own positions still count rows
    idx = idx.select("series_id", "ts", F.col("_wpos").alias("pos"))
    out = idx.join(target.select("series_id", "ts", *columns), ["series_id", "ts"], "left")
    for c in columns:
        out = interpolate(out, limit, value=c)
    # read twice below: for the verdict and for the rows
    out = settled(out, "clipped")
    hole = F.lit(False)
    for c in columns:
        hole = hole | F.col(c).isNull()
    verdict = out.groupBy("series_id").agg(
        F.when(F.count(F.lit(1)) < min_rows, F.lit("too few rows"))
        .when(F.bool_or(hole), F.lit("hole inside coverage"))
        .alias("reject_reason")
    )
    return spread(out.withColumn("_b", chunk_of()), verdict, KEY, "_b").drop("_b")


def min_length(
    panel: DataFrame, season: int, weeks: int, horizon: int, folds: int
) -> DataFrame:
    """Per series: length and why it cannot be backtested (null if it can)."""
    size = panel.groupBy("series_id").agg(F.count(F.lit(1)).alias("n"))
    need = 7 * season * weeks
    reason = F.when(F.col("n") <= need, F.lit("shorter than the minimum history")).when(
        F.col("n") - folds * horizon <= 0, F.lit("no fold fits")
    )
    return size.withColumn("reject_reason", reason)


def since(df: DataFrame, cutoff: str) -> DataFrame:
    """Readings at or after the cutoff; a plain predicate, so the scan sees it."""
    return df.filter(F.col("ts") >= F.lit(cutoff).cast("timestamp"))


def tail_rows(panel: DataFrame, rows: int) -> DataFrame:
    """Last ``rows`` rows of each series, by arithmetic on position and length."""
    return panel.filter(F.col("pos") >= F.col("n") - rows)


def check_rules(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Count violations of row rules; a null outcome is not a violation."""
    counts = df.agg(*[F.count_if(~ok).alias(name) for name, ok in rules.items()])
    pairs = [F.struct(F.lit(n).alias("rule"), F.col(n).alias("violations")) for n in rules]
    return counts.select(F.inline(F.array(*pairs)))


def rule_percentages(total: Column, tol: float = 1.5) -> Column:
    return F.abs(total - 100.0) <= tol


def rule_brier(brier: Column, prevalence: Column, tol: float = 0.005) -> Column:
    return brier <= prevalence * (1 - prevalence) + tol


def rule_ci_agrees_with_p(
    p: Column, lo: Column, hi: Column, null_value: float = 1.0, alpha: float = 0.05
) -> Column:
    crosses = (lo <= null_value) & (F.lit(null_value) <= hi)
    return (p < alpha) != crosses


def rule_direction(estimate: Column, expected: str, null_value: float = 1.0) -> Column:
    if expected == "protective":
        return estimate < null_value
    if expected == "harmful":
        return estimate > null_value
    return F.lit(True)


def rule_min_rows(n: Column, least: int) -> Column:
    return n >= least


def calibration_bins(df: DataFrame, keys: Sequence[str], predicted: str, outcome: str, bins: int = 10, least: int = 10) -> DataFrame:
    """Non-empty equal-width bins of predictions in [0, 1] per key: their number, the widest miss, and whether there are enough.

    A calibration curve on fewer than ``least`` bins hides what it should show.
    """
    at = F.least(F.floor(F.col(predicted) * bins), F.lit(bins - 1)).alias("_bin")
    cells = df.filter(F.col(predicted).between(0.0, 1.0) & F.col(outcome).isNotNull()).groupBy(*keys, at)
    cells = cells.agg(F.count(F.lit(1)).alias("n"), F.abs(F.avg(F.col(outcome).cast("double")) - F.avg(predicted)).alias("_miss"))
    out = cells.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_bins"), F.sum("n").alias("n"), F.max("_miss").alias("widest_miss"))
    return out.withColumn("enough_bins", F.col("n_bins") >= least)
