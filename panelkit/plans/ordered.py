"""Ordered computations that never put one whole key into one task.

A plain ``Window.partitionBy(series)`` sends a series to a single task.  When
one series may hold a third of all rows that task decides the run time, so
order-dependent work is done over *buckets* (contiguous pieces of a series):

* ``carried``/``running``/``neighbours``: solve inside each bucket, reduce each
  bucket to one summary row, scan the few summaries per key, join the carry
  back on ``(key, bucket)``.  The rows are shuffled once, on (key, bucket);
  the summary side is small.
* ``over_rows``: bounded look-back/look-ahead.  Rows near a chunk border are
  copied to the neighbouring chunk, so lags and rolling frames are exact.
* ``affine_scan``: linear recursions of one row on the row before, as compositions of
  (a, b) pairs per chunk that are carried from chunk to chunk.
* ``spread``: joins per-key facts to rows on (key, bucket) instead of key.
* ``ranked_values``: exact ranks and order statistics without sorting a key in
  one task and without a per-key buffer; a sketch of a large key picks its cells.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelkit.functions.columns import magnitude_bucket

CHUNK_ROWS = 16_384


def chunk_of(pos: str = "pos", rows: int = CHUNK_ROWS) -> Column:
    return F.floor(F.col(pos) / F.lit(rows))


def spread(rows: DataFrame, facts: DataFrame, keys: Sequence[str], bucket: str, how: str = "inner") -> DataFrame:
    """Join per-key ``facts`` to ``rows`` on (keys, bucket).

    The facts are copied once per non-empty bucket of their key, so the row
    side is joined on a balanced key.  Rows whose key has no facts drop out,
    unless ``how`` is "left".
    """
    cells = rows.groupBy(*keys, bucket).agg(F.lit(1).alias("_one")).drop("_one")
    return rows.join(cells.join(facts, list(keys)), [*keys, bucket], how)


def running(
    df: DataFrame,
    keys: Sequence[str],
    bucket: str,
    order: str,
    sums: dict[str, Column],
    totals: dict[str, Column] | None = None,
) -> DataFrame:
    """Running sums (up to and including the row) plus per-key totals."""
    totals = totals or {}
    part = [*keys, bucket]
    inside = Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    pre = df.select("*", *[c.alias(f"_x_{k}") for k, c in {**sums, **totals}.items()])
    cells = pre.groupBy(*part).agg(*[F.sum(f"_x_{k}").alias(f"_s_{k}") for k in {**sums, **totals}])
    carry = cells.select(
        *part,
        *[F.coalesce(F.sum(f"_s_{k}").over(earlier), F.lit(0)).alias(f"_c_{k}") for k in sums],
        *[F.sum(f"_s_{k}").over(whole).alias(k) for k in totals],
    )
    out = pre.select("*", *[F.sum(f"_x_{k}").over(inside).alias(f"_i_{k}") for k in sums])
    out = out.join(carry, part)
    return out.select(
        *df.columns,
        *[(F.col(f"_c_{k}") + F.col(f"_i_{k}")).alias(k) for k in sums],
        *list(totals),
    )


def with_position(
    df: DataFrame,
    keys: Sequence[str],
    bucket: str,
    order: str,
    pos: str = "pos",
    total: str | None = "n",
) -> DataFrame:
    """0-based row position inside each key, and the key's row count."""
    one = F.lit(1).cast("long")
    out = running(df, keys, bucket, order, {pos: one}, {total: one} if total else None)
    return out.withColumn(pos, F.col(pos) - 1)


def previous(
    df: DataFrame,
    keys: Sequence[str],
    bucket: str,
    order: str,
    columns: dict[str, str],
    ahead: bool = False,
) -> DataFrame:
    """Values of the row before (or after) in the key: ``{new_name: column}``."""
    part = [*keys, bucket]
    inside = Window.partitionBy(*part).orderBy(order)
    across = Window.partitionBy(*keys).orderBy(bucket)
    step = F.lead if ahead else F.lag
    edge = F.min_by if ahead else F.max_by
    cells = df.groupBy(*part).agg(
        *[edge(F.col(c), F.col(order)).alias(f"_e_{k}") for k, c in columns.items()]
    )
    cells = cells.select(*part, *[step(f"_e_{k}").over(across).alias(f"_c_{k}") for k in columns])
    out = df.select(
        "*",
        F.row_number()
        .over(Window.partitionBy(*part).orderBy(F.col(order).desc() if ahead else F.col(order)))
        .alias("_edge"),
        *[step(c).over(inside).alias(f"_i_{k}") for k, c in columns.items()],
    )
    out = out.join(cells, part)
    return out.select(
        *df.columns,
        *[
            F.when(F.col("_edge") == 1, F.col(f"_c_{k}")).otherwise(F.col(f"_i_{k}")).alias(k)
            for k in columns
        ],
    )


def neighbours(
    df: DataFrame, keys: Sequence[str], bucket: str, order: str, value: str
) -> DataFrame:
    """Nearest non-null value at or before, and at or after, every row.

    Adds prev_at, prev_value, next_at and next_value (``order`` and ``value``
    of those rows), at any distance.
    """
    part = [*keys, bucket]
    at = F.when(F.col(value).isNotNull(), F.col(order))
    back = Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    fwd = Window.partitionBy(*part).orderBy(order).rowsBetween(0, Window.unboundedFollowing)
    before = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(1, Window.unboundedFollowing)
    cells = df.groupBy(*part).agg(
        F.max(at).alias("_la"),
        F.max_by(F.col(value), at).alias("_lv"),
        F.min(at).alias("_fa"),
        F.min_by(F.col(value), at).alias("_fv"),
    )
    cells = cells.select(
        *part,
        F.last("_la", ignorenulls=True).over(before).alias("_ba"),
        F.last("_lv", ignorenulls=True).over(before).alias("_bv"),
        F.first("_fa", ignorenulls=True).over(after).alias("_aa"),
        F.first("_fv", ignorenulls=True).over(after).alias("_av"),
    )
    out = df.select(
        "*",
        F.last(at, ignorenulls=True).over(back).alias("_pa"),
        F.last(value, ignorenulls=True).over(back).alias("_pv"),
        F.first(at, ignorenulls=True).over(fwd).alias("_na"),
        F.first(value, ignorenulls=True).over(fwd).alias("_nv"),
    ).join(cells, part)
    return out.select(
        *df.columns,
        F.coalesce("_pa", "_ba").alias("prev_at"),
        F.coalesce("_pv", "_bv").alias("prev_value"),
        F.coalesce("_na", "_aa").alias("next_at"),
        F.coalesce("_nv", "_av").alias("next_value"),
    )


def over_rows(
    df: DataFrame,
    keys: Sequence[str],
    columns: Callable[[Window], dict[str, Column]],
    before: int = 0,
    after: int = 0,
    pos: str = "pos",
    rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Window columns that look at most ``before``/``after`` rows away.

    ``pos`` must be the 0-based position in the key.  ``columns`` receives a
    window over (keys, chunk) ordered by position.  One exchange, and no task
    holds more than a chunk plus its borders of any key.
    """
    rows = max(rows, before, after)
    home = F.floor(F.col(pos) / F.lit(rows))
    offset = F.col(pos) - home * rows
    on, back = offset >= rows - before, (offset < after) & (home > 0)
    # spelt out, for a lambda over an array would keep every row out of generated code
    chunks = (
        F.when(on & back, F.array(home, home + 1, home - 1))
        .when(on, F.array(home, home + 1))
        .when(back, F.array(home, home - 1))
        .otherwise(F.array(home))
    )
    copies = df.select("*", home.alias("_home"), F.explode(chunks).alias("_chunk"))
    w = Window.partitionBy(*keys, "_chunk").orderBy(pos)
    new = columns(w)
    out = copies.select("*", *[c.alias(k) for k, c in new.items()])
    return out.filter(F.col("_home") == F.col("_chunk")).drop("_home", "_chunk")


#: Rows of a chunk, and chunks of a group, that ``affine_scan`` folds at a time.
SCAN_ROWS = 256


#: Steps that ``_composed`` folds one by one; above, pieces of so many.
PIECE_ROWS = 16


def _after(last: Column, step: Column) -> Column:
    """x -> a x + b of ``step`` after ``last``."""
    return F.struct((step["a"] * last["a"]).alias("a"), (step["a"] * last["b"] + step["b"]).alias("b"))


def _unchanged() -> Column:
    return F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("b"))


def _whole(steps: Column) -> Column:
    """Composition of all steps of an ordered array."""
    return F.aggregate(steps, _unchanged(), _after)


def _composed(steps: Column) -> Column:
    """Prefix compositions of x -> a x + b over an ordered array: structs (a, b), each of all steps up to its own.

    An array grows by being copied, so the steps of a piece are folded by themselves and pieces are appended whole.
    """
    none = F.array().cast("array<struct<a:double,b:double>>")

    def last(done: Column) -> Column:
        return F.coalesce(F.get(done, F.size(done) - 1), _unchanged())

    def inside(i: Column) -> Column:
        piece = F.slice(steps, i * PIECE_ROWS + 1, PIECE_ROWS)
        return F.aggregate(piece, none, lambda done, step: F.concat(done, F.array(_after(last(done), step))))

    pieces = F.transform(F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / PIECE_ROWS).cast("int")), inside)
    return F.aggregate(pieces, none, lambda done, piece: F.concat(done, F.transform(piece, lambda step: _after(last(done), step))))


def affine_scan(
    df: DataFrame, keys: Sequence[str], a: Column, b: Column, name: str, pos: str = "pos", rows: int = SCAN_ROWS
) -> DataFrame:
    """``name`` = a * (``name`` of the row before) + b along ``pos``, from 0 before the first row of each key.

    Steps compose associatively: a chunk of rows is one (a, b) pair, a group of chunks
    again.  Chunks are folded by themselves, their pairs in groups, the groups' pairs per
    key, where ``rows``^2 rows are one pair; what enters a chunk comes back by joins
    on (keys, chunk).  Any ``a`` is allowed, 0 restarts the recursion.  ``pos`` must be
    the distinct 0-based position.  Nulls in ``a`` or ``b`` count as no change: a = 1, b = 0.
    ``rows`` is held between 16 and ``SCAN_ROWS``.
    """
    keys, rows = list(keys), min(max(rows, 16), SCAN_ROWS)
    known = F.col("_factor").isNotNull() & F.col("_added").isNotNull()
    step = F.struct(
        F.col(pos).alias("_at"),
        F.when(known, F.col("_factor")).otherwise(1.0).alias("a"),
        F.when(known, F.col("_added")).otherwise(0.0).alias("b"),
        F.struct(*df.columns).alias("row"),
    )
    # a and b may be dear, so each is worked out once a row
    given = df.select("*", a.cast("double").alias("_factor"), b.cast("double").alias("_added"))
    cells = given.groupBy(*keys, F.floor(F.col(pos) / F.lit(rows)).alias("_chunk")).agg(F.sort_array(F.collect_list(step)).alias("_steps"))
    pairs = cells.select(*keys, "_chunk", F.floor(F.col("_chunk") / F.lit(rows)).alias("_group"), _whole(F.col("_steps")).alias("_pair"))
    cells = cells.withColumn("_done", _composed(F.col("_steps")))

    def entered(pairs: DataFrame, part: Sequence[str], order: str) -> DataFrame:
        """Pairs of a part with the composition of all before them in it, and the composition of the whole part."""
        g = pairs.groupBy(*part).agg(F.sort_array(F.collect_list(F.struct(F.col(order), F.col("_pair.a"), F.col("_pair.b")))).alias("_steps"))
        g = g.withColumn("_done", _composed(F.col("_steps")))
        before = F.transform(
            "_steps", lambda s, i: F.struct(s[order].alias(order), F.when(i > 0, F.get(F.col("_done"), i - 1)).alias("_before"))
        )
        return g.select(*part, F.element_at("_done", -1).alias("_whole"), before.alias("_entries"))

    groups = entered(pairs, [*keys, "_group"], "_chunk")
    tops = entered(groups.select(*keys, "_group", F.col("_whole").alias("_pair")), keys, "_group")
    tops = tops.select(*keys, F.inline("_entries")).select(*keys, "_group", F.coalesce("_before.b", F.lit(0.0)).alias("_top"))
    inner = groups.select(*keys, "_group", F.inline("_entries")).join(tops, [*keys, "_group"])
    # from 0 at the key's start, what leaves the composition (a, b) after ``_top`` is a * _top + b
    enters = F.coalesce(F.col("_before.a"), F.lit(1.0)) * F.col("_top") + F.coalesce(F.col("_before.b"), F.lit(0.0))
    carried = cells.join(inner.select(*keys, "_chunk", enters.alias("_enters")), [*keys, "_chunk"])
    out = F.zip_with("_steps", "_done", lambda s, d: F.struct(s["row"].alias("row"), (d["a"] * F.col("_enters") + d["b"]).alias(name)))
    return carried.select(F.inline(out)).select("row.*", name)


#: Quantiles a sketch gives of a large key, equal steps between two of them, copies of the sketch.
EDGES, STEPS, COPIES = 64, 1024, 32


def value_cells(
    v: DataFrame, keys: Sequence[str], value: str, rows: int = CHUNK_ROWS, edges: int = EDGES, steps: int = STEPS, copies: int = COPIES
) -> DataFrame:
    """``v`` with "_bucket", contiguous pieces of the order of ``value`` in each key.

    Keys of at most ``rows`` rows are one piece.  A larger key has ``edges``
    quantiles of a mergeable sketch, each interval cut into equal ``steps``, so
    pieces follow the data wherever they lie and however far from zero.  The
    sketch only places the cuts; whatever is counted over the pieces is exact.
    Large keys are at most one in ``rows`` rows, and their edges are copied
    ``copies`` times for a join that a hot key cannot skew.
    """
    keys = list(keys)
    x = F.col(value).cast("double")
    probs = F.array(*[F.lit(i / edges) for i in range(edges + 1)])
    sketch = v.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"), F.percentile_approx(x, probs, 20 * edges).alias("_edges"))
    large = sketch.filter(F.col("_rows") > rows).select(*keys, "_edges", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("_copy"))
    dealt = v.withColumn("_copy", F.pmod(F.xxhash64(value), F.lit(copies)).cast("int")).join(large, [*keys, "_copy"], "left")
    dealt = dealt.withColumn("_at", F.lit(0))
    for half in (1 << i for i in reversed(range((edges + 1).bit_length()))):
        # edges at or below x, by halving; a project a step keeps it in generated code
        passed = F.get("_edges", F.col("_at") + (half - 1)) <= x
        dealt = dealt.withColumn("_at", F.col("_at") + F.when(passed, half).otherwise(0))
    at = F.col("_at")
    lo, hi = F.get("_edges", at - 1), F.get("_edges", at)
    step = F.when(hi > lo, F.least(F.floor((x - lo) / (hi - lo) * F.lit(float(steps))), F.lit(steps - 1)))
    bucket = F.when(F.col("_edges").isNull(), F.lit(0).cast("long")).otherwise(at.cast("long") * steps + F.coalesce(step, F.lit(0)))
    return dealt.withColumn("_bucket", bucket).select(*v.columns, "_bucket")


def ranked_values(
    df: DataFrame, keys: Sequence[str], value: str, sums: dict[str, Column] | None = None, near_zero: bool = False
) -> DataFrame:
    """One row per distinct value of a key with its place in the order.

    Columns: keys, ``value``, cnt (rows holding it), before (rows strictly
    below it) and total (rows of the key), plus the given per-value sums.
    Nulls are left out.  Ties collapse before the shuffle.  ``near_zero`` is for
    values without an offset by construction, such as p values: the logarithm
    cuts them well, and no sketch is needed.
    """
    sums = sums or {}
    v = df.filter(F.col(value).isNotNull())
    v = v.groupBy(*keys, value).agg(
        F.count(F.lit(1)).alias("cnt"), *[F.sum(c).alias(k) for k, c in sums.items()]
    )
    v = v.withColumn("_bucket", magnitude_bucket(value)) if near_zero else value_cells(v, keys, value)
    v = running(v, keys, "_bucket", value, {"_upto": F.col("cnt")}, {"total": F.col("cnt")})
    return v.select(
        *keys, value, "cnt", (F.col("_upto") - F.col("cnt")).alias("before"), "total", *sums
    )


def quantiles_of(
    ranked: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float]
) -> DataFrame:
    """Linear-interpolated quantiles from ``ranked_values`` output."""
    aggs = [F.max("total").alias("total")]
    for name, p in probs.items():
        h = (F.col("total") - 1) * F.lit(float(p))
        for side, at in (("lo", F.floor(h)), ("hi", F.ceil(h))):
            hit = (F.col("before") <= at) & (at < F.col("before") + F.col("cnt"))
            aggs.append(F.max(F.when(hit, F.col(value))).alias(f"_{side}_{name}"))
    g = ranked.groupBy(*keys).agg(*aggs)
    out = []
    for name, p in probs.items():
        h = (F.col("total") - 1) * F.lit(float(p))
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        out.append((lo + (hi - lo) * (h - F.floor(h))).alias(name))
    return g.select(*keys, F.col("total").alias("n"), *out)


def group_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float], near_zero: bool = False
) -> DataFrame:
    """Exact quantiles per key, without a per-key buffer of values; ``near_zero`` as in ``ranked_values``."""
    return quantiles_of(ranked_values(df, keys, value, near_zero=near_zero), keys, value, probs)


def running_extreme(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    value: Column,
    name: str,
    smallest: bool,
    descending: bool,
) -> DataFrame:
    """Running minimum or maximum along a numeric order of each key."""
    part = [*keys, "_bucket"]
    fn, merge = (F.min, F.least) if smallest else (F.max, F.greatest)
    pre = df.withColumns({"_bucket": magnitude_bucket(order), "_x": value})

    def direction(c: str) -> Column:
        return F.desc(c) if descending else F.asc(c)

    inside = Window.partitionBy(*part).orderBy(direction(order)).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*keys).orderBy(direction("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
    cells = pre.groupBy(*part).agg(fn("_x").alias("_m"))
    cells = cells.select(*part, fn("_m").over(earlier).alias("_carry"))
    out = pre.withColumn("_in", fn("_x").over(inside)).join(cells, part)
    return out.select(*df.columns, merge("_in", "_carry").alias(name))
