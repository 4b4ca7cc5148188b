"""Direct boosted trees, one model per series, lead and (if wanted) fold, and their exact attribution.

Spark cuts the training rows into blocks of a series and fold, moves each block
once and grows all leads of a few blocks together from histograms.  A series with more
than ``block_rows`` design rows is dealt over several blocks by a hash of its
positions; each block is a model of its own and forecasts are their mean by rows, so that no
series has to fit into one task and no row is left out.  Level-wise sums over all rows would
cost a Spark pass per level and round, 1,250 of them for 250 rounds of depth 5.

The trees grow in the executors' virtual machines (``native``); numpy grows the same ones where there is none.
Rows are sorted inside their block and draws are seeded from its key, so a block that
is computed again gives the same trees.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import chain
from math import factorial
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelkit.operators import native
from panelkit.operators.backtest import first_test_pos, first_train_end
from panelkit.operators.native import EXPLAIN, FORECAST, packed
from panelkit.session import fanned_out


@dataclass(frozen=True)
class Boosting:
    """Parameters of the trees; a leaf holds at least ``min_rows`` of the rows drawn for its round."""

    rounds: int = 250
    rate: float = 0.05
    depth: int = 5
    min_rows: int = 20
    bins: int = 64
    subsample: float = 0.8
    seed: int = 42


@dataclass
class Trees:
    """Trees by (round, group, heap node): split feature (-1: leaf), last bin on the left, value, drawn rows; and each group's level."""

    level: np.ndarray
    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    cover: np.ndarray


def bin_edges(x: np.ndarray, bins: int) -> list[np.ndarray]:
    """Upper edges (inclusive) of at most ``bins`` bins of every column: its values, or their quantiles if it has too many."""
    edges = []
    for column in x.T:
        values = np.unique(column)
        if len(values) > bins:
            values = np.unique(np.quantile(column, np.arange(1, bins) / bins, method="lower"))
        else:
            values = values[:-1]
        edges.append(values)
    return edges


def binned(x: np.ndarray, edges: Sequence[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, c) for e, c in zip(edges, x.T, strict=True)], axis=1).astype(np.int64)


def _children(node: np.ndarray, first: np.ndarray, row: np.ndarray, codes: np.ndarray, feature: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """Nodes one level below; rows in a leaf stay.  Nodes of all groups are numbered through, ``first`` is the root of a row's group."""
    f = feature.take(node)
    moving = np.flatnonzero(f >= 0)
    old = node.take(moving)
    right = codes.take(row.take(moving) + f.take(moving)) > cut.take(old)
    out = node.copy()
    out[moving] = 2 * old - first.take(moving) + 1 + right
    return out


def grow(codes: np.ndarray, group: np.ndarray, target: np.ndarray, groups: int, p: Boosting, seed: Sequence[int] = ()) -> Trees:
    """Boost the trees of all groups side by side; squared loss, ties go to the first feature and bin."""
    return grow_blocks(codes, group, target, groups, p, [(len(codes), seed)])


def grow_blocks(
    codes: np.ndarray, group: np.ndarray, target: np.ndarray, groups: int, p: Boosting, blocks: Sequence[tuple[int, Sequence[int]]]
) -> Trees:
    """``grow`` of several blocks of rows at once, each (rows, seed) with groups and draws of its own.

    Small blocks share the cost of a call this way; the trees are those of one call a block.  Gains are
    worked out only where a split leaves enough rows on both sides and parts other rows than the bin before.
    """
    n, width = codes.shape
    draws = [(rows, np.random.default_rng([p.seed, *seed])) for rows, seed in blocks]
    nodes = 2 ** (p.depth + 1) - 1
    level = np.bincount(group, target, groups) / np.maximum(np.bincount(group, minlength=groups), 1)
    shape = (p.rounds, groups, nodes)
    trees = Trees(level, np.full(shape, -1), np.zeros(shape, np.int64), np.zeros(shape), np.zeros(shape))
    fitted = level[group]
    size = width * p.bins
    places = codes + np.arange(width) * p.bins  # of a row in the histogram of its node
    flat_codes, first_code, root = codes.ravel(), np.arange(n) * width, group * nodes
    for t in range(p.rounds):
        feature, cut = trees.feature[t].reshape(-1), trees.cut[t].reshape(-1)
        used = np.flatnonzero(np.concatenate([draw.random(rows) for rows, draw in draws]) < p.subsample)
        rest = target - fitted
        node = root
        for d in range(p.depth):
            lowest, wide = 2**d - 1, 2**d
            own = node.take(used)
            held = np.bincount(own, minlength=groups * nodes).reshape(groups, nodes)[:, lowest : lowest + wide]
            g, at = np.nonzero(held >= 2 * p.min_rows)  # others cannot split
            if not len(g):
                break
            asked = g * nodes + lowest + at
            slot_of = np.full(groups * nodes, -1)
            slot_of[asked] = np.arange(len(g))
            slot = slot_of.take(own)
            inside = np.flatnonzero(slot >= 0)
            live = used.take(inside)
            cells = (places.take(live, axis=0) + (slot.take(inside) * size)[:, None]).ravel()
            left = np.bincount(cells, np.repeat(rest.take(live), width), len(g) * size).reshape(-1, p.bins).cumsum(axis=1)
            counts = np.bincount(cells, minlength=len(g) * size).reshape(-1, p.bins)
            n_left, n_both = counts.cumsum(axis=1), np.repeat(held[g, at], width)
            able = (n_left >= p.min_rows) & (n_left <= (n_both - p.min_rows)[:, None]) & (counts > 0)
            cell = np.flatnonzero(able)
            line = np.repeat(np.arange(len(able)), np.count_nonzero(able, axis=1))
            both = left[:, -1]
            a, n_a, n_b = left.take(cell), n_left.take(cell), n_both.take(line)
            gain = np.zeros(len(g) * size)
            gain[cell] = a**2 / n_a + (both.take(line) - a) ** 2 / (n_b - n_a) - (both**2 / n_both).take(line)
            gain = gain.reshape(len(g), size)
            best = gain.argmax(axis=1)
            split = np.flatnonzero(gain[np.arange(len(best)), best] > 0)
            if not len(split):
                break
            parent = asked.take(split)
            feature[parent], cut[parent] = np.divmod(best.take(split), p.bins)
            node = _children(node, root, first_code, flat_codes, feature, cut)
        flat = node.take(used)
        cover = np.bincount(flat, minlength=groups * nodes).reshape(groups, nodes).astype(float)
        total = np.bincount(flat, rest.take(used), groups * nodes).reshape(groups, nodes)
        trees.value[t] = p.rate * total / np.maximum(cover, 1)
        for i in range(p.depth - 1, -1, -1):
            above, below = slice(2**i - 1, 2 ** (i + 1) - 1), 2 ** (i + 1) - 1
            cover[:, above] += cover[:, below : 2 * below + 1 : 2] + cover[:, below + 1 : 2 * below + 2 : 2]
        trees.cover[t] = cover
        fitted = fitted + trees.value[t].reshape(-1).take(node)
    return trees


def values(trees: Trees, codes: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Predictions of rows by the trees of their groups."""
    out = trees.level[group].copy()
    depth, groups, nodes = (trees.feature.shape[2] + 1).bit_length() - 2, *trees.feature.shape[1:]
    flat_codes, row, root = codes.ravel(), np.arange(len(group)) * codes.shape[1], group * nodes
    for feature, cut, value in zip(*(a.reshape(-1, groups * nodes) for a in (trees.feature, trees.cut, trees.value)), strict=True):
        node = root
        for _ in range(depth):
            node = _children(node, root, row, flat_codes, feature, cut)
        out += value.take(node)
    return out


def _leaf_tables(outside: np.ndarray) -> np.ndarray:
    """Shapley values of leaves of value 1 by which of their k features agree (a bit each): leaves x 2^k x k.

    A feature that is known counts 1 if it agrees, else 0; one that is not counts its share of rows.
    """
    k = outside.shape[1]
    agrees = (np.arange(2**k)[:, None] >> np.arange(k) & 1).astype(float)
    weight = np.array([factorial(s) * factorial(k - 1 - s) / factorial(k) for s in range(k)])
    out = np.empty((len(outside), 2**k, k))
    for i in range(k):
        by_size = np.zeros((len(outside), 2**k, k))
        by_size[:, :, 0] = 1
        for j in range(k):
            if j != i:
                known = by_size[:, :, :-1] * agrees[:, j : j + 1]
                by_size *= outside[:, j, None, None]
                by_size[:, :, 1:] += known
        out[:, :, i] = (agrees[:, i] - outside[:, i, None]) * (by_size @ weight)
    return out


#: Values of leaves, rows and features that ``shapley`` holds at a time.
SHAPLEY_CELLS = 500_000


def shapley(trees: Trees, codes: np.ndarray, group: int = 0) -> tuple[np.ndarray, float]:
    """(rows x features exact Shapley values, mean of the trees) of one group, features unknown by the rows of each branch.

    A leaf is a game of the features on its way only, at most ``depth`` of them, so each
    leaf has one small table and a row looks up which of its features agree; leaves of the same
    number of features are worked out together, over all trees.  The values of a row and
    the mean sum to its prediction.
    """
    feature, cut, value, cover = (a[:, group] for a in (trees.feature, trees.cut, trees.value, trees.cover))
    rows, width = codes.shape
    # by tree, node and feature: bounds of the way to the node and its share of rows; 1 above all bins for "no bound"
    low = np.full((*feature.shape, width), -1)
    high = np.full((*feature.shape, width), max(int(cut.max(initial=0)), int(codes.max(initial=0))) + 1)
    share, met = np.ones(low.shape), np.zeros(low.shape, bool)
    there = np.zeros(feature.shape, bool)
    there[:, 0] = cover[:, 0] > 0
    for node in range(feature.shape[1] // 2):
        t = np.flatnonzero(there[:, node] & (feature[:, node] >= 0))
        f, at = feature[t, node], cut[t, node]
        for child in (2 * node + 1, 2 * node + 2):
            for a in (low, high, share, met):
                a[t, child] = a[t, node]
            there[t, child], met[t, child, f] = True, True
            share[t, child, f] *= cover[t, child] / cover[t, node]
        high[t, 2 * node + 1, f] = np.minimum(high[t, node, f], at)
        low[t, 2 * node + 2, f] = np.maximum(low[t, node, f], at)
    leaf = there & (feature < 0)
    mean = float(trees.level[group] + (value * cover / np.maximum(cover[:, :1], 1))[leaf].sum())
    tree, node = np.nonzero(leaf & (value != 0))
    met, low, high, share, worth = met[tree, node], low[tree, node], high[tree, node], share[tree, node], value[tree, node]
    out, held = np.zeros((width, rows)), met.sum(axis=1)
    columns = np.ascontiguousarray(codes.T)
    for k in np.unique(held[held > 0]):
        alike = np.flatnonzero(held == k)
        step = max(1, SHAPLEY_CELLS // max(rows * k, 2**k * k))
        for own in (alike[i : i + step] for i in range(0, len(alike), step)):
            names = np.nonzero(met[own])[1].reshape(-1, k)
            line = np.arange(len(own))[:, None]
            own_low, own_high = low[own][line, names], high[own][line, names]
            bits = np.zeros((len(own), rows), np.int64)
            for j in range(k):
                column = columns[names[:, j]]
                bits |= ((column > own_low[:, j, None]) & (column <= own_high[:, j, None])).astype(np.int64) << j
            tables = _leaf_tables(share[own][line, names]) * worth[own, None, None]
            places = bits + line * 2**k
            for j in range(k):
                part = tables[:, :, j].reshape(-1).take(places)
                order = np.argsort(names[:, j], kind="stable")
                found, start = np.unique(names[order, j], return_index=True)
                out[found] += np.add.reduceat(part[order], start, axis=0)
    return out.T, mean


def _complete(features: Sequence[str]) -> Column:
    whole = F.lit(True)
    for f in features:
        x = F.col(f).cast("double")
        whole = whole & x.isNotNull() & ~F.isnan(x)
    return whole


def _training(design_rows: DataFrame, features: Sequence[str]) -> DataFrame:
    y = F.col("target").cast("double")
    return design_rows.filter(y.isNotNull() & ~F.isnan(y) & _complete(features))


def _blocks(leads: int, block_rows: int) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.col("n") * leads / block_rows)).cast("long")


def _block_of(leads: int, block_rows: int) -> Column:
    return F.pmod(F.xxhash64("pos"), _blocks(leads, block_rows))


_GROUP = ["series_id", "_fit", "_block"]


def _seed(series, *rest: int) -> list[int]:
    return [crc32(str(series).encode()), *(int(v) for v in rest)]


#: Rows and groups (series, block and lead) that are grown at a time, enough to make numpy's calls cheap.
BATCH_ROWS, BATCH_GROUPS = 8_192, 64


def _batches(frames: Iterator[pd.DataFrame], leads: int) -> Iterator[list[pd.DataFrame]]:
    """The blocks of a task, whole and a few at a time, from its rows in the order of their blocks."""
    held, rows, wanted, batch, size = [], 0, BATCH_ROWS, [], 0

    def parts(whole: pd.DataFrame) -> np.ndarray:
        key = np.column_stack([pd.factorize(whole[c], use_na_sentinel=False)[0] for c in _GROUP])
        return np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1

    for frame in chain(frames, [None]):
        if frame is not None and len(frame):
            held.append(frame)
            rows += len(frame)
        if not held or (frame is not None and rows < wanted):
            continue
        whole = pd.concat(held, ignore_index=True)
        bounds = [0, *parts(whole), len(whole)]
        # the last block goes on with the next rows, if there are any
        done = len(bounds) - 1 if frame is None else len(bounds) - 2
        for i in range(done):
            batch.append(whole.iloc[bounds[i] : bounds[i + 1]])
            size += len(batch[-1])
            if size >= BATCH_ROWS or len(batch) * leads >= BATCH_GROUPS:
                yield batch
                batch, size = [], 0
        held = [whole.iloc[bounds[done] :]] if bounds[done] < len(whole) else []
        rows = len(whole) - bounds[done]
        wanted = rows + max(rows, BATCH_ROWS)
    if batch:
        yield batch


def _key(block: pd.DataFrame) -> tuple:
    return tuple(block[c].iloc[0] for c in _GROUP)


def _grown(blocks: Sequence[pd.DataFrame], names: Sequence[str], groups: Sequence[np.ndarray], params: Boosting) -> tuple[Trees, list, list]:
    """Trees of blocks of training rows whose groups are given by row, the bin edges of each block and the number of its first group."""
    edges = [bin_edges(b[names].to_numpy(), params.bins) for b in blocks]
    counts = [int(g.max()) + 1 for g in groups]
    first = [0, *np.cumsum(counts).tolist()]
    codes = np.concatenate([binned(b[names].to_numpy(), e) for b, e in zip(blocks, edges, strict=True)])
    group = np.concatenate([g + at for g, at in zip(groups, first[:-1], strict=True)])
    target = np.concatenate([b["target"].to_numpy() for b in blocks])
    seeds = [(len(b), _seed(*_key(b))) for b in blocks]
    return grow_blocks(codes, group, target, first[-1], params, seeds), edges, first


#: Draws that are held at a time; limits of the packed blocks.
DRAWN, NATIVE_BINS, NATIVE_DEPTH, NATIVE_BYTES = 4_000_000, 1 << 15, 16, 1 << 30


def _native(df: DataFrame, features: Sequence[str], params: Boosting, block_rows: int) -> str | None:
    """The function for packed blocks, if they are within its limits."""
    size = block_rows * (2 * len(features) + 12 + params.rounds / 8)
    if params.bins > NATIVE_BINS or params.depth > NATIVE_DEPTH or size > NATIVE_BYTES:
        return None
    return native.trees(df.sparkSession)


def _packed(kind: int, block: pd.DataFrame, names: Sequence[str], group: np.ndarray, asked: np.ndarray, own: np.ndarray, p: Boosting) -> bytes:
    """A block of training rows and the rows that its trees are asked for, with the draws of ``grow_blocks``."""
    x, target, n = block[names].to_numpy(), block["target"].to_numpy(), len(block)
    edges, held = bin_edges(x, p.bins), np.bincount(group)
    draw, step = np.random.default_rng([p.seed, *_seed(*_key(block))]), max(1, DRAWN // n)
    used = [np.packbits(draw.random((min(step, p.rounds - t), n)) < p.subsample, axis=1) for t in range(0, p.rounds, step)]
    used = np.concatenate(used) if used else np.empty(0, np.uint8)
    return packed(kind, binned(x, edges), group, target, np.bincount(group, target) / np.maximum(held, 1), used, binned(asked, edges), own, p)


def direct_trees(
    design_rows: DataFrame,
    features: Sequence[str],
    horizon: int,
    folds: int,
    min_train: int,
    params: Boosting = Boosting(),
    per_fold: bool = False,
    block_rows: int = 200_000,
    model: str = "direct_trees",
) -> DataFrame:
    """Boosted trees per series and lead, predicted at the origins of the folds.

    ``design_rows`` come from ``features.design``.  Trees are fit once, on what
    lies before the first kept fold, or again for every fold (``per_fold``).  Rows with
    a missing feature or target do not train; an origin with a missing feature, or whose
    lead has nothing to train on, keeps its row with no prediction.
    """
    features, names = list(features), [f"_x{i}" for i in range(len(features))]
    x = [F.col(f).cast("double").alias(a) for f, a in zip(features, names, strict=True)]
    target_pos, start = F.col("pos") + F.col("lead"), first_test_pos(horizon, folds)
    limit = first_train_end(horizon, folds, min_train)
    train = _training(design_rows, features).filter(limit.isNotNull())
    if per_fold:
        first = F.greatest(F.floor((target_pos - start) / horizon) + 1, F.floor((limit - start) / horizon)).cast("int")
        train = train.filter(first < folds).withColumn("_fit", F.explode(F.sequence(first, F.lit(folds - 1))))
    else:
        train = train.filter(target_pos < limit).withColumn("_fit", F.lit(0))
    train = train.withColumn("_block", _block_of(horizon, block_rows))
    into = F.col("pos") + 1 - start
    origins = design_rows.filter((into >= 0) & (into % horizon == 0) & F.col("target").isNotNull() & (F.col("pos") + 1 > min_train))
    origins = origins.withColumn("fold", F.floor(into / horizon).cast("int"))
    asked = origins.filter(_complete(features)).withColumn("_fit", F.col("fold") if per_fold else F.lit(0))
    asked = asked.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), _blocks(horizon, block_rows) - 1)))
    kept = [*_GROUP, F.col("lead").cast("long").alias("lead"), F.col("pos").cast("long").alias("pos")]
    rows = train.select(*kept, F.lit(None).cast("int").alias("fold"), F.col("target").cast("double").alias("target"), *x).unionByName(
        asked.select(*kept, "fold", F.lit(None).cast("double").alias("target"), *x)
    )

    def asked_of(batch: Sequence[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, pd.DataFrame, np.ndarray, np.ndarray]]:
        """Training rows, rows asked for and the groups of both, of the blocks that somebody asks."""
        for block in batch:
            trained = block[block["fold"].isna()]
            asked = block[block["fold"].notna() & block["lead"].isin(trained["lead"])]
            if len(asked):
                leads, group = np.unique(trained["lead"], return_inverse=True)
                yield trained, asked, group, np.searchsorted(leads, asked["lead"])

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in _batches(frames, horizon):
            out = []
            for trained, asked, group, own in asked_of(batch):
                block = _packed(FORECAST, trained, names, group, asked[names].to_numpy(), own, params)
                out.append((_key(trained)[0], asked["fold"].astype(int).tolist(), asked["lead"].tolist(), np.bincount(group)[own].tolist(), block))
            if out:
                yield pd.DataFrame(out, columns=["series_id", "fold", "lead", "rows", "block"])

    def fit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in _batches(frames, horizon):
            found = list(asked_of(batch))
            if not found:
                continue
            known, new, groups, owns = zip(*found, strict=True)
            trees, edges, first = _grown(known, names, groups, params)
            codes = np.concatenate([binned(q[names].to_numpy(), e) for q, e in zip(new, edges, strict=True)])
            y = values(trees, codes, np.concatenate([own + at for own, at in zip(owns, first[:-1], strict=True)]))
            weight = np.concatenate([np.bincount(g)[own] for g, own in zip(groups, owns, strict=True)])
            asked = pd.concat(new)
            yield pd.DataFrame({"series_id": asked["series_id"], "fold": asked["fold"].astype(int), "lead": asked["lead"], "y": y, "rows": weight})

    kind = design_rows.schema["series_id"].dataType.simpleString()
    dealt = fanned_out(rows, *_GROUP).sortWithinPartitions(*_GROUP, "lead", "pos")
    function = _native(design_rows, names, params, block_rows)
    if function:
        sent = dealt.mapInPandas(pack, f"series_id {kind}, fold array<int>, lead array<long>, rows array<long>, block binary")
        grown = sent.select("series_id", "fold", "lead", F.call_udf(function, "block").alias("y"), "rows")
        # outer, or Spark would filter by the arrays' size first and grow the trees once more for it
        found = grown.select("series_id", F.inline_outer(F.arrays_zip("fold", "lead", "y", "rows")))
    else:
        found = dealt.mapInPandas(fit, f"series_id {kind}, fold int, lead long, y double, rows long")
    found = found.groupBy("series_id", "fold", "lead").agg(F.try_divide(F.sum(F.col("y") * F.col("rows")), F.sum("rows")).alias("y_pred"))
    return origins.join(found, ["series_id", "fold", "lead"], "left").select(
        "series_id",
        F.lit(model).alias("model"),
        "fold",
        "lead",
        target_pos.alias("pos"),
        F.col("target_ts").alias("ts"),
        F.col("target").alias("y_true"),
        "y_pred",
    )


def tree_attribution(
    design_rows: DataFrame,
    features: Sequence[str],
    horizon: int,
    folds: int,
    min_train: int,
    params: Boosting = Boosting(),
    lead: int = 1,
    block_rows: int = 200_000,
) -> DataFrame:
    """Mean absolute Shapley value of each feature in the trees of one lead, by series, with its rank.

    Taken over the complete rows before the first kept fold, each by the trees of its own
    block; ties in rank go to the earlier feature.  A series without such rows has no rows here.
    """
    features, names = list(features), [f"_x{i}" for i in range(len(features))]
    x = [F.col(f).cast("double").alias(a) for f, a in zip(features, names, strict=True)]
    limit = first_train_end(horizon, folds, min_train)
    train = _training(design_rows.filter(F.col("lead") == lead), features).filter(F.col("pos") + F.col("lead") < limit)
    train = train.select(
        "series_id", F.lit(0).alias("_fit"), _block_of(1, block_rows).alias("_block"), F.col("pos").cast("long").alias("pos"),
        F.col("target").cast("double").alias("target"), *x,
    )

    def explain(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in _batches(frames, 1):
            trees, edges, _ = _grown(batch, names, [np.zeros(len(b), np.int64) for b in batch], params)
            for i, block in enumerate(batch):
                total = np.abs(shapley(trees, binned(block[names].to_numpy(), edges[i]), i)[0]).sum(axis=0)
                yield pd.DataFrame({"series_id": _key(block)[0], "i": np.arange(len(features)), "total": total, "rows": len(block)})

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in _batches(frames, 1):
            none = np.empty((0, len(names))), np.empty(0, np.int64)
            out = [(_key(b)[0], len(b), _packed(EXPLAIN, b, names, np.zeros(len(b), np.int64), *none, params)) for b in batch]
            yield pd.DataFrame(out, columns=["series_id", "rows", "block"])

    kind = design_rows.schema["series_id"].dataType.simpleString()
    dealt = fanned_out(train, *_GROUP).sortWithinPartitions(*_GROUP, "pos")
    function = _native(design_rows, names, params, block_rows)
    if function:
        sent = dealt.mapInPandas(pack, f"series_id {kind}, rows long, block binary")
        grown = sent.select("series_id", F.call_udf(function, "block").alias("total"), "rows")
        found = grown.select("series_id", F.posexplode_outer("total").alias("i", "total"), "rows")  # outer: as above
    else:
        found = dealt.mapInPandas(explain, f"series_id {kind}, i int, total double, rows long")
    found = found.groupBy("series_id", "i").agg((F.sum("total") / F.sum("rows")).alias("v"), F.sum("rows").alias("n_rows"))
    # one row a series and feature
    ranked = found.groupBy("series_id", "n_rows").agg(F.sort_array(F.collect_list(F.struct((-F.col("v")).alias("v"), "i"))).alias("_all"))
    each = ranked.select("series_id", "n_rows", F.posexplode("_all").alias("_at", "_one"))
    return each.select(
        "series_id",
        F.get(F.array(*[F.lit(f) for f in features]), F.col("_one.i")).alias("feature"),
        (-F.col("_one.v")).alias("mean_abs_shap"),
        (F.col("_at") + 1).alias("rank"),
        "n_rows",
    )
