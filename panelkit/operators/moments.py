"""Moments of linear fits, summed where the rows are.

A part is one row of numbers: count, mean of the target, means of the features and the
centred cross products of each feature with the target and of each pair of features.
Parts of a group merge about their common mean, so a large offset of the values costs no
digits.  A task reduces its batches to parts with numpy and merges them; only parts are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType



class Fit(NamedTuple):
    """One of several linear fits on the same rows; ``fold`` names the first fold that may train on a row."""

    label: tuple
    features: tuple[str, ...]
    target: str
    fold: str | None = None


#: Parts that a task holds before it merges them and hands on what is left.
HELD = 1 << 15


def cross_pairs(k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in (target, features) of the factors of every cross product of a part."""
    upper = np.triu_indices(k)
    return np.concatenate([np.arange(k), upper[0]]) + 1, np.concatenate([np.full(k, -1), upper[1]]) + 1


def part_of_rows(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Parts of (target, features) x rows, whose groups begin at ``starts``: groups x numbers."""
    n = np.diff(np.append(starts, values.shape[1]))
    # about the first row, so that values without spread have none here either
    first = values[:, starts]
    d = values - np.repeat(first, n, axis=1)
    mean = np.add.reduceat(d, starts, axis=1) / n
    d -= np.repeat(mean, n, axis=1)
    a, b = cross_pairs(len(values) - 1)
    return np.vstack([n[None, :], first + mean, np.add.reduceat(d[a] * d[b], starts, axis=1)]).T


def merged_parts(parts: np.ndarray, starts: np.ndarray, k: int) -> np.ndarray:
    """Parts of groups of parts, which begin at ``starts``."""
    size = np.diff(np.append(starts, len(parts)))
    n = np.add.reduceat(parts[:, 0], starts)
    share = parts[:, 0] / np.repeat(n, size)
    means = parts[:, 1 : 2 + k]
    mean = np.add.reduceat(share[:, None] * means, starts, axis=0)
    d = means - np.repeat(mean, size, axis=0)
    a, b = cross_pairs(k)
    cross = np.add.reduceat(parts[:, 2 + k :] + parts[:, :1] * d[:, a] * d[:, b], starts, axis=0)
    return np.hstack([n[:, None], mean, cross])


def numbers(lists: pa.ListArray, k: int) -> np.ndarray:
    """Parts of ``k`` features as a matrix."""
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, 2 + k + len(cross_pairs(k)[0]))


def _grouped(keys: Sequence[pa.Array], rows: int) -> tuple[np.ndarray, np.ndarray]:
    """An order that puts equal keys side by side, and where each group begins in it."""
    code = np.zeros(rows, np.int64)
    for key in keys:
        own = key.dictionary_encode(null_encoding="encode")
        code = code * len(own.dictionary) + own.indices.to_numpy(zero_copy_only=False)
        # dense again, so that the next key cannot overflow it
        code = np.unique(code, return_inverse=True)[1]
    order = np.argsort(code, kind="stable")
    return order, np.flatnonzero(np.diff(code[order], prepend=-1))


def _reduced(n_keys: int, names: Sequence[str], fits: Sequence[Fit], folds: int | None, schema: pa.Schema):
    k, n_marks = len(fits[0].features), len(schema) - 1
    places = [[names.index(c) for c in (f.target, *f.features)] for f in fits]
    opened = [None if f.fold is None else names.index(f.fold) for f in fits]

    def batch_of(marks: Sequence[pa.Array], parts: np.ndarray) -> pa.RecordBatch:
        ends = np.arange(0, parts.size + 1, parts.shape[1], dtype=np.int32)
        lists = pa.ListArray.from_arrays(ends, pa.array(np.ascontiguousarray(parts).ravel()))
        return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip([*marks, lists], schema, strict=True)], schema=schema)

    def reduced(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        order, starts = _grouped(batch.columns[:n_keys], batch.num_rows)
        code = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(order))))
        values = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[n_keys:]])[:, order]
        known = ~np.isnan(values)
        used: dict[tuple, tuple] = {}
        for fit, place, fold in zip(fits, places, opened, strict=True):
            whole = known[place].all(axis=0)
            # fits with the same rows and folds share their groups
            same = fold, whole.tobytes()
            if same not in used:
                group = code
                if fold is not None:
                    whole &= values[fold] < folds
                    group = code * folds + np.where(whole, values[fold], 0).astype(np.int64)
                kept = np.flatnonzero(whole)
                kept = kept[np.argsort(group[kept], kind="stable")]
                used[same] = group, kept, np.flatnonzero(np.diff(group[kept], prepend=-1))
            group, kept, begin = used[same]
            if not len(kept):
                continue
            at = pa.array(order[kept[begin]])
            marks = [key.take(at) for key in batch.columns[:n_keys]]
            marks += [pa.repeat(pa.scalar(v, schema.field(n_keys + i).type), len(begin)) for i, v in enumerate(fit.label)]
            if fold is not None:
                marks.append(pa.array(group[kept[begin]] % folds))
            yield batch_of(marks, part_of_rows(np.stack([values[i, kept] for i in place]), begin))

    def merged(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        (one,) = pa.Table.from_batches(held).combine_chunks().to_batches()
        marks = one.columns[:n_marks]
        order, starts = _grouped(marks, one.num_rows)
        at = pa.array(order[starts])
        return batch_of([c.take(at) for c in marks], merged_parts(numbers(one.column(n_marks), k)[order], starts, k))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for batch in batches:
            if batch.num_rows:
                held.extend(reduced(batch))
                count = sum(b.num_rows for b in held)
            if count >= HELD:
                held = [merged(held)]
                count = held[0].num_rows
                if count > HELD // 2:
                    yield held[0]
                    held, count = [], 0
        if held:
            yield merged(held)

    return run


def partial_moments(
    rows: DataFrame, keys: Sequence[str], fits: Sequence[Fit], labels: Sequence[StructField] = (), folds: int | None = None
) -> DataFrame:
    """``m_part`` of what each task holds of a key, for each of the ``fits`` (equally many features each).

    A row counts for a fit where none of its values is missing.  The ``labels`` of a
    fit become columns; with ``folds``, so does the row's fold, and rows that no fold trains on are left out.
    """
    keys = list(keys)
    names = list(dict.fromkeys(c for f in fits for c in (f.target, *f.features, f.fold) if c is not None))
    given = rows.select(*keys, *[F.col(c).cast("double").alias(f"_v{i}") for i, c in enumerate(names)])
    fold = [] if folds is None else [StructField("fold", IntegerType())]
    made = StructType([*given.select(*keys).schema.fields, *labels, *fold, StructField("m_part", ArrayType(DoubleType()))])
    return given.mapInArrow(_reduced(len(keys), names, fits, folds, to_arrow_schema(made)), made)
