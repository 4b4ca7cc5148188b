"""Exact top-k search against brute force."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelkit.llm import topk

VECTORS = "vec_id long, embedding array<float>, label int, rank int, score long"


def rows_of(seed: int) -> list[tuple]:
    r = random.Random(seed)
    base = [[r.gauss(0, 0.2) for _ in range(12)] for _ in range(8)]
    rows = [(i, [x + r.gauss(0, 0.05) for x in r.choice(base)], 0, 1, 1) for i in range(400)]
    rows += [(1000 + i, list(rows[i][1]), 0, 1, 1) for i in range(60)]  # ties
    rows += [(2000, None, 0, 0, 0), (2050, [0.1] * 11 + [None], 0, 0, 0), (2100, [float("nan")] * 12, 0, 0, 0), (2150, [float("inf")] * 12, 0, 0, 0)]
    rows += [(None, [0.5] * 12, 0, 0, 0), (3000, [0.5] * 7, 0, 0, 0), (3050, [], 0, 0, 0), (3001, [0.25] * 7, 0, 0, 0)]
    return rows


def plain(rows, k):
    whole = {}
    for i, v, *_ in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            whole[i] = [math.floor(256 * float(np.float32(x))) for x in v]
    out = []
    for q in (i for i in whole if i % 50 == 0):
        scores = sorted((-sum(a * b for a, b in zip(whole[q], v)), i) for i, v in whole.items() if i != q and len(v) == len(whole[q]))
        out += [(q, rank, i, -s) for rank, (s, i) in enumerate(scores[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("seed", range(3))
def test_top_k_equals_brute_force(frame, monkeypatch, seed):
    monkeypatch.setattr(topk, "BLOCK", 16)
    rows = rows_of(seed)
    got = topk.top_k(frame(VECTORS, rows).repartition(4), F.col("vec_id") % 50 == 0, 5)
    assert sorted(map(tuple, got.collect())) == plain(rows, 5)


def test_few_and_no_candidates(frame):
    few = [(0, [0.5, 0.5], 0, 0, 0), (1, [0.5, -0.5], 0, 0, 0)]
    assert [tuple(r) for r in topk.top_k(frame(VECTORS, few), F.col("vec_id") % 50 == 0, 5).collect()] == [(0, 1, 1, 0)]
    assert topk.top_k(frame(VECTORS, few[:1]), F.col("vec_id") % 50 == 0, 5).collect() == []
    assert topk.top_k(frame(VECTORS, []), F.col("vec_id") % 50 == 0, 5).collect() == []


def test_bounds_stop_early():
    r = np.random.default_rng(1)
    centres = r.normal(0, 60, (10, 16))
    vectors = np.floor(np.repeat(centres, 200, axis=0) + r.normal(0, 2, (2000, 16)))
    seen = []

    class Counted(np.ndarray):
        def __getitem__(self, key):
            if isinstance(key, np.ndarray) and key.dtype.kind == "i":
                seen.append(len(key))
            return super().__getitem__(key)

    got = list(topk.search(vectors[:1], [0], vectors.view(Counted), np.arange(2000), topk.choose_pivots(vectors, 16), 5))
    want = sorted((-int(vectors[0] @ v), i) for i, v in enumerate(vectors) if i)[:5]
    assert [(-s, i) for _, i, s in got] == want
    assert 0 < sum(seen) < 1000


WIDE = "vec_id long, embedding array<double>"


def exact(rows, k):
    floored = lambda x: 256 * int(x) if abs(x) >= 2.0**45 else math.floor(256 * x)
    whole = {i: [floored(x) for x in v] for i, v in rows}
    out = []
    for q in (i for i in whole if i % 50 == 0):
        cut = lambda s: max(-(1 << 63), min((1 << 63) - 1, s))
        scores = sorted((-cut(sum(a * b for a, b in zip(whole[q], v))), i) for i, v in whole.items() if i != q and len(v) == len(whole[q]))
        out += [(q, rank, i, -s) for rank, (s, i) in enumerate(scores[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("seed", range(3))
def test_components_of_any_finite_size(frame, monkeypatch, seed):
    monkeypatch.setattr(topk, "BLOCK", 16)
    r = random.Random(seed)
    size = lambda: r.choice([1e-300, 1e-3, 1.0, 1e3, 1e5, 1e6, 1e8, 1e11, 1e19, 1e307])
    rows = [(i, [r.uniform(-1, 1) * s for _ in range(3)]) for i in range(200) for s in [size()]]
    rows += [(1000 + i, [r.uniform(-1, 1) * size() for _ in range(3)]) for i in range(50)]
    rows += [(2000, [1e307, 1.0, 0.0]), (2050, [1.7e308] * 3), (2001, [-1.7e308] * 3), (2100, [0.0] * 3), (2150, [1e8, 1e8, 1e8]), (2151, [1e8, 1e8, 1e8])]
    got = topk.top_k(frame(WIDE, rows).repartition(3), F.col("vec_id") % 50 == 0, 5)
    assert sorted(map(tuple, got.collect())) == exact(rows, 5)


def test_one_large_vector_leaves_the_others_their_results(frame):
    rows = [(i, [math.sin(i), math.cos(i)]) for i in range(300)]
    got = topk.top_k(frame(WIDE, [*rows, (301, [1e307, 1.0])]), F.col("vec_id") % 50 == 0, 5)
    assert sorted(map(tuple, got.collect())) == exact([*rows, (301, [1e307, 1.0])], 5)
