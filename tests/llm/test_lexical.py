"""Ranked lexical search against brute force."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from panelkit.llm import lexical

TERMS = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
DOCS = "doc_id long, text string, item_id int, n string, score double"
ITEMS = "item_id long, text string, doc_id int, rank int"


def terms_of(text):
    return TERMS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, k=10):
    found = [(row[0], Counter(terms_of(row[1]))) for row in docs]
    found = [(i, c) for i, c in found if c]
    n_docs, length = len(found), sum(c.total() for _, c in found)
    df = Counter(t for _, c in found for t in c)
    asked: dict = {}
    for row in items:
        asked.setdefault(row[0], set()).update(terms_of(row[1]))
    out = []
    for item, terms in asked.items():
        scored = []
        for i, c in found:
            m = 10 + 90 * c.total() * n_docs // length
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms if t in c
            )
            if score > 0:
                scored.append((-score, i is None, i or 0))
        for rank, (s, missing, i) in enumerate(sorted(scored)[:k], 1):
            out.append((item, rank, None if missing else i, -s))
    return sorted(out, key=str)


def made(seed):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["Émile", "éMILE", "naïve", "B2B", "x", "10"]
    text = lambda n: r.choice([" ", ", ", "\n"]).join(r.choice(words) for _ in range(n))
    docs = [(i, text(r.choice([1, 3, 20, 200])), 0, "", 0.0) for i in range(120)]
    docs += [(500 + i, docs[i][1], 0, "", 0.0) for i in range(40)] + docs[:5]  # ties and repeated rows
    docs += [(900, None, 0, "", 0.0), (901, "", 0, "", 0.0), (902, " .,- ", 0, "", 0.0), (None, text(30), 0, "", 0.0), (None, docs[3][1], 0, "", 0.0)]
    docs += [(903, text(40_000), 0, "", 0.0)]
    items = [(i, text(r.choice([1, 4, 30])), 0, 0) for i in range(30)]
    items += [(100, None, 0, 0), (101, "", 0, 0), (102, "absent words only", 0, 0), (3, text(5), 0, 0), (None, text(6), 0, 0), (7, items[7][1], 0, 0)]
    return docs, items


@pytest.mark.parametrize(("seed", "block"), [(0, 1 << 24), (1, 300)])
def test_search_equals_brute_force(frame, monkeypatch, seed, block):
    monkeypatch.setattr(lexical, "ITEM_BYTES", block)
    docs, items = made(seed)
    got = lexical.search(frame(DOCS, docs).repartition(5), frame(ITEMS, items))
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == plain(docs, items)


def test_empty_tables(frame):
    docs, items = made(2)
    assert lexical.search(frame(DOCS, []), frame(ITEMS, items)).collect() == []
    assert lexical.search(frame(DOCS, docs), frame(ITEMS, [])).collect() == []
    assert lexical.search(frame(DOCS, [(1, None, 0, "", 0.0)]), frame(ITEMS, items)).collect() == []


def test_tiles_equal_plain_sums_at_any_width(monkeypatch):
    r = np.random.default_rng(0)
    weight = r.integers(0, 24_000, 500)
    items = [np.sort(r.choice(500, r.integers(0, 90), replace=False)) for _ in range(37)]
    n = 50
    rows, terms = (a.ravel() for a in np.meshgrid(np.arange(n), np.arange(500), indexing="ij"))
    keep = r.random(len(rows)) < 0.2
    rows, terms = rows[keep], terms[keep]
    impact = r.integers(0, 1_000_000, len(rows))
    dense = np.zeros((n, 500), object)
    dense[rows, terms] = impact.tolist()
    want = [[sum(int(dense[d, t]) * int(weight[t]) for t in item) for item in items] for d in range(n)]
    for terms_wide, items_wide in ((7, 5), (1024, 128)):
        monkeypatch.setattr(lexical, "TERM_TILE", terms_wide)
        monkeypatch.setattr(lexical, "ITEM_TILE", items_wide)
        got = np.zeros((n, len(items)), np.int64)
        for first, scores in lexical.Tiles(items, weight).scores(rows, terms, impact, n):
            got[:, first : first + scores.shape[1]] += scores
        assert got.tolist() == want


def test_partial_sums_stay_exact(monkeypatch):
    monkeypatch.setattr(lexical, "EXACT", 3 * 24_000 * 1_000_000)
    tiles = lexical.Tiles([np.arange(10)], np.full(10, 24_000))
    assert [len(p[2]) for p in tiles.parts] == [3, 3, 3, 1]


def test_long_texts_are_cut_between_terms(monkeypatch):
    monkeypatch.setattr(lexical, "PIECE", 10)
    text = "Alpha beta-gamma ééééééééééééé delta" * 3 + "x" * 50
    assert lexical.term_counts(text.encode()) == Counter(t.encode() for t in terms_of(text))
