"""Spelling variants against brute force."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from panelkit.llm import spelling

RUNS = re.compile("[A-Za-zÀ-ÿ]+")
DOCS = "doc_id long, text string, word string, n int, root string"


def words_of(docs):
    n = Counter()
    for doc_id, text, *_ in docs:
        for run in RUNS.findall(text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            n[run if h % 97 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    return {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(docs):
    n = words_of(docs)
    close = {w: [v for v in n if v != w and near(v, w)] for w in n}
    form = {}
    for w in n:
        best = min(close[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted(((w, form[w], root(w), n[w], len(close[w]), n[form[w]] if form[w] else None) for w in n), key=str)


def made(seed):
    r = random.Random(seed)
    base = ["house", "horse", "mouse", "mouses", "houseé", "aaaaa", "aaaaaa", "aaaaab", "straße", "straßen", "École", "école", "×××××", "abcd", "abcde", "abcdef", "bbcdef"]
    for _ in range(60):
        w = list(r.choice(base))
        w[r.randrange(len(w))] = r.choice("abcdezàÿ")
        base.append("".join(w))
    weights = [r.choice([1, 1, 2, 5, 20, 60]) for _ in base]
    docs = [(i, r.choice([" ", "-", "\n", "1", "中"]).join(w.upper() if r.random() < 0.2 else w for w in r.choices(base, weights, k=r.choice([1, 5, 60]))), "x", 1, "y") for i in range(90)]
    docs += docs[:4] + [(None, "house house horse", "", 0, ""), (500, None, "", 0, ""), (501, "", "", 0, ""), (502, "12 34", "", 0, "")]
    docs += [(503, "house " * 30_000, "", 0, ""), (504, "b" * 5000 + " " + "b" * 4999 + " " + "b" * 5000, "", 0, ""), (505, "b" * 5000 + " " + "b" * 4999, "", 0, ""), (506, "b" * 4999, "", 0, "")]
    return docs


@pytest.mark.parametrize(("seed", "size"), [(0, 64 << 20), (1, 40)])
def test_groups_equal_brute_force(frame, monkeypatch, seed, size):
    monkeypatch.setattr(spelling, "FILTER_BYTES", size)  # the second run takes several slices
    docs = made(seed)
    got = spelling.group(frame(DOCS, docs).repartition(4))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted(map(tuple, got.collect()), key=str) == plain(docs)


def test_no_words(frame):
    assert spelling.group(frame(DOCS, [])).collect() == []
    assert spelling.group(frame(DOCS, [(1, None, "", 0, ""), (2, "ab cd", "", 0, "")])).collect() == []


def test_chains_of_forms(frame):
    chain, size, text = "abcdefghij", 3, []
    for i in range(9):  # each word has the next, twice as frequent, as its form
        text += [chain] * size
        chain, size = chain[:i] + "z" + chain[i + 1 :], 2 * size
    docs = [(i, w, "", 0, "") for i, w in enumerate(text)]
    assert sorted(map(tuple, spelling.group(frame(DOCS, docs)).collect()), key=str) == plain(docs)


def test_hashes_of_edits_are_hashes_of_the_edited_words():
    codes = np.array([list("hello".encode()), list("wörld".encode("latin-1"))], np.uint8)
    for at in range(5):
        made = spelling.replaced(codes, at, spelling.ALPHABET)
        for j, letter in enumerate(spelling.ALPHABET):
            edited = codes.copy()
            edited[:, at] = letter
            assert (made[:, j] == spelling.hashes(edited)).all()
        assert (spelling.shortened(codes)[:, at] == spelling.hashes(np.delete(codes, at, axis=1))).all()


def test_filters_lose_nothing_and_pass_little(spark):
    r = np.random.default_rng(0)
    words = ["".join(map(chr, r.integers(97, 123, 8))) for _ in range(20_000)]
    table = spark.createDataFrame([(w,) for w in words], "word string")
    sizes = spelling._sizes(table, 1)
    blocks = {k: spelling.blocks_for(n) for k, n in sizes.items()}
    built = spelling._tables(spelling.filters(table, 1, blocks).collect())[8][: blocks[0, 8]]
    h = spelling.hashes(np.array([list(w.encode()) for w in words], np.uint8))
    assert len(spelling.holds(built, h)) == len(words)
    other = spelling.hashes(r.integers(97, 123, (20_000, 8)).astype(np.uint8))
    assert len(spelling.holds(built, other)) < 400


def test_long_texts_are_cut_between_runs(monkeypatch):
    monkeypatch.setattr(spelling, "PIECE", 7)
    text = "Some words, ééééééééééé ÀÿßX y z" * 4
    got = {w.decode(): n for w, n in spelling._runs(text.encode()).items()}
    assert got == Counter("".join(c.lower() if c.isascii() else c for c in w) for w in RUNS.findall(text))
