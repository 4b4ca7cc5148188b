"""Removal of repeated passages against brute force."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest

from panelkit.llm import substring

DOCS = "doc_id long, text string, lang string, n_chars long, start long"


def corpus(seed: int) -> list[tuple]:
    r = random.Random(seed)
    passages = [[r.choice("abcdefg") + str(r.randint(0, 40)) for _ in range(r.randint(45, 90))] for _ in range(5)]
    rows = []
    for i in range(60):
        words = []
        for _ in range(r.randint(0, 5)):
            words += [r.choice(["x", "yé", "z", "q"]) + str(r.randint(0, 900)) for _ in range(r.randint(0, 40))]
            p = list(r.choice(passages))
            if r.random() < 0.3:
                p[r.randrange(len(p))] = "edit" + str(r.randint(0, 9))
            words += p
        rows.append((i, r.choice([" ", "\n", "  "]).join(words), "en", 7, 1))
    rows += [(None, rows[3][1], "en", 1, 1), (100, None, None, None, None), (101, "", "en", 0, 0), rows[5], (7, rows[9][1], "en", 1, 1)]
    rows += [(200, "w " * 300, "en", 1, 1), (201, "w " * 120, "en", 1, 1), (202, " ".join(f"u{i % 70}" for i in range(20_000)), "en", 1, 1)]
    rows += [(300 + j, " ".join(["v", "z"][j % 2 :] * r.randint(40, 300)), "en", 1, 1) for j in range(6)]
    rows += [(320 + j, f"s{j} " + "l m " * r.randint(20, 90) + "l x " * 40 + "m l " * 60, "en", 1, 1) for j in range(5)]
    rows += [(203 + j, " ".join(f"u{i % 70}" for i in range(j, 500)), "en", 1, 1) for j in range(3)]
    r.shuffle(rows)
    return rows


def plain(rows, window):
    first = {}
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t, *_ in rows]
    for (doc_id, *_), words in zip(rows, split):
        for i in range(len(words) - window + 1 if doc_id is not None else 0):
            key = tuple(words[i : i + window])
            first[key] = min(first.get(key, doc_id), doc_id)
    out = []
    for (doc_id, *_), words in zip(rows, split):
        gone = set()
        for i in range(len(words) - window + 1 if doc_id is not None else 0):
            if first[tuple(words[i : i + window])] < doc_id:
                gone.update(range(i, i + window))
        out.append((doc_id, len(words), len(gone), " ".join(w for j, w in enumerate(words) if j not in gone)))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed,hot", [(1, 2000), (2, 2000), (3, 1), (4, 3)])
def test_kept_words_equal_brute_force(frame, monkeypatch, seed, hot):
    rows = corpus(seed)
    marked = substring.with_spans
    monkeypatch.setattr(substring, "with_spans", lambda docs, window: marked(docs, window, hot))
    got = substring.kept_words(frame(DOCS, rows).repartition(5)).collect()
    got = sorted(((r["doc_id"], r["n_words"], r["n_removed"], bytes(r["kept"]).decode()) for r in got), key=str)
    assert got == plain(rows, 50)
    assert sum(g[2] for g in got) > 500


def test_remove_keeps_columns_and_the_rest_of_the_text(frame):
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(1, f"head\n{passage}\ntail", "en", 9, 1), (2, f"one\n\n{passage} two\tthree", "fr", 9, 2), (3, None, None, None, None)]
    got = {r["doc_id"]: r for r in substring.remove(frame(DOCS, rows)).collect()}
    assert got[1]["text"] == rows[0][1] and got[1]["n_chars"] == 9
    assert got[2]["text"] == "one\n\ntwo\tthree" and got[2]["n_chars"] == 14 and got[2]["start"] == 2
    assert got[3]["text"] is None
    assert substring.remove(frame(DOCS, [])).count() == 0 and substring.kept_words(frame(DOCS, [])).count() == 0


def test_least_positions_are_leftmost():
    r = np.random.default_rng(0)
    marks = (r.integers(0, 6, 500).astype(np.uint64)) << np.uint64(40)
    for width in (1, 7, 43):
        got = substring.least_positions(marks, width)
        assert got.tolist() == [i + int(np.argmin(marks[i : i + width])) for i in range(500 - width + 1)]
    small = substring._CHUNK
    try:
        substring._CHUNK = 64
        assert substring.least_positions(marks, 7).tolist() == [i + int(np.argmin(marks[i : i + 7])) for i in range(494)]
    finally:
        substring._CHUNK = small


@pytest.mark.parametrize("seed", range(30))
def test_matching_statistics(seed):
    r = random.Random(seed)
    known = [[r.choice("abc") for _ in range(r.randint(1, 30))] for _ in range(4)]
    automaton = substring.SuffixAutomaton()
    for k in known:
        automaton.add(k)
    text = [r.choice("abc") for _ in range(40)]
    held = {tuple(k[i : i + 5]) for k in known for i in range(len(k) - 4)}
    want = set()
    for i in range(len(text) - 4):
        if tuple(text[i : i + 5]) in held:
            want.update(range(i, i + 5))
    assert {i for a, b in automaton.matches(text, 5) for i in range(a, b)} == want
