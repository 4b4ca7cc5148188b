"""The pipeline's stages against brute force on their own inputs."""

from __future__ import annotations

import random
import re

import corpus_pipeline
from test_jaccard import plain as plain_classes
from test_substring import plain as plain_words
from test_texts import EMAIL

from panelkit.llm import quality

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents() -> list[tuple]:
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefghijklmnopé") for _ in range(r.randint(2, 7)))
    passage = " ".join(word() for _ in range(70))
    texts = [" ".join(word() for _ in range(r.randint(20, 200))) for _ in range(30)]
    texts += [t + f" {word()}" for t in texts[:8]] + [f"{' '.join(word() for _ in range(90))} {passage} {word()}\nmail {word()}.x@site.org end" for _ in range(6)]
    texts += ["a b c " * 50, None, ""]
    r.shuffle(texts)
    return [(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)]


def test_stages(spark, frame):
    docs = frame(DOCS, documents())
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    stages = [f for _, f in corpus_pipeline.STAGES]

    good = stages[0](spark, docs, "")
    assert good.columns == docs.columns
    want = {i for i, t in rows.items() if not any(rule.rejects(quality.Facts(t)) for rule in quality.RULES)}
    kept = {r["doc_id"]: r["text"] for r in good.collect()}
    assert kept == {i: rows[i] for i in want} and 20 < len(kept) < len(rows)

    single = stages[1](spark, good, "")
    assert single.columns == docs.columns
    want = {i for i, _, c in plain_classes(sorted(kept.items())) if i == c}
    before, kept = kept, {r["doc_id"]: r["text"] for r in single.collect()}
    assert kept == {i: before[i] for i in want} and len(kept) < len(before)

    cut = stages[2](spark, single, "")
    assert cut.columns == docs.columns
    want = {i: words for i, _, _, words in plain_words(sorted(kept.items()), 50)}
    after = {r["doc_id"]: r for r in cut.collect()}
    assert {i: " ".join(r["text"].split()) for i, r in after.items()} == {i: " ".join(w.split()) for i, w in want.items()}
    assert all(r["n_chars"] == len(r["text"]) for r in after.values())
    assert sum(len(r["text"]) for r in after.values()) < sum(map(len, kept.values()))

    clean = stages[3](spark, cut, "")
    assert clean.columns == docs.columns
    redacted = {r["doc_id"]: r for r in clean.collect()}
    assert {i: r["text"] for i, r in redacted.items()} == {i: EMAIL.sub("[EMAIL]", r["text"]) for i, r in after.items()}
    assert all(r["n_chars"] == len(r["text"]) for r in redacted.values())

    packed = stages[4](spark, clean, "").collect()
    assert {r["doc_id"] for r in packed} == set(redacted)
    for i in redacted:
        own = [r for r in packed if r["doc_id"] == i]
        assert sum(r["length"] for r in own) == own[0]["doc_tokens"]
    assert re.search("site.org", " ".join(r["text"] for r in redacted.values())) is None


def test_run_over_a_table(spark, tmp_path, frame):
    frame(DOCS, documents()).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 10
