"""Document quality rules as a short-circuit cascade.

A document is kept if it passes every rule.  Rules read lazily computed facts of
the text; on a bounded sample each rule's time and rejection rate are measured,
and rules are then tried in falling order of rejections per second, so most bad
documents cost one cheap rule.  The order changes the cost only, never the verdict.

Defined cases: a null or blank text has no words and fails the word count; a null
``doc_id`` is carried along; repeated rows are judged each; extra columns stay out
of the digest and are carried by ``keep_good``.
"""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable, Sequence
from functools import cached_property
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelkit.llm.arrow import map_slices

#: Most rows in the sample that orders the rules.
SAMPLE_ROWS = 512
_SYMBOLS = "#*$%&|<>"
_NO_SYMBOL = {ord(c): None for c in _SYMBOLS}


class Facts:
    """Facts of one text, each computed when a rule first asks for it."""

    def __init__(self, text: str | None) -> None:
        self.text = text or ""

    @cached_property
    def words(self) -> list[bytes]:
        return self.text.encode().split()

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(b"".join(self.words).decode())

    @cached_property
    def n_symbols(self) -> int:
        return len(self.text) - len(self.text.translate(_NO_SYMBOL))

    @cached_property
    def n_dup_lines(self) -> int:
        lines = [line for line in self.text.encode().split(b"\n") if line.split()]
        return len(lines) - len(set(lines))

    @cached_property
    def n_repeat_words(self) -> int:
        """Words inside three-word windows that the text holds twice or more."""
        w = self.words
        windows = list(zip(w, w[1:], w[2:], strict=False))
        seen = Counter(windows)
        if len(seen) == len(windows):
            return 0
        covered, reach = 0, 0
        for i, window in enumerate(windows):
            if seen[window] > 1:
                covered += i + 3 - max(i, reach)
                reach = i + 3
        return covered

    @cached_property
    def upper_share(self) -> float:
        """Share of cased letters that are capitals."""
        capitals = sum(map(str.isupper, self.text))
        small = sum(map(str.islower, self.text))
        return capitals / (capitals + small) if capitals + small else 0.0


class Rule(NamedTuple):
    name: str
    rejects: Callable[[Facts], bool]


#: Fixed base rules of the verdict, then the shares that only junk reaches.
RULES = (
    Rule("few_words", lambda f: f.n_words < 50),
    Rule("repeats", lambda f: 100 * f.n_repeat_words > 50 * f.n_words),
    Rule("symbols", lambda f: 10 * f.n_symbols > 3 * f.n_words),
    Rule("word_length", lambda f: not 2 * f.n_words <= f.word_chars <= 20 * f.n_words),
    Rule("capitals", lambda f: f.upper_share > 0.5),
    Rule("repeated_lines", lambda f: 2 * f.n_dup_lines > f.text.count("\n") + 1),
)


def rule_order(docs: DataFrame, rules: Sequence[Rule] = RULES, rows: int = SAMPLE_ROWS) -> list[Rule]:
    """Rules by rejections per second on a sample of at most ``rows`` rows."""
    total = docs.count()
    if not total:
        return list(rules)
    sample = docs.select("text").sample(False, min(1.0, 2 * rows / total), 7).limit(rows)

    def measure(texts: list) -> list[list]:
        out: list[list] = [[], [], []]
        for text in texts:
            for i, rule in enumerate(rules):
                facts, start = Facts(text), time.perf_counter()
                bad = rule.rejects(facts)
                for column, value in zip(out, (i, time.perf_counter() - start, float(bad)), strict=True):
                    column.append(value)
        return out

    measured = map_slices(sample, "text", {"rule": "long", "seconds": "double", "bad": "double"}, measure)
    seen = {r["rule"]: r for r in measured.groupBy("rule").agg(F.sum("seconds").alias("s"), F.sum("bad").alias("b")).collect()}
    gain = {i: (seen[i]["b"] / max(seen[i]["s"], 1e-9) if i in seen else 0.0) for i in range(len(rules))}
    return [rules[i] for i in sorted(gain, key=lambda i: (-gain[i], i))]


def _verdict(facts: Facts, order: Sequence[Rule]) -> str | None:
    """The first rule in order that rejects; later rules are not tried."""
    return next((r.name for r in order if r.rejects(facts)), None)


def judge(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """doc_id, base counts, base_failed, kept and the rule that rejected."""
    order = rule_order(docs, rules)
    out = {
        "doc_id": "long", "n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long",
        "n_repeat_words": "long", "base_failed": "boolean", "kept": "boolean", "rejected_by": "string",
    }

    def work(ids: list, texts: list) -> list:
        rows = []
        for doc_id, text in zip(ids, texts, strict=True):
            f = Facts(text)
            by = _verdict(f, order)
            base = f.n_words < 50 or 100 * f.n_repeat_words > 50 * f.n_words
            rows.append(
                (doc_id, f.n_words, f.word_chars, f.n_symbols, f.n_dup_lines, f.n_repeat_words, base, by is None and not base, by)
            )
        return list(zip(*rows, strict=True))

    return map_slices(docs.select("doc_id", "text"), "text", out, work)


def keep_good(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """The rows of ``docs``, with all their columns, that pass every rule."""
    order = rule_order(docs, rules)

    def run(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            yield batch.filter(pa.array([_verdict(Facts(t), order) is None for t in texts], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
