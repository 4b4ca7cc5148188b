"""Removal of long passages that stand in an earlier document, by suffix automata.

A word is removed if it lies in a window of ``window`` consecutive words whose word
sequence also starts in a document with a smaller ``doc_id``; windows are judged on
the input.  The reference is the corpus itself, so its automata can't be broadcast:
they are split into shards, and each text meets only the shards that can match it.

1. Each window has an anchor: its least 8-word fingerprint (the leftmost, on ties).
   Consecutive windows of a document with one anchor form a run.  Equal windows have
   equal anchors, so all that a window can match shares its anchor.
2. Anchors that stand in one document only are dropped with their runs.
3. A run whose whole word sequence stands in an earlier document is removed outright;
   of equal runs only those of the earliest document go on.
4. What goes on is dealt out by anchor.  The runs of an anchor are a reference shard:
   in the order of ``doc_id``, each run is streamed through the suffix automaton of
   the earlier documents' runs; matching statistics of ``window`` words or more are
   maximal spans to remove; then the run joins the automaton.
5. An anchor with more than ``HOT_RUNS`` different runs would make a large shard; its
   windows are dealt out by their own 128-bit fingerprints instead, after each task
   has kept only the earliest document of each.

Fingerprints of runs have 128 bits; shards compare words.  Nothing is sampled, capped
or sent to the driver.

Defined cases: null texts have no words; rows with a null ``doc_id`` stay as they are
and remove nothing; rows with equal ``doc_id`` never remove from each other; repeated
rows are treated alike; extra columns are kept by ``remove``, left out by ``kept_words``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelkit.llm.arrow import arrow_schema, ddl, map_slices, slices
from panelkit.llm.words import U, grams, spans, texts_hashes, word_hashes
from panelkit.session import settled

WINDOW, GRAM = 50, 8
HOT_RUNS = 2000
_CHUNK = 1 << 18
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_ID, _HASH = "doc_id", "__text_hash"


def least_positions(marks: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` marks the position of its least, the leftmost on ties (of the upper 44 bits)."""
    n = len(marks) - width + 1
    if n > _CHUNK:
        parts = [least_positions(marks[at : at + _CHUNK + width - 1], width) + at for at in range(0, n, _CHUNK)]
        return np.concatenate(parts)
    place = U((1 << 20) - 1)
    keys = (marks & ~place) | np.arange(len(marks), dtype=U)
    padded = np.full(-(-len(keys) // width) * width, ~U(0))
    padded[: len(keys)] = keys
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(behind[:n], ahead[width - 1 : width - 1 + n]) & place).astype(np.int64)


def anchored_runs(words: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """First window, number of windows, further windows by repetition, anchor and fingerprint of each run.

    In periodic text a run is followed by equal ones; they count as its repetitions.
    A span of a run, at least a window long, overlaps the same span of the next
    repetition, so all of them together only end that many words later.
    """
    n = len(words) - window + 1
    if n <= 0:
        none = np.empty(0, np.int64)
        return none, none, none, none, none
    marks = grams(words, gram)
    at = least_positions(marks, window - gram + 1)
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    last = np.r_[first[1:], n]
    size, anchor, run = last - first, marks[at[first]].view(np.int64), spans(words, first, last + window - 1).view(np.int64)
    kept = np.flatnonzero(np.r_[True, (size[1:] != size[:-1]) | (anchor[1:] != anchor[:-1]) | (run[1:] != run[:-1])])
    times = np.diff(np.r_[kept, len(first)])
    return first[kept], size[kept], size[kept] * (times - 1), anchor[kept], run[kept]


class SuffixAutomaton:
    """All substrings of the word sequences added so far."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.length = [0]

    def _state(self, moves: dict, link: int, length: int) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, p: int, word, q: int) -> int:
        """The state of the suffixes of q that end p's move: q itself or a copy for the shorter ones."""
        if self.length[q] == self.length[p] + 1:
            return q
        copy = self._state(dict(self.next[q]), self.link[q], self.length[p] + 1)
        self.link[q] = copy
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        return copy

    def add(self, sequence: list) -> None:
        last = 0
        for word in sequence:
            p = last
            q = self.next[p].get(word)
            if q is not None:
                last = self._split(p, word, q)
                continue
            last = self._state({}, 0, self.length[p] + 1)
            while p >= 0 and word not in self.next[p]:
                self.next[p][word] = last
                p = self.link[p]
            if p >= 0:
                self.link[last] = self._split(p, word, self.next[p][word])

    def matches(self, sequence: list, least: int) -> list[tuple[int, int]]:
        """Maximal spans of ``sequence`` covered by matching statistics of ``least`` or more."""
        found: list[tuple[int, int]] = []
        state = size = 0
        for i, word in enumerate(sequence):
            while state and word not in self.next[state]:
                state = self.link[state]
                size = self.length[state]
            state = self.next[state].get(word, 0)
            size = size + 1 if state else 0
            if size >= least:
                if found and found[-1][1] >= i + 1 - size:
                    found[-1] = (min(found[-1][0], i + 1 - size), i + 1)
                else:
                    found.append((i + 1 - size, i + 1))
        return found


def _runs(docs: DataFrame, window: int) -> DataFrame:
    def work(ids: list, hashes: list, texts: list) -> list:
        parts = []
        for doc_id, text_hash, words in zip(ids, hashes, texts_hashes([(t or "").encode() for t in texts]), strict=True):
            if doc_id is not None and len(words) >= window:
                first, n, more, anchor, run = anchored_runs(words, window, GRAM)
                parts.append((np.full(len(first), doc_id), np.full(len(first), text_hash), first, n, more, anchor, run))
        return [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [[]] * 7

    out = {_ID: "long", _HASH: "long", "start": "long", "n": "long", "more": "long", "anchor": "long", "run": "long"}
    return map_slices(docs.select(_ID, _HASH, "text"), "text", out, work)


_KEYED = {
    "kind": "int", "key": "long", "key2": "long", _ID: "long", _HASH: "long", "start": "long", "end": "long", "more": "long", "words": "string",
}
_SPAN = {_ID: "long", _HASH: "long", "start": "long", "end": "long"}
_SPAN_KIND, _RUN_KIND, _WINDOW_KIND = 0, 1, 2


def _earliest(rows: list[tuple], window: int) -> Iterator[tuple]:
    """Of hot windows (key, key2, doc_id, text hash, start, more): the earliest document's of each, and spans of the others."""
    rows.sort()
    for _, own in groupby(rows, key=lambda r: r[:2]):
        own = list(own)
        for key, key2, doc_id, text_hash, start, more in own:
            kind = _SPAN_KIND if doc_id > own[0][2] else _WINDOW_KIND
            yield kind, key if kind else doc_id, key2, doc_id, text_hash, start, start + window + more, 0, None


def _contested(window: int, hot_buffer: int = 500_000):
    """Rows to deal out: contested runs with their words, or their single windows where the anchor is hot."""
    schema = arrow_schema(_KEYED)

    def packed(rows) -> pa.RecordBatch:
        columns = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot: list[tuple] = []
        for batch in batches:
            named = batch.select([_ID, _HASH, "text", "__runs"])
            for ids, hashes, texts, runs in slices(iter([named]), 2):
                rows = []
                for doc_id, text_hash, text, own in zip(ids, hashes, texts, runs, strict=True):
                    data = (text or "").encode()
                    words = data.split()
                    marks = word_hashes(data) if any(r["hot"] for r in own) else None
                    for r in own:
                        start, end = r["start"], r["start"] + r["n"] + window - 1
                        if r["hot"]:
                            at = np.arange(start, end - window + 1)
                            key, key2 = spans(marks, at, at + window), spans(marks ^ U(0x5851F42D4C957F2D), at, at + window)
                            hot += [(int(a), int(b), doc_id, text_hash, int(i), r["more"]) for a, b, i in zip(key.view(np.int64), key2.view(np.int64), at, strict=True)]
                        else:
                            rows.append((_RUN_KIND, r["anchor"], None, doc_id, text_hash, start, end, r["more"], b" ".join(words[start:end]).decode()))
                if rows:
                    yield packed(rows)
                if len(hot) >= hot_buffer:
                    yield packed(_earliest(hot, window))
                    hot = []
        if hot:
            yield packed(_earliest(hot, window))

    return run


def _shards(window: int):
    """Spans to remove, from rows sorted by key and then by document."""
    schema = arrow_schema(_SPAN)

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for (kind, _, _), own in groupby(rows_of(batches), key=lambda r: r[:3]):
            if kind == _SPAN_KIND:
                yield from (r[3:7] for r in own)
                continue
            automaton, pending, first = SuffixAutomaton(), [], None
            for doc, same in groupby(own, key=lambda r: r[3]):
                if kind == _WINDOW_KIND:
                    first = doc if first is None else first
                    if doc > first:
                        yield from (r[3:7] for r in same)
                    continue
                for words in pending:
                    automaton.add(words)
                pending = []
                for _, _, _, doc_id, text_hash, start, _, more, text in same:
                    pending.append(text.split(" "))
                    if first is not None:
                        for a, b in automaton.matches(pending[-1], window):
                            yield doc_id, text_hash, start + a, start + b + more
                first = doc

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for row in found(batches):
            rows.append(row)
            if len(rows) >= 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=schema)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=schema)

    return run


def with_spans(docs: DataFrame, window: int = WINDOW, hot_runs: int = HOT_RUNS) -> DataFrame:
    """``docs`` with ``__spans``: start and end (exclusive) of word spans to remove, unordered; null if none."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.withColumn(_HASH, F.xxhash64("text"))
    runs = settled(_runs(docs, window), "runs")
    ids = F.min(_ID).alias("lo"), F.max(_ID).alias("hi"), F.min("run").alias("run_lo"), F.max("run").alias("run_hi")
    shared = runs.groupBy("anchor").agg(*ids).where("lo < hi").select("anchor", (F.col("run_lo") != F.col("run_hi")).alias("mixed"))
    # written, so that the join is between two plain shuffles and a frequent anchor can be split
    live = settled(runs.join(settled(shared, "shared"), "anchor"), "live")
    earliest = live.groupBy("anchor", "run", "mixed").agg(F.min(_ID).alias("earliest"))
    crowded = earliest.where("mixed").groupBy("anchor").count().where(F.col("count") > hot_runs).select("anchor", F.lit(True).alias("hot"))
    crowded = settled(crowded, "crowded")  # as above
    judged = live.join(earliest.drop("mixed"), ["anchor", "run"]).where(f"{_ID} > earliest OR mixed").join(crowded, "anchor", "left")
    judged = settled(judged.withColumn("hot", F.coalesce("hot", F.lit(False))), "judged")
    whole = judged.where(f"{_ID} > earliest").select(_ID, _HASH, "start", (F.col("start") + F.col("n") + F.col("more") + window - 1).alias("end"))
    contested = (
        judged.where(f"{_ID} = earliest")
        .groupBy(_ID, _HASH)
        .agg(F.collect_list(F.struct("start", "n", "more", "anchor", "hot")).alias("__runs"))  # at most the document's own runs
    )
    # used twice with the same columns, so that its shuffle is written once
    texts = docs.repartition(parts, _ID, _HASH)
    dealt = texts.join(contested, [_ID, _HASH]).mapInArrow(_contested(window), ddl(_KEYED))
    dealt = dealt.repartition(parts, "key").sortWithinPartitions("kind", "key", "key2", _ID, _HASH, "start")
    removed = whole.unionByName(dealt.mapInArrow(_shards(window), ddl(_SPAN)))
    removed = removed.groupBy(_ID, _HASH).agg(F.collect_list(F.struct("start", "end")).alias("__spans"))
    return texts.join(removed, [_ID, _HASH], "left")


def _removed(n: int, found: list | None) -> np.ndarray:
    gone = np.zeros(n, bool)
    for s in found or ():
        gone[s["start"] : s["end"]] = True
    return gone


def without(text: str, found: list) -> str:
    """``text`` without the words of the spans and the white space after them."""
    data = text.encode()
    starts = [m.start() for m in _WORD.finditer(data)]
    edge = np.flatnonzero(np.diff(np.r_[False, _removed(len(starts), found), False].view(np.int8)))
    starts.append(len(data))
    out, at = [], 0
    for first, last in edge.reshape(-1, 2).tolist():
        out.append(data[at : starts[first]])
        at = starts[last]
    return b"".join([*out, data[at:]]).decode()


def kept_words(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed and kept: the words that stay, joined by one space."""

    def work(ids: list, texts: list, found: list) -> list:
        rows = []
        for doc_id, text, own in zip(ids, texts, found, strict=True):
            words = text.encode().split() if text else []
            gone = _removed(len(words), own)
            kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g] if own else words
            rows.append((doc_id, len(words), len(words) - len(kept), b" ".join(kept)))
        return list(zip(*rows, strict=True))

    out = {_ID: "long", "n_words": "long", "n_removed": "long", "kept": "binary"}
    # the same columns as inside, see there
    marked = with_spans(docs.select(_ID, "text"), window).select(_ID, "text", "__spans")
    return map_slices(marked, "text", out, work)


def remove(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` with all columns, repeated passages cut from ``text``; ``n_chars`` (if any) counted anew where it changed."""
    columns, counted = docs.columns, "n_chars" in docs.columns

    def run(batches):
        for batch in batches:
            old, found = batch.column("text").to_pylist(), batch.column("__spans").to_pylist()
            new = [without(t, s) if t and s else t for t, s in zip(old, found, strict=True)]
            batch = batch.select(columns)
            batch = batch.set_column(columns.index("text"), batch.schema.field("text"), pa.array(new, batch.schema.field("text").type))
            if counted:
                had = batch.column("n_chars").to_pylist()
                sizes = [h if a == b else len(b) for h, a, b in zip(had, old, new, strict=True)]
                at = columns.index("n_chars")
                batch = batch.set_column(at, batch.schema.field(at), pa.array(sizes, batch.schema.field(at).type))
            yield batch

    return with_spans(docs, window).mapInArrow(run, docs.schema)
