"""Ranked lexical search by dense blocked matrix products in float64.

The items are the queries and are few against the documents; every document meets
every item, so no candidate is lost.  One pass over the texts keeps, for each document,
its length and the items' terms it holds with their counts; everything else is left
behind.  From these come the statistics (number of documents, length of the corpus,
document frequencies), summed before anything is shuffled.  A second pass multiplies
tiles: impacts of some hundred documents (rows) times weights of some hundred terms
(columns) of a block of items.  Only a block's own terms are columns, so tiles are
compact.  All entries are whole numbers and a tile is never wider than what keeps every
partial sum below 2^53, so the products are exact; tiles add up in 64-bit integers.  A
task keeps the k best of each item by (score, doc_id), and a window ranks what the tasks
kept.  Cutting by score and id together is safe for ties.

Items go to the tasks in blocks of a bounded number of bytes of text, one pass for each
block; so what is sent does not grow with the number of items.

Score of a document: the sum over the item's terms of
``w * ((10^9 * tf) div (1000 * tf + 8 * m))`` with ``w = floor(1000 * ln((2N + 2) / (2df + 1)))``
and ``m = 10 + (90 * n * N) div L``.

Defined cases: null or empty texts have no terms, count in no statistic and are never
found; an item without terms finds nothing; rows of equal item_id (null is an id, too)
are one item with the terms of all of them; a document row that stands twice counts and
is found twice; equal scores rank by doc_id, null last.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from panelkit.llm.arrow import arrow_schema, ddl
from panelkit.session import settled

#: Bytes of item text in one block; documents, terms and items of a tile; bytes of a text counted at a time.
ITEM_BYTES, DOC_TILE, TERM_TILE, ITEM_TILE, PIECE = 16 << 20, 512, 1024, 128, 1 << 22
EXACT = 1 << 53
#: Lower-cases A-Z and turns what belongs to no term into a space; bytes from 0x80 on stand in terms only.
_FOLD = bytes(b if b >= 0x80 or 48 <= b <= 57 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
_HITS = {"doc_id": "long", "n": "long", "terms": "binary", "tfs": "binary"}
_COUNTS = {"kind": "int", "term": "long", "n": "long"}
_N, _L, _DF = range(3)


def term_counts(text: bytes) -> Counter:
    """How often each term stands in UTF-8 ``text``; a long text is cut where a term ends."""
    if len(text) <= PIECE:
        return Counter(text.translate(_FOLD).split())
    found, at = Counter(), 0
    while at < len(text):
        end = min(at + PIECE, len(text))
        while end < len(text) and _FOLD[text[end]] != 32:
            end += 1
        found.update(text[at:end].translate(_FOLD).split())
        at = end
    return found


def _hits(vocabulary: dict[bytes, int]):
    schema = arrow_schema(_HITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            ids, sizes, terms, tfs = [], [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), texts, strict=True):
                counts = term_counts(text.as_py() or b"")
                if not counts:
                    continue
                known = [(vocabulary[t], c) for t, c in counts.items() if t in vocabulary]
                pairs = np.array(known, "<i8").reshape(-1, 2)
                ids.append(doc_id)
                sizes.append(counts.total())
                terms.append(pairs[:, 0].astype("<i4").tobytes())
                tfs.append(pairs[:, 1].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip((ids, sizes, terms, tfs), schema)], schema=schema)

    return run


def _counts(width: int):
    """A task's part of the statistics: documents, length, and documents that hold each term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, length, df = 0, 0, np.zeros(width, np.int64)
        for batch in batches:
            docs += batch.num_rows
            length += int(batch.column(0).to_numpy().sum())
            for terms in batch.column(1):
                df[np.frombuffer(terms.as_py(), "<i4")] += 1  # a document's terms are distinct
        held = np.flatnonzero(df)
        kinds = np.r_[_N, _L, np.full(len(held), _DF)].astype(np.int32)
        values = kinds, np.r_[-1, -1, held], np.r_[docs, length, df[held]]
        schema = arrow_schema(_COUNTS)
        yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(values, schema)], schema=schema)

    return run


def weights(df: np.ndarray, n_docs: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)


def impacts(tf: np.ndarray, n: int, n_docs: int, length: int) -> np.ndarray:
    m = 10 + (90 * n * n_docs) // length
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


class Tiles:
    """Weights of a block of items, cut into compact tiles of items and of their own terms."""

    def __init__(self, item_terms: list[np.ndarray], weight: np.ndarray) -> None:
        self.parts = []
        for first in range(0, len(item_terms), ITEM_TILE):
            chosen = item_terms[first : first + ITEM_TILE]
            own = np.unique(np.concatenate(chosen)) if chosen else np.empty(0, np.int64)
            own = own[weight[own] > 0]
            # an impact is below 10^6
            width = max(1, min(TERM_TILE, EXACT // (1_000_000 * int(weight[own].max())))) if len(own) else 1
            for at in range(0, len(own), width):
                columns = own[at : at + width]
                rows = np.repeat(np.arange(len(chosen)), [len(t) for t in chosen])
                terms = np.concatenate(chosen)
                place = np.searchsorted(columns, terms)
                inside = place < len(columns)
                inside[inside] = columns[place[inside]] == terms[inside]
                self.parts.append((first, len(chosen), columns, rows[inside], place[inside], weight[terms[inside]].astype(np.float64)))

    def scores(self, doc_rows: np.ndarray, terms: np.ndarray, impact: np.ndarray, n_docs: int) -> Iterator[tuple[int, np.ndarray]]:
        """(first item, documents x items) for each tile of items; the entries of ``terms`` are sorted within no order."""
        order = np.argsort(terms, kind="stable")
        doc_rows, terms, impact = doc_rows[order], terms[order], impact[order].astype(np.float64)
        total, item = None, -1
        for first, n_items, columns, rows, place, weight in self.parts:
            if first != item:
                if total is not None:
                    yield item, total
                total, item = np.zeros((n_docs, n_items), np.int64), first
            lo, hi = np.searchsorted(terms, columns[0]), np.searchsorted(terms, columns[-1], "right")
            at = np.searchsorted(columns, terms[lo:hi])
            good = columns[at] == terms[lo:hi]
            left = np.zeros((n_docs, len(columns)))
            left[doc_rows[lo:hi][good], at[good]] = impact[lo:hi][good]
            right = np.zeros((len(columns), n_items))
            right[place, rows] = weight
            total += (left @ right).astype(np.int64)
        if total is not None:
            yield item, total


class Best:
    """The k highest (score, least id) of each item so far; a null id comes after all others."""

    def __init__(self, n_items: int, k: int) -> None:
        self.k = k
        self.held = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool))] * n_items
        self.least = np.ones(n_items, np.int64)

    def add(self, first: int, scores: np.ndarray, ids: np.ndarray, missing: np.ndarray) -> None:
        enough = scores >= self.least[first : first + scores.shape[1]]
        for j in np.flatnonzero(enough.any(axis=0)).tolist():
            rows, item = np.flatnonzero(enough[:, j]), first + j
            score, number, gone = (np.r_[old, new] for old, new in zip(self.held[item], (scores[rows, j], ids[rows], missing[rows])))
            keep = np.lexsort((number, gone, -score))[: self.k]
            self.held[item] = score[keep], number[keep], gone[keep]
            if len(keep) == self.k:
                self.least[item] = score[keep[-1]]


def _search(item_ids: list, item_terms: list[np.ndarray], weight: np.ndarray, n_docs: int, length: int, k: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tiles, best = Tiles(item_terms, weight), Best(len(item_ids), k)
        for batch in batches:
            for at in range(0, batch.num_rows, DOC_TILE):
                part = batch.slice(at, DOC_TILE)
                known = part.column(0)
                terms = [np.frombuffer(t, "<i4") for t in part.column(2).to_pylist()]
                found = [impacts(np.frombuffer(c, "<i8"), n, n_docs, length) for c, n in zip(part.column(3).to_pylist(), part.column(1).to_pylist())]
                rows = np.repeat(np.arange(len(terms)), [len(t) for t in terms])
                ids, missing = known.fill_null(0).to_numpy(zero_copy_only=False), known.is_null().to_numpy(zero_copy_only=False)
                for first, scores in tiles.scores(rows, np.concatenate(terms), np.concatenate(found), len(terms)):
                    best.add(first, scores, ids, missing)
        for item, (score, number, gone) in zip(item_ids, best.held):
            if len(score):
                values = pa.array([item] * len(score), schema[0].type), pa.array(number, mask=gone), pa.array(score)
                yield pa.RecordBatch.from_arrays(list(values), schema=schema)

    return run


def _block(items: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """The k best documents of each of some items; ``items`` fits the driver by its size, which the caller checked."""
    terms_of: dict = {}
    for item_id, text in items.collect():
        terms_of.setdefault(item_id, set()).update(term_counts((text or "").encode()))
    vocabulary = {t: i for i, t in enumerate(sorted(set().union(*terms_of.values())))}
    item_terms = [np.array(sorted(vocabulary[t] for t in terms), np.int64) for terms in terms_of.values()]
    hits = settled(docs.mapInArrow(_hits(vocabulary), ddl(_HITS)), "lexical-hits")
    parts = hits.select("n", "terms").mapInArrow(_counts(len(vocabulary)), ddl(_COUNTS))
    sums = parts.groupBy("kind", "term").agg(F.sum("n").alias("n")).collect()  # one row a term of the vocabulary
    facts = {(r["kind"], r["term"]): r["n"] for r in sums}
    n_docs, length = facts.get((_N, -1), 0), facts.get((_L, -1), 0)
    df = np.array([facts.get((_DF, i), 0) for i in range(len(vocabulary))], np.int64)
    kind = items.schema["item_id"].dataType
    schema = pa.schema([("item_id", to_arrow_type(kind)), ("doc_id", pa.int64()), ("score", pa.int64())])
    work = _search(list(terms_of), item_terms, weights(df, n_docs), n_docs, length, k, schema)
    found = hits.mapInArrow(work, f"item_id {kind.simpleString()}, doc_id long, score long")
    best = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` highest-scoring documents of each item.

    ``docs`` holds doc_id and text, ``items`` item_id and text.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    items = items.select("item_id", "text")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // ITEM_BYTES)
    if blocks <= 1:
        return _block(items, docs, k)
    block = F.pmod(F.xxhash64("item_id"), F.lit(blocks))
    found = [_block(items.where(block == b), docs, k) for b in range(blocks)]
    every = found[0]
    for part in found[1:]:
        every = every.unionByName(part)
    return every
