"""Exact top-k search by inner product with a pivot table.

Vectors become whole numbers, ``floor(scale * x)``.  A table holds each vector's
Euclidean distances to many pivots.  By the triangle inequality the greatest
difference between a query's and a candidate's entries is a lower bound of their
distance, and ``q.x = (|q|^2 + |x|^2 - |q-x|^2) / 2`` turns it into an upper bound of
the score.  Candidates are scored in falling order of that bound until the k-th best
score exceeds every bound that is left, so the result is exact.

Candidates are dealt out in small blocks to slots; every block of queries visits every
slot, and a slot answers with k rows for each query.  Pivots are chosen, far from each
other, from a bounded sample; they steer the work and never the result.

Doubles hold the scores of *plain* vectors exactly: those without a component beyond
sqrt(2^52 / length).  Others are *wide*.  They are no pivots and have no place in the table;
a score with a wide vector is computed in integers of any size, after the same early
stopping with bounds from scaled doubles and their rounding error.

Defined cases: rows with a null id, a null vector, or null or non-finite components
take no part; only vectors of equal length are compared; a query's own id is no
candidate; equal scores rank by id; a row that stands twice counts twice; a score beyond
64 bits is given, and ranks, as the nearest 64-bit number.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from operator import mul

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelkit.llm.arrow import arrow_schema, ddl

SCALE, PIVOTS = 256, 32
#: Vectors in the sample that pivots come from; vectors in a dealt block, in a block of queries, and in a slot at most.
SAMPLE, BLOCK, QUERY_BLOCK, SLOT = 1024, 128, 1024, 100_000
#: Roles of dealt blocks, in the order in which a slot meets them; wide blocks hold the components as they came.
PLAIN, WIDE, ASK_PLAIN, ASK_WIDE = range(4)
LEAST, MOST = -(1 << 63), (1 << 63) - 1
_PACKED = {"role": "int", "block": "long", "dim": "long", "ids": "binary", "vectors": "binary"}
_FOUND = {"query_key": "long", "query_id": "long", "vec_id": "long", "score": "long"}


def whole_numbers(batch: pa.RecordBatch, scale: int = SCALE) -> Iterator[tuple[int, bool, np.ndarray, np.ndarray]]:
    """(length, wide, ids, vectors) of the rows that take part, by vector length; columns are id and vector."""
    ids, lists = batch.column(0), batch.column(1)
    sizes = lists.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    ends = np.cumsum(np.maximum(sizes, 0))
    known = ids.is_valid().to_numpy(zero_copy_only=False) & (sizes >= 0)
    numbers = ids.fill_null(0).to_numpy(zero_copy_only=False)
    for dim in np.unique(sizes[known]).tolist():
        rows = np.flatnonzero(known & (sizes == dim))
        own = flat[(ends[rows] - dim)[:, None] + np.arange(dim)] if dim else np.empty((len(rows), 0))
        good = np.isfinite(own).all(axis=1)
        rows, own = rows[good], own[good]
        wide = (np.abs(own) > (np.sqrt(2.0**52 / max(1, dim)) - 1) / scale).any(axis=1)
        yield int(dim), False, numbers[rows[~wide]], np.floor(scale * own[~wide])
        if wide.any():
            yield int(dim), True, numbers[rows[wide]], own[wide]


def integers(vectors: np.ndarray, scale: int = SCALE) -> list[list[int]]:
    """``floor(scale * x)`` of components of any size; from 2^45 on they are whole before they are scaled."""
    return [[scale * int(x) if abs(x) >= 2.0**45 else math.floor(scale * x) for x in row] for row in vectors.tolist()]


def _packed(size: int, scale: int, plain: int, wide: int | None):
    """Blocks of at most ``size`` vectors; without a role for wide vectors these are left out."""
    schema = arrow_schema(_PACKED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, held = TaskContext.get().partitionId() << 31, {}

        def row(role: int, dim: int, ids: np.ndarray, vectors: np.ndarray) -> pa.RecordBatch:
            nonlocal made
            made += 1
            values = role, made, dim, ids.astype("<i8").tobytes(), vectors.astype("<f8").tobytes()
            return pa.RecordBatch.from_arrays([pa.array([v], type=f.type) for v, f in zip(values, schema, strict=True)], schema=schema)

        for batch in batches:
            for dim, is_wide, ids, vectors in whole_numbers(batch, scale):
                role = wide if is_wide else plain
                if role is None:
                    continue
                if (role, dim) in held:
                    ids, vectors = np.r_[held[role, dim][0], ids], np.vstack([held[role, dim][1], vectors])
                whole = len(ids) // size * size
                for at in range(0, whole, size):
                    yield row(role, dim, ids[at : at + size], vectors[at : at + size])
                held[role, dim] = ids[whole:], vectors[whole:]
        for (role, dim), (ids, vectors) in held.items():
            if len(ids):
                yield row(role, dim, ids, vectors)

    return run


def choose_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Farthest-first: each pivot is the vector farthest from those before it."""
    if not len(sample):
        return sample
    chosen = [0]
    nearest = np.linalg.norm(sample - sample[0], axis=1)
    while len(chosen) < min(n, len(sample)) and nearest.max() > 0:
        chosen.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, np.linalg.norm(sample - sample[chosen[-1]], axis=1))
    return sample[chosen]


def distances(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The pivot table: one row for each vector."""
    squares = (vectors**2).sum(axis=1)[:, None] + (pivots**2).sum(axis=1)[None, :] - 2 * vectors @ pivots.T
    return np.sqrt(np.maximum(squares, 0))


def search(queries, query_ids, vectors, ids, pivots: np.ndarray, k: int, chunk: int = 64, table: np.ndarray | None = None) -> Iterator[tuple[int, int, int]]:
    """(query's row, candidate's id, score) of the k best candidates of each query; ``table`` holds the candidates' distances to the pivots."""
    table, norms = distances(vectors, pivots) if table is None else table, (vectors**2).sum(axis=1)
    for q, (query, own_id) in enumerate(zip(queries, query_ids, strict=True)):
        norm = query @ query
        if len(pivots):
            near = np.abs(table - distances(query[None, :], pivots)).max(axis=1)
        else:
            near = np.zeros(len(vectors))
        # rounding of distances is far below this slack
        bound = (norm + norms - np.maximum(near - 1e-6 * (1 + near), 0) ** 2) / 2 + 1e-6 * (1 + norm + norms)
        bound = np.minimum(bound, np.sqrt(norm * norms) * (1 + 1e-9) + 1e-6)
        bound[ids == own_id] = -np.inf
        order = np.argsort(-bound, kind="stable")
        best_score, best_id, at = np.empty(0), np.empty(0, np.int64), 0
        while at < len(order) and bound[order[at]] > -np.inf and (len(best_score) < k or bound[order[at]] >= best_score[-1]):
            part = order[at : at + chunk]
            part = part[bound[part] > -np.inf]
            score, number = np.r_[best_score, vectors[part] @ query], np.r_[best_id, ids[part]]
            rank = np.lexsort((number, -score))[:k]
            best_score, best_id, at = score[rank], number[rank], at + chunk
        for number, score in zip(best_id.tolist(), best_score.tolist(), strict=True):
            yield q, number, int(score)


def _scaled(vectors: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Each vector divided by a power of two that brings it below 1, and the exponents."""
    shift = np.array([max((x.bit_length() for x in v), default=0) for v in vectors], np.int64)
    # cut to 62 bits first: integers may exceed the range of doubles
    made = np.array([[math.ldexp(x >> max(0, s - 62), max(0, s - 62) - s) for x in v] for v, s in zip(vectors, shift.tolist(), strict=True)], np.float64)
    return made.reshape(len(vectors), -1), shift


def search_wide(queries: list[list[int]], query_ids, vectors: list[list[int]], ids, k: int) -> Iterator[tuple[int, int, int]]:
    """As ``search``, for whole numbers of any size; scores beyond 64 bits are cut to 64 bits."""
    near, near_shift = _scaled(vectors)
    asked, asked_shift = _scaled(queries)
    for q, (query, own_id) in enumerate(zip(queries, query_ids, strict=True)):
        with np.errstate(over="ignore"):
            # an error below 1e-9 of the greatest sum that components below 1 can have
            bound = np.ldexp(near @ asked[q] + 1e-9 * (1 + len(query)), np.minimum(near_shift + asked_shift[q], 1000))
        bound = np.minimum(bound, float(MOST))
        bound[ids == own_id] = -np.inf
        best: list[tuple[int, int]] = []
        for at in np.argsort(-bound, kind="stable").tolist():
            if bound[at] == -np.inf or len(best) == k and bound[at] < -best[-1][0]:
                break
            score = max(LEAST, min(MOST, sum(map(mul, query, vectors[at]))))
            if len(best) < k or (-score, int(ids[at])) < best[-1]:
                best = sorted([*best, (-score, int(ids[at]))])[:k]
        for score, number in best:
            yield q, number, -score


def _slot_search(pivots: dict[int, np.ndarray], k: int, scale: int):
    """Within a slot: blocks of candidates come first and stay, blocks of queries then pass one by one."""
    schema = arrow_schema(_FOUND)

    def joined(parts: list) -> tuple[np.ndarray, np.ndarray]:
        return (np.concatenate([p[0] for p in parts]), np.vstack([p[1] for p in parts])) if len(parts) > 1 else parts[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot, parts, ready = None, {}, {}

        def candidates(kind: str, dim: int):
            """A slot's candidates in the form that a search takes, made once."""
            if (kind, dim) not in ready:
                plain, wide = parts.get((PLAIN, dim)), parts.get((WIDE, dim))
                if kind == "table":
                    ids, vectors = joined(plain)
                    own = pivots.get(dim, np.empty((0, dim)))
                    ready[kind, dim] = ids, vectors, own, distances(vectors, own)
                else:
                    found = [joined(wide)] if wide else []
                    numbers = integers(found[0][1], scale) if found else []
                    if kind == "all" and plain:
                        found.append(joined(plain))
                        numbers += [[int(x) for x in v] for v in found[-1][1].tolist()]
                    ready[kind, dim] = np.concatenate([f[0] for f in found]) if found else np.empty(0, np.int64), numbers
            return ready[kind, dim]

        for batch in batches:
            for own, role, block, dim, ids, vectors in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own != slot:
                    slot, parts, ready = own, {}, {}
                ids = np.frombuffer(ids, "<i8")
                vectors = np.frombuffer(vectors, "<f8").reshape(len(ids), dim)
                if role in (PLAIN, WIDE):
                    parts.setdefault((role, dim), []).append((ids, vectors))
                    continue
                found = []
                if role == ASK_PLAIN and (PLAIN, dim) in parts:
                    known, against, own_pivots, table = candidates("table", dim)
                    found += search(vectors, ids, against, known, own_pivots, k, table=table)
                if role == ASK_WIDE or (WIDE, dim) in parts:
                    known, against = candidates("all" if role == ASK_WIDE else "wide", dim)
                    asked = integers(vectors, scale) if role == ASK_WIDE else [[int(x) for x in v] for v in vectors.tolist()]
                    found += search_wide(asked, ids, against, known, k) if len(known) else ()
                if found:
                    rows = [((block << 11) + q, int(ids[q]), number, score) for q, number, score in found]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=schema)

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_column: str = "vec_id", vector_column: str = "embedding", scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` highest inner products of each query row."""
    spark = vectors.sparkSession
    named = vectors.where(F.col(id_column).isNotNull() & F.col(vector_column).isNotNull())
    queries = named.where(is_query).select(id_column, vector_column)
    named = named.select(id_column, vector_column)
    n, n_queries = named.count(), queries.count()
    slots = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // SLOT))
    sample = named.orderBy(F.xxhash64(id_column), id_column).limit(SAMPLE).mapInArrow(_packed(SAMPLE, scale, PLAIN, None), ddl(_PACKED))
    pivots = {
        r["dim"]: choose_pivots(np.frombuffer(r["vectors"], "<f8").reshape(-1, max(1, r["dim"])), PIVOTS)
        for r in sample.collect()  # at most SAMPLE vectors
        if r["dim"]
    }
    candidates = named.mapInArrow(_packed(BLOCK, scale, PLAIN, WIDE), ddl(_PACKED)).withColumn("slot", F.pmod(F.xxhash64("block", "dim"), F.lit(slots)).cast("int"))
    asked = queries.repartition(max(1, -(-n_queries // QUERY_BLOCK))).mapInArrow(_packed(QUERY_BLOCK, scale, ASK_PLAIN, ASK_WIDE), ddl(_PACKED))
    asked = asked.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))))
    # a slot's number is its partition's: no two slots meet in one task
    dealt = candidates.unionByName(asked).repartitionById(slots, "slot").sortWithinPartitions("slot", "role", "block", "dim")
    found = dealt.select("slot", "role", "block", "dim", "ids", "vectors").mapInArrow(_slot_search(pivots, k, scale), ddl(_FOUND))
    best = Window.partitionBy("query_key").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
