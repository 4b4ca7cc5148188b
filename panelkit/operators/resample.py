"""Bootstrap replicates summed where the rows are.

A row's weight in a replicate depends on its own id only, so every task can draw the
weights of its ids, multiply the matrix of weights with the matrix of terms and hand on
one row for each (group, replicate).  The rows of an id are brought together, so that
its weights are drawn once for all groups that it stands in.  Nothing larger than a block of rows times the
draws is held, besides the sums of the groups at hand.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from math import sin

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from panelkit.session import fanned_out

# P(Poisson(1) <= k) for k = 0, 1, 2 and so on.
POISSON = (
    0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462,
    0.9963401531726563, 0.9994058151824183, 0.9999167588507119, 0.9999897508033253, 0.9999988747974020,
)
#: Rows whose weights are held at a time; numbers that the sums of a task's groups hold before they are handed on.
ROWS, HELD = 64, 1 << 24


def weights(ids: Sequence[str | None], draws: int, seed: int) -> np.ndarray:
    """Appearances of each row in each replicate: rows x draws.

    Poisson with mean 1 by md5(seed|b|id), where a hash serves four replicates.
    """
    heads = [f"{seed}|{b}".encode() for b in range(-(-draws // 4))]
    md5 = hashlib.md5
    tails = [b"" if i is None else b"|" + i.encode() for i in ids]
    bits = b"".join([md5(head + tail).digest() for tail in tails for head in heads])
    u = (np.frombuffer(bits, ">u4").astype(np.float64) + 0.5) / 4294967296.0
    drawn = np.searchsorted(np.array(POISSON), u, side="left")  # thresholds below u
    return drawn.reshape(len(tails), -1)[:, :draws].astype(np.float64)


def _sums(n_keys: int, n_terms: int, draws: int, seed: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple[int, np.ndarray]] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for key, (n, sums) in held.items():
                columns = [pa.array([k] * draws, f.type) for k, f in zip(key, schema)]
                columns += [pa.array(np.arange(draws, dtype=np.int32)), pa.array(np.full(draws, n)), *map(pa.array, sums)]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

        for batch in batches:
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(n_keys)), strict=True)) if n_keys else [()] * batch.num_rows
            ids = batch.column(n_keys).to_pylist()
            # the weights themselves are summed as the first term
            terms = np.stack([np.ones(len(ids)), *(batch.column(n_keys + 1 + i).to_numpy(zero_copy_only=False) for i in range(n_terms))])
            by_id: dict[str | None, list[int]] = {}
            for row, own in enumerate(ids):
                by_id.setdefault(own, []).append(row)
            names = list(by_id)
            for at in range(0, len(names), ROWS):
                part = names[at : at + ROWS]
                drawn = weights(part, draws, seed)
                # an id's weights serve its rows in every group
                by_key: dict[tuple, tuple[list[int], list[int]]] = {}
                for place, own in enumerate(part):
                    for row in by_id[own]:
                        rows, places = by_key.setdefault(keys[row], ([], []))
                        rows.append(row)
                        places.append(place)
                for key, (rows, places) in by_key.items():
                    n, sums = held.get(key, (0, np.zeros((1 + n_terms, draws))))
                    by_place = np.zeros((1 + n_terms, len(part)))
                    np.add.at(by_place, (slice(None), places), terms[:, rows])
                    sums += by_place @ drawn
                    held[key] = n + len(rows), sums
                    if len(held) * sums.size >= HELD:
                        yield from out()
                        held = {}
        yield from out()

    return run


def replicates(df: DataFrame, keys: Sequence[str], id_col: str, terms: dict[str, Column], draws: int, seed: int) -> DataFrame:
    """Weighted sums of ``terms`` for each replicate, with the sum of weights ``_w`` and the rows ``n``.

    Rows without a value in some term must be left out before.
    """
    keys = list(keys)
    rows = df.select(*keys, F.col(id_col).cast("string").alias("_id"), *[c.cast("double").alias(k) for k, c in terms.items()])
    fields = [StructField("_rep", IntegerType()), StructField("n", LongType()), *[StructField(c, DoubleType()) for c in ("_w", *terms)]]
    made = StructType([*rows.select(*keys).schema.fields, *fields])
    parts = fanned_out(rows, "_id").sortWithinPartitions("_id").mapInArrow(_sums(len(keys), len(terms), draws, seed, to_arrow_schema(made)), made)
    return parts.groupBy(*keys, "_rep").agg(*[F.sum(c).alias(c) for c in ("n", "_w", *terms)])


_MD5_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
_MD5_ADD = [int(abs(sin(i + 1)) * 2**32) for i in range(64)]
_MD5_TURN = [(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)]
_MD5_WORD = [(1, 0), (5, 1), (3, 5), (7, 0)]
#: The last step that decides the first word of a digest; lengths of heads that a task keeps the draws' words of.
_MD5_FIRST, KNOWN = 60, 64


def _md5_block(state: Sequence[np.ndarray], words: Sequence[np.ndarray], steps: int = 64) -> list[np.ndarray]:
    """Words of the state after ``steps`` of a block, of many messages at once; words that all share have one entry."""
    a, b, c, d = state
    for i in range(steps):
        turn, (times, more) = _MD5_TURN[i // 16][i % 4], _MD5_WORD[i // 16]
        word = words[(times * i + more) % 16]
        x = (a + (word + np.uint32(_MD5_ADD[i]))) if len(word) == 1 else a + word + np.uint32(_MD5_ADD[i])
        if i < 16:  # some words of the state may still be shared
            f = ((c ^ d) & b ^ d) + x
        elif i < 32:
            f = b ^ c
            f &= d
            f ^= c
        elif i < 48:
            f = b ^ c
            f ^= d
        else:
            f = ~d
            f |= b
            f ^= c
        if i >= 16:
            f += x
        x = f << np.uint32(turn)
        f >>= np.uint32(32 - turn)
        x |= f
        x += b
        a, b, c, d = d, x, b, c
    return [a, b, c, d]


def _draw_words(length: int, draws: int, blocks: int) -> list[tuple[np.ndarray, int, list[np.ndarray]]]:
    """What follows a head of ``length`` bytes, with padding, of all draws: (draws, bytes before, words) by number of blocks of md5."""
    ends = np.array([f"{rep}|{m}".encode() + b"\x80" for rep in range(draws) for m in range(blocks)])
    before, wide = length // 64 * 64, ends.itemsize
    sizes = length + np.char.str_len(ends) - 1
    counts = (sizes - before + 8) // 64 + 1
    found = []
    for size in np.unique(counts).tolist():
        own = np.flatnonzero(counts == size)
        data = np.zeros((len(own), 64 * size + wide), np.uint8)
        data[:, length - before : length - before + wide] = ends[own].view(np.uint8).reshape(len(own), wide)
        data[:, 64 * size - 8 : 64 * size] = (8 * sizes[own]).astype("<u8").view(np.uint8).reshape(len(own), 8)
        words = np.ascontiguousarray(data[:, : 64 * size]).view("<u4").T.astype(np.uint32, order="C")
        found.append((own, before, [w if (w != w[0]).any() else w[:1].copy() for w in words]))
    return found


def first_words(head: str, draws: int, blocks: int, known: dict | None = None) -> np.ndarray:
    """The first four bytes of md5(head + "rep|m") as a number, draws x blocks.

    All draws of a head go through the steps of md5 side by side, in numpy; words that they share are held once.
    ``known`` keeps what heads of one length have in common for the next call.
    """
    start, known = head.encode(), {} if known is None else known
    asked = len(start), draws, blocks
    if asked not in known:
        if len(known) >= KNOWN:
            known.clear()
        known[asked] = _draw_words(*asked)
    out = np.empty(draws * blocks, np.uint32)
    for own, before, rest in known[asked]:
        state = [np.array([v], np.uint32) for v in _MD5_START]
        for at in range(0, before, 64):
            state = [x + y for x, y in zip(state, _md5_block(state, np.frombuffer(start[at : at + 64], "<u4").reshape(16, 1)), strict=True)]
        shared = start[before:]
        shared = np.frombuffer(shared.ljust(-(-len(shared) // 4) * 4, b"\0"), "<u4").astype(np.uint32)
        last = len(rest) // 16 - 1
        for k in range(last + 1):
            words = [rest[i] | shared[i] if i < len(shared) else rest[i] for i in range(16 * k, 16 * k + 16)]
            if k == last:
                out[own] = _md5_block(state, words, _MD5_FIRST + 1)[1] + state[0]
            else:
                state = [x + y for x, y in zip(state, _md5_block(state, words), strict=True)]
    return out.byteswap().reshape(draws, blocks)


def block_means(values: np.ndarray, key: str, block: int, draws: int, seed: int, known: dict | None = None) -> np.ndarray:
    """Means of moving-block replicates: ceil(n / block) blocks are drawn by md5(seed|key|block|rep|m) and cut to n.

    Each block is summed value by value: differences of running sums leave noise where values cancel.
    """
    n = len(values)
    blocks = -(-n // block)
    places, rest = n - block + 1, n - block * (blocks - 1)
    sums = np.zeros(places)
    for j in range(block):
        sums += values[j : j + places]
        if j + 1 == rest:
            cut = sums.copy()
    drawn = first_words(f"{seed}|{key}|{block}|", draws, blocks, known)
    starts = drawn - drawn // np.uint32(places) * np.uint32(places)
    total = np.zeros(draws)
    for m in range(blocks):
        total += (sums if m < blocks - 1 else cut)[starts[:, m]]
    return total / n


def block_intervals(groups: DataFrame, blocks: Sequence[int], draws: int, seed: int, level: float) -> DataFrame:
    """``_key``, block, ci_lo and ci_hi of every group and block length that it is long enough for.

    ``groups`` holds ``_key`` and ``_d``, the group's values in order.
    """
    tails = [(1.0 - level) / 2.0, 1.0 - (1.0 - level) / 2.0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for batch in batches:
            rows = []
            for key, values in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = np.array(values, np.float64)
                for block in blocks:
                    if len(own) >= block + 1:
                        lo, hi = np.quantile(block_means(own, key, block, draws, seed, known), tails)
                        rows.append((key, block, float(lo), float(hi)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["_key", "block", "ci_lo", "ci_hi"])

    found = fanned_out(groups.select("_key", "_d")).mapInArrow(run, "_key string, block long, ci_lo double, ci_hi double")
    return found.withColumn("block", F.col("block").cast("int"))
