"""Spelling variants grouped under frequent forms, by Bloom-guided neighbourhoods.

Words are counted where their texts are and summed over the corpus.  Two words are near
if one inserted, deleted or replaced code point turns one into the other.  To find near
words without comparing words, every word generates its edits, and the edits are probed
against blocked Bloom filters of the vocabulary, one filter for each word length.  Only
edits that a filter takes for a word are written out and shuffled to an exact join with
the vocabulary, which removes the false positives.  Each unordered pair is generated once:
by the longer word (it deletes a code point), or by the word with the smaller code
point where two differ (it replaces it by a larger one).

The filters are broadcast, and their size is bounded: words fall into slices by their hash
so that the filters of a slice stay below ``FILTER_BYTES``; each slice is one pass over the
vocabulary, in which only edits of that slice are probed.  One slice holds about forty million words.

Hashes of edits come from the hash of their word in constant time, for whole arrays of words
of equal length.  All words consist of code points below 256 and travel as Latin-1 bytes in tasks.

A word's form is its near word of largest count, if that is at least twice the word's own.
Counts at least double from form to form, so chains are short; roots are found by pointer
doubling over the words whose form has a form.

Defined cases: null and empty texts have no words; a null id counts as an empty one in the
choice of deletions; rows that stand twice count twice; of near words with equal counts
the smallest in code-point order is the form.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelkit.llm.arrow import arrow_schema, ddl
from panelkit.llm.words import mixed
from panelkit.session import fanned_out, settled

#: Least code points and occurrences of a word; words whose form holds so many times their count; one run in so many loses a code point.
LEAST_LENGTH, LEAST_COUNT, RATIO, CORRUPT = 5, 3, 2, 97
#: Bits of a filter for each word, bytes of all filters of a slice, blocks that one row of a filter holds.
WORD_BITS, FILTER_BYTES, BLOCK_ROWS = 12, 64 << 20, 1 << 12
#: Distinct words that a task counts before it hands them on; probes made at a time; bytes of a text searched at a time.
HELD, PROBES, PIECE = 400_000, 1 << 20, 1 << 22

_RUN = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\xbf])+")
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: Code points that runs can hold once A-Z are lower case.
ALPHABET = np.r_[np.arange(97, 123), np.arange(0xC0, 0x100)].astype(np.uint8)

U = np.uint64
_CODES = mixed(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))
_BASE = U(0xD1342543DE82EF95)
#: Odd factors of the eight lanes of a block.
_LANES = np.array([0x47B6137B, 0x44974D91, 0x8824AD5B, 0xA2B7289D, 0x705495C7, 0x2DF1424B, 0x9EFC4947, 0x5C6BFB31], np.uint32)

_WORDS = {"word": "string", "n": "long"}
_FILTER = {"slice": "int", "length": "int", "first": "long", "rows": "binary"}
_FOUND = {"candidate": "string", "word": "string", "n": "long"}


# --- the vocabulary ---------------------------------------------------------


def _runs(text: bytes) -> Counter:
    """Lower-cased runs of UTF-8 ``text``; a long text is cut between runs."""
    if len(text) <= PIECE:
        return Counter(_RUN.findall(text.translate(_LOWER)))
    found, at = Counter(), 0
    while at < len(text):
        end = min(at + PIECE, len(text))
        while end < len(text) and (chr(text[end]).isalpha() or text[end] >= 0x80):
            end += 1
        found.update(_RUN.findall(text[at:end].translate(_LOWER)))
        at = end
    return found


def corrupted(doc_id, runs: Counter, one_in: int = CORRUPT) -> Iterator[tuple[bytes, int]]:
    """(word, count) of a document after the deletions that a checksum of id and run decides; Latin-1 bytes."""
    start = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    start = zlib.crc32(b":", start)
    for run, n in runs.items():
        h = zlib.crc32(run, start)
        word = run if run.isascii() else run.decode().encode("latin-1")
        if h % one_in == 0:
            at = h % len(word)
            word = word[:at] + word[at + 1 :]
        yield word, n


def _count(least_length: int, one_in: int):
    schema = arrow_schema(_WORDS)

    def out(held: Counter) -> pa.RecordBatch:
        words = pa.array([w.decode("latin-1") for w in held], pa.string())
        return pa.RecordBatch.from_arrays([words, pa.array(list(held.values()), pa.int64())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            for doc_id, text in zip(batch.column(0).to_pylist(), texts, strict=True):
                for word, n in corrupted(doc_id, _runs(text.as_py() or b""), one_in):
                    if len(word) >= least_length:
                        held[word] += n
                if len(held) >= HELD:
                    yield out(held)
                    held = Counter()
        if held:
            yield out(held)

    return run


def vocabulary(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, one_in: int = CORRUPT) -> DataFrame:
    """word, n of all words with enough code points and occurrences."""
    parts = docs.select("doc_id", "text").mapInArrow(_count(least_length, one_in), ddl(_WORDS))
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


# --- hashes of words and of their edits -------------------------------------


def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.r_[np.ones(1, U), np.full(max(0, n - 1), _BASE, U)])[:n]


def hashes(codes: np.ndarray) -> np.ndarray:
    """One hash for each row of code points."""
    return mixed((_CODES[codes] * _powers(codes.shape[1])).sum(axis=1, dtype=U))


def replaced(codes: np.ndarray, at: int, alphabet: np.ndarray) -> np.ndarray:
    """Hashes of the words with the code point at ``at`` replaced by each of ``alphabet``: words x alphabet."""
    powers = _powers(codes.shape[1])
    rest = (_CODES[codes] * powers).sum(axis=1, dtype=U) - _CODES[codes[:, at]] * powers[at]
    return mixed(rest[:, None] + (_CODES[alphabet] * powers[at])[None, :])


def shortened(codes: np.ndarray) -> np.ndarray:
    """Hashes of the words without the code point at each place: words x places."""
    length = codes.shape[1]
    powers = _powers(length)
    own = _CODES[codes] * powers
    before = np.cumsum(own, axis=1, dtype=U) - own
    shifted = _CODES[codes[:, 1:]] * powers[: length - 1]
    after = np.zeros_like(own)
    after[:, :-1] = np.cumsum(shifted[:, ::-1], axis=1, dtype=U)[:, ::-1]
    return mixed(before + after)


def slice_of(h: np.ndarray, slices: int) -> np.ndarray:
    return ((h & U(0xFFFF)) * U(slices)) >> U(16)


def _place(h: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Block and the bit in each of its eight lanes; other bits of the hash than the slice's."""
    block = ((h >> U(32)) * U(blocks)) >> U(32)
    low = ((h >> U(4)) & U(0xFFFFFFFF)).astype(np.uint32)
    bits = np.uint32(1) << ((low[:, None] * _LANES[None, :]) >> np.uint32(27))
    return block.astype(np.int64), bits


def blocks_for(n: int) -> int:
    """Blocks of 256 bits of a filter over ``n`` words."""
    return -(-n * WORD_BITS // 256) + 1


def holds(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Places of the hashes that the filter may hold; lane by lane, so most fall out early."""
    block = (((h >> U(32)) * U(len(table))) >> U(32)).astype(np.int64)
    low = ((h >> U(4)) & U(0xFFFFFFFF)).astype(np.uint32)
    left = np.arange(len(h))
    for lane, factor in enumerate(_LANES):
        bit = np.uint32(1) << ((low[left] * factor) >> np.uint32(27))
        left = left[(table[block[left], lane] & bit) != 0]
    return left


# --- filters ----------------------------------------------------------------


def _by_length(batch: pa.RecordBatch, word_at: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, code points) of the words of a batch, by length."""
    words = [w.encode("latin-1") for w in batch.column(word_at).to_pylist()]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    for length in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == length)
        yield rows, np.frombuffer(b"".join(words[i] for i in rows.tolist()), np.uint8).reshape(len(rows), length)


def _with_place(slices: int, blocks: dict[tuple[int, int], int]):
    """slice, length, first block of the filter row, block in it and the lanes' bits of each word."""
    schema = pa.schema([("slice", pa.int32()), ("length", pa.int32()), ("first", pa.int64()), ("block", pa.int32()), ("bits", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, codes in _by_length(batch, 0):
                length, h = codes.shape[1], hashes(codes)
                own = slice_of(h, slices).astype(np.int32)
                for s in np.unique(own).tolist():
                    block, bits = _place(h[own == s], blocks[s, length])
                    size = len(block)
                    values = (
                        pa.array(np.full(size, s, np.int32)), pa.array(np.full(size, length, np.int32)), pa.array(block // BLOCK_ROWS),
                        pa.array((block % BLOCK_ROWS).astype(np.int32)), pa.array([b.tobytes() for b in bits], pa.binary()),
                    )
                    yield pa.RecordBatch.from_arrays(list(values), schema=schema)

    return run


def _rows_of_filter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (slice, length, first); one table of bits is held at a time."""
    schema, key, table = arrow_schema(_FILTER), None, None

    def out() -> pa.RecordBatch:
        values = [pa.array([v], f.type) for v, f in zip((*key, table.tobytes()), schema)]
        return pa.RecordBatch.from_arrays(values, schema=schema)

    for batch in batches:
        heads = list(zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True))
        blocks = batch.column(3).to_numpy()
        bits = np.frombuffer(b"".join(batch.column(4).to_pylist()), np.uint32).reshape(-1, 8)
        edges = [i for i in range(len(heads)) if i == 0 or heads[i] != heads[i - 1]] + [len(heads)]
        for lo, hi in zip(edges, edges[1:]):
            if heads[lo] != key:
                if table is not None:
                    yield out()
                key, table = heads[lo], np.zeros((BLOCK_ROWS, 8), np.uint32)
            np.bitwise_or.at(table, blocks[lo:hi], bits[lo:hi])
    if table is not None:
        yield out()


def _sizes(words: DataFrame, slices: int) -> dict[tuple[int, int], int]:
    """Words of each (slice, length); a row for each."""
    schema = pa.schema([("slice", pa.int32()), ("length", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            for rows, codes in _by_length(batch, 0):
                for s, n in enumerate(np.bincount(slice_of(hashes(codes), slices).astype(np.int64), minlength=slices).tolist()):
                    found[s, codes.shape[1]] += n
        columns = [k[0] for k in found], [k[1] for k in found], list(found.values())
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    parts = words.select("word").mapInArrow(run, "slice int, length int, n long")
    return {(r[0], r[1]): r[2] for r in parts.groupBy("slice", "length").agg(F.sum("n")).where("sum(n) > 0").collect()}


def filters(words: DataFrame, slices: int, blocks: dict[tuple[int, int], int]) -> DataFrame:
    """Blocked Bloom filters of the vocabulary in rows of ``BLOCK_ROWS`` blocks: slice, length, first, rows."""
    placed = words.select("word").mapInArrow(_with_place(slices, blocks), "slice int, length int, first long, block int, bits binary")
    dealt = fanned_out(placed, "slice", "length", "first").sortWithinPartitions("slice", "length", "first")
    return dealt.mapInArrow(_rows_of_filter, ddl(_FILTER))


def _tables(rows: list) -> dict[int, np.ndarray]:
    """Filters of one slice by word length; a row that holds no word is all zeros."""
    most: dict = {}
    for r in rows:
        most[r["length"]] = max(most.get(r["length"], 0), r["first"])
    tables = {length: np.zeros(((last + 1) * BLOCK_ROWS, 8), np.uint32) for length, last in most.items()}
    for r in rows:
        at = r["first"] * BLOCK_ROWS
        tables[r["length"]][at : at + BLOCK_ROWS] = np.frombuffer(r["rows"], np.uint32).reshape(-1, 8)
    return tables


# --- neighbourhoods ---------------------------------------------------------


def _probe(sent, own: int, slices: int, blocks: dict[int, int]):
    """Edits that the filters of slice ``own`` take for words."""
    schema = arrow_schema(_FOUND)

    def positives(table: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        flat = h.ravel()
        if slices > 1:
            inside = np.flatnonzero(slice_of(flat, slices) == own)
            return np.divmod(inside[holds(table, flat[inside])], h.shape[1])
        return np.divmod(holds(table, flat), h.shape[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = {length: sent.value[length][: blocks[length]] for length in sent.value}
        for batch in batches:
            counts = batch.column(1).to_numpy()
            for rows, codes in _by_length(batch, 0):
                length = codes.shape[1]
                step = max(1, PROBES // len(ALPHABET))
                for at in range(0, len(rows), step):
                    part, numbers = codes[at : at + step], rows[at : at + step]
                    made, source = [], []
                    if length - 1 in tables:
                        who, place = positives(tables[length - 1], shortened(part))
                        made += [np.delete(part[i], j).tobytes() for i, j in zip(who.tolist(), place.tolist())]
                        source.append(who)
                    for j in range(length if length in tables else 0):
                        who, letter = positives(tables[length], replaced(part, j, ALPHABET))
                        larger = ALPHABET[letter] > part[who, j]
                        who, letter = who[larger], letter[larger]
                        edited = part[who].copy()
                        edited[:, j] = ALPHABET[letter]
                        made += [w.tobytes() for w in edited]
                        source.append(who)
                    if not made:
                        continue
                    who = np.concatenate(source)
                    # a run of equal letters gives the same word at each of its places
                    pairs = sorted(set(zip(who.tolist(), made)))
                    who = np.array([w for w, _ in pairs])
                    values = (
                        pa.array([w.decode("latin-1") for _, w in pairs], pa.string()),
                        pa.array([part[i].tobytes().decode("latin-1") for i in who.tolist()], pa.string()),
                        pa.array(counts[numbers[who]], pa.int64()),
                    )
                    yield pa.RecordBatch.from_arrays(list(values), schema=schema)

    return run


def near_pairs(words: DataFrame) -> DataFrame:
    """word, n, near, near_n: each pair of near words in both directions; ``words`` is a written table."""
    spark = words.sparkSession
    size = words.count()
    slices = max(1, -(-size * WORD_BITS // (8 * FILTER_BYTES)))
    if slices > 1 << 16:
        raise ValueError("more slices than the hash tells apart; raise FILTER_BYTES")
    blocks = {k: blocks_for(n) for k, n in _sizes(words, slices).items()}
    built = settled(filters(words, slices, blocks), "bloom") if size else None
    found = None
    for s in range(slices if size else 0):
        rows = built.where(F.col("slice") == s).collect()  # FILTER_BYTES and a row for each length at most, but for the slices' spread
        sent = spark.sparkContext.broadcast(_tables(rows))
        own = {length: n for (at, length), n in blocks.items() if at == s}
        part = fanned_out(words, "word").mapInArrow(_probe(sent, s, slices, own), ddl(_FOUND))
        found = part if found is None else found.unionByName(part)
    if found is None:
        return words.select("word", "n", F.col("word").alias("near"), F.col("n").alias("near_n"))
    exact = found.join(words.select(F.col("word").alias("candidate"), F.col("n").alias("candidate_n")), "candidate")
    both = F.array(
        F.struct(F.col("word"), F.col("n"), F.col("candidate").alias("near"), F.col("candidate_n").alias("near_n")),
        F.struct(F.col("candidate").alias("word"), F.col("candidate_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")),
    )
    return exact.select(F.inline(both))


def _roots(forms: DataFrame) -> DataFrame:
    """word, root of the words with a form; ``forms`` holds word and form and is a written table."""
    heads = forms.select(F.col("word").alias("form"), F.col("form").alias("next"))
    step = forms.join(heads, "form", "left").select("word", F.coalesce("next", "form").alias("root"), F.col("next").isNull().alias("done"))
    step = settled(step, "roots")
    # a pointer skips twice as many forms after each round; what has arrived takes no part
    while not step.where(~F.col("done")).isEmpty():
        to = step.select(F.col("word").alias("root"), F.col("root").alias("next"), F.col("done").alias("arrived"))
        open_rows = step.where(~F.col("done")).join(to, "root", "left")
        moved = open_rows.select("word", F.coalesce("next", "root").alias("root"), F.coalesce("arrived", F.lit(True)).alias("done"))
        step = settled(step.where("done").unionByName(moved), "roots")
    return step.select("word", "root")


def group(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, one_in: int = CORRUPT, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of ``docs`` (doc_id, text)."""
    words = settled(vocabulary(docs, least_length, least_count, one_in), "vocabulary")
    best = F.min(F.struct((-F.col("near_n")).alias("least"), "near"))
    near = near_pairs(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("_best"))
    joined = words.join(near, "word", "left")
    top = -F.col("_best.least")
    takes = top >= ratio * F.col("n")
    facts = settled(
        joined.select(
            "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(takes, F.col("_best.near")).alias("form"), F.when(takes, top).alias("form_n")
        ),
        "forms",
    )
    roots = _roots(facts.where(F.col("form").isNotNull()).select("word", "form"))
    out = facts.join(roots, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
