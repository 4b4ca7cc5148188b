"""Token packing: full windows first, then best fit decreasing over open windows.

A document is its token ids and an end id.  Overlong documents are first cut into
full windows; what remains of each is placed, longest first, into the open window
with the least room that still holds it.  The open windows stand in a segment tree
indexed by remaining capacity, so a placement takes log(window) steps.  When a block
of documents is placed, the pieces of windows that stayed open are cut to fill the
others exactly, and the last tokens become sequences whose lengths are powers of
two: no sequence needs padding.

Every task packs its own rows in blocks of at most ``BLOCK_TOKENS`` tokens, with no
shuffle; memory is bounded by the block, and a rerun task gives the same sequences.

Defined cases: a null text is an empty one, its only token is the end id; a null
``doc_id`` is carried; repeated rows are packed each; extra columns are left out.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from operator import add

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from panelkit.llm.arrow import arrow_schema, ddl, slices
from panelkit.llm.memo import Memo

WINDOW = 2048
END_ID = 1
BLOCK_TOKENS = 4_000_000
#: Chunks, and runs of letters, in a generation of a task's tables.
KNOWN_CHUNKS = 200_000

OUT = {
    "doc_id": "long", "start": "long", "length": "long", "ids_crc32": "long", "doc_tokens": "long",
    "sequence_id": "long", "offset": "long",
}


#: Chunks that one letter run and one run of marks make up; their letters are the same in all normal forms.
_SIMPLE = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]*)([!-&(-/:-@\[-`{-~]*)").fullmatch


def _byte_characters() -> dict[int, str]:
    """The characters that stand for bytes in a byte-level vocabulary: printable ones for themselves, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class ChunkTokenizer:
    """Token ids of a text, chunk by chunk.

    The vocabulary's tokenizer never joins across white space, so a text's ids are
    those of its white-space-separated chunks; ids of chunks seen lately are kept.
    Chunks of plain letters and marks are lower-cased and cut here and go to the
    tokenizer's model at once; all others take its whole way, among them chunks with a
    special token's literal, which is that token as the library has it.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        # as a Latin-1 string holds its UTF-8 bytes, so each byte's character can be put in by translate()
        self.characters = _byte_characters()
        self.chunks = Memo(self._chunks, KNOWN_CHUNKS)
        self.runs = Memo(self._runs, KNOWN_CHUNKS)

    def _runs(self, runs: list[str]) -> list[bytes]:
        tokenize, characters = self.model.tokenize, self.characters
        own = (run if run.isascii() else run.encode().decode("latin-1").translate(characters) for run in runs)
        return [array("I", [t.id for t in tokenize(run)]).tobytes() for run in own]

    def _chunks(self, chunks: list[bytes]) -> list[bytes]:
        texts = [c.decode() for c in chunks]
        cut = list(map(_SIMPLE, texts))
        letters = [m[1].lower() for m in cut if m]
        marks = [m[2] for m in cut if m]
        runs = self.runs.values(set(letters).union(marks))
        simple = map(add, map(runs.__getitem__, letters), map(runs.__getitem__, marks))
        others = [t for t, m in zip(texts, cut, strict=True) if not m]
        whole = (array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch(others, add_special_tokens=False))
        return [next(simple if m else whole) for m in cut]

    def __call__(self, texts: list[str | None]) -> list[np.ndarray]:
        cut = [t.encode().split() if t else [] for t in texts]
        known = self.chunks.values(set().union(*cut))
        return [np.frombuffer(b"".join(map(known.__getitem__, own)), np.uint32) for own in cut]


class OpenWindows:
    """Windows with room left, in a segment tree over their remaining capacity."""

    def __init__(self, window: int) -> None:
        self.size = 1 << window.bit_length()
        self.full = [0] * (2 * self.size)  # windows in the subtree
        self.at: list[list[int]] = [[] for _ in range(self.size)]

    def put(self, window: int, room: int) -> None:
        self.at[room].append(window)
        self._count(room, 1)

    def _count(self, room: int, by: int) -> None:
        node = self.size + room
        while node:
            self.full[node] += by
            node >>= 1

    def tightest(self, need: int) -> tuple[int, int] | None:
        """Takes out the window with the least room of ``need`` or more."""
        node = self.size + need
        if not self.full[node]:
            while node > 1 and (node & 1 or not self.full[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.size:
                node = 2 * node if self.full[2 * node] else 2 * node + 1
        room = node - self.size
        self._count(room, -1)
        return self.at[room].pop(), room


def best_fit_decreasing(lengths: np.ndarray, window: int) -> list[list[int]]:
    """Item numbers of each window; items are no longer than ``window``."""
    opened, windows = OpenWindows(window), []
    for item in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[item])
        found = opened.tightest(need)
        if found is None:
            found = len(windows), window
            windows.append([])
        at, room = found
        windows[at].append(item)
        if room > need:
            opened.put(at, room - need)
    return windows


def sequences(lengths: list[int], window: int = WINDOW) -> Iterator[list[tuple[int, int, int]]]:
    """Sequences of (document, start, length) pieces that hold every token once."""
    rest = []
    for doc, n in enumerate(lengths):
        whole = n // window * window
        for start in range(0, whole, window):
            yield [(doc, start, window)]
        if n > whole:
            rest.append((doc, whole, n - whole))
    if not rest:
        return
    placed = best_fit_decreasing(np.array([r[2] for r in rest]), window)
    loads = [sum(rest[i][2] for i in items) for items in placed]
    still = []
    for at in sorted(range(len(placed)), key=lambda at: (-loads[at], at)):
        (still.append(at) if loads[at] < window else None)
    for at, items in enumerate(placed):
        if loads[at] == window:
            yield [rest[i] for i in items]
    # pieces of the emptiest windows, cut to fill the fullest ones
    spare: list[tuple[int, int, int]] = []
    low, high = 0, len(still)
    while low < high:
        pieces, room = [rest[i] for i in placed[still[low]]], window - loads[still[low]]
        while room and (spare or high > low + 1):
            if not spare:
                high -= 1
                spare = [rest[i] for i in placed[still[high]]]
            doc, start, n = spare.pop()
            take = min(n, room)
            pieces.append((doc, start, take))
            room -= take
            if n > take:
                spare.append((doc, start + take, n - take))
        low += 1
        if room:
            spare = pieces
            break
        yield pieces
    # the last tokens: sequences as long as the powers of two of their sum
    left = sum(n for _, _, n in spare)
    spare.reverse()
    while left:
        size = min(window, 1 << (left.bit_length() - 1))
        pieces, room = [], size
        while room:
            doc, start, n = spare.pop()
            take = min(n, room)
            pieces.append((doc, start, take))
            room -= take
            if n > take:
                spare.append((doc, start + take, n - take))
        left -= size
        yield pieces


def pack(docs: DataFrame, vocabulary: str, window: int = WINDOW, end_id: int = END_ID, block: int = BLOCK_TOKENS) -> DataFrame:
    """One row for each piece of a document: its tokens' place in document and sequence.

    ``vocabulary`` is a tokenizer file that every executor can read.
    """
    schema = arrow_schema(OUT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = ChunkTokenizer(vocabulary), np.array([end_id], np.uint32)
        first = TaskContext.get().partitionId() << 33
        made, ids, tokens, held = 0, [], [], 0

        def placed() -> pa.RecordBatch:
            nonlocal made
            rows = []
            for pieces in sequences([len(t) for t in tokens], window):
                offset = 0
                for doc, start, n in pieces:
                    crc = zlib.crc32(tokens[doc][start : start + n].astype("<u4").tobytes())
                    rows.append((ids[doc], start, n, crc, len(tokens[doc]), first + made, offset))
                    offset += n
                made += 1
            return pa.RecordBatch.from_arrays(
                [pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema
            )

        for doc_ids, texts in slices(batches, 1):
            for doc_id, own in zip(doc_ids, encode(texts), strict=True):
                ids.append(doc_id)
                tokens.append(np.concatenate([own, end]))
                held += len(own) + 1
            if held >= block:
                yield placed()
                ids, tokens, held = [], [], 0
        if ids:
            yield placed()

    return docs.select("doc_id", "text").mapInArrow(run, ddl(OUT))
