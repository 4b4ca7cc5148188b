"""Byte-level BPE encoding and decoding with a two-tier lookup.

A text is cut into pre-tokens.  First tier: a minimal perfect hash over the
vocabulary resolves, for many pre-tokens at once, those that are tokens
themselves.  Second tier: the others are merged lowest rank first, leftmost first
among equals, with a heap over a linked list of byte runs.

Defined cases: a null text is encoded as an empty one; ids come as little-endian
unsigned 32-bit integers in one binary value, so a document of any length is one
value; repeated rows and null ``doc_id`` are carried; extra columns are left out.
"""

from __future__ import annotations

import base64
from array import array
from heapq import heapify, heappop, heappush

import numpy as np
import regex
from pyspark.sql import DataFrame

from panelkit.llm.arrow import map_slices
from panelkit.llm.memo import Memo
from panelkit.llm.words import U, bytes_hashes, mixed

#: Pre-tokens in a generation of a task's table.
KNOWN_PIECES = 250_000
_SEED = U(0xA24BAED4963EE407)


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file in the order of their ids, which are 0, 1, 2 and so on."""
    with open(path, "rb") as f:
        pairs = sorted((int(rank), base64.b64decode(token)) for token, rank in map(bytes.split, f))
    if [r for r, _ in pairs] != list(range(len(pairs))):
        raise ValueError("ranks must be 0, 1, 2 and so on")
    return [t for _, t in pairs]


class PerfectHash:
    """A minimal perfect hash of byte strings: n keys, n slots, by hash and displace.

    Keys fall into buckets of four on average.  Large buckets first, each gets the
    first displacement that sends its keys to free slots; a bucket of one key stores
    its slot itself, as a negative number.
    """

    def __init__(self, keys: list[bytes]) -> None:
        self.n = n = len(keys)
        hashes = bytes_hashes(keys)
        if len(np.unique(hashes)) < n:
            raise ValueError("keys must differ")
        self.buckets = max(1, n // 4)
        bucket = (hashes % U(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        ends = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        self.shift = np.zeros(self.buckets, np.int64)
        self.key = np.zeros(n, np.int64)
        taken = np.zeros(n, bool)
        single = []
        for b in np.argsort(-np.diff(ends), kind="stable").tolist():
            own = order[ends[b] : ends[b + 1]]
            if len(own) == 1:
                single.append((b, own[0]))
            if len(own) < 2:
                continue
            tried = 0
            while True:
                slots = self._slots(hashes[own][None, :], np.arange(tried, tried + 256)[:, None])
                free = ~taken[slots].any(axis=1)
                for row in np.flatnonzero(free):
                    if len(set(slots[row].tolist())) == len(own):
                        self.shift[b] = tried + row
                        taken[slots[row]] = True
                        self.key[slots[row]] = own
                        break
                else:
                    tried += 256
                    continue
                break
        for (b, own), slot in zip(single, np.flatnonzero(~taken), strict=True):
            self.shift[b] = -1 - slot
            self.key[slot] = own

    def _slots(self, hashes: np.ndarray, shift: np.ndarray) -> np.ndarray:
        return (mixed(hashes + (shift.astype(U) + U(1)) * _SEED) % U(self.n)).astype(np.int64)

    def lookup(self, pieces: list[bytes]) -> np.ndarray:
        """The only key number that each piece can have; the caller compares the bytes."""
        hashes = bytes_hashes(pieces)
        shift = self.shift[(hashes % U(self.buckets)).astype(np.int64)]
        return self.key[np.where(shift < 0, -1 - shift, self._slots(hashes, np.maximum(shift, 0)))]


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of a pre-token that is no token itself."""
    n = len(piece)
    after, before = list(range(1, n + 1)), list(range(-1, n))  # of the run that starts here; 0: merged away
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapify(heap)
    while heap:
        _, i, end = heappop(heap)
        middle = after[i]
        if not middle or middle == n or after[middle] != end:
            continue  # one of the two runs has grown meanwhile
        after[i], after[middle] = end, 0
        if end < n:
            before[end] = i
            if (r := ranks.get(piece[i : after[end]])) is not None:
                heappush(heap, (r, i, after[end]))
        left = before[i]
        if left >= 0 and (r := ranks.get(piece[left:end])) is not None:
            heappush(heap, (r, left, end))
    out, at = [], 0
    while at < n:
        out.append(ranks[piece[at : after[at]]])
        at = after[at]
    return out


class Encoder:
    """Encodes texts; remembers the ids of a bounded number of pre-tokens."""

    def __init__(self, tokens: list[bytes], table: PerfectHash, pattern: str) -> None:
        self.tokens, self.table = tokens, table
        self.cut = regex.compile(pattern).findall
        self.ranks = {t: i for i, t in enumerate(tokens)}
        self.known = Memo(self._ids, KNOWN_PIECES)

    def _ids(self, pieces: list[str]) -> list[bytes]:
        raw = [p.encode() for p in pieces]
        found = zip(raw, self.table.lookup(raw).tolist(), strict=True)
        return [array("I", [i] if self.tokens[i] == own else merge(own, self.ranks)).tobytes() for own, i in found]

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        cut = [self.cut(t) if t else [] for t in texts]
        known = self.known.values(set().union(*cut))
        return [b"".join(map(known.__getitem__, pieces)) for pieces in cut]


def encode(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens and ids (binary, see above) of every text."""
    tokens = read_ranks(vocabulary)
    shared = docs.sparkSession.sparkContext.broadcast((tokens, PerfectHash(tokens)))  # as large as the vocabulary
    made: list[Encoder] = []

    def work(doc_ids: list, texts: list) -> list:
        if not made:
            made.append(Encoder(*shared.value, pattern))
        ids = made[0](texts)
        return [doc_ids, [len(x) // 4 for x in ids], ids]

    out = {"doc_id": "long", "n_tokens": "long", "ids": "binary"}
    return map_slices(docs.select("doc_id", "text"), "text", out, work)


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """``encode``'s rows with ``decoded``, the bytes that the ids stand for; null ids give null."""
    shared = encoded.sparkSession.sparkContext.broadcast(read_ranks(vocabulary))

    def work(doc_ids: list, n_tokens: list, ids: list) -> list:
        token = shared.value.__getitem__
        texts = [None if x is None else b"".join(map(token, np.frombuffer(x, "<u4").tolist())) for x in ids]
        return [doc_ids, n_tokens, ids, texts]

    out = {"doc_id": "long", "n_tokens": "long", "ids": "binary", "decoded": "binary"}
    return map_slices(encoded.select("doc_id", "n_tokens", "ids"), "ids", out, work)
