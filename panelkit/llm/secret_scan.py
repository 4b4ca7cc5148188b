"""Secrets by dictionary-primed compression novelty.

Base kinds (assign, access, hex) have the fixed forms below.  The method adds
``novel``: a whole string in sensitive context (a cue within ``CONTEXT`` characters before or
after it, outside itself) is measured by
the bytes that it adds to a zstandard frame whose dictionary holds common
identifiers and which already holds the surrounding text of both sides and those parts of the
string that other identifiers of the document have.  What can be guessed from
words, names and neighbours adds little; a random secret adds most of its length, with
digits or without.  Fixed bytes without repetitions stand before the string in both
frames, so many that a frame's literals keep their form whatever the string.

A string is a maximal run of its characters, never a part of a longer identifier.  A string
without digits that stands more than once is a name of the document; with digits it is measured all the same.
Strings farther than ``CONTEXT`` from any cue are in no sensitive context and are not measured.

Defined cases: a null text is an empty one; null ids and repeated rows are carried;
spans count code points, end exclusive; extra columns are left out.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter

import zstandard
from pyspark.sql import DataFrame

from panelkit.llm.arrow import map_slices
from panelkit.llm.identifiers import WORDS

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "novel")
_ASSIGN = re.compile(
    r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")  # a maximal run, as greedy matches of [0-9a-f]+ are
_NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
_CUES = ("secret", "token", "passw", "key", "auth", "bearer", "credential", "signature")
_CUE = re.compile("|".join(_CUES), re.IGNORECASE | re.ASCII)
_CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}")
_RUN = re.compile(r"[A-Za-z0-9+/_=-]+")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Characters of context on each side.
CONTEXT = 256
#: Least added bytes for each character (README has the share of random strings and of unseen names that reach it).
#: With so many digits it is hardly a name, and less is asked, since hexadecimal strings add less.
NOVEL, DIGITS, NOVEL_DIGITS = 0.95, 3, 0.75
#: In a string this long a chance match may save so many bytes; a name of that length saves more.
LONG, CHANCE = 28, 3
_PAD = bytes(range(128, 256))
_HEX_BYTES = bytes(120 if chr(b) in "0123456789abcdef" else 32 for b in range(256))
_IDENTIFIERS = (
    "authorization bearer token access_token refresh_token client_id client_secret api_key apikey secret_key "
    "private_key public_key password passwd username user_name signature credential session_id request response "
    "config configuration settings environment variable default value string integer boolean function return "
    "import export public private protected static const class interface package module application service "
    "database connection host port localhost example index identifier reference document version updated created"
)
_DICTIONARY = " ".join([*(case(w) for case in (str.upper, str.title, str) for w in reversed(WORDS)), _IDENTIFIERS]).encode()


class Novelty:
    """Bytes that a string adds to its primed context."""

    def __init__(self) -> None:
        words = zstandard.ZstdCompressionDict(_DICTIONARY, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        words.precompute_compress(level=19)
        self.compress = zstandard.ZstdCompressor(level=19, dict_data=words).compress

    def __call__(self, context: str, candidate: str) -> float:
        """Added bytes for each character."""
        before = context.encode() + _PAD
        added = len(self.compress(before + candidate.encode())) - len(self.compress(before))
        return max(0.0, added / len(candidate))


class _Names:
    """How many different strings of a document hold each part, and how often each string stands."""

    def __init__(self, text: str) -> None:
        self.times = Counter(_RUN.findall(text))
        self.holders = Counter(p for run in self.times for p in {p.lower() for p in _PARTS.findall(run) if len(p) > 2})

    def known(self, candidate: str) -> str:
        """The parts of the candidate that other strings hold, as the candidate spells them."""
        return " ".join(p for p in _PARTS.findall(candidate) if self.holders[p.lower()] > 1)


def novel(text: str, novelty: Novelty) -> list[tuple[int, int, int]]:
    cues = [(m.start(), m.end()) for m in _CUE.finditer(text)]
    if not cues:
        return []
    starts, ends, names, found = [c[0] for c in cues], [c[1] for c in cues], None, []
    for m in _CANDIDATE.finditer(text):
        start, end, own = m.start(), m.end(), m[0]
        if not re.search("[A-Za-z]", own):
            continue
        before = bisect_right(ends, start)  # cues that end before it
        after = bisect_left(starts, end)  # the first cue behind it
        near = before and ends[before - 1] >= start - CONTEXT or after < len(starts) and starts[after] < end + CONTEXT
        if not near:
            continue
        names = names or _Names(text)
        digits = len(re.findall("[0-9]", own))
        if not digits and names.times[own] > 1:
            continue
        context = " ".join((names.known(own), text[end : end + CONTEXT], text[max(0, start - CONTEXT) : start])).replace(own, " ")
        least = NOVEL_DIGITS if digits >= DIGITS else NOVEL if len(own) < LONG else 1 - CHANCE / len(own)
        if novelty(context, own) >= least:
            found.append((start, 3, end))
    return found


def spans(text: str, novelty: Novelty) -> list[tuple[int, int, int]]:
    """(start, kind number, end), sorted."""
    found = []
    low = text.lower()  # a superset test only: the patterns decide
    if any(n in low for n in _NAMES):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if b"x" * 24 in text.encode().translate(_HEX_BYTES):
        found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    if any(c in low for c in _CUES):
        found += novel(text, novelty)
    return sorted(found)


def listed(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in found)


def find(docs: DataFrame) -> DataFrame:
    """doc_id, a count for each base kind, base_spans and spans (kind:start:end, comma-joined)."""
    made: list[Novelty] = []

    def work(doc_ids: list, texts: list) -> list:
        if not made:
            made.append(Novelty())
        rows = []
        for doc_id, text in zip(doc_ids, texts, strict=True):
            own = spans(text or "", made[0])
            base = [s for s in own if s[1] < len(BASE)]
            rows.append((doc_id, *(sum(s[1] == k for s in base) for k in range(len(BASE))), listed(base), listed(own)))
        return list(zip(*rows, strict=True))

    out = {"doc_id": "long"} | {f"n_{k}": "long" for k in BASE} | {"base_spans": "string", "spans": "string"}
    return map_slices(docs.select("doc_id", "text"), "text", out, work)
