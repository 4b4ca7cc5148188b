"""Personal data by anchor expansion.

One pass of an Aho-Corasick automaton over a text finds anchors: at-signs, plus
signs, digits, ``://`` and identifier cues.  A local parser at each anchor grows the
span to its exact boundaries and validates it.  Base kinds (email, ip, card, phone)
have the fixed forms below; the anchors add ``userinfo`` (credentials before the
host of an address), ``iban`` and ``ssn`` after their cues.

Defined cases: a null text is an empty one; null ids and repeated rows are carried;
spans count code points, end exclusive; extra columns are left out by ``find`` and
kept by ``redact``.
"""

from __future__ import annotations

import re

import ahocorasick
from pyspark.sql import DataFrame

from panelkit.llm.arrow import map_slices

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "userinfo", "iban", "ssn")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGITS = re.compile(r"[0-9]+")
_IP = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_SCHEME = re.compile(r"[A-Za-z][A-Za-z0-9+.-]{0,31}\Z")
_USERINFO = re.compile(r"[A-Za-z0-9._~%!$&'()*+,;=:-]+(?=@)")
_IBAN = re.compile(r"[^A-Za-z0-9\n]{1,4}([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30})(?![A-Za-z0-9])")
_SSN = re.compile(r"[^A-Za-z0-9\n]{1,4}([0-9]{3}-[0-9]{2}-[0-9]{4})(?![0-9-])")
_CUES = {"iban": ("iban", "IBAN", "Iban"), "ssn": ("ssn", "SSN", "social security number", "Social Security Number")}


def anchors() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for c in "0123456789":
        found.add_word(c, ("digit", 1))
    for word, kind in (("@", "at"), ("+", "plus"), ("://", "scheme")):
        found.add_word(word, (kind, len(word)))
    for kind, words in _CUES.items():
        for word in words:
            found.add_word(word, (kind, len(word)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _iban(code: str) -> bool:
    code = code.replace(" ", "")
    return 15 <= len(code) <= 34 and int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def spans(text: str, automaton: ahocorasick.Automaton) -> list[tuple[int, int, int]]:
    """(kind number, start, end), sorted: by kind, then by place."""
    found = []
    email_end = ip_end = card_end = phone_end = 0  # where the last match of the kind ended, kept or not
    for last, (what, size) in automaton.iter(text):
        if what == "digit":
            if last >= card_end and (m := _CARD.match(text, last)):
                card_end = m.end()
                digits = m[0].replace(" ", "").replace("-", "")
                if 13 <= len(digits) <= 19 and luhn(digits):
                    found.append((2, last, card_end))
            if last >= ip_end:
                if m := _IP.match(text, last):
                    ip_end = m.end()
                    if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                        found.append((1, last, ip_end))
                else:  # nor does a match start further on in these digits
                    ip_end = _DIGITS.match(text, last).end()
        elif what == "at":
            start = last
            while start > email_end and text[start - 1] in _LOCAL:
                start -= 1
            if start < last and (m := _DOMAIN.match(text, last + 1)):
                email_end = m.end()
                found.append((0, start, email_end))
        elif what == "plus":
            if last >= phone_end and (m := _PHONE.match(text, last)):
                phone_end = m.end()
                if 9 <= sum(c in "0123456789" for c in m[0]) <= 15:
                    found.append((3, last, phone_end))
        elif what == "scheme":
            if _SCHEME.search(text, max(0, last - 34), last - 2) and (m := _USERINFO.match(text, last + 1)):
                found.append((4, m.start(), m.end()))
        elif last - size < 0 or not text[last - size].isalnum():
            m = (_IBAN if what == "iban" else _SSN).match(text, last + 1)
            if m and (what == "ssn" or _iban(m[1])):
                found.append((KINDS.index(what), m.start(1), m.end(1)))
    return sorted(found)


def listed(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in found)


def find(docs: DataFrame) -> DataFrame:
    """doc_id, a count for each base kind, base_spans and spans (kind:start:end, comma-joined)."""
    made: list = []

    def work(doc_ids: list, texts: list) -> list:
        if not made:
            made.append(anchors())
        rows = []
        for doc_id, text in zip(doc_ids, texts, strict=True):
            own = spans(text or "", made[0])
            base = [s for s in own if s[0] < len(BASE)]
            rows.append((doc_id, *(sum(s[0] == k for s in base) for k in range(len(BASE))), listed(base), listed(own)))
        return list(zip(*rows, strict=True))

    out = {"doc_id": "long"} | {f"n_{k}": "long" for k in BASE} | {"base_spans": "string", "spans": "string"}
    return map_slices(docs.select("doc_id", "text"), "text", out, work)


def redacted(text: str, found: list[tuple[int, int, int]]) -> str:
    """``text`` with each span, or each run of overlapping spans, replaced by ``[KIND]`` of its first."""
    out, at = [], 0
    for start, end, kind in sorted((a, b, k) for k, a, b in found):
        if start >= at:
            out += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with all columns; personal data in ``text`` replaced, ``n_chars`` (if any) counted anew."""
    import pyarrow as pa

    counted = "n_chars" in docs.columns

    def run(batches):
        automaton = anchors()
        for batch in batches:
            old = batch.column("text").to_pylist()
            new = [t and redacted(t, spans(t, automaton)) for t in old]
            batch = batch.set_column(batch.schema.get_field_index("text"), batch.schema.field("text"), pa.array(new, batch.schema.field("text").type))
            if counted:
                at = batch.schema.get_field_index("n_chars")
                had = batch.column("n_chars").to_pylist()
                sizes = [h if a == b else len(b) for h, a, b in zip(had, old, new, strict=True)]
                batch = batch.set_column(at, batch.schema.field(at), pa.array(sizes, batch.schema.field(at).type))
            yield batch

    return docs.mapInArrow(run, docs.schema)
