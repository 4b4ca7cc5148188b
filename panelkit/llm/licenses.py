"""License notices by an exact set-similarity join of text blocks and templates.

A template is found in a block when the block holds at least ``CONTAINED`` of the
template's distinct words.  Words are ordered by their document frequency in the
whole corpus, rare ones first.  Prefix filter: a block that holds none of the
``|T| - need + 1`` rarest words of a template can't reach it.  Length filter: nor
can a block of fewer than ``need`` distinct words.  Positional filter: at the i-th
word of T's order, what has been found plus all that is left must still reach
``need``.  All three are exact, so every block above the threshold is found.

Blocks are windows of twice the longest template's words (of its size class), one
template length apart, so each run of a template's length lies within one.

Defined cases: a null text is an empty one; null ids and repeated rows are carried;
an empty table gives no rows; extra columns are left out.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelkit.llm.arrow import map_slices

CONTAINED = 0.8
#: Fixed phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Fixed texts of public license notices and their labels.
TEMPLATES = (
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("apache", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at'),
    ("mit", "Released under the MIT License."),
    ("mit", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction'),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.'),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("agpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("bsl", "Boost Software License - Version 1.0 - August 17th, 2003"),
    ("cc0", "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty."),
    ("epl", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)
#: Bytes that belong to words, with A-Z in lower case; all others separate.
_WORDS = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(_WORDS).split() if text else []


def base_places(words: list[bytes]) -> list[tuple[int, str]]:
    """(word number, label) of each place where a phrase's words stand in a row."""
    joined, found = b" " + b" ".join(words) + b" ", []
    for phrase, label in PHRASES.items():
        sought, at, counted, number = f" {phrase} ".encode(), 0, 0, 0
        while (at := joined.find(sought, at)) >= 0:
            number += joined.count(b" ", counted, at)  # goes on from the last place
            found.append((number, label))
            counted = at
            at += 1
    return sorted(found)


class Index:
    """Templates under one global order of words, with an inverted index of their prefixes."""

    def __init__(self, templates=TEMPLATES, frequency: dict[bytes, int] | None = None, contained: float = CONTAINED) -> None:
        count = frequency or {}
        self.templates = []
        for label, text in templates:
            own = sorted(set(words_of(text)), key=lambda w: (count.get(w, 0), w))
            self.templates.append((label, own, max(1, math.ceil(contained * len(own) - 1e-9)), len(words_of(text))))
        self.by_word: dict[bytes, list[int]] = {}
        for t, (_, own, need, _) in enumerate(self.templates):
            for w in own[: len(own) - need + 1]:
                self.by_word.setdefault(w, []).append(t)
        self.prefix = frozenset(self.by_word)

    def search(self, words: list[bytes]) -> tuple[set[str], float]:
        """Labels found in any block, and the highest containment among them."""
        labels, best = set(), 0.0
        if self.prefix.isdisjoint(words):
            return labels, best
        blocks: dict[tuple[int, int], None] = {}
        for i, w in enumerate(words):
            for t in self.by_word.get(w, ()):
                step = max(8, self.templates[t][3])
                for block in {i // step, max(0, i // step - 1)}:  # the two blocks that hold the place
                    blocks[t, block] = None
        for t, block in blocks:
            label, own, need, n = self.templates[t]
            step = max(8, n)
            have = set(words[block * step : (block + 2) * step])
            if len(have) < need:
                continue
            hits = 0
            for i, w in enumerate(own):
                hits += w in have
                if hits + len(own) - i - 1 < need:
                    break
            if hits >= need:
                labels.add(label)
                best = max(best, hits / len(own))
        return labels, best


def frequencies(docs: DataFrame, templates=TEMPLATES) -> dict[bytes, int]:
    """Document frequency, over all rows, of the words that the templates hold (a fixed, small set)."""
    vocabulary = frozenset(w for _, text in templates for w in words_of(text))

    def work(texts: list) -> list:
        counts: dict[bytes, int] = {}
        for text in texts:
            for w in vocabulary.intersection(words_of(text)):
                counts[w] = counts.get(w, 0) + 1
        return [list(counts), list(counts.values())]

    counted = map_slices(docs.select("text"), "text", {"word": "binary", "n": "long"}, work)
    return {bytes(r["word"]): r["n"] for r in counted.groupBy("word").agg(F.sum("n").alias("n")).collect()}


def scan(docs: DataFrame, templates=TEMPLATES, contained: float = CONTAINED) -> DataFrame:
    """doc_id, n_words, places of base phrases, base labels, all labels and the score.

    The score is the highest containment among the notices found; a phrase counts 1.
    """
    index = Index(templates, frequencies(docs, templates), contained)

    def work(doc_ids: list, texts: list) -> list:
        rows = []
        for doc_id, text in zip(doc_ids, texts, strict=True):
            words = words_of(text)
            base = base_places(words)
            labels, score = index.search(words)
            own = {label for _, label in base}
            first, last = (base[0][0], base[-1][0]) if base else (None, None)
            rows.append((
                doc_id, len(words), len(base), first, last, ",".join(sorted(own)), ",".join(sorted(own | labels)),
                1.0 if base else score,
            ))
        return list(zip(*rows, strict=True))

    out = {
        "doc_id": "long", "n_words": "long", "n_base": "long", "first_word": "long", "last_word": "long",
        "base_labels": "string", "labels": "string", "score": "double",
    }
    return map_slices(docs.select("doc_id", "text"), "text", out, work)
