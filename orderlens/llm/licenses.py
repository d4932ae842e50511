"""License scan by patience alignment.

Words that occur once in a stretch of the text and once in a stretch of a
template are anchors; the longest run of anchors in the same order in both
(longest increasing subsequence) is kept and the gaps between its members are
aligned in the same way.  The coverage of a template is the share of its words
that are aligned.

The alignment decides whether a notice is reported, where it stands and how
much of it is there.  A text is read once; where the last ``reach`` times the
template's length of words hold enough of its words, whatever their order, the
stretches that end there are aligned, the shortest first.  The first one that
covers enough of the template is a notice; it grows while the alignment gains
more words than it passes over, and the scan goes on right behind it.  So a
stretch holds one copy, its words are anchors, and a notice that a text repeats,
edited or not, is found each time.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlens.llm.common import ship_package

#: Public license notices.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "All-Rights-Reserved": "All rights reserved.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
                "associated documentation files (the \"Software\"), to deal in the Software without restriction, "
                "including without limitation the rights to use, copy, modify, merge, publish, distribute, "
                "sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is "
                "furnished to do so, subject to the following conditions:",
    "MIT-full": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
                "associated documentation files (the \"Software\"), to deal in the Software without restriction, "
                "including without limitation the rights to use, copy, modify, merge, publish, distribute, "
                "sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is "
                "furnished to do so, subject to the following conditions: The above copyright notice and this "
                "permission notice shall be included in all copies or substantial portions of the Software. THE "
                "SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT "
                "LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
                "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
                "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN "
                "CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "ISC-full": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without "
                "fee is hereby granted, provided that the above copyright notice and this permission notice appear "
                "in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD "
                "TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL "
                "THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES "
                "WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, "
                "NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF "
                "THIS SOFTWARE.",
    "ISC-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without "
                "fee is hereby granted, provided that the above copyright notice and this permission notice appear "
                "in all copies.",
    "BSD-text": "Redistribution and use in source and binary forms, with or without modification, are permitted "
                "provided that the following conditions are met:",
    "Apache-2.0-text": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file "
                       "except in compliance with the License. You may obtain a copy of the License at",
    "GPL-text": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
                "General Public License as published by the Free Software Foundation, either version 3 of the "
                "License, or (at your option) any later version.",
}
#: Least share of a template's words that must be aligned.
COVERAGE = 0.8
#: Words of the text that an alignment may span, as a multiple of the template's (a parameter of the table).
REACH = 2

_WORD = re.compile(r"\w+(?:[.-]\w+)*")


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def align(a: list[str], b: list[str], i0: int, i1: int, j0: int, j1: int) -> list[tuple[int, int]]:
    """Aligned positions of ``a[i0:i1]`` and ``b[j0:j1]``, in order."""
    pairs: list[tuple[int, int]] = []
    while i0 < i1 and j0 < j1 and a[i0] == b[j0]:  # equal ends need no anchor
        pairs.append((i0, j0))
        i0, j0 = i0 + 1, j0 + 1
    tail: list[tuple[int, int]] = []
    while i0 < i1 and j0 < j1 and a[i1 - 1] == b[j1 - 1]:
        i1, j1 = i1 - 1, j1 - 1
        tail.append((i1, j1))
    in_a, in_b = Counter(a[i0:i1]), Counter(b[j0:j1])
    where = {w: j for j, w in zip(range(j0, j1), b[j0:j1]) if in_b[w] == 1}
    anchors = [(i, where[w]) for i, w in zip(range(i0, i1), a[i0:i1]) if in_a[w] == 1 and w in where]
    if anchors:
        chain = increasing(anchors)
        for (i, j), (i_next, j_next) in zip([(i0 - 1, j0 - 1), *chain], [*chain, (i1, j1)]):
            pairs += align(a, b, i + 1, i_next, j + 1, j_next)
            if i_next < i1:
                pairs.append((i_next, j_next))
    return pairs + tail[::-1]


def increasing(anchors: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest part of ``anchors`` (ordered by text position) that also
    rises in the template: patience piles, read back from the last."""
    tops: list[int] = []
    at: list[int] = []
    before: list[int] = []
    for k, (_, j) in enumerate(anchors):
        pile = bisect_left(tops, j)
        before.append(at[pile - 1] if pile else -1)
        if pile == len(tops):
            tops.append(j)
            at.append(k)
        else:
            tops[pile], at[pile] = j, k
    chain, k = [], at[-1]
    while k >= 0:
        chain.append(anchors[k])
        k = before[k]
    return chain[::-1]


def candidates(own: list[str], spots: list[int], counts: Counter, need: int, reach: int) -> Iterator[tuple[int, int]]:
    """Places in ``spots`` where a notice may end, each with the place of the first spot it can hold: the
    spots between have ``need`` words of the template, each as often as the template at most."""
    lo, common, held = 0, 0, Counter()
    for hi, i in enumerate(spots):
        held[own[i]] += 1
        common += held[own[i]] <= counts[own[i]]
        while spots[lo] <= i - reach:
            common -= held[own[spots[lo]]] <= counts[own[spots[lo]]]
            held[own[spots[lo]]] -= 1
            lo += 1
        if common >= need:
            yield lo, hi


def covered(own: list[str], t: list[str], first: int, last: int) -> int:
    """Words of the template that patience aligns with the text's words from ``first`` to ``last``."""
    return len(align(own, t, first, last + 1, 0, len(t)))


def tightest(own: list[str], t: list[str], spots: list[int], counts: Counter, lo: int, hi: int, need: int) -> int | None:
    """The last of the spots ``lo`` to ``hi`` from which the stretch up to spot ``hi`` covers enough of the template."""
    held, common = Counter(), 0
    for k in range(hi, lo - 1, -1):
        word = own[spots[k]]
        held[word] += 1
        common += held[word] <= counts[word]
        # only with enough common words, and as the stretch begins with one that can be aligned
        if common >= need and covered(own, t, spots[k], spots[hi]) >= need:
            return k
    return None


def grown(own: list[str], t: list[str], spots: list[int], first: int, hit: int, reach: int) -> int:
    """The spot, ``hit`` or later, up to which the stretch from spot ``first`` has most aligned words for its length."""
    best = (2 * covered(own, t, spots[first], spots[hit]) - (spots[hit] - spots[first]), hit)
    for k in range(hit + 1, bisect_left(spots, spots[first] + reach)):
        length = spots[k] - spots[first]
        if 2 * len(t) - length <= best[0]:  # no longer stretch can gain
            break
        gain = 2 * covered(own, t, spots[first], spots[k]) - length
        if gain > best[0]:
            best = (gain, k)
    return best[1]


def scan(text: str, templates: dict[str, list[str]], coverage: float = COVERAGE,
         reach: int = REACH) -> list[tuple[str, int, int, int, float]]:
    """(name, first word, last word, aligned words, coverage) of every notice in a text."""
    found = []
    own = words(text)
    index: dict[str, list[int]] = {}
    vocabulary = {w for t in templates.values() for w in t}
    for i, w in enumerate(own):
        if w in vocabulary:
            index.setdefault(w, []).append(i)
    for name, t in templates.items():
        need = max(1, int(-(-len(t) * coverage // 1)))
        counts = Counter(t)
        if sum(min(n, len(index.get(w, ()))) for w, n in counts.items()) < need:
            continue
        spots = sorted(i for w in counts for i in index.get(w, ()))
        span, free = reach * len(t), 0
        for lo, hi in candidates(own, spots, counts, need, span):
            if hi < free:  # inside the last notice
                continue
            first = tightest(own, t, spots, counts, max(lo, free), hi, need)
            if first is None:
                continue
            last = grown(own, t, spots, first, hi, span)
            aligned = covered(own, t, spots[first], spots[last])
            found.append((name, spots[first], spots[last], aligned, aligned / len(t)))
            free = last + 1
    return found


def license_table(docs: DataFrame, templates: dict[str, str] = TEMPLATES, coverage: float = COVERAGE,
                  reach: int = REACH) -> DataFrame:
    """One row per notice found: doc_id, license, first_word, last_word
    (positions from 0), aligned (words) and coverage.

    A null or empty text has none; rows that repeat an id are scanned each;
    a notice of two templates is reported for both.  A notice with more than
    ``reach`` times its template's words, other words among them, is not found;
    an empty table gives an empty result and other columns are not read.
    """
    ship_package(docs.sparkSession)
    split = {name: words(t) for name, t in templates.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                out += [(doc, *hit) for hit in scan(text.as_py() or "", split, coverage, reach)]
            columns = list(zip(*out)) if out else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)

    names = ["doc_id", "license", "first_word", "last_word", "aligned", "coverage"]
    kinds = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.float64()]
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, license string, first_word int, last_word int, aligned int, coverage double")
