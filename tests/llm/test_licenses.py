"""Notices that stand close by, edited, against a brute force."""

from __future__ import annotations

import random

from orderlens.llm import licenses


def common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


def patience(a, b):
    return len(licenses.align(a, b, 0, len(a), 0, len(b)))


def notices(own, t, common):
    """The stretch that reaches the coverage first, from its latest start, grown while it gains; then again
    behind it; ``common`` counts the words of a stretch that align with the template."""
    need, reach, free, out = -(-len(t) * licenses.COVERAGE // 1), licenses.REACH * len(t), 0, []
    end = 0
    while end < len(own):
        first = next((s for s in range(end, max(free, end - reach + 1) - 1, -1) if common(own[s:end + 1], t) >= need), None)
        if first is None:
            end += 1
            continue
        last = max(range(end, min(first + reach, len(own))),
                   key=lambda e: (2 * common(own[first:e + 1], t) - (e - first), -e))
        out.append((first, last))
        free = end = last + 1
    return out


def test_adjacent_edited_notices_are_one_row_each(docs):
    mit = licenses.TEMPLATES["MIT-text"].replace("free of charge", "gratis")
    size = len(licenses.words(mit))
    rows = [(1, "Released under an MIT License.\n" * 2, None, None), (2, f"{mit}\n" * 3, None, None),
            (3, f"{mit}\n" * 2 + licenses.TEMPLATES["MIT-text"], None, None)]
    got = licenses.license_table(docs(rows)).collect()
    spans = {i: sorted((r.first_word, r.last_word) for r in got if r.doc_id == i and r.license in ("MIT", "MIT-text"))
             for i in (1, 2, 3)}
    assert spans[1] == [(0, 4), (5, 9)]
    assert spans[2] == [(k * size, (k + 1) * size - 1) for k in range(3)]
    assert spans[3] == [(0, size - 1), (size, 2 * size - 1), (2 * size, 3 * size + 1)]


def test_repeated_edited_notices_against_brute_force(docs):
    rnd = random.Random(16)
    split = {name: licenses.words(t) for name, t in licenses.TEMPLATES.items() if len(licenses.words(t)) < 40}
    rows = []
    for i in range(60):
        text = []
        for _ in range(rnd.randint(1, 4)):
            copy = list(rnd.choice(list(split.values())))
            for _ in range(rnd.randint(0, 3)):
                at = rnd.randrange(len(copy) + 1)
                copy[at:at + rnd.randint(0, 1)] = rnd.choice([[], ["other"], ["the"], ["license"]])
            text += copy + ["gap"] * rnd.choice([0, 0, 1, 9])
        rows.append((i, " ".join(text), None, None))
    got = licenses.license_table(docs(rows)).collect()
    found = {(r.doc_id, r.license, r.first_word, r.last_word) for r in got if r.license in split}

    def all_stretches(measure):
        return {(i, name, *span) for i, text, *_ in rows for name, t in split.items() for span in notices(licenses.words(text), t, measure)}

    want = all_stretches(patience)
    assert found == want and len(want) > 100
    # patience needs words that are unique in a stretch; of what any alignment would find it misses little
    most = all_stretches(common)
    assert len(most - found) <= 0.03 * len(most)


def test_the_alignment_decides(monkeypatch):
    text = " ".join(licenses.TEMPLATES.values())
    split = {name: licenses.words(t) for name, t in licenses.TEMPLATES.items()}
    assert {hit[0] for hit in licenses.scan(text, split)} == set(split)
    monkeypatch.setattr(licenses, "align", lambda *a: [])
    assert licenses.scan(text, split) == []


def test_reach_is_a_parameter(docs):
    words = licenses.words(licenses.TEMPLATES["ISC-text"])
    spread = " ".join(f"{w} x{i} y{i}" for i, w in enumerate(words))
    rows = [(1, spread, None, None)]
    assert licenses.license_table(docs(rows)).where("license = 'ISC-text'").count() == 0
    assert licenses.license_table(docs(rows), reach=4).where("license = 'ISC-text'").count() == 1
    assert licenses.license_table(docs([])).count() == 0


def test_full_texts_are_found_once_with_their_notice(docs):
    got = licenses.license_table(docs([(1, licenses.TEMPLATES["MIT-full"] + "\n" + licenses.TEMPLATES["ISC-full"], None, None)])).collect()
    assert sorted(r.license for r in got) == ["ISC-full", "ISC-text", "MIT-full", "MIT-text"]
    assert all(r.coverage == 1.0 for r in got)
