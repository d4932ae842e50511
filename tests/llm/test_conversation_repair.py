"""Conversation repair against a search of all edits, and its edge cases."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from functools import lru_cache

import numpy as np
import pytest

from orderlens.llm import conversation_repair as cr

WHITE = " \t\n\x0b\x0c\r"
SCHEMA = "conv_id long, turn long, role string, text string, place string, letters int"


def hurt(rows):
    out = []
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        code = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if code == 1:
            text = ""
        elif code == 2:
            text = re.sub("[.!?]", "", text)
        elif code == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if code == 0 else 2 if code == 3 else 1)
    return out


def cheapest(rows):
    """rows (role, text, fault): (cost, letters, repaired rows), the least of all by cost and letters."""
    nexts = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
    given = {0: ("user", 2), 1: ("user", 2), 2: ("assistant", 3), 3: ("user", 2)}

    @lru_cache(None)
    def best(p, q, inserted):
        ways = []
        if p == len(rows):
            if q in (0, 3):
                ways.append((0, "", ()))
        else:
            role, text, fault = rows[p]
            more = 3 if fault == "truncated" else 0
            c, a, r = best(p + 1, q, 0)
            ways.append((c + 4, "D" + a, r))
            if fault not in ("blank", "duplicate"):
                if role[:1] in nexts[q]:
                    c, a, r = best(p + 1, nexts[q][role[:1]], 0)
                    ways.append((c + more, "K" + a, ((role, text), *r)))
                name, to = given[q]
                c, a, r = best(p + 1, to, 0)
                ways.append((c + 3 + more, "R" + a, ((name, text), *r)))
        if inserted < 3:
            name, to = given[q]
            c, a, r = best(p, to, inserted + 1)
            ways.append((c + 3, "I" + a, ((name, ""), *r)))
        return min(ways) if ways else (10 ** 9, "", ())

    return best(0, 0, 0)


def brute(rows):
    ids = {r[0] for r in rows}
    after = hurt(rows)
    out = []
    for conv in ids:
        mine = sorted((r for r in after if r[0] == conv),
                      key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).hexdigest()))
        seen, faults = set(), []
        for _, _, role, text in mine:
            bare = text.rstrip(WHITE)
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None)
            seen.add((role, text))
        turns = {r[1] for r in mine if r[1] is not None}
        initials = [r[2][:1] for r in mine]
        cost, audit, repaired = cheapest(tuple((r[2], r[3], f) for r, f in zip(mine, faults)))
        out.append((str(conv), max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults.count("blank"), faults.count("duplicate"),
                    faults.count("truncated"), sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit,
                    hashlib.sha256("\n".join(f"{r}:{t}" for r, t in repaired).encode()).hexdigest()))
    return sorted(out)


def got(df):
    return sorted((str(r.conv_id), r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in df.collect())


def make(seed, conversations=60, longest=14):
    rnd = random.Random(seed)
    rows = []
    for conv in range(conversations):
        for turn in range(rnd.randint(1, longest)):
            rows.append((conv, turn + (turn > 3) * rnd.randint(0, 2), rnd.choice(["user", "assistant", "assistant", "user", "system", "tool", "u", "", None]),
                         rnd.choice(["Yes.", "No!", "cut of", " ", "", "Why? \n", None, "größe.", f"Turn {turn}."])))
    rows += [(None, None, "user", "a."), (None, None, "assistant", "b."), (None, 2, "user", "a."), *[(900, 1, "user", "same.")] * 5]
    return rows


@pytest.mark.parametrize("bits", [cr.SEGMENT_BITS, 1, 0])
def test_repair_equals_a_search_of_all_edits(spark, bits):
    rows = make(1)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(3)
    assert got(cr.damage_and_repair(df, bits)) == brute(rows)


def test_a_long_conversation_in_many_segments(spark):
    rnd = random.Random(8)
    rows = [(5, i, rnd.choice(["user", "assistant", "system"]), rnd.choice([f"{i}.", "again.", "cut"])) for i in range(700)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(3)
    whole = got(cr.damage_and_repair(df))
    assert whole == got(cr.damage_and_repair(df, 3)) and whole[0][6] > 0 and len(whole[0][7]) >= 600


def test_blocks_give_the_cheapest_first_letters():
    rnd = random.Random(3)
    names = ["sua"[i] if i < 3 else "x" for i in range(4)]
    for _ in range(400):
        classes = np.array([rnd.randrange(12) for _ in range(rnd.randint(0, 11))], dtype=np.uint8)
        rows = tuple((names[c % 4], str(i), [None, "truncated", "blank"][c // 4]) for i, c in enumerate(classes))
        letters, state, cost = cr.read(classes, 0, 0)
        close = cr.ending(state)
        assert (cost + 3 * len(close), letters + close) == cheapest(rows)[:2]


def test_tables_follow_single_symbols():
    t = cr.tables()
    assert len(t.vectors) < 200 and len(t.block) == cr.SYMBOLS ** cr.BLOCK
    rnd = random.Random(1)
    for _ in range(200):
        symbols, v = [rnd.randrange(cr.SYMBOLS) for _ in range(cr.BLOCK)], rnd.randrange(len(t.vectors))
        costs = t.vectors[v]
        for s in reversed(symbols):
            costs = cr.before(s, costs)
        code = int("".join(map(str, symbols)), cr.SYMBOLS)
        assert cr.normalised(costs) == (t.vectors[t.block[code, v]], t.rise[code, v])


def test_the_map_of_a_segment_follows_its_blocks():
    rnd = random.Random(6)
    classes = np.array([rnd.randrange(12) for _ in range(101)], dtype=np.uint8)
    moves = cr.vector_map(classes)
    for v, behind in enumerate(cr.tables().vectors):
        for c in classes[::-1]:
            behind = cr.before(min(int(c), cr.MUST), behind)
        assert cr.normalised(behind)[0] == cr.tables().vectors[moves[v]]


def test_repaired_rows_read_as_the_grammar_says(spark):
    rows = make(4, 30)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    for bits in (cr.SEGMENT_BITS, 1):
        out = {}
        for r in sorted(cr.repaired_rows(df, bits).collect(), key=lambda r: (str(r.conv_id), r.place if r.place is not None else -1, r.part)):
            out.setdefault(r.conv_id, []).append(r)
        assert out and all(re.fullmatch("(s?(ua)+)?", "".join(r.role[0] for r in c)) for c in out.values())
        assert all(r.text == "" and r.role in ("user", "assistant") for c in out.values() for r in c if r.edit == "I")


def test_equal_rows_beyond_one_symbol_string(spark, monkeypatch):
    rows = [(1, 0, "user", "hello.", 5000), (1, 1, "assistant", "yes.", 1), (2, 0, "user", " ", 3000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, n long")
    r = {x.conv_id: x for x in cr.repair_table(df, df).collect()}
    assert r[1].duplicate == 4999 and r[1].audit == "K" + "D" * 4999 + "K" and r[1].cost == 4 * 4999
    assert r[2].blank == 3000 and r[2].audit == "D" * 3000 and r[2].illegal == 2999


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert cr.damage_and_repair(df).count() == 0 and cr.repaired_rows(df).count() == 0
