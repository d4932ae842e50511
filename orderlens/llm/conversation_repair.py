"""Conversation structure repair: the cheapest edits that make roles alternate.

A conversation is repaired when the initials of its roles read
``(s?(ua)+)?``: an optional system turn, then user and assistant in turn.  A
row's first fault counts: *blank* (no character outside white space),
*duplicate* (role and text seen earlier in the conversation), *truncated* (the
last such character is not ``.``, ``!`` or ``?``).  Edits: Keep costs nothing,
Rerole (to user or assistant) 3, Delete 4 (required for blank and duplicate
rows), Insert (an empty user or assistant turn anywhere) 3; a truncated row that
is not deleted costs 3 more.  Of the cheapest edits those whose initials, read
as a string, come first in ASCII are taken.

The costs of the rest of a conversation, one for each of the grammar's four
states, form a vector; its differences are small, so few normalised vectors
exist.  A row is one of nine symbols.  Following the Four Russians, a table says
for each block of ``BLOCK`` symbols and each vector behind the block which
vector stands before it, and by how much the costs rise.  Blocks are looked up
from the end of a conversation to its start; then each is expanded backward from
the vector behind it, which gives the costs at all its rows, and read forward.  As
the cost of the rest is known at each row, the first letter in ASCII that stays
cheapest is taken, and no tie can be missed; what a block gives is remembered.

No conversation needs to fit a task.  Equal rows are counted before they are
moved.  Rows are dealt by ranges of (conversation, turn, ...), so a long
conversation spans tasks, and cut into segments of at most ``2**SEGMENT_BITS``
rows, which become one string of symbols each.  A segment that is not its whole
conversation first says, for every vector behind it, which one stands before it;
these maps (a few hundred bytes a segment) are put together from the
conversation's end, then each segment is read from each of the four states, and
the states are put together from its start.  Repaired rows come out by segment.
Only the summary of a conversation, whose hash runs over all its text, reads
its rows in one task: in order, a batch at a time, with the letters of one
segment; its audit is one string by its nature.

Rows of a conversation are ordered by turn (null first), then by role and by the
hash of the text.  A null role or text is one space; rows with a null
conversation id are one conversation.  Roles other than those beginning with
s, u or a can only be reroled or deleted.  An empty table gives an empty
result.  Columns besides conv_id, turn, role and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderlens.llm.common import SPACES, SharedFolder, ship_package

BLOCK = 4
SEGMENT_BITS = 16
#: Equal rows in a row that one symbol string spells out.
COPIES = 1024
DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
#: States: nothing yet, after system, after user, after assistant.  The state after a kept initial, and after
#: the one role that may be inserted or given.
AFTER_KEEP = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
AFTER_GIVEN = (2, 2, 3, 2)
GIVEN = ("user", "user", "assistant", "user")
INITIALS = "sua"
#: Symbols: initial s, u, a or other, clean (0 to 3) or truncated (4 to 7); 8 must be deleted.
SYMBOLS, MUST = 9, 8
AT_END = (0, 2 * INSERT, INSERT, 0)


# --- one block

def edits(symbol: int, state: int) -> list[tuple[str, int, int]]:
    """(letter, cost, next state) of what can be done with a row, in ASCII order."""
    out = [("D", DELETE, state)]
    if symbol != MUST:
        more = TRUNCATED if symbol >= 4 else 0
        kept = AFTER_KEEP[state].get((INITIALS + "x")[symbol % 4])
        if kept is not None:
            out.append(("K", more, kept))
        out.append(("R", REROLE + more, AFTER_GIVEN[state]))
    return out


def before(symbol: int, rest: tuple[int, ...]) -> tuple[int, ...]:
    """Costs before a row from the costs behind it, for each state."""
    r = [min(cost + rest[after] for _, cost, after in edits(symbol, q)) for q in range(4)]
    u, a = min(r[2], INSERT + r[3]), min(r[3], INSERT + r[2])
    return (min(r[0], INSERT + u), min(r[1], INSERT + u), u, a)


def normalised(costs: tuple[int, ...]) -> tuple[tuple[int, ...], int]:
    least = min(costs)
    return tuple(c - least for c in costs), least


class Tables:
    """The normalised vectors, and for blocks of one and of BLOCK symbols the vector before and the rise."""

    def __init__(self) -> None:
        self.vectors = [normalised(AT_END)[0]]
        place = {self.vectors[0]: 0}
        one = []
        for v in self.vectors:  # grows while new vectors are found
            row = []
            for symbol in range(SYMBOLS):
                found, rise = normalised(before(symbol, v))
                if found not in place:
                    place[found] = len(self.vectors)
                    self.vectors.append(found)
                row.append((place[found], rise))
            one.append(row)
        table = np.array(one)
        self.one, self.one_rise = table[:, :, 0].T.copy(), table[:, :, 1].T.copy()
        self.block, self.rise = self.one, self.one_rise
        for _ in range(BLOCK - 1):  # a symbol in front of shorter blocks
            codes = len(self.block)
            first = np.repeat(np.arange(SYMBOLS), codes)
            behind, rise = np.tile(self.block, (SYMBOLS, 1)), np.tile(self.rise, (SYMBOLS, 1))
            self.rise = rise + self.one_rise[first[:, None], behind]
            self.block = self.one[first[:, None], behind]


@lru_cache(maxsize=1)
def tables() -> Tables:
    return Tables()


@lru_cache(maxsize=1 << 16)
def expanded(code: int, length: int, vector: int, state: int) -> tuple[str, int, int]:
    """(letters, state behind, cost) of a block read from a state: its costs
    backward from the vector behind it, then the first letter that is cheapest."""
    symbols = [code // SYMBOLS ** (length - 1 - i) % SYMBOLS for i in range(length)]
    costs = [tables().vectors[vector]]
    for symbol in reversed(symbols):
        costs.append(before(symbol, costs[-1]))
    costs.reverse()
    letters, spent, p = [], 0, 0
    while p < length:
        options = {letter: (cost, after) for letter, cost, after in edits(symbols[p], state)}
        for letter in "DIKR":
            if letter == "I":
                after, cost, at = AFTER_GIVEN[state], INSERT, p
            elif letter in options:
                (cost, after), at = options[letter], p + 1
            else:
                continue
            if cost + costs[at][after] == costs[p][state]:
                break
        letters.append(letter)
        spent, state, p = spent + cost, after, at
    return "".join(letters), state, spent


def ending(state: int) -> str:
    """What closes a conversation behind its last row."""
    return "I" * (AT_END[state] // INSERT)


# --- one segment

def symbols_of(text: str) -> np.ndarray:
    """The classes of a symbol string, A to L: initial and four times the fault."""
    return np.frombuffer(text.encode(), np.uint8) - ord("A")


def codes_of(classes: np.ndarray) -> tuple[list[int], list[int]]:
    """The first symbols that fill no block, one by one, and the codes of the blocks after them."""
    symbols = np.minimum(classes, MUST).astype(np.int64)
    odd = len(symbols) % BLOCK
    blocks = symbols[odd:].reshape(-1, BLOCK) @ (SYMBOLS ** np.arange(BLOCK - 1, -1, -1))
    return symbols[:odd].tolist(), blocks.tolist()


def vector_map(classes: np.ndarray) -> np.ndarray:
    """For each vector behind a segment the one before it."""
    t = tables()
    odd, blocks = codes_of(classes)
    now = np.arange(len(t.vectors))
    for code in reversed(blocks):
        now = t.block[code, now]
    for symbol in reversed(odd):
        now = t.one[symbol, now]
    return now


def read(classes: np.ndarray, behind: int, state: int) -> tuple[str, int, int]:
    """(letters, state behind, cost) of a segment, given the vector behind it and the state before it."""
    t = tables()
    odd, blocks = codes_of(classes)
    steps = []
    for code, length, table in [*((s, 1, t.one) for s in odd), *((b, BLOCK, t.block) for b in blocks)][::-1]:
        steps.append((code, length, behind))
        behind = int(table[code, behind])
    letters, cost = [], 0
    for step in reversed(steps):
        some, state, spent = expanded(*step, state)
        letters.append(some)
        cost += spent
    return "".join(letters), state, cost


def illegal_pairs(initials: np.ndarray) -> int:
    """Neighbours that are neither system and user nor user and assistant nor the reverse."""
    left, right = initials[:-1], initials[1:]
    legal = ((left == 0) & (right == 1)) | ((left == 1) & (right == 2)) | ((left == 2) & (right == 1))
    return int(len(left) - legal.sum())


# --- rows

def damaged(rows: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, text, n)``: conversation rows with the faults that
    crc32 of ``conv_id:turn`` modulo 20 sets: 0 drops the row, 1 empties its
    text, 2 takes ``.!?`` out of it, 3 repeats the row, 4 makes it the user's."""
    role, text = F.coalesce(F.col("role"), F.lit(" ")), F.coalesce(F.col("text"), F.lit(" "))
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    code = F.crc32(key.cast("binary")) % 20
    return (rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), code.alias("code")).where("code <> 0")
            .select("conv_id", "turn", F.when(F.col("code") == 4, "user").otherwise(F.col("role")).alias("role"),
                    F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.regexp_replace("text", "[.!?]", ""))
                    .otherwise(F.col("text")).alias("text"),
                    F.when(F.col("code") == 3, 2).otherwise(1).cast("long").alias("n")))


def classified(rows: DataFrame, folder: SharedFolder) -> DataFrame:
    """The rows ``(conv_id, turn, role, text, n)`` with their faults, in order:
    ``place`` numbers them, ``symbols`` has a letter for each of ``n`` copies."""
    equal = (rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), "n")
             .groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").alias("n"))
             .withColumn("h", F.sha2("text", 256)))
    turns = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    repeated = (equal.groupBy("conv_id", "role", "h").agg(F.min(turns).alias("first"), F.count(F.lit(1)).alias("k"))
                .where("k > 1").select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("h").alias("hash"), "first"))
    joined = equal.join(repeated, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("h") == F.col("hash")), "left")
    seen = F.col("hash").isNotNull() & ~turns.eqNullSafe(F.col("first"))
    bare = F.rtrim(F.col("text"), F.lit(SPACES))
    blank = bare == ""
    cut = ~F.substring(bare, -1, 1).isin(".", "!", "?")
    initial = F.substring("role", 1, 1)
    letter = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    pieces = joined.select("*", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / COPIES).cast("int"))).alias("piece"))
    pieces = (pieces.withColumn("seen", seen | (F.col("piece") > 0)).withColumn("blank", blank).withColumn("letter", letter)
              .withColumn("n", F.least(F.lit(COPIES), F.col("n") - F.col("piece") * COPIES)))

    def spelled(fault: int | Column) -> Column:
        return F.chr((F.lit(ord("A")) + F.col("letter") + 4 * fault).cast("long"))

    first = spelled(F.when(F.col("blank") | F.col("seen"), 2).when(cut, 1).otherwise(0))
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "h", "piece"]
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = (pieces.withColumn("symbols", F.concat(first, F.repeat(spelled(2), (F.col("n") - 1).cast("int"))))
             .repartitionByRange(tasks, *order).sortWithinPartitions(*order)
             .select("conv_id", "turn", "role", "text", "n", "blank", "symbols", F.monotonically_increasing_id().alias("place")))
    return folder.write(dealt, "rows")


def traced(rows: DataFrame, folder: SharedFolder, segment_bits: int = SEGMENT_BITS) -> DataFrame:
    """``(conv_id, seg, letters, state, cost, illegal)`` for each segment of the
    classified rows: its edits, the state before it, their cost, and the
    neighbours that break the order, the one before its first row included."""
    segments = (rows.select("conv_id", F.shiftright("place", segment_bits).alias("seg"), F.struct("place", "symbols").alias("s"))
                .groupBy("conv_id", "seg").agg(F.array_sort(F.collect_list("s")).alias("s"))
                .select("conv_id", "seg", F.array_join(F.transform("s", lambda x: x["symbols"]), "").alias("symbols")))
    segments = folder.write(segments, "segments")
    several = segments.groupBy("conv_id").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select(F.col("conv_id").alias("c"), "k")
    flagged = segments.join(several, F.col("conv_id").eqNullSafe(F.col("c")), "left").select("conv_id", "seg", "symbols", F.col("k").isNull().alias("whole"))
    schema = segments.select("conv_id", "seg", F.lit("").alias("letters"), F.lit(0).alias("state"), F.lit(0).cast("long").alias("cost"),
                             F.lit(0).cast("long").alias("illegal")).schema

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            letters, costs, bad = [], [], []
            for text in batch.column("symbols").to_pylist():
                classes = symbols_of(text)
                some, state, cost = read(classes, 0, 0)
                close = ending(state)
                letters.append(some + close)
                costs.append(cost + INSERT * len(close))
                bad.append(illegal_pairs(classes % 4))
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("seg"), pa.array(letters, pa.string()),
                                              pa.array([0] * len(letters), pa.int32()), pa.array(costs, pa.int64()), pa.array(bad, pa.int64())],
                                             schema.names)

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            moves = [vector_map(symbols_of(s)).astype("<i2").tobytes() for s in batch.column("symbols").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("seg"), pa.array(moves, pa.binary())], ["conv_id", "seg", "moves"])

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """From a conversation's last segment to its first: the vector behind each."""
        of, now = object(), 0
        for batch in batches:
            behind = []
            for r in batch.to_pylist():
                if r["conv_id"] != of:
                    of, now = r["conv_id"], 0
                behind.append(now)
                now = int(np.frombuffer(r["moves"], "<i2")[now])
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("seg"), pa.array(behind, pa.int32())], ["c", "g", "behind"])

    def from_each_state(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                classes = symbols_of(r["symbols"])
                ways = [read(classes, r["behind"], state) for state in range(4)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["conv_id"]], batch.schema.field("conv_id").type), pa.array([r["seg"]], pa.int64()),
                     *(pa.array([[w[i] for w in ways]], pa.list_(t)) for i, t in enumerate((pa.string(), pa.int32(), pa.int64()))),
                     pa.array([illegal_pairs(classes % 4)], pa.int64()), pa.array([int(classes[0] % 4)], pa.int32()),
                     pa.array([int(classes[-1] % 4)], pa.int32())],
                    ["conv_id", "seg", "letters", "states", "costs", "illegal", "first", "last"])

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """From a conversation's first segment to its last: the state before each."""
        def told(r: dict, state: int, extra: int, close: str) -> pa.RecordBatch:
            values = [r["conv_id"], r["seg"], r["letters"][state] + close, state, r["costs"][state] + INSERT * len(close), r["illegal"] + extra]
            types = [kind, pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], schema.names)

        held, state, extra = None, 0, 0  # the last segment is told once it is known to be the last
        for batch in batches:
            kind = batch.schema.field("conv_id").type
            for r in batch.to_pylist():
                same = held is not None and held["conv_id"] == r["conv_id"]
                if held is not None:
                    after = held["states"][state]
                    yield told(held, state, extra, "" if same else ending(after))
                    state = after
                if same:
                    extra = illegal_pairs(np.array([held["last"], r["first"]]))
                else:
                    state, extra = 0, 0
                held = r
        if held is not None:
            yield told(held, state, extra, ending(held["states"][state]))

    cut = flagged.where("NOT whole")
    base = segments.schema["conv_id"].dataType.simpleString()
    moves = cut.select("conv_id", "seg", "symbols").mapInArrow(mapped, f"conv_id {base}, seg long, moves binary")
    behind = (moves.repartition("conv_id").sortWithinPartitions("conv_id", F.col("seg").desc())
              .mapInArrow(vectors, f"c {base}, g long, behind int"))
    ways = (cut.join(behind, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("seg") == F.col("g"))).select("conv_id", "seg", "symbols", "behind")
            .mapInArrow(from_each_state, f"conv_id {base}, seg long, letters array<string>, states array<int>, costs array<long>, "
                                         "illegal long, first int, last int"))
    put_together = ways.repartition("conv_id").sortWithinPartitions("conv_id", "seg").mapInArrow(chosen, schema)
    return folder.write(flagged.where("whole").select("conv_id", "seg", "symbols").mapInArrow(whole, schema).unionByName(put_together), "traces")


def _edited(rows: Iterator[dict]) -> Iterator[tuple[dict, str, str, str]]:
    """(row, edit, role, text) of every row that stays or comes in, from
    segment heads (with letters) and rows in order; an inserted row comes with
    the row or head before which it stands."""
    letters, at, state, head = "", 0, 0, None

    def inserts(row: dict) -> Iterator[tuple[dict, str, str, str]]:
        nonlocal at, state
        while at < len(letters) and letters[at] == "I":
            yield row, "I", GIVEN[state], ""
            state, at = AFTER_GIVEN[state], at + 1

    for r in rows:
        if r["letters"] is not None:
            if head is not None:
                yield from inserts(head)
            letters, at, state, head = r["letters"], 0, r["state"], r
            continue
        for _ in range(r["n"]):
            yield from inserts(r)
            edit = letters[at]
            at += 1
            if edit == "K":
                state = AFTER_KEEP[state][r["role"][:1]]
                yield r, edit, r["role"], r["text"]
            elif edit == "R":
                yield r, edit, GIVEN[state], r["text"]
                state = AFTER_GIVEN[state]
        head = r
    if head is not None:
        yield from inserts(head)


def _stream(rows: DataFrame, traces: DataFrame, segment_bits: int) -> DataFrame:
    """Heads (kind 1) and rows (kind 2) with the same columns."""
    none = {"turn": "long", "role": "string", "text": "string", "n": "long", "blank": "boolean", "symbols": "string", "place": "long",
            "letters": "string", "state": "int", "cost": "long", "illegal": "long"}

    def like(df: DataFrame, kind: int) -> DataFrame:
        return df.select("conv_id", "seg", F.lit(kind).alias("kind"),
                         *(F.col(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in none.items()))

    return like(traces, 1).unionByName(like(rows.withColumn("seg", F.shiftright("place", segment_bits)), 2))


def repaired_rows(rows: DataFrame, segment_bits: int = SEGMENT_BITS) -> DataFrame:
    """The repaired conversations of ``(conv_id, turn, role, text)`` as rows
    (conv_id, turn, place, part, edit, role, text); ``place`` and ``part`` give
    the order, ``edit`` is K, R or I.  An inserted row has the turn of the row
    that it stands before, or after at the end of a segment."""
    spark = rows.sparkSession
    ship_package(spark)
    folder = SharedFolder(spark, "conversations")
    ready = classified(rows.withColumn("n", F.lit(1).cast("long")), folder)
    traces = traced(ready, folder, segment_bits)
    names = ["conv_id", "turn", "place", "part", "edit", "role", "text"]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, out, last, part = None, [], None, 0

        def watched() -> Iterator[dict]:
            nonlocal kind
            for batch in batches:
                kind = batch.schema.field("conv_id").type
                yield from batch.to_pylist()

        def packed() -> pa.RecordBatch:
            types = [kind, pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

        for r, edit, role, text in _edited(watched()):
            part = part + 1 if r["place"] == last else 0
            last = r["place"]
            out.append((r["conv_id"], r["turn"], r["place"], part, edit, role, text))
            if len(out) == 1000:
                yield packed()
                out = []
        if out:
            yield packed()

    schema = ready.select("conv_id", "turn", "place", F.lit(0).alias("part"), F.lit("").alias("edit"), "role", "text").schema
    for column in schema:
        column.nullable = True
    # by segment: a long conversation is written by many tasks
    return (_stream(ready, traces, segment_bits).repartition("conv_id", "seg").sortWithinPartitions("conv_id", "seg", "kind", "place")
            .mapInArrow(write, schema))


def repair_table(rows: DataFrame, all_conversations: DataFrame, segment_bits: int = SEGMENT_BITS) -> DataFrame:
    """One row for each id of ``all_conversations``: conv_id, gaps, blank,
    duplicate, truncated, illegal, cost, audit, repaired_sha256; from rows
    ``(conv_id, turn, role, text, n)``, ``n`` of each."""
    spark = rows.sparkSession
    ship_package(spark)
    folder = SharedFolder(spark, "conversations")
    ready = classified(rows, folder)
    traces = traced(ready, folder, segment_bits)
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, now, done = None, None, []

        def watched() -> Iterator[dict]:
            """Heads and rows go on to the edits, and are counted on the way."""
            nonlocal kind, now
            for batch in batches:
                kind = batch.schema.field("conv_id").type
                for r in batch.to_pylist():
                    if r["kind"] == 0:  # a conversation begins; what it holds is told by the rows behind
                        yield {"letters": "", "state": 0, "conv_id": r["conv_id"], "new": True}
                        continue
                    if r["kind"] == 1:
                        now["audit"].append(r["letters"])
                        now["illegal"] += r["illegal"]
                        now["cost"] += r["cost"]
                    else:
                        if r["turn"] is not None and r["turn"] != now["turn"]:
                            now["gaps"] += r["turn"] - now["turn"] - 1 if now["turn"] is not None else 0
                            now["turn"] = r["turn"]
                        must = sum(r["symbols"].count(c) for c in "IJKL")
                        now["blank" if r["blank"] else "duplicate"] += must
                        now["truncated"] += sum(r["symbols"].count(c) for c in "EFGH")
                    yield r

        def told() -> pa.RecordBatch:
            rows_out = [[c["conv_id"], c["gaps"], c["blank"], c["duplicate"], c["truncated"], c["illegal"], c["cost"], "".join(c["audit"]),
                         c["sha"].hexdigest()] for c in done]
            types = [kind, *([pa.int64()] * 6), pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows_out), types)], names)

        # the edits of a conversation come out before the next one's head goes in, so the two are never mixed
        stream = watched()
        pending: list[dict] = []

        def one(first: dict) -> Iterator[dict]:
            yield first
            for r in stream:
                if r.get("new"):
                    pending.append(r)
                    return
                yield r

        head = next(stream, None)
        while head is not None:
            now = {"conv_id": head["conv_id"], "gaps": 0, "turn": None, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0,
                   "audit": [], "sha": hashlib.sha256()}
            begun = False
            for _, _, role, text in _edited(one(head)):
                now["sha"].update(f"{chr(10) if begun else ''}{role}:{text}".encode("utf-8", "surrogatepass"))
                begun = True
            done.append(now)
            if len(done) == 500:
                yield told()
                done = []
            head = pending.pop() if pending else None
        if done:
            yield told()

    heads = all_conversations.select("conv_id").distinct()
    stream = _stream(ready, traces, segment_bits)
    begins = heads.select("conv_id", F.lit(-1).cast("long").alias("seg"), F.lit(0).alias("kind"),
                          *(F.lit(None).cast(f.dataType).alias(f.name) for f in stream.schema.fields[3:]))
    schema = (all_conversations.select("conv_id", *(F.lit(0).cast("long").alias(c) for c in names[1:7]), F.lit("").alias("audit"),
                                       F.lit("").alias("repaired_sha256")).schema)
    for column in schema:
        column.nullable = True
    return (begins.unionByName(stream).repartition("conv_id").sortWithinPartitions("conv_id", "seg", "kind", "place")
            .mapInArrow(summed, schema))


def damage_and_repair(conversations: DataFrame, segment_bits: int = SEGMENT_BITS) -> DataFrame:
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    return repair_table(damaged(rows), rows, segment_bits)


#: The same as DuckDB SQL: costs of the rest from the last row to the first, then one edit a step.
ORACLE = r"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
coded AS (
  SELECT *, xor(list_reduce(list_transform(string_split(k, ''), lambda x: ord(x)::BIGINT),
                            lambda c, b: list_reduce(range(8), lambda d, i: CASE WHEN d & 1 = 1 THEN xor(d >> 1, 3988292384) ELSE d >> 1 END,
                                                     xor(c, b)), 4294967295::BIGINT), 4294967295::BIGINT) % 20 AS code FROM keyed),
damaged AS (
  SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role,
         CASE code WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE code WHEN 0 THEN [] WHEN 3 THEN [1, 2] ELSE [1] END) AS copy FROM coded),
ordered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS p,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth,
         rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare, left(role, 1) AS i FROM damaged),
faults AS (
  SELECT *, lag(i) OVER (PARTITION BY conv_id ORDER BY p) || i AS pair,
         CASE WHEN bare = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault
  FROM ordered),
f AS (
  SELECT conv_id, p, role, text, i, coalesce(fault IN ('blank', 'duplicate'), false) AS must,
         CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END AS more FROM faults),
ends AS (SELECT conv_id, max(p) AS n FROM f GROUP BY conv_id),
back AS (
  SELECT conv_id, n + 1 AS p, [0, 6, 3, 0] AS w FROM ends
  UNION ALL
  SELECT conv_id, p, [least(r0, 3 + least(r2, 3 + r3)), least(r1, 3 + least(r2, 3 + r3)), least(r2, 3 + r3), least(r3, 3 + r2)] FROM (
    SELECT f.conv_id, f.p,
      least(4 + w[1], CASE WHEN NOT must THEN 3 + more + w[3] END, CASE WHEN NOT must AND i = 's' THEN more + w[2] WHEN NOT must AND i = 'u' THEN more + w[3] END) AS r0,
      least(4 + w[2], CASE WHEN NOT must THEN 3 + more + w[3] END, CASE WHEN NOT must AND i = 'u' THEN more + w[3] END) AS r1,
      least(4 + w[3], CASE WHEN NOT must THEN 3 + more + w[4] END, CASE WHEN NOT must AND i = 'a' THEN more + w[4] END) AS r2,
      least(4 + w[4], CASE WHEN NOT must THEN 3 + more + w[3] END, CASE WHEN NOT must AND i = 'u' THEN more + w[3] END) AS r3
    FROM back b JOIN f ON f.conv_id IS NOT DISTINCT FROM b.conv_id AND f.p = b.p - 1)),
steps AS (
  SELECT b.conv_id, b.p, b.w, c.w AS rest, f.role, f.text, f.i, f.must, f.more
  FROM back b LEFT JOIN back c ON c.conv_id IS NOT DISTINCT FROM b.conv_id AND c.p = b.p + 1
  LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM b.conv_id AND f.p = b.p),
run AS (
  SELECT conv_id, 1::BIGINT AS p, 1 AS q, '' AS audit, []::VARCHAR[] AS lines FROM ends
  UNION ALL
  SELECT conv_id, CASE WHEN e = 'I' THEN p ELSE p + 1 END,
         CASE e WHEN 'D' THEN q WHEN 'K' THEN kept ELSE given END, audit || e,
         CASE e WHEN 'D' THEN lines WHEN 'K' THEN list_append(lines, role || ':' || text)
                WHEN 'R' THEN list_append(lines, name || ':' || text) ELSE list_append(lines, name || ':') END
  FROM (SELECT *, CASE WHEN 4 + rest[q] = w[q] THEN 'D' WHEN 3 + w[given] = w[q] THEN 'I'
                       WHEN NOT must AND more + rest[kept] = w[q] THEN 'K' ELSE 'R' END AS e
        FROM (SELECT r.conv_id, r.p, r.q, r.audit, r.lines, s.w, s.rest, s.role, s.text, s.must, s.more,
                     CASE WHEN r.q = 3 THEN 4 ELSE 3 END AS given, CASE WHEN r.q = 3 THEN 'assistant' ELSE 'user' END AS name,
                     CASE WHEN r.q = 1 AND s.i = 's' THEN 2 WHEN r.q <> 3 AND s.i = 'u' THEN 3 WHEN r.q = 3 AND s.i = 'a' THEN 4 END AS kept
              FROM run r JOIN steps s ON s.conv_id IS NOT DISTINCT FROM r.conv_id AND s.p = r.p
              WHERE s.rest IS NOT NULL OR s.w[r.q] > 0))),
last AS (SELECT conv_id, arg_max(audit, length(audit)) AS audit, arg_max(lines, length(audit)) AS lines FROM run GROUP BY conv_id),
told AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
         count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM faults GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(b.w[1], 0)::BIGINT AS cost,
       coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN told t ON t.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN back b ON b.conv_id IS NOT DISTINCT FROM c.conv_id AND b.p = 1
LEFT JOIN last l ON l.conv_id IS NOT DISTINCT FROM c.conv_id"""
