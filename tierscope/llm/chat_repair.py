"""Cheapest repair of damaged conversations.

Faults are found row by row in windows. A conversation's repair is then a shortest path:
its rows from the last to the first, and the state of the wanted order of roles
``(s?(ua)+)?``. A path's weight is one integer: the cost in its high digits, and below it
one digit of fixed width for each edit, first edit highest, with zeros behind the last.
So the plain minimum of integers decides cost and, among equal costs, the ASCII-least
string of edits. Long conversations are cut into blocks of rows: a block's weights for
each pair of states are put in front of those of the rows behind it, which costs the
block's length instead of the conversation's for each row. All edits of a block end
with one of its rows, so that no string of edits for a pair of states is the beginning
of another one, and the minima of blocks stay minima in front of any rest.

Rows stream through sorted partitions. A conversation is one task's work because its
order and its result (one string of edits, one repaired conversation) are sequential;
besides Spark's sort, which spills, a task holds one byte a row of one conversation
while it plans, and the string of edits while it repairs.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tierscope.llm.common import column, stored

BLOCK = 128     # rows of a block
BLANKS = " \t\n\x0b\x0c\r"
EDITS = " DIKR"  # digit of each edit: Delete, Insert, Keep, Rerole
DIGIT = 3       # bits of a digit
DELETE, INSERT, REROLE, TRUNCATED = 3, 2, 2, 1  # costs

# States: nothing yet, system only, after a user, after an assistant.
AFTER = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None)}
WANTED = ("u", "u", "a", "u")   # the role that a state can get from user and assistant
NEXT = (2, 2, 3, 2)             # and the state after it
ROLES = {"u": "user", "a": "assistant"}


def damage(conversations: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, text)`` with synthetic faults, fixed by the CRC-32 of
    ``conv_id:turn`` modulo 20: 0 drops the row, 1 empties its text, 2 removes ``.!?``,
    3 repeats it, 4 sets the role user. A null role, text, or number in the CRC is one space."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")).cast("binary")) % 20
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate(spaced("text"), ".!?", "")).otherwise(spaced("text"))
    return conversations.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
        "role", "text", kind.alias("kind")).where("kind <> 0").select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(spaced("role")).alias("role"),
        text.alias("text"), F.explode(F.sequence(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1))).alias("copy")
    ).drop("copy")


def faults(rows: DataFrame) -> DataFrame:
    """``(conv_id, pos, turn, role, text, fault, initial)``: rows of each conversation (all
    null ids are one) in the order of turn (null first), role, text; the first fault that
    applies: ``B``lank, ``D``uplicate of an earlier role and text, ``T``runcated, or
    ``-``; and the role's initial, ``-`` unless it is s, u or a. Null roles and texts are empty."""
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    r = rows.select("conv_id", "turn", empty("role"), empty("text")).repartition("conv_id")
    turn = F.col("turn").asc_nulls_first()
    same = Window.partitionBy("conv_id", "role", "text").orderBy(turn)
    line = Window.partitionBy("conv_id").orderBy(turn, "role", "text", "seen")
    said = F.rtrim(F.col("text"), F.lit(BLANKS))
    initial = F.substring("role", 1, 1)
    return r.withColumn("seen", F.row_number().over(same)).select(
        "conv_id", F.row_number().over(line).alias("pos"), "turn", "role", "text",
        F.when(said == "", "B").when(F.col("seen") > 1, "D")
        .when(~F.substring(said, -1, 1).isin(".", "!", "?"), "T").otherwise("-").alias("fault"),
        F.when(initial.isin("s", "u", "a"), initial).otherwise("-").alias("initial"))


def _join(front: int, back: int, width: int, behind: int) -> int:
    """The weight of the edits ``front`` (digits of ``width``) before ``back`` (of ``behind``)."""
    digits = front & ((1 << DIGIT * width) - 1)
    spare = ((digits & -digits).bit_length() - 1) // DIGIT if digits else width  # zeros behind the last edit
    used = DIGIT * (width - spare)
    low = DIGIT * behind
    tail = (digits >> DIGIT * spare << low - used) | (back & ((1 << low) - 1)) >> used
    return ((front >> DIGIT * width) + (back >> low) << low) | tail


def _in_front(codes, values: list, width: int) -> list:
    """``values`` (least weight from each state, None if there is none) with the rows ``codes``,
    pairs of initial and fault, put in front, and inserts before each of them."""
    low = DIGIT * width
    mask, top = (1 << low) - 1, low - DIGIT

    def put(edit: str, cost: int, v: int) -> int:
        return ((v >> low) + cost << low) | EDITS.index(edit) << top | (v & mask) >> DIGIT

    for initial, fault in reversed(codes):
        extra = TRUNCATED if fault == "T" else 0
        found = []
        for s in range(4):
            ways = [] if values[s] is None else [put("D", DELETE, values[s])]
            if fault not in "BD":
                t = AFTER[initial][s] if initial in AFTER else None
                if t is not None and values[t] is not None:
                    ways.append(put("K", extra, values[t]))
                if values[NEXT[s]] is not None:
                    ways.append(put("R", REROLE + extra, values[NEXT[s]]))
            found.append(min(ways, default=None))
        values = _inserted(found, put)
    return values


def _inserted(found: list, put) -> list:
    """Least weights when any rows may be inserted first: at most three are of use."""
    values = found
    for _ in range(3):
        values = [min((w for w in (found[s], None if values[NEXT[s]] is None else put("I", INSERT, values[NEXT[s]]))
                       if w is not None), default=None) for s in range(4)]
    return values


def cheapest(codes: list, block: int = BLOCK) -> tuple[int, str]:
    """Cost and edits of the cheapest repair of rows, given as pairs of initial and fault."""
    width = 2 * len(codes) + 4
    low = DIGIT * width
    end = lambda edits: (INSERT * len(edits) << low) | sum(
        EDITS.index(e) << low - DIGIT * (k + 1) for k, e in enumerate(edits))
    values = [0, end("II"), end("I"), 0]
    if len(codes) <= block:
        values = _in_front(codes, values, width)
    else:
        small = 2 * block + 4
        for at in reversed(range(0, len(codes), block)):
            own = codes[at:at + block]
            parts = [_in_front(own, [0 if s == t else None for s in range(4)], small) for t in range(4)]
            values = [min((_join(parts[t][s], values[t], small, width) for t in range(4)
                           if parts[t][s] is not None and values[t] is not None), default=None) for s in range(4)]
    best = values[0]
    digits = format(best & ((1 << low) - 1), f"0{width}o").rstrip("0")
    return best >> low, "".join(EDITS[int(d)] for d in digits)


_PLAN = pa.schema([("conv_id", pa.int64()), *((c, pa.int64()) for c in (
    "gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string())])
_PLAN_SQL = ("conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, "
             "cost bigint, audit string")
_TURN = pa.schema([("conv_id", pa.int64()), ("seq", pa.int64()), ("edit", pa.string()), ("role", pa.string()),
                   ("text", pa.string())])
_TURN_SQL = "conv_id bigint, seq bigint, edit string, role string, text string"


def _rows(batches, *names):
    for batch in batches:
        yield from zip(*(column(batch, n) for n in names))


def _batches(rows, schema):
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 1 + sum(len(x) for x in row if isinstance(x, str)) // 1000
        if size >= 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _plans(batches):
    def finish():
        pairs = [KINDS[c] for c in codes]
        bad = sum(a + b not in ("su", "ua", "au") for (a, _), (b, _) in zip(pairs, pairs[1:]))
        gaps = 0 if first is None else last - first + 1 - distinct
        counts = [sum(f == x for _, f in pairs) for x in "BDT"]
        return (conv, gaps, *counts, bad, *cheapest(pairs))

    def plans():
        nonlocal conv, codes, first, last, distinct
        started = False
        for c, turn, initial, fault in _rows(batches, "conv_id", "turn", "initial", "fault"):
            if started and c != conv:
                yield finish()
            if not started or c != conv:
                started, conv, codes, first, last, distinct = True, c, bytearray(), None, None, 0
            if fault is None:  # every conversation has one row that only names it
                continue
            codes.append(NUMBER[initial, fault])
            if turn is not None and turn != last:
                first, last, distinct = turn if first is None else first, turn, distinct + 1
        if started:
            yield finish()

    conv, codes, first, last, distinct = None, bytearray(), None, None, 0
    yield from _batches(plans(), _PLAN)


KINDS = [(i, f) for i in "sua-" for f in "BDT-"]
NUMBER = {k: n for n, k in enumerate(KINDS)}


def plan(found: DataFrame, conversations: DataFrame) -> DataFrame:
    """One row for each conv_id of ``conversations``, with or without rows in ``found`` (of
    ``faults``): ``gaps`` in its turns, numbers of ``blank``, ``duplicate`` and ``truncated``
    rows and of ``illegal`` neighbours, the ``cost`` of the cheapest repair and its edits ``audit``."""
    names = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id")).distinct().selectExpr(
        "conv_id", "0 as pos", "cast(null as bigint) as turn", "cast(null as string) as initial",
        "cast(null as string) as fault")
    rows = found.select("conv_id", "pos", "turn", "initial", "fault").unionByName(names)
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "pos").mapInArrow(_plans, _PLAN_SQL)


def _repaired(batches):
    def turns():
        audit, at, state, seq = "", 0, 0, 0

        def inserts(conv):
            nonlocal at, state, seq
            while at < len(audit) and audit[at] == "I":
                role, state, at, seq = WANTED[state], NEXT[state], at + 1, seq + 1
                yield conv, seq, "I", ROLES[role], ""

        now, started = None, False
        for conv, pos, role, text, edits in _rows(batches, "conv_id", "pos", "role", "text", "audit"):
            if pos == 0:
                if started:
                    yield from inserts(now)
                started, now, audit, at, state, seq = True, conv, edits, 0, 0, 0
                continue
            yield from inserts(conv)
            edit, at = audit[at], at + 1
            if edit == "D":
                continue
            if edit == "R":
                role, state = ROLES[WANTED[state]], NEXT[state]
            else:
                state = AFTER[role[0]][state]
            seq += 1
            yield conv, seq, edit, role, text
        if started:
            yield from inserts(now)

    yield from _batches(turns(), _TURN)


def repair(found: DataFrame, plans: DataFrame) -> DataFrame:
    """The repaired conversations as rows ``(conv_id, seq, edit, role, text)`` in the order of
    seq, with the edit that each kept, changed or inserted row comes from."""
    heads = plans.selectExpr("conv_id", "0 as pos", "cast(null as string) as role", "cast(null as string) as text", "audit")
    rows = found.selectExpr("conv_id", "pos", "role", "text", "cast(null as string) as audit")
    return heads.unionByName(rows).repartition("conv_id").sortWithinPartitions("conv_id", "pos").mapInArrow(
        _repaired, _TURN_SQL)


def digests(plans: DataFrame, turns: DataFrame) -> DataFrame:
    """``plans`` with ``repaired_sha256`` of the repaired ``role:text`` rows, newline-joined."""
    names = [f.name for f in _PLAN]
    heads = plans.select("conv_id", F.lit(0).cast("bigint").alias("seq"), *names[1:],
                         *[F.lit(None).cast("string").alias(c) for c in ("role", "text")])
    rows = turns.select("conv_id", "seq", *[F.lit(None).cast(plans.schema[c].dataType).alias(c) for c in names[1:]],
                        "role", "text")

    def run(batches):
        def out():
            head, sha = None, None
            for seq, role, text, *own in _rows(batches, "seq", "role", "text", *names):
                if seq == 0:
                    if head:
                        yield (*head, sha.hexdigest())
                    head, sha = own, hashlib.sha256()
                else:
                    sha.update(f"{chr(10) * (seq > 1)}{role}:{text}".encode("utf-8", "surrogateescape"))
            if head:
                yield (*head, sha.hexdigest())
        yield from _batches(out(), _PLAN.append(pa.field("repaired_sha256", pa.string())))

    return heads.unionByName(rows).repartition("conv_id").sortWithinPartitions("conv_id", "seq").mapInArrow(
        run, _PLAN_SQL + ", repaired_sha256 string")


def audited(conversations: DataFrame) -> DataFrame:
    """Damage, faults, plan, repair and digest: one row for each conv_id of ``conversations``.
    Other columns are not read; no rows give no rows."""
    found = stored(faults(damage(conversations)))
    plans = stored(plan(found, conversations))
    return digests(plans, repair(found, plans))
