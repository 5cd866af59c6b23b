"""The repair against an enumeration of all edits."""

import hashlib
import itertools
import random
import re
import zlib

from tierscope.llm import chat_repair as cr

SCHEMA = "conv_id bigint, turn bigint, role string, text string, audit string"
GOOD = re.compile(r"(s?(ua)+)?\Z")


def brute_cheapest(codes, most_inserts=3):
    """Every string of edits with up to ``most_inserts`` inserts between rows, by its definition."""
    best = None
    n = len(codes)
    for slots in itertools.product(range(most_inserts), repeat=n + 1):
        if 2 * sum(slots) > 3 * n:
            continue
        for edits in itertools.product("DKR", repeat=n):
            if any(f in "BD" and e != "D" for (_, f), e in zip(codes, edits)):
                continue
            cost = 2 * sum(slots) + sum({"D": 3, "K": 0, "R": 2}[e] + (f == "T" and e != "D")
                                        for (_, f), e in zip(codes, edits))
            audit = "".join("I" * k + e for k, e in zip(slots, [*edits, ""]))
            if best is not None and (cost, audit) >= best:
                continue
            given = [None] * slots[0]
            for (i, _), e, k in zip(codes, edits, slots[1:]):
                given += ([] if e == "D" else [i if e == "K" else None]) + [None] * k
            if any(GOOD.match("".join(x)) for x in itertools.product(*(("u", "a") if g is None else (g,) for g in given))):
                best = cost, audit
    return best


def test_cheapest_equals_enumeration():
    rng = random.Random(1)
    cases = [list(p) for n in (0, 1, 2) for p in itertools.product([(i, f) for i in "sua-" for f in "B-T"], repeat=n)]
    cases += [[(rng.choice("suuaa-"), rng.choice("BDT---")) for _ in range(rng.choice([3, 3, 4]))] for _ in range(120)]
    for codes in cases:
        want = brute_cheapest(codes, 3 if len(codes) < 4 else 2)
        assert cr.cheapest(codes) == want, codes
        assert cr.cheapest(codes, block=1) == want and cr.cheapest(codes, block=2) == want


def test_blocks_change_nothing():
    rng = random.Random(2)
    for _ in range(60):
        codes = [(rng.choice("suuaa-"), rng.choice("BDT----")) for _ in range(rng.randint(1, 60))]
        want = cr.cheapest(codes, block=1000)
        assert all(cr.cheapest(codes, block=b) == want for b in (1, 3, 7, 16))


def brute(rows):
    convs = {r[0]: [] for r in rows}
    for c, turn, role, text, *_ in rows:
        spaced = lambda x: " " if x is None else str(x)
        kind = zlib.crc32(f"{spaced(c)}:{spaced(turn)}".encode()) % 20
        role, text = spaced(role), spaced(text)
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        convs[c] += [(turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    out = set()
    for c, v in convs.items():
        v.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
        codes, seen = [], set()
        for _, role, text in v:
            said = text.rstrip(" \t\n\x0b\x0c\r")
            fault = "B" if not said else "D" if (role, text) in seen else "-" if said[-1] in ".!?" else "T"
            seen.add((role, text))
            codes.append((role[:1], fault))
        cost, audit = cr.cheapest([(i if i in ("s", "u", "a") else "-", f) for i, f in codes])
        turns = {x[0] for x in v if x[0] is not None}
        lines, source = [], iter(v)
        for e in audit:
            row = next(source) if e != "I" else None
            wanted = "assistant" if lines and lines[-1][0] == "u" else "user"
            lines += {"D": [], "K": [f"{row[1]}:{row[2]}" if row else ""], "I": [f"{wanted}:"],
                      "R": [f"{wanted}:{row[2]}" if row else ""]}[e]
        assert GOOD.match("".join(x[0] for x in lines))
        n = lambda x: sum(f == x for _, f in codes)
        out.add((c, max(turns) - min(turns) + 1 - len(turns) if turns else 0, n("B"), n("D"), n("T"),
                 sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(codes, codes[1:])), cost, audit,
                 hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return out


def test_query_equals_brute_force(spark):
    from tierscope.llm.queries import op11_conversation_repair
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()]
    assert {tuple(r) for r in op11_conversation_repair(spark, sf).collect()} == brute(rows)


def test_edge_rows(spark):
    rng = random.Random(9)
    long = "é! " * 50_000
    rows = [(1, 0, None, None, "x"), (1, None, "user", long, "x"), (1, 0, None, None, "x"), (2, 0, "", "a", "x"),
            (None, 0, "user", "a", "x"), (None, None, "assistant", "b.", "x"), (3, None, "system", "\t\n", "x"),
            (4, 3, "Sys", "a.", "x"), (4, 9, "user", "a!  \n", "x"), (4, 9, "user", "a!  \n", "x")]
    rows += [(c, t, rng.choice(["user", "assistant", "system", "tool"]), rng.choice(["a.", "b", " ", "c?", "x. y"]), "x")
             for c in range(10, 60) for t in rng.sample(range(9), rng.randint(1, 6))]
    drop = next(c for c in range(100, 999) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows.append((drop, 0, "user", "gone.", "x"))
    got = [tuple(r) for r in cr.audited(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert set(got) == brute(rows) and len(got) == len(set(got))
    assert (drop, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) in got
    assert cr.audited(spark.createDataFrame(rows, SCHEMA).where("false")).count() == 0


def test_one_long_conversation(spark):
    rows = [(1, t, ("user", "assistant", "system")[t % 7 % 3], f"{t}." if t % 11 else " ", "x") for t in range(3000)]
    assert {tuple(r) for r in cr.audited(spark.createDataFrame(rows, SCHEMA)).collect()} == brute(rows)
