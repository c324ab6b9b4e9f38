"""Conversation repair against every cheapest way over the whole lattice, and its long form against its short one."""

import hashlib
import random
import zlib

import pytest

from mentionlake.llm import conversation_repair as C

COLUMNS = ["conv_id", "turn", "role", "text"]
SCHEMA = "conv_id long, turn long, role string, text string"
RESULT = ["conv_id", *C.RESULT, "audit", "repaired_sha256"]


def brute(rows):
    """The contract by a plain program: all states after each row with their least (cost, audit, lines)."""
    convs = {}
    for conv, turn, role, text in rows:
        kept = convs.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 1:
            text = ""
        if kind == 2:
            text = "".join(c for c in text if c not in ".!?")
        if kind == 4:
            role = "user"
        kept += [(turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return sorted((_brute(conv, sorted(kept, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))) for conv, kept in convs.items()), key=repr)


def _brute(conv, rows):
    seen, faults = set(), []
    for _, role, text in rows:
        solid = [c for c in text if c not in " \t\n\v\f\r"]
        faults.append("blank" if not solid else "duplicate" if (role, text) in seen else "" if solid[-1] in ".!?" else "truncated")
        seen.add((role, text))
    turns = {r[0] for r in rows if r[0] is not None}
    initials = [r[1][:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    steps = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    def with_inserts(states):
        for _ in range(3):
            for state, (cost, audit, lines) in list(states.items()):
                for name in ("user", "assistant"):
                    if to := steps.get((state, name[0])):
                        new = (cost + 3, audit + "I", [*lines, f"{name}:"])
                        states[to] = min(states.get(to, new), new)
        return states

    states = with_inserts({"": (0, "", [])})
    for (_, role, text), fault in zip(rows, faults, strict=True):
        after = {}
        for state, (cost, audit, lines) in states.items():
            ways = [(state, 4, "D", [])]
            if fault in ("", "truncated"):
                more = 3 * (fault == "truncated")
                to = steps.get((state, role[:1])) if role else state
                if to is not None:
                    ways.append((to, more, "K", [f"{role}:{text}"]))
                ways += [(steps[state, n[0]], 3 + more, "R", [f"{n}:{text}"]) for n in ("user", "assistant") if (state, n[0]) in steps]
            for to, more, letter, line in ways:
                new = (cost + more, audit + letter, lines + line)
                after[to] = min(after.get(to, new), new)
        states = with_inserts(after)
    cost, audit, lines = min(v for k, v in states.items() if k in ("", "a"))
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return (conv, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def found(df):
    return sorted((tuple(r) for r in df.select(*RESULT).collect()), key=repr)


def some(n, seed, convs):
    rng = random.Random(seed)
    texts = ["Yes.", "No", "What?", "", " \t\n", None, "Go on!", "tail. ", "é", "a.b", "…"]
    roles = ["user", "assistant", "system", "user", "assistant", None, "", "tool", "usher"]
    return [(rng.choice(convs), rng.choice([None, *range(40)]), rng.choice(roles), rng.choice(texts)) for _ in range(n)]


def test_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select(*COLUMNS).collect()]
    assert found(C.op11_conversation_repair(spark, sf)) == brute(rows)


@pytest.mark.parametrize("seed", range(3))
def test_nulls_ties_and_repeats(spark, seed):
    rows = some(300, seed, [*range(60), None])
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 kind", "2 copies", "'x' audit")
    assert found(C.repair(C.damaged(df))) == brute(rows)


@pytest.mark.parametrize("seed", range(3))
def test_pieces_give_what_a_whole_gives(spark, seed, monkeypatch):
    monkeypatch.setattr(C, "PIECE_BITS", seed)
    rows = some(250, 10 + seed, [1, 2, 3, None, 5, 6, 7]) + [(9, 7, "user", "the same.")] * 40 + [(8, t, "user", "at every turn.") for t in range(30)]
    dropped = next(t for t in range(999) if zlib.crc32(f"11:{t}".encode()) % 20 == 0)
    rows += [(11, dropped, "user", "lost.")] * 9
    df = C.damaged(spark.createDataFrame(rows, SCHEMA))
    assert found(C.repair(df, long=3)) == found(C.repair(df)) == brute(rows)


def test_empty_and_long_texts(spark):
    assert found(C.repair(C.damaged(spark.createDataFrame([], SCHEMA)))) == []
    rows = [(4, t, ("user", "assistant")[t % 2], "word " * 100_000 + ".") for t in range(6)]
    assert found(C.repair(C.damaged(spark.createDataFrame(rows, SCHEMA)))) == brute(rows)


def test_every_letter_of_a_long_tie():
    """Where many ways cost the same, the least audit of all is taken."""
    edges = [C.row_edges("u", C.SOUND, 1)] * 9
    states = {0: [""]}
    ways = {(0, 0): [(0, "")]}
    for i in range(len(edges) + 1):
        for state in C.STATES:
            for cost, audit in list(ways.get((i, state), [])):
                if cost + 3 < 30 and audit[-2:] != "II":
                    ways.setdefault((i, C.AFTER[C.NEXT[state]]), []).append((cost + 3, audit + "I"))
        for state in C.STATES:
            if i < len(edges):
                for cost, audit in sorted(set(ways.get((i, state), [])))[:400]:
                    for to, more, letter in edges[i][0][state]:
                        ways.setdefault((i + 1, to), []).append((cost + more, audit + letter))
    assert states and C.cheapest(edges, 0, C.ENDS) == min(x for s in C.ENDS for x in ways[9, s])
