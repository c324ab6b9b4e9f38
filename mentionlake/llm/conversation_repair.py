"""Conversation structure repair: the cheapest edits that give a conversation legal turns, found by a bidirectional Dijkstra search over the edit lattice.

A node of the lattice is (rows done, state of the role grammar). Forward and reverse heaps meet; all crossings of equal cost are finished, and of them the least
concatenated audit is taken. A conversation of over ``LONG`` rows is cut into pieces of rows, spread over tasks. A piece tells for each pair of states what
it costs to get from one to the other, and how the audits of equal cost compare; a small chain over the pieces picks the states, and each piece is then
repaired between its own. Inserts stand before a row or at the end of all, so no audit of a piece is the beginning of another and the choice is exact.

Defined cases: a null role or text is one space; rows of a null conv_id are one conversation; rows of a turn stand in the order of role, then text, both by code point;
an empty role has no initial, so keeping its row changes nothing; a conversation that lost all rows has zeros, an empty audit and the hash of the
empty string; an empty table gives no rows. Columns besides conv_id, turn, role and text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mentionlake.llm.common import maybe_among, settled, table

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3  # costs
#: States of the grammar `(s?(ua)+)?`: nothing yet, after s, after u, after a. What may come next, and where it leads.
NEXT, AFTER, ENDS = "uuau", {"s": 1, "u": 2, "a": 3}, (0, 3)
NAMES = {"u": "user", "a": "assistant"}
STATES = range(4)
#: Rows of a conversation that one task repairs as a whole; beyond that it is cut into pieces of 2^PIECE_BITS rows.
LONG, PIECE_BITS = 1024, 10
BLANK, REPEATED, CUT, SOUND = range(4)
WHITE = " \t\n\v\f\r"
RESULT = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies): rows as crc32 of `conv_id:turn` damages them; of a dropped row there are no copies, of a repeated one two."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", shown("conv_id"), shown("turn"))) % 20
    rows = conversations.select("conv_id", "turn", shown("role").alias("role"), shown("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1)
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.cast("long").alias("copies"))


@lru_cache(4096)
def row_edges(initial: str, fault: int, copies: int) -> tuple[tuple, tuple]:
    """Edges over a row by the state they leave, and by the state they reach: (other state, cost, letter).

    Copies after the first must go. Their D's follow the row's letter at once, as D comes before I, and are the same on every way; so they cost but stay out of the labels.
    """
    more = DELETE * (copies - 1)
    out, into = [[] for _ in STATES], [[] for _ in STATES]
    for state in STATES:
        ways = [(state, DELETE + more, "D")]
        if fault in (CUT, SOUND):
            more_cut = more + TRUNCATED * (fault == CUT)
            if not initial or initial == NEXT[state] or (initial == "s" and state == 0):
                ways.append((AFTER[initial] if initial else state, KEEP + more_cut, "K"))
            ways.append((AFTER[NEXT[state]], REROLE + more_cut, "R"))
        for other, cost, letter in ways:
            out[state].append((other, cost, letter))
            into[other].append((state, cost, letter))
    return tuple(map(tuple, out)), tuple(map(tuple, into))


INSERTS_OUT = tuple(((AFTER[NEXT[s]], INSERT, "I"),) for s in STATES)
INSERTS_INTO = tuple(tuple((s, INSERT, "I") for s in STATES if AFTER[NEXT[s]] == t) for t in STATES)


def cheapest(edges: list[tuple], entry: int, exits: tuple[int, ...], open_end: bool = True) -> tuple[int, str] | None:
    """(cost, least audit) from `entry` before the first row to one of `exits` after the last; None if there is no way. `open_end`: rows may be inserted after the last one.

    Equal costs leave a heap in the order of rows, so a label is final when it leaves: edges of no cost always cross a row. Every node of a cheapest way is final on one side at
    least once the heaps' least costs sum to more than the best crossing; so the least audit is that of a node that has labels of both sides.
    """
    n = len(edges)
    labels = ({(0, entry): (0, "")}, {(n, x): (0, "") for x in exits})
    heaps = ([(0, 0, entry)], [(0, -n, x) for x in exits])
    heapify(heaps[1])
    final: tuple[set, set] = (set(), set())
    best = 0 if n == 0 and entry in exits else float("inf")
    while heaps[0] and heaps[1] and heaps[0][0][0] + heaps[1][0][0] <= best:
        side = int(heaps[1][0][0] < heaps[0][0][0])
        _, place, state = heappop(heaps[side])
        i = abs(place)
        if (i, state) in final[side]:
            continue
        final[side].add((i, state))
        own, other = labels[side], labels[1 - side]
        cost, audit = own[i, state]
        ways = []
        if open_end or i < n:
            ways += [(i, *w) for w in (INSERTS_INTO if side else INSERTS_OUT)[state]]
        if side and i > 0:
            ways += [(i - 1, *w) for w in edges[i - 1][1][state]]
        if not side and i < n:
            ways += [(i + 1, *w) for w in edges[i][0][state]]
        for j, to, more, letters in ways:
            label = (cost + more, letters + audit if side else audit + letters)
            node = (j, to)
            if node not in own or label < own[node]:
                if node not in own or label[0] < own[node][0]:
                    heappush(heaps[side], (label[0], -j if side else j, to))
                own[node] = label
                if node in other:
                    best = min(best, label[0] + other[node][0])
    met = [labels[0][v][1] + labels[1][v][1] for v in labels[0].keys() & labels[1].keys() if labels[0][v][0] + labels[1][v][0] == best]
    return (int(best), min(met)) if met else None


def merged(rows: list[tuple]) -> list[tuple]:
    """(turn, role, text, copies, repeated) with equal neighbours counted together; rows without copies go."""
    out: list[tuple] = []
    for turn, role, text, copies, repeated in rows:
        if out and out[-1][:3] == (turn, role, text):
            out[-1] = (turn, role, text, out[-1][3] + copies, out[-1][4])
        elif copies:
            out.append((turn, role, text, copies, repeated))
    return out


def marked(rows: list[tuple]) -> list[int]:
    """The fault of the first copy of each row."""
    seen: set = set()
    faults = []
    for _, role, text, _, repeated in rows:
        bare = text.rstrip(WHITE)
        faults.append(BLANK if not bare else REPEATED if repeated or (role, text) in seen else SOUND if bare[-1] in ".!?" else CUT)
        seen.add((role, text))
    return faults


def summary(rows: list[tuple], faults: list[int]) -> dict:
    """What can be counted of consecutive rows, and what is needed to count on: first and last turn and initial."""
    turns = [r[0] for r in rows if r[0] is not None]
    initials = [r[1][:1] for r in rows]
    found = {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))}
    for (_, _, _, copies, _), fault in zip(rows, faults, strict=True):
        found["blank"] += copies * (fault == BLANK)
        found["duplicate"] += (copies - (fault != REPEATED)) * (fault != BLANK)
        found["truncated"] += fault == CUT
        found["illegal"] += copies - 1
    return found | {"first_turn": min(turns, default=None), "last_turn": max(turns, default=None), "turns": len(set(turns)), "first_initial": initials[0] if rows else None, "last_initial": initials[-1] if rows else None}


def replayed(rows: list[tuple], audit: str, state: int) -> tuple[str, list[str]]:
    """The audit with the letters of all copies, and the repaired rows, `role:text`, from the state on."""
    letters, lines = iter(audit), []
    spelled: list[str] = []

    def put(role: str, text: str, to: int) -> None:
        nonlocal state
        lines.append(f"{role}:{text}")
        state = to

    def edit() -> str:
        """The next letter of a row; what is inserted before it goes to the lines."""
        for letter in letters:
            spelled.append(letter)
            if letter != "I":
                return letter
            put(NAMES[NEXT[state]], "", AFTER[NEXT[state]])
        return ""

    for _, role, text, copies, _ in rows:
        letter = edit()
        if letter == "K":
            put(role, text, AFTER[role[0]] if role else state)
        elif letter == "R":
            put(NAMES[NEXT[state]], text, AFTER[NEXT[state]])
        spelled.append("D" * (copies - 1))
    edit()
    return "".join(spelled), lines


def lattice(rows: list[tuple], faults: list[int]) -> list[tuple]:
    return [row_edges(r[1][:1], fault, r[3]) for r, fault in zip(rows, faults, strict=True)]


def grouped(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Rows of sorted batches by their first columns, nulls included; one group is held at a time."""
    key, held = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[:n_keys] != key:
                if held:
                    yield key, held
                key, held = row[:n_keys], []
            held.append(row[n_keys:])
    if held:
        yield key, held


def batched(rows: Iterator[tuple], schema: pa.Schema, size: int = 512) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_pydict(dict(zip(schema.names, zip(*held, strict=True), strict=True)), schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pydict(dict(zip(schema.names, zip(*held, strict=True), strict=True)), schema)


def encoded(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def gaps(s: dict) -> int:
    return s["last_turn"] - s["first_turn"] + 1 - s["turns"] if s["turns"] else 0


def _repair(kind: pa.DataType):
    schema = pa.schema([("conv_id", kind), *((c, pa.int64()) for c in RESULT), ("audit", pa.string()), ("repaired_sha256", pa.string())])

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for (conv,), group in grouped(batches, 1):
            rows = merged([(*r, False) for r in group])
            faults = marked(rows)
            cost, audit = cheapest(lattice(rows, faults), 0, ENDS)
            s, (audit, lines) = summary(rows, faults), replayed(rows, audit, 0)
            yield conv, gaps(s), s["blank"], s["duplicate"], s["truncated"], s["illegal"], cost, audit, hashlib.sha256(encoded("\n".join(lines))).hexdigest()

    return lambda batches: batched(rows_of(batches), schema)


def repair(conversations: DataFrame, long: int = LONG) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of (conv_id, turn, role, text, copies): a row for each conv_id.

    One shuffle by conv_id, in which no conversation has over `long` rows; a bitmap leaves out those that may have more, and they are cut into pieces.
    """
    kind = conversations.schema["conv_id"].dataType.simpleString()
    out = f"conv_id {kind}, {', '.join(f'{c} long' for c in RESULT)}, audit string, repaired_sha256 string"
    arrow = _arrow_type(conversations)
    large = settled(conversations.groupBy("conv_id").count().where(F.col("count") > long).select(F.col("conv_id").alias("d")))
    if large.isEmpty():
        listed, others = None, conversations
    else:
        listed, others = maybe_among(conversations, large, "conv_id")
    order = [F.asc_nulls_first(c) for c in ("conv_id", "turn", "role", "text")]
    whole = others.repartition("conv_id").sortWithinPartitions(*order).mapInArrow(_repair(arrow), out)
    return whole if listed is None else whole.unionByName(_repair_long(listed, arrow, out))


def _arrow_type(conversations: DataFrame) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(conversations.schema["conv_id"].dataType)


#: Of a piece: what `summary` counts, then by entry and exit (four states, and the end of the conversation) cost and rank of the audit; -1: no way.
COUNTED = ["blank", "duplicate", "truncated", "illegal", "first_turn", "last_turn", "turns"]
EXITS = [((x,), False) for x in STATES] + [(ENDS, True)]


def _repair_long(rows: DataFrame, arrow: pa.DataType, out: str) -> DataFrame:
    """As repair(), for conversations of any length: equal rows are counted, the first of each (role, text) is found by a join, and pieces of sorted rows are repaired apart.

    Of a conversation one task sees a few numbers a piece, then, in order and a piece at a time, what is hashed.
    """
    kind = rows.schema["conv_id"].dataType.simpleString()
    ids = rows.select("conv_id").distinct()
    rows = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies")).where("copies > 0")
    turn = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("first_turn"))
    first = rows.groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("text").alias("t")).agg(F.min(turn).alias("first"))
    met = rows.join(first, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("text") == F.col("t")))
    met = met.select("conv_id", "turn", "role", "text", "copies", (~F.col("turn").eqNullSafe(F.col("first.first_turn"))).alias("repeated"))
    nulls_first = [F.asc_nulls_first(c) for c in ("conv_id", "turn", "role")]
    spread = met.repartitionByRange(*nulls_first, F.substring("text", 1, 64)).sortWithinPartitions(*nulls_first, "text")
    held = settled(spread.withColumn("at", F.monotonically_increasing_id())).withColumn("piece", F.expr(f"shiftright(at, {PIECE_BITS})"))
    columns = ["conv_id", "piece", "turn", "role", "text", "copies", "repeated"]

    tables = settled(held.repartition("conv_id", "piece").sortWithinPartitions("conv_id", "piece", "at").select(*columns).mapInArrow(_tables(arrow), f"conv_id {kind}, piece long, ways array<long>"))
    chained = tables.repartition("conv_id").sortWithinPartitions("conv_id", "piece").mapInArrow(_chain(arrow), f"c {kind}, p long, entry int, exit int")
    ways = held.join(chained, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("piece") == F.col("p")))
    pieces = f"conv_id {kind}, piece long, {', '.join(f'{c} long' for c in COUNTED)}, first_initial string, last_initial string, cost long, audit string, body string, bodies long"
    parts = ways.repartition("conv_id", "piece").sortWithinPartitions("conv_id", "piece", "at").select(*columns, "entry", "exit").mapInArrow(_parts(arrow), pieces)
    ended = parts.repartition("conv_id").sortWithinPartitions("conv_id", "piece").mapInArrow(_ends(arrow), out)
    none = {c: F.lit(0).cast("long") for c in RESULT} | {"audit": F.lit(""), "repaired_sha256": F.sha2(F.lit(""), 256)}
    lost = ids.join(ended.select(F.col("conv_id").alias("c")), F.col("conv_id").eqNullSafe(F.col("c")), "left_anti").select("conv_id", *(v.alias(k) for k, v in none.items()))
    return ended.unionByName(lost)


def _tables(kind: pa.DataType):
    schema = pa.schema([("conv_id", kind), ("piece", pa.int64()), ("ways", pa.list_(pa.int64()))])

    def rows_of(batches):
        for (conv, piece), rows in grouped(batches, 2):
            edges = lattice(rows, marked(rows))
            ways: list[int] = []
            for entry in STATES:
                found = [cheapest(edges, entry, exits, ended) for exits, ended in EXITS]
                rank = {a: i for i, a in enumerate(sorted({f[1] for f in found if f}))}
                ways += [x for f in found for x in ((f[0], rank[f[1]]) if f else (-1, -1))]
            yield conv, piece, ways

    return lambda batches: batched(rows_of(batches), schema)


def _chain(kind: pa.DataType):
    """The states between pieces: costs from each state to the end, from the last piece back; then from the first on the least audit of those that stay cheapest."""
    schema = pa.schema([("c", kind), ("p", pa.int64()), ("entry", pa.int32()), ("exit", pa.int32())])
    inf = float("inf")

    def rows_of(batches):
        for (conv,), rows in grouped(batches, 1):
            cost = lambda k, entry, x: c if (c := rows[k][1][10 * entry + 2 * x]) >= 0 else inf
            last = len(rows) - 1
            to_go = [[0.0] * 4 for _ in rows]
            to_go[last] = [cost(last, e, 4) for e in STATES]
            for k in range(last - 1, -1, -1):
                to_go[k] = [min(cost(k, e, x) + to_go[k + 1][x] for x in STATES) for e in STATES]
            state = 0
            for k in range(last):
                x = min((x for x in STATES if cost(k, state, x) + to_go[k + 1][x] == to_go[k][state]), key=lambda x: rows[k][1][10 * state + 2 * x + 1])
                yield conv, rows[k][0], state, x
                state = x
            yield conv, rows[last][0], state, 4

    return lambda batches: batched(rows_of(batches), schema)


def _parts(kind: pa.DataType):
    schema = pa.schema([("conv_id", kind), ("piece", pa.int64()), *((c, pa.int64()) for c in COUNTED), ("first_initial", pa.string()), ("last_initial", pa.string()), ("cost", pa.int64()), ("audit", pa.string()), ("body", pa.string()), ("bodies", pa.int64())])

    def rows_of(batches):
        for (conv, piece), group in grouped(batches, 2):
            entry, exit_ = group[0][5:]
            rows = [r[:5] for r in group]
            faults = marked(rows)
            cost, audit = cheapest(lattice(rows, faults), entry, *EXITS[exit_])
            s, (audit, lines) = summary(rows, faults), replayed(rows, audit, entry)
            yield conv, piece, *(s[c] for c in COUNTED), s["first_initial"], s["last_initial"], cost, audit, "\n".join(lines), len(lines)

    return lambda batches: batched(rows_of(batches), schema, 1)


def _ends(kind: pa.DataType):
    schema = pa.schema([("conv_id", kind), *((c, pa.int64()) for c in RESULT), ("audit", pa.string()), ("repaired_sha256", pa.string())])

    def finished(conv, s: dict, audit: list[str], h) -> tuple:
        return conv, gaps(s), s["blank"], s["duplicate"], s["truncated"], s["illegal"], s["cost"], "".join(audit), h.hexdigest()

    def rows_of(batches):
        held = None
        for batch in batches:
            for r in batch.to_pylist():
                if held is None or held[0] != r["conv_id"]:
                    if held is not None:
                        yield finished(*held)
                    held, written = (r["conv_id"], dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "turns", "cost"), 0) | {"first_turn": None, "last_turn": None}, [], hashlib.sha256()), 0
                _, s, audit, h = held
                for c in ("blank", "duplicate", "truncated", "illegal", "turns", "cost"):
                    s[c] += r[c]
                s["illegal"] += "last_initial" in s and s["last_initial"] + r["first_initial"] not in ("su", "ua", "au")
                s["turns"] -= s["last_turn"] is not None and s["last_turn"] == r["first_turn"]
                s["first_turn"] = r["first_turn"] if s["first_turn"] is None else s["first_turn"]
                s["last_turn"] = s["last_turn"] if r["last_turn"] is None else r["last_turn"]
                s["last_initial"] = r["last_initial"]
                audit.append(r["audit"])
                if r["bodies"]:
                    h.update(encoded(("\n" if written else "") + r["body"]))
                    written += r["bodies"]
        if held is not None:
            yield finished(*held)

    return lambda batches: batched(rows_of(batches), schema, 1)


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The repair of every damaged conversation."""
    return repair(damaged(table(spark, sf_dir, "conversations")))
