"""Repair of conversations' structure by bidirectional Dijkstra over the edit lattice.

A node of the lattice is (rows consumed, state of the grammar `(s?(ua)+)?`); edits are its edges. A
forward heap from the start and a reverse heap from the ends meet; both go on while a path as cheap as the
best could still be found, so all equal-cost crossings are known, and of the paths through them that
with the least audit in ASCII order is taken.

Rows are dealt by ranges of (conversation, turn), so a conversation that holds a great part of all rows is
spread over tasks. Where a task sees only a part of a conversation, or more than LONG rows of it, it gives the
cheapest audit from each state to each state, and the parts are joined in order: of two audits of one cost
between the same nodes none is the beginning of the other, so the least of each pair of states is all that
is needed. Texts move once, for the hash of what is repaired, which reads them in order without holding them.
"""

from __future__ import annotations

import hashlib
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.llm.columns import quoted
from spindrift.runtime import map_arrow

#: The costs of the edits, and what an undeleted truncated row adds.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: States: nothing yet, after the system's row, after a user's, after an assistant's.
ENDS = (0, 3)
LONG = 20_000
FAULTS = ("", "blank", "duplicate", "truncated")
_FAR = 1 << 60
_USER, _ASSISTANT = 2, 3


def turn_to(state: int) -> int:
    """Whom a rewritten or inserted row must be: a user after all but a user."""
    return _ASSISTANT if state == _USER else _USER


def keeps(initial: str, state: int) -> int:
    """The state after a kept row, or -1."""
    if initial == "s":
        return 1 if state == 0 else -1
    if initial == "u":
        return _USER if state != _USER else -1
    return _ASSISTANT if initial == "a" and state == _USER else -1


def edges(rows: list[tuple[str, int]], node: int):
    """(letter, cost, node) of the edits from a node; rows are (role's initial, fault)."""
    i, state = divmod(node, 4)
    to = turn_to(state)
    yield "I", INSERT, node - state + to
    if i == len(rows):
        return
    initial, fault = rows[i]
    yield "D", DELETE, node + 4
    if fault in (1, 2):
        return
    more = TRUNCATED if fault == 3 else 0
    kept = keeps(initial, state)
    if kept >= 0:
        yield "K", more, 4 * i + 4 + kept
    yield "R", more + REROLE, 4 * i + 4 + to


def into(rows: list[tuple[str, int]], node: int):
    """(cost, node) of the edits that lead to a node."""
    i, state = divmod(node, 4)
    for before in (node - state + s for s in range(4)):
        for _, cost, to in edges(rows, before):
            if to == node:
                yield cost, before
    if i:
        for before in range(4 * i - 4, 4 * i):
            for _, cost, to in edges(rows, before):
                if to == node:
                    yield cost, before


def cheapest(rows: list[tuple[str, int]], start: int, ends: tuple[int, ...]) -> tuple[int, str] | None:
    """The least cost from state `start` before the rows to one of the states `ends` after them, and of its audits the least."""
    size, last = 4 * len(rows) + 4, 4 * len(rows)
    ahead, behind = [_FAR] * size, [_FAR] * size
    done, undone = bytearray(size), bytearray(size)
    ahead[start] = 0
    front, back = [(0, start)], []
    for e in ends:
        behind[last + e] = 0
        heappush(back, (0, last + e))
    best = min(ahead[x] + behind[x] for x in (start, *(last + e for e in ends)))
    while front and back and front[0][0] + back[0][0] <= best:
        if front[0][0] <= back[0][0]:
            cost, node = heappop(front)
            if done[node]:
                continue
            done[node] = 1
            for _, w, to in edges(rows, node):
                if cost + w < ahead[to]:
                    ahead[to] = cost + w
                    heappush(front, (cost + w, to))
                best = min(best, cost + w + behind[to])
        else:
            cost, node = heappop(back)
            if undone[node]:
                continue
            undone[node] = 1
            for w, before in into(rows, node):
                if cost + w < behind[before]:
                    behind[before] = cost + w
                    heappush(back, (cost + w, before))
                best = min(best, cost + w + ahead[before])
    if best >= _FAR:
        return None
    for e in ends:
        undone[last + e] = 1

    # what lies on a cheapest path: up to a crossing by the forward costs, from it on by the reverse ones
    cross: dict[int, list[tuple[str, int]]] = {}
    first, second = set(), set()
    for node in range(size):
        if done[node]:
            out = [(letter, to) for letter, w, to in edges(rows, node) if undone[to] and ahead[node] + w + behind[to] == best]
            if out:
                cross[node] = out
                first.add(node)
                second.update(to for _, to in out)
    stack = list(first)
    while stack:
        node = stack.pop()
        for w, before in into(rows, node):
            if done[before] and ahead[before] + w == ahead[node] and before not in first:
                first.add(before)
                stack.append(before)
    stack = list(second)
    while stack:
        node = stack.pop()
        for _, w, to in edges(rows, node):
            if undone[to] and behind[to] + w == behind[node] and to not in second:
                second.add(to)
                stack.append(to)

    audit, goals = [], {last + e for e in ends}
    one, two = ({start} if start in first else set()), ({start} if start in second or not first else set())
    while not (two & goals):
        steps: dict[str, tuple[set[int], set[int]]] = {}
        for node in one:
            for letter, w, to in edges(rows, node):
                if to in first and ahead[node] + w == ahead[to]:
                    steps.setdefault(letter, (set(), set()))[0].add(to)
            for letter, to in cross.get(node, ()):
                steps.setdefault(letter, (set(), set()))[1].add(to)
        for node in two:
            for letter, w, to in edges(rows, node):
                if to in second and behind[to] + w == behind[node]:
                    steps.setdefault(letter, (set(), set()))[1].add(to)
        letter = min(steps)
        audit.append(letter)
        one, two = steps[letter]
    return best, "".join(audit)


def through(rows: list[tuple[str, int]]) -> list[tuple[int, str] | None]:
    """The cheapest audits of a part of a conversation, from each state (first) to each state."""
    return [cheapest(rows, s, (e,)) for s in range(4) for e in range(4)]


def joined(parts: list[list[tuple[int, str] | None]]) -> tuple[int, str]:
    """The cheapest audit of a conversation from those of its parts."""
    at: list[tuple[int, str] | None] = [(0, ""), None, None, None]
    for part in parts:
        at = [min(((a[0] + p[0], a[1] + p[1]) for s, a in enumerate(at) if a and (p := part[4 * s + e])), default=None) for e in range(4)]
    return min(x for e in ENDS if (x := at[e]))


def _text(x: str) -> Column:
    return F.coalesce(quoted(x).cast("string"), F.lit(" "))


def damaged(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """df's four columns with known damage, and `gone`: by the checksum of `conv:turn` modulo 20, 0 marks a row as
    gone, 1 empties its text, 2 takes its `[.!?]`, 3 repeats it, 4 makes it a user's. Null roles and texts become one space."""
    kind = F.crc32(F.concat(_text(conv), F.lit(":"), _text(turn))) % 20
    rows = df.select(quoted(conv).alias(conv), quoted(turn).alias(turn), _text(role).alias(role), _text(text).alias(text), kind.alias("_kind"))
    rows = rows.withColumn(role, F.when(F.col("_kind") == 4, "user").otherwise(quoted(role)))
    rows = rows.withColumn(text, F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.regexp_replace(quoted(text), "[.!?]", "")).otherwise(quoted(text)))
    twice = F.explode(F.when(F.col("_kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.withColumn("_copy", twice).select(quoted(conv), quoted(turn), quoted(role), quoted(text), (F.col("_kind") == 0).alias("gone"))


_ORDER = ("c", "t", "r", "d")
_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_FOUND = "struct<gaps:bigint,blank:bigint,duplicate:bigint,truncated:bigint,illegal:bigint,cost:bigint,audit:string>"
_PART = ("t", "r", "d", "rows", "low", "high", "turns", "blank", "duplicate", "truncated", "illegal", "first", "last", "costs", "audits")
_PART_TYPES = ("bigint", "string", "string", "bigint", "bigint", "bigint", "bigint", "bigint", "bigint", "bigint", "bigint", "string", "string", "array<bigint>", "array<string>")


class Part:
    """What is known of some rows of one conversation, in order."""

    def __init__(self, key: dict):
        self.key, self.rows, self.turns, self.low, self.high, self.before = key, [], 0, None, None, None
        self.seen = 0

    def add(self, r: dict) -> None:
        self.seen += 1
        if r["gone"]:
            return
        same = self.before is not None and all(self.before[k] == r[k] for k in ("t", "r", "d"))
        self.rows.append((r["i"], 1 if r["blank"] else 2 if r["later"] or same else 3 if r["cut"] else 0))
        if r["t"] is not None:
            self.low = r["t"] if self.low is None else self.low
            self.turns += self.high != r["t"]
            self.high = r["t"]
        self.before = r

    def values(self, whole: bool) -> list:
        many = [sum(f == k for _, f in self.rows) for k in (1, 2, 3)]
        illegal = sum(a + b not in ("su", "ua", "au") for (a, _), (b, _) in zip(self.rows, self.rows[1:], strict=False))
        found = [cheapest(self.rows, 0, ENDS)] if whole else through(self.rows)
        ends = (self.rows[0][0], self.rows[-1][0]) if self.rows else (None, None)
        return [*(self.key[k] for k in ("t", "r", "d")), len(self.rows), self.low, self.high, self.turns, *many, illegal, *ends, [x and x[0] for x in found], [x and x[1] for x in found]]


def parts(slim: DataFrame, long: int = LONG) -> DataFrame:
    """A row for each part of a conversation: (c, whole, p); slim has c, t, r, d, i, gone, blank, cut and later, and is dealt out by ranges here."""
    names = [*_ORDER, "i", "gone", "blank", "cut", "later"]
    order = [F.col("c").asc_nulls_first(), F.col("t").asc_nulls_first(), F.col("r"), F.col("d")]
    kind, kinds = slim.schema["c"].dataType.simpleString(), dict(zip(_PART, _PART_TYPES, strict=True))
    types = {"bigint": pa.int64(), "string": pa.string(), "array<bigint>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}
    struct = pa.struct([(k, types[v]) for k, v in kinds.items()])

    def run(batches):
        own, held, part, opened, split = None, [], None, False, False
        batch = None

        def emit(whole):
            held.append((own, whole, dict(zip(_PART, part.values(whole), strict=True))))

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array([h[0] for h in held], of), pa.array([h[1] for h in held], pa.bool_()), pa.array([h[2] for h in held], struct)], names=["c", "whole", "p"])
            held.clear()
            return out

        for batch in batches:
            of = batch.column(0).type
            for r in batch.to_pylist():
                if part is None or r["c"] != own:
                    if part is not None:
                        emit(opened and not split)  # the first of a task may have begun in another
                        opened = True
                    own, part, split = r["c"], Part(r), False
                elif len(part.rows) >= long and any(part.before[k] != r[k] for k in ("t", "r", "d")):
                    emit(False)
                    part, split = Part(r), True
                part.add(r)
            if len(held) >= 1000:
                yield flush()
        if part is not None:
            emit(False)  # and the last may go on
            yield flush()

    fields = ", ".join(f"{k}: {v}" for k, v in kinds.items())
    dealt = slim.select(*names).repartitionByRange(*order).sortWithinPartitions(*order)
    return map_arrow(dealt, run, f"c {kind}, whole boolean, p struct<{fields}>")


def combined(found: DataFrame) -> DataFrame:
    """(c, found): the results of every conversation from those of its parts, in order."""
    whole = found.where("whole").select("c", F.array("p").alias("parts"), F.lit(True).alias("whole"))
    order = F.struct(F.col("p.t").isNotNull(), "p.t", "p.r", "p.d", "p")
    some = found.where("not whole").groupBy("c").agg(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["p"]).alias("parts")).select("c", "parts", F.lit(False).alias("whole"))
    struct = pa.struct([*((k, pa.int64()) for k in _COUNTS), ("audit", pa.string())])

    def one(ps, whole):
        ps = [p for p in ps if p["rows"]]
        if not ps:
            return dict.fromkeys(_COUNTS, 0) | {"audit": ""}
        if whole:
            cost, audit = ps[0]["costs"][0], ps[0]["audits"][0]
        else:
            cost, audit = joined([[None if c is None else (c, a) for c, a in zip(p["costs"], p["audits"], strict=True)] for p in ps])
        dated = [p for p in ps if p["turns"]]
        turns = sum(p["turns"] for p in dated) - sum(a["high"] == b["low"] for a, b in zip(dated, dated[1:], strict=False))
        gaps = dated[-1]["high"] - dated[0]["low"] + 1 - turns if dated else 0
        illegal = sum(p["illegal"] for p in ps) + sum(a["last"] + b["first"] not in ("su", "ua", "au") for a, b in zip(ps, ps[1:], strict=False))
        return {"gaps": gaps, "illegal": illegal, "cost": cost, "audit": audit} | {k: sum(p[k] for p in ps) for k in ("blank", "duplicate", "truncated")}

    def run(batches):
        for batch in batches:
            out = [one(*x) for x in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, struct)], names=["c", "found"])

    kind = found.schema["c"].dataType.simpleString()
    return map_arrow(whole.unionByName(some), run, f"c {kind}, found {_FOUND}")


class Repair:
    """The rows of a conversation as its audit repairs them, hashed as they come."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state, self.hash, self.any = audit, 0, 0, hashlib.sha256(), False

    def write(self, line: str) -> None:
        self.hash.update((("\n" if self.any else "") + line).encode())
        self.any = True

    def inserted(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            self.state = turn_to(self.state)
            self.write(("user" if self.state == _USER else "assistant") + ":")
            self.at += 1

    def row(self, role: str, text: str) -> None:
        self.inserted()
        letter = self.audit[self.at]
        self.at += 1
        if letter == "R":
            self.state = turn_to(self.state)
            role = "user" if self.state == _USER else "assistant"
        elif letter == "K":
            self.state = keeps(role[:1], self.state)
        if letter != "D":
            self.write(f"{role}:{text}")

    def digest(self) -> str:
        self.inserted()
        return self.hash.hexdigest()


def hashed(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(c, found, repaired_sha256); rows has c, t, r, d and x, the text."""
    kind, turn = (rows.schema[k].dataType.simpleString() for k in ("c", "t"))
    head = found.select("c", F.lit(0).alias("kind"), F.lit(None).cast(turn).alias("t"), F.lit("").alias("r"), F.lit("").alias("d"), F.lit("").alias("x"), "found")
    body = rows.select("c", F.lit(1).alias("kind"), "t", "r", "d", "x", F.lit(None).cast(_FOUND).alias("found"))
    order = [F.col("c").asc_nulls_first(), "kind", F.col("t").asc_nulls_first(), "r", "d"]
    dealt = head.unionByName(body).repartition("c").sortWithinPartitions(*order).select("c", "kind", "r", "x", "found")

    def run(batches):
        own, now, repair = None, None, None
        for batch in batches:
            of, out = batch.schema, []
            for i in range(batch.num_rows):
                if batch.column(1)[i].as_py() == 0:
                    if repair:
                        out.append((own, now, repair.digest()))
                    own, now = batch.column(0)[i].as_py(), batch.column(4)[i].as_py()
                    repair = Repair(now["audit"])
                else:
                    repair.row(batch.column(2)[i].as_py(), batch.column(3)[i].as_py())
            if out:
                c, f, s = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, of.field(0).type), pa.array(f, of.field(4).type), pa.array(s)], names=["c", "found", "repaired_sha256"])
        if repair:
            yield pa.RecordBatch.from_arrays([pa.array([own], of.field(0).type), pa.array([now], of.field(4).type), pa.array([repair.digest()])], names=["c", "found", "repaired_sha256"])

    return map_arrow(dealt, run, f"c {kind}, found {_FOUND}, repaired_sha256 string")


def repair(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", gone: Column | None = None, long: int = LONG) -> DataFrame:
    """conv, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 of every conversation of df.

    Rows where `gone` holds play no part, but their conversations are listed: zeros, an empty audit and the
    hash of nothing where no row is left. Null roles and texts are one space, null turns come first and
    count neither as gaps nor as turns, null conversations are one. Rows of one turn are ordered by role,
    then by the hash of their text, and equal ones are duplicates of the first. Texts may be of any length.
    """
    gone = F.coalesce(gone, F.lit(False)) if gone is not None else F.lit(False)
    rows = df.select(quoted(conv).alias("c"), quoted(turn).cast("bigint").alias("t"), _text(role).alias("r"), _text(text).alias("x"), gone.alias("gone"))
    rows = rows.withColumn("d", F.sha2("x", 256))
    blank, closed = ~F.col("x").rlike(r"[^\x20\x09-\x0D]"), F.col("x").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    slim = rows.select("c", "t", "r", "d", F.substring("r", 1, 1).alias("i"), "gone", blank.alias("blank"), (~closed).alias("cut"))
    # rows that repeat an earlier turn's; those of one turn are told apart where they lie side by side
    dated = F.struct(F.col("t").isNotNull().alias("dated"), F.col("t").alias("turn"))
    many = slim.where("not gone and not blank").groupBy(F.struct("c", "r", "d").alias("key")).agg(F.min(dated).alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "least")
    slim = slim.withColumn("key", F.struct("c", "r", "d")).join(many, "key", "left")
    slim = slim.withColumn("later", F.coalesce(F.col("least") < dated, F.lit(False)))
    found = combined(parts(slim, long))
    out = hashed(rows.where("not gone"), found)
    return out.select(F.col("c").alias(conv), *(F.col(f"found.{k}").alias(k) for k in (*_COUNTS, "audit")), "repaired_sha256")
