import hashlib
import random
import re
import zlib
from collections import Counter
from itertools import groupby

import duckdb
import pytest
from pyspark.sql import functions as F

from spindrift.llm import conversations, queries
from spindrift.llm.repair_sql import SQL

SCHEMA = "conv_id bigint, turn bigint, role string, text string, c string, gone int, kind int"
RESULTS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
STEPS = {"u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}, "s": {0: 1}}


def plain(rows, start=0, ends=(0, 3)):
    """The least (cost, audit) by trying all edits, row by row and state by state."""
    at = {start: (0, "")}

    def insert(at):
        for _ in range(2):
            for s, (cost, audit) in list(at.items()):
                for who in "ua":
                    if s in STEPS[who]:
                        to = STEPS[who][s]
                        at[to] = min(at.get(to, (10**9, "")), (cost + 5, audit + "I"))
        return at

    for initial, fault in rows:
        new = {}
        for s, (cost, audit) in insert(at).items():
            options = [(s, 2, "D")]
            if fault not in (1, 2):
                more = 5 * (fault == 3)
                if initial in STEPS and s in STEPS[initial]:
                    options.append((STEPS[initial][s], more, "K"))
                options += [(STEPS[w][s], more + 1, "R") for w in "ua" if s in STEPS[w]]
            for to, w, letter in options:
                new[to] = min(new.get(to, (10**9, "")), (cost + w, audit + letter))
        at = new
    at = insert(at)
    return min((at[e] for e in ends if e in at), default=None)


def brute(rows):
    """The contract, conversation by conversation."""
    out = []
    for conv, own in groupby(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)), key=lambda r: r[0]):
        left = []
        for _, turn, role, text in own:
            role, text = (" " if x is None else x for x in (role, text))
            kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            left += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
        left.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
        seen, coded = set(), []
        for _, role, text in left:
            bare = text.rstrip(" \t\n\v\f\r")
            coded.append((role[:1], 1 if not bare else 2 if (role, text) in seen else 0 if bare[-1] in ".!?" else 3))
            seen.add((role, text))
        cost, audit = plain(coded)
        lines, state, rest = [], 0, iter(left)
        for letter in audit:
            to = 3 if state == 2 else 2
            who = "user" if to == 2 else "assistant"
            if letter == "I":
                lines.append(who + ":")
            else:
                _, role, text = next(rest)
                if letter == "D":
                    continue
                if letter == "K":
                    to, who = STEPS[role[0]][state], role
                lines.append(f"{who}:{text}")
            state = to
        turns = [t for t, _, _ in left if t is not None]
        many = Counter(f for _, f in coded)
        illegal = sum(a + b not in ("su", "ua", "au") for (a, _), (b, _) in zip(coded, coded[1:], strict=False))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out.append((conv, gaps, many[1], many[2], many[3], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def made(rng, n, long=1):
    roles, texts = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "umpire"], ["Yes.", "no", "Why? ", "", " \n", None, "Line one\nline two!", "x" * 50 + ".\t", "so.\n\nand", "é."]
    rows = []
    for conv in range(n):
        for turn in range(rng.choice([1, 2, 3, 5, 8]) * long):
            clean = rng.random() < 0.6
            role = ("user", "assistant")[turn % 2] if clean else rng.choice(roles)
            rows.append((conv, rng.choice([turn, turn, turn, turn * 3, None, 1]), role, f"Turn {turn}." if clean else rng.choice(texts)))
    return rows


def same(spark, rows, **options):
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA).repartition(3)
    got = conversations.repair(conversations.damaged(df), gone=F.col("gone"), **options)
    assert got.columns == RESULTS
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_search_matches_plain_edits():
    rng = random.Random(1)
    for k in range(6000):
        rows = [(rng.choice("uuaasx "), rng.choice([0, 0, 0, 1, 2, 3])) for _ in range(rng.randint(0, 9 if k % 50 else 60))]
        assert conversations.cheapest(rows, 0, conversations.ENDS) == plain(rows)
        assert conversations.through(rows) == [plain(rows, s, (e,)) for s in range(4) for e in range(4)]
        cuts = sorted(rng.randint(0, len(rows)) for _ in range(rng.randint(0, 3)))
        parts = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)], strict=True)]
        assert conversations.joined([conversations.through(p) for p in parts]) == plain(rows)


def test_repair_matches_brute_force(spark):
    rng = random.Random(2)
    rows = made(rng, 150)
    rows += [(None, t, r, x) for _, t, r, x in made(rng, 1, 3)] + [(-7, None, None, None), (900, 3, "user", "a." * 200_000)]
    rows += [(901, 5, "user", "Same.")] * 7 + [(902, None, "assistant", "Same.")] * 3
    rows += [(c, t, "user", "Gone.") for c in range(1000, 1400) for t in (0,) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0]
    same(spark, rows)
    assert any(r[7] == "" and r[0] and r[0] >= 1000 for r in brute(rows))


@pytest.mark.parametrize("long", [1, 7, conversations.LONG])
def test_a_conversation_that_holds_most_rows_is_split(spark, long):
    rng = random.Random(long)
    rows = [r for r in made(rng, 40) if r[0] != 5] + [(5, *r[1:]) for r in made(rng, 90, 2)]
    same(spark, rows, long=long)


def test_empty_table(spark):
    assert conversations.repair(conversations.damaged(spark.createDataFrame([], SCHEMA)), gone=F.col("gone")).count() == 0
    assert conversations.repair(spark.createDataFrame([(1, 0, "user", "Hi."), (1, 1, "assistant", "Hello.")], "conv_id int, turn int, role string, text string")).first()[1:8] == (0, 0, 0, 0, 0, 0, "KK")


def test_query_matches_its_sql(spark):
    con = duckdb.connect()
    con.sql("create view conversations as select * from '/root/testdata/sf0.01/conversations.parquet'")
    order = ", ".join(RESULTS)
    want = con.sql(f"select {order} from ({SQL})").fetchall()
    got = queries.QUERIES["op11_conversations"](spark, "/root/testdata/sf0.01").select(*RESULTS)
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_sql_matches_brute_force():
    rng = random.Random(3)
    rows = made(rng, 120) + [(None, 4, None, None), (None, None, "user", "x")]
    con = duckdb.connect()
    con.sql("create table conversations (conv_id bigint, turn bigint, role varchar, text varchar)")
    con.executemany("insert into conversations values (?, ?, ?, ?)", rows)
    assert sorted(con.sql(f"select {', '.join(RESULTS)} from ({SQL})").fetchall(), key=str) == brute(rows)
