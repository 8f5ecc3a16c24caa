"""DuckDB SQL of the conversation repair: the lattice, row by row, with the least (cost, audit) of each state."""

from __future__ import annotations

from spindrift.llm.conversations import DELETE, INSERT, REROLE, TRUNCATED


def _edit(state: str, letter: str, cost: str, line: str) -> str:
    """A state after an edit; null if the state can't be."""
    return f"CASE WHEN {state} IS NOT NULL THEN {{'cost': {state}.cost + {cost}, 'audit': {state}.audit || '{letter}', 'out': {state}.out || {line}}} END"


def _least(*options: str) -> str:
    return f"list_min([{', '.join(options)}])"


_USER, _ASSISTANT = "'user:' || chr(10)", "'assistant:' || chr(10)"
_FREE = "f NOT IN (1, 2)"


def _taken(state: str, initial: str, who: str) -> list[str]:
    keep = _edit(state, "K", "more", "role || ':' || text || chr(10)")
    rewrite = _edit(state, "R", f"{REROLE} + more", f"'{who}:' || text || chr(10)")
    return [f"CASE WHEN {_FREE} AND c = '{initial}' THEN {keep} END", f"CASE WHEN {_FREE} THEN {rewrite} END"]


def _dropped(state: str) -> str:
    return _edit(state, "D", str(DELETE), "''")


def _closed(source: str, columns: str) -> str:
    """States after insertions: first a user's row, then an assistant's."""
    inner = f"SELECT {columns}, a0, a1, {_least('a2', *(_edit(s, 'I', str(INSERT), _USER) for s in ('a0', 'a1', 'a3')))} AS b2, a3 FROM {source}"
    return f"SELECT {columns}, a0, a1, b2, {_least('a3', _edit('b2', 'I', str(INSERT), _ASSISTANT))} AS b3 FROM ({inner})"


_STEP = f"""
SELECT conv_id, i, {_dropped("a0")} AS a0,
       {_least(_dropped("a1"), f"CASE WHEN {_FREE} AND c = 's' THEN {_edit('a0', 'K', 'more', "role || ':' || text || chr(10)")} END")} AS a1,
       {_least(_dropped("b2"), *(x for s in ("a0", "a1", "b3") for x in _taken(s, "u", "user")))} AS a2,
       {_least(_dropped("b3"), *_taken("b2", "a", "assistant"))} AS a3
FROM ({_closed("(SELECT r.conv_id, n.i, n.role, n.text, n.c, n.f, n.more, r.a0, r.a1, r.a2, r.a3 FROM r JOIN n ON n.conv_id IS NOT DISTINCT FROM r.conv_id AND n.i = r.i + 1)", "conv_id, i, role, text, c, f, more")})
"""

SQL = f"""
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, z: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)) AS t),
k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
             coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS s FROM conversations),
h AS (SELECT conv_id, turn, role, text,
             xor(list_reduce(list_concat([4294967295], list_transform(string_split(s, ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda x, y: xor(x >> 8, t[1 + (xor(x, y) & 255)])), 4294967295) % 20 AS kind FROM k, crc),
d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
             CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy FROM h WHERE kind <> 0),
o AS (SELECT conv_id, turn, role, text, left(role, 1) AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i,
             row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again FROM d),
n AS (SELECT conv_id, turn, role, text, c, i, CASE WHEN f = 3 THEN {TRUNCATED} ELSE 0 END AS more, f, i > 1 AND lag(c) OVER (PARTITION BY conv_id ORDER BY i) || c NOT IN ('su', 'ua', 'au') AS odd
      FROM (SELECT o.*, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 1 WHEN again THEN 2 WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') THEN 3 ELSE 0 END AS f FROM o)),
r AS (SELECT conv_id, CAST(0 AS BIGINT) AS i, {{'cost': CAST(0 AS BIGINT), 'audit': '', 'out': ''}} AS a0, CAST(NULL AS STRUCT(cost BIGINT, audit VARCHAR, "out" VARCHAR)) AS a1,
             CAST(NULL AS STRUCT(cost BIGINT, audit VARCHAR, "out" VARCHAR)) AS a2, CAST(NULL AS STRUCT(cost BIGINT, audit VARCHAR, "out" VARCHAR)) AS a3 FROM (SELECT DISTINCT conv_id FROM conversations)
      UNION ALL ({_STEP})),
e AS (SELECT conv_id, arg_max({{'x': a0, 'y': b3}}, i) AS s FROM ({_closed("r", "conv_id, i")}) GROUP BY conv_id),
b AS (SELECT conv_id, list_min([s.x, s.y]) AS s FROM e),
g AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (f = 1) AS blank, count(*) FILTER (f = 2) AS duplicate,
             count(*) FILTER (f = 3) AS truncated, count(*) FILTER (odd) AS illegal FROM n GROUP BY conv_id)
SELECT b.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       s.cost AS cost, s.audit AS audit, sha256(left(s.out, greatest(length(s.out) - 1, 0))) AS repaired_sha256
FROM b LEFT JOIN g ON b.conv_id IS NOT DISTINCT FROM g.conv_id
"""
