"""Substring deduplication by collinear chaining.

The seeds of a text are hashes of K consecutive words, the least of each EVERY neighbours, at all
their places. Occurrences of a seed are joined to two others, the first of the text before and the
first of all, never pair by pair: first among the texts of one task, of which only the first text
goes on, then among all tasks. A seed that a third of all texts has so reaches one task as a row
for each slice of the corpus, not for each text.

The joined positions of two texts are merged into runs of one diagonal and chained in order with
gap costs; a Fenwick tree keeps the best chain that ends before a point. Chains are aligned on the
words themselves: runs are extended as far as words agree, gaps are aligned by their longest
common subsequence, and ends are carried over small edits; where that leaves too few words, the
ends are aligned by their longest common subsequence too. What is left are fuzzy passages.

Alignment reads excerpts around each chain. A passage that reaches the end of its excerpt is
aligned again on the two whole texts, unless it lies within a longer one of its text. Where chains of a text with several partners are too short
each but lie side by side, they are carried on to their partners' own partners (`_carried`), so
that a passage made of lines that nearer texts have in part is still found in the text that has it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from spindrift.llm import sieve, skew, wordhash
from spindrift.llm.columns import quoted, texts
from spindrift.llm.decontaminate import merge, offsets
from spindrift.runtime import cut_lineage, drop_unused, map_arrow, rewritten

K, WINDOW, EVERY = 5, 8, 2  # EVERY: the window that find takes
LEAST_WORDS, SIMILARITY = 50, 0.8
HELD = 1 << 19  # seeds combined at once in a task
OUT = 8 << 20  # bytes of excerpts handed on at once
JOIN_GAP, GAP_COST, SLACK, ENDS = 16, 0.25, 12, 40
PER_KEY = 1000  # chains that look up one text under one key
_SEED = np.uint64((1 << 48) - 1)  # bits of a seed that are kept; chance meetings make no chain
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)
_LAST = np.uint64(0xFFFFFFFFFFFFFFFF)


def seeds(w: wordhash.Words, before: dict[int, int], window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text number, word position) of the minimizers of a slice; before: words of a text in former slices."""
    head = np.r_[0, np.flatnonzero(w.text[1:] != w.text[:-1]) + 1]
    tail = np.r_[head[1:], len(w.text)]
    n = tail - head
    room = n + window + K
    base = np.cumsum(room) - room
    at = np.arange(len(w.text)) + np.repeat(base - head, n)
    h = np.zeros(int(room.sum()), np.uint64)
    h[at] = w.hash
    k = sum((h[j : len(h) - K + 1 + j] * _MULTIPLIERS[j] for j in range(K)), np.zeros(len(h) - K + 1, np.uint64))
    k = np.minimum(wordhash.mix(k), _LAST - np.uint64(1))
    inside = np.zeros(len(h) + 1, np.int32)
    many = n >= K
    np.add.at(inside, base[many], 1)
    np.add.at(inside, (base + n - K + 1)[many], -1)
    k[np.cumsum(inside)[: len(k)] == 0] = _LAST
    padded = np.r_[np.full(window - 1, _LAST), k, np.full(window - 1, _LAST)]
    low = np.lib.stride_tricks.sliding_window_view(padded, window).min(1)
    full = np.zeros(len(low), bool)  # windows within one text, or all of a short one
    counts = np.maximum(n - K + 1, 0)
    begin = base + window - 1
    span = np.maximum(counts - window + 1, (counts > 0).astype(np.int64))
    mark = np.zeros(len(low) + 1, np.int32)
    np.add.at(mark, begin[span > 0], 1)
    np.add.at(mark, (begin + span)[span > 0], -1)
    full = np.cumsum(mark)[: len(low)] > 0
    low = np.where(full, low, np.uint64(0))
    high = np.lib.stride_tricks.sliding_window_view(low, window).max(1)[: len(k)]
    pick = np.flatnonzero((k == high) & (k != _LAST))
    owner = np.searchsorted(base, pick, "right") - 1
    text = w.text[head[owner]]
    pos = pick - base[owner] + np.array([before.get(int(t), 0) for t in w.text[head]], np.int64)[owner]
    for t, c in zip(w.text[head].tolist(), n.tolist(), strict=True):
        before[t] = before.get(t, 0) + c
    h = k[pick]
    new = np.r_[True, (h[1:] != h[:-1]) | (text[1:] != text[:-1]) | (pos[1:] != pos[:-1] + 1)] if len(h) else np.zeros(0, bool)
    begin = np.flatnonzero(new)
    length = np.diff(np.r_[begin, len(h)])
    at, kind = [begin], [h[begin]]
    for s in range(JOIN_GAP - 3, int(length.max(initial=0)), JOIN_GAP - 3):  # a run has seeds of its own, close enough to be joined
        long = begin[length > s]
        at += [long, long + s]
        kind += [wordhash.mix(h[long] + np.uint64(s)), wordhash.mix(h[long] ^ np.uint64(s << 32))]
    where = np.concatenate(at)
    return np.concatenate(kind) & _SEED, text[where], pos[where]


def _groups(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For rows sorted by h, doc: where each row's seed begins, where its text begins there, where the text before it does (or -1)."""
    at = np.arange(len(h))
    new = np.r_[True, h[1:] != h[:-1]] if len(h) else np.zeros(0, bool)
    other = new | np.r_[True, doc[1:] != doc[:-1]] if len(h) else new
    first = np.maximum.accumulate(np.where(new, at, 0)) if len(h) else at
    own = np.maximum.accumulate(np.where(other, at, 0)) if len(h) else at
    before = np.where(own > first, own[np.maximum(own - 1, 0)], -1)
    return first, own, before


def link(first: np.ndarray, own: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and what each is linked to: the first place of the text before, and that of the first text."""
    later = np.flatnonzero(before >= 0)
    far = later[first[later] != before[later]]
    return np.r_[later, far], np.r_[before[later], first[far]]


_NAMES = ["route", "doc", "at", "other"]


def _rows(route, doc, at, other):
    return pa.RecordBatch.from_arrays([pa.array(route), pa.array(doc), pa.array(at), other], names=_NAMES)


def _pack(pos: np.ndarray, other: np.ndarray) -> np.ndarray:
    return (pos.astype(np.int64) << 32) | other.astype(np.int64)


def _collect(batches):
    """Open rows (route: seed, other: null, at: place and whether texts share the seed) and finished links (route: the text's hash) of one task."""
    held, size = [], 0

    def flush():
        h, doc, pos = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort([pos, doc, h])
        h, doc, pos = h[order], doc[order], pos[order]
        one = np.r_[True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1]) | (pos[1:] != pos[:-1])]
        h, doc, pos = h[one], doc[one], pos[one]
        first, own, before = _groups(h, doc)
        shared = np.zeros(len(h), bool)
        shared[first[before >= 0]] = True  # by the seed's first row
        go = np.flatnonzero(before < 0)  # every place of the first text
        yield _rows(h[go].view(np.int64), doc[go], _pack(pos[go], shared[first[go]]), pa.nulls(len(go), pa.int64()))
        rows, to = link(first, own, before)
        if len(rows):
            yield _rows(wordhash.mix(doc[rows].view(np.uint64)).view(np.int64), doc[rows], _pack(pos[rows], pos[to]), pa.array(doc[to]))

    for batch in batches:
        ids = batch.column(0).to_numpy()
        before: dict[int, int] = {}
        for piece in wordhash.cut(texts(batch.column(1))):
            w = wordhash.words(piece)
            if not len(w.hash):
                continue
            h, text, pos = seeds(w, before, EVERY)
            held.append((h, ids[text], pos))
            size += len(h)
            if size >= HELD:
                yield from flush()
                held, size = [], 0
    if size:
        yield from flush()


def _join(batches):
    """Reads rows sorted by route, doc, at: passes finished links on and links what shares a seed.

    A later place in a seed's first text is linked to that text's first place, where other texts share the seed.
    """
    kept = None  # of the seed that may go on: rows that its next rows are linked to or that are still open
    for batch in batches:
        route, doc, at = (batch.column(i).to_numpy() for i in range(3))
        open_ = batch.column(3).is_null().to_numpy(zero_copy_only=False)
        done = np.flatnonzero(~open_)
        if len(done):
            yield pa.RecordBatch.from_arrays([batch.column(1).take(pa.array(done)), batch.column(2).take(pa.array(done)), batch.column(3).take(pa.array(done))], names=["doc", "at", "other"])
        route, doc, pos, shared = route[open_], doc[open_], at[open_] >> 32, (at[open_] & 1).astype(bool)
        known = np.zeros(len(route), bool)
        if not len(route):
            continue
        if kept is not None and kept[0][0] == route[0]:
            route, doc, pos, shared, known = (np.r_[x, y] for x, y in zip(kept, (route, doc, pos, shared, known), strict=True))
        first, own, before = _groups(route, doc)
        many = np.zeros(len(route), bool)
        many[first[shared | (before >= 0)]] = True
        many = many[first]
        again = np.r_[False, (route[1:] == route[:-1]) & (doc[1:] == doc[:-1]) & (pos[1:] == pos[:-1])]
        rows, to = link(first, own, before)
        own_rows = np.flatnonzero((before < 0) & (first != np.arange(len(route))) & many)
        rows, to = np.r_[rows, own_rows], np.r_[to, first[own_rows]]
        new = ~(known | again)[rows]
        rows, to = rows[new], to[new]
        if len(rows):
            yield pa.RecordBatch.from_arrays([pa.array(doc[rows]), pa.array(_pack(pos[rows], pos[to])), pa.array(doc[to])], names=["doc", "at", "other"])
        f = int(first[-1])
        keep = {f, int(own[-1]), max(int(before[-1]), f)}
        settled = bool(many[f])
        if not settled:  # all of one text, whose other places wait for a second one
            keep |= set(np.flatnonzero((first == f) & ~again).tolist())
        k = np.array(sorted(keep))
        kept = route[k], doc[k], pos[k], np.full(len(k), settled), np.full(len(k), settled) | (k == f)


class Fenwick:
    """Greatest (value, item) over prefixes."""

    def __init__(self, n: int):
        self.best = [(-1e18, -1)] * (n + 1)

    def put(self, i: int, value: float, item: int) -> None:
        i += 1
        while i < len(self.best):
            if value > self.best[i][0]:
                self.best[i] = value, item
            i += i & -i

    def get(self, i: int) -> tuple[float, int]:
        """Over places 0 .. i - 1."""
        out = (-1e18, -1)
        while i > 0:
            if self.best[i][0] > out[0]:
                out = self.best[i]
            i -= i & -i
        return out


def runs(pos: np.ndarray, other: np.ndarray) -> list[tuple[int, int, int]]:
    """(begin, begin in the other, words) of seeds that lie close on one diagonal."""
    diagonal = pos - other
    order = np.lexsort([pos, diagonal])
    p, d = pos[order], diagonal[order]
    new = np.r_[True, (d[1:] != d[:-1]) | (p[1:] - p[:-1] > JOIN_GAP)]
    begin = np.flatnonzero(new)
    end = np.r_[begin[1:], len(p)] - 1
    return sorted(zip(p[begin].tolist(), (p[begin] - d[begin]).tolist(), (p[end] - p[begin] + K).tolist(), strict=True))


def chains(segments: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """Collinear chains of segments sorted by begin, best first, each segment in one; gaps cost GAP_COST a word on either side."""
    if len(segments) == 1:
        return [segments]
    ends = sorted({b + n for _, b, n in segments})
    place = {e: i for i, e in enumerate(ends)}
    tree, score, back = Fenwick(len(ends)), [0.0] * len(segments), [-1] * len(segments)
    by_end = sorted(range(len(segments)), key=lambda i: segments[i][0] + segments[i][2])
    done = 0
    from bisect import bisect_right

    for j, (a, b, n) in enumerate(segments):
        while done < len(by_end) and sum(segments[by_end[done]][::2]) <= a + K and by_end[done] < j:
            i = by_end[done]
            ia, ib, m = segments[i]
            tree.put(place[ib + m], score[i] + GAP_COST * (ia + m + ib + m), i)
            done += 1
        value, i = tree.get(bisect_right(ends, b + K))
        gain = value - GAP_COST * (a + b)
        score[j], back[j] = (n + gain, i) if i >= 0 and gain > 0 else (float(n), -1)
    out, used = [], [False] * len(segments)
    for j in sorted(range(len(segments)), key=lambda j: -score[j]):
        chain = []
        while j >= 0 and not used[j]:
            used[j] = True
            chain.append(segments[j])
            j = back[j]
        if chain:
            out.append(chain[::-1])
    return out


def _chain(batches):
    """Reads links sorted by doc, other: yields (doc, other, flat runs) of each chain that may be a passage."""

    def found(doc, other, at):
        edge = np.flatnonzero((doc[1:] != doc[:-1]) | (other[1:] != other[:-1])) + 1
        begin, end = np.r_[0, edge], np.r_[edge, len(doc)]
        pos, far = at >> 32, at & 0xFFFFFFFF
        wide = (end - begin >= 2) & (np.maximum.reduceat(pos, begin) - np.minimum.reduceat(pos, begin) + K >= SLACK)
        for s, e in zip(begin[wide].tolist(), end[wide].tolist(), strict=True):
            for chain in chains(runs(pos[s:e], far[s:e])):
                first, last = chain[0], chain[-1]
                if last[0] + last[2] - first[0] >= SLACK and last[1] + last[2] - first[1] >= SLACK:
                    yield int(doc[s]), int(other[s]), [x for r in chain for x in r]

    def emit(rows):
        d, o, r = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(o, pa.int64()), pa.array(r, pa.list_(pa.int64()))], names=["doc", "other", "runs"])

    held = None
    for batch in batches:
        doc, at, other = (batch.column(i).to_numpy() for i in range(3))
        if held is not None:
            doc, other, at = (np.r_[x, y] for x, y in zip(held, (doc, other, at), strict=True))
        same = (doc == doc[-1]) & (other == other[-1])
        cut = int(np.argmax(same))  # the last pair may go on
        held = doc[cut:], other[cut:], at[cut:]
        if cut and (rows := list(found(doc[:cut], other[:cut], at[:cut]))):
            yield emit(rows)
    if held is not None and (rows := list(found(*held))):
        yield emit(rows)


def common(x: list[int], y: list[int]) -> int:
    """Length of the longest common subsequence, a row of the table being the bits of one number."""
    places: dict[int, int] = {}
    for j, b in enumerate(y):
        places[b] = places.get(b, 0) | 1 << j
    row = full = (1 << len(y)) - 1
    for a in x:
        if hit := places.get(a, 0) & row:
            row = ((row + hit) | (row - hit)) & full
    return len(y) - row.bit_count()


def _same(a: np.ndarray, b: np.ndarray) -> int:
    """Words that agree from the start."""
    n = min(len(a), len(b))
    at, step = 0, 32
    while at < n:
        upto = min(n, at + step)
        bad = np.flatnonzero(a[at:upto] != b[at:upto])
        if len(bad):
            return at + int(bad[0])
        at, step = upto, step * 4
    return n


def _onward(a: np.ndarray, b: np.ndarray, reach: int = 12, least: int = 3) -> list[tuple[int, int, int]]:
    """Runs (place, place in b, words) that go on from the start over small edits."""
    out, i, j = [], 0, 0
    while True:
        ahead, other = a[i : i + reach + least].tolist(), b[j : j + reach + least].tolist()
        places: dict[tuple, list[int]] = {}
        for y in range(len(other) - least + 1):
            places.setdefault(tuple(other[y : y + least]), []).append(y)
        best = min(((x + y, x, y) for x in range(len(ahead) - least + 1) for y in places.get(tuple(ahead[x : x + least]), ()) if 0 < x + y < 2 * reach), default=None)
        if not best:
            return out
        i, j = i + best[1], j + best[2]
        n = _same(a[i:], b[j:])
        out.append((i, j, n))
        i, j = i + n, j + n


def _subsequence(x: list[int], y: list[int]) -> list[tuple[int, int]]:
    """Places of a longest common subsequence, each as early as can be."""
    known = set(y)
    if known.isdisjoint(x):
        return []
    rows = [[0] * (len(y) + 1)]
    for a in reversed(x):
        under = rows[-1]
        if a not in known:
            rows.append(under)
            continue
        row = [0] * (len(y) + 1)
        for j in range(len(y) - 1, -1, -1):
            row[j] = under[j + 1] + 1 if a == y[j] else max(under[j], row[j + 1])
        rows.append(row)
    rows.reverse()
    out, i, j = [], 0, 0
    while i < len(x) and j < len(y):
        if x[i] == y[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif rows[i + 1][j] >= rows[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def _stretches(a: np.ndarray, b: np.ndarray, exact: list[tuple[int, int, int]], least: int, similarity: float) -> list[tuple[int, int, int, int, int]]:
    """What align gives, of runs of equal words in order."""
    longest = int(sum(n for _, _, n in exact) * (1 / similarity - 1)) + JOIN_GAP  # a wider gap is in no passage that is similar enough
    gaps = []
    for (i, j, n), (x, y, _) in zip(exact, exact[1:], strict=False):
        left, right = a[i + n : x], b[j + n : y]
        wide = max(len(left), len(right))
        gaps.append((wide, common(left.tolist(), right.tolist()) if 0 < min(len(left), len(right)) and wide <= longest else 0))
    out, at = [], 0
    while at < len(exact):  # the longest similar stretch from each run on
        words = matched = exact[at][2]
        best = (at, matched) if words >= least else None
        for k in range(at + 1, len(exact)):
            wide, inner = gaps[k - 1]
            if wide > longest:
                break
            words, matched = words + wide + exact[k][2], matched + inner + exact[k][2]
            if words >= least and matched >= similarity * words:
                best = k, matched
        if best is None:
            at += 1
            continue
        k, matched = best
        out.append((exact[at][0], exact[k][0] + exact[k][2], exact[at][1], exact[k][1] + exact[k][2], matched))
        at = k + 1
    return out


def align(a: np.ndarray, b: np.ndarray, chain: list[tuple[int, int, int]], least: int, similarity: float) -> list[tuple[int, int, int, int, int]]:
    """(begin, end, begin in b, end in b, matched words) of the passages that a chain of runs supports."""
    exact: list[tuple[int, int, int]] = []
    for x, y, n in chain:
        for at in range(0, n, K):  # a run may hold edits: extend every part of it that agrees
            i, j = x + at, y + at
            if exact and i < exact[-1][0] + exact[-1][2]:
                continue
            if i < 0 or j < 0 or i >= len(a) or j >= len(b) or a[i] != b[j]:
                continue
            ahead = _same(a[i:], b[j:])
            behind = _same(a[:i][::-1], b[:j][::-1])
            if exact:
                behind = min(behind, i - exact[-1][0] - exact[-1][2], j - exact[-1][1] - exact[-1][2])
                if behind < 0:
                    continue
            exact.append((i - behind, j - behind, ahead + behind))
    if not exact:
        return []
    i, j, n = exact[-1]
    exact += [(i + n + x, j + n + y, m) for x, y, m in _onward(a[i + n :], b[j + n :])]
    i, j, _ = exact[0]
    exact = [(i - x - m, j - y - m, m) for x, y, m in _onward(a[:i][::-1], b[:j][::-1])][::-1] + exact
    out = _stretches(a, b, exact, least, similarity)
    if not out:
        i, j, n = exact[-1]
        last = [(i + n + x, j + n + y, 1) for x, y in _subsequence(a[i + n : i + n + ENDS].tolist(), b[j + n : j + n + ENDS].tolist())]
        i, j, _ = exact[0]
        first = [(i - 1 - x, j - 1 - y, 1) for x, y in _subsequence(a[max(0, i - ENDS) : i][::-1].tolist(), b[max(0, j - ENDS) : j][::-1].tolist())][::-1]
        if first or last:
            out = _stretches(a, b, [*first, *exact, *last], least, similarity)
    return out


def _cut(t: bytes | None, held: tuple, begin: int, end: int, margin: int | None) -> tuple[tuple, int, bool, np.ndarray]:
    """(text and its word hashes, for the next call; first word, whether the text goes on, hashes) of the words around begin .. end."""
    if held[1] is None or held[0] != t:
        held = t, wordhash.hashes(t).view(np.int64)
    low, high = (0, len(held[1])) if margin is None else (max(0, begin - margin), end + margin)
    return held, low, high < len(held[1]), held[1][low:high]


def _excerpts(margin: int | None):
    """Adds to each chain the words around it: the first one's number, whether the text goes on, and their hashes."""

    def run(batches):
        for batch in batches:
            rows, held, at, size = [], (None, None), 0, 0
            runs_ = batch.column(2).to_pylist()
            for i, (flat, t) in enumerate(zip(runs_, texts(batch.column(3)), strict=True)):
                held, low, more, cut = _cut(t, held, flat[0], flat[-3] + flat[-1], margin)
                rows.append((low, more, cut.tobytes()))
                size += cut.nbytes
                if size > OUT or i == batch.num_rows - 1:
                    low, more, cut = zip(*rows, strict=True)
                    part = batch.slice(at, len(rows))
                    yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(3)), pa.array(low, pa.int64()), pa.array(more, pa.bool_()), pa.array(cut, pa.binary())], names=["doc", "other", "runs", "low", "more", "cut"])
                    rows, at, size = [], i + 1, 0

    return run


def _align(least: int, similarity: float, margin: int | None):
    """(doc, other, runs, found, open): found has 5 numbers for each passage of a chain; open where one ends at an excerpt's edge."""

    def run(batches):
        for batch in batches:
            runs_, lows, mores = (batch.column(i).to_pylist() for i in (2, 3, 4))
            found, open_, held = [], [], (None, None)
            for flat, low, more, mine, t in zip(runs_, lows, mores, texts(batch.column(5)), texts(batch.column(6)), strict=True):
                held, far, on, b = _cut(t, held, flat[1], flat[-2] + flat[-1], margin)
                a = np.frombuffer(mine, np.int64)
                chain = [(x - low, y - far, n) for x, y, n in zip(flat[::3], flat[1::3], flat[2::3], strict=True)]
                got = align(a, b, chain, least, similarity)
                found.append([x for s, e, p, q, m in got for x in (s + low, e + low, p + far, q + far, m)])
                open_.append(any((s == 0 and low > 0) or (p == 0 and far > 0) or (e == len(a) and more) or (q == len(b) and on) for s, e, p, q, _ in got))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(found, pa.list_(pa.int64())), pa.array(open_, pa.bool_())], names=["doc", "other", "runs", "found", "open"])

    return run


_CHAIN = "doc bigint, other bigint, runs array<bigint>"


def _aligned(chained: DataFrame, docs: DataFrame, least: int, similarity: float, margin: int | None) -> DataFrame:
    """Chains (doc, other, runs) with what _align finds; margin: words beyond a chain that are read, None for the whole texts.

    A text that many chains look up, as the first that has a common passage, is kept under several
    keys, so that no key has more than about PER_KEY chains.
    """
    total = chained.count()
    uses = cut_lineage(chained.groupBy("other").agg(F.ceil(F.count(F.lit(1)) / PER_KEY).cast("int").alias("salts")))
    mine = map_arrow(chained.join(docs, "doc").select("doc", "other", "runs", "_text"), _excerpts(margin), f"{_CHAIN}, low bigint, more boolean, cut binary")
    keyed = skew.lookup(mine, uses, "other", total).withColumn("salt", F.pmod(F.xxhash64("doc"), F.col("salts")).cast("int"))
    theirs = docs.withColumnRenamed("doc", "other").join(uses, "other").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    pairs = keyed.drop("salts").join(theirs.select("other", "salt", "_text"), ["other", "salt"]).select("doc", "other", "runs", "low", "more", "cut", "_text")
    return map_arrow(pairs, _align(least, similarity, margin), f"{_CHAIN}, found array<bigint>, open boolean")


def _passages(tried: DataFrame, *more: str) -> DataFrame:
    """(doc, other, start, end, other_start, other_end, matched) of every passage that chains have."""
    part = F.transform(F.sequence(F.lit(0), F.floor(F.size("found") / 5).cast("int") - 1), lambda i: F.slice("found", i * 5 + 1, F.lit(5)))
    rows = tried.where("size(found) > 0").select("doc", "other", *more, F.explode(part).alias("p"))
    return rows.select("doc", "other", *more, *(F.element_at("p", k + 1).alias(n) for k, n in enumerate(("start", "end", "other_start", "other_end", "matched"))))


def _cut_short(tried: DataFrame) -> DataFrame:
    """The chains of which a passage ends at its excerpt's edge and is not within a longer one of its text."""
    edge = _passages(tried.where("open"), "runs")
    whole = _passages(tried.where("not open")).select("doc", F.col("start").alias("low"), F.col("end").alias("high"))
    inside = (edge["doc"] == whole["doc"]) & (F.col("low") <= F.col("start")) & (F.col("high") >= F.col("end")) & (F.col("high") - F.col("low") > F.col("end") - F.col("start"))
    return edge.join(whole, inside, "left_anti").select("doc", "other", "runs").distinct()


def _steps(chained: DataFrame) -> DataFrame:
    """(doc, other, x, y, n) for each run of each chain."""
    place = lambda i, k: F.element_at("runs", (i * 3 + k).cast("int"))
    flat = F.transform(F.sequence(F.lit(0), F.floor(F.size("runs") / 3).cast("int") - 1), lambda i: F.struct(place(i, 1).alias("x"), place(i, 2).alias("y"), place(i, 3).alias("n")))
    return chained.select("doc", "other", F.explode(flat).alias("s")).select("doc", "other", "s.*")


def _carried(failed: DataFrame, chained: DataFrame, least: int) -> DataFrame:
    """Seeds (doc, at, other) of chains that lead on to partners' partners, where several short chains lie side by side."""
    ends = failed.select("doc", "other", "runs", F.element_at("runs", 1).alias("begin"), (F.element_at("runs", -3) + F.element_at("runs", -1)).alias("end"))
    by = Window.partitionBy("doc").orderBy("begin", "end", "other")  # of one text
    upto = F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1))
    ends = ends.withColumn("new", F.coalesce((F.col("begin") > upto + JOIN_GAP).cast("int"), F.lit(1)))
    ends = ends.withColumn("island", F.sum("new").over(by))
    wide = ends.groupBy("doc", "island").agg((F.max("end") - F.min("begin")).alias("words"), F.min("other").alias("a"), F.max("other").alias("b")).where(F.col("words") >= least).where("a != b")
    steps = _steps(ends.join(wide.select("doc", "island"), ["doc", "island"], "left_semi"))
    onward = _steps(chained).select(F.col("doc").alias("other"), F.col("other").alias("beyond"), F.col("x").alias("u"), F.col("y").alias("v"), F.col("n").alias("m"))
    low, high = F.greatest("y", "u"), F.least(F.col("y") + F.col("n"), F.col("u") + F.col("m"))
    met = steps.join(onward, "other").where((high - low >= K) & (F.col("beyond") != F.col("doc")))
    met = met.select("doc", F.col("beyond").alias("other"), (F.col("x") + low - F.col("y")).alias("x"), (F.col("v") + low - F.col("u")).alias("y"), (high - low).alias("n"))
    both = met.unionByName(steps.select("doc", "other", "x", "y", "n"))
    at = lambda off: F.shiftleft(F.col("x") + off, 32).bitwiseOR(F.col("y") + off)
    every = F.sequence(F.lit(0).cast("long"), F.col("n") - K, F.lit(JOIN_GAP).cast("long"))
    return both.select("doc", "other", F.explode(F.array_union(every, F.array(F.col("n") - K))).alias("off"), "x", "y").select("doc", at(F.col("off")).alias("at"), "other").distinct()


def _chains(links: DataFrame) -> DataFrame:
    return cut_lineage(map_arrow(links.repartition("doc").sortWithinPartitions("doc", "other", "at"), _chain, _CHAIN))


def _chained(docs: DataFrame) -> DataFrame:
    """The chains of all texts; what was shuffled for them is given up."""
    found = map_arrow(docs, _collect, "route bigint, doc bigint, at bigint, other bigint")
    links = map_arrow(found.repartition("route").sortWithinPartitions("route", "doc", "at"), _join, "doc bigint, at bigint, other bigint")
    return _chains(links)


def find(df: DataFrame, id: str = "doc_id", text: str = "text", least: int = LEAST_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """Passages of `least` words or more that a text shares with an earlier one, by id.

    One row for each: doc_id, partner_id, start_word, end_word, partner_start, partner_end,
    n_matched, similarity (matched words over the longer side). Word ranges are half open; words
    are those of decontaminate. partner_id is the text that has the same seeds just before doc_id
    or first of all, so texts that share a passage are connected without listing all their pairs;
    every place of a passage in a text is reported. Of a passage that other texts share, later
    places in the first text are reported too, with that text as its own partner; a passage that
    repeats within one text alone is none. Ids are integers, any other type is a TypeError; a row
    without id or words has no passages, and rows that repeat an id are held to be one document.
    """
    if not isinstance(df.schema[id].dataType, IntegralType):
        raise TypeError(f"{id} must be of an integer type")
    docs = df.select(quoted(id).cast("long").alias("doc"), quoted(text).alias("_text")).where("doc is not null and _text is not null")
    chained = _chained(docs)
    drop_unused(df.sparkSession)
    named = chained.select("doc").unionByName(chained.select(F.col("other").alias("doc"))).distinct()
    some = rewritten(sieve.maybe(docs, named, "doc"))  # the texts that any chain needs
    tried = cut_lineage(_aligned(chained, some, least, similarity, 2 * least))
    failed = tried.where("size(found) = 0 and doc != other")
    longer = cut_lineage(_cut_short(tried))
    again = longer.unionByName(_chains(_carried(failed, chained, least)))
    tried = tried.join(longer, ["doc", "other", "runs"], "left_anti").unionByName(_aligned(cut_lineage(again), some, least, similarity, None))
    rows = _passages(tried).distinct()
    rows = cut_lineage(rows)
    between = rows.where("doc != other")
    places = between.select("doc", "start", "end").unionByName(between.select(F.col("other").alias("doc"), F.col("other_start").alias("start"), F.col("other_end").alias("end"))).distinct()
    places = places.select("doc", F.col("start").alias("low"), F.col("end").alias("high"))
    within = rows.where("doc = other")
    overlap = F.least("high", "end") - F.greatest("low", "start")
    other_overlap = F.least("high", "other_end") - F.greatest("low", "other_start")
    within = within.join(places, (within["doc"] == places["doc"]) & ((overlap >= least) | (other_overlap >= least)), "left_semi")
    out = between.unionByName(within)
    longer = F.greatest(F.col("end") - F.col("start"), F.col("other_end") - F.col("other_start"))
    return out.select(
        F.col("doc").alias("doc_id"),
        F.col("other").alias("partner_id"),
        F.col("start").alias("start_word"),
        F.col("end").alias("end_word"),
        F.col("other_start").alias("partner_start"),
        F.col("other_end").alias("partner_end"),
        F.col("matched").alias("n_matched"),
        (F.col("matched") / longer).alias("similarity"),
    )


def strip(df: DataFrame, found: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """id and the text without the passages that found gives for it, which an earlier text keeps; rows without passages stay as they are."""
    spans = found.groupBy(F.col("doc_id").alias("_doc")).agg(F.array_sort(F.collect_set(F.struct("start_word", "end_word"))).alias("_spans"))  # of one text
    rows = df.select(F.col(id), F.col(text)).join(spans, F.col(id) == F.col("_doc"), "left").select(F.col(id), F.col(text), "_spans")

    def run(batches):
        for batch in batches:
            out = []
            for t, spans_ in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                places = offsets(t, merge([(s["start_word"], s["end_word"]) for s in spans_])) if spans_ else []
                for a, b in reversed(places):
                    t = t[:a] + t[b:]
                out.append(t)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=[id, text])

    return map_arrow(rows, run, f"`{id}` {df.schema[id].dataType.simpleString()}, `{text}` string")
