import random

import numpy as np

from spindrift.llm import passages, wordhash
from spindrift.llm.decontaminate import words

SCHEMA = "doc_id bigint, text string, doc int, _text string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x") for i, t in rows], SCHEMA)


def filler(rng, n):
    return ["w%d" % rng.randrange(100_000) for _ in range(n)]


def edited(rng, w, share):
    out = []
    for x in w:
        r = rng.random()
        out += [] if r < share / 3 else [x, "ins%d" % rng.randrange(1000)] if r < 2 * share / 3 else ["sub%d" % rng.randrange(1000)] if r < share else [x]
    return out


def test_seeds_are_the_minimizers():
    rng = random.Random(1)
    batch = [" ".join(filler(rng, n)).encode() for n in (3, 5, 6, 12, 13, 40, 200)]
    for piece in wordhash.cut(batch):
        w = wordhash.words(piece)
        h, text, pos = passages.seeds(w, {})
        for t in range(len(batch)):
            own = w.hash[w.text == t]
            k = [int(wordhash.mix(np.array([sum(int(own[i + j]) * int(passages._MULTIPLIERS[j]) for j in range(5)) % 2**64], np.uint64))[0]) for i in range(len(own) - 4)]
            want = {s + min(range(len(win)), key=win.__getitem__) for s in range(max(1, len(k) - 7)) if (win := k[s : s + 8])}
            assert set(pos[text == t].tolist()) == want and {int(x) for x in h[text == t]} == {k[i] % 2**48 for i in want}


def brute_chain(segments):
    best = [0.0] * len(segments)
    for j, (a, b, n) in enumerate(segments):
        best[j] = n
        for i, (x, y, m) in enumerate(segments[:j]):
            if x + m <= a + passages.K and y + m <= b + passages.K:
                best[j] = max(best[j], n + best[i] - passages.GAP_COST * (a - x - m + b - y - m))
    return max(best)


def test_fenwick_chains_score_like_the_quadratic_ones():
    rng = random.Random(2)
    for _ in range(300):
        segments = sorted({(rng.randrange(200), rng.randrange(200), rng.randint(5, 20)) for _ in range(rng.randint(1, 12))})
        got = passages.chains(segments)
        assert sorted(x for c in got for x in c) == segments
        first = got[0]
        score = first[0][2]
        for (x, y, m), (a, b, n) in zip(first, first[1:], strict=False):
            assert x + m <= a + passages.K and y + m <= b + passages.K
            score += n - passages.GAP_COST * (a - x - m + b - y - m)
        assert abs(score - brute_chain(segments)) < 1e-6


def test_common_subsequence_and_alignment():
    assert passages.common([1, 2, 3, 4], [2, 9, 4]) == 2 and passages.common([], [1]) == 0
    rng = np.random.default_rng(3)
    core = rng.integers(0, 10**6, 80)
    a = np.r_[rng.integers(10**6, 2 * 10**6, 30), core, rng.integers(10**6, 2 * 10**6, 20)]
    b = np.r_[rng.integers(2 * 10**6, 3 * 10**6, 10), core[:40], [7], core[42:], rng.integers(2 * 10**6, 3 * 10**6, 9)]
    (s, e, p, q, m), = passages.align(a, b, [(35, 15, 20)], 50, 0.8)
    assert (s, e, p, q, m) == (30, 110, 10, 89, 78)


def test_planted_passages_are_found(spark):
    rng = random.Random(4)
    exact, fuzzy, short, line = filler(rng, 60), filler(rng, 100), filler(rng, 30), filler(rng, 12)
    rows, planted = [], {"exact": [], "fuzzy": []}
    for i in range(120):
        body = line + filler(rng, rng.randint(20, 300))
        at = rng.randrange(len(body))
        if i % 6 == 0:
            body[at:at] = exact
            planted["exact"].append((i, at))
        elif i % 6 == 1:
            body[at:at] = edited(rng, fuzzy, 0.08)
            planted["fuzzy"].append((i, at))
        elif i % 6 == 2:
            body[at:at] = short
        rows.append((i, " ".join(body)))
    copy = rows[3][1]
    rows += [(500 + i, copy.upper()) for i in range(40)] + [(600, None), (601, ""), (602, "a " * 3000), (603, " ".join(short * 3)), (None, copy), (604, "a " * 2000)]
    df = docs(spark, rows).repartition(6)
    got = passages.find(df).collect()
    split = {i: words((t or "").encode()) for i, t in rows}
    for r in got:
        assert r.end_word - r.start_word >= 40 and r.similarity >= 0.8 and r.doc_id != r.partner_id
        assert r.end_word <= len(split[r.doc_id]) and r.partner_end <= len(split[r.partner_id])
        assert passages.common(split[r.doc_id][r.start_word : r.end_word], split[r.partner_id][r.partner_start : r.partner_end]) >= r.n_matched
    seen = {r.doc_id for r in got} | {r.partner_id for r in got}
    clean = {i for i in range(120) if i % 6 > 1 and i != 3} | {600, 601, 603}
    assert not seen & clean
    for kind in planted:
        ids = [i for i, _ in planted[kind]]
        root = {i: i for i in ids}

        def find(i):
            while root[i] != i:
                i = root[i]
            return i

        for r in got:
            if r.doc_id in root and r.partner_id in root:
                root[find(r.doc_id)] = find(r.partner_id)
        assert len({find(i) for i in ids}) == 1, kind
    assert {3, *range(500, 540)} <= seen and {602, 604} <= seen
    exact_rows = [r for r in got if r.doc_id in dict(planted["exact"]) and r.partner_id in dict(planted["exact"])]
    at = dict(planted["exact"])
    assert all(r.start_word <= at[r.doc_id] and r.end_word >= at[r.doc_id] + 60 for r in exact_rows)
    left = {r.doc_id: r.text for r in passages.strip(docs(spark, rows), passages.find(docs(spark, rows))).collect()}
    assert left[600] is None and left[2] == dict(rows)[2] and sum(" ".join(exact) in (t or "") for t in left.values()) == 1
    assert passages.find(docs(spark, [])).count() == 0


def test_links_stay_few_for_a_common_passage(spark):
    rng = random.Random(5)
    shared = filler(rng, 80)
    rows = [(i, " ".join(filler(rng, 20) + shared)) for i in range(300)]
    got = passages.find(docs(spark, rows).repartition(7)).collect()
    assert {r.doc_id for r in got} | {r.partner_id for r in got} == set(range(300)) and len(got) < 4 * 300


def test_long_text_in_slices(spark, monkeypatch):
    rng = random.Random(6)
    shared = filler(rng, 200)
    batch = [" ".join(filler(rng, 500) + shared).encode()]
    whole = [passages.seeds(wordhash.words(p), {}) for p in wordhash.cut(batch)]
    before, parts = {}, []
    for p in wordhash.cut(batch, 700):
        parts.append(passages.seeds(wordhash.words(p), before))
    assert before == {0: 700} and len(parts) > 3
    one, many = set(zip(*[x.tolist() for x in (whole[0][0], whole[0][2])], strict=True)), {(h, q) for x in parts for h, q in zip(x[0].tolist(), x[2].tolist(), strict=True)}
    assert len(one & many) > 0.8 * len(one)


def test_short_passages_with_many_edits_are_found(spark):
    rng = random.Random(7)
    rows, pairs = [], []
    for i in range(150):
        core = filler(rng, 50)
        changed = list(core)
        for at in rng.sample(range(1, 49), (5, 7, 9)[i % 3]):
            changed[at] = "sub%d" % rng.randrange(10**6)
        rows += [(2 * i, " ".join(filler(rng, 60) + core + filler(rng, 60))), (2 * i + 1, " ".join(filler(rng, 70) + changed + filler(rng, 40)))]
        pairs.append((2 * i, 2 * i + 1))
    got = passages.find(docs(spark, rows).repartition(5)).collect()
    found = {(min(r.doc_id, r.partner_id), max(r.doc_id, r.partner_id)) for r in got if r.end_word - r.start_word >= 50 and r.similarity >= 0.8}
    assert found <= set(pairs)
    for k in range(3):
        assert len(found & set(pairs[k::3])) >= 48  # of 50


def test_links_match_brute_force_however_rows_are_cut():
    """_collect and _join give the links of their docstrings, whatever the slices and batches."""
    import pyarrow as pa

    rng = random.Random(8)
    for _ in range(60):
        rows = sorted((s, d, 10 * s + p) for s, d, p in {(rng.randrange(6), rng.randrange(5), rng.randrange(4)) for _ in range(rng.randint(1, 40))})
        shared = {r: rng.random() < 0.2 for r in rows}
        want = set()
        for s in {r[0] for r in rows}:
            own = [r for r in rows if r[0] == s]
            ids = sorted({r[1] for r in own})
            start = {d: min(r[2] for r in own if r[1] == d) for d in ids}
            for _, d, p in own:
                if d != ids[0]:
                    want |= {(d, p, x, start[x]) for x in (ids[ids.index(d) - 1], ids[0])}
                elif p != start[d] and (len(ids) > 1 or any(shared[r] for r in own)):
                    want.add((d, p, d, start[d]))
        cut = [0, *sorted(rng.sample(range(1, len(rows)), min(len(rows) - 1, rng.randint(0, 9)))), len(rows)]
        batches = [passages._rows(np.array([r[0] for r in part]), np.array([r[1] for r in part]), np.array([r[2] << 32 | shared[r] for r in part]), pa.nulls(len(part), pa.int64())) for part in (rows[a:b] for a, b in zip(cut, cut[1:], strict=False))]
        got = [(d, at >> 32, o, at & 0xFFFFFFFF) for b in passages._join(iter(batches)) for d, at, o in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        first = {s: min(r[1] for r in rows if r[0] == s) for s in {r[0] for r in rows}}
        assert set(got) <= want and len(got) == len(set(got))
        missing = want - set(got)  # at a batch's edge the text before may be passed over, never the first
        assert all(w[2] != w[0] and w[2] not in first.values() for w in missing), missing


def occurrences(got):
    """Ranges by text that the rows name, on either side."""
    out = {}
    for r in got:
        out.setdefault(r.doc_id, []).append((r.start_word, r.end_word))
        out.setdefault(r.partner_id, []).append((r.partner_start, r.partner_end))
    return out


def covered(spans, a, b):
    inside = {x for s, e in spans for x in range(max(a, s), min(b, e))}
    return len(inside) >= 0.9 * (b - a)


def test_second_copies_in_a_text_are_found(spark):
    rng = random.Random(9)
    shared, own = filler(rng, 80), filler(rng, 70)
    rows, at = [], {}
    for i in range(2, 6):
        body, places = filler(rng, 50), []
        for _ in range(2 if i % 2 else 3):
            places.append(len(body))
            body += shared + filler(rng, rng.randint(60, 150))
        rows.append((i, " ".join(body)))
        at[i] = places
    rows.append((9, " ".join(own + filler(rng, 60) + own + filler(rng, 20))))  # within one text alone
    got = passages.find(docs(spark, rows).repartition(3)).collect()
    seen = occurrences(got)
    assert all(covered(seen[i], a, a + 80) for i in at for a in at[i]) and 9 not in seen
    left = [r.text for r in passages.strip(docs(spark, rows), passages.find(docs(spark, rows))).collect()]
    assert sum(t.count(" ".join(shared[10:70])) for t in left) == 1


def test_long_passages_are_whole(spark):
    """A passage that goes on far beyond the seeds that two texts are linked by."""
    rng = random.Random(10)
    long, mid = filler(rng, 900), filler(rng, 700)
    rows = [(1, " ".join(filler(rng, 40) + long)), (2, " ".join(long[300:360] + filler(rng, 200) + mid)), (3, " ".join(filler(rng, 20) + long + filler(rng, 30))), (4, " ".join(mid + long[:500]))]
    got = passages.find(docs(spark, rows)).collect()
    assert any((r.doc_id, r.partner_id, r.start_word, r.end_word) == (3, 1, 20, 920) for r in got)
    assert any((r.doc_id, r.partner_id) == (4, 2) and r.end_word - r.start_word >= 700 for r in got)


def test_passages_made_of_common_lines(spark):
    """A text shares 60 words with one far off, while nearer texts have parts of them only."""
    rng = random.Random(11)
    rows, want = [], []
    for i in range(30):
        whole = filler(rng, 60)
        rows.append((i, " ".join(filler(rng, 30) + whole + filler(rng, 30))))
        rows.append((1000 + 10 * i, " ".join(filler(rng, 40) + whole[:35] + filler(rng, 40))))
        rows.append((1001 + 10 * i, " ".join(filler(rng, 40) + whole[25:] + filler(rng, 40))))
        rows.append((1002 + 10 * i, " ".join(filler(rng, 25) + whole + filler(rng, 25))))
        want.append((1002 + 10 * i, i))
    for parts in (1, 2, 7):
        df = docs(spark, rows).repartitionByRange(parts, "doc_id")
        got = {(r.doc_id, r.partner_id) for r in passages.find(df).collect() if r.end_word - r.start_word >= 60}
        assert set(want) <= got, parts


def test_find_against_all_pairs(spark):
    """Every pair of texts, aligned in full, against find: fuzzy recall by components of texts that share a passage."""
    rng = random.Random(12)
    rows, groups = [], []
    for g in range(60):
        core = filler(rng, rng.randint(50, 90))
        members = []
        for _ in range(rng.randint(2, 4)):
            changed = list(core)
            for at in rng.sample(range(len(core)), rng.randint(0, len(core) // 10)):
                changed[at] = "sub%d" % rng.randrange(10**6)
            members.append(len(rows))
            rows.append((len(rows), " ".join(filler(rng, rng.randint(0, 80)) + changed + filler(rng, rng.randint(0, 80)))))
        groups.append(members)
    got = passages.find(docs(spark, rows).repartition(4)).collect()
    linked = {(min(r.doc_id, r.partner_id), max(r.doc_id, r.partner_id)) for r in got}
    near = {(a, b) for m in groups for a in m for b in m if a < b and passages.common(*([hash(w) for w in rows[x][1].split()] for x in (a, b))) >= 40}
    assert linked <= {(a, b) for m in groups for a in m for b in m if a < b}
    joined = sum(1 for m in groups if all(any(p in linked for p in ((min(x, y), max(x, y)) for y in m if y != x)) for x in m))
    print(f"{joined} of {len(groups)} groups whole, {len(near & linked)} of {len(near)} pairs linked directly")
    assert joined >= 0.9 * len(groups)


def test_ids_must_be_integers(spark):
    import pytest

    with pytest.raises(TypeError):
        passages.find(spark.createDataFrame([("a", "b")], "doc_id string, text string"))
