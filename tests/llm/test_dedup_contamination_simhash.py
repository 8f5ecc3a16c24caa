import random

import pytest
import xxhash
from pyspark.sql import functions as F

from spindrift.llm import decontaminate, exact_dedup, graph, sieve, simhash

SCHEMA = "doc_id bigint, text string, _digest string, node bigint, u int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], SCHEMA)


def brute_fingerprint(text):
    words = [w for w in (text or "").encode().lower().split()]
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)) if h else 0


def brute_components(ids, linked):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in linked:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def corpus(seed=3):
    rng = random.Random(seed)
    words = ["w%d" % i for i in range(400)]
    base = [[rng.choice(words) for _ in range(rng.randint(1, 200))] for _ in range(25)]
    rows = []
    for i in range(150):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = rng.choice(words)
        rows.append((i, " ".join(w)))
    return [*rows, (1000, None), (1001, ""), (1002, " \t\n"), (1003, "one"), (1004, "ONE"), (1005, "É é x")]


def test_exact_dedup_matches_brute_force(spark):
    rows = [*corpus(), (7, "dup"), (7, "dup"), (None, "only"), (None, "w1"), (1006, "ÉA"), (1007, "Éa"), (1008, "éa")]
    low = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in (t or ""))
    for digest in (exact_dedup.sha256, lambda c: F.substring(F.sha2(c, 256), 1, 2)):  # the second clashes all the time
        got = exact_dedup.classes(docs(spark, rows), digest=digest).collect()
        want = []
        for i, t in rows:
            ids = [j for j, u in rows if low(u) == low(t)]
            keep = max((j for j in ids if j is not None), default=None)
            want.append((i, keep, len(ids), i == keep))
        assert sorted(map(str, [(r.doc_id, r.keep_id, r.group_size, r.kept) for r in got])) == sorted(map(str, want))


def test_sieve_is_exact(spark):
    df = spark.range(3000).select(F.col("id").cast("string").alias("k"), F.col("id").alias("_digest")).unionByName(spark.createDataFrame([(None, 1)], "k string, _digest bigint"))
    keys = df.where("_digest % 7 = 0").select("k")
    assert {r.k for r in sieve.among(df, keys, "k", bits=1 << 16).collect()} == {str(i) for i in range(0, 3000, 7)}
    assert sieve.without(df, keys, "k", bits=1 << 16).count() == 3001 - len(range(0, 3000, 7))
    assert sieve.marked(df, keys, "k").where("may").count() < 600
    assert sieve.bits_for(0) == sieve.LEAST and sieve.bits_for(10**12) == sieve.MOST and sieve.bits_for(10**6) >= 16 * 10**6


NAMES = "row key may page byte low bit map k0 _page _byte _low _may _digest _salt _content _q_n_words n_words fp root node component_id id kept n u v a.b x`y".split()


def test_no_column_name_clashes(spark):
    """Whatever the caller's columns are named, they come back as they were."""
    from spindrift.llm import quality

    rows = [(1, "same text"), (2, "Same text"), (3, "another one here"), (4, "another one here"), (5, None)]
    df = spark.createDataFrame([(i, t, *(f"{n}{i}" for n in NAMES)) for i, t in rows], ["doc_id", "text", *NAMES])
    keys = spark.createDataFrame([(1,), (4,)], "x bigint")
    model = quality.Model(0.0, [((quality.Condition("n_words", True, 2.0),), 3.0)])
    item = spark.createDataFrame([("i", "another one here")], "item_id string, text string")
    for got, ids in (
        (sieve.without(df, keys, "doc_id"), [2, 3, 5]),
        (sieve.among(df, keys, "doc_id"), [1, 4]),
        (sieve.maybe(df, keys, "doc_id"), [1, 4]),
        (sieve.once(df.unionByName(df), df.select("doc_id"), "doc_id"), [1, 2, 3, 4, 5]),
        (exact_dedup.deduplicate(df.unionByName(df)), [2, 4, 5]),
        (simhash.representatives(df.unionByName(df)), [1, 3, 5]),
        (quality.accept(df, model, 0.9), [3, 4]),
        (decontaminate.clean(df, item), [1, 2, 5]),
    ):
        assert got.columns == df.columns
        assert sorted(map(tuple, got.collect()), key=str) == sorted((tuple(r) for r in df.collect() if r.doc_id in ids), key=str)


def test_one_id_on_two_texts(spark):
    rows = [(5, "a"), (5, "b"), (9, "B"), (6, "a")]
    assert sorted(tuple(r)[:2] for r in exact_dedup.deduplicate(docs(spark, rows)).collect()) == [(6, "a"), (9, "B")]
    rows = [(9, "a"), (9, "b"), (5, "a"), (10, "b"), (10, "c")]
    assert sorted(tuple(r)[:2] for r in exact_dedup.deduplicate(docs(spark, rows)).collect()) == [(9, "a"), (10, "b"), (10, "c")]
    one, two = "red green blue " * 9, "quite another text of other words " * 5
    rows = [(5, one), (5, two), (3, two), (9, one), (5, two)]
    kept = simhash.representatives(docs(spark, rows))
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == [(3, two), (5, one)]


def test_hub_nodes_and_hot_keys(spark, monkeypatch):
    from spindrift.llm import skew

    monkeypatch.setattr(skew, "LEAST", 3)
    rng = random.Random(4)
    edges = [(1000, i) for i in range(200)] + [(2000 + i, 1000 + i) for i in range(50)] + [(rng.randrange(3000, 3100), rng.randrange(3000, 3100)) for _ in range(80)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    ok = [(a, b) for a, b in edges if a != b]
    assert got == brute_components({x for e in ok for x in e}, ok)
    rows = spark.createDataFrame([(1, i) for i in range(50)] + [(2, 0), (None, 1), (3, 1)], "k int, v int")
    table = spark.createDataFrame([(1, "a"), (2, "b"), (7, "c")], "k int, w string")
    assert sorted((r.k, r.v, r.w) for r in skew.lookup(rows, table, "k", 53).collect()) == sorted([(1, i, "a") for i in range(50)] + [(2, 0, "b")])


def test_exact_dedup_keeps_columns_and_one_of_repeats(spark):
    rows = [(1, "a"), (2, "A"), (2, "A"), (3, None), (4, ""), (None, "q")]
    got = exact_dedup.deduplicate(docs(spark, rows))
    assert got.columns == ["doc_id", "text", "_digest", "node", "u"]
    assert sorted(str(r.doc_id) for r in got.collect()) == ["2", "4", "None"]
    assert exact_dedup.deduplicate(docs(spark, [])).count() == 0


def brute_hits(rows, items, width=10):
    split = lambda t: decontaminate.words((t or "").encode())
    wins = {(tuple(w), i) for i, t in items for w in decontaminate.windows(split(t), width)}
    out = {}
    for d, t in rows:
        w, hit, names = split(t), set(), set()
        for win, i in wins:
            for p in range(len(w) - len(win) + 1):
                if tuple(w[p : p + len(win)]) == win:
                    hit.update(range(p, p + len(win)))
                    names.add(str(i))
        out[d] = len(w), len(hit), sorted(names)
    return out


@pytest.mark.parametrize("limit", [1 << 20, 1])
def test_decontamination_matches_brute_force(spark, limit):
    rng = random.Random(5)
    words = ["a", "b", "é", "7", "Zz"]
    item = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(1, item(14)), (2, item(3)), (2, item(12)), (3, "--"), (4, None), (None, item(2)), (10, "Solo")]
    text = lambda: ", ".join([item(40), "solo!", items[0][1].upper()])
    rows = [(1, text()), (2, item(60)), (3, None), (4, ""), (5, "solos sol"), (6, "SOLO"), (7, "b " * 30)]
    got = decontaminate.find(docs(spark, rows), spark.createDataFrame(items, "item_id int, text string"), limit=limit).collect()
    want = brute_hits(rows, [x for x in items if x[0] is not None and x[1] is not None])
    assert {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in got} == want
    for r in got:
        t = dict(rows)[r.doc_id] or ""
        cut = [w for s in r.spans for w in decontaminate.words(t[s.start : s.end].encode())]
        assert len(cut) == r.n_hit


def test_blocks_cross_windows(monkeypatch):
    tree = decontaminate.Automaton([("i", b"x y x"), ("j", b"y z z z z"), ("k", b"q")], 3)
    text = b"x y x " * 40 + b"z " * 9 + b"x y x q y z z z z z q"
    whole = decontaminate.scan(text, tree)
    assert whole[2] == {"i", "j", "k"}
    monkeypatch.setattr(decontaminate.blocks, "__defaults__", (5,))
    assert decontaminate.scan(text, tree) == whole


@pytest.mark.parametrize("width", [1, 2, 3, 7, 10])
def test_block_automaton_matches_brute_force(width):
    rng = random.Random(width)
    for _ in range(150):
        words = "abc"[: rng.randint(1, 3)]
        item = lambda n: " ".join(rng.choice(words) for _ in range(n))
        items = [(str(i), item(rng.randint(0, 25))) for i in range(4)]
        rows = [(0, item(rng.randint(0, 60)) + rng.choice(["", " " + items[0][1]]))]
        tree = decontaminate.Automaton([(i, t.encode()) for i, t in items], width)
        n, spans, names = decontaminate.scan(rows[0][1].encode(), tree)
        assert (n, sum(b - a for a, b in spans), sorted(names)) == brute_hits(rows, items, width)[0]


def test_clean_without_items_keeps_all(spark):
    none = spark.createDataFrame([], "item_id int, text string")
    kept = decontaminate.clean(docs(spark, [(1, "a"), (None, "b")]), none)
    assert kept.count() == 2 and kept.columns == ["doc_id", "text", "_digest", "node", "u"]
    item = spark.createDataFrame([(1, "b c")], "item_id int, text string")
    assert [r.doc_id for r in decontaminate.clean(docs(spark, [(1, "a b, C!"), (2, "b"), (3, None)]), item).collect()] == [2, 3]


def test_masks_cover_every_pair_within_the_radius():
    rng = random.Random(1)
    table = simhash.masks(4)
    assert len(set(table)) == 31 and min(m.bit_count() for m in table) >= 30
    for _ in range(3000):
        d = sum(1 << i for i in rng.sample(range(64), rng.randint(1, 4)))
        assert any(m & d == 0 for m in table)


@pytest.mark.parametrize("bucket", [4096, 3])
def test_simhash_matches_brute_force(spark, bucket):
    rows = corpus()
    got = {r.doc_id: r for r in simhash.link(docs(spark, rows), bucket=bucket).collect()}
    fps = {i: brute_fingerprint(t) for i, t in rows}
    assert {i: r.fp & (1 << 64) - 1 for i, r in got.items()} == fps
    want = brute_components(fps, [(a, b) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= 4])
    assert {i: r.component_id for i, r in got.items()} == want
    kept = simhash.representatives(docs(spark, rows), bucket=bucket)
    assert {r.doc_id for r in kept.collect()} == set(want.values()) and kept.columns == ["doc_id", "text", "_digest", "node", "u"]


@pytest.mark.parametrize("radius", [1, 2, 3])
@pytest.mark.parametrize("bucket", [4096, 3])
def test_edges_at_other_radii(spark, radius, bucket):
    rng = random.Random(radius)
    codes = {rng.getrandbits(64) for _ in range(4)}
    for _ in range(120):
        x = rng.choice(sorted(codes))
        for _ in range(rng.randint(1, radius + 2)):
            x ^= 1 << rng.randrange(64)
        codes.add(x)
    codes = [simhash.signed(x) for x in sorted(codes)]
    got = simhash.edges(spark.createDataFrame([(x,) for x in codes], "fp long"), radius, bucket).collect()
    distance = lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count()
    near = [(a, b) for a in codes for b in codes if a < b and distance(a, b) <= radius]
    assert brute_components(codes, [(r.a, r.b) for r in got]) == brute_components(codes, near)


def test_simhash_of_nothing_and_of_null_ids(spark):
    assert simhash.link(docs(spark, [])).count() == 0
    assert simhash.representatives(docs(spark, [(None, "a b"), (1, "a b"), (1, "a b"), (2, "a b")])).count() == 2


def test_long_text_in_blocks(monkeypatch):
    text = " ".join("w%d" % (i % 977) for i in range(5000))
    whole = simhash.fingerprint(text.encode())
    monkeypatch.setattr(simhash, "BLOCK", 64)
    assert simhash.fingerprint(text.encode()) == whole == brute_fingerprint(text)


def test_components_of_paths_and_stars(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 160)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)] + [(5, 5), (None, 3)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    ok = [(a, b) for a, b in edges if a is not None and a != b]
    assert got == brute_components({x for e in ok for x in e}, ok)
