import json
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from spindrift.llm import language, packing, quality, tokens, toxicity, wordhash
from spindrift.llm.decontaminate import words as split_words

JSON = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id bigint, text string, lang string, start int, score string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, g, 1, "x") for i, t, g in rows], SCHEMA)


def prose(rng, parts, n):
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(n)) + "."


TONGUES = {"aa": ["ka", "lo", "mi", "tar"], "bb": ["sch", "ung", "ein", "ö"], "cc": ["ció", "ñe", "ral", "do"]}


def test_words_and_grams_match_plain_python():
    rng = random.Random(1)
    batch = [None, b"", b"...", *(("%s, É%s" % (prose(rng, list("aBç9-"), 30), "x" * 5000)).encode() for _ in range(5))]
    seen, plain = [], []
    for piece in wordhash.cut(batch, 200):
        w = wordhash.words(piece)
        seen += [(int(t), bytes(w.letters[f : f + s]), int(h)) for t, f, s, h in zip(w.text, w.first, w.size, w.hash, strict=True)]
        one, back, n = w.distinct()
        assert n.sum() == len(w.hash) and (one.hash[back] == w.hash).all()
        keys, begin, per = wordhash.grams(one, 3)
        for f, s, b, p in zip(one.first, one.size, begin, per, strict=True):
            padded = b"  " + bytes(one.letters[f : f + s]) + b" "
            assert [int.from_bytes(padded[i : i + 3], "big") for i in range(s + 1)] == keys[b : b + p].tolist()
    for i, t in enumerate(batch):
        plain += [(i, x) for x in split_words(t or b"")]
    assert [(t, x) for t, x, _ in seen] == plain
    assert len({h for _, _, h in seen}) == len({x for _, x, _ in seen})
    c = wordhash.Counts(3)
    for _ in range(5):
        c.add(np.array([1, 1, 7], np.uint64), np.array([1, 2, 5]))
    assert [x.tolist() for x in c.take()] == [[1, 7], [15, 25]] and len(c.take()[0]) == 0


def test_toxic_words_raise_the_score(spark):
    rng = random.Random(2)
    bad = ["vexor", "grummel", "snitz"]
    rows, labels = [], []
    for i in range(600):
        w = prose(rng, TONGUES["aa"], 60).split()
        if i % 4 == 0:
            for _ in range(3):
                w[rng.randrange(60)] = rng.choice(bad) + rng.choice(["", "o", "ka"])
        rows.append((i, " ".join(w), "aa"))
        labels.append((i, int(i % 4 == 0)))
    rows += [(1000, None, None), (1001, "", None), (1002, "?!", None), (None, "ka lo", None), (1003, "you vexor grummel", None)]
    df, l = docs(spark, rows), spark.createDataFrame([*labels, (None, 1), (7, None)], "doc_id bigint, toxic int")
    got = {r.doc_id: r.score for r in toxicity.score(df, toxicity.fit(df, l)).collect()}
    assert len(got) == len(rows) and got[1000] == got[1001] == got[1002] == 0 and all(0 <= s <= 1 for s in got.values())
    held = [(got[i], y) for i, y in labels if __import__("zlib").crc32(str(i).encode()) % 3 == 1]
    assert sum((s >= 0.7) == (y == 1) for s, y in held) / len(held) > 0.95
    none = toxicity.fit(docs(spark, []), spark.createDataFrame([], "doc_id bigint, toxic int"))
    assert toxicity.score(docs(spark, [(1, "a", None)]), none).count() == 1


def plain_kneser_ney(counts, shared, gram):
    """P(last byte of gram) from counts of a class and the corpus's distinct grams, by dictionaries."""

    def p(g):  # shared continuation models; g: bytes of 4, 3, 2 or 1
        if not g:
            return 1 / 256
        row = {x[-1:]: n for x, n in shared[len(g)].items() if x[:-1] == g[:-1]}
        total = sum(row.values())
        return (max(row.get(g[-1:], 0) - 0.75, 0) + 0.75 * len(row) * p(g[1:])) / total if total else p(g[1:])

    row = {x[-1:]: n for x, n in counts.items() if x[:-1] == gram[:-1]}
    total = sum(row.values())
    lower = p(gram[1:])
    return (max(row.get(gram[-1:], 0) - 0.75, 0) + 0.75 * len(row) * lower) / total if total else lower


def test_ratios_match_plain_kneser_ney(spark):
    rng = random.Random(8)
    rows = [(i, prose(rng, ["ab", "ba", "c", "é", "dab"], 12), None) for i in range(60)]
    labels = [(i, i % 2) for i in range(40)]
    df = docs(spark, rows)
    model = toxicity.fit(df, spark.createDataFrame(labels, "doc_id bigint, toxic int"))
    chosen = toxicity.labelled(spark.createDataFrame(labels, "doc_id bigint, toxic int"), "toxic", "doc_id", 3, 1, 1000)
    used = {r.id: r.y for r in chosen.where(F.pmod(F.xxhash64("id", F.lit(7)), F.lit(toxicity.FIT_SHARE)) != 0).collect()}
    counts, every = [Counter(), Counter()], set()
    for i, t, _ in rows:
        for w in split_words(t.encode()):
            padded = b"    " + w + b" "
            for k in range(len(w) + 1):
                every.add(padded[k : k + 5])
                if i in used:
                    counts[used[i]][padded[k : k + 5]] += 1
    shared, longer = {}, every
    for n in (4, 3, 2, 1):
        shared[n] = Counter(x[1:] for x in longer)
        longer = set(shared[n])
    grams = sorted(every) + [b"  zzz", b"abzab", b"    z", b" abaz"]
    got = model.ratios(np.array([int.from_bytes(x, "big") for x in grams], np.uint64))
    want = [np.log(plain_kneser_ney(counts[1], shared, x)) - np.log(plain_kneser_ney(counts[0], shared, x)) for x in grams]
    assert np.allclose(got, want)


def test_mixtures_match_plain_inference(spark):
    rng = random.Random(9)
    rows = [(i, prose(rng, TONGUES[g], 30), g) for i, g in enumerate(["aa", "bb", "cc"] * 30)]
    rows += [(200 + k, " ".join(prose(rng, TONGUES[g], n) for g, n in zip(("aa", "bb", "cc"), sizes, strict=True)), None) for k, sizes in enumerate([(90, 0, 30), (40, 40, 40), (5, 0, 0), (1, 1, 1)])]
    df = docs(spark, rows)
    model = language.fit(df, F.lit(True))
    counts, total = {g: Counter() for g in TONGUES}, Counter()

    def grams(w):
        padded = b"   " + w + b" "
        return [padded[k : k + 4] for k in range(len(w) + 1)]

    for _, t, g in rows:
        if g:
            for w in split_words(t.encode()):
                counts[g].update(grams(w))
    for c in counts.values():
        total += c
    n = sum(total.values())
    probability = lambda x, g: (counts[g][x] + (weight := 2 * np.sqrt(sum(counts[g].values()) + 1)) * (total[x] + 0.01) / (n + 0.01 * (len(total) + 1))) / (sum(counts[g].values()) + weight)
    names = sorted(TONGUES)
    for i, got in enumerate(model.mixtures([t.encode() for _, t, _ in rows])):
        words = split_words(rows[i][1].encode())
        ll = [[sum(np.log(probability(x, g)) for x in grams(w)) for g in names] for w in words]

        def climb(some, share, steps):
            for _ in range(steps):
                like = [[np.exp(max(r[k] - max(r), -30)) * s for k, s in zip(some, share, strict=True)] for r in ll]
                new = [sum(r[k] / sum(r) for r in like) / len(ll) for k in range(len(some))]
                if max(abs(a - b) for a, b in zip(new, share, strict=True)) < 1e-4:
                    return new
                share = new
            return share

        share = climb([0, 1, 2], [1 / 3] * 3, language.STEPS)
        order, best, found = sorted(range(3), key=lambda k: -share[k]), -np.inf, None
        for k in (1, 2, 3):
            some = order[:k]
            part = climb(some, [share[x] / sum(share[y] for y in some) for x in some], 4) if k > 1 else [1.0]
            value = sum(np.log(max(sum(np.exp(max(r[x] - max(r), -30)) * p for x, p in zip(some, part, strict=True)), 1e-30)) for r in ll) - language.PENALTY * k * np.log(len(ll) + 1)
            if value <= best:
                break
            best, found = value, dict(zip(some, part, strict=True))
        assert np.allclose(got, [found.get(k, 0.0) for k in range(3)], atol=2e-3), (i, got, found)
    small = language.fit(df, F.lit(True), entries=90)  # 30 rows for three languages
    assert len(small.grams) == 30 and small.table.shape == (31, 3)


def test_many_languages_in_one_text(spark):
    rng = random.Random(10)
    tongues = {f"l{k}": [c + v for c in "bdfgklmnprstvz"[2 * k : 2 * k + 2] for v in "aeiou"] for k in range(7)}
    rows = [(i, prose(rng, tongues[g], 80), g) for i, g in enumerate(sorted(tongues) * 20)]
    df = docs(spark, [*rows, (900, " ".join(prose(rng, p, 60) for p in tongues.values()), None)])
    got = {r.doc_id: r for r in language.predict(df, language.fit(df, F.lit(True))).collect()}
    assert set(got[900].shares) == set(tongues)
    assert all(got[i].lang_pred == g for i, _, g in rows)


def test_languages_and_mixtures(spark):
    rng = random.Random(3)
    rows = [(i, prose(rng, TONGUES[g], 80), g) for i, g in enumerate(["aa", "bb", "cc"] * 60)]
    mixed = prose(rng, TONGUES["aa"], 120) + " " + prose(rng, TONGUES["cc"], 60)
    rows += [(900, None, "aa"), (901, "12 !", None), (902, mixed, None), (903, "", None), (None, "katar", None), (904, rows[0][1] * 400, None)]
    df = docs(spark, rows)
    model = language.fit(df, toxicity.crc_split(F.col("doc_id"), 4) != 2)
    got = {r.doc_id: r for r in language.predict(df, model).collect()}
    assert all(got[i].lang_pred == g for i, _, g in rows[:180])
    assert [got[i].lang_pred for i in (900, 901, 903)] == ["und"] * 3 and got[900].score == 0
    assert set(got[902].shares) == {"aa", "cc"} and abs(got[902].score - 2 / 3) < 0.05 and got[902].lang_pred == "aa"
    assert got[904].lang_pred == "aa" and got[None].lang_pred == "aa"
    empty = language.fit(docs(spark, []), toxicity.crc_split(F.col("doc_id"), 4) != 2)
    assert language.predict(df, empty).where("lang_pred = 'und' and score = 0").count() == len(rows)


def test_quality_rules(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(500):
        t = prose(rng, TONGUES["aa"], rng.randint(20, 200))
        if i % 3 == 0:
            t = [t.upper().replace(" ", "!! "), " ".join(x + " " + x for x in t.split()), t.replace(" ", " | ")][i % 9 // 3]
        rows.append((i, t, "aa"))
        labels.append((i, int(i % 3 != 0)))
    rows += [(900, None, None), (901, "", None), (None, rows[1][1], None)]
    df, l = docs(spark, rows), spark.createDataFrame(labels, "doc_id bigint, quality int")
    model = quality.fit(df, l)
    assert 0 < len(model.rules) < 200
    got = {r.doc_id: r.score for r in quality.score(df, model).collect()}
    assert len(got) == len(rows) and sum((got[i] >= 0.3) == bool(y) for i, y in labels) > 480
    x = np.array([quality.statistics(t.encode() if t else None) for _, t, _ in rows])
    z = model.constant + sum(w * np.logical_and.reduce([c.holds(x) for c in r]) for r, w in model.rules)
    assert np.allclose([got[i] for i, _, _ in rows], 1 / (1 + np.exp(-z)))
    kept = quality.accept(df, model, 0.3)
    assert kept.columns == df.columns and kept.count() == sum(s >= 0.3 for s in got.values())
    assert quality.fit(docs(spark, []), l).rules == []


def test_encoder_equals_the_library():
    plain = Tokenizer.from_file(str(JSON))
    encoder = tokens.Encoder.of("t", open(JSON).read())
    rng = random.Random(5)
    odd = ["", "don't 'sx ''s ß É <|endoftext|> x", "áb İ Σας", "naïve—café “q” 12½", "x" * 50 + " \x1c y", "\xa0a\xadb\x85c", "á ́b", "²³ 7th", "\n\t "]
    pool = "abcXYZ éÈß'.,-12\n\t½€“”Ωжあ \x1d"
    odd += ["".join(rng.choice(pool) for _ in range(rng.randint(1, 60))) for _ in range(400)]
    for t in odd + [" ".join(odd)]:
        assert encoder.encode(t).tolist() == plain.encode(t, add_special_tokens=False).ids, t


def test_long_texts_in_slices(monkeypatch):
    encoder = tokens.Encoder.of("t", open(JSON).read())
    text = " ".join(["Hello, don't", "été", "x1"] * 50) + " Ω b"
    whole = encoder.encode(text).tolist()
    monkeypatch.setattr(tokens, "SLICE", 16)
    monkeypatch.setattr(tokens, "KEPT", 3)
    assert encoder.encode(text).tolist() == whole


class Counted:
    """A tokenizer that counts what goes through it."""

    def __init__(self, plain):
        self.plain, self.calls = plain, 0

    def __getattr__(self, name):
        self.calls += 1
        return getattr(self.plain, name)


def test_new_words_of_common_characters_spare_the_library():
    rng = random.Random(8)
    texts = [prose(rng, [*"abcdefgh", "ß", "é", "'s ", "'LL", ", “", "7½"], 60) for _ in range(100)] + ["", " \n", "it's", "x'", "'re'ves"]
    encoder = tokens.Encoder(open(JSON).read())
    plain = encoder.tokenizer
    encoder.tokenizer = counted = Counted(plain)
    got = encoder.encode_many(texts)
    assert counted.calls == 0
    assert [x.tolist() for x in got] == [x.ids for x in plain.encode_batch_fast(texts, add_special_tokens=False)]
    lines = "\n".join(texts) * 80  # over one slice, and without blanks
    assert encoder.encode(lines.replace(" ", "\n")).tolist() == plain.encode(lines, add_special_tokens=False).ids
    odd = ["y " + "ab" * 1000 + "'s " + "é" * 401 + "!" * 400, "Ω it's", "<|endoftext|>'s", "a'd"]  # a long split, other characters, a special token
    assert [x.tolist() for x in encoder.encode_many(odd)] == [x.ids for x in plain.encode_batch_fast(odd, add_special_tokens=False)]
    assert 0 < counted.calls <= 8


def test_each_token_is_one_merge_of_earlier_ones_and_its_own_letters_merged():
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in json.loads(open(JSON).read())["model"]["merges"]]
    rank = {m: i for i, m in enumerate(merges)}
    made = {"".join(m): i for m, i in rank.items()}
    assert len(made) == len(merges) == len(rank)
    assert all(made.get(x, -1) < i for (a, b), i in rank.items() for x in (a, b))
    for token in made:
        word = token.removesuffix("</w>")
        parts = [*word[:-1], word[-1] + token[len(word) :]]
        while len(parts) > 1:
            least = min(zip(parts, parts[1:]), key=lambda m: rank.get(m, len(rank)))
            if least not in rank:
                break
            at = next(i for i in range(len(parts)) if tuple(parts[i : i + 2]) == least)
            parts[at : at + 2] = ["".join(least)]
        assert parts == [token]


@pytest.mark.parametrize("length", [64, 16])
def test_packing_round_trip(spark, length):
    rng = random.Random(6)
    rows = [(i, prose(rng, TONGUES["aa"], int(rng.paretovariate(0.8) * 3) % 400), "aa") for i in range(300)]
    rows += [(900, None, None), (901, "", None), (902, "same", None), (902, "same", None), (None, "nameless", None)]
    df = docs(spark, rows).repartition(5)
    got = packing.pack(df, str(JSON), length=length, windows=4).collect()
    plain = Tokenizer.from_file(str(JSON))
    want = Counter((i, tuple([*plain.encode(t or "", add_special_tokens=False).ids, 2])) for i, t, _ in rows)
    by_doc, by_sequence = {}, {}
    for r in got:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert len(ids) == r.length > 0
        by_doc.setdefault(r.doc_id, []).append((r.start, ids, r.doc_tokens))
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, ids in want:
        pieces = sorted(by_doc[i])
        if i == 902:
            assert len(pieces) == 2
            continue
        assert [x for p in pieces for x in p[1]] == list(ids) and all(p[2] == len(ids) for p in pieces)
    fill = 0
    for spans in by_sequence.values():
        at = 0
        for o, n in sorted(spans):
            assert o == at
            at += n
        assert at <= length
        fill += at
    assert fill / (len(by_sequence) * length) > (0.85 if length == 64 else 0.6)
    assert packing.pack(docs(spark, []), str(JSON)).count() == 0


def test_best_fit_wastes_little():
    rng = random.Random(7)
    windows = [(i, rng.randint(1, 100)) for i in range(500)]
    out = packing.best_fit(windows, 100)
    size = dict(windows)
    used = {}
    for own, into, at in out:
        used.setdefault(into, []).append((at, size[own]))
    assert sorted(o for o, _, _ in out) == list(range(500))
    for spans in used.values():
        at = 0
        for a, n in sorted(spans):
            assert a == at
            at += n
        assert at <= 100
    assert len(used) * 100 < 1.05 * sum(size.values())


def test_longest_word_is_of_the_whole_text():
    text = b"word " * 12_000 + b"x" * 900 + b" word"
    assert dict(zip(quality.NAMES, quality.statistics(text), strict=True))["long_word"] == 900
