import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from spindrift.llm import alignment

A, B = (str(public_tokenizers.path(x)) for x in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
SCHEMA = "doc_id bigint, text string, block int, place int, pair string"


def brute(rows):
    """The contract, token by token."""
    one, two = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    one.encode_special_tokens = True
    letters = alignment.byte_letters()

    def piece(i):
        p = two.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if p.startswith("<0x") and len(p) == 6 else p.replace("▁", " ").encode()

    linked, out = [], []
    for i, t in rows:
        a = [(k, bytes(letters[c] for c in one.id_to_token(k))) for k in one.encode(" " + t, add_special_tokens=False).ids] if t else []
        b = [(k, piece(k)) for k in two.encode(t)] if t else []
        if not t or not b"".join(x for _, x in a) == b"".join(x for _, x in b) == b" " + t.encode():
            out.append([i, 0, 0, 0, 0, ""])
            linked.append(Counter())
            continue
        ends = []
        for side in (a, b):
            at = 0
            ends.append([at := at + len(x) for _, x in side])
        cuts = sorted(set(ends[0]) & set(ends[1]))
        groups = [([k for (k, _), e in zip(a, ends[0], strict=True) if lo < e <= hi], [k for (k, _), e in zip(b, ends[1], strict=True) if lo < e <= hi]) for lo, hi in zip([0, *cuts], cuts, strict=False)]
        own = Counter((x, y) for p, q in groups for x in p for y in q)
        shown = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in groups)
        out.append([i, len(a), len(b), len(groups), own.total(), hashlib.sha256(shown.encode()).hexdigest()])
        linked.append(own)
    count = Counter(p for own in linked for p in own)
    most = {}
    for (x, _), n in count.items():
        most[x] = max(n, most.get(x, 0))
    for row, own in zip(out, linked, strict=True):
        row[5:5] = [sum(n for p, n in own.items() if count[p] == most[p[0]]), sum(n * count[p] for p, n in own.items())]
    return sorted(map(tuple, out), key=str), count, linked


def test_alignment_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(alignment, "CHUNK_TEXTS", 7)
    monkeypatch.setattr(alignment, "CHUNK_BYTES", 300)
    monkeypatch.setattr(alignment, "ENTRIES", 400)
    rng = random.Random(6)
    pieces = ["the", " the", "ing", "é", "日本語", "🙂", "\n", "  ", "\t", "<s>", "</s>", "<unk>", "<|endoftext|>", "<0x41>", "▁", "0", "12345", ".", "...", "=====", "Zürich", " ", "\x00", "\r", "ﬁ", "a" * 40]
    rows = [(i, "".join(rng.choice(pieces) for _ in range(rng.randint(1, 30)))) for i in range(160)]
    rows += [(200, None), (201, ""), (202, " "), (203, "the the the"), (203, "the the the"), (None, "the end"), (204, "=-" * 3000), (205, " " * 700 + "x"), (206, "ab" * 900)]
    want, _, _ = brute(rows)
    df = spark.createDataFrame([(i, t, 1, 2, "x") for i, t in rows], SCHEMA).repartition(3)
    got = alignment.measure(df, A, B).collect()
    assert sorted(map(tuple, got), key=str) == want
    assert any(r.n_a == 0 and r.doc_id is not None and r.doc_id < 200 for r in got) and any(r.n_best < r.n_links for r in got)
    assert alignment.measure(df.limit(0), A, B).count() == 0


def test_pair_table_matches_brute_force(spark):
    rng = random.Random(7)
    rows = [(i, " ".join(rng.choice(["unbelievable", "tokenisation", "the", "qwxz", "zzzz"]) for _ in range(rng.choice([1, 5, 300])))) for i in range(60)]
    _, count, linked = brute(rows)
    indexed = alignment.index(spark.createDataFrame(rows, "doc_id bigint, text string"), A, B)
    got = {(r.a, r.b): (r.documents, r.links) for r in alignment.pairs(indexed, alignment.vocabulary(B)).collect()}
    assert got == {p: (n, sum(own[p] for own in linked)) for p, n in count.items()}
    assert max(n for _, n in got.values()) > 100


def test_endless_runs_and_large_groups_end():
    tools = alignment.sides("test", open(A, "rb").read(), open(B, "rb").read())
    plain = Tokenizer.from_file(A)
    plain.encode_special_tokens = True
    for text in (" " * 1_200_000 + "x", "a" * 300_000, "\n\t" * 200_000, "<|endoftext|>" * 5):
        assert tools[0].one(text).tolist() == plain.encode(text, add_special_tokens=False).ids
    x = alignment.align([b"\xff\xfe", ("é́" * 60_000).encode()], *tools)
    assert x.n_a[0] == 0 and x.digests[0] == "" and x.times.sum() == x.links.sum()


def test_bitmaps_hold_what_they_were_given():
    rng = np.random.default_rng(1)
    key = np.unique(rng.integers(0, 50, 5000) << 16 | rng.integers(0, alignment.BLOCK, 5000))
    times = rng.integers(1, 40, len(key))
    pair, places, words, more, more_words = (c.to_pylist() for c in alignment.postings(key, times))
    got = {}
    for p, at, w, mat, mw in zip(pair, places, words, more, more_words, strict=True):
        for d in alignment.unpacked(np.array(at), np.array(w))[1]:
            got[p << 16 | int(d)] = 1
        for d in alignment.unpacked(np.array(mat, np.int64), np.array(mw, np.int64))[1]:
            got[p << 16 | int(d % alignment.BLOCK)] += 1 << int(d // alignment.BLOCK)
    assert got == dict(zip(key.tolist(), times.tolist(), strict=True))
