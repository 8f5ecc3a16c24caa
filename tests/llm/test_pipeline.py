import random
from collections import Counter
from pathlib import Path
from urllib.parse import urlparse

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from spindrift.llm import quality, queries
from spindrift.runtime import shared_folder
from tests.llm.test_dedup_contamination_simhash import brute_components, brute_fingerprint, brute_hits

SF = "/root/testdata/sf0.001"
CONTRACT = {
    "op1_toxicity": ["doc_id", "held_out", "score", "predicted"],
    "op2_passages": ["doc_id", "partner_id"],
    "op3_decontaminate": ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
    "op4_exact_dedup": ["doc_id", "keep_id", "group_size", "kept", "text_sha256"],
    "op5_packing": ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
    "op6_language": ["doc_id", "held_out", "lang_pred", "score"],
    "op7_secrets": ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
    "op8_simhash": ["doc_id", "fingerprint", "component_id"],
    "op9_quality": ["doc_id", "held_out", "score", "predicted"],
    "op10_pii": ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
    "op11_conversations": ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"],
    "op12_alignment": ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"],
    "op13_topk": ["query_id", "rank", "vec_id", "score"],
}


def test_every_operator_has_one_query():
    assert set(queries.QUERIES) == set(CONTRACT)


@pytest.mark.parametrize("name", sorted(CONTRACT))
def test_contract(spark, name):
    """The columns, and a row for each document, conversation or query vector (pieces and partners: at least one, at most one)."""
    df = queries.QUERIES[name](spark, SF)
    assert set(CONTRACT[name]) <= set(df.columns)
    got = df.toPandas()
    key, rows = ("conv_id", "conversations") if name == "op11_conversations" else ("query_id", "embeddings") if name == "op13_topk" else ("doc_id", "documents")
    table = spark.read.parquet(f"{SF}/{rows}.parquet")
    if name == "op13_topk":
        ids = [r.vec_id for r in table.where("vec_id % 20 = 0").collect() for _ in range(20)]
    elif name == "op11_conversations":
        ids = [r.conv_id for r in table.select("conv_id").distinct().collect()]
    else:
        ids = [r.doc_id for r in table.select("doc_id").collect()]
    if name in ("op2_passages", "op5_packing"):
        assert set(got[key]) <= set(ids) and (name == "op2_passages" or set(got[key]) == set(ids))
    else:
        assert sorted(got[key]) == sorted(ids)


def low(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in (t or ""))


def test_pipeline_matches_brute_force(spark, tmp_path):
    rng = random.Random(9)
    parts = ["ka", "lo", "mi", "tar", "os", "en", "ri"]
    word = lambda: "".join(rng.choice(parts) for _ in range(rng.randint(1, 4)))
    prose = lambda n: " ".join(word() for _ in range(n)) + "."
    items = [(i, prose(14)) for i in range(3)]
    rows, labels = [], []
    for i in range(260):
        t = prose(rng.randint(15, 120))
        if i % 5 == 0:
            t = t.upper().replace(" ", "!! ")
        if i % 11 == 3:
            t += " " + items[i % 3][1]
        rows.append((i, t, "en", "src", len(t)))
        labels.append((i, int(i % 5 != 0), 0))
    for k in range(20):
        t = rows[20 + k][1]
        rows.append((300 + k, t if k % 2 else t.replace("ka", "KA", 1), "en", "src", len(t)))
    rows += [(400, None, None, None, None), (401, "", "en", "s", 0), (402, rows[7][1] + " extra", "en", "s", 1)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    model = quality.fit(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))

    def good(t):
        x = np.array([quality.statistics(t.encode() if t else None)])
        z = model.constant + sum(w for r, w in model.rules if all(c.holds(x)[0] for c in r))
        return 1 / (1 + np.exp(-z)) >= queries.GOOD_AT

    kept = {i: t for i, t, *_ in rows if good(t)}
    assert 0 < len(kept) < len(rows) and all(i in kept for i, q, _ in labels if q)
    top = {}
    for i, t in kept.items():
        top[low(t)] = max(i, top.get(low(t), i))
    kept = {i: kept[i] for i in top.values()}
    fps = {i: brute_fingerprint(t) for i, t in kept.items()}
    part = brute_components(fps, [(a, b) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= 4])
    kept = {i: kept[i] for i in set(part.values())}
    hits = brute_hits(list(kept.items()), items)
    kept = {i: t for i, t in kept.items() if not hits[i][1]}

    got = docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        got = stage(spark, got, str(tmp_path))
        if k < 4:
            assert got.columns == docs.columns
        got.write.parquet(f"{tmp_path}/stage{k}")
        got = spark.read.parquet(f"{tmp_path}/stage{k}")
    plain = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    want = Counter({i: len(plain.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in kept.items()})
    have = Counter()
    for r in got.collect():
        have[r.doc_id] += r.length
    assert have == want
    assert corpus_pipeline.run(spark, str(tmp_path)).agg({"length": "sum"}).first()[0] == sum(want.values())


def test_pipeline_of_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    folder = Path(urlparse(shared_folder(spark)).path)
    before = set(folder.glob("table-*"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert len(set(folder.glob("table-*")) - before) == 1  # of five stages' outputs only the last stays
