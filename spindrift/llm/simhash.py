"""SimHash fingerprints, linked through covering locality-sensitive hashing.

Bit positions are mapped to the non-zero vectors of GF(2)^(radius+1). Mask v keeps the positions
whose vector has an odd product with v. Any `radius` positions span less than the whole space, so
some v is orthogonal to all of them: its mask drops just those bits, and two fingerprints that
differ there alone agree under it. Every pair within the radius so meets in some table, for
certain. Masks keep about half of the bits, so that chance meetings stay rare up to billions of
distinct fingerprints.

Equal fingerprints are one node from the start. In a bucket, nodes are joined to spanning stars,
never listed as pairs. A bucket of more than `bucket` nodes is not compared at all: its nodes
are linked through the codes within half the radius of them, an exact way too (two codes at most
`radius` apart have one in common), in which no code can gather more than its own ball. At an odd
radius a code has an inner and an outer ball, and two nodes of the outer one are linked only
through a node of the inner one.
"""

from __future__ import annotations

import json
import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm import sieve, skew
from spindrift.llm.columns import map_texts, packed, quoted
from spindrift.llm.graph import components
from spindrift.runtime import cut_lineage, map_arrow

BITS, WIDTH, SEED, RADIUS, BUCKET = 64, 4, 42, 4, 4096
BLOCK = 1 << 16
SPACES = re.compile(rb"[\x20\x09-\x0d]+")


def joined(text: bytes) -> bytes:
    """Words, A-Z lower-cased, with one blank between two."""
    low = text.lower()  # of bytes: ASCII letters only
    return b" ".join(low.split()) if len(low) < 1 << 20 else SPACES.sub(b" ", low).strip(b" ")


def fingerprint(text: bytes | None, width: int = WIDTH) -> int:
    """A bit is set where over half of the shingles' hashes have it; 0 for a text without words."""
    norm = joined(text or b"")
    if not norm:
        return 0
    blanks = np.flatnonzero(np.frombuffer(norm, np.uint8) == 32)
    starts, ends = np.r_[0, blanks + 1], np.r_[blanks, len(norm)]
    if len(starts) > width:
        starts, ends = starts[: 1 - width], ends[width - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    ones, h = np.zeros(BITS, np.int64), xxhash.xxh64_intdigest
    for i in range(0, len(starts), BLOCK):
        a, b = starts[i : i + BLOCK].tolist(), ends[i : i + BLOCK].tolist()
        hashes = np.array([h(norm[x:y], SEED) for x, y in zip(a, b, strict=True)], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(starts), bitorder="little").view("<u8")[0])


def _codes(batch: list[bytes | None], width: int) -> pa.Array:
    return pa.array(np.array([fingerprint(t, width) for t in batch], np.uint64).view(np.int64))


def fingerprints(df: DataFrame, id: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """id and fp (the 64 bits as a long) for every row; a null text has no words."""

    return map_texts(df, [id], text, lambda batch: [_codes(batch, width)], "fp bigint")


def masks(radius: int = RADIUS) -> list[int]:
    """The covering masks as unsigned ints, one for each non-zero v."""
    top = (1 << (radius + 1)) - 1
    vectors = [1 + i % top for i in range(BITS)]
    return [sum(1 << i for i, x in enumerate(vectors) if (x & v).bit_count() & 1) for v in range(1, top + 1)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def stars(codes: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Spanning edges (member, hub) of the linked parts of one bucket."""
    out, left = [], codes
    while left.size > 1:
        hub, edge, left = left[0], left[:1], left[1:]
        while edge.size and left.size:
            near = np.zeros(left.size, bool)
            for i in range(0, edge.size, 64):
                near |= (np.bitwise_count(edge[i : i + 64, None] ^ left[None, :]) <= radius).any(0)
            edge, left = left[near], left[~near]
            out += [(x, hub) for x in edge.tolist()]
    return [(int(x), int(h)) for x, h in out]


def _walk(radius: int, bucket: int):
    """Reads rows sorted by (t, key): yields spanning edges, and (fp, null) for nodes of oversized buckets."""

    def emit(pairs):
        a = np.array([p[0] for p in pairs], np.uint64).view(np.int64)
        b = [None if p[1] is None else p[1] for p in pairs]
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array([None if x is None else (x - (1 << 64) if x >> 63 else x) for x in b], pa.int64())], names=["a", "b"])

    def run(batches):
        held_key, held, over = None, np.zeros(0, np.uint64), False
        for batch in batches:
            t = batch.column(0).to_numpy()
            key = batch.column(1).to_numpy()
            fp = batch.column(2).to_numpy().view(np.uint64)
            cut = np.flatnonzero((t[1:] != t[:-1]) | (key[1:] != key[:-1])) + 1
            starts, ends = np.r_[0, cut], np.r_[cut, len(t)]
            out = []
            # groups of one that touch neither end of the batch have no partner
            size = ends - starts
            busy = np.flatnonzero(size > 1)
            picked = np.unique(np.r_[0, busy, len(starts) - 1])
            for g in picked.tolist():
                s, e = int(starts[g]), int(ends[g])
                k = (int(t[s]), int(key[s]))
                if k != held_key:
                    if not over and held.size > 1:
                        out += stars(held, radius)
                    held_key, held, over = k, fp[s:e], False
                elif not over:
                    held = np.concatenate([held, fp[s:e]])
                else:
                    out += [(int(x), None) for x in fp[s:e]]
                if not over and held.size > bucket:
                    out += [(int(x), None) for x in held]
                    held, over = held[:0], True
            if out:
                yield emit(out)
        if not over and held.size > 1 and (out := stars(held, radius)):
            yield emit(out)

    return run


def _balls(batches):
    """Links rows sorted by (code, outer, fp) to the first of their code, where that is an inner one."""
    last = None  # (code, hub) of the code that may go on
    for batch in batches:
        code, outer, fp = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy()
        head = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
        hub, inner = fp[head], outer[head] == 0
        if last is not None and last[0] == code[0]:
            inner = np.r_[last[1] is not None, inner[1:]]
            hub = hub if last[1] is None else np.r_[last[1], hub[1:]]
        size = np.diff(np.r_[head, len(code)])
        a, b, ok = fp, np.repeat(hub, size), np.repeat(inner, size)
        pairs = np.unique(np.stack([a, b], 1)[ok & (a != b)], axis=0)
        last = code[-1], hub[-1] if inner[-1] else None
        if len(pairs):
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])


def edges(fps: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """Edges (a, b) between distinct fingerprints fp that connect all pairs within the radius."""
    table = F.array(*(F.struct(F.lit(i).cast("byte").alias("t"), F.lit(signed(m)).alias("m")) for i, m in enumerate(masks(radius))))
    rows = fps.select("fp", F.explode(table).alias("x")).select("x.t", F.col("fp").bitwiseAND(F.col("x.m")).alias("key"), "fp")
    rows = rows.repartition("t", "key").sortWithinPartitions("t", "key", "fp")
    found = cut_lineage(map_arrow(rows, _walk(radius, bucket), "a bigint, b bigint").distinct())
    hot = found.where("b is null").select(F.col("a").alias("fp")).distinct()
    if radius > 4:
        if not hot.isEmpty():
            raise ValueError("radius above 4 is not supported for oversized buckets")
        return found.where("b is not null")
    # two codes at most `radius` apart have one that is within half of it of one of them and within the rest of the other
    reach = [{"outer": int(k > radius // 2), "m": signed(sum(1 << i for i in c))} for k in range((radius + 1) // 2 + 1) for c in combinations(range(BITS), k)]
    around = F.from_json(F.lit(json.dumps(reach)), "array<struct<outer:tinyint,m:bigint>>")  # one literal; a column for each of the 2081 masks takes many seconds to build
    codes = hot.select("fp", F.explode(around).alias("x")).select(F.col("fp").bitwiseXOR(F.col("x.m")).alias("code"), "x.outer", "fp")
    linked = map_arrow(codes.repartition("code").sortWithinPartitions("code", "outer", "fp"), _balls, "a bigint, b bigint")
    return found.where("b is not null").unionByName(linked)


def link(df: DataFrame, id: str = "doc_id", text: str = "text", width: int = WIDTH, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """One row per row of df: id, fp (long), component_id (smallest id reachable, itself included).

    Texts that are null, empty or blank have fingerprint zero and are linked like any other. Rows
    that repeat an id keep their own fingerprints; rows with a null id have no smallest id of
    their own and join a component without naming it. An empty table gives an empty result.
    """
    fp = cut_lineage(fingerprints(df, id, text, width))
    n = fp.count()
    nodes = cut_lineage(fp.groupBy("fp").agg(F.min(id).alias("_node")))
    roots = components(edges(nodes.select("fp"), radius, bucket), "a", "b").withColumnRenamed("node", "fp")
    # the smallest fingerprint names a part; the smallest id of all its members names the component
    linked = cut_lineage(nodes.join(roots, "fp", "left").select("fp", "_node", F.coalesce("root", "fp").alias("root")))
    name = linked.groupBy("root").agg(F.min("_node").alias("component_id"))
    named = skew.lookup(linked.select("fp", "root"), name, "root", linked.count()).select("fp", "component_id")
    return skew.lookup(fp, named, "fp", n).select(id, "fp", "component_id")


def representatives(df: DataFrame, id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of df whose id names their component: one document of each group, with all columns, whatever those are named.

    Rows go by id and fingerprint: of two texts under one id only that may go which has a smaller
    id in its own component. Of rows that repeat an id and fingerprint one stays; a row without id
    stays always.
    """
    ids = df.select(quoted(id).alias("id"), quoted(text).alias("text")).where("id is not null")
    linked = cut_lineage(link(ids, "id", "text", **options))
    stays = F.col("component_id") == F.col("id")
    by_id = cut_lineage(linked.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.max(stays).alias("some")))
    kept = sieve.without(df, by_id.where("not some").select("id"), id)
    again = by_id.where("some and n > 1").select("id")
    if again.isEmpty():
        return kept
    rows = sieve.among(kept, again, id)
    rows = rows.select(packed(rows).alias("row"), quoted(id).alias("id"), quoted(text).alias("text"))
    rows = map_texts(rows, ["row", "id"], "text", lambda batch: [_codes(batch, options.get("width", WIDTH))], "fp bigint")
    good = linked.join(again, "id", "left_semi").where(stays).select("id", "fp").distinct()
    chosen = rows.join(good, ["id", "fp"], "left_semi").groupBy("id", "fp").agg(F.first("row").alias("row")).select("row.*")
    return sieve.without(kept, again, id).unionByName(chosen)
