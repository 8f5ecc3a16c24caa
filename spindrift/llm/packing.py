"""Packing token ids into sequences of bounded length, online and in bounded space.

Each partition keeps a fixed number of open windows. A document goes whole into the fullest
window that has room; when none has, the fullest is topped up with the document's head, emitted,
and the rest placed anew. Longer documents are first cut into full sequences. What is still open
at a partition's end is merged at last: windows move as wholes, best fit decreasing, in groups of
bounded size, by their numbers and fill alone, while the pieces only learn their new place.
"""

from __future__ import annotations

from math import ceil
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm import sieve
from spindrift.llm.columns import field, texts
from spindrift.llm.tokens import Encoder
from spindrift.runtime import cut_lineage, map_arrow

LENGTH, OPEN, LEAST, END, GROUP = 4096, 32, 32, 2, 50_000
GROUP_TEXT = 1 << 21  # characters encoded at once


class Packer:
    """The open windows of one partition; LEAST is the shortest piece worth cutting off."""

    def __init__(self, base: int, length: int = LENGTH, windows: int = OPEN, least: int = LEAST):
        self.next, self.length, self.windows, self.least = base, length, windows, least
        self.open: list[list[int]] = []  # [fill, sequence]

    def fresh(self) -> int:
        self.next += 1
        return self.next - 1

    def place(self, n: int) -> list[tuple[int, int, int, int]]:
        """(start, length, sequence, offset) of a document's pieces."""
        out, at = [], 0
        while n - at >= self.length:
            out.append((at, self.length, self.fresh(), 0))
            at += self.length
        while at < n:
            rest = n - at
            best = max((w for w in self.open if self.length - w[0] >= rest), default=None)
            if best is None and len(self.open) < self.windows:
                best = [0, self.fresh()]
                self.open.append(best)
            if best is None:
                best = max(self.open)
                gap = self.length - best[0]
                if gap < self.least:
                    self.open.remove(best)
                    continue
                rest = gap
            out.append((at, rest, best[1], best[0]))
            best[0] += rest
            at += rest
            if best[0] == self.length:
                self.open.remove(best)
        return out


def pack_partitions(df: DataFrame, tokenizer: str, id: str = "doc_id", text: str = "text", length: int = LENGTH, windows: int = OPEN, end: int | None = END) -> DataFrame:
    """Pieces (id, start, length, doc_tokens, sequence_id, offset, ids, open) as each partition places them.

    ids are little-endian unsigned 32-bit numbers. Rows with open = 1 are no pieces: they name the
    windows left open, with their fill as length. A null text is an empty one. tokenizer is the
    path of a file that the driver can read; its content goes to the executors.
    """
    sent = df.sparkSession.sparkContext.broadcast(Path(tokenizer).read_text())
    key = f"{tokenizer}:{len(sent.value)}"
    names = [id, "start", "length", "doc_tokens", "sequence_id", "offset", "ids", "open"]
    kinds = [pa.int64()] * 5

    def run(batches):
        encoder = Encoder.of(key, sent.value)
        packer = Packer(TaskContext.get().partitionId() << 32, length, windows)
        kind = None
        for batch in batches:
            kind = batch.column(0).type
            rows, ids, size, held = [], [], 0, []

            def flush():
                cols = list(zip(*rows, strict=True)) if rows else [()] * 5
                take = batch.column(0).take(pa.array(held, pa.int64()))
                arrays = [take, *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True)), pa.array(ids, pa.binary()), pa.array([0] * len(rows), pa.int32())]
                return pa.RecordBatch.from_arrays(arrays, names=names)

            group: list[tuple[int, str]] = []
            for i, t in enumerate(texts(batch.column(1))):
                group.append((i, (t or b"").decode()))
                size += len(group[-1][1])
                if size > GROUP_TEXT or i == batch.num_rows - 1:
                    for (k, _), tokens in zip(group, encoder.encode_many([x for _, x in group]), strict=True):
                        if end is not None:
                            tokens = np.append(tokens, np.uint32(end))
                        for a, n, sequence, offset in packer.place(len(tokens)):
                            rows.append((a, n, len(tokens), sequence, offset))
                            ids.append(tokens[a : a + n].astype("<u4").tobytes())
                            held.append(k)
                    if rows:
                        yield flush()
                    group, rows, ids, size, held = [], [], [], 0, []
        if packer.open:
            n = len(packer.open)
            fill, own = zip(*packer.open, strict=True)
            zero = pa.array([0] * n, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.nulls(n, kind), zero, pa.array(fill, pa.int64()), zero, pa.array(own, pa.int64()), zero, pa.nulls(n, pa.binary()), pa.array([1] * n, pa.int32())], names=names)

    schema = f"{field(df, id)}, start bigint, length bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary, open int"
    return map_arrow(df.select(id, text), run, schema)


def best_fit(windows: list[tuple[int, int]], length: int) -> list[tuple[int, int, int]]:
    """(window, its new sequence, its offset there) for (window, fill), largest first into the tightest room."""
    from bisect import bisect_left, insort

    room: list[tuple[int, int]] = []  # (free, sequence)
    out = []
    for own, fill in sorted(windows, key=lambda w: (-w[1], w[0])):
        k = bisect_left(room, (fill, -1))
        if k < len(room):
            free, into = room.pop(k)
        else:
            free, into = length, own
        out.append((own, into, length - free))
        if free - fill:
            insort(room, (free - fill, into))
    return out


def merge_leftovers(pieces: DataFrame, length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """The pieces with the leftover windows merged; whatever other columns they have stay."""
    pieces = cut_lineage(pieces)
    left = pieces.where("open = 1").select("sequence_id", F.col("length").alias("fill"))
    groups = max(1, ceil(left.count() / group))

    def run(batches):
        got = [x for b in batches for x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
        out = best_fit(got, length)
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in range(3)], names=["_own", "_into", "_at"])

    # each task has about `group` windows of two numbers
    moved = map_arrow(left.repartition(groups, "sequence_id"), run, "_own bigint, _into bigint, _at bigint").where("_own != _into")
    moved = cut_lineage(moved)
    rows = sieve.marked(pieces.where("open = 0").drop("open"), moved.select("_own"), "sequence_id")
    again = rows.where("may").select("row.*").join(moved, F.col("sequence_id") == F.col("_own"), "left")
    again = again.withColumn("offset", F.col("offset") + F.coalesce("_at", F.lit(0))).withColumn("sequence_id", F.coalesce("_into", "sequence_id"))
    return rows.where("not may").select("row.*").unionByName(again.drop("_own", "_into", "_at"))


def pack(df: DataFrame, tokenizer: str, **options) -> DataFrame:
    """Pieces (id, start, length, doc_tokens, sequence_id, offset, ids): every token id of df in exactly one."""
    return merge_leftovers(pack_partitions(df, tokenizer, **options), options.get("length", LENGTH))
