"""Benchmark decontamination with an Aho-Corasick automaton over word symbols.

Test items are normalised to words (A-Z lower-cased; digits, letters and every character beyond
ASCII are word characters). Each text is scanned once, whole, in blocks that bound memory; a hit's
word range is mapped to code-point offsets of the original text only for texts that have one.

The automaton holds every second half-window of an item (words 0-4, 5-9, ... of windows of ten), so
it has one state for a word of the benchmark rather than one for a word of every window. Each whole
window has one of these blocks inside it, and the words around a block (half a window on either
side, kept as numbers in one array) tell which windows are really there. Items shorter than a window
are entries as wholes. Worker processes build it once from the broadcast items.

The items are broadcast as one automaton while they stay below `limit` bytes; a larger benchmark is
cut into lists of that size, and what one list's scan has found is written to the shared folder
before the next, so that a worker holds one automaton at a time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from spindrift.llm.columns import packed, quoted, texts
from spindrift.runtime import map_arrow, rewritten

WORD_BYTES = bytes([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)])
TABLE = bytes((b + 32 if 65 <= b <= 90 else b) if (b + 32 if 65 <= b <= 90 else b) in WORD_BYTES else 32 for b in range(256))
WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
WINDOW = 10
LIMIT = 32 << 20
BLOCK = 4 << 20
_built: dict[str, Automaton] = {}


def words(text: bytes) -> list[bytes]:
    return text.translate(TABLE).split()


def blocks(text: bytes, size: int = BLOCK):
    """The words of a text, in lists of bounded length; a word is never cut."""
    at = 0
    while at < len(text):
        end = min(len(text), at + size)
        while end < len(text) and TABLE[text[end]] != 32:
            end += 1
        yield words(text[at:end])
        at = end


def windows(item: list[bytes], width: int) -> list[tuple[bytes, ...]]:
    if not item:
        return []
    return [tuple(item[i : i + width]) for i in range(max(1, len(item) - width + 1))]


class Automaton:
    """The items' blocks as one Aho-Corasick automaton, and for each block the distinct surroundings it has.

    around: [surrounding, 2 * reach] word numbers left and right of a block, -1 beyond the item's ends.
    """

    def __init__(self, items: list[tuple[str, bytes]], width: int):
        import ahocorasick

        self.width, self.block, self.vocabulary = width, max(1, (width + 1) // 2), {}
        self.reach = width - self.block  # of words on either side of a block that its windows can have
        names: dict[str, int] = {}
        keys: dict[tuple[int, ...], dict[bytes, set[int]]] = {}
        for name, text in items:
            own = names.setdefault(name, len(names))
            w = [self.vocabulary.setdefault(x, len(self.vocabulary) + 1) for x in words(text)]
            if 0 < len(w) < width:
                keys.setdefault(tuple(w), {}).setdefault(b"", set()).add(own)
            elif w:
                ends = np.full(self.reach, -1, np.int32)
                padded = np.concatenate([ends, np.array(w, np.int32), ends])
                for i in range(0, len(w) - self.block + 1, self.block):
                    p = i + self.reach + self.block
                    beside = np.concatenate([padded[i : i + self.reach], padded[p : p + self.reach]]).tobytes()
                    keys.setdefault(tuple(w[i : i + self.block]), {}).setdefault(beside, set()).add(own)
        self.names = list(names)
        self.tree = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE) if keys else None
        self.length, first, around, self.owners, self.whole = [], [0], [], [], []
        for n, (k, beside) in enumerate(keys.items()):
            self.tree.add_word(k, n)
            self.length.append(len(k))
            self.whole.append(beside.pop(b"", None))  # the items that are this entry, whole
            around += beside
            self.owners += (tuple(x) for x in beside.values())
            first.append(len(self.owners))
        self.first = first
        self.around = np.frombuffer(b"".join(around), np.int32).reshape(-1, 2 * self.reach) if self.reach else np.zeros((len(self.owners), 0), np.int32)
        if keys:
            self.tree.make_automaton()

    def hits(self, ids: tuple[int, ...], base: int, spans: list, names: set) -> None:
        """Adds the word ranges of the windows in ids, whose first word is number `base` of the text, and their items."""
        reach, block = self.reach, self.block
        for end, n in self.tree.iter(ids):
            whole = self.whole[n]
            if whole is not None:
                spans.append((base + end - self.length[n] + 1, base + end + 1))
                names.update(self.names[i] for i in whole)
            a, b = self.first[n], self.first[n + 1]
            if a == b:
                continue
            at = end - block + 1
            left = ids[max(0, at - reach) : at]
            right = ids[end + 1 : end + 1 + reach]
            here = np.array([*(-2,) * (reach - len(left)), *left, *right, *(-2,) * (reach - len(right))], np.int32)
            same = self.around[a:b] == here
            before = np.logical_and.accumulate(same[:, :reach][:, ::-1], 1).sum(1)
            after = np.logical_and.accumulate(same[:, reach:], 1).sum(1)
            for k in np.flatnonzero(before + after >= reach).tolist():
                # windows begin from `before` words ahead of the block to as few as `after` words behind it allow
                low, high = int(before[k]), max(0, reach - int(after[k]))
                spans.append((base + at - low, base + at - high + self.width))
                names.update(self.names[i] for i in self.owners[a + k])


def automaton(key: str, items: list[tuple[str, bytes]], width: int) -> Automaton:
    """A worker process builds it once."""
    if key not in _built:
        _built.clear()
        _built[key] = Automaton(items, width)
    return _built[key]


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def scan(text: bytes, tree: Automaton) -> tuple[int, list[tuple[int, int]], set[str]]:
    """Word count, merged hit ranges in words, names of the items hit."""
    n, spans, names, tail = 0, [], set(), ()
    for block in blocks(text):
        ids = tail + tuple([tree.vocabulary.get(w, 0) for w in block])
        if tree.tree is not None:
            tree.hits(ids, n - len(tail), spans, names)
        n += len(block)
        tail = ids[max(0, len(ids) - tree.width + 1) :]  # a window may cross into the next block
        spans = merge(spans)
    return n, spans, names


def offsets(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Code-point ranges of word ranges."""
    out, at, found = [], 0, WORD.finditer(text)
    for a, b in spans:
        first = next(islice(found, a - at, None))
        last = first if b - a == 1 else next(islice(found, b - a - 2, None))
        out.append((first.start(), last.end()))
        at = b
    return out


def shards_of(items: DataFrame, item_id: str, item_text: str, limit: int) -> Iterator[tuple[Broadcast, bool]]:
    """The items with id and text, broadcast in lists of about `limit` bytes, and whether a list is the last; one empty list for none.

    One list at a time is on the driver.
    """
    sc = items.sparkSession.sparkContext
    listed = items.select(F.col(item_id).cast("string").alias("i"), F.col(item_text).cast("string").alias("t")).where("i is not null and t is not null")
    held, size = [], 0
    for row in listed.orderBy("i", "t").toLocalIterator():
        if size and size + len(row.t) > limit:
            yield sc.broadcast(held), False
            held, size = [], 0
        held.append((row.i, row.t.encode()))
        size += len(row.t)
    yield sc.broadcast(held), True


def find(df: DataFrame, items: DataFrame, id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = WINDOW, limit: int = LIMIT) -> DataFrame:
    """One row per row of df: id, n_words, n_hit, items (sorted array), spans (array of code-point ranges).

    A null text has no words; an item without id or words takes no part, and rows that repeat an
    item_id are windows of one item. Ids are passed through, null and repeated ones too; an empty
    benchmark hits nothing. Other columns of either table play no part.
    """
    names = ["id", "n_words", "n_hit", "items", "spans", "text", "ranges"]
    place = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    schema = StructType([StructField("id", df.schema[id].dataType), *StructType.fromDDL("n_words bigint, n_hit bigint, items array<string>, spans array<struct<start: bigint, end: bigint>>, text string, ranges array<bigint>").fields])
    empty = {"n_words": F.lit(0).cast("long"), "n_hit": F.lit(0).cast("long")} | {f.name: F.lit(None).cast(f.dataType) for f in schema.fields if f.name in ("items", "spans", "ranges")}
    out = df.select(*(quoted(id).alias("id") if n == "id" else quoted(text).alias("text") if n == "text" else empty[n].alias(n) for n in names))
    for sent, last in shards_of(items, item_id, item_text, limit):

        def run(batches, sent=sent, last=last, key=uuid4().hex):
            tree = automaton(key, sent.value, width)
            for batch in batches:
                n_words, n_hit, found, ranges, places = [], [], [], [], []
                before, flat = batch.column(3).to_pylist(), batch.column(6).to_pylist()
                for i, t in enumerate(texts(batch.column(5))):
                    n, spans, hit = scan(t or b"", tree)
                    old = flat[i] or []
                    spans = merge([*spans, *zip(old[::2], old[1::2], strict=True)]) if old else spans
                    n_words.append(n)
                    n_hit.append(sum(b - a for a, b in spans))
                    found.append(sorted({*hit, *(before[i] or ())}))
                    ranges.append([x for s in spans for x in s])
                    places.append([{"start": a, "end": b} for a, b in offsets(t.decode(), spans)] if last and spans else [])
                text_out = pa.nulls(len(n_words), pa.string()) if last else batch.column(5).cast(pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(found, pa.list_(pa.string())), pa.array(places, place), text_out, pa.array(ranges, pa.list_(pa.int64()))], names=names)

        out = map_arrow(out, run, schema)
        out = out if last else rewritten(out)
    return out.select(F.col("id").alias(id), "n_words", "n_hit", "items", "spans")


def contaminated_fraction(found: DataFrame):
    """Share of a document's words that lie in test windows."""
    return F.when(found["n_words"] > 0, found["n_hit"] / found["n_words"]).otherwise(F.lit(0.0))


def clean(df: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = WINDOW, limit: int = LIMIT) -> DataFrame:
    """The rows of df that hold no window of any item, with all their columns; a narrow filter, no shuffle."""
    rows = df.select(packed(df).alias("row"), quoted(text).alias("text"))
    for sent, last in shards_of(items, item_id, item_text, limit):

        def run(batches, sent=sent, key=uuid4().hex):
            tree = automaton(key, sent.value, width)
            for batch in batches:
                keep = [not scan(t or b"", tree)[1] for t in texts(batch.column(1))]
                yield batch.filter(pa.array(keep, pa.bool_()))

        rows = map_arrow(rows, run, rows.schema)
        rows = rows if last else rewritten(rows)
    return rows.select("row.*")
