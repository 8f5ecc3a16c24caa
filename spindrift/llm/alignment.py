"""Alignment of two tokenizers over a corpus, by inverted bitmaps of linked id pairs.

A text is encoded by both tokenizers; where a token of either ends at the same byte the text is cut
into groups, and all tokens of one side in a group are linked to all of the other's. Each task inverts
its documents in blocks of at most BLOCK: for an id pair, the bitmap of the block's documents that hold
it linked (only its words of 64 bits that are not zero) and multiplicity planes, of which plane k is the
bitmap of the documents whose number of links less one has bit k. Bitmaps of a pair are merged by OR
within a block and counted by population over all blocks, so a pair has a row a block, however
many documents hold it. The postings, joined to their pair's count, then return to their blocks and
add up each document's scores.

Blocks are numbered by task and written once to the shared folder, with the rows of their documents.
"""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.llm.columns import field, quoted, texts
from spindrift.runtime import map_arrow, rewritten

BLOCK = 1 << 16  # documents of a block; places within it have 16 bits
WORDS = BLOCK // 64
ENTRIES = 3_000_000  # (pair, document) entries held until a block is closed
CHUNK_BYTES, CHUNK_TEXTS, ROWS = 1 << 22, 1000, 20_000
#: Fixed value: the pattern that byte-level vocabularies split text with before their merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_BYTE = re.compile("<0x([0-9A-F]{2})>")


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: printable bytes for themselves, the others from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Side:
    """A tokenizer: ids of texts, and each id's bytes."""

    def __init__(self, pieces: list[bytes]):
        self.size = np.array([len(p) for p in pieces], np.int64)
        self.first = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(pieces), np.uint8)

    def spelt(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of ids, end to end."""
        size = self.size[ids]
        ends = np.cumsum(size)
        return self.flat[np.repeat(self.first[ids] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]


class ByteLevel(Side):
    """A byte-level vocabulary of the tokenizers library, given as its JSON; strings of special tokens are plain text."""

    def __init__(self, content: bytes):
        from tokenizers import Tokenizer

        self.plain = Tokenizer.from_str(content.decode())
        self.plain.encode_special_tokens = True
        spec = json.loads(content)
        special, letters = {x["content"] for x in spec["added_tokens"]}, byte_letters()
        vocab = {bytes(letters[c] for c in w): i for w, i in spec["model"]["vocab"].items() if w not in special}
        pieces = [b""] * (max(spec["model"]["vocab"].values()) + 1)
        for w, i in vocab.items():
            pieces[i] = w
        super().__init__(pieces)
        merges = [m if isinstance(m, str) else " ".join(m) for m in spec["model"]["merges"]]
        self.fast = None
        if [spec["model"]["vocab"].get(m.replace(" ", "")) for m in merges] == list(range(256, 256 + len(merges))):  # ids rank as the merges do
            import tiktoken

            self.fast = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=vocab, special_tokens={})

    def encode(self, batch: list[str]) -> list[np.ndarray]:
        return [self.one(t) for t in batch]

    def one(self, text: str) -> np.ndarray:
        if self.fast:
            try:
                return self.fast.encode_to_numpy(text, disallowed_special=()).astype(np.int64)
            except BaseException as e:  # its pattern matcher gives up on endless runs of white space
                if isinstance(e, (KeyboardInterrupt, SystemExit, MemoryError)):
                    raise
        return np.array(self.plain.encode(text, add_special_tokens=False).ids, np.int64)


class Pieces(Side):
    """A model of the sentencepiece library; it adds the leading space itself."""

    def __init__(self, content: bytes):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=content)
        named = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        super().__init__([bytes([int(m[1], 16)]) if (m := _BYTE.fullmatch(p)) else p.replace("▁", " ").encode() for p in named])

    def encode(self, batch: list[str]) -> list[np.ndarray]:
        return [np.array(x, np.int64) for x in self.model.encode(batch, num_threads=1)]


_made: dict[str, tuple[ByteLevel, Pieces, list[bytes]]] = {}


def sides(key: str, a: bytes, b: bytes) -> tuple[ByteLevel, Pieces, list[bytes]]:
    """The process's tokenizers, and the strings of ids: those of side A with ',' and '|', then those of B with ',' and ';'."""
    if key not in _made:
        _made.clear()
        one, two = ByteLevel(a), Pieces(b)
        shown = [b"%d%c" % (i, c) for i in range(len(one.size)) for c in b",|"] + [b"%d%c" % (i, c) for i in range(len(two.size)) for c in b",;"]
        _made[key] = one, two, shown
    return _made[key]


@dataclass
class Aligned:
    """What a chunk of texts gives: numbers for each text, and (pair, place of the text, links), by pair and place."""

    n_a: np.ndarray
    n_b: np.ndarray
    groups: np.ndarray
    links: np.ndarray
    digests: list[str]
    key: np.ndarray  # pair << 16 | place
    times: np.ndarray


def spread(n: np.ndarray) -> np.ndarray:
    """0, 1, .. for each of n runs of that length."""
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def align(batch: list[bytes | None], one: ByteLevel, two: Pieces, shown: list[bytes], place: int = 0) -> Aligned:
    """Groups and links of a chunk of texts, whose places begin at `place`.

    A pair is A's id times the size of B's vocabulary plus B's id. A text that is null, empty or not
    spelt by both sides' tokens has none.
    """
    n = len(batch)
    zero = lambda: np.zeros(n, np.int64)
    out = Aligned(zero(), zero(), zero(), zero(), [""] * n, np.zeros(0, np.int64), np.zeros(0, np.int64))
    full = [(i, t) for i, t in enumerate(batch) if t]
    plain = [t.decode("utf-8", "replace") for _, t in full]
    kept = []
    for (i, t), x, y in zip(full, one.encode([" " + t for t in plain]), two.encode(plain), strict=True):
        size = len(t) + 1
        if one.size[x].sum() == size == two.size[y].sum():
            want = np.frombuffer(b" " + t, np.uint8)
            if np.array_equal(one.spelt(x), want) and np.array_equal(two.spelt(y), want):
                kept.append((i, size, x, y))
    if not kept:
        return out
    own = np.array([i for i, *_ in kept])
    ends = np.cumsum([size for _, size, *_ in kept])
    a, b = (np.concatenate([k[side] for k in kept]) for side in (2, 3))
    many_a, many_b = (np.array([len(k[side]) for k in kept]) for side in (2, 3))
    end_a, end_b = np.cumsum(one.size[a]), np.cumsum(two.size[b])
    seen = np.zeros(ends[-1] + 1, np.bool_)
    seen[end_a] = True
    both = end_b[seen[end_b]]  # the ends of groups; every text's end is one
    group_a, group_b = np.searchsorted(both, end_a), np.searchsorted(both, end_b)
    in_a, in_b = np.bincount(group_a, minlength=len(both)), np.bincount(group_b, minlength=len(both))
    first_a, first_b = np.cumsum(in_a) - in_a, np.cumsum(in_b) - in_b
    text = np.searchsorted(ends, both)  # of each group
    out.n_a[own], out.n_b[own] = many_a, many_b
    out.groups[own] = np.bincount(text, minlength=len(own))
    np.add.at(out.links, own[text], in_a * in_b)

    # a text's groups as a string: A's ids, then B's, group by group
    code = np.empty(len(a) + len(b), np.int64)
    code[np.arange(len(a)) + first_b[group_a]] = 2 * a + (np.r_[group_a[1:], -1] != group_a)
    code[np.arange(len(b)) + (first_a + in_a)[group_b]] = 2 * (len(one.size) + b) + (np.r_[group_b[1:], -1] != group_b)
    at = 0
    for i, m in zip(own.tolist(), (many_a + many_b).tolist(), strict=True):
        out.digests[i] = hashlib.sha256(b"".join(map(shown.__getitem__, code[at : at + m].tolist()))[:-1]).hexdigest()
        at += m

    # links; of a large group, each side's distinct ids are paired, weighted by how often they occur
    doc = (place + own)[text]
    large = in_a * in_b > 4096
    few = ~large[group_a]
    times = in_b[group_a[few]]
    pair = np.repeat(a[few], times) * len(two.size) + b[np.repeat(first_b[group_a[few]], times) + spread(times)]
    keys, weights = [pair << 16 | np.repeat(doc[group_a[few]], times)], [np.ones(len(pair), np.int64)]
    for g in np.flatnonzero(large).tolist():
        x, nx = np.unique(a[first_a[g] : first_a[g] + in_a[g]], return_counts=True)
        y, ny = np.unique(b[first_b[g] : first_b[g] + in_b[g]], return_counts=True)
        keys.append(((x[:, None] * len(two.size) + y[None, :]) << 16 | doc[g]).ravel())
        weights.append((nx[:, None] * ny[None, :]).ravel())
    out.key, out.times = merged(keys, weights)
    return out


def merged(keys: list[np.ndarray], weights: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order, and the sum of each one's weights."""
    key = np.concatenate(keys) if keys else np.zeros(0, np.int64)
    if not len(key):
        return key, key
    if len(keys) == 1 and (weights[0] == 1).all():
        key.sort()
        start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        return key[start], np.diff(np.r_[start, len(key)])
    order = np.argsort(key, kind="stable")
    key, weight = key[order], np.concatenate(weights)[order]
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    return key[start], np.add.reduceat(weight, start)


def bitmaps(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pair, place of the word, word) of the words that are not zero, from ordered keys pair << 16 | place."""
    word = key >> 6
    start = np.flatnonzero(np.r_[True, word[1:] != word[:-1]]) if len(word) else np.zeros(0, np.int64)
    bits = np.left_shift(np.uint64(1), (key & 63).astype(np.uint64))
    return word[start] >> 10, word[start] & (WORDS - 1), np.bitwise_or.reduceat(bits, start).view(np.int64) if len(start) else np.zeros(0, np.int64)


def unpacked(place: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which of the words, place of the document) of every bit that is set."""
    bits = np.unpackbits(np.ascontiguousarray(word).view(np.uint8), bitorder="little")
    at = np.flatnonzero(bits)
    which = at >> 6
    return which, (place[which] << 6) + (at & 63)


def postings(key: np.ndarray, times: np.ndarray) -> list[pa.Array]:
    """Arrow columns pair, places, words, plane_places, plane_words; a plane's places are its number times WORDS more."""
    parts = [bitmaps(key)]
    more, plane = times - 1, 0
    while (more >> plane).any():
        p, at, word = bitmaps(key[(more >> plane & 1) == 1])
        parts.append((p, at + plane * WORDS, word))
        plane += 1
    pairs = np.unique(parts[0][0])

    def lists(part):
        p, at, word = (np.concatenate(x) for x in zip(*part, strict=True)) if part else (np.zeros(0, np.int64),) * 3
        order = np.argsort(p, kind="stable")
        offsets = pa.array(np.searchsorted(p[order], np.r_[pairs, np.iinfo(np.int64).max]).astype(np.int32))
        return pa.ListArray.from_arrays(offsets, pa.array(at[order].astype(np.int32))), pa.ListArray.from_arrays(offsets, pa.array(word[order]))

    return [pa.array(pairs), *lists(parts[:1]), *lists(parts[1:])]


NUMBERS = ("n_a", "n_b", "n_groups", "n_links")


def index(df: DataFrame, a: str, b: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The blocks of df, written to the shared folder: a row for each document and one for each posting.

    block and place name a document of df; its row has id, the numbers and groups_sha256, and pair is
    null. A posting has block, pair, places, words, plane_places and plane_words. a and b are paths of
    files that the driver can read; their contents go to the executors.
    """
    sc = df.sparkSession.sparkContext
    sent = sc.broadcast((Path(a).read_bytes(), Path(b).read_bytes()))
    name = f"{a}:{b}:{len(sent.value[0])}:{len(sent.value[1])}"
    lists = [pa.list_(pa.int32()), pa.list_(pa.int64())]
    kinds = [pa.int64(), pa.int32(), None, *[pa.int64()] * 4, pa.string(), pa.int64(), *lists, *lists]
    names = ["block", "place", "id", *NUMBERS, "groups_sha256", "pair", "places", "words", "plane_places", "plane_words"]

    def run(batches):
        tools = sides(name, *sent.value)
        block, place = TaskContext.get().partitionId() << 32, 0
        keys: list[np.ndarray] = []
        times: list[np.ndarray] = []
        kind = None

        def close():
            key, time = merged(keys, times)
            if len(key):
                columns = postings(key, time)
                for at in range(0, len(columns[0]), ROWS):
                    part = [c.slice(at, ROWS) for c in columns]
                    n = len(part[0])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, block)), pa.nulls(n, pa.int32()), pa.nulls(n, kind), *(pa.nulls(n, pa.int64()) for _ in NUMBERS), pa.nulls(n, pa.string()), *part], names=names)
            keys.clear()
            times.clear()

        for batch in batches:
            kind = batch.column(0).type
            held, size, first = [], 0, 0
            last = batch.num_rows - 1
            for i, t in enumerate(texts(batch.column(1))):
                held.append(t)
                size += len(t or b"")
                if size < CHUNK_BYTES and len(held) < CHUNK_TEXTS and i < last:
                    continue
                if place + len(held) > BLOCK or sum(map(len, keys)) > ENTRIES:
                    yield from close()
                    block, place = block + 1, 0
                x, n = align(held, *tools, place), len(held)
                numbers = [pa.array(v) for v in (x.n_a, x.n_b, x.groups, x.links)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, block)), pa.array(np.arange(place, place + n, dtype=np.int32)), batch.column(0).slice(first, n), *numbers, pa.array(x.digests, pa.string()), *(pa.nulls(n, k) for k in kinds[8:])],
                    names=names,
                )
                keys.append(x.key)
                times.append(x.times)
                held, size, first, place = [], 0, i + 1, place + n
        yield from close()

    numbers = ", ".join(f"{c} bigint" for c in NUMBERS)
    schema = f"block bigint, place int, {field(df, id, 'id')}, {numbers}, groups_sha256 string, pair bigint, places array<int>, words array<bigint>, plane_places array<int>, plane_words array<bigint>"
    return rewritten(map_arrow(df.select(quoted(id), quoted(text)), run, schema))


def population(words: str) -> Column:
    return F.aggregate(words, F.lit(0).cast("bigint"), lambda n, w: n + F.bit_count(w))


def pairs(indexed: DataFrame, size_b: int) -> DataFrame:
    """(pair, a, b, documents, links, best): how many documents hold a pair, its links, and whether none of A's id is held by more."""
    plane = F.zip_with("plane_places", "plane_words", lambda at, w: F.expr("1L").cast("bigint") * F.pow(F.lit(2), F.floor(at / WORDS)).cast("bigint") * F.bit_count(w))
    own = indexed.where("pair is not null").select("pair", population("words").alias("documents"), F.aggregate(plane, F.lit(0).cast("bigint"), lambda n, x: n + x).alias("more"))
    counts = own.groupBy("pair").agg(F.sum("documents").alias("documents"), F.sum(F.col("documents") + F.col("more")).alias("links"))
    counts = counts.select("pair", F.expr(f"pair div {size_b}").alias("a"), (F.col("pair") % size_b).alias("b"), "documents", "links")
    most = counts.groupBy("a").agg(F.max("documents").alias("most"))
    return counts.join(F.broadcast(most), "a").select("pair", "a", "b", "documents", "links", (F.col("documents") == F.col("most")).alias("best"))  # one row an id of A's vocabulary


def scores(indexed: DataFrame, counted: DataFrame) -> DataFrame:
    """(block, place, n_best, count_sum): the sums over each document's links, from the postings of its block."""
    rows = indexed.where("pair is not null").select("block", "pair", "places", "words", "plane_places", "plane_words")
    rows = rows.join(counted.select("pair", "documents", "best"), "pair").drop("pair")
    columns = ["block", "documents", "best", "places", "words", "plane_places", "plane_words"]

    def run(batches):
        block, best, total = None, np.zeros(BLOCK, np.int64), np.zeros(BLOCK, np.int64)

        def flush():
            at = np.flatnonzero(total)
            out = pa.RecordBatch.from_arrays([pa.array(np.full(len(at), block)), pa.array(at.astype(np.int32)), pa.array(best[at]), pa.array(total[at])], names=["block", "place", "n_best", "count_sum"])
            best[:], total[:] = 0, 0
            return out

        for batch in batches:
            blocks = batch.column(0).to_numpy()
            for at in np.flatnonzero(np.r_[True, blocks[1:] != blocks[:-1]]).tolist() if len(blocks) else []:
                n = int(np.searchsorted(blocks[at:], blocks[at], "right"))
                if block is not None and block != blocks[at]:
                    yield flush()
                block = int(blocks[at])
                count, top = batch.column(1).slice(at, n).to_numpy(), batch.column(2).slice(at, n).to_numpy(zero_copy_only=False)
                for column, planes in ((3, False), (5, True)):
                    places, words = batch.column(column).slice(at, n), batch.column(column + 1).slice(at, n)
                    row = np.repeat(np.arange(n), np.diff(places.offsets.to_numpy()))
                    slot, word = places.flatten().to_numpy().astype(np.int64), words.flatten().to_numpy()
                    for k in range(0, len(word), 1 << 16):
                        which, doc = unpacked(slot[k : k + (1 << 16)], word[k : k + (1 << 16)])
                        own = row[k + which]
                        weight = 1 << (doc // BLOCK) if planes else np.ones(len(doc), np.int64)
                        doc = doc % BLOCK
                        np.add.at(total, doc, weight * count[own])
                        np.add.at(best, doc, weight * top[own])
        if block is not None:
            yield flush()

    dealt = rows.select(*columns).repartition("block").sortWithinPartitions("block")
    return map_arrow(dealt, run, "block bigint, place int, n_best bigint, count_sum bigint")


def vocabulary(model: str) -> int:
    """The number of pieces of B's model."""
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=model).get_piece_size()


def measure(df: DataFrame, a: str, b: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row of df.

    n_best and count_sum are over a document's links: how many have the count (documents that hold
    the pair linked) that is the highest of their A id, and the sum of the counts. A text that is
    null, empty or not spelt by the tokens of both sides has zeros and an empty groups_sha256. Rows
    that repeat an id or a text each count; other columns play no part.
    """
    indexed = index(df, a, b, id, text)
    found = scores(indexed, pairs(indexed, vocabulary(b)))
    rows = indexed.where("pair is null").select("block", "place", "id", *NUMBERS, "groups_sha256").join(found, ["block", "place"], "left")
    sums = [F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in ("n_best", "count_sum")]
    return rows.select(F.col("id").alias(id), *NUMBERS, *sums, "groups_sha256")
