"""Words of many texts at once, as numpy ranges and 64-bit hashes.

Texts are taken in slices of bounded size; a longer text is cut between words into several
slices, so memory does not follow the longest text.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np

from spindrift.llm.decontaminate import TABLE

SLICE = 1 << 20
_rng = np.random.default_rng(20240229)
BYTE_CODES = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
POWERS = np.multiply.accumulate(np.r_[np.uint64(1), np.full(4095, 0x9E3779B97F4A7C15, np.uint64)])


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads every input bit over the whole word (the splitmix64 finaliser)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@dataclass
class Words:
    """letters: all words' bytes, end to end; first: where each begins; size: its bytes; text: its text's number."""

    letters: np.ndarray
    first: np.ndarray
    size: np.ndarray
    text: np.ndarray
    hash: np.ndarray

    def distinct(self) -> tuple[Words, np.ndarray, np.ndarray]:
        """One of each word, then for every word its place there, then each one's count."""
        _, at, back, count = np.unique(self.hash, return_index=True, return_inverse=True, return_counts=True)
        size = self.size[at]
        first = np.cumsum(size) - size
        take = np.arange(int(size.sum())) + np.repeat(self.first[at] - first, size)
        return Words(self.letters[take], first, size, self.text[at], self.hash[at]), back, count


def hashes(text: bytes | None) -> np.ndarray:
    """The hashes of a text's words, in order."""
    return np.concatenate([np.zeros(0, np.uint64), *(words(piece).hash for piece in cut([text]))])


def cut(texts: Iterable[bytes | None], size: int = SLICE) -> Iterator[list[tuple[int, bytes]]]:
    """Texts' normalised bytes in slices of about `size` bytes, as (number, bytes)."""
    held, n = [], 0
    for i, t in enumerate(texts):
        t = (t or b"").translate(TABLE)
        at = 0
        while at < len(t):
            end = len(t)
            if end - at > size:
                end = t.find(b" ", at + size)
                end = len(t) if end < 0 else end
            held.append((i, t[at:end]))
            n += end - at
            at = end
            if n >= size:
                yield held
                held, n = [], 0
    if held:
        yield held


def words(piece: list[tuple[int, bytes]]) -> Words:
    buf = np.frombuffer(b" " + b" ".join(t for _, t in piece) + b" ", np.uint8)
    inside = buf != 32
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    start, end = edge[::2], edge[1::2]
    size = end - start
    letters = buf[inside]
    first = np.cumsum(size) - size
    rel = np.arange(len(letters)) - np.repeat(first, size)
    code = BYTE_CODES[letters] * POWERS[rel & (len(POWERS) - 1)]
    h = mix(np.add.reduceat(code, first) + size.astype(np.uint64)) if len(first) else np.zeros(0, np.uint64)
    bound = np.cumsum([1, *(len(t) + 1 for _, t in piece)])
    text = np.array([i for i, _ in piece], np.int64)[np.searchsorted(bound, start, "right") - 1] if len(start) else np.zeros(0, np.int64)
    return Words(letters, first, size, text, h)


def grams(w: Words, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The byte n-grams that end on each letter or just behind each word, as integers.

    A word is preceded by order - 1 blanks and followed by one. Returns the grams, and where each
    word's begin and how many it has.
    """
    room = w.size + order
    base = np.cumsum(room) - room
    out = np.full(int(room.sum()), 32, np.uint64)
    shift = base + order - 1 - w.first
    out[np.arange(len(w.letters)) + np.repeat(shift, w.size)] = w.letters
    key = np.zeros(max(0, len(out) - order + 1), np.uint64)
    for k in range(order):
        key = (key << np.uint64(8)) | out[k : len(out) - order + 1 + k]
    n = w.size + 1
    begin = np.cumsum(n) - n
    take = np.arange(int(n.sum())) + np.repeat(base - begin, n)
    return key[take], begin, n


class Counts:
    """Sums of int64 counts by key, compressed whenever they grow past `limit` entries."""

    def __init__(self, limit: int = 1 << 20):
        self.keys, self.sums, self.held, self.limit = [], [], 0, limit

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        k, back = np.unique(keys, return_inverse=True)
        self.keys.append(k)
        self.sums.append(np.bincount(back, counts, len(k)).astype(np.int64))
        self.held += len(k)
        if self.held > self.limit:
            self.squeeze()

    def squeeze(self) -> None:
        if len(self.keys) > 1:
            k, back = np.unique(np.concatenate(self.keys), return_inverse=True)
            s = np.bincount(back, np.concatenate(self.sums), len(k)).astype(np.int64)
            self.keys, self.sums, self.held = [k], [s], len(k)

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        self.squeeze()
        out = (self.keys[0], self.sums[0]) if self.keys else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        self.keys, self.sums, self.held = [], [], 0
        return out
