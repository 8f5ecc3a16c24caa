"""Token ids of many texts, as the tokenizers library gives them.

The tokenizer of word_bpe_49k.json lower-cases, drops white space and splits at a pattern, so ids
depend on each split alone. Texts of common characters (SAFE) are split here, over whole arrays of
characters; Arrow numbers the different splits of some millions of characters, and each of these is
merged once, by tiktoken. Nothing is kept from one round to the next. Any other text, and a split
longer than LONG, goes through the tokenizers library.

tiktoken merges by rank of the merged bytes and knows no end of a word, so a split is given to it
with a blank after it: each byte and the blank are merged first, which are the vocabulary's 256
letters that end a word. Its ids are then those of the library, as each token of this vocabulary comes
from one merge, later than those of its parts, and is what its own letters are merged to
(tested for every token).
"""

from __future__ import annotations

import json as reader
import re

import numpy as np
import pyarrow as pa

from spindrift.llm.alignment import byte_letters

#: Characters that neither normalisation nor the two libraries' tables treat differently.
SAFE = re.compile("[\t\n\r\x20-\x7e\xa0-\xff‐-‧‰-⁞€]*")
#: The splitting pattern of the tokenizer is 's|'t|'re|'ve|'m|'ll|'d|[letters]+|[digit]|[others]+; these are the letters and digits of SAFE in lower case.
LETTERS, DIGITS = re.compile("[a-zªµºß-öø-ÿ]"), re.compile("[0-9²³¹¼-¾]")
#: Characters of a slice of a text; of slices that are encoded together; of the longest split that tiktoken is given.
SLICE, KEPT, LONG = 1 << 19, 1 << 21, 400
CUT = re.compile("[ \n]")
BLANK, LETTER, DIGIT, OTHER = range(4)
_made: dict[str, Encoder] = {}


def _kind(c: str) -> int:
    return BLANK if c.isspace() else LETTER if LETTERS.match(c) else DIGIT if DIGITS.match(c) else OTHER


#: The kind of each character of SAFE: by code point, and by Latin-1 byte as bytes.translate takes it, beside the lower case.
KINDS = np.full(1 << 16, OTHER, np.uint8)
KINDS[:256] = [_kind(chr(i)) for i in range(256)]
KINDS_1, LOWER_1 = KINDS[:256].tobytes(), bytes(ord(chr(i).lower()) for i in range(256))


def split(text: str) -> tuple[np.ndarray, str, np.ndarray, np.ndarray]:
    """(letters, coding, first, upto) of a text of SAFE's characters in lower case: its splits' letters end to end, as code units, where each split begins in the text and where it ends in letters."""
    text += "\n\n"  # so that two characters follow every split's first
    try:
        coding, low = "latin-1", text.encode("latin-1").translate(LOWER_1)
        units, kind = np.frombuffer(low, np.uint8), np.frombuffer(low.translate(KINDS_1), np.uint8)
    except UnicodeEncodeError:
        coding = "utf-16-le"
        units = np.frombuffer(text.lower().encode(coding), np.uint16)
        kind = KINDS[units]
    full = kind != BLANK
    begin = full.copy()
    begin[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
    # an apostrophe that begins a split takes the letters of 's, 't, 'm, 'd, 're, 've or 'll along
    at = np.flatnonzero(begin[:-2] & (units[:-2] == ord("'")) & (kind[1:-1] == LETTER))
    x, y = units[at + 1], units[at + 2]
    two = ((x == ord("r")) | (x == ord("v"))) & (y == ord("e")) | (x == ord("l")) & (y == ord("l"))
    one = (x == ord("s")) | (x == ord("t")) | (x == ord("m")) | (x == ord("d"))
    begin[at[one | two] + 1] = False
    after = np.r_[at[one] + 2, at[two] + 3]
    begin[after[kind[after] == LETTER]] = True
    letters, first = units[full], np.flatnonzero(begin)
    return letters, coding, first, np.r_[np.flatnonzero(begin[full]), len(letters)][1 : len(first) + 1]


class Encoder:
    def __init__(self, json: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(json)
        self.special = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        model, letters = reader.loads(json)["model"], byte_letters()
        tokens = [*letters, *(c + "</w>" for c in letters), *("".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"])]
        spelt = [bytes(letters[c] for c in w.removesuffix("</w>")) + b" " * w.endswith("</w>") for w in tokens]
        self.fast = tiktoken.Encoding("words", pat_str="[^ ]+ ", mergeable_ranks={w: i for i, w in enumerate(spelt)}, special_tokens={})
        self.ids = np.array([model["vocab"][w] for w in tokens], np.uint32)
        self.last = np.array([w.endswith("</w>") for w in tokens])

    @staticmethod
    def of(key: str, json: str) -> Encoder:
        """The process's encoder for that vocabulary."""
        if key not in _made:
            _made.clear()
            _made[key] = Encoder(json)
        return _made[key]

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def merged(self, letters: np.ndarray, upto: np.ndarray, coding: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, first, size): ids of the splits that end at upto in letters, and each one's place there."""
        size = np.diff(upto, prepend=0)
        short = size <= LONG
        some = letters if short.all() else letters[np.repeat(short, size)]
        spelt = np.insert(some, np.cumsum(size[short]), ord(" ")).tobytes().decode(coding)
        got = self.fast.encode_to_numpy(spelt, disallowed_special=())
        ends = np.flatnonzero(self.last[got]) + 1
        first, n = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
        first[short], n[short] = np.r_[0, ends][:-1], np.diff(ends, prepend=0)
        ids, at = [self.ids[got]], len(got)
        for k in np.flatnonzero(~short):
            ids.append(self.whole(letters[upto[k] - size[k] : upto[k]].tobytes().decode(coding)))
            first[k], n[k] = at, len(ids[-1])
            at += n[k]
        return np.concatenate(ids), first, n

    def round(self, parts: list[str]) -> list[np.ndarray]:
        """The ids of each of several texts of SAFE's characters."""
        letters, coding, begin, upto = split("\n".join(parts))
        if not len(begin):
            return [np.zeros(0, np.uint32) for _ in parts]
        wide = letters.itemsize
        words = pa.Array.from_buffers(pa.large_binary(), len(upto), [None, pa.py_buffer(np.r_[0, upto] * wide), pa.py_buffer(letters)]).dictionary_encode()
        number, words = words.indices.to_numpy(), words.dictionary
        ends = np.frombuffer(words.buffers()[1], np.int64, len(words) + 1)[1:] // wide
        ids, first, size = self.merged(np.frombuffer(words.buffers()[2], letters.dtype, ends[-1]), ends, coding)
        size, first = size[number], first[number]
        ends = np.cumsum(size)
        flat = ids[np.arange(ends[-1]) + np.repeat(first - (ends - size), size)]
        cuts = np.r_[0, ends][np.searchsorted(begin, np.cumsum([len(x) + 1 for x in parts]))]
        return np.split(flat, cuts[:-1])

    def encode_many(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text; texts of any length are taken in slices that end at a blank or a line's end."""
        out: list[list[np.ndarray]] = [[] for _ in texts]
        kept: list[tuple[int, int]] = []  # text, and which of its slices
        parts: list[str] = []
        held = 0

        def flush():
            for (i, k), ids in zip(kept, self.round(parts), strict=True):
                out[i][k] = ids
            kept.clear()
            parts.clear()

        for i, text in enumerate(texts):
            at = 0
            while at < len(text):
                end = len(text)
                if end - at > SLICE:
                    cut = CUT.search(text, at + SLICE)
                    end = cut.start() if cut else end
                part = text[at:end]
                if not SAFE.fullmatch(part) or any(x in part for x in self.special):
                    out[i].append(self.whole(part))
                else:
                    kept.append((i, len(out[i])))
                    out[i].append(np.zeros(0, np.uint32))
                    parts.append(part)
                    held += len(part)
                    if held > KEPT:
                        flush()
                        held = 0
                at = end
        if parts:
            flush()
        return [np.concatenate(x) if len(x) > 1 else x[0] if x else np.zeros(0, np.uint32) for x in out]

    def encode(self, text: str) -> np.ndarray:
        return self.encode_many([text])[0]
