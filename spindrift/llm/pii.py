"""Personal data by a character-level bidirectional LSTM with CRF transitions.

Four kinds of span are found by pattern: email addresses, IP addresses, card numbers and phone
numbers. The network adds spans that are written otherwise (numbers without a plus sign, spelt-out
addresses). It is trained here, in numpy, from labelled spans, and reads windows of WINDOW
characters that overlap by half. Each window is decoded by itself; what a window's edge cuts is joined
to what its neighbour sees of it, up to LONGEST characters, and what all windows of a text propose is reconciled
globally: the set of disjoint spans of the greatest total score, base spans first.

Windows lie on a grid over the whole text. A span is kept only if its letters can be what it is said
to be (plausible), which takes a digit, an at sign or a spelt-out address within it; so windows further
than LONGEST from any of these are not decoded, as whatever they proposed would be dropped.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import math
import random
import re
from bisect import bisect_left, bisect_right
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from spindrift.llm.columns import map_texts
from spindrift.runtime import shared_folder

KINDS = ("email", "ip", "card", "phone")
TAGS = 1 + len(KINDS)  # 0: none
WINDOW, HIDDEN, EMBED = 96, 24, 10
HALF, LONGEST = WINDOW // 2, 3 * WINDOW // 2
STEPS, VERSION = 900, 2
SLICE = 2048  # windows decoded at once
LEAST = 1.0  # mean margin over none that a span must have
#: The base patterns.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3,}+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9]){15,}+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: The words of a spelt-out address, whatever is around them.
_AT, _DOT = (rf"(?<![^\W_]){x}(?![^\W_])" for x in ("at", "dot"))
#: A name, at, a host, and dot or a point that is joined to what follows or stands apart on both sides.
_SPELT = re.compile(rf"[^\W_][\W_]*{_AT}[\W_]*[^\W_][\w\x20-]{{0,64}}?(?:[\W_]{{0,4}}{_DOT}[\W_]*|\.|[\W_]\.[\W_]?)[^\W_]", re.IGNORECASE)
_MARK = re.compile(r"[0-9@]")
_SPELT_AT = re.compile(_AT, re.IGNORECASE)
_DIGITS = re.compile(r"[0-9]")
#: Spelt out beyond doubt: at and dot are both words, or at stands in brackets.
_SURE = re.compile(rf"{_AT}[\W_]*[^\W_][\w.-]*[\W_]*{_DOT}[\W_]*[^\W_]|[\[({{<]\s*{_AT}\s*[\])}}>]\s*[\w-]+\.[^\W_]", re.IGNORECASE)
FORM = 3.0  # what that adds to a span's score, as its emissions are weak on letters and blanks

SYMBOLS = {c: i for i, c in enumerate("\0 aA0@.-_+()[]:,;/\n")}
_CODE = np.full(256, 0, np.int64)
for _b in range(256):
    _c = chr(_b)
    _c = "a" if _c.islower() else "A" if _c.isupper() else "0" if _c in "0123456789" else _c
    _CODE[_b] = SYMBOLS.get(_c, len(SYMBOLS))
#: Letters of spelt-out addresses keep their own codes.
for _i, _c in enumerate("adot"):
    _CODE[ord(_c)] = len(SYMBOLS) + 1 + _i
CODES = len(SYMBOLS) + 5


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if k % 2 == 0 else (n * 2 - 9 if n > 4 else n * 2)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        host = _HOST.match(text, at + 1) if start < at else None
        if host:
            out.append((start, host.end()))
            last = host.end()
        else:
            last = max(last, start)
        at = text.find("@", max(at + 1, last))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base patterns, by kind, then start; linear in the text."""
    out = [(0, a, b) for a, b in emails(text)]
    if not _DIGITS.search(text):
        return out
    for m in _DOTTED.finditer(text):
        parts, begin = m.group().split("."), m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            size = sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                out.append((1, begin, begin + size))
            begin += size + 1
    for m in _CARD.finditer(text):
        digits = "".join(c for c in m.group() if c in "0123456789")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append((2, m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(c in "0123456789" for c in m.group()) <= 15:
                out.append((3, m.start(), m.end()))
    return out


def encode(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode("latin-1", "replace"), np.uint8)
    return _CODE[raw]


def lse(a: np.ndarray, axis: int) -> np.ndarray:
    """Logarithm of a sum of exponentials."""
    m = a.max(axis, keepdims=True)
    return m.squeeze(axis) + np.log(np.exp(a - m).sum(axis))


@dataclass
class Model:
    """embed [code, e]; wx [side, e, 4h], wh [side, h, 4h], b [side, 4h] of both directions; out [2h, tag] and bias; moves [tag, tag]."""

    p: dict[str, np.ndarray]

    def run(self, codes: np.ndarray, keep: bool = False):
        """Emission scores [window, time, tag] of codes [window, time]; both directions advance together."""
        p, (n, t) = self.p, codes.shape
        kind = p["embed"].dtype
        x = p["embed"][codes]
        seq = np.stack([x, x[:, ::-1]])  # [side, window, time, e]
        pre = seq.reshape(2, n * t, EMBED) @ p["wx"] + p["b"][:, None]
        pre = np.ascontiguousarray(pre.reshape(2, n, t, 4 * HIDDEN).transpose(2, 0, 1, 3))
        h, c = np.zeros((2, n, HIDDEN), kind), np.zeros((2, n, HIDDEN), kind)
        hs, steps = np.zeros((t, 2, n, HIDDEN), kind), []
        for k in range(t):
            z = pre[k] + h @ p["wh"]
            g = 1 / (1 + np.exp(-z[..., : 3 * HIDDEN]))
            u = np.tanh(z[..., 3 * HIDDEN :])
            i, f, o = g[..., :HIDDEN], g[..., HIDDEN : 2 * HIDDEN], g[..., 2 * HIDDEN :]
            c_new = f * c + i * u
            tc = np.tanh(c_new)
            if keep:
                steps.append((h, c, i, f, o, u, tc))
            h, c = o * tc, c_new
            hs[k] = h
        both = np.concatenate([hs[:, 0], hs[::-1, 1]], 2).transpose(1, 0, 2)
        e = (both.reshape(n * t, 2 * HIDDEN) @ p["out"]).reshape(n, t, TAGS) + p["bias"]
        return (e, both, seq, steps) if keep else e

    def decode(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best tags [window, time] by Viterbi, and each tag's margin over none in its emission."""
        e, moves = self.run(codes), self.p["moves"]
        n, t, _ = e.shape
        score, back = e[:, 0].copy(), np.zeros((n, t, TAGS), np.int8)
        for k in range(1, t):
            all_ = score[:, :, None] + moves
            back[:, k] = all_.argmax(1)
            score = all_.max(1) + e[:, k]
        tags = np.zeros((n, t), np.int64)
        tags[:, -1] = score.argmax(1)
        for k in range(t - 1, 0, -1):
            tags[:, k - 1] = back[np.arange(n), k, tags[:, k]]
        margin = np.take_along_axis(e, tags[:, :, None], 2)[:, :, 0] - e[:, :, 0]
        return tags, margin

    def gradient(self, codes: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood of the tags under the CRF, and its gradient."""
        p = self.p
        e, both, seq, steps = self.run(codes, keep=True)
        n, t, _ = e.shape
        moves = p["moves"]
        al, be = [e[:, 0]], [np.zeros((n, TAGS))]
        for k in range(1, t):
            al.append(lse(al[-1][:, :, None] + moves, 1) + e[:, k])
        for k in range(t - 1, 0, -1):
            be.append(lse(moves[None] + (e[:, k] + be[-1])[:, None, :], 2))
        al, be = np.stack(al, 1), np.stack(be[::-1], 1)
        z = lse(al[:, -1], 1)
        rows = np.arange(n)
        gold = np.take_along_axis(e, tags[:, :, None], 2).sum((1, 2)) + moves[tags[:, :-1], tags[:, 1:]].sum(1)
        de = np.exp(al + be - z[:, None, None])
        pairs = np.exp(al[:, :-1, :, None] + moves + (e[:, 1:] + be[:, 1:])[:, :, None, :] - z[:, None, None, None]).sum((0, 1))
        dm = pairs - np.bincount((tags[:, :-1] * TAGS + tags[:, 1:]).ravel(), minlength=TAGS * TAGS).reshape(TAGS, TAGS)
        de[rows[:, None], np.arange(t), tags] -= 1
        de /= n
        g = {"moves": dm / n, "out": both.reshape(n * t, 2 * HIDDEN).T @ de.reshape(n * t, TAGS), "bias": de.sum((0, 1))}
        dboth = (de.reshape(n * t, TAGS) @ p["out"].T).reshape(n, t, 2 * HIDDEN).transpose(1, 0, 2)
        dh_all = np.stack([dboth[..., :HIDDEN], dboth[::-1, :, HIDDEN:]], 1)  # [time, side, window, h]
        dh, dc = np.zeros((2, n, HIDDEN)), np.zeros((2, n, HIDDEN))
        dz_all, back = np.zeros((t, 2, n, 4 * HIDDEN)), p["wh"].transpose(0, 2, 1)
        for k in range(t - 1, -1, -1):
            h, c, i, f, o, u, tc = steps[k]
            dh = dh + dh_all[k]
            dc = dc + dh * o * (1 - tc * tc)
            dz = dz_all[k]
            dz[..., :HIDDEN] = dc * u * i * (1 - i)
            dz[..., HIDDEN : 2 * HIDDEN] = dc * c * f * (1 - f)
            dz[..., 2 * HIDDEN : 3 * HIDDEN] = dh * tc * o * (1 - o)
            dz[..., 3 * HIDDEN :] = dc * i * (1 - u * u)
            dh, dc = dz @ back, dc * f
        held = np.stack([s[0] for s in steps]).transpose(1, 0, 2, 3).reshape(2, t * n, HIDDEN)
        dz_side = dz_all.transpose(1, 0, 2, 3).reshape(2, t * n, 4 * HIDDEN)
        g["wh"], g["b"] = held.transpose(0, 2, 1) @ dz_side, dz_side.sum(1)
        seq_side = seq.transpose(0, 2, 1, 3).reshape(2, t * n, EMBED)
        g["wx"] = seq_side.transpose(0, 2, 1) @ dz_side
        dx = (dz_side @ p["wx"].transpose(0, 2, 1)).reshape(2, t, n, EMBED)
        demb = (dx[0] + dx[1, ::-1]).transpose(1, 0, 2).reshape(n * t, EMBED)
        flat = codes.ravel()
        g["embed"] = np.stack([np.bincount(flat, demb[:, k], CODES) for k in range(EMBED)], 1)
        return float((z - gold).mean()), g


def start(seed: int = 11) -> Model:
    rng = np.random.default_rng(seed)
    w = lambda *s: rng.standard_normal(s) / np.sqrt(s[-2])
    b = np.zeros((2, 4 * HIDDEN))
    b[:, HIDDEN : 2 * HIDDEN] = 1
    return Model({"embed": w(CODES, EMBED) * np.sqrt(CODES / 4), "out": w(2 * HIDDEN, TAGS), "bias": np.zeros(TAGS), "moves": np.zeros((TAGS, TAGS)), "wx": w(2, EMBED, 4 * HIDDEN), "wh": w(2, HIDDEN, 4 * HIDDEN), "b": b})


def samples(n: int = 6000, seed: int = 5) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Texts with labelled spans (kind, start, end), written by rule: prose, data, and look-alikes that are none."""
    rng = random.Random(seed)
    d = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    word = lambda: "".join(rng.choice(["th", "an", "er", "on", "re", "é", "ti", "ing", "o", "st", "le", "a", "d", "to", "at"]) for _ in range(rng.randint(1, 4)))
    name = lambda: word().replace("é", "e")

    def marked(x):
        """A word or sign that stands for at or dot, set apart in one of many ways."""
        x = rng.choice([x, x, x.upper(), x.capitalize()])
        left, right = rng.choice(["[]", "()", "{}", "<>", "--", "__", "**", "||"])
        return rng.choice([f" {x} ", f" {x} ", f" {x} ", f"{left}{x}{right}", f" {left}{x}{right} ", f" {left} {x} {right} "])

    def email():
        user = rng.choice([name(), name() + d(2), *(name() + x + name() for x in "._-"), name() + marked("dot") + name()])
        top = rng.choice(["com", "org", "net", "io", "de", "fr", "es", "info", "co.uk"])
        host = rng.choice([name(), name() + d(1), name() + "-" + name(), name() + "." + name()])
        if rng.random() < 0.4:
            return rng.choice([f"{user}@{host}.{top}", f"{user}@{host}.{top}", f"{user} @ {host}.{top}", f"{user} @ {host} . {top}", f"{user}@{host}{marked('dot')}{top}"])
        dot = marked("dot") if rng.random() < 0.8 else "."
        return user + marked("at") + host.replace(".", dot) + dot + top.replace(".", dot)

    def ip():
        parts = [str(rng.randint(0, rng.choice([9, 99, 255, 255]))) for _ in range(4)]
        return rng.choice([".", ".", "[.]", "(.)", "{.}", " . ", "[dot]", " dot ", " [.] "]).join(parts)

    def card():
        x = rng.choice("3456") + d(14)
        x += next(c for c in "0123456789" if luhn(x + c))
        return rng.choice(["", " ", "-", ".", "/", "_", " - ", ","]).join(x[i : i + 4] for i in range(0, 16, 4))

    def phone():
        first = rng.choice([f"({d(3)})", f"({d(2)})", d(3), d(3), d(2), "0" + d(2), "0" + d(1)])
        ahead = rng.choice(["", "", f"+{d(1)}", f"+{d(2)}", f"00{d(2)}", f"{d(1)}", "0"])
        sep = rng.choice([" ", " ", "-", "-", ".", "/", " - "])
        rest = [d(k) for k in rng.choice([(3, 4), (3, 4), (4, 4), (2, 2, 2), (2, 2, 2, 2), (3, 3), (3, 2, 2), (6,), (7,)])]
        return sep.join([x for x in (ahead, first, *rest) if x]) if rng.random() < 0.7 or not ahead else f"{ahead} {first} {sep.join(rest)}"

    def other():
        w = lambda: rng.choice([word(), word().capitalize()])
        return rng.choice(
            [
                lambda: d(rng.randint(1, 5)), lambda: f"{d(4)}-{d(2)}-{d(2)}", lambda: f"{d(2)}/{d(2)}/{d(4)}", lambda: f"{d(2)}:{d(2)}", lambda: f"{d(2)}:{d(2)}:{d(2)}", lambda: f"{d(2)}.{d(2)}", lambda: f"{d(1)}.{d(5)}",
                lambda: f"$ {d(2)},{d(3)}.{d(2)}", lambda: f"{d(1)},{d(3)},{d(3)}", lambda: f"v{d(1)}.{d(1)}.{d(1)}", lambda: f"{d(1)}.{d(2)}.{d(1)}", lambda: word() + d(2), lambda: f"@{word()}", lambda: "".join(rng.choice("0123456789abcdef") for _ in range(rng.randint(8, 40))),
                lambda: "AKIA" + "".join(rng.choice("ABCDEF234567XYZ") for _ in range(16)), lambda: f"{word()} dot {word()}", lambda: f"{word()} at {word()}. {w()}", lambda: f"{w()} at {word()} {word()}. {w()} dot {word()}", lambda: f"at {d(1)}.{d(2)} {word()}", lambda: f"({d(2)})",
                lambda: f"{d(1)} {d(2)} {d(2)}", lambda: " ".join(d(1) for _ in range(8)), lambda: f"978-{d(1)}-{d(2)}-{d(6)}-{d(1)}", lambda: f"{d(4)}-{d(2)}-{d(2)} {d(2)}:{d(2)}:{d(2)}", lambda: f"{d(2)}.{d(4)} {d(1)}.{d(4)}", lambda: d(rng.randint(9, 20)), lambda: f"{d(3)}-{d(3)},",
            ]
        )()

    makers, out = (email, ip, card, phone), []
    for _ in range(n):
        text, found = "", []
        while len(text) < WINDOW - 8:
            x = rng.random()
            if x < 0.16:
                kind = rng.choice((0, 0, 1, 2, 3))
                s = makers[kind]()
                found.append((kind, len(text), len(text) + len(s)))
                text += s + rng.choice([" ", " ", ". ", ", ", "\n"])
            elif x < 0.3:
                text += other() + rng.choice([" ", ". ", "\n"])
            else:
                text += (word().capitalize() if rng.random() < 0.15 else word()) + rng.choice([" ", " ", " ", ", ", ". ", ".\n"])
        out.append((text, found))
    return out


GRAIN = 2.0**-20


def train(labelled: list[tuple[str, list[tuple[int, int, int]]]] | None = None, steps: int = STEPS, batch: int = 48, rate: float = 0.02, seed: int = 3) -> Model:
    """A model fit to texts with labelled spans by Adam.

    Every step is in double precision and its gradient is rounded to multiples of GRAIN, a million times what two machines'
    linear algebra can differ by, so that the weights come out alike wherever they are trained. They are float32 in the end.
    """
    labelled = samples() if labelled is None else labelled
    model = start()
    if labelled:
        codes, tags = np.zeros((len(labelled), WINDOW), np.int64), np.zeros((len(labelled), WINDOW), np.int64)
        for r, (text, found) in enumerate(labelled):
            c = encode(text)[:WINDOW]
            codes[r, : len(c)] = c
            for kind, a, b in found:
                tags[r, a : min(b, WINDOW)] = kind + 1
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in model.p.items()}
        v = {k: np.zeros_like(x) for k, x in model.p.items()}
        for s in range(1, steps + 1):
            pick = rng.integers(0, len(codes), batch)
            _, g = model.gradient(codes[pick], tags[pick])
            g = {k: np.round(x / GRAIN) * GRAIN for k, x in g.items()}
            norm = np.sqrt(sum(math.fsum((x * x).ravel()) for x in g.values()))
            lr = rate * min(1.0, 2.0 * (1 - s / (steps + 1)))
            for k, x in g.items():
                x = x * min(1.0, 5.0 / (norm + 1e-9))
                m[k] = 0.9 * m[k] + 0.1 * x
                v[k] = 0.99 * v[k] + 0.01 * x * x
                model.p[k] = model.p[k] - lr * (m[k] / (1 - 0.9**s)) / (np.sqrt(v[k] / (1 - 0.99**s)) + 1e-8)
    return Model({k: x.astype(np.float32) for k, x in model.p.items()})


def trained(spark: SparkSession, labelled: list[tuple[str, list[tuple[int, int, int]]]] | None = None, steps: int = STEPS) -> Model:
    """train(labelled, steps), kept in the shared folder under a hash of all it depends on: trained once for a folder."""
    labelled = samples() if labelled is None else labelled
    known = hashlib.sha256(json.dumps([VERSION, labelled, steps, WINDOW, HIDDEN, EMBED, _CODE.tolist()]).encode()).hexdigest()
    path = f"{shared_folder(spark)}/pii-{known[:32]}"
    schema = "name string, shape array<int>, weights binary"
    wanted = set(start().p)
    try:
        kept = spark.read.schema(schema).parquet(path).collect()  # seven rows
    except AnalysisException:
        kept = []
    if {r.name for r in kept} != wanted or len(kept) != len(wanted):
        model = train(labelled, steps)
        rows = [(k, list(v.shape), v.astype("<f4").tobytes()) for k, v in sorted(model.p.items())]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(path)
        return model
    return Model({r.name: np.frombuffer(r.weights, "<f4").reshape(r["shape"]).astype(np.float32) for r in kept})


def windows(text: str) -> list[int]:
    """Where the windows begin that a span to keep may reach into, of those of the grid.

    Such a span holds a mark (a digit, an at sign, or the `at` of a spelt-out address) and is LONGEST at most, so the windows
    that lie as near to a mark are all.
    """
    last = max(0, -(-(len(text) - WINDOW) // HALF))  # of the window that reaches the end
    before, after = -(-LONGEST // HALF) + 1, -(-LONGEST // HALF)
    out: list[int] = []

    def take(at: int) -> None:
        k = at // HALF
        out.extend(range(max(k - before, out[-1] + 1 if out else 0), min(k + after, last) + 1))

    digits, spelt = _MARK.finditer(text), (m for m in _SPELT_AT.finditer(text) if _SPELT.search(text[max(0, m.start() - LONGEST) : m.end() + LONGEST]))
    done = -1
    for m in heapq.merge(digits, spelt, key=lambda m: m.start()):
        if m.start() // HALF != done:
            done = m.start() // HALF
            take(m.start())
    return [k * HALF for k in out]


def plausible(kind: int, part: str) -> bool:
    """Whether a proposed span can be what it is said to be: the checks of the base kinds hold for it too."""
    digits = "".join(c for c in part if c in "0123456789")
    if kind == 0:
        return "@" in part or bool(digits and _SPELT_AT.search(part) and "." in part) or bool(_SPELT.search(part))
    if kind == 1:
        parts = re.findall(r"[0-9]+", part)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == 2:
        return 16 <= len(digits) <= 19 and luhn(digits)
    return 8 <= len(digits) <= 15 and len(digits) < len(part)


def pieces(at: int, size: int, tags: np.ndarray, margin: np.ndarray, length: int) -> list[tuple[int, int, int, float, bool, bool]]:
    """(start, end, kind, sum of margins, cut on the left, cut on the right) of a window's spans; a text's own ends cut nothing."""
    n = min(size, length - at)
    row = tags[:n]
    edge = np.flatnonzero(np.diff(row)) + 1
    out = []
    for a, b in zip([0, *edge.tolist()], [*edge.tolist(), n], strict=True):
        if row[a]:
            out.append((at + a, at + b, int(row[a]) - 1, float(margin[a:b].sum()), a == 0 and at > 0, b == n and at + n < length))
    return out


def joined(found: list[tuple[int, list[tuple[int, int, int, float, bool, bool]]]]) -> list[tuple[int, int, int, float]]:
    """(start, end, kind, mean margin) of the spans that windows (their begin, their pieces; in order) see whole or see together.

    A piece that its window's edge cuts is joined to the pieces of its kind that it overlaps in the next window, and so on;
    where the neighbour sees none, or no neighbour was decoded, it is dropped, as is what is longer than LONGEST.
    """
    out, open_ = [], []  # open_: joined so far and cut on the right: (start, end, kind, margins, characters)
    before = None
    for at, parts in found:
        if before is None or at != before + HALF:
            open_ = []
        fresh = []
        for start, end, kind, margins, left, right in parts:
            size = end - start
            met = [o for o in open_ if o[2] == kind and o[0] < end and o[1] > start]
            ahead = [o for o in joined_ends if o[2] == kind and o[0] < end and o[1] > start] if left and not met and before is not None and at == before + HALF else []
            if left and not met and not ahead:
                continue
            for o in met or ahead or [(start, end, kind, 0.0, 0)]:
                x = (min(o[0], start), max(o[1], end), kind, o[3] + margins, o[4] + size)
                if x[1] - x[0] > LONGEST:
                    continue
                if right:
                    fresh.append(x)
                else:
                    out.append((x[0], x[1], kind, x[3] / x[4]))
        joined_ends = [(s, e, k, m, e - s) for s, e, k, m, left, right in parts if not left and not right]
        open_, before = fresh, at
    return out


def proposals(text: str, found: list[tuple[int, list[tuple[int, int, int, float, bool, bool]]]]) -> dict[tuple[int, int, int], float]:
    """Spans (start, end, kind) that the windows of a text propose, each with its best score."""
    out: dict[tuple[int, int, int], float] = {}
    for start, end, kind, score in joined(found):
        while start < end and not (text[start].isalnum() or text[start] in "+(["):
            start += 1
        while end > start and not text[end - 1].isalnum():
            end -= 1
        part = text[start:end]
        if len(part) >= 7 and plausible(kind, part):
            score += FORM if kind == 0 and _SURE.search(part) else 0.0
            key = start, end, kind
            out[key] = max(out.get(key, -1e9), score)
    return out


def reconcile(found: dict[tuple[int, int, int], float], least: float) -> list[tuple[int, int, int]]:
    """The disjoint spans of the greatest total score, of those that score `least` or more."""
    spans = sorted((e, s, k, v) for (s, e, k), v in found.items() if v >= least)
    ends = [x[0] for x in spans]
    best: list[tuple[float, int, bool]] = [(0.0, 0, False)]
    for i, (_, s, _, v) in enumerate(spans):
        before = bisect_right(ends, s, 0, i)
        with_it = best[before][0] + v
        best.append((with_it, before, True) if with_it > best[i][0] else (best[i][0], i, False))
    out, i = [], len(spans)
    while i:
        _, before, taken = best[i]
        if taken:
            e, s, k, _ = spans[i - 1]
            out.append((k, s, e))
        i = before
    return out[::-1]


def clear(found: dict[tuple[int, int, int], float], taken: list[tuple[int, int]]) -> dict[tuple[int, int, int], float]:
    """What overlaps none of the taken spans, which are in order of their begin."""
    starts = [a for a, _ in taken]
    reach, furthest = [], 0
    for _, b in taken:
        furthest = max(furthest, b)
        reach.append(furthest)
    free = {}
    for x, v in found.items():
        k = bisect_left(starts, x[1])  # of those that begin before its end, the furthest end
        if not k or reach[k - 1] <= x[0]:
            free[x] = v
    return free


def find_batch(model: Model, batch: list[str], least: float) -> list[tuple[list, list]]:
    """(base spans, all spans by start) of each text; the windows of all texts are decoded together."""
    base = [base_spans(t) for t in batch]
    flat = [(i, at) for i, t in enumerate(batch) for at in windows(t)]
    seen: list[list] = [[] for _ in batch]
    for k in range(0, len(flat), SLICE):
        part = flat[k : k + SLICE]
        codes = np.zeros((len(part), WINDOW), np.int64)
        for r, (i, at) in enumerate(part):
            c = encode(batch[i][at : at + WINDOW])
            codes[r, : len(c)] = c
        tags, margin = model.decode(codes)
        for r, (i, at) in enumerate(part):
            seen[i].append((at, pieces(at, WINDOW, tags[r], margin[r], len(batch[i]))))
    out = []
    for i, t in enumerate(batch):
        free = clear(proposals(t, seen[i]), sorted((a, b) for _, a, b in base[i]))
        more = reconcile(free, least)
        out.append((base[i], sorted([*base[i], *more], key=lambda s: (s[1], s[0], s[2]))))
    return out


def find(df: DataFrame, model: Model, id: str = "doc_id", text: str = "text", least: float = LEAST) -> DataFrame:
    """id, base and found for every row: arrays of (kind, start, end), kind a place in KINDS.

    base is ordered by kind, then start; found has base and the network's spans that overlap none
    of it, by start. Offsets are code points, ends exclusive. A null text is an empty one; ids are
    passed through; other columns play no part.
    """
    sent = df.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64())]))

    def of(batch):
        out: list[tuple[list, list]] = []
        held, size = [], 0
        for t in batch:
            held.append((t or b"").decode())
            size += len(held[-1])
            if size > 1 << 22:
                out += find_batch(sent.value, held, least)
                held, size = [], 0
        out += find_batch(sent.value, held, least)
        named = [[[{"kind": k, "start": a, "end": b} for k, a, b in spans] for spans in side] for side in zip(*out, strict=True)] if out else [[], []]
        return [pa.array(x, kind) for x in named]

    span = "array<struct<kind:int,start:bigint,end:bigint>>"
    return map_texts(df, [id], text, of, f"base {span}, found {span}")
