"""Language identification by mixture inference.

Each language has a model of the byte n-grams of words. A text is a mixture: every word was
written in one language, and expectation-maximisation finds the proportions. How many languages
there are is decided by penalised likelihood over the nested sets of the strongest ones, which
grow as long as that improves. The models are counted over every text that may be learnt from,
n-gram by n-gram. Their table has a row for each n-gram seen, ENTRIES numbers at most (256 MB);
only where a corpus has more n-grams than that leaves rows, the rarest share one.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.llm import wordhash
from spindrift.llm.columns import map_texts, quoted, texts
from spindrift.runtime import cut_lineage, map_arrow

ORDER, ENTRIES, STEPS, PENALTY, PRIOR = 4, 1 << 26, 12, 3.0, 2.0
LETTER = re.compile(r"[^\W\d_]")
UNKNOWN = "und"


@dataclass
class Model:
    languages: list[str]
    grams: np.ndarray  # sorted
    table: np.ndarray  # [gram, language] log-probability; the last row is that of any other

    def words(self, one: wordhash.Words) -> np.ndarray:
        """[word, language] log-likelihood."""
        keys, begin, _ = wordhash.grams(one, ORDER)
        some, back = np.unique(keys, return_inverse=True)
        at = np.minimum(np.searchsorted(self.grams, some), max(len(self.grams) - 1, 0))
        row = np.where(self.grams[at] == some, at, len(self.grams)) if len(self.grams) else np.zeros(len(some), np.int64)
        return np.add.reduceat(self.table[row][back], begin)

    def mixtures(self, batch: list[bytes | None]) -> np.ndarray:
        """[text, language] proportions; zero rows for wordless texts.

        A text that is longer than a slice is gathered as distinct words and their counts, so memory
        follows its vocabulary, not its length.
        """
        out = np.zeros((len(batch), len(self.languages)))
        held, number = [], -1  # of a text that may go on: (hashes, likelihoods, counts)

        def settle():
            if held:
                h, ll, n = (np.concatenate(x) for x in zip(*held, strict=True))
                _, at, back = np.unique(h, return_index=True, return_inverse=True)
                out[number] = infer(ll[at], np.bincount(back, n, len(at)))

        for piece in wordhash.cut(batch):
            w = wordhash.words(piece)
            if not len(w.size):
                continue
            one, back, _ = w.distinct()
            ll = self.words(one).astype(np.float32)
            head = np.r_[0, np.flatnonzero(w.text[1:] != w.text[:-1]) + 1]
            for s, e in zip(head.tolist(), [*head[1:].tolist(), len(w.text)], strict=True):
                i = int(w.text[s])
                if i != number:
                    settle()
                    held, number = [], i
                if 0 < s and e < len(w.text):  # all of a text
                    out[i] = infer(ll[back[s:e]], np.ones(e - s))
                    continue
                kinds, n = np.unique(back[s:e], return_counts=True)
                held.append((one.hash[kinds], ll[kinds], n))
        settle()
        return out


def infer(ll: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Proportions of the selected languages, from the log-likelihoods [word, language] of words that occur n times."""
    top = ll.max(1, keepdims=True)
    like = np.exp(np.maximum(ll - top, -30))
    share = np.full(ll.shape[1], 1 / ll.shape[1])
    total = n.sum()

    def climb(like: np.ndarray, share: np.ndarray, steps: int) -> np.ndarray:
        for _ in range(steps):
            mass = like * share
            new = (n / mass.sum(1)) @ mass / total
            if np.abs(new - share).max() < 1e-4:
                return new
            share = new
        return share

    share = climb(like, share, STEPS)
    order = np.argsort(-share, kind="stable")
    best, found = -np.inf, None
    for k in range(1, len(order) + 1):
        some = order[:k]
        if k > 1 and share[some[-1]] <= 0:
            break
        part = climb(like[:, some], share[some] / max(share[some].sum(), 1e-12), 4) if k > 1 else np.ones(1)
        value = n @ np.log(np.maximum(like[:, some] @ part, 1e-30)) - PENALTY * k * np.log(total + 1)
        if value <= best:
            break
        best, found = value, (some, part)
    out = np.zeros(ll.shape[1])
    out[found[0]] = found[1]
    return out


def fit(df: DataFrame, may_learn: Column, lang: str = "lang", text: str = "text", entries: int = ENTRIES) -> Model:
    """Counts the n-grams of every text of df with a language where may_learn holds; every language found is learnt."""
    rows = df.where(may_learn & quoted(lang).isNotNull() & quoted(text).isNotNull()).select(quoted(lang).alias("lang"), quoted(text).alias("text"))
    names = sorted(r[0] for r in rows.groupBy("lang").count().collect())
    number = {x: i for i, x in enumerate(names)}

    def count(batches):
        sums = [wordhash.Counts() for _ in names]
        for batch in batches:
            kind = np.array([number[x] for x in batch.column(0).to_pylist()])
            for piece in wordhash.cut(list(texts(batch.column(1)))):
                w = wordhash.words(piece)
                own = kind[w.text]
                for k in np.unique(own):
                    some = own == k
                    one, _, n = wordhash.Words(w.letters, w.first[some], w.size[some], w.text[some], w.hash[some]).distinct()
                    keys, _, per = wordhash.grams(one, ORDER)
                    sums[k].add(keys, np.repeat(n, per))
        for k, s in enumerate(sums):
            keys, n = s.take()
            for i in range(0, len(keys), 1 << 16):
                part = keys[i : i + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), k, np.int32)), pa.array(part.view(np.int64)), pa.array(n[i : i + (1 << 16)])], names=["l", "g", "n"])

    counted = cut_lineage(map_arrow(rows, count, "l int, g bigint, n bigint").groupBy("l", "g").agg(F.sum("n").alias("n")))
    room = max(1, entries // max(1, len(names)))
    by_gram = counted.groupBy("g").agg(F.sum("n").alias("t"))
    if by_gram.count() > room:
        kept = by_gram.orderBy(F.desc("t"), "g").limit(room).select("g", F.lit(True).alias("own"))
        counted = counted.join(kept, "g", "left").groupBy("l", F.when(F.col("own"), F.col("g")).alias("g")).agg(F.sum("n").alias("n"))
    got = counted.select("l", F.coalesce("g", F.lit(-1)).alias("g"), "n").toArrow()  # `entries` numbers at most
    g, l, n = (got.column(x).to_numpy() for x in ("g", "l", "n"))
    grams = np.unique(g[g >= 0])
    counts = np.zeros((len(grams) + 1, len(names)))
    counts[np.where(g >= 0, np.searchsorted(grams, g), len(grams)), l] = n
    shared = (counts.sum(1, keepdims=True) + 0.01) / (counts.sum() + 0.01 * (len(grams) + 1))
    total = counts.sum(0, keepdims=True)
    weight = PRIOR * np.sqrt(total + 1)
    table = np.log((counts + weight * shared) / (total + weight))
    return Model(names, grams.astype(np.uint64), np.ascontiguousarray(table).astype(np.float32))


def predict(df: DataFrame, model: Model, id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, lang_pred, score and shares (a map of the selected languages) for every row.

    The prediction is the language of the largest share, the first by name among equals; `und`
    with score 0 for a text that is null or has no letter, or where no language was learnt.
    """
    sent = df.sparkSession.sparkContext.broadcast(model)

    def of(batch):
        m = sent.value
        if not m.languages:
            n = len(batch)
            return [pa.array([UNKNOWN] * n), pa.array(np.zeros(n)), pa.array([[]] * n, pa.map_(pa.string(), pa.float64()))]
        mix = m.mixtures(batch)
        lettered = np.array([t is not None and LETTER.search(t.decode()) is not None for t in batch], bool)
        best = mix.argmax(1)
        names = [m.languages[b] if x else UNKNOWN for b, x in zip(best, lettered, strict=True)]
        score = np.where(lettered, mix[np.arange(len(batch)), best], 0.0)
        shares = [[(m.languages[k], float(r[k])) for k in np.flatnonzero(r)] if x else [] for r, x in zip(mix, lettered, strict=True)]
        return [pa.array(names, pa.string()), pa.array(np.clip(score, 0, 1)), pa.array(shares, pa.map_(pa.string(), pa.float64()))]

    return map_texts(df, [id], text, of, "lang_pred string, score double, shares map<string,double>")
