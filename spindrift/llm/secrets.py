"""Secrets by character Markov models, with DataFrame functions alone.

Three kinds of span are found by pattern: assignments, access keys and long hexadecimal runs. The
Markov models add more: two chains over characters, one trained on random strings and one on
ordinary identifiers, give a long token's log-likelihood ratio, and tokens whose ratio a character
is high enough are spans of kind `markov`. Both chains are counted by Spark from labelled samples;
their ratio is a constant table of (characters + 1)^2 numbers.

Positions come from what lies between the matches: a text split at a pattern and the matches of
that pattern, in turn, are the text.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm.columns import quoted

KINDS = ("assign", "access", "hex", "markov")
#: The patterns that define the base kinds.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # maximal runs after AKIA, 20 characters at least
HEX = r"[0-9a-f]{24,}"  # likewise for [0-9a-f]+
#: What the models look at: every token of 16 characters or more.
TOKEN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}"
CHARACTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
THRESHOLD, SMOOTHING, BLOCK = 0.8, 0.5, 64
_SPAN = "array<struct<start:bigint,kind:int,end:bigint>>"

#: Words that ordinary identifiers are made of.
WORDS = (
    "get set add remove update delete create find list load save read write open close start stop init build make parse format encode decode "
    "user account order item product customer event message session config option value index count total size length name type status state "
    "file path folder image video audio page view model controller service manager factory handler listener adapter builder helper util test "
    "data base table column row key field record query result request response client server host port address network socket stream buffer "
    "cache queue stack tree node edge graph map array string number integer float double boolean date time year month week day hour minute "
    "color width height left right top bottom center margin border style font text label button menu window dialog panel layout container"
).split()

#: Syllables that long words of some languages are made of, a language a row.
SYLLABLES = [
    "the ing tion er re an on en ed es or ti is ar al te co de in st ly ness ment able ous ship for con pre dis un ter th nd nt ch sh wh ea ou ble".split(),
    "der die und sch ein ich en er ge be ver zu ung heit keit lich isch tz pf ch st an auf aus bei ent ig es ber gen haus werk zeug land".split(),
    "le la re de que eux eau oi ai ou an en on un tion ment elle ette ier age ance pa tre con pro vi au is er ez aux sur par".split(),
    "el la de que os as ar er ir ado ido cion mente dad ero es en con des pre tra bre al an on ra ri ro ta te to lla llo gua".split(),
    "il la di che are ere ire zione mente ita ato ino otto gli gn sco con pro per tra sta re ri ra la le lo ma na no va to".split(),
]


def samples(spark: SparkSession, each: int = 4000) -> DataFrame:
    """Labelled samples (text, secret): random strings of seven alphabets, and identifiers, words of five languages, numbers, dates and rules."""
    n = F.col("id")
    rows = spark.range(each)
    digest = F.sha2(n.cast("string"), 256)
    long = F.concat(digest, F.sha2(F.concat(n.cast("string"), F.lit("+")), 256))
    plain = F.base64(F.unhex(long))
    random = F.array(
        F.substring(digest, 1, 40),
        F.regexp_replace(F.substring(plain, 1, 40), "[=]", ""),
        F.translate(F.substring(plain, 3, 32), "+/=", "-_"),
        F.upper(F.regexp_replace(F.substring(plain, 5, 30), "[+/=]", "")),
        F.translate(F.substring(digest, 9, 32), "0123456789abcdef", "qzxwvktghjmpbcdy"),
        F.translate(F.substring(plain, 7, 36), "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/=", "abcdefghijklmnopqrstuvwxyzqwertyuiopgh"),
        F.translate(F.substring(plain, 9, 36), "abcdefghijklmnopqrstuvwxyz0123456789+/=", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567QZXKJV"),
    )
    words = F.split(F.lit(" ".join(WORDS)), " ")
    pick = lambda k: F.element_at(words, (F.pmod(F.xxhash64(n, F.lit(k)), F.lit(len(WORDS))) + 1).cast("int"))
    a, b, c = pick(1), pick(2), pick(3)
    number = F.pmod(F.xxhash64(n, F.lit(4)), F.lit(10000)).cast("string")
    tongues = F.split(F.lit("|".join(" ".join(x) for x in SYLLABLES)), r"\|")
    draw = lambda most, *of: (F.pmod(F.xxhash64(n, *(x if isinstance(x, Column) else F.lit(x) for x in of)), most) + 1).cast("int")

    def spoken(k: int) -> Column:
        """A word of four to nine syllables of one language."""
        own = F.split(F.element_at(tongues, draw(F.lit(len(SYLLABLES)), 11, k)), " ")
        return F.array_join(F.transform(F.sequence(F.lit(1), draw(F.lit(6), 12, k) + 3), lambda i: F.element_at(own, draw(F.size(own), 13, k, i))), "")

    ordinary = F.array(
        F.concat_ws("_", a, b, c, number),
        F.concat(a, F.initcap(b), F.initcap(c)),
        F.concat_ws("-", a, b, c),
        F.concat_ws("/", a, b, F.concat(c, number)),
        F.concat(F.lit("20"), F.lpad(number, 4, "1"), F.lpad(F.pmod(F.xxhash64(n, F.lit(5)), F.lit(10**10)).cast("string"), 10, "0")),
        F.upper(F.concat_ws("_", a, b, c)),
        F.date_format(F.timestamp_seconds(F.pmod(F.xxhash64(n, F.lit(6)), F.lit(2_000_000_000))), "yyyy-MM-dd'T'HH-mm-ss'Z'"),
        F.concat(F.date_format(F.timestamp_seconds(F.pmod(F.xxhash64(n, F.lit(7)), F.lit(2_000_000_000))), "yyyyMMdd-HHmmss-"), a),
        F.concat(a, b, c),
        F.concat(F.initcap(a), F.initcap(b), F.initcap(c), F.lit("Error")),
        F.concat(F.upper(a), F.upper(b), F.upper(c)),
        F.concat(F.lit("https/www/"), a, F.lit("/"), b, F.lit("/index_"), c),
        F.repeat(F.element_at(F.array(*(F.lit(x) for x in "-=_/+ax0")), (F.pmod(n, F.lit(8)) + 1).cast("int")), 20),
        *(f(spoken(k)) for k, f in enumerate((*[lambda w: w] * 6, *[lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 10))] * 2, F.upper))),
    )
    one = lambda texts, label: rows.select(F.explode(texts).alias("text"), F.lit(label).alias("secret"))
    return one(random, 1).unionByName(one(ordinary, 0))


def train(labelled: DataFrame, text: str = "text", secret: str = "secret", smoothing: float = SMOOTHING) -> list[float]:
    """The table of log-likelihood ratios, by 68 * (place of a character) + (place of the next).

    Places count from 1 in CHARACTERS; 0 stands for the start and for any other character. Null
    texts and labels are left out; an empty table of samples gives ratios of zero.
    """
    size = len(CHARACTERS) + 1
    rows = labelled.where(quoted(text).isNotNull() & quoted(secret).isNotNull()).select(quoted(text).alias("t"), (quoted(secret) > 0).cast("int").alias("s"))
    steps = rows.where("t != ''").select("t", "s", F.explode(F.sequence(F.lit(1), F.length("t"))).alias("i"))
    place = lambda i: F.expr(f"instr('{CHARACTERS}', substring(t, {i}, 1))")
    before = F.when(F.col("i") == 1, 0).otherwise(place("i - 1"))
    counts = steps.groupBy("s", before.alias("a"), place("i").alias("b")).count().collect()  # at most 2 * 68 * 68 rows
    seen = [[smoothing] * (size * size) for _ in range(2)]
    for r in counts:
        seen[r.s][r.a * size + r.b] += r["count"]
    logs = []
    for k in range(2):
        total = [sum(seen[k][a * size : (a + 1) * size]) for a in range(size)]
        logs.append([math.log(x / total[i // size]) for i, x in enumerate(seen[k])])
    return [round(x - y, 4) for x, y in zip(logs[1], logs[0], strict=True)]


def ratio(token: Column, table: list[float]) -> Column:
    """Log-likelihood ratio a character of a token: random against ordinary."""
    size = len(CHARACTERS) + 1
    constant = F.from_json(F.lit(json.dumps(table)), "array<double>")
    place = lambda c: F.instr(F.lit(CHARACTERS), c)
    at = F.transform(F.split(token, ""), place)
    walk = F.aggregate(
        at,
        F.struct(F.lit(0).alias("before"), F.lit(0.0).alias("sum")),
        lambda acc, x: F.struct(x.alias("before"), (acc["sum"] + F.element_at(constant, (acc["before"] * size + x + 1).cast("int"))).alias("sum")),
        lambda acc: acc["sum"],
    )
    return walk / F.greatest(F.length(token), F.lit(1))


def spans(text: Column, pattern: str, kind: int, good=None) -> Column:
    """Array of (start, kind, end) of the pattern's leftmost non-overlapping matches that are good.

    Matches are placed BLOCK at a time, first from their block's begin and then from the text's, so
    the arrays that grow match by match stay short however many matches a text has.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.zip_with(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)), found, lambda g, m: F.struct(F.length(g).alias("g"), m.alias("m")))
    blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.size(found) - 1) / BLOCK), F.lit(0)).cast("int")), lambda i: F.slice(pairs, i * BLOCK + 1, F.lit(BLOCK)))
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(_SPAN).alias("out"))

    def step(acc, x):
        begin = acc["at"] + x["g"]
        end = begin + F.length(x["m"])
        span = F.array(F.struct(begin.cast("bigint").alias("start"), F.lit(kind).alias("kind"), end.cast("bigint").alias("end")))
        more = F.concat(acc["out"], span)
        return F.struct(end.cast("bigint").alias("at"), (F.when(good(x["m"]), more).otherwise(acc["out"]) if good else more).alias("out"))

    placed = F.transform(blocks, lambda block: F.aggregate(block, start, step))
    bases = F.aggregate(placed, F.array(F.lit(0).cast("bigint")), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x["at"])))
    moved = lambda base: lambda s: F.struct((s["start"] + base).alias("start"), s["kind"].alias("kind"), (s["end"] + base).alias("end"))
    return F.flatten(F.zip_with(placed, F.slice(bases, F.lit(1), F.size(placed)), lambda x, base: F.transform(x["out"], moved(base))))


def joined(spans: Column) -> Column:
    kind = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kind, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find(df: DataFrame, table: list[float], id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """id, base and found for every row: arrays of (start, kind, end), kind a place in KINDS.

    base has the three base kinds, found these and the models' spans that overlap none of them;
    both are ordered by start, then kind. Offsets are code points, ends exclusive. A null text is
    an empty one, ids are passed through, other columns play no part.
    """
    t = F.coalesce(quoted(text), F.lit(""))
    none = F.array().cast(_SPAN)
    rows = df.select(quoted(id).alias("_id"), t.alias("_t"))
    by = lambda test, pattern, kind, good=None: F.when(test, spans(F.col("_t"), pattern, kind, good)).otherwise(none)
    mark = F.col("_t").contains("=") | F.col("_t").contains(":")
    base = F.concat(
        by(mark & F.col("_t").rlike(ASSIGN), ASSIGN, 0, lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 6),
        by(F.col("_t").contains("AKIA"), ACCESS, 1),
        by(F.col("_t").rlike(HEX), HEX, 2),
    )
    rows = rows.select("_id", "_t", F.array_sort(base).alias("base"))
    more = by(F.col("_t").rlike(TOKEN), TOKEN, 3, lambda m: ratio(m, table) >= threshold)
    rows = rows.select("_id", "base", more.alias("more"))
    free = F.filter("more", lambda m: ~F.exists("base", lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])))
    return rows.select(F.col("_id").alias(id), "base", F.array_sort(F.concat("base", free)).alias("found"))


def count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))).cast("long")
