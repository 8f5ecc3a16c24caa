"""Exact deduplication by skew-safe combining.

Rows with the same digest meet in three steps: Spark's partial aggregation joins those of one
task, salted groups join those of one (digest, salt), and the winners of the salts are joined
at last. A third of all rows in one group so reaches the last step as SALTS rows. Digests only
propose: the same three steps then run over the whole contents, compared as grouping keys, and a
digest that stands for several contents is resolved by content.

A content whose digest occurs once has nothing to be compared with; sieve keeps those from being
shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.llm import sieve
from spindrift.llm.columns import ascii_lower, quoted
from spindrift.runtime import cut_lineage

SALTS, PER_SALT = 32, 10_000_000


def sha256(content: Column) -> Column:
    return F.sha2(content, 256)


def classes(df: DataFrame, id: str = "doc_id", text: str = "text", digest: Callable[[Column], Column] = sha256, salts: int | None = None) -> DataFrame:
    """One row per row of df: id, keep_id, group_size, kept, digest.

    Contents are equal when identical after lower-casing A-Z; a null text is an empty one. The
    largest id of a group stays; a null id stays only where a group has no other. Rows that
    repeat an id and content count each, and all that bear the winning id have kept = true. An
    empty table gives an empty result; other columns of df play no part.
    """
    content = ascii_lower(F.coalesce(F.col(text), F.lit("")))
    base = df.select(F.col(id).alias("_id"), content.alias("_content"))
    base = base.withColumn("_digest", F.unhex(digest(F.col("_content"))))

    plain = cut_lineage(base.select("_id", "_digest"))
    salts = salts or max(SALTS, plain.count() // PER_SALT)  # so that a salt of the hottest digest has PER_SALT rows at most
    salt = F.pmod(F.xxhash64("_id"), F.lit(salts)).cast("int")
    rows, base = plain.withColumn("_salt", salt), base.withColumn("_salt", salt)
    salted = rows.groupBy("_digest", "_salt").agg(F.count(F.lit(1)).alias("_n"), F.max("_id").alias("_top"))
    groups = salted.groupBy("_digest").agg(F.sum("_n").alias("_n"), F.max("_top").alias("_top"))
    single = groups.where("_n = 1").select("_digest", F.col("_top").alias("_keep"), F.col("_n").alias("_size"))
    several = groups.where("_n > 1").select("_digest")

    # the contents of the proposed groups, whole, compared as grouping keys
    proposed = sieve.maybe(base, several, "_digest")
    by_salt = proposed.groupBy("_digest", "_salt", "_content").agg(F.count(F.lit(1)).alias("_n"), F.max("_id").alias("_top"))
    whole = by_salt.groupBy("_digest", "_content").agg(F.sum("_n").alias("_size"), F.max("_top").alias("_keep"))
    counted = cut_lineage(
        whole.groupBy("_digest")
        .agg(F.count(F.lit(1)).alias("_contents"), F.first("_keep").alias("_keep"), F.first("_size").alias("_size"))
        .join(several, "_digest", "left_semi")  # the sieve lets a few others pass
    )
    settled = single.unionByName(counted.where("_contents = 1").select("_digest", "_keep", "_size"))

    # the winner goes to each salt of its digest, so that no join key holds more than a salt's rows
    targets = salted.select("_digest", "_salt").join(settled, "_digest")
    out = rows.join(targets, ["_digest", "_salt"]).select("_id", "_keep", "_size", "_digest")
    clash = counted.where("_contents > 1").select("_digest")
    if not clash.isEmpty():
        clashing = proposed.join(clash, "_digest", "left_semi")
        apart = clashing.join(whole.join(clash, "_digest", "left_semi"), ["_digest", "_content"])
        out = out.unionByName(apart.select("_id", "_keep", "_size", "_digest"))
    return out.select(
        F.col("_id").alias(id),
        F.col("_keep").alias("keep_id"),
        F.col("_size").cast("long").alias("group_size"),
        F.col("_id").eqNullSafe(F.col("_keep")).alias("kept"),
        F.lower(F.hex("_digest")).alias("digest"),
    )


def deduplicate(df: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of df that stay, with all their columns, whatever those are named.

    Rows go by id and content: a row stays where its content has no row of a larger id, though
    another text under the same id may go. Of rows that repeat an id and content one stays. A row
    without id stays once for each content, for no other row can be told to stand for it.
    """
    digest = sha256(ascii_lower(F.coalesce(quoted(text), F.lit(""))))
    found = classes(df.select(quoted(id).alias("id"), quoted(text).alias("text")), "id", "text")
    found = cut_lineage(found.groupBy("id", "digest").agg(F.count(F.lit(1)).alias("n"), F.max("kept").alias("kept")))
    lost = found.where("id is not null and not kept").select("id", "digest")
    kept = sieve.without(df, lost, id, digest)
    again = found.where("n > 1 and (kept or id is null)").select("id", "digest")
    if again.isEmpty():
        return kept
    return sieve.once(kept, again, id, digest)
