"""Dropping or picking rows by key without shuffling the rows that cannot be concerned.

Keys are marked in a filter of 16 bits a key, 2^28 bits (8192 bitmaps of 4 KB) at most, which is
what bounds the broadcast. It only says where a key is surely absent; an exact join decides on the
rest, so results do not depend on it. Beyond some 10^8 keys the filter fills up and all rows go
through the exact join.

The caller's columns travel in one struct, so no name of theirs can clash with the scratch columns.
Keys are compared as structs: a null part equals a null part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.llm.columns import packed, quoted

LEAST, MOST, PER_KEY = 1 << 18, 1 << 28, 16


def bits_for(keys: int) -> int:
    """The bits of a filter of so many keys."""
    return min(MOST, max(LEAST, 1 << (PER_KEY * keys).bit_length()))


def _key(on: tuple) -> Column:
    return F.struct(*((quoted(c) if isinstance(c, str) else c).alias(f"k{i}") for i, c in enumerate(on)))


def marked(df: DataFrame, keys: DataFrame, *on: str | Column, bits: int | None = None) -> DataFrame:
    """(row, key, may): a row of df as a struct, its key, and false where the key is surely not among keys.

    `on` are columns of df, by name or as expressions, that match the columns of keys in order.
    """
    bits = bits or bits_for(keys.count())
    at = F.pmod(F.xxhash64("key"), F.lit(bits))
    low = at.bitwiseAND(F.lit(32767))
    known = keys.select(_key(tuple(keys.columns)).alias("key")).select(F.shiftright(at, 15).alias("page"), low.alias("bit"))
    pages = known.groupBy("page").agg(F.bitmap_construct_agg("bit").alias("map"))
    rows = df.select(packed(df).alias("row"), _key(on).alias("key"))
    rows = rows.withColumn("page", F.shiftright(at, 15)).join(F.broadcast(pages), "page", "left")
    byte = F.conv(F.hex(F.substring("map", (F.shiftright(low, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    rows = rows.select("row", "key", byte.alias("byte"), low.bitwiseAND(F.lit(7)).cast("int").alias("low"))
    return rows.select("row", "key", F.coalesce(F.expr("1 << low").bitwiseAND(F.col("byte")) != 0, F.lit(False)).alias("may"))


def maybe(df: DataFrame, keys: DataFrame, *on: str | Column, bits: int | None = None) -> DataFrame:
    """All rows of df whose key is one of keys, and a few others."""
    return marked(df, keys, *on, bits=bits).where("may").select("row.*")


def among(df: DataFrame, keys: DataFrame, *on: str | Column, bits: int | None = None) -> DataFrame:
    """The rows whose key is one of keys."""
    some = marked(df, keys, *on, bits=bits).where("may")
    return some.join(keys.select(_key(tuple(keys.columns)).alias("key")), "key", "left_semi").select("row.*")


def without(df: DataFrame, keys: DataFrame, *on: str | Column, bits: int | None = None) -> DataFrame:
    """The rows whose key is none of keys."""
    rows = marked(df, keys, *on, bits=bits)
    rest = rows.where("may").join(keys.select(_key(tuple(keys.columns)).alias("key")), "key", "left_anti")
    return rows.where("not may").select("row.*").unionByName(rest.select("row.*"))


def once(df: DataFrame, again: DataFrame, *on: str | Column, bits: int | None = None) -> DataFrame:
    """df with one row for each key, where `again` has the keys that repeat."""
    rows = marked(df, again, *on, bits=bits)
    return rows.where("not may").select("row.*").unionByName(rows.where("may").groupBy("key").agg(F.first("row").alias("row")).select("row.*"))
