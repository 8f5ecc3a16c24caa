"""Small column and row helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from spindrift.runtime import map_arrow

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(text: Column) -> Column:
    """Text with A-Z lower-cased and every other character as it was.

    lower() does just that to a text of one byte a character, and much faster.
    """
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def quoted(name: str) -> Column:
    """The column of that very name, whatever characters it has."""
    return F.col(f"`{name.replace('`', '``')}`")


def packed(df: DataFrame) -> Column:
    """All columns of df as one struct, so that scratch columns beside it can't clash with them; select("row.*") undoes it."""
    return F.struct(*(quoted(c) for c in df.columns))


def field(df: DataFrame, name: str, alias: str | None = None) -> str:
    """DDL of one column of df, for the schema of a Python stage."""
    return f"`{alias or name}` {df.schema[name].dataType.simpleString()}"


def texts(column: pa.Array) -> Iterator[bytes | None]:
    """The UTF-8 bytes of each text of an Arrow column, one at a time."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    for x in column.cast(pa.large_binary()):
        yield x.as_py()


def map_texts(df: DataFrame, keys: list[str], text: str, of: Callable, schema: str) -> DataFrame:
    """keys and what `of` makes of each text: of(list of bytes or None) -> list of Arrow arrays, for a batch."""
    made = StructType.fromDDL(schema)
    names = [*keys, *made.names]

    def run(batches):
        for batch in batches:
            out = of(list(texts(batch.column(len(keys)))))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keys))), *out], names=names)

    whole = StructType([*(StructField(k, df.schema[k].dataType) for k in keys), *made.fields])
    return map_arrow(df.select(*(quoted(k) for k in keys), quoted(text)), run, whole)
