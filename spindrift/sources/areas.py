"""Area definitions: text of nested blocks, one for each grid, read as a table of grids."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The keys of a block, and the parameters of its projection.
KEYS = ("NAME", "PCS_ID", "PCS_DEF", "XSIZE", "YSIZE", "AREA_EXTENT")
PARAMETERS = ("proj", "datum", "units", "lat_0", "lon_0", "lat_ts", "a", "b", "x_0", "y_0")
_WORDS = ("proj", "datum", "units")


def areas(lines: DataFrame, line: str = "line_no", value: str = "value", file: str | None = None) -> DataFrame:
    """A row for each block `REGION: name { key: value ... };` of the lines: file (if given), area_id, name, pcs_id, the projection's parameters, nx, ny and the extent.

    `#` starts a comment, anywhere. Lines belong to the last block that was opened before them, which is told by a running count
    over a file; those outside of a block are left out, as are blocks that are not closed. A key that repeats keeps its last value.
    """
    keys = [file] if file else []
    text = F.trim(F.regexp_replace(F.col(value), "#.*$", ""))
    rows = lines.select(*keys, F.col(line).alias("_n"), text.alias("_t")).where("_t != ''")
    opened, closed = F.regexp_extract("_t", r"^REGION:\s*(\S+)\s*\{", 1), F.col("_t").rlike(r"^\}\s*;?$")
    rows = rows.withColumns({"_id": opened, "_open": opened != "", "_close": closed})
    before = Window.partitionBy(*keys).orderBy("_n").rowsBetween(Window.unboundedPreceding, 0)  # the lines of one file
    rows = rows.withColumns({"_block": F.count_if("_open").over(before), "_ended": F.count_if("_close").over(before)})
    pair = F.regexp_extract("_t", r"^(\w+):\s*(.*)$", 1), F.trim(F.regexp_extract("_t", r"^(\w+):\s*(.*)$", 2))
    rows = rows.withColumns({"_key": pair[0], "_value": pair[1]}).where("_block > 0")
    # a block's own lines come after the end of all blocks before it
    rows = rows.withColumn("_first", F.min("_ended").over(Window.partitionBy(*keys, "_block")))
    inside = (F.col("_ended") == F.col("_first")) & ~F.col("_close")
    got = rows.groupBy(*keys, "_block").agg(
        F.max("_id").alias("area_id"),
        F.bool_or("_close").alias("_whole"),
        *(F.max_by("_value", F.when(inside & (F.col("_key") == k), F.col("_n"))).alias(k) for k in KEYS),
    ).where("_whole")
    numbers = F.transform(F.split(F.regexp_replace("AREA_EXTENT", r"[()\s]", ""), ","), lambda x: x.try_cast("double"))

    def parameter(name: str):
        found = F.nullif(F.regexp_extract("PCS_DEF", rf"(?:^|[,\s+]){name}=([^,\s]+)", 1), F.lit(""))
        return (found if name in _WORDS else found.try_cast("double")).alias(name)

    corner = lambda k, n: F.get(numbers, F.lit(k)).alias(n)
    return got.select(
        *keys, "area_id", F.col("NAME").alias("name"), F.col("PCS_ID").alias("pcs_id"), *(parameter(p) for p in PARAMETERS),
        F.col("XSIZE").try_cast("int").alias("nx"), F.col("YSIZE").try_cast("int").alias("ny"), corner(0, "llx"), corner(1, "lly"), corner(2, "urx"), corner(3, "ury"),
    )


def written(grids: DataFrame, *keys: str) -> DataFrame:
    """Grids (area_id, proj, lat_0, lon_0, lat_ts, nx, ny, llx, lly, urx, ury) as such lines: keys, line_no and value; a file a row."""
    s = lambda c: F.col(c).cast("string")
    join = F.concat_ws
    definition = join(", ", F.concat(F.lit("proj="), "proj"), F.concat(F.lit("lat_0="), s("lat_0")), F.concat(F.lit("lon_0="), s("lon_0")), F.concat(F.lit("lat_ts="), s("lat_ts")), F.lit("units=m"))
    extent = F.concat(F.lit("("), join(", ", *(s(c) for c in ("llx", "lly", "urx", "ury"))), F.lit(")"))
    field = lambda k, v: F.concat(F.lit(f"       {k}:    "), v)
    lines = F.array(
        F.lit("# grids"), F.lit("#REGION: none {"), F.lit("#};"), F.concat(F.lit("REGION: "), "area_id", F.lit(" {")), field("NAME", F.concat(F.lit("Grid "), "area_id")), field("PCS_ID", F.col("area_id")), field("PCS_DEF", definition),
        field("XSIZE", s("nx")), field("YSIZE", F.concat(s("ny"), F.lit("  # rows"))), F.lit("       # edges of pixels"), field("AREA_EXTENT", extent), F.lit("};"), F.lit(""),
    )
    return grids.select(*keys, F.posexplode(lines).alias("line_no", "value"))
