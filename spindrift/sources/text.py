"""Text sources: buoy catalogues, header files, matchup lists. One declarative row for each catalogue."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.functions.geo import Lcc
from spindrift.runtime import cut_lineage


@dataclass(frozen=True)
class Catalogue:
    """How one catalogue writes a record: what a comment is, and where its fields are (from 0) among those split by `split`."""

    comment: str = ""
    skip: int = 0
    split: str = r"\s+"
    must: str = ""  # lines without this text are no records
    date: tuple[int, ...] = (0,)  # fields of a date, joined by a blank
    form: str = "yyyy.MM.dd HH:mm:ss"  # of the joined date; 'doy': a year and a fractional day of it; 'file': the year ends the file's name, day/HHmm the field
    doy_base: float = 1.0  # what the first of January is
    lat: int = 2
    lon: int = 3
    missing: float | None = None
    source: int = 0  # 0 argos, 1 gps
    gps_text: str = ""  # lines with this text are gps
    stops: bool = False  # the first line that is no record ends its file
    keep: tuple[int, str, bool] | None = None  # field, value, and whether records have that value or any other
    buoy: int | None = None  # field of the buoy's name, where a file has several
    fields: tuple[int, int] | None = None  # how many fields a record may have
    sided: bool = False  # coordinates without N, S, E or W are none
    plausible: bool = False  # only years 1960 to 2025, off the pole and the date line
    grid: Lcc | None = None  # lon and lat are metres east and north of this projection


_IABP = {"skip": 1, "split": ",", "form": "doy", "plausible": True}
#: The readers of the catalogues that come as text, one row each.
CATALOGUES = {
    "aari": Catalogue(comment="#", date=(0, 1), lat=2, lon=3),
    "antsid": Catalogue(comment="!", date=(0, 1), form="doy", doy_base=0.0, missing=999.999),
    "awi": Catalogue(split=",", must="GPS position better than 100m", form="yyyy-MM-dd'T'HH:mm", date=(0,), lat=1, lon=2, source=1),
    "bbb": Catalogue(comment="!", date=(0, 1), form="yyyy.MM.dd HH:mm"),
    "argos": Catalogue(skip=13, date=(0, 1, 2), form="yyyy MM dd", lat=3, lon=4, missing=-999.99902),
    "crrel": Catalogue(split=",", date=(0,), form="M/d/yyyy H:mm", lat=1, lon=2, gps_text="gps", stops=True),
    "hudson": Catalogue(skip=1, date=(2, 3), form="yyyy-MM-dd HH:mm", lat=5, lon=4, grid=Lcc(44.5, 54.5, 0.0, -84.0, 1_000_000.0)),
    "iabp": Catalogue(split=";", date=(1, 4), form="doy", lat=5, lon=6),
    "iabp_3hour": Catalogue(**_IABP, date=(1, 3), lat=4, lon=5, fields=(6, 9)),
    "iabp_full": Catalogue(**_IABP, date=(1, 4), lat=6, lon=7, fields=(8, 11)),
    "itp": Catalogue(comment="%", date=(0, 1), form="doy", lat=3, lon=2),
    "sams": Catalogue(comment="#", date=(1, 2), form="yyyy-MM-dd HH:mm:ss", lat=4, lon=5, keep=(0, "0", False)),
    "simba": Catalogue(skip=1, split=",", date=(0, 1, 2), form="yyyy MM dd", lat=3, lon=4),
    "tara": Catalogue(date=(4,), form="file", lat=1, lon=2, keep=(3, "3", True), buoy=0, sided=True),
    "sip": Catalogue(skip=1, split=",", date=(0,), form="yyyy-MM-dd'T'HH:mm:ss", lat=1, lon=2, stops=True),
}


def _number(x: Column, sided: bool) -> Column:
    """A coordinate, with N, S, E or W behind it or, if not `sided`, without."""
    side = F.when(x.rlike("[SsWw]$"), -1.0).otherwise(1.0)
    value = side * F.regexp_replace(x, "[NnSsEeWw]$", "").try_cast("double")
    return F.when(x.rlike("[NnSsEeWw]$"), value) if sided else value


def _full_year(year: Column) -> Column:
    """Years of two figures: 0 to 25 are of this century, 60 to 99 of the last."""
    return F.when(year.between(0, 25), year + 2000).when(year.between(60, 99), year + 1900).otherwise(year)


def _degrees_east(lon: Column) -> Column:
    return F.when(lon < 0, lon + 360).otherwise(lon)


def records(lines: DataFrame, spec: Catalogue, line: str = "value", number: str = "line_no", file: str | None = None, buoy: str | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """(datetime, lat, lon, source) of the lines that are records, behind the columns `carry`; the others and unreadable ones are left out.

    `number` is the place of a line in its file, from 0; `file` the column of its file's name (none:
    all are of one file); `buoy` the buoy that is wanted of a file with several. Longitudes come out
    in [0, 360).
    """
    text = F.trim(F.col(line))
    rows = lines.where((F.col(number) >= spec.skip) & (text != ""))
    if spec.comment:
        rows = rows.where(~text.startswith(spec.comment))
    if spec.must:
        rows = rows.where(text.contains(spec.must))
    parts = F.split(text, spec.split)
    field = lambda k: F.trim(F.get(parts, F.lit(k)))
    name = F.col(file) if file else F.lit("")
    if spec.form == "doy":
        year, doy = _full_year(field(spec.date[0]).try_cast("int")), field(spec.date[1]).try_cast("double")
        seconds = F.round((doy - spec.doy_base) * 86400)
    elif spec.form == "file":
        year, part = F.right(name, F.lit(4)).try_cast("int"), F.right(field(spec.date[0]), F.lit(8))
        piece = lambda at, n: F.substring(part, at, n).try_cast("int")
        seconds = F.when(part.rlike("^[0-9]{3}/[0-9]{4}$"), (piece(1, 3) - 1) * 86400 + piece(5, 2) * 3600 + piece(7, 2) * 60)
    if spec.form in ("doy", "file"):
        start = F.make_date(F.when(year.between(1, 9999), year), F.lit(1), F.lit(1)).cast("timestamp_ntz")
        when = F.timestamp_add("SECOND", seconds.cast("int"), start)
    else:
        when = F.try_to_timestamp(F.concat_ws(" ", *(field(k) for k in spec.date)), F.lit(spec.form)).cast("timestamp_ntz")
    lat, lon = (_number(field(k), spec.sided) for k in (spec.lat, spec.lon))
    if spec.grid:
        lat, lon = spec.grid.inverse(lon, lat)
    source = F.when(F.lower(text).contains(spec.gps_text), 1).otherwise(spec.source) if spec.gps_text else F.lit(spec.source)
    good = F.lit(True)
    if spec.keep:
        at, value, same = spec.keep
        good = good & ((field(at) == value) if same else (field(at) != value))
    if spec.buoy is not None and buoy is not None:
        good = good & (field(spec.buoy) == buoy)
    if spec.fields:
        good = good & F.size(parts).between(*spec.fields)
    if spec.plausible:
        good = good & year.between(1960, 2025) & (lat.cast("int") != -90) & (F.abs(lon.cast("int")) != 180)
    rows = rows.select(
        F.struct(*carry).alias("carried") if carry else F.lit(None).alias("carried"),
        name.alias("file"),
        F.col(number).alias("number"),
        when.alias("datetime"),
        lat.alias("lat"),
        _degrees_east(lon).alias("lon"),
        source.cast("tinyint").alias("source"),
        good.alias("good"),
    )
    good = F.col("good") & F.col("datetime").isNotNull() & F.col("lat").between(-90, 90) & (F.col("lon") >= 0) & (F.col("lon") < 360)
    if spec.missing is not None:
        good = good & (F.abs(F.col("lat") - spec.missing) > 1e-6) & (F.abs(F.col("lon") - spec.missing) > 1e-6)
    good = F.coalesce(good, F.lit(False))
    if spec.stops:  # a row for each file that has an end before its last line
        ends = rows.where(~good).groupBy(F.col("file").alias("ended")).agg(F.min("number").alias("stop"))
        rows = rows.join(ends, F.col("file").eqNullSafe(F.col("ended")), "left").where(F.col("stop").isNull() | (F.col("number") < F.col("stop")))
    return rows.where(good).select(*(["carried.*"] if carry else []), "datetime", "lat", "lon", "source")


def iabp(lines: DataFrame, file: str, line: str = "value", number: str = "line_no", carry: tuple[str, ...] = ()) -> DataFrame:
    """Records of files of two layouts, told apart by FULL_RESOLUTION in a file's name."""
    full = F.coalesce(F.col(file).contains("FULL_RESOLUTION"), F.lit(False))
    parts = [records(lines.where(full if k == "iabp_full" else ~full), CATALOGUES[k], line, number, file, carry=carry) for k in ("iabp_full", "iabp_3hour")]
    return parts[0].unionByName(parts[1])


def numbered_times(rows: DataFrame, units: str, buoy: str | None = None) -> DataFrame:
    """(datetime, lat, lon, source) of rows (buoy, time, lat, lon) of a NetCDF variable whose units read 'seconds since dd mm yyyy HH:MM UTC'.

    Rows of other buoys, and those without a time or a place, are left out; other units are a ValueError.
    """
    found = re.fullmatch(r"seconds since (\d{2}) (\d{2}) (\d{4}) (\d{2}):(\d{2}) UTC", units.strip())
    if not found:
        raise ValueError(f"units not understood: {units}")
    day, month, year, hour, minute = found.groups()
    start = F.lit(f"{year}-{month}-{day} {hour}:{minute}:00").cast("timestamp_ntz")
    rows = rows if buoy is None else rows.where(F.col("buoy") == buoy)
    rows = rows.where("time is not null and lat is not null and lon is not null and not isnan(lat) and not isnan(lon)")
    return rows.select(F.timestamp_add("SECOND", F.col("time").cast("long"), start).alias("datetime"), "lat", _degrees_east(F.col("lon")).alias("lon"), F.lit(0).cast("tinyint").alias("source"))


def written_times(rows: DataFrame, *about: str) -> DataFrame:
    """(datetime, lat, lon, source) of rows (time_string, latitude, longitude), times such as 01-Apr-2007 10:20:30.

    about: what the file says of itself; its records are gps if any of it does. Rows without a time or a place are left out.
    """
    when = F.try_to_timestamp(F.initcap(F.trim("time_string")), F.lit("dd-MMM-yyyy HH:mm:ss")).cast("timestamp_ntz")
    gps = int(any("gps" in x.lower() for x in about))
    rows = rows.select(when.alias("datetime"), F.col("latitude").alias("lat"), _degrees_east(F.col("longitude")).alias("lon"), F.lit(gps).cast("tinyint").alias("source"))
    return rows.where("datetime is not null and lat is not null and lon is not null and not isnan(lat) and not isnan(lon)")


def defines(lines: DataFrame, line: str = "value") -> DataFrame:
    """(key, value) of `#define KEY VALUE` lines; a value that is another key is followed to its end, null where it leads back to itself.

    Each round doubles the steps that are behind a row, so a chain of n names takes log2(n) rounds.
    """
    pattern = r"^\s*#define\s+(\w+)\s+(\S+)"
    rows = lines.where(F.col(line).rlike(pattern)).select(F.regexp_extract(line, pattern, 1).alias("key"), F.regexp_extract(line, pattern, 2).alias("value"))
    out = cut_lineage(rows.groupBy("key").agg(F.max("value").alias("value")))
    for _ in range(out.count().bit_length() + 1):
        open_ = out.join(out.select(F.col("key").alias("value")), "value", "left_semi")
        if open_.isEmpty():
            return out
        step = out.select(F.col("key").alias("value"), F.col("value").alias("_next"))
        out = cut_lineage(out.join(step, "value", "left").select("key", F.coalesce("_next", "value").alias("value")))
    circle = out.select(F.col("key").alias("value"), F.lit(True).alias("_again"))
    return out.join(circle, "value", "left").select("key", F.when(F.col("_again"), None).otherwise(F.col("value")).alias("value"))
