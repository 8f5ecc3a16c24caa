"""Seasons, fractions, months and period strings as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def month_day(d: Column) -> Column:
    return F.month(d) * 100 + F.dayofmonth(d)


def merge_season(d: Column, area: Column) -> Column:
    """Season of a date; bounds are inclusive and winter is tested first."""
    md = month_day(d)
    north = F.when((md >= 1101) | (md <= 401), "winter").when(md.between(601, 901), "summer").when(md.between(401, 601), "spring").otherwise("autumn")
    south = F.when(md.between(401, 1001), "winter").when((md >= 1201) | (md <= 201), "summer").when(md.between(1001, 1201), "spring").otherwise("autumn")
    return F.when(area == "nh", north).otherwise(south)


def bounds(d: Column, area: Column, season: Column) -> tuple[Column, Column]:
    """First and last day of the transition season a date lies in."""
    y = F.year(d)
    at = lambda m: F.make_date(y, F.lit(m), F.lit(1))
    spring = F.when(area == "nh", at(4)).otherwise(at(10)), F.when(area == "nh", at(6)).otherwise(at(12))
    autumn = F.when(area == "nh", at(9)).otherwise(at(2)), F.when(area == "nh", at(11)).otherwise(at(4))
    return F.when(season == "spring", spring[0]).otherwise(autumn[0]), F.when(season == "spring", spring[1]).otherwise(autumn[1])


def winter_fraction(d: Column, area: Column) -> Column:
    """Share of winter: 1 in winter, 0 in summer, linear between."""
    season = merge_season(d, area)
    first, last = bounds(d, area, season)
    done = F.datediff(d, first) / F.datediff(last, first)
    return F.when(season == "winter", 1.0).when(season == "summer", 0.0).when(season == "spring", 1 - done).otherwise(done)


def summer_hold(d: Column, area: Column) -> Column:
    """Whether vectors of a date are held back: 1 May to 1 October in the north, from 1 November to 1 April in the south."""
    md = month_day(d)
    return F.when(area == "nh", md.between(501, 1001)).otherwise((md >= 1101) | (md <= 401))


def decode_period(code: Column, year: Column) -> tuple[Column, Column]:
    """First and last day of Y, H1-H2, Q1-Q4 or M1-M12 of a year."""
    kind, n = F.substring(code, 1, 1), F.coalesce(F.regexp_extract(code, r"^[HQM](\d+)$", 1).try_cast("int"), F.lit(1))
    width = F.when(kind == "H", 6).when(kind == "Q", 3).when(kind == "M", 1).otherwise(12)
    first = F.make_date(year, (n - 1) * width + 1, F.lit(1))
    return first, F.last_day(F.add_months(first, width - 1))


def previous_period(code: Column, year: Column) -> tuple[Column, Column]:
    kind, n = F.substring(code, 1, 1), F.coalesce(F.regexp_extract(code, r"^[HQM](\d+)$", 1).try_cast("int"), F.lit(1))
    most = F.when(kind == "H", 2).when(kind == "Q", 4).when(kind == "M", 12)
    back = (kind == "Y") | (n == 1)
    name = F.when(kind == "Y", F.lit("Y")).otherwise(F.concat(kind, F.when(n == 1, most).otherwise(n - 1).cast("string")))
    return name, F.when(back, year - 1).otherwise(year)
