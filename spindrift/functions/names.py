"""File names, identifiers and instruments as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def basename(path: Column) -> Column:
    return F.element_at(F.split(F.regexp_replace(path, "/+$", ""), "/"), -1)


def split_drift_name(name: Column) -> dict[str, Column]:
    """Parts of <prefix>_<instrument-platform>_<channels>_<method>_<level>_<area>_<start>w_<stop>w.nc; null where it is another name."""
    pattern = r"^[a-z]+_([^_]+)_([^_]+)_([^_]+)_(lev\d)_([^_]+)_(\d{10}[wn]?)_(\d{10}[wn]?)\.nc$"
    part = lambda k: F.when(name.rlike(pattern), F.regexp_extract(name, pattern, k))
    stamp = lambda k: F.when(F.length(part(k)) == 11, F.substring(part(k), 1, 10)).otherwise(part(k))
    return {"sensor": part(1), "channels": part(2), "method": part(3), "level": part(4), "area": part(5), "start": stamp(6), "stop": stamp(7)}


def drift_name(sensor: Column, channel: Column, area: Column, start: Column, stop: Column, prefix: str = "drift") -> Column:
    return F.format_string(f"{prefix}_%s_%sv-Lap+%sh-Lap_simplex_lev2_%s_%sw_%sw.nc", sensor, channel, channel, area, start, stop)


def default_channel(instrument: Column) -> Column:
    return F.when(instrument.startswith("amsr"), "37").when(instrument.startswith("ssmi"), "90").otherwise("all")


def instrument_ok(instrument: Column, platform: Column) -> Column:
    """Whether an instrument flies on a platform: numbered satellites below 16 carry ssmi, the later ones ssmis."""
    number = F.regexp_extract(platform, r"^f(\d+)$", 1).try_cast("int")
    ok = (
        F.when(instrument == "ssmi", number < 16)
        .when(instrument == "ssmis", number >= 16)
        .when(instrument == "amsr2", platform.startswith("gw"))
        .when(instrument == "amsr", platform == "aq")
        .when(instrument == "ascat", platform.startswith("metop"))
        .otherwise(F.lit(False))
    )
    return F.coalesce(ok, F.lit(False))


def short_id(network: Column, name: Column) -> Column:
    """At most nine characters that name a buoy: without its file suffix, behind its network's first letter."""
    return F.rpad(F.substring(F.concat(F.substring(network, 1, 1), F.regexp_replace(name, r"(_0pT|_1pT|#)", "")), 1, 9), 9, "z")


def matchup_list_line(line: Column) -> Column:
    return basename(line).rlike(r"^matchup_[a-z0-9_-]+\.nc$")
