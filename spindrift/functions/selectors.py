"""Selectors of matchups as column predicates, and their folding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def equals(field: str, value) -> Column:
    return F.col(field) == value


def label(field: str, value: str, case: bool = False) -> Column:
    """A label, alike but for case unless asked otherwise."""
    return F.col(field) == value if case else F.lower(F.col(field)) == value.lower()


def period(field: str, first: str, last: str) -> Column:
    """A closed period."""
    t = lambda s: F.lit(s).cast("timestamp_ntz")
    return F.col(field).between(t(first), t(last))


def box(field: str, low: float, high: float) -> Column:
    """A closed latitude band."""
    if not -90 <= low <= high <= 90:
        raise ValueError("a latitude band needs -90 <= low <= high <= 90")
    return F.col(field).between(low, high)


def lon_box(field: str, west: float, east: float) -> Column:
    """A closed longitude band, on longitudes wrapped into [-180, 180)."""
    if west >= east:
        raise ValueError("west must be less than east")
    return (((F.col(field) + 180) % 360 + 360) % 360 - 180).between(west, east)


def fold(parts: list[tuple[str, Column]]) -> Column:
    """Predicates applied in turn to a running mask; the first must be 'and'."""
    if parts and parts[0][0] != "and":
        raise ValueError("the first selector must be 'and'")
    mask = F.lit(True)
    for how, predicate in parts:
        mask = mask & predicate if how == "and" else mask | predicate
    return mask
