"""The wind-driven drift model: complex least squares by cell, and its application."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fit(df: DataFrame, cell: str, least: int | Column, *by: str) -> DataFrame:
    """(cell, by, n, ar, ai, cr, ci) of drift = A * wind + C where a cell has more than `least` pairs, which may depend on the keys; nulls are left out."""
    u, v, x, y = (F.col(c) for c in ("u", "v", "iu", "iv"))
    rows = df.where(u.isNotNull() & v.isNotNull() & x.isNotNull() & y.isNotNull())
    s = rows.groupBy(cell, *by).agg(
        F.count(F.lit(1)).alias("n"), F.sum(u).alias("su"), F.sum(v).alias("sv"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(u * u + v * v).alias("ww"), F.sum(u * x + v * y).alias("re"), F.sum(u * y - v * x).alias("im")
    ).where(F.col("n") > least)
    n, su, sv, sx, sy = (F.col(c) for c in ("n", "su", "sv", "sx", "sy"))
    det = n * F.col("ww") - (su * su + sv * sv)
    s = s.withColumns({"ar": F.try_divide(n * F.col("re") - (su * sx + sv * sy), det), "ai": F.try_divide(n * F.col("im") - (su * sy - sv * sx), det)})
    ar, ai = F.col("ar"), F.col("ai")
    return s.select(cell, *by, "n", "ar", "ai", ((sx - (ar * su - ai * sv)) / n).alias("cr"), ((sy - (ar * sv + ai * su)) / n).alias("ci"))


def apply(u: Column, v: Column, ar, ai, cr, ci) -> tuple[Column, Column]:
    """Drift of a wind under the model."""
    return ar * u - ai * v + cr, ar * v + ai * u + ci


def residuals(df: DataFrame, model: DataFrame, cell: str) -> DataFrame:
    """(cell, rms_real, rms_imag) of the fit."""
    rows = df.join(model, cell)
    x, y = apply(F.col("u"), F.col("v"), F.col("ar"), F.col("ai"), F.col("cr"), F.col("ci"))
    rms = lambda e: F.sqrt(F.avg(e * e))
    return rows.groupBy(cell).agg(rms(F.col("iu") - x).alias("rms_real"), rms(F.col("iv") - y).alias("rms_imag"))
