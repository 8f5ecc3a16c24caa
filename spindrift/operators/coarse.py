"""The coarse search: the best start displacements of every cell, over images of any size.

Images are cut into square tiles. A pixel goes to its own tile and to those whose halo it lies in, so a tile
of the first date joins the same tile of the second on its key, and all that a cell's pattern and its
furthest candidate can touch is there. No row holds more than one tile with its halo.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.operators.merge import offsets
from spindrift.operators.tracking import candidates, fade, shifted
from spindrift.runtime import map_arrow

TILE, BEST, LEAST_SHARE = 64, 3, 0.75


def tiles_of(v: Column, tile: int, halo: int) -> Column:
    """The numbers of the tiles along one axis that a coordinate belongs to, with their halos."""
    return F.sequence(F.floor((v - halo) / tile), F.floor((v + halo) / tile))


def tiled(px: DataFrame, keys: tuple[str, ...], tile: int, halo: int, name: str) -> DataFrame:
    """keys, tx, ty and the pixels of each tile with its halo as an array of (x, y, v)."""
    rows = px.where(F.col("v").isNotNull()).select(*keys, "x", "y", "v", F.explode(tiles_of(F.col("x"), tile, halo)).alias("tx")).select("*", F.explode(tiles_of(F.col("y"), tile, halo)).alias("ty"))
    return rows.groupBy(*keys, "tx", "ty").agg(F.collect_list(F.struct(F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"), F.col("v").cast("double").alias("v"))).alias(name))  # (tile + 2 halo)^2 at most


def raster(pixels: list[dict], x0: int, y0: int, side: int) -> np.ndarray:
    """Pixels as an array from (x0, y0) on; NaN where there is none."""
    out = np.full((side, side), np.nan)
    if pixels:
        x, y, v = (np.array([p[k] for p in pixels]) for k in "xyv")
        out[y - y0, x - x0] = v
    return out


def scores(a: np.ndarray, b: np.ndarray, cells: np.ndarray, pattern: np.ndarray, moves: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """[cell, move]: correlation of a's pattern at each cell with b moved back, weighed by the move; -1 where too little is there."""
    at_y, at_x = cells[:, 1, None] + pattern[None, :, 1], cells[:, 0, None] + pattern[None, :, 0]
    p = a[at_y, at_x]
    out = np.full((len(cells), len(moves)), -1.0)
    for k, d in enumerate(moves):
        s = shifted(b, *d)[at_y, at_x]
        ok = ~np.isnan(p) & ~np.isnan(s)
        n = ok.sum(1)
        some = n >= LEAST_SHARE * len(pattern)
        div = np.maximum(n, 1)
        x, y = np.where(ok, p, 0), np.where(ok, s, 0)
        x, y = np.where(ok, x - (x.sum(1) / div)[:, None], 0), np.where(ok, y - (y.sum(1) / div)[:, None], 0)
        xx, yy = (x * x).sum(1), (y * y).sum(1)
        good = some & (xx > 0) & (yy > 0)
        out[good, k] = ((x * y).sum(1)[good] / np.sqrt(xx[good] * yy[good]) + 1) * weights[k] - 1
    return out


def search(cells: DataFrame, begin: DataFrame, end: DataFrame, limit: float, radius: float, first: float = 5.0, step: float = 10.0, spacing: float = 1.0, tile: int = TILE, keys: tuple[str, ...] = ("image",), best: int = BEST) -> DataFrame:
    """keys, x, y, place (from 1), candidate, dx, dy and score: the best displacements of each cell, in the units of `spacing`.

    cells has keys, x and y on the pixels' grid, begin and end have keys, x, y and v. Candidates lie on rings below the
    limit, `first` and then `step` apart, and are tried in order: of equal scores the earlier one is better, and those
    of -1 or less are none. radius is the pattern's, spacing the size of a pixel, both in those units too.
    """
    rings = candidates(limit, first, step)
    moves, weights = np.array(rings).reshape(-1, 2) / spacing, np.array([fade(np.array(d), limit) for d in rings])
    pattern = np.array(offsets(radius / spacing))
    around = int(np.abs(pattern).max(initial=0))
    halo = around + int(ceil(np.abs(moves).max(initial=0))) + 1
    side = tile + 2 * halo
    a, b = tiled(begin, keys, tile, around, "a"), tiled(end, keys, tile, halo, "b")
    c = cells.select(*keys, "x", "y", F.floor(F.col("x") / tile).alias("tx"), F.floor(F.col("y") / tile).alias("ty"))
    c = c.groupBy(*keys, "tx", "ty").agg(F.collect_list(F.struct(F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"))).alias("cells"))  # a tile's
    rows = c.join(a, [*keys, "tx", "ty"]).join(b, [*keys, "tx", "ty"]).select(*keys, "tx", "ty", "cells", "a", "b")
    n = len(keys)

    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                tx, ty, own, one, two = (batch.column(n + k)[r].as_py() for k in range(5))
                x0, y0 = tx * tile - halo, ty * tile - halo
                at = np.array([(q["x"] - x0, q["y"] - y0) for q in own])
                got = scores(raster(one, x0, y0, side), raster(two, x0, y0, side), at, pattern, moves, weights)
                order = np.argsort(-got, axis=1, kind="stable")[:, :best]
                value = np.take_along_axis(got, order, 1)
                cell, place = np.nonzero(value > -1)
                k = order[cell, place]
                many = len(cell)
                columns = [batch.column(q).slice(r, 1).take(pa.array(np.zeros(many, np.int64))) for q in range(n)]
                columns += [pa.array(at[cell, 0] + x0), pa.array(at[cell, 1] + y0), pa.array((place + 1).astype(np.int32)), pa.array(k.astype(np.int32)), pa.array(moves[k, 0] * spacing), pa.array(moves[k, 1] * spacing), pa.array(value[cell, place])]
                yield pa.RecordBatch.from_arrays(columns, names=[*keys, "x", "y", "place", "candidate", "dx", "dy", "score"])

    kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    return map_arrow(rows, run, f"{kinds}, x bigint, y bigint, place int, candidate int, dx double, dy double, score double")
