"""Elevation rasters in long form: gaps, pyramids, tiles, checks.

Averages are always taken of heights, before they are encoded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import decode_height, encode_height

NODATA = -9999.0
TILE = 256


def is_gap(h: Column, nodata: float = NODATA) -> Column:
    return h.isNull() | F.isnan(h) | (h == nodata) | (h < -1000)


def fill_gaps(cells: DataFrame, tile: list[str], h: str = "h") -> DataFrame:
    """Cells with gaps set to the mean of their tile's valid cells; tiles of gaps
    alone are left out.  The means are aggregated first and joined, so no tile
    is gathered in one task."""
    valid = F.when(~is_gap(F.col(h)), F.col(h))
    means = cells.groupBy(*tile).agg(F.avg(valid).alias("__mean")).where("__mean is not null")
    return cells.join(means, tile).withColumn(h, F.coalesce(valid, F.col("__mean"))).drop("__mean")


def halve(cells: DataFrame, factor: int = 2) -> DataFrame:
    """Means of factor x factor cells (px, py, h, and n: cells behind it).

    Coarser levels weigh by ``n``, so each level is the mean of the original cells.
    """
    n = F.col("n") if "n" in cells.columns else F.lit(1).cast("bigint")
    c = cells.withColumn("n", n).where(~is_gap(F.col("h")))
    return c.groupBy(F.floor(F.col("px") / factor).alias("px"), F.floor(F.col("py") / factor).alias("py")).agg(
        (F.sum(F.col("h") * F.col("n")) / F.sum("n")).alias("h"), F.sum("n").alias("n")
    )


def pyramid(cells: DataFrame, levels: int) -> list[DataFrame]:
    """The raster and its coarser levels, each made of the one before."""
    out = [cells]
    for _ in range(levels):
        out.append(halve(out[-1]))
    return out


def cut_tiles(cells: DataFrame, size: int = TILE) -> DataFrame:
    """Whole tiles only: tx, ty and the place within; blocks that miss cells are left out."""
    t = cells.select(
        F.floor(F.col("px") / size).alias("tx"), F.floor(F.col("py") / size).alias("ty"),
        F.pmod("px", F.lit(size)).alias("ix"), F.pmod("py", F.lit(size)).alias("iy"), "h",
    )
    full = t.groupBy("tx", "ty").agg(F.count("*").alias("n")).where(F.col("n") == size * size).select("tx", "ty")
    return t.join(full, ["tx", "ty"])


def encode(cells: DataFrame, h: str = "h") -> DataFrame:
    r, g, b = encode_height(h)
    return cells.withColumn("r", r).withColumn("g", g).withColumn("b", b)


def deviation(samples: DataFrame, limit: float = 6.0) -> DataFrame:
    """Of samples (name, r, g, b, soll): largest deviation, missing ones, verdict."""
    d = F.abs(decode_height("r", "g", "b") - F.col("soll"))
    return samples.agg(F.max(d).alias("max_abw"), F.count_if(F.col("r").isNull()).alias("fehlend")).withColumn(
        "urteil", F.when((F.col("fehlend") == 0) & (F.col("max_abw") <= limit), "gut").otherwise("schlecht")
    )


def resample(cells: DataFrame, target_x: Column, target_y: Column) -> DataFrame:
    """Warp by averages: every cell goes to the target cell its centre falls in."""
    return cells.where(~is_gap(F.col("h"))).groupBy(target_x.alias("px"), target_y.alias("py")).agg(F.avg("h").alias("h"))


def bilinear(points: DataFrame, cells: DataFrame) -> DataFrame:
    """Heights at points (id, fx, fy in cell units) from the four cells around."""
    corners = points.select(
        "id", "fx", "fy", F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)))).alias("c")
    )
    fx, fy = F.floor("fx"), F.floor("fy")
    corners = corners.select(
        "id", (fx + F.col("c.a")).alias("px"), (fy + F.col("c.b")).alias("py"),
        (F.abs(1 - F.col("c.a") - (F.col("fx") - fx)) * F.abs(1 - F.col("c.b") - (F.col("fy") - fy))).alias("w"),
    )
    j = corners.join(cells, ["px", "py"])
    return j.groupBy("id").agg((F.sum(F.col("h") * F.col("w")) / F.sum("w")).alias("h"))


def dark_share(pixels: DataFrame) -> DataFrame:
    """Share of black opaque pixels."""
    black = (F.col("r") == 0) & (F.col("g") == 0) & (F.col("b") == 0) & (F.col("a") == 255)
    return pixels.agg(F.avg(F.when(black, 1.0).otherwise(0.0)).alias("dark"))


def png_tiles(cells: DataFrame, size: int = TILE) -> DataFrame:
    """Terrain pictures of whole tiles (tx, ty, ix, iy, h), gaps filled: tx, ty, png.

    A tile has size x size cells, so a group is bounded.
    """
    import numpy as np
    import pandas as pd

    from ..functions.binary import encode_png

    def draw(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rgb = np.zeros((size, size, 3), np.uint8)
        rgb[rows["iy"], rows["ix"]] = rows[["r", "g", "b"]].to_numpy()
        return pd.DataFrame({"tx": [key[0]], "ty": [key[1]], "png": [encode_png(rgb.tobytes(), size, size)]})

    rows = encode(fill_gaps(cells, ["tx", "ty"])).select("tx", "ty", "ix", "iy", "r", "g", "b")
    return rows.groupBy("tx", "ty").applyInPandas(draw, "tx bigint, ty bigint, png binary")
