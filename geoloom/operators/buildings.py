"""Building footprints with heights from rings of faces."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import close_ring, from_utm, triples

LOW, HIGH = 0.5, 300.0


def footprints(buildings: DataFrame) -> DataFrame:
    """One footprint per building: id, hoehe, ring (lon, lat).

    Columns in: ``id``, ``measured`` (heights in document order, inner parts
    too), ``ground`` and ``faces`` (arrays of flat coordinate arrays; ``faces``
    stand in where there is no ground).  The ring is the first usable one of the
    ground, else the face of the lowest mean height; the height is the last parseable one, else the extent of z over all
    faces; heights outside 0.5 to 300 m drop the building.
    """
    usable = lambda c: F.filter(F.transform(c, triples), lambda r: r.isNotNull())
    b = buildings.select("id", "measured", usable("ground").alias("g"), usable("faces").alias("f"))
    mean_z = lambda r: F.aggregate(r, F.lit(0.0), lambda s, p: s + p["z"]) / F.size(r)
    order = F.transform("f", lambda r, i: F.struct(mean_z(r).alias("z"), i.alias("i"), r.alias("r")))
    b = b.withColumn("ring", F.coalesce(F.get("g", F.lit(0)), F.array_min(order)["r"])).where("ring is not null")
    heights = F.filter(F.transform("measured", lambda m: m.try_cast("double")), lambda m: m.isNotNull())
    zs = F.transform(F.flatten(F.concat("g", "f")), lambda p: p["z"])
    b = b.withColumn("hoehe", F.coalesce(F.try_element_at(heights, F.lit(-1)), F.array_max(zs) - F.array_min(zs)))
    b = b.where(F.col("hoehe").between(LOW, HIGH)).withColumn("hoehe", F.round("hoehe", 1))

    def place(p):  # noqa: ANN001, ANN202
        lon, lat = from_utm(p["x"], p["y"])
        return F.struct(F.round(lon, 7).alias("lon"), F.round(lat, 7).alias("lat"))

    return b.select("id", "hoehe", close_ring(F.transform("ring", place)).alias("ring"))


def as_geojson(rows: DataFrame) -> DataFrame:
    """One feature a line."""
    ring = F.transform("ring", lambda p: F.array(p["lon"], p["lat"]))
    geometry = F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates"))
    return rows.select(F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct("hoehe").alias("properties"), geometry.alias("geometry"))).alias("value"))


def tile_control(rows: DataFrame) -> DataFrame:
    """Control values per tile: count, median and largest height."""
    return rows.groupBy("tile").agg(F.count("*").alias("n"), F.round(F.median("hoehe"), 1).alias("median"), F.max("hoehe").alias("max"))


def tiles_of(rows: DataFrame, zooms: tuple[int, int] = (13, 16)) -> DataFrame:
    """Every (z, x, y) that a footprint's box touches."""
    from ..functions.geo import tile_xy

    lon, lat = F.transform("ring", lambda p: p["lon"]), F.transform("ring", lambda p: p["lat"])
    z = rows.withColumn("w", F.array_min(lon)).withColumn("e", F.array_max(lon)).withColumn("s", F.array_min(lat)).withColumn("n", F.array_max(lat))
    z = z.withColumn("z", F.explode(F.sequence(F.lit(zooms[0]), F.lit(zooms[1]))))
    x0, y0 = tile_xy("w", "n", "z")
    x1, y1 = tile_xy("e", "s", "z")
    z = z.withColumn("x", F.explode(F.sequence(x0, x1))).withColumn("y0", y0).withColumn("y1", y1)
    return z.withColumn("y", F.explode(F.sequence("y0", "y1"))).drop("w", "e", "s", "n", "y0", "y1")


def points_in_rings(points: DataFrame, rings: DataFrame, z: int = 16) -> DataFrame:
    """Points (pid, lon, lat) inside footprints: an equi join by tile, then the exact test."""
    from ..functions.geo import in_ring, tile_xy

    px, py = tile_xy("lon", "lat", F.lit(z))
    p = points.select("pid", F.col("lon").alias("plon"), F.col("lat").alias("plat"), px.alias("x"), py.alias("y"))
    r = tiles_of(rings, (z, z)).select("id", "ring", "x", "y")
    ring = F.transform("ring", lambda q: F.struct(q["lon"].alias("x"), q["lat"].alias("y")))
    return p.join(r, ["x", "y"]).where(in_ring(F.col("plon"), F.col("plat"), ring)).select("pid", "id")


def vector_tiles(rows: DataFrame, zooms: tuple[int, int] = (13, 16), layer: str = "buildings", extent: int = 4096, batch: int = 20_000) -> DataFrame:
    """Vector tiles of footprints: z, x, y, part, tile.

    Rings are projected by columns; a task packs at most ``batch`` footprints, so
    a crowded tile comes in parts, which readers of the format may join end to end.
    """
    import pandas as pd

    from ..functions.binary import write_tile
    from ..functions.geo import tile_fraction

    t = tiles_of(rows, zooms)

    def pixel(p):  # noqa: ANN001, ANN202
        fx, fy = tile_fraction(p["lon"], p["lat"], F.col("z"))
        return F.struct(F.round((fx - F.col("x")) * extent).cast("int").alias("px"), F.round((fy - F.col("y")) * extent).cast("int").alias("py"))

    sizes = t.groupBy("z", "x", "y").agg(F.ceil(F.count("*") / batch).cast("int").alias("parts"))
    t = t.join(sizes, ["z", "x", "y"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    t = t.select("z", "x", "y", "part", "hoehe", F.transform("ring", pixel).alias("pts"))

    def pack(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        shapes = [([(q["px"], q["py"]) for q in ring[:-1]], {"hoehe": str(h)}) for ring, h in zip(f["pts"], f["hoehe"])]
        return pd.DataFrame({"z": [key[0]], "x": [key[1]], "y": [key[2]], "part": [key[3]], "tile": [write_tile({layer: shapes}, extent)]})

    return t.groupBy("z", "x", "y", "part").applyInPandas(pack, "z int, x bigint, y bigint, part int, tile binary")
