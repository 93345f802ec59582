"""Tile selection: areas, catalogues, wanted and missing tiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.geo import tile_xy
from ..functions.text import tile_of_name, tile_of_parts


def area_grid(spark: SparkSession, areas: list[tuple[str, int, int, int, int]]) -> DataFrame:
    """Every tile of half-open boxes (name, x0, x1, y0, y1) with the box's rank (0 first)."""
    rows = spark.createDataFrame([(i, *a) for i, a in enumerate(areas)], "rang int, bereich string, x0 long, x1 long, y0 long, y1 long").where("x1 > x0 and y1 > y0")
    return rows.select("rang", "bereich", F.explode(F.sequence("x0", F.col("x1") - 1)).alias("x"), "y0", "y1").select(
        "rang", "bereich", "x", F.explode(F.sequence("y0", F.col("y1") - 1)).alias("y")
    )


def box_grid(boxes: DataFrame) -> DataFrame:
    """Tiles of boxes (z, west, south, east, north in degrees) at each zoom."""
    x0, y0 = tile_xy("west", "north", "z")
    x1, y1 = tile_xy("east", "south", "z")
    t = boxes.select("z", x0.alias("x0"), x1.alias("x1"), y0.alias("y0"), y1.alias("y1"))
    return t.select("z", F.explode(F.sequence("x0", "x1")).alias("x"), "y0", "y1").select("z", "x", F.explode(F.sequence("y0", "y1")).alias("y")).distinct()


def around(points: DataFrame, z: int, radius: int = 1) -> DataFrame:
    """The tiles within ``radius`` of each point's tile; input columns are kept."""
    x, y = tile_xy("lon", "lat", F.lit(z), clamp=False)
    off = F.sequence(F.lit(-radius), F.lit(radius))
    p = points.withColumn("x", x).withColumn("y", y).withColumn("dx", F.explode(off)).withColumn("dy", F.explode(off))
    return p.withColumn("x", F.col("x") + F.col("dx")).withColumn("y", F.col("y") + F.col("dy")).drop("dx", "dy")


def catalogue_files(catalogue: DataFrame, by_parts: bool = False, suffix: str = ".jp2") -> DataFrame:
    """Files of a nested catalogue with their tile: x, y, name, size, ordinal.

    Columns in: ``ordinal`` and ``datasets`` (array of structs with ``files``).
    """
    ds = catalogue.select("ordinal", F.posexplode("datasets").alias("d", "ds"))
    fs = ds.select("ordinal", "d", F.posexplode("ds.files").alias("f", "file"))
    tile = tile_of_parts("file.name", suffix) if by_parts else tile_of_name("file.name")
    rows = fs.select(tile.alias("t"), F.col("file.name").alias("name"), F.col("file.size").try_cast("bigint").alias("size"), F.struct("ordinal", "d", "f").alias("ordinal"))
    return rows.where("t is not null").select(F.col("t.east").alias("x"), F.col("t.north").alias("y"), "name", "size", "ordinal")


def last_of_tile(files: DataFrame) -> DataFrame:
    """Per tile the last file in catalogue order."""
    return files.groupBy("x", "y").agg(F.max_by(F.struct("name", "size"), "ordinal").alias("b")).select("x", "y", "b.name", "b.size")


def assign_areas(grid: DataFrame, catalogue: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tiles found, each with its first area by rank, and counts per area.

    Counts: tiles of an area found and missing (areas may share tiles), and
    tiles and bytes that are marked with it (they do not).
    """
    j = grid.join(catalogue, ["x", "y"], "left")
    found = j.where("name is not null")
    marked = found.groupBy("x", "y").agg(F.min_by("bereich", "rang").alias("bereich"), F.first("name").alias("name"), F.first("size").alias("size"))
    own = marked.groupBy("bereich").agg(F.count("*").alias("marked"), F.sum("size").alias("bytes"))
    counts = j.groupBy("bereich").agg(F.count_if(F.col("name").isNotNull()).alias("found"), F.count_if(F.col("name").isNull()).alias("missing"))
    return marked, counts.join(own, "bereich", "left").na.fill({"marked": 0, "bytes": 0})


def wanted_and_missing(wanted: DataFrame, catalogue: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Catalogue entries of wanted tiles, and wanted tiles without one."""
    w = wanted.select("x", "y").distinct()
    return w.join(catalogue, ["x", "y"]), w.join(catalogue.select("x", "y"), ["x", "y"], "left_anti")


def still_to_do(wanted: DataFrame, present: DataFrame) -> DataFrame:
    return wanted.join(present.select("z", "x", "y"), ["z", "x", "y"], "left_anti")


def size_mismatches(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Files whose size differs from the expected one or that are absent: name, soll, ist."""
    return expected.join(actual, "name", "left").where("ist is null or ist <> soll").select("name", "soll", "ist")


def marker_filter(rows: DataFrame, marker: str) -> DataFrame:
    """Rows of an area, all of them for ``alle``; names become .tif names."""
    rows = rows if marker == "alle" else rows.where(F.col("bereich") == marker)
    return rows.withColumn("name", F.regexp_replace("name", "\\.jp2$", ".tif"))


def newest_build(days: DataFrame, today: str, window: int = 12) -> DataFrame:
    """The newest available day of the last ``window`` days."""
    recent = F.col("day").between(F.date_sub(F.lit(today).cast("date"), window - 1), F.lit(today).cast("date"))
    return days.where(recent & F.col("available")).orderBy(F.desc("day")).limit(1)


def progress(done: DataFrame, total: int, seconds: float) -> DataFrame:
    """Done, percent, rate and remaining seconds; ``done`` has a ``state`` of done, empty or error."""
    d = done.agg(F.count("*").alias("done"), F.count_if(F.col("state") == "empty").alias("empty"), F.count_if(F.col("state") == "error").alias("errors"))
    rate = F.col("done") / F.lit(seconds)
    return d.select("done", "empty", "errors", (100.0 * F.col("done") / total).alias("percent"), rate.alias("rate"), ((total - F.col("done")) / rate).alias("remaining"))


def rate_slots(requests: DataFrame, rate: float, key: str = "id", time: str = "t") -> DataFrame:
    """Requests with their start time ``slot`` under a common rate per key, and
    their number ``n`` from 1 in order of time: spaced out by 1 / rate at least.
    """
    by = Window.partitionBy(key).orderBy(time)
    r = requests.withColumn("n", F.row_number().over(by).cast("bigint"))
    gap = (F.col("n") - 1) / rate
    return r.withColumn("slot", F.max(F.col(time) - gap).over(by.rowsBetween(Window.unboundedPreceding, 0)) + gap)


def grid_layout(rows: DataFrame, order: str, columns: int, width: int, top: int) -> DataFrame:
    """Places in a sheet of ``columns`` cells a row, below ``top`` pixels."""
    i = F.row_number().over(Window.orderBy(order)) - 1  # one row per symbol: a few hundred
    return rows.withColumn("i", i).withColumn("x", (F.col("i") % columns) * width).withColumn("y", top + F.floor(F.col("i") / columns) * width)
