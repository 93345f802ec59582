"""Tile archives: MBTILES files (SQLite) as data source and sink."""

from __future__ import annotations

import os
import sqlite3
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.geo import flip_row


class Zoom(InputPartition):
    def __init__(self, z: int, low: int, high: int):
        self.z, self.low, self.high = z, low, high


class MbtilesReader(DataSourceReader):
    """One partition per stretch of columns of a zoom level."""

    STRETCH = 1024

    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as db:
            ranges = db.execute("select zoom_level, min(tile_column), max(tile_column) from tiles group by zoom_level").fetchall()
        out = [Zoom(z, a, a + self.STRETCH) for z, lo, hi in ranges for a in range(lo, hi + 1, self.STRETCH)]
        return out or [Zoom(-1, 0, 0)]

    def read(self, p: Zoom) -> Iterator[tuple]:
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as db:
            for z, x, row, data in db.execute(
                "select zoom_level, tile_column, tile_row, tile_data from tiles where zoom_level = ? and tile_column >= ? and tile_column < ?", (p.z, p.low, p.high)
            ):
                yield z, x, 2**z - 1 - row, data


class Mbtiles(DataSource):
    """``spark.read.format("mbtiles").load(path)``: z, x, y (from the top), tile."""

    @classmethod
    def name(cls) -> str:
        return "mbtiles"

    def schema(self) -> str:
        return "z int, x int, y int, tile binary"

    def reader(self, schema) -> MbtilesReader:  # noqa: ANN001
        return MbtilesReader(self.options["path"])


def register(spark: SparkSession) -> None:
    from .osm import OsmPbf

    spark.dataSource.register(Mbtiles)
    spark.dataSource.register(OsmPbf)


def write_tiles(tiles: DataFrame, path: str, metadata: dict[str, str] | None = None) -> None:
    """The cluster form of an archive: Parquet by zoom with rows from the bottom, and a metadata table."""
    rows = tiles.select(F.col("z").alias("zoom_level"), F.col("x").alias("tile_column"), flip_row("y", "z").alias("tile_row"), F.col("tile").alias("tile_data"))
    rows.write.mode("overwrite").partitionBy("zoom_level").parquet(f"{path}/tiles")
    tiles.sparkSession.createDataFrame(list((metadata or {}).items()), "name string, value string").coalesce(1).write.mode("overwrite").parquet(f"{path}/metadata")


def export_mbtiles(tiles: DataFrame, path: str, metadata: dict[str, str] | None = None) -> int:
    """One archive file on the driver: rows stream through it, a later tile replaces an earlier one."""
    part = f"{path}.part"
    with sqlite3.connect(part) as db:
        db.execute("create table if not exists metadata (name text primary key, value text)")
        db.execute("create table if not exists tiles (zoom_level int, tile_column int, tile_row int, tile_data blob)")
        db.execute("create unique index if not exists tile_index on tiles (zoom_level, tile_column, tile_row)")
        db.executemany("insert or replace into metadata values (?, ?)", list((metadata or {}).items()))
        n = 0
        for r in tiles.select("z", "x", "y", "tile").toLocalIterator():
            db.execute("insert or replace into tiles values (?, ?, ?, ?)", (r.z, r.x, 2**r.z - 1 - r.y, bytes(r.tile)))
            n += 1
        db.commit()
    os.replace(part, path)
    return n


def extract(tiles: DataFrame, box: tuple[float, float, float, float], maxzoom: int) -> DataFrame:
    """Tiles that touch a box (west, south, east, north) up to a zoom level."""
    from ..functions.geo import tile_xy

    w, s, e, n = map(F.lit, box)
    x0, y0 = tile_xy(w, n, "z")
    x1, y1 = tile_xy(e, s, "z")
    return tiles.where((F.col("z") <= maxzoom) & F.col("x").between(x0, x1) & F.col("y").between(y0, y1))
