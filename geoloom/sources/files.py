"""File readers and writers."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructType

CATALOGUE = "datasets array<struct<files:array<struct<name:string,size:string>>>>"
ROUTE = (
    "trip struct<summary:struct<length:double>,legs:array<struct<shape:string,elevation:array<double>,"
    "maneuvers:array<struct<instruction:string,begin_shape_index:int,length:double,type:int>>>>>"
)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with an ``ordinal`` that follows the file order.

    The ordinal counts partitions first; Spark reads the splits of one file in
    order, so it rises with the line within every file.
    """
    return spark.read.text(path).withColumn("ordinal", F.monotonically_increasing_id())


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """Nested catalogue documents; an unreadable or empty one is an error."""
    df = spark.read.schema(CATALOGUE).option("multiLine", True).json(path).withColumn("ordinal", F.monotonically_increasing_id())
    if df.where(F.size("datasets") > 0).isEmpty():
        raise ValueError(f"no datasets in {path}")
    return df


def read_routes(spark: SparkSession, path: str) -> DataFrame:
    """Route answers; those without a trip are left out."""
    return spark.read.schema(ROUTE).option("multiLine", True).json(path).where("trip is not null")


def write_list(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, sep="\t", header=False)


def read_list(spark: SparkSession, path: str, schema: str = "bereich string, name string, groesse bigint") -> DataFrame:
    return spark.read.schema(schema).csv(path, sep="\t", header=False)


def write_text(df: DataFrame, path: str) -> None:
    """A text column as lines (GeoJSON lines, positional arrays)."""
    df.select("value").write.mode("overwrite").text(path)


def read_style(spark: SparkSession, path: str) -> dict:
    from ..functions.style import load_style

    return load_style(spark.read.text(path, wholetext=True).first().value)


RING = ArrayType(DoubleType())
BUILDING = ArrayType(
    StructType().add("id", StringType()).add("measured", ArrayType(StringType())).add("ground", ArrayType(RING)).add("faces", ArrayType(RING))
)


def parse_buildings(data: bytes) -> list[dict] | None:
    """Buildings of a CityGML file; null if the file is malformed.

    Namespaces do not matter.  Faces are outer rings, as ``posList`` or as
    single ``pos``, a polygon without ``exterior`` is its own ring; a ring with
    an unreadable number keeps a null there.
    """
    import io
    from xml.etree import ElementTree

    def local(e) -> str:  # noqa: ANN001
        return e.tag.rpartition("}")[2]

    def number(word: str) -> float | None:
        try:
            return float(word)
        except ValueError:
            return None

    def ring(polygon) -> list[float | None]:  # noqa: ANN001
        outer = next((e for e in polygon if local(e) == "exterior"), polygon)
        return [number(w) for e in outer.iter() if local(e) in ("posList", "pos") for w in (e.text or "").split()]

    def rings(e) -> list[list[float | None]]:  # noqa: ANN001
        return [ring(p) for p in e.iter() if local(p) == "Polygon"]

    out: list[dict] = []
    try:
        for _, e in ElementTree.iterparse(io.BytesIO(data)):
            if local(e) == "Building":  # a building within another one comes first and apart
                ground = [r for g in e.iter() if local(g) == "GroundSurface" for r in rings(g)]
                measured = [m.text for m in e.iter() if local(m) == "measuredHeight"]
                key = next((v for k, v in e.attrib.items() if k.rpartition("}")[2] == "id"), None)
                out.append({"id": key, "measured": measured, "ground": ground, "faces": rings(e)})
                e.clear()
    except ElementTree.ParseError:
        return None
    return out


@F.pandas_udf(BUILDING)
def buildings_of(content: pd.Series) -> pd.Series:
    return content.map(parse_buildings)


def read_buildings(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Buildings of CityGML files, and the paths of files dropped as malformed."""
    files = spark.read.format("binaryFile").load(path).select("path", buildings_of("content").alias("b"))
    return files.where("b is not null").select("path", F.explode("b").alias("b")).select("path", "b.*"), files.where("b is null").select("path")


def write_log(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def sheet_json(rows: DataFrame) -> str:
    """A sprite sheet's index (symbol, x, y, width, ratio); a few hundred rows."""
    return json.dumps({r.symbol: {"x": r.x, "y": r.y, "width": r.width, "height": r.width, "pixelRatio": r.ratio} for r in rows.collect()}, sort_keys=True)
