"""Three-level address index: places, streets, house numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import first_filled, number_sort_key, stripped_form, transcribed_form
from ..sources.scratch import stash

RAW = ("ort", "plz", "strasse", "hnr", "lat", "lon")


def node_addresses(nodes: DataFrame) -> DataFrame:
    """Address rows of nodes (id, lat, lon, tags) with a house number and a valid location."""
    t = lambda k: F.element_at("tags", F.lit(k))
    return nodes.where((first_filled(t("addr:housenumber")) != "") & F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180)).select(
        first_filled(t("addr:city"), t("addr:place")).alias("ort"), first_filled(t("addr:postcode")).alias("plz"),
        first_filled(t("addr:street")).alias("strasse"), t("addr:housenumber").alias("hnr"), "lat", "lon",
    )


def way_addresses(ways: DataFrame) -> DataFrame:
    """Address rows of ways (id, nodes, tags), placed at their first node."""
    t = lambda k: F.element_at("tags", F.lit(k))
    return ways.where((F.size("nodes") > 0) & (first_filled(t("addr:housenumber")) != "")).select(
        F.get("nodes", F.lit(0)).alias("node"), first_filled(t("addr:street")).alias("strasse"), t("addr:housenumber").alias("hnr"),
        first_filled(t("addr:city"), t("addr:place")).alias("ort"), first_filled(t("addr:postcode")).alias("plz"),
    )


def needed_nodes(nodes: DataFrame, ways: DataFrame) -> DataFrame:
    """Nodes that some address way begins with (id, lat, lon), invalid places left out."""
    return nodes.where(F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180)).join(ways.select(F.col("node").alias("id")), "id", "left_semi")


def latest_positions(nodes: DataFrame) -> DataFrame:
    """One position per node id, the last by ``ordinal``; invalid ones do not count."""
    ok = nodes.where(F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180))
    return ok.groupBy("id").agg(F.max_by(F.struct("lat", "lon"), "ordinal").alias("p")).select("id", "p.lat", "p.lon")


def place_ways(ways: DataFrame, positions: DataFrame) -> DataFrame:
    """Address rows of ways with the position of their node; unresolved ways vanish."""
    p = positions.select(F.col("id").alias("node"), "lat", "lon")
    return ways.join(p, "node").select(*RAW)


def raw_addresses(nodes: DataFrame, ways: DataFrame) -> DataFrame:
    """All address rows: of ways and of nodes; repeats stay."""
    w = way_addresses(ways)
    return place_ways(w, needed_nodes(nodes, w)).unionByName(node_addresses(nodes))


def places(raw: DataFrame) -> DataFrame:
    """One row per place name, same-named places as one: ort, plz, lat, lon, anzahl."""
    return raw.where("ort <> ''").groupBy("ort").agg(
        F.min(F.nullif("plz", F.lit(""))).alias("plz"), F.avg("lat").alias("lat"), F.avg("lon").alias("lon"), F.count("*").alias("anzahl")
    )


def _numbered(df: DataFrame, name: str, *order: str) -> DataFrame:
    """Ids in the order of ``order``: a range sort, then counts of the parts before.

    No window over the whole table: rows are numbered within sorted partitions
    and each partition starts where the ones before end.  The rows are written
    before they are sampled for range bounds, and once more when numbered.
    """
    ranged = stash(df, "rows").repartitionByRange(*order).sortWithinPartitions(*order)
    row = F.monotonically_increasing_id()  # the part above 33 bits, the row within it below
    parted = stash(ranged.withColumn("__row", row).withColumn("__part", F.shiftright("__row", 33)), "numbered")
    counts = parted.groupBy("__part").agg(F.count("*").alias("__n"))
    first = counts.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__first"))  # one row per partition
    within = F.col("__row").bitwiseAND(F.lit((1 << 33) - 1))
    return parted.join(F.broadcast(first), "__part").withColumn(name, F.col("__first") + within + 1).drop("__part", "__row", "__first")


def place_index(raw: DataFrame) -> DataFrame:
    """Places with ids in name order and search forms."""
    p = _numbered(places(raw), "id", "ort")
    return p.select("id", F.col("ort").alias("name"), "plz", "lat", "lon", "anzahl", transcribed_form("ort").alias("such1"), stripped_form("ort").alias("such2"))


def street_index(raw: DataFrame, place_rows: DataFrame) -> DataFrame:
    """Streets of places with ids in (place, name) order and search forms."""
    p = place_rows.select(F.col("id").alias("ort_id"), F.col("name").alias("ort"))
    s = raw.where("strasse <> ''").join(p, "ort").groupBy("ort_id", "strasse").agg(
        F.avg("lat").alias("lat"), F.avg("lon").alias("lon"), F.count("*").alias("anzahl")
    )
    s = _numbered(s, "id", "ort_id", "strasse")
    return s.select(
        "id", "ort_id", F.col("strasse").alias("name"), "lat", "lon", "anzahl", transcribed_form("strasse").alias("such1"), stripped_form("strasse").alias("such2")
    )


def number_index(raw: DataFrame, place_rows: DataFrame, street_rows: DataFrame) -> DataFrame:
    """House numbers of streets with sort keys; repeats stay."""
    p = place_rows.select(F.col("id").alias("ort_id"), F.col("name").alias("ort"))
    s = street_rows.select(F.col("id").alias("strasse_id"), "ort_id", F.col("name").alias("strasse"))
    return raw.join(p, "ort").join(s, ["ort_id", "strasse"]).select("strasse_id", F.col("hnr").alias("nummer"), "lat", "lon", number_sort_key("hnr").alias("sortier"))


def distinct_numbers(raw: DataFrame) -> DataFrame:
    """Lookup of sort keys by distinct number."""
    return raw.select(F.col("hnr").alias("nummer")).distinct().withColumn("sortier", number_sort_key("nummer"))
