"""Gazetteer of populated places from headerless tab-separated files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import gazetteer_key

BOX = (-11.0, 34.0, 40.0, 72.0)  # west, south, east, north, edges included


def place_lines(lines: DataFrame, only: str | None = None) -> DataFrame:
    """Parsed place lines; ``lines`` has ``value`` and ``ordinal`` (file order).

    Lines with fewer than 15 fields, another feature class than P, an
    unparseable number (the id too) or a place outside the box are left out.
    """
    c = F.split("value", "\t")
    f = lambda i: F.get(c, F.lit(i))
    pop = F.when(f(14) == "", F.lit(0).cast("bigint")).otherwise(f(14).try_cast("bigint"))
    rows = lines.where((F.size(c) >= 15) & (f(6) == "P")).select(
        "ordinal", f(0).try_cast("bigint").alias("gid"), f(1).alias("name"), f(2).alias("ascii"), f(4).try_cast("double").alias("lat"), f(5).try_cast("double").alias("lon"),
        f(8).alias("country"), f(10).alias("adm1"), pop.alias("pop"),
    )
    rows = rows.where("gid is not null and lat is not null and lon is not null and pop is not null")
    rows = rows.where(F.col("lat").between(BOX[1], BOX[3]) & F.col("lon").between(BOX[0], BOX[2]))
    return rows.where(F.col("country") == only) if only else rows


def best_by_population(rows: DataFrame, key: str = "gid") -> DataFrame:
    """Per key the row of largest population, the first of equals; ``first_seen``
    is the ordinal of the key's first row."""
    cols = [c for c in rows.columns if c != key]
    best = F.max_by(F.struct(*cols), F.struct(F.col("pop"), -F.col("ordinal")))
    return rows.groupBy(key).agg(best.alias("b"), F.min("ordinal").alias("first_seen")).select(key, "b.*", "first_seen")


def name_lines(lines: DataFrame, language: str = "de") -> DataFrame:
    """Alternate names of a language that are not historic; lines with fewer than
    five fields or an id that is no number are left out."""
    c = F.split("value", "\t")
    f = lambda i: F.get(c, F.lit(i))
    historic = (F.size(c) > 7) & (f(7) == "1")
    gid = f(1).try_cast("bigint")
    return lines.where((F.size(c) > 4) & (f(2) == language) & ~historic & gid.isNotNull()).select(
        "ordinal", gid.alias("gid"), f(3).alias("name"), (f(4) == "1").alias("preferred")
    )


def preferred_name(names: DataFrame, key: str = "gid") -> DataFrame:
    """Per key the first preferred name, else the first."""
    order = F.struct((~F.col("preferred")).cast("int"), F.col("ordinal"))
    return names.groupBy(key).agg(F.min_by("name", order).alias("name"))


def known_names(names: DataFrame, known: DataFrame, key: str = "gid") -> DataFrame:
    return names.join(known.select(key).distinct(), key, "left_semi")


def aliases(names: list, display) -> F.Column:  # noqa: ANN001
    """Sorted distinct names without the empty one and the display name."""
    return F.array_sort(F.array_except(F.array_compact(F.array_distinct(F.array(*names))), F.array(F.lit(""), display)))


def dedup_nearby(rows: DataFrame, name: str = "name", order: str = "first_seen") -> DataFrame:
    """Per name key and tenth of a degree the row of most people, first of equals;
    ``first_seen`` becomes that of the key."""
    k = [gazetteer_key(name).alias("__k"), F.round("lat", 1).alias("__la"), F.round("lon", 1).alias("__lo")]
    cols = [c for c in rows.columns if c != "first_seen"]
    keyed = rows.select(*k, F.struct(*cols).alias("r"), F.col("pop").alias("__p"), F.col(order).alias("__o"))
    best = F.max_by("r", F.struct(F.col("__p"), -F.col("__o")))
    return keyed.groupBy("__k", "__la", "__lo").agg(best.alias("b"), F.min("__o").alias("first_seen")).select("b.*", "first_seen")


def gazetteer(world: DataFrame, country: DataFrame, names: DataFrame, only: str = "DE") -> DataFrame:
    """The whole gazetteer: display, lat, lon, pop, country, adm1, aliases, first_seen.

    The country's file is read first: of equal populations its row wins, and the
    world's lines count on from its last one.
    """
    last = country.agg(F.coalesce(F.max("ordinal"), F.lit(0)).alias("m"))
    second = place_lines(world).crossJoin(F.broadcast(last)).withColumn("ordinal", F.col("ordinal") + F.col("m") + 1).drop("m")  # one row
    best = best_by_population(place_lines(country, only).unionByName(second))
    local = preferred_name(known_names(name_lines(names), best)).withColumnRenamed("name", "local")
    rows = best.join(local, "gid", "left").withColumn("display", F.coalesce("local", "name"))
    rows = rows.withColumn("aliases", aliases([F.col("name"), F.col("ascii"), F.col("local")], F.col("display")))
    rows = rows.select("display", F.round("lat", 5).alias("lat"), F.round("lon", 5).alias("lon"), "pop", "country", "adm1", "aliases", "first_seen")
    return dedup_nearby(rows, "display").orderBy(F.desc("pop"), "first_seen")


def lookup(rows: DataFrame, query: str, name: str = "display") -> DataFrame:
    """First place of a name in order of population."""
    q = gazetteer_key(F.lit(query))
    return rows.where(gazetteer_key(name) == q).orderBy(F.desc("pop"), "first_seen").limit(1)


def as_positional_json(rows: DataFrame) -> DataFrame:
    """Rows as compact arrays of unlike values, as the sink writes them."""
    j = lambda c: F.get_json_object(F.to_json(F.struct(F.col(c).alias("v"))), "$.v")
    text = lambda c: F.regexp_extract(F.to_json(F.struct(F.col(c).alias("v"))), "^\\{\"v\":(.*)\\}$", 1)
    parts = [text("display"), j("lat"), j("lon"), j("pop"), text("country"), text("adm1"), text("aliases")]
    return rows.select(F.concat(F.lit("["), F.concat_ws(",", *parts), F.lit("]")).alias("value"))


def upsert(old: DataFrame, new: DataFrame, key: list[str], keep_old: bool = False) -> DataFrame:
    """Rows of both by key; the new row wins, or the old one if ``keep_old``.

    Within one input the last (or, with ``keep_old``, the first) by ``ordinal`` wins.
    """
    both = old.withColumn("__s", F.lit(0)).unionByName(new.withColumn("__s", F.lit(1)))
    order = [F.col("__s"), F.col("ordinal")]
    w = Window.partitionBy(*key).orderBy(*(order if keep_old else [c.desc() for c in order]))
    return both.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r", "__s")
