"""Kinds of features: counts, ranges, and a style's kinds without data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def kind_summary(features: DataFrame) -> DataFrame:
    """Per kind: count, numeric min_zoom range, first name by ordinal, and how many lack a detail."""
    zoom = F.col("min_zoom").try_cast("double")
    return features.groupBy("kind").agg(
        F.count("*").alias("n"), F.min(zoom).alias("zoom_from"), F.max(zoom).alias("zoom_to"),
        F.min_by("name", F.when(F.col("name").isNotNull() & (F.col("name") != ""), F.col("ordinal"))).alias("example"),
        F.count_if(F.col("kind_detail").isNull()).alias("no_detail"), F.min("ordinal").alias("first_seen"),
    )


def most_common(counts: DataFrame, n: int) -> DataFrame:
    return counts.orderBy(F.desc("n"), "first_seen").limit(n)


def kind_details(features: DataFrame) -> DataFrame:
    """Counts by kind and detail where there is one."""
    return features.where("kind_detail is not null").groupBy("kind", "kind_detail").agg(F.count("*").alias("n"), F.min("ordinal").alias("first_seen"))


def kinds_of_layers(*layers: DataFrame) -> DataFrame:
    """Distinct kinds over several frames."""
    out = layers[0].select("kind")
    for x in layers[1:]:
        out = out.unionByName(x.select("kind"))
    return out.distinct()


def phantom_kinds(wanted: DataFrame, features: DataFrame) -> DataFrame:
    """Kinds a style filters for that no feature has, per layer."""
    return wanted.join(features.select("kind").where("kind is not null").distinct(), "kind", "left_anti").groupBy("layer").agg(
        F.array_sort(F.collect_set("kind")).alias("kinds")
    )


def missing_symbols(wanted: DataFrame, sheet: DataFrame) -> DataFrame:
    return wanted.join(sheet.select("symbol"), "symbol", "left_anti")


def distinct_messages(log: DataFrame, n: int = 6) -> DataFrame:
    """The first n different messages; aborted loads do not count, statuses from 400 do."""
    bad = (F.col("status") >= 400) | (F.col("error").isNotNull() & (F.col("error") != "ERR_ABORTED"))
    rows = log.where(bad).groupBy("message").agg(F.min("ordinal").alias("first_seen"))
    return rows.orderBy("first_seen").limit(n)
