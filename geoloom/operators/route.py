"""Routes: resampling, elevation profiles, checks of a trip log."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import between_points, flat_distance
from ..functions.text import kilometres

SMOOTH, POINTS, LEAST_SPAN = 2, 400, 10.0


def _by(key: str, order: str = "seq"):  # noqa: ANN202
    return Window.partitionBy(key).orderBy(order)


def cumulative(points: DataFrame, key: str = "id") -> DataFrame:
    """Points (seq, lon, lat) with ``step`` to and ``way`` up to each, in metres."""
    w = _by(key)
    step = flat_distance(F.lag("lon").over(w), F.lag("lat").over(w), "lon", "lat")
    return points.withColumn("step", F.coalesce(step, F.lit(0.0))).withColumn("way", F.sum("step").over(w.rowsBetween(Window.unboundedPreceding, 0)))


def resample(points: DataFrame, metres: float, key: str = "id") -> DataFrame:
    """Points every ``metres`` along each line, the first included: nr, lon, lat."""
    w = _by(key)
    c = cumulative(points, key)
    seg = c.select(
        key, "seq", F.lag("lon").over(w).alias("lon0"), F.lag("lat").over(w).alias("lat0"), "lon", "lat", (F.col("way") - F.col("step")).alias("w0"), F.col("way").alias("w1")
    )
    first = seg.where("lon0 is null").select(key, F.lit(0).cast("bigint").alias("nr"), "lon", "lat")
    lo, hi = F.floor(F.col("w0") / metres) + 1, F.floor(F.col("w1") / metres)
    more = seg.where((F.col("lon0").isNotNull()) & (hi >= lo)).withColumn("nr", F.explode(F.sequence(lo, hi)))
    t = (F.col("nr") * metres - F.col("w0")) / (F.col("w1") - F.col("w0"))
    return first.unionByName(more.select(key, "nr", between_points("lon0", "lon", t).alias("lon"), between_points("lat0", "lat", t).alias("lat")))


def finite(series: DataFrame, h: str = "h") -> DataFrame:
    return series.where(F.col(h).isNotNull() & ~F.isnan(h))


def has_heights(series: DataFrame, key: str = "id", least: int = 3) -> DataFrame:
    """Keys with at least ``least`` finite values that are not all zero (zeros mean no data)."""
    return finite(series).groupBy(key).agg(F.count("*").alias("n"), F.max(F.abs("h")).alias("m")).where((F.col("n") >= least) & (F.col("m") > 0)).select(key)


def smoothed(series: DataFrame, k: int = SMOOTH, key: str = "id") -> DataFrame:
    """Moving mean over k values on each side."""
    return series.withColumn("g", F.avg("h").over(_by(key).rowsBetween(-k, k)))


def ascents(series: DataFrame, k: int = SMOOTH, key: str = "id") -> DataFrame:
    """Metres up and down of the smoothed series over all points: auf, ab."""
    s = smoothed(finite(series.join(has_heights(series, key), key, "left_semi")), k, key)
    d = s.withColumn("d", F.col("g") - F.lag("g").over(_by(key)))
    return d.groupBy(key).agg(F.sum(F.greatest("d", F.lit(0.0))).alias("auf"), F.sum(F.greatest(-F.col("d"), F.lit(0.0))).alias("ab"))


def thinned(series: DataFrame, most: int = POINTS, key: str = "id") -> DataFrame:
    """At most ``most`` points of a series, evenly."""
    sizes = series.groupBy(key).agg(F.count("*").alias("__n"))
    s = series.withColumn("__i", F.row_number().over(_by(key)) - 1).join(sizes, key)
    return s.where(F.col("__i") % F.ceil(F.col("__n") / most) == 0).drop("__i", "__n")


def scaled(series: DataFrame, height: float = 40.0, key: str = "id") -> DataFrame:
    """Picture heights; a series that spans less than 10 m is not stretched to the full picture."""
    r = series.groupBy(key).agg(F.min("h").alias("lo"), F.max("h").alias("hi"))
    y = height * (1 - (F.col("h") - F.col("lo")) / F.greatest(F.col("hi") - F.col("lo"), F.lit(LEAST_SPAN)))
    return series.join(r, key).withColumn("y", y).drop("lo", "hi")


def rises(log: DataFrame, key: str = "id", least: float = 0.05) -> DataFrame:
    """Where the remaining distance (text ``rest``) rises: count and largest rise in km."""
    km = log.withColumn("km", kilometres("rest")).where("km is not null")
    d = km.withColumn("d", F.col("km") - F.lag("km").over(_by(key)))
    return d.groupBy(key).agg(F.count_if(F.col("d") > least).alias("anstiege"), F.coalesce(F.max(F.when(F.col("d") > least, F.col("d"))), F.lit(0.0)).alias("groesster"))


def changes(log: DataFrame, column: str, key: str = "id") -> DataFrame:
    """How often a value differs from the one before."""
    prev = F.lag(column).over(_by(key))
    first = F.row_number().over(_by(key)) == 1
    return log.withColumn("c", ~first & ~F.col(column).eqNullSafe(prev)).groupBy(key).agg(F.count_if("c").alias("wechsel"))


def until_stable(frames: DataFrame, key: str = "id") -> DataFrame:
    """First frame whose hash equals the one before."""
    same = F.col("hash") == F.lag("hash").over(_by(key))
    return frames.withColumn("same", same).where("same").groupBy(key).agg(F.min("seq").alias("stabil"))


def trip_counters(log: DataFrame, key: str = "id") -> DataFrame:
    """Recalculations, readings off the route or out of the mode, headings, tilt (upper median)."""
    return log.groupBy(key).agg(
        F.count("*").alias("messungen"),
        F.count_if(F.col("anweisung").rlike("(?i)neu berechnet|abseits")).alias("neuberechnungen"),
        F.count_if(F.col("zustand").rlike("(?i)abseits")).alias("abseits"),
        F.count_if(~F.col("navimodus")).alias("ohne_modus"),
        F.count_distinct(F.floor(F.coalesce("drehung", F.lit(0.0)) / 10 + 0.5)).alias("richtungen"),
        F.count_if(F.col("neigung") < 40).alias("flach"),
        F.expr("percentile_disc(0.5) within group (order by neigung desc)").alias("neigung_median"),
    )


def never_shown(maneuvers: DataFrame, log: DataFrame, key: str = "id") -> DataFrame:
    """Maneuvers (seq from 0, text) that no reading displays; the first is exempt."""
    shown = log.select(key, F.col("anweisung").alias("text")).distinct()
    return maneuvers.where("seq > 0 and text <> ''").join(shown, [key, "text"], "left_anti")


def largest_gap(a: DataFrame, b: DataFrame, key: str = "id") -> DataFrame:
    """Largest distance of two lines' points of the same number."""
    o = b.select(key, "seq", F.col("lon").alias("lon2"), F.col("lat").alias("lat2"))
    return a.join(o, [key, "seq"]).groupBy(key).agg(F.max(flat_distance("lon", "lat", "lon2", "lat2")).alias("abweichung"))
