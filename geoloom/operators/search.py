"""Guided search over the address index.

Forms are compared as plain strings: wildcard signs in a query are ordinary
characters, and a query without any form finds nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import search_forms

CAP = 25
#: Streets: the second round runs if the first found fewer, for queries this long.
ENOUGH, LONG_QUERY = 5, 4


def forms_of(spark, query: str) -> list[str]:  # noqa: ANN001
    """The distinct non-empty search forms of a query text of two characters or more."""
    if len(query.strip()) < 2:
        return []
    row = spark.range(1).select(search_forms(F.lit(query.strip())).alias("f")).first()
    return [f for f in row.f if f]


def _top(rows: DataFrame, match, forms: list[str]) -> DataFrame:  # noqa: ANN001
    """The CAP best rows: most addresses first, then id."""
    hit = reduce(lambda a, b: a | b, (match(F.col(c), f) for f in forms for c in ("such1", "such2")))
    return rows.where(hit).orderBy(F.desc("anzahl"), "id").limit(CAP)


def two_rounds(rows: DataFrame, forms: list[str], second: bool | None = None) -> DataFrame:
    """Prefix matches, then matches anywhere that are not among them; CAP in all.

    Each round is cut to CAP before rows already seen are taken out, so the
    result may be shorter than CAP.  ``second`` None: the second round is left
    out if the first is full.
    """
    if not forms:
        return rows.limit(0).withColumn("runde", F.lit(1))
    first = _top(rows, lambda c, f: c.startswith(f), forms).withColumn("runde", F.lit(1))
    if second is False:
        return first
    more = _top(rows, lambda c, f: c.contains(f), forms).withColumn("runde", F.lit(2))
    w = Window.partitionBy("id").orderBy("runde")  # at most 2 * CAP rows
    both = first.unionByName(more).withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")
    return both.orderBy("runde", F.desc("anzahl"), "id").limit(CAP)


def search_places(places: DataFrame, query: str) -> DataFrame:
    """Places for a query: id, name, lat, lon, anzahl, plz ('' if unknown), runde."""
    found = two_rounds(places, forms_of(places.sparkSession, query))
    return found.select("id", "name", "lat", "lon", "anzahl", F.coalesce("plz", F.lit("")).alias("plz"), "runde")


def search_streets(streets: DataFrame, places: DataFrame, query: str, place_id: int | None = None) -> DataFrame:
    """Streets for a query, in one place if given, with the place's name."""
    forms = forms_of(streets.sparkSession, query)
    rows = streets.where(F.col("ort_id") == place_id) if place_id else streets
    second = False
    if forms and len(query.strip()) >= LONG_QUERY:  # a plan cannot stop on a count, so it is asked for first
        second = two_rounds(rows, forms, second=False).count() < ENOUGH
    found = two_rounds(rows, forms, second=second)
    p = places.select(F.col("id").alias("ort_id"), F.col("name").alias("ort"))
    return found.join(p, "ort_id").select("id", "name", "ort", "lat", "lon", "anzahl", "runde")


def search_numbers(numbers: DataFrame, street_id: int, query: str = "") -> DataFrame:
    """House numbers of a street: the exact ones, then those that begin so; by sort key."""
    q = query.strip().lower()
    n = F.lower("nummer")
    rows = numbers.where(F.col("strasse_id") == street_id)
    rank = F.when(n == q, 0).when(n.startswith(q), 1)
    return rows.withColumn("rang", rank).where("rang is not null").orderBy("rang", "sortier", "nummer").limit(CAP).select("nummer", "lat", "lon", "rang")


def answer_places(places: DataFrame, query: str) -> DataFrame:
    """The service's place answer as JSON lines."""
    return search_places(places, query).select(F.to_json(F.struct("id", "name", "lat", "lon", "anzahl", "plz")).alias("json"))


class AddressService:
    """The lookup service's requests as functions over cached index tables."""

    def __init__(self, places: DataFrame, streets: DataFrame, numbers: DataFrame):
        self.places, self.streets, self.numbers = places.cache(), streets.cache(), numbers.cache()

    def request(self, path: str, args: dict[str, str]) -> tuple[int, list[dict] | dict]:
        """Status and body: 404 for an unknown path, 400 for arguments that make no sense."""
        try:
            if path == "/health":
                return 200, {"orte": self.places.count()}
            if path == "/orte":
                found = search_places(self.places, args.get("q", "")).drop("runde")
            elif path == "/strassen":
                found = search_streets(self.streets, self.places, args.get("q", ""), int(args.get("ort") or 0) or None).drop("runde")
            elif path == "/nummern":
                found = search_numbers(self.numbers, int(args["strasse"]), args.get("q", "")).drop("rang")
            else:
                return 404, {}
        except (KeyError, ValueError):
            return 400, {}
        return 200, [r.asDict() for r in found.collect()]  # at most CAP rows
