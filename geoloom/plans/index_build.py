"""The address index as resumable stages over node and way tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import address
from .stages import Runner, Stage


def stages(nodes: DataFrame, ways: DataFrame) -> list[Stage]:
    """raw, places, streets, numbers; each reads the tables of those before."""

    def raw(spark: SparkSession, table) -> DataFrame:  # noqa: ANN001
        return address.raw_addresses(nodes, ways)

    def places(spark: SparkSession, table) -> DataFrame:  # noqa: ANN001
        return address.place_index(table("raw"))

    def streets(spark: SparkSession, table) -> DataFrame:  # noqa: ANN001
        return address.street_index(table("raw"), table("places"))

    def numbers(spark: SparkSession, table) -> DataFrame:  # noqa: ANN001
        # sorted by street, so row groups prune a lookup by street
        n = address.number_index(table("raw"), table("places"), table("streets"))
        return n.repartitionByRange("strasse_id").sortWithinPartitions("strasse_id", "sortier", "nummer")

    return [
        Stage("raw", raw, least=1),
        Stage("places", places, needs=("raw",), least=1),
        Stage("streets", streets, needs=("places",), least=1),
        Stage("numbers", numbers, needs=("streets",), least=1),
    ]


def build(spark: SparkSession, nodes: DataFrame, ways: DataFrame, folder: str) -> dict[str, str]:
    """Build or resume the index in ``folder``; returns the state of each stage."""
    return Runner(spark, folder).run(stages(nodes, ways))
