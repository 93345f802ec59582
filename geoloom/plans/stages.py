"""Resumable stages: each writes its table once, verified, and is skipped after."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass
class Stage:
    name: str
    make: Callable[[SparkSession, Callable[[str], DataFrame]], DataFrame]
    #: Names of stages whose tables it reads; it is left out if one of them failed.
    needs: tuple[str, ...] = ()
    #: Fewest rows of a good result.
    least: int = 0


class Runner:
    """Runs stages in order under one folder.

    A result goes to a staging folder, its rows are counted there, and only then
    is it renamed to its place; the ledger is the presence of the place.  Stages
    overwrite nothing and append nothing, so a broken run is simply run again.
    A stage that fails stops those that need it, not the others.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def done(self, name: str) -> bool:
        return self._fs.exists(self._path(f"{self.folder}/{name}/_SUCCESS"))

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}")

    def run(self, stages: list[Stage]) -> dict[str, str]:
        """State per stage: done, skipped, failed: reason, or blocked."""
        state: dict[str, str] = {}
        for s in stages:
            if self.done(s.name):
                state[s.name] = "skipped"
            elif any(not self.done(n) for n in s.needs):
                state[s.name] = "blocked"
            else:
                try:
                    self._make(s)
                    state[s.name] = "done"
                except Exception as e:  # noqa: BLE001  the other stages go on
                    state[s.name] = f"failed: {type(e).__name__}: {str(e)[:200]}"
        return state

    def _make(self, s: Stage) -> None:
        part = f"{self.folder}/_part-{s.name}"
        s.make(self.spark, self.table).write.mode("overwrite").parquet(part)
        rows = self.spark.read.parquet(part).count()
        if rows < s.least:
            raise ValueError(f"{rows} rows, at least {s.least} expected")
        place = self._path(f"{self.folder}/{s.name}")
        self._fs.delete(place, True)
        if not self._fs.rename(self._path(part), place):
            raise OSError(f"cannot rename {part}")
