"""Position streams: trip checks and resumable tile work as structured streaming."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: A trip without a reading for so long is over.
IDLE_MS = 3_600_000
READING = "id bigint, ts timestamp, km double, anweisung string"


def read_readings(spark: SparkSession, folder: str, files: int = 100) -> DataFrame:
    return spark.readStream.schema(READING).option("maxFilesPerTrigger", files).json(folder)


def _rises(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        state.remove()
        return
    last, rises, most, n = state.get if state.exists else (float("nan"), 0, 0.0, 0)
    rows = pd.concat(list(batches)).sort_values("ts")
    for km in rows["km"].dropna():
        if last == last and km - last > 0.05:
            rises, most = rises + 1, max(most, km - last)
        last, n = km, n + 1
    state.update((float(last), int(rises), float(most), int(n)))
    newest = rows["ts"].max()
    seen = int(newest.timestamp() * 1000) if pd.notna(newest) else state.getCurrentWatermarkMs()
    state.setTimeoutTimestamp(max(seen + IDLE_MS, state.getCurrentWatermarkMs() + 1))
    yield pd.DataFrame({"id": [key[0]], "anstiege": [rises], "groesster": [most], "messungen": [n]})


def rises(readings: DataFrame, late: str = "5 minutes") -> DataFrame:
    """Running count of rises of the remaining distance per trip.

    State per trip is four numbers, given up when the watermark (``late`` behind
    the newest reading) is an hour past the trip's newest reading; a trip that
    goes on after that counts anew.  Readings are ordered within a micro-batch;
    one that arrives in a later batch counts after those already seen.
    """
    out = "id bigint, anstiege bigint, groesster double, messungen bigint"
    state = "last double, rises bigint, most double, n bigint"
    return readings.withWatermark("ts", late).groupBy("id").applyInPandasWithState(_rises, out, state, "update", GroupStateTimeout.EventTimeTimeout)


def per_window(readings: DataFrame, width: str = "1 minute", late: str = "5 minutes") -> DataFrame:
    """Readings and nearest remaining distance per trip and window, late ones dropped after ``late``."""
    return readings.withWatermark("ts", late).groupBy("id", F.window("ts", width)).agg(F.count("*").alias("n"), F.min("km").alias("km"))


def drain(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process what is there and stop; a second call takes up only what is new."""
    q = df.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).outputMode(mode).format("parquet").start(path)
    q.awaitTermination()
