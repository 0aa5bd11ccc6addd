"""Streams: windowed metrics, drift of each batch against a fixed baseline, and an online control chart per key."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.quality import population_stability

#: Points of a chart that are returned at once.
CHARTED = 10_000
CHART = "key string, ts timestamp, value double, up double, down double, alarm boolean"


def read_events(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """A stream of the Parquet files of a folder, with the folder's own schema."""
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    return stream.withColumns({c: F.col(c).cast("timestamp") for c, kind in stream.dtypes if kind == "timestamp_ntz"})


def windowed(events: DataFrame, time: str, value: str, keys: Sequence[str], width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """start, keys, n and total of every window; rows later than the watermark are dropped (LateRows counts them)."""
    rows = events.withWatermark(time, late).groupBy(F.window(time, width), *keys)
    return rows.agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), *keys, "n", "total")


def drift_batches(stream: DataFrame, baseline: DataFrame, column: str, table: str, checkpoint: str):
    """Append the stability index of every batch against the baseline to a table."""

    def score(batch: DataFrame, number: int) -> None:
        population_stability(baseline, batch, column).withColumn("batch", F.lit(number)).write.mode("append").parquet(table)

    return stream.writeStream.foreachBatch(score).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class LateRows(StreamingQueryListener):
    """Rows that watermarks have dropped, by the name of their query (its id without one): add it to spark.streams and read `dropped`.

    Spark counts them where they meet the state; of an aggregation that are a batch's partial sums, one a key and task.
    """

    def __init__(self) -> None:
        self.dropped: Counter = Counter()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        self.dropped[progress.name or str(progress.id)] += sum(op.numRowsDroppedByWatermark for op in progress.stateOperators)

    def onQueryTerminated(self, event) -> None:
        pass


def online_chart(stream: DataFrame, key: str, time: str, value: str, warm_up: int = 20, k: float = 0.5, h: float = 4.0, late: str | None = None) -> DataFrame:
    """A two-sided CUSUM of each key, its baseline from the key's first values; the state is five numbers a key.

    Without `late` a batch is charted in its own order of time. With it, values wait in the state until the watermark, that far behind the
    latest time seen, has passed them, and are charted in the order of time whatever batches they came in; values later than
    that are dropped, and a timer charts what waits where a key has no new values. Values of one time go from the smallest up.
    A key's values of a batch are sorted as arrays and charted piece by piece.
    """
    width = 0 if late is None else 1

    def step(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, mean, m2, up, down, times, values = state.get if state.exists else (0, 0.0, 0.0, 0.0, 0.0, [], [])
        found = [(np.array(times, np.int64), np.array(values, np.float64))]
        if not state.hasTimedOut:
            found += [(batch["ts"].astype("datetime64[us]").astype("int64").to_numpy(), batch["value"].to_numpy(np.float64)) for batch in batches]
        ts, v = (np.concatenate(x) for x in zip(*found))  # 16 bytes a value
        del found
        order = np.lexsort((v, ts))
        ts, v = ts[order], v[order]
        del order
        ready = int(np.searchsorted(ts, state.getCurrentWatermarkMs() * 1000, side="right")) if width else len(ts)
        left = ts[ready:].tolist(), v[ready:].tolist()
        for start in range(0, ready, CHARTED):
            piece = slice(start, min(start + CHARTED, ready))
            out = []
            for x in v[piece].tolist():
                alarm = False
                if n < warm_up:
                    n += 1
                    gap = x - mean
                    mean += gap / n
                    m2 += gap * (x - mean)
                else:
                    sd = (m2 / n) ** 0.5
                    up, down = max(0.0, up + x - mean - k * sd), max(0.0, down - x + mean - k * sd)
                    alarm = up > h * sd or down > h * sd
                out.append((up, down, alarm))
                if alarm:
                    up = down = 0.0
            ups, downs, alarms = zip(*out)
            yield pd.DataFrame({"key": keys[0], "ts": ts[piece].astype("datetime64[us]"), "value": v[piece], "up": ups, "down": downs, "alarm": alarms})
        state.update((n, mean, m2, up, down, *left))
        if left[0]:
            state.setTimeoutTimestamp(max(left[0][0] // 1000, state.getCurrentWatermarkMs()) + 1)

    rows = stream.select(F.col(key).cast("string").alias("key"), F.col(time).cast("timestamp").alias("ts"), F.col(value).cast("double").alias("value")).filter("value IS NOT NULL")
    if late is not None:
        rows = rows.withWatermark("ts", late)
    timeout = GroupStateTimeout.NoTimeout if late is None else GroupStateTimeout.EventTimeTimeout
    return rows.groupBy("key").applyInPandasWithState(step, CHART, "n long, mean double, m2 double, up double, down double, times array<long>, waiting array<double>", "append", timeout)
