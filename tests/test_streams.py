"""Streams cut into any batches against one pass in the order of time."""

import datetime as dt
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.streaming import events as E


def chart_of(rows, warm_up=20):
    """(key, ts, up, down, alarm) of one key's (ts, value) in order."""
    first = np.array([v for _, v in rows[:warm_up]])
    mean, sd, up, down, out = first.mean(), first.std(), 0.0, 0.0, []
    for i, (ts, v) in enumerate(rows):
        alarm = False
        if i >= warm_up:
            up, down = max(0.0, up + v - mean - 0.5 * sd), max(0.0, down - v + mean - 0.5 * sd)
            alarm = up > 4 * sd or down > 4 * sd
        out.append((ts, round(up, 6), round(down, 6), alarm))
        if alarm:
            up = down = 0.0
    return out


@pytest.mark.parametrize("files", [1, 6])
def test_chart_is_the_same_for_any_batches(spark, tmp_path, files):
    rng = np.random.default_rng(2)
    start = dt.datetime(2024, 1, 1)
    rows = [(k, start + dt.timedelta(seconds=60 * i + j), float(rng.normal() + (2 if i > 200 else 0))) for i in range(300) for j, k in enumerate("ab")]
    rows += [("quiet", start + dt.timedelta(seconds=30), 1.0)]
    # every value up to half an hour late, so that batches overlap in time
    arrival = sorted(rows, key=lambda r: r[1] + dt.timedelta(seconds=float(rng.random() * 1800)))
    for i, part in enumerate(np.array_split(np.arange(len(arrival)), files)):
        df = spark.createDataFrame([arrival[j] for j in part], "k string, at timestamp, v double").coalesce(1)
        df.write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1 if files > 1 else 0)  # files are read in the order of their times
    stream = E.read_events(spark, str(tmp_path / "in"), 1)
    chart = E.online_chart(stream, "k", "at", "v", late="2 hours")
    chart.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "seen")).trigger(availableNow=True).start().awaitTermination()
    got = {}
    for r in spark.read.parquet(str(tmp_path / "out")).withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).orderBy("ts").collect():
        got.setdefault(r.key, []).append((r.ts, round(r.up, 6), round(r.down, 6), r.alarm))
    last = max(r[1] for r in rows) - dt.timedelta(hours=2)
    for key in ("a", "b", "quiet"):
        want = [(str(t), u, d, a) for t, u, d, a in chart_of([(t, v) for k, t, v in rows if k == key]) if t <= last]
        assert got[key] == want


def test_late_rows_are_counted(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    for hours in (0, 10, 10, 0):  # the last file comes ten hours late, a batch after the watermark has moved
        df = spark.createDataFrame([("a", start + dt.timedelta(hours=hours, minutes=i), 1.0) for i in range(5)], "k string, at timestamp, v double")
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)
    listener = E.LateRows()
    spark.streams.addListener(listener)
    try:
        out = E.windowed(E.read_events(spark, str(tmp_path / "in"), 1), "at", "v", ["k"])
        out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "seen")).queryName("late").trigger(availableNow=True).start().awaitTermination()
        for _ in range(50):
            if listener.dropped["late"]:
                break
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(listener)
    assert listener.dropped["late"] == 1  # one window of one key
    assert spark.read.parquet(str(tmp_path / "out")).agg(F.sum("n")).first()[0] == 5


def test_a_chart_of_many_values_is_returned_in_pieces(spark, tmp_path):
    """Over two pieces of one key, against one pass in plain Python; ties of time go by value."""
    n = 2 * E.CHARTED + 123
    rows = spark.range(n).select(F.lit("a").alias("k"), F.timestamp_seconds(F.lit(1_700_000_000) + F.pmod(F.xxhash64("id"), F.lit(5000))).alias("t"), (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1000)) / 10).alias("v"))
    rows.write.parquet(f"{tmp_path}/in")
    chart = E.online_chart(E.read_events(spark, f"{tmp_path}/in", 100), "k", "t", "v")
    chart.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/seen").trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out").agg(F.count("*"), F.count_if("alarm"), F.max("up"), F.max("down")).first()
    values = [r["v"] for r in rows.orderBy("t", "v").collect()]
    mean, sd = sum(values[:20]) / 20, (sum(v * v for v in values[:20]) / 20 - (sum(values[:20]) / 20) ** 2) ** 0.5
    up = down = alarms = highest = lowest = 0
    for v in values[20:]:
        up, down = max(0.0, up + v - mean - 0.5 * sd), max(0.0, down - v + mean - 0.5 * sd)
        highest, lowest, alarm = max(highest, up), max(lowest, down), max(up, down) > 4 * sd
        if alarm:
            up, down, alarms = 0.0, 0.0, alarms + 1
    assert (got[0], got[1]) == (n, alarms) and tuple(got)[2:] == pytest.approx((highest, lowest), rel=1e-6)
