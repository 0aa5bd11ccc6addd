"""Readers, versions, guarded SQL and streams on small files."""

import pytest
from pyspark.sql import functions as F

from millrace.sources import files as S
from millrace.streaming import events as E


def test_delimited(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_bytes("Report 2024\nname;amount;amount\nMüller;1,5;2\nshort;1\nlong;1;2;3\n".encode("latin-1"))
    df, report = S.read_delimited(spark, str(path))
    assert df.columns == ["name", "amount", "amount_1"]
    assert [tuple(r) for r in df.orderBy("name").collect()] == [("Müller", "1,5", "2"), ("long", "1", "2"), ("short", "1", None)]
    r = report.first()
    assert (r.delimiter, r.banner_lines, r.rows, r.short_rows) == (";", 1, 3, 1) and r.encoding != "utf-8"
    (tmp_path / "b.csv").write_text('a,b\n"x,1\n')
    with pytest.raises(ValueError):
        S.read_delimited(spark, str(tmp_path / "b.csv"))


def test_json(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"meta": 1, "records": [{"id": 1, "who": {"name": "x", "at": {"city": "y"}}}, {"id": 2, "who": null}]}')
    rows = S.read_json(spark, str(tmp_path / "a.json"))
    assert sorted(rows.columns) == ["id", "who.at.city", "who.name"]
    assert sorted(r["id"] for r in rows.collect()) == [1, 2]


def test_versions(spark, tmp_path):
    root = str(tmp_path / "set")
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, s string")
    assert S.write_version(df, root) == 1 and S.write_version(df.filter("id = 1"), root, ["filter"]) == 2
    assert S.read_version(spark, root).count() == 1 and S.read_version(spark, root, 1).count() == 2
    lineage = {r["version"]: r for r in spark.read.json(root + "/lineage").collect()}
    assert lineage[1]["rows"] == 2 and lineage[2]["recipe"] == '["filter"]'
    df.write.parquet(f"{root}/v=3")  # a writer that was lost before its lineage row
    assert S.read_version(spark, root).count() == 1
    assert S.write_version(df, root) == 4 and S.read_version(spark, root).count() == 2


def test_guarded_sql(spark):
    views = {"numbers_of_test": spark.range(10)}
    out = S.run_sql(spark, "WITH a AS (SELECT id FROM numbers_of_test) SELECT sum(id) AS s FROM a", views)
    assert [tuple(r) for r in out.collect()] == [(45, False)]
    assert {r.is_truncated for r in S.run_sql(spark, "SELECT id FROM numbers_of_test", views, 3).collect()} == {True}
    for bad in ("DROP TABLE numbers_of_test", "SELECT * FROM parquet.`/x`", "SELECT 1; SELECT 2", "SELECT * FROM other"):
        with pytest.raises(PermissionError):
            S.run_sql(spark, bad, views)


def test_guard(spark):
    r = S.resource_guard(spark.createDataFrame([("x" * 20,)], "t string"), max_cell=10).first()
    assert (r.rows, r.longest_cell, r.within_limits) == (1, 20, False)


def run(query):
    query.awaitTermination(120)
    assert query.exception() is None


def test_inbox(spark, tmp_path):
    inbox, seen = tmp_path / "in", []
    inbox.mkdir()
    work = lambda df, n: seen.append(df.count())
    for name in ("a", "b"):
        (inbox / f"{name}.csv").write_text("x\n1\n2\n")
        run(S.watch_inbox(spark, str(inbox), "x int", work, str(tmp_path / "check")))
    assert seen == [2, 2]


@pytest.fixture()
def folder(spark, sf, tmp_path):
    path = str(tmp_path / "events")
    spark.read.parquet(f"{sf}/events.parquet").repartition(2).write.parquet(path)
    return path


def test_windows(spark, sf, folder, tmp_path):
    stream = E.windowed(E.read_events(spark, folder, 10), "ts", "value", ["event_type"])
    run(stream.writeStream.outputMode("complete").format("memory").queryName("windows_of_test").trigger(availableNow=True).start())
    batch = spark.read.parquet(f"{sf}/events.parquet").groupBy(F.date_trunc("hour", "ts").alias("start"), "event_type").agg(F.count("*").alias("n"))
    assert spark.table("windows_of_test").agg(F.sum("n")).first()[0] == batch.agg(F.sum("n")).first()[0]
    assert spark.table("windows_of_test").count() == batch.count()


def test_drift(spark, sf, folder, tmp_path):
    baseline = spark.read.parquet(f"{sf}/events.parquet")
    run(E.drift_batches(E.read_events(spark, folder), baseline, "event_type", str(tmp_path / "out"), str(tmp_path / "check")))
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert len(rows) == 2 and all(0 <= r.psi < 0.2 and not r.drifted for r in rows)


def test_online_chart(spark, tmp_path):
    values = [10.0, 11.0] * 10 + [10.5] * 5 + [20.0] * 3
    df = spark.createDataFrame([("k", float(i), v) for i, v in enumerate(values)], "k string, t double, v double").withColumn("t", F.timestamp_seconds("t"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = E.online_chart(E.read_events(spark, str(tmp_path / "in")), "k", "t", "v")
    run(stream.writeStream.outputMode("append").format("memory").queryName("chart_of_test").trigger(availableNow=True).start())
    alarms = [r.alarm for r in spark.table("chart_of_test").orderBy("ts").collect()]
    assert len(alarms) == len(values) and not any(alarms[:25]) and any(alarms[25:])
