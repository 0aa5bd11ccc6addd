"""Queries of readers, versions and streams: given tables are written to a folder of the warehouse and read back."""

import uuid

from pyspark.sql import functions as F

from ..functions.scalars import canonical, month_of
from ..operators import rows as R
from ..sources import files as S
from ..streaming import events as E
from . import ORACLE, query
from .monitoring import halves


def scratch(t) -> str:
    """A new folder under the warehouse, which all executors share."""
    return f"{t.spark.conf.get('spark.sql.warehouse.dir')}/millrace-{uuid.uuid4().hex}"


BY_SEGMENT = "SELECT c_mktsegment, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer GROUP BY c_mktsegment"


def by_segment(df):
    return df.groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.round(F.sum(F.col("c_acctbal").cast("double")), 2).alias("balance"))


@query("i02_read_csv", BY_SEGMENT)
def _(t):
    path = scratch(t)
    t("customer").write.option("header", True).csv(path)
    return by_segment(S.read_csv_strict(t.spark, path, ", ".join(f"{c} {kind}" for c, kind in t("customer").dtypes)))


@query("i03_read_delimited", BY_SEGMENT)
def _(t):
    path = scratch(t)
    t("customer").write.option("header", True).option("sep", ";").csv(path)
    return by_segment(S.read_delimited(t.spark, path)[0])


@query("i03_quoted_records", "SELECT o_orderstatus, count(*) AS n, CAST(sum(length(o_orderpriority) * 2 + 13) AS BIGINT) AS chars, count(*) FILTER (o_orderkey % 3 = 0) AS marked FROM orders GROUP BY o_orderstatus")
def _(t):
    """Every cell of text holds a line break, a delimiter and quotes, and every file a banner and a letter that is no UTF-8."""
    path, priority = scratch(t), F.col("o_orderpriority")
    cell = F.concat(F.lit('"'), priority, F.lit(',\n""é""\n\n;'), priority, F.lit(' |end"'))
    line = F.concat_ws(",", F.col("o_orderkey").cast("string"), "o_orderstatus", cell, F.when(F.col("o_orderkey") % 3 == 0, "x").otherwise("y"))
    lines = t("orders").select(F.encode(line, "ISO-8859-1").cast("string").alias("value"), F.spark_partition_id().alias("p"), F.lit(1).alias("k"))
    head = lines.select("p").distinct().select(F.lit("Report\no_orderkey,o_orderstatus,text,mark").alias("value"), "p", F.lit(0).alias("k"))
    head.union(lines).repartition("p").sortWithinPartitions("p", "k").select("value").write.text(path)
    rows = S.read_delimited(t.spark, path)[0]
    return rows.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.sum(F.length("text").cast("long")).alias("chars"), F.count_if(F.col("mark") == "x").alias("marked"))


@query("i04_read_json", BY_SEGMENT)
def _(t):
    path = scratch(t)
    t("customer").select("c_custkey", F.struct("c_mktsegment", F.struct("c_acctbal").alias("money")).alias("facts")).write.json(path)
    rows = S.read_json(t.spark, path, lines=True)
    return by_segment(rows.select(F.col("`facts.c_mktsegment`").alias("c_mktsegment"), F.col("`facts.money.c_acctbal`").alias("c_acctbal")))


@query("i08_i09_versions", "SELECT 1 AS version, count(*) AS n, round(sum(p_retailprice), 2) AS v FROM part UNION ALL SELECT 2, count(*) FILTER (p_size > 25), round(sum(p_retailprice) FILTER (p_size > 25), 2) FROM part")
def _(t):
    root, part = scratch(t), t("part")
    S.write_version(part, root)
    S.write_version(part.filter("p_size > 25"), root, ["p_size > 25"])
    facts = lambda v: S.read_version(t.spark, root, v).agg(F.count("*").alias("n"), F.round(F.sum("p_retailprice"), 2).alias("v"))
    return facts(1).select(F.lit(1).alias("version"), "n", "v").union(facts(None).select(F.lit(2), "n", "v"))


@query("i10_preview", "SELECT n_nationkey, n_name FROM nation ORDER BY n_nationkey LIMIT 5")
def _(t):
    return S.preview(t("nation").select("n_nationkey", "n_name").orderBy("n_nationkey"), 5)


@query("i11_watch_inbox", "SELECT count(*) AS n, CAST(sum(o_custkey) AS BIGINT) AS v FROM orders")
def _(t):
    inbox, seen = scratch(t), scratch(t)
    t("orders").select("o_orderkey", "o_custkey").write.option("header", True).csv(inbox)
    work = lambda df, number: df.agg(F.count("*").alias("n"), F.sum("o_custkey").alias("v")).write.mode("append").parquet(seen)
    for _ in range(2):  # the second time there is nothing new
        S.watch_inbox(t.spark, inbox, "o_orderkey long, o_custkey long", work, f"{inbox}-seen").awaitTermination()
    return t.spark.read.parquet(seen).agg(F.sum("n").alias("n"), F.sum("v").alias("v"))


def stored(df, t):
    path = scratch(t)
    df.write.parquet(path)
    return path


@query("g02_windowed", "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def _(t):
    name = f"windows_{uuid.uuid4().hex}"
    stream = E.windowed(E.read_events(t.spark, stored(t("events"), t), 10), "ts", "value", ["event_type"])
    stream.writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start().awaitTermination()
    return t.spark.table(name).select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("g03_drift_batches", f"SELECT psi, drifted, 0 AS batch FROM ({ORACLE['n05_stability']})")
def _(t):
    before, after = halves(t)
    path, table = stored(after.coalesce(1), t), scratch(t)
    E.drift_batches(E.read_events(t.spark, path, 10), before, "event_type", table, f"{table}-seen").awaitTermination()
    return t.spark.read.parquet(table).withColumn("batch", F.col("batch").cast("int"))


@query("g04_online_chart", """
    WITH RECURSIVE s AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL),
    b AS (SELECT event_type, avg(value) AS m, stddev_pop(value) AS sd FROM s WHERE i <= 20 GROUP BY event_type),
    c(event_type, i, up, down, alarm) AS (SELECT event_type, CAST(20 AS BIGINT), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), false FROM b UNION ALL
      SELECT event_type, i, greatest(0, u + value - m - 0.5 * sd), greatest(0, d - value + m - 0.5 * sd), greatest(u + value - m - 0.5 * sd, d - value + m - 0.5 * sd) > 4 * sd
      FROM (SELECT c.event_type, s.i, value, m, sd, CASE WHEN alarm THEN 0 ELSE up END AS u, CASE WHEN alarm THEN 0 ELSE down END AS d FROM c JOIN s ON s.event_type = c.event_type AND s.i = c.i + 1 JOIN b ON b.event_type = c.event_type))
    SELECT event_type AS key, max(n) AS points, count(*) FILTER (alarm) AS alarms, round(max(up), 4) AS highest, round(max(down), 4) AS lowest FROM c JOIN (SELECT DISTINCT event_type, n FROM s) USING (event_type) GROUP BY event_type""")  # fmt: skip
def _(t):
    chart, charts = E.online_chart(E.read_events(t.spark, stored(t("events"), t), 10), "event_type", "ts", "value"), scratch(t)
    chart.writeStream.outputMode("append").format("parquet").option("path", charts).option("checkpointLocation", f"{charts}-seen").trigger(availableNow=True).start().awaitTermination()
    found = t.spark.read.parquet(charts).groupBy("key")
    return found.agg(F.count("*").alias("points"), F.count_if("alarm").alias("alarms"), F.round(F.max("up"), 4).alias("highest"), F.round(F.max("down"), 4).alias("lowest"))


@query("u03_concat", "SELECT event_type, count(*) AS n FROM events WHERE event_id % 2 = 0 OR value > 20 GROUP BY event_type")
def _(t):
    a, b = halves(t)
    return a.unionByName(b).groupBy("event_type").agg(F.count("*").alias("n"))


@query("u05_schema_changes", "SELECT 'added' AS change, 'o_half' AS \"column\" UNION ALL SELECT 'removed', 'o_orderstatus' UNION ALL SELECT 'retyped', 'o_custkey'")
def _(t):
    o = t("orders")
    found = R.schema_changes(o, o.drop("o_orderstatus").withColumn("o_half", F.col("o_totalprice") / 2).withColumn("o_custkey", F.col("o_custkey").cast("string")))
    return t.spark.createDataFrame([(k, c) for k, columns in found.items() for c in columns], "change string, column string")


@query("v04_x04_labels", "SELECT 'orders' AS source, strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n FROM orders GROUP BY 2")
def _(t):
    return R.derive(t("orders"), "source", F.lit("orders")).groupBy("source", month_of(F.col("o_orderdate")).alias("month")).agg(F.count("*").alias("n"))


@query("x16_canonical", "SELECT o_orderkey, printf('%.9e', o_totalprice) AS price, CAST(o_custkey AS VARCHAR) AS customer FROM orders")
def _(t):
    return t("orders").select("o_orderkey", canonical(F.col("o_totalprice"), "double").alias("price"), canonical(F.col("o_custkey"), "bigint").alias("customer"))
