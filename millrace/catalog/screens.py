"""Queries of screens, sources and checks."""

from pyspark.sql import functions as F

from ..operators import cleaning as C
from ..operators import inference as I
from ..operators import learning as M
from ..operators import periods as P
from ..operators import screens as S
from ..sources import files
from . import query


@query("c04_literal_codes", "SELECT n_nationkey, CASE WHEN n_nationkey % 5 = 0 THEN 'NA' ELSE chr(65 + n_nationkey % 26) || 'X' END AS code FROM nation")
def _(t):
    return C.normalize_na(t("nation").select("n_nationkey", F.when(F.col("n_nationkey") % 5 == 0, "NA").otherwise(F.expr("concat(char(65 + n_nationkey % 26), 'X')")).alias("code")))


@query("c07_drop_all_null_rows", "SELECT count(*) AS n FROM orders WHERE o_orderkey % 7 <> 0")
def _(t):
    nulls = [F.when(F.col("o_orderkey") % 7 != 0, F.col(c)).alias(c) for c in ("o_orderkey", "o_totalprice")]
    return C.drop_all_null_rows(t("orders").select(*nulls)).agg(F.count("*").alias("n"))


@query("i07_run_sql", "SELECT c_mktsegment, count(*) AS n, false AS is_truncated FROM customer GROUP BY c_mktsegment")
def _(t):
    return files.run_sql(t.spark, "SELECT c_mktsegment, count(*) AS n FROM customer_of_query GROUP BY c_mktsegment", {"customer_of_query": t("customer")})


@query("i12_resource_guard", "SELECT count(*) AS rows, 6 AS columns, max(greatest(length(p_name), length(p_brand), length(p_type))) AS longest_cell, count(*) <= 500000 AS within_limits FROM part")
def _(t):
    return files.resource_guard(t("part"))


@query("s22_outlier_sensitivity", """
    WITH c AS (SELECT quantile_cont(o_totalprice, 0.99) AS cap FROM orders), g AS (SELECT o_orderpriority AS g, avg(o_totalprice) AS m, avg(o_totalprice) FILTER (o_totalprice <= cap) AS t, median(o_totalprice) AS d FROM orders, c GROUP BY 1),
    l AS (SELECT arg_max(g, m) AS by_mean, arg_max(g, t) AS by_trimmed_mean, arg_max(g, d) AS by_median FROM g)
    SELECT *, by_mean = by_trimmed_mean AND by_mean = by_median AS stable FROM l""")  # fmt: skip
def _(t):
    return S.outlier_sensitivity(t("orders"), "o_orderpriority", "o_totalprice")


@query("s24_moderation", """
    WITH c AS (SELECT l_linestatus, l_returnflag, avg(l_extendedprice) AS m, count(*) AS n FROM lineitem GROUP BY ALL)
    SELECT l_linestatus, max(m) - min(m) AS contrast, arg_max(l_returnflag, m) AS highest, CAST(sum(n) AS BIGINT) AS n FROM c GROUP BY l_linestatus""")  # fmt: skip
def _(t):
    return S.moderation(t("lineitem"), "l_linestatus", "l_returnflag", "l_extendedprice")


@query("s29_claims", """
    WITH s AS (SELECT o_orderstatus, sum(o_totalprice) AS v FROM orders GROUP BY 1), r AS (SELECT max(v) / sum(v) AS share FROM s)
    SELECT 'concentrated' AS claim, share AS value, CASE WHEN share >= 0.45 THEN 'SUPPORTED' ELSE 'REFUTED' END AS verdict FROM r""")  # fmt: skip
def _(t):
    return S.claim_checks(S.top_share(t("orders"), "o_orderstatus", "o_totalprice"), [{"name": "concentrated", "column": "share", "least": 0.45}])


@query("r03_kendall", """
    WITH c AS (SELECT CAST(l_linenumber AS DOUBLE) AS x, l_quantity AS y, CAST(count(*) AS DOUBLE) AS n FROM lineitem GROUP BY ALL),
    s AS (SELECT sum(a.n * b.n * sign(b.y - a.y)) AS s FROM c a JOIN c b ON a.x < b.x), tx AS (SELECT sum(k * (k - 1) / 2) AS tx FROM (SELECT sum(n) AS k FROM c GROUP BY x)), ty AS (SELECT sum(k * (k - 1) / 2) AS ty FROM (SELECT sum(n) AS k FROM c GROUP BY y)),
    m AS (SELECT sum(n) AS n FROM c) SELECT s / sqrt((n * (n - 1) / 2 - tx) * (n * (n - 1) / 2 - ty)) AS tau, CAST(n AS BIGINT) AS n FROM s, tx, ty, m""")  # fmt: skip
def _(t):
    return S.kendall(t("lineitem"), "l_linenumber", "l_quantity")


@query("r04_partial_correlation", """
    WITH r AS (SELECT corr(l_quantity, l_extendedprice) AS a, corr(l_quantity, l_discount) AS b, corr(l_extendedprice, l_discount) AS c FROM lineitem)
    SELECT (a - b * c) / sqrt((1 - b * b) * (1 - c * c)) AS r FROM r""")  # fmt: skip
def _(t):
    return S.partial_correlation(t("lineitem"), "l_quantity", "l_extendedprice", ["l_discount"]).select("r")


@query("r06_stronger_predictor", """
    WITH r AS (SELECT 'l_quantity' AS predictor, corr(l_extendedprice, l_quantity) AS r FROM lineitem UNION ALL SELECT 'l_discount', corr(l_extendedprice, l_discount) FROM lineitem)
    SELECT *, CAST(row_number() OVER (ORDER BY abs(r) DESC) AS INTEGER) AS rank FROM r""")  # fmt: skip
def _(t):
    return S.stronger_predictor(t("lineitem"), "l_extendedprice", ["l_quantity", "l_discount"])


@query("r11_diagnostics")
def _(t):
    return S.diagnostics(t("lineitem"), "l_extendedprice", ["l_quantity", "l_discount"], "l_shipdate")


@query("r13_driver_screen", """
    WITH g AS (SELECT l_returnflag AS g, count(*) AS n, avg(l_extendedprice) AS m FROM lineitem GROUP BY 1), w AS (SELECT avg(l_extendedprice) AS mm, var_pop(l_extendedprice) AS vv, count(*) AS nn FROM lineitem)
    SELECT 'l_quantity' AS candidate, 'number' AS kind, abs(corr(l_extendedprice, l_quantity)) AS strength FROM lineitem
    UNION ALL SELECT 'l_returnflag', 'category', sqrt(sum(n * (m - mm) * (m - mm)) / (any_value(vv) * any_value(nn))) FROM g, w""")  # fmt: skip
def _(t):
    return S.driver_screen(t("lineitem"), "l_extendedprice", ["l_quantity", "l_returnflag"], 0.0)


@query("r14_exploratory_pairs", """
    WITH r AS (SELECT 'l_quantity' AS a, 'l_extendedprice' AS b, corr(l_quantity, l_extendedprice) AS r FROM lineitem UNION ALL SELECT 'l_quantity', 'l_discount', corr(l_quantity, l_discount) FROM lineitem
      UNION ALL SELECT 'l_quantity', 'l_tax', corr(l_quantity, l_tax) FROM lineitem UNION ALL SELECT 'l_extendedprice', 'l_discount', corr(l_extendedprice, l_discount) FROM lineitem
      UNION ALL SELECT 'l_extendedprice', 'l_tax', corr(l_extendedprice, l_tax) FROM lineitem UNION ALL SELECT 'l_discount', 'l_tax', corr(l_discount, l_tax) FROM lineitem) SELECT a, b, round(r, 8) AS r FROM r""")  # fmt: skip
def _(t):
    return S.exploratory_pairs(t("lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]).select("a", "b", F.round("r", 8).alias("r"))


@query("q02_roles", """
    WITH n AS (SELECT count(*) AS n, count(DISTINCT o_orderkey) AS k, count(DISTINCT o_custkey) AS c, count(DISTINCT o_orderstatus) AS s, count(DISTINCT o_orderpriority) AS p FROM orders),
    kinds AS (SELECT column_name, data_type FROM information_schema.columns WHERE table_name = 'orders')
    SELECT column_name AS "column", CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double' WHEN 'VARCHAR' THEN 'string' WHEN 'DATE' THEN 'date' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' ELSE data_type END AS type,
      CASE WHEN data_type IN ('DATE', 'TIMESTAMP') THEN 'time' WHEN column_name = 'o_orderkey' THEN CASE WHEN k >= 0.97 * n THEN 'key' ELSE 'identifier' END
        WHEN column_name = 'o_custkey' THEN CASE WHEN c >= 0.97 * n THEN 'key' ELSE 'identifier' END WHEN data_type <> 'VARCHAR' THEN 'metric'
        WHEN CASE column_name WHEN 'o_orderstatus' THEN s ELSE p END <= greatest(50, 0.05 * n) THEN 'category' ELSE 'text' END AS role FROM kinds, n""")  # fmt: skip
def _(t):
    return S.roles(t("orders"))


@query("q05_fitness", """
    SELECT 'p' AS "column", count(*) AS rows, count(*) - count(p) AS nulls, count(DISTINCT p) AS "distinct", (count(*) - count(p)) / CAST(count(*) AS DOUBLE) AS missing_share,
      CASE WHEN (count(*) - count(p)) > 0.4 * count(*) THEN 'UNFIT' WHEN (count(*) - count(p)) > 0.05 * count(*) THEN 'CAUTION' ELSE 'FIT' END AS verdict
    FROM (SELECT CASE WHEN o_orderkey % 10 <> 0 THEN o_totalprice END AS p FROM orders)""")  # fmt: skip
def _(t):
    return S.fitness(t("orders").select(F.when(F.col("o_orderkey") % 10 != 0, F.col("o_totalprice")).alias("p")), "p")


@query("q13_leakage", "SELECT 'twice' AS \"column\", 1.0 AS r")
def _(t):
    return S.leakage(t("orders").withColumn("twice", F.col("o_totalprice") * 2), "o_totalprice", ["twice", "o_custkey"]).withColumn("r", F.round("r", 9))


@query("q13_temporal_validity", "SELECT strftime(min(o_orderdate), '%Y-%m-%d') AS first, strftime(max(o_orderdate), '%Y-%m-%d') AS last, count(*) - count(o_orderdate) AS missing, count(*) FILTER (o_orderdate < TIMESTAMP '1900-01-01') AS too_early FROM orders")
def _(t):
    return S.temporal_validity(t("orders"), "o_orderdate")


@query("q20_rows_used", "SELECT count(*) AS rows, count(*) FILTER (o_orderkey % 10 <> 0) AS n_used, count(*) FILTER (o_orderkey % 10 = 0) AS n_dropped FROM orders")
def _(t):
    return S.rows_used(t("orders").withColumn("p", F.when(F.col("o_orderkey") % 10 != 0, F.col("o_totalprice"))), ["p", "o_custkey"])


@query("d05_materiality", """
    WITH a AS (SELECT o_totalprice AS p FROM orders WHERE o_orderkey % 33 <> 0), x AS (SELECT ((SELECT count(*) FROM a) - count(*)) / CAST(count(*) AS DOUBLE) AS row_change, ((SELECT avg(p) FROM a) - avg(o_totalprice)) / stddev_pop(o_totalprice) AS mean_shift FROM orders)
    SELECT *, abs(row_change) > 0.05 OR abs(mean_shift) > 0.1 AS material FROM x""")  # fmt: skip
def _(t):
    o = t("orders")
    return S.materiality(o, o.filter("o_orderkey % 33 <> 0"), "o_totalprice")


@query("s12_pairwise", """
    WITH g AS (SELECT o_orderpriority AS g, count(*) AS n, avg(o_totalprice) AS m, var_samp(o_totalprice) AS v FROM orders GROUP BY 1)
    SELECT a.g AS a, b.g AS b, a.m - b.m AS difference, (a.m - b.m) / sqrt(a.v / a.n + b.v / b.n) AS statistic FROM g a JOIN g b ON a.g < b.g""")  # fmt: skip
def _(t):
    return I.pairwise(t("orders"), "o_totalprice", "o_orderpriority").select("a", "b", "difference", "statistic")


@query("t17_corrected_trends")
def _(t):
    series = P.period_series(t("orders"), "o_orderdate", "o_totalprice", "sum", "month", ["o_orderpriority"])
    return P.corrected_trends(series, ["o_orderpriority"])


@query("m11_risk_score")
def _(t):
    o = t("orders").withColumn("big", (F.col("o_totalprice") > 200000).cast("int"))
    return M.risk_score(o.select("big", "o_orderpriority", "o_orderdate", F.length("o_orderstatus").alias("l"), (F.col("o_custkey") % 10).alias("k")), "big", ["o_orderpriority", "k"], "o_orderdate")[1]


@query("c20_transformation_record", "SELECT 'filter' AS operation, true AS starts_where_it_should, true AS ends_where_it_should, true AS chained, false AS forged")
def _(t):
    """A record of a step, its hashes against those of the tables in another order, and the chain against that of another first record."""
    o = t("orders")
    record = C.transformation_record("filter", o, o.filter("o_orderkey % 2 = 0"), "start")
    again = C.transformation_record("filter", o.repartition(3, "o_custkey"), o.filter("o_orderkey % 2 = 0").orderBy("o_custkey"), "start").select(F.col("before").alias("b"), F.col("after").alias("a"), F.col("record").alias("r"))
    forged = C.transformation_record("filter", o, o.filter("o_orderkey % 2 = 0"), "other").select(F.col("record").alias("f"))
    same = record.crossJoin(again).crossJoin(forged)  # a row each
    return same.select("operation", (F.col("before") == F.col("b")).alias("starts_where_it_should"), (F.col("after") == F.col("a")).alias("ends_where_it_should"), (F.col("record") == F.col("r")).alias("chained"), (F.col("record") == F.col("f")).alias("forged"))
