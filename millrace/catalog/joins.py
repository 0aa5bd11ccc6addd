"""Join queries."""

from pyspark.sql import functions as F

from ..operators import joins as J
from . import query


def tables(t):
    return {n: t(n) for n in ("customer", "orders", "lineitem", "nation", "region", "supplier", "part")}


ORDER_HOPS = [J.Hop("customer", ("o_custkey",), ("c_custkey",)), J.Hop("nation", ("c_nationkey",), ("n_nationkey",)), J.Hop("region", ("n_regionkey",), ("r_regionkey",))]


@query("j01_inner", "SELECT c_mktsegment, count(*) AS n, sum(o_totalprice) AS v FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment")
def _(t):
    return J.join(t("orders"), t("customer"), ["o_custkey"], ["c_custkey"]).groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("v"))


@query("j02_left", "SELECT c_mktsegment, count(o_orderkey) AS orders, count(*) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_mktsegment")
def _(t):
    return J.join(t("customer"), t("orders"), ["c_custkey"], ["o_custkey"], "left").groupBy("c_mktsegment").agg(F.count("o_orderkey").alias("orders"), F.count("*").alias("n"))


@query("j03_join_path", """
    SELECT r_name, c_mktsegment, count(DISTINCT o_orderkey) AS orders, sum(l_extendedprice * (1 - l_discount)) AS revenue
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    GROUP BY ALL""")  # fmt: skip
def _(t):
    rows = J.join_path(tables(t), "lineitem", [J.Hop("orders", ("l_orderkey",), ("o_orderkey",)), *ORDER_HOPS])
    return rows.groupBy("r_name", "c_mktsegment").agg(F.count_distinct("l_orderkey").alias("orders"), F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"))


@query("j04_assess_join", """
    WITH l AS (SELECT count(*) AS left_rows, count(o_custkey) AS left_known, count(DISTINCT o_custkey) AS left_distinct FROM orders),
    r AS (SELECT count(*) AS right_rows, count(c_custkey) AS right_known, count(DISTINCT c_custkey) AS right_distinct FROM customer)
    SELECT *, 'MANY_TO_ONE' AS cardinality, 'SAFE' AS status FROM l, r""")  # fmt: skip
def _(t):
    return J.assess_join(t("orders"), t("customer"), ["o_custkey"], ["c_custkey"])


@query("j05_assess_hops", "SELECT * FROM (VALUES (1, 'customer', 'MANY_TO_ONE', 'SAFE'), (2, 'nation', 'MANY_TO_ONE', 'SAFE'), (3, 'region', 'MANY_TO_ONE', 'SAFE')) v(hop, \"right\", cardinality, status)")
def _(t):
    return J.assess_hops(tables(t), "orders", ORDER_HOPS)


@query("j06_fanout_guard", "SELECT false AS allowed")
def _(t):
    return J.fanout_guard(J.assess_hops(tables(t), "orders", [J.Hop("lineitem", ("o_orderkey",), ("l_orderkey",))]))


@query("j07_grain_proof", """
    WITH a AS (SELECT o_orderkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey)
    SELECT (SELECT count(*) FROM orders) AS before_rows, (SELECT count(*) FROM a) AS after_rows, (SELECT count(DISTINCT o_orderkey) FROM orders) AS before_distinct,
      (SELECT count(DISTINCT o_orderkey) FROM a) AS after_distinct, (SELECT count(*) FROM a) / CAST((SELECT count(*) FROM orders) AS DOUBLE) AS fanout, 'FANOUT_DETECTED' AS verdict""")  # fmt: skip
def _(t):
    o = t("orders")
    return J.grain_proof(o, J.join(o, t("lineitem"), ["o_orderkey"], ["l_orderkey"]), ["o_orderkey"])


@query("j08_composite_cardinality", """
    SELECT count(*) AS left_rows, count(*) AS left_known, count(DISTINCT (l_orderkey, l_linenumber)) AS left_distinct, count(*) AS right_rows, count(*) AS right_known,
      count(DISTINCT (l_orderkey, l_linenumber)) AS right_distinct, CASE WHEN count(*) = count(DISTINCT (l_orderkey, l_linenumber)) THEN 'ONE_TO_ONE' ELSE 'MANY_TO_MANY' END AS cardinality,
      CASE WHEN count(*) = count(DISTINCT (l_orderkey, l_linenumber)) THEN 'SAFE' ELSE 'UNSAFE' END AS status FROM lineitem""")  # fmt: skip
def _(t):
    return J.assess_join(t("lineitem"), t("lineitem"), ["l_orderkey", "l_linenumber"], ["l_orderkey", "l_linenumber"])


@query("j09_discover_joins", """
    WITH o AS (SELECT DISTINCT o_custkey AS k FROM orders), c AS (SELECT DISTINCT c_custkey AS k FROM customer),
    n AS (SELECT count(o.k) AS a, count(c.k) AS b, count(*) FILTER (o.k IS NOT NULL AND c.k IS NOT NULL) AS s, count(*) AS u FROM o FULL JOIN c ON o.k = c.k),
    p AS (SELECT DISTINCT l_orderkey AS k FROM lineitem), q AS (SELECT DISTINCT o_orderkey AS k FROM orders),
    m AS (SELECT count(p.k) AS a, count(q.k) AS b, count(*) FILTER (p.k IS NOT NULL AND q.k IS NOT NULL) AS s, count(*) AS u FROM p FULL JOIN q ON p.k = q.k)
    SELECT 'customer' AS "left", 'c_custkey' AS left_key, 'orders' AS "right", 'o_custkey' AS right_key, greatest(s / CAST(u AS DOUBLE), 0.9 * s / least(a, b)) AS score FROM n
    UNION ALL SELECT 'lineitem', 'l_orderkey', 'orders', 'o_orderkey', greatest(s / CAST(u AS DOUBLE), 0.9 * s / least(a, b)) FROM m""")  # fmt: skip
def _(t):
    return J.discover_joins({n: t(n) for n in ("customer", "orders", "lineitem")})


@query("j10_found_path", "SELECT c_mktsegment, sum(l_quantity) AS v FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment")
def _(t):
    used = {n: t(n) for n in ("customer", "orders", "lineitem")}
    edges = [tuple(r) for r in J.discover_joins(used).collect()]  # one row a pair of key columns
    return J.join_path(used, "lineitem", J.find_join_path(edges, "lineitem", "customer")).groupBy("c_mktsegment").agg(F.sum("l_quantity").alias("v"))


@query("j11_foreign_key", """
    WITH k AS (SELECT DISTINCT l_orderkey AS k FROM lineitem), m AS (SELECT count(*) AS keys, count(o_orderkey) AS matched FROM k LEFT JOIN orders ON k = o_orderkey)
    SELECT *, matched / CAST(keys AS DOUBLE) AS match_ratio, keys > 5 AND keys = matched AS is_foreign_key FROM m""")  # fmt: skip
def _(t):
    return J.foreign_key(t("lineitem"), "l_orderkey", t("orders"), "o_orderkey")


@query("j12_semi", "SELECT count(*) AS n FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 100000)")
def _(t):
    big = t("orders").filter("o_totalprice > 100000").select(F.col("o_custkey").alias("c_custkey"))
    return J.semi(t("customer"), big, ["c_custkey"]).agg(F.count("*").alias("n"))


@query("j12_anti", "SELECT count(*) AS n FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 100000)")
def _(t):
    big = t("orders").filter("o_totalprice > 100000").select(F.col("o_custkey").alias("c_custkey"))
    return J.anti(t("customer"), big, ["c_custkey"]).agg(F.count("*").alias("n"))


@query("j13_related_column", "SELECT o_orderstatus, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1 GROUP BY o_orderstatus")
def _(t):
    return J.join_path(tables(t), "orders", ORDER_HOPS[:2]).filter("n_regionkey = 1").groupBy("o_orderstatus").agg(F.count("*").alias("n"))
