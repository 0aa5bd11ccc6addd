"""Queries of profiles, quality, versions, drift and outliers."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import inference as I
from ..operators import quality as Q
from . import query

PROFILED = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_orderkey", "l_suppkey"]

#: Columns of lineitem with their types, numbers apart.
NUMBERS = {"l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint", "l_linenumber": "int", "l_quantity": "double", "l_extendedprice": "double", "l_discount": "double", "l_tax": "double"}
OTHERS = {"l_returnflag": "string", "l_linestatus": "string", "l_shipdate": "timestamp_ntz"}


@query("q01_profile", " UNION ALL ".join([
    *(f"SELECT '{c}' AS \"column\", '{k}' AS type, count(*) AS rows, count(*) - count({c}) AS nulls, count(DISTINCT {c}) AS \"distinct\", NULL::VARCHAR AS min_text, min({c})::DOUBLE AS min, max({c})::DOUBLE AS max, avg({c}) AS mean, stddev_samp({c}) AS sd, quantile_cont({c}::DOUBLE, 0.25) AS q25, quantile_cont({c}::DOUBLE, 0.5) AS median, quantile_cont({c}::DOUBLE, 0.75) AS q75, quantile_cont({c}::DOUBLE, 0.95) AS q95 FROM lineitem" for c, k in NUMBERS.items()),
    *(f"SELECT '{c}', '{k}', count(*), count(*) - count({c}), count(DISTINCT {c}), min({c}::VARCHAR), NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM lineitem" for c, k in OTHERS.items()),
]))
def _(t):
    return Q.profile(t("lineitem"))


@query("q01_exact_profile", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) AS rows, count(*) - count({c}) AS nulls, count(DISTINCT {c}) AS \"distinct\", CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max, avg({c}) AS mean, stddev_samp({c}) AS sd FROM lineitem" for c in PROFILED))
def _(t):
    return Q.exact_profile(t("lineitem"), PROFILED)


@query("q01_histogram", """
    WITH e AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders)
    SELECT CAST(least(10, floor((o_totalprice - lo) / ((hi - lo) / 10)) + 1) AS INTEGER) AS bin, count(*) AS n FROM orders, e GROUP BY 1""")  # fmt: skip
def _(t):
    return Q.histogram(t("orders"), "o_totalprice")


@query("q01_top_values", "SELECT p_type AS item, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, item LIMIT 10")
def _(t):
    return Q.top_values(t("part"), "p_type")


@query("q03_quality_score", """
    WITH n AS (SELECT count(*) AS n FROM orders), d AS (SELECT 1 - (SELECT count(*) FROM (SELECT DISTINCT * FROM orders)) / CAST(n AS DOUBLE) AS d FROM n),
    q AS (SELECT quantile_cont(o_orderkey, 0.25) AS a1, quantile_cont(o_orderkey, 0.75) AS a3, quantile_cont(o_custkey, 0.25) AS b1, quantile_cont(o_custkey, 0.75) AS b3, quantile_cont(o_totalprice, 0.25) AS c1, quantile_cont(o_totalprice, 0.75) AS c3 FROM orders),
    o AS (SELECT (count(*) FILTER (o_orderkey < a1 - 1.5 * (a3 - a1) OR o_orderkey > a3 + 1.5 * (a3 - a1)) + count(*) FILTER (o_custkey < b1 - 1.5 * (b3 - b1) OR o_custkey > b3 + 1.5 * (b3 - b1)) + count(*) FILTER (o_totalprice < c1 - 1.5 * (c3 - c1) OR o_totalprice > c3 + 1.5 * (c3 - c1))) / (3.0 * count(*)) AS o FROM orders, q),
    m AS (SELECT (6.0 * count(*) - count(o_orderkey) - count(o_custkey) - count(o_orderstatus) - count(o_totalprice) - count(o_orderdate) - count(o_orderpriority)) / (6 * count(*)) AS m FROM orders)
    SELECT m AS missing_share, d AS duplicate_share, o AS outlier_share, 30 * (1 - m) + 20 * (1 - d) + 20 * (1 - o) + 30 AS score FROM m, d, o""")  # fmt: skip
def _(t):
    return Q.quality_score(t("orders"))


@query("q04_candidate_keys", "SELECT 'o_orderkey' AS \"column\", count(*) = count(DISTINCT o_orderkey) AS is_key FROM orders UNION ALL SELECT 'o_custkey', count(*) = count(DISTINCT o_custkey) FROM orders")
def _(t):
    return Q.candidate_keys(t("orders"), ["o_orderkey", "o_custkey"])


@query("q08_key_violations", "WITH k AS (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber) SELECT count(*) FILTER (n > 1) AS repeated_keys, CAST(coalesce(sum(n) FILTER (n > 1), 0) AS BIGINT) AS rows_of_them, CAST(sum(n) AS BIGINT) AS rows, coalesce(sum(n) FILTER (n > 1), 0) / CAST(sum(n) AS DOUBLE) AS share FROM k")
def _(t):
    return Q.key_violations(t("lineitem"), ["l_orderkey", "l_linenumber"])


@query("q09_unit_changes", "WITH m AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, median(o_totalprice) AS median, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) >= 5), r AS (SELECT *, median / lag(median) OVER (ORDER BY month) AS ratio FROM m) SELECT * FROM r WHERE ratio >= 1.2 OR ratio <= 1 / 1.2")
def _(t):
    return Q.unit_changes(t("orders"), "o_orderdate", "o_totalprice", 1.2)


@query("q10_column_findings", "SELECT 'kind' AS \"column\", 'constant' AS \"check\", count(*) AS rows, CAST(0 AS BIGINT) AS nulls, CAST(1 AS BIGINT) AS \"distinct\" FROM part")
def _(t):
    return Q.column_findings(t("part").select("p_partkey", "p_brand", F.lit("x").alias("kind")))


@query("q12_class_balance", """
    WITH c AS (SELECT toxic, count(*) AS n FROM labels WHERE toxic IS NOT NULL GROUP BY toxic), f AS (SELECT count(*) AS classes, min(n) AS rarer, max(n) AS commoner FROM c)
    SELECT *, rarer / CAST(commoner AS DOUBLE) AS ratio, CASE WHEN classes <> 2 THEN 'not_applicable' WHEN rarer < 0.05 * commoner THEN 'severe' WHEN rarer < 0.2 * commoner THEN 'imbalanced' ELSE 'balanced' END AS severity FROM f""")  # fmt: skip
def _(t):
    return Q.class_balance(t("labels"), "toxic")


@query("q18_functional_dependencies", "SELECT 'o_orderkey' AS determinant, d AS dependent, 1.0 AS share FROM (VALUES ('o_custkey'), ('o_orderstatus')) v(d)")
def _(t):
    return Q.functional_dependencies(t("orders"), ["o_orderkey", "o_custkey", "o_orderstatus"], 0.98)


@query("q21_dominated_groups", """
    WITH e AS (SELECT event_type AS g, CASE WHEN event_id % 500 = 0 AND event_type <> 'view' THEN value * 400 ELSE value END AS v FROM events),
    b AS (SELECT g, quantile_cont(v, 0.75) + 3 * (quantile_cont(v, 0.75) - quantile_cont(v, 0.25)) AS high, count(v) AS n, sum(v) AS total FROM e GROUP BY g),
    f AS (SELECT g, any_value(n) AS n, any_value(total) AS total, count(*) AS extremes, sum(v) AS held FROM e JOIN b USING (g) WHERE n >= 8 AND v > high GROUP BY g)
    SELECT g AS event_type, n, round(total, 3) AS total, extremes, round(held, 3) AS held, held / total AS share FROM f WHERE extremes <= 0.05 * n AND held / total >= 0.2""")  # fmt: skip
def _(t):
    large = F.when((F.col("event_id") % 500 == 0) & (F.col("event_type") != "view"), F.col("value") * 400).otherwise(F.col("value"))
    found = Q.dominated_groups(t("events").select("event_type", large.alias("value")), "event_type", "value")
    return found.withColumn("total", F.round("total", 3)).withColumn("held", F.round("held", 3))


def edited(t):
    o = t("orders")
    return o, o.filter("o_orderkey % 33 <> 0").withColumn("o_totalprice", F.when(F.col("o_orderkey") % 20 == 0, F.col("o_totalprice") * 2).otherwise(F.col("o_totalprice")))


@query("d01_compare", """
    SELECT CASE WHEN o_orderkey % 33 = 0 THEN 'removed' WHEN o_orderkey % 20 = 0 THEN 'changed' ELSE 'unchanged' END AS state, count(*) AS keys FROM orders GROUP BY 1""")  # fmt: skip
def _(t):
    return Q.compare(*edited(t), ["o_orderkey"])


@query("d01_changed_cells", "SELECT c AS \"column\", CASE WHEN c = 'o_totalprice' THEN (SELECT count(*) FROM orders WHERE o_orderkey % 33 <> 0 AND o_orderkey % 20 = 0) ELSE 0 END AS changed FROM (VALUES ('o_custkey'), ('o_orderstatus'), ('o_totalprice'), ('o_orderdate'), ('o_orderpriority')) v(c)")
def _(t):
    return Q.changed_cells(*edited(t), ["o_orderkey"])


@query("d02_missing_delta", """
    WITH n AS (SELECT count(*) AS n, count(*) FILTER (o_orderkey % 33 <> 0) AS m FROM orders),
    b AS (SELECT 'o_orderkey' AS "column", 0.0 AS before, 0.0 AS after UNION ALL
      SELECT 'o_totalprice', count(*) FILTER (o_orderkey % 7 = 0) / max(n), count(*) FILTER (o_orderkey % 33 <> 0 AND (o_orderkey % 7 = 0 OR o_orderkey % 5 = 0)) / max(m) FROM orders, n UNION ALL
      SELECT 'o_orderstatus', count(*) FILTER (o_orderstatus = 'P') / max(n), count(*) FILTER (o_orderkey % 33 <> 0 AND o_orderstatus = 'P' AND o_orderkey % 2 = 0) / max(m) FROM orders, n)
    SELECT *, after - before AS delta FROM b""")  # fmt: skip
def _(t):
    holes = lambda d, price, status: d.select("o_orderkey", F.when(~price, F.col("o_totalprice")).alias("o_totalprice"), F.when(~status, F.col("o_orderstatus")).alias("o_orderstatus"))
    o, k, is_p = t("orders"), F.col("o_orderkey"), F.col("o_orderstatus") == "P"
    return Q.missing_delta(holes(o, k % 7 == 0, is_p), holes(o.filter(k % 33 != 0), (k % 7 == 0) | (k % 5 == 0), is_p & (k % 2 == 0)))


@query("d03_numeric_delta", """
    WITH a AS (SELECT CASE WHEN o_orderkey % 20 = 0 THEN o_totalprice * 2 ELSE o_totalprice END AS p FROM orders WHERE o_orderkey % 33 <> 0),
    f AS (SELECT (SELECT avg(o_totalprice) FROM orders) AS mean_before, (SELECT median(o_totalprice) FROM orders) AS median_before, (SELECT stddev_pop(o_totalprice) FROM orders) AS sd_before,
      avg(p) AS mean_after, median(p) AS median_after, stddev_pop(p) AS sd_after FROM a)
    SELECT *, (mean_after - mean_before) / sd_before AS shift FROM f""")  # fmt: skip
def _(t):
    return Q.numeric_delta(*edited(t), "o_totalprice")


@query("d04_category_delta", "SELECT DISTINCT p_brand AS item, 'removed' AS state FROM part WHERE p_brand NOT IN (SELECT p_brand FROM part WHERE p_brand LIKE '%1%')")
def _(t):
    p = t("part")
    return Q.category_delta(p, p.filter("p_brand LIKE '%1%'"), "p_brand")


@query("d06_frames_equal", "SELECT * FROM (VALUES ('shuffled', true), ('nudged', true), ('swapped', false), ('one more', false)) t(edit, equal)")
def _(t):
    """Of edits of a table: rows shuffled, fractions nudged so that near ties sort differently, two cells swapped, a row repeated."""
    o = t("orders").select("o_orderkey", F.col("o_totalprice").cast("double").alias("price"), F.round(F.col("o_totalprice").cast("double"), -4).alias("about"), "o_orderstatus")
    nudged = o.withColumn("about", F.col("about") * (1 + F.when(F.col("o_orderkey") % 2 == 0, 1e-9).otherwise(-1e-9)))
    first, last = (t("orders").agg(f("o_orderkey")).first()[0] for f in (F.min, F.max))
    swapped = o.withColumn("o_orderkey", F.when(F.col("o_orderkey") == first, last).when(F.col("o_orderkey") == last, first).otherwise(F.col("o_orderkey")))
    edits = {"shuffled": o.repartition(7, "o_orderstatus"), "nudged": nudged.drop("o_orderkey"), "swapped": swapped, "one more": o.union(o.filter(F.col("o_orderkey") == first))}
    parts = [Q.frames_equal(o if "o_orderkey" in d.columns else o.drop("o_orderkey"), d).select(F.lit(name).alias("edit"), "equal") for name, d in edits.items()]
    return reduce(DataFrame.union, parts)


@query("n01_outliers_iqr", "WITH q AS (SELECT quantile_cont(l_extendedprice, 0.25) AS a, quantile_cont(l_extendedprice, 0.75) AS b FROM lineitem) SELECT l_returnflag, count(*) FILTER (l_extendedprice < a - 0.8 * (b - a) OR l_extendedprice > b + 0.8 * (b - a)) AS n FROM lineitem, q GROUP BY l_returnflag")
def _(t):
    return Q.outliers(t("lineitem"), "l_extendedprice", "iqr", 0.8).groupBy("l_returnflag").agg(F.count_if("is_outlier").alias("n"))


@query("n01_outliers_zscore", "WITH q AS (SELECT avg(l_extendedprice) AS a, stddev_samp(l_extendedprice) AS b FROM lineitem) SELECT l_returnflag, count(*) FILTER (abs(l_extendedprice - a) > 2 * b) AS n FROM lineitem, q GROUP BY l_returnflag")
def _(t):
    return Q.outliers(t("lineitem"), "l_extendedprice", "zscore", 2.0).groupBy("l_returnflag").agg(F.count_if("is_outlier").alias("n"))


@query("n01_outliers_mad", "WITH m AS (SELECT median(l_extendedprice) AS a FROM lineitem), q AS (SELECT a, median(abs(l_extendedprice - a)) AS b FROM lineitem, m GROUP BY a) SELECT l_returnflag, count(*) FILTER (0.6745 * abs(l_extendedprice - a) > 1.3 * b) AS n FROM lineitem, q GROUP BY l_returnflag")
def _(t):
    return Q.outliers(t("lineitem"), "l_extendedprice", "mad", 1.3).groupBy("l_returnflag").agg(F.count_if("is_outlier").alias("n"))


SHARES = """
    WITH b AS (SELECT event_type AS item, count(*) / CAST(sum(count(*)) OVER () AS DOUBLE) AS before FROM events WHERE event_id % 2 = 0 GROUP BY 1),
    a AS (SELECT event_type AS item, count(*) / CAST(sum(count(*)) OVER () AS DOUBLE) AS after FROM events WHERE event_id % 2 = 1 AND value > 20 GROUP BY 1),
    s AS (SELECT item, coalesce(before, 0) AS before, coalesce(after, 0) AS after FROM b FULL JOIN a USING (item))"""


def halves(t):
    e = t("events")
    return e.filter("event_id % 2 = 0"), e.filter("event_id % 2 = 1 AND value > 20")


@query("n03_share_drift", f"{SHARES} SELECT *, after - before AS change FROM s WHERE abs(after - before) >= 0.0")
def _(t):
    return Q.share_drift(*halves(t), "event_type", 0.0)


@query("n05_stability", f"{SHARES} SELECT sum((after - before) * ln((after + 0.0001) / (before + 0.0001))) AS psi, sum((after - before) * ln((after + 0.0001) / (before + 0.0001))) > 0.2 AS drifted FROM s")
def _(t):
    return Q.population_stability(*halves(t), "event_type")


@query("n05_numeric_stability", """
    WITH b AS (SELECT value FROM events WHERE event_id % 2 = 0 AND value IS NOT NULL), c AS (SELECT value FROM events WHERE event_id % 2 = 1 AND value > 20),
    e AS (SELECT DISTINCT unnest(quantile_cont(value, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS e FROM b), l AS (SELECT list(e) AS es FROM e),
    x AS (SELECT len(list_filter(es, lambda e: e <= value)) AS bin, 1 AS was FROM b, l UNION ALL SELECT len(list_filter(es, lambda e: e <= value)), 0 FROM c, l),
    s AS (SELECT sum(was) / (SELECT count(*) FROM b) AS before, sum(1 - was) / (SELECT count(*) FROM c) AS after FROM x GROUP BY bin)
    SELECT sum((after - before) * ln((after + 0.0001) / (before + 0.0001))) AS psi, sum((after - before) * ln((after + 0.0001) / (before + 0.0001))) > 0.2 AS drifted FROM s""")  # fmt: skip
def _(t):
    return Q.numeric_stability(*halves(t), "value")


@query("n08_drift_cycle", """
    WITH b AS (SELECT * FROM events WHERE event_id % 2 = 0), c AS (SELECT * FROM events WHERE event_id % 2 = 1 AND value > 20),
    v AS (SELECT DISTINCT value AS v FROM (SELECT value FROM b UNION ALL SELECT value FROM c) WHERE value IS NOT NULL),
    s AS (SELECT (SELECT count(value) FROM b) AS n, (SELECT count(value) FROM c) AS m),
    r AS (SELECT v, sum(x) OVER (ORDER BY v) AS fb, sum(y) OVER (ORDER BY v) AS fc FROM (SELECT v, coalesce(x, 0) AS x, coalesce(y, 0) AS y FROM v LEFT JOIN (SELECT value, count(*) AS x FROM b GROUP BY value) p ON p.value = v LEFT JOIN (SELECT value, count(*) AS y FROM c GROUP BY value) q ON q.value = v)),
    k AS (SELECT max(abs(fb / n - fc / m)) AS d, any_value(n) AS n, any_value(m) AS m FROM r, s),
    t AS (SELECT event_type, (SELECT count(*) FROM b x WHERE x.event_type = y.event_type) / (SELECT count(*) FROM b) AS f, (SELECT count(*) FROM c x WHERE x.event_type = y.event_type) / (SELECT count(*) FROM c) AS g FROM (SELECT DISTINCT event_type FROM events) y),
    p AS (SELECT sum((g - f) * ln((g + 0.0001) / (f + 0.0001))) AS psi FROM t)
    SELECT 'events' AS "table", 'value' AS "column", 'CONTINUOUS_KS' AS kind, d AS value, d * sqrt(n * m / (n + m)) > 1.627624 AS drifted FROM k UNION ALL SELECT 'events', 'event_type', 'CATEGORICAL_PSI', psi, psi > 0.2 FROM p
    UNION ALL SELECT 'same', 'value', 'CONTINUOUS_KS', 0.0, false""")  # fmt: skip
def _(t):
    baseline, current = halves(t)
    return I.drift_cycle({"events": (baseline, current), "same": (baseline, baseline)}, {"events": ["value", "event_type", "gone"], "same": ["value"]})


@query("n07_alert_rules", """
    WITH v AS (SELECT sum(value) FILTER (event_id % 2 = 0) AS before, sum(value) FILTER (event_id % 2 = 1 AND value > 20) AS after FROM events)
    SELECT 'total' AS rule, before, after, 100 * (after - before) / abs(before) AS percent, CASE WHEN abs(100 * (after - before) / abs(before)) >= 1 THEN 'TRIGGERED' ELSE 'NO_CHANGE' END AS status FROM v
    UNION ALL SELECT 'absent', NULL, NULL, NULL, 'METRIC_UNAVAILABLE'""")  # fmt: skip
def _(t):
    rules = [{"name": "total", "column": "value", "how": "sum", "threshold": 1}, {"name": "absent", "column": "none", "how": "sum", "threshold": 1}]
    return Q.alert_rules(*halves(t), rules).select("rule", "before", "after", "percent", "status")
