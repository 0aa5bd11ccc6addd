"""Aggregation queries."""

from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators.quality import distribution_profile
from ..operators.ranks import concentration, trimmed_mean
from . import query

X, G = "l_extendedprice", "l_returnflag"
# centred so that signs and zeros occur
CENTRED = "(l_quantity - 25)"

SIMPLE = {
    "row_count": "count(*)", "count": f"count({X})", "count_distinct": f"count(DISTINCT {X})", "sum": f"sum({X})", "mean": f"avg({X})", "median": f"median({X})",
    "min": f"min({X})", "max": f"max({X})", "variance": f"var_samp({X})", "stddev": f"stddev_samp({X})", "range": f"max({X}) - min({X})",
    "q1": f"quantile_cont({X}, 0.25)", "q3": f"quantile_cont({X}, 0.75)", "iqr": f"quantile_cont({X}, 0.75) - quantile_cont({X}, 0.25)",
    "missing_count": f"count(*) - count({X})", "missing_percent": f"100.0 * (count(*) - count({X})) / count(*)", "skewness": f"skewness({X})", "kurtosis": f"kurtosis({X})",
    "coefficient_of_variation": f"stddev_samp({X}) / abs(avg({X}))",
}
SIGNED = {
    "abs_sum": f"sum(abs({CENTRED}))", "positive_count": f"count(*) FILTER ({CENTRED} > 0)", "negative_count": f"count(*) FILTER ({CENTRED} < 0)",
    "zero_count": f"count(*) FILTER ({CENTRED} = 0)", "nonzero_count": f"count(*) FILTER ({CENTRED} <> 0)",
}

for name, sql in SIMPLE.items():
    query(f"a_{name}", f"SELECT {G}, {sql} AS value, count(*) AS row_count FROM lineitem GROUP BY {G}")(lambda t, n=name: A.aggregate(t("lineitem"), n, X, [G]))
for name, sql in SIGNED.items():
    query(f"a_{name}", f"SELECT {G}, {sql} AS value, count(*) AS row_count FROM lineitem GROUP BY {G}")(lambda t, n=name: A.aggregate(t("lineitem").withColumn("c", F.col("l_quantity") - 25), n, "c", [G]))


@query("a_duplicate_row_count", "SELECT event_type, CAST(sum(n - 1) AS BIGINT) AS value, CAST(sum(n) AS BIGINT) AS row_count FROM (SELECT event_type, user_id, count(*) AS n FROM events GROUP BY ALL) GROUP BY event_type")
def _(t):
    return A.aggregate(t("events").select("event_type", "user_id"), "duplicate_row_count", None, ["event_type"])


@query("a_mode", """
    WITH c AS (SELECT o_orderstatus, o_orderpriority AS v, count(*) AS n FROM orders GROUP BY ALL)
    SELECT o_orderstatus, first(v ORDER BY n DESC, v) AS value, CAST(sum(n) AS BIGINT) AS row_count FROM c GROUP BY o_orderstatus""")  # fmt: skip
def _(t):
    return A.aggregate(t("orders"), "mode", "o_orderpriority", ["o_orderstatus"])


@query("a_percentile", f"SELECT {G}, quantile_cont({X}, 0.9) AS value, count(*) AS row_count FROM lineitem GROUP BY {G}")
def _(t):
    return A.aggregate(t("lineitem"), "percentile", X, [G], percentile=90)


@query("a_mad", f"""
    WITH m AS (SELECT {G}, median({X}) AS middle, count(*) AS row_count FROM lineitem GROUP BY {G})
    SELECT {G}, median(abs({X} - middle)) AS value, any_value(row_count) AS row_count FROM lineitem JOIN m USING ({G}) GROUP BY {G}""")  # fmt: skip
def _(t):
    return A.aggregate(t("lineitem"), "mad", X, [G])


@query("a29_rate", "SELECT l_linestatus, avg(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END) AS rate, count(*) AS n FROM lineitem GROUP BY l_linestatus")
def _(t):
    return A.rate(t("lineitem").withColumn("returned", F.when(F.col("l_returnflag") == "R", "yes").otherwise("no")), "returned", ["l_linestatus"])


@query("a30_ratio_of_sums", f"SELECT {G}, sum(l_extendedprice * l_discount) / sum(l_extendedprice) AS value FROM lineitem GROUP BY {G}")
def _(t):
    return A.ratio_of_sums(t("lineitem"), F.col(X) * F.col("l_discount"), F.col(X), [G])


@query("a31_weighted_mean", f"SELECT {G}, sum(l_discount * l_quantity) / sum(l_quantity) AS value, count(*) AS n FROM lineitem GROUP BY {G}")
def _(t):
    return A.weighted_mean(t("lineitem"), "l_discount", "l_quantity", [G])


@query("a32_natural_metric", "SELECT c_mktsegment, sum(c_acctbal) AS value, count(*) AS row_count FROM customer GROUP BY c_mktsegment")
def _(t):
    return A.metric(t("customer"), "c_acctbal", ["c_mktsegment"])


@query("a33_having", "SELECT l_suppkey, avg(l_quantity) AS value, count(*) AS n FROM lineitem GROUP BY l_suppkey HAVING count(*) >= 300")
def _(t):
    return A.having(t("lineitem"), ["l_suppkey"], "l_quantity", 300)


@query("a34_cross_tab", f"SELECT {G}, l_linestatus, sum({X}) AS value, count(*) AS n FROM lineitem GROUP BY ALL")
def _(t):
    return A.cross_tab(t("lineitem"), G, "l_linestatus", X)


@query("a35_contingency", """
    WITH c AS (SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL)
    SELECT *, CAST(sum(n) OVER (PARTITION BY o_orderstatus) AS BIGINT) AS row_total, CAST(sum(n) OVER (PARTITION BY o_orderpriority) AS BIGINT) AS column_total FROM c""")  # fmt: skip
def _(t):
    return A.contingency(t("orders"), "o_orderstatus", "o_orderpriority")


@query("a36_share_of_total", "SELECT c_mktsegment, sum(c_acctbal) AS value, sum(c_acctbal) / (SELECT sum(c_acctbal) FROM customer) AS share FROM customer GROUP BY c_mktsegment")
def _(t):
    return A.share_of_total(t("customer"), "c_acctbal", "c_mktsegment")


@query("a37_frequency_table", """
    WITH c AS (SELECT p_brand AS item, count(*) AS n FROM part GROUP BY ALL), s AS (SELECT *, (SELECT count(*) FROM part) AS total FROM c)
    SELECT item, n, n * 100.0 / total AS percent, sum(n) OVER (ORDER BY n DESC, item ROWS UNBOUNDED PRECEDING) * 100.0 / total AS cumulative_percent
    FROM s ORDER BY n DESC, item LIMIT 20""")  # fmt: skip
def _(t):
    return A.frequency_table(t("part"), "p_brand")


@query("a38_concentration", """
    WITH s AS (SELECT o_custkey, sum(o_totalprice) AS x FROM orders GROUP BY ALL),
    r AS (SELECT x, row_number() OVER (ORDER BY x) AS i, count(*) OVER () AS n, sum(x) OVER () AS total FROM s)
    SELECT 2 * sum(i * x) / (any_value(n) * any_value(total)) - (any_value(n) + 1.0) / any_value(n) AS gini,
      10000 * sum((x / total) * (x / total)) AS hhi, any_value(n) AS n, max(x) / any_value(total) AS top_1_share,
      sum(x) FILTER (i > n - 3) / any_value(total) AS top_3_share, sum(x) FILTER (i > n - 5) / any_value(total) AS top_5_share,
      sum(x) FILTER (i > n - 10) / any_value(total) AS top_10_share, sum(x) FILTER (i > n - ceil(n / 5)) / any_value(total) AS top_fifth_share FROM r""")  # fmt: skip
def _(t):
    return concentration(t("orders").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("x")), "x")


@query("a39_pareto", """
    WITH s AS (SELECT o_custkey, sum(o_totalprice) AS x FROM orders GROUP BY ALL),
    r AS (SELECT x, coalesce(sum(x) OVER (ORDER BY x DESC, o_custkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(x) OVER () AS total FROM s)
    SELECT count(*) FILTER (before < 0.8 * total) AS groups_needed, count(*) AS groups FROM r""")  # fmt: skip
def _(t):
    return A.pareto(t("orders"), "o_custkey", "o_totalprice")


@query("a40_segments", """
    WITH s AS (SELECT c_mktsegment, sum(c_acctbal) AS total, avg(c_acctbal) AS mean, stddev_samp(c_acctbal) AS sd, count(*) AS n FROM customer GROUP BY ALL)
    SELECT *, total / sum(total) OVER () AS share, sum(total) OVER (ORDER BY total DESC ROWS UNBOUNDED PRECEDING) / sum(total) OVER () AS cumulative_share,
      CAST(row_number() OVER (ORDER BY total DESC) AS INTEGER) AS rank, (total - avg(total) OVER ()) / stddev_samp(total) OVER () AS z FROM s""")  # fmt: skip
def _(t):
    return A.segments(t("customer"), "c_mktsegment", "c_acctbal")


DESCRIBED = ("l_quantity", "l_extendedprice", "l_discount")
# biased moments from central sums
PER_COLUMN = """
    SELECT '{c}' AS "column", count({c}) AS n, count(*) - count({c}) AS nulls, sum({c}) AS sum, avg({c}) AS mean, median({c}) AS median, min({c}) AS min, max({c}) AS max,
      var_samp({c}) AS variance, stddev_samp({c}) AS sd, skewness({c}) * (count({c}) - 2) / sqrt(count({c}) * (count({c}) - 1.0)) AS skewness, kurtosis_pop({c}) AS kurtosis,
      quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) AS iqr, quantile_cont({c}, 0.01) AS p1, quantile_cont({c}, 0.05) AS p5, quantile_cont({c}, 0.95) AS p95, quantile_cont({c}, 0.99) AS p99
    FROM lineitem"""


@query("a41_descriptive", " UNION ALL ".join(PER_COLUMN.format(c=c) for c in DESCRIBED))
def _(t):
    return A.descriptive(t("lineitem"), DESCRIBED)


@query("a42_trimmed_mean", """
    WITH r AS (SELECT o_totalprice AS x, row_number() OVER (ORDER BY o_totalprice) AS i, count(*) OVER () AS n FROM orders)
    SELECT avg(x) AS trimmed_mean, count(*) AS used FROM r WHERE i > floor(0.05 * n) AND i <= n - floor(0.05 * n)""")  # fmt: skip
def _(t):
    return trimmed_mean(t("orders"), "o_totalprice", 0.05)


@query("a42_distribution_profile", """
    WITH o AS (SELECT CAST(o_totalprice AS DOUBLE) AS v FROM orders), r AS (SELECT v, row_number() OVER (ORDER BY v) AS i, count(*) OVER () AS n FROM o),
    t AS (SELECT avg(v) AS trimmed_mean FROM r WHERE i > floor(0.05 * n) AND i <= n - floor(0.05 * n)),
    m AS (SELECT count(*) AS n, avg(v) AS mean, median(v) AS median, stddev_samp(v) AS sd, var_pop(v) AS var, quantile_cont(v, 0.1) AS p10, quantile_cont(v, 0.25) AS p25, quantile_cont(v, 0.5) AS p50, quantile_cont(v, 0.75) AS p75, quantile_cont(v, 0.9) AS p90, quantile_cont(v, 0.99) AS p99 FROM o)
    SELECT any_value(n) AS n, any_value(mean) AS mean, any_value(median) AS median, any_value(trimmed_mean) AS trimmed_mean, any_value(sd) AS sd, any_value(p75 - p25) AS iqr,
      avg(pow(v - mean, 3)) / pow(any_value(var), 1.5) AS skewness, avg(pow(v - mean, 4)) / pow(any_value(var), 2) - 3 AS kurtosis, any_value(p10) AS p10, any_value(p25) AS p25, any_value(p50) AS p50, any_value(p75) AS p75, any_value(p90) AS p90, any_value(p99) AS p99,
      count(*) FILTER (v < p25 - 1.5 * (p75 - p25) OR v > p75 + 1.5 * (p75 - p25)) AS outliers, count(*) FILTER (v < p25 - 3 * (p75 - p25) OR v > p75 + 3 * (p75 - p25)) AS extreme_outliers FROM o, m, t""")  # fmt: skip
def _(t):
    return distribution_profile(t("orders"), "o_totalprice")


@query("a43_rfm", """
    WITH c AS (SELECT o_custkey, count(*) AS f, sum(o_totalprice) AS m FROM orders GROUP BY ALL)
    SELECT count(*) AS customers, avg(CASE WHEN m < (SELECT median(m) FROM c) THEN 1.0 ELSE 0.0 END) AS below_median_share, avg(CASE WHEN f = 1 THEN 1.0 ELSE 0.0 END) AS single_order_share FROM c""")  # fmt: skip
def _(t):
    return A.rfm_summary(t("orders"), "o_custkey", "o_orderdate", "o_totalprice")


def churned(t):
    """Orders as subjects: finished or not is the event, open ones are unknown; the price stands for exposure."""
    return t("orders").withColumn("event", F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 0))


EVENT = "CASE o_orderstatus WHEN 'F' THEN 1.0 WHEN 'O' THEN 0.0 END"


@query("a44_a46_event_rates", f"""
    SELECT o_orderpriority, sum({EVENT}) AS events, count({EVENT}) AS known, avg({EVENT}) AS rate, sum(coalesce({EVENT}, 0)) / sum(o_totalprice) AS exposure_rate
    FROM orders GROUP BY o_orderpriority""")  # fmt: skip
def _(t):
    return A.event_rates(churned(t), "o_orderpriority", "event", "o_totalprice")


@query("a47_censoring", f"SELECT count(*) FILTER ({EVENT} = 1) AS events, count(*) FILTER ({EVENT} = 0) AS non_events, count(*) FILTER ({EVENT} IS NULL) AS censored FROM orders")
def _(t):
    return A.censoring(churned(t), "event")


@query("a48_stratified_rates", f"SELECT o_orderpriority, CAST(year(o_orderdate) AS VARCHAR) AS y, avg({EVENT}) AS rate, count({EVENT}) AS n FROM orders GROUP BY ALL")
def _(t):
    return A.stratified_rates(churned(t).withColumn("y", F.year("o_orderdate")), "o_orderpriority", "y", "event")


HOLED = "CASE WHEN o_totalprice < 50000 THEN NULL ELSE o_totalprice END"


def holed(t):
    return t("orders").withColumn("price", F.when(F.col("o_totalprice") >= 50000, F.col("o_totalprice")))


@query("a50_missingness", f"""
    WITH o AS (SELECT o_orderstatus, CASE WHEN {HOLED} IS NULL THEN 1.0 ELSE 0.0 END AS m FROM orders)
    SELECT o_orderstatus, avg(m) AS null_rate, count(*) AS n, (SELECT avg(m) FROM o) AS overall, avg(m) - (SELECT avg(m) FROM o) AS gap FROM o GROUP BY o_orderstatus""")  # fmt: skip
def _(t):
    return A.missingness(holed(t), "price", "o_orderstatus")


BOUNDS = f"""
    SELECT o_orderstatus, count(p) AS known, count(*) - count(p) AS missing, sum(p) + (count(*) - count(p)) * min(p) AS sum_low, sum(p) + (count(*) - count(p)) * max(p) AS sum_high,
      (sum(p) + (count(*) - count(p)) * min(p)) / count(*) AS mean_low, (sum(p) + (count(*) - count(p)) * max(p)) / count(*) AS mean_high
    FROM (SELECT o_orderstatus, {HOLED} AS p FROM orders) GROUP BY o_orderstatus"""


@query("a51_missingness_bounds", BOUNDS)
def _(t):
    return A.missingness_bounds(holed(t), "price", ["o_orderstatus"])


@query("a52_ranking_stability", f"""
    WITH b AS ({BOUNDS}), p AS (SELECT a.mean_low AS a_low, a.mean_high AS a_high, b.mean_low AS b_low, b.mean_high AS b_high FROM b a, b WHERE a.o_orderstatus = 'F' AND b.o_orderstatus = 'O')
    SELECT *, a_low > b_high OR b_low > a_high AS stable FROM p""")  # fmt: skip
def _(t):
    return A.ranking_stability(holed(t), "price", "o_orderstatus", "F", "O")
