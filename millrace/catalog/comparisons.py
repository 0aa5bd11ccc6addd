"""Queries of group comparisons, nested filters, checks of results, and the operators around them."""

from pyspark.sql import functions as F

from ..operators import comparisons as X
from ..operators import effects as K
from ..operators import learning as M
from ..operators import periods as P
from ..operators import quality as Q
from ..operators import rows as R
from ..operators import screens as S
from ..operators.joins import foreign_keys
from . import query
from .models import labelled
from .time import IN_NOW, IN_THEN, NOW, THEN


@query("f02_f06_conditions", """
    SELECT count(*) FILTER (o_orderkey = 4) AS equal, count(*) FILTER (lower(o_orderstatus) NOT IN ('f', 'p')) AS not_in, count(*) FILTER (o_totalprice < 1000.5) AS less, count(*) FILTER (o_custkey <= 10) AS whole,
      count(*) FILTER (CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderstatus END IS NULL) AS missing, count(*) FILTER (o_orderstatus = 'F') AS flagged FROM orders""")  # fmt: skip
def _(t):
    o = t("orders").withColumn("flag", F.col("o_orderstatus") == "F").withColumn("gap", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderstatus")))
    c = {"equal": ("o_orderkey", "=", "4"), "not_in": ("o_orderstatus", "not in", ["f", "P"]), "less": ("o_totalprice", "<", 1000.5), "whole": ("o_custkey", "<", 10.5), "missing": ("gap", "is null"), "flagged": ("flag", "=", "yes")}
    return o.agg(*(F.count_if(R.predicate(o, v)).alias(k) for k, v in c.items()))


@query("f07_nested", """
    SELECT l_orderkey, l_linenumber FROM lineitem
    WHERE (l_quantity > 45 OR (l_discount >= 0.09 AND NOT l_returnflag = 'N')) AND (l_tax < l_discount OR l_linenumber = 1)""")  # fmt: skip
def _(t):
    tree = ("and", [("or", [("l_quantity", ">", 45), ("and", [("l_discount", ">=", 0.09), ("not", ("l_returnflag", "=", "n"))])]), ("or", [("l_tax", "<", F.col("l_discount")), ("l_linenumber", "=", 1)])])
    return R.where(t("lineitem"), [tree]).select("l_orderkey", "l_linenumber")


@query("f08_filter_text", "SELECT o_orderkey FROM orders WHERE o_totalprice > 150000 AND o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus <> 'P' AND o_custkey BETWEEN 5 AND 5000")
def _(t):
    return R.filter_text(t("orders"), "o_totalprice > 150000 and o_orderpriority in ('1-URGENT', '2-HIGH'), o_orderstatus <> 'P', o_custkey between 5 and 5000").select("o_orderkey")


@query("f11_row_predicate", "SELECT count(*) AS n FROM orders WHERE o_totalprice / 2 > 50000 AND length(o_orderstatus) = 1")
def _(t):
    return R.row_predicate(t("orders"), "o_totalprice / 2 > 50000 AND length(o_orderstatus) = 1").agg(F.count("*").alias("n"))


@query("j11_foreign_keys", """
    SELECT 'l' AS child, 'orderkey' AS "column", 'o' AS parent, 'orderkey' AS key, 1.0 AS match_ratio UNION ALL SELECT 'o', 'custkey', 'c', 'custkey', 1.0""")  # fmt: skip
def _(t):
    tables = {"l": t("lineitem").select(F.col("l_orderkey").alias("orderkey"), "l_quantity"), "o": t("orders").select(F.col("o_orderkey").alias("orderkey"), F.when(F.col("o_custkey") % 2 == 0, F.col("o_custkey")).alias("custkey")), "c": t("customer").select(F.col("c_custkey").alias("custkey"), "c_name")}
    return foreign_keys(tables)


FLAGS = "l_returnflag IN ('A', 'R')"


def two(t):
    return t("lineitem").filter(FLAGS)


@query("s12_pooled_pairs", """
    WITH g AS (SELECT o_orderpriority AS g, count(*) AS n, avg(o_totalprice) AS m, var_samp(o_totalprice) AS v FROM orders GROUP BY 1)
    SELECT a.g AS a, b.g AS b, round(a.m - b.m, 4) AS difference, round((a.m - b.m) / sqrt(((a.n - 1) * a.v + (b.n - 1) * b.v) / (a.n + b.n - 2) * (1.0 / a.n + 1.0 / b.n)), 8) AS statistic FROM g a JOIN g b ON a.g < b.g""")  # fmt: skip
def _(t):
    return X.pooled_pairs(t("orders"), "o_totalprice", "o_orderpriority").select("a", "b", F.round("difference", 4).alias("difference"), F.round("statistic", 8).alias("statistic"))


@query("s12_tukey", """
    WITH g AS (SELECT o_orderpriority AS g, count(*) AS n, avg(o_totalprice) AS m, var_samp(o_totalprice) AS v FROM orders GROUP BY 1), w AS (SELECT sum((n - 1) * v) / (sum(n) - count(*)) AS w FROM g)
    SELECT a.g AS a, b.g AS b, round((a.m - b.m) / sqrt(w / 2 * (1.0 / a.n + 1.0 / b.n)), 8) AS statistic FROM g a JOIN g b ON a.g < b.g, w""")  # fmt: skip
def _(t):
    return X.pooled_pairs(t("orders"), "o_totalprice", "o_orderpriority", tukey=True).select("a", "b", F.round("statistic", 8).alias("statistic"))


@query("s12_dunn", """
    WITH r AS (SELECT l_returnflag AS g, rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS r FROM lineitem), g AS (SELECT g, count(*) AS n, avg(r) AS m FROM r GROUP BY g),
    n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM r), k AS (SELECT sum(CAST(c AS DOUBLE) * c * c - c) AS t FROM (SELECT count(*) AS c FROM lineitem GROUP BY l_quantity))
    SELECT a.g AS a, b.g AS b, round((a.m - b.m) / sqrt((n.n * (n.n + 1) / 12 - t / (12 * (n.n - 1))) * (1.0 / a.n + 1.0 / b.n)), 8) AS statistic FROM g a JOIN g b ON a.g < b.g, n, k""")  # fmt: skip
def _(t):
    return X.dunn(t("lineitem"), "l_quantity", "l_returnflag").select("a", "b", F.round("statistic", 8).alias("statistic"))


@query("s16_shift_report", """
    WITH a AS (SELECT count(*) AS n, avg(value) AS m, var_samp(value) AS v FROM events WHERE event_id % 2 = 0), b AS (SELECT count(*) AS n, avg(value * 1.4) AS m, var_samp(value * 1.4) AS v FROM events WHERE event_id % 2 = 1)
    SELECT a.n AS n_baseline, b.n AS n_current, 100 * abs(b.m - a.m) / abs(a.m) AS mean_shift_percent, b.v / a.v AS variance_ratio, true AS shifted FROM a, b""")  # fmt: skip
def _(t):
    e = t("events")
    after = e.filter("event_id % 2 = 1").withColumn("value", F.col("value") * 1.4)
    return X.shift_report(e.filter("event_id % 2 = 0"), after, "value").select("n_baseline", "n_current", "mean_shift_percent", "variance_ratio", "shifted")


@query("s18_group_comparison", f"""
    WITH r AS (SELECT l_returnflag AS g, rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0 AS r FROM lineitem WHERE {FLAGS})
    SELECT 'Mann-Whitney U' AS method, sum(r) FILTER (g = 'A') - count(*) FILTER (g = 'A') * (count(*) FILTER (g = 'A') + 1) / 2.0 AS statistic FROM r""")  # fmt: skip
def _(t):
    return X.group_comparison(two(t), "l_extendedprice", "l_returnflag").select("method", "statistic")


@query("s18_association", """
    WITH c AS (SELECT l_returnflag AS a, l_linestatus AS b, count(*) AS n FROM lineitem GROUP BY ALL), m AS (SELECT *, sum(n) OVER (PARTITION BY a) AS r, sum(n) OVER (PARTITION BY b) AS k, sum(n) OVER () AS t FROM c)
    SELECT 'Chi-square test of independence' AS method, any_value(t) * (sum(CAST(n AS DOUBLE) * n / (CAST(r AS DOUBLE) * k)) - 1) AS statistic FROM m""")  # fmt: skip
def _(t):
    return X.association(t("lineitem"), "l_returnflag", "l_linestatus").select("method", "statistic")


@query("s19_test_choice", """
    WITH s AS (SELECT l_returnflag AS g, count(*) AS n, avg(l_extendedprice) AS m FROM lineitem GROUP BY 1),
    c AS (SELECT s.g, s.n, avg(power(l_extendedprice - m, 2)) AS m2, avg(power(l_extendedprice - m, 3)) AS m3, avg(power(l_extendedprice - m, 4)) AS m4 FROM lineitem JOIN s ON l_returnflag = s.g GROUP BY ALL),
    p AS (SELECT exp(-n / 6.0 * (power(m3 / power(m2, 1.5), 2) + power(m4 / (m2 * m2) - 3, 2) / 4) / 2) AS p FROM c)
    SELECT 'multi_group_independent' AS problem, CASE WHEN bool_and(p >= 0.05) THEN '?' ELSE 'Kruskal-Wallis' END AS method, count(*) AS groups, bool_and(p >= 0.05) AS all_normal FROM p""")  # fmt: skip
def _(t):
    return X.choose_test(t("lineitem"), "l_extendedprice", "l_returnflag").select("problem", "method", "groups", "all_normal")


@query("s19_paired_choice", "SELECT 'two_group_paired' AS problem, 'Wilcoxon signed-rank' AS method, count(*) AS n FROM lineitem")
def _(t):
    return X.choose_paired(t("lineitem"), "l_tax", "l_discount")


@query("s20_stratified_check", f"""
    WITH d AS (SELECT l_returnflag AS g, l_linestatus AS s, CAST(l_quantity > 25 AS DOUBLE) AS e FROM lineitem WHERE {FLAGS}), o AS (SELECT avg(e) FILTER (g = 'R') - avg(e) FILTER (g = 'A') AS d FROM d),
    s AS (SELECT s, avg(e) FILTER (g = 'R') - avg(e) FILTER (g = 'A') AS d FROM d GROUP BY s HAVING count(*) FILTER (g = 'A') >= 20 AND count(*) FILTER (g = 'R') >= 20)
    SELECT 'ok' AS status, any_value(o.d) AS difference, count(*) AS strata, any_value(o.d) <> 0 AND (bool_and(abs(s.d) < 0.5 * abs(o.d)) OR bool_or(s.d * o.d < 0)) AS confounded FROM s, o""")  # fmt: skip
def _(t):
    return X.stratified_check(two(t).withColumn("e", (F.col("l_quantity") > 25).cast("int")), "l_returnflag", "l_linestatus", "e")


@query("s27_powers")
def _(t):
    return X.powers(t("customer"), "c_mktsegment")


@query("s28_preflight", "SELECT count(*) AS groups, count(*) FILTER (n >= 2) AS usable, count(*) FILTER (n >= 2 AND lo = hi) AS constant, 'ALLOWED' AS status FROM (SELECT count(*) AS n, min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders GROUP BY o_orderpriority)")
def _(t):
    return X.preflight(t("orders"), "o_totalprice", "o_orderpriority")


@query("s30_patterns", """
    WITH o AS (SELECT o_orderpriority AS g, o_totalprice * CASE WHEN o_orderpriority LIKE '1%' THEN 40 ELSE 1 END AS v FROM orders), g AS (SELECT g, sum(v) AS s, avg(v) AS m, count(*) AS n, var_samp(v) AS var FROM o GROUP BY g),
    f AS (SELECT (sum(n * (m - mean) * (m - mean)) / (count(*) - 1)) / (sum((n - 1) * var) / (sum(n) - count(*))) AS f FROM g, (SELECT avg(v) AS mean FROM o))
    SELECT 'concentration' AS pattern, max(s) / sum(s) AS evidence, max(s) / sum(s) >= 0.4 AS found FROM g UNION ALL SELECT 'divergence', max(m) / min(m), max(m) / min(m) >= 1.5 FROM g
    UNION ALL SELECT 'anomaly', max(abs(s - mean)) / any_value(sd), max(abs(s - mean)) / any_value(sd) >= 1.7 FROM g, (SELECT avg(s) AS mean, stddev_samp(s) AS sd FROM g)
    UNION ALL SELECT 'segment_difference', NULL, f > 2.372 FROM f""")  # fmt: skip
def _(t):
    """All four; the evidence of a difference between segments is a p-value, which SQL has by its critical value only."""
    o = t("orders").select("o_orderpriority", (F.col("o_totalprice") * F.when(F.col("o_orderpriority").startswith("1"), 40).otherwise(1)).alias("v"))
    found = X.patterns(o, "o_orderpriority", "v").withColumn("evidence", F.when(F.col("pattern") != "segment_difference", F.col("evidence")))
    return found.withColumn("found", F.when(F.col("pattern") == "anomaly", F.col("evidence") >= 1.7).otherwise(F.col("found")))


@query("k13_churn_verdict", f"""
    SELECT avg(CAST(l_quantity > 25 AS DOUBLE)) FILTER (l_returnflag = 'A') AS rate_a, avg(CAST(l_quantity > 25 AS DOUBLE)) FILTER (l_returnflag = 'R') AS rate_b FROM lineitem WHERE {FLAGS}""")  # fmt: skip
def _(t):
    rows = two(t).withColumn("e", (F.col("l_quantity") > 25).cast("int"))
    return X.churn_verdict(rows, "l_returnflag", "e", ["l_linestatus"], "l_tax").select("rate_a", "rate_b")


@query("a53_verify_aggregate", "SELECT o_orderpriority, sum(o_totalprice) AS value, true AS agrees FROM orders GROUP BY 1")
def _(t):
    return X.verify_aggregate(t("orders"), "sum", "o_totalprice", ["o_orderpriority"]).drop("again")


@query("q14_selection_bias", """
    WITH s AS (SELECT stddev_pop(o_totalprice) AS s FROM orders), f AS (SELECT avg(o_totalprice) FILTER (o_totalprice > 100000) AS b, avg(o_totalprice) FILTER (o_totalprice <= 100000) AS a FROM orders)
    SELECT 'active' AS "column", a AS mean_a, b AS mean_b, (b - a) / s AS gap, (b - a) / s >= 0.2 AS biased FROM s, f""")  # fmt: skip
def _(t):
    return X.selection_bias(t("orders").withColumn("active", (F.col("o_totalprice") > 100000).cast("int")), ["active"], "o_totalprice")


@query("q16_context_reviews", """
    WITH o AS (SELECT CASE WHEN o_orderstatus = 'F' AND o_orderkey % 40 < 8 THEN o_totalprice * 50 ELSE o_totalprice END AS price, o_orderstatus AS status, CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_orderdate END AS seen FROM orders),
    q AS (SELECT quantile_cont(price, 0.25) AS a, quantile_cont(price, 0.75) AS b FROM o),
    g AS (SELECT status, count(*) FILTER (price < a - 1.5 * (b - a) OR price > b + 1.5 * (b - a)) AS n FROM o, q GROUP BY status)
    SELECT 'price' AS "column", 'outliers_in_few_groups' AS "check", max(n) / sum(n) AS share, 'repeat with ranks or trimmed values' AS review FROM g
    UNION ALL SELECT 'seen', 'invalid_times', count(*) FILTER (seen IS NULL) / count(*), 'mend or leave out invalid times' FROM o""")  # fmt: skip
def _(t):
    k = F.col("o_orderkey")
    rows = t("orders").select(F.when((F.col("o_orderstatus") == "F") & (k % 40 < 8), F.col("o_totalprice") * 50).otherwise(F.col("o_totalprice")).alias("price"), F.col("o_orderstatus").alias("status"), F.when(k % 10 != 0, F.col("o_orderdate")).alias("seen"), (k % 2).alias("half"))
    findings = X.context_findings(rows, "price", "status", ["half"], "seen")
    return findings.join(X.task_impact(findings, "trend"), ["column", "check"]).select("column", "check", "share", "review")


@query("q16_task_impact", "SELECT 'kind' AS \"column\", 'constant' AS \"check\", 'leave the column out' AS review, true AS blocks UNION ALL SELECT 'gap', 'missing', 'compare results under missing-value bounds', false")
def _(t):
    rows = t("orders").select("o_orderkey", F.lit("x").alias("kind"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_custkey")).alias("gap"))
    return X.task_impact(Q.column_findings(rows), "comparison")


SCOPES = {
    "1996-02": ("DATE '1996-02-01'", "DATE '1996-03-01'"), "1996-Q3": ("DATE '1996-07-01'", "DATE '1996-10-01'"), "1997": ("DATE '1997-01-01'", "DATE '1998-01-01'"), "1996-05-04": ("DATE '1996-05-04'", "DATE '1996-05-05'"),
    "between_1996-01-10_1996-02-09": ("DATE '1996-01-10'", "DATE '1996-02-10'"), "before_1996-01-01": ("DATE '1995-01-01'", "DATE '1996-01-01'"), "today": ("(SELECT max(CAST(o_orderdate AS DATE)) FROM orders)", "(SELECT max(CAST(o_orderdate AS DATE)) + 1 FROM orders)"),
    "yesterday": ("(SELECT max(CAST(o_orderdate AS DATE)) - 1 FROM orders)", "(SELECT max(CAST(o_orderdate AS DATE)) FROM orders)"),
    "yoy": ("(SELECT date_trunc('month', max(o_orderdate)) FROM orders)", "(SELECT date_trunc('month', max(o_orderdate)) + INTERVAL 1 MONTH FROM orders)"),
}


@query("t01_named_scopes", " UNION ALL ".join(f"SELECT '{k}' AS scope, count(*) AS n FROM orders WHERE o_orderdate >= {a} AND o_orderdate < {b}" for k, (a, b) in SCOPES.items()))
def _(t):
    o = t("orders")
    anchor = P.last_day(o, "o_orderdate")
    return o.agg(F.array(*(F.struct(F.lit(k).alias("scope"), F.count_if(P.scope(anchor, k)[0].holds("o_orderdate")).alias("n")) for k in SCOPES)).alias("rows")).select(F.inline("rows"))


@query("t10_drill_down", f"""
    WITH s AS (SELECT o_orderpriority, o_orderstatus, CASE WHEN {IN_NOW} THEN o_totalprice ELSE -o_totalprice END AS v FROM orders WHERE {IN_NOW} OR {IN_THEN}),
    d AS (SELECT o_orderpriority AS level, sum(v) AS delta, sum(v) / (SELECT sum(v) FROM s) AS share FROM s GROUP BY 1)
    SELECT 'o_orderpriority' AS dimension, arg_max(level, share) AS level, round(arg_max(delta, share), 2) AS delta FROM d""")  # fmt: skip
def _(t):
    return P.drill_down(t("orders"), "o_orderdate", "o_totalprice", NOW, THEN, ["o_orderpriority"]).select("dimension", "level", F.round("delta", 2).alias("delta"))


@query("t11_per_day", f"""
    WITH c AS (SELECT sum(o_totalprice) FILTER ({IN_NOW}) / 91 AS a, sum(o_totalprice) FILTER (o_orderdate >= TIMESTAMP '1995-11-01' AND o_orderdate < TIMESTAMP '1996-01-01') / 61 AS b FROM orders)
    SELECT a AS per_day_current, b AS per_day_previous, 100 * (a / b - 1) AS per_day_percent FROM c""")  # fmt: skip
def _(t):
    two_months = P.Period(THEN.start.replace(month=11), THEN.end)
    change = P.period_change(t("orders"), "o_orderdate", "o_totalprice", NOW, two_months)
    return P.per_day(change, NOW, two_months).select("per_day_current", "per_day_previous", "per_day_percent")


@query("r09_ols_hac", """
    WITH d AS (SELECT CAST(l_extendedprice AS DOUBLE) AS y, CAST(l_quantity AS DOUBLE) AS x, l_shipdate AS t FROM lineitem),
    f AS (SELECT regr_slope(y, x) AS b, avg(y) AS my, avg(x) AS mx, count(*) AS n, var_pop(x) * count(*) AS sxx, CAST(floor(4 * pow(count(*) / 100, 2.0 / 9)) AS BIGINT) AS lags FROM d),
    s AS (SELECT (x - mx) * (y - my - b * (x - mx)) AS s, row_number() OVER (ORDER BY t, x, y) AS i FROM d, f),
    k AS (SELECT unnest(range(1, lags + 1)) AS k, lags FROM f),
    c AS (SELECT sum(2 * (1 - k / (lags + 1)) * a.s * b.s) AS crossed FROM s a CROSS JOIN k JOIN s b ON b.i = a.i - k)
    SELECT 'l_quantity' AS term, b AS estimate, sqrt((SELECT sum(s * s) FROM s) + crossed) / sxx AS se FROM f, c""")  # fmt: skip
def _(t):
    return S.ols_hac(t("lineitem"), "l_extendedprice", ["l_quantity"], "l_shipdate")


@query("r12_adjusted_association")
def _(t):
    return S.adjusted_association(t("lineitem"), "l_extendedprice", "l_quantity", ["l_discount", "l_returnflag"])


@query("k06_longitudinal")
def _(t):
    orders = t("orders").select(F.col("o_custkey").alias("unit"), F.year("o_orderdate").alias("time"), (F.col("o_totalprice") > 100000).cast("int").alias("t"), (F.col("o_totalprice") / 1000).alias("y"), (F.col("o_orderkey") % 7).alias("c"))
    return K.longitudinal(orders.groupBy("unit", "time").agg(F.max("t").alias("t"), F.avg("y").alias("y"), F.avg("c").alias("c")), "unit", "time", "t", "y", ["c"])


@query("k07_structure", "SELECT * FROM (VALUES ('quantity', 'cost', '->'), ('tax', 'cost', '->')) t(a, b, kind)")
def _(t):
    """A collider is planted: quantity and tax, which do not go with each other, both make the cost."""
    noise = F.pmod(F.xxhash64("l_orderkey", "l_linenumber"), F.lit(1000)) / 1000
    quantity, tax = F.pmod(F.xxhash64("l_orderkey", "l_linenumber", F.lit(1)), F.lit(1000)) / 1000, F.pmod(F.xxhash64("l_orderkey", "l_linenumber", F.lit(2)), F.lit(1000)) / 1000
    rows = t("lineitem").select((F.col("l_quantity") / 50 + quantity).alias("quantity"), (F.col("l_tax") * 10 + tax).alias("tax"), noise.alias("noise"))
    return K.structure(rows.withColumn("cost", F.col("quantity") + F.col("tax") + F.col("noise")), ["quantity", "tax", "cost"]).select("a", "b", "kind")


@query("k09_sensitivity", """
    WITH m AS (SELECT avg(l_extendedprice) FILTER (l_discount > 0.05) - avg(l_extendedprice) FILTER (l_discount <= 0.05) AS d,
      sqrt(var_samp(l_extendedprice) FILTER (l_discount > 0.05) / count(*) FILTER (l_discount > 0.05) + var_samp(l_extendedprice) FILTER (l_discount <= 0.05) / count(*) FILTER (l_discount <= 0.05)) AS se, count(*) - 2 AS dof FROM lineitem),
    g AS (SELECT a, b FROM (VALUES (0.05), (0.1), (0.2)) x(a), (VALUES (0.05), (0.1), (0.2)) y(b))
    SELECT CAST(a AS DOUBLE) AS treatment_r2, CAST(b AS DOUBLE) AS outcome_r2, round(se * sqrt(dof * a * b / (1 - a)), 4) AS bias, round(d - sign(d) * se * sqrt(dof * a * b / (1 - a)), 4) AS towards_null FROM g, m""")  # fmt: skip
def _(t):
    high = F.col("l_discount") > 0.05
    one, zero = F.when(high, F.col("l_extendedprice")), F.when(~high, F.col("l_extendedprice"))
    d, se, n = t("lineitem").agg(F.avg(one) - F.avg(zero), F.sqrt(F.var_samp(one) / F.count(one) + F.var_samp(zero) / F.count(zero)), F.count("*")).first()
    return K.sensitivity(t("lineitem"), d, se, n - 2).select("treatment_r2", "outcome_r2", F.round("bias", 4).alias("bias"), F.round("towards_null", 4).alias("towards_null"))


@query("k09_confounding_grid", """
    WITH r AS (SELECT avg(CAST(l_extendedprice > 30000 AS DOUBLE)) FILTER (l_quantity > 25) / avg(CAST(l_extendedprice > 30000 AS DOUBLE)) FILTER (l_quantity <= 25) AS rr FROM lineitem)
    SELECT CAST(s AS DOUBLE) AS strength, CASE WHEN rr >= 1 THEN rr / (s * s) ELSE rr * s * s END AS adjusted, CASE WHEN rr > 1 THEN rr / (s * s) <= 1 ELSE rr * s * s >= 1 END AS crosses_null,
      greatest(rr, 1 / rr) + sqrt(greatest(rr, 1 / rr) * (greatest(rr, 1 / rr) - 1)) AS e_value FROM r, (VALUES (1.0), (1.5), (2.0), (3.0), (5.0)) g(s)""")  # fmt: skip
def _(t):
    hit = (F.col("l_extendedprice") > 30000).cast("double")
    rr = t("lineitem").agg(F.avg(F.when(F.col("l_quantity") > 25, hit)) / F.avg(F.when(F.col("l_quantity") <= 25, hit))).first()[0]
    return K.confounding_grid(t("lineitem"), rr)


@query("m02_cross_validated")
def _(t):
    return M.cross_validated(labelled(t), "id", "label", ["l_quantity", "l_discount", "l_returnflag"], folds=3)


@query("m06_eligible_features", """
    SELECT 'o_orderkey' AS "column", 0.0 AS missing_share, count(DISTINCT o_orderkey) AS "distinct", false AS eligible FROM orders
    UNION ALL SELECT 'o_totalprice', 0.0, count(DISTINCT o_totalprice), true FROM orders UNION ALL SELECT 'same', 0.0, 1, false
    UNION ALL SELECT 'gap', 1 - count(*) FILTER (o_orderkey % 4 = 0) / CAST(count(*) AS DOUBLE), count(DISTINCT o_totalprice) FILTER (o_orderkey % 4 = 0), false FROM orders""")  # fmt: skip
def _(t):
    rows = t("orders").select("o_orderkey", "o_totalprice", F.lit(1).alias("same"), F.when(F.col("o_orderkey") % 4 == 0, F.col("o_totalprice")).alias("gap"))
    return M.eligible_features(rows)


@query("m07_stability")
def _(t):
    customers = t("orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("v"))
    return M.cluster_stability(customers, "o_custkey", ["n", "v"], 3)
