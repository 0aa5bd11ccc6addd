"""Queries of tests, associations and regressions. SQL gives the statistics; tail probabilities are tested apart."""

from pyspark.sql import functions as F

from ..operators import inference as I
from ..operators import resampling as R
from . import query


def two(t):
    """Line items of two return flags."""
    return t("lineitem").filter("l_returnflag IN ('A', 'R')")


G2 = """WITH g AS (SELECT l_returnflag AS g, count(*) AS n, avg(l_extendedprice) AS m, var_samp(l_extendedprice) AS v FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY 1),
    p AS (SELECT a.n AS n1, b.n AS n2, a.m AS m1, b.m AS m2, a.v AS v1, b.v AS v2 FROM g a, g b WHERE a.g = 'A' AND b.g = 'R')"""


@query("s01_welch", f"{G2} SELECT (m1 - m2) / sqrt(v1 / n1 + v2 / n2) AS statistic, m1 - m2 AS difference, n1 AS n_a, n2 AS n_b FROM p")
def _(t):
    return I.t_test(two(t), "l_extendedprice", "l_returnflag").select("statistic", "difference", "n_a", "n_b")


@query("s02_pooled", f"{G2}, q AS (SELECT *, ((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) AS s FROM p) SELECT (m1 - m2) / sqrt(s * (1.0 / n1 + 1.0 / n2)) AS statistic, (m1 - m2) / sqrt(s) AS cohens_d FROM q")
def _(t):
    return I.t_test(two(t), "l_extendedprice", "l_returnflag", pooled=True).select("statistic", "cohens_d")


@query("s03_paired", "SELECT avg(l_tax - l_discount) / (stddev_samp(l_tax - l_discount) / sqrt(count(*))) AS statistic, avg(l_tax - l_discount) AS difference FROM lineitem")
def _(t):
    return I.paired_t(t("lineitem"), "l_tax", "l_discount").select("statistic", "difference")


@query("s04_wilcoxon", """
    WITH d AS (SELECT l_quantity - 25.5 AS d FROM lineitem WHERE l_quantity <> 25.5), r AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2.0 AS r FROM d)
    SELECT sum(r) FILTER (d > 0) AS statistic, count(*) AS n FROM r""")  # fmt: skip
def _(t):
    return I.wilcoxon(t("lineitem").withColumn("mid", F.lit(25.5)), "l_quantity", "mid").select("statistic", "n")


RANKS = "SELECT {g} AS g, rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS r FROM lineitem WHERE l_returnflag IN ({flags})"


@query("s05_mann_whitney", f"WITH r AS ({RANKS.format(g='l_returnflag', flags=chr(39) + 'A' + chr(39) + ', ' + chr(39) + 'R' + chr(39))}) SELECT sum(r) FILTER (g = 'A') - count(*) FILTER (g = 'A') * (count(*) FILTER (g = 'A') + 1) / 2.0 AS statistic, count(*) FILTER (g = 'A') AS n_a FROM r")
def _(t):
    return I.mann_whitney(two(t), "l_quantity", "l_returnflag").select("statistic", "n_a")


@query("s06_anova", """
    WITH g AS (SELECT count(*) AS n, avg(o_totalprice) AS m, var_samp(o_totalprice) AS v FROM orders GROUP BY o_orderpriority), t AS (SELECT sum(n * m) / sum(n) AS mm, sum(n) AS nn, count(*) AS k FROM g)
    SELECT (sum(n * (m - mm) * (m - mm)) / (any_value(k) - 1)) / (sum((n - 1) * v) / (any_value(nn) - any_value(k))) AS statistic, sum(n * (m - mm) * (m - mm)) / (sum(n * (m - mm) * (m - mm)) + sum((n - 1) * v)) AS eta_squared FROM g, t""")  # fmt: skip
def _(t):
    return I.anova(t("orders"), "o_totalprice", "o_orderpriority").select("statistic", "eta_squared")


@query("s07_welch_anova", """
    WITH g AS (SELECT count(*) AS n, avg(o_totalprice) AS m, var_samp(o_totalprice) AS v FROM orders GROUP BY o_orderpriority), w AS (SELECT *, n / v AS w FROM g),
    a AS (SELECT count(*) AS k, sum(w) AS ws, sum(w * m) / sum(w) AS mm FROM w), l AS (SELECT sum((1 - w / ws) * (1 - w / ws) / (n - 1)) AS lack, sum(w * (m - mm) * (m - mm)) AS b FROM w, a)
    SELECT b / (k - 1) / (1 + 2 * (k - 2) / CAST(k * k - 1 AS DOUBLE) * lack) AS statistic, k - 1 AS df_between, (k * k - 1) / (3 * lack) AS df_within, 'ok' AS status FROM a, l""")  # fmt: skip
def _(t):
    return I.anova(t("orders"), "o_totalprice", "o_orderpriority", welch=True).drop("p_value")


@query("s08_kruskal", """
    WITH r AS (SELECT l_returnflag AS g, rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS r FROM lineitem),
    s AS (SELECT sum(r) * sum(r) / count(*) AS q FROM r GROUP BY g), n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM lineitem),
    t AS (SELECT sum(CAST(c AS DOUBLE) * c * c - c) AS ties FROM (SELECT count(*) AS c FROM lineitem GROUP BY l_quantity))
    SELECT (12 / (n * (n + 1)) * (SELECT sum(q) FROM s) - 3 * (n + 1)) / (1 - ties / (n * n * n - n)) AS statistic, CAST(n AS BIGINT) AS n FROM n, t""")  # fmt: skip
def _(t):
    return I.kruskal(t("lineitem"), "l_quantity", "l_returnflag").select("statistic", "n")


@query("s09_chi_square", """
    WITH c AS (SELECT l_returnflag AS a, l_linestatus AS b, count(*) AS n FROM lineitem GROUP BY ALL), m AS (SELECT *, sum(n) OVER (PARTITION BY a) AS r, sum(n) OVER (PARTITION BY b) AS k, sum(n) OVER () AS t FROM c),
    x AS (SELECT any_value(t) * (sum(CAST(n AS DOUBLE) * n / (CAST(r AS DOUBLE) * k)) - 1) AS chi, any_value(t) AS t, least(count(DISTINCT a), count(DISTINCT b)) - 1 AS k FROM m)
    SELECT chi AS statistic, sqrt(chi / (t * k)) AS cramers_v, CAST(t AS BIGINT) AS n FROM x""")  # fmt: skip
def _(t):
    return I.chi_square(t("lineitem"), "l_returnflag", "l_linestatus").select("statistic", "cramers_v", "n")


@query("s10_fisher", "SELECT (count(*) FILTER (q = 1 AND x = 1) * count(*) FILTER (q = 0 AND x = 0)) / CAST(count(*) FILTER (q = 1 AND x = 0) * count(*) FILTER (q = 0 AND x = 1) AS DOUBLE) AS odds_ratio, count(*) AS n FROM (SELECT CAST(p_size > 25 AS INTEGER) AS q, CAST(p_retailprice > 1400 AS INTEGER) AS x FROM part)")
def _(t):
    return I.fisher_exact(t("part").select((F.col("p_size") > 25).cast("int").alias("q"), (F.col("p_retailprice") > 1400).cast("int").alias("x")), "q", "x").select("odds_ratio", "n")


@query("s11_corrected_p", """
    WITH p AS (SELECT p_type AS id, avg(p_retailprice) * count(*) / 1e6 AS p_value FROM part GROUP BY p_type), r AS (SELECT *, row_number() OVER (ORDER BY p_value) AS i, count(*) OVER () AS m FROM p)
    SELECT id, p_value, least(1.0, m * p_value) AS bonferroni, least(1.0, max((m - i + 1) * p_value) OVER (ORDER BY p_value ROWS UNBOUNDED PRECEDING)) AS holm,
      least(1.0, min(m * p_value / i) OVER (ORDER BY p_value ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS benjamini_hochberg FROM r""")  # fmt: skip
def _(t):
    return I.adjusted(t("part").groupBy(F.col("p_type").alias("id")).agg((F.avg("p_retailprice") * F.count("*") / 1e6).alias("p_value")))


ECDF = """
    WITH b AS (SELECT l_extendedprice AS v, 0 AS s FROM lineitem WHERE l_returnflag = 'A' UNION ALL SELECT l_extendedprice, 1 FROM lineitem WHERE l_returnflag = 'R'),
    c AS (SELECT v, sum(1 - s) AS a, sum(s) AS r FROM b GROUP BY v),
    f AS (SELECT v, sum(a) OVER w / CAST(sum(a) OVER () AS DOUBLE) AS f0, sum(r) OVER w / CAST(sum(r) OVER () AS DOUBLE) AS f1, lead(v) OVER (ORDER BY v) AS nv FROM c WINDOW w AS (ORDER BY v ROWS UNBOUNDED PRECEDING))"""


def sides(t):
    return t("lineitem").filter("l_returnflag = 'A'"), t("lineitem").filter("l_returnflag = 'R'")


@query("s14_ks", f"{ECDF} SELECT max(abs(f0 - f1)) AS statistic FROM f")
def _(t):
    return I.ks_test(*sides(t), "l_extendedprice").select("statistic")


@query("s15_wasserstein", f"{ECDF} SELECT sum(abs(f0 - f1) * (nv - v)) AS distance FROM f")
def _(t):
    return I.wasserstein(*sides(t), "l_extendedprice")


@query("s17_two_rates", """
    WITH g AS (SELECT l_returnflag AS g, CAST(count(*) AS DOUBLE) AS n, avg(CAST(l_quantity > 25 AS INTEGER)) AS p FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY 1),
    w AS (SELECT *, 1.959963984540054 AS z FROM g), i AS (SELECT g, n, p, (p + z * z / (2 * n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n) AS l, (p + z * z / (2 * n) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n) AS u FROM w),
    x AS (SELECT a.p AS p1, b.p AS p2, a.n AS n1, b.n AS n2, a.l AS l1, a.u AS u1, b.l AS l2, b.u AS u2, (a.p * a.n + b.p * b.n) / (a.n + b.n) AS p FROM i a, i b WHERE a.g = 'A' AND b.g = 'R')
    SELECT p1 - p2 AS difference, p1 - p2 - sqrt((p1 - l1) * (p1 - l1) + (u2 - p2) * (u2 - p2)) AS low, p1 - p2 + sqrt((u1 - p1) * (u1 - p1) + (p2 - l2) * (p2 - l2)) AS high,
      round((p1 - p2) * (p1 - p2) / (p * (1 - p) * (1 / n1 + 1 / n2)), 6) AS statistic, p1 AS rate_a, p2 AS rate_b FROM x""")  # fmt: skip
def _(t):
    found = I.two_rates(two(t).withColumn("late", (F.col("l_quantity") > 25).cast("int")), "late", "l_returnflag")
    return found.drop("p_value").withColumn("statistic", F.round("statistic", 6))


@query("s21_simpson", """
    WITH c AS (SELECT l_returnflag AS g, l_linestatus AS s, count(*) AS n, sum(l_quantity) AS q FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY ALL),
    w AS (SELECT s, sum(n) FILTER (g = 'A') AS n0, sum(n) FILTER (g = 'R') AS n1, sum(q) FILTER (g = 'A') AS q0, sum(q) FILTER (g = 'R') AS q1 FROM c GROUP BY s),
    m AS (SELECT sum(q0) / sum(n0) - sum(q1) / sum(n1) AS marginal, sum((q0 / n0 - q1 / n1) * (n0 + n1)) / sum(n0 + n1) AS within, count(*) AS strata FROM w WHERE n0 IS NOT NULL AND n1 IS NOT NULL)
    SELECT *, sign(marginal) * sign(within) < 0 AS reversed FROM m""")  # fmt: skip
def _(t):
    return I.simpson(two(t), "l_quantity", "l_returnflag", "l_linestatus")


@query("s23_specification_curve", """
    WITH q AS (SELECT quantile_cont(o_totalprice, 0.01) AS a, quantile_cont(o_totalprice, 0.05) AS b, quantile_cont(o_totalprice, 0.95) AS c, quantile_cont(o_totalprice, 0.99) AS d FROM orders),
    x AS (SELECT o_orderpriority AS g, o_totalprice AS v, t FROM orders, q, (VALUES ('none'), ('1%'), ('5%')) s(t) WHERE t = 'none' OR t = '1%' AND o_totalprice BETWEEN a AND d OR t = '5%' AND o_totalprice BETWEEN b AND c),
    m AS (SELECT t, g, sum(v) AS s, avg(v) AS m, median(v) AS d FROM x GROUP BY t, g),
    l AS (SELECT t AS trim, 'sum' AS aggregate, arg_max(g, s) AS leader FROM m GROUP BY t UNION ALL SELECT t, 'mean', arg_max(g, m) FROM m GROUP BY t UNION ALL SELECT t, 'median', arg_max(g, d) FROM m GROUP BY t)
    SELECT *, leader = (SELECT leader FROM l WHERE trim = 'none' AND aggregate = 'mean') AS agrees FROM l""")  # fmt: skip
def _(t):
    return I.specification_curve(t("orders"), "o_orderpriority", "o_totalprice")


@query("s25_bootstrap", """
    SELECT statistic, round(estimate, 6) AS estimate, n, true AS holds_it, true AS wide_as_theory_says FROM (
      SELECT 'mean' AS statistic, avg(o_totalprice) AS estimate, count(*) AS n FROM orders UNION ALL
      SELECT 'ratio', sum(l_tax) / sum(l_discount), count(*) FROM lineitem UNION ALL
      SELECT 'median', median(o_totalprice), count(*) FROM orders)""")  # fmt: skip
def _(t):
    """Bootstrap intervals against those of theory: a mean's and a ratio's by their linearised errors, a median's by the share of rows below its ends."""
    orders, lines = t("orders"), t("lineitem").withColumn("key", F.concat_ws("-", "l_orderkey", "l_linenumber"))
    o, l = orders.select(F.col("o_totalprice").cast("double").alias("v"), "o_orderkey"), lines.select(F.col("l_tax").cast("double").alias("v"), F.col("l_discount").cast("double").alias("b"), "key")  # noqa: E741
    z, parts = 1.959964, []
    r = l.agg((F.sum("v") / F.sum("b")).alias("r"), F.avg("b").alias("mb"))
    ratio_error = l.crossJoin(F.broadcast(r)).agg((F.stddev_samp(F.col("v") - F.col("r") * F.col("b")) / F.first("mb") / F.sqrt(F.count("*"))).alias("width"))
    for name, found, width in (
        ("mean", R.bootstrap(o, "v", "o_orderkey"), o.agg((F.stddev_samp("v") / F.sqrt(F.count("*"))).alias("width"))),
        ("ratio", R.bootstrap(l, "v", "key", "ratio", "b"), ratio_error),
    ):
        near = ((F.col("high") - F.col("low")) / (2 * z * F.col("width"))).between(0.75, 1.3)
        parts.append(found.crossJoin(width).select(F.lit(name).alias("statistic"), F.round("estimate", 6).alias("estimate"), "n", F.col("estimate").between(F.col("low"), F.col("high")).alias("holds_it"), near.alias("wide_as_theory_says")))
    median = R.bootstrap(o, "v", "o_orderkey", "quantile")
    inside = o.crossJoin(F.broadcast(median)).groupBy("estimate", "low", "high", "n").agg(F.avg((F.col("v") < F.col("low")).cast("double")).alias("a"), F.avg((F.col("v") < F.col("high")).cast("double")).alias("b"))
    near = ((F.col("b") - F.col("a")) * F.sqrt("n") / z).between(0.75, 1.3)
    return parts[0].union(parts[1]).union(inside.select(F.lit("median"), F.round("estimate", 6), "n", F.col("estimate").between(F.col("low"), F.col("high")), near))


@query("r01_correlation", "SELECT corr(l_quantity, l_extendedprice) AS r, covar_samp(l_quantity, l_extendedprice) AS covariance, count(*) AS n FROM lineitem")
def _(t):
    return I.correlation(t("lineitem"), "l_quantity", "l_extendedprice").select("r", "covariance", "n")


@query("r02_spearman", """
    WITH r AS (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS a, rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0 AS b FROM lineitem)
    SELECT corr(a, b) AS rho, count(*) AS n FROM r""")  # fmt: skip
def _(t):
    return I.spearman(t("lineitem"), "l_quantity", "l_extendedprice").select("rho", "n")


@query("r05_correlation_matrix", """
    SELECT 'l_quantity' AS a, 'l_extendedprice' AS b, corr(l_quantity, l_extendedprice) AS r FROM lineitem UNION ALL SELECT 'l_quantity', 'l_discount', corr(l_quantity, l_discount) FROM lineitem
    UNION ALL SELECT 'l_extendedprice', 'l_discount', corr(l_extendedprice, l_discount) FROM lineitem""")  # fmt: skip
def _(t):
    return I.correlation_matrix(t("lineitem"), ["l_quantity", "l_extendedprice", "l_discount"]).select("a", "b", "r")


@query("r07_simple_regression", "SELECT l_returnflag, regr_slope(l_extendedprice, l_quantity) AS slope, regr_intercept(l_extendedprice, l_quantity) AS intercept, regr_r2(l_extendedprice, l_quantity) AS r_squared, CAST(regr_count(l_extendedprice, l_quantity) AS BIGINT) AS n FROM lineitem GROUP BY l_returnflag")
def _(t):
    return I.simple_regression(t("lineitem"), "l_extendedprice", "l_quantity", ["l_returnflag"])


@query("r08_ols", """
    WITH c AS (SELECT covar_pop(l_quantity, l_quantity) AS aa, covar_pop(l_discount, l_discount) AS bb, covar_pop(l_quantity, l_discount) AS ab, covar_pop(l_quantity, l_extendedprice) AS ay, covar_pop(l_discount, l_extendedprice) AS bz,
      avg(l_extendedprice) AS my, avg(l_quantity) AS ma, avg(l_discount) AS mb FROM lineitem),
    s AS (SELECT (ay * bb - bz * ab) / (aa * bb - ab * ab) AS p, (bz * aa - ay * ab) / (aa * bb - ab * ab) AS q, * FROM c)
    SELECT '(intercept)' AS term, my - p * ma - q * mb AS estimate FROM s UNION ALL SELECT 'l_quantity', p FROM s UNION ALL SELECT 'l_discount', q FROM s""")  # fmt: skip
def _(t):
    return I.ols(t("lineitem"), "l_extendedprice", ["l_quantity", "l_discount"]).select("term", "estimate")


@query("r09_ols_hc3", """
    WITH m AS (SELECT count(*) AS n, avg(l_extendedprice) AS y, avg(l_quantity) AS a, avg(l_discount) AS b FROM lineitem), c AS (SELECT l_extendedprice - y AS y, l_quantity - a AS a, l_discount - b AS b, n, l_suppkey AS g FROM lineitem, m),
    p AS (SELECT sum(a * a) AS aa, sum(a * b) AS ab, sum(b * b) AS bb, sum(a * y) AS ay, sum(b * y) AS ay2 FROM c), i AS (SELECT bb / (aa * bb - ab * ab) AS ia, -ab / (aa * bb - ab * ab) AS iab, aa / (aa * bb - ab * ab) AS ib, ay, ay2 FROM p),
    s AS (SELECT ia * ay + iab * ay2 AS sa, iab * ay + ib * ay2 AS sb, ia, iab, ib FROM i), e AS (SELECT a, b, n, g, y - sa * a - sb * b AS e, ia, iab, ib, sa, sb, 1.0 / n + ia * a * a + 2 * iab * a * b + ib * b * b AS h FROM c, s),
    r AS (SELECT any_value(ia) AS ia, any_value(iab) AS iab, any_value(ib) AS ib, any_value(sa) AS sa, any_value(sb) AS sb, sum(a * a * e * e / ((1 - h) * (1 - h))) AS raa, sum(a * b * e * e / ((1 - h) * (1 - h))) AS rab, sum(b * b * e * e / ((1 - h) * (1 - h))) AS rbb FROM e),
    v AS (SELECT *, sqrt(ia * ia * raa + 2 * ia * iab * rab + iab * iab * rbb) AS ea, sqrt(iab * iab * raa + 2 * iab * ib * rab + ib * ib * rbb) AS eb FROM r)
    SELECT 'l_quantity' AS term, sa AS estimate, ea AS se FROM v UNION ALL SELECT 'l_discount', sb, eb FROM v""")  # fmt: skip
def _(t):
    return I.ols_robust(t("lineitem"), "l_extendedprice", ["l_quantity", "l_discount"])


@query("r09_ols_clustered", """
    WITH m AS (SELECT count(*) AS n, avg(l_extendedprice) AS y, avg(l_quantity) AS a, avg(l_discount) AS b FROM lineitem), c AS (SELECT l_extendedprice - y AS y, l_quantity - a AS a, l_discount - b AS b, n, l_suppkey AS g FROM lineitem, m),
    p AS (SELECT sum(a * a) AS aa, sum(a * b) AS ab, sum(b * b) AS bb, sum(a * y) AS ay, sum(b * y) AS ay2 FROM c), i AS (SELECT bb / (aa * bb - ab * ab) AS ia, -ab / (aa * bb - ab * ab) AS iab, aa / (aa * bb - ab * ab) AS ib, ay, ay2 FROM p),
    s AS (SELECT ia * ay + iab * ay2 AS sa, iab * ay + ib * ay2 AS sb, ia, iab, ib FROM i), e AS (SELECT a, b, n, g, y - sa * a - sb * b AS e, ia, iab, ib, sa, sb, 1.0 / n + ia * a * a + 2 * iab * a * b + ib * b * b AS h FROM c, s),
    k AS (SELECT g, sum(a * e) AS u, sum(b * e) AS v, count(*) AS m, any_value(ia) AS ia, any_value(iab) AS iab, any_value(ib) AS ib, any_value(sa) AS sa, any_value(sb) AS sb FROM e GROUP BY g), f AS (SELECT count(*) / (count(*) - 1.0) * (sum(m) - 1.0) / (sum(m) - 3.0) AS f FROM k),
    r AS (SELECT any_value(ia) AS ia, any_value(iab) AS iab, any_value(ib) AS ib, any_value(sa) AS sa, any_value(sb) AS sb, any_value(f) * sum(u * u) AS raa, any_value(f) * sum(u * v) AS rab, any_value(f) * sum(v * v) AS rbb FROM k, f),
    v AS (SELECT *, sqrt(ia * ia * raa + 2 * ia * iab * rab + iab * iab * rbb) AS ea, sqrt(iab * iab * raa + 2 * iab * ib * rab + ib * ib * rbb) AS eb FROM r)
    SELECT 'l_quantity' AS term, sa AS estimate, ea AS se FROM v UNION ALL SELECT 'l_discount', sb, eb FROM v""")  # fmt: skip
def _(t):
    return I.ols_robust(t("lineitem"), "l_extendedprice", ["l_quantity", "l_discount"], "l_suppkey")


@query("r10_design_rank", """
    WITH s AS (SELECT count(*) AS n, sum(l_quantity) AS b, sum(l_quantity * l_quantity) AS d FROM lineitem)
    SELECT sqrt((n + d + sqrt((n - d) * (n - d) + 4 * b * b)) / (n + d - sqrt((n - d) * (n - d) + 4 * b * b))) AS condition_number, 2 AS rank, true AS full_rank, 2 AS rank_of_repeated, false AS full_of_repeated FROM s""")  # fmt: skip
def _(t):
    one = I.design_rank(t("lineitem"), ["l_quantity"])
    two = I.design_rank(t("lineitem").withColumn("twice", F.col("l_quantity") * 2 + 1), ["l_quantity", "twice"])
    return one.crossJoin(two.select(F.col("rank").alias("rank_of_repeated"), F.col("full_rank").alias("full_of_repeated")))


@query("r10_vif", """
    WITH r AS (SELECT corr(l_quantity, l_extendedprice) AS c FROM lineitem) SELECT 'l_quantity' AS "column", 1 / (1 - c * c) AS vif FROM r UNION ALL SELECT 'l_extendedprice', 1 / (1 - c * c) FROM r""")  # fmt: skip
def _(t):
    return I.vif(t("lineitem"), ["l_quantity", "l_extendedprice"])
