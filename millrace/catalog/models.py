"""Queries of forecasts, effects, survival and models."""

from pyspark.sql import functions as F

from ..operators import effects as K
from ..operators import forecast as E
from ..operators import learning as M
from ..operators.periods import drop_partial_last, period_series
from . import query


def monthly(t, keys=()):
    return drop_partial_last(period_series(t("orders"), "o_orderdate", "o_totalprice", "sum", "month", keys), "month")


@query("e02_forecast")
def _(t):
    return E.forecast(monthly(t))


@query("e02_forecast_by_group")
def _(t):
    return E.forecast(monthly(t, ["o_orderpriority"]), ["o_orderpriority"])


def treated(t):
    """Line items with a high discount as treatment, the tax class and quantity as covariates, the price as outcome."""
    return t("lineitem").select((F.col("l_discount") > 0.05).cast("int").alias("t"), (F.col("l_extendedprice") / 1000).alias("y"), (F.col("l_quantity") / 10).alias("q"), (F.col("l_tax") * 100).alias("x"))


#: Treatment, outcome and one covariate of two values: a propensity that is the share of its cell, so that SQL can give errors.
TWO_CELLS = """
    d AS (SELECT CAST(l_discount > 0.05 AS INTEGER) AS t, l_extendedprice / 1000 + l_discount * 20 AS y, CAST(l_quantity > 25 AS INTEGER) AS q FROM lineitem),
    c AS (SELECT q, avg(t) AS e, avg(y) FILTER (t = 1) AS m1, avg(y) FILTER (t = 0) AS m0 FROM d GROUP BY q),
    f AS (SELECT m1 - m0 + t * (y - m1) / e - (1 - t) * (y - m0) / (1 - e) AS phi FROM d JOIN c USING (q)),
    s AS (SELECT avg(phi) AS effect, stddev_pop(phi) / sqrt(count(*)) AS se, count(*) AS n FROM f)"""


def two_cells(t):
    return t("lineitem").select((F.col("l_discount") > 0.05).cast("int").alias("t"), (F.col("l_extendedprice") / 1000 + F.col("l_discount") * 20).alias("y"), (F.col("l_quantity") > 25).cast("int").alias("q"))


@query("k02_ipw", f"WITH {TWO_CELLS} SELECT round(effect, 3) AS effect, round(se, 3) AS se, n FROM s")
def _(t):
    return K.ipw(two_cells(t), "t", "y", ["q"]).select(F.round("effect", 3).alias("effect"), F.round("se", 3).alias("se"), "n")


@query("k03_interval", """
    WITH d AS (SELECT CAST(l_discount > 0.05 AS INTEGER) AS t, l_extendedprice / 1000 AS y, l_quantity / 10 AS q FROM lineitem),
    m AS (SELECT t, avg(y) AS my, avg(q) AS mq, var_pop(q) AS v, covar_pop(y, q) / var_pop(q) AS b, count(*) / (SELECT count(*) FROM d) AS share FROM d GROUP BY t),
    a AS (SELECT avg(q) AS mean FROM d),
    f AS (SELECT d.t, o.my + o.b * (q - o.mq) - z.my - z.b * (q - z.mq) AS gap, i.share, i.v, i.mq, q, mean, y - i.my - i.b * (q - i.mq) AS r FROM d JOIN m i USING (t) JOIN m o ON o.t = 1 JOIN m z ON z.t = 0, a),
    g AS (SELECT gap, (2 * t - 1) * r / share * (1 + (mean - mq) * (q - mq) / v) AS rest FROM f), e AS (SELECT avg(gap) AS effect, count(*) AS n FROM g),
    s AS (SELECT effect, n, sqrt(avg((gap - effect + rest) ** 2) / n) AS se FROM g, e GROUP BY effect, n)
    SELECT round(effect, 6) AS effect, round(se, 6) AS se, round(effect - 1.959963985 * se, 5) AS low, round(effect + 1.959963985 * se, 5) AS high, n FROM s""")  # fmt: skip
def _(t):
    return K.g_computation(treated(t), "t", "y", ["q"]).select(F.round("effect", 6).alias("effect"), F.round("se", 6).alias("se"), F.round("low", 5).alias("low"), F.round("high", 5).alias("high"), "n")


@query("k03_g_computation", """
    WITH d AS (SELECT CAST(l_discount > 0.05 AS INTEGER) AS t, l_extendedprice / 1000 AS y, l_quantity / 10 AS q, l_tax * 100 AS x FROM lineitem),
    m AS (SELECT t, avg(y) AS y, avg(q) AS q, avg(x) AS x FROM d GROUP BY t), c AS (SELECT d.t, d.y - m.y AS y, d.q - m.q AS q, d.x - m.x AS x FROM d JOIN m USING (t)),
    p AS (SELECT t, sum(q * q) AS qq, sum(q * x) AS qx, sum(x * x) AS xx, sum(q * y) AS qy, sum(x * y) AS xy FROM c GROUP BY t),
    b AS (SELECT m.t, (xx * qy - qx * xy) / (qq * xx - qx * qx) AS bq, (qq * xy - qx * qy) / (qq * xx - qx * qx) AS bx, m.y, m.q, m.x FROM p JOIN m USING (t)), a AS (SELECT avg(q) AS q, avg(x) AS x, count(*) AS n FROM d),
    f AS (SELECT t, b.y + bq * (a.q - b.q) + bx * (a.x - b.x) AS f, n FROM b, a)
    SELECT round(max(f) FILTER (t = 1) - max(f) FILTER (t = 0), 6) AS effect, any_value(n) AS n FROM f""")  # fmt: skip
def _(t):
    return K.g_computation(treated(t), "t", "y", ["q", "x"]).select(F.round("effect", 6).alias("effect"), "n")


@query("k04_doubly_robust", f"WITH {TWO_CELLS} SELECT n, true AS effect_as_in_cells, true AS error_as_in_cells FROM s")
def _(t):
    """Folds are drawn by hash; the effect must be that of the cells within a tenth of its error, the error within two percent."""
    d = two_cells(t)
    cells = d.groupBy("q").agg(F.avg("t").alias("e"), F.avg(F.when(F.col("t") == 1, F.col("y"))).alias("m1"), F.avg(F.when(F.col("t") == 0, F.col("y"))).alias("m0"))
    phi = F.col("m1") - F.col("m0") + F.col("t") * (F.col("y") - F.col("m1")) / F.col("e") - (1 - F.col("t")) * (F.col("y") - F.col("m0")) / (1 - F.col("e"))
    plain = d.join(F.broadcast(cells), "q").agg(F.avg(phi).alias("effect of cells"), (F.stddev_pop(phi) / F.sqrt(F.count("*"))).alias("se of cells"))
    both = K.doubly_robust(d, "t", "y", ["q"]).crossJoin(plain)
    return both.select("n", (F.abs(F.col("effect") - F.col("effect of cells")) < 0.1 * F.col("se")).alias("effect_as_in_cells"), (F.abs(F.col("se") / F.col("se of cells") - 1) < 0.02).alias("error_as_in_cells"))


@query("k05_positivity", f"WITH {TWO_CELLS} SELECT round(min(e), 3) AS propensity_min, round(max(e), 3) AS propensity_max, round(max(e) - min(e), 3) AS shared_width, 0 AS extreme, (SELECT n FROM s) AS n, 0.0 AS extreme_share, CASE WHEN max(e) - min(e) > 0.05 THEN 'ADEQUATE' ELSE 'CAUTION' END AS status FROM c")
def _(t):
    found = K.positivity(two_cells(t), "t", ["q"])
    return found.withColumns({c: F.round(c, 3) for c in ("propensity_min", "propensity_max", "shared_width")})


@query("k05_balance", """
    SELECT 'q' AS covariate, (avg(q) FILTER (t = 1) - avg(q) FILTER (t = 0)) / sqrt((var_samp(q) FILTER (t = 1) + var_samp(q) FILTER (t = 0)) / 2) AS difference
    FROM (SELECT CAST(l_discount > 0.05 AS INTEGER) AS t, l_quantity / 10 AS q FROM lineitem)""")  # fmt: skip
def _(t):
    return K.balance(treated(t), "t", ["q"])


LIVES = """
    WITH s AS (SELECT o_orderpriority AS g, CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) % 400 AS DOUBLE) AS t, CAST(o_orderstatus = 'F' AS INTEGER) AS e FROM orders)"""


def lives(t):
    days = F.datediff(F.to_date("o_orderdate"), F.lit("1995-01-01").cast("date")) % 400
    return t("orders").select(F.col("o_orderpriority").alias("g"), days.cast("double").alias("t"), (F.col("o_orderstatus") == "F").cast("int").alias("e"), (F.col("o_totalprice") / 100000).alias("x"))


@query("k10_kaplan_meier", f"""{LIVES},
    c AS (SELECT g, t, sum(e) AS d, count(*) AS r FROM s GROUP BY g, t), n AS (SELECT *, sum(r) OVER (PARTITION BY g ORDER BY t DESC ROWS UNBOUNDED PRECEDING) AS n FROM c),
    k AS (SELECT g, t, n, d, exp(sum(CASE WHEN d < n THEN ln(1 - d / CAST(n AS DOUBLE)) ELSE -1e300 END) OVER w) AS s, sum(CASE WHEN d < n THEN d / CAST(n * (n - d) AS DOUBLE) ELSE 0 END) OVER w AS v FROM n WHERE d > 0 WINDOW w AS (PARTITION BY g ORDER BY t ROWS UNBOUNDED PRECEDING))
    SELECT g AS "group", t AS time, CAST(n AS BIGINT) AS at_risk, CAST(d AS BIGINT) AS events, round(s, 10) AS survival, round(s * sqrt(v), 10) AS se FROM k""")  # fmt: skip
def _(t):
    return K.kaplan_meier(lives(t), "t", "e", "g").withColumns({"survival": F.round("survival", 10), "se": F.round("se", 10)})


@query("k11_log_rank", f"""{LIVES}, p AS (SELECT * FROM s WHERE g IN ('1-URGENT', '2-HIGH')), u AS (SELECT DISTINCT t FROM p WHERE e = 1),
    r AS (SELECT u.t, count(*) FILTER (p.t >= u.t) AS n, count(*) FILTER (p.t >= u.t AND g = '1-URGENT') AS m, count(*) FILTER (p.t = u.t AND e = 1) AS d, count(*) FILTER (p.t = u.t AND e = 1 AND g = '1-URGENT') AS d1 FROM u, p GROUP BY u.t),
    x AS (SELECT d1 - d * m / CAST(n AS DOUBLE) AS gap, CASE WHEN n > 1 THEN d * (m / CAST(n AS DOUBLE)) * (1 - m / CAST(n AS DOUBLE)) * (n - d) / (n - 1) ELSE 0 END AS v FROM r)
    SELECT sum(gap) * sum(gap) / sum(v) AS statistic, sum(gap) AS observed_minus_expected FROM x""")  # fmt: skip
def _(t):
    return K.log_rank(lives(t).filter("g IN ('1-URGENT', '2-HIGH')"), "t", "e", "g").select("statistic", "observed_minus_expected")


@query("k12_cox")
def _(t):
    return K.cox(lives(t), "t", "e", ["x"])


def labelled(t):
    return t("lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), (F.col("l_extendedprice") > 35000).cast("int").alias("label"), "l_quantity", "l_discount", "l_returnflag", "l_extendedprice")


@query("m02_classify")
def _(t):
    return M.classify(labelled(t), "id", "label", ["l_quantity", "l_discount", "l_returnflag"])


@query("m03_regress")
def _(t):
    return M.regress(labelled(t).drop("label"), "id", "l_extendedprice", ["l_quantity", "l_discount", "l_returnflag"])


@query("m04_importance")
def _(t):
    return M.importance(labelled(t), "l_extendedprice", ["l_quantity", "l_discount"])


@query("m05_segments")
def _(t):
    customers = t("orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("v"))
    return M.cluster_profile(M.segment(customers, ["n", "v"], 4)[0], ["n", "v"])


@query("m07_adjusted_rand", """
    WITH c AS (SELECT o_orderstatus AS a, o_orderpriority AS b, CAST(count(*) AS DOUBLE) AS n FROM orders GROUP BY ALL), p AS (SELECT sum(n * (n - 1) / 2) AS z, sum(n) AS t FROM c),
    x AS (SELECT sum(n * (n - 1) / 2) AS x FROM (SELECT sum(n) AS n FROM c GROUP BY a)), y AS (SELECT sum(n * (n - 1) / 2) AS y FROM (SELECT sum(n) AS n FROM c GROUP BY b))
    SELECT round((z - x * y / (t * (t - 1) / 2)) / ((x + y) / 2 - x * y / (t * (t - 1) / 2)), 9) AS ari FROM p, x, y""")  # fmt: skip
def _(t):
    return M.adjusted_rand(t("orders"), "o_orderstatus", "o_orderpriority").select(F.round("ari", 9).alias("ari"))


PROBABILITIES = "SELECT (p_partkey % 100) / 100.0 AS p, CAST((p_partkey * 7919) % 100 < p_partkey % 100 AS INTEGER) AS y FROM part"


def probabilities(t):
    k = F.col("p_partkey")
    return t("part").select(((k % 100) / 100.0).alias("p"), ((k * 7919) % 100 < k % 100).cast("int").alias("y"))


@query("m09_calibration", f"""
    WITH d AS ({PROBABILITIES}), b AS (SELECT least(floor(p * 10), 9) AS b, count(*) AS n, abs(avg(p) - avg(y)) AS gap FROM d GROUP BY 1)
    SELECT (SELECT avg((p - y) * (p - y)) FROM d) AS brier, sum(n * gap) / sum(n) AS ece, max(gap) AS mce FROM b""")  # fmt: skip
def _(t):
    return M.calibration_errors(probabilities(t), "p", "y")


@query("m10_isotonic", """
    WITH g AS (SELECT (o_custkey % 20) / 20.0 AS p, count(*) AS n, sum(CAST(o_totalprice > 200000 - 2000 * (o_custkey % 20) AS INTEGER)) AS s FROM orders GROUP BY 1),
    v AS (SELECT a.p AS a, b.p AS b, (SELECT sum(s) / sum(n) FROM g WHERE p BETWEEN a.p AND b.p) AS v FROM g a JOIN g b ON a.p <= b.p),
    m AS (SELECT g.p, v.a, min(v.v) AS v FROM g JOIN v ON v.a <= g.p AND v.b >= g.p GROUP BY g.p, v.a)
    SELECT CAST(p AS DOUBLE) AS p, round(max(v), 8) AS calibrated FROM m GROUP BY p""")  # fmt: skip
def _(t):
    """The fit at every old probability; SQL has it as the largest of the least means of stretches that hold it."""
    k = F.col("o_custkey") % 20
    rows = t("orders").select((k / 20).alias("p"), (F.col("o_totalprice") > 200000 - 2000 * k).cast("int").alias("y"))
    return M.isotonic(rows, "p", "y").groupBy("p").agg(F.round(F.max("calibrated"), 8).alias("calibrated"))


@query("m14_uplift")
def _(t):
    return M.uplift(treated(t).withColumn("y", (F.col("y") > 35).cast("int")), "t", "y", ["q", "x"])
