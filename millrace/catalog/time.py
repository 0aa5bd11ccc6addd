"""Time queries."""

import datetime as dt

from pyspark.sql import functions as F

from ..operators import periods as P
from . import query

NOW, THEN = P.Period(dt.date(1996, 1, 1), dt.date(1996, 4, 1)), P.Period(dt.date(1995, 10, 1), dt.date(1996, 1, 1))
IN_NOW = "o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1996-04-01'"
IN_THEN = "o_orderdate >= TIMESTAMP '1995-10-01' AND o_orderdate < TIMESTAMP '1996-01-01'"
CHANGE = f"""
    SELECT {{group}} coalesce(sum(o_totalprice) FILTER ({IN_NOW}), 0) AS current, coalesce(sum(o_totalprice) FILTER ({IN_THEN}), 0) AS previous,
      count(o_totalprice) FILTER ({IN_NOW}) AS n_current, count(o_totalprice) FILTER ({IN_THEN}) AS n_previous
    FROM orders WHERE {IN_NOW} OR {IN_THEN} {{by}}"""
MONTHLY = "SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS period, sum(o_totalprice) AS value, count(*) AS n, count(DISTINCT CAST(o_orderdate AS DATE)) AS days FROM orders GROUP BY ALL"


def monthly(t, keys=()):
    return P.period_series(t("orders"), "o_orderdate", "o_totalprice", "sum", "month", keys)


def shown(df):
    """Dates as text, sums to the cent."""
    return df.withColumns({c: F.col(c).cast("string") for c, kind in df.dtypes if kind == "date"}).withColumn("value", F.round("value", 2))


@query("t01_scope", f"""
    WITH a AS (SELECT max(CAST(o_orderdate AS DATE)) AS d FROM orders), b AS (SELECT date_trunc('quarter', d) AS e FROM a)
    SELECT count(*) FILTER (o_orderdate >= e - INTERVAL 3 MONTH AND o_orderdate < e) AS n, count(*) FILTER (o_orderdate >= e - INTERVAL 6 MONTH AND o_orderdate < e - INTERVAL 3 MONTH) AS baseline FROM orders, b""")  # fmt: skip
def _(t):
    o = t("orders")
    now, then = P.scope(P.last_day(o, "o_orderdate"), "last_quarter")
    return o.agg(F.count_if(now.holds("o_orderdate")).alias("n"), F.count_if(then.holds("o_orderdate")).alias("baseline"))


@query("t03_grain", """
    WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders), g AS (SELECT d, date_diff('day', d, lead(d) OVER (PARTITION BY year(d) ORDER BY d)) AS gap FROM d)
    SELECT median(gap) AS gap, count(*) AS dates, bool_and(day(d) = 1) AS first_days, CASE WHEN median(gap) <= 1.5 THEN 'day' WHEN median(gap) <= 8 THEN 'week' WHEN median(gap) <= 31 THEN 'month' WHEN median(gap) <= 92 THEN 'quarter' ELSE 'year' END AS grain FROM g""")  # fmt: skip
def _(t):
    return P.infer_grain(t("orders"), "o_orderdate")


@query("t04_coordinates", "SELECT o_orderkey, CAST(date_diff('day', (SELECT min(o_orderdate) FROM orders), o_orderdate) AS DOUBLE) AS elapsed FROM orders")
def _(t):
    return P.time_coordinates(t("orders"), "o_orderdate").select("o_orderkey", "elapsed")


@query("t05_series", f"SELECT CAST(period AS VARCHAR) AS period, round(value, 2) AS value, n, days FROM ({MONTHLY})")
def _(t):
    return shown(monthly(t))


@query("t06_complete_periods", f"""
    WITH s AS ({MONTHLY}) SELECT CAST(period AS VARCHAR) AS period, round(value, 2) AS value, n, days FROM s
    WHERE period < (SELECT max(period) FROM s) OR days >= 0.9 * date_diff('day', period, CAST(period + INTERVAL 1 MONTH AS DATE))""")  # fmt: skip
def _(t):
    return shown(P.drop_partial_last(monthly(t), "month"))


@query("t07_t08_period_change", f"""
    WITH c AS ({CHANGE.format(group='', by='')}) SELECT *, current - previous AS delta, 100 * (current - previous) / previous AS percent,
      (n_current - n_previous) * (previous / n_previous) AS volume_effect, n_previous * (current / n_current - previous / n_previous) AS rate_effect,
      (n_current - n_previous) * (current / n_current - previous / n_previous) AS cross_effect FROM c""")  # fmt: skip
def _(t):
    return P.volume_and_rate(P.period_change(t("orders"), "o_orderdate", "o_totalprice", NOW, THEN))


@query("t09_contributions", f"""
    WITH s AS (SELECT o_orderpriority, o_orderstatus, CASE WHEN {IN_NOW} THEN o_totalprice ELSE -o_totalprice END AS v FROM orders WHERE {IN_NOW} OR {IN_THEN}),
    d AS (SELECT 'o_orderpriority' AS dimension, o_orderpriority AS level, sum(v) AS delta FROM s GROUP BY ALL UNION ALL SELECT 'o_orderstatus', o_orderstatus, sum(v) FROM s GROUP BY ALL)
    SELECT *, delta / sum(delta) OVER (PARTITION BY dimension) AS share FROM d""")  # fmt: skip
def _(t):
    return P.contributions(t("orders"), "o_orderdate", "o_totalprice", NOW, THEN, ["o_orderpriority", "o_orderstatus"])


@query("t12_unusual_change", f"""
    WITH s AS ({MONTHLY}), f AS (SELECT period, value FROM s WHERE period < (SELECT max(period) FROM s) OR days >= 0.9 * date_diff('day', period, CAST(period + INTERVAL 1 MONTH AS DATE))),
    c AS (SELECT period, value - lag(value) OVER (ORDER BY period) AS c FROM f), k AS (SELECT * FROM c WHERE c IS NOT NULL), o AS (SELECT * FROM k WHERE period < (SELECT max(period) FROM k)), m AS (SELECT median(c) AS m, count(*) AS n FROM o),
    j AS (SELECT arg_max(c, period) AS j FROM k), d AS (SELECT 1.4826 * median(abs(c - m)) AS d FROM o, m) SELECT round(m, 2) AS middle, n AS others, round(j, 2) AS judged, round(d, 2) AS spread, round(CASE WHEN n >= 5 THEN (j - m) / d END, 6) AS z FROM m, j, d""")  # fmt: skip
def _(t):
    found = P.change_is_unusual(P.drop_partial_last(monthly(t), "month"))
    return found.withColumns({c: F.round(c, 6 if c == "z" else 2) for c in ("middle", "judged", "spread", "z")})


@query("t13_rate_and_mix", f"""
    WITH c AS ({CHANGE.format(group='o_orderpriority,', by='GROUP BY o_orderpriority')}), w AS (SELECT *, n_current / CAST(sum(n_current) OVER () AS DOUBLE) AS w1, n_previous / CAST(sum(n_previous) OVER () AS DOUBLE) AS w0,
      current / n_current AS y1, previous / n_previous AS y0 FROM c)
    SELECT sum(0.5 * (w1 + w0) * (y1 - y0)) AS rate_effect, sum(0.5 * (y1 + y0) * (w1 - w0)) AS mix_effect FROM w""")  # fmt: skip
def _(t):
    return P.kitagawa(t("orders"), "o_orderdate", "o_totalprice", NOW, THEN, "o_orderpriority")


@query("t14_cohorts", f"""
    WITH c AS ({CHANGE.format(group='o_custkey,', by='GROUP BY o_custkey')})
    SELECT CASE WHEN n_previous = 0 THEN 'new' WHEN n_current = 0 THEN 'lost' ELSE 'retained' END AS cohort, count(*) AS entities, sum(current - previous) AS delta FROM c GROUP BY 1""")  # fmt: skip
def _(t):
    return P.cohort_bridge(t("orders"), "o_orderdate", "o_custkey", "o_totalprice", NOW, THEN)


@query("t15_series_summary", f"""
    WITH s AS (SELECT *, CAST(row_number() OVER (ORDER BY period) AS DOUBLE) AS i, value - lag(value) OVER (ORDER BY period) AS change FROM ({MONTHLY}))
    SELECT arg_min(value, period) AS first, arg_max(value, period) AS last, count(*) AS periods, regr_slope(value, i) AS slope, stddev_samp(change) AS volatility,
      arg_max(value, period) - arg_min(value, period) AS net_change, (arg_max(value, period) - arg_min(value, period)) / arg_min(value, period) AS growth FROM s""")  # fmt: skip
def _(t):
    return P.series_summary(monthly(t))


@query("t16_trend", """
    WITH m AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS period, sum(o_totalprice) AS value, count(DISTINCT CAST(o_orderdate AS DATE)) AS days FROM orders GROUP BY ALL),
    s AS (SELECT value, row_number() OVER (ORDER BY period) - 1 AS i FROM m WHERE period < (SELECT max(period) FROM m) OR days >= 0.9 * date_diff('day', period, period + INTERVAL 1 MONTH)),
    p AS (SELECT (b.value - a.value) / (b.i - a.i) AS slope FROM s a JOIN s b ON a.i < b.i), t AS (SELECT coalesce(sum(k * (k - 1) / 2), 0) AS ties FROM (SELECT count(*) AS k FROM s GROUP BY value))
    SELECT CAST((SELECT count(*) FROM s) AS INTEGER) AS n, median(slope) AS median_slope, (SELECT regr_slope(value, i) FROM s) AS ols_slope, sum(sign(slope)) / sqrt(count(*) * (count(*) - any_value(ties))) AS tau FROM p, t""")  # fmt: skip
def _(t):
    return P.trend(P.drop_partial_last(monthly(t), "month")).select("n", "median_slope", "ols_slope", "tau")


@query("t18_trend_by_group", f"""
    WITH m AS (SELECT o_orderpriority, CAST(date_trunc('month', o_orderdate) AS DATE) AS period, sum(o_totalprice) AS value FROM orders GROUP BY ALL),
    s AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY period) - 1 AS i FROM m),
    p AS (SELECT a.o_orderpriority, (b.value - a.value) / (b.i - a.i) AS slope FROM s a JOIN s b ON a.o_orderpriority = b.o_orderpriority AND a.i < b.i)
    SELECT o_orderpriority, (SELECT median(slope) FROM p WHERE p.o_orderpriority = s.o_orderpriority) AS median_slope, regr_slope(value, i) AS ols_slope FROM s GROUP BY o_orderpriority""")  # fmt: skip
def _(t):
    return P.trend(monthly(t, ["o_orderpriority"]), ["o_orderpriority"]).select("o_orderpriority", "median_slope", "ols_slope")


@query("t19_before_and_after", f"""
    WITH s AS (SELECT *, CAST(date_diff('month', (SELECT min(period) FROM ({MONTHLY})), period) AS DOUBLE) AS x FROM ({MONTHLY}))
    SELECT CASE WHEN period < DATE '1996-01-01' THEN 'before' ELSE 'after' END AS side, regr_slope(value, x) AS slope, avg(value) AS level, count(*) AS periods FROM s GROUP BY 1""")  # fmt: skip
def _(t):
    return P.before_and_after(monthly(t), dt.date(1996, 1, 1))
