"""Operators whose results have no SQL, against hand-computed or simulated data."""

import math

import numpy as np
import pytest

from millrace.functions import tails
from millrace.operators import cleaning as C
from millrace.operators import effects as K
from millrace.operators import forecast as E
from millrace.operators import inference as I
from millrace.operators import joins as J
from millrace.operators import periods as P
from millrace.operators import quality as Q
from millrace.operators import rows as R
from millrace.operators.aggregates import aggregate
from millrace.operators.ranks import quantiles


def test_tails():
    assert tails.t_sf(2.0, 10) == pytest.approx(0.0733880, abs=1e-6)
    assert tails.f_sf(3.0, 2, 20) == pytest.approx(0.0725, abs=1e-4)
    assert tails.chi2_sf(3.841459, 1) == pytest.approx(0.05, abs=1e-6)
    assert tails.normal_quantile(0.05) == pytest.approx(1.959964, abs=1e-5)
    assert tails.t_quantile(0.05, 10) == pytest.approx(2.228139, abs=1e-5)
    assert tails.kolmogorov_sf(1.358) == pytest.approx(0.05, abs=1e-3)


def test_null_groups_and_unknown_names(spark):
    df = spark.createDataFrame([("a", 1), ("a", None), (None, 3)], "g string, x int")
    assert {r.g: (r.value, r.row_count) for r in aggregate(df, "sum", "x", ["g"]).collect()} == {"a": (1, 2), "<missing>": (3, 1)}
    for bad in (lambda: aggregate(df, "sum", "y"), lambda: aggregate(df, "other", "x"), lambda: aggregate(df, "percentile", "x", percentile=101)):
        with pytest.raises(ValueError):
            bad()
    assert aggregate(df.limit(0), "mean", "x", ["g"]).collect() == []


def test_numbers_and_dates(spark):
    df = spark.createDataFrame([("$1,234.50", "1.234,5", "12%", "007", "31/12/2024"), ("(2)", "-3,5", "5-", "08", "01/02/2024"), (None,) * 5], "a string, b string, c string, d string, e string")
    out = C.parse_dates(C.coerce_numeric(df), "e").collect()
    assert [(r.a, r.b, r.c, r.d) for r in out[:2]] == [(1234.5, 1234.5, 0.12, "007"), (-2.0, -3.5, -5.0, "08")]
    assert str(out[0].e) == "2024-12-31" and str(out[1].e) == "2024-02-01" and out[2].e is None
    same = spark.createDataFrame([("01/02/2024",)], "e string")
    assert C.parse_dates(same, "e").first().e == "01/02/2024"


def test_names(spark):
    df = spark.createDataFrame([(1, 2, 3)], ["a", " a ", " "])
    assert C.normalize_columns(df).columns == ["a", "a_1", "unnamed_column"]


def test_content_hash_ignores_order(spark):
    a = spark.createDataFrame([(1, "x"), (2, None)], "i int, s string")
    b = spark.createDataFrame([(None, 2), ("x", 1)], "s string, i int")
    assert C.content_hash(a).first() == C.content_hash(b).first() != C.content_hash(a.limit(1)).first()


def test_where_fails_closed(spark):
    df = spark.createDataFrame([("a", 1, True), ("B", None, False)], "s string, n int, b boolean")
    assert R.where(df, [("s", "=", "b")]).count() == 1 and R.where(df, [("b", "=", "yes")]).count() == 1
    assert R.where(df, [("n", "!=", 5)]).count() == 1
    for bad in (("x", "=", 1), ("s", "like", 1), ("s", ">", "a"), ("n", "in", []), ("n", "between", (2, 1))):
        with pytest.raises(ValueError):
            R.where(df, [bad]).count()


def test_unsafe_joins(spark):
    a, b = spark.createDataFrame([(1,), (1,)], "k int"), spark.createDataFrame([(1, "x"), (1, "y")], "k int, s string")
    assert J.assess_join(a, b, ["k"], ["k"]).first().status == "UNSAFE"
    assert J.assess_join(a, b, ["k"], ["k"], authorised=True).first().status == "SAFE"
    assert J.assess_join(a, b, ["k"], ["s"]).first().reason == "incompatible_types"
    assert J.assess_join(a, b, ["k"], ["z"]).first().reason == "missing_key"
    assert J.assess_join(a.limit(0), b, ["k"], ["k"]).first().status == "UNKNOWN"


def test_quantiles_are_exact(spark):
    rng = np.random.default_rng(1)
    x = np.append(rng.normal(size=500).round(1), [3.0] * 400)
    got = {r.point: r.quantile for r in quantiles(spark.createDataFrame([(float(v),) for v in x], "x double"), "x", [0, 0.1, 0.37, 0.5, 0.9, 1]).collect()}
    assert all(v == pytest.approx(np.quantile(x, p)) for p, v in got.items())


def test_tests_on_known_numbers(spark):
    a, b = [1.0, 2.0, 3.0, 4.0, 5.0], [2.0, 4.0, 6.0, 8.0, 10.0]
    df = spark.createDataFrame([("a", x) for x in a] + [("b", x) for x in b], "g string, x double")
    r = I.t_test(df, "x", "g").first()
    assert r.statistic == pytest.approx(-1.8974, abs=1e-4) and r.df == pytest.approx(5.8824, abs=1e-4) and r.p_value == pytest.approx(0.10753, abs=1e-4)
    assert I.t_test(df.filter("x = 2"), "x", "g").first().status == "insufficient_data"
    u = I.mann_whitney(df, "x", "g").first()
    assert u.statistic == 5.0
    f = I.fisher_exact(spark.createDataFrame([(1, 1)] * 8 + [(1, 0)] * 2 + [(0, 1)] * 1 + [(0, 0)] * 5, "a int, b int"), "a", "b").first()
    assert f.odds_ratio == 20 and f.p_value == pytest.approx(0.03497, abs=1e-4)


def test_regression_recovers_its_model(spark):
    rng = np.random.default_rng(2)
    x, z = rng.normal(size=800), rng.normal(size=800)
    y = 2 + 3 * x - z + rng.normal(size=800)
    df = spark.createDataFrame([(float(a), float(b), float(c), int(i % 20)) for i, (a, b, c) in enumerate(zip(x, z, y))], "x double, z double, y double, k int")
    m = np.column_stack([np.ones(800), x, z])
    b = np.linalg.lstsq(m, y, rcond=None)[0]
    e, inv = y - m @ b, np.linalg.inv(m.T @ m)
    got = {r.term: r for r in I.ols(df, "y", ["x", "z"]).collect()}
    assert [got[t].estimate for t in ("(intercept)", "x", "z")] == pytest.approx(list(b))
    assert [got[t].se for t in ("(intercept)", "x", "z")] == pytest.approx(list(np.sqrt(np.diag(inv) * (e @ e) / 797)))
    h = np.einsum("ij,jk,ik->i", m, inv, m)
    hc3 = inv @ (m.T * (e / (1 - h)) ** 2) @ m @ inv
    assert [r.se for r in I.ols_robust(df, "y", ["x", "z"]).collect()] == pytest.approx(list(np.sqrt(np.diag(hc3))[1:]))
    assert I.ols_robust(df, "y", ["x", "z"], "k").count() == 2


def test_trend_and_forecast(spark):
    months = [(f"2020-{i % 12 + 1:02d}-01" if i < 12 else f"2021-{i % 12 + 1:02d}-01", 10.0 + 2 * i) for i in range(24)]
    series = spark.createDataFrame(months, "period string, value double").selectExpr("CAST(period AS DATE) AS period", "value")
    r = P.trend(series).first()
    assert r.median_slope == pytest.approx(2) and r.ols_slope == pytest.approx(2) and r.tau == 1 and r.detectable
    f = E.forecast(series, horizon=2).orderBy("step").collect()
    assert f[0].forecast == pytest.approx(58) and str(f[1].period) == "2022-02-01" and f[0].method in ("drift", "holt")
    assert E.forecast(series.limit(4)).collect() == [] and P.trend(series.limit(2)).collect() == []


def test_effects_recover_the_truth(spark):
    rng = np.random.default_rng(3)
    a = rng.normal(size=3000)
    t = (rng.random(3000) < 1 / (1 + np.exp(-a))).astype(int)
    y = 3 * t + 2 * a + rng.normal(size=3000)
    df = spark.createDataFrame([(float(p), int(q), float(r)) for p, q, r in zip(a, t, y)], "a double, t int, y double")
    assert K.g_computation(df, "t", "y", ["a"]).first().effect == pytest.approx(3, abs=0.15)
    assert K.ipw(df, "t", "y", ["a"]).first().effect == pytest.approx(3, abs=0.4)
    r = K.doubly_robust(df, "t", "y", ["a"]).first()
    assert r.low < 3 < r.high and r.se < 0.1
    with pytest.raises(ValueError):
        K.ipw(df.limit(10), "t", "y", ["a"])


def test_survival(spark):
    df = spark.createDataFrame([(1.0, 1), (2.0, 1), (2.0, 0), (3.0, 1), (4.0, 0)], "t double, e int")
    assert [(r.time, r.at_risk, round(r.survival, 6)) for r in K.kaplan_meier(df, "t", "e").orderBy("time").collect()] == [(1.0, 5, 0.8), (2.0, 4, 0.6), (3.0, 2, 0.3)]
    assert K.median_survival(K.kaplan_meier(df, "t", "e")).first().median == 3.0
    rng = np.random.default_rng(4)
    x = rng.integers(0, 2, 600)
    life = rng.exponential(1 / np.exp(0.7 * x))
    two = spark.createDataFrame([(float(a), 1, float(b)) for a, b in zip(life, x)], "t double, e int, x double")
    r = K.cox(two, "t", "e", ["x"]).first()
    assert abs(r.estimate - 0.7) < 3 * r.se and r.hazard_ratio == pytest.approx(math.exp(r.estimate))


def test_scopes():
    import datetime as dt

    now, then = P.scope(dt.date(2024, 5, 17), "last_quarter")
    assert (now.start, now.end, then.start) == (dt.date(2024, 1, 1), dt.date(2024, 4, 1), dt.date(2023, 10, 1))
    now, then = P.scope(dt.date(2024, 5, 17), "last_30_days")
    assert (now.end - now.start).days == 30 and then.end == now.start
    with pytest.raises(ValueError):
        P.scope(dt.date(2024, 5, 17), "next_month")


def test_tests_of_more_than_a_thousand_groups(spark):
    rng = np.random.default_rng(5)
    k, m = 1500, 4
    shift = np.repeat(np.where(np.arange(k) < 1000, 0.0, 2.0), m)  # what comes after the first thousand groups differs
    x = rng.normal(size=k * m) + shift
    df = spark.createDataFrame([(f"g{i // m:05d}", float(v)) for i, v in enumerate(x)], "g string, x double")
    v = x.reshape(k, m)
    mean, var = v.mean(axis=1), v.var(axis=1, ddof=1)
    f = m * ((mean - x.mean()) ** 2).sum() / (k - 1) / (var.sum() / k)
    got = I.anova(df, "x", "g").first()
    assert (got.df_between, got.df_within, got.statistic) == (k - 1, float(k * m - k), pytest.approx(f))
    w = m / var
    lack = ((1 - w / w.sum()) ** 2).sum() / (m - 1)
    f = (w * (mean - (w * mean).sum() / w.sum()) ** 2).sum() / (k - 1) / (1 + 2 * (k - 2) / (k * k - 1) * lack)
    got = I.anova(df, "x", "g", welch=True).first()
    assert (got.df_between, got.df_within, got.statistic) == (k - 1, pytest.approx((k * k - 1) / (3 * lack)), pytest.approx(f))
    ranks = np.argsort(np.argsort(x)).reshape(k, m) + 1.0
    n = k * m
    got = I.kruskal(df, "x", "g").first()
    assert (got.df, got.statistic) == (k - 1, pytest.approx(12 / (n * (n + 1)) * (ranks.sum(axis=1) ** 2 / m).sum() - 3 * (n + 1)))
    few = df.filter("g < 'g00002' OR g >= 'g01498'").unionAll(spark.createDataFrame([(f"b{i:05d}", float(j)) for i in range(1100) for j in range(2)], "g string, x double"))
    pairs = I.pairwise(few, "x", "g").filter("a >= 'g'").select("a", "b", "difference", "p_value").collect()
    last = next(r for r in pairs if (r.a, r.b) == ("g01498", "g01499"))
    assert len(pairs) == 6 and last.difference == pytest.approx(mean[-2] - mean[-1]) and 0 < last.p_value <= 1


def test_profile_is_exact(spark):
    df = spark.range(0, 60000, 1, 4).selectExpr("id AS k", "concat('t', id) AS t", "CAST(IF(id % 4 = 0, NULL, id % 1001) AS double) AS x", "date_add(DATE'1900-01-01', CAST(id AS int)) AS d", "IF(id = 0, -0.0D, 0.0D) AS z")
    x = np.array([i % 1001 for i in range(60000) if i % 4], float)
    got = {r.column: r for r in Q.profile(df).collect()}
    assert list(got) == df.columns
    assert [(r.rows, r.nulls, r.distinct) for r in got.values()] == [(60000, 0, 60000), (60000, 0, 60000), (60000, 15000, 1001), (60000, 0, 60000), (60000, 0, 1)]
    r = got["x"]
    assert [r.mean, r.sd, r.q25, r.median, r.q75, r.q95] == pytest.approx([x.mean(), x.std(ddof=1), *np.quantile(x, [0.25, 0.5, 0.75, 0.95])])
    assert (got["t"].min_text, got["d"].min_text, got["d"].median) == ("t0", "1900-01-01", None)
    assert [(r.column, r.rows, r.distinct, r.median) for r in Q.profile(df.limit(0).select("k", "t")).collect()] == [("k", 0, 0, None), ("t", 0, 0, None)]
