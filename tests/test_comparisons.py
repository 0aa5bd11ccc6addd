"""Regression diagnostics, choices of tests, structure and longitudinal effects against numpy and simulated truth."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from millrace.functions import tails
from millrace.operators import comparisons as X
from millrace.operators import effects as K
from millrace.operators import periods as P
from millrace.operators import ranks
from millrace.operators import screens as S


def test_tails_at_known_points():
    for q, k, df in ((3.578, 3, 20), (4.339, 3, 6), (3.633, 4, 1e6), (6.085, 2, 2)):  # critical values of printed tables
        assert tails.range_sf(q, k, df) == pytest.approx(0.05, abs=2e-4)
    assert tails.noncentral_chi2_power(2, 9.63) == pytest.approx(0.8, abs=1e-3)


@pytest.fixture(scope="module")
def series(spark):
    rng = np.random.default_rng(8)
    n = 400
    x, w = rng.normal(size=n), rng.normal(size=n)
    e = np.zeros(n)
    for i in range(1, n):
        e[i] = 0.5 * e[i - 1] + rng.normal()
    y = 1 + 2 * x - w + e
    days = [dt.datetime(2024, 1, 1) + dt.timedelta(i) for i in range(n)]
    frame = pd.DataFrame({"day": days, "x": x, "w": w, "y": y})
    return frame, spark.createDataFrame(frame.sample(frac=1, random_state=1)).repartition(3)


def fit(a, y):
    b = np.linalg.lstsq(a, y, rcond=None)[0]
    return b, y - a @ b


def test_diagnostics_are_those_of_numpy(series):
    frame, df = series
    n, y = len(frame), frame["y"].to_numpy()
    a = np.column_stack([np.ones(n), frame["x"], frame["w"]])
    b, e = fit(a, y)
    got = S.diagnostics(df, "y", ["x", "w"], "day").first()
    h = np.einsum("ij,jk,ik->i", a, np.linalg.inv(a.T @ a), a)
    cook = e**2 / (3 * (e @ e) / (n - 3)) * h / (1 - h) ** 2
    assert got.max_cook == pytest.approx(cook.max()) and got.influential == (cook > 4 / (n - 3)).sum() and got.high_leverage == (h > 6 / n).sum()
    _, wider = fit(np.column_stack([a, (a @ b) ** 2]), y)
    assert got.reset == pytest.approx((e @ e - wider @ wider) / (wider @ wider / (n - 4)), rel=1e-6)
    assert got.durbin_watson == pytest.approx((np.diff(e) ** 2).sum() / (e @ e))
    lags = np.column_stack([np.concatenate([np.zeros(k), e[:-k]]) for k in range(1, 5)])
    _, rest = fit(np.column_stack([a, lags]), e)
    assert got.breusch_godfrey == pytest.approx(n * (1 - rest @ rest / (e @ e)), rel=1e-6) and got.breusch_godfrey_p < 0.01


def test_newey_west_is_that_of_numpy(series):
    frame, df = series
    n, y = len(frame), frame["y"].to_numpy()
    a = np.column_stack([np.ones(n), frame["x"], frame["w"]])
    b, e = fit(a, y)
    u = a * e[:, None]
    s = u.T @ u
    for k in range(1, 4):
        g = u[k:].T @ u[:-k]
        s += (1 - k / 4) * (g + g.T)
    inverse = np.linalg.inv(a.T @ a)
    se = np.sqrt(np.diag(inverse @ s @ inverse))
    got = {r.term: r for r in S.ols_hac(df, "y", ["x", "w"], "day", 3).collect()}
    assert [got[t].estimate for t in ("x", "w")] == pytest.approx(b[1:]) and [got[t].se for t in ("x", "w")] == pytest.approx(se[1:], rel=1e-6)


def test_adjustment_removes_confounding(spark):
    rng = np.random.default_rng(9)
    g = rng.integers(0, 3, 3000)
    x = g + rng.normal(size=3000)
    y = 1.5 * x - 4 * g + rng.normal(size=3000)
    got = S.adjusted_association(spark.createDataFrame(pd.DataFrame({"x": x, "y": y, "g": [f"a.{i}" for i in g]})), "y", "x", ["g"]).first()
    assert got.low < 1.5 < got.high and abs(got.unadjusted - 1.5) > 0.5


def test_positions(spark):
    rng = np.random.default_rng(3)
    v = rng.integers(0, 200, 1000).astype(float)
    got = ranks.positions(spark.createDataFrame(pd.DataFrame({"v": v, "i": range(1000)})).repartition(4), F.col("v"), ["i"]).collect()
    assert [r.i for r in sorted(got, key=lambda r: r.position)] == sorted(range(1000), key=lambda i: (v[i], i)) and sorted(r.position for r in got) == list(range(1, 1001))


def test_the_test_that_fits(spark):
    rng = np.random.default_rng(10)
    frame = lambda **g: spark.createDataFrame([(k, float(x)) for k, v in g.items() for x in v], "g string, v double")
    normal = lambda n, m=0, s=1: rng.normal(m, s, n)
    method = lambda df: X.choose_test(df, "v", "g").first()["method"]
    assert method(frame(a=normal(200), b=normal(200, 1))) == "Welch t-test"
    assert method(frame(a=rng.exponential(size=200), b=normal(200))) == "Mann-Whitney U"
    assert method(frame(a=normal(200), b=normal(200), c=normal(200, 1))) == "One-way ANOVA"
    assert method(frame(a=normal(200), b=normal(200, 0, 5), c=normal(200))) == "Welch ANOVA"
    assert method(frame(a=rng.exponential(size=200), b=normal(200), c=normal(200))) == "Kruskal-Wallis"
    assert method(frame(a=[1, 2], b=[3])) == "INSUFFICIENT_DATA" and method(frame(a=[1] * 5, b=[2] * 5)) == "NOT_APPLICABLE"
    assert X.group_comparison(frame(a=[0, 1] * 50, b=[0, 1, 1, 1] * 50), "v", "g").first().method == "Two rates"
    assert X.preflight(frame(a=[1] * 5), "v", "g").first().status == "insufficient_groups:2"
    small = spark.createDataFrame([("x", "p"), ("x", "q"), ("y", "q")] * 3, "a string, b string")
    assert X.choose_categorical(small, "a", "b").first().method == "Fisher exact test"
    curved = spark.createDataFrame([(float(i), math.exp(i / 5)) for i in range(60)], "x double, y double")
    assert X.choose_correlation(curved, "x", "y").first().method == "Spearman correlation"


def test_confounded_rates(spark):
    # within each stratum the groups are alike; overall they differ because their mix differs
    rows = [(g, s, int(i < (80 if s == "old" else 20))) for g, old in (("a", 4), ("b", 1)) for s, n in (("old", old), ("new", 5 - old)) for _ in range(n) for i in range(100)]
    df = spark.createDataFrame(rows, "g string, s string, e int")
    r = X.stratified_check(df, "g", "s", "e").first()
    assert r.status == "ok" and r.confounded and r.strata == 2
    assert X.churn_verdict(df, "g", "e", ["s"]).first().verdict == "CONFOUNDED"
    apart = spark.createDataFrame([("a", i, i % 2) for i in range(50)] + [("b", i + 100, 1) for i in range(50)], "g string, s int, e int")
    assert X.stratified_check(apart, "g", "s", "e").first().status == "no_common_support" and X.churn_verdict(apart, "g", "e", ["s"]).first().verdict == "NOT_IDENTIFIABLE"


def test_structure_of_a_collider(spark):
    rng = np.random.default_rng(11)
    a, b = rng.normal(size=4000), rng.normal(size=4000)
    c = a + b + 0.5 * rng.normal(size=4000)
    d = c + 0.5 * rng.normal(size=4000)
    got = {tuple(r) for r in K.structure(spark.createDataFrame(pd.DataFrame({"a": a, "b": b, "c": c, "d": d})), list("abcd")).collect()}
    assert got == {("a", "c", "->"), ("b", "c", "->"), ("c", "d", "->")}


def test_longitudinal_effect(spark):
    rng = np.random.default_rng(12)
    rows = []
    for u in range(400):
        before = 0
        for t in range(3):
            c = rng.normal()
            treated = int(rng.random() < 1 / (1 + math.exp(-(c + 0.5 * before))))
            rows.append((u, t, treated, 2.0 * treated + 1.5 * c + rng.normal(), float(c)))
            before = treated
    df = spark.createDataFrame(rows, "u int, t int, d int, y double, c double")
    got = K.longitudinal(df, "u", "t", "d", "y", ["c"]).first()
    plain = np.array([r[3] for r in rows if r[2]]).mean() - np.array([r[3] for r in rows if not r[2]]).mean()
    assert abs(got.estimate - 2) < 3 * got.se + 0.1 < abs(plain - 2)


def test_named_periods():
    day = dt.date(2024, 5, 15)
    now = lambda name: (P.scope(day, name)[0].start.isoformat(), P.scope(day, name)[0].end.isoformat())
    assert now("today") == ("2024-05-15", "2024-05-16") and now("yesterday") == ("2024-05-14", "2024-05-15") and now("2024-Q2") == ("2024-04-01", "2024-07-01")
    assert now("wow") == ("2024-05-13", "2024-05-20") and P.scope(day, "yoy")[1].start == dt.date(2023, 5, 1) and now("between_2024-01-10_2024-02-09") == ("2024-01-10", "2024-02-10")
    assert now("after_2024-05-01") == ("2024-05-02", "2024-05-16") and now("2023") == ("2023-01-01", "2024-01-01")
    with pytest.raises(ValueError):
        P.scope(day, "some_time")
