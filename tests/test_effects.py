"""Errors of effects against simulation, and clusters against the rows they repeat."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from millrace.operators import effects as K


def simulated(rng, n):
    a, b = rng.normal(size=n), rng.integers(0, 2, n)
    t = (rng.random(n) < 1 / (1 + np.exp(-0.8 * a + 0.5 * b))).astype(int)
    y = 2 * t + 1.5 * a - b + t * a + rng.normal(size=n)
    return pd.DataFrame({"t": t, "y": y, "a": a, "b": b})


def hajek(d):
    """ATE by inverse propensity weights with a logistic fit by Newton steps, ridge as in the operator."""
    z = np.column_stack([np.ones(len(d)), d.a, d.b])
    beta = np.zeros(3)
    for _ in range(30):
        e = 1 / (1 + np.exp(-z @ beta))
        beta += np.linalg.solve((z * (e * (1 - e))[:, None]).T @ z, z.T @ (d.t - e))
    e = np.clip(1 / (1 + np.exp(-z @ beta)), *K.POSITIVITY)
    w1, w0 = d.t / e, (1 - d.t) / (1 - e)
    return (w1 * d.y).sum() / w1.sum() - (w0 * d.y).sum() / w0.sum()


def outcome(d):
    z = np.column_stack([np.ones(len(d)), d.a, d.b])
    fit = lambda k: np.linalg.lstsq(z[d.t == k], d.y[d.t == k], rcond=None)[0]
    return float((z @ (fit(1) - fit(0))).mean())


@pytest.mark.parametrize("operator, plain", [(K.ipw, hajek), (K.g_computation, outcome)])
def test_errors_are_those_of_a_bootstrap(spark, operator, plain):
    rng = np.random.default_rng(3)
    d = simulated(rng, 2000)
    r = operator(spark.createDataFrame(d), "t", "y", ["a", "b"]).first()
    draws = [plain(d.iloc[rng.integers(0, len(d), len(d))]) for _ in range(300)]
    assert r.effect == pytest.approx(plain(d), abs=0.01) and r.se == pytest.approx(np.std(draws), rel=0.12)
    assert r.low < 2 < r.high and r.high - r.low == pytest.approx(2 * 1.959964 * r.se, rel=1e-6)


@pytest.mark.parametrize("operator", [K.ipw, K.g_computation, K.doubly_robust])
def test_repeated_rows_of_a_cluster_add_nothing(spark, operator):
    d = simulated(np.random.default_rng(4), 800)
    d["unit"] = np.arange(800)
    once = operator(spark.createDataFrame(d), "t", "y", ["a", "b"], cluster="unit").first()
    often = operator(spark.createDataFrame(pd.concat([d] * 4)), "t", "y", ["a", "b"], cluster="unit").first()
    assert often.effect == pytest.approx(once.effect, abs=0.02) and often.se == pytest.approx(once.se, rel=0.03) and often.n == 4 * once.n
    assert operator(spark.createDataFrame(pd.concat([d] * 4)), "t", "y", ["a", "b"]).first().se < 0.6 * often.se


def test_positivity(spark):
    d = simulated(np.random.default_rng(5), 1000)
    r = K.positivity(spark.createDataFrame(d), "t", ["a", "b"]).first()
    assert r.status == "ADEQUATE" and 0 < r.propensity_min < r.propensity_max < 1 and r.shared_width > 0.5
    d["far"] = 20.0 * d.t + d.a
    assert K.positivity(spark.createDataFrame(d), "t", ["far"]).first().status == "CAUTION"


def test_longitudinal_models_learn_from_counts(spark, monkeypatch):
    """A period's models see a row for each kind of row, weighted, not the rows."""
    seen = []

    class Fit(K.LogisticRegression):
        def fit(self, dataset, params=None):
            seen.append(dataset.count())
            return super().fit(dataset, params)

    monkeypatch.setattr(K, "LogisticRegression", Fit)
    rows = spark.range(1500).select((F.col("id") % 500).alias("u"), F.floor(F.col("id") / 500).alias("p"), (F.pmod(F.xxhash64("id"), F.lit(3)) > 0).cast("int").alias("t"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(4)).alias("c"))
    found = K.longitudinal(rows.withColumn("y", 5 * F.col("t") + F.col("c")), "u", "p", "t", "y", ["c"]).first()
    assert len(seen) == 6 and max(seen) <= 16
    assert found["estimate"] == pytest.approx(5, abs=0.3) and found["periods"] == 3
