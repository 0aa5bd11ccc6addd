"""Models that learn from counts of equal rows agree with those that learn from the rows."""

import pytest
from pyspark.sql import functions as F

from millrace.operators import learning as M


def test_models_learn_from_counts_as_from_rows(spark, monkeypatch):
    n = F.col("id")
    rows = spark.range(6000).select("id", (F.xxhash64(n) % 7).cast("double").alias("a"), F.when(n % 11 > 0, (F.xxhash64(n, F.lit(1)) % 5).cast("double")).alias("b"), F.when(n % 3 > 0, F.lit("x")).otherwise("y").alias("c"))
    rows = rows.withColumn("y", 3 * F.col("a") + F.coalesce("b", F.lit(0.0)) + F.when(F.col("c") == "x", 4).otherwise(0) + F.pmod(F.xxhash64(n, F.lit(2)), F.lit(100)) / 25)
    rows = rows.withColumn("label", (F.col("y") > 4).cast("int")).cache()
    features, small = ["a", "b", "c"], {"trees": 3, "depth": 4}

    def found():
        return [
            M.classify(rows, "id", "label", features, **small).collect(),
            M.cross_validated(rows, "id", "label", features, folds=2, trees=1, depth=4).collect(),
            M.regress(rows, "id", "y", features, trees=1, depth=4).collect(),
            M.importance(rows.na.drop(), "y", ["a", "b"]).collect(),
        ]

    before = found()
    monkeypatch.setattr(M, "MANY", 1000)
    after = found()
    for old, new in zip(before, after):
        for a, b in zip(old, new):
            assert a[0] == b[0]
            exact = a[0] in ("logistic", "ridge")
            assert [float(x) for x in b[1:]] == pytest.approx([float(x) for x in a[1:]], rel=1e-6 if exact else 0.05, abs=1e-6 if exact else 0.02)
