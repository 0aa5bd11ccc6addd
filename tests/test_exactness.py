"""Operators that must stay exact at any number of groups, values or pairs, against plain counting."""

import re
from collections import Counter
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from millrace.operators import aggregates as A
from millrace.operators import cleaning as C
from millrace.operators import pairs
from millrace.operators import quality as Q
from millrace.operators import ranks
from millrace.operators import rows as R
from millrace.operators import screens as K
from millrace.operators.inference import wilcoxon
from millrace.sources import files as S


def tau(x, y):
    s = (np.sign(x[None, :] - x[:, None]) * np.sign(y[None, :] - y[:, None])).sum() / 2
    ties = lambda v: sum(k * (k - 1) / 2 for k in np.unique(v, return_counts=True)[1])
    pairs = len(x) * (len(x) - 1) / 2
    return s / np.sqrt((pairs - ties(x)) * (pairs - ties(y)))


@pytest.mark.parametrize("fit", [pairs.FIT, 400])
@pytest.mark.parametrize("kind", ["continuous", "tied", "hot"])
def test_kendall_is_exact(spark, monkeypatch, kind, fit):
    """Also where groups have to be cut twice before they fit."""
    monkeypatch.setattr(pairs, "FIT", fit)
    monkeypatch.setattr(pairs, "GRID", 4 if fit == 400 else pairs.GRID)
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=3000), rng.normal(size=3000)
    if kind == "tied":
        x, y = rng.integers(0, 5, 3000).astype(float), y.round(1)
    if kind == "hot":
        x, y = np.where(rng.random(3000) < 0.4, 3.0, x), np.where(rng.random(3000) < 0.3, 0.0, y)
    y = y + 0.3 * x
    got = K.kendall(spark.createDataFrame(pd.DataFrame({"x": x, "y": y})), "x", "y").first()
    assert got.n == 3000 and got.tau == pytest.approx(tau(x, y), rel=1e-12)


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        now = [i]
        for j, d in enumerate(b, 1):
            now.append(min(row[j] + 1, now[-1] + 1, row[j - 1] + (c != d)))
        row = now
    return row[-1]


def test_fuzzy_categories_of_any_number(spark):
    rng = np.random.default_rng(2)
    words = ["".join(rng.choice(list("abcdef"), rng.integers(1, 9))) for _ in range(700)]
    words += ["United States", "United-States", "united states", "Unted States", "United States", "GREY", "grey."]
    n = Counter(words)
    bare = lambda w: re.sub("[^A-Za-z0-9]", "", w).lower()

    def like(a, b):
        longest = max(len(a), len(b))
        return abs(len(a) - len(b)) <= 0.2 * longest and 5 * edits(a.lower(), b.lower()) <= longest or bare(a) == bare(b)

    want = {}
    for a in n:
        better = [(n[b], b) for b in n if a != b and (n[b] > n[a] or n[b] == n[a] and b < a) and like(a, b)]
        want[a] = max(better)[1] if better else a
    for a in want:  # chains end in one spelling
        while want[want[a]] != want[a]:
            want[a] = want[want[a]]
    df = spark.createDataFrame([(w,) for w in words], "c string").withColumn("old", F.col("c"))
    got = {r.old: r.c for r in C.merge_fuzzy_categories(df, "c").collect()}
    assert len(n) > 500 and got == want


@pytest.mark.parametrize("few", [500, 100_000])
def test_column_quantiles(spark, monkeypatch, few):
    monkeypatch.setattr(ranks, "FEW", few)
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=20000).round(3), np.zeros(15000)])
    frame = pd.DataFrame({"x": x, "y": np.arange(35000.0), "z": rng.exponential(size=35000)})
    points = [0, 0.003, 0.25, 0.5, 0.77, 0.999, 1]
    got = ranks.column_quantiles(spark.createDataFrame(frame), list("xyz"), points)
    for c in "xyz":
        assert np.allclose(got[c], np.quantile(frame[c], points), rtol=1e-12)
    small = spark.createDataFrame([(1.0,), (None,), (5.0,), (float("nan"),)], "x double")
    assert ranks.column_quantiles(small, ["x"], [0.5, 1]) == {"x": [3.0, 5.0]}
    assert ranks.column_quantiles(small.limit(0), ["x"], [0.5]) == {"x": [None]}


def test_no_percentile_over_raw_rows():
    for path in Path(ranks.__file__).parent.glob("*.py"):
        text = path.read_text()
        used = re.findall(r"F\.(?:percentile|median)\(.*", text)
        # one row a resample, and one row a period
        assert all('"mean"' in u or '"change"' in u for u in used), (path, used)


def test_frames_equal_sees_cells(spark):
    a = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0), (None, None, None)], "i long, s string, x double")
    swapped = spark.createDataFrame([(1, "b", 1.0), (2, "a", 2.0), (None, None, None)], a.schema)
    equal = lambda x, y: Q.frames_equal(x, y).first()["equal"]
    assert equal(a, a.orderBy("x")) and equal(a, a.withColumn("x", F.col("x") + 1e-9))
    assert not equal(a, swapped) and not equal(a, a.withColumn("x", F.col("x") + 1e-3)) and not equal(a, a.union(a.limit(1)))
    assert equal(a.select("x"), swapped.select("x")) and not equal(a.select("i"), a.select((F.col("i") + 2**53).alias("i")))
    many = spark.range(60_000).select(F.col("id").cast("string").alias("t"))
    assert equal(many, many) and not equal(many, many.withColumn("t", F.when(F.col("t") == "77", "x").otherwise(F.col("t"))))
    digest = lambda d: Q.relation_digest(d).first()
    assert digest(a) == digest(a.orderBy("x")) != digest(swapped)


def test_filters_of_every_kind(spark):
    df = spark.createDataFrame([(2**53, 1.5, "a", True, 3), (2**53 + 1, 2.5, "B", False, 2), (None, None, None, None, None)], "k long, x double, t string, b boolean, n int")
    n = lambda *c: R.where(df, list(c)).count()
    assert n(("k", "=", 2**53 + 1)) == 1 and n(("k", "=", 1.5)) == 0 and n(("k", "!=", 1.5)) == 2
    assert n(("n", ">", 2.5)) == 1 and n(("n", ">=", 2.5)) == 1 and n(("n", "<", 2.5)) == 1 and n(("n", "<=", 2.5)) == 1 and n(("n", "between", (1.5, 2.5))) == 1
    assert n(("or", [("t", "=", "b"), ("x", "<", 2)])) == 2 and n(("not", ("b", "=", "yes"))) == 1 and n(("n", ">", F.col("x"))) == 1
    assert n(("or", [("k", "is null"), ("and", [("x", ">", 2), ("t", "in", ["b"])])])) == 2
    text = lambda t: R.filter_text(df, t).count()
    assert text("x > 1 AND t in ('a', 'b, or x'), n between 2 and 3") == 1 and text("t is null") == 1 and text("t = 'it''s'") == 0
    for bad in ("x > 1 or n > 1", "max(k) > 1", "x > 1 -- y", "t = 'a'; drop table x", "x in (select 1)", ""):
        with pytest.raises(ValueError):
            R.filter_text(df, bad)
    with pytest.raises(ValueError):
        R.row_predicate(df, "sum(k) > 1")


def test_delimited_files_keep_their_rows(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("North\nregion,v,w\nNorth,1,2\nregion,3,4\n,5,6\nregion,v,w\nSouth€,7\nX,1,2,3\n".encode("cp1252"))
    df, report = S.read_delimited(spark, str(tmp_path / "a.csv"))
    got = sorted(tuple(r) for r in df.na.fill("").collect())
    assert got == [("", "5", "6"), ("North", "1", "2"), ("South€", "7", ""), ("X", "1", "2"), ("region", "3", "4"), ("region", "v", "w")]
    r = report.first()
    assert (r.encoding, r.banner_lines, r.rows, r.short_rows, r.long_rows) == ("windows-1252", 1, 6, 1, 1)


def test_sql_reads_registered_views_only(spark):
    spark.range(5).createOrReplaceTempView("secret_of_test")
    for bad in (
        "SELECT count(*) FROM seen_of_test, secret_of_test", "SELECT (SELECT max(id) FROM secret_of_test) FROM seen_of_test", "SELECT * FROM range(3)",
        "WITH secret_of_test AS (SELECT 1) SELECT * FROM secret_of_test", "SELECT id FROM seen_of_test WHERE id IN (SELECT id FROM secret_of_test)",
    ):
        with pytest.raises(PermissionError):
            S.run_sql(spark, bad, {"seen_of_test": spark.range(3)})
    assert S.run_sql(spark, "WITH a AS (SELECT * FROM seen_of_test) SELECT count(*) AS n FROM a, seen_of_test", {"seen_of_test": spark.range(3)}).first()["n"] == 9


def test_fuzzy_categories_of_any_script(spark):
    values = ["北京"] * 2 + ["上海", "Москва", "Москва", "москва!", "?", "??", "--"] + ["colour"] * 9 + ["colours"] * 4 + ["colourss"] * 2 + ["e\u0301te\u0301"] * 3 + ["e\u0301te\u0301."]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "c string").withColumn("old", F.col("c"))
    got = {r.old: r.c for r in C.merge_fuzzy_categories(df, "c").collect()}
    same = {v: v for v in values} | {None: None, "москва!": "Москва", "colours": "colour", "colourss": "colour", "e\u0301te\u0301.": "e\u0301te\u0301"}
    assert got == same


def hashed(spark, rows, schema):
    return tuple(C.content_hash(spark.createDataFrame(rows, schema)).first())


def test_content_hash_tells_rows_apart(spark):
    pairs = [([(None,)], [("\x00",)], "a string"), ([("1\x1fb=2", "3")], [("1", "2\x1fb=3")], "a string, b string"), ([("1:-",)], [("-",)], "a string"), ([(["a, b"],)], [(["a", "b"],)], "a array<string>"),
             ([("x", "y")], [("y", "x")], "a string, b string"), ([("x",), ("x",)], [("x",)], "a string"), ([("x",), ("y",)], [("x",), ("x",)], "a string"), ([((None,),)], [(None,)], "a struct<b:int>"), ([(bytearray(b"a"),)], [(bytearray(b"\xff"),)], "a binary")]
    for x, y, schema in pairs:
        assert hashed(spark, x, schema) != hashed(spark, y, schema)
    rows = [(i % 7, f"t{i % 5}", i / 3) for i in range(50)]
    one, other = spark.createDataFrame(rows, "a int, b string, c double"), spark.createDataFrame(rows[::-1], "a int, b string, c double").select("c", "a", "b").repartition(5)
    assert C.content_hash(one).first() == C.content_hash(other).first() != C.content_hash(one.withColumnRenamed("a", "z")).first()
    assert C.content_hash(one.limit(0)).first().rows == 0 and hashed(spark, [(0.0,)], "a double") == hashed(spark, [(-0.0,)], "a double")


def equal(spark, x, y, schema="a double, b double"):
    return Q.frames_equal(spark.createDataFrame(x, schema), spark.createDataFrame(y, schema)).first().equal


def test_frames_equal_within_the_tolerance(spark):
    near = 1.0000000001
    assert equal(spark, [(1.0, 5.0), (near, 3.0)], [(near, 5.0), (1.0, 3.0)])
    assert not equal(spark, [(1.0, 5.0), (2.0, 3.0)], [(1.0, 3.0), (2.0, 5.0)])
    assert not equal(spark, [(1.0, 5.0)], [(1.0, 5.0), (1.0, 5.0)])
    nan, inf = float("nan"), float("inf")
    assert equal(spark, [(nan, inf), (None, -inf)], [(None, -inf), (nan, inf)]) and not equal(spark, [(nan, inf)], [(nan, -inf)]) and not equal(spark, [(None, 1.0)], [(0.0, 1.0)])
    assert equal(spark, [(1e12, 0.0)], [(1e12 + 1, 1e-7)]) and not equal(spark, [(1e12, 0.0)], [(1e12 + 1e7, 0.0)])
    assert equal(spark, [], []) and not equal(spark, [], [(1.0, 1.0)])
    dense = [(k * 5e-7, float(k % 2)) for k in range(3000)]  # values linked by steps within the tolerance, far apart at their ends
    assert equal(spark, dense, [(x + 1e-8, y) for x, y in dense[::-1]])
    assert not equal(spark, dense, [*dense[:-1], (0.0, dense[-1][1])])
    assert equal(spark, [(1, "x"), (2, None)], [(2, None), (1, "x")], "a int, b string") and not equal(spark, [(1, "x")], [(1, None)], "a int, b string")


@pytest.mark.parametrize("sql", ["SELECT java_method('java.lang.System', 'getenv', 'HOME') FROM v", "SELECT reflect('a', 'b') FROM v", "SELECT id FROM v WHERE EXISTS (SELECT try_reflect('a', 'b'))", "SELECT id FROM v WHERE id IN (SELECT id FROM other)", "SELECT * FROM range(5)", "SELECT id FROM v ORDER BY (SELECT max(id) FROM other)", "SELECT input_file_name() FROM v", "SELECT system.builtin.java_method('a', 'b') FROM v"])
def test_guarded_sql_refuses(spark, sql):
    with pytest.raises(PermissionError):
        S.run_sql(spark, sql, {"v": spark.range(3)})


def test_guarded_sql_reads_texts_as_texts(spark):
    assert S.run_sql(spark, "SELECT 'UnresolvedRelation [zzz] java_method(1)' AS x FROM v", {"v": spark.range(3)}).count() == 3


@pytest.mark.parametrize("per_range", [700, ranks.PER_RANGE])
def test_ranges_grow_with_the_rows(spark, monkeypatch, per_range):
    """More ranges, the same ranks, quantiles and numbers; 300 edges and more are searched run by run."""
    rng = np.random.default_rng(6)
    frame = pd.DataFrame({"g": rng.integers(0, 3, 60_000), "x": np.concatenate([rng.normal(size=40_000), np.full(20_000, 0.5)])})
    df = spark.createDataFrame(frame)
    monkeypatch.setattr(ranks, "PER_RANGE", per_range)
    edges = ranks.bounds_of(df, F.col("x"))
    assert len(edges) == (0 if per_range > 60_000 else len(edges)) and (per_range > 60_000 or 40 < len(edges) < 90)
    got = ranks.ranked(df, "x", ["g"]).toPandas().sort_values(["g", "value"])
    for g, part in got.groupby("g"):
        values, counts = np.unique(frame.x[frame.g == g], return_counts=True)
        assert (part.value.to_numpy() == values).all() and (part.n.to_numpy() == counts).all() and (part.below.to_numpy() == np.cumsum(counts) - counts).all()
    placed = ranks.numbered(df, ["g"], "x").toPandas().sort_values(["g", "place"])
    for _, part in placed.groupby("g"):
        assert (part.place.to_numpy() == np.arange(1, len(part) + 1)).all() and (np.diff(part.x) >= 0).all()


def test_bucketed_by_many_edges(spark):
    from millrace.functions.scalars import bucketed

    rng = np.random.default_rng(7)
    for n in (0, 1, 32, 33, 100, 2047):
        edges = sorted(set(rng.normal(size=n).tolist()))
        x = np.concatenate([rng.normal(size=300), edges[:50], [-np.inf, np.inf]])
        got = spark.createDataFrame([(float(v),) for v in x], "x double").select(bucketed(F.col("x"), edges).alias("b")).toPandas().b
        assert (got.to_numpy() == np.searchsorted(edges, x, side="right")).all()


@pytest.mark.parametrize("per_range", [3000, ranks.PER_RANGE])
def test_averages_and_charts_of_one_long_series(spark, monkeypatch, per_range):
    monkeypatch.setattr(ranks, "PER_RANGE", per_range)
    rng = np.random.default_rng(9)
    v = rng.normal(size=100_000) + np.where(np.arange(100_000) % 20_000 > 15_000, 1.5, 0)
    df = spark.createDataFrame(pd.DataFrame({"t": np.arange(100_000), "v": v})).select(F.lit(None).cast("string").alias("k"), "t", "v").union(spark.createDataFrame([("few", 1, 2.0), ("few", 2, 4.0), ("none", 1, None)], "k string, t long, v double")).repartition(5)
    ema = v[0]
    for x in v[1:]:
        ema = 0.1 * x + 0.9 * ema
    got = {r.k: r.ema for r in R.exponential_average(df, ["k"], "t", "v", 19).collect()}
    assert got[None] == pytest.approx(ema, rel=1e-12) and got["few"] == pytest.approx(2.2) and len(got) == 2
    mean, sd, up, down, alarms = v[:20].mean(), v[:20].std(), 0.0, 0.0, 0
    for x in v[20:]:
        up, down = max(0.0, up + x - mean - 0.5 * sd), max(0.0, down - x + mean - 0.5 * sd)
        if up > 4 * sd or down > 4 * sd:
            up, down, alarms = 0.0, 0.0, alarms + 1
    charts = {r.k: (r.alarms, r.n) for r in R.control_chart(df, ["k"], "t", "v").collect()}
    assert charts == {None: (alarms, 100_000), "few": (0, 2)} and alarms > 100
    assert [tuple(r) for r in R.control_chart(df.filter("k IS NULL"), [], "t", "v").collect()] == [(alarms, 100_000)]


@pytest.mark.parametrize("few", [200, 100_000])
@pytest.mark.parametrize("kind", ["continuous", "tied", "one"])
def test_bootstrap_of_a_quantile(spark, monkeypatch, few, kind):
    """Every resample's quantile is numpy's of the rows repeated by their weights; what is shuffled does not grow with the rows."""
    from millrace.operators import resampling as B

    monkeypatch.setattr(B, "FEW", few)
    rng = np.random.default_rng(11)
    x = rng.exponential(size=6000) if kind == "continuous" else rng.integers(0, 4, 6000).astype(float) if kind == "tied" else np.full(6000, 2.5)
    df = spark.createDataFrame(pd.DataFrame({"k": np.arange(6000), "x": x})).repartition(4)
    rows = B.keyed(df, "k", 7, v="x")
    table = rows.toPandas()
    w = B.weights(table.h.to_numpy(), 40)
    assert abs(w.mean() - 1) < 0.02 and abs(w.var() - 1) < 0.03
    for q in (0.5, 0.9):
        want = [np.quantile(np.repeat(table.v.to_numpy(), w[:, r]), q) for r in range(40)]
        assert np.allclose(B.quantile_replicates(rows, q, 40), want, rtol=1e-12)
    sums = B.weighted_sums(rows, ["v"], 40)
    assert np.allclose(sums[0], table.v.to_numpy() @ w)


def test_bootstrap_of_nothing(spark):
    from millrace.operators import resampling as B

    empty = spark.createDataFrame([(1, None)], "k long, x double")
    for kind in ("mean", "quantile"):
        assert tuple(B.bootstrap(empty, "x", "k", kind).first()) == (None, None, None, 0)


def test_sketches_rule_out_and_never_lose(spark):
    from millrace.operators import joins as J

    rng = np.random.default_rng(12)
    sets = {"a": np.arange(20_000), "b": np.arange(10_000, 30_000), "c": np.arange(19_000, 60_000), "d": np.arange(50), "e": np.arange(19_950, 20_050), "f": np.arange(100_000, 100_020), "g": rng.permutation(20_000)[:9_000]}
    tables = {f"t{n}": spark.createDataFrame(pd.DataFrame({f"{n}_user_id": v.astype(float if n == "c" else np.int64), "other": 1})).repartition(3) for n, v in sets.items()}
    sketch = {n: J.sketches(tables[f"t{n}"], [f"{n}_user_id"])[f"{n}_user_id"] for n in sets}
    score = lambda x, y: max(len(x & y) / len(x | y), 0.9 * len(x & y) / min(len(x), len(y)))
    want, joined = set(), 0
    for i, p in enumerate(sorted(sets)):
        assert len(sketch[p]) == min(J.SKETCH, len(sets[p])) and (np.diff(sketch[p].astype(float)) > 0).all()
        for q in sorted(sets)[i + 1 :]:
            x, y = set(sets[p].tolist()), set(sets[q].tolist())
            may = J.may_overlap(sketch[p], sketch[q], 0.5)
            joined += may
            assert may or score(x, y) < 0.5
            if score(x, y) >= 0.5:
                want.add((f"t{p}", f"t{q}", round(score(x, y), 9)))
            for s, t in ((p, q), (q, p)):
                assert not J.missing_from(sketch[s], sketch[t])[1] or not set(sets[s].tolist()) <= set(sets[t].tolist())
    assert {(r.left, r.right, round(r.score, 9)) for r in J.discover_joins(tables).collect()} == want and joined <= 16  # of 21; of a few values too little shows
    named = {n: df.withColumnRenamed(df.columns[0], "user_id") for n, df in tables.items()}
    found = {(r.child, r.parent) for r in J.foreign_keys(named).filter("column = 'user_id'").collect()}
    holds = lambda x, y: set(sets[x].tolist()) <= set(sets[y].tolist())
    assert found == {(f"t{p}", f"t{q}") for p in sets for q in sets if p != q and holds(p, q)}


def test_signed_ranks_of_many_ties(spark):
    """The cube of 2.1 million tied rows is beyond a long."""
    n = 2_100_000
    r = wilcoxon(spark.range(n).select(F.lit(3.0).alias("x"), F.lit(1.0).alias("y")), "x", "y").first()
    assert (r["statistic"], r["n"]) == (n * (n + 1) / 2, n)
    assert r["z"] == pytest.approx(n * (n + 1) / 4 / (n * (n + 1) * (2 * n + 1) / 24 - (n**3 - n) / 48) ** 0.5)


def test_frames_equal_ranks_only_buckets_that_differ(spark, monkeypatch):
    """Rows in another order are not ranked, two swapped cells only with the rows of their buckets; equal rows are ranked once."""
    seen, near_ranks = [], Q.near_ranks
    monkeypatch.setattr(Q, "near_ranks", lambda df, *more: seen.append(df.count()) or near_ranks(df, *more))
    a = spark.range(20_000).select("id", (F.col("id") / 7).alias("x"))
    swapped = a.withColumn("id", F.when(F.col("id") == 3, 17).when(F.col("id") == 17, 3).otherwise(F.col("id")))
    equal = lambda x, y: Q.frames_equal(x, y).first().equal
    assert equal(a, a.repartition(5, "x")) and not equal(a, a.union(a.limit(1))) and not seen
    assert not equal(a, swapped) and 4 <= seen[0] < 200
    seen.clear()
    again = spark.range(5_000).select((F.col("id") % 10).cast("double").alias("x"))
    assert equal(again, again.select((F.col("x") + 1e-9).alias("x"))) and seen == [20]
    flags = [(None, 1.0), (1.0, None)]
    assert not equal(spark.createDataFrame(flags, "a double, b double"), spark.createDataFrame([(1.0, 1.0), (None, None)], "a double, b double"))


@pytest.mark.parametrize("places", [3, Q.PLACES])
def test_frames_equal_compares_runs_of_repeated_rows(spark, monkeypatch, places):
    """Chains of near values with repeats: the answer is that of both sides sorted and compared place by place."""
    monkeypatch.setattr(Q, "PLACES", places)
    rng = np.random.default_rng(5)
    answers = []
    for shift in (0, 1, 2):  # steps of 0.6 of the tolerance: one is near, two are not
        x = np.sort(rng.integers(0, 40, 300))
        y = np.sort(np.where(rng.random(300) < 0.2, x + shift * rng.integers(0, 2, 300), x))
        y[0] += shift == 0 and x[0] == x[1]  # a row moved by one step
        answers.append(bool((np.abs(x - y) <= 1).all()))
        assert equal(spark, [(float(v) * 6e-7,) for v in x], [(float(v) * 6e-7 + 1e-9,) for v in rng.permutation(y)], "a double") == answers[-1]
    assert set(answers) == {True, False}


def shuffled(plan):
    """The most rows that one exchange of a plan that has run has written."""
    if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        return shuffled(plan.executedPlan())
    inner = [plan.plan()] if plan.getClass().getSimpleName().endswith("QueryStageExec") else [plan.children().apply(i) for i in range(plan.children().size())]
    own = plan.metrics().get("shuffleRecordsWritten")
    return max([own.get().value() if own.isDefined() else 0, *map(shuffled, inner)])


@pytest.mark.parametrize("groups", [["g"], []])
def test_group_quantiles_shuffle_only_ranges_they_fall_into(spark, monkeypatch, groups):
    """Median distances from the median, as numpy has them, without a shuffle of all rows or of all values, and without Spark's own choice to broadcast."""
    monkeypatch.setattr(ranks, "PER_RANGE", 1000)
    rng = np.random.default_rng(8)
    frame = pd.DataFrame({"g": np.where(rng.random(60_000) < 0.9, "a", "b"), "x": np.concatenate([rng.normal(size=50_000), np.full(10_000, 0.25)])})
    df = spark.createDataFrame(frame).union(spark.createDataFrame([("a", None), ("c", None)], "g string, x double"))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = A.aggregate(df, "mad", "x", groups)
        got = {r["g"] if groups else "": (r["value"], r["row_count"]) for r in found.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    mad = lambda x: np.median(np.abs(x - np.median(x)))
    want = {g: mad(part.x) for g, part in frame.groupby("g")} if groups else {"": mad(frame.x)}
    assert {k: v[0] for k, v in got.items() if v[0] is not None} == pytest.approx(want)
    assert {k: v[1] for k, v in got.items()} == ({"a": (frame.g == "a").sum() + 1, "b": (frame.g == "b").sum(), "c": 1} if groups else {"": 60_002})
    assert shuffled(found._jdf.queryExecution().executedPlan()) < 15_000


@pytest.mark.parametrize("few", [0, ranks.FEW])
def test_quantiles_of_many_groups_in_ranges(spark, monkeypatch, few):
    """Every range is some group's, NaN comes last, facts of groups are broadcast or not: the same quantiles."""
    monkeypatch.setattr(ranks, "PER_RANGE", 500)
    monkeypatch.setattr(ranks, "FEW", few)
    g = np.repeat(np.arange(60), 400)
    x = g * 10 + np.random.default_rng(9).integers(0, 30, len(g)) / 2
    x[-300:] = np.nan
    df = spark.createDataFrame([(int(k), float(v)) for k, v in zip(g, x)], "g int, x double")
    got = ranks.group_quantiles(df, "x", {"low": 0.1, "high": 0.9}, ["g"]).toPandas().sort_values("g")
    want = np.array([np.quantile(np.sort(x[g == k]), [0.1, 0.9]) if k < 59 else [np.sort(x[g == k])[39] * 0.1 + np.sort(x[g == k])[40] * 0.9, np.nan] for k in range(60)])
    assert got.low.to_numpy() == pytest.approx(want[:, 0]) and got.high.to_numpy() == pytest.approx(want[:, 1], nan_ok=True)
