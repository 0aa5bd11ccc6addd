"""Profiles of tables, quality findings, comparison of versions, drift and outliers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import bucketed, group_label, ratio
from .cleaning import as_text, multiset_sums, row_key
from .lineage import cut
from .ranks import bounds_of, column_quantiles, group_quantiles, trimmed_mean, with_facts


def numeric(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


#: Quantiles of a profile by name.
QUANTILES = {"q25": 0.25, "median": 0.5, "q75": 0.75, "q95": 0.95}


def profile(df: DataFrame) -> DataFrame:
    """One row per column, all exact: rows, nulls, distinct values, and for numbers moments and quantiles.

    One scan gives counts, extremes and moments of all columns. Distinct values are counted column by column, each
    from a scan of that column alone, in one job; quantiles (linear between neighbours) are narrowed from sketches.
    """
    fields = df.schema.fields
    number = {f.name: isinstance(f.dataType, T.NumericType) for f in fields}
    nested = (T.ArrayType, T.MapType, T.StructType)
    value = {f.name: as_text(f) if isinstance(f.dataType, nested) else F.col(f"`{f.name}`") for f in fields}
    least = lambda f: F.min(value[f.name]).cast("string")
    columns, names = [F.count("*").alias("rows")], list(number)
    for i, f in enumerate(fields):
        v = value[f.name].cast("double")
        columns += [F.count(value[f.name]).alias(f"known {i}")]
        columns += [F.min(v).alias(f"min {i}"), F.max(v).alias(f"max {i}"), F.avg(v).alias(f"mean {i}"), F.stddev_samp(v).alias(f"sd {i}")] if number[f.name] else [least(f).alias(f"text {i}")]
    counted = reduce(DataFrame.union, (df.select(value[f.name].alias("v")).agg(F.lit(i).alias("i"), F.count_distinct("v").alias("n")) for i, f in enumerate(fields)))
    with ThreadPoolExecutor(3) as jobs:  # three jobs that do not wait for each other
        facts, distinct, found = (
            jobs.submit(f) for f in (df.agg(*columns).first, lambda: {r["i"]: r["n"] for r in counted.collect()}, lambda: column_quantiles(df, {c: value[c] for c in names if number[c]}, list(QUANTILES.values())))
        )
    facts, distinct, found = facts.result(), distinct.result(), found.result()
    rows = []
    for i, f in enumerate(fields):
        moments = [facts[f"{k} {i}"] if number[f.name] else None for k in ("min", "max", "mean", "sd")]
        rows.append((f.name, f.dataType.simpleString(), facts["rows"], facts["rows"] - facts[f"known {i}"], distinct[i], None if number[f.name] else facts[f"text {i}"], *moments, *(found[f.name] if number[f.name] else [None] * len(QUANTILES))))
    numbers = ", ".join(f"{k} double" for k in ("min", "max", "mean", "sd", *QUANTILES))
    return df.sparkSession.createDataFrame(rows, f"column string, type string, rows long, nulls long, distinct long, min_text string, {numbers}")


def exact_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column, rows, nulls, distinct, min, max, mean and sd of numeric columns, distinct values counted exactly."""
    long = df.select(F.inline(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns))))
    counts = long.groupBy("column", "v").agg(F.count("*").alias("n"))
    n, v = F.col("n"), F.col("v")
    known = F.when(v.isNotNull(), n)
    facts = counts.groupBy("column").agg(F.sum("n").alias("rows"), F.coalesce(F.sum(F.when(v.isNull(), n)), F.lit(0)).alias("nulls"), F.count("v").alias("distinct"), F.min("v").alias("min"), F.max("v").alias("max"), ratio(F.sum(n * v), F.sum(known)).alias("mean"))
    spread = counts.join(F.broadcast(facts.select("column", "mean")), "column").groupBy("column").agg(F.sqrt(ratio(F.sum(n * (v - F.col("mean")) * (v - F.col("mean"))), F.sum(known) - 1)).alias("sd"))
    return facts.join(spread, "column")


def distribution_profile(df: DataFrame, column: str) -> DataFrame:
    """n, mean, median, trimmed_mean (5 % off either end), sd, iqr, skewness, kurtosis, p10 to p99, and the values beyond 1.5 and 3 interquartile ranges.

    Moments are those of the whole column; a column without spread has no skewness, kurtosis or outliers (0), one without values no row. Below 20 values nothing is trimmed.
    """
    rows = df.select(F.col(column).cast("double").alias("v")).filter("v IS NOT NULL AND NOT isnan(v)")
    points = {"p10": 0.1, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9, "p99": 0.99}
    q = dict(zip(points, column_quantiles(rows, ["v"], list(points.values()))["v"]))
    lit = lambda x: F.lit(x).cast("double")
    iqr = q["p75"] - q["p25"] if q["p75"] is not None else None
    far = lambda k: F.count_if((F.col("v") < lit(q["p25"] - k * iqr)) | (F.col("v") > lit(q["p75"] + k * iqr))) if iqr else F.lit(0).cast("long")
    shaped = lambda f: F.when(F.stddev_samp("v") > 1e-12, f("v")).otherwise(0.0)
    facts = rows.agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("sd"), shaped(F.skewness).alias("skewness"), shaped(F.kurtosis).alias("kurtosis"), far(1.5).alias("outliers"), far(3.0).alias("extreme_outliers")).filter("n > 0")
    trimmed = trimmed_mean(rows, "v", 0.05).select("trimmed_mean")
    return facts.crossJoin(trimmed).select("n", "mean", lit(q["p50"]).alias("median"), F.when(F.col("n") >= 20, F.col("trimmed_mean")).otherwise(F.col("mean")).alias("trimmed_mean"), "sd", lit(iqr).alias("iqr"), "skewness", "kurtosis", *(lit(v).alias(k) for k, v in q.items()), "outliers", "extreme_outliers")


def histogram(df: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """bin (from 1) and rows of equal-width bins between the least and the largest value."""
    ends = df.agg(F.min(column).cast("double").alias("low"), F.max(column).cast("double").alias("high"))
    bin_of = F.least(F.width_bucket(F.col(column).cast("double"), F.col("low"), F.col("high"), F.lit(bins)), F.lit(bins))
    return df.filter(F.col(column).isNotNull()).crossJoin(F.broadcast(ends)).groupBy(bin_of.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def top_values(df: DataFrame, column: str, n: int = 10) -> DataFrame:
    return df.filter(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("item")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "item").limit(n)


def candidate_keys(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column and whether it names every row: no nulls, no repeats."""
    facts = exact_profile(df, columns)
    return facts.select("column", ((F.col("nulls") == 0) & (F.col("distinct") == F.col("rows"))).alias("is_key"))


def quality_score(df: DataFrame) -> DataFrame:
    """missing, duplicate and outlier shares and a score of 0 to 100: 30 points for missing, 20 for each of the others, 30 for types and dates that hold by schema."""
    columns = df.columns
    missing = df.agg((reduce(lambda a, b: a + b, (F.count_if(F.col(f"`{c}`").isNull()) for c in columns)) / (F.count("*") * len(columns))).alias("missing_share"))
    repeats = df.groupBy(*columns).count().agg((F.sum(F.col("count") - 1) / F.sum("count")).alias("duplicate_share"))
    found = column_quantiles(df, numeric(df), [0.25, 0.75])
    numbers = [c for c, (q1, _) in found.items() if q1 is not None]
    outside = lambda c: (F.col(c) < found[c][0] - 1.5 * (found[c][1] - found[c][0])) | (F.col(c) > found[c][1] + 1.5 * (found[c][1] - found[c][0]))
    far = df.agg((reduce(lambda a, b: a + b, (F.count_if(outside(c)) for c in numbers)) / (F.count("*") * len(numbers)) if numbers else F.lit(0.0)).alias("outlier_share"))
    score = 30 * (1 - F.col("missing_share")) + 20 * (1 - F.col("duplicate_share")) + 20 * (1 - F.col("outlier_share")) + 30
    return missing.crossJoin(repeats).crossJoin(far).withColumn("score", score)


def column_findings(df: DataFrame, many: float = 0.2, near: float = 0.95) -> DataFrame:
    """column, check and evidence of columns that miss many values, are constant, or nearly so."""
    long = df.select(F.inline(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("v")) for c in df.columns))))
    counts = long.groupBy("column", "v").agg(F.count("*").alias("n"))
    facts = counts.groupBy("column").agg(F.sum("n").alias("rows"), F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("n"))), F.lit(0)).alias("nulls"), F.max(F.when(F.col("v").isNotNull(), F.col("n"))).alias("most"), F.count("v").alias("distinct"))
    check = F.when(F.col("distinct") <= 1, "constant").when(F.col("most") >= near * (F.col("rows") - F.col("nulls")), "near_constant").when(F.col("nulls") >= many * F.col("rows"), "missing")
    return facts.withColumn("check", check).filter("check IS NOT NULL").select("column", "check", "rows", "nulls", "distinct")


def key_violations(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, the rows they have, and their share."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("n"))
    return counts.agg(F.count_if(F.col("n") > 1).alias("repeated_keys"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("rows_of_them"), F.sum("n").alias("rows")).withColumn("share", ratio(F.col("rows_of_them"), F.col("rows")))


def unit_changes(df: DataFrame, time: str, value: str, least: float = 20.0, rows: int = 5) -> DataFrame:
    """Months whose median is twenty times the one before, or a twentieth."""
    dated = df.filter(F.col(time).isNotNull()).withColumn("month", F.date_format(time, "yyyy-MM"))
    months = group_quantiles(dated, value, {"median": 0.5}, ["month"]).join(dated.groupBy("month").agg(F.count(value).alias("n")), "month").filter(F.col("n") >= rows)
    jumps = months.withColumn("ratio", ratio(F.col("median"), F.lag("median").over(Window.orderBy("month"))))  # one row a month
    return jumps.filter((F.col("ratio") >= least) | (F.col("ratio") <= 1 / least))


def class_balance(df: DataFrame, column: str) -> DataFrame:
    """Rows of the rarer and the commoner of two values, their ratio, and a severity."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    facts = counts.agg(F.count("*").alias("classes"), F.min("n").alias("rarer"), F.max("n").alias("commoner"))
    r = ratio(F.col("rarer"), F.col("commoner"))
    return facts.withColumn("ratio", r).withColumn("severity", F.when(F.col("classes") != 2, "not_applicable").when(r < 0.05, "severe").when(r < 0.2, "imbalanced").otherwise("balanced"))


def functional_dependencies(df: DataFrame, columns: Sequence[str], least: float = 0.98) -> DataFrame:
    """determinant, dependent and the share of determinant values with one dependent value."""
    found = []
    for a in columns:
        per = df.filter(F.col(a).isNotNull()).groupBy(a).agg(*(F.min(b).alias(f"low {b}") for b in columns if b != a), *(F.max(b).alias(f"high {b}") for b in columns if b != a))
        shares = per.agg(F.array(*(F.struct(F.lit(a).alias("determinant"), F.lit(b).alias("dependent"), F.avg(F.col(f"low {b}").eqNullSafe(F.col(f"high {b}")).cast("double")).alias("share")) for b in columns if b != a)).alias("rows"))
        found.append(shares.select(F.inline("rows")))
    return reduce(DataFrame.unionByName, found).filter(F.col("share") >= least)


def dominated_groups(df: DataFrame, group: str, value: str) -> DataFrame:
    """Groups of which a few extreme values (over Q3 + 3 IQR, at most 5 % of rows) hold a fifth of the total."""
    rows = df.withColumn(group, group_label(group))
    q = group_quantiles(rows, value, {"q1": 0.25, "q3": 0.75}, [group]).select(group, (F.col("q3") + 3 * (F.col("q3") - F.col("q1"))).alias("high"))
    bounds = q.join(rows.groupBy(group).agg(F.count(value).alias("n"), F.sum(value).alias("total")), group)
    far = with_facts(rows, bounds.filter("n >= 8"), [group]).filter(F.col(value) > F.col("high"))
    facts = far.groupBy(group, "n", "total").agg(F.count("*").alias("extremes"), F.sum(value).alias("held"))
    return facts.withColumn("share", ratio(F.col("held"), F.col("total"))).filter("extremes <= 0.05 * n AND share >= 0.2")


def same_row(columns: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, (F.col(f"b.{c}").eqNullSafe(F.col(f"a.{c}")) for c in columns)) if columns else F.lit(True)


def compare(before: DataFrame, after: DataFrame, keys: Sequence[str]) -> DataFrame:
    """added, removed, changed and unchanged keys; null and repeated keys are counted apart and left out."""
    known = reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in keys))
    values = [c for c in before.columns if c in after.columns and c not in keys]

    def once(df: DataFrame) -> DataFrame:
        return df.filter(known).groupBy(*keys).agg(F.count("*").alias("n"), *(F.first(c).alias(c) for c in values))

    both = once(before).alias("b").join(once(after).alias("a"), reduce(lambda x, y: x & y, (F.col(f"b.{k}") == F.col(f"a.{k}") for k in keys)), "full_outer")
    repeated = (F.coalesce("b.n", F.lit(0)) > 1) | (F.coalesce("a.n", F.lit(0)) > 1)
    state = F.when(repeated, "repeated").when(F.col("b.n").isNull(), "added").when(F.col("a.n").isNull(), "removed").when(same_row(values), "unchanged").otherwise("changed")
    return both.select(state.alias("state")).groupBy("state").agg(F.count("*").alias("keys"))


def changed_cells(before: DataFrame, after: DataFrame, keys: Sequence[str]) -> DataFrame:
    """column and keys whose value changed; null and repeated keys are left out."""
    values = [c for c in before.columns if c in after.columns and c not in keys]
    once = lambda d: d.groupBy(*keys).agg(F.count("*").alias("rows of key"), *(F.first(c).alias(c) for c in values)).filter("`rows of key` = 1")
    both = once(before).alias("b").join(once(after).alias("a"), reduce(lambda x, y: x & y, (F.col(f"b.{k}") == F.col(f"a.{k}") for k in keys)))
    return both.agg(F.array(*(F.struct(F.lit(c).alias("column"), F.count_if(~F.col(f"b.{c}").eqNullSafe(F.col(f"a.{c}"))).alias("changed")) for c in values)).alias("rows")).select(F.inline("rows"))


def missing_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """column, its null share in both versions, and the difference."""
    columns = [c for c in before.columns if c in after.columns]
    shares = lambda d, n: d.agg(F.array(*(F.struct(F.lit(c).alias("column"), F.avg(F.col(f"`{c}`").isNull().cast("double")).alias(n)) for c in columns)).alias("rows")).select(F.inline("rows"))
    return shares(before, "before").join(F.broadcast(shares(after, "after")), "column").withColumn("delta", F.col("after") - F.col("before"))


def numeric_delta(before: DataFrame, after: DataFrame, column: str) -> DataFrame:
    """Mean, median and spread in both versions, and the mean's change against the old spread."""
    middle = lambda d: F.lit(column_quantiles(d, [column], [0.5])[column][0]).cast("double")
    facts = lambda d, n: d.agg(F.avg(column).alias(f"mean_{n}"), F.stddev_pop(column).alias(f"sd_{n}")).withColumn(f"median_{n}", middle(d))
    return facts(before, "before").crossJoin(facts(after, "after")).withColumn("shift", ratio(F.col("mean_after") - F.col("mean_before"), F.col("sd_before")))


def category_delta(before: DataFrame, after: DataFrame, column: str) -> DataFrame:
    """item and whether it is added or removed."""
    b, a = before.select(F.col(column).alias("item")).distinct(), after.select(F.col(column).alias("item")).distinct()
    return a.join(b, "item", "left_anti").withColumn("state", F.lit("added")).union(b.join(a, "item", "left_anti").withColumn("state", F.lit("removed")))


#: Buckets of rows that are compared by digests, and places of a class in one task.
BUCKETS, PLACES = 4096, 500_000


def relation_digest(df: DataFrame) -> DataFrame:
    """rows and two sums over the SHA-256 of each row: equal for the same rows in any order, and for no others but by chance of 2 ** -100."""
    key = row_key(df, sorted(df.columns))
    first, second = multiset_sums(key)[:2]
    return df.agg(F.count("*").alias("rows"), first.alias("first"), second.alias("second"))


def near_ranks(df: DataFrame, column: str, tolerance: float) -> DataFrame:
    """value, rank: the distinct values of a column, those at most the tolerance from the value before under one rank (null: -1).

    Values are cut into ranges; in each the gaps over the tolerance are counted up, and a range goes on from the counts before it.
    """
    values = df.select(F.col(column).alias("value")).filter("value IS NOT NULL").distinct()
    edges = bounds_of(values, F.col("value"))
    ranged = values.withColumn("range", bucketed(F.col("value"), edges))
    inside = Window.partitionBy("range").orderBy("value")
    gaps = ranged.withColumn("step", (F.col("value") - F.lag("value").over(inside) > tolerance * F.greatest(F.lit(1.0), F.abs("value"))).cast("long"))
    counted = gaps.withColumn("in range", F.sum(F.coalesce("step", F.lit(0))).over(inside))
    ends = counted.groupBy("range").agg(F.min("value").alias("least"), F.max("value").alias("most"), F.max("in range").alias("steps"))
    before = Window.orderBy("range")  # a row a range
    jump = F.coalesce((F.col("least") - F.lag("most").over(before) > tolerance * F.greatest(F.lit(1.0), F.abs("least"))).cast("long"), F.lit(0))
    offsets = ends.withColumn("jump", jump).select("range", (F.sum("jump").over(before) + F.coalesce(F.sum("steps").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("offset"))
    return counted.join(F.broadcast(offsets), "range").select("value", (F.col("in range") + F.col("offset")).alias("rank"))


def frames_equal(a: DataFrame, b: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Whether two results hold the same rows, in any order and as often; fractions may differ by a tolerance.

    The tolerance is absolute up to 1 and relative beyond. Rows are dealt into buckets by their exact columns; buckets whose rows have equal
    sums of 128 bits of hashes on both sides hold the same rows (others but by chance of 2 ** -100) and are done with, without a shuffle of them.
    What is left goes on as counts of equal rows. Values of a column that are linked by steps within the tolerance share a rank, on both sides, so
    that fractions that are nearly equal never sort rows apart: rows of the same other columns and ranks form a class. Where
    all values of a class lie within the tolerance, its rows are counted. In any other class rows are put in the order of the fractions that
    spread there, and each pair at one place is compared, which is exact where one column spreads. Infinities and NaN equal themselves only.
    """
    answer = lambda equal: a.sparkSession.createDataFrame([(equal,)], "equal boolean")
    if sorted(a.columns) != sorted(b.columns):
        return answer(False)
    fraction = lambda d: {f.name for f in d.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType))}
    loose = sorted(fraction(a) | fraction(b))
    exact = sorted(set(a.columns) - set(loose))
    each, numbers = range(len(loose)), [f"c{i}" for i in range(len(loose))]

    def keyed(df: DataFrame, sign: int) -> DataFrame:
        return df.select(row_key(df, exact).alias("key"), *(F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate(loose)), F.lit(sign).alias("sign"))

    rows = keyed(a, 1).union(keyed(b, -1)).withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(BUCKETS)))
    # two hashes of all cells, a null told from its neighbour, added up in parts of 22 bits, which 2 ** 41 rows do not overflow
    digest = lambda salt: F.xxhash64(F.lit(salt), "key", *(x for c in numbers for x in (F.col(c).isNull(), F.col(c))))
    parts = [F.sum(F.shiftrightunsigned(h, bits).bitwiseAND(2**22 - 1)) for h in ("h0", "h1") for bits in (0, 22, 44)]
    digests = rows.withColumns({"h0": digest(0), "h1": digest(1)}).groupBy("bucket", "sign").agg(F.count("*"), *parts).collect()  # two rows a bucket at most
    sides = [{r["bucket"]: tuple(r)[2:] for r in digests if r["sign"] == sign} for sign in (1, -1)]
    unlike = sorted(k for k in sides[0].keys() | sides[1].keys() if sides[0].get(k) != sides[1].get(k))
    if not unlike or not loose or any(sides[0].get(k, (0,))[0] != sides[1].get(k, (0,))[0] for k in unlike):
        return answer(not unlike)
    of_side = lambda sign: F.count_if(F.col("sign") == sign)
    rows = cut(rows.filter(F.col("bucket").isin(unlike)).groupBy("key", *numbers).agg(of_side(1).alias("a"), of_side(-1).alias("b")))
    for i in each:
        c = F.col(f"c{i}")
        odd = F.isnan(c) | (F.abs(c) == float("inf"))
        ranks = near_ranks(rows.filter(~odd), f"c{i}", tolerance).select(F.col("value").alias(f"v{i}"), F.col("rank").cast("string").alias(f"r{i}"))
        rows = rows.join(ranks, c == F.col(f"v{i}"), "left").withColumn(f"r{i}", F.coalesce(F.when(odd, c.cast("string")), F.col(f"r{i}"), F.lit("null"))).drop(f"v{i}")
    rows = rows.select(F.sha2(F.concat_ws("/", "key", *(f"r{i}" for i in each)), 256).alias("class"), *(F.when(~F.isnan(c) & (F.abs(c) != float("inf")), F.col(c)).alias(c) for c in numbers), "a", "b")
    spreads = lambda i: F.coalesce(F.max(f"c{i}") - F.min(f"c{i}") > tolerance * F.greatest(F.lit(1.0), F.abs(F.min(f"c{i}"))), F.lit(False))
    rows = cut(rows)
    facts = rows.groupBy("class").agg((F.sum("a") - F.sum("b")).alias("left over"), F.max(F.col("a") != F.col("b")).alias("unlike"), *(spreads(i).alias(f"s{i}") for i in each))
    classes = cut(facts.filter((F.col("left over") != 0) | F.col("unlike") & reduce(lambda x, y: x | y, (F.col(f"s{i}") for i in each))))
    if classes.filter(F.col("left over") != 0).take(1):
        return answer(False)
    if not classes.take(1):
        return answer(True)
    wide = rows.join(classes.drop("left over", "unlike"), "class")
    wide = wide.select("class", "a", "b", *(F.when(F.col(f"s{i}"), F.col(f"c{i}")).alias(f"c{i}") for i in each)).withColumn("first", F.coalesce(*numbers))
    # the rows of a class are numbered within ranges of their first fraction, the same for both sides, offset by the ranges before
    ranged = wide.withColumn("range", bucketed(F.col("first"), bounds_of(wide, F.col("first"))))
    upto = lambda order: order.rowsBetween(Window.unboundedPreceding, -1)
    before, order = upto(Window.partitionBy("class").orderBy("range")), upto(Window.partitionBy("class", "range").orderBy("first", *numbers))  # before: a row a range
    starts = ranged.groupBy("class", "range").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).select("class", "range", *(F.coalesce(F.sum(s).over(before), F.lit(0)).alias(f"{s} before") for s in "ab"))
    side = lambda s: F.struct(F.lit(s).alias("side"), F.col(s).alias("n"), (F.col(f"{s} before") + F.coalesce(F.sum(s).over(order), F.lit(0))).alias("start"))
    placed = ranged.join(starts, ["class", "range"]).withColumn("sides", F.array(side("a"), side("b"))).select("class", *numbers, F.inline("sides")).filter("n > 0")
    # rows that are repeated hold a run of places; runs are cut at every PLACES, and each is compared with the other side's run at its start
    block = lambda place: F.floor(place / PLACES)
    runs = placed.withColumn("block", F.explode(F.sequence(block(F.col("start")), block(F.col("start") + F.col("n") - 1)))).withColumn("place", F.greatest("start", F.col("block") * PLACES))
    there = lambda s: F.last(F.when(F.col("side") == s, F.struct(*numbers)), ignorenulls=True).over(Window.partitionBy("class", "block").orderBy("place")).alias(s)
    both = runs.select(there("a"), there("b"))
    far = [F.abs(F.col(f"a.{c}") - F.col(f"b.{c}")) > tolerance * F.greatest(F.lit(1.0), F.abs(F.col(f"a.{c}"))) for c in numbers]
    return both.agg((F.count_if(reduce(lambda x, y: x | y, (F.coalesce(f, F.lit(False)) for f in far))) == 0).alias("equal"))


def outliers(df: DataFrame, column: str, method: str = "iqr", k: float | None = None) -> DataFrame:
    """Rows with `is_outlier` by interquartile fences (1.5), z-score (3) or median absolute deviation (3.5)."""
    v, no = F.col(column), F.lit(False)
    if method == "iqr":
        q1, q3 = column_quantiles(df, [column], [0.25, 0.75])[column]
        far = no if q1 is None else (v < q1 - (k or 1.5) * (q3 - q1)) | (v > q3 + (k or 1.5) * (q3 - q1))
    elif method == "zscore":
        mean, sd = df.agg(F.avg(column), F.stddev_samp(column)).first()
        far = no if sd is None else F.abs(v - mean) > (k or 3.0) * sd
    elif method == "mad":
        middle = column_quantiles(df, [column], [0.5])[column][0]
        off = F.abs(v - F.lit(middle).cast("double"))
        mad = column_quantiles(df, {"off": off}, [0.5])["off"][0]
        far = 0.6745 * off > (k or 3.5) * mad if mad else no
    else:
        raise ValueError(f"unknown method {method}")
    return df.withColumn("is_outlier", F.coalesce(far, no))


def shares(df: DataFrame, column: str, name: str) -> DataFrame:
    counts = df.groupBy(group_label(column)).agg(F.count("*").alias("n"))
    return counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("t")))).select(F.col(column).alias("item"), ratio(F.col("n"), F.col("t")).alias(name))


def share_drift(baseline: DataFrame, current: DataFrame, column: str, least: float = 0.1) -> DataFrame:
    """item, both shares and the change, of categories whose share moved by ten points."""
    both = shares(baseline, column, "before").join(shares(current, column, "after"), "item", "full_outer").na.fill(0.0, ["before", "after"])
    return both.withColumn("change", F.col("after") - F.col("before")).filter(F.abs("change") >= least)


def population_stability(baseline: DataFrame, current: DataFrame, column: str, smoothing: float = 0.0001) -> DataFrame:
    """The population stability index of a category column, and whether it is above 0.2."""
    both = shares(baseline, column, "before").join(shares(current, column, "after"), "item", "full_outer").na.fill(0.0, ["before", "after"])
    b, a = F.col("before") + smoothing, F.col("after") + smoothing
    return both.agg(F.sum((a - b) * F.log(a / b)).alias("psi")).withColumn("drifted", F.col("psi") > 0.2)


def numeric_stability(baseline: DataFrame, current: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """The index of a number column over the baseline's quantile bins."""
    edges = sorted({q for q in column_quantiles(baseline, [column], [i / bins for i in range(1, bins)])[column] if q is not None})
    binned = lambda d: d.filter(F.col(column).isNotNull()).select(bucketed(F.col(column), edges).alias("bin"))
    return population_stability(binned(baseline), binned(current), "bin")


def alert_rules(previous: DataFrame, current: DataFrame, rules: Sequence[Mapping]) -> DataFrame:
    """rule, both values, percent change, status and event id of every rule, from one aggregate a version.

    A rule is {"name", "column", "how", "threshold"}: the change in percent that triggers it, either way.
    """
    how = {"sum": F.sum, "mean": F.avg, "count": F.count, "max": F.max, "min": F.min}
    usable = [r for r in rules if r["column"] in previous.columns and r["column"] in current.columns]
    measured = lambda d, n: d.agg(F.array(*(F.struct(F.lit(r["name"]).alias("rule"), how[r["how"]](r["column"]).cast("double").alias(n), F.lit(float(r["threshold"])).alias("threshold")) for r in usable)).alias("rows")).select(F.inline("rows"))
    both = measured(previous, "before").join(measured(current, "after").drop("threshold"), "rule")
    percent = 100 * ratio(F.col("after") - F.col("before"), F.abs("before"))
    status = F.when(F.col("before").isNull() | F.col("after").isNull(), "METRIC_UNAVAILABLE").when(F.col("before") == 0, "BASELINE_UNDEFINED").when(F.abs("percent") >= F.col("threshold"), "TRIGGERED").otherwise("NO_CHANGE")
    out = both.withColumn("percent", percent).withColumn("status", status).withColumn("event_id", F.sha2(F.concat_ws("|", "rule", F.format_string("%.10e", "before"), F.format_string("%.10e", "after")), 256))
    absent = [r["name"] for r in rules if r not in usable]
    if absent:
        rows = [(a, "METRIC_UNAVAILABLE") for a in absent]
        out = out.unionByName(previous.sparkSession.createDataFrame(rows, "rule string, status string"), allowMissingColumns=True)
    return out


def new_events(alerts: DataFrame, known: DataFrame) -> DataFrame:
    """Triggered alerts whose event is not yet in the event table."""
    return alerts.filter("status = 'TRIGGERED'").join(known.select("event_id"), "event_id", "left_anti")
