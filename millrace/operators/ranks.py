"""Ranks and exact quantiles over all rows without a window over all rows.

For ranks, value counts are taken per group; bounds from approximate percentiles cut the values into ranges; totals of
the ranges give each its offset, and only within a range are counts added up in order. There are as many ranges as the rows
need at PER_RANGE each, up to RANGES, and equal values, however many, are one row.

For a few quantiles of whole columns nothing is shuffled but counts: a sketch brackets each quantile, a second pass
counts what lies below the bracket and inside it, and the values inside are narrowed again or counted exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import bucketed, ratio
from . import lineage

#: Rows of a range, ranges at most, and the accuracy of the sketch that finds their bounds.
PER_RANGE, RANGES, ACCURACY = 500_000, 2048, 20_000
#: Rank error of the sketch, as a share of the rows it has seen.
ERROR = 1 / 1000
#: Values inside all brackets of a column up to which they are counted exactly instead of narrowed, and groups whose facts are broadcast.
FEW = 100_000


def bounds_of(df: DataFrame, value: Column) -> list[float]:
    """Values that cut a column into ranges of about equal numbers of rows, PER_RANGE each; none, and no sketch, for fewer rows."""
    n = df.agg(F.count(value)).first()[0]
    ranges = min(RANGES, -(-n // PER_RANGE))
    if ranges < 2:
        return []
    return sorted(set(df.agg(F.percentile_approx(value, [i / ranges for i in range(1, ranges)], ACCURACY)).first()[0]))


def running(counts: DataFrame, bounds: Sequence[float], sums: Mapping[str, str], groups: Sequence[str] = (), totals: Mapping[str, str] | None = None) -> DataFrame:
    """counts (groups, value and columns of numbers, a row a value) with running sums over the smaller values.

    sums names a new column for each column to be summed; totals one for its sum over the whole group. Only sums of
    ranges cross the ranges, at most as many rows a group as there are ranges.
    """
    if not bounds:  # one range: fewer rows than PER_RANGE
        before = Window.partitionBy(*groups).orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
        summed = {name: F.coalesce(F.sum(c).over(before), F.lit(0)) for c, name in sums.items()} | {name: F.sum(c).over(Window.partitionBy(*groups)) for c, name in (totals or {}).items()}
        return counts.filter("value IS NOT NULL").withColumns(summed)
    # as many partitions as ranges: few rows a task, even where all rows fit into one partition of Spark's target size
    cut = counts.withColumn("range of value", bucketed(F.col("value"), list(bounds))).repartition(len(bounds) + 1, *groups, "range of value")
    columns = sorted({*sums, *(totals or {})})
    whole = cut.groupBy(*groups, "range of value").agg(*(F.sum(c).alias(c) for c in columns))
    by_group = Window.partitionBy(*groups)
    before = by_group.orderBy("range of value").rowsBetween(Window.unboundedPreceding, -1)
    whole = whole.select(*groups, "range of value", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"before {c}") for c in sums), *(F.sum(c).over(by_group).alias(name) for c, name in (totals or {}).items()))
    within = Window.partitionBy(*groups, "range of value").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    joined = cut.join(whole if groups else F.broadcast(whole), [*groups, "range of value"])  # without groups at most RANGES rows
    return joined.withColumns({name: F.col(f"before {c}") + F.coalesce(F.sum(c).over(within), F.lit(0)) for c, name in sums.items()}).drop("range of value", *(f"before {c}" for c in sums))


def ranked(df: DataFrame, value: str, groups: Sequence[str] = (), bounds: Sequence[float] | None = None) -> DataFrame:
    """Groups, value, n (its rows), below (rows with a smaller value) and total (rows of the group), nulls left out; bounds of ranges, if they are known."""
    v = F.col(value).cast("double")
    bounds = bounds_of(df, v) if bounds is None else bounds
    counts = df.filter(F.col(value).isNotNull()).groupBy(*groups, v.alias("value")).agg(F.count("*").alias("n"))
    return running(counts, bounds, {"n": "below"}, groups, {"n": "total"}).select(*groups, "value", "n", "below", "total")


def positions(df: DataFrame, order: Column, ties: Sequence[str] = ()) -> DataFrame:
    """df with `position`, the number (from 1) of a row in the order of a number and then of the ties; rows without one go.

    Rows are numbered within ranges of the order and offset by the ranges before, so no task sees all of them.
    """
    rows = df.withColumn("order of row", order.cast("double")).filter("`order of row` IS NOT NULL")
    rows = rows.withColumn("range of row", bucketed(F.col("order of row"), bounds_of(rows, F.col("order of row"))))
    before = Window.orderBy("range of row").rowsBetween(Window.unboundedPreceding, -1)  # at most RANGES rows
    starts = rows.groupBy("range of row").agg(F.count("*").alias("n of range")).withColumn("start of range", F.coalesce(F.sum("n of range").over(before), F.lit(0))).drop("n of range")
    inside = F.row_number().over(Window.partitionBy("range of row").orderBy("order of row", *ties))
    return rows.join(F.broadcast(starts), "range of row").withColumn("position", F.col("start of range") + inside).drop("order of row", "range of row", "start of range")


def beside(rows: DataFrame, facts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows with the facts of their keys, one row each; a null key meets a null key."""
    if not keys:
        return rows.crossJoin(facts)  # one row
    names = {k: f"{k} of facts" for k in keys}
    same = reduce(lambda x, y: x & y, (F.col(f"`{k}`").eqNullSafe(F.col(f"`{n}`")) for k, n in names.items()))
    return rows.join(facts.withColumnsRenamed(names), same).drop(*names.values())


def numbered(df: DataFrame, keys: Sequence[str], order: str, ties: Sequence[str] = ()) -> DataFrame:
    """df with `place`, the number (from 1) of a row among those of its keys in the order of a column and then of the ties.

    Where there are many rows and the order is a number, date or time, rows are numbered within ranges of it, each offset by the rows of the
    same keys in the ranges before, so that not even one key's rows meet in one task.
    """
    kind = df.schema[order].dataType
    by = F.col(order).cast("double") if isinstance(kind, T.NumericType) else F.unix_micros(F.col(order).cast("timestamp")).cast("double") if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)) else None
    edges = bounds_of(df, by) if by is not None else []
    if not edges:
        return df.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(order, *ties)).cast("long"))
    ranged = df.withColumn("range of row", F.coalesce(bucketed(by, edges), F.lit(-1)))
    before = Window.partitionBy(*keys).orderBy("range of row").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    starts = ranged.groupBy(*keys, "range of row").agg(F.count("*").alias("n of range")).withColumn("start of range", F.coalesce(F.sum("n of range").over(before), F.lit(0))).drop("n of range")
    inside = F.row_number().over(Window.partitionBy(*keys, "range of row").orderBy(order, *ties))
    return beside(ranged, starts, [*keys, "range of row"]).withColumn("place", F.col("start of range") + inside).drop("range of row", "start of range")


def mid_ranks(df: DataFrame, value: str) -> DataFrame:
    """value, n and the mean rank of its rows."""
    return ranked(df, value).withColumn("mid_rank", F.col("below") + (F.col("n") + 1) / 2)


def with_facts(rows: DataFrame, facts: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Rows with the facts of their groups, one row each. Facts of at most FEW groups are broadcast, so that rows of a large group do not meet in one task."""
    if not groups:
        return rows.crossJoin(F.broadcast(facts))  # one row
    facts = lineage.cut(facts)
    return rows.join(F.broadcast(facts) if facts.count() <= FEW else facts, list(groups))


def quantiles(df: DataFrame, value: str, points: Sequence[float], groups: Sequence[str] = ()) -> DataFrame:
    """point and quantile of each group, linear between neighbours, exact at any size; group keys must not be null.

    Rows of each group are counted by ranges; only values in the ranges that a quantile of some group falls into are shuffled and put in order.
    """
    v, place = F.col(value).cast("double"), "range of value"
    at = F.col("point") * (F.col("total") - 1)
    # of the few points only those that the rows of a range or a value reach go on
    hit = lambda k: (F.col("below") <= k) & (k < F.col("below") + F.col("n"))
    reached = F.filter(F.array(*(F.lit(float(p)) for p in points)), lambda p: hit(F.floor(p * (F.col("total") - 1))) | hit(F.ceil(p * (F.col("total") - 1))))
    edges = bounds_of(df, v)
    if edges:
        rows = df.filter(F.col(value).isNotNull()).select(*groups, v.alias("value")).withColumn(place, bucketed(F.col("value"), edges))
        by_group = Window.partitionBy(*groups)  # a row a range
        before = by_group.orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
        whole = rows.groupBy(*groups, place).agg(F.count("*").alias("n")).withColumns({"below": F.coalesce(F.sum("n").over(before), F.lit(0)), "total": F.sum("n").over(by_group)})
        whole = lineage.cut(whole.filter(F.size(reached) > 0).select(*groups, place, F.col("below").alias("before"), "total"))
        some = [r[0] for r in whole.select(place).distinct().collect()]  # RANGES at most
        inside = lambda r: reduce(lambda x, y: x & y, [F.col("value") >= e for e in edges[r - 1 : r] if r] + [F.col("value") < e for e in edges[r : r + 1]])
        held = reduce(lambda x, y: x | y, map(inside, some), F.lit(False)) if len(some) <= 32 else F.col(place).isin(some)  # few ranges by their ends, which is faster
        counts = rows.filter(held).groupBy(*groups, place, "value").agg(F.count("*").alias("n"))
        ordered = with_facts(counts, whole, [*groups, place]).repartition(len(edges) + 1, *groups, place)
        within = Window.partitionBy(*groups, place).orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
        ranks = ordered.withColumn("below", F.col("before") + F.coalesce(F.sum("n").over(within), F.lit(0)))
    else:
        ranks = ranked(df, value, groups, edges)
    picked = ranks.select(*groups, "value", "total", F.explode(reached).alias("point"))
    ends = picked.groupBy(*groups, "point").agg(F.min("value").alias("a"), F.max("value").alias("b"), F.first("total").alias("total"))
    return ends.select(*groups, "point", (F.col("a") + (F.col("b") - F.col("a")) * (at - F.floor(at))).alias("quantile"))


def group_quantiles(df: DataFrame, value: str, points: Mapping[str, float], groups: Sequence[str] = ()) -> DataFrame:
    """Groups and a column for each named point; a group without a known value has no row."""
    found = quantiles(df, value, list(points.values()), groups)
    return found.groupBy(*groups).agg(*(F.max(F.when(F.col("point") == float(p), F.col("quantile"))).alias(name) for name, p in points.items()))


def by_column(df: DataFrame, values: Mapping[str, Column], facts: Mapping[str, Sequence[Column]]) -> dict[str, list]:
    """Aggregates over `v`, the values of each column, in one job: each column is read by itself, so expressions stay few and scans narrow."""
    parts = [df.select(values[c].alias("v")).agg(F.lit(c).alias("column"), F.array(*exprs).alias("facts")) for c, exprs in facts.items()]
    return {r["column"]: r["facts"] for r in reduce(DataFrame.union, parts).collect()}  # a row a column


def in_one_scan(df: DataFrame, values: Mapping[str, Column], bracket: Mapping[tuple, tuple[float, float]], rank: Mapping[tuple, float]) -> dict[tuple, float]:
    """The quantiles whose brackets hold them, from one scan that counts what lies below each bracket and the values in it, a few by the caller's bound."""
    keys = list(bracket)
    columns = list(dict.fromkeys(c for c, _ in keys))
    of = [[j for j, k in enumerate(keys) if k[0] == c] for c in columns]
    ends = [bracket[k] for k in keys]

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            which, found, counts = [], [], []
            for i, mine in enumerate(of):
                v = batch.column(i).drop_null().to_numpy()
                for j in mine:
                    u, n = np.unique(v[(v >= ends[j][0]) & (v <= ends[j][1])], return_counts=True)
                    which.append(np.full(len(u) + 1, j, np.int32))
                    found.append(np.append(u, -np.inf))  # below
                    counts.append(np.append(n, (v < ends[j][0]).sum()))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (which, found, counts)], ["i", "v", "n"])

    rows = df.select(*(values[c].alias(f"v{i}") for i, c in enumerate(columns)))
    table = rows.mapInArrow(look, "i int, v double, n long").groupBy("i", "v").agg(F.sum("n").alias("n")).toArrow()  # the values in the brackets
    which, v, n = (table.column(c).to_numpy() for c in ("i", "v", "n"))
    out = {}
    for j, k in enumerate(keys):
        order = np.flatnonzero(which == j)
        order = order[np.argsort(v[order])]
        upto = np.cumsum(n[order])
        at = [int(np.searchsorted(upto, math.floor(rank[k]), side="right")), int(np.searchsorted(upto, math.ceil(rank[k]), side="right"))]
        if len(order) and at[0] >= 1 and at[1] < len(order):
            a, b = v[order[at]]
            out[k] = float(a + (b - a) * (rank[k] - math.floor(rank[k])))
    return out


def column_quantiles(df: DataFrame, columns: Mapping[str, Column] | Sequence[str], points: Sequence[float]) -> dict[str, list[float | None]]:
    """The exact quantiles of whole columns (linear between neighbours, nulls and NaN left out), a few numbers each.

    No more than FEW values a bracket are ever counted one by one; brackets that hold more are narrowed by another
    sketch, each time by two orders of magnitude, or cut at their middle, until they end in a single value.
    """
    wanted = dict(columns) if isinstance(columns, Mapping) else {c: F.col(c) for c in columns}
    values = {c: F.when(~F.isnan(v.cast("double")), v.cast("double")) for c, v in wanted.items()}
    if not values:
        return {}
    v, margin, error = F.col("v"), 2 * ERROR, int(1 / ERROR)
    ends = sorted({x for p in points for x in (max(0.0, p - margin), min(1.0, p + margin))})
    names = list(values)
    sketch = df.select(*(values[c].alias(f"v{i}") for i, c in enumerate(names))).agg(
        F.array(*(F.array(F.count(x).cast("double"), F.min(x), F.max(x)) for x in map(F.col, (f"v{i}" for i in range(len(names)))))).alias("facts"), F.array(*(F.percentile_approx(f"v{i}", ends, error) for i in range(len(names)))).alias("points")
    ).first()
    first = {c: [*sketch["facts"][i], *(sketch["points"][i] or [None] * len(ends))] for i, c in enumerate(names)}
    size = {c: int(f[0]) for c, f in first.items()}
    whole = {c: (f[1], f[2]) for c, f in first.items()}
    bracket: dict[tuple[str, float], tuple[float, float]] = {}
    for c in values:
        known = dict(zip(ends, first[c][3:]))
        for p in points if size[c] else ():
            low, high = max(0.0, p - margin), min(1.0, p + margin)
            bracket[c, p] = (known[low] if low else whole[c][0], known[high] if high < 1 else whole[c][1])
    rank = {(c, p): p * (size[c] - 1) for c, p in bracket}
    done: dict[tuple[str, float], float] = {}
    valid = {k: (whole[k[0]], 0, size[k[0]]) for k in bracket}
    if max(size.values()) * 2 * margin <= FEW:
        done |= in_one_scan(df, values, bracket, rank)
        bracket = {k: b for k, b in bracket.items() if k not in done}
    while bracket:
        of: dict[str, list] = {}
        for k in bracket:
            of.setdefault(k[0], []).append(k)
        inside = lambda k: v.between(*map(F.lit, bracket[k]))
        counted = by_column(df, values, {c: [F.count_if(e) for k in ks for e in (v < bracket[k][0], inside(k))] for c, ks in of.items()})
        below = {k: counted[c][2 * i] for c, ks in of.items() for i, k in enumerate(ks)}
        held = {k: counted[c][2 * i + 1] for c, ks in of.items() for i, k in enumerate(ks)}
        by_half = set()
        for k in bracket:  # the sketch's bound holds for large inputs; where rounding of small ones leaves the rank outside, the bracket before is cut in two
            if below[k] <= math.floor(rank[k]) and math.ceil(rank[k]) < below[k] + held[k]:
                valid[k] = bracket[k], below[k], held[k]
            else:
                bracket[k], below[k], held[k] = valid[k]
                by_half.add(k)
        done |= {k: b[0] for k, b in bracket.items() if b[0] == b[1]}
        few = [k for k, b in bracket.items() if b[0] < b[1] and held[k] <= FEW]
        if few:
            at = {k: i for i, k in enumerate(few)}
            parts = []
            for c, ks in of.items():
                if mine := [k for k in ks if k in at]:
                    rows = df.select(values[c].alias("v")).filter(reduce(lambda x, y: x | y, map(inside, mine))).groupBy("v").agg(F.count("*").alias("n"))
                    fits = F.filter(F.array(*(F.when(inside(k), F.lit(at[k])) for k in mine)), lambda i: i.isNotNull())
                    parts.append(rows.select("v", "n", F.explode(fits).alias("i")))
            upto = F.sum("n").over(Window.partitionBy("i").orderBy("v"))  # FEW rows a partition at most
            ranks = F.create_map(*(x for k in few for x in (F.lit(at[k]), F.array(F.lit(math.floor(rank[k]) - below[k]), F.lit(math.ceil(rank[k]) - below[k])))))[F.col("i")]
            start, last = F.col("upto") - F.col("n"), F.col("upto") - 1
            hit = ((start <= ranks[0]) & (ranks[0] <= last)) | ((start <= ranks[1]) & (ranks[1] <= last))
            found = reduce(DataFrame.union, parts).withColumn("upto", upto).filter(hit).groupBy("i").agg(F.min("v"), F.max("v")).collect()  # a row a quantile
            for i, a, b in found:
                done[few[i]] = a + (b - a) * (rank[few[i]] - math.floor(rank[few[i]]))
        many = [k for k in bracket if k not in done]
        share = {k: (rank[k] - below[k]) / max(1, held[k] - 1) for k in many}
        asked: dict[str, list] = {}
        for k in many:
            if k not in by_half and held[k] > 10 / ERROR:
                asked.setdefault(k[0], []).append(k)
        narrow = lambda k: F.percentile_approx(F.when(inside(k), v), [max(0.0, share[k] - margin), min(1.0, share[k] + margin)], error)
        closer = by_column(df, values, {c: [narrow(k)[i] for k in ks for i in (0, 1)] for c, ks in asked.items()}) if asked else {}
        new = {k: tuple(closer[c][2 * i : 2 * i + 2]) for c, ks in asked.items() for i, k in enumerate(ks)}
        new = {k: (e[0] if share[k] > margin else bracket[k][0], e[1] if share[k] + margin < 1 else bracket[k][1]) for k, e in new.items()}
        bracket = {k: new[k] if new.get(k, bracket[k]) != bracket[k] else halved(df, values[k[0]], bracket[k], rank[k]) for k in many}
    return {c: [done.get((c, p)) for p in points] for c in values}


def halved(df: DataFrame, v: Column, bracket: tuple[float, float], rank: float) -> tuple[float, float]:
    """The part of a bracket on the rank's side of its middle; both parts share the middle value."""
    low, high = bracket
    middle = low + (high - low) / 2
    upto, nearest = df.agg(F.count_if(v <= middle), F.max(F.when(v <= middle, v))).first()
    if math.ceil(rank) < upto:
        return (low, nearest if nearest > low else low)
    following = df.agg(F.min(F.when(v > middle, v))).first()[0]
    return (following if math.floor(rank) >= upto else nearest, high if math.floor(rank) >= upto else following)


def concentration(df: DataFrame, value: str) -> DataFrame:
    """Gini coefficient, Herfindahl index (0 to 10,000), rows, the shares of the 1, 3, 5 and 10 largest rows, and that of the largest fifth of the rows, of non-negative values."""
    r = ranked(df.filter(F.col(value) >= 0), value)
    n, x = F.col("n"), F.col("value")
    ranks = n * F.col("below") + n * (n + 1) / 2  # sum of the ranks of a value's rows
    above = F.col("total") - F.col("below") - n  # rows with a larger value
    of_top = lambda k: F.sum(x * F.greatest(F.lit(0), F.least(n, k - above)))
    tops = {f"top_{k}_share": of_top(F.lit(k)) for k in (1, 3, 5, 10)} | {"top_fifth_share": of_top(F.ceil(F.col("total") / 5))}
    sums = r.agg(F.sum(ranks * x).alias("w"), F.sum(n * x).alias("s"), F.sum(n * x * x).alias("q"), F.sum(n).alias("n"), *(e.alias(name) for name, e in tops.items()))
    return sums.select(
        (2 * ratio(F.col("w"), F.col("n") * F.col("s")) - (F.col("n") + 1) / F.col("n")).alias("gini"), (10000 * ratio(F.col("q"), F.col("s") * F.col("s"))).alias("hhi"), "n", *(ratio(F.col(name), F.col("s")).alias(name) for name in tops)
    )


def trimmed_mean(df: DataFrame, value: str, share: float = 0.05) -> DataFrame:
    """Mean without the lowest and highest share of the rows."""
    cut = F.floor(F.lit(share) * F.col("total"))
    used = F.greatest(F.lit(0), F.least(F.col("below") + F.col("n"), F.col("total") - cut) - F.greatest(F.col("below"), cut))
    return ranked(df, value).agg(ratio(F.sum(used * F.col("value")), F.sum(used)).alias("trimmed_mean"), F.sum(used).alias("used"))
