"""Filters, projections, set operations and ordered windows over rows."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from decimal import ROUND_CEILING, ROUND_FLOOR, Decimal
from functools import reduce

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import MISSING, NO, YES
from .ranks import beside, column_quantiles, numbered

#: Share of a text column's values that must be dates for an ordered comparison.
DATE_SHARE = 0.8


def kind_of(df: DataFrame, column: str) -> str:
    if column not in df.columns:
        raise ValueError(f"unknown column {column}")
    dtype = df.schema[column].dataType
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    if isinstance(dtype, T.NumericType):
        return "number"
    return "time" if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)) else "text"


def number_literal(df: DataFrame, column: str, value) -> tuple[Column, Column, bool]:
    """The whole numbers (or the numbers) at or below and at or above a value, in the column's own type, and whether they are the value."""
    dtype, d = df.schema[column].dataType, Decimal(str(value))
    if isinstance(dtype, T.IntegralType):
        low, high = int(d.to_integral_value(ROUND_FLOOR)), int(d.to_integral_value(ROUND_CEILING))
        lit = lambda n: F.lit(n) if abs(n) < 2**63 else F.lit(Decimal(n))
        return lit(low), lit(high), low == high
    exact = F.lit(d) if isinstance(dtype, T.DecimalType) else F.lit(float(d)).cast(dtype)
    return exact, exact, True


def equals(df: DataFrame, column: str, value) -> Column:
    """Equality: yes and no words on booleans, numbers on numbers in the column's own type, text without regard to case."""
    kind, c = kind_of(df, column), F.col(column)
    if value is None:
        return c.isNull()
    if isinstance(value, Column):
        return c == value
    if kind == "boolean":
        word = str(value).strip().lower()
        if word not in YES + NO:
            raise ValueError(f"{value} is neither yes nor no")
        return c == F.lit(word in YES)
    if kind == "number":
        low, _, exact = number_literal(df, column, value)
        return c == low if exact else F.when(c.isNotNull(), F.lit(False))
    return F.lower(c.cast("string")) == str(value).lower() if kind == "text" else c == F.lit(value).cast("timestamp")


def ordered(df: DataFrame, column: str, value) -> tuple[Column, Column, Column]:
    """A column, and the values at or below and at or above a value in its order: numbers, times, or texts that are dates; other texts have none."""
    kind, c = kind_of(df, column), F.col(column)
    if isinstance(value, Column):
        return c, value, value
    if kind == "number":
        low, high, _ = number_literal(df, column, value)
        return c, low, high
    at = F.lit(value).cast("timestamp")
    if kind == "time":
        return c.cast("timestamp"), at, at
    dates = c.try_cast("timestamp")
    share = df.agg(F.count(dates) / F.count(c)).first()[0] if kind == "text" else None
    if share is None or share < DATE_SHARE:
        raise ValueError(f"{column} has no order")
    return dates, at, at


def condition(df: DataFrame, column: str, operator: str, value=None) -> Column:
    """One condition as a column; an unknown operator raises. A value may be another column: ("a", "<", F.col("b"))."""
    op = operator.strip().lower()
    if op in ("is null", "is not null"):
        kind_of(df, column)
        return F.col(column).isNull() if op == "is null" else F.col(column).isNotNull()
    if op == "=":
        return equals(df, column, value)
    if op == "!=":
        return ~equals(df, column, value)
    if op in ("in", "not in"):
        if not value or any(v is None for v in value):
            raise ValueError("a list needs values, none of them null")
        any_of = reduce(lambda x, y: x | y, (equals(df, column, v) for v in value))
        return any_of if op == "in" else ~any_of
    if op == "between":
        low, high = value
        if low > high:
            raise ValueError("the lower end is above the upper")
        (c, _, a), (_, b, _) = ordered(df, column, low), ordered(df, column, high)
        return (c >= a) & (c <= b)
    if op in ("<", "<=", ">", ">="):
        c, low, high = ordered(df, column, value)
        return {"<": c < high, "<=": c <= low, ">": c > low, ">=": c >= high}[op]
    raise ValueError(f"unknown operator {operator}")


def predicate(df: DataFrame, tree: Sequence) -> Column:
    """A nested condition as a column: (column, operator, value), ("and" | "or", [conditions]) or ("not", condition)."""
    head = tree[0]
    if head in ("and", "or") and len(tree) == 2 and not isinstance(tree[1], str):
        parts = [predicate(df, t) for t in tree[1]]
        if not parts:
            raise ValueError(f"{head} of nothing")
        return reduce((lambda x, y: x & y) if head == "and" else (lambda x, y: x | y), parts)
    if head == "not" and len(tree) == 2 and not isinstance(tree[1], str):
        return ~predicate(df, tree[1])
    return condition(df, *tree)


def where(df: DataFrame, conditions: Sequence[tuple]) -> DataFrame:
    """Rows that meet all of the conditions, which may be nested (see predicate); nulls meet only `is null`."""
    return df.filter(predicate(df, ("and", list(conditions)))) if conditions else df


#: What a filter in words may not hold, outside quoted strings: alternatives, comments, statements, subqueries, function calls.
REFUSED = re.compile(r"--|/\*|;|`|\b(?:or|select|insert|update|delete|drop|create|alter|union|exists|having|group|order|case)\b|\b(?!(?:in|and|not|between)\b)[A-Za-z_]\w*\s*\(", re.I)


def filter_text(df: DataFrame, text: str) -> DataFrame:
    """Rows that meet comparisons, IN, BETWEEN and IS NULL joined by AND or commas; anything else raises.

    Spark reads the text itself and refuses unknown columns.
    """
    quoted: list[str] = []
    bare = re.sub(r"'(?:[^']|'')*'", lambda m: quoted.append(m[0]) or "''", text)
    if not bare.strip() or REFUSED.search(bare) or "'" in bare.replace("''", ""):
        raise ValueError("only comparisons joined by AND or commas")
    # commas outside brackets join conditions
    joined = re.sub(r"\([^()]*\)|,", lambda m: " AND " if m[0] == "," else m[0], bare)
    strings = iter(quoted)
    return df.filter(F.expr(re.sub("''", lambda _: next(strings), joined)))


def row_predicate(df: DataFrame, expression: str) -> DataFrame:
    """Rows that meet an SQL expression over single rows; one that aggregates raises ValueError, as does an unknown column."""
    try:
        return df.filter(F.expr(expression))
    except AnalysisException as e:
        raise ValueError(f"not a condition on rows: {expression}") from e


def in_range(df: DataFrame, time: str, start: str, end: str) -> DataFrame:
    """Rows of a half-open time range."""
    return df.filter((F.col(time) >= F.lit(start).cast("timestamp")) & (F.col(time) < F.lit(end).cast("timestamp")))


def population(df: DataFrame, conditions: Sequence[tuple], target: str) -> DataFrame:
    """Mean of a target over a filtered population, or a status where nothing is left."""
    return where(df, conditions).agg(F.avg(target).alias("value"), F.count("*").alias("n")).withColumn("status", F.when(F.col("n") == 0, "empty_population").otherwise("ok"))


def project(df: DataFrame, columns: Sequence[str | tuple[str, str]] = ()) -> DataFrame:
    """Columns, renamed where a pair (name, new name) is given; none means all."""
    return df.select(*(F.col(c) if isinstance(c, str) else F.col(c[0]).alias(c[1]) for c in columns)) if columns else df


def derive(df: DataFrame, name: str, expression: Column | str) -> DataFrame:
    return df.withColumn(name, F.expr(expression) if isinstance(expression, str) else expression)


def what_if_cap(df: DataFrame, amount: str, discount: str, cap: float) -> DataFrame:
    """Revenue now, revenue if no discount were above a cap, and the difference."""
    now, capped = F.sum(F.col(amount) * (1 - F.col(discount))), F.sum(F.col(amount) * (1 - F.least(F.col(discount), F.lit(cap))))
    return df.agg(now.alias("actual"), capped.alias("scenario")).withColumn("delta", F.col("scenario") - F.col("actual"))


def what_if_growth(df: DataFrame, segment: str, value: str, amount: str, growth: float) -> DataFrame:
    """The total if one segment grew."""
    grown = F.when(F.col(segment) == value, F.col(amount) * (1 + growth)).otherwise(F.col(amount))
    return df.agg(F.sum(amount).alias("actual"), F.sum(grown).alias("scenario")).withColumn("delta", F.col("scenario") - F.col("actual"))


def quantile_bins(df: DataFrame, column: str, bins: int = 4) -> DataFrame:
    """bin: the quantile band of a column, from 0; equal edges make one."""
    edges = sorted({q for q in column_quantiles(df, [column], [i / bins for i in range(1, bins)])[column] if q is not None})
    number = F.lit(0)
    for e in edges:
        number = number + (F.col(column) > e).cast("int")
    return df.withColumn("bin", F.when(F.col(column).isNotNull(), number))


def one_hot(df: DataFrame, column: str, most: int = 10, drop_first: bool = False) -> DataFrame:
    """A 0/1 column for each of the `most` most frequent values, nulls as a value of their own."""
    value = F.coalesce(F.col(column).cast("string"), F.lit(MISSING))
    levels = sorted(r["v"] for r in df.groupBy(value.alias("v")).count().orderBy(F.desc("count"), "v").limit(most).collect())
    return df.withColumns({f"{column}={v}": (value == v).cast("int") for v in levels[int(drop_first) :]})


def bag_difference(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows added and rows removed, repeated rows counted."""
    counted = lambda d, n: d.groupBy(*d.columns).agg(F.count("*").alias(n))
    keys = before.columns
    a, b = counted(before, "nb").alias("b"), counted(after, "na").alias("a")
    both = a.join(b, reduce(lambda x, y: x & y, (F.col(f"b.{k}").eqNullSafe(F.col(f"a.{k}")) for k in keys)), "full_outer")
    delta = F.coalesce("na", F.lit(0)) - F.coalesce("nb", F.lit(0))
    return both.agg(F.coalesce(F.sum(F.greatest(delta, F.lit(0))), F.lit(0)).alias("added"), F.coalesce(F.sum(F.greatest(-delta, F.lit(0))), F.lit(0)).alias("removed"))


def key_sets(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Sizes of the union, the intersection and the differences of two key sets."""
    left, right = a.select(key).distinct().withColumn("l", F.lit(1)), b.select(key).distinct().withColumn("r", F.lit(1))
    both = left.join(right, key, "full_outer")
    return both.agg(F.count("*").alias("union"), F.count_if(F.col("l").isNotNull() & F.col("r").isNotNull()).alias("intersection"), F.count_if(F.col("r").isNull()).alias("only_left"), F.count_if(F.col("l").isNull()).alias("only_right"))


def schema_changes(before: DataFrame, after: DataFrame) -> dict[str, list[str]]:
    """Columns added, removed and of another type."""
    a, b = dict(before.dtypes), dict(after.dtypes)
    return {"added": sorted(b.keys() - a.keys()), "removed": sorted(a.keys() - b.keys()), "retyped": sorted(c for c in a.keys() & b.keys() if a[c] != b[c])}


def rank_groups(grouped: DataFrame, value: str, key: str, largest: bool = True) -> DataFrame:
    """Positions 1 to n of a grouped result, nulls last either way."""
    order = F.col(value).desc_nulls_last() if largest else F.col(value).asc_nulls_last()
    return grouped.withColumn("rank", F.row_number().over(Window.orderBy(order, key)))


def leaders(grouped: DataFrame, value: str) -> DataFrame:
    """All groups with the top value."""
    top = grouped.agg(F.max(value).alias("top"))
    return grouped.join(F.broadcast(top), F.col(value) == F.col("top"), "left_semi")


def top_groups(df: DataFrame, group: str, target: str, n: int) -> DataFrame:
    """The n groups with the largest sums, 1 to 100."""
    if not 1 <= n <= 100:
        raise ValueError("between 1 and 100 groups")
    return df.groupBy(group).agg(F.sum(target).alias("value")).orderBy(F.desc("value"), group).limit(n)


def capped(df: DataFrame, order: Sequence[str], cap: int) -> DataFrame:
    """The first rows in order, each with whether more were left out."""
    rows = df.orderBy(*order).limit(cap + 1).withColumn("row of all", F.row_number().over(Window.orderBy(*order)))  # cap + 1 rows
    return rows.withColumn("truncated", F.max("row of all").over(Window.partitionBy()) > cap).filter(F.col("row of all") <= cap).drop("row of all")


def smoothed(series: DataFrame, keys: Sequence[str], time: str, value: str, width: int = 3) -> DataFrame:
    """Change, trailing mean and cumulative sum of each series."""
    w = Window.partitionBy(*keys).orderBy(time)
    return series.withColumns({"delta": F.col(value) - F.lag(value).over(w), "moving_average": F.avg(value).over(w.rowsBetween(-(width - 1), 0)), "running_total": F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, 0))})


def exponential_average(series: DataFrame, keys: Sequence[str], time: str, value: str, span: int = 3) -> DataFrame:
    """The recursive average with weight 2 / (span + 1), at the end of each series; rows without a value are left out.

    The steps are affine maps, whose composition gives the k-th value from the end the weight alpha * (1 - alpha) ** (k - 1), and
    the first value what is left: a weighted sum of numbered rows, of which no task sees a whole series.
    """
    alpha = 2 / (span + 1)
    rows = series.filter(F.col(value).isNotNull()).select(*keys, time, F.col(value).cast("double").alias("v of series"))
    last = rows.groupBy(*keys).agg(F.count("*").alias("n of series"))
    placed = beside(numbered(rows, keys, time, ["v of series"]), last, keys)
    rest = F.pow(F.lit(1 - alpha), F.col("n of series") - F.col("place"))
    weight = rest * F.when(F.col("place") == 1, 1.0).otherwise(alpha)
    return placed.groupBy(*keys).agg(F.sum(weight * F.col("v of series")).alias("ema"))


def cusum_break(series: DataFrame, keys: Sequence[str], time: str, value: str) -> DataFrame:
    """Where the cumulative deviation from the mean is largest, and whether it is a break (over 1.5 sd * sqrt(n))."""
    all_of = Window.partitionBy(*keys)
    w = all_of.orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
    deviation = series.withColumn("d", F.col(value) - F.avg(value).over(all_of)).withColumn("sd", F.stddev_samp(value).over(all_of)).withColumn("n", F.count(value).over(all_of))
    path = deviation.withColumn("cusum", F.abs(F.sum("d").over(w)))
    return path.groupBy(*keys).agg(F.max("cusum").alias("cusum"), F.max_by(F.col(time), F.struct("cusum", F.lit(0))).alias("at"), (F.max("cusum") > 1.5 * F.first("sd") * F.sqrt(F.first("n"))).alias("is_break"))


def control_chart(series: DataFrame, keys: Sequence[str], time: str, value: str, warm_up: int = 20, k: float = 0.5, h: float = 4.0) -> DataFrame:
    """Alarms of a two-sided CUSUM chart whose baseline is the first points of each series; n counts its points with a value.

    An alarm sets both sums back, so a chart is followed in order: rows come sorted by key and time and pass by once, with a
    few numbers held for the series at hand and none of its rows.
    """
    base = numbered(series.filter(F.col(value).isNotNull()), keys, time, [value]).filter(F.col("place") <= warm_up)
    facts = base.groupBy(*keys).agg(F.avg(value).cast("double").alias("mean of chart"), F.stddev_pop(value).cast("double").alias("sd of chart"))
    rows = series.filter(F.col(value).isNotNull()).select(*keys, F.col(time).alias("time of chart"), F.col(value).cast("double").alias("v of chart"))
    joined = beside(rows, facts, keys)
    series_key = F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}) if keys else F.lit("")
    sent = joined.select(series_key.alias("key"), "time of chart", F.col("v of chart").alias("v"), F.col("mean of chart").alias("mean"), F.col("sd of chart").alias("sd"))
    ordered = sent.repartition("key").sortWithinPartitions("key", "time of chart", "v").select("key", "v", "mean", "sd")

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, n, up, down, alarms = None, 0, 0.0, 0.0, 0
        row = lambda: pa.RecordBatch.from_arrays([pa.array([at]), pa.array([alarms], pa.int32()), pa.array([n], pa.int32())], ["key", "alarms", "n"])
        for batch in batches:
            for key, v, mean, sd in zip(*(c.to_pylist() for c in batch.columns)):
                if key != at:
                    if at is not None:
                        yield row()
                    at, n, up, down, alarms = key, 0, 0.0, 0.0, 0
                n += 1
                if n > warm_up:
                    up, down = max(0.0, up + v - mean - k * sd), max(0.0, down - v + mean - k * sd)
                    if up > h * sd or down > h * sd:
                        up, down, alarms = 0.0, 0.0, alarms + 1
        if at is not None:
            yield row()

    charts = ordered.mapInArrow(follow, "key string, alarms int, n int")
    if not keys:
        return charts.select("alarms", "n")
    found = series.select(*keys).distinct().withColumn("key", series_key)
    return found.join(charts, "key").select(*keys, "alarms", "n")


def rolling_anomalies(series: DataFrame, keys: Sequence[str], time: str, value: str, width: int = 5, history: int = 3, sigma: float = 2.0) -> DataFrame:
    """Points outside the mean of the points before them by sigma of their spreads."""
    w = Window.partitionBy(*keys).orderBy(time).rowsBetween(-width, -1)
    s = series.withColumns({"expected": F.avg(value).over(w), "spread": F.stddev_samp(value).over(w), "held": F.count(value).over(w)})
    return s.filter((F.col("held") >= history) & (F.col("spread") > 0) & (F.abs(F.col(value) - F.col("expected")) > sigma * F.col("spread"))).select(*keys, time, value, "expected", "spread")


def sharp_transition(series: DataFrame, keys: Sequence[str], time: str, value: str) -> DataFrame:
    """The largest step of each series, and whether it is over 1.5 times the mean step."""
    w = Window.partitionBy(*keys).orderBy(time)
    steps = series.withColumn("step", F.abs(F.col(value) - F.lag(value).over(w)))
    return steps.groupBy(*keys).agg(F.max("step").alias("step"), F.max_by(F.col(time), F.struct("step", F.lit(0))).alias("at"), (F.max("step") > 1.5 * F.avg("step")).alias("is_sharp"))


def carried(df: DataFrame, unit: str, time: Sequence[str], value: str) -> DataFrame:
    """The unit's first value, the value before, and the deviation from the unit's mean, on every row."""
    w, whole = Window.partitionBy(unit).orderBy(*time), Window.partitionBy(unit)
    return df.withColumns({"first": F.first(value).over(w), "previous": F.lag(value).over(w), "residual": F.col(value) - F.avg(value).over(whole)})


