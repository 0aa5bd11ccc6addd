"""Aggregations over groups. Null keys are a group of their own, null values count only as rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import flag, group_label, ratio
from .ranks import column_quantiles, group_quantiles, with_facts


def skewness(c: Column) -> Column:
    """The adjusted sample skewness; null under three values or without spread."""
    n = F.count(c)
    return F.when((n >= 3) & (F.stddev_pop(c) > 0), F.sqrt(n * (n - 1.0)) / (n - 2) * F.skewness(c))


def kurtosis(c: Column) -> Column:
    """The adjusted excess kurtosis; null under four values or without spread."""
    n = F.count(c).cast("double")
    return F.when((n >= 4) & (F.stddev_pop(c) > 0), (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(c) + 6))


#: Operations that are one aggregate expression of the target column.
OPERATIONS = {
    "row_count": lambda c: F.count("*"),
    "count": F.count,
    "count_distinct": F.count_distinct,
    "sum": F.sum,
    "mean": F.avg,
    "min": F.min,
    "max": F.max,
    "variance": F.var_samp,
    "stddev": F.stddev_samp,
    "range": lambda c: F.max(c) - F.min(c),
    "missing_count": lambda c: F.count_if(c.isNull()),
    "missing_percent": lambda c: F.count_if(c.isNull()) * 100.0 / F.count("*"),
    "abs_sum": lambda c: F.sum(F.abs(c)),
    "positive_count": lambda c: F.count_if(c > 0),
    "negative_count": lambda c: F.count_if(c < 0),
    "zero_count": lambda c: F.count_if(c == 0),
    "nonzero_count": lambda c: F.count_if(c != 0),
    "skewness": skewness,
    "kurtosis": kurtosis,
    "coefficient_of_variation": lambda c: F.when((F.count(c) >= 2) & (F.avg(c) != 0), F.stddev_samp(c) / F.abs(F.avg(c))),
}


#: Operations that are a difference of quantiles, or one quantile.
QUANTILES = {"median": (0.5,), "q1": (0.25,), "q3": (0.75,), "iqr": (0.75, 0.25)}


def labelled(df: DataFrame, groups: Sequence[str]) -> DataFrame:
    return df.withColumns({g: group_label(g) for g in groups}) if groups else df


def aggregate(df: DataFrame, operation: str, target: str | None = None, groups: Sequence[str] = (), percentile: float | None = None) -> DataFrame:
    """value and row_count of an operation on target for each group; an unknown operation raises."""
    if target is not None and target not in df.columns or any(g not in df.columns for g in groups):
        raise ValueError(f"unknown column among {[target, *groups]}")
    if operation == "duplicate_row_count":
        rows = labelled(df, groups)
        return rows.groupBy(*rows.columns).count().groupBy(*groups).agg(F.sum(F.col("count") - 1).alias("value"), F.sum("count").alias("row_count"))
    rows = labelled(df, groups)
    if operation == "mode":
        counts = rows.groupBy(*groups, F.col(target).alias("v")).agg(F.count("*").alias("n"))
        most = counts.groupBy(*groups).agg(F.max(F.when(F.col("v").isNotNull(), F.col("n"))).alias("m"), F.sum("n").alias("row_count"))
        joined = counts.join(most, list(groups)) if groups else counts.crossJoin(F.broadcast(most))
        top = joined.filter(F.col("v").isNotNull() & (F.col("n") == F.col("m")))
        return top.groupBy(*groups, "row_count").agg(F.min_by("v", F.col("v").cast("string")).alias("value")).select(*groups, "value", "row_count")
    if operation == "mad":
        middle = group_quantiles(rows, target, {"middle": 0.5}, groups)
        joined = with_facts(rows.select(*groups, target), middle, groups)
        return with_rows(rows, group_quantiles(joined.withColumn("off the middle", F.abs(F.col(target) - F.col("middle"))), "off the middle", {"value": 0.5}, groups), groups)
    if operation == "percentile" and (percentile is None or not 0 <= percentile <= 100):
        raise ValueError("a percentile is between 0 and 100")
    if operation == "percentile" or operation in QUANTILES:
        points = {f"q{i}": p for i, p in enumerate(QUANTILES.get(operation) or (percentile / 100,))}
        found = group_quantiles(rows, target, points, groups)
        return with_rows(rows, found.select(*groups, (F.col("q0") - F.col("q1") if len(points) > 1 else F.col("q0")).alias("value")), groups)
    if operation in OPERATIONS:
        value = OPERATIONS[operation](F.col(target) if target else F.lit(1))
    else:
        raise ValueError(f"unknown operation {operation}")
    return rows.groupBy(*groups).agg(value.alias("value"), F.count("*").alias("row_count"))


def with_rows(rows: DataFrame, found: DataFrame, groups: Sequence[str]) -> DataFrame:
    """value (null where a group has none) and row_count of every group."""
    counts = rows.groupBy(*groups).agg(F.count("*").alias("row_count"))
    return counts.join(found, list(groups) if groups else F.lit(True), "left").select(*groups, "value", "row_count")


def rate(df: DataFrame, column: str, groups: Sequence[str] = ()) -> DataFrame:
    """The share of yes among the yes and no of a two-valued column."""
    f = flag(F.col(column))
    return labelled(df, groups).groupBy(*groups).agg(F.avg(f).alias("rate"), F.count(f).alias("n"))


def ratio_of_sums(df: DataFrame, numerator: Column, denominator: Column, groups: Sequence[str] = ()) -> DataFrame:
    """Sum of numerators over sum of denominators; null where that is zero."""
    return labelled(df, groups).groupBy(*groups).agg(ratio(F.sum(numerator), F.sum(denominator)).alias("value"))


def weighted_mean(df: DataFrame, value: str, weight: str, groups: Sequence[str] = ()) -> DataFrame:
    """Mean of value by weight over rows where both are known and the weight is positive."""
    both = F.col(value).isNotNull() & (F.col(weight) > 0)
    w = F.when(both, F.col(weight).cast("double"))
    return labelled(df, groups).groupBy(*groups).agg(ratio(F.sum(w * F.col(value)), F.sum(w)).alias("value"), F.count(w).alias("n"))


def having(df: DataFrame, groups: Sequence[str], target: str, least: int = 5) -> DataFrame:
    """Mean and size of the groups with at least so many rows."""
    return df.groupBy(*groups).agg(F.avg(target).alias("value"), F.count("*").alias("n")).filter(F.col("n") >= least)


def cross_tab(df: DataFrame, a: str, b: str, target: str) -> DataFrame:
    """Sum and rows of every pair of values of two dimensions."""
    return labelled(df, [a, b]).groupBy(a, b).agg(F.sum(target).alias("value"), F.count("*").alias("n"))


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    """Rows of every pair of values, with the margins."""
    cells = labelled(df, [a, b]).groupBy(a, b).agg(F.count("*").alias("n"))
    rows, columns = cells.groupBy(a).agg(F.sum("n").alias("row_total")), cells.groupBy(b).agg(F.sum("n").alias("column_total"))
    return cells.join(rows, a).join(columns, b)


def share_of_total(df: DataFrame, target: str, group: str) -> DataFrame:
    """Each group's sum and its share of the sum over all; null where that is zero."""
    sums = labelled(df, [group]).groupBy(group).agg(F.sum(target).alias("value"))
    total = sums.agg(F.sum("value").alias("total"))
    return sums.crossJoin(F.broadcast(total)).select(group, "value", ratio(F.col("value"), F.col("total")).alias("share"))


def frequency_table(df: DataFrame, column: str, top_n: int = 20) -> DataFrame:
    """The most frequent values with count, percent and cumulative percent of the non-null."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("item")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    top = counts.orderBy(F.desc("n"), "item").limit(top_n).crossJoin(F.broadcast(total))
    running = Window.orderBy(F.desc("n"), "item").rowsBetween(Window.unboundedPreceding, 0)  # over top_n rows
    return top.select("item", "n", (F.col("n") * 100.0 / F.col("total")).alias("percent"), (F.sum("n").over(running) * 100.0 / F.col("total")).alias("cumulative_percent"))


def pareto(df: DataFrame, group: str, target: str, share: float = 0.8) -> DataFrame:
    """How many groups, largest first, reach a share of the total."""
    sums = df.groupBy(group).agg(F.sum(target).alias("value")).filter("value > 0")
    running = Window.orderBy(F.desc("value"), group).rowsBetween(Window.unboundedPreceding, -1)  # one row a group
    before = sums.withColumn("before", F.coalesce(F.sum("value").over(running), F.lit(0.0))).withColumn("total", F.sum("value").over(Window.partitionBy()))
    return before.agg(F.count_if(F.col("before") < share * F.col("total")).alias("groups_needed"), F.count("*").alias("groups"))


def segments(df: DataFrame, segment: str, target: str) -> DataFrame:
    """Sum, mean, spread, rows, share, cumulative share, rank and z-score of the sums of every segment."""
    sums = labelled(df, [segment]).groupBy(segment).agg(
        F.sum(target).alias("total"), F.avg(target).alias("mean"), F.stddev_samp(target).alias("sd"), F.count(target).alias("n")
    )
    whole = sums.agg(F.sum("total").alias("all"), F.avg("total").alias("mid"), F.stddev_samp("total").alias("spread"))
    order = Window.orderBy(F.desc("total"), segment)  # one row a segment
    return sums.crossJoin(F.broadcast(whole)).select(
        segment, "total", "mean", "sd", "n",
        ratio(F.col("total"), F.col("all")).alias("share"),
        ratio(F.sum("total").over(order.rowsBetween(Window.unboundedPreceding, 0)), F.col("all")).alias("cumulative_share"),
        F.row_number().over(order).alias("rank"),
        ratio(F.col("total") - F.col("mid"), F.col("spread")).alias("z"),
    )


def descriptive(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per column: counts, moments, extremes and quantiles; quantiles are narrowed from sketches to exact values."""
    points = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)
    held = column_quantiles(df, columns, points)
    parts = []
    for c in columns:
        v = F.col(c).cast("double")
        at = lambda p: F.lit(held[c][points.index(p)]).cast("double")  # noqa: E731, B023
        parts.append(F.struct(
            F.lit(c).alias("column"), F.count(v).alias("n"), F.count_if(v.isNull()).alias("nulls"), F.sum(v).alias("sum"), F.avg(v).alias("mean"),
            at(0.5).alias("median"), F.min(v).alias("min"), F.max(v).alias("max"), F.var_samp(v).alias("variance"), F.stddev_samp(v).alias("sd"),
            F.skewness(v).alias("skewness"), F.kurtosis(v).alias("kurtosis"), (at(0.75) - at(0.25)).alias("iqr"),
            *(at(p / 100).alias(f"p{p}") for p in (1, 5, 95, 99)),
        ))
    return df.agg(F.array(*parts).alias("rows")).select(F.inline("rows"))


def rfm(df: DataFrame, customer: str, time: str, amount: str) -> DataFrame:
    """Orders, revenue and last date of every customer."""
    return df.groupBy(customer).agg(F.count("*").alias("frequency"), F.sum(amount).alias("monetary"), F.max(F.to_date(time)).alias("last_date"))


def rfm_summary(df: DataFrame, customer: str, time: str, amount: str) -> DataFrame:
    """Customers, their share below the median revenue and their share with a single order."""
    by_customer = rfm(df, customer, time, amount)
    middle = column_quantiles(by_customer, ["monetary"], [0.5])["monetary"][0]
    return by_customer.agg(
        F.count("*").alias("customers"), F.avg((F.col("monetary") < F.lit(middle).cast("double")).cast("double")).alias("below_median_share"), F.avg((F.col("frequency") == 1).cast("double")).alias("single_order_share")
    )


def event_rates(df: DataFrame, group: str, event: str, exposure: str | None = None) -> DataFrame:
    """Events, known rows and crude rate of each group; with exposure also events per unit of exposure, unknown rows included."""
    e = F.col(event).cast("double")
    more = [ratio(F.sum(F.coalesce(e, F.lit(0.0))), F.sum(exposure)).alias("exposure_rate")] if exposure else []
    return labelled(df, [group]).groupBy(group).agg(F.sum(e).alias("events"), F.count(e).alias("known"), F.avg(e).alias("rate"), *more)


def censoring(df: DataFrame, event: str) -> DataFrame:
    """Events, confirmed non-events and rows with an unknown outcome."""
    return df.agg(F.count_if(F.col(event) == 1).alias("events"), F.count_if(F.col(event) == 0).alias("non_events"), F.count_if(F.col(event).isNull()).alias("censored"))


def stratified_rates(df: DataFrame, group: str, stratum: str, event: str) -> DataFrame:
    """Crude rate of each group within each stratum."""
    e = F.col(event).cast("double")
    return labelled(df, [group, stratum]).groupBy(group, stratum).agg(F.avg(e).alias("rate"), F.count(e).alias("n"))


def missingness(df: DataFrame, target: str, group: str) -> DataFrame:
    """Null rate of a column in each group, and its gap to the rate over all rows."""
    null = F.col(target).isNull().cast("double")
    by_group = labelled(df, [group]).groupBy(group).agg(F.avg(null).alias("null_rate"), F.count("*").alias("n"))
    return by_group.crossJoin(F.broadcast(df.agg(F.avg(null).alias("overall")))).withColumn("gap", F.col("null_rate") - F.col("overall"))


def missingness_bounds(df: DataFrame, target: str, groups: Sequence[str] = ()) -> DataFrame:
    """Sum and mean if every missing value were the least, or the largest, that was seen; null under two known values."""
    v = F.col(target).cast("double")
    n, missing = F.count(v), F.count_if(v.isNull())
    low, high = F.sum(v) + missing * F.min(v), F.sum(v) + missing * F.max(v)
    known = lambda c: F.when(n >= 2, c)
    return labelled(df, groups).groupBy(*groups).agg(
        n.alias("known"), missing.alias("missing"), known(low).alias("sum_low"), known(high).alias("sum_high"), known(low / (n + missing)).alias("mean_low"), known(high / (n + missing)).alias("mean_high")
    )


def ranking_stability(df: DataFrame, target: str, group: str, a: str, b: str) -> DataFrame:
    """Whether group a is above group b whatever the missing values were."""
    bounds = missingness_bounds(df.filter(F.col(group).isin(a, b)), target, [group])
    side = lambda g, c: F.max(F.when(F.col(group) == g, F.col(c)))
    return bounds.agg(side(a, "mean_low").alias("a_low"), side(a, "mean_high").alias("a_high"), side(b, "mean_low").alias("b_low"), side(b, "mean_high").alias("b_high")).withColumn(
        "stable", (F.col("a_low") > F.col("b_high")) | (F.col("b_low") > F.col("a_high"))
    )


# Parts of names by which a column's natural aggregation is chosen.
RATE_WORDS = ("rate", "ratio", "percent", "pct", "share", "margin", "discount", "avg", "average", "mean", "score", "price")
ID_ENDS = ("id", "key", "code")


def resolve_aggregation(column: str) -> str:
    """The aggregation that a column's name calls for: ids are counted, rates averaged, amounts summed."""
    words = column.lower().split("_")
    if words[-1].endswith(ID_ENDS):
        return "count_distinct"
    return "mean" if any(w in RATE_WORDS for w in words) else "sum"


def metric(df: DataFrame, column: str, groups: Sequence[str] = ()) -> DataFrame:
    """A column by its natural aggregation."""
    return aggregate(df, resolve_aggregation(column), column, groups)
