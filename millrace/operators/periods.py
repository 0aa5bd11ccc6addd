"""Periods of time: scopes anchored to the data's last date, series, changes and what explains them."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import group_label, ratio
from ..functions.tails import normal_quantile, normal_sf
from .ranks import column_quantiles


@dataclass(frozen=True)
class Period:
    """A half-open range of days."""

    start: dt.date
    end: dt.date

    def holds(self, time: str) -> Column:
        return (F.col(time) >= F.lit(self.start).cast("timestamp")) & (F.col(time) < F.lit(self.end).cast("timestamp"))


def add_months(day: dt.date, n: int) -> dt.date:
    month = day.year * 12 + day.month - 1 + n
    return dt.date(month // 12, month % 12 + 1, 1)


def last_day(df: DataFrame, time: str) -> dt.date | None:
    """The latest date in the data, which anchors every relative period."""
    return df.agg(F.max(F.to_date(time))).first()[0]


MONTHS = {"month": 1, "quarter": 3, "year": 12}


def scope(anchor: dt.date, name: str) -> tuple[Period, Period]:
    """A named period and its baseline.

    Names: this_ or last_ month, quarter, year or week; last_N_days; trailing_12_months; today, yesterday; wow and yoy (this
    week or month against the last, or against that of a year before); a month (2024-05), quarter (2024-Q2), year (2024) or
    day (2024-05-31); between_A_B, before_A and after_A for days A and B, the last two against as many days before.
    """
    which, _, unit = name.partition("_")
    day, one = dt.date.fromisoformat, dt.timedelta(1)
    span = lambda start, end: (Period(start, end), Period(start - (end - start), start))
    if name in ("today", "yesterday"):
        start = anchor - one * (name == "yesterday")
        return span(start, start + one)
    if name == "wow":
        return scope(anchor, "this_week")
    if name == "yoy":
        start = add_months(anchor, 0)
        return Period(start, add_months(start, 1)), Period(add_months(start, -12), add_months(start, -11))
    if name == "trailing_12_months":
        end = add_months(anchor, 1)
        return Period(add_months(end, -12), end), Period(add_months(end, -24), add_months(end, -12))
    if which == "between":
        a, b = unit.split("_")
        return span(day(a), day(b) + one)
    if which == "before":
        return span(day(unit) - dt.timedelta(365), day(unit))
    if which == "after":
        return span(day(unit) + one, max(anchor + one, day(unit) + 2 * one))
    if m := re.fullmatch(r"(\d{4})(?:-(\d{2})|-Q([1-4]))?", name):
        n = 1 if m[2] else 3 if m[3] else 12
        start = dt.date(int(m[1]), int(m[2]) if m[2] else 3 * int(m[3]) - 2 if m[3] else 1, 1)
        return Period(start, add_months(start, n)), Period(add_months(start, -n), start)
    if re.fullmatch(r"\d{4}-\d{2}-\d{2}", name):
        return span(day(name), day(name) + one)
    if unit.endswith("_days") and which == "last":
        end = anchor + one
        return span(end - dt.timedelta(int(unit.split("_")[0])), end)
    if unit == "week":
        monday = anchor - dt.timedelta(anchor.weekday() + (7 if which == "last" else 0))
        return span(monday, monday + dt.timedelta(7))
    if unit not in MONTHS or which not in ("this", "last"):
        raise ValueError(f"unknown period {name}")
    n = MONTHS[unit]
    start = add_months(anchor, -((anchor.month - 1) % n) - (n if which == "last" else 0))
    return Period(start, add_months(start, n)), Period(add_months(start, -n), start)


def infer_grain(df: DataFrame, time: str) -> DataFrame:
    """grain of a time column, from the gaps between its distinct dates: day, week, month, quarter or year."""
    days = df.select(F.to_date(time).alias("d")).filter("d IS NOT NULL").distinct()
    # the gap to the next date, within and across years, without one window over all dates
    year = Window.partitionBy(F.year("d")).orderBy("d")
    gaps = days.withColumn("gap", F.datediff(F.lead("d").over(year), "d"))
    middle = column_quantiles(gaps, ["gap"], [0.5])["gap"][0]
    facts = gaps.agg(F.count("*").alias("dates"), F.bool_and(F.dayofmonth("d") == 1).alias("first_days")).select(F.lit(middle).cast("double").alias("gap"), "dates", "first_days")
    grain = F.when(F.col("gap") <= 1.5, "day").when(F.col("gap") <= 8, "week").when(F.col("gap") <= 31, "month").when(F.col("gap") <= 92, "quarter").otherwise("year")
    return facts.withColumn("grain", grain)


AGGREGATES = {"sum": F.sum, "mean": F.avg, "count": F.count}


def period_series(df: DataFrame, time: str, value: str, how: str = "sum", grain: str = "month", keys: Sequence[str] = ()) -> DataFrame:
    """period (its first day), value and n of every period and key; rows without a date are left out."""
    period = F.to_date(F.date_trunc(grain, time)).alias("period")
    return df.filter(F.col(time).isNotNull()).groupBy(*keys, period).agg(AGGREGATES[how](value).alias("value"), F.count(value).alias("n"), F.count_distinct(F.to_date(time)).alias("days"))


def drop_partial_last(series: DataFrame, grain: str, least: float = 0.9) -> DataFrame:
    """Without the last period if fewer than a share of its days were seen."""
    last = series.agg(F.max("period").alias("last"))
    following = {"month": F.add_months("period", 1), "quarter": F.add_months("period", 3), "year": F.add_months("period", 12), "week": F.date_add("period", 7), "day": F.date_add("period", 1)}[grain]
    complete = F.col("days") >= least * F.datediff(following, "period")
    return series.crossJoin(F.broadcast(last)).filter((F.col("period") < F.col("last")) | complete).drop("last")


def period_change(df: DataFrame, time: str, value: str, current: Period, previous: Period, groups: Sequence[str] = ()) -> DataFrame:
    """current, previous, delta and percent of a sum in two periods, from one pass."""
    now, then = current.holds(time), previous.holds(time)
    sums = df.filter(now | then).withColumns({g: group_label(g) for g in groups}).groupBy(*groups).agg(
        F.coalesce(F.sum(F.when(now, F.col(value))), F.lit(0.0)).alias("current"), F.coalesce(F.sum(F.when(then, F.col(value))), F.lit(0.0)).alias("previous"),
        F.count(F.when(now, F.col(value))).alias("n_current"), F.count(F.when(then, F.col(value))).alias("n_previous"),
    )
    return sums.withColumn("delta", F.col("current") - F.col("previous")).withColumn("percent", 100 * ratio(F.col("delta"), F.col("previous")))


def volume_and_rate(change: DataFrame) -> DataFrame:
    """The change of a sum by more rows, by a higher mean, and by both together."""
    p0, p1 = ratio(F.col("previous"), F.col("n_previous")), ratio(F.col("current"), F.col("n_current"))
    dn, dp = F.col("n_current") - F.col("n_previous"), p1 - p0
    return change.withColumns({"volume_effect": dn * p0, "rate_effect": F.col("n_previous") * dp, "cross_effect": dn * dp})


def contributions(df: DataFrame, time: str, value: str, current: Period, previous: Period, dimensions: Sequence[str]) -> DataFrame:
    """dimension, level, delta and share of the total change, for all dimensions from one job."""
    now, then = current.holds(time), previous.holds(time)
    signed = F.when(now, F.col(value)).when(then, -F.col(value))
    long = df.filter(now | then).select(signed.alias("v"), F.inline(F.array(*(F.struct(F.lit(d).alias("dimension"), F.coalesce(F.col(d).cast("string"), F.lit("<missing>")).alias("level")) for d in dimensions))))
    deltas = long.groupBy("dimension", "level").agg(F.sum("v").alias("delta"))
    return deltas.withColumn("share", ratio(F.col("delta"), F.sum("delta").over(Window.partitionBy("dimension"))))


def drill_down(df: DataFrame, time: str, value: str, current: Period, previous: Period, dimensions: Sequence[str], least: float = 0.4) -> DataFrame:
    """The level that moved most the way of the total, and within it the level of another dimension that holds `least` or more of its change, if any."""
    parts = contributions(df, time, value, current, previous, dimensions)
    top = parts.orderBy(F.desc("share"), "dimension", "level").first()
    if top is None or top["share"] is None:
        return parts.limit(0).select("dimension", "level", "delta", F.lit("").alias("sub_dimension"), F.lit("").alias("sub_level"), F.col("delta").alias("sub_delta"), F.col("share").alias("sub_share"))
    others = [d for d in dimensions if d != top["dimension"]]
    inside = df.filter(F.coalesce(F.col(top["dimension"]).cast("string"), F.lit("<missing>")) == top["level"])
    best = contributions(inside, time, value, current, previous, others).filter(F.col("share") >= least).orderBy(F.desc("share"), "dimension", "level").first() if others else None
    sub = (best["dimension"], best["level"], best["delta"], best["share"]) if best else (None,) * 4
    return df.sparkSession.createDataFrame([(top["dimension"], top["level"], top["delta"], *sub)], "dimension string, level string, delta double, sub_dimension string, sub_level string, sub_delta double, sub_share double")


def per_day(change: DataFrame, current: Period, previous: Period, least: float = 0.03) -> DataFrame:
    """The change with its totals for each calendar day where the periods' lengths differ by more than 3 %, else null."""
    now, then = (current.end - current.start).days, (previous.end - previous.start).days
    differ = F.lit(abs(now - then) / then > least)
    a, b = F.col("current") / now, F.col("previous") / then
    return change.withColumns({"per_day_current": F.when(differ, a), "per_day_previous": F.when(differ, b), "per_day_percent": F.when(differ, 100 * (ratio(a, b) - 1))})


def kitagawa(df: DataFrame, time: str, value: str, current: Period, previous: Period, dimension: str) -> DataFrame:
    """The change of a mean by changed means within levels and by a changed mix of levels."""
    change = period_change(df, time, value, current, previous, [dimension])
    whole = change.agg(F.sum("n_current").alias("n1"), F.sum("n_previous").alias("n0"))
    w1, w0 = F.col("n_current") / F.col("n1"), F.col("n_previous") / F.col("n0")
    y1, y0 = F.coalesce(ratio(F.col("current"), F.col("n_current")), F.lit(0.0)), F.coalesce(ratio(F.col("previous"), F.col("n_previous")), F.lit(0.0))
    parts = change.crossJoin(F.broadcast(whole)).select((0.5 * (w1 + w0) * (y1 - y0)).alias("rate"), (0.5 * (y1 + y0) * (w1 - w0)).alias("mix"))
    return parts.agg(F.sum("rate").alias("rate_effect"), F.sum("mix").alias("mix_effect"))


def cohort_bridge(df: DataFrame, time: str, entity: str, value: str, current: Period, previous: Period) -> DataFrame:
    """cohort (new, retained, lost), entities and delta between two periods."""
    per = period_change(df, time, value, current, previous, [entity])
    cohort = F.when(F.col("n_previous") == 0, "new").when(F.col("n_current") == 0, "lost").otherwise("retained")
    return per.groupBy(cohort.alias("cohort")).agg(F.count("*").alias("entities"), F.sum("delta").alias("delta"))


def change_is_unusual(series: DataFrame) -> DataFrame:
    """z of the last change against the others by median and 1.4826 times the median absolute deviation; null under five."""
    w = Window.orderBy("period")  # one row a period
    changes = series.withColumn("change", F.col("value") - F.lag("value").over(w)).filter("change IS NOT NULL")
    last = changes.agg(F.max_by("change", "period").alias("judged"), F.max("period").alias("last"))
    others = changes.crossJoin(F.broadcast(last)).filter("period < last")
    middle = others.agg(F.median("change").alias("middle"), F.count("*").alias("others"), F.first("judged").alias("judged"))
    spread = others.crossJoin(F.broadcast(middle.select("middle"))).agg((1.4826 * F.median(F.abs(F.col("change") - F.col("middle")))).alias("spread"))
    return middle.crossJoin(spread).withColumn("z", F.when(F.col("others") >= 5, ratio(F.col("judged") - F.col("middle"), F.col("spread"))))


def time_coordinates(df: DataFrame, time: str, unit: str = "day") -> DataFrame:
    """elapsed: units since the first date; months, quarters and years by the calendar."""
    first = df.agg(F.min(time).alias("first date"))
    months = F.months_between(F.date_trunc("month", time), F.date_trunc("month", "first date"))
    elapsed = {"day": F.datediff(time, "first date"), "week": F.datediff(time, "first date") / 7, "month": months, "quarter": months / 3, "year": F.year(time) - F.year("first date")}[unit]
    return df.crossJoin(F.broadcast(first)).withColumn("elapsed", elapsed.cast("double")).drop("first date")


def slopes(values: np.ndarray) -> np.ndarray:
    i, j = np.triu_indices(len(values), 1)
    return (values[j] - values[i]) / (j - i)


def trend_of(values: np.ndarray) -> dict:
    """Median and least-squares slope per period, Kendall's tau and its p, and the lag-1 autocorrelation of residuals."""
    n = len(values)
    pairs = slopes(values)
    s, ties = float(np.sign(pairs).sum()), np.unique(values, return_counts=True)[1]
    spread = (n * (n - 1) * (2 * n + 5) - float((ties * (ties - 1) * (2 * ties + 5)).sum())) / 18
    tau = s / np.sqrt(len(pairs) * (len(pairs) - float((ties * (ties - 1) / 2).sum()))) if len(pairs) > (ties * (ties - 1) / 2).sum() else 0.0
    p = 2 * normal_sf(abs(s) / np.sqrt(spread)) if spread > 0 else 1.0
    x = np.arange(n) - (n - 1) / 2
    ols = float((x * values).sum() / (x * x).sum())
    r = values - values.mean() - ols * x
    sxx = float((x * x).sum())
    # heteroscedasticity- and autocorrelation-consistent error with a triangular kernel
    lags, scores = int(np.floor(4 * (n / 100) ** (2 / 9))), x * r
    meat = float((scores**2).sum()) + 2 * sum((1 - k / (lags + 1)) * float((scores[k:] * scores[:-k]).sum()) for k in range(1, lags + 1))
    se = np.sqrt(max(meat, 0.0)) / sxx
    half = normal_quantile(0.05) * np.sqrt(max(spread, 0.0))
    ordered = np.sort(pairs)
    low, high = (ordered[int(min(max(k, 0), len(ordered) - 1))] for k in (np.floor((len(ordered) - half) / 2), np.ceil((len(ordered) + half) / 2) - 1))
    auto = float((r[1:] * r[:-1]).sum() / (r * r).sum()) if (r * r).sum() > 0 else 0.0
    median = float(np.median(pairs))
    ols_p = 2 * normal_sf(abs(ols) / se) if se > 0 else (0.0 if ols else 1.0)
    detectable = n >= 10 and p < 0.05 and ols_p < 0.05 and np.sign(median) == np.sign(ols) and median != 0
    return {"n": n, "median_slope": median, "slope_low": float(low), "slope_high": float(high), "ols_slope": ols, "ols_se": float(se), "tau": float(tau), "p_value": float(p), "residual_autocorrelation": auto, "detectable": bool(detectable)}


TREND = "n int, median_slope double, slope_low double, slope_high double, ols_slope double, ols_se double, tau double, p_value double, residual_autocorrelation double, detectable boolean"


def trend(series: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """A trend of every series of periods (a bounded group each); under three periods there is none."""
    names = list(keys) or ["series"]
    rows = series if keys else series.withColumn("series", F.lit("all"))

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        values = group.sort_values("period")["value"].astype(float).dropna().to_numpy()
        if len(values) < 3:
            return pd.DataFrame(columns=[*names, *(c.split()[0] for c in TREND.split(", "))])
        return pd.DataFrame([{**{k: group[k].iloc[0] for k in names}, **trend_of(values)}])

    schema = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in names)
    return rows.groupBy(*names).applyInPandas(fit, f"{schema}, {TREND}")


def series_summary(series: DataFrame) -> DataFrame:
    """First, last, net change, growth and volatility of a period series, and its least-squares slope a period."""
    w = Window.orderBy("period")  # one row a period
    s = series.withColumn("i", F.row_number().over(w).cast("double")).withColumn("change", F.col("value") - F.lag("value").over(w))
    facts = s.agg(F.min_by("value", "period").alias("first"), F.max_by("value", "period").alias("last"), F.count("*").alias("periods"), F.regr_slope("value", "i").alias("slope"), F.stddev_samp("change").alias("volatility"))
    return facts.withColumn("net_change", F.col("last") - F.col("first")).withColumn("growth", ratio(F.col("last") - F.col("first"), F.col("first")))


def before_and_after(series: DataFrame, boundary: dt.date, keys: Sequence[str] = ()) -> DataFrame:
    """Slope and level of each side of a boundary."""
    first = series.groupBy(*keys).agg(F.min("period").alias("start")) if keys else series.agg(F.min("period").alias("start"))
    joined = series.join(first, list(keys)) if keys else series.crossJoin(F.broadcast(first))
    x = F.months_between("period", "start")
    side = F.when(F.col("period") < F.lit(boundary), "before").otherwise("after")
    return joined.withColumn("x", x).groupBy(*keys, side.alias("side")).agg(F.regr_slope("value", "x").alias("slope"), F.avg("value").alias("level"), F.count("*").alias("periods"))


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def corrected_trends(series: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A trend of every series, its p-value corrected for their number."""
    from .inference import adjusted

    return adjusted(trend(series, keys))
