"""Screens over many columns: drivers of an outcome, exploratory pairs, sensitivity to outliers, regression diagnostics,
roles of columns, fitness of a table for analysis, and checks of claims."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import tails
from ..functions.scalars import group_label, ratio
from .inference import adjusted, cross_products, ols_robust, one_row
from .pairs import kendall as kendall
from .quality import exact_profile, numeric
from .ranks import column_quantiles, group_quantiles, positions
from .rows import one_hot


def outlier_sensitivity(df: DataFrame, group: str, value: str, share: float = 0.01) -> DataFrame:
    """The leading group by mean, by mean without the top share of values, and by median, and whether they agree."""
    held = F.when(F.col(value) <= F.lit(column_quantiles(df, [value], [1 - share])[value][0]).cast("double"), F.col(value))
    rows = df.withColumn(group, group_label(group))
    facts = rows.groupBy(group).agg(F.avg(value).alias("m"), F.avg(held).alias("t")).join(group_quantiles(rows, value, {"d": 0.5}, [group]), group, "left")
    leaders = facts.agg(F.max_by(group, "m").alias("by_mean"), F.max_by(group, "t").alias("by_trimmed_mean"), F.max_by(group, "d").alias("by_median"))
    return leaders.withColumn("stable", (F.col("by_mean") == F.col("by_trimmed_mean")) & (F.col("by_mean") == F.col("by_median")))


def moderation(df: DataFrame, moderator: str, predictor: str, outcome: str) -> DataFrame:
    """moderator, and the outcome's range of means over the predictor's levels within it."""
    cells = df.groupBy(group_label(moderator), group_label(predictor)).agg(F.avg(outcome).alias("mean"), F.count(outcome).alias("n"))
    return cells.groupBy(moderator).agg((F.max("mean") - F.min("mean")).alias("contrast"), F.max_by(predictor, "mean").alias("highest"), F.sum("n").alias("n"))


def stronger_predictor(df: DataFrame, outcome: str, predictors: Sequence[str]) -> DataFrame:
    """predictor, its correlation with the outcome, and its place by size, from one job."""
    pairs = df.agg(F.array(*(F.struct(F.lit(p).alias("predictor"), F.corr(outcome, p).alias("r")) for p in predictors)).alias("rows")).select(F.inline("rows"))
    return pairs.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(F.abs("r")), "predictor")))


def partial_correlation(df: DataFrame, x: str, y: str, controls: Sequence[str]) -> DataFrame:
    """The correlation of x and y given controls."""
    n, _, s = cross_products(df, [x, y, *controls])
    q = np.linalg.inv(s)
    r = float(-q[0, 1] / math.sqrt(q[0, 0] * q[1, 1]))
    dof = n - 2 - len(controls)
    return one_row(df, {"r": r, "p_value": float(tails.t_sf(r * math.sqrt(dof / (1 - r * r)), dof)), "n": n})


def fitted(df: DataFrame, y: str, xs: Sequence[str]) -> tuple[DataFrame, int, np.ndarray, np.ndarray]:
    """The complete rows with `fit`, `e` (residual) and `h` (leverage) of a least-squares fit; n, the inverse of the centred products, and the slopes."""
    n, means, s = cross_products(df, [y, *xs])
    inverse = np.linalg.inv(s[1:, 1:])
    b = inverse @ s[1:, 0]
    rows = df.na.drop(subset=[y, *xs])
    centred = [F.col(x).cast("double") - float(m) for x, m in zip(xs, means[1:])]
    fit = F.lit(float(means[0])) + sum((float(v) * c for v, c in zip(b, centred)), F.lit(0.0))
    leverage = F.lit(1 / n) + sum((float(inverse[i, j]) * centred[i] * centred[j] for i in range(len(xs)) for j in range(len(xs))), F.lit(0.0))
    return rows.withColumns({"fit": fit, "h": leverage}).withColumn("e", F.col(y) - F.col("fit")), n, inverse, b


def explained(df: DataFrame, y: str, xs: Sequence[str]) -> tuple[int, float, float]:
    """n, R squared and the residual sum of squares of a least-squares fit; columns that repeat others are left to the pseudo-inverse."""
    n, _, s = cross_products(df, [y, *xs])
    scale = np.sqrt(np.diag(s)[1:])
    scale[scale == 0] = 1.0
    slopes = np.linalg.pinv(s[1:, 1:] / np.outer(scale, scale)) @ (s[1:, 0] / scale)
    held = float(slopes @ (s[1:, 0] / scale))
    return n, float(held / s[0, 0]) if s[0, 0] else 0.0, float(s[0, 0] - held)


def lagged(rows: DataFrame, columns: Sequence[str], lags: int, block: int = 50_000) -> DataFrame:
    """Rows numbered by `position` with `lag k c` for every column c and k up to `lags`, 0 before the first.

    Rows are looked back on within blocks of consecutive numbers, to which the last rows of the block before are added.
    """
    block = max(block, 10 * lags)
    number = F.floor((F.col("position") - 1) / block)
    own = rows.withColumn("block of row", number).withColumn("is own", F.lit(True))
    carried = rows.filter(F.pmod(F.col("position") - 1, F.lit(block)) >= block - lags).withColumn("block of row", number + 1).withColumn("is own", F.lit(False))
    w = Window.partitionBy("block of row").orderBy("position")
    earlier = {f"lag {k} {c}": F.coalesce(F.lag(c, k).over(w), F.lit(0.0)) for c in columns for k in range(1, lags + 1)}
    return own.union(carried).withColumns(earlier).filter("`is own`").drop("block of row", "is own")


def diagnostics(df: DataFrame, y: str, xs: Sequence[str], time: str | None = None) -> DataFrame:
    """Jarque-Bera, Breusch-Pagan, RESET, Cook's distance and leverage of a fit; with a time column Durbin-Watson and Breusch-Godfrey over all rows in its order."""
    p = len(xs)
    if df.na.drop(subset=[y, *xs]).limit(p + 3).count() < p + 3:
        return one_row(df, {"status": "insufficient_data"})
    rows, n, _, _ = fitted(df, y, xs)
    skew, kurt, rss = rows.agg(F.skewness("e"), F.kurtosis("e"), F.sum(F.col("e") * F.col("e"))).first()
    jb = n / 6 * (skew * skew + kurt * kurt / 4)
    m, r2, _ = explained(rows.withColumn("e2", F.col("e") * F.col("e")), "e2", xs)
    _, _, with_square = explained(rows.withColumn("fit2", F.col("fit") * F.col("fit")), y, [*xs, "fit2"])
    reset = (rss - with_square) / (with_square / (n - p - 2)) if with_square > 0 else math.inf
    e, h = F.col("e"), F.col("h")
    cook = e * e / ((p + 1) * (rss / (n - p - 1))) * h / ((1 - h) * (1 - h))
    most, influential, high = rows.agg(F.max(cook), F.count_if(cook > 4 / max(n - p - 1, 1)), F.count_if(h > 2 * (p + 1) / n)).first()
    out = {
        "jarque_bera": jb, "jarque_bera_p": float(tails.chi2_sf(jb, 2)), "breusch_pagan": m * r2, "breusch_pagan_p": float(tails.chi2_sf(m * r2, p)), "reset": reset, "reset_p": float(tails.f_sf(reset, 1, n - p - 2)),
        "max_cook": float(most), "influential": int(influential), "high_leverage": int(high), "n": n,
    }
    if time:
        lags = min(4, max(1, n // 10))
        placed = lagged(positions(rows.select(time, y, *xs, "e"), seconds(time), [*xs, y]), ["e"], lags)
        gap = F.col("e") - F.col("lag 1 e")
        out["durbin_watson"] = placed.agg(F.sum(F.when(F.col("position") > 1, gap * gap))).first()[0] / rss
        if n >= 20:
            _, again, _ = explained(placed, "e", [*xs, *(f"lag {k} e" for k in range(1, lags + 1))])
            out["breusch_godfrey"], out["breusch_godfrey_p"] = n * again, float(tails.chi2_sf(n * again, lags))
    return one_row(df, out)


def seconds(time: str) -> Column:
    return F.col(time).cast("timestamp").cast("double")


def ols_hac(df: DataFrame, y: str, xs: Sequence[str], time: str, lags: int | None = None) -> DataFrame:
    """term, estimate and se of a fit whose errors allow for serial dependence (Newey and West), over all rows in the order of time."""
    rows, n, inverse, b = fitted(df, y, xs)
    means = rows.agg(*(F.avg(x) for x in xs)).first()
    lags = max(1, int(4 * (n / 100) ** (2 / 9))) if lags is None else lags
    scores = rows.select(time, y, *xs, *(((F.col(x) - float(m)) * F.col("e")).alias(f"s{i}") for i, (x, m) in enumerate(zip(xs, means))))
    names = [f"s{i}" for i in range(len(xs))]
    placed = lagged(positions(scores, seconds(time), [*xs, y]).select("position", *names), names, lags)
    weight = lambda k: 1 - k / (lags + 1)
    # of a pair of scores: the product in one row, and both ways with every row before it
    crossed = lambda a, b: F.sum(F.col(a) * F.col(b) + sum((weight(k) * (F.col(a) * F.col(f"lag {k} {b}") + F.col(b) * F.col(f"lag {k} {a}")) for k in range(1, lags + 1)), F.lit(0.0)))
    total = np.array(placed.agg(*(crossed(a, b) for a in names for b in names)).first(), float).reshape(len(xs), -1)
    covariance = inverse @ total @ inverse
    return df.sparkSession.createDataFrame([(x, float(v), float(math.sqrt(max(c, 0)))) for x, v, c in zip(xs, b, np.diag(covariance))], "term string, estimate double, se double")


def adjusted_association(df: DataFrame, y: str, x: str, controls: Sequence[str], alpha: float = 0.05) -> DataFrame:
    """The slope of x on y given controls (texts as 0/1 columns of their ten most frequent values), with HC3 errors, and the slope without them."""
    rows = df.na.drop(subset=[y, x])
    numbers = [c for c in controls if isinstance(df.schema[c].dataType, T.NumericType)]
    columns = list(numbers)
    for c in controls:
        if c not in numbers:
            rows = one_hot(rows, c, drop_first=True)
            plain = {n: f"{c} is {i}" for i, n in enumerate(k for k in rows.columns if k.startswith(f"{c}="))}
            rows = rows.withColumnsRenamed(plain)
            columns += plain.values()
    alone = ols_robust(rows, y, [x]).first()
    found = ols_robust(rows, y, [x, *columns]).filter(F.col("term") == x).first()
    z = tails.normal_quantile(alpha)
    t = found["estimate"] / found["se"] if found["se"] else math.inf
    return one_row(df, {"estimate": found["estimate"], "se": found["se"], "low": found["estimate"] - z * found["se"], "high": found["estimate"] + z * found["se"], "p_value": 2 * tails.normal_sf(abs(t)), "unadjusted": alone["estimate"]})


def driver_screen(df: DataFrame, outcome: str, candidates: Sequence[str], least: float = 0.1) -> DataFrame:
    """candidate, kind and strength (correlation, or the square root of the share of variance between groups) of the drivers above a limit."""
    numbers = [c for c in candidates if isinstance(df.schema[c].dataType, T.NumericType)]
    labels = [c for c in candidates if c not in numbers]
    parts = []
    if numbers:
        parts.append(df.agg(F.array(*(F.struct(F.lit(c).alias("candidate"), F.lit("number").alias("kind"), F.abs(F.corr(outcome, c)).alias("strength")) for c in numbers)).alias("rows")).select(F.inline("rows")))
    if labels:
        long = df.filter(F.col(outcome).isNotNull()).select(F.col(outcome).cast("double").alias("v"), F.inline(F.array(*(F.struct(F.lit(c).alias("candidate"), F.coalesce(F.col(c).cast("string"), F.lit("<missing>")).alias("level")) for c in labels))))
        per = long.groupBy("candidate", "level").agg(F.count("*").alias("n"), F.avg("v").alias("m"))
        whole = df.agg(F.avg(outcome).alias("mm"), F.var_pop(outcome).alias("vv"), F.count(outcome).alias("nn"))
        between = per.crossJoin(F.broadcast(whole)).groupBy("candidate").agg(F.sqrt(ratio(F.sum(F.col("n") * (F.col("m") - F.col("mm")) * (F.col("m") - F.col("mm"))), F.first("vv") * F.first("nn"))).alias("strength"))
        parts.append(between.select("candidate", F.lit("category").alias("kind"), "strength"))
    return reduce(DataFrame.unionByName, parts).filter(F.col("strength") >= least)


def exploratory_pairs(df: DataFrame, columns: Sequence[str] | None = None, top: int = 20) -> DataFrame:
    """a, b, r, p and corrected p of all pairs of number columns, the clearest first."""
    columns = list(columns or numeric(df))
    n, _, s = cross_products(df, columns)
    rows = []
    for i in range(len(columns)):
        for j in range(i):
            spread = math.sqrt(s[i, i] * s[j, j])
            if spread:
                r = float(s[i, j] / spread)
                rows.append((columns[j], columns[i], r, float(tails.t_sf(r * math.sqrt((n - 2) / (1 - r * r)), n - 2)) if abs(r) < 1 else 0.0))
    return adjusted(df.sparkSession.createDataFrame(rows, "a string, b string, r double, p_value double")).orderBy("p_value", F.desc(F.abs("r"))).limit(top)


def roles(df: DataFrame) -> DataFrame:
    """column, type and role: time, key, identifier, metric, category or text, by type, name and distinct values."""
    counted = reduce(DataFrame.union, (df.select(F.col(f"`{f.name}`").alias("v")).agg(F.lit(f.name).alias("column"), F.count("*").alias("rows"), F.count_distinct("v").alias("n")) for f in df.schema.fields))
    found = counted.collect()  # a row a column
    counts, n = {r["column"]: r["n"] for r in found}, found[0]["rows"]
    out = []
    for f in df.schema.fields:
        d, name = counts[f.name], f.name.lower()
        kind = f.dataType.simpleString()
        if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            role = "time"
        elif name.endswith(("id", "key", "code")):
            role = "key" if d >= 0.97 * n else "identifier"
        elif isinstance(f.dataType, T.NumericType):
            role = "metric"
        else:
            role = "category" if d <= max(50, 0.05 * n) else "text"
        out.append((f.name, kind, role))
    return df.sparkSession.createDataFrame(out, "column string, type string, role string")


def fitness(df: DataFrame, metric: str, least_rows: int = 30, most_missing: float = 0.4) -> DataFrame:
    """rows, missing share, distinct values and a verdict (FIT, CAUTION, UNFIT) for an analysis of one metric."""
    facts = exact_profile(df, [metric]).withColumn("missing_share", ratio(F.col("nulls"), F.col("rows")))
    verdict = F.when((F.col("rows") - F.col("nulls") < least_rows) | (F.col("distinct") < 2), "UNFIT").when(F.col("missing_share") > most_missing, "UNFIT").when(F.col("missing_share") > 0.05, "CAUTION").otherwise("FIT")
    return facts.select("column", "rows", "nulls", "distinct", "missing_share", verdict.alias("verdict"))


def leakage(df: DataFrame, target: str, columns: Sequence[str], least: float = 0.995) -> DataFrame:
    """column and correlation of number columns that all but repeat the target."""
    pairs = df.agg(F.array(*(F.struct(F.lit(c).alias("column"), F.corr(target, c).alias("r")) for c in columns)).alias("rows")).select(F.inline("rows"))
    return pairs.filter(F.abs("r") >= least)


def temporal_validity(df: DataFrame, time: str, earliest: str = "1900-01-01") -> DataFrame:
    """First and last date, rows without one, before the earliest plausible date, and after the given table's last midnight."""
    t = F.col(time).cast("timestamp")
    return df.agg(F.date_format(F.min(t), "yyyy-MM-dd").alias("first"), F.date_format(F.max(t), "yyyy-MM-dd").alias("last"), F.count_if(t.isNull()).alias("missing"), F.count_if(t < F.lit(earliest).cast("timestamp")).alias("too_early"))


def claim_checks(results: DataFrame, claims: Sequence[Mapping]) -> DataFrame:
    """claim, value and verdict for claims on a one-row result: {"name", "column", "least", "most"}."""
    parts = []
    for c in claims:
        v = F.col(c["column"]).cast("double")
        low, high = F.lit(c.get("least", -math.inf)), F.lit(c.get("most", math.inf))
        parts.append(F.struct(F.lit(c["name"]).alias("claim"), v.alias("value"), F.when(v.isNull(), "INCONCLUSIVE").when((v >= low) & (v <= high), "SUPPORTED").otherwise("REFUTED").alias("verdict")))
    return results.select(F.inline(F.array(*parts)))


def top_share(df: DataFrame, group: str, value: str) -> DataFrame:
    """The largest group and its share of the total."""
    sums = df.groupBy(group_label(group)).agg(F.sum(value).alias("v"))
    return sums.agg(F.max_by(group, "v").alias("leader"), ratio(F.max("v"), F.sum("v")).alias("share"))


def rows_used(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows, rows that an analysis of the columns can use, and those it drops."""
    known = reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in columns))
    return df.agg(F.count("*").alias("rows"), F.count_if(known).alias("n_used"), F.count_if(~known).alias("n_dropped"))


def materiality(before: DataFrame, after: DataFrame, column: str, most_rows: float = 0.05, most_shift: float = 0.1) -> DataFrame:
    """Change of rows and of a column's mean between versions, and whether either is material."""
    facts = lambda d, n: d.agg(F.count("*").alias(f"rows_{n}"), F.avg(column).alias(f"mean_{n}"), F.stddev_pop(column).alias(f"sd_{n}"))
    both = facts(before, "before").crossJoin(facts(after, "after"))
    rows, shift = ratio(F.col("rows_after") - F.col("rows_before"), F.col("rows_before")), ratio(F.col("mean_after") - F.col("mean_before"), F.col("sd_before"))
    return both.select(rows.alias("row_change"), shift.alias("mean_shift"), ((F.abs(rows) > most_rows) | (F.abs(shift) > most_shift)).alias("material"))
