"""Statistical tests and associations: aggregates on Spark, a few numbers finished on the result rows.

Rank tests use value counts (ranks.py); regressions one job of cross-products. Small or constant samples give a status
instead of an error.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import tails
from ..functions.scalars import group_label, ratio
from .ranks import bounds_of, column_quantiles, group_quantiles, mid_ranks, running
from .resampling import bootstrap


def one_row(df: DataFrame, values: dict) -> DataFrame:
    """A result of a few numbers as a frame."""
    values = {k: v.item() if isinstance(v, np.generic) else v for k, v in values.items()}
    clean = {k: (None if isinstance(v, float) and not math.isfinite(v) else v) for k, v in values.items()}
    kind = lambda v: T.BooleanType() if isinstance(v, bool) else T.LongType() if isinstance(v, int) else T.StringType() if isinstance(v, str) else T.DoubleType()
    schema = T.StructType([T.StructField(k, kind(v)) for k, v in clean.items()])
    return df.sparkSession.createDataFrame([tuple(clean.values())], schema)


def moments(df: DataFrame, value: str, group: str) -> DataFrame:
    """group, n, mean and variance, a row for every group."""
    return df.filter(F.col(value).isNotNull()).groupBy(group_label(group).alias("group")).agg(F.count("*").alias("n"), F.avg(value).cast("double").alias("mean"), F.var_samp(value).alias("var"))


def two_of(groups: DataFrame, group: str) -> tuple[dict, dict]:
    """The rows of the two groups, in order; any other number of groups is an error."""
    found = [r.asDict() for r in groups.orderBy("group").take(3)]
    if len(found) != 2:
        raise ValueError(f"{group} has {'more than two' if len(found) > 2 else len(found)} groups, not two")
    return found[0], found[1]


def two_groups(df: DataFrame, value: str, group: str) -> tuple[dict, dict]:
    return two_of(moments(df, value, group), group)


def t_test(df: DataFrame, value: str, group: str, pooled: bool = False, alpha: float = 0.05) -> DataFrame:
    """Welch's (or the pooled) t-test of two groups, the difference's interval, Cohen's d and Hedges' g."""
    a, b = two_groups(df, value, group)
    if min(a["n"], b["n"]) < 2 or a["var"] + b["var"] == 0:
        return one_row(df, {"status": "insufficient_data"})
    n1, n2, v1, v2 = a["n"], b["n"], a["var"], b["var"]
    both = ((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)
    if pooled:
        se, dof = math.sqrt(both * (1 / n1 + 1 / n2)), float(n1 + n2 - 2)
    else:
        x, y = v1 / n1, v2 / n2
        se, dof = math.sqrt(x + y), (x + y) ** 2 / (x * x / (n1 - 1) + y * y / (n2 - 1))
    gap = a["mean"] - b["mean"]
    half = tails.t_quantile(alpha, dof) * se
    d = gap / math.sqrt(both)
    return one_row(df, {"statistic": gap / se, "df": dof, "p_value": tails.t_sf(gap / se, dof), "difference": gap, "low": gap - half, "high": gap + half, "cohens_d": d, "hedges_g": d * (1 - 3 / (4 * (n1 + n2) - 9)), "n_a": n1, "n_b": n2, "status": "ok"})


def paired_t(df: DataFrame, x: str, y: str) -> DataFrame:
    """The t-test of the mean of x - y."""
    d = F.col(x) - F.col(y)
    n, mean, sd = df.agg(F.count(d), F.avg(d), F.stddev_samp(d)).first()
    if n < 2 or not sd:
        return one_row(df, {"status": "insufficient_data"})
    t = mean / (sd / math.sqrt(n))
    return one_row(df, {"statistic": t, "df": n - 1, "p_value": tails.t_sf(t, n - 1), "difference": mean, "status": "ok"})


def wilcoxon(df: DataFrame, x: str, y: str) -> DataFrame:
    """The signed-rank test by its normal approximation with tie correction; zero differences are left out."""
    d = df.select((F.col(x) - F.col(y)).alias("d")).filter("d <> 0").withColumn("size", F.abs("d"))
    ranks = mid_ranks(d, "size").select(F.col("value").alias("size"), F.col("n").alias("tied"), "mid_rank")
    signs = d.withColumn("size", F.col("size").cast("double")).groupBy("size").agg(F.count_if(F.col("d") > 0).alias("up"))
    w, ties, n = signs.join(ranks, "size").agg(F.sum(F.col("up") * F.col("mid_rank")), F.sum(F.col("tied").cast("double") ** 3 - F.col("tied")), F.sum("tied")).first()
    if not n:
        return one_row(df, {"status": "insufficient_data"})
    var = n * (n + 1) * (2 * n + 1) / 24 - ties / 48
    z = (w - n * (n + 1) / 4) / math.sqrt(var)
    return one_row(df, {"statistic": float(w), "z": z, "p_value": 2 * tails.normal_sf(abs(z)), "n": int(n), "status": "ok"})


def rank_sums(df: DataFrame, value: str, group: str) -> tuple[DataFrame, float, int]:
    """group, ranks (their sum) and n of every group, the tie term and all rows."""
    labelled = df.select(group_label(group).alias("group"), F.col(value).cast("double").alias("value")).filter("value IS NOT NULL")
    ranks = mid_ranks(labelled, "value").select("value", "n", "mid_rank")
    per = labelled.groupBy("group", "value").agg(F.count("*").alias("k")).join(ranks, "value")
    groups = per.groupBy("group").agg(F.sum(F.col("k") * F.col("mid_rank")).alias("ranks"), F.sum("k").alias("n"))
    ties, n = ranks.agg(F.sum(F.col("n").cast("double") ** 3 - F.col("n")), F.sum("n")).first()
    return groups, float(ties or 0), int(n or 0)


def mann_whitney(df: DataFrame, value: str, group: str) -> DataFrame:
    """U of the first of two groups, its p by the tie-corrected normal approximation, and the rank-biserial correlation."""
    groups, ties, n = rank_sums(df, value, group)
    a, b = two_of(groups, group)
    n1, n2 = a["n"], b["n"]
    u = a["ranks"] - n1 * (n1 + 1) / 2
    sd = math.sqrt(n1 * n2 / 12 * (n + 1 - ties / (n * (n - 1))))
    z = (abs(u - n1 * n2 / 2) - 0.5) / sd if sd else 0.0
    return one_row(df, {"statistic": float(u), "z": z, "p_value": min(1.0, 2 * tails.normal_sf(z)), "rank_biserial": 2 * u / (n1 * n2) - 1, "n_a": n1, "n_b": n2, "status": "ok"})


def kruskal(df: DataFrame, value: str, group: str) -> DataFrame:
    """Kruskal and Wallis's H with tie correction, and epsilon squared."""
    groups, ties, n = rank_sums(df, value, group)
    k, squares = groups.agg(F.count("*"), F.sum(F.col("ranks") * F.col("ranks") / F.col("n"))).first()
    if k < 2:
        return one_row(df, {"status": "insufficient_data"})
    h = 12 / (n * (n + 1)) * squares - 3 * (n + 1)
    h /= 1 - ties / (n**3 - n)
    return one_row(df, {"statistic": h, "df": k - 1, "p_value": tails.chi2_sf(h, k - 1), "epsilon_squared": h / (n - 1), "n": n, "status": "ok"})


def anova(df: DataFrame, value: str, group: str, welch: bool = False) -> DataFrame:
    """One-way analysis of variance and eta squared, or Welch's for unequal variances: two jobs of one row each over the groups."""
    g = moments(df, value, group).filter("n > 1")
    size, at, w = F.col("n"), F.col("mean"), F.col("n") / F.nullif(F.col("var"), F.lit(0.0))
    weight = w if welch else size
    k, n, weights, sums, within, flat = g.agg(F.count("*"), F.sum(size), F.sum(weight), F.sum(weight * at), F.sum((size - 1) * F.col("var")), F.count_if(F.col("var") == 0)).first()
    if k < 2 or welch and flat:
        return one_row(df, {"status": "insufficient_data"})
    mean = sums / weights
    between, lack = g.agg(F.sum(weight * (at - mean) * (at - mean)), F.sum((1 - weight / float(weights)) ** 2 / (size - 1))).first()
    if welch:
        f = between / (k - 1) / (1 + 2 * (k - 2) / (k * k - 1) * lack)
        dof = (k * k - 1) / (3 * lack)
        return one_row(df, {"statistic": f, "df_between": k - 1, "df_within": dof, "p_value": tails.f_sf(f, k - 1, dof), "status": "ok"})
    f = between / (k - 1) / (within / (n - k)) if within else math.inf
    return one_row(df, {"statistic": f, "df_between": k - 1, "df_within": float(n - k), "p_value": tails.f_sf(f, k - 1, n - k), "eta_squared": between / (between + within) if between + within else None, "status": "ok"})


def chi_square(df: DataFrame, a: str, b: str) -> DataFrame:
    """Independence of two columns, without continuity correction, and Cramér's V."""
    cells = df.groupBy(group_label(a), group_label(b)).agg(F.count("*").alias("n"))
    rows, columns = cells.groupBy(a).agg(F.sum("n").alias("r")), cells.groupBy(b).agg(F.sum("n").alias("c"))
    total = cells.agg(F.sum("n").alias("t"))
    term = F.col("n").cast("double") * F.col("n") / (F.col("r").cast("double") * F.col("c"))
    s, k, m, n = cells.join(rows, a).join(columns, b).agg(F.sum(term), F.count_distinct(a), F.count_distinct(b)).crossJoin(total).first()
    if not n or min(k, m) < 2:
        return one_row(df, {"status": "not_applicable"})
    chi, dof = n * (s - 1), (k - 1) * (m - 1)
    return one_row(df, {"statistic": chi, "df": dof, "p_value": tails.chi2_sf(chi, dof), "cramers_v": math.sqrt(max(chi, 0) / (n * (min(k, m) - 1))), "n": n, "status": "ok"})


def fisher_exact(df: DataFrame, a: str, b: str, alpha: float = 0.05) -> DataFrame:
    """Fisher's exact test of two 0/1 columns, and the odds ratio with its interval."""
    cell = lambda x, y: F.count_if((F.col(a) == x) & (F.col(b) == y))
    p, q, r, s = df.agg(cell(1, 1), cell(1, 0), cell(0, 1), cell(0, 0)).first()
    row, column, n = p + q, p + r, p + q + r + s
    log = lambda x: math.lgamma(row + 1) + math.lgamma(n - row + 1) + math.lgamma(column + 1) + math.lgamma(n - column + 1) - math.lgamma(n + 1) - math.lgamma(x + 1) - math.lgamma(row - x + 1) - math.lgamma(column - x + 1) - math.lgamma(n - row - column + x + 1)
    chance = [math.exp(log(x)) for x in range(max(0, row + column - n), min(row, column) + 1)]
    limit = math.exp(log(p)) * (1 + 1e-7)
    odds = p * s / (q * r) if q * r else math.inf
    half = tails.normal_quantile(alpha) * math.sqrt(sum(1 / x for x in (p, q, r, s))) if min(p, q, r, s) else math.inf
    return one_row(df, {"odds_ratio": odds, "low": odds * math.exp(-half), "high": odds * math.exp(half), "p_value": min(1.0, sum(c for c in chance if c <= limit)), "n": n})


def two_rates(df: DataFrame, event: str, group: str, alpha: float = 0.05) -> DataFrame:
    """The difference of two groups' rates of a 0/1 column, with Newcombe's interval and a chi-square p."""
    a, b = two_groups(df, event, group)
    z = tails.normal_quantile(alpha)

    def wilson(p, n):
        mid, half = p + z * z / (2 * n), z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
        return (mid - half) / (1 + z * z / n), (mid + half) / (1 + z * z / n)

    p1, p2, n1, n2 = a["mean"], b["mean"], a["n"], b["n"]
    (l1, u1), (l2, u2) = wilson(p1, n1), wilson(p2, n2)
    p = (p1 * n1 + p2 * n2) / (n1 + n2)
    chi = (p1 - p2) ** 2 / (p * (1 - p) * (1 / n1 + 1 / n2)) if 0 < p < 1 else 0.0
    d = p1 - p2
    return one_row(df, {"difference": d, "low": d - math.hypot(p1 - l1, u2 - p2), "high": d + math.hypot(u1 - p1, p2 - l2), "statistic": chi, "p_value": tails.chi2_sf(chi, 1), "rate_a": p1, "rate_b": p2})


def ecdf_gaps(baseline: DataFrame, current: DataFrame, value: str) -> tuple[DataFrame, list[float]]:
    """value, the two distribution functions at it, and their rows; and bounds that cut the values into ranges.

    One count of values holds both sides, so their running sums come from one shuffle.
    """
    side = lambda d, i: d.select(F.col(value).cast("double").alias("value"), F.lit(i).alias("side")).filter("value IS NOT NULL")
    both = side(baseline, 0).union(side(current, 1))
    bounds = bounds_of(both, F.col("value"))
    counts = both.groupBy("value").agg(F.count_if(F.col("side") == 0).alias("a"), F.count_if(F.col("side") == 1).alias("b"))
    r = running(counts, bounds, {"a": "a below", "b": "b below"}, totals={"a": "n0", "b": "n1"})
    share = lambda c, n: (F.col(f"{c} below") + F.col(c)) / F.greatest(F.lit(1), F.col(n))
    return r.select("value", share("a", "n0").alias("f0"), share("b", "n1").alias("f1"), "n0", "n1"), bounds


def ks_test(baseline: DataFrame, current: DataFrame, value: str) -> DataFrame:
    """The largest gap between two distribution functions, with its asymptotic p."""
    d, n0, n1 = ecdf_gaps(baseline, current, value)[0].agg(F.max(F.abs(F.col("f0") - F.col("f1"))), F.max("n0"), F.max("n1")).first()
    if d is None or not n0 or not n1:
        return one_row(baseline, {"status": "insufficient_data"})
    return one_row(baseline, {"statistic": d, "p_value": tails.kolmogorov_sf(d * math.sqrt(n0 * n1 / (n0 + n1))), "n_baseline": n0, "n_current": n1, "status": "ok"})


def continuous_drift(baseline: DataFrame, current: DataFrame, column: str, alpha: float = 0.01, least: int = 30) -> DataFrame:
    """statistic, p_value, both numbers of values and `drifted`: a Kolmogorov-Smirnov p below alpha, where both sides have `least` values; else drifted is null."""
    found = ks_test(baseline, current, column).first().asDict()
    if found["status"] != "ok":
        return baseline.sparkSession.createDataFrame([(None, None, 0, 0, None)], "statistic double, p_value double, n_baseline long, n_current long, drifted boolean")
    enough = min(found["n_baseline"], found["n_current"]) >= least
    row = (float(found["statistic"]), float(found["p_value"]), found["n_baseline"], found["n_current"], bool(found["p_value"] < alpha) if enough else None)
    return baseline.sparkSession.createDataFrame([row], "statistic double, p_value double, n_baseline long, n_current long, drifted boolean")


def drift_cycle(tables: Mapping[str, tuple[DataFrame, DataFrame]], columns: Mapping[str, Sequence[str]]) -> DataFrame:
    """One cycle over tables with a baseline and a recent version: table, column, kind, value (of the statistic or the stability index), and drifted.

    Columns of numbers are tested by continuous_drift, all others by the population stability index; a column that either version lacks has no row.
    """
    from .quality import population_stability

    parts = []
    for name in sorted(columns):
        baseline, current = tables[name]
        for c in columns[name]:
            if c in baseline.columns and c in current.columns:
                if isinstance(baseline.schema[c].dataType, T.NumericType):
                    found = continuous_drift(baseline, current, c).select(F.lit("CONTINUOUS_KS").alias("kind"), F.col("statistic").alias("value"), "drifted")
                else:
                    found = population_stability(baseline, current, c).select(F.lit("CATEGORICAL_PSI").alias("kind"), F.col("psi").alias("value"), "drifted")
                parts.append(found.select(F.lit(name).alias("table"), F.lit(c).alias("column"), "kind", "value", "drifted"))
    if not parts:
        raise ValueError("no monitored column is in both versions of its table")
    return reduce(DataFrame.unionByName, parts)


def wasserstein(baseline: DataFrame, current: DataFrame, value: str) -> DataFrame:
    """The area between two distribution functions, from quantile functions summed over ranges of values."""
    gaps, bounds = ecdf_gaps(baseline, current, value)
    part = sum(((F.col("value") >= b).cast("int") for b in bounds), F.lit(0))
    gaps = gaps.withColumn("range", part)
    w = Window.partitionBy("range").orderBy("value")
    inner = gaps.withColumn("next", F.lead("value").over(w)).agg(F.sum(F.abs(F.col("f0") - F.col("f1")) * (F.col("next") - F.col("value"))).alias("d"))
    ends = gaps.groupBy("range").agg(F.max("value").alias("last"), F.max_by(F.abs(F.col("f0") - F.col("f1")), "value").alias("gap"), F.min("value").alias("first"))
    across = ends.withColumn("next", F.lead("first").over(Window.orderBy("range"))).agg(F.sum(F.col("gap") * (F.col("next") - F.col("last"))).alias("e"))  # 32 rows
    return inner.crossJoin(across).select((F.coalesce("d", F.lit(0.0)) + F.coalesce("e", F.lit(0.0))).alias("distance"))


def by_batch(f):
    """A function of numbers as a pandas UDF; null where an argument is."""

    @F.pandas_udf("double")
    def applied(*columns: pd.Series) -> pd.Series:
        return pd.Series([None if any(map(pd.isna, row)) else float(f(*row)) for row in zip(*columns)], dtype=float)

    return applied


def adjusted(results: DataFrame, p_value: str = "p_value") -> DataFrame:
    """Bonferroni, Holm and Benjamini-Hochberg p-values of a table of results."""
    up, m = Window.orderBy(p_value), F.count("*").over(Window.partitionBy())  # result rows
    i = F.row_number().over(up)
    rows = results.withColumn("m", m).withColumn("i", i)
    p = F.col(p_value)
    rows = rows.withColumn("holm step", (F.col("m") - F.col("i") + 1) * p).withColumn("bh step", F.col("m") * p / F.col("i"))
    one = F.lit(1.0)
    return rows.withColumns({
        "bonferroni": F.least(one, F.col("m") * p), "holm": F.least(one, F.max("holm step").over(up.rowsBetween(Window.unboundedPreceding, 0))),
        "benjamini_hochberg": F.least(one, F.min("bh step").over(up.rowsBetween(0, Window.unboundedFollowing))),
    }).drop("m", "i", "holm step", "bh step")


def bootstrap_mean(df: DataFrame, value: str, key: str, resamples: int = 200, seed: int = 7, alpha: float = 0.05) -> DataFrame:
    """mean, low and high by a Poisson bootstrap: each row has a Poisson(1) weight in every resample, drawn from its key."""
    return bootstrap(df, value, key, resamples=resamples, seed=seed, alpha=alpha).select(F.col("estimate").alias("mean"), "low", "high")


def simpson(df: DataFrame, value: str, group: str, stratum: str) -> DataFrame:
    """The marginal difference of two groups, the difference averaged over strata, and whether its sign turns."""
    cells = df.filter(F.col(value).isNotNull()).groupBy(group_label(group), group_label(stratum)).agg(F.count("*").alias("n"), F.sum(value).alias("s"))
    labels = sorted(r[0] for r in cells.select(group).distinct().limit(3).collect())
    if len(labels) != 2:
        raise ValueError(f"{group} does not have two groups")
    side = lambda g, c: F.sum(F.when(F.col(group) == g, F.col(c)))
    strata = cells.groupBy(stratum).agg(*(side(g, c).alias(f"{c}{i}") for i, g in enumerate(labels) for c in ("n", "s"))).filter("n0 IS NOT NULL AND n1 IS NOT NULL")
    gap = F.col("s0") / F.col("n0") - F.col("s1") / F.col("n1")
    weight = F.col("n0") + F.col("n1")
    marginal = cells.agg(*(side(g, c).alias(f"{c}{i}") for i, g in enumerate(labels) for c in ("n", "s"))).select((F.col("s0") / F.col("n0") - F.col("s1") / F.col("n1")).alias("marginal"))
    within = strata.agg(ratio(F.sum(gap * weight), F.sum(weight)).alias("within"), F.count("*").alias("strata"))
    return marginal.crossJoin(within).withColumn("reversed", F.signum("marginal") * F.signum("within") < 0)


def specification_curve(df: DataFrame, group: str, value: str) -> DataFrame:
    """The leading group under three trims and three aggregates, and whether it agrees with the untrimmed mean."""
    q = column_quantiles(df, [value], [0.01, 0.05, 0.95, 0.99])[value]
    at = [F.lit(x).cast("double") for x in q]
    rows = df.filter(F.col(value).isNotNull()).withColumn(group, group_label(group))
    trims = {"none": F.lit(True), "1%": F.col(value).between(at[0], at[3]), "5%": F.col(value).between(at[1], at[2])}
    how = {"sum": F.sum, "mean": F.avg}
    wide = rows.groupBy(group).agg(*(h(F.when(c, F.col(value))).alias(f"{t} {n}") for t, c in trims.items() for n, h in how.items()))
    for t, c in trims.items():
        wide = wide.join(group_quantiles(rows.filter(c), value, {f"{t} median": 0.5}, [group]), group, "left")
    long = wide.select(group, F.inline(F.array(*(F.struct(F.lit(t).alias("trim"), F.lit(n).alias("aggregate"), F.col(f"{t} {n}").cast("double").alias("v")) for t in trims for n in [*how, "median"]))))
    best = long.groupBy("trim", "aggregate").agg(F.max_by(group, "v").alias("leader"))
    baseline = best.filter("trim = 'none' AND aggregate = 'mean'").select(F.col("leader").alias("baseline"))
    return best.crossJoin(F.broadcast(baseline)).select("trim", "aggregate", "leader", (F.col("leader") == F.col("baseline")).alias("agrees"))


def correlation(df: DataFrame, x: str, y: str, alpha: float = 0.05) -> DataFrame:
    """Pearson's r with its p, Fisher interval and the covariance."""
    both = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    r, cov, n = both.agg(F.corr(x, y), F.covar_samp(x, y), F.count("*")).first()
    if r is None or n < 4:
        return one_row(df, {"status": "insufficient_data"})
    dof = n - 2
    t = r * math.sqrt(dof / (1 - r * r)) if abs(r) < 1 else math.inf
    half = tails.normal_quantile(alpha) / math.sqrt(n - 3)
    z = math.atanh(r) if abs(r) < 1 else math.inf
    return one_row(df, {"r": r, "covariance": cov, "p_value": tails.t_sf(t, dof), "low": math.tanh(z - half), "high": math.tanh(z + half), "n": n, "status": "ok"})


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """Pearson's r of mid-ranks."""
    both = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).filter("x IS NOT NULL AND y IS NOT NULL")
    rank = lambda c: mid_ranks(both, c).select(F.col("value").alias(c), F.col("mid_rank").alias(f"rank {c}"))
    rho, n = both.join(rank("x"), "x").join(rank("y"), "y").agg(F.corr("rank x", "rank y"), F.count("*")).first()
    t = rho * math.sqrt((n - 2) / (1 - rho * rho)) if rho is not None and abs(rho) < 1 else math.inf
    return one_row(df, {"rho": rho, "p_value": tails.t_sf(t, n - 2) if n > 2 else None, "n": n})


def cross_products(df: DataFrame, columns: Sequence[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows without nulls, means, and sums of centred cross-products: two jobs of one row each."""
    rows = df.select(*(F.col(c).cast("double").alias(c) for c in columns)).na.drop()
    first = rows.agg(F.count("*"), *(F.avg(c) for c in columns)).first()
    n, means = first[0], np.array([m or 0.0 for m in first[1:]])
    p = len(columns)
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    sums = rows.agg(*(F.sum((F.col(columns[i]) - float(means[i])) * (F.col(columns[j]) - float(means[j]))) for i, j in pairs)).first()
    out = np.zeros((p, p))
    for (i, j), s in zip(pairs, sums):
        out[i, j] = out[j, i] = s or 0.0
    return n, means, out


def ols(df: DataFrame, y: str, xs: Sequence[str], alpha: float = 0.05) -> DataFrame:
    """term, estimate, se, t, p, interval of every coefficient, with n, R squared, AIC and BIC of the fit."""
    n, means, s = cross_products(df, [y, *xs])
    p = len(xs)
    if n <= p + 1 or np.linalg.matrix_rank(s[1:, 1:]) < p:
        return df.sparkSession.createDataFrame([("(none)", "rank_deficient")], "term string, status string")
    inverse = np.linalg.inv(s[1:, 1:])
    slopes = inverse @ s[1:, 0]
    rss = float(s[0, 0] - slopes @ s[1:, 0])
    var = rss / (n - p - 1)
    se = np.sqrt(np.diag(inverse) * var)
    intercept = float(means[0] - slopes @ means[1:])
    se0 = math.sqrt(var * (1 / n + means[1:] @ inverse @ means[1:]))
    critical = tails.t_quantile(alpha, n - p - 1)
    loglik = -n / 2 * (math.log(2 * math.pi * rss / n) + 1)
    fit = (int(n), 1 - rss / s[0, 0], 2 * (p + 1) - 2 * loglik, math.log(n) * (p + 1) - 2 * loglik)
    rows = [(k, float(b), float(e), float(b / e), float(tails.t_sf(b / e, n - p - 1)), float(b - critical * e), float(b + critical * e), *map(float, fit[1:]), fit[0]) for k, b, e in zip(["(intercept)", *xs], [intercept, *slopes], [se0, *se])]
    return df.sparkSession.createDataFrame(rows, "term string, estimate double, se double, t double, p_value double, low double, high double, r_squared double, aic double, bic double, n long")


def ols_robust(df: DataFrame, y: str, xs: Sequence[str], cluster: str | None = None) -> DataFrame:
    """term, estimate and se of a fit with HC3 errors, or clustered ones: a second pass sums the outer products of scores."""
    n, means, s = cross_products(df, [y, *xs])
    inverse = np.linalg.inv(s[1:, 1:])
    b = inverse @ s[1:, 0]
    rows = df.select(*([cluster] if cluster else []), *(F.col(c).cast("double").alias(c) for c in [y, *xs])).na.drop(subset=[y, *xs])
    centred = [F.col(x) - float(m) for x, m in zip(xs, means[1:])]
    residual = F.col(y) - float(means[0]) - sum(float(v) * c for v, c in zip(b, centred))
    p = len(xs)
    if cluster:
        scores = rows.groupBy(cluster).agg(*(F.sum(residual * c).alias(f"s{i}") for i, c in enumerate(centred)))
        k = scores.count()
        parts = scores.agg(*(F.sum(F.col(f"s{i}") * F.col(f"s{j}")) for i in range(p) for j in range(p))).first()
        scale = k / (k - 1) * (n - 1) / (n - p - 1)
    else:
        leverage = 1 / n + sum(float(inverse[i, j]) * centred[i] * centred[j] for i in range(p) for j in range(p))
        weight = (residual / (1 - leverage)) ** 2
        parts = rows.agg(*(F.sum(weight * centred[i] * centred[j]) for i in range(p) for j in range(p))).first()
        scale = 1.0
    covariance = inverse @ np.array(parts, float).reshape(p, p) @ inverse * scale
    return df.sparkSession.createDataFrame([(x, float(v), float(math.sqrt(c))) for x, v, c in zip(xs, b, np.diag(covariance))], "term string, estimate double, se double")


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """a, b, r, partial (given all others) and p of every pair, with corrected p-values."""
    n, _, s = cross_products(df, columns)
    d = np.sqrt(np.diag(s))
    r = s / np.outer(d, d)
    q = np.linalg.inv(r)
    rows = []
    for i in range(len(columns)):
        for j in range(i + 1, len(columns)):
            v = float(r[i, j])
            rows.append((columns[i], columns[j], v, float(-q[i, j] / math.sqrt(q[i, i] * q[j, j])), float(tails.t_sf(v * math.sqrt((n - 2) / (1 - v * v)), n - 2)) if abs(v) < 1 else 0.0))
    return adjusted(df.sparkSession.createDataFrame(rows, "a string, b string, r double, partial double, p_value double"))


def vif(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column and its variance inflation by the others."""
    _, _, s = cross_products(df, columns)
    d = np.sqrt(np.diag(s))
    inflation = np.diag(np.linalg.inv(s / np.outer(d, d)))
    return df.sparkSession.createDataFrame([(c, float(v)) for c, v in zip(columns, inflation)], "column string, vif double")


def design_rank(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """condition_number of the design with a constant (root of the ratio of its products' extreme eigenvalues), rank, and whether it is full."""
    n, means, s = cross_products(df, columns)
    whole = np.zeros((len(columns) + 1, len(columns) + 1))
    whole[0, 0], whole[0, 1:], whole[1:, 0] = n, n * means, n * means
    whole[1:, 1:] = s + n * np.outer(means, means)
    d = np.sqrt(np.maximum(np.diag(s), 0))
    scaled = s / np.outer(np.where(d > 0, d, 1), np.where(d > 0, d, 1))
    rank = int(n > 0) + int((np.linalg.eigvalsh(scaled) > 1e-10 * len(columns)).sum())  # of columns of unit spread, apart from the constant
    values = np.linalg.eigvalsh(whole)
    condition = float(np.sqrt(values[-1] / values[0])) if values[0] > 0 and rank == len(columns) + 1 else math.inf
    return one_row(df, {"condition_number": condition, "rank": rank, "full_rank": rank == len(columns) + 1})


def simple_regression(df: DataFrame, y: str, x: str, groups: Sequence[str] = ()) -> DataFrame:
    """Slope, intercept and R squared in every group."""
    return df.groupBy(*groups).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r_squared"), F.regr_count(y, x).alias("n"))


def pairwise(df: DataFrame, value: str, group: str) -> DataFrame:
    """a, b, difference, statistic and corrected p-values of Welch's test for every pair of groups."""
    g = moments(df, value, group).filter("n > 1 AND var > 0").select("group", "n", "mean", (F.col("var") / F.col("n")).alias("v"))
    pairs = g.alias("a").join(g.alias("b"), F.col("a.group") < F.col("b.group"))
    x, y, gap = F.col("a.v"), F.col("b.v"), F.col("a.mean") - F.col("b.mean")
    dof = (x + y) * (x + y) / (x * x / (F.col("a.n") - 1) + y * y / (F.col("b.n") - 1))
    p_value = by_batch(tails.t_sf)
    tested = pairs.select(F.col("a.group").alias("a"), F.col("b.group").alias("b"), gap.alias("difference"), (gap / F.sqrt(x + y)).alias("statistic"), dof.alias("dof"))
    return adjusted(tested.withColumn("p_value", p_value("statistic", "dof")).drop("dof"))


def power_of_two_means(effect: float, n_a: int, n_b: int, alpha: float = 0.05) -> float:
    """The chance to detect a standardised difference, by the normal approximation."""
    z, shift = tails.normal_quantile(alpha), effect * math.sqrt(n_a * n_b / (n_a + n_b))
    return tails.normal_sf(z - shift) + tails.normal_sf(z + shift)
