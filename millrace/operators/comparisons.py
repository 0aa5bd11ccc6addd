"""Comparisons of groups: which test fits, what it says, whether the difference survives strata, and patterns in results.

Shapes of groups come from one aggregate; a few rows a group are finished on the driver. Normality is judged by moments
(Jarque and Bera), since a test of order statistics would sort every group in one place.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import tails
from ..functions.scalars import group_label, ratio
from .inference import anova, by_batch, chi_square, correlation, fisher_exact, kruskal, ks_test, mann_whitney, one_row, paired_t, spearman, t_test, two_rates, wasserstein, wilcoxon
from .ranks import column_quantiles, group_quantiles, with_facts

ALPHA = 0.05


def shapes(df: DataFrame, value: str, group: str) -> DataFrame:
    """group, n, mean, sd, skewness, kurtosis, p of normality, and whether the values are all but constant."""
    v = F.col(value).cast("double")
    facts = df.filter(v.isNotNull() & ~F.isnan(v)).groupBy(group_label(group).alias("group")).agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"), F.skewness(v).alias("skewness"), F.kurtosis(v).alias("kurtosis"), (F.max(v) - F.min(v)).alias("range"), F.max(F.abs(v)).alias("largest")
    )
    jb = F.col("n") / 6 * (F.col("skewness") * F.col("skewness") + F.col("kurtosis") * F.col("kurtosis") / 4)
    constant = F.col("range") <= 100 * 2.0**-52 * F.greatest(F.lit(1.0), F.col("largest"))
    return facts.select("group", "n", "mean", "sd", "skewness", "kurtosis", F.when((F.col("n") >= 3) & ~constant, F.exp(-jb / 2)).alias("normality_p"), constant.alias("constant"))


def preflight(df: DataFrame, value: str, group: str, least: int = 2, least_groups: int = 2) -> DataFrame:
    """groups, usable ones, constant ones, and a status: ALLOWED, or why a comparison is blocked."""
    s = shapes(df, value, group)
    usable = F.col("n") >= least
    facts = s.agg(F.count("*").alias("groups"), F.count_if(usable).alias("usable"), F.count_if(usable & F.col("constant")).alias("constant"))
    status = F.when(F.col("usable") < least_groups, f"insufficient_groups:{least_groups}").when(F.col("constant") == F.col("usable"), "constant_or_near_constant_group_outcome").otherwise("ALLOWED")
    return facts.withColumn("status", status)


def levene(df: DataFrame, value: str, group: str) -> DataFrame:
    """The test of equal spreads on distances from group medians: an analysis of variance of them."""
    rows = df.filter(F.col(value).isNotNull()).select(group_label(group).alias("group"), F.col(value).cast("double").alias("v"))
    off = with_facts(rows, group_quantiles(rows, "v", {"middle": 0.5}, ["group"]), ["group"]).select("group", F.abs(F.col("v") - F.col("middle")).alias("off"))
    return anova(off, "off", "group")


def choose_test(df: DataFrame, value: str, group: str, alpha: float = ALPHA) -> DataFrame:
    """problem, method, groups, whether all pass the normality screen, and p of equal spreads (three groups or more)."""
    least = 3 if df.filter(F.col(value).isNotNull()).select(group_label(group)).distinct().limit(3).count() < 3 else 2
    s = shapes(df, value, group).filter(F.col("n") >= least)
    k, constant, normal = s.agg(F.count("*"), F.count_if("constant"), F.coalesce(F.bool_and(F.coalesce(F.col("normality_p") >= alpha, F.lit(False))), F.lit(False))).first()
    problem = "two_group_independent" if least == 3 else "multi_group_independent"
    out = {"problem": problem, "groups": int(k), "all_normal": bool(normal), "levene_p": None}
    if k < (2 if least == 3 else 3):
        method = "INSUFFICIENT_DATA" if least == 3 else "TWO_GROUP_OR_INSUFFICIENT"
    elif constant == k:
        method = "NOT_APPLICABLE"
    elif least == 3:
        method = "Welch t-test" if normal else "Mann-Whitney U"
    else:
        p = levene(df, value, group).first()["p_value"]
        out["levene_p"] = p
        method = "Kruskal-Wallis" if not normal else "One-way ANOVA" if p is not None and p >= alpha else "Welch ANOVA"
    return df.sparkSession.createDataFrame([(problem, method, out["groups"], out["all_normal"], out["levene_p"])], "problem string, method string, groups long, all_normal boolean, levene_p double")


def choose_paired(df: DataFrame, x: str, y: str, alpha: float = ALPHA) -> DataFrame:
    """The test of paired columns: by the normality of their differences."""
    d = df.select(F.lit("d").alias("g"), (F.col(x) - F.col(y)).alias("d"))
    r = shapes(d, "d", "g").first()
    method = "INSUFFICIENT_DATA" if r is None else "NOT_APPLICABLE" if r["constant"] and not r["mean"] else "Paired t-test" if not r["constant"] and r["n"] >= 5 and r["normality_p"] >= alpha else "Wilcoxon signed-rank"
    return one_row(df, {"problem": "two_group_paired", "method": method, "n": int(r["n"]) if r else 0})


def choose_categorical(df: DataFrame, a: str, b: str) -> DataFrame:
    """Fisher's test for a two by two table with a sparse expected count, else chi-square; with the least expected count."""
    cells = df.groupBy(group_label(a).alias("a"), group_label(b).alias("b")).agg(F.count("*").alias("n"))
    rows, columns = cells.groupBy("a").agg(F.sum("n").alias("r")), cells.groupBy("b").agg(F.sum("n").alias("c"))
    k, low, total = rows.agg(F.count("*"), F.min("r"), F.sum("r")).first()
    m, least = columns.agg(F.count("*"), F.min("c")).first()
    if min(k, m) < 2:
        return one_row(df, {"method": "NOT_APPLICABLE", "expected_least": math.nan})
    expected = low * least / total
    return one_row(df, {"method": "Fisher exact test" if k == m == 2 and expected < 5 else "Chi-square test of independence", "expected_least": float(expected)})


def choose_correlation(df: DataFrame, x: str, y: str) -> DataFrame:
    """Spearman where it is 0.15 off Pearson's r or a column is skewed by more than 1.5, else Pearson; with both."""
    both = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    r, n, a, b = both.agg(F.corr(x, y), F.count("*"), F.skewness(x), F.skewness(y)).first()
    if n < 3 or r is None:
        return one_row(df, {"method": "NOT_APPLICABLE", "n": int(n)})
    rho = spearman(both, x, y).first()["rho"]
    skewed = [abs(s) * math.sqrt(n * (n - 1)) / (n - 2) > 1.5 for s in (a, b)]
    return one_row(df, {"method": "Spearman correlation" if abs(rho - r) > 0.15 or n >= 8 and any(skewed) else "Pearson correlation", "r": r, "rho": rho, "n": int(n)})


def group_comparison(df: DataFrame, value: str, group: str, alpha: float = ALPHA) -> DataFrame:
    """method, statistic, p_value and whether it is significant, by the test that fits: rates for a 0/1 column, else the chosen test."""
    low, high, kinds = df.agg(F.min(value).cast("double"), F.max(value).cast("double"), F.approx_count_distinct(value)).first()
    two = df.filter(F.col(value).isNotNull()).select(group_label(group)).distinct().limit(3).count() == 2
    if two and kinds <= 2 and {low, high} == {0.0, 1.0}:
        method, found = "Two rates", two_rates(df.withColumn(value, F.col(value).cast("double")), value, group)
    else:
        method = choose_test(df, value, group, alpha).first()["method"]
        run = {"Welch t-test": t_test, "Mann-Whitney U": mann_whitney, "One-way ANOVA": anova, "Welch ANOVA": lambda *a: anova(*a, welch=True), "Kruskal-Wallis": kruskal}
        if method not in run:
            return one_row(df, {"method": method, "statistic": math.nan, "p_value": math.nan, "significant": False})
        found = run[method](df, value, group)
    r = found.first()
    return one_row(df, {"method": method, "statistic": float(r["statistic"]), "p_value": float(r["p_value"]), "significant": bool(r["p_value"] < alpha)})


def paired_comparison(df: DataFrame, x: str, y: str) -> DataFrame:
    """method, statistic and p_value of the paired test that fits."""
    method = choose_paired(df, x, y).first()["method"]
    if method not in ("Paired t-test", "Wilcoxon signed-rank"):
        return one_row(df, {"method": method})
    r = (paired_t if method == "Paired t-test" else wilcoxon)(df, x, y).first()
    return one_row(df, {"method": method, "statistic": float(r["statistic"]), "p_value": float(r["p_value"])})


def association(df: DataFrame, a: str, b: str) -> DataFrame:
    """method, statistic and p_value of the association of two columns: numbers by correlation, others by a table."""
    numbers = all(isinstance(df.schema[c].dataType, T.NumericType) for c in (a, b))
    method = (choose_correlation if numbers else choose_categorical)(df, a, b).first()["method"]
    if method == "NOT_APPLICABLE":
        return one_row(df, {"method": method})
    if numbers:
        r = (correlation if method.startswith("Pearson") else spearman)(df, a, b).first()
        return one_row(df, {"method": method, "statistic": float(r["r" if method.startswith("Pearson") else "rho"]), "p_value": float(r["p_value"])})
    if method.startswith("Chi"):
        r = chi_square(df, a, b).first()
        return one_row(df, {"method": method, "statistic": float(r["statistic"]), "p_value": float(r["p_value"])})
    first = lambda c: df.agg(F.min(group_label(c))).first()[0]
    flags = df.select(*((group_label(c) != first(c)).cast("int").alias(c) for c in (a, b)))
    r = fisher_exact(flags, a, b).first()
    return one_row(df, {"method": method, "statistic": float(r["odds_ratio"]) if r["odds_ratio"] is not None else math.nan, "p_value": float(r["p_value"])})


def shift_report(baseline: DataFrame, current: DataFrame, value: str) -> DataFrame:
    """Distance, KS, mean shift in percent, variance ratio and severity of the change of a column between two populations."""
    facts = lambda d: d.agg(F.count(value), F.avg(value).cast("double"), F.var_samp(value).cast("double")).first()
    (n0, m0, v0), (n1, m1, v1) = facts(baseline), facts(current)
    if min(n0, n1) < 3:
        return one_row(baseline, {"severity": "insufficient_data"})
    ks, distance = ks_test(baseline, current, value).first(), wasserstein(baseline, current, value).first()["distance"]
    percent = 100 * abs(m1 - m0) / abs(m0) if abs(m0) > 1e-9 else 0.0
    shifted = ks["p_value"] < 0.05 or percent > 20
    severity = "High" if ks["p_value"] < 0.001 and percent > 25 else "Moderate" if shifted else "None"
    return one_row(baseline, {"n_baseline": int(n0), "n_current": int(n1), "distance": distance, "ks": ks["statistic"], "p_value": ks["p_value"], "mean_shift_percent": percent, "variance_ratio": v1 / v0 if v0 > 1e-9 else 1.0, "shifted": bool(shifted), "severity": severity})


def stratified_check(df: DataFrame, group: str, stratum: str, event: str, least: int = 20) -> DataFrame:
    """Whether the difference of two groups' event rates survives within strata.

    Numbers with more than ten values are cut into fifths, after a check that the groups' ranges overlap. Only strata with
    `least` known rows in both groups count. Confounded: all differences under half of the overall one, or any of the other sign.
    """
    known = df.filter(F.col(event).isNotNull() & F.col(stratum).isNotNull() & F.col(group).isNotNull()).select(group_label(group).alias("g"), F.col(stratum).alias("s"), F.col(event).cast("double").alias("e"))
    overall = known.groupBy("g").agg(F.avg("e").alias("rate"), F.min("s").alias("low"), F.max("s").alias("high")).orderBy("g").limit(3).collect()
    if len(overall) != 2:
        return one_row(df, {"status": "not_two_groups"})
    difference = overall[1]["rate"] - overall[0]["rate"]
    if isinstance(df.schema[stratum].dataType, T.NumericType):
        if max(r["low"] for r in overall) > min(r["high"] for r in overall):
            return one_row(df, {"status": "no_common_support", "difference": difference})
        if known.select("s").distinct().limit(11).count() > 10:
            edges = sorted({q for q in column_quantiles(known, ["s"], [0.2, 0.4, 0.6, 0.8])["s"]})
            known = known.withColumn("s", sum(((F.col("s") > e).cast("int") for e in edges), F.lit(0)))
    first = overall[0]["g"]
    of = lambda is_first, f: f(F.when((F.col("g") == first) == is_first, F.col("e")))
    strata = known.groupBy("s").agg(of(True, F.count).alias("n0"), of(False, F.count).alias("n1"), (of(False, F.avg) - of(True, F.avg)).alias("d"))
    n, small, turned = strata.filter((F.col("n0") >= least) & (F.col("n1") >= least)).agg(F.count("*"), F.bool_and(F.abs("d") < 0.5 * abs(difference)), F.bool_or(F.col("d") * difference < 0)).first()
    if not n:
        return one_row(df, {"status": "no_adequate_stratum", "difference": difference})
    return one_row(df, {"status": "ok", "difference": difference, "strata": int(n), "confounded": bool(difference and (small or turned))})


def churn_verdict(df: DataFrame, group: str, event: str, confounders: Sequence[str], exposure: str | None = None, least: int = 20) -> DataFrame:
    """verdict, rates of the two groups, and the confounders that explain or hide their difference.

    INSUFFICIENT_EVIDENCE without two groups of `least` known outcomes; CONFOUNDED where a stratified check says so;
    NOT_IDENTIFIABLE where one cannot be made; EXPOSURE_DRIVEN where rates by exposure differ the other way; else SUPPORTED.
    """
    e = F.col(event).cast("double")
    columns = [F.count(e).alias("n"), F.avg(e).alias("rate"), *([ratio(F.sum(F.coalesce(e, F.lit(0.0))), F.sum(exposure)).alias("per")] if exposure else [])]
    groups = df.filter(F.col(group).isNotNull()).groupBy(group_label(group).alias("g")).agg(*columns).orderBy("g").limit(3).collect()
    if len(groups) != 2 or min(r["n"] for r in groups) < least:
        return one_row(df, {"verdict": "INSUFFICIENT_EVIDENCE"})
    a, b = groups
    checks = {c: stratified_check(df, group, c, event, least).first().asDict() for c in confounders}
    confounded = [c for c, r in checks.items() if r.get("confounded")]
    unclear = [c for c, r in checks.items() if r["status"] != "ok"]
    turned = exposure is not None and (b["per"] - a["per"]) * (b["rate"] - a["rate"]) < 0
    verdict = "CONFOUNDED" if confounded else "NOT_IDENTIFIABLE" if unclear else "EXPOSURE_DRIVEN" if turned else "SUPPORTED"
    return one_row(df, {"verdict": verdict, "rate_a": a["rate"], "rate_b": b["rate"], "difference": b["rate"] - a["rate"], "explained_by": ",".join(confounded or unclear)})


def patterns(df: DataFrame, group: str, value: str, concentration: float = 0.4, divergence: float = 1.5, alpha: float = ALPHA) -> DataFrame:
    """pattern, evidence and whether it is found: one group holds the total, the largest mean diverges, segments differ, a group is far off."""
    sums = df.groupBy(group_label(group).alias("g")).agg(F.sum(value).alias("s"), F.avg(value).alias("m"))
    share, apart, mean, sd, most, least = sums.agg(ratio(F.max("s"), F.sum("s")), ratio(F.max("m"), F.nullif(F.min("m"), F.lit(0.0))), F.avg("s"), F.stddev_samp("s"), F.max("s"), F.min("s")).first()
    far = max(most - mean, mean - least) / sd if sd else 0.0
    p = anova(df, value, group).first().asDict().get("p_value")
    rows = [
        ("concentration", share, share is not None and share >= concentration), ("divergence", apart, apart is not None and apart >= divergence),
        ("segment_difference", p, p is not None and p < alpha), ("anomaly", far, far >= 2.0),
    ]
    return df.sparkSession.createDataFrame([(n, None if v is None else float(v), bool(f)) for n, v, f in rows], "pattern string, evidence double, found boolean")


def dunn(df: DataFrame, value: str, group: str) -> DataFrame:
    """a, b, statistic and corrected p-values of Dunn's test for every pair of groups, on ranks over all groups."""
    from .inference import adjusted, rank_sums

    groups, ties, n = rank_sums(df, value, group)
    spread = n * (n + 1) / 12 - ties / (12 * (n - 1)) if n > 1 else 0.0
    g = groups.select("group", "n", (F.col("ranks") / F.col("n")).alias("mean"))
    pairs = g.alias("a").join(g.alias("b"), F.col("a.group") < F.col("b.group"))
    z = (F.col("a.mean") - F.col("b.mean")) / F.sqrt(F.lit(spread) * (1 / F.col("a.n") + 1 / F.col("b.n")))
    p_value = by_batch(lambda z: 2 * tails.normal_sf(abs(z)))
    return adjusted(pairs.select(F.col("a.group").alias("a"), F.col("b.group").alias("b"), z.alias("statistic")).withColumn("p_value", p_value("statistic")))


def pooled_pairs(df: DataFrame, value: str, group: str, tukey: bool = False) -> DataFrame:
    """a, b, difference, statistic and corrected p-values of every pair of groups by the pooled t-test, or by Tukey's range test."""
    from .inference import adjusted, moments

    g = moments(df, value, group).filter("n > 1")
    k, n, within = g.agg(F.count("*"), F.sum("n"), F.sum((F.col("n") - 1) * F.col("var"))).first()
    pairs = g.alias("a").join(g.alias("b"), F.col("a.group") < F.col("b.group"))
    n1, n2, gap = F.col("a.n"), F.col("b.n"), F.col("a.mean") - F.col("b.mean")
    if tukey:
        dof, k = float(n - k), int(k)
        se = F.sqrt(F.lit(within / dof) / 2 * (1 / n1 + 1 / n2))
        p_value = by_batch(lambda q: tails.range_sf(abs(q), k, dof))
        return pairs.select(F.col("a.group").alias("a"), F.col("b.group").alias("b"), gap.alias("difference"), (gap / se).alias("statistic")).withColumn("p_value", p_value("statistic"))
    pooled = ((n1 - 1) * F.col("a.var") + (n2 - 1) * F.col("b.var")) / (n1 + n2 - 2)
    tested = pairs.select(F.col("a.group").alias("a"), F.col("b.group").alias("b"), gap.alias("difference"), (gap / F.sqrt(pooled * (1 / n1 + 1 / n2))).alias("statistic"), (n1 + n2 - 2).alias("dof"))
    p_value = by_batch(tails.t_sf)
    return adjusted(tested.withColumn("p_value", p_value("statistic", "dof")).drop("dof"))


def powers(df: DataFrame, group: str, alpha: float = ALPHA) -> DataFrame:
    """test and power to see a medium effect with the rows at hand: means (d 0.5), rates (h 0.35), correlation (r 0.3), ANOVA (f 0.35), chi-square (w 0.32)."""
    sizes = df.groupBy(group_label(group).alias("g")).agg(F.count("*").alias("n"))
    k, n = sizes.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    largest = [r["n"] for r in sizes.orderBy(F.desc("n")).limit(2).collect()]
    two = largest if len(largest) == 2 else [0, 0]
    z = tails.normal_quantile(alpha)
    tail = lambda shift: min(1.0, tails.normal_sf(z - shift) + tails.normal_sf(z + shift))
    harmonic = math.sqrt(two[0] * two[1] / sum(two)) if min(two) > 1 else 0.0
    rows = [
        ("two_means", tail(0.5 * harmonic) if harmonic else 0.0), ("two_proportions", tail(0.35 * harmonic) if harmonic else 0.0),
        ("correlation", tail(math.atanh(0.3) * math.sqrt(n - 3)) if n > 3 else 0.0),
        ("anova", tails.noncentral_f_power(k - 1, n - k, n * 0.35**2, alpha) if 1 < k < n else 0.0),
        ("chi_square", tails.noncentral_chi2_power(k - 1, n * 0.32**2, alpha) if k > 1 else 0.0),
    ]
    return df.sparkSession.createDataFrame([(a, float(b)) for a, b in rows], "test string, power double")


def selection_bias(df: DataFrame, columns: Sequence[str], metric: str, least: int = 5, gap: float = 0.2) -> DataFrame:
    """column, the two means, their standardised gap and whether it is 0.2 or more, of two-valued selection columns."""
    long = df.select(F.col(metric).cast("double").alias("m"), F.inline(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("v")) for c in columns))))
    sd = F.greatest(F.lit(1e-12), F.lit(df.agg(F.stddev_pop(metric)).first()[0]).cast("double"))
    per = long.filter("v IS NOT NULL AND m IS NOT NULL").groupBy("column", "v").agg(F.count("*").alias("n"), F.avg("m").alias("mean"))
    both = per.groupBy("column").agg(F.count("*").alias("values"), F.min("n").alias("n"), F.min_by("mean", "v").alias("mean_a"), F.max_by("mean", "v").alias("mean_b")).filter(f"`values` = 2 AND n >= {least}")
    return both.select("column", "mean_a", "mean_b", (F.abs(F.col("mean_a") - F.col("mean_b")) / sd).alias("gap")).withColumn("biased", F.col("gap") >= gap)


# Which findings touch which tasks, and the review that each calls for.
IMPACT = {
    "missing": (("summary", "comparison", "prediction", "trend"), "compare results under missing-value bounds"),
    "constant": (("comparison", "prediction"), "leave the column out"),
    "near_constant": (("comparison", "prediction"), "check that rare values decide nothing"),
    "outliers_in_few_groups": (("summary", "comparison", "trend"), "repeat with ranks or trimmed values"),
    "selection": (("comparison", "prediction"), "name the population and account for how rows got in"),
    "invalid_times": (("trend",), "mend or leave out invalid times"),
}


def context_findings(df: DataFrame, metric: str, group: str | None = None, selection: Sequence[str] = (), time: str | None = None, share: float = 0.5, least: int = 5) -> DataFrame:
    """column, check and share of findings that need the context of a task: outliers of a metric of which half or more lie in one of several groups, columns that select rows, invalid times."""
    from .quality import outliers
    from .screens import temporal_validity

    parts = []
    if group:
        by_group = outliers(df, metric).groupBy(group_label(group).alias("g")).agg(F.count_if("is_outlier").alias("n"))
        facts = by_group.agg(ratio(F.max("n"), F.sum("n")).alias("share"), F.sum("n").alias("n"), F.count("*").alias("groups"))
        parts.append(facts.filter((F.col("groups") > 1) & (F.col("n") >= least) & (F.col("share") >= share)).select(F.lit(metric).alias("column"), F.lit("outliers_in_few_groups").alias("check"), "share"))
    if selection:
        parts.append(selection_bias(df, selection, metric).filter("biased").select("column", F.lit("selection").alias("check"), F.col("gap").alias("share")))
    if time:
        invalid = temporal_validity(df, time).crossJoin(df.agg(F.count("*").alias("rows"))).withColumn("share", ratio(F.col("missing") + F.col("too_early"), F.col("rows")))
        parts.append(invalid.filter(F.col("share") > 0).select(F.lit(time).alias("column"), F.lit("invalid_times").alias("check"), "share"))
    if not parts:
        raise ValueError("a group, selection columns or a time column")
    return reduce(DataFrame.unionByName, parts)


def task_impact(findings: DataFrame, task: str) -> DataFrame:
    """column, check, review and whether it blocks, of the column findings that matter to a task (of findings as column_findings gives)."""
    rules = [(check, review) for check, (tasks, review) in IMPACT.items() if task in tasks]
    rules_of = findings.sparkSession.createDataFrame(rules, "check string, review string")
    return findings.join(F.broadcast(rules_of), "check").select("column", "check", "review", (F.col("check") == "constant").alias("blocks"))


def verify_aggregate(df: DataFrame, operation: str, target: str, groups: Sequence[str] = (), tolerance: float = 1e-4) -> DataFrame:
    """groups, value, the value by another route (from counts of distinct values), and whether they agree within a relative tolerance."""
    from .aggregates import aggregate, labelled

    n, v = F.col("n"), F.col("v")
    routes = {
        "sum": F.sum(n * v), "mean": F.sum(n * v) / F.sum(F.when(v.isNotNull(), n)), "count": F.coalesce(F.sum(F.when(v.isNotNull(), n)), F.lit(0)), "min": F.min(v), "max": F.max(v),
        "count_distinct": F.count(v), "row_count": F.sum(n), "missing_count": F.coalesce(F.sum(F.when(v.isNull(), n)), F.lit(0)),
    }
    counts = labelled(df, groups).groupBy(*groups, F.col(target).cast("double").alias("v")).agg(F.count("*").alias("n"))
    again = counts.groupBy(*groups).agg(routes[operation].cast("double").alias("again"))
    found = aggregate(df, operation, target, groups).select(*groups, F.col("value").cast("double").alias("value"))
    both = found.join(again, list(groups)) if groups else found.crossJoin(again)
    near = F.abs(F.col("value") - F.col("again")) <= tolerance * F.greatest(F.lit(1.0), F.abs("value"))
    return both.withColumn("agrees", F.coalesce(near, F.col("value").isNull() & F.col("again").isNull()))
