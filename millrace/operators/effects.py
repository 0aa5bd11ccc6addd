"""Effects of a binary treatment, and survival."""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence
from functools import reduce
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.util import inheritable_thread_target

from ..functions import tails
from ..functions.scalars import bucketed, clip, group_label, ratio
from . import lineage
from .inference import cross_products, one_row
from .ranks import bounds_of, running

#: Propensities are held between these; least complete rows.
POSITIVITY, LEAST = (0.01, 0.99), 40


def prepared(df: DataFrame, treatment: str, outcome: str, adjust: Sequence[str], cluster: str | None = None) -> DataFrame:
    """t, y, the covariates and their vector, of the complete rows; `c`, a hash of the row's cluster, where there are clusters."""
    clusters = [F.xxhash64(cluster).alias("c")] if cluster else []
    rows = df.select(F.col(treatment).cast("double").alias("t"), F.col(outcome).cast("double").alias("y"), *(F.col(c).cast("double").alias(c) for c in adjust), *clusters).na.drop()
    n, arms = rows.agg(F.count("*"), F.count_distinct("t")).first()
    if n < LEAST or arms != 2:
        raise ValueError("an effect needs both arms and forty complete rows")
    return VectorAssembler(inputCols=list(adjust), outputCol="features").transform(rows)


def with_propensity(rows: DataFrame) -> DataFrame:
    """p, the propensity held within POSITIVITY, and e, as the model gives it."""
    n = rows.count()
    model = LogisticRegression(featuresCol="features", labelCol="t", regParam=1 / n, standardization=False, probabilityCol="p of t", rawPredictionCol="raw of t", predictionCol="guess of t").fit(rows)
    return model.transform(rows).withColumn("e", vector_to_array("p of t")[1]).withColumn("p", clip(F.col("e"), *POSITIVITY)).drop("p of t", "raw of t", "guess of t")


def means(rows: DataFrame, *weighted: tuple[F.Column, Sequence[F.Column]]) -> list[np.ndarray]:
    """For each (weight, columns) the averages of weight * column, all from one pass."""
    found = rows.agg(F.array(*(F.avg(w * c) for w, columns in weighted for c in columns)).alias("m")).first()["m"]
    out, at = [], 0
    for _, columns in weighted:
        out.append(np.array(found[at : at + len(columns)], float))
        at += len(columns)
    return out


def products_of(z: Sequence[F.Column]) -> list[F.Column]:
    return [a * b for a in z for b in z]


def solved(matrix: np.ndarray, vector: np.ndarray) -> np.ndarray:
    """The inverse of a matrix of products, by columns of unit length, times a vector; columns that repeat others share."""
    matrix = matrix.reshape(len(vector), -1)
    scale = np.sqrt(np.maximum(np.diag(matrix), 1e-300))
    return np.linalg.pinv(matrix / np.outer(scale, scale)) @ (vector / scale) / scale


def dot(b: np.ndarray, z: Sequence[F.Column]) -> F.Column:
    return sum((float(v) * c for v, c in zip(b, z)), F.lit(0.0))


def with_interval(rows: DataFrame, effect: F.Column, influence: F.Column, alpha: float, clustered: bool) -> DataFrame:
    """effect, se, low, high and n from what each row adds to the estimate's error; rows of one cluster are added up first."""
    rows = rows.withColumn("influence", influence)
    n = rows.agg(F.first(effect).alias("effect"), F.count("*").alias("n"), F.avg("influence").alias("centre"))
    if clustered:
        sums = rows.groupBy("c").agg(F.sum("influence").alias("s"), F.count("*").alias("k"))
        square = sums.crossJoin(F.broadcast(n)).agg(F.sum((F.col("s") - F.col("k") * F.col("centre")) ** 2).alias("square"))
    else:
        square = rows.agg((F.var_pop("influence") * F.count("*")).alias("square"))
    se, z = F.sqrt("square") / F.col("n"), tails.normal_quantile(alpha)
    return n.crossJoin(square).withColumn("se", se).select("effect", "se", (F.col("effect") - z * F.col("se")).alias("low"), (F.col("effect") + z * F.col("se")).alias("high"), "n")


def with_outcomes(train: DataFrame, rows: DataFrame) -> DataFrame:
    """m0 and m1: outcomes that linear models of either arm predict."""
    for arm in (0, 1):
        model = LinearRegression(featuresCol="features", labelCol="y", predictionCol=f"m{arm}", solver="normal").fit(train.filter(F.col("t") == arm))
        rows = model.transform(rows)
    return rows


def ipw(df: DataFrame, treatment: str, outcome: str, adjust: Sequence[str], estimand: str = "ATE", cluster: str | None = None, alpha: float = 0.05) -> DataFrame:
    """The effect by inverse propensity weights, normalised in each arm, with its error and interval.

    The error is the sandwich of the stacked estimating equations of the propensity model and of both means: what a row adds to
    the weighted means, and what it adds to them by way of the model's coefficients. Two passes of sums; clusters are added up first.
    """
    rows = with_propensity(prepared(df, treatment, outcome, adjust, cluster))
    t, p, y, e = F.col("t"), F.col("p"), F.col("y"), F.col("e")
    z = [F.lit(1.0), *(F.col(c) for c in adjust)]
    w1, w0 = (t / p, (1 - t) / (1 - p)) if estimand == "ATE" else (t, (1 - t) * p / (1 - p))
    moves = (p == e).cast("double")  # a propensity at its bound does not move with the coefficients
    d1, d0 = (-t * (1 - p) / p * moves if estimand == "ATE" else F.lit(0.0)), (1 - t) * p / (1 - p) * moves
    (a1, a0), (b1, b0), d1y, d1z, d0y, d0z, h = means(rows, (F.lit(1.0), [w1, w0]), (y, [w1, w0]), (d1 * y, z), (d1, z), (d0 * y, z), (d0, z), (e * (1 - e), products_of(z)))
    m1, m0 = b1 / a1, b0 / a0
    slope = solved(h, (d1y - m1 * d1z) / a1 - (d0y - m0 * d0z) / a0)
    influence = w1 * (y - m1) / a1 - w0 * (y - m0) / a0 + (t - e) * dot(slope, z)
    return with_interval(rows, F.lit(m1 - m0), influence, alpha, cluster is not None)


def g_computation(df: DataFrame, treatment: str, outcome: str, adjust: Sequence[str], cluster: str | None = None, alpha: float = 0.05) -> DataFrame:
    """The mean difference of the outcomes that models of either arm predict for everyone, with its error and interval.

    The error stacks the least-squares equations of both arms with the mean: a row adds its own difference, and its residual by way of its arm's coefficients.
    """
    rows = with_outcomes(rows := prepared(df, treatment, outcome, adjust, cluster), rows)
    t, y = F.col("t"), F.col("y")
    z = [F.lit(1.0), *(F.col(c) for c in adjust)]
    everyone, g1, g0, (effect,) = means(rows, (F.lit(1.0), z), (t, products_of(z)), (1 - t, products_of(z)), (F.lit(1.0), [F.col("m1") - F.col("m0")]))
    by_arm = t * (y - F.col("m1")) * dot(solved(g1, everyone), z) - (1 - t) * (y - F.col("m0")) * dot(solved(g0, everyone), z)
    return with_interval(rows, F.lit(float(effect)), F.col("m1") - F.col("m0") - float(effect) + by_arm, alpha, cluster is not None)


def doubly_robust(df: DataFrame, treatment: str, outcome: str, adjust: Sequence[str], folds: int = 3, seed: int = 7, alpha: float = 0.05, cluster: str | None = None) -> DataFrame:
    """The effect by augmented weights with models fitted on the other folds, its error and interval; a cluster stays in one fold."""
    fold = F.xxhash64("c", F.lit(seed)) if cluster else F.xxhash64("t", "y", *adjust, F.lit(seed))
    rows = prepared(df, treatment, outcome, adjust, cluster).withColumn("fold", F.pmod(fold, F.lit(folds)))
    scored = None
    for k in range(folds):
        train, held = rows.filter(F.col("fold") != k), rows.filter(F.col("fold") == k)
        model = LogisticRegression(featuresCol="features", labelCol="t", regParam=1e-4, standardization=False, probabilityCol="p of t", rawPredictionCol="raw of t", predictionCol="guess of t").fit(train)
        part = with_outcomes(train, model.transform(held).withColumn("p", clip(vector_to_array("p of t")[1], *POSITIVITY)).drop("p of t", "raw of t", "guess of t"))
        scored = part if scored is None else scored.union(part)
    t, y, p = F.col("t"), F.col("y"), F.col("p")
    influence = F.col("m1") - F.col("m0") + t * (y - F.col("m1")) / p - (1 - t) * (y - F.col("m0")) / (1 - p)
    scored = scored.withColumn("influence of row", influence)
    if cluster:
        effect = scored.agg(F.avg("influence of row")).first()[0]
        return with_interval(scored, F.lit(effect), F.col("influence of row"), alpha, True)
    facts = scored.agg(F.avg("influence of row").alias("effect"), (F.stddev_samp("influence of row") / F.sqrt(F.count("*"))).alias("se"), F.count("*").alias("n"))
    z = tails.normal_quantile(alpha)
    return facts.withColumn("low", F.col("effect") - z * F.col("se")).withColumn("high", F.col("effect") + z * F.col("se"))


def positivity(df: DataFrame, treatment: str, adjust: Sequence[str]) -> DataFrame:
    """Extremes of the propensities, the width of the range that both arms share, how many lie below 0.05 or above 0.95, and a status.

    ADEQUATE if the shared range is wider than 0.05 and less than a fifth of the scores are extreme, else CAUTION.
    """
    rows = with_propensity(prepared(df.withColumn("y of none", F.lit(0.0)), treatment, "y of none", adjust))
    e, t = clip(F.col("e"), 1e-6, 1 - 1e-6), F.col("t") == 1
    arm = lambda f, one: f(F.when(t if one else ~t, e))
    shared = F.greatest(F.lit(0.0), F.least(arm(F.max, True), arm(F.max, False)) - F.greatest(arm(F.min, True), arm(F.min, False)))
    facts = rows.agg(F.min(e).alias("propensity_min"), F.max(e).alias("propensity_max"), shared.alias("shared_width"), F.count_if((e < 0.05) | (e > 0.95)).alias("extreme"), F.count("*").alias("n"))
    fine = (F.col("shared_width") > 0.05) & (F.col("extreme") / F.col("n") < 0.2)
    return facts.withColumn("extreme_share", F.col("extreme") / F.col("n")).withColumn("status", F.when(fine, "ADEQUATE").otherwise("CAUTION"))


def balance(df: DataFrame, treatment: str, adjust: Sequence[str]) -> DataFrame:
    """covariate and the standardised difference of its means between the arms."""
    t = F.col(treatment) == 1
    parts = []
    for c in adjust:
        one, zero = F.when(t, F.col(c)), F.when(~t, F.col(c))
        parts.append(F.struct(F.lit(c).alias("covariate"), ratio(F.avg(one) - F.avg(zero), F.sqrt((F.var_samp(one) + F.var_samp(zero)) / 2)).alias("difference")))
    return df.agg(F.array(*parts).alias("rows")).select(F.inline("rows"))


def e_value(risk_ratio: float) -> float:
    """The confounding that could explain a risk ratio away."""
    r = max(risk_ratio, 1 / risk_ratio)
    return r + math.sqrt(r * (r - 1))


def sensitivity(df: DataFrame, estimate: float, se: float, dof: float, strengths: Sequence[float] = (0.05, 0.1, 0.2), alpha: float = 0.05) -> DataFrame:
    """Partial R squared of an unseen confounder with treatment and outcome, the bias it could make, the estimate towards null, and the robustness value."""
    if se <= 0 or dof <= 0:
        raise ValueError("an error and degrees of freedom are positive")
    t, critical = abs(estimate / se), tails.t_quantile(alpha, dof)
    robustness = (t * t - critical * critical) / (t * t + dof) if t > critical else 0.0
    rows = []
    for a in strengths:
        for b in strengths:
            bias = se * math.sqrt(dof * a * b / (1 - a))
            rows.append((a, b, bias, estimate - math.copysign(bias, estimate), robustness))
    return df.sparkSession.createDataFrame(rows, "treatment_r2 double, outcome_r2 double, bias double, towards_null double, robustness_value double")


def confounding_grid(df: DataFrame, risk_ratio: float, strengths: Sequence[float] = (1.0, 1.5, 2.0, 3.0, 5.0)) -> DataFrame:
    """strength, the risk ratio left if a confounder had that strength with treatment and outcome, whether it crosses 1, and the E-value."""
    rows = [(float(s), risk_ratio / (s * s) if risk_ratio >= 1 else risk_ratio * s * s) for s in strengths]
    return df.sparkSession.createDataFrame([(s, a, bool(a <= 1 if risk_ratio > 1 else a >= 1), e_value(risk_ratio)) for s, a in rows], "strength double, adjusted double, crosses_null boolean, e_value double")


def longitudinal(df: DataFrame, unit: str, time: str, treatment: str, outcome: str, confounders: Sequence[str]) -> DataFrame:
    """estimate and se of a treatment over time by stabilised weights: per period the chance of the treatment given its past, with and without confounders.

    Weights multiply along each unit's periods up to a row's own; the weighted fit has errors clustered by unit.
    """
    rows = df.select(F.col(unit).alias("unit"), F.col(time).alias("time"), F.col(treatment).cast("double").alias("t"), F.col(outcome).cast("double").alias("y"), *(F.col(c).cast("double").alias(c) for c in confounders)).na.drop()
    rows = lineage.cut(rows.withColumn("before", F.coalesce(F.lag("t").over(Window.partitionBy("unit").orderBy("time")), F.lit(0.0))))
    kinds = lineage.cut(rows.groupBy("time", "t", "before", *confounders).agg(F.count("*").cast("double").alias("n of kind")))  # models learn from counts of equal rows
    facts = kinds.groupBy("time").agg(F.sum("n of kind"), F.sum(F.col("n of kind") * F.col("t"))).orderBy("time").limit(201).collect()  # one model a period
    if len(facts) > 200:
        raise ValueError("more than 200 periods: use a coarser time")
    inputs = {"num": ["before"], "den": ["before", *confounders]}

    def fitted(fact: tuple) -> tuple:
        """The period with the intercept and coefficients of both models."""
        p, n, treated_rows = fact
        found = []
        for columns in inputs.values():
            if 0 < treated_rows < n:
                part = kinds.filter(F.col("time") == p).groupBy("t", *columns).agg(F.sum("n of kind").alias("n of kind"))
                assembled = VectorAssembler(inputCols=columns, outputCol="features").transform(part)
                model = LogisticRegression(featuresCol="features", labelCol="t", weightCol="n of kind", regParam=1 / n, standardization=False).fit(assembled)
                found.append([float(model.intercept), *map(float, model.coefficients)])
            else:
                chance = clip_number(treated_rows / n)
                found.append([math.log(chance / (1 - chance)), *(0.0 for _ in columns)])
        return p, *found

    with ThreadPool(4) as jobs:
        models = jobs.map(inheritable_thread_target(df.sparkSession)(fitted), [tuple(f) for f in facts])
    models = df.sparkSession.createDataFrame(models, T.StructType([T.StructField("time", rows.schema["time"].dataType), *(T.StructField(f"{name} of model", T.ArrayType(T.DoubleType())) for name in inputs)]))
    scored = rows.join(F.broadcast(models), "time")  # at most 200 rows
    for name, columns in inputs.items():
        margin = reduce(lambda x, y: x + y, (F.col(f"{name} of model")[i + 1] * F.col(c) for i, c in enumerate(columns)), F.col(f"{name} of model")[0])
        scored = scored.withColumn(name, clip(1 / (1 + F.exp(-margin)), *POSITIVITY))
    scored = scored.drop(*(f"{name} of model" for name in inputs))
    chance = lambda c: F.when(F.col("t") == 1, F.col(c)).otherwise(1 - F.col(c))
    history = Window.partitionBy("unit").orderBy("time").rowsBetween(Window.unboundedPreceding, 0)
    weighted = lineage.cut(scored.select("unit", "t", "y", F.exp(F.sum(F.log(chance("num") / chance("den"))).over(history)).alias("w")))
    sw, st, sy, stt, sty = weighted.agg(F.sum("w"), F.sum(F.col("w") * F.col("t")), F.sum(F.col("w") * F.col("y")), F.sum(F.col("w") * F.col("t") * F.col("t")), F.sum(F.col("w") * F.col("t") * F.col("y"))).first()
    mt, my = st / sw, sy / sw
    spread = stt - sw * mt * mt
    b = (sty - sw * mt * my) / spread
    score = F.col("w") * (F.col("t") - mt) * (F.col("y") - my - b * (F.col("t") - mt))
    per = weighted.groupBy("unit").agg(F.sum(score).alias("s"))
    squares, units = per.agg(F.sum(F.col("s") * F.col("s")), F.count("*")).first()
    se = math.sqrt(squares * units / (units - 1)) / spread
    return one_row(df, {"estimate": b, "se": se, "p_value": 2 * tails.normal_sf(abs(b / se)) if se else 0.0, "units": int(units), "periods": len(facts)})


def clip_number(p: float) -> float:
    return min(max(p, POSITIVITY[0]), POSITIVITY[1])


def structure(df: DataFrame, columns: Sequence[str], alpha: float = 0.01) -> DataFrame:
    """a, b and kind (-> or --) of the edges that partial correlations leave, oriented by colliders and Meek's first three rules.

    Spark sums the products of all rows; the search runs on the matrix of the few columns.
    """
    n, _, s = cross_products(df, columns)
    d = np.sqrt(np.diag(s))
    r = s / np.outer(d, d)
    p = len(columns)

    def apart(i: int, j: int, given: tuple) -> bool:
        q = np.linalg.pinv(r[np.ix_((i, j, *given), (i, j, *given))])
        rho = float(np.clip(-q[0, 1] / math.sqrt(q[0, 0] * q[1, 1]), -0.999999, 0.999999))
        free = n - len(given) - 3
        return free <= 0 or 2 * tails.normal_sf(abs(math.atanh(rho)) * math.sqrt(free)) > alpha

    near = {i: set(range(p)) - {i} for i in range(p)}
    split: dict[tuple[int, int], tuple] = {}
    size = 0
    while any(len(near[i]) - 1 >= size for i in range(p)):
        frozen = {i: sorted(near[i]) for i in near}
        for i, j in itertools.combinations(range(p), 2):
            if j in near[i]:
                sets = itertools.chain(itertools.combinations([k for k in frozen[i] if k != j], size), itertools.combinations([k for k in frozen[j] if k != i], size))
                if (found := next((g for g in sets if apart(i, j, g)), None)) is not None:
                    near[i].discard(j)
                    near[j].discard(i)
                    split[i, j] = found
        size += 1
    arrows = {(i, k) for k in range(p) for i, j in itertools.permutations(near[k], 2) if j not in near[i] and k not in split.get((min(i, j), max(i, j)), ())}
    arrows = {(i, j) for i, j in arrows if (j, i) not in arrows}
    loose = {(i, j) for i in range(p) for j in near[i] if i < j and (i, j) not in arrows and (j, i) not in arrows}
    changed = True
    while changed:
        changed = False
        for i, j in [*loose, *((b, a) for a, b in loose)]:
            into = any((k, i) in arrows and j not in near[k] for k in range(p))
            through = any((i, k) in arrows and (k, j) in arrows for k in range(p))
            joint = any((k, j) in arrows and (m, j) in arrows and m not in near[k] and k in near[i] and m in near[i] for k, m in itertools.combinations(range(p), 2))
            if into or through or joint:
                loose.discard((min(i, j), max(i, j)))
                arrows.add((i, j))
                changed = True
                break
    rows = [(columns[i], columns[j], "->") for i, j in sorted(arrows)] + [(columns[i], columns[j], "--") for i, j in sorted(loose)]
    return df.sparkSession.createDataFrame(rows, "a string, b string, kind string")


def risk_table(df: DataFrame, duration: str, event: str, group: str | None = None, edges: list[float] | None = None) -> DataFrame:
    """group, time, events, censored and at_risk of every distinct time, by sums within ranges of times and before them."""
    rows = df.select((group_label(group) if group else F.lit("all")).alias("group"), F.col(duration).cast("double").alias("value"), F.col(event).cast("int").alias("event"))
    counts = rows.filter("value IS NOT NULL AND event IS NOT NULL").groupBy("group", "value").agg(F.sum("event").alias("events"), F.count("*").alias("rows"))
    edges = bounds_of(rows, F.col("value")) if edges is None else edges
    summed = running(counts, edges, {"rows": "gone"}, ["group"], {"rows": "all"})
    return summed.select("group", F.col("value").alias("time"), "events", (F.col("all") - F.col("gone")).alias("at_risk"), (F.col("rows") - F.col("events")).alias("censored"))


def kaplan_meier(df: DataFrame, duration: str, event: str, group: str | None = None) -> DataFrame:
    """group, time, at_risk, events, survival and Greenwood's error at every time of an event."""
    d, n = F.col("events").cast("double"), F.col("at_risk").cast("double")
    log = F.when(d < n, F.log1p(-d / n)).otherwise(F.lit(float("-inf")))
    spread = F.when(d < n, d / (n * (n - d))).otherwise(F.lit(0.0))
    edges = bounds_of(df, F.col(duration).cast("double"))
    rows = risk_table(df, duration, event, group, edges).filter("events > 0").select("group", F.col("time").alias("value"), "at_risk", "events", log.alias("log"), spread.alias("spread"))
    summed = running(rows, edges, {"log": "log before", "spread": "spread before"}, ["group"])
    rows = summed.withColumn("survival", F.exp(F.col("log before") + F.col("log"))).withColumn("se", F.col("survival") * F.sqrt(F.col("spread before") + F.col("spread")))
    return rows.select("group", F.col("value").alias("time"), "at_risk", "events", "survival", "se")


def median_survival(curve: DataFrame) -> DataFrame:
    """group and the first time at which half or less survive."""
    return curve.groupBy("group").agg(F.min(F.when(F.col("survival") <= 0.5, F.col("time"))).alias("median"))


def running_back(times: DataFrame, columns: Sequence[str], edges: list[float] | None = None) -> DataFrame:
    """Sums of columns over the rows with this `time` or a later one: within ranges of times, offset by the ranges after."""
    edges = bounds_of(times, F.col("time")) if edges is None else edges
    cut = times.withColumn("range of time", bucketed(F.col("time"), edges))
    after = Window.orderBy(F.desc("range of time")).rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    totals = cut.groupBy("range of time").agg(*(F.sum(c).alias(c) for c in columns)).select("range of time", *(F.coalesce(F.sum(c).over(after), F.lit(0)).alias(f"later {c}") for c in columns))
    back = Window.partitionBy("range of time").orderBy(F.desc("time")).rowsBetween(Window.unboundedPreceding, 0)
    return cut.join(F.broadcast(totals), "range of time").withColumns({c: F.sum(c).over(back) + F.col(f"later {c}") for c in columns}).drop("range of time", *(f"later {c}" for c in columns))


def log_rank(df: DataFrame, duration: str, event: str, group: str) -> DataFrame:
    """The log-rank test of two groups."""
    labels = sorted(r[0] for r in df.select(group_label(group).alias("g")).distinct().limit(3).collect())
    if len(labels) != 2:
        raise ValueError("the log-rank test takes two groups")
    rows = df.select((group_label(group) == labels[0]).cast("int").alias("one"), F.col(duration).cast("double").alias("time"), F.col(event).cast("int").alias("event")).filter("time IS NOT NULL AND event IS NOT NULL")
    by_time = rows.groupBy("time").agg(F.sum("event").alias("d"), F.count("*").alias("n"), F.sum("one").alias("n1"), F.sum(F.col("one") * F.col("event")).alias("d1"))
    d, n, m = F.col("d").cast("double"), F.col("n").cast("double"), F.col("n1").cast("double")
    gap, var = running_back(by_time, ["n", "n1"]).filter("d > 0").agg(F.sum(F.col("d1") - d * m / n), F.sum(F.when(n > 1, d * (m / n) * (1 - m / n) * (n - d) / (n - 1)).otherwise(0.0))).first()
    chi = gap * gap / var if var else 0.0
    return one_row(df, {"statistic": chi, "p_value": tails.chi2_sf(chi, 1), "observed_minus_expected": gap, "group": labels[0]})


def cox(df: DataFrame, duration: str, event: str, xs: Sequence[str], steps: int = 20) -> DataFrame:
    """term, estimate, se and hazard ratio of a proportional-hazards model (Breslow's ties), by Newton steps.

    Every step is one job: sums by distinct time, and their reverse running sums. The rows are written once and the ranges of times found once.
    """
    rows = df.select(F.col(duration).cast("double").alias("time"), F.col(event).cast("int").alias("event"), *(F.col(x).cast("double").alias(x) for x in xs)).na.drop()
    rows = lineage.cut(rows)
    edges = bounds_of(rows, F.col("time"))
    facts = rows.agg(*(F.avg(x) for x in xs), *(F.stddev_pop(x) for x in xs)).first()
    p = len(xs)
    means, scales = np.array(facts[:p]), np.array([s or 1.0 for s in facts[p:]])
    z = [(F.col(x) - float(m)) / float(s) for x, m, s in zip(xs, means, scales)]
    b = np.zeros(p)
    for _ in range(steps):
        r = F.exp(sum((float(v) * c for v, c in zip(b, z)), F.lit(0.0)))
        by_time = rows.groupBy("time").agg(
            F.sum("event").alias("d"), F.sum(r).alias("s"), *(F.sum(r * c).alias(f"s{i}") for i, c in enumerate(z)), *(F.sum(r * z[i] * z[j]).alias(f"s{i}_{j}") for i in range(p) for j in range(i, p)),
            *(F.sum(F.when(F.col("event") == 1, c).otherwise(0.0)).alias(f"x{i}") for i, c in enumerate(z)),
        )
        held = running_back(by_time, [c for c in by_time.columns if c.startswith("s")], edges).filter("d > 0")
        d = F.col("d")
        mean = lambda i: F.col(f"s{i}") / F.col("s")
        sums = held.agg(*(F.sum(F.col(f"x{i}") - d * mean(i)) for i in range(p)), *(F.sum(d * (F.col(f"s{i}_{j}") / F.col("s") - mean(i) * mean(j))) for i in range(p) for j in range(i, p))).first()
        gradient, information, k = np.array(sums[:p], float), np.zeros((p, p)), p
        for i in range(p):
            for j in range(i, p):
                information[i, j] = information[j, i] = sums[k]
                k += 1
        step = np.linalg.solve(information, gradient)
        b += step
        if np.abs(step).max() < 1e-8:
            break
    se = np.sqrt(np.diag(np.linalg.inv(information)))
    out = [(x, float(v / s), float(e / s), float(math.exp(v / s)), 2 * tails.normal_sf(abs(v / e))) for x, v, e, s in zip(xs, b, se, scales)]
    return df.sparkSession.createDataFrame(out, "term string, estimate double, se double, hazard_ratio double, p_value double")
