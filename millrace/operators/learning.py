"""Models and segments by Spark's own learning library."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import BinaryClassificationEvaluator, ClusteringEvaluator, MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import Imputer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.util import inheritable_thread_target

from ..functions.scalars import ratio
from .lineage import cut
from .ranks import beside
from .resampling import DRAWN, weights

#: Rows beyond which models learn from counts of equal rows, kinds of such rows they may have, and trees that grow side by side.
MANY, KINDS, SIDE_BY_SIDE = 1_000_000, 50_000, 4


def split(df: DataFrame, key: str, share: float = 0.2, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Training and test rows by a hash of a key, the same in every run."""
    return df.filter(~held_out(key, share, seed)), df.filter(held_out(key, share, seed))


def held_out(key: str, share: float = 0.2, seed: int = 42) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(10_000)) < int(share * 10_000)


def preparation(df: DataFrame, features: Sequence[str], medians_of: DataFrame | None = None) -> list:
    """Median for missing numbers (of the rows given, else of those it is fitted to), a 0/1 column for each value of a text, all scaled."""
    numbers = [f for f in features if isinstance(df.schema[f].dataType, T.NumericType)]
    texts = [f for f in features if f not in numbers]
    stages = [Imputer(strategy="median", inputCols=numbers, outputCols=[f"{c} filled" for c in numbers])] if numbers else []
    if medians_of is not None:
        stages = [s.fit(medians_of) for s in stages]
    for c in texts:
        stages += [StringIndexer(inputCol=c, outputCol=f"{c} index", handleInvalid="keep"), OneHotEncoder(inputCol=f"{c} index", outputCol=f"{c} hot")]
    inputs = [*(f"{c} filled" for c in numbers), *(f"{c} hot" for c in texts)]
    return [*stages, VectorAssembler(inputCols=inputs, outputCol="raw features"), StandardScaler(inputCol="raw features", outputCol="features")]


def repeats(rows: DataFrame, columns: Sequence[str]) -> bool:
    """Whether these are many rows of few kinds, so that a model may learn from counts of the kinds instead."""
    n, kinds = rows.agg(F.count("*"), F.approx_count_distinct(F.xxhash64(*columns))).first()
    return n > MANY and kinds <= KINDS


def counted(rows: DataFrame, columns: Sequence[str], trees: int, seed: int) -> DataFrame:
    """columns, `weight` (rows of the kind) and `w`, its weights in a bootstrap for each tree: a sum of n Poisson(1) weights is Poisson(n)."""
    kinds = rows.groupBy(*columns).agg(F.count("*").cast("double").alias("weight")).withColumn("h", F.xxhash64(*columns, F.lit(seed)))

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, h = batch.column("weight").to_numpy(), batch.column("h").to_numpy().view(np.uint64)
            drawn = [np.random.default_rng(int(x)).poisson(k, trees).astype(float) for x, k in zip(h, n)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(drawn, pa.list_(pa.float64()))], [*batch.schema.names, "w"])

    return cut(kinds.mapInArrow(draw, T.StructType([*kinds.schema.fields, T.StructField("w", T.ArrayType(T.DoubleType()))])).drop("h"))


def bagged(rows: DataFrame, features: Sequence[str], trees: int, seed: int) -> DataFrame:
    """features, and `w` and `y` for each tree: the weight of the kind in the tree's bootstrap and the mean label of its rows there.

    Every row has a Poisson(1) weight in each tree. Splits and leaves of a regression tree depend on these sums only: what labels vary
    within a kind is the same before and after any split. A task keeps the sums of all kinds, at most about KINDS by trees twice.
    """
    kinds = cut(rows.select(*features).distinct().withColumn("kind", F.monotonically_increasing_id()))
    ids = np.sort(kinds.select("kind").toArrow().column("kind").to_numpy())  # about KINDS numbers
    of = beside(rows.withColumn("h", F.xxhash64(F.monotonically_increasing_id(), F.lit(seed))), F.broadcast(kinds), features).select("kind", "h", "label")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(ids), 2 * trees))
        for batch in batches:
            at, h, y = np.searchsorted(ids, batch.column("kind").to_numpy()), batch.column("h").to_numpy(), batch.column("label").to_numpy()
            for i in range(0, len(h), DRAWN):
                order = np.argsort(at[i : i + DRAWN], kind="stable")
                which, first = np.unique(at[i : i + DRAWN][order], return_index=True)
                w = weights(h[i : i + DRAWN][order], trees).astype(float)
                total[which] += np.add.reduceat(np.hstack([w, w * y[i : i + DRAWN][order][:, None]]), first, axis=0)
        some = np.flatnonzero(total[:, :trees].any(axis=1))
        for i in range(0, len(some), DRAWN):
            part = some[i : i + DRAWN]
            yield pa.RecordBatch.from_arrays([pa.array(ids[part]), pa.array(list(total[part]), pa.list_(pa.float64()))], ["kind", "sums"])

    sums = of.mapInArrow(add, "kind long, sums array<double>").groupBy("kind").agg(*(F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(2 * trees)))
    found = sums.select("kind", F.array(*(f"s{i}" for i in range(trees))).alias("w"), F.array(*(ratio(F.col(f"s{trees + i}"), F.col(f"s{i}")) for i in range(trees))).alias("y"))
    return cut(kinds.join(F.broadcast(found), "kind", "left").drop("kind"))


def grown(tree, kinds: DataFrame, trees: int, seed: int) -> list:
    """The trees of a forest, each on the kinds with its own weights (and labels, where kinds have `y`): kinds has `features`."""

    def grow(i: int):
        label = F.col("y")[i] if "y" in kinds.columns else F.col("label")
        mine = kinds.select("features", label.alias("label"), F.col("w")[i].alias("weight")).na.drop()
        return tree.copy({tree.seed: seed + i}).fit(mine)

    with ThreadPool(SIDE_BY_SIDE) as pool:
        return pool.map(inheritable_thread_target(kinds.sparkSession)(grow), range(trees))


def voted(models: list, kinds: DataFrame, classes: int) -> DataFrame:
    """kinds with `p`, the forest's chance of each class, and its `prediction`, the first of the likeliest classes."""
    for i, m in enumerate(models):
        kinds = m.copy({m.probabilityCol: f"p{i}", m.rawPredictionCol: "", m.predictionCol: ""}).transform(kinds).withColumn(f"p{i}", vector_to_array(f"p{i}"))
    mean = F.array(*(reduce(lambda x, y: x + y, (F.coalesce(F.get(f"p{i}", F.lit(c)), F.lit(0.0)) for i in range(len(models)))) / len(models) for c in range(classes)))
    return kinds.withColumn("p", mean).drop(*(f"p{i}" for i in range(len(models)))).withColumn("prediction", (F.array_position("p", F.array_max("p")) - 1).cast("double"))


def from_kinds(rows: DataFrame, kinds: DataFrame, held: str, features: Sequence[str], trees: int, depth: int, seed: int) -> dict[str, DataFrame]:
    """Held-out kinds with `prediction` and `rawPrediction` of a logistic regression and a random forest that learn from the other kinds."""
    train, test = kinds.filter(~F.expr(held)), kinds.filter(held)
    prepared = Pipeline(stages=preparation(rows, features, rows.filter(~F.expr(held)))).fit(train)
    train, test = cut(prepared.transform(train)), cut(prepared.transform(test))
    classes = int(train.agg(F.max("label")).first()[0]) + 1
    tree = RandomForestClassifier(numTrees=1, bootstrap=False, featureSubsetStrategy="sqrt" if trees > 1 else "all", maxDepth=depth, weightCol="weight")
    votes = voted(grown(tree, train, trees, seed), test, classes)
    return {"logistic": LogisticRegression(weightCol="weight").fit(train).transform(test), "forest": votes.withColumn("rawPrediction", array_to_vector("p"))}


def classify(df: DataFrame, key: str, target: str, features: Sequence[str], trees: int = 50, depth: int = 6, seed: int = 42) -> DataFrame:
    """model, area under the curve and accuracy on held-out rows, of a logistic regression and a random forest.

    Many rows of few kinds are counted first, and both models learn from the counts and are judged by them.
    """
    rows = df.filter(F.col(target).isNotNull()).withColumn("label", F.col(target).cast("double")).withColumns({f: F.col(f).cast("double") for f in features if isinstance(df.schema[f].dataType, T.NumericType)})
    out = []
    if repeats(rows, [*features, "label"]):
        rows = rows.withColumn("held", held_out(key, seed=seed))
        kinds = counted(rows, [*features, "label", "held"], trees, seed)
        for name, scored in from_kinds(rows, kinds, "held", features, trees, depth, seed).items():
            accuracy, n = scored.agg(ratio(F.sum(F.when(F.col("prediction") == F.col("label"), F.col("weight")).otherwise(0.0)), F.sum("weight")), F.sum("weight").cast("long")).first()
            out.append((name, float(BinaryClassificationEvaluator(weightCol="weight").evaluate(scored)), accuracy, n))
        return df.sparkSession.createDataFrame(out, "model string, auc double, accuracy double, n_test long")
    train, test = split(rows, key, seed=seed)
    for name, model in (("logistic", LogisticRegression()), ("forest", RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed))):
        scored = Pipeline(stages=[*preparation(rows, features), model]).fit(train).transform(test)
        accuracy, n = scored.agg(F.avg((F.col("prediction") == F.col("label")).cast("double")), F.count("*")).first()
        out.append((name, float(BinaryClassificationEvaluator().evaluate(scored)), accuracy, n))
    return df.sparkSession.createDataFrame(out, "model string, auc double, accuracy double, n_test long")


def regress(df: DataFrame, key: str, target: str, features: Sequence[str], trees: int = 50, depth: int = 6, seed: int = 42) -> DataFrame:
    """model, R squared, MAE and RMSE on held-out rows, of a ridge regression and a random forest."""
    rows = df.filter(F.col(target).isNotNull()).withColumn("label", F.col(target).cast("double")).withColumns({f: F.col(f).cast("double") for f in features if isinstance(df.schema[f].dataType, T.NumericType)})
    train, test = split(rows, key, seed=seed)
    n = train.count()
    out = []
    prepared = Pipeline(stages=preparation(rows, features)).fit(train)
    ridge = LinearRegression(regParam=1 / max(n, 1), elasticNetParam=0.0).fit(prepared.transform(train))
    if repeats(train, features):
        models = grown(RandomForestRegressor(numTrees=1, bootstrap=False, featureSubsetStrategy="onethird" if trees > 1 else "all", maxDepth=depth, weightCol="weight"), cut(prepared.transform(bagged(train, features, trees, seed))), trees, seed)
        kinds = prepared.transform(cut(test.select(*features).distinct()))
        for i, m in enumerate(models):
            kinds = m.copy({m.predictionCol: f"y{i}"}).transform(kinds)
        mean = reduce(lambda x, y: x + y, (F.col(f"y{i}") for i in range(trees))) / trees
        forest = beside(test, F.broadcast(cut(kinds.select(*features, mean.alias("prediction")))), features)  # about KINDS rows at most
    else:
        forest = RandomForestRegressor(numTrees=trees, maxDepth=depth, seed=seed).fit(prepared.transform(train)).transform(prepared.transform(test))
    for name, scored in (("ridge", ridge.transform(prepared.transform(test))), ("forest", forest)):
        out.append((name, *(float(RegressionEvaluator(metricName=m).evaluate(scored)) for m in ("r2", "mae", "rmse"))))
    return df.sparkSession.createDataFrame(out, "model string, r2 double, mae double, rmse double")


def importance(df: DataFrame, target: str, features: Sequence[str], top: int = 10, seed: int = 42) -> DataFrame:
    """feature and importance of number columns in a random forest, the largest first."""
    rows = df.select(F.col(target).cast("double").alias("label"), *(F.col(f).cast("double").alias(f) for f in features)).na.drop()
    assembler = VectorAssembler(inputCols=list(features), outputCol="features")
    if repeats(rows, features):
        tree = RandomForestRegressor(numTrees=1, bootstrap=False, featureSubsetStrategy="onethird", maxDepth=6, weightCol="weight")
        shares = np.mean([m.featureImportances.toArray() for m in grown(tree, cut(assembler.transform(bagged(rows, features, 50, seed))), 50, seed)], axis=0)
    else:
        shares = RandomForestRegressor(numTrees=50, maxDepth=6, seed=seed).fit(assembler.transform(rows)).featureImportances.toArray()
    return df.sparkSession.createDataFrame(list(zip(features, map(float, shares))), "feature string, importance double").orderBy(F.desc("importance")).limit(top)


def eligible_features(df: DataFrame, columns: Sequence[str] | None = None, most_missing: float = 0.6) -> DataFrame:
    """column, missing share, distinct values and whether it can be a feature: under 60 % missing, not constant, not an identifier."""
    columns = list(columns or (f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)))
    long = df.select(F.inline(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns))))
    facts = long.groupBy("column", "v").agg(F.count("*").alias("n")).groupBy("column").agg(F.sum("n").alias("rows"), F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("n"))), F.lit(0)).alias("nulls"), F.count("v").alias("distinct"), F.bool_and(F.col("v") == F.floor("v")).alias("whole"))
    known = F.col("rows") - F.col("nulls")
    key_like = F.col("whole") & (F.col("distinct") == known) & (known > 1)
    missing = ratio(F.col("nulls"), F.col("rows"))
    return facts.select("column", missing.alias("missing_share"), "distinct", ((missing < most_missing) & (F.col("distinct") > 1) & ~key_like).alias("eligible"))


def cluster_stability(df: DataFrame, key: str, features: Sequence[str], k: int, draws: int = 5, share: float = 0.8, seed: int = 42) -> DataFrame:
    """draw and adjusted Rand index of refits on hash samples of 80 % against the fit on all rows, over the sampled rows."""
    rows = df.na.drop(subset=list(features))
    assembled = VectorAssembler(inputCols=list(features), outputCol="raw features").transform(rows)
    scaled = StandardScaler(inputCol="raw features", outputCol="features", withMean=True).fit(assembled).transform(assembled)
    whole = KMeans(k=k, seed=seed, predictionCol="all").fit(scaled).transform(scaled)
    out = None
    for d in range(draws):
        sample = whole.filter(F.pmod(F.xxhash64(key, F.lit(seed + d)), F.lit(1000)) < int(1000 * share))
        again = KMeans(k=k, seed=seed, predictionCol="again").fit(sample.select("features")).transform(sample)
        row = adjusted_rand(again, "all", "again").select(F.lit(d).alias("draw"), "ari")
        out = row if out is None else out.union(row)
    return out


def cross_validated(df: DataFrame, key: str, target: str, features: Sequence[str], folds: int = 5, trees: int = 50, depth: int = 6, seed: int = 42) -> DataFrame:
    """model, mean and spread of the accuracy over folds by a hash of the key, and weighted F1, precision and recall over all held-out rows."""
    rows = df.filter(F.col(target).isNotNull()).withColumn("label", F.col(target).cast("double")).withColumns({f: F.col(f).cast("double") for f in features if isinstance(df.schema[f].dataType, T.NumericType)})
    rows = rows.withColumn("fold", F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(folds)))
    out = []
    if repeats(rows, [*features, "label", "fold"]):
        kinds = counted(rows, [*features, "label", "fold"], trees, seed)
        parts = [from_kinds(rows, kinds, f"fold = {f}", features, trees, depth, seed) for f in range(folds)]
        for name in ("logistic", "forest"):
            held = cut(reduce(DataFrame.union, (p[name].select("fold", "label", "prediction", "weight") for p in parts)))
            right = F.sum(F.when(F.col("label") == F.col("prediction"), F.col("weight")).otherwise(0.0))
            mean, sd = held.groupBy("fold").agg(ratio(right, F.sum("weight")).alias("a")).agg(F.avg("a"), F.stddev_samp("a")).first()
            out.append((name, mean, sd, *(float(MulticlassClassificationEvaluator(metricName=m, weightCol="weight").evaluate(held)) for m in ("f1", "weightedPrecision", "weightedRecall"))))
        return df.sparkSession.createDataFrame(out, "model string, accuracy double, spread double, f1 double, precision double, recall double")
    for name, model in (("logistic", LogisticRegression()), ("forest", RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed))):
        held = None
        for f in range(folds):
            part = Pipeline(stages=[*preparation(rows, features), model]).fit(rows.filter(F.col("fold") != f)).transform(rows.filter(F.col("fold") == f)).select("fold", "label", "prediction")
            held = part if held is None else held.union(part)
        mean, sd = held.groupBy("fold").agg(F.avg((F.col("label") == F.col("prediction")).cast("double")).alias("a")).agg(F.avg("a"), F.stddev_samp("a")).first()
        scores = [float(MulticlassClassificationEvaluator(metricName=m).evaluate(held)) for m in ("f1", "weightedPrecision", "weightedRecall")]
        out.append((name, mean, sd, *scores))
    return df.sparkSession.createDataFrame(out, "model string, accuracy double, spread double, f1 double, precision double, recall double")


def segment(df: DataFrame, features: Sequence[str], most: int = 6, seed: int = 42, gate: float = 0.15) -> tuple[DataFrame, DataFrame]:
    """Rows with a cluster, and k with its silhouette for 2 to `most`; below the gate there is one cluster."""
    rows = df.na.drop(subset=list(features))
    assembled = VectorAssembler(inputCols=list(features), outputCol="raw features").transform(rows)
    scaled = StandardScaler(inputCol="raw features", outputCol="features", withMean=True).fit(assembled).transform(assembled).drop("raw features")
    tried = []
    for k in range(2, most + 1):
        model = KMeans(k=k, seed=seed, predictionCol="cluster").fit(scaled)
        tried.append((k, float(ClusteringEvaluator(predictionCol="cluster").evaluate(model.transform(scaled))), model))
    best = max(tried, key=lambda x: x[1])
    labelled = best[2].transform(scaled) if best[1] >= gate else scaled.withColumn("cluster", F.lit(0))
    return labelled.drop("features"), df.sparkSession.createDataFrame([x[:2] for x in tried], "k int, silhouette double")


def cluster_profile(labelled: DataFrame, features: Sequence[str]) -> DataFrame:
    """cluster, feature, mean and its distance from the overall mean in overall spreads."""
    long = labelled.select("cluster", F.inline(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("v")) for f in features))))
    whole = long.groupBy("feature").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
    return long.groupBy("cluster", "feature").agg(F.avg("v").alias("mean"), F.count("*").alias("n")).join(F.broadcast(whole), "feature").withColumn("effect", ratio(F.col("mean") - F.col("m"), F.col("s"))).drop("m", "s")


def adjusted_rand(df: DataFrame, a: str, b: str) -> DataFrame:
    """Agreement of two labellings, 1 if they are the same and about 0 by chance."""
    cells = df.groupBy(a, b).agg(F.count("*").cast("double").alias("n"))
    pairs = lambda c: F.sum(c * (c - 1) / 2)
    both = cells.agg(pairs(F.col("n")).alias("together"), F.sum("n").alias("t"))
    one = cells.groupBy(a).agg(F.sum("n").alias("n")).agg(pairs(F.col("n")).alias("x"))
    other = cells.groupBy(b).agg(F.sum("n").alias("n")).agg(pairs(F.col("n")).alias("y"))
    chance = F.col("x") * F.col("y") / (F.col("t") * (F.col("t") - 1) / 2)
    return both.crossJoin(one).crossJoin(other).select(ratio(F.col("together") - chance, (F.col("x") + F.col("y")) / 2 - chance).alias("ari"))


def calibration(df: DataFrame, probability: str, outcome: str, bins: int = 10) -> DataFrame:
    """bin, rows, mean probability, share of outcomes and their gap."""
    number = F.least(F.floor(F.col(probability) * bins), F.lit(bins - 1)).cast("int")
    by_bin = df.groupBy(number.alias("bin")).agg(F.count("*").alias("n"), F.avg(probability).alias("predicted"), F.avg(outcome).alias("observed"))
    return by_bin.withColumn("gap", F.abs(F.col("predicted") - F.col("observed")))


def calibration_errors(df: DataFrame, probability: str, outcome: str, bins: int = 10) -> DataFrame:
    """Brier score, expected and largest calibration error."""
    table = calibration(df, probability, outcome, bins)
    brier = df.agg(F.avg((F.col(probability) - F.col(outcome)) * (F.col(probability) - F.col(outcome))).alias("brier"))
    return brier.crossJoin(table.agg(ratio(F.sum(F.col("n") * F.col("gap")), F.sum("n")).alias("ece"), F.max("gap").alias("mce")))


def isotonic(df: DataFrame, probability: str, outcome: str) -> DataFrame:
    """The rows with a calibrated probability: the best non-decreasing function of the old one."""
    rows = df.withColumn("label of fit", F.col(outcome).cast("double")).withColumn("x of fit", F.col(probability).cast("double"))
    model = IsotonicRegression(featuresCol="x of fit", labelCol="label of fit", predictionCol="calibrated").fit(rows)
    return model.transform(rows).drop("label of fit", "x of fit")


def uplift(df: DataFrame, treatment: str, outcome: str, features: Sequence[str]) -> DataFrame:
    """quadrant and rows, by a model of each arm: sure things, lost causes, persuadables and sleeping dogs."""
    rows = df.select(F.col(treatment).cast("int").alias("t"), F.col(outcome).cast("double").alias("y"), *(F.col(f).cast("double").alias(f) for f in features)).na.drop()
    rows = VectorAssembler(inputCols=list(features), outputCol="features").transform(rows)
    for arm in (0, 1):
        model = LogisticRegression(labelCol="y", probabilityCol=f"p{arm}", rawPredictionCol=f"r{arm}", predictionCol=f"g{arm}").fit(rows.filter(F.col("t") == arm))
        rows = model.transform(rows).withColumn(f"with{arm}", vector_to_array(f"p{arm}")[1] >= 0.5)
    quadrant = F.when(F.col("with1") & F.col("with0"), "sure_thing").when(F.col("with1"), "persuadable").when(F.col("with0"), "sleeping_dog").otherwise("lost_cause")
    return rows.groupBy(quadrant.alias("quadrant")).agg(F.count("*").alias("n"))


def risk_score(df: DataFrame, target: str, features: Sequence[str], time: str, holdout: float = 0.2) -> tuple[DataFrame, DataFrame]:
    """Rows with a risk of a 0/1 target, and the model's area under the curve and Brier score on the latest rows.

    The model learns from the earlier rows only, cut at a percentile of the time column.
    """
    rows = df.filter(F.col(target).isNotNull() & F.col(time).isNotNull()).withColumn("label", F.col(target).cast("double")).withColumns({f: F.col(f).cast("double") for f in features if isinstance(df.schema[f].dataType, T.NumericType)})
    seconds = F.unix_timestamp(F.col(time).cast("timestamp"))
    border = rows.agg(F.percentile_approx(seconds, 1 - holdout, 1000)).first()[0]
    model = Pipeline(stages=[*preparation(rows, features), LogisticRegression()]).fit(rows.filter(seconds <= border))
    scored = model.transform(rows).withColumn("risk", vector_to_array("probability")[1])
    late = scored.filter(seconds > border)
    brier, n = late.agg(F.avg((F.col("risk") - F.col("label")) * (F.col("risk") - F.col("label"))), F.count("*")).first()
    report = df.sparkSession.createDataFrame([(float(BinaryClassificationEvaluator().evaluate(late)), brier, n)], "auc double, brier double, n_test long")
    return scored.select(*df.columns, "risk"), report
