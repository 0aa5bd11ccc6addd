"""Equi-joins and the checks that keep them from multiplying rows."""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import ratio

#: Containment weighs this much against Jaccard similarity where joins are looked for.
CONTAINMENT = 0.9
#: Hashes of a column's sketch.
SKETCH = 1024
KEY_ENDS = ("_id", "_key", "_code", "id", "key", "code")


@dataclass(frozen=True)
class Hop:
    """One join of a path: a table on the right, and key columns on the left and on the right."""

    right: str
    left_keys: tuple[str, ...]
    right_keys: tuple[str, ...]
    how: str = "inner"


def join(left: DataFrame, right: DataFrame, left_keys: Sequence[str], right_keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Inner or left equi-join; the right keys are left out."""
    if how not in ("inner", "left"):
        raise ValueError("joins are inner or left")
    same = [a for a, b in zip(left_keys, right_keys) if a == b]
    if len(same) == len(left_keys):
        return left.join(right, same, how)
    renamed = reduce(lambda d, k: d.withColumnRenamed(k, f"key of {k}"), right_keys, right)
    on = reduce(lambda x, y: x & y, (F.col(a) == F.col(f"key of {b}") for a, b in zip(left_keys, right_keys)))
    return left.join(renamed, on, how).drop(*(f"key of {k}" for k in right_keys))


def join_path(tables: Mapping[str, DataFrame], base: str, hops: Sequence[Hop]) -> DataFrame:
    """A chain or star of at most five joins, in the order given; Spark picks broadcast or shuffle by size."""
    if len(hops) > 5:
        raise ValueError("at most five hops")
    return reduce(lambda d, h: join(d, tables[h.right], h.left_keys, h.right_keys, h.how), hops, tables[base])


def semi(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows whose key is in another table."""
    return df.join(keys, list(on), "left_semi")


def anti(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows whose key is not in another table."""
    return df.join(keys, list(on), "left_anti")


def key_facts(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Rows, rows with a known key, and distinct known keys. Keys are counted in groups, so no key's rows meet in a buffer."""
    known = reduce(lambda x, y: x & y, (F.col(k).isNotNull() for k in keys))
    counts = df.groupBy(*keys).agg(F.count("*").alias("n"))
    return counts.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias(f"{name}_rows"), F.coalesce(F.sum(F.when(known, F.col("n"))), F.lit(0)).alias(f"{name}_known"), F.count_if(known).alias(f"{name}_distinct")
    )


def kind(dtype: T.DataType) -> str:
    return "number" if isinstance(dtype, T.NumericType) else "text" if isinstance(dtype, T.StringType) else dtype.simpleString()


def assess_join(left: DataFrame, right: DataFrame, left_keys: Sequence[str], right_keys: Sequence[str], authorised: bool = False) -> DataFrame:
    """One row: row and key counts of both sides, cardinality, and SAFE, UNSAFE or UNKNOWN.

    Missing keys, keys of different kinds and many-to-many joins that are not authorised are unsafe; an empty side
    or one without known keys is unknown.
    """
    problem = None
    if any(k not in left.columns for k in left_keys) or any(k not in right.columns for k in right_keys):
        problem = "missing_key"
    elif any(kind(left.schema[a].dataType) != kind(right.schema[b].dataType) for a, b in zip(left_keys, right_keys)):
        problem = "incompatible_types"
    if problem:
        return left.sparkSession.createDataFrame([("UNKNOWN", "UNSAFE", problem)], "cardinality string, status string, reason string")
    both = key_facts(left, left_keys, "left").crossJoin(F.broadcast(key_facts(right, right_keys, "right")))
    one_left, one_right = F.col("left_known") == F.col("left_distinct"), F.col("right_known") == F.col("right_distinct")
    empty = (F.col("left_known") == 0) | (F.col("right_known") == 0)
    cardinality = F.when(empty, "UNKNOWN").when(one_left & one_right, "ONE_TO_ONE").when(one_right, "MANY_TO_ONE").when(one_left, "ONE_TO_MANY").otherwise("MANY_TO_MANY")
    status = F.when(empty, "UNKNOWN").when((F.col("cardinality") == "MANY_TO_MANY") & ~F.lit(authorised), "UNSAFE").otherwise("SAFE")
    return both.withColumn("cardinality", cardinality).withColumn("status", status)


def assess_hops(tables: Mapping[str, DataFrame], base: str, hops: Sequence[Hop]) -> DataFrame:
    """hop, cardinality and status of every join of a path, each against the table that holds its left key."""
    reports, seen = [], [base]
    for i, h in enumerate(hops):
        owner = next((n for n in seen if all(k in tables[n].columns for k in h.left_keys)), base)
        report = assess_join(tables[owner], tables[h.right], h.left_keys, h.right_keys)
        reports.append(report.select(F.lit(i + 1).alias("hop"), F.lit(h.right).alias("right"), "cardinality", "status"))
        seen.append(h.right)
    return reduce(DataFrame.unionByName, reports)


def fanout_guard(reports: DataFrame) -> DataFrame:
    """Whether a base metric may be aggregated over the path: no hop repeats the base's rows."""
    return reports.agg(F.bool_and((F.col("status") == "SAFE") & F.col("cardinality").isin("ONE_TO_ONE", "MANY_TO_ONE")).alias("allowed"))


def grain_proof(before: DataFrame, after: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows and distinct keys before and after a join, the fan-out, and a verdict."""
    both = key_facts(before, keys, "before").crossJoin(F.broadcast(key_facts(after, keys, "after")))
    verdict = F.when(F.col("after_rows") > F.col("before_rows"), "FANOUT_DETECTED").when(F.col("after_rows") == F.col("before_rows"), "PRESERVED").otherwise("AGGREGATED_SAFELY")
    return both.select("before_rows", "after_rows", "before_distinct", "after_distinct", ratio(F.col("after_rows"), F.col("before_rows")).alias("fanout"), verdict.alias("verdict"))


def stem(column: str) -> str:
    """A key column's name without its table prefix and key ending."""
    name = column.lower().split("_", 1)[-1]
    end = next((e for e in KEY_ENDS if name.endswith(e) and name != e), "")
    return name[: len(name) - len(end)].strip("_")


def hashed(column: F.Column, kind: T.DataType) -> F.Column:
    """A value's hash, the same for numbers of any type that are equal."""
    return F.xxhash64(column.cast("double") + F.lit(0.0)) if isinstance(kind, T.NumericType) else F.xxhash64(column.cast("string"))


def sketches(df: DataFrame, columns: Sequence[str], k: int = SKETCH) -> dict[str, np.ndarray]:
    """Of each column the k smallest hashes of its values, ascending and unsigned, from one scan of the table.

    Fewer than k are the hashes of all its values. A task returns k hashes a column at most.
    """
    if not columns:
        return {}
    names = [f"h{i}" for i in range(len(columns))]
    rows = df.select(*(F.when(F.col(f"`{c}`").isNotNull(), hashed(F.col(f"`{c}`"), df.schema[c].dataType)).alias(n) for c, n in zip(columns, names)))

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.uint64) for _ in names]
        for batch in batches:
            for i in range(len(names)):
                new = np.unique(batch.column(i).drop_null().to_numpy().view(np.uint64))
                if len(held[i]) == k:
                    new = new[new < held[i][-1]]
                if len(new):
                    held[i] = np.union1d(held[i], new)[:k]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(names), dtype=np.int32), [len(x) for x in held])), pa.array(np.concatenate(held).view(np.int64))], ["i", "h"])

    # signed order of h + 2 ** 63 is unsigned order of h
    ranked = F.row_number().over(Window.partitionBy("i").orderBy(F.expr("h ^ -9223372036854775808L")))
    found = rows.mapInArrow(least, "i int, h long").distinct().withColumn("r", ranked).filter(F.col("r") <= k).select("i", "h").toArrow()  # k rows a column
    which, h = found.column("i").to_numpy(), found.column("h").to_numpy().view(np.uint64)
    return {c: np.sort(h[which == i]) for i, c in enumerate(columns)}


def missing_from(a: np.ndarray, b: np.ndarray, k: int = SKETCH) -> tuple[int, int]:
    """Of the values that a's sketch shows where b's is complete: how many there are, and how many b does not have."""
    seen = a if len(b) < k else a[a <= b[-1]] if len(b) else a
    return len(seen), int((~np.isin(seen, b, assume_unique=True)).sum())


def may_overlap(a: np.ndarray, b: np.ndarray, least: float, k: int = SKETCH) -> bool:
    """Whether the score of two columns can reach a bound: ruled out only where the sketches show it exactly or by five standard errors."""
    if not len(a) or not len(b):
        return False
    if len(a) < k and len(b) < k:
        shared = len(np.intersect1d(a, b, assume_unique=True))
        return max(shared / (len(a) + len(b) - shared), CONTAINMENT * shared / min(len(a), len(b))) >= least
    contained = []  # Jaccard similarity is no larger than either containment
    for x, y in ((a, b), (b, a)):
        n, gone = missing_from(x, y, k)
        contained.append((1 - gone / n) + 5 * math.sqrt(max(gone / n * (1 - gone / n), 1 / n) / n) if n else 1.0)
    return max(min(contained), CONTAINMENT * max(contained)) >= least


def overlap(left: DataFrame, a: str, right: DataFrame, b: str) -> DataFrame:
    """Distinct keys of both sides, shared keys, Jaccard similarity, containment and their score."""
    x = left.select(F.col(a).alias("k")).filter("k IS NOT NULL").distinct().withColumn("l", F.lit(1))
    y = right.select(F.col(b).alias("k")).filter("k IS NOT NULL").distinct().withColumn("r", F.lit(1))
    counts = x.join(y, "k", "full_outer").agg(F.count("l").alias("left_keys"), F.count("r").alias("right_keys"), F.count_if(F.col("l").isNotNull() & F.col("r").isNotNull()).alias("shared"), F.count("*").alias("all"))
    jaccard, contained = ratio(F.col("shared"), F.col("all")), ratio(F.col("shared"), F.least("left_keys", "right_keys"))
    return counts.withColumn("jaccard", jaccard).withColumn("containment", contained).withColumn("score", F.greatest("jaccard", CONTAINMENT * F.col("containment"))).drop("all")


def discover_joins(tables: Mapping[str, DataFrame], least: float = 0.5) -> DataFrame:
    """left, left_key, right, right_key, score of pairs of key columns that share a stem and their values.

    One scan a table gives sketches of its key columns; only pairs whose sketches do not rule the score out are joined.
    """
    found, names = [], sorted(tables)
    keys = {n: [c for c in tables[n].columns if stem(c) and c.lower().endswith(KEY_ENDS)] for n in names}
    paired = {n: [c for c in keys[n] if any(stem(c) == stem(d) for m in names if m != n for d in keys[m])] for n in names}
    known = {n: sketches(tables[n], paired[n]) for n in names}
    number = lambda n, c: isinstance(tables[n].schema[c].dataType, T.NumericType)
    for i, p in enumerate(names):
        for q in names[i + 1 :]:
            for a in paired[p]:
                for b in paired[q]:
                    if stem(a) == stem(b) and (number(p, a) != number(q, b) or may_overlap(known[p][a], known[q][b], least)):
                        found.append(overlap(tables[p], a, tables[q], b).select(F.lit(p).alias("left"), F.lit(a).alias("left_key"), F.lit(q).alias("right"), F.lit(b).alias("right_key"), "score"))
    if not found:
        spark = next(iter(tables.values())).sparkSession
        return spark.createDataFrame([], "left string, left_key string, right string, right_key string, score double")
    return reduce(DataFrame.unionByName, found).filter(F.col("score") >= least)


def find_join_path(edges: Sequence[tuple[str, str, str, str, float]], start: str, goal: str, most: int = 5) -> list[Hop]:
    """The shortest path of safe joins between two tables by the best mean score; a tie raises.

    edges are the few rows of discover_joins.
    """
    paths, best = [((), (start,), 0.0)], []
    for _ in range(most):
        longer = []
        for hops, seen, score in paths:
            for p, a, q, b, s in [*edges, *((q, b, p, a, s) for p, a, q, b, s in edges)]:
                if p == seen[-1] and q not in seen:
                    longer.append(((*hops, Hop(q, (a,), (b,))), (*seen, q), score + s))
        best = sorted((x for x in longer if x[1][-1] == goal), key=lambda x: -x[2])
        if best:
            break
        paths = longer
    if not best:
        raise ValueError(f"no path from {start} to {goal}")
    if len(best) > 1 and best[0][2] == best[1][2]:
        raise ValueError("several paths are equally good")
    return list(best[0][0])


def foreign_key(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """Distinct child keys, how many the parent has, the share, and whether it is a many-to-one foreign key."""
    keys = child.select(F.col(column).alias("k")).filter("k IS NOT NULL").distinct()
    matched = keys.join(parent.select(F.col(key).alias("k")).distinct().withColumn("hit", F.lit(1)), "k", "left")
    return matched.agg(F.count("*").alias("keys"), F.count("hit").alias("matched")).withColumn("match_ratio", ratio(F.col("matched"), F.col("keys"))).withColumn("is_foreign_key", (F.col("keys") > 5) & (F.col("matched") == F.col("keys")))


def foreign_keys(tables: Mapping[str, DataFrame]) -> DataFrame:
    """child, column, parent, key, match_ratio of all pairs of columns of one name, or named after the other table, of which one's values are among the other's.

    One scan a table gives sketches of the columns with such names. A value that a child's sketch shows and the parent's lacks
    rules a pair out; only what is left is joined.
    """
    names = sorted(tables)
    plain = {n: [c for c, kind in tables[n].dtypes if not kind.startswith(("array", "map", "struct"))] for n in names}
    named = lambda p, a, q, b: a.lower() == b.lower() or a.lower() == f"{q.lower()}_id" or b.lower() == f"{p.lower()}_id"
    pairs = [(p, a, q, b) for i, p in enumerate(names) for q in names[i + 1 :] for a in plain[p] for b in plain[q] if named(p, a, q, b)]
    known = {n: sketches(tables[n], sorted({c for p, a, q, b in pairs for m, c in ((p, a), (q, b)) if m == n})) for n in names}
    number = lambda n, c: isinstance(tables[n].schema[c].dataType, T.NumericType)

    def may_hold(child: str, a: str, parent: str, b: str) -> bool:
        if not len(known[child][a]) or not len(known[parent][b]):
            return False
        return number(child, a) != number(parent, b) or not missing_from(known[child][a], known[parent][b])[1]

    found = []
    for p, a, q, b in pairs:
        for way, (child, x, parent, y) in enumerate(((p, a, q, b), (q, b, p, a))):
            if may_hold(child, x, parent, y):
                facts = foreign_key(tables[child], x, tables[parent], y).filter("is_foreign_key")
                row = F.struct(F.lit(way).alias("way"), F.lit(child).alias("child"), F.lit(x).alias("column"), F.lit(parent).alias("parent"), F.lit(y).alias("key"), "match_ratio")
                found.append(facts.select(F.lit(f"{p}.{a}.{q}.{b}").alias("pair"), row.alias("row")))
    if not found:
        return next(iter(tables.values())).sparkSession.createDataFrame([], "child string, column string, parent string, key string, match_ratio double")
    # columns with the same values are the key of the table that comes first
    return reduce(DataFrame.unionByName, found).groupBy("pair").agg(F.min("row").alias("row")).select("row.*").drop("way")
