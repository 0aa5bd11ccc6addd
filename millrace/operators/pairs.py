"""Concordant and discordant pairs of points, counted exactly without meeting each other.

A group of points that fits a task is counted there by sorts. A larger one is cut into ranges of x and ranges of y, its own. Pairs that
differ in both ranges are counted on the grid of the ranges' counts; pairs in one range of x form a group of their own, and so do
pairs in one range of y, with the range of x in the place of x. Those groups are counted or cut again, level by level, until all fit.
A bound of a range is a range by itself, so that a frequent value of x is left with points of one x, which have no pairs to count.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .inference import one_row
from .lineage import cut

#: Points that a task counts, and ranges of x and of y that a larger group is cut into.
FIT, GRID = 1 << 20, 64


def signed_pairs(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> float:
    """Concordant minus discordant pairs of weighted points, pairs that are tied in x or y left out."""
    if len(x) < 2:
        return 0.0
    if len(x) <= 64:
        later = np.sign(x[None, :] - x[:, None]) > 0
        return float((np.sign(y[None, :] - y[:, None]) * later * n[:, None] * n[None, :]).sum())
    order = np.argsort(x, kind="stable")
    x, y, n = x[order], y[order], n[order]
    middle = int(np.searchsorted(x, x[len(x) // 2]))  # points of one x stay on one side
    if middle == 0:
        middle = int(np.searchsorted(x, x[0], side="right"))
        if middle == len(x):
            return 0.0
    by_y = np.argsort(y[:middle], kind="stable")
    low, weight = y[:middle][by_y], np.concatenate([[0.0], np.cumsum(n[:middle][by_y])])
    right = y[middle:]
    across = float((n[middle:] * (weight[np.searchsorted(low, right)] - (weight[-1] - weight[np.searchsorted(low, right, side="right")]))).sum())
    return across + signed_pairs(x[:middle], y[:middle], n[:middle]) + signed_pairs(x[middle:], y[middle:], n[middle:])


def on_grid(cells: pd.DataFrame) -> float:
    """Concordant minus discordant pairs of points that differ in both ranges, from the counts of the cells a, b of a group."""
    grid = np.zeros((2 * GRID + 1, 2 * GRID + 1))
    grid[cells["a"], cells["b"]] = cells["n"]
    after = np.cumsum(grid[::-1], axis=0)[::-1]
    later = np.vstack([after[1:], np.zeros((1, grid.shape[1]))])  # points in larger ranges of x
    below = np.cumsum(later, axis=1) - later
    above = later.sum(axis=1, keepdims=True) - below - later
    return float((grid * (above - below)).sum())


def signed_total(points: DataFrame) -> float:
    """Concordant minus discordant pairs of distinct points x, y with weights n."""
    total, now = 0.0, cut(points.select(F.lit("").alias("g"), "x", "y", F.col("n").cast("double").alias("n")))
    added = lambda df: float(df.agg(F.sum("s")).first()[0] or 0.0)
    while True:
        sizes = now.groupBy("g").agg(F.count("*").alias("size"), F.percentile_approx("x", [i / GRID for i in range(1, GRID)], 1000).alias("ex"), F.percentile_approx("y", [i / GRID for i in range(1, GRID)], 1000).alias("ey"))
        sizes = cut(sizes.select("g", (F.col("size") > FIT).alias("is_large"), F.array_distinct("ex").alias("ex"), F.array_distinct("ey").alias("ey")))
        fits = now.join(sizes.filter("NOT is_large").select("g"), "g")
        total += added(fits.groupBy("g").applyInPandas(lambda g: pd.DataFrame({"s": [signed_pairs(g["x"].to_numpy(float), g["y"].to_numpy(float), g["n"].to_numpy(float))]}), "s double"))
        large = sizes.filter("is_large")
        if not large.take(1):
            return total
        # a value below, at or above an edge: even numbers are ranges, odd ones the edges themselves
        place = lambda v, e: F.aggregate(e, F.lit(0), lambda k, x: k + (F.col(v) >= x).cast("int") + (F.col(v) > x).cast("int"))
        placed = cut(now.join(large, "g").select("g", "x", "y", "n", place("x", F.col("ex")).alias("a"), place("y", F.col("ey")).alias("b")))
        cells = placed.groupBy("g", "a", "b").agg(F.sum("n").alias("n"))
        total += added(cells.groupBy("g").applyInPandas(lambda g: pd.DataFrame({"s": [on_grid(g)]}), "s double"))  # at most (2 GRID + 1) ** 2 cells
        columns = placed.filter("a % 2 = 0").select(F.concat("g", F.lit("x"), F.col("a").cast("string")).alias("g"), "x", "y", "n")
        rows = placed.filter("b % 2 = 0").groupBy(F.concat("g", F.lit("y"), F.col("b").cast("string")).alias("g"), F.col("a").cast("double").alias("x"), "y").agg(F.sum("n").alias("n"))
        now = cut(columns.union(rows))


def kendall(df: DataFrame, x: str, y: str) -> DataFrame:
    """Kendall's tau-b, exact at any size: no task holds more than about FIT points. Rows with a null take no part."""
    known = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).filter("x IS NOT NULL AND y IS NOT NULL")
    points = cut(known.groupBy("x", "y").agg(F.count("*").alias("n")))
    s = signed_total(points)
    pairs_in = lambda c: points.groupBy(c).agg(F.sum("n").cast("double").alias("k")).agg(F.sum(F.col("k") * (F.col("k") - 1) / 2)).first()[0] or 0.0
    n = points.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    pairs = n * (n - 1) / 2
    free = math.sqrt((pairs - pairs_in("x")) * (pairs - pairs_in("y")))
    return one_row(df, {"tau": s / free if free else math.nan, "n": n})
