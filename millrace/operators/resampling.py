"""Bootstrap intervals of means, ratios and quantiles without copying rows.

Every row has a Poisson(1) weight in each resample, drawn from a hash of its key. A task draws the weights of a few
thousand rows at a time as a matrix and returns sums over its rows for all resamples; what is shuffled is a row for each task and resample, or
for each task and bin, whatever the number of rows.

A weighted quantile of every resample at once: weighted counts of bins between sketched edges show in which bins the resamples' order
statistics lie; only rows in those bins are looked at again, with finer edges, until few are left, which are sorted.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows whose weights are drawn at once, bins of a round, and rows that are sorted in one place.
DRAWN, BINS, FEW = 4096, 256, 100_000
#: Chances of a Poisson(1) weight above 0, 1, 2, ...; eight are all that 40 bits tell apart but for 1 in 10 ** 6.
EDGES = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])


def weights(hashes: np.ndarray, resamples: int) -> np.ndarray:
    """Poisson(1) weights, a row for each hash: the hash and the resample's number mixed to a uniform number."""
    x = hashes.view(np.uint64)[:, None] + np.arange(1, resamples + 1, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    u = ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / (1 << 53)
    return np.searchsorted(EDGES, u.ravel(), side="right").reshape(u.shape)


def keyed(df: DataFrame, key: str, seed: int, **columns: str) -> DataFrame:
    """h (hash of the key) and the named columns as doubles, of rows that have them all."""
    return df.select(F.xxhash64(key, F.lit(seed)).alias("h"), *(F.col(c).cast("double").alias(name) for name, c in columns.items())).na.drop()


def weighted_sums(rows: DataFrame, columns: list[str], resamples: int) -> np.ndarray:
    """Of each column the weighted sum in each resample."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(columns), resamples))
        for batch in batches:
            h, values = batch.column("h").to_numpy(), np.stack([batch.column(c).to_numpy() for c in columns])
            for i in range(0, len(h), DRAWN):
                total += values[:, i : i + DRAWN] @ weights(h[i : i + DRAWN], resamples)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(resamples, dtype=np.int32)), *(pa.array(t) for t in total)], ["resample", *columns])

    sums = rows.mapInArrow(add, ", ".join(["resample int", *(f"{c} double" for c in columns)])).groupBy("resample").agg(*(F.sum(c).alias(c) for c in columns))
    found = sums.orderBy("resample").collect()  # a row a resample
    return np.array([[r[c] for r in found] for c in columns]).reshape(len(columns), -1)


def binned(rows: DataFrame, edges: np.ndarray, resamples: int) -> np.ndarray:
    """Weighted counts of each bin (values below the first edge, from an edge to the next, from the last on) in each resample."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(edges) + 1, resamples), np.int64)
        for batch in batches:
            h, at = batch.column("h").to_numpy(), np.searchsorted(edges, batch.column("v").to_numpy(), side="right")
            for i in range(0, len(h), DRAWN):
                order = np.argsort(at[i : i + DRAWN], kind="stable")
                which, first = np.unique(at[i : i + DRAWN][order], return_index=True)
                total[which] += np.add.reduceat(weights(h[i : i + DRAWN][order], resamples), first, axis=0)
        some = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([t.tolist() for t in total[some]], pa.list_(pa.int64()))], ["bin", "n"])

    counted = rows.mapInArrow(add, "bin int, n array<long>").select("bin", F.posexplode("n").alias("resample", "k")).groupBy("bin", "resample").agg(F.sum("k").alias("k"))
    sums = counted.groupBy("bin").agg(F.transform(F.array_sort(F.collect_list(F.struct("resample", "k"))), lambda s: s["k"]).alias("n"))
    out = np.zeros((len(edges) + 1, resamples), np.int64)
    for r in sums.collect():  # a row a bin
        out[r["bin"]] = r["n"]
    return out


def sorted_quantiles(h: np.ndarray, v: np.ndarray, below: np.ndarray, rank: np.ndarray | None, point: float) -> np.ndarray:
    """The quantiles of the resamples from the rows around them, below: weighted counts of the rows before these, rank: the places asked for."""
    order = np.argsort(v, kind="stable")
    h, v, resamples = h[order], v[order], len(below)
    if rank is None:
        rank = point * (sum(weights(h[i : i + DRAWN], resamples).sum(axis=0) for i in range(0, len(h), DRAWN)) - 1)
    ends = np.full((2, resamples), np.nan)
    running = below.copy()
    for i in range(0, len(h), DRAWN):
        upto = running + np.cumsum(weights(h[i : i + DRAWN], resamples), axis=0)
        for end, k in zip(ends, (np.floor(rank), np.ceil(rank))):
            at = (upto <= k).sum(axis=0)
            new = np.isnan(end) & (at < len(upto)) & (rank >= 0)
            end[new] = v[i + at[new]]
        running = upto[-1]
    return ends[0] + (ends[1] - ends[0]) * (rank - np.floor(rank))


def quantile_replicates(rows: DataFrame, point: float, resamples: int) -> np.ndarray:
    """The quantile (linear between neighbours) of each resample of rows h, v; at last about as many rows are sorted as the root of all."""
    below, rank, low, high, before = np.zeros(resamples, np.int64), None, -np.inf, np.inf, math.inf
    while True:
        part = rows.filter(F.col("v").between(float(low), float(high)))
        n, found = part.agg(F.count("*"), F.percentile_approx("v", [i / BINS for i in range(BINS + 1)], 10 * BINS)).first()
        if not n:
            return np.full(resamples, np.nan)
        if n <= FEW or 2 * n > before and rank is not None:
            table = part.select("h", "v").toArrow()
            return sorted_quantiles(table.column("h").to_numpy(), table.column("v").to_numpy(), below, rank, point)
        values, times = np.unique(found, return_counts=True)
        often = values[(times > 1) | (values == values[-1])]
        edges = np.unique(np.concatenate([values, np.nextafter(often, np.inf)]))  # a frequent value has a bin of its own
        counts = binned(part, edges, resamples)
        upto = below + np.cumsum(counts, axis=0)
        rank = point * (upto[-1] - 1) if rank is None else rank
        bins = np.stack([(upto <= k).sum(axis=0) for k in (np.floor(rank), np.ceil(rank))])
        single = np.concatenate([[False], np.nextafter(edges[:-1], np.inf) == edges[1:], [False]])
        if single[bins].all():
            a, b = edges[bins - 1]
            return a + (b - a) * (rank - np.floor(rank))
        first, last = int(bins.min()), int(bins.max())
        below = below + counts[:first].sum(axis=0)
        low = edges[first - 1] if first else low
        high = np.nextafter(edges[last], -np.inf) if last < len(edges) else high
        before = n


def bootstrap(df: DataFrame, value: str, key: str, statistic: str = "mean", by: str | None = None, point: float = 0.5, resamples: int = 200, seed: int = 7, alpha: float = 0.05) -> DataFrame:
    """estimate, low, high, n by a Poisson bootstrap of the mean of a column, of the ratio of the sums of value and by, or of a quantile.

    key tells rows apart; rows of one key are drawn together. Rows with a null take no part; without rows all is null.
    """
    if statistic not in ("mean", "ratio", "quantile") or (statistic == "ratio") != (by is not None):
        raise ValueError("mean, quantile, or ratio by another column")
    rows = keyed(df, key, seed, v=value, **({"b": by} if by else {}))
    if statistic == "quantile":
        from .ranks import column_quantiles

        estimate, n = column_quantiles(rows, ["v"], [point])["v"][0], rows.count()
        replicates = quantile_replicates(rows.filter(~F.isnan("v")), point, resamples)
    else:
        over = F.col("b") if by else F.lit(1.0)
        top, bottom, n = rows.agg(F.sum("v"), F.sum(over), F.count("*")).first()
        estimate = top / bottom if bottom else None
        a, b = weighted_sums(rows.withColumn("b", over), ["v", "b"], resamples)
        replicates = np.divide(a, b, out=np.full(len(a), np.nan), where=b != 0)
    known = replicates[~np.isnan(replicates)]
    low, high = (float(x) for x in np.quantile(known, [alpha / 2, 1 - alpha / 2])) if len(known) and n else (None, None)
    return df.sparkSession.createDataFrame([(estimate, low, high, n)], "estimate double, low double, high double, n long")
