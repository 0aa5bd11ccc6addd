"""Nearest neighbours and inner-product search of vectors, in blocks.

Vectors are packed into blocks of a few thousand rows. Every block of queries meets every block of candidates; a
task that gets such a pair works on whole matrices and keeps the best of each query in a heap across the pairs it
sees, so that what leaves a task is at most k rows a query. Query blocks are broadcast only where their measured
size is small; beyond that the pairs are dealt out block by block.

Approximate neighbours (block matrix join): every block carries its int8 codes, made once; tiles of their products give
distances with bounds on the quantisation error, and only pairs whose lower bound does not exceed the k-th upper bound
are computed in double precision.

Exact top-k (pivot-table elimination): every block carries its rows' distances to the pivots, computed once; they give
lower bounds on a candidate's distance to a query and so upper bounds on its score. Candidates are evaluated in bound
order until no bound reaches the k-th score.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import cut

#: Rows of a candidate block and of a query block; bytes of query blocks up to which they are broadcast.
BLOCK, QUERY_BLOCK, BROADCAST_BYTES = 4096, 512, 16 << 20
#: Pivots of a table at most.
MOST_PIVOTS = 256
PACKED = ["dim", "n", "ids", "data", "more"]


def usable(df: DataFrame, id_col: str, vector_col: str, zero: bool, *more: str) -> DataFrame:
    """vec_id, v (array of double) and further columns of the rows that take part."""
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"), *more)
    finite = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & finite)
    return rows if zero else rows.filter(F.exists("v", lambda x: x != 0))


def packed(rows: DataFrame, block: int, prepare: Callable[[np.ndarray], bytes]) -> DataFrame:
    """Blocks of vectors of one dimension: ids as 64-bit integers, data as doubles, row by row, and what prepare makes of the data."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list[int], list[np.ndarray]]] = {}

        def out(dim: int) -> pa.RecordBatch:
            ids, data = held.pop(dim)
            whole = np.concatenate(data).astype("<f8")
            columns = [pa.array([dim], pa.int32()), pa.array([len(ids)], pa.int32()), *(pa.array([b], pa.binary()) for b in (np.array(ids, "<i8").tobytes(), whole.tobytes(), prepare(whole.reshape(-1, dim))))]
            return pa.RecordBatch.from_arrays(columns, PACKED)

        for batch in batches:
            lists = batch.column("v")
            flat, offsets = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            for i, vec_id in enumerate(batch.column("vec_id").to_pylist()):
                vector = flat[offsets[i] : offsets[i + 1]]
                ids, data = held.setdefault(len(vector), ([], []))
                ids.append(vec_id)
                data.append(vector)
                if len(ids) == block:
                    yield out(len(vector))
        for dim in list(held):
            yield out(dim)

    return rows.mapInArrow(pack, "dim int, n int, ids binary, data binary, more binary")


def arrays(dim: int, ids: bytes, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(ids, "<i8"), np.frombuffer(data, "<f8").reshape(-1, dim)


def search(candidates: DataFrame, queries: DataFrame, k: int, prepare: tuple[Callable, Callable], tile: Callable, kind: str, largest: bool) -> DataFrame:
    """The k best candidates of each query, by tile(query block, candidate block, bests so far).

    prepare makes what a candidate block and a query block carry beside their vectors. tile yields (query position, [(value, vec_id), ...]) with smaller values first; value is the score, or its
    negative where the largest score is best.
    """
    blocks = packed(candidates, BLOCK, prepare[0])
    n_queries, dims = queries.agg(F.count("*"), F.max(F.size("v"))).first()
    asked = packed(queries.repartition(max(1, -(-n_queries // QUERY_BLOCK))), QUERY_BLOCK, prepare[1]).select(*(F.col(c).alias(f"q_{c}") for c in PACKED))
    # with what a query carries beside its vector: at most as much again, or 4 bytes a pivot
    if n_queries * (2 * (dims or 0) + MOST_PIVOTS // 2 + 3) * 8 <= BROADCAST_BYTES:
        pairs = blocks.crossJoin(F.broadcast(asked))
    else:
        pairs = cut(blocks).crossJoin(cut(asked))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bests: dict[bytes, tuple[np.ndarray, list[list[tuple]]]] = {}
        for batch in batches:
            for r in batch.to_pylist():
                if r["dim"] != r["q_dim"]:
                    continue
                q_ids, q = arrays(r["q_dim"], r["q_ids"], r["q_data"])
                c_ids, c = arrays(r["dim"], r["ids"], r["data"])
                _, heaps = bests.setdefault(r["q_ids"], (q_ids, [[] for _ in q_ids]))
                for i, found in tile(q_ids, q, r["q_more"], c_ids, c, r["more"], heaps):
                    merged = {}
                    for value, vec_id in heapq.merge(heaps[i], found):
                        merged.setdefault(vec_id, value)
                        if len(merged) == k:
                            break
                    heaps[i] = [(value, vec_id) for vec_id, value in merged.items()]
        flat = [(int(q), v, value) for ids, heaps in bests.values() for q, heap in zip(ids, heaps) for value, v in heap]
        sign = -1 if largest else 1
        columns = [pa.array([x[0] for x in flat], pa.int64()), pa.array([x[1] for x in flat], pa.int64()), pa.array([sign * x[2] for x in flat], pa.int64() if kind == "long" else pa.float64())]
        yield pa.RecordBatch.from_arrays(columns, ["query_id", "vec_id", "score"])

    # a repeated id counts once, with its best score
    found = pairs.mapInArrow(best, f"query_id long, vec_id long, score {kind}")
    found = found.groupBy("query_id", "vec_id").agg((F.max if largest else F.min)("score").alias("score"))
    order = F.desc("score") if largest else F.asc("score")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(order, "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def quantised(x: np.ndarray) -> bytes:
    """The scale of a block, each row's distance to what its int8 codes stand for and its codes' square, in units of the scale, and the codes."""
    scale = float(np.abs(x).max()) / 127 or 1.0
    units = x / scale
    codes = np.rint(units).astype(np.int8)
    error, square = np.sqrt(((units - codes) ** 2).sum(axis=1)), (codes.astype(np.float64) ** 2).sum(axis=1)
    return np.concatenate([[scale], error, square]).astype("<f8").tobytes() + codes.tobytes()


def dequantised(more: bytes, n: int, dim: int) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    head = np.frombuffer(more, "<f8", 2 * n + 1)
    return float(head[0]), head[1 : n + 1], head[n + 1 :], np.frombuffer(more, np.int8, offset=head.nbytes).reshape(n, dim)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of int8 rows. In single precision, exact: 1,024 products of codes stay below 2 ** 24."""
    out = np.zeros((len(a), len(b)))
    for i in range(0, a.shape[1], 1024):
        out += a[:, i : i + 1024].astype(np.float32) @ b[:, i : i + 1024].astype(np.float32).T
    return out


def distances(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Euclidean distances in double precision, components added in order; where their squares leave its range, scaled first."""
    total = np.zeros(len(rows))
    with np.errstate(over="ignore"):
        for i in range(rows.shape[1]):
            gap = rows[:, i] - query[i]
            total += gap * gap
    for i in np.flatnonzero(~np.isfinite(total) | (total < 1e-290)):
        largest = max(float(np.abs(rows[i]).max()), float(np.abs(query).max())) or 1.0
        part = math.sqrt(math.fsum((a / largest - b / largest) ** 2 for a, b in zip(rows[i].tolist(), query.tolist()))) * largest
        total[i] = part * part if 1e-290 < part * part < np.inf else -part  # as it is
    return np.where(total < 0, -total, np.sqrt(np.abs(total)))


def nearest(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", queries: F.Column | None = None, k: int = 10) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k nearest other rows by Euclidean distance.

    queries is a condition on vec_id (default: divisible by 100). Rows whose id or vector is null, or whose vector
    is empty, zero or holds a null or non-finite component, take no part; vectors of different dimensions are not
    compared. Components may be of any finite size. Ties go to the smaller vec_id; a repeated vec_id is found once, at its
    smallest distance, and a query never finds its own id. A query without candidates has no rows, and an empty table
    gives none. The error bounds hold for every pair, so no neighbour is lost.
    """
    rows = usable(df, id_col, vector_col, zero=False)

    def tile(q_ids, q, q_more, c_ids, c, c_more, heaps):
        (qs, qe, q2, qc), (cs, ce, c2, cc) = dequantised(q_more, *q.shape), dequantised(c_more, *c.shape)
        unit = max(qs, cs)  # all bounds in units of the larger scale, so that no square leaves the range of doubles
        qs, cs = qs / unit, cs / unit
        about = np.sqrt(np.maximum((q2 * qs * qs)[:, None] + (c2 * cs * cs)[None, :] - 2 * qs * cs * products(qc, cc), 0))
        error = (qe * qs)[:, None] + (ce * cs)[None, :] + 1e-6 * (about + qs + cs)
        other = q_ids[:, None] != c_ids[None, :]
        distinct = len(np.unique(c_ids)) == len(c_ids)
        for i in range(len(q_ids)):
            limit = np.inf
            if distinct and len(c_ids) > k:
                limit = np.partition(np.where(other[i], about[i] + error[i], np.inf), k - 1)[k - 1]
            if len(heaps[i]) == k:
                limit = min(limit, heaps[i][-1][0] / unit * (1 + 1e-9))
            near = np.flatnonzero((about[i] - error[i] <= limit) & other[i])
            if len(near):
                yield i, sorted(zip(distances(c[near], q[i]).tolist(), c_ids[near].tolist()))

    return search(rows, rows.filter(queries if queries is not None else F.col("vec_id") % 100 == 0), k, (quantised, quantised), tile, "double", largest=False)


def pivots_of(sample: np.ndarray, n: int) -> np.ndarray:
    """Up to n rows of a sample, each the farthest from those before it."""
    if not len(sample):
        return sample
    chosen = [0]
    far = ((sample - sample[0]) ** 2).sum(axis=1)
    while len(chosen) < min(n, len(sample)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((sample - sample[chosen[-1]]) ** 2).sum(axis=1))
    return sample[chosen]


def pivot_table(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1)[None, :] - 2 * x @ pivots.T, 0)).astype("<f4")


def exact_scores(rows: np.ndarray, query: np.ndarray, largest: float) -> np.ndarray:
    """Inner products of whole numbers up to `largest` in size: in double precision where no sum reaches 2 ** 53, else
    in Python's integers; beyond 64 bits they are kept at the end of the range."""
    if largest * largest * len(query) < 2.0**53:
        return (rows @ query).astype(np.int64)
    whole = [int(x) for x in query]
    return np.array([max(-(2**63) + 1, min(2**63 - 1, sum(int(a) * b for a, b in zip(r, whole)))) for r in rows], np.int64)


#: Largest finite double: what a component that leaves the range by scaling is held at.
LARGEST = float(np.finfo(np.float64).max)


def scaled_floor(x: F.Column, scale: int) -> F.Column:
    """floor(scale * x) as a double; from 2 ** 52 on a double is whole."""
    y = F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), x * float(scale)))
    return F.when(F.abs(y) < float(1 << 52), F.floor(y).cast("double")).otherwise(y)


def top_products(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", queries: F.Column | None = None, k: int = 5, scale: int = 256, n_pivots: int = 64, sample: int = 1000) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k largest inner products of floor(scale * component).

    queries is a condition on vec_id (default: divisible by 50). Rows whose id or vector is null, or whose vector
    is empty or holds a null or non-finite component, take no part; vectors of different dimensions are not
    compared. Ties go to the smaller vec_id; a repeated vec_id is found once, at its highest score, and a query
    never finds its own id. A query without candidates has no rows, and an empty table gives none. The pivots (at most
    MOST_PIVOTS) come from `sample` rows drawn by a hash of the id; they decide how much is evaluated, never what is
    found. Scores beyond 64 bits are held at the ends of that range.
    """
    if not 0 <= n_pivots <= MOST_PIVOTS:
        raise ValueError(f"at most {MOST_PIVOTS} pivots")
    rows = usable(df, id_col, vector_col, zero=True).withColumn("v", F.transform("v", lambda x: scaled_floor(x, scale)))
    drawn = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("v").collect()
    by_dim: dict[int, list] = {}
    for r in drawn:
        by_dim.setdefault(len(r["v"]), []).append(r["v"])
    # of the dimensions that the sample has; candidates of others are all evaluated
    norms = rows.filter(F.size("v").isin(*by_dim)).groupBy(F.size("v").alias("dim")).agg(F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)).alias("square"))
    largest_square = {r["dim"]: r["square"] for r in norms.collect() if r["square"] < 1e300} if by_dim else {}

    def lifted(x: np.ndarray) -> np.ndarray:
        """One more component gives all candidates the same norm, so that the nearest has the largest product."""
        rest = largest_square[x.shape[1]] - (x * x).sum(axis=1)
        return np.hstack([x, np.sqrt(np.maximum(rest, 0))[:, None]])

    pivots = {dim: pivots_of(lifted(np.array(by_dim[dim])), n_pivots) for dim in largest_square if n_pivots}
    flat = lambda x: np.hstack([x, np.zeros((len(x), 1))])
    table = lambda lift: lambda x: pivot_table(lift(x), pivots[x.shape[1]]).tobytes() if x.shape[1] in pivots else b""

    def tile(q_ids, q, q_more, c_ids, c, c_more, heaps):
        bound = np.zeros((len(q), len(c)), np.float32)
        if c_more:
            of_c, of_q = (np.ascontiguousarray(np.frombuffer(m, "<f4").reshape(len(x), -1).T) for m, x in ((c_more, c), (q_more, q)))
            gap = np.empty_like(bound)
            for of_one_c, of_one_q in zip(of_c, of_q):
                np.subtract(of_one_c[None, :], of_one_q[:, None], out=gap)
                np.maximum(bound, np.abs(gap, out=gap), out=bound)
        with np.errstate(over="ignore"):
            total = (q * q).sum(axis=1) + (largest_square[c.shape[1]] if c_more else np.inf)
        largest = max(np.abs(c).max(), np.abs(q).max())
        for i in range(len(q_ids)):
            slack = 1e-5 * total[i] + 1  # of rounding
            most = (total[i] - bound[i] ** 2) / 2 + slack
            best: list[tuple[int, int]] = list(heaps[i])
            order = np.flatnonzero(most >= -best[k - 1][0]) if len(best) == k else np.arange(len(most))
            order = order[np.argsort(-most[order])]
            at, step = 0, 128
            while at < len(order) and (len(best) < k or most[order[at]] >= -best[k - 1][0]):
                next_ones = order[at : at + step]
                next_ones = next_ones[c_ids[next_ones] != q_ids[i]]
                scores = exact_scores(c[next_ones], q[i], largest)
                if len(best) == k:
                    next_ones, scores = next_ones[good := scores >= -best[k - 1][0]], scores[good]
                merged: dict[int, int] = {}
                for value, vec_id in heapq.merge(best, sorted(zip((-scores).tolist(), c_ids[next_ones].tolist()))):
                    merged.setdefault(vec_id, value)
                    if len(merged) == k:
                        break
                best = [(value, vec_id) for vec_id, value in merged.items()]
                at, step = at + step, step * 4
            yield i, best

    return search(rows, rows.filter(queries if queries is not None else F.col("vec_id") % 50 == 0), k, (table(lifted), table(flat)), tile, "long", largest=True)
