"""Hard negatives by exact integer scores from a residue number system.

Vectors of whole numbers are packed into blocks. A block of anchors meets a block of candidates as residues modulo
several small primes: each product of residue matrices is exact in single precision, and Chinese remaindering (Garner's
mixed radix with symmetric digits) puts the signed scores together. How many primes are needed follows from the largest
components of the two blocks.

Two passes go over the candidates. The first keeps each anchor's best rows of its own label, its positives; products are
taken label by label there. The second keeps, for every positive, the best rows of other labels whose score lies in the
window that the positive's score gives. What leaves a task is a few rows for each anchor or positive.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import cut
from .vectors import BLOCK, BROADCAST_BYTES, QUERY_BLOCK, scaled_floor, usable

#: Odd primes, first those below 256 from the largest down, then the larger ones: all together they hold any score of doubles.
PRIMES = [p for p in (*range(251, 2, -2), *range(257, 2048, 2)) if all(p % q for q in range(3, int(p**0.5) + 1, 2))]
#: Whole numbers below this are exact in single precision.
EXACT = 1 << 24


@cache
def moduli(bound: int) -> tuple[int, ...]:
    """Primes whose product exceeds four times the bound of a score."""
    product = 1
    for n, p in enumerate(PRIMES, 1):
        product *= p
        if product > 4 * bound:
            return tuple(PRIMES[:n])
    raise ValueError("scores of doubles do not get this large")


def residues(x: np.ndarray, p: int) -> np.ndarray:
    """x modulo p between -(p - 1) / 2 and (p - 1) / 2, exact for whole doubles of any size."""
    rest = np.fmod(x, p)
    return (rest - p * np.rint(rest / p)).astype(np.float32)


def reduced(x: np.ndarray, p: int) -> np.ndarray:
    """Whole numbers of single precision modulo p, in place; the quotient may be one off, which leaves the residue congruent."""
    x -= np.float32(p) * np.rint(x / np.float32(p))
    return x


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of whole rows of a and b as 64-bit integers, exact; beyond 64 bits they are held at the ends of the range."""
    bound = a.shape[1] * int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0))
    primes = moduli(bound)
    digits: list[np.ndarray] = []
    for p in primes:
        ra, rb = residues(a, p), residues(b, p).T
        chunk = (EXACT - 1) // ((p - 1) // 2) ** 2
        total = np.zeros((len(a), len(b)), np.float32)
        for i in range(0, a.shape[1], chunk):
            total += reduced(ra[:, i : i + chunk] @ rb[i : i + chunk], p)
        total = reduced(total, p)
        for q, digit in zip(primes, digits):  # the digit of p: what is left after those of the primes before it
            inverse = pow(q, -1, p)
            total = reduced(reduced(total - digit, p) * np.float32(inverse - p if inverse > p // 2 else inverse), p)
        digits.append(total)
    if bound < 2**63:
        out = digits[-1].astype(np.int64)
        for p, digit in zip(primes[-2::-1], digits[-2::-1]):
            out = out * p + digit.astype(np.int64)
        return out
    out = digits[-1].astype(np.int64).astype(object)
    for p, digit in zip(primes[-2::-1], digits[-2::-1]):
        out = out * p + digit.astype(np.int64)
    return np.array([[max(1 - 2**63, min(2**63 - 1, int(x))) for x in row] for row in out], np.int64).reshape(out.shape)


#: A row of these is a block: n ids and labels, data row by row, and for anchors the positives' ids, scores and number.
PACKED = ["dim", "ids", "labels", "data", "p_ids", "p_scores", "p_counts"]


def packed(rows: DataFrame, block: int) -> DataFrame:
    """Blocks of up to `block` rows of one dimension. Whole numbers that fit go as 16-bit integers, else as doubles."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = {}

        def out(dim: int) -> pa.RecordBatch:
            part = held.pop(dim)
            data = np.concatenate([r[2] for r in part])
            small = np.abs(data).max(initial=0) < 2**15
            joined = lambda i: np.array([x for r in part for x in r[i]], "<i8").tobytes()
            cells = [np.array([r[0] for r in part], "<i8").tobytes(), np.array([r[1] for r in part], "<i8").tobytes(), data.astype("<i2" if small else "<f8").tobytes(), joined(3), joined(4), np.array([len(r[3]) for r in part], "<i8").tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), *(pa.array([c], pa.binary()) for c in cells)], PACKED)

        for batch in batches:
            lists = batch.column("v")
            flat, offsets = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            ids, labels, p_ids, p_scores = (batch.column(c).to_pylist() for c in ("vec_id", "label", "p_ids", "p_scores"))
            for i in range(batch.num_rows):
                vector = flat[offsets[i] : offsets[i + 1]]
                held.setdefault(len(vector), []).append((ids[i], labels[i], vector, p_ids[i] or [], p_scores[i] or []))
                if len(held[len(vector)]) == block:
                    yield out(len(vector))
        for dim in list(held):
            yield out(dim)

    return rows.mapInArrow(pack, "dim int, ids binary, labels binary, data binary, p_ids binary, p_scores binary, p_counts binary")


def opened(dim: int, ids: bytes, labels: bytes, data: bytes, p_ids: bytes, p_scores: bytes, p_counts: bytes) -> tuple:
    """ids, labels, vectors as doubles, and the positives of each row as (ids, scores)."""
    ids, labels, p_ids, p_scores, p_counts = (np.frombuffer(x, "<i8") for x in (ids, labels, p_ids, p_scores, p_counts))
    kind = "<i2" if len(data) == 2 * dim * len(ids) else "<f8"
    at = np.concatenate([[0], np.cumsum(p_counts)])
    positives = [(p_ids[i:j], p_scores[i:j]) for i, j in zip(at, at[1:])]
    return ids, labels, np.frombuffer(data, kind).reshape(-1, dim).astype(np.float64), positives


Best = list[tuple[int, int]]


def meet(rows: DataFrame, anchors: DataFrame, bytes_of_anchors: int, tile: Callable[[tuple, tuple, dict[tuple, Best]], None]) -> DataFrame:
    """anchor_id, positive_id, other_id, score: what tile(anchor block, candidate block, kept) leaves in kept over all pairs of blocks.

    kept maps (anchor, positive or None) to (-score, id), best first, and goes on over the pairs that a task sees. Anchors of up to
    BROADCAST_BYTES are sent once to each worker; beyond that the blocks of both sides, written once, are dealt out pair by pair.
    """
    names = ["anchor_id", "positive_id", "other_id", "score"]
    schema = "anchor_id long, positive_id long, other_id long, score long"
    blocks, asked = packed(rows, BLOCK), packed(anchors, QUERY_BLOCK)

    def kept_rows(kept: dict[tuple, Best]) -> pa.RecordBatch:
        flat = [(a, p, v, -s) for (a, p), best in kept.items() for s, v in best]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in flat], pa.int64()) for i in range(4)], names)

    if bytes_of_anchors <= BROADCAST_BYTES:
        sent = rows.sparkSession.sparkContext.broadcast([tuple(r) for r in asked.collect()])

        def every(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            kept: dict[tuple, Best] = {}
            mine = [(r[0], opened(*r)) for r in sent.value]
            for batch in batches:
                for r in batch.to_pylist():
                    block = opened(*(r[c] for c in PACKED))
                    for dim, q in mine:
                        if dim == r["dim"]:
                            tile(q, block, kept)
            yield kept_rows(kept)

        return blocks.mapInArrow(every, schema)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[tuple, Best] = {}
        for batch in batches:
            for r in batch.to_pylist():
                if r["dim"] == r["q_dim"]:
                    tile(opened(*(r[f"q_{c}"] for c in PACKED)), opened(*(r[c] for c in PACKED)), kept)
        yield kept_rows(kept)

    return cut(blocks).crossJoin(cut(asked).select(*(F.col(c).alias(f"q_{c}") for c in PACKED))).mapInArrow(pairs, schema)


def keep(kept: dict[tuple, Best], key: tuple, values: np.ndarray, ids: np.ndarray, k: int) -> None:
    """Merge the k best of new candidates into those kept: higher values first, ties to the smaller id."""
    if len(values) > k:
        values, ids = values[near := values >= np.partition(values, len(values) - k)[len(values) - k]], ids[near]
    if len(values):
        kept[key] = sorted([*kept.get(key, ()), *zip((-values).tolist(), ids.tolist())])[:k]


def best(found: DataFrame, k: int, *keys: str) -> DataFrame:
    """The k best rows of each key over all tasks, with their rank from 1."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "other_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def hard_negatives(
    df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", anchors: F.Column | None = None,
    n_positives: int = 5, n_negatives: int = 3, low: Fraction = Fraction(1, 2), high: Fraction = Fraction(19, 20), scale: int = 256,
) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    Scores are inner products of floor(scale * component). An anchor's positives are its n_positives best other rows of
    its label; for each, its negatives are the n_negatives best rows of other labels with a score from low to high times
    the positive's. Ties go to the smaller id. anchors is a condition on vec_id (default: divisible by 50). Rows whose
    id, label or vector is null, or whose vector is empty or holds a null or non-finite component, take no part; vectors
    of different dimensions are not compared. A repeated id stands once, with the least (label, vector) of its rows. An
    anchor without positives, and a positive without a row in its window, has no rows; an empty table gives none. Scores
    are exact up to 64 bits and are held at the ends of that range beyond.
    """
    part = usable(df.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("v"), F.col(label_col).cast("long").alias("label")).filter("label is not null"), "vec_id", "v", True, "label")
    part = part.withColumn("v", F.transform("v", lambda x: scaled_floor(x, scale)))
    chosen = anchors if anchors is not None else F.col("vec_id") % 50 == 0
    rows = part.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("r")).select("vec_id", "r.label", "r.v", chosen.alias("is_anchor"))
    none = F.lit(None).cast("array<long>")
    rows = cut(rows).withColumns({"p_ids": none, "p_scores": none})
    n, n_anchors, size = rows.agg(F.count("*"), F.count_if("is_anchor"), F.sum(F.when(F.col("is_anchor"), 8 * (F.size("v") + 3 + 2 * n_positives)))).first()
    rows = rows.repartition(max(1, -(-n // BLOCK), min(n // 64, rows.sparkSession.sparkContext.defaultParallelism)))
    asked = lambda rows: rows.repartition(max(1, -(-n_anchors // QUERY_BLOCK)))

    def positives_of(q: tuple, c: tuple, kept: dict[tuple, Best]) -> None:
        for label in np.intersect1d(q[1], c[1]):
            mine, theirs = np.flatnonzero(q[1] == label), np.flatnonzero(c[1] == label)
            ids = c[0][theirs]
            for i, line in zip(mine, scores(q[2][mine], c[2][theirs])):
                other = ids != q[0][i]
                keep(kept, (int(q[0][i]), None), line[other], ids[other], n_positives)

    found = best(meet(rows, asked(rows.filter("is_anchor")), size or 0, positives_of), n_positives, "anchor_id")
    lists = found.groupBy("anchor_id").agg(F.collect_list("other_id").alias("p_ids"), F.collect_list("score").alias("p_scores"))  # n_positives at most
    with_lists = cut(rows.filter("is_anchor").drop("p_ids", "p_scores").join(lists, F.col("vec_id") == F.col("anchor_id")).drop("anchor_id"))

    def negatives_of(q: tuple, c: tuple, kept: dict[tuple, Best]) -> None:
        whole = scores(q[2], c[2])
        for i, line in enumerate(whole):
            other = c[1] != q[1][i]
            line, ids = line[other], c[0][other]
            for p, score in zip(*(x.tolist() for x in q[3][i])):
                least, most = -(-score * low.numerator // low.denominator), score * high.numerator // high.denominator
                if least <= most:
                    key = (int(q[0][i]), p)
                    if len(kept.get(key, ())) == n_negatives:
                        least = max(least, -kept[key][-1][0])
                    inside = (line >= least) & (line <= most)
                    keep(kept, key, line[inside], ids[inside], n_negatives)

    negatives = best(meet(rows, asked(with_lists), size or 0, negatives_of), n_negatives, "anchor_id", "positive_id")
    pairs = with_lists.select(F.col("vec_id").alias("anchor_id"), F.explode(F.arrays_zip("p_ids", "p_scores")).alias("p")).select("anchor_id", F.col("p.p_ids").alias("positive_id"), F.col("p.p_scores").alias("positive_score"))
    return negatives.join(pairs, ["anchor_id", "positive_id"]).select("anchor_id", "positive_id", "rank", F.col("other_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
