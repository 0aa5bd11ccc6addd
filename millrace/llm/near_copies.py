"""Near copies of documents: a Jaccard join of their word n-gram sets by chosen paths.

Documents with one and the same set of n-grams form a class. Over the classes, each of several runs draws a few
n-grams of every set by a hash that all sets share, at a rate of 1 / (threshold * size): two sets at the threshold or
above then draw a common one with a fixed probability. Sets that drew the same n-gram meet in a bucket; a bucket
that is too large is split once more by n-grams drawn at the next level. Buckets are compared by brute force, exactly,
those that stay large in tiles of two blocks. The number of runs follows from the target recall of pairs that meet only
in buckets that are split. Buckets with the same least member are compared as one bucket.

A bucket never writes out its pairs: it returns, for each of its sets, the links counted there (a pair counts in the
first bucket it shares) and an edge to the least set of its local component. Components of those edges are the
classes of near copies.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from fractions import Fraction
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import cut, id_and_text, sieve, sifted, slices, texts_of
from .chunks import spread
from .components import components, with_facts

#: Sets of a block that is compared by brute force, and levels of draws: the last ones split buckets above that size.
BLOCK, LEVELS = 512, 2
RECALL = 0.9999
#: n-grams of a block on average at most, and bytes of a batch of n-gram sets in a worker.
BLOCK_GRAMS, BATCH_BYTES = 1 << 20, 8 << 20
#: Draws of a set are told apart by so many slots, a run and a level each.
SLOTS = 64


def runs_for(recall: float) -> int:
    """Runs after which a pair at the threshold has met with this probability, even if all its buckets are split.

    A level gives it a common draw with at least 1 - 1/e, and in a run it needs one on every level.
    """
    return math.ceil(math.log(1 - recall) / math.log(1 - (1 - 1 / math.e) ** LEVELS))


def finish(h: np.ndarray) -> np.ndarray:
    """Mix the bits of 64-bit hashes."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_sets(texts: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-gram hashes of each text, one text after another, and how many each has.

    Words are runs of characters other than ASCII white space. A text of fewer than n words has one n-gram, all of
    its words; a text without words has none.
    """
    words = [t.encode().split() for t in texts]
    counts = np.fromiter(map(len, words), np.int64, len(words))
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, chain.from_iterable(words)), np.uint64, int(counts.sum()))
    grams = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    at = spread(np.cumsum(counts) - counts, grams)
    width = np.minimum(np.repeat(counts, grams), n)
    mixed = width.astype(np.uint64)
    for i in range(n):
        inside = width > i
        mixed[inside] = finish(mixed[inside] * np.uint64(0x9E3779B97F4A7C15) + hashes[at[inside] + i])
    ends = np.cumsum(grams)
    sets = [np.unique(mixed[e - g : e]) for e, g in zip(ends.tolist(), grams.tolist())]
    return (np.concatenate(sets) if sets else mixed), np.fromiter(map(len, sets), np.int64, len(sets))


def digests(flat: np.ndarray, counts: np.ndarray) -> list[bytes | None]:
    """128 bits for each set; None for an empty one."""
    data, ends = flat.tobytes(), (np.cumsum(counts) * 8).tolist()
    return [hashlib.blake2b(data[e - 8 * n : e], digest_size=16).digest() if n else None for e, n in zip(ends, counts.tolist())]


def drawn(flat: np.ndarray, counts: np.ndarray, threshold: float, runs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner, slot (run * LEVELS + level) and n-gram of every draw."""
    rate = np.minimum(2.0**64 / (threshold * np.maximum(counts, 1)), 2.0**64 - 2048).astype(np.uint64)
    owner = np.repeat(np.arange(len(counts)), counts)
    limit = rate[owner]
    found = []
    for slot in range(runs * LEVELS):
        seed = np.uint64(xxhash.xxh3_64_intdigest(b"draw %d" % slot))
        hit = np.flatnonzero(finish(flat ^ seed) < limit)
        found.append((owner[hit], np.full(len(hit), slot), flat[hit]))
    owners, slots, grams = (np.concatenate(x) for x in zip(*found))
    order = np.argsort(owners, kind="stable")
    return owners[order], slots[order], grams[order]


def sketch(df: DataFrame, n: int, threshold: float, runs: int) -> DataFrame:
    """doc_id, key, node (digest of the n-gram set, null if empty), size and draws of every row of (doc_id, text, key).

    A draw is the n-gram's hash with the slot in its lowest bits.
    """

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                flat, counts = shingle_sets(texts_of(part, "text"), n)
                owner, slot, gram = drawn(flat, counts, threshold, runs)
                offsets = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(counts)))]).astype(np.int32)
                items = pa.array((gram & ~np.uint64(SLOTS - 1) | slot.astype(np.uint64)).view(np.int64), pa.int64())
                columns = [part.column("doc_id"), part.column("key"), pa.array(digests(flat, counts), pa.binary()), pa.array(counts, pa.int64()), pa.ListArray.from_arrays(offsets, items)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "key", "node", "size", "draws"])

    return df.mapInArrow(make, "doc_id long, key binary, node binary, size long, draws array<long>")


def of_level(d: Column, level: int) -> Column:
    return d.bitwiseAND(SLOTS - 1) % LEVELS == level


def run_of(d: Column) -> Column:
    return F.floor(d.bitwiseAND(SLOTS - 1) / LEVELS)


def sized(level: DataFrame) -> DataFrame:
    """node, bucket and what the level has beside them, with the bucket's sets (n) and its least member (leader), of buckets with at least two."""
    sizes = level.groupBy("bucket").agg(F.count("*").alias("n"), F.min(F.xxhash64("node")).alias("leader"))
    return cut(level.join(sizes.filter("n > 1"), "bucket"))


def buckets(nodes: DataFrame, block: int) -> DataFrame:
    """bucket, n, grams, node: groups of sets that meet, with their sets and n-grams.

    The draws of the second level are taken from a set's own row, one row for each set in a large bucket, so what is
    joined and shuffled for the split grows with the sets and not with their draws. Buckets with one least member are
    compared as one: near copies share most of their buckets, and so a pair of them is not compared in each.
    """
    first = sized(nodes.select("node", F.explode(F.filter("draws", lambda d: of_level(d, 0))).alias("d")).select("node", "d", F.xxhash64("d").alias("bucket")))
    small, large = first.filter(F.col("n") <= block), first.filter(F.col("n") > block)
    members = small.select(F.col("leader").alias("bucket"), "node")
    if not large.isEmpty():
        inside = large.groupBy("node").agg(F.collect_list("d").alias("held"))  # a few a run
        second = lambda h: F.transform(F.filter("draws", lambda d: of_level(d, 1) & (run_of(d) == run_of(h))), lambda d: F.xxhash64(h, d))
        split = inside.join(nodes.select("node", "draws"), "node").select("node", F.explode(F.array_distinct(F.flatten(F.transform("held", second)))).alias("bucket"))
        members = members.union(sized(split).select(F.col("leader").alias("bucket"), "node"))
    members = cut(members.groupBy("node").agg(F.collect_set("bucket").alias("buckets")).join(nodes.select("node", "size"), "node").select("node", "size", F.explode("buckets").alias("bucket")))
    return members.join(members.groupBy("bucket").agg(F.count("*").alias("n"), F.sum("size").alias("grams")), "bucket").select("bucket", "n", "grams", "node")


def compare(sets: list[np.ndarray], threshold: Fraction) -> np.ndarray:
    """Which pairs of sets have a Jaccard similarity of the threshold or more (none with itself)."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    tokens, index, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    shared = times[index] > 1
    column = np.cumsum(times > 1) - 1
    owner, column = owner[shared], column[index[shared]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    common = np.zeros((len(sets), len(sets)), np.float64)
    width = 4096
    edges = np.searchsorted(column, np.arange(0, (int(column[-1]) + 1 if len(column) else 0) + width, width))
    for i, (a, b) in enumerate(zip(edges[:-1], edges[1:])):
        if a < b:
            part = np.zeros((len(sets), min(width, int(column[b - 1]) - i * width + 1)), np.float32)
            part[owner[a:b], column[a:b] - i * width] = 1
            common += part @ part.T
    common = common.astype(np.int64)
    p, q = threshold.numerator, threshold.denominator
    alike = common * q >= p * (sizes[:, None] + sizes[None, :] - common)
    np.fill_diagonal(alike, False)
    return alike


def joined(group: list[tuple], bucket: int, one_block: bool, threshold: Fraction) -> list[tuple]:
    """The links and the edge of each member of a bucket, or of a tile of two of its blocks.

    A member is (node, copies, buckets it is in, n-grams, block). In a tile of two blocks pairs within a block
    count only in the block's own tile.
    """
    by_node = {g[0]: g for g in group}
    group = [by_node[k] for k in sorted(by_node)]
    if len(group) < 2:
        return []
    alike = compare([g[3] for g in group], threshold)
    if not one_block:
        block = np.array([g[4] for g in group])
        alike &= block[:, None] != block[None, :]
    if not alike.any():
        return []
    least = np.arange(len(group))
    while True:
        near = np.minimum(least, np.where(alike, least[None, :], len(group)).min(axis=1))
        near = np.minimum(near, near[near])
        if (near == least).all():
            break
        least = near
    ids, index = np.unique(np.concatenate([g[2] for g in group]), return_inverse=True)
    earlier = np.zeros((len(group), len(ids)), np.float32)
    earlier[np.repeat(np.arange(len(group)), [len(g[2]) for g in group]), index] = 1
    earlier = earlier[:, ids < bucket]
    counted = alike & (earlier @ earlier.T == 0)
    copies = np.array([g[1] for g in group], np.int64)
    links, kinds = counted @ copies, counted.sum(axis=1)
    return [(g[0], group[r][0], int(n), int(k)) for g, r, n, k, linked in zip(group, least, links, kinds, alike.any(axis=1)) if linked]


def brute_force(texts: DataFrame, wanted: DataFrame, n: int, threshold: Fraction, block: int) -> DataFrame:
    """node, root, links, texts of every set that is linked in a bucket; wanted: key, node, copies, buckets (with n, grams).

    One text of each wanted set is read, by the digest of the text. A bucket is compared in tiles of two blocks of
    about `block` sets, or fewer where they hold more than BLOCK_GRAMS n-grams.
    """
    tiles = "bucket long, low int, high int, block int, node binary, copies long, buckets binary, grams binary"
    names = [c.split()[0] for c in tiles.split(", ")]
    types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.binary(), pa.binary()]

    def spread_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for part in slices(batch, "text"):
                flat, counts = shingle_sets(texts_of(part, "text"), n)
                ends = np.cumsum(counts)
                for i, (r, digest) in enumerate(zip(part.select(["copies", "buckets"]).to_pylist(), digests(flat, counts))):
                    grams = flat[ends[i] - counts[i] : ends[i]].tobytes()
                    mine = np.array(sorted(b["bucket"] for b in r["buckets"]), "<i8").tobytes()
                    for b in r["buckets"]:
                        n_blocks = max(-(-b["n"] // block), -(-b["grams"] // BLOCK_GRAMS))
                        own = int.from_bytes(digest[:8], "little") % n_blocks
                        for o in range(n_blocks):
                            rows.append((b["bucket"], min(own, o), max(own, o), own, digest, r["copies"], mine, grams))
                            held += len(grams) + len(mine) + 64
                            if held > BATCH_BYTES:
                                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
                                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    asked = sifted(texts, sieve(wanted, "key"), "key").groupBy("key").agg(F.first("text").alias("text"))  # copies once
    rows = asked.join(wanted, "key").select("text", "copies", "buckets").mapInArrow(spread_out, tiles)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group, out = None, [], []

        def flush() -> Iterator[pa.RecordBatch]:
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.binary(), pa.binary(), pa.int64(), pa.int64()))], ["node", "root", "links", "texts"])
                out.clear()

        for batch in batches:
            for part in slices(batch, "grams", BATCH_BYTES):
                for r in part.to_pylist():
                    now = (r["bucket"], r["low"], r["high"])
                    if now != key:
                        if len(group) > 1:
                            out += joined(group, key[0], key[1] == key[2], threshold)
                        key, group = now, []
                        if len(out) > 5000:
                            yield from flush()
                    group.append((r["node"], r["copies"], np.frombuffer(r["buckets"], "<i8"), np.frombuffer(r["grams"], "<u8"), r["block"]))
        if len(group) > 1:
            out += joined(group, key[0], key[1] == key[2], threshold)
        yield from flush()

    return rows.repartition("bucket", "low", "high").sortWithinPartitions("bucket", "low", "high").mapInArrow(meet, "node binary, root binary, links long, texts long")


def near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, threshold: str = "0.8", recall: float = RECALL, block: int = BLOCK, keep_first: bool = False) -> DataFrame:
    """doc_id, class_id, copy_of, n_links, n_texts of every row: its class of near copies and its links.

    Two documents are linked if the Jaccard similarity of their sets of word n-grams is the threshold or more.
    class_id is the least doc_id of the connected component, copy_of the least doc_id with the same n-gram set,
    n_links the number of other documents linked, n_texts that of other n-gram sets linked. A null text counts as
    empty. A text without words is linked to nothing and is its own class; a row with a null id takes part, and ids
    of classes whose rows all have null ids are null. A repeated row is a copy of its first, and rows may share an id.
    A very long text is one set like any other; the more n-grams a bucket holds, the more blocks it is compared in. An
    empty table gives no rows. Other columns are left out, whatever their names.

    With keep_first also key (the MD5 of the text, empty for a null) and is_first: whether the row has the least id (a
    null is the largest) and, of those, the least key of its class. A text without words is the first of its class.
    """
    texts = id_and_text(df, id_col, text_col).withColumn("key", F.coalesce(F.unhex(F.md5("text")), F.lit(b"")))
    runs = runs_for(recall)
    if runs * LEVELS > SLOTS:
        raise ValueError(f"a recall of {recall} takes more than {SLOTS // LEVELS} runs")
    rows = cut(sketch(texts, n, float(Fraction(threshold)), runs))
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key")
    nodes = cut(rows.filter("node IS NOT NULL").groupBy("node").agg(F.min(place).alias("place"), F.min("key").alias("key"), F.count("*").alias("copies"), F.first("size").alias("size"), F.first("draws").alias("draws")))
    held = buckets(nodes, block).groupBy("node").agg(F.collect_list(F.struct("bucket", "n", "grams")).alias("buckets"))  # a few a run
    wanted = cut(nodes.select("key", "node", "copies").join(held, "node"))
    found = cut(brute_force(texts, wanted, n, Fraction(threshold), block))
    links = found.groupBy("node").agg(F.sum("links").alias("links"), F.sum("texts").alias("texts"))
    roots = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    classed = cut(nodes.select("node", "place", "copies").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    least = classed.groupBy("root").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    by_node = cut(with_facts(classed, least, "root", classed.count()).join(links, "node", "left").withColumn("n", F.col("copies")))
    every, known = rows.select("doc_id", "key", "node"), rows.filter("node IS NOT NULL").count()
    alone = every.filter("node IS NULL").select("doc_id", "key", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("copy_of"), F.lit(0).cast("long").alias("n_links"), F.lit(0).cast("long").alias("n_texts"), F.lit(True).alias("is_first"))
    others = with_facts(every.filter("node IS NOT NULL"), by_node, "node", known).select(
        "doc_id", "key", F.col("first.doc_id").alias("class_id"), F.col("place.doc_id").alias("copy_of"),
        (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).cast("long").alias("n_links"), F.coalesce("texts", F.lit(0)).cast("long").alias("n_texts"), (place == F.col("first")).alias("is_first"),
    )
    return others.union(alone).select("doc_id", "class_id", "copy_of", "n_links", "n_texts", *(["key", "is_first"] if keep_first else []))
