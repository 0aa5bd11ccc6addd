"""SimHash near-dedup by the generalised pigeonhole principle.

A text's fingerprint has the bits that more than half of the hashes of its word shingles have. Fingerprints that differ in
at most `most` bits are linked, and the components of the links are the groups.

The bits are dealt into PARTS groups of equal width such that correlated bits share a group, which keeps the other groups
selective. If thresholds t_i of the groups satisfy sum(t_i + 1) = most + 1, any two linked fingerprints differ by at most t_i
in some group i. Every fingerprint gets thresholds of its own by dynamic programming: from the counts of all values of
each group it knows how many fingerprints it would meet at each threshold, and takes the cheapest allocation; a group where
its value is common may get -1, no probe at all. It then probes the values within its thresholds that occur.

Members of a value and those who probe it are cut into blocks of about BLOCK by hash, every block of members meets every
block of probes in a bucket of its own, and a bucket returns a spanning forest of its links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import cut, id_and_text
from .components import components, with_facts

#: Groups of bits, and bits of one: its counts are a table of 2 ** WIDTH numbers whatever the data.
PARTS, WIDTH = 4, 16
#: Members of a value, or probes of it, that meet in one bucket.
BLOCK = 1 << 14
#: Pairs compared at once, and what a probe costs beside a comparison: it is a row that is shuffled.
CHUNK, PROBE_COST = 1 << 20, 16
#: Largest threshold of one group.
LARGEST = 2
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def fingerprint(text: str | None, n: int = 4, seed: int = 42) -> int:
    """The SimHash of a text's shingles of n words, repeats included; 0 without words."""
    words = (text or "").encode().translate(LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(n, len(words))
    hashed = xxhash.xxh64_intdigest
    counts, spans = np.zeros(64, np.int64), list(zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist()))
    for at in range(0, len(spans), CHUNK // 64):
        hashes = np.array([hashed(joined[s:e], seed) for s, e in spans[at : at + CHUNK // 64]], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(spans), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, n: int = 4, seed: int = 42) -> DataFrame:
    """doc_id, fp (64 bits as a signed long) of doc_id, text."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py(), n, seed) for t in batch.column("text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found)], ["doc_id", "fp"])

    return docs.mapInArrow(of, "doc_id long, fp long")


def bit_groups(together: np.ndarray, n: int) -> np.ndarray:
    """PARTS rows of WIDTH bits; together counts the fingerprints that have both bits, of n in all.

    Greedy: a group starts with the bit that is most correlated to the bits left and takes up the bit that is most correlated to it.
    """
    share = np.diag(together) / max(n, 1)
    spread = np.sqrt(np.maximum(share * (1 - share), 1e-12))
    related = np.abs((together / max(n, 1) - np.outer(share, share)) / np.outer(spread, spread))
    np.fill_diagonal(related, 0)
    left, groups = list(range(64)), []
    for _ in range(PARTS):
        group = [max(left, key=lambda b: related[b, left].sum())]
        left.remove(group[0])
        while len(group) < WIDTH:
            group.append(max(left, key=lambda b: related[b, group].sum()))
            left.remove(group[-1])
        groups.append(sorted(group))
    return np.array(groups)


def values_of(fps: np.ndarray, groups: np.ndarray) -> np.ndarray:
    """The value of each group of bits, one column a group."""
    bits = fps.view(np.uint64)
    out = np.zeros((len(fps), len(groups)), np.int64)
    for g, group in enumerate(groups):
        for i, b in enumerate(group):
            out[:, g] |= ((bits >> np.uint64(b)) & np.uint64(1)).astype(np.int64) << i
    return out


def balls(counts: np.ndarray) -> np.ndarray:
    """For each value of a group and t = 0 .. LARGEST, the sum of the counts of the values that differ from it in at most t bits."""
    at, width = np.arange(len(counts)), len(counts).bit_length() - 1
    spheres = [counts.astype(np.float64), *(np.zeros(len(counts)) for _ in range(LARGEST))]
    for b in range(width):
        for t in range(LARGEST, 0, -1):
            spheres[t] = spheres[t] + spheres[t - 1][at ^ (1 << b)]
    return np.cumsum(spheres, axis=0).T


def allocation(costs: np.ndarray, most: int) -> np.ndarray:
    """Thresholds of each group for each row, -1 or more, with sum(t + 1) = most + 1 at the least total cost.

    costs: rows x groups x thresholds from 0 on. Ties go to the smaller threshold of the later group.
    """
    rows, parts, levels = costs.shape
    total, need = np.zeros((rows, most + 2)), most + 1
    total[:, 1:] = np.inf
    taken = []
    for g in range(parts):
        options = np.full((levels + 1, rows, need + 1), np.inf)
        options[0] = total
        for t in range(levels):
            options[t + 1, :, t + 1 :] = total[:, : need - t] + costs[:, g, t : t + 1]
        taken.append(options.argmin(axis=0))
        total = options.min(axis=0)
    out, rest = np.zeros((rows, parts), np.int64), np.full(rows, need)
    for g in reversed(range(parts)):
        step = taken[g][np.arange(rows), rest]
        out[:, g], rest = step - 1, rest - step
    return out


def masks(width: int) -> list[np.ndarray]:
    """Masks of exactly t of `width` bits, for t = 0 .. LARGEST."""
    every = np.arange(1 << width)
    ones = np.bitwise_count(every)
    return [every[ones == t] for t in range(LARGEST + 1)]


def placed(fps: DataFrame, groups: np.ndarray, counts: np.ndarray, most: int) -> DataFrame:
    """part, value, block_m, block_p, fp, is_probe: where each fingerprint stands as a member and where it probes.

    counts holds for each group how many fingerprints have each of its values: PARTS * 2 ** WIDTH numbers, sent to the workers once.
    """
    sent = fps.sparkSession.sparkContext.broadcast((groups, counts))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, counts = sent.value
        around = np.stack([balls(c) for c in counts])
        there = np.stack([balls(c > 0) for c in counts])
        costs, flips = around + PROBE_COST * there, masks(WIDTH)
        # blocks of members and of probes at each value; its neighbours probe it in one of PARTS groups on average, PARTS times as often at most
        of_members = np.maximum(1, -(-counts // BLOCK))
        of_probes = np.maximum(1, np.ceil((counts + (around[:, :, 1] - counts) / PARTS) / BLOCK).astype(np.int64))

        def rows(part: int, value: np.ndarray, fp: np.ndarray, is_probe: bool) -> list[np.ndarray]:
            mixed = (fp.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            own, others = (of_probes, of_members) if is_probe else (of_members, of_probes)
            block = (mixed % own[part, value].astype(np.uint64)).astype(np.int64)
            times = others[part, value]
            at = np.repeat(np.arange(len(fp)), times)
            other = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
            mine = block[at]
            m, p = (other, mine) if is_probe else (mine, other)
            return [np.full(len(at), part, np.int32), value[at].astype(np.int32), m.astype(np.int32), p.astype(np.int32), fp[at], np.full(len(at), is_probe)]

        for batch in batches:
            fps = batch.column("fp").to_numpy(zero_copy_only=False)
            for at in range(0, len(fps), 4096):
                fp = fps[at : at + 4096]
                values = values_of(fp, groups)
                cost = np.stack([costs[g][values[:, g]] for g in range(PARTS)], axis=1)
                t, found = allocation(cost, most), []
                for g in range(PARTS):
                    found.append(rows(g, values[:, g], fp, False))
                    for level in range(LARGEST + 1):
                        who = np.flatnonzero(t[:, g] >= level)
                        for mask in flips[level]:
                            probed = values[who, g] ^ mask
                            others = counts[g][probed] > (level == 0)  # at its own value it meets itself
                            if others.any():
                                found.append(rows(g, probed[others], fp[who[others]], True))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found)], ["part", "value", "block_m", "block_p", "fp", "is_probe"])

    return fps.mapInArrow(place, "part int, value int, block_m int, block_p int, fp long, is_probe boolean")


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, least node reached) that connect what the edges (a, b) connect: fewer than there are nodes."""
    nodes, both = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j, label = both[: len(a)], both[len(a) :], np.arange(len(nodes))
    while True:
        least = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], least)
        np.minimum.at(new, label[j], least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    while (label[label] != label).any():
        label = label[label]
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[moved], nodes[label[moved]]


def linked(members: np.ndarray, probes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between the members and the probes of a bucket, compared in chunks."""
    found_a, found_b, step = [], [], max(1, CHUNK // max(1, len(members)))
    for at in range(0, len(probes), step):
        part = probes[at : at + step]
        i, j = np.nonzero(np.bitwise_count(part[:, None] ^ members[None, :]) <= most)
        a, b = forest(part[i], members[j])
        found_a.append(a)
        found_b.append(b)
    return forest(np.concatenate(found_a), np.concatenate(found_b))


def links(fps: DataFrame, groups: np.ndarray, counts: np.ndarray, most: int) -> DataFrame:
    """a, b: edges between fingerprints whose components are those of all links at up to `most` bits."""
    key = ["part", "value", "block_m", "block_p"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by bucket. Small buckets are compared together as one list of pairs; what a batch cuts off waits for the next."""

        def of(bucket: np.ndarray, fp: np.ndarray, is_probe: np.ndarray) -> pa.RecordBatch:
            begins = np.flatnonzero(np.concatenate([[True], (bucket[1:] != bucket[:-1]).any(axis=1)]))
            ends = np.append(begins[1:], len(fp))
            which = np.repeat(np.arange(len(begins)), ends - begins)
            n_members = np.bincount(which[~is_probe], minlength=len(begins))
            n_probes = np.bincount(which[is_probe], minlength=len(begins))
            found_a, found_b = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
            bits = fp.view(np.uint64)
            pairs = n_members * n_probes
            for g in np.flatnonzero(pairs > CHUNK // 16):
                s, e = begins[g], ends[g]
                a, b = linked(bits[s : e - n_probes[g]], bits[e - n_probes[g] : e], most)
                found_a.append(a)
                found_b.append(b)
            small = np.flatnonzero((pairs > 0) & (pairs <= CHUNK // 16))
            for part in np.split(small, np.flatnonzero(np.diff(np.cumsum(pairs[small]) // CHUNK)) + 1) if len(small) else ():
                n = pairs[part]
                g = np.repeat(part, n)
                k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                a, b = bits[begins[g] + k % n_members[g]], bits[begins[g] + n_members[g] + k // n_members[g]]
                near = (a != b) & (np.bitwise_count(a ^ b) <= most)
                found_a.append(a[near])
                found_b.append(b[near])
            a, b = forest(np.concatenate(found_a), np.concatenate(found_b))
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        held: list[tuple[np.ndarray, ...]] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = (np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in key], axis=1), batch.column("fp").to_numpy(zero_copy_only=False), batch.column("is_probe").to_numpy(zero_copy_only=False))
            held, size = [*held, rows], size + batch.num_rows
            bucket = rows[0]
            cuts = np.flatnonzero((bucket != bucket[-1]).any(axis=1))
            last = cuts[-1] + 1 if len(cuts) else 0  # where the last bucket begins in this batch
            if size >= 4 * BLOCK and (last or (held[0][0][-1] != bucket[-1]).any()):
                whole = [np.concatenate(c) for c in zip(*held)]
                at = size - batch.num_rows + last
                yield of(*(c[:at] for c in whole))
                held, size = [tuple(c[at:] for c in whole)], size - at
        if held:
            yield of(*(np.concatenate(c) for c in zip(*held)))

    rows = placed(fps, groups, counts, most).repartition(*key).sortWithinPartitions(*key, "is_probe")
    return rows.mapInArrow(compare, "a long, b long").distinct()


def statistics(fps: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """Groups of bits, the counts of their values, and the number of fingerprints. Sums of all fingerprints in tables of fixed size."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((64, 64))
        for batch in batches:
            bits = np.unpackbits(batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            for i in range(0, len(bits), CHUNK // 16):
                part = bits[i : i + CHUNK // 16].astype(np.float32)
                total += part.T @ part
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(4096, dtype=np.int32)), pa.array(total.ravel().astype(np.int64))], ["at", "n"])

    together = np.zeros(4096, np.int64)
    for r in fps.mapInArrow(pairs, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():  # 4,096 rows
        together[r["at"]] = r["n"]
    n = fps.count()
    groups = bit_groups(together.reshape(64, 64), n)

    def tallied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(PARTS << WIDTH, np.int64)
        for batch in batches:
            values = values_of(batch.column("fp").to_numpy(zero_copy_only=False), groups)
            total += np.bincount((values + (np.arange(PARTS) << WIDTH)).ravel(), minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["at", "n"])

    counts = np.zeros(PARTS << WIDTH, np.int64)
    tally = fps.mapInArrow(tallied, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()  # PARTS * 2 ** WIDTH rows at most
    counts[tally.column("at").to_numpy()] = tally.column("n").to_numpy()
    return groups, counts.reshape(PARTS, -1), n


def simhash_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = 4, n: int = 4, seed: int = 42) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits), component_id: one row for each row of df.

    Words are the runs between ASCII white space, in lower case as far as A-Z goes; a shingle is n words joined by a space
    (of fewer words, all of them), repeats included, hashed by XXH64 of its UTF-8 with the seed. A text that is null or
    has no words has the fingerprint 0, which is linked like any other; a bit that exactly half of the hashes have is 0.
    Fingerprints of at most `most` differing bits (0 to 7) are linked; component_id is the smallest id that links reach from
    a row, its own included. A repeated id has one row for each of its rows. A row without an id gets the component of
    its fingerprint, null if no row with an id is in reach, and still links others. An empty table gives no rows. Texts may have any
    length. No link is lost: thresholds only decide where a pair is met.
    """
    if not 0 <= most < PARTS * (LARGEST + 1):
        raise ValueError(f"links of 0 to {PARTS * (LARGEST + 1) - 1} bits")
    docs = cut(fingerprints(id_and_text(df, id_col, text_col), n, seed))
    own = cut(docs.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    fps = own.select("fp")
    edges = links(fps, *statistics(fps)[:2], most)
    rooted = cut(own.join(components(edges), F.col("fp") == F.col("node"), "left").select("fp", "least", F.col("n").alias("copies"), F.coalesce("root", "fp").alias("root")))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
    facts = cut(with_facts(rooted, smallest, "root", rooted.count()).select("fp", "component_id", F.col("copies").alias("n")))
    found = with_facts(docs, facts, "fp", docs.count())
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
