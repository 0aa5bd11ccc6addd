"""Removal of passages that occur elsewhere, by FM-indexes over shards.

Every window of `least` words has an anchor, the least hash of its word n-grams, leftmost on a tie; windows in a row
with one anchor form a segment, and every window of the corpus lies in exactly one. Equal windows have equal
anchors. So segments are grouped by anchor, equal ones at once, and only anchors that occur twice go on. Those
with one kind of segment are repeated as a whole; the segments of the others are sent to shards by anchor. A shard
builds an FM-index of its distinct segments, streams them through it by backward search and reports the stretches
whose windows occur twice. An anchor with too many kinds for a shard has its windows counted instead.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import bounded, cut, sieve, sifted, slices, texts_of
from .chunks import spread
from .fm_index import repeated
from .near_copies import finish

#: Words of an anchor's n-gram; kinds of segments in a shard, and of one anchor beyond which its windows are counted.
GRAM, SHARD, HOT = 12, 20_000, 20_000
BASE = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word of the texts, and the words of each; words are runs without ASCII white space."""
    words = [t.encode().split() for t in texts]
    counts = np.fromiter(map(len, words), np.int64, len(words))
    return np.fromiter(map(xxhash.xxh3_64_intdigest, chain.from_iterable(words)), np.uint64, int(counts.sum())), counts


def least_in_windows(values: np.ndarray, width: int) -> np.ndarray:
    """Where the least value of each run of `width` is, the leftmost on a tie."""
    at, held = np.arange(len(values)), 1
    while held < width:
        step = min(held, width - held)
        right = values[step:] < values[:-step]
        at = np.where(right, at[step:], at[:-step])
        values = np.where(right, values[step:], values[:-step])
        held += step
    return at


def prefix_sums(words: np.ndarray, base: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of words times powers of base, and the inverse powers, modulo 2 ** 64."""
    n = len(words) + 1
    powers = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, base, np.uint64)]))
    inverse = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, np.uint64(pow(int(base), -1, 1 << 64)), np.uint64)]))
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * powers[:-1])]), inverse


def segments(words: np.ndarray, counts: np.ndarray, least: int, gram: int) -> tuple[np.ndarray, ...]:
    """Text, start among all words, length, anchor and digest of every segment."""
    starts = np.cumsum(counts) - counts
    n_windows = np.maximum(counts - least + 1, 0)
    where = spread(starts, n_windows)  # starts of windows among all words
    if not len(where):
        none = np.zeros(0, np.int64)
        return none, none, none, none, none
    hashes = np.zeros(len(words) - gram + 1, np.uint64)
    for i in range(gram):
        hashes = finish(hashes + words[i : len(words) - gram + 1 + i])
    anchor = least_in_windows(hashes, least - gram + 1)[where]
    anchor_at = anchor
    text = np.repeat(np.arange(len(counts)), n_windows)
    new = np.append(True, (anchor_at[1:] != anchor_at[:-1]) | (text[1:] != text[:-1]))
    first = np.flatnonzero(new)
    begin = where[first]
    size = np.diff(np.append(first, len(where))) + least - 1
    sums, inverse = prefix_sums(words, BASE)
    digest = finish((sums[begin + size] - sums[begin]) * inverse[begin] + size.astype(np.uint64)).view(np.int64)
    return text[first], begin, size, finish(hashes[anchor_at[first]]).view(np.int64), digest


def occurrences(texts: DataFrame, least: int, gram: int) -> DataFrame:
    """anchor and digest (128 bits that name a segment), key (md5 of its text), start and length in words, of every segment."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                held = texts_of(part, "text")
                words, counts = word_hashes(held)
                text, begin, size, anchor, digest = segments(words, counts, least, gram)
                keys = pa.array([hashlib.md5(t.encode(), usedforsecurity=False).digest() for t in held], pa.binary())
                start = begin - (np.cumsum(counts) - counts)[text]
                columns = [pa.array(anchor, pa.int64()), pa.array(digest, pa.int64()), keys.take(pa.array(text)), pa.array(start, pa.int32()), pa.array(size, pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, ["anchor", "digest", "key", "start", "length"])

    return texts.select("text").mapInArrow(find, "anchor long, digest long, key binary, start int, length int")


KIND = ["anchor", "digest"]
COVER = "anchor long, digest long, covered array<struct<from:int,to:int>>"


def words_of(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """anchor, digest and words (hashes) of wanted segments, from any text that holds them."""
    asked = wanted.groupBy("key").agg(F.collect_list(F.struct(*KIND, "start", "length")).alias("asked"))  # of one text
    once = sifted(texts, sieve(wanted, "key"), "key").groupBy("key").agg(F.first("text").alias("text"))  # copies once
    rows = once.join(asked, "key").select("text", "asked")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                words, counts = word_hashes(texts_of(part, "text"))
                starts = np.cumsum(counts) - counts
                found = [(a["anchor"], a["digest"], words[s + a["start"] : s + a["start"] + a["length"]].tobytes()) for s, asked in zip(starts.tolist(), part.column("asked").to_pylist()) for a in asked]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), (pa.int64(), pa.int64(), pa.binary()))], [*KIND, "words"])

    return rows.mapInArrow(read, "anchor long, digest long, words binary").dropDuplicates(KIND)


def by_index(rows: DataFrame, shards: int, least: int) -> DataFrame:
    """The covered stretches of segments from the FM-index of their shard."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held = None, []

        def report() -> Iterator[pa.RecordBatch]:
            found = repeated([np.frombuffer(h["words"], "<u8") for h in held], least)
            rows = [(h["anchor"], h["digest"], [{"from": a, "to": b} for a, b in f]) for h, f in zip(held, found) if f]
            if rows:
                covered = pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())]))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), covered))], [*KIND, "covered"])

        for batch in batches:
            for r in batch.to_pylist():
                if r["shard"] != shard:
                    if len(held) > 1:
                        yield from report()
                    shard, held = r["shard"], []
                held.append(r)
        if len(held) > 1:
            yield from report()

    sharded = rows.withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards)))
    return sharded.repartition("shard").sortWithinPartitions("shard").mapInArrow(search, COVER)


def by_count(rows: DataFrame, least: int) -> DataFrame:
    """The covered stretches of segments by counting their windows, for anchors with too many kinds for a shard."""

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                words = np.frombuffer(r["words"], "<u8")
                at = np.arange(len(words) - least + 1)
                sums, inverse = prefix_sums(words, BASE)
                window = pa.array(finish((sums[at + least] - sums[at]) * inverse[at]).view(np.int64))
                same = [pa.array(np.full(len(at), r[c]), pa.int64()) for c in KIND]
                yield pa.RecordBatch.from_arrays([window, pa.array(at, pa.int32()), *same], ["window", "at", *KIND])

    windows = rows.mapInArrow(cut_up, "window long, at int, anchor long, digest long")
    twice = windows.groupBy("anchor", "window").agg(F.count("*").alias("n")).filter("n > 1")
    stretch = F.struct(F.col("at").alias("from"), (F.col("at") + least).alias("to"))
    return windows.join(twice, ["anchor", "window"]).groupBy(*KIND).agg(F.collect_list(stretch).alias("covered"))  # of one segment


def remove_repeated(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 35, gram: int = GRAM, shard: int = SHARD, hot: int = HOT, keep: list[str] | None = None) -> DataFrame:
    """doc_id (or the columns of keep), n_words, n_removed and kept of every row.

    Words are runs of characters other than ASCII white space, taken unchanged. A window is `least` words in a row of
    one document; a word is removed if a window that covers it occurs at another place too, in any document. All is
    judged on the input. kept holds the words left, joined by one space. A null text has no words and an empty kept; a
    null id stays null; a repeated row repeats its passages; an empty table gives no rows. A very long text is cut into the same segments as
    any other, and every window of it is in one of them; of grams with one hash in a window the first is its anchor. Windows
    shorter than a gram take grams of their own length. Other columns are left out, whatever their names.
    """
    if least < 1:
        raise ValueError("a window has a word at least")
    gram = min(gram, least)
    columns = [F.col(c) for c in keep] if keep else [F.col(id_col).cast("long").alias("doc_id")]
    source = bounded(df).select(*columns, F.col(text_col).cast("string").alias("text of"))
    names = [f.name for f in source.schema.fields if f.name != "text of"]
    texts = df.select(F.col(text_col).cast("string").alias("text")).filter("text IS NOT NULL")
    found = occurrences(texts, least, gram)
    twice = cut(found.groupBy("anchor").agg(F.count("*").alias("total")).filter("total > 1").select("anchor"))
    places = cut(sifted(found, sieve(twice, "anchor"), "anchor").join(twice, "anchor", "left_semi"))
    kinds = places.groupBy(*KIND).agg(F.count("*").alias("n"))
    kinds = kinds.join(kinds.groupBy("anchor").agg(F.count("*").alias("kinds")), "anchor")
    # copies of a text have the same places
    places = cut(places.distinct().join(kinds, KIND))
    mixed = places.filter("kinds > 1").groupBy(*KIND, "kinds").agg(F.min(F.struct("key", "start", "length")).alias("p")).select(*KIND, "kinds", "p.*")
    content = cut(words_of(texts.withColumn("key", F.unhex(F.md5("text"))), mixed).join(mixed.select(*KIND, "kinds"), KIND))
    n_kinds = content.count()
    covered = by_index(content.filter(F.col("kinds") <= hot).drop("kinds"), max(1, -(-n_kinds // shard)), least).union(by_count(content.filter(F.col("kinds") > hot).drop("kinds"), least))
    # equal segments cover each other whole
    whole = places.filter("n > 1").select("key", F.col("start").alias("from"), (F.col("start") + F.col("length")).alias("to"))
    parts = places.filter("n = 1").join(covered, KIND).select("key", "start", F.explode("covered").alias("c")).select("key", (F.col("start") + F.col("c.from")).alias("from"), (F.col("start") + F.col("c.to")).alias("to"))
    stretches = cut(whole.union(parts).groupBy("key").agg(F.collect_list(F.struct("from", "to")).alias("out")))  # of one text
    keyed, touched = source.withColumn("key of", F.unhex(F.md5("text of"))), sieve(stretches, "key")
    own = [F.col(f"`{n}`") for n in names]
    inside = sifted(keyed, touched, "key of").join(stretches, F.col("key of") == F.col("key"), "left").select(*own, "text of", F.col("out").alias("out of"))
    none = F.lit(None).cast("array<struct<from:int,to:int>>")
    rows = inside.union(sifted(keyed, touched, "key of", out=True).select(*own, "text of", none.alias("out of")))

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text of"):
                n_words, n_removed, left = [], [], []
                for text, out in zip(texts_of(part, "text of"), part.column("out of").to_pylist()):
                    words = text.encode().split()
                    gone = np.zeros(len(words) + 1, np.int32)
                    for s in out or ():
                        gone[s["from"]] += 1
                        gone[s["to"]] -= 1
                    stay = np.cumsum(gone[:-1]) == 0
                    n_words.append(len(words))
                    n_removed.append(len(words) - int(stay.sum()))
                    left.append(b" ".join(words if not out else [w for w, s in zip(words, stay.tolist()) if s]).decode())
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(i) for i in range(len(names))), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(left, pa.string())], [*names, "n_words", "n_removed", "kept"]
                )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields if f.name != "text of")
    return rows.mapInArrow(strip, schema + ", n_words long, n_removed long, kept string")
