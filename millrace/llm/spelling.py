"""Spelling variants of the words of a corpus, by blocked Gram matrices of letter counts.

Two words that differ by one inserted, deleted or replaced code point have letter counts whose squared distance is at most
two. Words of one length, and of adjacent lengths, meet in blocks: the product of their letter-count matrices gives all squared distances
of a pair of blocks at once, and the pairs at most two apart are verified code point by code point.

Most pairs of blocks are ruled out before: the letters are dealt into a few classes, and a block holds words of one length and
one count of each class, its cell. One edit adds one to a class, or moves one from a class to another, so a cell meets
itself, its neighbours of the same length and those of the next length, and no others. The number of classes grows with
the number of words, such that a cell holds about as many words at any size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import cut, id_and_text
from .components import with_facts

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Maximal runs of these are words.
RUNS = "[A-Za-z\\u00C0-\\u00FF]+"
#: Words of a block, and code points of one (a longer word stands alone); rows of a block that are multiplied at once.
BLOCK, BLOCK_CHARS, TILE = 4096, 1 << 18, 512
#: Columns of the letter counts: a to z each, all further letters six between them, which makes no distance larger.
COLUMNS = 32
#: Candidates verified at once.
VERIFIED = 1 << 16


def occurrences(docs: DataFrame, shed: int) -> DataFrame:
    """word, one row for each run of doc_id, text.

    Only A-Z are lower-cased. With h = crc32 of "<doc_id>:<run>", a run loses its code point h % length (from 0) where shed divides h (0: never).
    """
    run = docs.select("doc_id", F.explode(F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(RUNS), F.lit(0))).alias("run"))
    if not shed:
        return run.select(F.col("run").alias("word"))
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run")))
    at = (F.col("h") % F.length("run")).cast("int")
    cut_out = F.concat(F.substring("run", 1, at), F.substring(F.col("run"), at + 2, F.length("run")))
    return run.withColumn("h", h).select(F.when(F.col("h") % shed == 0, cut_out).otherwise(F.col("run")).alias("word"))


def letter_counts(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of words of one length, row by row, and their letter counts."""
    codes = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").reshape(len(words), -1)
    column = np.where((codes >= 97) & (codes <= 122), codes - 97, 26 + codes % (COLUMNS - 26)).astype(np.int64)
    flat = column + COLUMNS * np.arange(len(words))[:, None]
    return codes, np.bincount(flat.ravel(), minlength=COLUMNS * len(words)).reshape(-1, COLUMNS).astype(np.float32)


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which rows of a and b, code points of the same length or of b one longer, differ by exactly one edit."""
    if a.shape[1] == b.shape[1]:
        return (a != b).sum(axis=1) == 1
    n = a.shape[1]
    lead = np.cumprod(a == b[:, :n], axis=1).sum(axis=1)
    trail = np.cumprod((a == b[:, 1:])[:, ::-1], axis=1).sum(axis=1)
    return lead + trail >= n


def near_in(a: list[str], b: list[str] | None) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j) of the pairs of two blocks that differ by one edit; b None: of pairs within a, each once."""
    codes_a, counts_a = letter_counts(a)
    codes_b, counts_b = letter_counts(b) if b is not None else (codes_a, counts_a)
    squares_a, squares_b = (counts_a**2).sum(axis=1), (counts_b**2).sum(axis=1)
    found_i, found_j = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for at in range(0, len(a), TILE):
        rows = slice(at, at + TILE)
        distance = squares_a[rows, None] + squares_b[None, :] - 2 * (counts_a[rows] @ counts_b.T)
        i, j = np.nonzero(distance <= 2)
        i += at
        if b is None:
            i, j = i[ahead := i < j], j[ahead]
        for k in range(0, len(i), VERIFIED):
            part_i, part_j = i[k : k + VERIFIED], j[k : k + VERIFIED]
            near = one_edit(codes_a[part_i], codes_b[part_j])
            found_i.append(part_i[near])
            found_j.append(part_j[near])
    return np.concatenate(found_i), np.concatenate(found_j)


def classes_for(n_words: int) -> int:
    """Classes of letters such that cells stay about as full: one more for four times the words."""
    return max(2, min(16, 2 + (max(n_words, 1) // BLOCK).bit_length() // 2))


def cells(words: DataFrame, n_classes: int) -> DataFrame:
    """word, n and cell: the length and the number of letters of each class."""
    of_class = lambda k: F.length(F.regexp_replace("word", f"[^{''.join(chr(c) for c in (*range(97, 123), *range(0xC0, 0x100)) if c % n_classes == k)}]", ""))
    return words.withColumn("cell", F.array(F.length("word"), *(of_class(k) for k in range(n_classes))))


def meetings(n_classes: int) -> F.Column:
    """The cells that words of a cell are compared with: itself, one longer by a letter of a class, one with a letter of an earlier class turned into one of a later."""
    every = range(n_classes)
    changes = [{}, *({0: 1, k + 1: 1} for k in every), *({k + 1: 1, m + 1: -1} for k in every for m in range(k))]
    return F.array(*(F.array(*(F.col("cell")[i] + change.get(i, 0) for i in range(n_classes + 1))) for change in changes))


def blocks_of(words: DataFrame, n_classes: int) -> DataFrame:
    """cell, block, blocks, words, ns: the words of each cell in blocks of about BLOCK by hash. blocks: how many the cell has."""
    placed = cells(words, n_classes)
    most = F.greatest(F.lit(1), F.least(F.lit(BLOCK), F.lit(BLOCK_CHARS) / F.col("cell")[0])).cast("int")
    size = placed.groupBy("cell").agg(F.count("*").alias("n")).select("cell", F.ceil(F.col("n") / most).cast("int").alias("blocks"), "n")
    dealt = with_facts(placed.withColumnRenamed("n", "times"), size, "cell", words.count())
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int"))
    return dealt.groupBy("cell", "block").agg(F.first("blocks").alias("blocks"), F.collect_list("word").alias("words"), F.collect_list("times").alias("ns"))


def near_words(words: DataFrame) -> DataFrame:
    """word, n_near, form_n, form: for each word that has near ones their number, and of those the one of largest n (ties: the first by code points).

    words: word, n, each word once. Tasks return a row for each word of a pair of blocks, not for each pair of words.
    """
    n_classes = classes_for(words.count())
    blocks = cut(blocks_of(words, n_classes))
    # a block asks for every block of the cells that it is compared with, so that both sides of a key are bounded
    there = blocks.select(F.col("cell").alias("target"), F.col("blocks").alias("targets")).distinct()
    asks = blocks.select("cell", "block", F.explode(meetings(n_classes)).alias("target")).join(there, "target")
    asks = asks.select("cell", "block", "target", F.explode(F.sequence(F.lit(0), F.col("targets") - 1)).alias("other"))
    asks = asks.filter((F.col("cell") != F.col("target")) | (F.col("block") <= F.col("other")))
    left = blocks.select("cell", "block", F.col("words").alias("a_words"), F.col("ns").alias("a_ns"))
    right = blocks.select(F.col("cell").alias("target"), F.col("block").alias("other"), F.col("words").alias("b_words"), F.col("ns").alias("b_ns"))
    itself = (F.col("cell") == F.col("target")) & (F.col("block") == F.col("other"))
    pairs = asks.join(left, ["cell", "block"]).join(right, ["target", "other"]).select(itself.alias("itself"), "a_words", "a_ns", "b_words", "b_ns")
    names = ["word", "n_near", "form_n", "form"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[str, list] = {}
            for k in range(batch.num_rows):
                same, a, a_ns, b, b_ns = (batch.column(c)[k].as_py() for c in range(5))
                if same:
                    b, b_ns = a, a_ns
                i, j = near_in(a, None if same else b)
                for x, y in zip(i.tolist(), j.tolist()):
                    for word, other, n in ((a[x], b[y], b_ns[y]), (b[y], a[x], a_ns[x])):
                        have = found.get(word)
                        if have is None:
                            found[word] = [1, n, other]
                            continue
                        have[0] += 1
                        if n > have[1] or n == have[1] and other < have[2]:
                            have[1:] = n, other
            columns = [list(found), *([v[c] for v in found.values()] for c in range(3))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string()))], names)

    near = pairs.mapInArrow(compare, "word string, n_near long, form_n long, form string")
    best = F.min(F.struct((-F.col("form_n")).alias("n"), F.col("form").alias("form"))).alias("best")
    return near.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", (-F.col("best.n")).alias("form_n"), "best.form")


def last_forms(forms: DataFrame) -> DataFrame:
    """word, root: where the forms of word, form lead. A form is at least twice as frequent, so that chains end; each round doubles the steps."""
    now = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        further = now.select(F.col("word").alias("at"), F.col("root").alias("next"))
        joined = cut(now.join(further, F.col("root") == F.col("at"), "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        now = joined.select("word", "root")
        if not joined.filter("moved").take(1):
            return now


def spelling_variants(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = 5, least_n: int = 3, times: int = 2, shed: int = 97) -> DataFrame:
    """word, form, root, n, n_near, form_n: one row for each word of at least least_length code points and least_n occurrences.

    Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF, of which only A-Z are lower-cased; in texts one run in `shed`, drawn by
    a checksum of id and run, has lost a code point first (0: none has). Words are near if they differ by exactly one inserted,
    deleted or replaced code point. A word's form is its near word of largest n, ties to the smallest by code points, if that is at
    least `times` (2 or more) the word's own n; else form and form_n are null. root follows the forms to the last; a word without
    a form is its own. n_near counts near words, 0 if there are none. A null text has no words; a null id reads as an
    empty one in the checksum; repeated rows count each time. Texts and words may have any length. An empty table gives no rows.
    """
    if times < 2:
        raise ValueError("a form is at least twice as frequent, else forms could go in a circle")
    counted = occurrences(id_and_text(df, id_col, text_col), shed).groupBy("word").agg(F.count("*").alias("n"))
    words = cut(counted.filter((F.length("word") >= least_length) & (F.col("n") >= least_n)))
    facts = cut(words.join(near_words(words), "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form", "form_n", (F.col("form_n") >= times * F.col("n")).alias("taken")))
    roots = last_forms(facts.filter("taken").select("word", "form"))
    only = lambda c: F.when(F.col("taken"), F.col(c)).alias(c)
    return facts.join(roots, "word", "left").select("word", only("form"), F.coalesce("root", "word").alias("root"), "n", "n_near", only("form_n"))
