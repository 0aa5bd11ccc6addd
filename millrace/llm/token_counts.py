"""Token counts of documents by a map-side two-tier lookup.

Tier one is a broadcast table of the corpus's frequent chunks (see chunks.py) and their token counts; tier two is
each worker's cache of the others, filled by the tokenizer library. No pre-token is shuffled, neither to be counted nor
to choose the table: every partition is summed up in one row of at most `summary` chunks, and these rows are merged in a
tree of tasks that each read some of them in place.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from ._common import cut, id_and_text, slices, texts_of, vocabulary
from .chunks import LengthCache, Library

#: Bounds of the broadcast table: entries, and characters of an entry (so at most 65,536 * (32 * 4 + 8) bytes).
TABLE_SIZE, ENTRY_CHARS = 65_536, 32
#: Summaries that one task merges.
FAN = 64


SUMMARY = "chunks array<string>, counts array<long>"


def summed_up(counts: Counter, most: int) -> pa.RecordBatch:
    """One row: the most frequent chunks (the least first on a tie) and their counts."""
    top = sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:most]
    return pa.RecordBatch.from_arrays([pa.array([[k for k, _ in top]], pa.list_(pa.string())), pa.array([[n for _, n in top]], pa.list_(pa.int64()))], ["chunks", "counts"])


def frequent_chunks(texts: DataFrame, table_size: int = TABLE_SIZE, summary: int = 8_192) -> list[str]:
    """The chunks with the highest counts over all texts, from each partition's `summary` most frequent ones."""

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for part in slices(batch, "text"):
                for text in texts_of(part, "text"):
                    counts.update(text.split(" "))
                if len(counts) > 50 * summary:
                    counts = Counter(dict(counts.most_common(10 * summary)))
        yield summed_up(Counter({k: n for k, n in counts.items() if n > 1 and len(k) <= ENTRY_CHARS}), summary)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for chunks, n in zip(batch.column("chunks"), batch.column("counts")):
                for k, v in zip(chunks.as_py(), n.as_py()):
                    counts[k] += v
        yield summed_up(counts, table_size)

    found = cut(texts.select("text").mapInArrow(summarise, SUMMARY))
    parts = found.rdd.getNumPartitions()
    while parts > 1:
        parts = -(-parts // FAN)
        found = cut(found.coalesce(parts).mapInArrow(merge, SUMMARY))
    return [k for r in found.collect() for k in r["chunks"]]  # one row of table_size at most


def count_tokens(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer_path: str | None = None,
    limit: int = 1024,
    table_size: int = TABLE_SIZE,
) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row: UTF-8 bytes and tokens of the whole text.

    A null text counts as empty (0 bytes, 0 tokens, not over the limit); a very long text is counted whole; a null id stays null; repeated rows come
    back as often as they occur; an empty table gives no rows. Other columns are left out, whatever their names.
    """
    path = tokenizer_path or vocabulary("byte_bpe_50k.json")
    texts = id_and_text(df, id_col, text_col)
    frequent = frequent_chunks(texts, table_size)
    keys, _, lengths = Library(path).encode(frequent)
    table = df.sparkSession.sparkContext.broadcast((keys, lengths.tolist()))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = LengthCache(Library(path), dict(zip(*table.value)))
        for batch in batches:
            for part in slices(batch, "text"):
                n = cache.counts(texts_of(part, "text"))
                size = pc.fill_null(pc.binary_length(part.column("text")), 0).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), size, pa.array(n, pa.int64()), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return texts.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
