"""Packing of tokenised documents into sequences of bounded length.

Each input partition runs the bounded-space online rule: a fixed number of open windows, each piece placed where
it leaves the least room, and, where no window has room and none may be opened, the fullest is filled up with
the first part of the piece and emitted. At the end of a partition its open windows are poured together, so that
at most one is not full. These leftovers, one small row a partition, are merged whole into sequences, in groups
of neighbouring partitions.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import cut, id_and_text, slices, texts_of, vocabulary
from .chunks import IdCache, Library

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part long, window long, offset long"
#: Rows of one merge group: partitions whose leftovers may share a sequence.
MERGE_GROUP = 256
#: Windows of one partition have numbers below this.
PER_PART = 1 << 32


class Windows:
    """The open windows of one partition: pieces are (document, start, length), windows are lists of them."""

    def __init__(self, size: int, most_open: int):
        self.size, self.most_open = size, most_open
        self.open: list[list] = []  # [tokens held, [pieces]]
        self.full: list[list] = []

    def place(self, doc: int, start: int, length: int) -> None:
        while length:
            room = [self.size - w[0] for w in self.open]
            fits = [(r, i) for i, r in enumerate(room) if r >= length]
            if fits or len(self.open) < self.most_open:
                if fits:
                    window = self.open[min(fits)[1]]
                else:
                    self.open.append(window := [0, []])
                put = length
            else:
                put, i = min((r, i) for i, r in enumerate(room))
                window = self.open[i]
            window[0] += put
            window[1].append((doc, start, put))
            start, length = start + put, length - put
            if window[0] == self.size:
                self.open.remove(window)
                self.full.append(window[1])

    def pour(self) -> list:
        """Pour the open windows together, fullest first; what is not full at the end is returned."""
        held, self.open, self.most_open = sorted(self.open, key=lambda w: -w[0]), [], 1
        for _, pieces in held:
            for piece in pieces:
                self.place(*piece)
        return self.open[0][1] if self.open else []


def pack(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer_path: str | None = None,
    size: int = 1024,
    end_id: int = 0,
    most_open: int = 32,
    keep_ids: bool = False,
) -> DataFrame:
    """Pieces of all documents and their places in sequences of at most `size` tokens.

    One row per piece: doc_id, start (the document's ids before it), length, ids_crc32 (of its ids as unsigned
    little-endian 32-bit numbers), doc_tokens (with the end id), sequence_id, offset; with keep_ids also ids, the
    piece's own ids. Every document ends with end_id, so an empty or null text is one piece of one id, and each id
    lies in exactly one piece. Repeated rows are packed as often as they occur; a null id stays null; an empty
    table gives no rows. A document longer than `size` fills sequences of its own, its rest is packed. Which
    pieces share a sequence depends on the input's partitions; ids and lengths do not.
    """
    path = tokenizer_path or vocabulary("byte_bpe_50k.json")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, cache, windows, number = TaskContext.get().partitionId(), IdCache(Library(path)), Windows(size, most_open), 0
        waiting: dict[int, tuple] = {}  # documents with pieces in open windows: id, ids, tokens
        serial = 0
        rows: list[tuple] = []
        ids: list[bytes] = []

        def write(pieces: list, window: int) -> None:
            offset = 0
            for doc, start, length in pieces:
                doc_id, tokens, total = waiting[doc]
                data = tokens[start : start + length].tobytes()
                rows.append((doc_id, start, length, zlib.crc32(data), total, part, window, offset))
                if keep_ids:
                    ids.append(data)
                offset += length

        def flush() -> pa.RecordBatch:
            columns = [pa.array(c, pa.int64()) for c in zip(*rows)] or [pa.array([], pa.int64())] * 8
            names = [c.split()[0] for c in PIECES.split(", ")]
            if keep_ids:
                flat = pa.array(np.frombuffer(b"".join(ids), "<u4").astype(np.int32))
                offsets = np.concatenate([[0], np.cumsum([len(b) // 4 for b in ids], dtype=np.int64)]).astype(np.int32)
                columns, names = [*columns, pa.ListArray.from_arrays(offsets, flat)], [*names, "ids"]
            rows.clear()
            ids.clear()
            return pa.RecordBatch.from_arrays(columns, names)

        for batch in batches:
            for piece in slices(batch, "text"):
                for doc_id, tokens in zip(piece.column("doc_id").to_pylist(), cache.ids(texts_of(piece, "text"))):
                    tokens = np.append(tokens, np.uint32(end_id)).astype("<u4")
                    total, serial = len(tokens), serial + 1
                    waiting[serial] = (doc_id, tokens, total)
                    whole = total - total % size
                    windows.full += [[(serial, s, size)] for s in range(0, whole, size)]
                    windows.place(serial, whole, total - whole)
                    for window in windows.full:
                        write(window, number)
                        number += 1
                    windows.full.clear()
                open_docs = {p[0] for w in windows.open for p in w[1]}
                waiting = {k: v for k, v in waiting.items() if k in open_docs}
                yield flush()
        rest = windows.pour()
        for window in windows.full:
            write(window, number)
            number += 1
        write(rest, -1)
        yield flush()

    placed = cut(id_and_text(df, id_col, text_col).mapInArrow(place, PIECES + ", ids array<int>" * keep_ids))
    rest = placed.filter("window < 0").groupBy("part").agg(F.sum("length").alias("tokens"))

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        """First fit of the leftovers, largest first; at most MERGE_GROUP rows."""
        held: list[int] = []
        out = []
        for part, tokens in sorted(zip(group["part"], group["tokens"]), key=lambda x: (-x[1], x[0])):
            i = next((i for i, n in enumerate(held) if n + tokens <= size), len(held))
            if i == len(held):
                held.append(0)
            out.append((part, i, held[i]))
            held[i] += tokens
        return pd.DataFrame(out, columns=["part", "slot", "base"]).assign(block=group["part"].iloc[0] // MERGE_GROUP)

    merged = rest.groupBy(F.expr(f"part div {MERGE_GROUP}")).applyInPandas(merge, "part long, slot long, base long, block long")
    # numbers of merged sequences: negative, by block and slot; of full windows: by partition and window
    joined = placed.join(merged.withColumnRenamed("part", "of_part"), (F.col("part") == F.col("of_part")) & (F.col("window") < 0), "left")
    return joined.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        F.when(F.col("window") >= 0, F.col("part") * PER_PART + F.col("window")).otherwise(-1 - (F.col("block") * MERGE_GROUP + F.col("slot"))).alias("sequence_id"),
        (F.col("offset") + F.coalesce("base", F.lit(0))).alias("offset"),
        *["ids"] * keep_ids,
    )
