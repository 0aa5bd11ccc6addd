"""Helpers shared by the operators: byte-bounded Arrow slices, checkpoints, null-safe column selection."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of text that a Python worker holds as strings at once.
SLICE_CHARS = 750_000


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_CHARS) -> Iterator[pa.RecordBatch]:
    """Cut a record batch into runs of rows of about `limit` bytes of `column` (a longer row stands alone)."""
    values = batch.column(column)
    lengths = pc.fill_null(pc.binary_length(values), 0).to_pylist()
    start = held = 0
    for i, n in enumerate(lengths):
        if i > start and held + n > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)


def texts_of(batch: pa.RecordBatch, column: str) -> list[str]:
    """The texts of a batch; a null counts as empty."""
    return [t or "" for t in batch.column(column).to_pylist()]


#: Bytes of an Arrow batch on its way to a Python worker.
BATCH_BYTES = 8 << 20


def bounded(df: DataFrame) -> DataFrame:
    """df, its session's Arrow batches held to BATCH_BYTES: ten thousand long texts at once would fill a worker.

    Sets spark.sql.execution.arrow.maxBytesPerBatch of the session where it is larger.
    """
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = re.fullmatch(r"(\d+)b?", conf.get(key))
    if now is None or int(now[1]) > BATCH_BYTES:
        conf.set(key, str(BATCH_BYTES))
    return df


def id_and_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Two columns, doc_id and text, whatever else the input has."""
    return bounded(df).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def cut(df: DataFrame) -> DataFrame:
    """Write df to the cluster's shared checkpoint folder and go on from there.

    The folder is the session's spark.checkpoint.dir, or what setCheckpointDir was given. Without one a temporary folder
    is made where driver and executor are one process (a local master, as in tests); on a cluster this raises, since a
    folder of one machine would lose rows with it.
    """
    spark: SparkSession = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="millrace-"))
    return df.checkpoint()


#: Bits of a sieve, and so at most 2 ** 19 rows of 64 of them: a broadcast of 10 MB or less whatever the data.
SIEVE_BITS = 1 << 25


def sieve(keys: DataFrame, *columns: str) -> DataFrame:
    """A table of fixed size that lets through all keys and few others."""
    bit = F.xxhash64(*columns).bitwiseAND(SIEVE_BITS - 1)
    bits = keys.select(bit.alias("bit")).groupBy(F.expr("bit div 64").alias("sieve word"))
    return bits.agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("sieve bits"))


def sifted(df: DataFrame, kept: DataFrame, *columns: str, out: bool = False) -> DataFrame:
    """The rows that a sieve lets through (with out: those it does not), so that only they are shuffled."""
    names = [F.col(f"`{c}`") for c in df.columns]
    bit = F.xxhash64(*(F.col(f"`{c}`") for c in columns)).bitwiseAND(SIEVE_BITS - 1)
    rows = df.withColumn("sieve bit", bit).withColumn("sieve word", F.expr("`sieve bit` div 64")).join(F.broadcast(kept), "sieve word", "left")
    held = F.expr("shiftrightunsigned(coalesce(`sieve bits`, 0L), cast(`sieve bit` % 64 as int)) & 1 = 1")
    return rows.filter(~held if out else held).select(*names)


def vocabulary(name: str) -> str:
    """The path of a public tokenizer file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)
