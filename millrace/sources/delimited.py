"""Delimited files of unknown make: encoding, delimiter and banner are found out, records may hold line breaks.

A file is split by Spark wherever a line ends, inside quotes or not. What a line does to the state "inside quotes" is a map
of two states; the maps of a split are composed into one, those of a file's splits are composed in order, and so every
split knows the state it starts in. Then each split cuts its lines into records in one pass; the pieces of a record that lies in several
splits are joined. Where no line of the files leaves a quote open, lines are records and none of this is done.
"""

from __future__ import annotations

import csv
import io
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.cleaning import normalize_columns

# Encodings and delimiters that are tried.
ENCODINGS = ("utf-8", "windows-1252", "iso-8859-1")
DELIMITERS = (",", ";", "\t", "|")
#: Lines of a file, and characters of each, from which its delimiter and banner are found out.
SNIFFED_LINES, SNIFFED_CHARS = 300, 1 << 16
#: Bytes that windows-1252 does not have.
UNDEFINED = "[\\x81\\x8D\\x8F\\x90\\x9D]"


def decoded(value: F.Column, encoding: str) -> F.Column:
    """The text of raw lines. Spark decodes ISO 8859-1; the 27 characters that windows-1252 has besides are put right."""
    if encoding == "utf-8":
        return value
    text = F.decode(value.cast("binary"), "ISO-8859-1")
    codes = [c for c in range(0x80, 0xA0) if bytes([c]).decode("cp1252", "ignore")]
    return F.translate(text, "".join(map(chr, codes)), bytes(codes).decode("cp1252")) if encoding == "windows-1252" else text


def raw_lines(spark: SparkSession, path: str, end: str) -> DataFrame:
    """file, block (where its split starts), id (in the order of the lines of a split) and value, the bytes of each line."""
    lines = spark.read.option("lineSep", end).text(path)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), "value")


def head_of(spark: SparkSession, path: str) -> tuple[bytes, str]:
    """The first lines of a file of the path, and what ends a line: a line feed, or a lone carriage return."""
    first = raw_lines(spark, path, "\n").filter("block = 0").select(F.substring(F.col("value").cast("binary"), 1, SNIFFED_CHARS).alias("value")).limit(SNIFFED_LINES)
    lines = [bytes(r["value"]) for r in first.collect()]
    head = b"\n".join(lines)
    alone = b"\r" in head.replace(b"\r\n", b"").removesuffix(b"\r") and all(b"\r" in x[:-1] for x in lines)
    return head.replace(b"\r", b"\n") if alone else head.replace(b"\r\n", b"\n").removesuffix(b"\r"), "\r" if alone else "\n"


def sniff(head: bytes, encoding: str) -> tuple[str, list[str], int]:
    """Delimiter, header and banner records before the header of a file's first lines.

    The delimiter is the one by which the most records have the same number of fields, more than one; ties go to more fields and then to the first of DELIMITERS.
    """
    text = head.removeprefix(b"\xef\xbb\xbf").decode(encoding, "replace")

    def parsed(delimiter: str) -> list[list[str]]:
        try:
            return [r for r in csv.reader(io.StringIO(text, newline=""), delimiter=delimiter) if r and any(c.strip() for c in r)]
        except csv.Error:  # a field that is too long to be one
            return []

    usual = {d: max(((n, width) for width, n in Counter(len(r) for r in parsed(d) if len(r) > 1).items()), default=(0, 0)) for d in DELIMITERS}
    best = max(DELIMITERS, key=usual.get)
    records = parsed(best)
    # the header has as many fields as most records; records above it are a banner
    banner = [len(r) for r in records].index(usual[best][1]) if usual[best][0] else 0
    return best, records[banner] if records else [], banner


def leaves_open(delimiter: str) -> tuple[str, str]:
    """Patterns of lines after which a quote is open: if the line starts outside quotes, and if it starts inside. A quote opens only where a field starts."""
    d = re.escape(delimiter)
    quoted = r'[^"]*+(?:""[^"]*+)*+'
    outside = rf'(?:(?:"{quoted}"[^{d}]*+|[^"{d}][^{d}]*+)?+{d})*+"{quoted}$'
    return f"(?s)^{outside}", rf'(?s)^{quoted}(?:$|"[^{d}]*+{d}{outside})'


def states(lines: DataFrame) -> DataFrame:
    """file, block, begins (inside quotes?) and ends of every split, from opens and stays, what each line does to the two states.

    A line sets the state (both the same), swaps it or leaves it. A split's map: the last line that sets it, and the swaps after that.
    """
    key = ["file", "block"]
    sets = F.max(F.when(F.col("opens") == F.col("stays"), F.struct("id", F.col("opens").cast("int").alias("to")))).alias("set")
    last = lines.groupBy(*key).agg(sets)
    swap = F.col("opens") & ~F.col("stays") & (F.col("id") > F.coalesce(F.col("set.id"), F.lit(-1)))
    maps = lines.filter("opens AND NOT stays").join(last, key).groupBy(*key).agg(F.count_if(swap).alias("swaps"))
    split = last.join(maps, key, "left").select(*key, F.col("set.to").alias("to"), F.coalesce("swaps", F.lit(0)).alias("swaps"))
    upto = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # a row a split
    counted = split.withColumn("all", F.sum("swaps").over(upto))
    known = counted.withColumn("from", F.last(F.when(F.col("to").isNotNull(), F.col("to") + F.col("all") + F.col("swaps")), ignorenulls=True).over(upto))
    # to + swaps of the last split that sets the state, and of those after it: sums of swaps differ by them, modulo two
    after = known.withColumn("ends", F.pmod(F.coalesce(F.col("from"), F.lit(0)) + F.col("all"), F.lit(2)))
    before = F.lag("ends", 1, 0).over(Window.partitionBy("file").orderBy("block"))
    return after.select(*key, (before == 1).alias("begins"), (F.col("ends") == 1).alias("ends"))


def records(lines: DataFrame, encoding: str) -> DataFrame:
    """file, block, place (of a record among those that begin in its split) and record, for lines with opens and stays."""
    splits = states(lines)
    found = splits.filter("begins OR ends").collect()  # at most a row for each split of the input, and only those cut inside a record
    final = splits.groupBy("file").agg(F.max_by("ends", "block").alias("open")).filter("open").take(1)
    if final:
        raise ValueError(f"a quote is not closed in {final[0]['file']}")
    inside = lines.sparkSession.sparkContext.broadcast({(r["file"], r["block"]) for r in found if r["begins"]})
    names = ["file", "block", "place", "record", "begins", "ends"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, place, is_open, begins, held = None, -1, False, True, []
        out: list[tuple] = []

        def emit(ends: bool) -> None:
            nonlocal held
            text = b"\n".join(held)
            if not (begins and ends) or text.strip():
                out.append((*at, place, text.removeprefix(b"\xef\xbb\xbf" if at[1] == 0 and place == 0 else b"").decode(encoding, "replace"), begins, ends))
            held = []

        for batch in batches:
            files, blocks, values, opens, stays = (batch.column(c).to_pylist() for c in range(5))
            for key, value, o, s in zip(zip(files, blocks), values, opens, stays):
                if key != at:
                    if held:
                        emit(False)
                    at, place, is_open = key, -1, key in inside.value
                    begins = not is_open
                if not held and not is_open:
                    begins = True
                    place += bool(value.strip())
                held.append(value.removesuffix(b"\r"))
                is_open = s if is_open else o
                if not is_open:
                    emit(True)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 6, (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.bool_()))], names)
            out.clear()
        if held:
            emit(False)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 6, (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.bool_()))], names)

    pieces = lines.select("file", "block", F.col("value").cast("binary"), "opens", "stays").mapInArrow(cut, "file string, block long, place long, record string, begins boolean, ends boolean")
    whole = pieces.filter("begins AND ends").select(*names[:4])
    # of the others there are two a split at most: one that goes on from the split before, one that goes on in the next
    order = Window.partitionBy("file").orderBy("block", "begins").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    owner = F.last(F.when(F.col("begins"), F.struct("block", "place")), ignorenulls=True).over(order)
    parts = pieces.filter("NOT (begins AND ends)").withColumn("owner", owner).groupBy("file", "owner").agg(F.array_sort(F.collect_list(F.struct("block", "begins", "record"))).alias("parts"))
    return whole.union(parts.select("file", "owner.block", "owner.place", F.array_join(F.transform("parts", lambda p: p["record"]), "\n")))


def read_delimited(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A delimited file of unknown make, or a folder of them, as text columns, and a report: encoding, delimiter, banner lines, rows, short and long rows.

    The encoding is the first that all bytes fit. Quoted cells may hold delimiters, doubled quotes and line breaks (read as line feeds),
    also over the borders of Spark's splits; a quote that is never closed raises ValueError. Short rows are filled with
    nulls, long ones are cut, blank lines are no rows. Banner and header are left out by their places, the first records of
    each file, so a row that repeats them stays. A file without a line that is not blank gives no columns and no rows.
    """
    head, end = head_of(spark, path)
    delimiter = sniff(head, "iso-8859-1")[0]
    opens, stays = leaves_open(delimiter)
    lines = raw_lines(spark, path, end).withColumns({"opens": F.col("value").rlike(opens), "stays": F.col("value").rlike(stays)})
    facts = lines.agg(
        F.bool_and(F.is_valid_utf8("value")).alias("utf8"), F.bool_or(F.decode(F.col("value").cast("binary"), "ISO-8859-1").rlike(UNDEFINED)).alias("undefined"), F.bool_or("opens").alias("opens"), F.bool_or(F.trim("value") != "").alias("any")
    ).first()
    encoding = ENCODINGS[0] if facts["utf8"] in (True, None) else ENCODINGS[2] if facts["undefined"] else ENCODINGS[1]
    delimiter, header, banner = sniff(head, encoding)
    if not header:
        empty = spark.createDataFrame([], T.StructType())
        return empty, spark.createDataFrame([(encoding, delimiter, 0, 0, 0, 0)], "encoding string, delimiter string, banner_lines int, rows long, short_rows long, long_rows long")
    names = normalize_columns(spark.range(0).select(*(F.lit("").alias(h) for h in header))).columns
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names] + [T.StructField("more fields", T.StringType())])
    if facts["opens"]:
        rows = records(lines, encoding).filter((F.col("block") > 0) | (F.col("place") > banner)).select("record")
    else:
        kept = lines.filter(F.rtrim("value", F.lit(" \t\r")) != "")
        # lines of a split are numbered in order; the first lines of a file are in the split that starts at 0
        place = F.row_number().over(Window.partitionBy("file").orderBy("id"))
        first = kept.filter("block = 0").select("file", "id").withColumn("place", place).filter(F.col("place") <= banner + 1).groupBy("file").agg(F.max("id").alias("last"))
        text = F.rtrim(decoded(F.col("value"), encoding), F.lit("\r")).alias("record")
        rows = kept.filter("block = 0").join(first, "file").filter("id > last").select(text).union(kept.filter("block <> 0").select(text))
    options = {"sep": delimiter, "quote": '"', "escape": '"', "mode": "PERMISSIVE", "emptyValue": ""}
    data = rows.select(F.from_csv("record", ", ".join(f"`{f.name}` string" for f in schema), options).alias("row")).select("row.*")
    report = data.agg(F.lit(encoding).alias("encoding"), F.lit(delimiter).alias("delimiter"), F.lit(banner).alias("banner_lines"), F.count("*").alias("rows"), F.count_if(F.col(f"`{names[-1]}`").isNull()).alias("short_rows"), F.count_if(F.col("more fields").isNotNull()).alias("long_rows"))
    return data.drop("more fields"), report
