"""Delimited files against Python's csv module."""

import csv
import io
import random

import pytest

from millrace.sources import files as S

CELLS = ["x", "", "two words", 'say "hi"', "a,b;c", "line\nbreak", "\n\nmany\n", "Müller", '""', "5\" pipe", "end\r\nhere", " "]


def expected(data, encoding, delimiter, banner=0):
    """Rows below the header by Python's csv: padded, cut, blank records left out, line breaks as line feeds."""
    text = data.decode(encoding).replace("\r\n", "\n").removeprefix("﻿")
    rows = [r for r in csv.reader(io.StringIO(text, newline=""), delimiter=delimiter) if r and any(c.strip() for c in r) or len(r) > 1]
    width = len(rows[banner])
    return sorted((tuple((r + [None] * width)[:width]) for r in rows[banner + 1 :]), key=str)


def got(spark, path):
    df, report = S.read_delimited(spark, str(path))
    rows = [tuple(r) for r in df.collect()]
    r = report.first()
    assert r.rows == len(rows)
    plain = lambda row: tuple(c or "" if c is not None else None for c in row)
    return sorted(map(plain, rows), key=str), r


def same_but_nulls(a, b):
    """Empty cells may be read as null."""
    return [tuple(c or "" for c in r) for r in a] == [tuple(c or "" for c in r) for r in b]


@pytest.fixture
def small_splits(spark):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    yield lambda n: (spark.conf.set("spark.sql.files.maxPartitionBytes", n), spark.conf.set("spark.sql.files.openCostInBytes", 1))
    spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("split", [150, 1 << 27])
@pytest.mark.parametrize("delimiter, end", [(",", "\n"), (";", "\r\n"), ("|", "\n")])
def test_quoted_line_breaks_over_splits(spark, tmp_path, small_splits, split, delimiter, end):
    small_splits(split)
    rng = random.Random(split)
    out = io.StringIO(newline="")
    writer = csv.writer(out, delimiter=delimiter, lineterminator=end)
    writer.writerow(["id", "a", "b"])
    for i in range(60):
        writer.writerow([i, rng.choice(CELLS), rng.choice(CELLS) * rng.choice([1, 1, 1, 30])])
    data = out.getvalue().encode()
    for name in ("a", "b"):
        (tmp_path / f"{name}.csv").write_bytes(data)
    rows, report = got(spark, tmp_path)
    want = expected(data, "utf-8", delimiter)
    assert same_but_nulls(rows, sorted([*want, *want], key=str))
    assert (report.encoding, report.delimiter, report.banner_lines) == ("utf-8", delimiter, 0)


@pytest.mark.parametrize("split", [2000])
@pytest.mark.parametrize("where", [700])
@pytest.mark.parametrize("quoted", [False, True])
def test_encoding_of_all_bytes(spark, tmp_path, small_splits, split, where, quoted):
    small_splits(split)
    for encoding, odd in (("cp1252", "né €"), ("iso-8859-1", "né \x81")):
        lines = ["Report of 2024", "id;name"] + [f"{i};{odd if i == where else 'plain'}" for i in range(800)]
        if quoted:
            lines[500] = '498;"plain\nin ""two"" lines"'
        data = "\n".join(lines).encode(encoding)
        (tmp_path / "x.csv").write_bytes(data)
        rows, report = got(spark, tmp_path / "x.csv")
        assert rows == expected(data, encoding, ";", 1)
        assert report.encoding == ("windows-1252" if encoding == "cp1252" else encoding) and report.banner_lines == 1


def test_cases_of_delimited_files(spark, tmp_path):
    def read(data):
        path = tmp_path / f"{abs(hash(data))}.csv"
        path.write_bytes(data)
        return got(spark, path)[0]

    assert read(b'a,b\n1,"x\ny"\n2,z\n') == [("1", "x\ny"), ("2", "z")]
    assert read(b"") == [] and read(b"\n\n  \n") == []
    assert read(b"a,b\n") == []
    assert read(b"\xef\xbb\xbfa,b\r\n1,2\r\n\r\n3,4\r\n") == [("1", "2"), ("3", "4")]
    assert read(b"a,b\r1,2\r3,4\r") == [("1", "2"), ("3", "4")]
    assert read(b'a,b\n5" pipe,6" pipe\n7,8\n') == [('5" pipe', '6" pipe'), ("7", "8")]
    assert read(b"a,b\n1,2\na,b\n1,2\n") == [("1", "2"), ("1", "2"), ("a", "b")]
    assert read(b'a,b\n1,2,3\n4\n"5","6"\n') == [("1", "2"), ("4", None), ("5", "6")]
    for bad in (b'a,b\n"x,1\n', b"a,b\n" + b"1,2\n" * 1000 + b'3,"4\n5,6\n'):
        with pytest.raises(ValueError):
            read(bad)
