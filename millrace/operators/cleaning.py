"""Cleaning of columns as projections; where a whole column decides, one aggregate decides first."""

from __future__ import annotations

import json
import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import clip, similarity
from .lineage import followed
from .ranks import column_quantiles

# Tokens that stand for a missing value, numbers that do, and patterns of personal data.
MISSING_TOKENS = (
    "n/a", "na", "n.a.", "n.a", "null", "none", "unknown", "unk", "--", "-", "?", "missing", "not available", "not applicable", "#n/a",
    "#value!", "#ref!", "#div/0!", "#num!", "#name?", "nil", "nan", "-999", "-9999", "99999", "n/d", "",
)
SENTINELS = (-999.0, -9999.0, 99999.0)
NUMBER = r"^[-+(]?\s*[$€£¥]?\s*[-+]?(?:\d+(?:[.,]\d+)*|[.,]\d+)\s*[%€]?\s*\)?-?$"
LEADING_ZERO = r"^0\d+$"
PERSONAL = {
    "email": r"^[^@\s]+@[^@\s]+\.[a-zA-Z]{2,}$",
    "ssn": r"^\d{3}-\d{2}-\d{4}$",
    "card": r"^(?:\d[ -]?){13,16}$",
    "phone": r"^\+?\d?[ .-]?\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}$",
}


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def normalize_columns(df: DataFrame) -> DataFrame:
    """Trim names, name blank ones, and number repeated ones."""
    seen: dict[str, int] = {}
    names = []
    for raw in df.columns:
        name = raw.strip() or "unnamed_column"
        while name in seen:
            seen[name] += 1
            name = f"{name}_{seen[name]}"
        seen[name] = 0
        names.append(name)
    return df.toDF(*names)


def trim_strings(df: DataFrame) -> DataFrame:
    """Trim every text column; blank becomes null."""
    return df.withColumns({c: F.nullif(F.trim(c), F.lit("")) for c in text_columns(df)})


def is_missing_token(c: Column) -> Column:
    return F.lower(F.trim(c)).isin(*MISSING_TOKENS)


def literal_codes(df: DataFrame) -> list[str]:
    """Text columns in which "NA" is a code: all other values have one to three letters, and there are two or more."""
    columns = text_columns(df)
    if not columns:
        return []
    other = {c: F.when(F.upper(F.trim(c)) != "NA", F.trim(c)) for c in columns}
    checks = df.agg(*(F.coalesce(F.bool_and(v.rlike("^[A-Za-z]{1,3}$")), F.lit(False)).alias(f"{i} code") for i, v in enumerate(other.values())), *(F.count_distinct(v).alias(f"{i} n") for i, v in enumerate(other.values()))).first()
    return [c for i, c in enumerate(columns) if checks[f"{i} code"] and checks[f"{i} n"] >= 2]


def normalize_na(df: DataFrame) -> DataFrame:
    """Missing-value tokens become null, but not where they are codes."""
    kept = set(literal_codes(df))
    return df.withColumns({c: F.when(~is_missing_token(F.col(c)), F.col(c)) for c in text_columns(df) if c not in kept})


def number_of(c: Column) -> Column:
    """A text as a double: currency signs, thousands in either style, trailing or bracketed minus, percent; else null."""
    text = F.trim(c)
    negative = text.rlike(r"^\(.*\)$") | text.rlike(r"-$") | text.rlike(r"^[$€£¥]?\s*-")
    bare = F.regexp_replace(text, r"[^0-9.,]", "")
    decimal_comma = bare.rlike(r",\d{1,2}$") & ~bare.rlike(r"\.\d{1,2}$") | bare.rlike(r"\..*,")
    plain = F.when(decimal_comma, F.regexp_replace(F.regexp_replace(bare, r"\.", ""), ",", ".")).otherwise(F.regexp_replace(bare, ",", ""))
    value = plain.try_cast("double") * F.when(negative, -1.0).otherwise(1.0)
    return F.when(text.rlike(NUMBER), F.when(text.rlike(r"%"), value / 100).otherwise(value))


def coerce_numeric(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Text columns of which every known value is a number become doubles; codes with leading zeros never do."""
    columns = list(columns or text_columns(df))
    if not columns:
        return df
    numeric = lambda c: number_of(F.col(c)).isNotNull() & ~F.trim(c).rlike(LEADING_ZERO)
    checks = df.agg(*(F.min(F.when(F.col(c).isNotNull(), numeric(c).cast("int"))).alias(str(i)) for i, c in enumerate(columns))).first()
    return df.withColumns({c: number_of(F.col(c)) for i, c in enumerate(columns) if checks[str(i)] == 1})


def parse_dates(df: DataFrame, column: str) -> DataFrame:
    """Dates of numbers and separators become dates if their order of day and month is proven; else the column stays."""
    parts = F.regexp_extract(column, r"^\s*(\d{1,4})[-/.](\d{1,2})[-/.](\d{1,4})\s*$", 0)
    part = lambda i: F.regexp_extract(column, r"^\s*(\d{1,4})[-/.](\d{1,2})[-/.](\d{1,4})\s*$", i).try_cast("int")
    facts = df.agg(F.max(part(1)).alias("first"), F.max(part(2)).alias("second"), F.count(column).alias("n"), F.count_if(parts != "").alias("shaped")).first()
    if not facts["n"] or facts["shaped"] != facts["n"]:
        return df
    if facts["first"] > 31:
        order = (1, 2, 3)
    elif facts["first"] > 12 and facts["second"] <= 12:
        order = (3, 2, 1)
    elif facts["second"] > 12 and facts["first"] <= 12:
        order = (3, 1, 2)
    else:
        return df
    iso = F.concat_ws("-", *(F.lpad(part(i).cast("string"), 4 if k == 0 else 2, "0") for k, i in enumerate(order)))
    return df.withColumn(column, F.when(F.col(column).isNotNull(), iso.try_cast("date")))


def drop_all_null_rows(df: DataFrame) -> DataFrame:
    return df.na.drop("all")


def null_sentinels(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Numbers that stand for a missing value become null."""
    return df.withColumns({c: F.when(~F.col(c).cast("double").isin(*SENTINELS), F.col(c)) for c in columns})


def count_sentinels(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column and number of sentinel values."""
    return df.agg(F.array(*(F.struct(F.lit(c).alias("column"), F.count_if(F.col(c).cast("double").isin(*SENTINELS)).alias("sentinels")) for c in columns)).alias("rows")).select(F.inline("rows"))


def standardize_dates(df: DataFrame, column: str, pattern: str = "yyyy-MM-dd") -> DataFrame:
    """Dates as text in one pattern; what is no date becomes null."""
    return df.withColumn(column, F.date_format(F.col(column).try_cast("timestamp"), pattern))


def normalize_categories(df: DataFrame, column: str, casing: str = "lower", mapping: Mapping[str, str] | None = None) -> DataFrame:
    """Trim and case a column, then replace values."""
    cased = {"lower": F.lower, "upper": F.upper, "title": F.initcap}[casing](F.trim(column))
    for old, new in (mapping or {}).items():
        cased = F.when(F.trim(column) == old, F.lit(new)).otherwise(cased) if old != new else cased
    return df.withColumn(column, cased)


def fill_missing(df: DataFrame, column: str, strategy: str, value=None) -> DataFrame:
    """Fill nulls by mean, median, mode (the least on a tie) or a constant, or drop their rows."""
    if strategy == "drop":
        return df.na.drop(subset=[column])
    if strategy == "constant":
        return df.withColumn(column, F.coalesce(column, F.lit(value)))
    if strategy == "mode":
        counts = df.filter(F.col(column).isNotNull()).groupBy(column).count()
        fill = counts.orderBy(F.desc("count"), column).limit(1).select(F.col(column).alias("fill"))
    elif strategy == "median":
        return df.withColumn(column, F.coalesce(column, F.lit(column_quantiles(df, [column], [0.5])[column][0])))
    else:
        fill = df.agg({"mean": F.avg}[strategy](column).alias("fill"))
    return df.join(F.broadcast(fill), F.lit(True), "left").withColumn(column, F.coalesce(column, "fill")).drop("fill")


def deduplicate(df: DataFrame, subset: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row in order of each key."""
    first = F.row_number().over(Window.partitionBy(*subset).orderBy(*order))
    return df.withColumn("row of key", first).filter(F.col("row of key") == 1).drop("row of key")


def fences(df: DataFrame, column: str, k: float = 1.5) -> tuple[float, float] | None:
    """The values k interquartile ranges outside the quartiles; None without a known value."""
    q1, q3 = column_quantiles(df, [column], [0.25, 0.75])[column]
    return None if q1 is None else (q1 - k * (q3 - q1), q3 + k * (q3 - q1))


def handle_outliers(df: DataFrame, column: str, action: str = "clamp", k: float = 1.5) -> DataFrame:
    """Clamp values to the fences, or drop the rows outside them."""
    found = fences(df, column, k)
    if found is None:
        return df
    low, high = map(F.lit, found)
    if action == "clamp":
        return df.withColumn(column, F.when(F.col(column).isNotNull(), F.least(F.greatest(column, low), high)))
    return df.filter(F.col(column).isNull() | F.col(column).between(low, high))


def cast_column(df: DataFrame, column: str, to: str) -> DataFrame:
    """Cast; what cannot be cast becomes null."""
    return df.withColumn(column, F.col(column).try_cast(to))


def cast_failures(df: DataFrame, column: str, to: str) -> DataFrame:
    """Known values, and those that cannot be cast."""
    return df.agg(F.count(column).alias("known"), F.count_if(F.col(column).isNotNull() & F.col(column).try_cast(to).isNull()).alias("failed"))


STEPS = {
    "standardize_dates": standardize_dates,
    "normalize_categories": normalize_categories,
    "fill_missing": fill_missing,
    "deduplicate": deduplicate,
    "handle_outliers": handle_outliers,
    "cast_column": cast_column,
}


def apply_recipe(df: DataFrame, steps: Sequence[Mapping]) -> DataFrame:
    """Apply named steps in order: [{"step": name, **arguments}, ...]. An unknown step raises."""
    return reduce(lambda d, s: STEPS[s["step"]](d, **{k: v for k, v in s.items() if k != "step"}), steps, df)


def logged_recipe(df: DataFrame, steps: Sequence[Mapping]) -> tuple[DataFrame, DataFrame]:
    """The table after a recipe, and its log: step (from 1), name, arguments as JSON, rows and columns before and after, and rows that the step changed or took away."""
    parts, now = [], df
    for i, s in enumerate(steps, 1):
        before, now = now, apply_recipe(now, [s])
        arguments = json.dumps({k: v for k, v in s.items() if k != "step"}, sort_keys=True, default=str)
        same = [c for c in before.columns if c in now.columns]
        keys = lambda d, name, same=same: d.groupBy(row_key(d, same).alias("row")).agg(F.count("*").alias(name))
        both = keys(before, "b").join(keys(now, "a"), "row", "full_outer").select(F.coalesce("b", F.lit(0)).alias("b"), F.coalesce("a", F.lit(0)).alias("a"))
        facts = both.agg(F.sum("b").alias("rows_before"), F.sum("a").alias("rows_after"), F.sum(F.greatest(F.col("b") - F.col("a"), F.lit(0))).alias("rows_changed"))
        parts.append(facts.select(F.lit(i).alias("step"), F.lit(s["step"]).alias("name"), F.lit(arguments).alias("arguments"), "rows_before", "rows_after", "rows_changed", F.lit(len(before.columns)).alias("columns_before"), F.lit(len(now.columns)).alias("columns_after")))
    if not parts:
        return df, df.sparkSession.createDataFrame([], "step int, name string, arguments string, rows_before long, rows_after long, rows_changed long, columns_before int, columns_after int")
    return now, reduce(DataFrame.union, parts)


def impute(df: DataFrame, target: str, columns: Sequence[str]) -> DataFrame:
    """Fill covariates of which less than 40 % is missing by their medians; the target never, and over 5 % of it missing raises."""
    facts = df.agg(F.avg(F.col(target).isNull().cast("double")).alias("target"), *(F.avg(F.col(c).isNull().cast("double")).alias(c) for c in columns)).first()
    if facts["target"] is not None and facts["target"] > 0.05:
        raise ValueError(f"more than 5 % of {target} is missing")
    filled = [c for c in columns if c != target and 0 < (facts[c] or 0) < 0.4]
    medians = column_quantiles(df, filled, [0.5])
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(medians[c][0])) for c in filled}) if filled else df


def pieces(text: Column, parts: Column, i: Column) -> tuple[Column, Column]:
    """Where the i-th (from 0) of so many nearly equal parts of a text of this length starts (from 1), and its length."""
    short = F.floor(text / parts)
    longer = text - short * parts  # the last ones hold a character more
    start = i * short + F.greatest(F.lit(0), i - (parts - longer)) + 1
    return start.cast("int"), (short + (i >= parts - longer).cast("int")).cast("int")


def spelled_alike(values: DataFrame, threshold: float) -> DataFrame:
    """a, b: all pairs of different values (text, lower-cased in `low`) whose edit similarity reaches the threshold.

    Of two such texts of l <= L characters at most d = L * (1 - threshold / 100) edits apart, one of d + 1 parts of the
    shorter stands unchanged in the longer, at most d places away. Pairs meet only over such parts, whatever their number.
    """
    loss = 1 - threshold / 100
    edits = lambda n: F.floor(n * F.lit(loss) + 1e-9).cast("int")
    sized = values.filter("low <> ''").withColumn("l", F.length("low"))
    longest = F.floor(F.col("l") / F.lit(1 - loss) + 1e-9).cast("int")
    short = sized.withColumn("of", F.explode(F.sequence(F.col("l"), longest))).withColumn("parts", edits(F.col("of")) + 1).filter("parts <= l")
    short = short.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    start, size = pieces(F.col("l"), F.col("parts"), F.col("i"))
    short = short.select("l", "of", "i", F.substring(F.col("low"), start, size).alias("part"), F.col("v").alias("a"))
    long = sized.withColumnRenamed("l", "of").withColumn("d", edits(F.col("of"))).withColumn("l", F.explode(F.sequence(F.col("of") - F.col("d"), F.col("of")))).filter("l >= 1 AND d + 1 <= l")
    long = long.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("d")))).withColumn("shift", F.explode(F.sequence(-F.col("d"), F.col("d"))))
    start, size = pieces(F.col("l"), F.col("d") + 1, F.col("i"))
    at = start + F.col("shift")
    long = long.filter((at >= 1) & (at + size - 1 <= F.col("of"))).select("l", "of", "i", F.substring(F.col("low"), at, size).alias("part"), F.col("v").alias("b"))
    pairs = short.join(long.distinct(), ["l", "of", "i", "part"]).filter("a <> b").select("a", "b").distinct()
    alike = pairs.filter(similarity(F.lower("a"), F.lower("b")) >= threshold)
    return alike.union(alike.select("b", "a")).distinct()


def merge_fuzzy_categories(df: DataFrame, column: str, threshold: float = 80.0) -> DataFrame:
    """Spelling variants (edit similarity, or the same letters and digits of any script) become the most frequent spelling like them.

    A chain of variants ends in one spelling: where a value's more frequent spelling has a more frequent one itself, both
    become that one. Values without a letter or digit are like others by similarity alone. Works on the distinct values, however
    many: candidates share a part of their text, so no value meets all others.
    """
    if not 50 < threshold <= 100:
        raise ValueError("a threshold is above 50 and at most 100")
    counts = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count("*").alias("n"))
    values = counts.select("v", F.lower("v").alias("low"), F.lower(F.regexp_replace("v", r"[^\p{L}\p{M}\p{N}]", "")).alias("bare"))
    best_bare = F.max_by("v", F.struct("n", "v"))
    same = counts.join(values.filter("bare <> ''"), "v").groupBy("bare").agg(best_bare.alias("b"))
    pairs = spelled_alike(values, threshold).union(values.join(same, "bare").filter("v <> b").select(F.col("v").alias("a"), "b"))
    a, b = counts.select(F.col("v").alias("a"), F.col("n").alias("na")), counts.select(F.col("v").alias("b"), F.col("n").alias("nb"))
    like = pairs.join(a, "a").join(b, "b").filter((F.col("nb") > F.col("na")) | ((F.col("nb") == F.col("na")) & (F.col("b") < F.col("a"))))
    best = followed(like.groupBy("a").agg(F.max_by("b", F.struct("nb", "b")).alias("b"))).withColumnRenamed("root", "canonical")
    return df.join(best, F.col(column) == F.col("a"), "left").withColumn(column, F.coalesce("canonical", column)).drop("a", "canonical")


def mask_personal(df: DataFrame, salt: str, least: float = 0.1) -> DataFrame:
    """Columns of which a tenth or more looks like personal data become salted hashes."""
    columns = text_columns(df)
    if not columns:
        return df
    looks = lambda c: reduce(lambda x, y: x | y, (F.trim(c).rlike(p) for p in PERSONAL.values()))
    shares = df.agg(*(F.avg(looks(c).cast("double")).alias(c) for c in columns)).first()
    return df.withColumns({c: F.when(F.col(c).isNotNull(), F.concat(F.lit("MASKED_"), F.substring(F.sha2(F.concat(F.col(c), F.lit("_" + salt)), 256), 1, 12))) for c in columns if (shares[c] or 0) >= least})


def row_policy(df: DataFrame, **allowed) -> DataFrame:
    """Only rows whose columns have the allowed values; a policy without a column of the table raises."""
    if not allowed or any(c not in df.columns for c in allowed):
        raise PermissionError(f"no policy can be applied to {df.columns}")
    return df.filter(reduce(lambda x, y: x & y, (F.col(c) == v for c, v in allowed.items())))


def as_text(f: T.StructField) -> Column:
    """A cell as text that differs where values differ; nested values as JSON."""
    c = F.col(f"`{f.name}`")
    if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
        return F.when(c.isNotNull(), F.to_json(F.struct(c), {"ignoreNullFields": "false"}))
    if isinstance(f.dataType, T.BinaryType):
        return F.hex(c)
    return ((c + F.lit(0.0).cast(f.dataType)) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else c).cast("string")  # -0.0 is 0.0


def row_key(df: DataFrame, columns: Sequence[str]) -> Column:
    """SHA-256 of a row as one text that differs where a cell differs, a null from any value and a column from its neighbour.

    Every cell is written with its length before it, a null as a mark that no length has.
    """
    kinds = {f.name: f for f in df.schema.fields}
    cells = [F.coalesce(F.concat(F.length(as_text(kinds[c])).cast("string"), F.lit(":"), as_text(kinds[c])), F.lit("-")) for c in columns]
    return F.sha2(F.concat(*cells), 256) if cells else F.lit("")


def multiset_sums(key: Column, digits: int = 15) -> list[Column]:
    """Sums of the parts of hexadecimal SHA-256 digests: together the sum of the digests as whole numbers, the same in any order of rows."""
    return [F.sum(F.conv(F.substring(key, i, min(digits, 65 - i)), 16, 10).cast("decimal(20,0)")).cast("string") for i in range(1, 65, digits)]


def content_hash(df: DataFrame) -> DataFrame:
    """rows and a SHA-256 that depends on the rows and column names, not on their order.

    The rows' digests are added up in full, 256 bits each, so that equal hashes of different rows would be a collision of
    SHA-256; then count, sums and the column names, written with their lengths, are hashed.
    """
    names = sorted(df.columns)
    sums = multiset_sums(row_key(df, names))
    head = "".join(f"{len(n)}:{n}" for n in (re.sub(r"\s+", " ", c) for c in names))
    facts = df.agg(F.count("*").alias("rows"), F.array(*(F.coalesce(s, F.lit("0")) for s in sums)).alias("sums"))
    return facts.select("rows", F.sha2(F.concat(F.lit(head), F.lit("/"), F.col("rows").cast("string"), F.lit("/"), F.array_join("sums", "/")), 256).alias("sha256"))


def clipped(df: DataFrame, column: str, low: float, high: float) -> DataFrame:
    return df.withColumn(column, clip(F.col(column), low, high))


def transformation_record(operation: str, before: DataFrame, after: DataFrame, previous: str = "") -> DataFrame:
    """operation, content hashes before and after, and a hash that chains the record to the one before it."""
    a, b = content_hash(before).select(F.col("sha256").alias("before")), content_hash(after).select(F.col("sha256").alias("after"))
    record = a.crossJoin(b).select(F.lit(operation).alias("operation"), "before", "after")
    return record.withColumn("record", F.sha2(F.concat_ws("|", F.lit(previous), "operation", "before", "after"), 256))
