"""Scalar expressions used by the operators: null-safe ratios, yes/no flags, text similarity, canonical cells."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# The words that count as yes and no.
YES = ("true", "yes", "y", "1", "t")
NO = ("false", "no", "n", "0", "f")
#: The label of a null group key.
MISSING = "<missing>"


def ratio(numerator: Column, denominator: Column, zero_value: float | None = None) -> Column:
    """numerator / denominator as a double; zero_value (default null) where the denominator is zero."""
    return F.when(denominator == 0, F.lit(zero_value).cast("double")).otherwise(numerator.cast("double") / F.nullif(denominator.cast("double"), F.lit(0.0)))


def group_label(column: str) -> Column:
    """A group key as text, null as its own group."""
    return F.coalesce(F.col(column).cast("string"), F.lit(MISSING)).alias(column)


def flag(column: Column) -> Column:
    """1 for a yes word, 0 for a no word, else null."""
    word = F.lower(F.trim(column.cast("string")))
    return F.when(word.isin(*YES), 1).when(word.isin(*NO), 0)


def similarity(a: Column, b: Column) -> Column:
    """Edit-distance similarity of two texts, 0 to 100; two empty texts are alike."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 100.0).otherwise((1 - F.levenshtein(a, b) / longest) * 100)


def contains_text(column: Column, part: str) -> Column:
    """Case-insensitive containment."""
    return F.contains(F.lower(column), F.lit(part.lower()))


def clip(column: Column, low, high) -> Column:
    """column held between low and high; null stays null."""
    return F.when(column.isNotNull(), F.least(F.greatest(column, F.lit(low)), F.lit(high)))


def fisher_z(r: Column) -> Column:
    """The inverse hyperbolic tangent of a correlation; null at -1 and 1."""
    return F.when(F.abs(r) < 1, F.atanh(r))


def canonical(column: Column, dtype: str) -> Column:
    """A cell as text that does not depend on engine or column order: doubles to ten significant digits."""
    if dtype in ("double", "float"):
        return F.format_string("%.9e", column.cast("double"))
    return column.cast("string")


def month_of(column: Column) -> Column:
    """The month of a date as yyyy-MM."""
    return F.date_format(column, "yyyy-MM")


def days_between(start: Column, end: Column) -> Column:
    """Days from start to end."""
    return F.datediff(end, start)


def bucketed(column: Column, edges: list[float]) -> Column:
    """The number of edges (ascending) at or below a value: of many edges, first the run that they are in, then the place in it."""
    count = lambda some: sum(((column >= e).cast("int") for e in some), F.lit(0))
    if len(edges) <= 32:
        return F.when(column.isNotNull(), count(edges))
    size = math.isqrt(len(edges)) + 1
    runs = [edges[i : i + size] for i in range(0, len(edges), size)]
    run = count([r[-1] for r in runs])
    inside = F.array(*(F.array(*map(F.lit, r)) for r in runs), F.array().cast("array<double>"))[run]
    return F.when(column.isNotNull(), F.least(run * size, F.lit(len(edges))) + F.size(F.filter(inside, lambda e: column >= e)))
