"""Text primitives with the semantics of the notes data model, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Line ends of str.splitlines().
LINE_END = "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"
FENCE = "(?s)```.*?```"


def strip(x: Column) -> Column:
    """Without white space (Unicode) at either end."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def rule(x: Column) -> Column:
    """The line stripped, null where it can't be a rule of front-matter."""
    return F.when(F.contains(x, F.lit("---")), strip(x))


def lines(x: Column) -> Column:
    """str.splitlines(): no empty element after a final line end."""
    parts = F.split(x, LINE_END, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def jaccard(a: Column, b: Column) -> Column:
    """Intersection over union of two arrays read as sets; 0 if both are empty."""
    return F.coalesce(F.size(F.array_intersect(a, b)) / F.nullif(F.size(F.array_union(a, b)), F.lit(0)), F.lit(0.0))


def tokens(x: Column) -> Column:
    return F.transform(F.regexp_extract_all(x, F.lit("[A-Za-z0-9]{3,}"), F.lit(0)), F.lower)


def title_tokens(title: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(title), r"(?U)[\s\-_]+"), lambda t: t != ""))


def words(x: Column) -> Column:
    return F.filter(F.split(x, r"(?U)\s+"), lambda w: w != "")


def round_half_even(x: Column, digits: int = 3) -> Column:
    """round() on the binary value: exact decimals decide, ties go to the even digit."""
    return F.bround(x.cast("decimal(38,18)"), digits).cast("double")
