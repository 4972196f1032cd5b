"""Cleaning of the value lists that filters take."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, functions as F

# The characters trimmed from filter values (Unicode white space).
WHITE_SPACE = (
    "\t\n\v\f\r \u0085\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008"
    "\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def clean_values(values: Iterable[str]) -> list[str]:
    """Split on commas, trim, drop blanks, keep the first of duplicates."""
    parts = (part.strip(WHITE_SPACE) for value in values for part in value.split(","))
    return list(dict.fromkeys(part for part in parts if part))


def clean_values_column(values: Column | str) -> Column:
    """The same over an array-of-text column."""
    parts = F.flatten(F.transform(values, lambda v: F.split(v, ",", -1)))
    trimmed = F.transform(parts, lambda p: F.btrim(p, F.lit(WHITE_SPACE)))
    return F.array_distinct(F.filter(trimmed, lambda p: p != ""))
