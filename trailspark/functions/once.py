"""Columns that are computed once, whatever is done with them later."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def compute_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add costly columns in a way that a later filter reads their values.

    A filter on a projected column is moved below the projection, where its expression is
    evaluated again for every mention. It is not moved below a generator, and a generator of
    one row per row adds just the columns. Filters on other columns still move to the scan.
    """
    row = F.struct(*(column.alias(name) for name, column in columns.items()))
    return df.select("*", F.inline_outer(F.array(row)))
