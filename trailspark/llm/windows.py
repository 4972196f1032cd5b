"""Hashes of all windows of words of a text, without user functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def add_window_hashes(df: DataFrame, words: str, name: str, window: int) -> DataFrame:
    """Add one hash per window of `window` words (a power of two), null for fewer words.

    Hashes of windows of 2, 4, … words are made from the hashes of their halves.
    """
    df = df.withColumn(name, F.when(F.size(words) >= window, F.transform(words, lambda w: F.xxhash64(w))))
    span = 1
    while span < window:
        df = df.withColumn(name, _doubled(F.col(name), span))
        span *= 2
    return df


def _doubled(hashes: Column, span: int) -> Column:
    count = F.size(hashes) - span
    left, right = F.slice(hashes, F.lit(1), count), F.slice(hashes, F.lit(span + 1), count)
    return F.zip_with(left, right, lambda a, b: F.xxhash64(a, b))
