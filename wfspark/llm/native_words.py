"""Words and word n-grams as Column expressions."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What stands between words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`.
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words of a text with A-Z lowered; null has none."""
    low = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(low, _BETWEEN), "")


def shifted(array: Column, n: int) -> list[Column]:
    """The array from its first, second, ... n-th item on, all as long as the last of them; empty for a shorter array."""
    size = F.greatest(F.size(array) - (n - 1), F.lit(0))
    return [F.slice(array, F.lit(k + 1), size) for k in range(n)]


def grams(words_: Column, n: int) -> Column:
    """Hash of every n consecutive words, in order; empty for fewer words. ``words_`` should be a column, not an expression: it is read n times.
    Nothing outside a lambda is named in it, or it would be worked out anew for every word."""
    return F.transform(F.arrays_zip(*shifted(words_, n)), lambda x: F.xxhash64(x))


def small_enough(df: DataFrame, most: int) -> bool:
    """Does the frame have no more rows than that? Counts at most one row beyond."""
    return df.limit(most + 1).count() <= most


def joined(left: DataFrame, right: DataFrame, on: list[str], how: str, most: int = 2_000_000) -> DataFrame:
    """Join with a right side that is sent to every task only if it has no more than ``most`` rows; else both sides are shuffled."""
    return left.join(F.broadcast(right) if small_enough(right, most) else right, on, how)
