"""Edit distances over words and characters, and the rates made of them."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def edit_distance(a: Sequence, b: Sequence) -> int:
    """Unit-cost edit distance of two sequences, bit-parallel: a step for each element of b on integers of len(a) bits.

    What they have in common at both ends is left off first.  For texts of a page this is faster than the quadratic
    ``levenshtein`` of the JVM, which also has no form for words.
    """
    if a == b:
        return 0
    n = min(len(a), len(b))
    low = 0
    while low < n and a[low] == b[low]:
        low += 1
    high = 0
    while high < n - low and a[-1 - high] == b[-1 - high]:
        high += 1
    a, b = a[low : len(a) - high], b[low : len(b) - high]
    if not a or not b:
        return len(a) + len(b)
    masks: dict = {}
    for i, x in enumerate(a):
        masks[x] = masks.get(x, 0) | 1 << i
    top = 1 << (len(a) - 1)
    full = (top << 1) - 1
    up, down, score = full, 0, len(a)
    for x in b:
        eq = masks.get(x, 0)
        same = eq | down
        diagonal = (((eq & up) + up) ^ up) | eq
        right, left = down | ~(diagonal | up) & full, up & diagonal
        if right & top:
            score += 1
        elif left & top:
            score -= 1
        right, left = (right << 1 | 1) & full, left << 1 & full
        up, down = left | ~(same | right) & full, right & same
    return score


@F.pandas_udf(T.IntegerType())
def word_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else edit_distance(x.split(), y.split()) for x, y in zip(a, b)], dtype="Int32")


@F.pandas_udf(T.IntegerType())
def char_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else edit_distance(x, y) for x, y in zip(a, b)], dtype="Int32")


def error_rate(distance: Column, n_hypothesis: Column, n_reference: Column) -> Column:
    """Distance over the reference's length; for an empty reference 0 if the hypothesis is empty too, else 1.  May exceed 1."""
    return F.when(n_reference > 0, distance / n_reference).when(n_hypothesis == 0, 0.0).otherwise(1.0)
