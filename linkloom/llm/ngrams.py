"""Words and hashes of word windows as plain Spark columns."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEPARATORS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def folded_words(text: Column) -> Column:
    """The words of a text, ASCII letters lower-cased; NULL has none."""
    low = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(low, SEPARATORS), "")


def _later(array: Column, by: int) -> Column:
    return F.slice(array, by + 1, F.greatest(F.size(array) - by, F.lit(0)))


def _joined(left: Column, right: Column) -> Column:
    return F.zip_with(left, right, lambda a, b: F.xxhash64(a, b))


def with_windows(df: DataFrame, words: str, sizes: list[int]) -> DataFrame:
    """Add ``_w<size>`` for each size: the hash of every window of that many words, in order.

    Hashes of 1, 2, 4, ... words are combined by doubling, so a window costs a few hashes whatever its size. The
    arrays are built column by column, since one nested expression would be evaluated many times over.
    """
    if not sizes:
        return df
    out, steps = df.withColumn("_h1", F.transform(words, lambda w: F.xxhash64(w))) if set(sizes) & {1} else df, {1: words}
    width = 1
    while 2 * width <= max(sizes):
        out = out.withColumn(f"_h{2 * width}", _joined(F.col(steps[width]), _later(F.col(steps[width]), width)))
        steps[2 * width], width = f"_h{2 * width}", 2 * width
    for size in sizes:
        parts = [1 << b for b in range(size.bit_length() - 1, -1, -1) if size >> b & 1]
        made, at = F.col("_h1" if size == 1 else steps[parts[0]]), parts[0]
        for i, part in enumerate(parts[1:]):
            out = out.withColumn(f"_p{size}_{i}", _joined(made, _later(F.col(steps[part]), at)))
            made, at = F.col(f"_p{size}_{i}"), at + part
        out = out.withColumn(f"_w{size}", F.slice(made, 1, F.greatest(F.size(words) - (size - 1), F.lit(0))))
    return out
