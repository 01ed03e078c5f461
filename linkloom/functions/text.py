"""String columns that behave like the reference's text handling.

White space here is the Unicode set plus the four ASCII separators 0x1C-0x1F, which Java's
``\\s`` leaves out even in Unicode mode.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

WS = r"\s\x1c-\x1f"
_LINE_BREAK = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"


def is_empty(col) -> Column:
    """NULL and the empty string both count as empty. Plain comparisons, so filters reach the scan."""
    col = F.col(col) if isinstance(col, str) else col
    return col.isNull() | (col == "")


def is_filled(col) -> Column:
    col = F.col(col) if isinstance(col, str) else col
    return col.isNotNull() & (col != "")


def strip(col: Column) -> Column:
    """Remove Unicode white space at both ends."""
    return F.regexp_replace(col, rf"(?U)\A[{WS}]+|[{WS}]+\z", "")


def strip_marks(col: Column, marks: str) -> Column:
    """Strip white space, then any run of the given characters at both ends."""
    return F.btrim(strip(col), F.lit(marks))


def lines(col: Column) -> Column:
    return F.split(col, _LINE_BREAK, -1)


def word_count(col: Column) -> Column:
    return F.size(F.filter(F.split(col, rf"(?U)[{WS}]+", -1), lambda w: w != ""))


def ascii_lower(col: Column) -> Column:
    """Fold A-Z only, as the reference's LIKE does; other alphabets keep their case."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def like_anywhere(col: Column, query: str) -> Column:
    """``%query%`` with ASCII-only case folding; ``%`` and ``_`` in the query stay wildcards."""
    escape = next(c for c in map(chr, range(1, 32)) if c not in query)
    needle = "".join(c.lower() if "A" <= c <= "Z" else c for c in query)
    return F.like(ascii_lower(col), F.lit(f"%{needle}%"), F.lit(escape))


def round_half_even(col: Column, digits: int) -> Column:
    """Round the exact binary value of a double to ``digits`` places, ties to even.

    ``bround`` rounds the shortest decimal print instead, which differs for values such as 0.35
    (stored slightly below its print). The error term of the scaling is exact because the
    factor is small: both halves of the split value multiply without rounding.
    """
    scale = float(10**digits)
    x = F.abs(col.cast("double"))
    scaled = x * F.lit(scale)
    big = x * F.lit(134217729.0)
    high = big - (big - x)
    missing = (high * F.lit(scale) - scaled) + (x - high) * F.lit(scale)
    whole = F.floor(scaled)
    half = (scaled - whole.cast("double")) - F.lit(0.5)
    up = (half > 0) | ((half == 0) & ((missing > 0) | ((missing == 0) & (whole % 2 == 1))))
    rounded = (whole + F.when(up, 1).otherwise(0)).cast("double") / F.lit(scale)
    return F.when(col < 0, -rounded).otherwise(rounded)


def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    return round_half_even(part * 100 / whole, digits)
