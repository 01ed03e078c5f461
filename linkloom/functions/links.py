"""Finding links in free text."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from linkloom.functions.text import WS

# Fixed patterns: a link runs to the next white space, bar, angle bracket or quote.
LINK = rf"(?U)https?://[^{WS}|<>\"'`]+"
TRAILING_MARKS = r"[.,;!?)]+\z"


def find_links(text: Column) -> Column:
    """Array of all links of a text, in order, without trailing punctuation."""
    return F.transform(
        F.regexp_extract_all(text, F.lit(LINK), F.lit(0)),
        lambda link: F.regexp_replace(link, TRAILING_MARKS, ""),
    )
