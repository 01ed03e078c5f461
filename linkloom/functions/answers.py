"""Mapping free model answers to taxonomy names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.functions import text

# Marks that may surround an answer, and the words that may introduce it.
MARKS = "\"'.,;:-"
LINE_MARKS = MARKS + "*"
BOLD = r"(?d)\*\*(.+?)\*\*"
LABELLED = rf"(?iuUd)(?:категория|катерия|category)[{text.WS}]*[:—–-][{text.WS}]*(.+)"
NUMBERED = rf"(?Ud)\A([0-9]+)[.)][{text.WS}]+(.+)\z"

# What disqualifies a free-text tag.
TAG_MAX_LEN = 40
TAG_MAX_WORDS = 4
BAD_TAG_PREFIXES = ("url:", "http", "title:", "category:", "the web", "the page", "i'm sorry")
BAD_TAG_WORDS = ("web page", "web site", "sorry")


def names_by_key(categories: DataFrame) -> DataFrame:
    """``key`` (a name in lower case) and the canonical ``name``, one row per key."""
    return categories.groupBy(F.lower("name").alias("key")).agg(F.max_by("name", F.struct("sort_order", "id")).alias("name"))


def candidates(raw: Column) -> Column:
    """What an answer may name, in lower case and in the order of preference.

    The whole text, the first bold run, the text after a label, each line.
    """
    first = F.array(
        text.strip_marks(raw, MARKS),
        text.strip_marks(F.regexp_extract(raw, BOLD, 1), MARKS),
        text.strip_marks(F.regexp_extract(raw, LABELLED, 1), LINE_MARKS),
    )
    by_line = F.transform(text.lines(raw), lambda line: text.strip_marks(line, LINE_MARKS))
    return F.transform(F.concat(first, by_line), lambda c: F.lower(c))


def fingerprint(raw: Column) -> Column:
    """What stands for an answer in joins, so that its text, and the row it belongs to, stay where they are."""
    return F.sha2(F.coalesce(raw, F.lit("")), 256)


def named(texts: DataFrame, categories: DataFrame, text: str, keys: list[str], rank: list[Column] | None = None) -> DataFrame:
    """``keys`` with the ``category`` that their texts name; keys without a name are left out.

    Every candidate is a row of keys, ranks and the candidate alone, and only candidates that are a name go on. Of several the largest
    by ``rank`` counts, then the most preferred one; repeats of a key are merged in the map tasks.
    """
    ranks = {f"_rank{i}": c for i, c in enumerate(rank or [])}
    listed = texts.select(*keys, *[c.alias(n) for n, c in ranks.items()], F.posexplode(candidates(F.col(text))).alias("_pos", "key"))
    found = listed.join(names_by_key(categories), "key")
    best = F.max_by("name", F.struct(*ranks, (-F.col("_pos")).alias("_preferred")))
    return found.groupBy(*keys).agg(best.alias("category"))


def numbered_lines(raw: Column) -> Column:
    """The lines of a numbered-list answer as (item, text); lines of another form have no item."""

    def one_line(line: Column) -> Column:
        line = text.strip(line)
        return F.struct(
            F.regexp_extract(line, NUMBERED, 1).try_cast("int").alias("item"), F.regexp_extract(line, NUMBERED, 2).alias("text")
        )

    return F.transform(text.lines(text.strip(raw)), one_line)


def is_valid_tag(tag: Column) -> Column:
    """False for long strings, addresses, refusals and whole sentences."""
    low = F.lower(tag)
    bad = (F.char_length(tag) > TAG_MAX_LEN) | (text.word_count(tag) > TAG_MAX_WORDS)
    for prefix in BAD_TAG_PREFIXES:
        bad = bad | low.startswith(prefix)
    for word in BAD_TAG_WORDS:
        bad = bad | low.contains(word)
    return ~bad
