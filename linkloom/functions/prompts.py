"""Prompt texts for the category model."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from linkloom.functions.text import is_filled

# Prompt wording.
SINGLE_HEAD = (
    "You are a professional librarian organizing a database of web pages.\n"
    "Assign exactly ONE category from the list below.\n"
    "\n"
    "STRICT RULE: You MUST choose from this list. Do NOT invent new categories.\n"
)
BATCH_HEAD = (
    "You are a professional librarian organizing a database of web pages.\n"
    "Assign exactly ONE category from the list below to each item.\n"
    "\n"
    "STRICT RULE: You MUST choose from this list. Do NOT invent new categories.\n"
)
BATCH_TAIL = "\nRespond with ONLY a numbered list. Format: 1. Category name"
NO_TITLE = "(no title)"
SINGLE_CUT = 200
BATCH_CUT = 150


def allowed_line(names: Column) -> Column:
    return F.concat(F.lit("Allowed categories: "), names, F.lit("\n"))


def shown_title(title: Column) -> Column:
    return F.when(is_filled(title), title).otherwise(F.lit(NO_TITLE))


def _description_line(description: Column, cut: int, lead: str) -> Column:
    line = F.concat(F.lit(f"{lead}Description: "), F.substring(description, 1, cut), F.lit("\n"))
    return F.when(is_filled(description), line).otherwise(F.lit(""))


def single_prompt(title: Column, description: Column, names: Column) -> Column:
    return F.concat(
        F.lit(SINGLE_HEAD),
        allowed_line(names),
        F.lit("\nTitle: "),
        shown_title(title),
        F.lit("\n"),
        _description_line(description, SINGLE_CUT, ""),
        F.lit("Category:"),
    )


def batch_item(number: Column, title: Column, description: Column) -> Column:
    return F.concat(
        number.cast("string"),
        F.lit(". Title: "),
        shown_title(title),
        _description_line(description, BATCH_CUT, "\n   "),
    )


def batch_prompt(items: Column, names: Column) -> Column:
    """``items`` is the array of item texts in their numbered order."""
    return F.concat(
        F.lit(BATCH_HEAD), allowed_line(names), F.lit(BATCH_TAIL), F.lit("\n\n"), F.array_join(items, "\n")
    )
