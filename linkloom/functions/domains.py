"""The three notions of a link's domain, and the domain filter."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.functions.text import strip


def netloc(url: Column) -> Column:
    """Host part with port and user info, as written; empty when there is no ``scheme://``."""
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)


def norm_domain(url: Column) -> Column:
    """Lower-cased host without one leading ``www.``."""
    return F.regexp_replace(F.lower(netloc(url)), r"^www\.", "")


def rule_domain(url: Column) -> Column:
    """Key for the domain rules: like :func:`norm_domain` but with the case kept."""
    return F.regexp_replace(netloc(url), r"^www\.", "")


def report_domain(url: Column) -> Column:
    """Domain as the reports show it: up to the next slash, every ``www.`` removed."""
    rest = F.substr(url, F.instr(url, "://") + 3)
    return F.replace(F.substring_index(rest, "/", 1), F.lit("www."), F.lit(""))


def where_domain(df: DataFrame, domain: str, url: str = "url") -> DataFrame:
    """Rows of one domain; case and a leading ``www.`` of the argument do not matter."""
    return df.filter(norm_domain(F.col(url)) == F.lit(domain.lower().removeprefix("www.")))


def enrich(df: DataFrame) -> DataFrame:
    """Add ``domain`` and the comma-separated categories as a list."""
    parts = F.transform(F.split(F.coalesce("category", F.lit("")), ",", -1), strip)
    return df.withColumns(
        {"domain": rule_domain(F.col("url")), "categories_list": F.filter(parts, lambda c: c != "")}
    )

