"""Listing, paging and search over done links."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.functions.domains import enrich
from linkloom.functions.text import is_empty, like_anywhere
from linkloom.operators.worklists import has_status
from linkloom.scale import number_rows
from linkloom.schema import DONE

PER_PAGE_DEFAULT = 20
PER_PAGE_MAX = 100
SORT_DEFAULT = "newest"
SORTS = ("newest", "oldest", "title", "id_desc", "id_asc")

# Pages up to this place need no index.
TOP_ROWS = 1000

# An index keeps so many neighbouring rows in one slice; a page lies in one or two.
SLICE_ROWS = 1 << 17

COLUMNS = ["id", "url", "title", "description", "category", "processed_at", "added_at"]


def sort_columns(sort: str) -> list[Column]:
    """Order of a listing; an unknown name means newest first. The id makes it total."""
    if sort == "oldest":
        return [F.asc("added_at"), F.asc("id")]
    if sort == "title":
        return [F.coalesce("title", "url").asc(), F.asc("id")]
    if sort == "id_desc":
        return [F.desc("id")]
    if sort == "id_asc":
        return [F.asc("id")]
    return [F.desc("added_at"), F.desc("id")]


def listing(urls: DataFrame) -> DataFrame:
    manual = F.coalesce("manual_override", F.lit(0)).alias("manual_override")
    return urls.filter(has_status(DONE)).select(*COLUMNS, manual)


def by_category(urls: DataFrame, category: str) -> DataFrame:
    return listing(urls).filter(F.col("category") == category)


def recent(urls: DataFrame) -> DataFrame:
    return listing(urls)


def uncategorized(urls: DataFrame) -> DataFrame:
    return listing(urls).filter(is_empty("category"))


# What a search may name instead of a category: the listing to search in.
SCOPES = {"": recent, "recent": recent, "uncategorized": uncategorized}


def search(urls: DataFrame, query: str = "", category: str = "") -> DataFrame:
    """Substring search in title, description and link, in all rows, a category or those without one."""
    rows = SCOPES[category](urls) if category in SCOPES else by_category(urls, category)
    if not query:
        return rows
    return rows.filter(reduce(or_, [like_anywhere(F.col(c), query) for c in ("title", "description", "url")]))


def ranked(rows: DataFrame, sort: str = SORT_DEFAULT) -> DataFrame:
    """The order of a listing as an index: ``id``, its place ``row_no`` (from 1), and ``slice``, which holds ``SLICE_ROWS`` places.

    Ids and sort columns are sorted once over many tasks, so equal titles or times may be any share of the rows.
    """
    keys = rows.select("id", "added_at", "title", "url")
    numbered = number_rows(keys, sort_columns(sort))
    return numbered.select("id", "row_no", F.floor((F.col("row_no") - 1) / F.lit(SLICE_ROWS)).alias("slice"))


def write_index(index: DataFrame, path: str) -> None:
    """Store an index by slice, so that a page reads the slices it lies in and no others."""
    index.repartitionByRange("slice").sortWithinPartitions("row_no").write.partitionBy("slice").mode("overwrite").parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("id long, row_no long, slice long").parquet(path)


def page(
    rows: DataFrame, page: int = 1, per_page: int = PER_PAGE_DEFAULT, sort: str = SORT_DEFAULT, index: DataFrame | None = None
) -> DataFrame:
    """One page of a listing, enriched.

    The places of the page are looked up in ``index``, made by :func:`ranked` for these rows and kept for any number of pages, or made here
    for this one. Without an index a page among the first ``TOP_ROWS`` places is cut off the top in one pass, in which no task keeps more
    rows than that. At most ``per_page`` ids then find their rows, so no page keeps more than that, however far down it is.
    """
    per_page = min(per_page, PER_PAGE_MAX)
    first, last = (page - 1) * per_page + 1, page * per_page
    order = sort_columns(sort)
    if index is None and last <= TOP_ROWS:
        keys = rows.select(*[F.col(c).alias(c) for c in ("id", "added_at", "title", "url")])
        wanted = keys.orderBy(*order).offset(first - 1).limit(per_page).select("id")
        return enrich(rows.join(F.broadcast(wanted), "id", "left_semi").orderBy(*order))
    index = ranked(rows, sort) if index is None else index
    slices = F.col("slice").between((first - 1) // SLICE_ROWS, (last - 1) // SLICE_ROWS)
    wanted = index.filter(slices & F.col("row_no").between(first, last)).select("id", "row_no")
    return enrich(rows.join(F.broadcast(wanted), "id").orderBy("row_no").drop("row_no"))


def page_info(rows: DataFrame, per_page: int = PER_PAGE_DEFAULT) -> DataFrame:
    """One row: total rows and number of pages (at least one)."""
    per_page = min(per_page, PER_PAGE_MAX)
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    return total.withColumn("pages", F.greatest(F.lit(1), F.ceil(F.col("total") / F.lit(per_page))).cast("long"))
