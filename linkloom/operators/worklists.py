"""Work lists read from the ``urls`` table. Pass ``ordered=False`` inside a job that needs no sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.functions.domains import norm_domain, where_domain
from linkloom.functions.text import is_empty, is_filled
from linkloom.scale import ID_SPAN, first_n, rank_by_bucket
from linkloom.schema import DONE, ERROR, PENDING, TRANSIENT_CODES


def has_status(status: str) -> Column:
    return F.col("status") == status


def is_transient() -> Column:
    """A retry may help: a transient HTTP code, or no code at all (network failure)."""
    return F.col("error_code").isNull() | F.col("error_code").isin(*TRANSIENT_CODES)


def not_manual() -> Column:
    """The category was not set by hand."""
    return F.col("manual_override").isNull() | (F.col("manual_override") == 0)


def is_unclassified_work() -> Column:
    return has_status(DONE) & is_empty("category") & not_manual() & is_filled("title")


def _sorted(df: DataFrame, ordered: bool) -> DataFrame:
    return df.orderBy("id") if ordered else df


def pending(urls: DataFrame, domain: str | None = None, limit: int | None = None, ordered: bool = True) -> DataFrame:
    work = urls.filter(has_status(PENDING)).select("id", "url")
    if domain:
        work = where_domain(work, domain)
    return _sorted(first_n(work, limit), ordered)


def done(
    urls: DataFrame,
    domain: str | None = None,
    limit: int | None = None,
    with_description: bool = True,
    ordered: bool = True,
) -> DataFrame:
    """Rows for a model comparison run."""
    work = urls.filter(has_status(DONE)).select("id", "url", "title", "description")
    if domain:
        work = where_domain(work, domain)
    if not with_description:
        work = work.withColumn("description", F.lit(None).cast("string"))
    return _sorted(first_n(work, limit), ordered)


def done_without_description(
    urls: DataFrame, domain: str | None = None, limit: int | None = None, ordered: bool = True
) -> DataFrame:
    work = urls.filter(has_status(DONE) & is_empty("description")).select("id", "url")
    if domain:
        work = where_domain(work, domain)
    return _sorted(first_n(work, limit), ordered)


def errors(urls: DataFrame, domain: str | None = None, ordered: bool = True) -> DataFrame:
    failed = urls.filter(has_status(ERROR)).select("id", "url", "error", "error_code")
    if domain:
        failed = where_domain(failed, domain)
    return _sorted(failed, ordered)


def retryable_errors(urls: DataFrame) -> DataFrame:
    return urls.filter(has_status(ERROR) & is_transient()).select("id", "url", "error_code")


def unclassified(
    urls: DataFrame, limit: int | None = None, with_description: bool = True, ordered: bool = True
) -> DataFrame:
    """Rows that still need a category: done, titled, not set by hand."""
    work = urls.filter(is_unclassified_work()).select("id", "url", "title", "description")
    if not with_description:
        work = work.withColumn("description", F.lit(None).cast("string"))
    return _sorted(first_n(work, limit), ordered)


def round_robin(work: DataFrame, id_span: int = ID_SPAN) -> DataFrame:
    """Polite fetch order: one link of each domain in turn, domains in first-seen order.

    ``turn`` and ``domain_first_id`` are the order. A dominant domain is ranked in id slices,
    so no task holds all of it.
    """
    keyed = work.withColumn("domain", norm_domain(F.col("url")))
    ranked = rank_by_bucket(
        keyed,
        ["domain"],
        F.floor(F.col("id") / F.lit(id_span)),
        ["id"],
        "turn",
        group_min={"domain_first_id": "id"},
    )
    return ranked.drop("turn_of").orderBy("turn", "domain_first_id")


def urls_by_ids(urls: DataFrame, ids: DataFrame) -> DataFrame:
    """Look up the links of a table of ids."""
    wanted = ids.select("id").distinct()
    return urls.select("id", "url").join(wanted, "id", "left_semi")
