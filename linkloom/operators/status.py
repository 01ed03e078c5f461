"""Status transitions: each takes a ``urls`` snapshot and returns the next one.

The result has the same columns plus ``changed``; ``scale.affected`` counts it and
``settle`` drops it before the snapshot is written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.functions.text import is_empty, is_filled
from linkloom.operators.worklists import has_status, is_transient
from linkloom.scale import one_per_key
from linkloom.schema import DEFERRED, DONE, ERROR, PENDING

# What a row loses when it goes back to the queue.
_FRESH = {"status": PENDING, "title": None, "error": None, "processed_at": None}
_RETRY = {"status": PENDING, "error": None, "error_code": None, "processed_at": None}


def rewrite(df: DataFrame, where: Column, values: dict[str, Column | str | int | None]) -> DataFrame:
    """Set columns on the rows that match; all values see the row as it was before."""
    hit = where & where.isNotNull()  # never NULL, and unlike coalesce a filter on it reaches the scan
    types = {f.name: f.dataType for f in df.schema.fields}
    changes = {
        name: F.when(where, value if isinstance(value, Column) else F.lit(value)).otherwise(F.col(name)).cast(types[name])
        for name, value in values.items()
    }
    return df.withColumns({**changes, "changed": hit})


def settle(df: DataFrame) -> DataFrame:
    return df.drop("changed")


def reset_all(urls: DataFrame) -> DataFrame:
    """Everything back to pending. Description, error code and category stay as they were."""
    return rewrite(urls, F.lit(True), _FRESH)


def reset_url(urls: DataFrame, url: str) -> DataFrame:
    return rewrite(urls, F.col("url") == url, _FRESH)


def reset_ids(urls: DataFrame, ids: DataFrame) -> DataFrame:
    """Like :func:`reset_url`, for a table of ids."""
    hits = ids.select("id", F.lit(True).alias("_hit")).distinct()
    return rewrite(urls.join(hits, "id", "left"), F.col("_hit"), _FRESH).select(*urls.columns, "changed")


def reset_errors(urls: DataFrame) -> DataFrame:
    return rewrite(urls, has_status(ERROR), _RETRY)


def reset_transient_errors(urls: DataFrame) -> DataFrame:
    return rewrite(urls, has_status(ERROR) & is_transient(), _RETRY)


def defer_errors(urls: DataFrame, codes: list[int] | None = None) -> DataFrame:
    """Put errors aside; only those with the given codes when there are any."""
    where = has_status(ERROR)
    if codes:
        where = where & F.col("error_code").isin(*codes)
    return rewrite(urls, where, {"status": DEFERRED})


def undefer_all(urls: DataFrame) -> DataFrame:
    return rewrite(urls, has_status(DEFERRED), {"status": ERROR})


def delete_urls(urls: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows left after deleting a table of ids."""
    return urls.join(ids.select("id").distinct(), "id", "left_anti")


def delete_results(results: DataFrame, ids: DataFrame, cascade: bool = True) -> DataFrame:
    """Model results left after deleting those links; ``cascade=False`` keeps the orphans."""
    if not cascade:
        return results
    gone = ids.select(F.col("id").alias("url_id")).distinct()
    return results.join(gone, "url_id", "left_anti")


_OUTCOME = ("url", "title", "description", "error", "error_code")


def apply_fetch(urls: DataFrame, fetched: DataFrame, now: Column | None = None, order_by: str | None = None) -> DataFrame:
    """Write fetch outcomes: done with title and description, or error with message and code.

    Of several outcomes for a link the last by ``order_by`` counts, or the largest row without it.
    """
    now = F.current_timestamp() if now is None else now
    last = one_per_key(fetched.select(*_OUTCOME, *([order_by] if order_by else [])), ["url"], order_by)
    news = last.select(
        "url",
        F.col("title").alias("_title"),
        F.col("description").alias("_description"),
        F.col("error").alias("_error"),
        F.col("error_code").alias("_code"),
        F.lit(True).alias("_hit"),
    )
    failed = F.col("_error").isNotNull()
    merged = rewrite(
        urls.join(news, "url", "left"),
        F.col("_hit"),
        {
            "status": F.when(failed, ERROR).otherwise(DONE),
            "title": F.when(~failed, F.col("_title")),
            "description": F.when(~failed, F.col("_description")),
            "error": F.col("_error"),
            "error_code": F.when(failed, F.col("_code")),
            "processed_at": now,
        },
    )
    return merged.select(*urls.columns, "changed")


def latest_outcome(fetched: DataFrame, order_by: str) -> DataFrame:
    """Keep the last outcome per link."""
    return one_per_key(fetched, ["url"], order_by)


def refill_descriptions(urls: DataFrame, fetched: DataFrame, order_by: str | None = None) -> DataFrame:
    """Fill empty descriptions of done rows and touch nothing else; repeated links as in ``apply_fetch``.

    ``outcome`` is got, no_tag or error for rows that were tried, NULL for the others.
    """
    last = one_per_key(fetched.select("url", "description", "error", *([order_by] if order_by else [])), ["url"], order_by)
    news = last.select(
        "url", F.col("description").alias("_description"), F.col("error").alias("_error"), F.lit(True).alias("_hit")
    )
    tried = has_status(DONE) & is_empty("description") & F.col("_hit").isNotNull()
    outcome = F.when(
        tried,
        F.when(is_filled("_error"), "error")
        .when(is_filled("_description"), "got")
        .otherwise("no_tag"),
    )
    joined = urls.join(news, "url", "left").withColumn("outcome", outcome)
    filled = rewrite(joined, F.col("outcome") == "got", {"description": F.col("_description")})
    return filled.select(*urls.columns, "changed", "outcome")


def refill_summary(refilled: DataFrame) -> DataFrame:
    return refilled.filter(F.col("outcome").isNotNull()).groupBy("outcome").agg(F.count(F.lit(1)).alias("count"))


def fetch_summary(fetched: DataFrame) -> DataFrame:
    """One row: fetched well, failed, total."""
    failed = F.col("error").isNotNull()
    return fetched.agg(
        F.count_if(~failed).alias("done"),
        F.count_if(failed).alias("errors"),
        F.count(F.lit(1)).alias("total"),
    )

