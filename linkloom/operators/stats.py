"""Statistics over ``urls``. Each report is one pass with map-side partial aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from linkloom.functions.domains import report_domain
from linkloom.functions.text import is_empty, is_filled, percent, strip
from linkloom.operators.worklists import has_status, is_transient
from linkloom.schema import DEFERRED, DONE, ERROR, PERMANENT_CODES, STATUSES

# Labels of deferred-error reasons.
CODE_LABELS = {
    "403": "403 — доступ запрещён (антибот)",
    "429": "429 — слишком много запросов",
    "401": "401 — требуется авторизация",
    "503": "503 — сервер временно недоступен",
    "502": "502 — ошибка шлюза",
    "500": "500 — ошибка сервера",
    "451": "451 — заблокировано по закону",
    "network": "Сеть — таймаут или нет ответа",
}


def _rows() -> Column:
    return F.count(F.lit(1))


def status_counts(urls: DataFrame) -> DataFrame:
    """One row: a count per status and the total."""
    return urls.agg(_rows().alias("total"), *[F.count_if(has_status(s)).alias(s) for s in STATUSES])


def full_stats(urls: DataFrame, results: DataFrame) -> DataFrame:
    """Status counts plus classified, unclassified, percent and links with model results."""
    classified = F.count_if(has_status(DONE) & is_filled("category"))
    counts = urls.agg(
        _rows().alias("total"),
        *[F.count_if(has_status(s)).alias(s) for s in STATUSES],
        classified.alias("classified"),
    )
    compared = results.agg(F.countDistinct("url_id").alias("n")).scalar()
    share = F.when(F.col("done") > 0, F.floor(F.try_divide(F.col("classified") * 100, F.col("done")))).otherwise(0)
    return counts.withColumns(
        {
            "unclassified": F.col("done") - F.col("classified"),
            "classified_pct": share.cast("long"),
            "compared": compared,
        }
    )


def analytics(urls: DataFrame) -> DataFrame:
    """One row of counters over the done links."""
    title, description, category = is_filled("title"), is_filled("description"), is_filled("category")
    manual = F.coalesce("manual_override", F.lit(0)) == 1
    counters = {
        "with_title": title,
        "without_title": ~title,
        "with_desc": description,
        "without_desc": ~description,
        "classified": category,
        "unclassified": ~category,
        "manual_override": manual,
        "ready_for_llm": ~category & title,
        "unclass_no_title": ~category & ~title,
    }
    return urls.filter(has_status(DONE)).agg(
        _rows().alias("done"), *[F.count_if(c).alias(n) for n, c in counters.items()]
    )


def _top_domains(rows: DataFrame, k: int) -> DataFrame:
    return (
        rows.groupBy(report_domain(F.col("url")).alias("domain"))
        .agg(_rows().alias("count"))
        .orderBy(F.desc("count"), "domain")
        .limit(k)
    )


def domains_without_title(urls: DataFrame, k: int = 10) -> DataFrame:
    return _top_domains(urls.filter(has_status(DONE) & is_empty("title")), k)


def domains_without_category(urls: DataFrame, k: int = 10) -> DataFrame:
    return _top_domains(urls.filter(has_status(DONE) & is_empty("category") & is_filled("title")), k)


def category_counts(urls: DataFrame) -> DataFrame:
    return urls.filter(has_status(DONE) & is_filled("category")).groupBy("category").agg(_rows().alias("count"))


def categories_with_counts(urls: DataFrame, k: int | None = None) -> DataFrame:
    """Categories of done links, largest first."""
    ranked = category_counts(urls).orderBy(F.desc("count"), "category")
    return ranked if k is None else ranked.limit(k)


def deferred_by_code(urls: DataFrame) -> DataFrame:
    """Deferred links per error code with a label; no code means a network failure."""
    counted = urls.filter(has_status(DEFERRED)).groupBy("error_code").agg(_rows().alias("count"))
    code = F.when(F.coalesce("error_code", F.lit(0)) == 0, "network").otherwise(F.col("error_code").cast("string"))
    labels = F.create_map(*[F.lit(x) for pair in CODE_LABELS.items() for x in pair])
    return counted.withColumn("label", F.coalesce(F.try_element_at(labels, code), code)).orderBy(
        F.desc("count"), "error_code"
    )


def is_incomplete() -> Column:
    return has_status(DONE) & (is_empty("title") | is_empty("description"))


def dashboard(urls: DataFrame) -> DataFrame:
    """One row: done links, categories in use, errors, transient errors, incomplete, pending."""
    return urls.agg(
        F.count_if(has_status(DONE)).alias("total_urls"),
        F.countDistinct(F.when(has_status(DONE) & is_filled("category"), F.col("category"))).alias("total_categories"),
        F.count_if(has_status(ERROR)).alias("error_count"),
        F.count_if(has_status(ERROR) & is_transient()).alias("transient_error_count"),
        F.count_if(is_incomplete()).alias("incomplete_count"),
        F.count_if(has_status("pending")).alias("pending_count"),
    )


def counters(urls: DataFrame) -> DataFrame:
    """The four single counters as (counter, count) rows, from one pass."""
    wide = urls.agg(
        F.count_if(has_status("pending")).alias("pending"),
        F.count_if(has_status(ERROR)).alias("error"),
        F.count_if(has_status(ERROR) & is_transient()).alias("transient_error"),
        F.count_if(is_incomplete()).alias("incomplete"),
    )
    return wide.unpivot([], ["pending", "error", "transient_error", "incomplete"], "counter", "count")


def error_buckets(urls: DataFrame) -> DataFrame:
    """Error rows by code or failure type with share of all errors and whether a retry may help."""
    low = F.lower(F.coalesce("error", F.lit("")))
    no_code = (
        F.when(low.contains("timed out") | low.contains("timeout") | low.contains("connection"), "network")
        .when(low.contains("ssl") | low.contains("tls"), "ssl")
        .otherwise("other")
    )
    kind = (
        F.when(is_transient(), "retriable")
        .when(F.col("error_code").isin(*PERMANENT_CODES), "permanent")
        .otherwise("mixed")
    )
    failed = urls.filter(has_status(ERROR)).select(
        F.coalesce(F.col("error_code").cast("string"), no_code).alias("bucket"), kind.alias("kind")
    )
    counted = failed.groupBy("bucket", "kind").agg(_rows().alias("count"))
    return counted.withColumn("share", _share_of_all()).orderBy(F.desc("count"), "bucket")


def _share_of_all() -> Column:
    """Percent of the total of a small counted table; the window holds one row per bucket."""
    return percent(F.col("count"), F.sum("count").over(W.partitionBy(F.lit(0))))


def error_kinds(urls: DataFrame) -> DataFrame:
    """Retriable, permanent and mixed subtotals."""
    summed = error_buckets(urls).groupBy("kind").agg(F.sum("count").alias("count"))
    return summed.withColumn("share", _share_of_all())


def classified(urls: DataFrame) -> DataFrame:
    return urls.filter(F.col("category").isNotNull()).select("url", "title", "category", "tagged_by")


def description_coverage(urls: DataFrame) -> DataFrame:
    """One row: done links with a description, all done links, percent."""
    have = urls.filter(has_status(DONE)).agg(F.count_if(is_filled("description")).alias("have"), _rows().alias("total"))
    return have.withColumn("pct", F.when(F.col("total") > 0, percent(F.col("have"), F.col("total"))))


def category_review(urls: DataFrame) -> DataFrame:
    """Every category with a sample link and flags: red looks broken, yellow is used once."""
    name = F.col("category")
    red = name.contains("URL:") | name.contains("Category:") | name.rlike(r"(?U)\A\d") | (F.char_length(name) > 60)
    return (
        urls.filter(name.isNotNull())
        .groupBy("category")
        .agg(_rows().alias("count"), F.min("url").alias("example_url"))
        .withColumns({"red": red, "yellow": ~red & (F.col("count") == 1)})
        .orderBy(F.desc("count"), "category")
    )


def category_listing(urls: DataFrame) -> DataFrame:
    return urls.filter(F.col("category").isNotNull()).select("category", "title", "url").orderBy("category", "title", "url")


def tag_frequency(urls: DataFrame) -> DataFrame:
    """Tags of comma-separated category lists with their number of uses, most used first."""
    tags = urls.select(F.explode(F.split("category", ",")).alias("_tag")).select(strip(F.col("_tag")).alias("tag"))
    return tags.filter("tag != ''").groupBy("tag").agg(_rows().alias("count")).orderBy(F.desc("count"), "tag")


def tag_totals(urls: DataFrame) -> DataFrame:
    return tag_frequency(urls).agg(_rows().alias("unique_tags"), F.coalesce(F.sum("count"), F.lit(0)).alias("assignments"))
