"""One-off clean-ups and the benchmark subset."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.functions.answers import names_by_key
from linkloom.functions.domains import norm_domain
from linkloom.functions.text import is_filled
from linkloom.operators.status import rewrite
from linkloom.operators.worklists import has_status
from linkloom.scale import first_n, one_per_key
from linkloom.schema import DONE, URL_DEFAULTS, URLS

# Fixed pattern: how a failed request names its HTTP code.
HTTP_CODE = r"(?U)(\d{3})\s+(Client|Server)\s+Error"


def eligible(urls: DataFrame) -> DataFrame:
    """Rows usable for a benchmark run: done, titled, with a category that is not NULL."""
    return urls.filter(has_status(DONE) & F.col("category").isNotNull() & is_filled("title"))


def eligible_count(urls: DataFrame) -> DataFrame:
    return eligible(urls).agg(F.count(F.lit(1)).alias("eligible"))


def snapshot_rows(urls: DataFrame, limit: int) -> DataFrame:
    return first_n(eligible(urls).select("id", "category", "tagged_by"), limit)


def restore(urls: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Put category and tagged_by back from a snapshot."""
    old = one_per_key(snapshot.select("id", "category", "tagged_by"), ["id"]).select(
        "id", F.col("category").alias("_category"), F.col("tagged_by").alias("_tagged_by"), F.lit(True).alias("_hit")
    )
    merged = rewrite(
        urls.join(old, "id", "left"), F.col("_hit"), {"category": F.col("_category"), "tagged_by": F.col("_tagged_by")}
    )
    return merged.select(*urls.columns, "changed")


def benchmark_ids(urls: DataFrame, n: int) -> DataFrame:
    """The first ``n`` done links with a title that is not NULL."""
    return first_n(urls.filter(has_status(DONE) & F.col("title").isNotNull()).select("id"), n)


def reset_subset(urls: DataFrame, ids: DataFrame) -> DataFrame:
    hits = ids.select("id", F.lit(True).alias("_hit")).distinct()
    merged = rewrite(urls.join(hits, "id", "left"), F.col("_hit"), {"category": None, "tagged_by": None})
    return merged.select(*urls.columns, "changed")


def count_classified(urls: DataFrame, ids: DataFrame) -> DataFrame:
    subset = urls.filter(F.col("category").isNotNull()).join(ids.select("id"), "id", "left_semi")
    return subset.agg(F.count(F.lit(1)).alias("classified"))


def _mapped(urls: DataFrame, mapping: DataFrame) -> DataFrame:
    """``urls`` with the new category and the action: rename, same or null."""
    pairs = one_per_key(mapping.select("old", "new"), ["old"]).select(F.col("old").alias("_old"), F.col("new").alias("_new"))
    joined = urls.join(pairs, F.col("category") == F.col("_old"), "left")
    action = F.when(
        is_filled("category"),
        F.when(F.coalesce("_new", F.lit("")) == "", "null")
        .when(F.col("_new") == F.col("category"), "same")
        .otherwise("rename"),
    )
    return joined.withColumn("_action", action)


def migration_report(urls: DataFrame, mapping: DataFrame) -> DataFrame:
    """Dry run: per category, where it would go and how many rows that moves."""
    sizes = urls.filter(is_filled("category")).groupBy("category").agg(F.count(F.lit(1)).alias("count"))
    planned = _mapped(sizes, mapping)
    return planned.select("category", F.col("_action").alias("action"), F.col("_new").alias("new_category"), "count").orderBy(
        "category"
    )


def migration_totals(urls: DataFrame, mapping: DataFrame) -> DataFrame:
    """One row: rows renamed, rows emptied, categories without a mapping."""
    n, action = F.col("count"), F.col("action")
    return migration_report(urls, mapping).agg(
        F.coalesce(F.sum(F.when(action == "rename", n)), F.lit(0)).alias("renamed"),
        F.coalesce(F.sum(F.when(action == "null", n)), F.lit(0)).alias("nulled"),
        F.count_if(action == "null").alias("unmapped"),
    )


def migrate_categories(urls: DataFrame, mapping: DataFrame) -> DataFrame:
    """Apply the mapping; categories without one become NULL."""
    moved = rewrite(
        _mapped(urls, mapping),
        F.col("_action").isin("rename", "null"),
        {"category": F.when(F.col("_action") == "rename", F.col("_new"))},
    )
    return moved.select(*urls.columns, "changed")


def backfill_error_code(urls: DataFrame) -> DataFrame:
    """Read missing error codes out of the error text."""
    code = F.regexp_extract("error", HTTP_CODE, 1).try_cast("int")
    return rewrite(urls, F.col("error_code").isNull() & code.isNotNull(), {"error_code": code})


def match_cleanup(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Add ``rule_no``, the first clean-up rule that a row meets.

    ``rules`` is (rule_no, error_code, domain); a NULL domain means any. Exact rules and
    any-domain rules are two equi-joins on the code, so no join condition needs a nested loop.
    """
    exact = (
        rules.filter(F.col("domain").isNotNull())
        .groupBy(F.col("error_code").alias("_code"), F.lower("domain").alias("_domain"))
        .agg(F.min("rule_no").alias("_exact"))
    )
    general = (
        rules.filter(F.col("domain").isNull())
        .groupBy(F.col("error_code").alias("_any_code"))
        .agg(F.min("rule_no").alias("_general"))
    )
    site = norm_domain(F.col("url"))
    return (
        urls.join(exact, (F.col("error_code") == F.col("_code")) & (site == F.col("_domain")), "left")
        .join(general, F.col("error_code") == F.col("_any_code"), "left")
        .withColumn("rule_no", F.least("_exact", "_general"))
        .select(*urls.columns, "rule_no")
    )


def cleanup(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Rows left after the clean-up rules."""
    return match_cleanup(urls, rules).filter(F.col("rule_no").isNull()).drop("rule_no")


def cleanup_counts(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Deleted rows per rule."""
    hit = match_cleanup(urls, rules).filter(F.col("rule_no").isNotNull())
    return hit.groupBy("rule_no").agg(F.count(F.lit(1)).alias("deleted"))


def tidy_categories(urls: DataFrame, categories: DataFrame, placeholders: tuple[str, ...] = ("(no title)",)) -> DataFrame:
    """Remove placeholder and comma categories; give the others their taxonomy spelling."""
    name = F.col("category")
    names = names_by_key(categories).select(F.col("key").alias("_key"), F.col("name").alias("_proper"))
    spelled = urls.join(names, F.lower("category") == F.col("_key"), "left")
    proper = F.col("_proper")
    junk = name.isin(*placeholders) | name.contains(",")
    tidied = rewrite(
        spelled,
        name.isNotNull() & (junk | (proper.isNotNull() & (proper != name))),
        {"category": F.when(~junk, proper)},
    )
    return tidied.select(*urls.columns, "changed")


def upgrade(urls: DataFrame) -> DataFrame:
    """Bring an older snapshot to the current columns; running it again changes nothing."""

    def column(field) -> Column:
        if field.name in urls.columns:
            return F.col(field.name).cast(field.dataType).alias(field.name)
        return F.lit(URL_DEFAULTS.get(field.name)).cast(field.dataType).alias(field.name)

    return urls.select(*[column(f) for f in URLS.fields])
