"""The labelled dataset: rows, text, class statistics, split and weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.functions.domains import norm_domain
from linkloom.functions.text import is_filled, percent, strip
from linkloom.operators.worklists import has_status
from linkloom.scale import number_rows, rank_by_bucket
from linkloom.schema import DONE

TEXT_CUT = 200
RARE_WEIGHT = 3.0


def exportable(urls: DataFrame) -> DataFrame:
    """Done links with title and category."""
    rows = urls.filter(has_status(DONE) & is_filled("title") & is_filled("category"))
    return rows.select("id", "url", "title", "description", "category")


def in_taxonomy(rows: DataFrame, categories: DataFrame) -> DataFrame:
    """Rows whose category is a taxonomy name in any case."""
    known = categories.select(F.lower("name").alias("_low")).distinct()
    return rows.join(known, F.lower("category") == F.col("_low"), "left_semi")


def frequent_classes(rows: DataFrame, at_least: int) -> DataFrame:
    """Drop classes with fewer rows, when the bound is above 1. Classes are counted, not ranked."""
    if at_least <= 1:
        return rows
    big = rows.groupBy("category").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= at_least)
    return rows.join(big.select("category"), "category", "left_semi")


def skipped(urls: DataFrame, categories: DataFrame, at_least: int = 0) -> DataFrame:
    """One row: exported rows and classes, and rows skipped by each filter.

    Works on the table of class sizes: one row per spelling of a category.
    """
    sizes = exportable(urls).groupBy("category").agg(F.count(F.lit(1)).alias("_n"))
    known = categories.select(F.lower("name").alias("_low"), F.lit(True).alias("_known")).distinct()
    marked = sizes.join(known, F.lower("category") == F.col("_low"), "left")
    listed = F.col("_known").isNotNull()
    enough = F.col("_n") >= (at_least if at_least > 1 else 0)

    def rows_where(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("_n"))), F.lit(0))

    return marked.agg(
        rows_where(listed & enough).alias("exported"),
        F.count_if(listed & enough).alias("classes"),
        rows_where(~listed).alias("skipped_taxonomy"),
        rows_where(listed & ~enough).alias("skipped_rare"),
    )


def training_text(title: Column, description: Column, url: Column, with_description: bool = True) -> Column:
    """Title, cut description and domain joined with the separator token."""
    parts = [strip(title)]
    if with_description:
        trimmed = strip(description)
        parts.append(F.when(trimmed != "", F.substring(trimmed, 1, TEXT_CUT)))
    return F.concat_ws(" [SEP] ", *parts, norm_domain(url))


def dataset(
    urls: DataFrame, categories: DataFrame, with_description: bool = True, at_least: int = 0
) -> DataFrame:
    """(id, text, label) of the whole export."""
    rows = frequent_classes(in_taxonomy(exportable(urls), categories), at_least)
    text = training_text(F.col("title"), F.col("description"), F.col("url"), with_description)
    return rows.select("id", text.alias("text"), F.col("category").alias("label"))


def class_distribution(rows: DataFrame, label: str = "category") -> DataFrame:
    """Rank, size and percent per class. Classes are numbered by a range shuffle, so there may be any number of them."""
    sizes = rows.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("count"), F.min("id").alias("_first"))
    whole = rows.agg(F.count(F.lit(1)).alias("whole")).scalar()
    ranked = number_rows(sizes, [F.desc("count"), F.asc("_first")], "rank").withColumn("rank", F.col("rank").cast("int"))
    return ranked.withColumn("pct", percent(F.col("count"), whole)).drop("_first").orderBy("rank")


def label_map(rows: DataFrame, label: str = "label") -> DataFrame:
    """Label ids in code-point order; one row per class."""
    named = rows.select(F.col(label).alias("label")).distinct()
    return number_rows(named, ["label"], "label_id").withColumn("label_id", (F.col("label_id") - 1).cast("int"))


def class_weights(rows: DataFrame, label: str = "label") -> DataFrame:
    """Inverse-frequency weight per class; ``rare`` marks weights above 3."""
    sizes = rows.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("count"))
    whole = rows.agg(F.count(F.lit(1)).alias("n")).scalar()
    classes = sizes.agg(F.count(F.lit(1)).alias("n")).scalar()
    weight = whole / (classes * F.col("count"))
    return sizes.withColumn("weight", weight).withColumn("rare", F.col("weight") > RARE_WEIGHT)


def with_weights(rows: DataFrame, label: str = "label") -> DataFrame:
    """Rows with the weight of their class. The weights, one row per class, go to the rows; a shuffle by class would leave a task per class."""
    weights = class_weights(rows, label).select(F.col("label").alias(label), "weight")
    return rows.join(F.broadcast(weights), label)


HASH_BITS = 60


def _order_hash(id_col: str, seed: int) -> Column:
    """A seeded number from 0 up to ``2 ** HASH_BITS`` that any engine with MD5 can repeat."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))
    return F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("long")


def stratified_split(
    rows: DataFrame,
    label: str = "label",
    id_col: str = "id",
    test_share: float = 0.15,
    val_share: float = 0.15,
    seed: int = 42,
    slice_bits: int = 16,
) -> DataFrame:
    """Add ``part`` (train, val or test) with the same shares in every class.

    Rows are ordered by a seeded hash of the id, in 2^slice_bits hash slices per class, so a
    dominant class is never sorted in one task.
    """
    hashed = rows.withColumn("_h", _order_hash(id_col, seed))
    ranked = rank_by_bucket(hashed, [label], F.shiftright("_h", HASH_BITS - slice_bits), ["_h", id_col], "_rank")
    test = F.round(F.col("_rank_of") * F.lit(test_share))
    val = F.round(F.col("_rank_of") * F.lit(val_share))
    part = (
        F.when(F.col("_rank") <= test, "test").when(F.col("_rank") <= test + val, "val").otherwise("train")
    )
    return ranked.withColumn("part", part).drop("_h", "_rank", "_rank_of")


def review_sample(rows: DataFrame, label: str = "label", id_col: str = "id", large: int = 100, seed: int = 42) -> DataFrame:
    """Rows to check by hand: all of a rare class (<50), half of a medium one (50-150), ``large`` of a big one."""
    hashed = rows.withColumn("_h", _order_hash(id_col, seed))
    ranked = rank_by_bucket(hashed, [label], F.shiftright("_h", HASH_BITS - 16), ["_h", id_col], "_rank")
    size = F.col("_rank_of")
    take = F.when(size < 50, size).when(size <= 150, F.ceil(size / 2)).otherwise(F.lit(large))
    return ranked.filter(F.col("_rank") <= take).drop("_h", "_rank", "_rank_of")


def needs_retraining(urls: DataFrame, since: Column, at_least: int = 200) -> DataFrame:
    """One row: hand-made corrections since the last run and whether they suffice to retrain."""
    fixed = urls.filter((F.coalesce("manual_override", F.lit(0)) == 1) & (F.col("processed_at") >= since))
    return fixed.agg(F.count(F.lit(1)).alias("fixes")).withColumn("retrain", F.col("fixes") >= at_least)
