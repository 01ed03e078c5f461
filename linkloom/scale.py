"""Building blocks that keep big or lopsided inputs spread over many tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from linkloom.session import durable

# Where rows of one key are ranked in ranges of ids, a range has this many.
ID_SPAN = 100_000

# Ids are counted in slices of this many binary digits; no task sorts more than one slice.
SLICE_BITS = 17


def one_per_key(df: DataFrame, keys: list[str], order_by: str | None = None) -> DataFrame:
    """The last row of each key by ``order_by``; equal or missing orders are settled by the other columns.

    The maximum is merged in the map tasks, so a key may be repeated any number of times.
    """
    rest = [c for c in df.columns if c not in keys]
    first = [order_by] if order_by else []
    last = df.groupBy(*keys).agg(F.max(F.struct(*first, *[c for c in rest if c not in first])).alias("_last"))
    return last.select(*keys, *[F.col(f"_last.{c}").alias(c) for c in rest])


def rank_by_bucket(
    df: DataFrame,
    keys: list[str],
    bucket: Column,
    order: list[str],
    name: str = "rank",
    group_min: dict[str, str] | None = None,
) -> DataFrame:
    """Position (from 1) of each row in its key group, without ever sorting a whole group at once.

    ``bucket`` cuts each group into ascending slices of the order; rows are counted per slice,
    the slice counts are summed up, and only the rows of one slice are sorted together. So one
    key may hold any share of the rows. Keys must not be NULL. ``<name>_of`` is the group size; ``group_min`` names
    further columns that get the group's minimum of a column.
    """
    group_min = group_min or {}
    marked = df.withColumn("_slice", bucket)
    slices = marked.groupBy(*keys, "_slice").agg(
        F.count(F.lit(1)).alias("_size"), *[F.min(c).alias(f"_min_{n}") for n, c in group_min.items()]
    )
    up_to = W.partitionBy(*keys).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    group = W.partitionBy(*keys)
    starts = slices.select(
        *keys,
        "_slice",
        F.coalesce(F.sum("_size").over(up_to), F.lit(0)).alias("_before"),
        F.sum("_size").over(group).alias("_group_size"),
        *[F.min(f"_min_{n}").over(group).alias(n) for n in group_min],
    )
    within = W.partitionBy(*keys, "_slice").orderBy(*order)
    return (
        marked.join(starts, [*keys, "_slice"])
        .withColumn(name, F.col("_before") + F.row_number().over(within))
        .drop("_slice", "_before")
        .withColumnRenamed("_group_size", f"{name}_of")
    )


def _slice_starts(df: DataFrame, id_col: str) -> DataFrame:
    """``_slice`` and ``_before``, the number of rows in all earlier slices of the id.

    Slices are summed up in slices of slices, and those once more. A window then holds at most ``2 ** SLICE_BITS`` rows
    however the ids are spread; the outermost one has no more rows than a long has values above its lower digits (8192).
    """

    def up_to(*keys: str, by: str) -> Column:
        window = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
        return F.coalesce(F.sum("_n").over(window.orderBy(by).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))

    fine = df.groupBy(F.shiftright(F.col(id_col).cast("long"), SLICE_BITS).alias("_slice")).agg(F.count(F.lit(1)).alias("_n"))
    fine = fine.withColumn("_wide", F.shiftright("_slice", SLICE_BITS))
    wide = fine.groupBy("_wide").agg(F.sum("_n").alias("_n")).withColumn("_widest", F.shiftright("_wide", SLICE_BITS))
    widest = wide.groupBy("_widest").agg(F.sum("_n").alias("_n"))
    outer = widest.select("_widest", up_to(by="_widest").alias("_b3"))
    middle = wide.select("_wide", "_widest", up_to("_widest", by="_wide").alias("_b2")).join(outer, "_widest")
    inner = fine.select("_slice", "_wide", up_to("_wide", by="_slice").alias("_b1")).join(middle, "_wide")
    return inner.select("_slice", (F.col("_b1") + F.col("_b2") + F.col("_b3")).alias("_before"))


def _numbered(df: DataFrame, starts: DataFrame, id_col: str, name: str) -> DataFrame:
    sliced = df.withColumn("_slice", F.shiftright(F.col(id_col).cast("long"), SLICE_BITS)).join(starts, "_slice")
    within = F.row_number().over(W.partitionBy("_slice").orderBy(id_col))
    return sliced.withColumn(name, F.col("_before") + within).drop("_slice", "_before")


def number_by_id(df: DataFrame, id_col: str = "id", name: str = "row_no") -> DataFrame:
    """Number rows 1, 2, ... in the order of a unique integer id."""
    return _numbered(df, _slice_starts(df, id_col), id_col, name)


def number_rows(df: DataFrame, order: list, name: str = "row_no") -> DataFrame:
    """Number rows 1, 2, ... in any total order.

    A range shuffle sorts the rows; a checkpoint fixes the partitions; then each row's number is
    its place in its partition plus the sizes of the partitions before. The table of partition
    sizes has one row per shuffle partition, which bounds the broadcast and the window.
    """
    fixed = durable(df.repartitionByRange(*order).sortWithinPartitions(*order))
    placed = fixed.withColumns(
        {"_part": F.spark_partition_id(), "_place": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}
    )
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    return (
        placed.join(F.broadcast(starts), "_part")
        .withColumn(name, F.col("_before") + F.col("_place") + 1)
        .drop("_part", "_place", "_before")
    )


def first_n(df: DataFrame, n: int | None, id_col: str = "id") -> DataFrame:
    """The first ``n`` rows by id; all rows when ``n`` is None. Only slices that can hold them are sorted."""
    if n is None:
        return df
    starts = _slice_starts(df, id_col).filter(F.col("_before") < n)
    return _numbered(df, starts, id_col, "_row").filter(F.col("_row") <= n).drop("_row")


def affected(df: DataFrame) -> DataFrame:
    """One row: how many rows a snapshot transform changed."""
    return df.agg(F.count_if("changed").alias("affected"))
