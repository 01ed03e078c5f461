"""Stored model results: the answers of each run by model, and placed by link, so that comparisons read them without a shuffle.

In the second layout the rows of a link lie in one bucket. A table is a folder of bucket files and an entry in the session's catalogue; another session
enters the folder again with :func:`open_placed`. Operators that take ``placed=True`` rely on this layout, and grouping by ``url_id`` (with or
without ``model``) uses it without being told.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from linkloom.operators.compare import upsert_results
from linkloom.schema import MODEL_RESULTS
from linkloom.session import durable

BUCKETS = 200


def write_placed(results: DataFrame, table: str, path: str, buckets: int = BUCKETS) -> DataFrame:
    """Replace the table by ``results`` (url_id, model and any other columns): one file a bucket, sorted by link and model."""
    spark = results.sparkSession
    writer = results.repartition(buckets, "url_id").write.bucketBy(buckets, "url_id").sortBy("url_id", "model")
    writer.option("path", path).mode("overwrite").format("parquet").saveAsTable(table)
    return spark.table(table)


def open_placed(spark: SparkSession, table: str, path: str, buckets: int = BUCKETS) -> DataFrame:
    """Enter a folder that :func:`write_placed` has written with as many buckets."""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema.fields)
    spark.sql(f"DROP TABLE IF EXISTS {table}")  # an outside folder: only the entry goes
    spark.sql(f"CREATE TABLE {table} ({columns}) USING parquet CLUSTERED BY (url_id) SORTED BY (url_id, model) INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(table)


def drop_entry(spark: SparkSession, table: str) -> None:
    """Remove the entry; the folder stays."""
    spark.sql(f"DROP TABLE IF EXISTS {table}")


def save_answers(answers: DataFrame, path: str) -> None:
    """Add model answers (url_id, model, category, tagged_at) to a store with one folder per model; the last write of a pair wins.

    Only the folders of the models that have answered are read and replaced.
    """
    spark = answers.sparkSession
    spark.createDataFrame([], MODEL_RESULTS).write.mode("append").partitionBy("model").parquet(path)
    new = durable(answers.select(*MODEL_RESULTS.names))
    old = read_answers(spark, path).join(new.select("model").distinct(), "model", "left_semi")
    merged = durable(upsert_results(old, new))
    merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("model").parquet(path)


def read_answers(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MODEL_RESULTS).parquet(path)
