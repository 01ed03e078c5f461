"""Text, dataset, comparison, metrics and run-log files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.operators.compare import short_names, wide
from linkloom.schema import BENCH_LOG, DATASET, DRY_RUN_LOG


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files as (doc_id, text). ``doc_id`` orders lines by file and place in it.

    Files are split between tasks; the block start orders the splits of one file, the running
    number the lines of one split.
    """
    place = F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"),
    )
    return spark.read.text(path).select(place.alias("doc_id"), F.col("value").alias("text"))


def write_dataset(dataset: DataFrame, path: str) -> None:
    """JSON lines with text and label; other alphabets stay readable."""
    dataset.select("text", "label").write.mode("errorifexists").json(path)


def read_dataset(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(DATASET).json(path)


def write_comparison(results: DataFrame, urls: DataFrame, names: list[str], path: str) -> None:
    """Side-by-side CSV with a header: link, title, one column per short model name."""
    rows = wide(results, urls, names).orderBy("id")
    cells = [F.col(f"`{m}`").alias(s) for m, s in zip(names, short_names(names))]
    rows.select("url", "title", *cells).write.mode("errorifexists").option("header", True).option(
        "escape", '"'
    ).option("emptyValue", "").csv(path)


def write_metrics(report: DataFrame, path: str) -> None:
    """One nested JSON object, from ``metrics.report_json``."""
    report.write.mode("errorifexists").text(path)


def append_bench_log(spark: SparkSession, path: str, date: str, model: str | None, best: dict) -> None:
    """Add the winning run of a benchmark to the log."""
    row = (date, model or "auto", round(float(best["rps"]), 1), f"batch={best['batch']} workers={best['workers']}")
    spark.createDataFrame([row], BENCH_LOG).write.mode("append").option("header", True).csv(path)


def append_dry_run_log(
    spark: SparkSession,
    path: str,
    date: str,
    model: str,
    elapsed: float,
    processed: int,
    limit: int | None = None,
    batch: int = 1,
    workers: int = 1,
) -> None:
    """Add a dry run to its log."""
    run = spark.createDataFrame(
        [(date, model, float(elapsed), processed, limit, batch, workers)],
        "date string, model string, elapsed double, processed int, `limit` int, batch int, workers int",
    )
    log_dry_runs(run, path)


def log_dry_runs(runs: DataFrame, path: str) -> None:
    """Add a table of dry runs (date, model, elapsed, processed, limit, batch, workers) to the log."""
    several = lambda name: F.when(F.col(name) > 1, F.concat(F.lit(f"{name}="), F.col(name).cast("string")))
    size = F.when(F.col("limit") > 0, F.col("limit").cast("string")).otherwise("all")
    speed = F.when((F.col("elapsed") > 0) & (F.col("processed") > 0), F.try_divide("processed", "elapsed")).otherwise(0.0)
    runs.select(
        "date",
        "model",
        F.round("elapsed", 1).alias("elapsed_sec"),
        F.round(speed, 2).alias("url_per_sec"),
        F.col("processed").cast("long").alias("processed"),
        F.concat_ws(" ", F.concat(F.lit("limit="), size), several("batch"), several("workers")).alias("config"),
    ).write.mode("append").option("header", True).csv(path)


def read_log(spark: SparkSession, path: str, schema=BENCH_LOG) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)
