"""Continuous versions of import, page parsing, rule labelling and result upsert.

What a job has to remember is Spark's own stream state: one row per link that an import has seen, one row per (link, model) of the
results. A job can be stopped and restarted; a batch that is repeated starts from the state of the batch before and so does the same
again. The state belongs to the checkpoint of the job. :func:`run_available` keeps it in RocksDB, on disk, so it may outgrow memory;
jobs that are started by hand should set ``spark.sql.streaming.stateStore.providerClass`` alike.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from linkloom.operators.classify import route_by_rules
from linkloom.operators.ingest import extract_links, largest_id, pending_rows
from linkloom.operators.pages import page_meta
from linkloom.schema import MODEL_RESULTS, URLS

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

# Of the files that a batch reads, one task reads no more: it sorts them as a whole before they are grouped.
SPLIT = "spark.sql.files.maxPartitionBytes"
SPLIT_BYTES = 32 << 20

_IMPORTED = T.StructType([*URLS.fields, T.StructField("batch", T.LongType())])


def _write_batch(rows: DataFrame, path: str, batch: int) -> None:
    """One partition per batch, replaced as a whole when the batch is repeated."""
    writer = rows.withColumn("batch", F.lit(batch).cast("long")).write.partitionBy("batch")
    writer.mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def import_links(
    texts: DataFrame, urls: DataFrame, path: str, now: Column | None = None, high_water: int | None = None
) -> DataStreamWriter:
    """Mine arriving texts (doc_id, text) for links and store the unseen ones as pending rows under ``path``.

    The state holds each link with the times of the first and the last batch that had it, so a link is new where both are this
    batch's. Links that ``urls``, the table the job starts from, already has are looked up once per batch. Nothing that an earlier
    batch wrote is read again but its high-water mark: the largest id ever given out, one row per batch. Rows
    may therefore be deleted without their ids coming back; a deleted link counts as seen. ``high_water`` is the mark before
    the first batch, by default the largest id in ``urls``. Ids follow first-seen order within a batch.

    The stream's checkpoint numbers the batches, so it belongs to ``path``: keep or drop both.
    """
    rows_path, marks = f"{path.rstrip('/')}/rows", f"{path.rstrip('/')}/marks"
    spark = texts.sparkSession
    spark.createDataFrame([], _IMPORTED).write.mode("append").partitionBy("batch").parquet(rows_path)

    def mark_before(session: SparkSession, batch: int) -> int:
        if batch == 0:
            return largest_id(urls).first()[0] if high_water is None else high_water
        return session.read.schema("high long").parquet(f"{marks}/batch={batch - 1}").first()["high"]

    def store(found: DataFrame, batch: int) -> None:
        session = found.sparkSession
        fresh = found.filter("first_time = last_time").select("url", F.col("first.doc").alias("first_doc"), F.col("first.pos").alias("first_pos"))
        high = mark_before(session, batch)
        _write_batch(pending_rows(urls, fresh, now, F.lit(high)), rows_path, batch)
        written = session.read.schema(_IMPORTED).parquet(rows_path).filter(F.col("batch") == batch).count()
        _write_batch(session.range(1).select(F.lit(high + written).cast("long").alias("high")), marks, batch)

    timed = extract_links(texts).filter("url <> ''").withColumn("time", F.current_timestamp())
    first = F.min(F.struct("doc", "pos")).alias("first")
    seen = timed.groupBy("url").agg(first, F.min("time").alias("first_time"), F.max("time").alias("last_time"))
    return seen.writeStream.outputMode("update").foreachBatch(store)


def imported(spark: SparkSession, path: str) -> DataFrame:
    """The rows that an import has added."""
    return spark.read.schema(_IMPORTED).parquet(f"{path.rstrip('/')}/rows").select(*URLS.names)


def parse_pages(pages: DataFrame) -> DataFrame:
    """Fetch outcomes of arriving pages; no state is kept."""
    return page_meta(pages)


def label_by_rules(work: DataFrame, rules: DataFrame) -> DataFrame:
    """Route arriving links by the static rule table; no state is kept."""
    return route_by_rules(work, rules)


def last_results(rows: DataFrame) -> DataFrame:
    """(url_id, model) with ``last``, its greatest (tagged_at, category): the last write wins, in a batch or over a stream."""
    return rows.groupBy("url_id", "model").agg(F.max(F.struct("tagged_at", "category")).alias("last"))


def collect_results(rows: DataFrame) -> DataStreamWriter:
    """Merge arriving model results (url_id, model, category, tagged_at) into the state of the stream.

    The state is the table: :func:`current_results` reads it. Each batch also puts out the pairs it has touched, which a caller may
    send on by giving the writer another format or ``foreachBatch``.
    """
    return last_results(rows).writeStream.outputMode("update").format("noop")


def current_results(spark: SparkSession, checkpoint: str) -> DataFrame:
    """One row per (url_id, model) as of the last finished batch of the stream with this checkpoint."""
    state = spark.read.format("statestore").load(checkpoint).select("key.url_id", "key.model", "value.*")
    merged = state.toDF("url_id", "model", "last").select("url_id", "model", "last.category", "last.tagged_at")
    return merged.select(*[F.col(f.name).cast(f.dataType) for f in MODEL_RESULTS.fields])


def run_available(writer: DataStreamWriter, checkpoint: str) -> None:
    """Process everything that has arrived and stop."""
    spark = SparkSession.active()
    before = {name: spark.conf.get(name) for name in (PROVIDER, SPLIT)}
    spark.conf.set(PROVIDER, ROCKSDB)
    spark.conf.set(SPLIT, SPLIT_BYTES)
    try:
        writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def append_to(rows: DataFrame, path: str, transform: Callable[[DataFrame], DataFrame] = lambda d: d) -> DataStreamWriter:
    """Write a stateless stream as parquet files."""
    return transform(rows).writeStream.format("parquet").option("path", path)
