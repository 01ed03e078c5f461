"""Streams give what the batch operators give, also after a restart, a repeated batch and deleted rows."""

import glob
import os
import shutil

from pyspark.sql import functions as F

from linkloom.operators import compare, ingest, pages
from linkloom.plans.entries.streams import run_arriving
from linkloom.streaming import jobs


def now():
    return F.lit("2026-05-01 00:00:00").cast("timestamp")


def same(a, b):
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def stream(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def forget_last_batch(checkpoint):
    """As after a crash: the batch has run, but the stream does not know."""
    last = max(glob.glob(f"{checkpoint}/commits/[0-9]*"), key=lambda f: int(os.path.basename(f)))
    for name in (last, os.path.join(os.path.dirname(last), f".{os.path.basename(last)}.crc")):
        if os.path.exists(name):
            os.remove(name)
    return int(os.path.basename(last))


def paths(tmp_path):
    return (str(tmp_path / n) for n in ("in", "out", "mark"))


def importer(spark, tables, folder, out, mark, **kw):
    schema = tables.raw_links.schema

    def run(*news):
        for frame in news:
            frame.coalesce(1).write.mode("append").parquet(folder)
        jobs.run_available(jobs.import_links(stream(spark, folder, schema), tables.urls, out, now(), **kw), mark)
        return jobs.imported(spark, out)

    return run


def test_import(spark, tables, tmp_path):
    run = importer(spark, tables, *paths(tmp_path))
    texts = tables.raw_links
    extra = texts.selectExpr("doc_id", "concat(text, ' https://later.example/', doc_id % 3) AS text")
    run(texts.filter("doc_id % 2 = 0"), texts.filter("doc_id % 2 = 1"))
    got = run(extra)  # a restart that finds one more file
    want = ingest.new_rows(tables.urls, ingest.extract_links(extra), now())
    assert same(got.select("url", "status", "added_at"), want.select("url", "status", "added_at"))
    ids = [r["id"] for r in got.collect()]
    top = tables.urls.agg(F.max("id")).first()[0]
    assert sorted(ids) == list(range(top + 1, top + 1 + len(ids)))
    later = [r["url"] for r in got.filter("url like '%later%'").orderBy("id").collect()]
    assert later == ["https://later.example/0", "https://later.example/1", "https://later.example/2"]


def test_one_batch_numbers_like_the_batch_import(spark, tables, tmp_path):
    got = importer(spark, tables, *paths(tmp_path))(tables.raw_links)
    assert same(got, ingest.new_rows(tables.urls, ingest.extract_links(tables.raw_links), now()))


def test_a_repeated_import_batch_changes_nothing(spark, tables, tmp_path):
    folder, out, mark = paths(tmp_path)
    run = importer(spark, tables, folder, out, mark)
    texts = tables.raw_links
    extra = texts.selectExpr("doc_id", "concat('https://again.example/', doc_id) AS text")
    before = run(texts, extra).collect()
    for _ in range(2):
        assert forget_last_batch(mark) == 1
        assert sorted(run().collect()) == sorted(before)


def test_ids_of_deleted_rows_never_return(spark, tables, tmp_path):
    folder, out, mark = paths(tmp_path)
    run = importer(spark, tables, folder, out, mark, high_water=10_000)
    first = [r["id"] for r in run(tables.raw_links).collect()]
    assert min(first) == 10_001
    shutil.rmtree(f"{out}/rows/batch=0")  # all rows of the first batch are deleted
    fresh = tables.raw_links.limit(4).selectExpr("doc_id", "concat('https://fresh.example/', doc_id) AS text")
    assert sorted(r["id"] for r in run(tables.raw_links, fresh).collect()) == [max(first) + 1 + i for i in range(4)]


def test_a_batch_reads_only_its_own_texts(spark, tables, tmp_path):
    """What earlier batches have written can be out of reach; only the last mark is needed."""
    folder, out, mark = paths(tmp_path)
    run = importer(spark, tables, folder, out, mark)
    run(tables.raw_links, tables.raw_links)
    for old in glob.glob(f"{out}/rows/batch=0/*.parquet"):
        with open(old, "wb") as f:
            f.write(b"not parquet")
    shutil.rmtree(f"{out}/marks/batch=0")
    fresh = tables.raw_links.limit(1).selectExpr("doc_id", "'https://only.example/' AS text")
    run(fresh)
    assert spark.read.parquet(f"{out}/rows/batch=2").count() == 1


def test_an_import_without_texts(spark, tables, tmp_path):
    folder, out, mark = paths(tmp_path)
    os.mkdir(folder)
    assert importer(spark, tables, folder, out, mark)().collect() == []


def test_pages(spark, tables, tmp_path):
    folder, out, mark = paths(tmp_path)
    tables.pages.repartition(3).write.parquet(folder)
    jobs.run_available(jobs.append_to(jobs.parse_pages(stream(spark, folder, tables.pages.schema)), out), mark)
    assert same(spark.read.parquet(out), pages.page_meta(tables.pages))


def test_results(spark, tables, tmp_path):
    folder, _, mark = paths(tmp_path)
    rows = tables.model_results_raw.select("url_id", "model", "category", "tagged_at")

    def want(seen):
        return compare.latest_results(seen, ["tagged_at", "category"], ["category", "tagged_at"])

    def run():
        jobs.run_available(jobs.collect_results(stream(spark, folder, rows.schema)), mark)
        return jobs.current_results(spark, mark)

    half = rows.filter("url_id % 2 = 0")
    half.repartition(2).write.parquet(folder)
    assert same(run(), want(half))
    rows.filter("url_id % 2 = 1").repartition(2).write.mode("append").parquet(folder)
    assert same(run(), want(rows))
    for _ in range(2):  # a batch that is repeated changes nothing
        assert forget_last_batch(mark) == 3
        assert same(run(), want(rows))
    late = half.limit(5).selectExpr("url_id", "model", "'too late' AS category", "tagged_at - INTERVAL 30 YEARS AS tagged_at")
    late.coalesce(1).write.mode("append").parquet(folder)
    assert same(run(), want(rows))
    update = half.limit(5).selectExpr("url_id", "model", "'new' AS category", "tagged_at + INTERVAL 30 YEARS AS tagged_at")
    update.coalesce(1).write.mode("append").parquet(folder)
    assert same(run(), want(rows.unionByName(update)))


def test_touched_pairs_can_be_sent_on(spark, tables, tmp_path):
    folder, _, mark = paths(tmp_path)
    rows = tables.model_results_raw.select("url_id", "model", "category", "tagged_at").limit(200)
    rows.coalesce(1).write.parquet(folder)
    sent = []
    jobs.run_available(jobs.collect_results(stream(spark, folder, rows.schema)).foreachBatch(lambda df, n: sent.append(df.count())), mark)
    assert sent == [rows.select("url_id", "model").distinct().count()]


def test_a_part_is_one_batch_of_files_by_many_tasks(spark, tables):
    """No single task writes or sorts a part."""
    seen = {}

    def store(batch, number):
        rows = batch.withColumn("file", F.input_file_name()).collect()
        seen[number] = (sorted(r["id"] for r in rows), len({r["file"] for r in rows}), batch.sparkSession.conf.get(jobs.SPLIT))

    split = spark.conf.get(jobs.SPLIT)
    run_arriving(tables, spark.range(0, 90, 1, 4), "numbers", "id", lambda rows: rows.writeStream.foreachBatch(store))
    assert seen == {k: (list(range(k, 90, 3)), 4, str(jobs.SPLIT_BYTES)) for k in range(3)}
    assert spark.conf.get(jobs.SPLIT) == split
