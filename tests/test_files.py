"""Sources, sinks, versioned tables and whole runs."""

import json

import pytest
from pyspark.sql import functions as F

from linkloom import scale
from linkloom.operators import dataset, ingest, metrics, migrate, stats, status, train
from linkloom.plans import flows
from linkloom.plans.entries.categorising import stub_list_model, stub_model
from linkloom.schema import DRY_RUN_LOG
from linkloom.sources import files
from linkloom.sources.tables import Table, backup, backups, drop_snapshot, read_snapshot, take_snapshot


def now():
    return F.lit("2026-05-01 00:00:00").cast("timestamp")


def test_text_order_follows_the_files(spark, tmp_path):
    for name, size in (("a.txt", 400), ("b.txt", 3)):
        (tmp_path / name).write_text("".join(f"x https://{name}/{i}) y\n" for i in range(size)), encoding="utf-8")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        links = ingest.extract_links(files.read_text(spark, str(tmp_path)))
        got = [r["url"] for r in ingest.distinct_links(links).collect()]
        rows = ingest.new_rows(spark.createDataFrame([], "id long, url string"), links, now()).orderBy("id").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    want = [f"https://a.txt/{i}" for i in range(400)] + [f"https://b.txt/{i}" for i in range(3)]
    assert got == want
    assert [(r["id"], r["url"]) for r in rows] == list(enumerate(want, 1))


def test_dataset_files(spark, tables, tmp_path):
    path = str(tmp_path / "data")
    rows = dataset.dataset(tables.urls, tables.categories)
    files.write_dataset(rows, path)
    back = files.read_dataset(spark, path)
    assert back.exceptAll(rows.select("text", "label")).isEmpty() and back.count() == rows.count()
    lines = [json.loads(x[0]) for x in spark.read.text(path).collect()]
    assert all(set(x) == {"text", "label"} for x in lines)


def test_training_text(spark):
    rows = [("T", "  ", "https://www.A.com/x"), (" T ", "d" * 300, "http://b.c"), ("T", None, "nohost")]
    df = spark.createDataFrame(rows, "title string, description string, url string")
    got = [r[0] for r in df.select(dataset.training_text(F.col("title"), F.col("description"), F.col("url"))).collect()]
    assert got == ["T [SEP] a.com", f"T [SEP] {'d' * 200} [SEP] b.c", "T [SEP] "]


def test_metrics_file(spark, tables, tmp_path):
    path = str(tmp_path / "metrics")
    files.write_metrics(metrics.report_json(tables.predictions, {"num_train": 7}), path)
    report = json.loads(spark.read.text(path).first()[0])
    assert set(report) == {"accuracy", "macro_f1", "num_test", "num_labels", "num_train", "per_class"}
    assert set(report["per_class"]) == {"A", "N", "R", "X"}
    assert set(report["per_class"]["A"]) == {"precision", "recall", "f1", "support"}


def test_run_logs(spark, tmp_path):
    log = str(tmp_path / "bench")
    files.append_bench_log(spark, log, "2026-03-08 14:57", None, {"rps": 1.06, "batch": 1, "workers": 4})
    files.append_bench_log(spark, log, "2026-03-08 15:55", "m", {"rps": 0.4, "batch": 10, "workers": 2})
    rows = sorted(tuple(r) for r in files.read_log(spark, log).collect())
    assert rows == [("2026-03-08 14:57", "auto", 1.1, "batch=1 workers=4"), ("2026-03-08 15:55", "m", 0.4, "batch=10 workers=2")]
    log = str(tmp_path / "dry")
    files.append_dry_run_log(spark, log, "d", "m", 2.0, 5, batch=10)
    assert tuple(files.read_log(spark, log, DRY_RUN_LOG).first()) == ("d", "m", 2.0, 2.5, 5, "limit=all batch=10")


def test_versions(spark, tmp_path):
    table = Table(spark, str(tmp_path / "t"))
    with pytest.raises(FileNotFoundError):
        table.read()
    for n in range(1, 5):
        table.write(spark.range(n))
    assert table.read().count() == 4 and table.read(2).count() == 2
    (tmp_path / "t" / "v=00000009").mkdir()  # a write that never finished
    assert table.read().count() == 4
    assert table.write(spark.range(7)) == 10
    table.prune(2)
    assert table.steps() == ["v=00000004", "v=00000010"] and table.read().count() == 7


def test_change_sets(spark, tmp_path):
    table = Table(spark, str(tmp_path / "t"))

    def rows(pairs):
        return spark.createDataFrame(pairs, "id long, v string")

    def now_in(step=None):
        return sorted(tuple(r) for r in table.read(step).collect())

    table.write(rows([(i, "old") for i in range(1, 6)]))
    assert table.write_changes(rows([(2, "new"), (6, "added")])) == 2
    assert table.write_changes(rows([(2, "newer")])) == 1
    assert table.delete(rows([(6, ""), (1, ""), (99, "")])) == 2
    want = [(2, "newer"), (3, "old"), (4, "old"), (5, "old")]
    assert now_in() == want
    assert now_in(2) == [(1, "old"), (2, "new"), (3, "old"), (4, "old"), (5, "old"), (6, "added")]
    assert table.high_water() == 6
    table.fold()
    assert now_in() == want and table.pending_changes() == [] and table.high_water() == 6
    table.prune(1)
    assert now_in() == want and table.high_water() == 6
    assert table.write_changes(rows([(6, "back")])) == 1 and now_in()[-1] == (6, "back")


def test_many_changes_are_folded(spark, tables, tmp_path, monkeypatch):
    monkeypatch.setattr(flows, "CHANGE_SETS", 2)
    urls = Table(spark, str(tmp_path / "urls"))
    urls.write(tables.urls)
    total = tables.urls.count()
    for _ in range(2):
        for step in (status.defer_errors, status.undefer_all):
            flows.store(urls, step(urls.read()))
    assert [n[0] for n in urls.steps()].count("v") > 1 and urls.read().count() == total
    gone = urls.read().filter("status = 'error'").select("id")
    n = gone.count()
    assert flows.delete_links(urls, gone) == n > 0 and urls.read().count() == total - n


def test_backups_keep_the_newest(spark, tmp_path):
    path = str(tmp_path / "backups")
    for n in range(5):
        backup(spark.range(n + 1), path, f"2026050{n}-120000", "before run #1")
    found = backups(spark, path)
    assert [b["name"] for b in found] == [f"urls-2026050{n}-120000-beforerun1" for n in (4, 3, 2)]
    assert all(b["size"] > 0 for b in found)
    assert backups(spark, str(tmp_path / "none")) == []


def test_snapshot_file(spark, tables, tmp_path):
    path = str(tmp_path / "snap")
    assert read_snapshot(spark, path) is None
    with pytest.raises(ValueError):
        take_snapshot(migrate.snapshot_rows(tables.urls.limit(0), 5), path)
    take_snapshot(migrate.snapshot_rows(tables.urls, 5), path)
    with pytest.raises(ValueError):
        take_snapshot(migrate.snapshot_rows(tables.urls, 5), path)
    assert read_snapshot(spark, path).count() == 5
    drop_snapshot(spark, path)
    assert read_snapshot(spark, path) is None


def test_a_whole_run(spark, tables, tmp_path):
    """Import, parse, classify, export, benchmark and restore over stored versions."""
    urls = Table(spark, str(tmp_path / "urls"))
    urls.write(tables.urls.limit(0))
    texts = tables.pages.selectExpr("page_id AS doc_id", "concat('<', url, '> and <', url, '>') AS text")
    pages = tables.pages.select("url").distinct().count()
    assert tuple(flows.import_links(urls, texts, now()).first()) == (pages, pages, 0)
    assert tuple(flows.import_links(urls, texts, now()).first()) == (pages, 0, pages)
    assert urls.read().columns == tables.urls.columns
    assert flows.parse_pages(urls, tables.pages, now=now()) == pages
    assert stats.status_counts(urls.read()).first()["done"] == pages

    before = urls.steps()
    dry = flows.classify_links(urls, tables.rules, tables.categories, stub_model, "stub", dry_run=True).first()
    assert urls.steps() == before
    wet = flows.classify_links(urls, tables.rules, tables.categories, stub_list_model, "stub", batch_size=5).first()
    assert wet["total"] == dry["total"] == pages
    named = urls.read().filter("category IS NOT NULL")
    assert named.count() == wet["done"]
    assert {r[0] for r in named.select("tagged_by").distinct().collect()} == {"stub", "domain_rule"}

    counts = flows.export_dataset(urls, tables.categories, str(tmp_path / "export")).first()
    assert counts["exported"] == files.read_dataset(spark, str(tmp_path / "export")).count() == wet["done"]

    kept = urls.read()
    snap = str(tmp_path / "snap")
    assert flows.start_benchmark(urls, snap, 7) == 7
    assert urls.read().filter("category IS NOT NULL").count() == wet["done"] - 7
    assert flows.finish_benchmark(urls, snap) == 7
    assert flows.finish_benchmark(urls, snap) is None
    assert urls.read().exceptAll(kept).isEmpty()

    assert flows.refetch(urls, kept.select("id").limit(4)) == 4
    assert stats.status_counts(urls.read()).first()["pending"] == 4


def test_refill(spark, tables, tmp_path):
    urls = Table(spark, str(tmp_path / "urls"))
    urls.write(tables.urls)
    empty = urls.read().filter("status = 'done' AND coalesce(description, '') = ''").count()
    got = {r["outcome"]: r["count"] for r in flows.refill_descriptions(urls, tables.pages).collect()}
    assert got == {"got": empty}
    assert urls.read().filter("status = 'done' AND coalesce(description, '') = ''").isEmpty()
    assert urls.read().drop("description").exceptAll(tables.urls.drop("description")).isEmpty()


def test_rename_both_tables(spark, tables, tmp_path):
    urls, names = Table(spark, str(tmp_path / "urls")), Table(spark, str(tmp_path / "names"))
    urls.write(tables.urls)
    names.write(tables.categories)
    uses = tables.urls.filter("category = 'cat4'").count()
    assert flows.rename_category(names, urls, "cat4", "quartz") == uses > 0
    assert urls.read().filter("category = 'quartz'").count() == uses
    assert names.read().filter("name = 'quartz'").count() == 1


def test_classifier_learns_and_survives_saving(spark, tables, tmp_path):
    rows = tables.documents.selectExpr("doc_id AS id", "text", "lang AS label")
    parts = scale.durable(dataset.stratified_split(rows))
    model = train.train(parts.filter("part = 'train'"), max_iter=15, features=1 << 12)
    test = parts.filter("part = 'test'")
    predicted = train.predict(model, test)
    assert metrics.summary(predicted).first()["accuracy"] > 0.8
    path = str(tmp_path / "model")
    train.save(model, path)
    again = train.predict(train.load(path), test)
    assert again.select("id", "prediction").exceptAll(predicted.select("id", "prediction")).isEmpty()
    assert train.labels(train.load(path)) == sorted(train.labels(model))
    sure, unsure = train.split_by_confidence(predicted, 0.9)
    assert sure.count() + unsure.count() == test.count()
    worst = [r["confidence"] for r in train.least_confident(predicted, 3).collect()]
    assert worst == sorted(r["confidence"] for r in predicted.collect())[:3]


def test_weights_leave_the_rows_where_they_are(spark):
    """One class must not become one task, whatever Spark thinks of the size of the weights."""
    rows = spark.range(0, 800, 1, 8).selectExpr("id", "IF(id % 100 < 90, 'a', 'b') AS label")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = dataset.with_weights(rows).withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert len({r["task"] for r in got}) == 8
    assert {r["label"]: round(r["weight"] * r["n"], 6) for r in spark.createDataFrame(got).groupBy("label", "weight").agg(F.count("id").alias("n")).collect()} == {"a": 400, "b": 400}


def test_training_reads_the_texts_once(spark):
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def text(n):
        read.add(1)
        return f"word{n % 7} more{n % 2}"

    rows = spark.range(200).select(text.asNondeterministic()("id").alias("text"), F.when(F.col("id") % 2 == 0, "even").otherwise("odd").alias("label"))
    model = train.train(rows, max_iter=5, features=1 << 8)
    assert read.value == 200
    assert train.labels(model) == ["even", "odd"]
