"""Invariants of the snapshot transforms."""

import zlib

import pytest
from pyspark.sql import functions as F

from linkloom import scale
from linkloom.operators import classify, compare, ingest, migrate, stats, status, taxonomy


def same(a, b):
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def now():
    return F.lit("2026-05-01 00:00:00").cast("timestamp")


def test_import_is_idempotent(tables):
    links = ingest.extract_links(tables.raw_links)
    once = ingest.insert_links(tables.urls, links, now())
    assert ingest.new_rows(once, links, now()).isEmpty()
    assert same(ingest.insert_links(once, links, now()), once)
    assert once.select("id").distinct().count() == once.select("url").distinct().count() == once.count()


def test_deleted_ids_are_not_reused(tables):
    links = ingest.extract_links(tables.raw_links)
    fresh = ingest.new_rows(tables.urls.filter("id < 10"), links, now(), high_water=1000)
    assert fresh.agg(F.min("id")).first()[0] == 1001


def test_status_counts_sum_to_total(tables):
    row = stats.status_counts(tables.urls).first()
    assert row["total"] == row["pending"] + row["done"] + row["error"] + row["deferred"]


def test_transitions(tables):
    deferred = status.defer_errors(tables.urls)
    n = scale.affected(deferred).first()[0]
    back = status.undefer_all(status.settle(deferred))
    assert scale.affected(back).first()[0] >= n
    assert tables.urls.filter("status = 'error'").count() == n
    assert status.reset_errors(tables.urls).filter("status = 'error'").isEmpty()
    again = status.reset_errors(status.settle(status.reset_errors(tables.urls)))
    assert scale.affected(again).first()[0] == 0
    kept = status.reset_all(tables.urls).select("id", "description", "error_code", "category")
    assert same(kept, tables.urls.select("id", "description", "error_code", "category"))


def test_reset_ids(tables):
    got = status.reset_ids(tables.urls, tables.doomed)
    ids = {r["id"] for r in tables.doomed.collect()}
    assert {r["id"] for r in got.filter("changed").collect()} == ids
    assert got.filter("changed AND status <> 'pending'").isEmpty()


def test_snapshot_restores_exactly(tables):
    rows = migrate.snapshot_rows(tables.urls, 20)
    cleared = migrate.reset_subset(tables.urls, rows)
    assert scale.affected(cleared).first()[0] == 20
    assert migrate.count_classified(cleared, rows).first()[0] == 0
    assert same(status.settle(migrate.restore(status.settle(cleared), rows)), tables.urls)


def test_last_fetch_wins(spark, tables):
    rows = [("u", None, "429", 429, 1), ("u", "T", None, None, 2), ("v", "old", None, None, 1), ("v", None, "x", None, 3)]
    df = spark.createDataFrame(rows, "url string, title string, error string, error_code int, at int")
    got = {r["url"]: (r["title"], r["error"], r["error_code"]) for r in status.latest_outcome(df, "at").collect()}
    assert got == {"u": ("T", None, None), "v": (None, "x", None)}


def test_upsert_is_idempotent(tables):
    batch = tables.latest.limit(50)
    once = compare.upsert_results(tables.latest, batch)
    assert same(once, compare.upsert_results(once, batch))
    assert once.count() == tables.latest.count()


def test_manual_rows(tables):
    guarded = classify.reset_categories(tables.urls, protect_manual=True)
    assert guarded.filter("changed AND manual_override = 1").isEmpty()
    assert not classify.reset_categories(tables.urls).filter("changed AND manual_override = 1").isEmpty()
    edited = classify.edit_categories(tables.urls, tables.edits)
    assert edited.filter("changed").select("manual_override").distinct().first()[0] == 1


def test_rules_may_carry_the_model_name(tables):
    from linkloom.plans.entries.categorising import stub_model

    found = classify.classify(tables.urls, tables.rules, tables.categories, stub_model)
    assert {r[0] for r in classify.tag_answers(found, "m", True).select("tagged_by").distinct().collect()} == {"m"}


def test_failures_do_not_stop_others(spark, tables):
    def moody(prompt):
        kind = zlib.crc32(prompt.encode()) % 4
        if kind == 0:
            raise ConnectionError("down")
        if kind == 1:
            raise classify.ModelError("refused")
        return "cat1" if kind == 2 else "no idea"

    work = tables.urls.filter("title <> ''").select("id", "url", "title", "description")
    got = classify.annotate(work, moody, tables.categories, workers=3)
    assert got.count() == work.count()
    assert {r[0] for r in got.select("error_kind").distinct().collect()} == {"ok", "api_err", "conn_err", "empty"}
    assert got.filter("(error_kind = 'ok') <> (category IS NOT NULL)").isEmpty()
    totals = classify.totals(got.withColumn("route", F.lit("open")), 2.0).first()
    assert totals["done"] + totals["errors"] == totals["total"] == work.count()


def test_a_failed_list_counts_for_all_its_rows(tables):
    def down(prompt):
        raise classify.ModelError("no")

    work = tables.urls.filter("title <> ''").select("id", "url", "title", "description")
    got = classify.annotate(work, down, tables.categories, batch_size=6)
    assert got.count() == work.count() and {r[0] for r in got.select("error_kind").distinct().collect()} == {"api_err"}


def test_the_model_runs_once_per_prompt(spark, tables, tmp_path):
    log = str(tmp_path / "calls")

    def counted(prompt):
        with open(log, "a") as out:
            out.write(".")
        return "cat1"

    work = tables.urls.filter("title <> ''").select("id", "url", "title", "description")
    got = classify.annotate(work, counted, tables.categories)
    got.count()
    got.groupBy("category").count().collect()
    assert len(open(log).read()) == work.count()


def test_builtin_taxonomy(spark):
    rows = taxonomy.seed(taxonomy.default_sections(spark))
    assert rows.count() == 39
    sizes = [len(r["names"]) for r in taxonomy.section_lists(rows).collect()]
    assert sizes == [13, 6, 3, 6, 11]
    assert [r["sort_order"] for r in taxonomy.flat(rows).collect()] == list(range(39))
    assert taxonomy.seed(taxonomy.default_sections(spark), rows).isEmpty()
    assert classify.rule_violations(taxonomy.default_rules(spark), rows).isEmpty()


def test_category_order_in_a_new_section(tables):
    made = taxonomy.create(tables.categories, "first", "brand new").filter("name = 'first'").first()
    assert made["sort_order"] == 1 and made["id"] == 13
    assert taxonomy.create(tables.categories, "   ", "s1").count() == tables.categories.count()


def test_upgrade_adds_defaults(tables):
    old = tables.urls.select("id", "url", "status")
    new = migrate.upgrade(old)
    assert new.columns == tables.urls.columns
    assert same(migrate.upgrade(new), new)
    assert new.first()["manual_override"] == 0


@pytest.mark.parametrize("cut", [0, 3, 100])
def test_limits(tables, cut):
    from linkloom.operators import worklists

    rows = [r["id"] for r in worklists.pending(tables.urls).collect()]
    assert [r["id"] for r in worklists.pending(tables.urls, limit=cut).collect()] == rows[:cut]
