"""Ranking, numbering and joins with one dominant key, against brute force."""

import re

import pytest
from pyspark.sql import functions as F

from linkloom import scale
from linkloom.operators import browse, classify, compare, dataset, ingest, migrate, status, worklists


@pytest.fixture(scope="module")
def lopsided(spark):
    """3000 links; one domain holds two thirds of them."""
    site = F.when(F.col("id") % 3 < 2, "hot.example").otherwise(F.concat(F.lit("s"), F.col("id") % 50, F.lit(".example")))
    rows = spark.range(1, 3001).withColumn("domain", site)
    return rows.withColumn("url", F.concat(F.lit("https://www."), "domain", F.lit("/"), "id")).drop("domain")


def test_round_robin(lopsided):
    got = [(r["id"], r["domain"]) for r in worklists.round_robin(lopsided, id_span=100).collect()]
    queues = {}
    for i, d in sorted((i, d) for i, d in got):
        queues.setdefault(d, []).append(i)
    order = []
    while any(queues.values()):
        for d in queues:
            if queues[d]:
                order.append((queues[d].pop(0), d))
    assert got == order


def test_slices_are_small(lopsided):
    """No sort group of the ranking is larger than its slice."""
    ranked = scale.rank_by_bucket(
        lopsided.withColumn("k", F.lit("one")), ["k"], F.floor(F.col("id") / 100), ["id"], "rank"
    )
    assert [(r["id"], r["rank"], r["rank_of"]) for r in ranked.orderBy("id").collect()] == [(i, i, 3000) for i in range(1, 3001)]


def test_numbering(lopsided):
    got = scale.number_rows(lopsided, [F.desc("url"), F.desc("id")]).collect()
    urls = sorted((r["url"] for r in got), reverse=True)
    assert {r["row_no"]: r["url"] for r in got} == dict(enumerate(urls, 1))
    sparse = lopsided.filter("id % 7 = 3")
    by_id = scale.number_by_id(sparse).orderBy("id").collect()
    assert [r["row_no"] for r in by_id] == list(range(1, len(by_id) + 1))


@pytest.mark.parametrize("bits", [2, 17])
def test_numbering_of_ids_spread_far(spark, monkeypatch, bits):
    monkeypatch.setattr(scale, "SLICE_BITS", bits)
    ids = [(-1) ** (i % 5 == 0) * ((i * i * 7919) << (i % 24)) + i for i in range(400)]
    rows = spark.createDataFrame([(i,) for i in ids], "id long")
    got = [r["row_no"] for r in scale.number_by_id(rows).orderBy("id").collect()]
    assert got == list(range(1, len(ids) + 1))
    for n in (0, 1, 7, 400, 500):
        assert sorted(r["id"] for r in scale.first_n(rows, n).collect()) == sorted(ids)[:n]


def test_first_n(lopsided):
    assert sorted(r["id"] for r in scale.first_n(lopsided, 500).collect()) == list(range(1, 501))


def test_one_row_per_key(spark):
    rows = [("a", 1, "x"), ("a", 3, "y"), ("a", 2, "z"), ("b", None, None), ("b", None, "w"), (None, 1, "n")]
    df = spark.createDataFrame(rows, "k string, at int, v string")
    assert {(r["k"], r["v"]) for r in scale.one_per_key(df, ["k"], "at").collect()} == {("a", "y"), ("b", "w"), (None, "n")}
    assert {(r["k"], r["v"]) for r in scale.one_per_key(df.select("k", "v"), ["k"]).collect()} == {("a", "z"), ("b", "w"), (None, "n")}


@pytest.mark.parametrize("top_rows", [0, 15, 1000])
@pytest.mark.parametrize("sort", browse.SORTS)
def test_deep_pages(tables, sort, top_rows, monkeypatch):
    monkeypatch.setattr(browse, "TOP_ROWS", top_rows)  # with an index, without, and on both sides of the bound
    rows = browse.recent(tables.urls)
    whole = [r["id"] for r in rows.orderBy(*browse.sort_columns(sort)).collect()]
    for p in (1, 3, 6):
        assert [r["id"] for r in browse.page(rows, p, 7, sort).collect()] == whole[7 * p - 7 : 7 * p]


def test_pages_make_the_whole(tables):
    rows = browse.recent(tables.urls)
    pages = browse.page_info(rows, 8).first()["pages"]
    ids = [r["id"] for p in range(1, pages + 1) for r in browse.page(rows, p, 8).collect()]
    whole = [r["id"] for r in rows.orderBy(*browse.sort_columns("newest")).collect()]
    assert ids == whole


def test_one_plan_for_pages_at_any_depth(spark, tmp_path, monkeypatch):
    """A stored index: no limit or offset in the plan, no task that keeps the rows before the page, and only the page's slices are read."""
    monkeypatch.setattr(browse, "SLICE_ROWS", 100)
    rows = spark.range(1, 5001).select(
        "id", F.concat(F.lit("u"), "id").alias("url"), F.when(F.col("id") % 3 > 0, "same title").alias("title"), F.lit(None).cast("string").alias("category"),
        F.timestamp_seconds(F.col("id") % 2).alias("added_at"),
    )
    path = str(tmp_path / "index")
    browse.write_index(browse.ranked(rows, "title"), path)
    index = browse.read_index(spark, path)
    whole = [r["id"] for r in rows.orderBy(*browse.sort_columns("title")).collect()]
    plans = set()
    for p in (1, 2, 77, 250, 251):
        page = browse.page(rows, p, 20, index=index)
        assert [r["id"] for r in page.collect()] == whole[20 * p - 20 : 20 * p]
        text = page._jdf.queryExecution().optimizedPlan().toString()
        assert "Limit" not in text and "Offset" not in text and "slice" in text
        plans.add(re.sub(r"#\d+L?|\d+", "", text))
    assert len(plans) == 1


def test_page_counts(spark):
    empty = spark.createDataFrame([], "id int")
    assert tuple(browse.page_info(empty, 20).first()) == (0, 1)
    assert tuple(browse.page_info(spark.range(41), 20).first()) == (41, 3)
    assert tuple(browse.page_info(spark.range(201), 500).first()) == (201, 3)


def test_same_result_without_broadcast(spark, tables):
    """Sides that are too big to broadcast go through shuffle joins with the same result."""

    def run():
        work = worklists.unclassified(tables.urls, ordered=False)
        return [
            sorted(map(str, df.collect()))
            for df in (
                classify.route_by_rules(work, tables.rules),
                worklists.urls_by_ids(tables.urls, tables.doomed),
                compare.accept_model(tables.urls, tables.latest, "model_2:latest"),
                dataset.frequent_classes(dataset.exportable(tables.urls), 2),
                migrate.cleanup_counts(tables.urls, tables.cleanup_rules),
                ingest.new_rows(tables.urls, ingest.extract_links(tables.raw_links), F.lit(None).cast("timestamp")),
            )
        ]

    usual = run()
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert run() == usual
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_large_taxonomy(spark):
    """Names are joined, so a taxonomy may have any size."""
    categories = spark.range(20_000).select(F.col("id"), F.concat(F.lit("Cat "), "id").alias("name"), F.lit("s").alias("section"), F.col("id").alias("sort_order"))
    answers = spark.createDataFrame([(1, "cat 19999."), (2, "I say\n**CAT 7**"), (3, "Category: cat 12"), (4, "none"), (5, None), (1, "cat 19999.")], "id int, raw string")
    got = sorted((r["id"], r["category"]) for r in classify.normalized(answers, categories).collect() if r["category"])
    assert got == [(1, "Cat 19999"), (1, "Cat 19999"), (2, "Cat 7"), (3, "Cat 12")]
    batches = spark.createDataFrame([(0, 3, "1. cat 5\n2) nothing\n1. cat 6\n9. cat 7"), (1, 2, None)], "chunk int, n int, raw string")
    items = sorted((r["chunk"], r["item"], r["category"]) for r in classify.parsed_batches(batches, categories).collect())
    assert items == [(0, 1, "Cat 6"), (0, 2, None), (0, 3, None), (1, 1, None), (1, 2, None)]
    assert classify.allowed_lists(categories).count() == 2


def test_answers_are_not_copied_per_candidate(spark, tables):
    """Where lines and candidates are rows, they carry no payload; long answers only add light rows."""
    payload = F.concat("raw", F.lit("!")).alias("payload")
    single = classify.normalized(tables.answers.select("*", payload), tables.categories)
    listed = classify.parsed_batches(tables.batch_answers.select("*", payload), tables.categories)
    for df in (single, listed):
        lines = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
        fed = [below for line, below in zip(lines, lines[1:], strict=False) if "Generate posexplode" in line]
        assert fed and not any("payload" in below for below in fed)
        assert {"raw", "payload"} <= set(df.columns) and not any("monotonically" in line for line in lines)


def test_long_batches(spark):
    categories = spark.range(90).select("id", F.concat(F.lit("Cat "), "id").alias("name"), F.lit("s").alias("section"), F.col("id").alias("sort_order"))
    rows = [(size, size, "\n".join(f"{i}. {'junk' if i % 9 == 0 else f'**cat {i}**'}" for i in range(1, size + 1)) + "\n2. cat 89") for size in (20, 80)]
    batches = spark.createDataFrame([*rows, rows[0]], "chunk int, n int, raw string")
    got = sorted((r["chunk"], r["item"], r["category"]) for r in classify.parsed_batches(batches, categories).collect())
    want = [(n, i, "Cat 89" if i == 2 else None if i % 9 == 0 else f"Cat {i}") for n in (20, 20, 80) for i in range(1, n + 1)]
    assert got == sorted(want, key=lambda r: r[:2])


def test_repeated_keys_make_no_rows(spark, tables):
    """Several rules, edits or mappings for one key change one row, and the last one counts."""
    urls, n = tables.urls, tables.urls.count()
    row = urls.filter("category IS NOT NULL").select("id", "url", "category").first()
    twice = spark.createDataFrame([(row["id"], "first", 1), (row["id"], "second", 2)], "id int, category string, at int")
    edited = classify.edit_categories(urls, twice, order_by="at")
    assert edited.count() == n and edited.filter(F.col("id") == row["id"]).first()["category"] == "second"
    outcomes = spark.createDataFrame([(row["url"], "old", "d", None, None, 1), (row["url"], "new", "d", None, None, 2)], "url string, title string, description string, error string, error_code int, at int")
    assert status.apply_fetch(urls, outcomes, order_by="at").filter(F.col("url") == row["url"]).select("title").collect() == [("new",)]
    assert status.apply_fetch(urls, outcomes).count() == status.refill_descriptions(urls, outcomes).count() == n
    rules = tables.rules.unionByName(tables.rules)
    work = worklists.unclassified(urls, ordered=False)
    assert classify.route_by_rules(work, rules).count() == work.count()
    mapping = spark.createDataFrame([(row["category"], "a"), (row["category"], "b")], "old string, new string")
    assert migrate.migrate_categories(urls, mapping).count() == n


def test_split_of_a_dominant_class(spark):
    rows = spark.range(4000).withColumn("label", F.when(F.col("id") % 10 < 8, "big").otherwise(F.concat(F.lit("c"), F.col("id") % 10)))
    parts = dataset.stratified_split(rows)
    assert parts.select("id").distinct().count() == parts.count() == 4000
    sizes = {(r["label"], r["part"]): r["count"] for r in parts.groupBy("label", "part").count().collect()}
    assert sizes[("big", "test")] == sizes[("big", "val")] == 480 and sizes[("big", "train")] == 2240
    assert sizes[("c8", "test")] == 60 and sizes[("c9", "train")] == 280
    again = dataset.stratified_split(rows)
    assert parts.exceptAll(again).isEmpty()
    assert not dataset.stratified_split(rows, seed=1).exceptAll(parts).isEmpty()


def test_review_sample(spark):
    sizes = {"rare": 30, "medium": 101, "large": 900}
    rows = spark.createDataFrame([(i, k) for k, n in sizes.items() for i in range(n)], "id long, label string")
    got = {r["label"]: r["count"] for r in dataset.review_sample(rows).groupBy("label").count().collect()}
    assert got == {"rare": 30, "medium": 51, "large": 100}
