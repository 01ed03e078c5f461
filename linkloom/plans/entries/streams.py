"""Streaming jobs run over everything available; the oracle is the batch result."""

from pyspark.sql import functions as F

from linkloom.operators import pages
from linkloom.plans.catalog import add
from linkloom.plans.entries.categorising import ROUTED, WORK, work
from linkloom.plans.entries.fetching import H1, TITLE
from linkloom.plans.entries.imports import LINKS, NOW, now
from linkloom.plans.entries.training import scratch
from linkloom.streaming import jobs


PARTS = 3


def run_arriving(t, frame, name: str, by: str, job) -> str:
    """Write ``frame`` in a few parts, each by as many tasks as it takes to read; run ``job`` of the stream, one batch, after each."""
    path, checkpoint = scratch(t, name), scratch(t, "progress")
    for part in range(PARTS):
        frame.filter(F.pmod(F.col(by), F.lit(PARTS)) == part).write.mode("append").parquet(path)
        jobs.run_available(job(t.spark.readStream.schema(frame.schema).parquet(path)), checkpoint)
    return checkpoint


def imported(t):
    path = scratch(t, "imported")
    run_arriving(t, t.raw_links, "texts", "doc_id", lambda texts: jobs.import_links(texts, t.urls, path, now()))
    return jobs.imported(t.spark, path).select("id", "url", "status", "added_at")


def parsed(t):
    path = scratch(t, "parsed")
    stream = jobs.parse_pages(t.spark.readStream.schema(t.pages.schema).parquet(f"{t.sf_dir}/pages*.parquet"))
    jobs.run_available(jobs.append_to(stream, path), scratch(t, "progress"))
    return t.spark.read.schema(pages.page_meta(t.pages).schema).parquet(path).select("page_id", "title", "description")


def labelled(t):
    path = scratch(t, "labelled")
    run_arriving(t, work(t), "work", "id", lambda rows: jobs.append_to(jobs.label_by_rules(rows, t.rules), path))
    return t.spark.read.parquet(path)


def collected(t):
    stamped = t.model_results_raw.select("url_id", "model", "category", "tagged_at")
    return jobs.current_results(t.spark, run_arriving(t, stamped, "answers", "url_id", jobs.collect_results))


add(
    "r1_stream_import",
    imported,
    "raw_links urls",
    LINKS
    + f""", arrived AS (SELECT url, min({{'b': doc_id % {PARTS}, 'd': doc_id, 'p': pos}}) AS f FROM links WHERE url NOT IN (SELECT url FROM urls) GROUP BY url)
SELECT (SELECT max(id) FROM urls) + row_number() OVER (ORDER BY f) AS id, url, 'pending' AS status, TIMESTAMP '{NOW}' AS added_at FROM arrived""",
)
add("r2_stream_pages", parsed, "", f"SELECT page_id, {TITLE} AS title, {H1} AS description FROM pages")
add("r3_stream_rules", labelled, "urls rules", f"WITH {WORK}, {ROUTED} SELECT * FROM routed")
add(
    "r4_stream_results",
    collected,
    "model_results_raw",
    """SELECT url_id, model, arg_max(category, {'t': tagged_at, 'c': category}) AS category, max(tagged_at) AS tagged_at FROM model_results_raw GROUP BY url_id, model""",
)
