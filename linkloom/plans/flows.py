"""Whole runs over stored tables: import, parse, refill, classify, compare, export.

Each reads the latest rows and writes only the rows it adds or changes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom import scale
from linkloom.functions.domains import where_domain
from linkloom.operators import classify, compare, dataset, ingest, migrate, pages, status, taxonomy
from linkloom.sources import files, results
from linkloom.sources.tables import Table, drop_snapshot, read_snapshot, take_snapshot


def _now(now: Column | None) -> Column:
    return F.current_timestamp() if now is None else now


# After this many change sets the next one is followed by a full version.
CHANGE_SETS = 8


def store(table: Table, transformed: DataFrame) -> int:
    """Write the changed rows of a transform as a change set. Returns their number."""
    rows = transformed.filter("changed").drop("changed", "outcome")
    return save(table, rows)


def save(table: Table, rows: DataFrame) -> int:
    count = table.write_changes(rows)
    if len(table.pending_changes()) > CHANGE_SETS:
        table.fold()
    return count


def import_links(urls: Table, texts: DataFrame, now: Column | None = None) -> DataFrame:
    """Find links in texts and add the unseen ones. Returns found, added and skipped."""
    before = urls.read()
    links = ingest.extract_links(texts)
    report = ingest.import_summary(ingest.split_known(before, links))
    save(urls, ingest.new_rows(before, links, _now(now), urls.high_water()))
    return report


def store_fetched(urls: Table, fetched: DataFrame, domain: str | None = None, now: Column | None = None) -> int:
    """Merge fetch outcomes. Returns the number of changed rows."""
    news = where_domain(fetched, domain) if domain else fetched
    return store(urls, status.apply_fetch(urls.read(), news, _now(now)))


def parse_pages(urls: Table, fetched_pages: DataFrame, domain: str | None = None, now: Column | None = None) -> int:
    """Extract titles and descriptions of fetched pages and merge them."""
    found = scale.durable(pages.page_meta(fetched_pages.select("url", "html")))
    return store_fetched(urls, found, domain, now)


def refill_descriptions(urls: Table, fetched_pages: DataFrame, domain: str | None = None) -> DataFrame:
    """Fill empty descriptions from fetched pages. Returns counts per outcome."""
    found = scale.durable(pages.page_meta(fetched_pages.select("url", "html")))
    news = where_domain(found, domain) if domain else found
    filled = scale.durable(status.refill_descriptions(urls.read(), news).filter("changed OR outcome IS NOT NULL"))
    store(urls, filled)
    return status.refill_summary(filled)


def refetch(urls: Table, ids: DataFrame) -> int:
    """Put chosen links back into the queue. Returns the number of changed rows."""
    return store(urls, status.reset_ids(urls.read(), ids))


def classify_links(
    urls: Table,
    rules: DataFrame,
    categories: DataFrame,
    ask: classify.Ask,
    model: str,
    limit: int | None = None,
    with_description: bool = True,
    batch_size: int = 1,
    dry_run: bool = False,
) -> DataFrame:
    """Classify what waits for a category; a dry run leaves the table alone. Returns counts."""
    before = urls.read()
    found = classify.classify(before, rules, categories, ask, limit, with_description, batch_size)
    if not dry_run:
        store(urls, classify.set_categories(before, classify.tag_answers(found, model)))
    return classify.totals(found)


def export_dataset(
    urls: Table, categories: DataFrame, path: str, with_description: bool = True, at_least: int = 0
) -> DataFrame:
    """Write the labelled dataset. Returns exported and skipped counts."""
    rows = urls.read()
    files.write_dataset(dataset.dataset(rows, categories, with_description, at_least), path)
    return dataset.skipped(rows, categories, at_least)


def compare_models(
    urls: Table,
    asks: dict[str, classify.Ask],
    wanted: list[str],
    categories: DataFrame,
    path: str,
    domain: str | None = None,
    limit: int | None = None,
    with_description: bool = True,
    workers: int | None = None,
    now: Column | None = None,
) -> DataFrame:
    """Run the wanted models that exist over the done links and keep their answers under ``path``.

    Each model is saved before the next one starts, so a run that breaks off loses nothing. Returns all stored results, merged.
    """
    rows = urls.read()
    for model in [m for m in wanted if m in asks]:
        answers = compare.run_models(rows, asks, [model], categories, _now(now), domain, limit, with_description, workers)
        results.save_answers(answers, path)
    return results.read_answers(urls.spark, path)


def accept_model(urls: Table, results: DataFrame, model: str, protect_manual: bool = False) -> int:
    """Copy one model's categories onto its links. Returns the number of changed rows."""
    return store(urls, compare.accept_model(urls.read(), results, model, protect_manual))


def start_benchmark(urls: Table, snapshot_path: str, limit: int) -> int:
    """Save the categories of a subset, then clear them. Returns the number of changed rows."""
    rows = take_snapshot(migrate.snapshot_rows(urls.read(), limit), snapshot_path)
    return store(urls, migrate.reset_subset(urls.read(), rows))


def finish_benchmark(urls: Table, snapshot_path: str) -> int | None:
    """Restore the saved categories and drop the snapshot; None when there is none."""
    rows = read_snapshot(urls.spark, snapshot_path)
    if rows is None:
        return None
    done = store(urls, migrate.restore(urls.read(), rows))
    drop_snapshot(urls.spark, snapshot_path)
    return done


def rename_category(categories: Table, urls: Table, old: str, new: str) -> int:
    """Rename a category in both tables. Returns the number of rewritten links."""
    names, links = taxonomy.rename(categories.read(), urls.read(), old, new)
    changed = store(urls, links)
    store(categories, names)
    return changed


def delete_links(urls: Table, ids: DataFrame) -> int:
    """Delete links by id; their ids are not given out again. Returns how many there were."""
    return urls.delete(ids)
