"""Benchmark subset, migrations, clean-up and comparison files."""

from pyspark.sql import functions as F

from linkloom.functions.domains import norm_domain
from linkloom.operators import ingest, migrate
from linkloom.operators.compare import short_names
from linkloom.plans.catalog import add
from linkloom.plans.entries.comparing import MODELS, cells
from linkloom.plans.entries.imports import LINKS, NOW, now
from linkloom.plans.entries.training import scratch
from linkloom.plans.views import NORM_DOMAIN
from linkloom.sources import files, tables

ELIGIBLE = "eligible AS (SELECT * FROM urls WHERE status = 'done' AND category IS NOT NULL AND coalesce(title, '') <> '')"


def comparison_file(t):
    path = scratch(t, "comparison")
    files.write_comparison(t.latest, t.urls, MODELS, path)
    short = short_names(MODELS)
    schema = ", ".join(["url string", "title string", *[f"`{s}` string" for s in short]])
    rows = t.spark.read.schema(schema).option("header", True).option("escape", '"').csv(path)
    return rows.select("url", *[F.coalesce(s, F.lit("")).alias(s) for s in short])


def backup_roundtrip(t):
    path = scratch(t, "backups")
    for n in range(4):
        tables.backup(t.urls, path, f"2026050{n}-120000", "nightly run!")
    newest = tables.backups(t.spark, path)[0]["name"]
    return t.spark.read.parquet(f"{path}/{newest}")


def text_import(t):
    """Write the texts as files in their order, read them back, and number the new links."""
    path = scratch(t, "texts")
    t.raw_links.repartitionByRange("doc_id").sortWithinPartitions("doc_id").select("text").write.text(path)
    links = ingest.extract_links(files.read_text(t.spark, path))
    return ingest.new_rows(t.urls, links, now()).select("id", "url", "status", "added_at", "manual_override")


add(
    "s1_text_files",
    text_import,
    "raw_links urls",
    LINKS
    + f""" SELECT (SELECT max(id) FROM urls) + row_number() OVER (ORDER BY first_doc, first_pos) AS id, url, 'pending' AS status,
  TIMESTAMP '{NOW}' AS added_at, 0 AS manual_override FROM seen WHERE url NOT IN (SELECT url FROM urls)""",
)
add("x1_eligible", lambda t: migrate.eligible_count(t.urls), "urls", f"WITH {ELIGIBLE} SELECT count(*) AS eligible FROM eligible")
add(
    "x2_snapshot",
    lambda t: tables.take_snapshot(migrate.snapshot_rows(t.urls, 25), scratch(t, "snapshot")),
    "urls",
    f"WITH {ELIGIBLE} SELECT id, category, tagged_by FROM eligible ORDER BY id LIMIT 25",
)
add(
    "x3_restore",
    lambda t: migrate.restore(
        migrate.reset_subset(t.urls, t.urls.select("id")).drop("changed"), migrate.snapshot_rows(t.urls, 25)
    ).select("id", "category", "tagged_by", "changed"),
    "urls",
    f"""WITH {ELIGIBLE}, snap AS (SELECT id, category, tagged_by FROM eligible ORDER BY id LIMIT 25)
SELECT u.id, s.category, s.tagged_by, s.id IS NOT NULL AS changed FROM urls u LEFT JOIN snap s ON s.id = u.id""",
)
add(
    "x4_benchmark_ids",
    lambda t: migrate.benchmark_ids(t.urls, 25),
    "urls",
    "SELECT id FROM urls WHERE status = 'done' AND title IS NOT NULL ORDER BY id LIMIT 25",
)
add(
    "x4_reset_subset",
    lambda t: migrate.reset_subset(t.urls, migrate.benchmark_ids(t.urls, 25)).select("id", "category", "tagged_by", "changed"),
    "urls",
    """WITH s AS (SELECT id FROM urls WHERE status = 'done' AND title IS NOT NULL ORDER BY id LIMIT 25)
SELECT u.id, CASE WHEN s.id IS NULL THEN category END AS category, CASE WHEN s.id IS NULL THEN tagged_by END AS tagged_by, s.id IS NOT NULL AS changed FROM urls u LEFT JOIN s ON s.id = u.id""",
)
add(
    "x4_count_classified",
    lambda t: migrate.count_classified(t.urls, migrate.benchmark_ids(t.urls, 25)),
    "urls",
    "SELECT count(category) AS classified FROM (SELECT category FROM urls WHERE status = 'done' AND title IS NOT NULL ORDER BY id LIMIT 25) s",
)
add("x5_backups", backup_roundtrip, "urls", "SELECT * FROM urls")
MOVED = """WITH moved AS (SELECT u.id, u.category, m.new, CASE WHEN coalesce(u.category, '') <> '' THEN CASE WHEN coalesce(m.new, '') = '' THEN 'null' WHEN m.new = u.category THEN 'same' ELSE 'rename' END END AS action
  FROM urls u LEFT JOIN category_mapping m ON m.old = u.category)"""
add(
    "x6_migration_report",
    lambda t: migrate.migration_report(t.urls, t.category_mapping),
    "urls category_mapping",
    MOVED + " SELECT category, action, new AS new_category, count(*) AS count FROM moved WHERE action IS NOT NULL GROUP BY ALL",
)
add(
    "x6_migration_totals",
    lambda t: migrate.migration_totals(t.urls, t.category_mapping),
    "urls category_mapping",
    MOVED
    + " SELECT count(*) FILTER (action = 'rename') AS renamed, count(*) FILTER (action = 'null') AS nulled, count(DISTINCT category) FILTER (action = 'null') AS unmapped FROM moved",
)
add(
    "x6_migrate",
    lambda t: migrate.migrate_categories(t.urls, t.category_mapping).select("id", "category", "changed"),
    "urls category_mapping",
    MOVED
    + " SELECT id, CASE action WHEN 'rename' THEN new WHEN 'null' THEN NULL ELSE category END AS category, coalesce(action IN ('rename', 'null'), false) AS changed FROM moved",
)
add(
    "x7_backfill_codes",
    lambda t: migrate.backfill_error_code(t.urls.withColumn("error_code", F.when(F.col("status") == "error", F.col("error_code")))).select(
        "id", "error", "error_code", "changed"
    ),
    "urls",
    """WITH u AS (SELECT id, error, CASE WHEN status = 'error' THEN error_code END AS error_code, TRY_CAST(regexp_extract(error, '(\\d{3})\\s+(Client|Server)\\s+Error', 1) AS INTEGER) AS code FROM urls)
SELECT id, error, coalesce(error_code, code) AS error_code, error_code IS NULL AND code IS NOT NULL AS changed FROM u""",
)
HITS = f"""WITH hits AS (SELECT u.id, (SELECT min(r.rule_no) FROM cleanup_rules r WHERE r.error_code = u.error_code AND (r.domain IS NULL OR r.domain = {NORM_DOMAIN.replace('url', 'u.url')})) AS rule_no FROM urls u)"""
add(
    "x8_cleanup",
    lambda t: migrate.cleanup(t.urls, t.cleanup_rules).select("id", "url", norm_domain(F.col("url")).alias("domain")),
    "urls cleanup_rules",
    HITS + f" SELECT urls.id, url, {NORM_DOMAIN} AS domain FROM urls JOIN hits ON hits.id = urls.id WHERE hits.rule_no IS NULL",
)
add(
    "x8_cleanup_counts",
    lambda t: migrate.cleanup_counts(t.urls, t.cleanup_rules),
    "urls cleanup_rules",
    HITS + " SELECT rule_no, count(*) AS deleted FROM hits WHERE rule_no IS NOT NULL GROUP BY rule_no",
)
add(
    "x9_tidy_categories",
    lambda t: migrate.tidy_categories(t.urls.drop("category").join(t.tag_lists, "id"), t.categories, ("done ,,",)).select(
        "id", "category", "changed"
    ),
    "tag_lists categories",
    """WITH p AS (SELECT l.id, l.category, contains(l.category, ',') AS junk, c.name FROM tag_lists l LEFT JOIN categories c ON lower(c.name) = lower(l.category))
SELECT id, CASE WHEN junk THEN NULL WHEN name IS NOT NULL THEN name ELSE category END AS category, category IS NOT NULL AND (junk OR (name IS NOT NULL AND name <> category)) AS changed FROM p""",
)
add(
    "x10_upgrade",
    lambda t: migrate.upgrade(migrate.upgrade(t.urls.drop("manual_override", "description"))),
    "urls",
    "SELECT * REPLACE (CAST(NULL AS VARCHAR) AS description, 0 AS manual_override) FROM urls",
)
add(
    "s6_comparison_file",
    comparison_file,
    "model_results urls",
    "WITH w AS (SELECT u.id, u.url, "
    + cells(lambda m: m.split(":")[0])
    + " FROM model_results r JOIN urls u ON u.id = r.url_id GROUP BY ALL) SELECT * EXCLUDE (id) FROM w",
)
