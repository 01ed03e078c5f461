"""Taxonomy listings and edits."""

from pyspark.sql import functions as F

from linkloom.operators import taxonomy
from linkloom.plans.catalog import add

COUNTED = "counted AS (SELECT c.id, c.name, c.section, c.sort_order, count(u.id) AS url_count FROM categories c LEFT JOIN urls u ON u.category = c.name AND u.status = 'done' GROUP BY ALL)"

add("t1_flat", lambda t: taxonomy.flat(t.categories), "categories", "SELECT id, name, section, sort_order FROM categories")
add(
    "t2_section_lists",
    lambda t: taxonomy.section_lists(t.categories).withColumn("names", F.array_join("names", "|")),
    "categories",
    "SELECT section, string_agg(name, '|' ORDER BY sort_order, id) AS names, min(sort_order) AS first_order FROM categories GROUP BY section",
)
add(
    "t3_sections",
    lambda t: taxonomy.sections(t.categories),
    "categories",
    "SELECT section, min(sort_order) AS first_order, min(id) AS first_id FROM categories GROUP BY section",
)
add("t4_with_counts", lambda t: taxonomy.with_counts(t.categories, t.urls), "categories urls", f"WITH {COUNTED} SELECT * FROM counted")
add(
    "t5_create",
    lambda t: taxonomy.create(t.categories, "  fresh ", "s1"),
    "categories",
    """SELECT * FROM categories UNION ALL SELECT (SELECT max(id) FROM categories) + 1, 'fresh', 's1', (SELECT max(sort_order) FROM categories WHERE section = 's1') + 1""",
)
add("t5_create_existing", lambda t: taxonomy.create(t.categories, "cat3 ", "s1"), "categories", "SELECT * FROM categories")
add(
    "t6_rename_urls",
    lambda t: taxonomy.rename(t.categories, t.urls, "cat4", " quartz ")[1].select("id", "category", "changed"),
    "urls",
    "SELECT id, CASE WHEN category = 'cat4' THEN 'quartz' ELSE category END AS category, coalesce(category = 'cat4', false) AS changed FROM urls",
)
add(
    "t6_rename_taken",
    lambda t: taxonomy.rename(t.categories, t.urls, "cat4", "cat5")[1].select("id", "category", "changed"),
    "urls",
    "SELECT id, category, false AS changed FROM urls",
)
add(
    "t6_rename_categories",
    lambda t: taxonomy.rename(t.categories, t.urls, "cat4", "quartz")[0],
    "categories",
    "SELECT id, CASE WHEN name = 'cat4' THEN 'quartz' ELSE name END AS name, section, sort_order, name = 'cat4' AS changed FROM categories",
)
add(
    "t7_move",
    lambda t: taxonomy.move(t.categories, "cat4", "s3"),
    "categories",
    "SELECT id, name, CASE WHEN name = 'cat4' THEN 's3' ELSE section END AS section, sort_order, name = 'cat4' AS changed FROM categories",
)
add(
    "t8_delete_reassign",
    lambda t: taxonomy.delete(t.categories, t.urls, "cat4", "cat5")[1].select("id", "category", "manual_override", "changed"),
    "urls",
    "SELECT id, CASE WHEN category = 'cat4' THEN 'cat5' ELSE category END AS category, manual_override, coalesce(category = 'cat4', false) AS changed FROM urls",
)
add(
    "t8_delete_clear",
    lambda t: taxonomy.delete(t.categories, t.urls, "cat4")[1].select("id", "category", "manual_override", "changed"),
    "urls",
    "SELECT id, nullif(category, 'cat4') AS category, CASE WHEN category = 'cat4' THEN 0 ELSE manual_override END AS manual_override, coalesce(category = 'cat4', false) AS changed FROM urls",
)
add(
    "t8_delete_count",
    lambda t: taxonomy.delete(t.categories, t.urls, "cat4")[2],
    "urls",
    "SELECT count(*) AS url_count FROM urls WHERE category = 'cat4' AND status = 'done'",
)
add(
    "t9_grouped",
    lambda t: taxonomy.grouped_with_counts(t.categories, t.urls).withColumn(
        "cats", F.array_join(F.transform("cats", lambda c: F.concat_ws(":", c["name"], c["url_count"].cast("string"))), "|")
    ),
    "categories urls",
    f"WITH {COUNTED} SELECT section, string_agg(name || ':' || url_count, '|' ORDER BY sort_order, id) AS cats, min(sort_order) AS first_order FROM counted GROUP BY section",
)
add(
    "t10_coverage",
    lambda t: taxonomy.coverage(t.categories, t.urls),
    "categories urls",
    """WITH h AS (SELECT category, count(*) AS n FROM urls WHERE status = 'done' AND coalesce(category, '') <> '' GROUP BY category)
SELECT coalesce(c.name, h.category) AS category, c.section, coalesce(h.n, 0) AS count, c.name IS NOT NULL AS in_taxonomy FROM categories c FULL JOIN h ON h.category = c.name""",
)
