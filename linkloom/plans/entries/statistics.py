"""Statistics."""

from linkloom.operators import stats, worklists
from linkloom.plans.catalog import add

HAS = "coalesce({}, '') <> ''"
TITLE, DESC, CAT = (HAS.format(c) for c in ("title", "description", "category"))
TRANSIENT = "(error_code IS NULL OR error_code IN (429, 500, 502, 503, 504))"
DOMAIN = "replace(regexp_extract(url, '://([^/]*)', 1), 'www.', '')"


def pct(part: str, whole: str) -> str:
    """One decimal, rounded on the exact binary value."""
    return f"CAST(printf('%.1f', {part} * 100 / {whole}) AS DOUBLE)"


STATUS = ", ".join(f"count(*) FILTER (status = '{s}') AS {s}" for s in ("pending", "done", "error", "deferred"))

add("h1_status_counts", lambda t: stats.status_counts(t.urls), "urls", f"SELECT count(*) AS total, {STATUS} FROM urls")
add(
    "h2_full_stats",
    lambda t: stats.full_stats(t.urls, t.latest),
    "urls model_results_raw",
    f"""WITH c AS (SELECT count(*) AS total, {STATUS}, count(*) FILTER (status = 'done' AND {CAT}) AS classified FROM urls)
SELECT *, done - classified AS unclassified, CASE WHEN done > 0 THEN classified * 100 // done ELSE 0 END AS classified_pct,
  (SELECT count(DISTINCT url_id) FROM model_results_raw) AS compared FROM c""",
)
add(
    "h3_analytics",
    lambda t: stats.analytics(t.urls),
    "urls",
    f"""SELECT count(*) AS done, count(*) FILTER ({TITLE}) AS with_title, count(*) FILTER (NOT ({TITLE})) AS without_title,
  count(*) FILTER ({DESC}) AS with_desc, count(*) FILTER (NOT ({DESC})) AS without_desc, count(*) FILTER ({CAT}) AS classified,
  count(*) FILTER (NOT ({CAT})) AS unclassified, count(*) FILTER (coalesce(manual_override, 0) = 1) AS manual_override,
  count(*) FILTER (NOT ({CAT}) AND {TITLE}) AS ready_for_llm, count(*) FILTER (NOT ({CAT}) AND NOT ({TITLE})) AS unclass_no_title
FROM urls WHERE status = 'done'""",
)
add(
    "h4_domains_without_title",
    lambda t: stats.domains_without_title(t.urls),
    "urls",
    f"SELECT {DOMAIN} AS domain, count(*) AS count FROM urls WHERE status = 'done' AND NOT ({TITLE}) GROUP BY 1 ORDER BY count DESC, domain LIMIT 10",
)
add(
    "h4_domains_without_category",
    lambda t: stats.domains_without_category(t.urls),
    "urls",
    f"SELECT {DOMAIN} AS domain, count(*) AS count FROM urls WHERE status = 'done' AND NOT ({CAT}) AND {TITLE} GROUP BY 1 ORDER BY count DESC, domain LIMIT 10",
)
add(
    "h5_categories_with_counts",
    lambda t: stats.categories_with_counts(t.urls),
    "urls",
    f"SELECT category, count(*) AS count FROM urls WHERE status = 'done' AND {CAT} GROUP BY category",
)
add(
    "h6_deferred_by_code",
    lambda t: stats.deferred_by_code(t.urls),
    "urls",
    """SELECT error_code, count(*) AS count, CASE error_code WHEN 403 THEN '403 — доступ запрещён (антибот)' WHEN 429 THEN '429 — слишком много запросов' WHEN 503 THEN '503 — сервер временно недоступен'
  ELSE coalesce(CAST(error_code AS VARCHAR), 'Сеть — таймаут или нет ответа') END AS label FROM urls WHERE status = 'deferred' GROUP BY error_code""",
)
add(
    "h7_dashboard",
    lambda t: stats.dashboard(t.urls),
    "urls",
    f"""SELECT count(*) FILTER (status = 'done') AS total_urls, count(DISTINCT category) FILTER (status = 'done' AND {CAT}) AS total_categories,
  count(*) FILTER (status = 'error') AS error_count, count(*) FILTER (status = 'error' AND {TRANSIENT}) AS transient_error_count,
  count(*) FILTER (status = 'done' AND NOT ({TITLE} AND {DESC})) AS incomplete_count, count(*) FILTER (status = 'pending') AS pending_count FROM urls""",
)
add(
    "h8_counters",
    lambda t: stats.counters(t.urls),
    "urls",
    f"""SELECT 'pending' AS counter, count(*) AS count FROM urls WHERE status = 'pending' UNION ALL SELECT 'error', count(*) FROM urls WHERE status = 'error'
UNION ALL SELECT 'transient_error', count(*) FROM urls WHERE status = 'error' AND {TRANSIENT}
UNION ALL SELECT 'incomplete', count(*) FROM urls WHERE status = 'done' AND NOT ({TITLE} AND {DESC})""",
)
add(
    "h9_retryable_errors",
    lambda t: worklists.retryable_errors(t.urls),
    "urls",
    f"SELECT id, url, error_code FROM urls WHERE status = 'error' AND {TRANSIENT}",
)
BUCKETS = """WITH e AS (SELECT coalesce(CAST(error_code AS VARCHAR), CASE WHEN lower(coalesce(error, '')) SIMILAR TO '.*(timed out|timeout|connection).*' THEN 'network' WHEN lower(coalesce(error, '')) SIMILAR TO '.*(ssl|tls).*' THEN 'ssl' ELSE 'other' END) AS bucket,
  CASE WHEN error_code IS NULL OR error_code IN (429, 500, 502, 503, 504) THEN 'retriable' WHEN error_code IN (400, 401, 403, 404, 405, 410, 451) THEN 'permanent' ELSE 'mixed' END AS kind FROM urls WHERE status = 'error')"""
add(
    "h10_error_buckets",
    lambda t: stats.error_buckets(t.urls),
    "urls",
    BUCKETS + f" SELECT bucket, kind, count(*) AS count, {pct('count(*)', '(SELECT count(*) FROM e)')} AS share FROM e GROUP BY bucket, kind",
)
add(
    "h10_error_kinds",
    lambda t: stats.error_kinds(t.urls),
    "urls",
    BUCKETS + f" SELECT kind, count(*) AS count, {pct('count(*)', '(SELECT count(*) FROM e)')} AS share FROM e GROUP BY kind",
)
add(
    "h11_classified",
    lambda t: stats.classified(t.urls),
    "urls",
    "SELECT url, title, category, tagged_by FROM urls WHERE category IS NOT NULL",
)
add(
    "h12_description_coverage",
    lambda t: stats.description_coverage(t.urls),
    "urls",
    f"SELECT count(*) FILTER ({DESC}) AS have, count(*) AS total, {pct(f'count(*) FILTER ({DESC})', 'count(*)')} AS pct FROM urls WHERE status = 'done'",
)
RED = "(contains({0}, 'URL:') OR contains({0}, 'Category:') OR regexp_matches({0}, '^[0-9]') OR length({0}) > 60)"
add(
    "h13_category_review",
    lambda t: stats.category_review(t.tags.withColumnRenamed("tag", "category").join(t.urls.select("id", "url"), "id")),
    "tags urls",
    f"""SELECT tag AS category, count(*) AS count, min(url) AS example_url, {RED.format('tag')} AS red, NOT {RED.format('tag')} AND count(*) = 1 AS yellow
FROM tags t JOIN urls u ON u.id = t.id GROUP BY tag""",
)
add(
    "h14_category_listing",
    lambda t: stats.category_listing(t.urls),
    "urls",
    "SELECT category, title, url FROM urls WHERE category IS NOT NULL",
)
TAGS = "tags1 AS (SELECT trim(unnest(string_split(category, ','))) AS tag FROM tag_lists), used AS (SELECT tag, count(*) AS count FROM tags1 WHERE tag <> '' GROUP BY tag)"
add("h15_tag_frequency", lambda t: stats.tag_frequency(t.tag_lists), "tag_lists", f"WITH {TAGS} SELECT * FROM used")
add(
    "h15_tag_totals",
    lambda t: stats.tag_totals(t.tag_lists),
    "tag_lists",
    f"WITH {TAGS} SELECT count(*) AS unique_tags, CAST(sum(count) AS BIGINT) AS assignments FROM used",
)
