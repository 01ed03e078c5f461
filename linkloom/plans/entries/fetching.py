"""Page metadata and fetch outcomes."""

from linkloom.operators import pages, status, worklists
from linkloom.plans.catalog import add
from linkloom.plans.entries.imports import NOW, now

REGEX = "regexp_extract(html, '<{0}>([^<]*)</{0}>', 1)"
UNESCAPE = "regexp_replace(replace(replace(replace({}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp(;|$)', '&', 'g')"
TITLE = f"trim({UNESCAPE.format(REGEX.format('title'))})"
H1 = f"trim({UNESCAPE.format(REGEX.format('h1'))})"

add(
    "p1_titles",
    lambda t: pages.page_meta(t.pages).select("page_id", "url", "title", "title_source"),
    "",
    f"SELECT page_id, url, {TITLE} AS title, 'title_tag' AS title_source FROM pages",
)
add(
    "p2_descriptions",
    lambda t: pages.page_meta(t.pages).select("page_id", "url", "description", "description_source", "error"),
    "",
    f"SELECT page_id, url, {H1} AS description, 'h1' AS description_source, CAST(NULL AS VARCHAR) AS error FROM pages",
)
add(
    "p3_sources",
    lambda t: pages.page_meta(t.rich_pages),
    "rich_pages",
    f"""WITH k AS (SELECT *, page_id % 8 AS k, CAST(page_id AS VARCHAR) AS n FROM rich_pages)
SELECT page_id, url, CASE k WHEN 1 THEN 'OG ' || n WHEN 2 THEN 'LD ' || n WHEN 4 THEN 'G ' || n WHEN 5 THEN 'OG ' || n END AS title,
  CASE k WHEN 1 THEN 'M & ' || n WHEN 2 THEN 'D ' || n WHEN 3 THEN 'L ' || n WHEN 6 THEN NULL ELSE {H1} END AS description,
  CASE WHEN k = 6 THEN '''int'' object has no attribute ''strip''' END AS error, CAST(NULL AS INTEGER) AS error_code,
  CASE k WHEN 1 THEN 'og_title' WHEN 2 THEN 'ld_name' WHEN 4 THEN 'ld_name' WHEN 5 THEN 'og_title' END AS title_source,
  CASE k WHEN 1 THEN 'meta_description' WHEN 2 THEN 'ld_description' WHEN 3 THEN 'ld_description' WHEN 6 THEN 'ld_description' ELSE 'h1' END AS description_source FROM k""",
)
add(
    "p3_candidates",
    lambda t: pages.candidates(t.rich_pages).drop("paragraph"),
    "rich_pages",
    f"""WITH k AS (SELECT *, page_id % 8 AS k, CAST(page_id AS VARCHAR) AS n FROM rich_pages)
SELECT page_id, url, CAST(NULL AS VARCHAR) AS parse_error, CAST(NULL AS VARCHAR) AS title_tag, CASE WHEN k IN (1, 5) THEN 'OG ' || n END AS og_title,
  CASE k WHEN 2 THEN 'LD ' || n WHEN 4 THEN 'G ' || n END AS ld_name, CASE WHEN k = 5 THEN '''int'' object has no attribute ''strip''' END AS ld_name_error,
  CASE WHEN k = 7 THEN '' END AS og_description, CASE WHEN k = 1 THEN 'M & ' || n END AS meta_description,
  CASE k WHEN 2 THEN 'D ' || n WHEN 3 THEN 'L ' || n END AS ld_description, CASE WHEN k = 6 THEN '''int'' object has no attribute ''strip''' END AS ld_description_error,
  {H1} AS h1 FROM k""",
)
add(
    "p4_stubs",
    lambda t: pages.find_stubs(t.stub_pages),
    "stub_pages",
    """SELECT page_id, url, regexp_extract(html, 'defaultHash\\s*=\\s*"([a-f0-9]{32,})"', 1) AS challenge_hash FROM stub_pages
WHERE length(html) <= 1500 AND regexp_matches(html, 'defaultHash\\s*=\\s*"([a-f0-9]{32,})"')""",
)
add(
    "p5_apply_fetch",
    lambda t: status.apply_fetch(t.urls, t.fetch_results, now()).select(
        "id", "status", "title", "description", "error", "error_code", "processed_at", "changed"
    ),
    "urls fetch_results",
    f"""SELECT u.id, CASE WHEN f.url IS NULL THEN u.status WHEN f.error IS NOT NULL THEN 'error' ELSE 'done' END AS status,
  CASE WHEN f.url IS NULL THEN u.title WHEN f.error IS NULL THEN f.title END AS title,
  CASE WHEN f.url IS NULL THEN u.description WHEN f.error IS NULL THEN f.description END AS description,
  CASE WHEN f.url IS NULL THEN u.error ELSE f.error END AS error,
  CASE WHEN f.url IS NULL THEN u.error_code ELSE f.error_code END AS error_code,
  CASE WHEN f.url IS NULL THEN u.processed_at ELSE TIMESTAMP '{NOW}' END AS processed_at, f.url IS NOT NULL AS changed
FROM urls u LEFT JOIN fetch_results f ON f.url = u.url""",
)
add(
    "p6_without_description",
    lambda t: worklists.done_without_description(t.urls),
    "urls",
    "SELECT id, url FROM urls WHERE status = 'done' AND (description IS NULL OR description = '')",
)
REFILL = """WITH r AS (SELECT u.id, u.description, CASE WHEN u.status = 'done' AND coalesce(u.description, '') = '' AND f.url IS NOT NULL THEN
    CASE WHEN coalesce(f.error, '') <> '' THEN 'error' WHEN coalesce(f.description, '') <> '' THEN 'got' ELSE 'no_tag' END END AS outcome, f.description AS fresh
  FROM urls u LEFT JOIN fetch_results f ON f.url = u.url)"""
add(
    "p7_refill_descriptions",
    lambda t: status.refill_descriptions(t.urls, t.fetch_results).select("id", "description", "changed", "outcome"),
    "urls fetch_results",
    REFILL
    + " SELECT id, CASE WHEN outcome = 'got' THEN fresh ELSE description END AS description, coalesce(outcome = 'got', false) AS changed, outcome FROM r",
)
add(
    "p7_refill_counts",
    lambda t: status.refill_summary(status.refill_descriptions(t.urls, t.fetch_results)),
    "urls fetch_results",
    REFILL + " SELECT outcome, count(*) AS count FROM r WHERE outcome IS NOT NULL GROUP BY outcome",
)
add(
    "p8_fetch_summary",
    lambda t: status.fetch_summary(t.fetch_results),
    "fetch_results",
    "SELECT count(*) FILTER (error IS NULL) AS done, count(*) FILTER (error IS NOT NULL) AS errors, count(*) AS total FROM fetch_results",
)
add(
    "p8_errors",
    lambda t: worklists.errors(t.urls),
    "urls",
    "SELECT id, url, error, error_code FROM urls WHERE status = 'error'",
)
