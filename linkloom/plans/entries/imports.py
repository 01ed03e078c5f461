"""Sources, link import and domains."""

from pyspark.sql import functions as F

from linkloom import scale
from linkloom.functions import domains
from linkloom.operators import ingest, taxonomy, worklists
from linkloom.plans.catalog import add
from linkloom.plans.views import NETLOC, NORM_DOMAIN, RULE_DOMAIN

NOW = "2026-05-01 00:00:00"


def now():
    return F.lit(NOW).cast("timestamp")


LINKS = r"""WITH found AS (
  SELECT doc_id, unnest(regexp_extract_all(text, 'https?://[^\s|<>"''`]+')) AS raw,
         generate_subscripts(regexp_extract_all(text, 'https?://[^\s|<>"''`]+'), 1) - 1 AS pos FROM raw_links),
links AS (SELECT doc_id, CAST(pos AS INTEGER) AS pos, regexp_replace(raw, '[.,;!?)]+$', '') AS url FROM found),
firsts AS (SELECT url, min({'d': doc_id, 'p': pos}) AS f FROM links GROUP BY url),
seen AS (SELECT url, f.d AS first_doc, f.p AS first_pos FROM firsts)"""

add("s2_pending", lambda t: worklists.pending(t.urls), "urls", "SELECT id, url FROM urls WHERE status = 'pending'")
add("s3_done", lambda t: worklists.done(t.urls), "urls", "SELECT id, url, title, description FROM urls WHERE status = 'done'")
add(
    "s8_seed_categories",
    lambda t: taxonomy.seed(t.sections),
    "section_entries",
    """WITH placed AS (SELECT name, section, row_number() OVER (ORDER BY position, place) - 1 AS sort_order FROM section_entries),
kept AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY sort_order) AS nth FROM placed)
SELECT row_number() OVER (ORDER BY sort_order) AS id, name, section, sort_order FROM kept WHERE nth = 1""",
)
add(
    "l1_extract_links",
    lambda t: ingest.extract_links(t.raw_links),
    "raw_links",
    LINKS + " SELECT doc_id AS doc, pos, url FROM links",
)
add(
    "l2_distinct_links",
    lambda t: ingest.distinct_links(ingest.extract_links(t.raw_links)),
    "raw_links",
    LINKS + " SELECT url, first_doc, first_pos FROM seen",
)
add(
    "l3_insert_links",
    lambda t: ingest.insert_links(t.urls, ingest.extract_links(t.raw_links), now()),
    "raw_links urls",
    LINKS
    + f""" SELECT * FROM urls UNION ALL
SELECT (SELECT max(id) FROM urls) + row_number() OVER (ORDER BY first_doc, first_pos), url, 'pending', NULL, NULL, NULL, NULL,
  TIMESTAMP '{NOW}', NULL, NULL, NULL, 0 FROM seen WHERE url NOT IN (SELECT url FROM urls)""",
)
add(
    "l4_split_known",
    lambda t: ingest.split_known(t.urls, ingest.extract_links(t.raw_links)),
    "raw_links urls",
    LINKS + " SELECT url, first_doc, first_pos, url IN (SELECT url FROM urls) AS is_duplicate FROM seen",
)
add("l5_preview", lambda t: ingest.preview(t.raw_links), "raw_links", LINKS + " SELECT url, first_doc, first_pos FROM seen")
add(
    "l6_import_summary",
    lambda t: ingest.import_summary(ingest.split_known(t.urls, ingest.extract_links(t.raw_links))),
    "raw_links urls",
    LINKS
    + """ SELECT count(*) AS found, count(*) FILTER (url NOT IN (SELECT url FROM urls)) AS added,
  count(*) FILTER (url IN (SELECT url FROM urls)) AS skipped FROM seen""",
)
add(
    "d1_norm_domain",
    lambda t: t.urls.select("id", domains.norm_domain(F.col("url")).alias("domain")),
    "urls",
    f"SELECT id, {NORM_DOMAIN} AS domain FROM urls",
)
add(
    "d2_rule_domain",
    lambda t: t.raw_links.select(
        "doc_id", F.explode(F.regexp_extract_all("text", F.lit("https?://[^|<>)\"]+"), F.lit(0))).alias("url")
    ).select("doc_id", "url", domains.rule_domain(F.col("url")).alias("domain")),
    "raw_links",
    f"""WITH u AS (SELECT doc_id, unnest(regexp_extract_all(text, 'https?://[^|<>)"]+')) AS url FROM raw_links)
SELECT doc_id, url, {RULE_DOMAIN} AS domain FROM u""",
)
add(
    "d3_report_domain",
    lambda t: t.urls.select("id", domains.report_domain(F.col("url")).alias("domain")),
    "urls",
    "SELECT id, replace(regexp_extract(url, '://([^/]*)', 1), 'www.', '') AS domain FROM urls",
)
add(
    "d4_pending_of_domain",
    lambda t: worklists.pending(t.urls, domain="WWW.Blog.ththan.example.net"),
    "urls",
    f"SELECT id, url FROM urls WHERE status = 'pending' AND {NORM_DOMAIN} = 'blog.ththan.example.net'",
)
add(
    "d5_errors_of_domain",
    lambda t: worklists.errors(t.urls, domain="www.cheap-pills.example.com"),
    "urls",
    f"SELECT id, url, error, error_code FROM urls WHERE status = 'error' AND {NORM_DOMAIN} = 'cheap-pills.example.com'",
)
add(
    "d5_done_of_domain",
    lambda t: worklists.done(t.urls, domain="spam-farm.example.org", with_description=False),
    "urls",
    f"SELECT id, url, title, CAST(NULL AS VARCHAR) AS description FROM urls WHERE status = 'done' AND {NORM_DOMAIN} = 'spam-farm.example.org'",
)
add(
    "d6_round_robin",
    lambda t: worklists.round_robin(t.urls.select("id", "url"), id_span=16),
    "urls",
    f"""WITH k AS (SELECT id, url, {NORM_DOMAIN} AS domain FROM urls)
SELECT id, url, domain, row_number() OVER (PARTITION BY domain ORDER BY id) AS turn, min(id) OVER (PARTITION BY domain) AS domain_first_id FROM k""",
)
add(
    "d7_first_n",
    lambda t: worklists.pending(t.urls, limit=10),
    "urls",
    "SELECT id, url FROM urls WHERE status = 'pending' ORDER BY id LIMIT 10",
)
add(
    "d7_numbered",
    lambda t: scale.number_by_id(t.urls.filter("status = 'done'").select("id")),
    "urls",
    "SELECT id, row_number() OVER (ORDER BY id) AS row_no FROM urls WHERE status = 'done'",
)
add(
    "d8_enrich",
    lambda t: domains.enrich(t.tag_lists.join(t.urls.select("id", "url"), "id")).select(
        "id", "domain", F.array_join("categories_list", "|").alias("categories_list")
    ),
    "tag_lists urls",
    f"""SELECT l.id, {RULE_DOMAIN} AS domain,
  array_to_string(list_filter(list_transform(string_split(coalesce(l.category, ''), ','), lambda x: trim(x)), lambda x: x <> ''), '|') AS categories_list
FROM tag_lists l JOIN urls u ON u.id = l.id""",
)
