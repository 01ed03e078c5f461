"""Input tables of the query catalogue, derived from the driver's parquet tables.

The SQL runs unchanged in Spark and DuckDB, so the same text builds the Spark view and the
common table expressions of the oracle. ``{ROW}`` is the one word that differs.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NETLOC = "regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)"
NORM_DOMAIN = f"regexp_replace(lower({NETLOC}), '^www[.]', '')"
RULE_DOMAIN = f"regexp_replace({NETLOC}, '^www[.]', '')"

# name -> (tables and views it reads, SQL)
VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "urls": (
        ("pages",),
        """SELECT page_id + 1 AS id, url,
  CASE WHEN page_id % 10 = 7 THEN 'error' WHEN page_id % 10 = 8 THEN 'deferred' WHEN page_id % 10 = 9 THEN 'pending' ELSE 'done' END AS status,
  CASE WHEN page_id % 10 > 6 THEN NULL WHEN page_id % 13 = 0 THEN NULL WHEN page_id % 23 = 1 THEN '' ELSE regexp_extract(html, '<title>([^<]*)</title>', 1) END AS title,
  CASE WHEN page_id % 10 > 6 THEN NULL WHEN page_id % 4 = 1 THEN NULL WHEN page_id % 4 = 3 THEN '' ELSE substring(regexp_extract(html, '<h1>([^<]*)</h1>', 1), 1, 300) END AS description,
  CASE WHEN page_id % 10 NOT IN (7, 8) THEN NULL
       WHEN CAST(floor(page_id / 10) AS BIGINT) % 7 = 3 THEN 'Read timed out'
       WHEN CAST(floor(page_id / 10) AS BIGINT) % 7 = 5 THEN concat('503 Server Error: Unavailable for url: ', url)
       ELSE concat(CASE CAST(floor(page_id / 10) AS BIGINT) % 7 WHEN 0 THEN '403' WHEN 1 THEN '429' WHEN 2 THEN '404' WHEN 4 THEN '402' ELSE '410' END, ' Client Error: Failed for url: ', url) END AS error,
  CASE WHEN page_id % 10 IN (7, 8) THEN CASE CAST(floor(page_id / 10) AS BIGINT) % 7 WHEN 0 THEN 403 WHEN 1 THEN 429 WHEN 2 THEN 404 WHEN 4 THEN 402 WHEN 5 THEN 503 WHEN 6 THEN 410 END END AS error_code,
  CAST(concat('2026-03-', lpad(CAST(1 + page_id % 28 AS VARCHAR(4)), 2, '0'), ' ', lpad(CAST(page_id % 24 AS VARCHAR(4)), 2, '0'), ':00:00') AS TIMESTAMP) AS added_at,
  CASE WHEN page_id % 10 < 9 THEN CAST(concat('2026-04-', lpad(CAST(1 + page_id % 28 AS VARCHAR(4)), 2, '0'), ' 12:00:00') AS TIMESTAMP) END AS processed_at,
  CASE WHEN page_id % 10 > 6 OR page_id % 3 = 0 THEN NULL WHEN page_id % 29 = 1 THEN '' WHEN page_id % 19 = 1 THEN concat('CAT', CAST(page_id % 11 AS VARCHAR(4))) ELSE concat('cat', CAST(page_id % 11 AS VARCHAR(4))) END AS category,
  CASE WHEN page_id % 10 < 7 AND page_id % 3 <> 0 THEN concat('model_', CAST(page_id % 2 AS VARCHAR(4))) END AS tagged_by,
  CASE WHEN page_id % 17 = 0 THEN 1 WHEN page_id % 5 = 0 THEN NULL ELSE 0 END AS manual_override
FROM pages""",
    ),
    "categories": (
        ("pages",),
        """SELECT k + 1 AS id, concat('cat', CAST(k AS VARCHAR(4))) AS name, concat('s', CAST(CAST(floor(k / 3) AS BIGINT) AS VARCHAR(4))) AS section, k AS sort_order
FROM (SELECT DISTINCT page_id % 12 AS k FROM pages) t WHERE k <> 10""",
    ),
    "rules": (
        ("pages",),
        f"""SELECT domain, CASE WHEN length(domain) % 5 IN (1, 2) OR domain LIKE 'blog.%' THEN 's1' END AS section, CASE WHEN length(domain) % 5 IN (0, 2) THEN 'cat3' END AS category
FROM (SELECT DISTINCT {RULE_DOMAIN} AS domain FROM pages) t
WHERE length(domain) % 5 IN (0, 1, 2) OR domain LIKE 'blog.%'""",
    ),
    # rules that partly name what the taxonomy does not have
    "loose_rules": (
        ("rules",),
        """SELECT domain, CASE WHEN length(domain) % 2 = 0 THEN 's9' ELSE section END AS section, CASE WHEN length(domain) % 3 = 0 THEN 'cat10' ELSE category END AS category
FROM rules""",
    ),
    "raw_links": (
        ("pages",),
        """SELECT page_id AS doc_id, concat('- [', CAST(page_id AS VARCHAR(8)), '](', url, '), also <', url, '> | "https://new', CAST(page_id % 40 AS VARCHAR(8)), '.example.org/a?b=1"!, see https://www.Mixed.example.com/', CAST(page_id % 7 AS VARCHAR(4)), ').;') AS text
FROM pages""",
    ),
    "fetch_results": (
        ("pages",),
        """SELECT url,
  CASE WHEN page_id % 4 <> 0 THEN regexp_extract(html, '<title>([^<]*)</title>', 1) END AS title,
  CASE WHEN page_id % 4 IN (1, 2) THEN 'refetched text' END AS description,
  CASE WHEN page_id % 4 = 0 THEN '429 Client Error: Too Many Requests' END AS error,
  CASE WHEN page_id % 4 = 0 THEN 429 END AS error_code
FROM pages WHERE page_id % 10 > 6 OR page_id % 2 = 1""",
    ),
    "stub_pages": (
        ("pages",),
        """SELECT page_id, url, CASE WHEN page_id % 5 = 0 THEN concat('<script>defaultHash = "', md5(url), '"</script>') WHEN page_id % 5 = 1 THEN concat('<script>defaultHash="', md5(url), '"</script>', repeat(' ', 1500)) ELSE html END AS html
FROM pages""",
    ),
    # pages without a title tag, with the other places a title or description can come from
    "rich_pages": (
        ("pages",),
        """SELECT page_id, url, concat(CASE page_id % 8
    WHEN 1 THEN concat('<meta property="og:title" content=" OG ', CAST(page_id AS VARCHAR(8)), ' "><meta name="description" content="M &amp; ', CAST(page_id AS VARCHAR(8)), '">')
    WHEN 2 THEN concat('<script type="application/ld+json">{"name": "LD ', CAST(page_id AS VARCHAR(8)), '", "description": " D ', CAST(page_id AS VARCHAR(8)), ' "}</script>')
    WHEN 3 THEN concat('<script type="application/ld+json">[1, {"description": "L ', CAST(page_id AS VARCHAR(8)), '"}, {"name": "no"}]</script>')
    WHEN 4 THEN concat('<script type="application/ld+json">{bad</script><script type="application/ld+json">{"url": 1}</script><script type="application/ld+json">{"name": "G ', CAST(page_id AS VARCHAR(8)), '"}</script>')
    WHEN 5 THEN concat('<meta content="OG ', CAST(page_id AS VARCHAR(8)), '" property="og:title"><script type="application/ld+json">{"name": 5, "description": null}</script>')
    WHEN 6 THEN '<script type="application/ld+json">{"description": 7}</script>'
    WHEN 7 THEN '<meta property="og:description" content=" "><meta property="og:description" content="second">' ELSE '' END, replace(html, 'title>', 'b>')) AS html
FROM pages""",
    ),
    "model_results_raw": (
        ("lineitem",),
        """SELECT l_orderkey AS url_id, concat('model_', CAST(l_linenumber AS VARCHAR(4)), ':latest') AS model,
  CASE WHEN l_linenumber = 2 AND l_quantity < 3 THEN '' WHEN l_linenumber = 3 AND l_quantity > 40 THEN concat(l_returnflag, '_', l_linestatus) WHEN l_linenumber = 4 AND l_quantity > 40 THEN 'a b c d e' WHEN l_quantity > 25 THEN lower(l_returnflag) ELSE l_returnflag END AS category,
  CAST(l_shipdate AS TIMESTAMP) AS tagged_at,
  {ROW}(l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax, l_returnflag, l_linestatus) AS tie
FROM lineitem""",
    ),
    "model_results": (
        ("model_results_raw",),
        """SELECT url_id, model, category, tagged_at FROM (SELECT r.*, row_number() OVER (PARTITION BY url_id, model ORDER BY tagged_at DESC, tie DESC) AS rn FROM model_results_raw r) t WHERE rn = 1""",
    ),
    # every model answers every order, so that some models pass the knock-out
    "panel": (
        ("orders",),
        """SELECT o_orderkey AS url_id, 'alpha:8b' AS model, lower(o_orderpriority) AS category, CAST(o_orderdate AS TIMESTAMP) AS tagged_at FROM orders
UNION ALL SELECT o_orderkey, 'beta:24b', CASE WHEN o_custkey % 4 = 0 THEN o_orderpriority ELSE lower(o_orderpriority) END, CAST(o_orderdate AS TIMESTAMP) FROM orders
UNION ALL SELECT o_orderkey, 'gamma', CASE WHEN o_custkey % 3 = 0 THEN lower(o_orderstatus) ELSE lower(o_orderpriority) END, CAST(o_orderdate AS TIMESTAMP) FROM orders
UNION ALL SELECT o_orderkey, 'delta:7b', CASE WHEN o_custkey % 30 = 0 THEN concat('x_', o_orderstatus) WHEN o_custkey % 25 = 0 THEN 'one two three four five' ELSE o_orderstatus END, CAST(o_orderdate AS TIMESTAMP) FROM orders
UNION ALL SELECT o_orderkey, 'omega', CASE WHEN o_custkey % 2 = 0 THEN ' Shared ' ELSE lower(o_orderstatus) END, CAST(o_orderdate AS TIMESTAMP) FROM orders""",
    ),
    "answers": (
        ("pages",),
        """SELECT page_id AS id,
  CASE page_id % 7 WHEN 0 THEN concat('"CAT', CAST(page_id % 10 AS VARCHAR(4)), '".') WHEN 1 THEN concat('I would pick **cat', CAST(page_id % 10 AS VARCHAR(4)), '** here') WHEN 2 THEN concat('Category: cat', CAST(page_id % 10 AS VARCHAR(4)))
    WHEN 3 THEN concat('Because it fits.', chr(10), '*cat', CAST(page_id % 10 AS VARCHAR(4)), '*', chr(10), 'done') WHEN 4 THEN 'cat10' WHEN 5 THEN '' ELSE concat('КАТЕГОРИЯ — Cat', CAST(page_id % 10 AS VARCHAR(4))) END AS raw
FROM pages""",
    ),
    "batch_answers": (
        ("pages",),
        """SELECT page_id AS id, CAST(3 AS INTEGER) AS n,
  concat('Here you go:', chr(10), '1. cat', CAST(page_id % 13 AS VARCHAR(4)), chr(10), ' 3) **CAT', CAST(page_id % 11 AS VARCHAR(4)), '** ', chr(10), '9. cat2', chr(10),
    CASE WHEN page_id % 2 = 0 THEN concat('2. Category: cat', CAST(page_id % 5 AS VARCHAR(4)), chr(10)) ELSE concat('2 cat1', chr(10)) END,
    CASE WHEN page_id % 3 = 0 THEN '1. cat4' ELSE '1. junk' END) AS raw
FROM pages""",
    ),
    "category_mapping": (
        ("pages",),
        """SELECT DISTINCT concat('cat', CAST(page_id % 8 AS VARCHAR(4))) AS old, CASE WHEN page_id % 8 < 3 THEN 'cat1' ELSE concat('cat', CAST(page_id % 8 AS VARCHAR(4))) END AS new
FROM pages WHERE page_id % 8 <> 5""",
    ),
    "cleanup_rules": (
        ("pages",),
        f"""SELECT CAST(2 AS BIGINT) AS rule_no, 403 AS error_code, domain FROM (SELECT DISTINCT {NORM_DOMAIN} AS domain FROM pages) d WHERE length(domain) % 2 = 0
UNION ALL SELECT DISTINCT CAST(1 + page_id % 2 * 4 AS BIGINT), CASE WHEN page_id % 2 = 0 THEN 410 ELSE 404 END, CAST(NULL AS VARCHAR(9)) FROM pages
UNION ALL SELECT DISTINCT CAST(9 AS BIGINT), 403, {NORM_DOMAIN} FROM pages""",
    ),
    # hand edits of links without a description, and links that are gone for good
    "edits": (("urls",), "SELECT id, concat('cat', CAST(id % 4 AS VARCHAR(4))) AS category FROM urls WHERE status = 'done' AND coalesce(description, '') = ''"),
    "doomed": (("urls",), "SELECT id FROM urls WHERE error_code IN (404, 410) OR title = ''"),
    "tag_lists": (
        ("urls",),
        """SELECT id, CASE WHEN id % 3 = 0 THEN concat(coalesce(category, 'none'), ', ', status) WHEN id % 3 = 1 THEN category ELSE concat(status, ' ,,', coalesce(tagged_by, '')) END AS category
FROM urls""",
    ),
    "tags": (("pages",), "SELECT page_id AS id, CASE page_id % 6 WHEN 0 THEN concat('Sorry, no ', CAST(page_id AS VARCHAR(8))) WHEN 1 THEN 'a b c d e' WHEN 2 THEN regexp_extract(html, '<h1>([^<]*)</h1>', 1) WHEN 3 THEN concat('URL: ', url) WHEN 4 THEN 'Data' ELSE regexp_extract(html, '<h1>([A-Za-z]*)', 1) END AS tag FROM pages"),
    "predictions": (
        ("lineitem",),
        """SELECT l_returnflag AS label, CASE WHEN l_quantity < 10 THEN 'N' WHEN l_quantity > 45 THEN 'X' ELSE l_returnflag END AS prediction
FROM lineitem""",
    ),
    "runs": (
        ("lineitem",),
        """SELECT l_linenumber AS run_no, l_linenumber * 5 AS batch, 1 + l_linenumber % 4 AS workers, count(*) AS done,
  CASE WHEN l_linenumber = 7 THEN CAST(0 AS DOUBLE) ELSE CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) / l_linenumber END AS elapsed_sec
FROM lineitem GROUP BY l_linenumber""",
    ),
    "speeds": (
        ("panel",),
        """SELECT model, CAST(sum(CAST(length(category) AS BIGINT)) AS DOUBLE) / count(*) AS sec_per_url FROM panel GROUP BY model""",
    ),
    "section_entries": (
        ("part",),
        """SELECT p_brand AS section, p_type AS name, CAST(dense_rank() OVER (ORDER BY p_brand) - 1 AS INTEGER) AS position, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_type) - 1 AS INTEGER) AS place
FROM (SELECT DISTINCT p_brand, p_type FROM part) t""",
    ),
}


def with_views(names: str | list[str], body: str) -> str:
    """Oracle SQL: the needed views as common table expressions, then ``body``."""
    wanted = names.split() if isinstance(names, str) else names
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in VIEWS and name not in ordered:
            for parent in VIEWS[name][0]:
                visit(parent)
            ordered.append(name)

    for name in wanted:
        visit(name)
    parts = [f"{n} AS ({VIEWS[n][1].replace('{ROW}', 'row')})" for n in ordered]
    body = body.strip()
    if body.upper().startswith("WITH "):
        parts.append(body[5:].strip())
        return "WITH " + ",\n".join(parts)
    return ("WITH " + ",\n".join(parts) + "\n" + body) if parts else body


class Tables:
    """The same views as DataFrames over one scale-factor folder; ``t.urls``, ``t.pages``, ..."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name in VIEWS:
            parents, sql = VIEWS[name]
            frame = self.spark.sql(self._bind(sql.replace("{ROW}", "struct"), parents), **{p: getattr(self, p) for p in parents})
        else:
            frame = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        setattr(self, name, frame)
        return frame

    @staticmethod
    def _bind(sql: str, parents: tuple[str, ...]) -> str:
        sql = sql.replace("{", "{{").replace("}", "}}")
        for parent in parents:
            sql = sql.replace(f"FROM {parent}", f"FROM {{{parent}}}")
        return sql

    @cached_property
    def latest(self) -> DataFrame:
        """``model_results`` through the library's own upsert rule."""
        from linkloom.operators.compare import latest_results

        return latest_results(self.model_results_raw, ["tagged_at", "tie"], ["category", "tagged_at"])

    @cached_property
    def sections(self) -> DataFrame:
        entries = self.section_entries.groupBy("section", "position")
        names = F.array_sort(F.collect_list(F.struct("place", "name")))
        return entries.agg(F.transform(names, lambda n: n["name"]).alias("names"))
