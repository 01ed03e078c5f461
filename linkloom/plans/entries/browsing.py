"""Listings, pages and search."""

from pyspark.sql import functions as F

from linkloom.operators import browse
from linkloom.plans.catalog import add
from linkloom.plans.views import RULE_DOMAIN

FIELDS = f"""id, url, title, description, category, processed_at, added_at, coalesce(manual_override, 0) AS manual_override, {RULE_DOMAIN} AS domain,
  array_to_string(list_filter(list_transform(string_split(coalesce(category, ''), ','), lambda x: trim(x)), lambda x: x <> ''), '|') AS categories_list"""
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ORDERS = {
    "newest": "added_at DESC, id DESC",
    "oldest": "added_at, id",
    "title": "coalesce(title, url) NULLS FIRST, id",
    "id_desc": "id DESC",
    "id_asc": "id",
}


def shown(rows):
    return rows.withColumn("categories_list", F.array_join("categories_list", "|"))


def folded(column: str, query: str) -> str:
    return f"coalesce(translate({column}, '{UPPER}', '{LOWER}') LIKE '%{query}%' ESCAPE chr(1), false)"


def found(query: str) -> str:
    return "(" + " OR ".join(folded(c, query) for c in ("title", "description", "url")) + ")"


for _sort, _order in ORDERS.items():
    add(
        f"b1_sort_{_sort}",
        lambda t, s=_sort: shown(browse.page(browse.recent(t.urls), 2, 30, s)),
        "urls",
        f"SELECT {FIELDS} FROM urls WHERE status = 'done' ORDER BY {_order} LIMIT 30 OFFSET 30",
    )
add(
    "b2_page_info",
    lambda t: browse.page_info(browse.recent(t.urls), 30),
    "urls",
    "SELECT count(*) AS total, CAST(greatest(1, ceil(count(*) / 30)) AS BIGINT) AS pages FROM urls WHERE status = 'done'",
)
add(
    "b2_page_past_end",
    lambda t: shown(browse.page(browse.recent(t.urls), 1000, 100)),
    "urls",
    f"SELECT {FIELDS} FROM urls WHERE status = 'done' ORDER BY added_at DESC, id DESC LIMIT 100 OFFSET 99900",
)
add(
    "b3_by_category",
    lambda t: shown(browse.page(browse.by_category(t.urls, "cat2"), 1, 10)),
    "urls",
    f"SELECT {FIELDS} FROM urls WHERE status = 'done' AND category = 'cat2' ORDER BY added_at DESC, id DESC LIMIT 10",
)
add(
    "b4_recent",
    lambda t: shown(browse.page(browse.recent(t.urls), sort="no such order")),
    "urls",
    f"SELECT {FIELDS} FROM urls WHERE status = 'done' ORDER BY added_at DESC, id DESC LIMIT 20",
)
add(
    "b5_uncategorized",
    lambda t: shown(browse.page(browse.uncategorized(t.urls), 1, 500, "title")),
    "urls",
    f"SELECT {FIELDS} FROM urls WHERE status = 'done' AND coalesce(category, '') = '' ORDER BY coalesce(title, url), id LIMIT 100",
)
SEARCHES = {
    "b6_search_plain": ("EXAMPLE.org", "", "example.org"),
    "b6_search_wildcards": ("t_e%on", "recent", "t_e%on"),
    "b6_search_backslash": ("a\\b", "", "a\\b"),
    "b6_search_accents": ("É", "uncategorized", "É"),
    "b6_search_category": ("the", "cat1", "the"),
}
_WHERE = {"": "true", "recent": "true", "uncategorized": "coalesce(category, '') = ''", "cat1": "category = 'cat1'"}
for _name, (_query, _category, _needle) in SEARCHES.items():
    add(
        _name,
        lambda t, q=_query, c=_category: shown(browse.page(browse.search(t.urls, q, c), 1, 50)),
        "urls",
        f"SELECT {FIELDS} FROM urls WHERE status = 'done' AND {_WHERE[_category]} AND {found(_needle)} ORDER BY added_at DESC, id DESC LIMIT 50",
    )
add(
    "b6_search_total",
    lambda t: browse.page_info(browse.search(t.urls, "Th")),
    "urls",
    f"SELECT count(*) AS total, CAST(greatest(1, ceil(count(*) / 20)) AS BIGINT) AS pages FROM urls WHERE status = 'done' AND {found('th')}",
)
