"""Rules, prompts, answers and category writes."""

from pyspark.sql import functions as F

from linkloom.functions import answers as texts
from linkloom.functions import prompts
from linkloom.operators import classify, worklists
from linkloom.plans.catalog import add
from linkloom.plans.views import NORM_DOMAIN, RULE_DOMAIN

WORK = "work AS (SELECT * FROM urls WHERE status = 'done' AND coalesce(category, '') = '' AND coalesce(manual_override, 0) = 0 AND coalesce(title, '') <> '')"
ROUTED = f"""routed AS (SELECT w.id, w.url, w.title, w.description, r.section AS rule_section, r.category AS rule_category,
  CASE WHEN r.category IS NOT NULL THEN 'rule' WHEN r.section IS NOT NULL THEN 'section' ELSE 'open' END AS route
  FROM work w LEFT JOIN rules r ON r.domain = {RULE_DOMAIN.replace('url', 'w.url')})"""


def _literal(text: str) -> str:
    """A text of the prompts as an SQL string."""
    return "'" + text.replace("'", "''") + "'"


SINGLE_HEAD, BATCH_HEAD, BATCH_TAIL = (_literal(x) for x in (prompts.SINGLE_HEAD, prompts.BATCH_HEAD, prompts.BATCH_TAIL))
WHOLE = "(SELECT string_agg(name, ', ' ORDER BY sort_order, id) FROM categories)"
SECTION = "(SELECT string_agg(name, ', ' ORDER BY sort_order, id) FROM categories c WHERE c.section = rule_section)"


def _canonical(text: str) -> str:
    return f"(SELECT min(c.name) FROM categories c WHERE lower(c.name) = lower({text}))"


def _marks(text: str, extra: str = "") -> str:
    return f"trim(trim({text}), '\"''.,;:-{extra}')"


def _normalized(raw: str) -> str:
    bold = f"regexp_extract({raw}, '\\*\\*(.+?)\\*\\*', 1)"
    labelled = f"regexp_extract({raw}, '(?i)(?:категория|катерия|category)\\s*[:—–-]\\s*(.+)', 1)"
    line = f"""(SELECT arg_min(c.name, l.i) FROM (SELECT unnest(string_split({raw}, chr(10))) AS line, generate_subscripts(string_split({raw}, chr(10)), 1) AS i) l
      JOIN categories c ON lower(c.name) = lower({_marks('l.line', '*')}))"""
    return f"coalesce({_canonical(_marks(raw))}, {_canonical(_marks(bold))}, {_canonical(_marks(labelled, '*'))}, {line})"


def work(t):
    return worklists.unclassified(t.urls, ordered=False)


def stub_model(prompt: str) -> str:
    """Deterministic stand-in for a model: names a category by the length of the title."""
    title = prompt.rsplit("\nTitle: ", 1)[1].split("\n", 1)[0]
    if len(title) % 9 == 4:
        raise classify.ModelError("refused")
    return f"Category: **CAT{len(title) % 13}**"


STUB = "CASE WHEN length(title) % 9 = 4 OR length(title) % 13 IN (10, 12) THEN NULL ELSE concat('cat', CAST(length(title) % 13 AS VARCHAR)) END"
STUB_KIND = "CASE WHEN length(title) % 9 = 4 THEN 'api_err' WHEN length(title) % 13 IN (10, 12) THEN 'empty' ELSE 'ok' END"


def stub_list_model(prompt: str) -> str:
    """The same stand-in for numbered lists; it skips every title of an even length."""
    if "numbered list" not in prompt:
        return stub_model(prompt)
    lines = [line for line in prompt.split("\n") if ". Title: " in line]
    sized = [(line.split(". Title: ", 1)[0], len(line.split(". Title: ", 1)[1])) for line in lines]
    return "\n".join(f"{n}. cat{size % 13}" for n, size in sized if size % 2)


LISTED = f"CASE WHEN length(title) % 2 = 1 AND length(title) % 13 NOT IN (10, 12) THEN concat('cat', CAST(length(title) % 13 AS VARCHAR)) ELSE {STUB} END"
LISTED_KIND = f"CASE WHEN length(title) % 2 = 1 AND length(title) % 13 NOT IN (10, 12) THEN 'ok' ELSE {STUB_KIND} END"


add("c1_unclassified", lambda t: worklists.unclassified(t.urls), "urls", f"WITH {WORK} SELECT id, url, title, description FROM work")
add(
    "c2_route_by_rules",
    lambda t: classify.route_by_rules(work(t), t.rules),
    "urls rules",
    f"WITH {WORK}, {ROUTED} SELECT * FROM routed",
)
add(
    "c3_rule_violations",
    lambda t: classify.rule_violations(t.loose_rules, t.categories),
    "loose_rules categories",
    """SELECT domain, 'category' AS kind, category AS value FROM loose_rules WHERE category IS NOT NULL AND category NOT IN (SELECT name FROM categories)
UNION ALL SELECT domain, 'section', section FROM loose_rules WHERE section IS NOT NULL AND section NOT IN (SELECT section FROM categories)""",
)
add(
    "c4_allowed_lists",
    lambda t: classify.allowed_lists(t.categories),
    "categories",
    "SELECT section, string_agg(name, ', ' ORDER BY sort_order, id) AS allowed FROM categories GROUP BY section UNION ALL SELECT NULL, string_agg(name, ', ' ORDER BY sort_order, id) FROM categories",
)
add(
    "c5_prompts",
    lambda t: classify.with_prompt(classify.route_by_rules(work(t), t.rules), t.categories, "rule_section").select("id", "prompt"),
    "urls rules categories",
    f"""WITH {WORK}, {ROUTED} SELECT id, {SINGLE_HEAD} || 'Allowed categories: ' || coalesce({SECTION}, {WHOLE}) || chr(10) || chr(10) || 'Title: ' || title || chr(10) ||
  CASE WHEN coalesce(description, '') <> '' THEN 'Description: ' || substring(description, 1, 200) || chr(10) ELSE '' END || 'Category:' AS prompt FROM routed""",
)
add(
    "c6_batch_prompts",
    lambda t: classify.batch_prompts(work(t), t.categories, 10).select("chunk", "n", F.array_join(F.transform("ids", lambda i: i.cast("string")), "|").alias("ids"), "prompt"),
    "urls categories",
    f"""WITH {WORK}, placed AS (SELECT *, row_number() OVER (ORDER BY id) - 1 AS r FROM work),
items AS (SELECT id, r // 10 AS chunk, r % 10 + 1 AS item, CAST(r % 10 + 1 AS VARCHAR) || '. Title: ' || title ||
  CASE WHEN coalesce(description, '') <> '' THEN chr(10) || '   Description: ' || substring(description, 1, 150) || chr(10) ELSE '' END AS line FROM placed)
SELECT chunk, CAST(count(*) AS INTEGER) AS n, string_agg(CAST(id AS VARCHAR), '|' ORDER BY item) AS ids,
  {BATCH_HEAD} || 'Allowed categories: ' || {WHOLE} || chr(10) || {BATCH_TAIL} || chr(10) || chr(10) || string_agg(line, chr(10) ORDER BY item) AS prompt
FROM items GROUP BY chunk""",
)
add(
    "c7_normalize_answers",
    lambda t: classify.normalized(t.answers, t.categories),
    "answers categories",
    f"SELECT id, raw, {_normalized('raw')} AS category FROM answers",
)
add(
    "c8_parse_batches",
    lambda t: classify.parsed_batches(t.batch_answers, t.categories).select("id", "item", "category"),
    "batch_answers categories",
    f"""WITH lines AS (SELECT id, n, trim(unnest(string_split(raw, chr(10)))) AS line, generate_subscripts(string_split(raw, chr(10)), 1) AS i FROM batch_answers),
numbered AS (SELECT id, n, i, TRY_CAST(regexp_extract(line, '^([0-9]+)[.)]\\s+(.+)$', 1) AS INTEGER) AS item, regexp_extract(line, '^([0-9]+)[.)]\\s+(.+)$', 2) AS answer FROM lines WHERE regexp_matches(line, '^([0-9]+)[.)]\\s+(.+)$')),
named AS (SELECT id, i, item, {_normalized('answer')} AS category FROM numbered WHERE item BETWEEN 1 AND n),
best AS (SELECT id, item, arg_max(category, i) AS category FROM named WHERE category IS NOT NULL GROUP BY id, item)
SELECT s.id, s.item, best.category FROM (SELECT id, unnest(generate_series(1, n))::INTEGER AS item FROM batch_answers) s LEFT JOIN best ON best.id = s.id AND best.item = s.item""",
)
add(
    "c9_annotate",
    lambda t: classify.annotate(work(t), stub_model, t.categories).select("id", "category", "error_kind"),
    "urls",
    f"WITH {WORK} SELECT id, {STUB} AS category, {STUB_KIND} AS error_kind FROM work",
)
add(
    "c9_annotate_batches",
    lambda t: classify.annotate(work(t), stub_list_model, t.categories, batch_size=7).select("id", "category", "error_kind"),
    "urls",
    f"WITH {WORK} SELECT id, {LISTED} AS category, {LISTED_KIND} AS error_kind FROM work",
)


def tagged(t):
    return classify.tag_answers(classify.classify(t.urls, t.rules, t.categories, stub_model), "stub")


PASS = f"""WITH {WORK}, {ROUTED}, passed AS (SELECT id, url, route, CASE WHEN route = 'rule' THEN rule_category ELSE {STUB} END AS category,
  CASE WHEN route = 'rule' THEN 'ok' ELSE {STUB_KIND} END AS error_kind, CASE WHEN route = 'rule' THEN 'domain_rule' ELSE 'stub' END AS tagged_by FROM routed)"""
add(
    "c10_set_categories",
    lambda t: classify.set_categories(t.urls, tagged(t)).select("id", "category", "tagged_by", "changed"),
    "urls rules",
    PASS
    + """ SELECT u.id, CASE WHEN p.category IS NOT NULL THEN p.category ELSE u.category END AS category,
  CASE WHEN p.category IS NOT NULL THEN p.tagged_by ELSE u.tagged_by END AS tagged_by, p.category IS NOT NULL AS changed FROM urls u LEFT JOIN passed p ON p.id = u.id""",
)
add(
    "c11_reset_categories",
    lambda t: classify.reset_categories(t.urls).select("id", "category", "tagged_by", "changed"),
    "urls",
    "SELECT id, CASE WHEN status <> 'done' THEN category END AS category, CASE WHEN status <> 'done' THEN tagged_by END AS tagged_by, status = 'done' AS changed FROM urls",
)
add(
    "c12_reset_domain",
    lambda t: classify.reset_categories(t.urls, "WWW.spam-farm.example.org").select("id", "category", "tagged_by", "changed"),
    "urls",
    f"""WITH m AS (SELECT *, status = 'done' AND {NORM_DOMAIN} = 'spam-farm.example.org' AS changed FROM urls)
SELECT id, CASE WHEN NOT changed THEN category END AS category, CASE WHEN NOT changed THEN tagged_by END AS tagged_by, changed FROM m""",
)
add(
    "c13_edit_categories",
    lambda t: classify.edit_categories(t.urls, t.edits).select("id", "category", "manual_override", "changed"),
    "urls edits",
    """SELECT u.id, CASE WHEN e.id IS NULL THEN u.category ELSE e.category END AS category, CASE WHEN e.id IS NULL THEN u.manual_override ELSE 1 END AS manual_override,
  e.id IS NOT NULL AS changed FROM urls u LEFT JOIN edits e ON e.id = u.id""",
)
add(
    "c14_valid_tags",
    lambda t: t.tags.select("id", "tag", texts.is_valid_tag(F.col("tag")).alias("valid")),
    "tags",
    """SELECT id, tag, NOT (length(tag) > 40 OR len(list_filter(regexp_split_to_array(tag, '\\s+'), lambda x: x <> '')) > 4
  OR regexp_matches(lower(tag), '^(url:|http|title:|category:|the web|the page|i''m sorry)') OR regexp_matches(lower(tag), 'web page|web site|sorry')) AS valid FROM tags""",
)
add(
    "c15_summary",
    lambda t: classify.summary(classify.classify(t.urls, t.rules, t.categories, stub_model)),
    "urls rules",
    PASS + " SELECT route, error_kind, count(*) AS count FROM passed GROUP BY route, error_kind",
)
add(
    "c16_dry_run",
    lambda t: classify.classify(t.urls, t.rules, t.categories, stub_model),
    "urls rules",
    PASS + " SELECT id, url, route, category, error_kind FROM passed",
)
