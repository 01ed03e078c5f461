"""Model comparison."""

import uuid

from pyspark.sql import functions as F

from linkloom.operators import compare
from linkloom.plans.catalog import add
from linkloom.plans.entries.categorising import STUB, stub_model
from linkloom.plans.entries.imports import NOW, now
from linkloom.plans.entries.statistics import pct
from linkloom.plans.entries.training import scratch
from linkloom.sources import results

RETAGGED = "tagged_at < TIMESTAMP '1996-01-01 00:00:00'"
MODELS = [f"model_{i}:latest" for i in range(1, 8)]


def cells(name=str) -> str:
    """One column per model, named by ``name``; the results are aliased as r."""
    cell = "coalesce(max(CASE WHEN r.model = '{0}' THEN r.category END), '')"
    return ", ".join(cell.format(m) + f' AS "{name(m)}"' for m in MODELS)


def _votes(results: str) -> str:
    """Plurality per link: most votes, then the answer of the first model in name order."""
    return f"""tagged AS (SELECT url_id, model, trim(coalesce(category, '')) AS tag FROM {results}),
polls AS (SELECT url_id, lower(tag) AS low, count(*) AS n, min(model) AS first_model FROM tagged WHERE tag <> '' GROUP BY ALL),
best AS (SELECT url_id, low, n FROM polls QUALIFY row_number() OVER (PARTITION BY url_id ORDER BY n DESC, first_model) = 1),
led AS (SELECT i.url_id, coalesce(best.low, '') AS plurality, coalesce(best.n, 0) AS depth FROM (SELECT DISTINCT url_id FROM tagged) i LEFT JOIN best USING (url_id)),
grid AS (SELECT led.url_id, m.model, coalesce(tagged.tag, '') AS tag, plurality FROM led CROSS JOIN (SELECT DISTINCT model FROM tagged) m LEFT JOIN tagged ON tagged.url_id = led.url_id AND tagged.model = m.model),
judged AS (SELECT model, count(*) AS total, count(*) FILTER (tag = '') AS empty_count, count(*) FILTER (contains(tag, '_')) AS underscore_count,
  count(*) FILTER (tag <> '' AND len(regexp_split_to_array(tag, '\\s+')) > 4) AS long_count,
  count(*) FILTER (tag <> '' AND lower(tag) = plurality) AS matches, count(*) FILTER (tag <> '') AS given, count(*) FILTER (tag <> '' AND tag = lower(tag)) AS low_count FROM grid GROUP BY model),
limits AS (SELECT *, greatest(1, CAST(floor(total * CAST(0.02 AS DOUBLE)) AS BIGINT)) AS bound, matches / total AS agree, CASE WHEN given > 0 THEN low_count / given ELSE CAST(0 AS DOUBLE) END AS steady FROM judged),
marked AS (SELECT *, concat_ws('; ', CASE WHEN empty_count > 0 THEN 'пустых: ' || empty_count END, CASE WHEN underscore_count > bound THEN 'подчёркивания: ' || underscore_count END,
  CASE WHEN long_count > bound THEN 'длинных (>4 слов): ' || long_count END) AS knockout_reasons FROM limits)"""


def one(expr: str) -> str:
    return f"CAST(printf('%.1f', CAST(({expr}) * 100 AS DOUBLE)) AS DOUBLE)"


SCORES = f"""SELECT model, {one('agree')} AS agreement, {one('steady')} AS case_consistency,
  {one("CASE WHEN knockout_reasons <> '' THEN CAST(0 AS DOUBLE) ELSE agree * CAST(0.7 AS DOUBLE) + steady * CAST(0.3 AS DOUBLE) END")} AS score,
  knockout_reasons <> '' AS knocked_out, knockout_reasons, empty_count, underscore_count, long_count FROM marked"""


def reasons(df):
    return df.withColumn("knockout_reasons", F.array_join("knockout_reasons", "; "))


def placed(t):
    """The results stored by link."""
    return results.write_placed(t.latest, f"placed_{uuid.uuid4().hex}", scratch(t, "placed"), 8)


add("j1_latest_results", lambda t: t.latest, "model_results", "SELECT * FROM model_results")
add(
    "j1_upsert",
    lambda t: compare.upsert_results(
        t.latest, t.latest.filter(RETAGGED).select("url_id", "model", F.upper("category").alias("category"), now().alias("tagged_at"))
    ),
    "model_results",
    f"""SELECT url_id, model, CASE WHEN {RETAGGED} THEN upper(category) ELSE category END AS category,
  CASE WHEN {RETAGGED} THEN TIMESTAMP '{NOW}' ELSE tagged_at END AS tagged_at FROM model_results""",
)
add(
    "j2_wide_by_id",
    lambda t: compare.wide_by_id(t.latest, MODELS),
    "model_results",
    f"SELECT url_id, {cells()} FROM model_results r GROUP BY url_id",
)
add(
    "j2_wide",
    lambda t: compare.wide(t.latest, t.urls, MODELS),
    "model_results urls",
    f"SELECT u.id, u.url, coalesce(u.title, '') AS title, {cells()} FROM model_results r JOIN urls u ON u.id = r.url_id GROUP BY ALL",
)
add(
    "j3_joined",
    lambda t: compare.joined(t.latest, t.urls),
    "model_results urls",
    "SELECT u.id, u.url, u.title, r.model, r.category, r.tagged_at FROM model_results r JOIN urls u ON u.id = r.url_id",
)
add("j4_models", lambda t: compare.models(t.latest), "model_results_raw", "SELECT DISTINCT model FROM model_results_raw")
add(
    "j5_disagreements",
    lambda t: compare.disagreements(t.latest),
    "model_results",
    "SELECT url_id, count(DISTINCT nullif(lower(category), '')) AS answers FROM model_results GROUP BY url_id HAVING answers > 1",
)
add(
    "j5_disagreement_count",
    lambda t: compare.disagreement_count(t.latest),
    "model_results",
    "SELECT count(*) AS disagreements FROM (SELECT url_id FROM model_results GROUP BY url_id HAVING count(DISTINCT nullif(lower(category), '')) > 1) t",
)
add("j6_plurality", lambda t: compare.plurality(t.latest), "model_results", f"WITH {_votes('model_results')} SELECT * FROM led")
add("j6_plurality_panel", lambda t: compare.plurality(t.panel), "panel", f"WITH {_votes('panel')} SELECT * FROM led")
add("j7_model_scores", lambda t: reasons(compare.model_scores(t.latest)), "model_results", f"WITH {_votes('model_results')} {SCORES}")
add("j7_model_scores_panel", lambda t: reasons(compare.model_scores(t.panel)), "panel", f"WITH {_votes('panel')} {SCORES}")
add("j6_plurality_placed", lambda t: compare.plurality(placed(t), placed=True), "model_results", f"WITH {_votes('model_results')} SELECT * FROM led")
add("j7_model_scores_placed", lambda t: reasons(compare.model_scores(placed(t), placed=True)), "model_results", f"WITH {_votes('model_results')} {SCORES}")
add(
    "j8_knockouts",
    lambda t: reasons(compare.knockouts(t.panel)),
    "panel",
    f"WITH {_votes('panel')} SELECT model, knockout_reasons FROM marked WHERE knockout_reasons <> ''",
)
add(
    "j9_accept_model",
    lambda t: compare.accept_model(t.urls, t.latest, "model_2:latest").select("id", "category", "tagged_by", "changed"),
    "urls model_results",
    """SELECT u.id, CASE WHEN r.url_id IS NULL THEN u.category ELSE r.category END AS category, CASE WHEN r.url_id IS NULL THEN u.tagged_by ELSE r.model END AS tagged_by,
  r.url_id IS NOT NULL AS changed FROM urls u LEFT JOIN model_results r ON r.url_id = u.id AND r.model = 'model_2:latest'""",
)
add(
    "j10_cleared",
    lambda t: compare.cleared(t.latest)[1],
    "model_results",
    "SELECT count(*) AS deleted FROM model_results",
)
DONE = "done AS (SELECT id AS url_id, coalesce(nullif(title, ''), '(no title)') AS title FROM urls WHERE status = 'done')"
add(
    "j11_run_models",
    lambda t: compare.run_models(
        t.urls, {"stub:a": stub_model, "stub:b": lambda p: f"cat{len(p) % 3}"}, ["stub:a", "stub:gone"], t.categories, now()
    ),
    "urls",
    f"WITH {DONE} SELECT url_id, 'stub:a' AS model, {STUB} AS category, TIMESTAMP '{NOW}' AS tagged_at FROM done WHERE {STUB} IS NOT NULL",
)


def stored_run(t):
    """Two runs over the done links, the second one over a model that has answered before."""
    path = scratch(t, "answers")
    asks = {"stub:a": stub_model, "stub:b": lambda p: f"cat{len(p) % 3}"}
    for wanted, at in ((["stub:b", "stub:a"], F.lit("2026-04-01").cast("timestamp")), (["stub:a"], now())):
        results.save_answers(compare.run_models(t.urls, asks, wanted, t.categories, at), path)
    return results.read_answers(t.spark, path).filter("model = 'stub:a'")


add(
    "j11_stored_run",
    stored_run,
    "urls",
    f"WITH {DONE} SELECT url_id, 'stub:a' AS model, {STUB} AS category, TIMESTAMP '{NOW}' AS tagged_at FROM done WHERE {STUB} IS NOT NULL",
)
add(
    "j12_side_by_side",
    lambda t: compare.side_by_side(t.latest, t.urls, MODELS),
    "model_results urls",
    "SELECT u.id, substring(CASE WHEN coalesce(u.title, '') <> '' THEN u.title ELSE u.url END, 1, 45) AS title, "
    + ", ".join(f"coalesce(nullif(max(CASE WHEN model = '{m}' THEN r.category END), ''), '—') AS {s}" for m, s in zip(MODELS, compare.short_names(MODELS)))
    + " FROM model_results r JOIN urls u ON u.id = r.url_id GROUP BY u.id, u.title, u.url",
)
add(
    "j13_rows_per_model",
    lambda t: compare.rows_per_model(t.latest),
    "model_results",
    "SELECT model, count(*) AS count FROM model_results GROUP BY model",
)
add(
    "j14_most_different",
    lambda t: compare.most_different(t.latest, t.urls),
    "model_results urls",
    "SELECT u.id, u.url, u.title, count(DISTINCT r.category) AS unique_results FROM urls u JOIN model_results r ON r.url_id = u.id GROUP BY ALL HAVING unique_results > 1",
)
add(
    "j15_tag_frequency",
    lambda t: compare.tag_frequency(t.latest.withColumn("category", F.concat_ws(", ", "category", F.lower("category")))),
    "model_results",
    """WITH s AS (SELECT model, unnest(string_split(category || ', ' || lower(category), ', ')) AS tag FROM model_results) SELECT model, tag, count(*) AS freq FROM s GROUP BY ALL""",
)
add(
    "j16_pivot_by_pattern",
    lambda t: compare.pivot_by_pattern(t.latest, t.urls, {"one": "el_1", "two": "_2:", "rest": "latest"}),
    "model_results urls",
    """SELECT u.id, u.url, u.title, max(CASE WHEN model LIKE '%el\\_1%' ESCAPE '\\' THEN r.category END) AS one, max(CASE WHEN model LIKE '%\\_2:%' ESCAPE '\\' THEN r.category END) AS two,
  max(CASE WHEN model LIKE '%latest%' THEN r.category END) AS rest FROM urls u JOIN model_results r ON r.url_id = u.id GROUP BY ALL""",
)
for _name, _table in (("j17_consensus_depth", "model_results"), ("j17_consensus_depth_panel", "panel")):
    add(
        _name,
        lambda t, n=_table: compare.consensus_depth(t.latest if n == "model_results" else t.panel),
        _table,
        f"WITH {_votes(_table)} SELECT depth, count(*) AS urls, {pct('count(*)', '(SELECT count(*) FROM led)')} AS share FROM led GROUP BY depth",
    )
add(
    "j18_format_checks",
    lambda t: compare.format_checks(t.latest),
    "model_results",
    """WITH s AS (SELECT model, trim(coalesce(category, '')) AS tag FROM model_results) SELECT model, count(*) AS answers, count(*) FILTER (contains(tag, '_')) AS underscores,
  count(*) FILTER (regexp_matches(tag, '[A-Za-z]')) AS latin, count(*) FILTER (tag <> lower(tag)) AS mixed_case FROM s WHERE tag <> '' GROUP BY model""",
)
add(
    "j19_scores_with_speed",
    lambda t: compare.scores_with_speed(t.panel, t.speeds),
    "panel speeds",
    f"""WITH {_votes('panel')}, timed AS (SELECT m.*, CAST(1 AS DOUBLE) / s.sec_per_url AS rate FROM marked m JOIN speeds s USING (model) WHERE knockout_reasons = ''),
spread AS (SELECT *, min(rate) OVER () AS lo, max(rate) OVER () AS hi FROM timed),
swift AS (SELECT *, CASE WHEN hi > lo THEN (rate - lo) / (hi - lo) ELSE CAST(1 AS DOUBLE) END AS speed FROM spread),
final AS (SELECT *, agree * CAST(0.6 AS DOUBLE) + steady * CAST(0.25 AS DOUBLE) + speed * CAST(0.15 AS DOUBLE) AS score FROM swift),
near AS (SELECT *, max(score) OVER () - score < CAST(0.05 AS DOUBLE) AS near_best FROM final)
SELECT CAST(row_number() OVER (ORDER BY near_best DESC, CASE WHEN near_best THEN rate END DESC, score DESC, model) AS INTEGER) AS rank, model, {one('agree')} AS agreement,
  {one('steady')} AS case_consistency, {one('speed')} AS speed, {one('score')} AS score, near_best FROM near""",
)
add(
    "j20_run_winner",
    lambda t: compare.run_winner(t.runs),
    "runs",
    """WITH r AS (SELECT *, CASE WHEN elapsed_sec > 0 THEN done / elapsed_sec ELSE CAST(0 AS DOUBLE) END AS rps FROM runs),
b AS (SELECT *, first_value(rps) OVER (ORDER BY run_no) AS base, max(rps) OVER () AS top FROM r)
SELECT run_no, batch, workers, done, elapsed_sec, rps, rps / CASE WHEN base = 0 THEN 1 ELSE base END AS speedup, abs(rps - top) < 0.01 AS is_best FROM b""",
)
