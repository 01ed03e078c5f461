"""Assigning one taxonomy category per link: rules first, then a model."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from uuid import uuid4

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkloom.functions import prompts
from linkloom.functions.answers import fingerprint, named, numbered_lines
from linkloom.functions.domains import norm_domain, rule_domain
from linkloom.operators.status import rewrite
from linkloom.operators.worklists import has_status, is_unclassified_work, not_manual, unclassified
from linkloom.scale import number_by_id, one_per_key
from linkloom.schema import DONE
from linkloom.session import durable

RULE_TAG = "domain_rule"

# Fixed value: failed connections in a row after which a model counts as gone.
PATIENCE = 3

# One row in so many is asked before the rest.
PROBES = 64


class ModelError(Exception):
    """Raised by a model function when the model itself refuses or fails (not the connection)."""


def route_by_rules(work: DataFrame, rules: DataFrame, order_by: str | None = None) -> DataFrame:
    """Add ``route`` (rule, section or open), ``rule_section`` and ``rule_category``.

    Of several rules for a domain one counts: the last by ``order_by``, or the largest (section, category).
    """
    keyed = one_per_key(rules.select("domain", "section", "category", *([order_by] if order_by else [])), ["domain"], order_by).select(
        F.col("domain").alias("_rule_domain"),
        F.col("section").alias("rule_section"),
        F.col("category").alias("rule_category"),
    )
    routed = work.withColumn("_domain", rule_domain(F.col("url"))).join(
        keyed, F.col("_domain") == F.col("_rule_domain"), "left"
    )
    route = (
        F.when(F.col("rule_category").isNotNull(), "rule")
        .when(F.col("rule_section").isNotNull(), "section")
        .otherwise("open")
    )
    return routed.withColumn("route", route).drop("_domain", "_rule_domain")


def rule_violations(rules: DataFrame, categories: DataFrame) -> DataFrame:
    """Rules that name a category or section outside the taxonomy."""
    names = categories.select(F.col("name").alias("category")).distinct()
    sections = categories.select("section").distinct()
    bad_category = (
        rules.filter(F.col("category").isNotNull())
        .join(names, "category", "left_anti")
        .select("domain", F.lit("category").alias("kind"), F.col("category").alias("value"))
    )
    bad_section = (
        rules.filter(F.col("section").isNotNull())
        .join(sections, "section", "left_anti")
        .select("domain", F.lit("section").alias("kind"), F.col("section").alias("value"))
    )
    return bad_category.unionByName(bad_section)


def _joined_names(by: str = "struct(sort_order, id, name)") -> Column:
    ordered = F.array_sort(F.collect_list(F.expr(by)))
    return F.array_join(F.transform(ordered, lambda c: c["name"]), ", ")


def allowed_lists(categories: DataFrame) -> DataFrame:
    """Allowed-category text per section, and for the whole taxonomy under a NULL section."""
    per_section = categories.groupBy("section").agg(_joined_names().alias("allowed"))
    whole = categories.agg(_joined_names().alias("allowed")).select(F.lit(None).cast("string").alias("section"), "allowed")
    return per_section.unionByName(whole)


def with_prompt(work: DataFrame, categories: DataFrame, section: str | None = None) -> DataFrame:
    """Add the single-row prompt; ``section`` names a column that narrows the choice."""
    whole = categories.agg(_joined_names().alias("allowed")).scalar()
    allowed, rows = whole, work
    if section:
        per_section = categories.groupBy(F.col("section").alias("_section")).agg(_joined_names().alias("_allowed"))
        rows = work.join(per_section, F.col(section) == F.col("_section"), "left")
        allowed = F.coalesce("_allowed", whole)
    prompt = prompts.single_prompt(F.col("title"), F.col("description"), allowed)
    return rows.withColumn("prompt", prompt).select(*work.columns, "prompt")


def batch_prompts(work: DataFrame, categories: DataFrame, size: int) -> DataFrame:
    """One prompt per ``size`` rows in id order: ``chunk``, ``n``, ``ids`` and ``prompt``.

    A chunk never holds more than ``size`` rows, so the collected list is bounded.
    """
    numbered = number_by_id(work)
    placed = numbered.withColumns(
        {
            "chunk": F.floor((F.col("row_no") - 1) / F.lit(size)),
            "item": ((F.col("row_no") - 1) % F.lit(size) + 1).cast("int"),
        }
    )
    line = prompts.batch_item(F.col("item"), F.col("title"), F.col("description"))
    packed = placed.groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("item", "id", line.alias("line")))).alias("rows"))
    whole = categories.agg(_joined_names().alias("allowed")).scalar()
    return packed.select(
        "chunk",
        F.size("rows").alias("n"),
        F.transform("rows", lambda r: r["id"]).alias("ids"),
        prompts.batch_prompt(F.transform("rows", lambda r: r["line"]), whole).alias("prompt"),
    )


def normalized(answers: DataFrame, categories: DataFrame, raw: str = "raw") -> DataFrame:
    """Add the canonical ``category`` of a free answer.

    Names are looked for once per different answer and joined back by its fingerprint, so no row is copied per candidate.
    """
    rows = answers.drop("category").withColumn("_answer", fingerprint(F.col(raw)))
    texts = rows.select("_answer", F.coalesce(raw, F.lit("")).alias("_text"))
    return rows.join(named(texts, categories, "_text", ["_answer"]), "_answer", "left").drop("_answer")


def parsed_batches(batches: DataFrame, categories: DataFrame, raw: str = "raw", size: str = "n") -> DataFrame:
    """One row per batch item: the batch columns, ``item`` (from 1) and ``category``.

    The last line that names a valid category wins for its number; numbers outside the batch are ignored. As in
    :func:`normalized`, only lines and their candidates are multiplied; the batches meet a map from item to name, one per different answer.
    """
    rows = batches.drop("item", "category").withColumn("_answer", fingerprint(F.col(raw)))
    lines = rows.select("_answer", F.posexplode(numbered_lines(F.coalesce(raw, F.lit("")))).alias("_line", "_part"))
    lines = lines.select("_answer", "_line", F.col("_part.item").alias("_item"), F.col("_part.text").alias("_text")).filter("_item IS NOT NULL")
    last = named(lines, categories, "_text", ["_answer", "_item"], [F.col("_line")])
    found = last.groupBy("_answer").agg(F.map_from_entries(F.collect_list(F.struct("_item", "category"))).alias("_found"))
    joined = rows.join(found, "_answer", "left").withColumn("item", F.explode(F.sequence(F.lit(1), F.col(size).cast("int"))))
    return joined.withColumn("category", F.try_element_at("_found", F.col("item"))).drop("_answer", "_found")


@dataclass(frozen=True)
class Model:
    """A model that is set up once per worker process and asked in lists.

    ``open`` returns the call: a function from prompts to as many answers, each a text or a :class:`ModelError`. ``at_once`` is the longest list.
    """

    open: Callable[[], Callable[[list[str]], list[str | ModelError]]]
    at_once: int = 64
    name: str = field(default_factory=lambda: uuid4().hex)


Ask = Callable[[str], str] | Model

# Per worker process: opened models, and the failed calls in a row of each run. All tasks of a process share them.
_OPENED: dict[str, Callable[[list[str]], list[str | ModelError]]] = {}
_FAILED: dict[str, int] = {}


def _call(ask: Ask, prompts: list[str]) -> list[str | ModelError]:
    if not isinstance(ask, Model):
        return [ask(p) for p in prompts]
    if ask.name not in _OPENED:
        _OPENED[ask.name] = ask.open()
    return _OPENED[ask.name](prompts)


def _answers(ask: Ask, run: str, prompts: list[str], patience: int) -> list[tuple[str | None, str | None]]:
    """Answer and failure of each prompt; after ``patience`` calls in a row without a connection the rest is skipped."""
    size, out = ask.at_once if isinstance(ask, Model) else 1, []
    for at in range(0, len(prompts), size):
        some = prompts[at : at + size]
        if _FAILED.get(run, 0) >= patience:
            out += [(None, "skipped")] * len(some)
            continue
        try:
            got = _call(ask, some)
            out += [(None, "api_err") if isinstance(g, ModelError) else (g, None) for _, g in zip(some, got, strict=True)]
            _FAILED[run] = 0
        except ModelError:
            out += [(None, "api_err")] * len(some)
            _FAILED[run] = 0
        except Exception:
            out += [(None, "conn_err")] * len(some)
            _FAILED[run] = _FAILED.get(run, 0) + 1
    return out


def ask_model(df: DataFrame, ask: Ask, workers: int | None = None, patience: int = PATIENCE) -> DataFrame:
    """Replace the ``prompt`` column by ``raw``, the answer, and ``failure`` (api_err, conn_err, skipped or NULL).

    One failing call does not stop the others, but a model that is gone is not asked for every row: a worker process ends its calls after
    ``patience`` failed connections in a row, and one row in ``PROBES`` (by a hash of the prompt) is asked before all others. If
    that finds the model gone, the others are skipped at once. So the calls to a dead model are bounded by the number
    of worker processes, whatever the number of rows. ``workers`` sets how many calls may run at once.

    The answers are written to the shared checkpoint folder, so later steps and lost executors do not make the model run again.
    """
    kept = [f for f in df.schema.fields if f.name != "prompt"]
    schema = T.StructType([*kept, T.StructField("raw", T.StringType()), T.StructField("failure", T.StringType())])
    run = uuid4().hex

    def answer(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            got = _answers(ask, run, list(frame["prompt"]), patience)
            yield frame.drop(columns="prompt").assign(raw=[g[0] for g in got], failure=[g[1] for g in got])

    def asked(rows: DataFrame) -> DataFrame:
        spread = rows.repartition(workers, rows.columns[0]) if workers else rows
        return durable(spread.mapInPandas(answer, schema))

    probed = F.pmod(F.xxhash64("prompt"), F.lit(PROBES)) == 0
    first = asked(df.filter(probed))
    counts = first.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("failure").isin("conn_err", "skipped")).alias("down")).first()
    rest = df.filter(~probed)
    if counts["down"] >= patience and counts["down"] == counts["n"]:
        untouched = rest.drop("prompt").withColumns({"raw": F.lit(None).cast("string"), "failure": F.lit("skipped")})
        return first.unionByName(untouched.select(*schema.names))
    return first.unionByName(asked(rest))


def annotate(
    work: DataFrame,
    ask: Ask,
    categories: DataFrame,
    batch_size: int = 1,
    section: str | None = None,
    workers: int | None = None,
) -> DataFrame:
    """Categorise ``work`` (id, url, title, description) with a model.

    Adds ``category`` and ``error_kind`` (ok, api_err, empty, conn_err or skipped). With a batch size,
    rows go to the model in numbered lists first; what a list leaves open is asked singly, as
    are the rows of a narrowed section.
    """
    if batch_size <= 1:
        return _annotate_single(work, ask, categories, section, workers)
    listed = work.filter(F.col(section).isNull()) if section else work
    batches = ask_model(batch_prompts(listed, categories, batch_size), ask, workers)
    found = parsed_batches(batches, categories).select(
        F.element_at("ids", F.col("item")).alias("id"), F.col("category").alias("_found"), F.col("failure").alias("_down")
    )
    joined = work.join(found, "id", "left")
    settled = joined.filter(F.col("_found").isNotNull() | F.col("_down").isNotNull())
    first = settled.select(
        *work.columns, F.col("_found").alias("category"), F.coalesce("_down", F.lit("ok")).alias("error_kind")
    )
    left_open = joined.filter(F.col("_found").isNull() & F.col("_down").isNull()).select(*work.columns)
    return first.unionByName(_annotate_single(left_open, ask, categories, section, workers))


def _annotate_single(
    work: DataFrame, ask: Ask, categories: DataFrame, section: str | None, workers: int | None
) -> DataFrame:
    answered = ask_model(with_prompt(work, categories, section), ask, workers)
    named = normalized(answered, categories)
    kind = F.coalesce("failure", F.when(F.col("category").isNull(), "empty").otherwise("ok"))
    return named.withColumn("error_kind", kind).select(*work.columns, "category", "error_kind")


def classify(
    urls: DataFrame,
    rules: DataFrame,
    categories: DataFrame,
    ask: Ask,
    limit: int | None = None,
    with_description: bool = True,
    batch_size: int = 1,
    workers: int | None = None,
) -> DataFrame:
    """The whole pass without the write (a dry run): rows with route, category and error_kind.

    Rule rows never reach the model.
    """
    routed = route_by_rules(unclassified(urls, limit, with_description, ordered=False), rules)
    by_rule = routed.filter(F.col("route") == "rule").select(
        "id", "url", "route", F.col("rule_category").alias("category"), F.lit("ok").alias("error_kind")
    )
    open_rows = routed.filter(F.col("route") != "rule")
    by_model = annotate(
        open_rows.select("id", "url", "title", "description", "route", "rule_section"),
        ask,
        categories,
        batch_size,
        "rule_section",
        workers,
    )
    return by_rule.unionByName(by_model.select("id", "url", "route", "category", "error_kind"))


def set_categories(urls: DataFrame, answers: DataFrame, order_by: str | None = None) -> DataFrame:
    """Write ``category`` and ``tagged_by`` by link, only on rows that wait for a category.

    Answers without a category are left out; of several for a link the last by ``order_by`` counts.
    """
    named = answers.filter(F.col("category").isNotNull()).select("url", "category", "tagged_by", *([order_by] if order_by else []))
    news = one_per_key(named, ["url"], order_by).select("url", F.col("category").alias("_category"), F.col("tagged_by").alias("_tagged_by"))
    merged = rewrite(
        urls.join(news, "url", "left"),
        is_unclassified_work() & F.col("_category").isNotNull(),
        {"category": F.col("_category"), "tagged_by": F.col("_tagged_by")},
    )
    return merged.select(*urls.columns, "changed")


def tag_answers(classified: DataFrame, model: str, rules_as_model: bool = False) -> DataFrame:
    """Attach ``tagged_by`` to the output of :func:`classify`.

    Rule rows are marked as such unless ``rules_as_model`` asks for the model's name on them too.
    """
    by = F.when((F.col("route") == "rule") & F.lit(not rules_as_model), RULE_TAG).otherwise(model)
    return classified.withColumn("tagged_by", by)


def reset_categories(urls: DataFrame, domain: str | None = None, protect_manual: bool = False) -> DataFrame:
    """Clear category and tagged_by of done rows, of one domain if given."""
    where = has_status(DONE)
    if domain:
        where = where & (norm_domain(F.col("url")) == domain.lower().removeprefix("www."))
    if protect_manual:
        where = where & not_manual()
    return rewrite(urls, where, {"category": None, "tagged_by": None})


def edit_categories(urls: DataFrame, edits: DataFrame, manual: bool = True, order_by: str | None = None) -> DataFrame:
    """Apply a table of hand edits (id, category); of several for an id the last by ``order_by`` counts."""
    last = one_per_key(edits.select("id", "category", *([order_by] if order_by else [])), ["id"], order_by)
    news = last.select("id", F.col("category").alias("_category"), F.lit(True).alias("_hit"))
    merged = rewrite(
        urls.join(news, "id", "left"),
        F.col("_hit"),
        {"category": F.col("_category"), "manual_override": 1 if manual else 0},
    )
    return merged.select(*urls.columns, "changed")


def summary(classified: DataFrame) -> DataFrame:
    """Counts per route and error kind."""
    return classified.groupBy("route", "error_kind").agg(F.count(F.lit(1)).alias("count"))


def totals(classified: DataFrame, elapsed_sec: float | None = None) -> DataFrame:
    """One row: done, errors, total and, given a duration, rows per second."""
    out = classified.agg(
        F.count_if(F.col("error_kind") == "ok").alias("done"),
        F.count_if(F.col("error_kind") != "ok").alias("errors"),
        F.count(F.lit(1)).alias("total"),
    )
    if elapsed_sec:
        out = out.withColumn("per_sec", F.round(F.col("total") / F.lit(float(elapsed_sec)), 1))
    return out
