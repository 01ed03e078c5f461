"""Comparing the answers of several models, kept in long form (url_id, model, category, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from linkloom.functions.text import is_filled, percent, round_half_even, strip, word_count
from linkloom.operators.classify import Ask, annotate
from linkloom.operators.status import rewrite
from linkloom.operators.worklists import done, not_manual
from linkloom.scale import first_n

TITLE_CUT = 45


def latest_results(raw: DataFrame, order_by: list[str], keep: list[str] | None = None) -> DataFrame:
    """One row per (url_id, model): the last write in ``order_by`` wins.

    A grouped maximum instead of a ranking window: repeats of a key collapse in the map tasks,
    so a pair that was written very often never gathers in one task.
    """
    values = keep or [c for c in raw.columns if c not in ("url_id", "model")]
    last = F.max_by(F.struct(*values), F.struct(*order_by))
    return raw.groupBy("url_id", "model").agg(last.alias("_v")).select("url_id", "model", *[f"_v.{c}" for c in values])


def upsert_results(current: DataFrame, incoming: DataFrame, order_by: str = "tagged_at") -> DataFrame:
    """Merge a newer batch into the results; within the batch the last write wins."""
    old = current.withColumn("_new", F.lit(0))
    both = old.unionByName(incoming.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    values = [c for c in both.columns if c not in ("url_id", "model", "_new")]
    return latest_results(both, ["_new", order_by], values)


def models(results: DataFrame) -> DataFrame:
    return results.select("model").distinct().orderBy("model")


def joined(results: DataFrame, urls: DataFrame, ordered: bool = True) -> DataFrame:
    """Result rows with link and title; results without a link drop out."""
    rows = results.withColumnRenamed("category", "_category").join(
        urls.select(F.col("id").alias("url_id"), "url", "title"), "url_id"
    )
    extra = [c for c in results.columns if c not in ("url_id", "model", "category")]
    out = rows.select(F.col("url_id").alias("id"), "url", "title", "model", F.col("_category").alias("category"), *extra)
    return out.orderBy("id", "model") if ordered else out


def _cells(names: list[str], blank: bool) -> list[Column]:
    """One column per model; ``blank`` turns NULL and missing answers into empty text."""
    cells = [(m, F.max(F.when(F.col("model") == m, F.col("category")))) for m in names]
    return [(F.coalesce(c, F.lit("")) if blank else c).alias(m) for m, c in cells]


def wide_by_id(results: DataFrame, names: list[str], blank: bool = True) -> DataFrame:
    """One row per url_id, one column per model. Name the models: no extra pass to find them."""
    return results.groupBy("url_id").agg(*_cells(names, blank))


def wide(results: DataFrame, urls: DataFrame, names: list[str], blank: bool = True) -> DataFrame:
    """Side-by-side table with link and title; pivots first, joins the links once per row."""
    titled = urls.select(F.col("id").alias("url_id"), "url", F.coalesce("title", F.lit("")).alias("title"))
    return (
        wide_by_id(results, names, blank)
        .join(titled, "url_id")
        .select(F.col("url_id").alias("id"), "url", "title", *[F.col(f"`{m}`") for m in names])
    )


def short_names(models: list[str]) -> list[str]:
    """Model names without the part after the colon, where that leaves them different."""
    short = [m.split(":")[0] for m in models]
    return [s if short.count(s) == 1 else m for s, m in zip(short, models)]


def side_by_side(results: DataFrame, urls: DataFrame, names: list[str], limit: int | None = None) -> DataFrame:
    """The comparison view: a cut title (or link) and one column per short model name."""
    if limit:
        # The first links that have results, found by their ids alone; only their results are pivoted.
        linked = urls.select("id").join(results.select(F.col("url_id").alias("id")), "id", "left_semi")
        first = first_n(linked, limit).select(F.col("id").alias("url_id"))
        results = results.join(first, "url_id", "left_semi")
    rows = wide(results, urls, names).orderBy("id")
    shown = F.when(F.col("title") != "", F.col("title")).otherwise(F.col("url"))
    cells = [
        F.when(F.col(f"`{m}`") == "", "—").otherwise(F.col(f"`{m}`")).alias(s) for m, s in zip(names, short_names(names))
    ]
    return rows.select("id", F.substring(shown, 1, TITLE_CUT).alias("title"), *cells)


def disagreements(results: DataFrame) -> DataFrame:
    """Links with more than one different answer, ignoring case and empty answers."""
    answer = F.when(is_filled("category"), F.lower("category"))
    counted = results.groupBy("url_id").agg(F.size(F.collect_set(answer)).alias("answers"))
    return counted.filter(F.col("answers") > 1)


def disagreement_count(results: DataFrame) -> DataFrame:
    return disagreements(results).agg(F.count(F.lit(1)).alias("disagreements"))


def _order() -> Column:
    """What makes an answer the plurality of its link, smallest first."""
    return F.struct((F.col("low") == "").alias("blank"), (-F.col("n")).alias("less"), "first", "low")


def _by_link(rows: DataFrame, placed: bool) -> DataFrame:
    """Rows of one link together; ``placed`` says that storage has done so (bucketed by url_id)."""
    return rows if placed else rows.repartition("url_id")


def votes(results: DataFrame, placed: bool = False) -> DataFrame:
    """Result rows with ``tag``, its lower-case form, and the ``plurality`` of the link.

    Ties go to the answer seen first in model-name order; a link without answers has ''.
    ``leads`` marks one row per link. One shuffle by link and one sort serve all windows; a link
    holds at most one row per model.
    """
    tagged = results.select("url_id", "model", strip(F.coalesce("category", F.lit(""))).alias("tag"))
    together = _by_link(tagged, placed).withColumn("low", F.lower("tag"))
    same, link = W.partitionBy("url_id", "low"), W.partitionBy("url_id")
    counted = together.withColumns({"n": F.count(F.lit(1)).over(same), "first": F.min("model").over(same)})
    judged = counted.withColumns({"best": F.min(_order()).over(link), "lead": F.min("model").over(link)})
    return judged.select(
        "url_id", "model", "tag", "low", F.col("best.low").alias("plurality"), (F.col("model") == F.col("lead")).alias("leads")
    )


def plurality(results: DataFrame, placed: bool = False) -> DataFrame:
    """The most frequent answer per link and the number of models that gave it.

    Ties and blanks as in :func:`votes`, by two grouped aggregates after one shuffle by link.
    """
    low = F.lower(strip(F.coalesce("category", F.lit(""))))
    together = _by_link(results.select("url_id", "model", low.alias("low")), placed)
    polls = together.groupBy("url_id", "low").agg(F.count(F.lit(1)).alias("n"), F.min("model").alias("first"))
    best = polls.groupBy("url_id").agg(F.min(_order()).alias("b"))
    return best.select(
        "url_id", F.col("b.low").alias("plurality"), F.when(F.col("b.blank"), 0).otherwise(-F.col("b.less")).alias("depth")
    )


def _model_counts(results: DataFrame, placed: bool) -> DataFrame:
    """Per model: total links, blank, underscore, long, matching and lower-case answers.

    A link that a model skipped is a blank answer. The number of all links comes from the same
    pass: each link is led by one row, whatever its model. The window sums one row per model.
    """
    tag, low = F.col("tag"), F.col("low")
    per_model = votes(results, placed).groupBy("model").agg(
        F.count_if("leads").alias("_led"),
        F.count_if(tag != "").alias("_given"),
        F.count_if(tag.contains("_")).alias("underscore_count"),
        F.count_if((tag != "") & (word_count(tag) > 4)).alias("long_count"),
        F.count_if((low == F.col("plurality")) & (low != "")).alias("_matches"),
        F.count_if((tag != "") & (tag == low)).alias("_lower"),
    )
    counted = per_model.withColumn("_total", F.sum("_led").over(W.partitionBy(F.lit(0))))
    return counted.withColumn("empty_count", F.col("_total") - F.col("_given"))


def _limit() -> Column:
    return F.greatest(F.lit(1), F.floor(F.col("_total") * F.lit(0.02)))


def _shares() -> dict[str, Column]:
    given = F.col("_given")
    return {
        "_agree": F.col("_matches") / F.col("_total"),
        "_case": F.when(given > 0, F.try_divide(F.col("_lower"), given)).otherwise(F.lit(0.0)),
    }


def _reasons() -> Column:
    """Why a model is out. The wording is a fixed value."""
    empty, under, long = F.col("empty_count"), F.col("underscore_count"), F.col("long_count")
    return F.array_compact(
        F.array(
            F.when(empty > 0, F.concat(F.lit("пустых: "), empty.cast("string"))),
            F.when(under > _limit(), F.concat(F.lit("подчёркивания: "), under.cast("string"))),
            F.when(long > _limit(), F.concat(F.lit("длинных (>4 слов): "), long.cast("string"))),
        )
    )


def model_scores(results: DataFrame, placed: bool = False) -> DataFrame:
    """Agreement, case consistency, knock-outs and the weighted score per model, best first."""
    judged = _model_counts(results, placed).withColumns({**_shares(), "knockout_reasons": _reasons()})
    judged = judged.withColumn("knocked_out", F.size("knockout_reasons") > 0)
    score = F.when(F.col("knocked_out"), F.lit(0.0)).otherwise(
        F.col("_agree") * F.lit(0.7) + F.col("_case") * F.lit(0.3)
    )
    return judged.select(
        "model",
        round_half_even(F.col("_agree") * 100, 1).alias("agreement"),
        round_half_even(F.col("_case") * 100, 1).alias("case_consistency"),
        round_half_even(score * 100, 1).alias("score"),
        "knocked_out",
        "knockout_reasons",
        "empty_count",
        "underscore_count",
        "long_count",
    ).orderBy(F.desc("score"), "model")


def knockouts(results: DataFrame, placed: bool = False) -> DataFrame:
    """Models that are out, with the reasons."""
    return (
        _model_counts(results, placed)
        .withColumn("knockout_reasons", _reasons())
        .filter(F.size("knockout_reasons") > 0)
        .select("model", "knockout_reasons")
    )


def scores_with_speed(results: DataFrame, speeds: DataFrame, placed: bool = False) -> DataFrame:
    """Ranking that also weighs speed; ``speeds`` is (model, sec_per_url).

    Knocked-out models are left out. Speed is the inverse of seconds per link, scaled to 0..1
    between the slowest and the fastest candidate. Among models less than 0.05 below the best
    score the faster one ranks first. The windows hold one row per model.
    """
    judged = _model_counts(results, placed).withColumns(_shares()).filter(F.size(_reasons()) == 0)
    timed = judged.join(speeds.select("model", (F.lit(1.0) / F.col("sec_per_url")).alias("_rate")), "model")
    every = W.partitionBy(F.lit(0))
    low, high = F.min("_rate").over(every), F.max("_rate").over(every)
    speed = F.when(high > low, F.try_divide(F.col("_rate") - low, high - low)).otherwise(F.lit(1.0))
    scored = timed.withColumn("_speed", speed).withColumn(
        "_score", F.col("_agree") * F.lit(0.6) + F.col("_case") * F.lit(0.25) + F.col("_speed") * F.lit(0.15)
    )
    near = (F.max("_score").over(every) - F.col("_score")) < F.lit(0.05)
    ranked = scored.withColumn("near_best", near)
    order = [F.desc("near_best"), F.desc(F.when(F.col("near_best"), F.col("_rate"))), F.desc("_score"), F.asc("model")]
    return ranked.withColumn("rank", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(*order))).select(
        "rank",
        "model",
        round_half_even(F.col("_agree") * 100, 1).alias("agreement"),
        round_half_even(F.col("_case") * 100, 1).alias("case_consistency"),
        round_half_even(F.col("_speed") * 100, 1).alias("speed"),
        round_half_even(F.col("_score") * 100, 1).alias("score"),
        "near_best",
    )


def consensus_depth(results: DataFrame, placed: bool = False) -> DataFrame:
    """Number and share of links by the size of their largest agreeing group."""
    counted = plurality(results, placed).groupBy("depth").agg(F.count(F.lit(1)).alias("urls"))
    whole = F.sum("urls").over(W.partitionBy(F.lit(0)))
    return counted.withColumn("share", percent(F.col("urls"), whole)).orderBy(F.desc("depth"))


def accept_model(urls: DataFrame, results: DataFrame, model: str, protect_manual: bool = False) -> DataFrame:
    """Copy one model's categories, empty ones too, onto its links. ``results`` is merged."""
    news = results.filter(F.col("model") == model).select(
        F.col("url_id").alias("id"), F.col("category").alias("_category"), F.lit(True).alias("_hit")
    )
    where = F.col("_hit").isNotNull()
    if protect_manual:
        where = where & not_manual()
    merged = rewrite(urls.join(news, "id", "left"), where, {"category": F.col("_category"), "tagged_by": model})
    return merged.select(*urls.columns, "changed")


def cleared(results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The empty result table and a one-row count of what was cleared."""
    return results.limit(0), results.agg(F.count(F.lit(1)).alias("deleted"))


def run_models(
    urls: DataFrame,
    asks: dict[str, Ask],
    wanted: list[str],
    categories: DataFrame,
    now: Column,
    domain: str | None = None,
    limit: int | None = None,
    with_description: bool = True,
    workers: int | None = None,
) -> DataFrame:
    """Run the wanted models that exist over the done links; long rows of the valid answers.

    A model that is gone is given up after a bounded number of calls and leaves what it has answered until then.
    """
    work = done(urls, domain, limit, with_description, ordered=False)
    out = None
    for model in wanted:
        if model not in asks:
            continue
        rows = annotate(work, asks[model], categories, workers=workers).filter(F.col("error_kind") == "ok")
        rows = rows.select(F.col("id").alias("url_id"), F.lit(model).alias("model"), "category", now.alias("tagged_at"))
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise ValueError("none of the wanted models exists")
    return out


def rows_per_model(results: DataFrame) -> DataFrame:
    return results.groupBy("model").agg(F.count(F.lit(1)).alias("count"))


def most_different(results: DataFrame, urls: DataFrame) -> DataFrame:
    """Links with several different answers, most different first."""
    counted = results.groupBy("url_id").agg(F.size(F.collect_set("category")).alias("unique_results"))
    return (
        counted.filter(F.col("unique_results") > 1)
        .join(urls.select(F.col("id").alias("url_id"), "url", "title"), "url_id")
        .select(F.col("url_id").alias("id"), "url", "title", "unique_results")
        .orderBy(F.desc("unique_results"), "id")
    )


def tag_frequency(results: DataFrame) -> DataFrame:
    """Uses of each tag per model after splitting lists at comma and space."""
    tags = results.select("model", F.explode(F.split("category", ", ", -1)).alias("tag"))
    return tags.groupBy("model", "tag").agg(F.count(F.lit(1)).alias("freq")).orderBy("model", F.desc("freq"), "tag")


def pivot_by_pattern(results: DataFrame, urls: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """One row per link with the largest answer of the models whose name contains each pattern."""
    cells = [F.max(F.when(F.col("model").contains(p), F.col("category"))).alias(n) for n, p in patterns.items()]
    titled = urls.select(F.col("id").alias("url_id"), "url", "title")
    return results.groupBy("url_id").agg(*cells).join(titled, "url_id").withColumnRenamed("url_id", "id")


def format_checks(results: DataFrame) -> DataFrame:
    """Per model: answers with underscores, with Latin letters, and not in lower case."""
    tag = strip(F.coalesce("category", F.lit("")))
    rows = results.select("model", tag.alias("tag")).filter("tag != ''")
    return rows.groupBy("model").agg(
        F.count(F.lit(1)).alias("answers"),
        F.count_if(F.col("tag").contains("_")).alias("underscores"),
        F.count_if(F.col("tag").rlike("[A-Za-z]")).alias("latin"),
        F.count_if(F.col("tag") != F.lower("tag")).alias("mixed_case"),
    )


def run_winner(runs: DataFrame) -> DataFrame:
    """Benchmark runs with rows per second, speed-up over the first run and the best flag.

    ``runs`` has run_no, batch, workers, done and elapsed_sec: one row per configuration.
    """
    rate = F.when(F.col("elapsed_sec") > 0, F.try_divide(F.col("done"), F.col("elapsed_sec"))).otherwise(F.lit(0.0))
    rated = runs.withColumn("rps", rate)
    first = F.first("rps").over(W.partitionBy(F.lit(0)).orderBy("run_no"))
    base = F.when(first == 0, F.lit(1.0)).otherwise(first)
    best = F.max("rps").over(W.partitionBy(F.lit(0)))
    return rated.withColumns(
        {"speedup": F.col("rps") / base, "is_best": F.abs(F.col("rps") - best) < F.lit(0.01)}
    ).orderBy(F.desc("rps"), "run_no")
