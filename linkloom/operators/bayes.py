"""A classifier of counts: multinomial naive Bayes over words.

Training is two grouped counts in one pass each, exact and the same on any number of machines; nothing of the model is on the
driver. A model is a table of words with their counts per label, and a table of labels, which both may be stored and read as they are.
Scores, and so predictions and confidences, can be restated in SQL.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BETWEEN_WORDS = r"[^\p{L}\p{N}]+"
ALPHA = 1.0  # what each word is counted beyond its occurrences
DIGITS = 6


class Bayes(NamedTuple):
    """``words`` (word, ``counts`` as (label, n) pairs) and ``labels`` (label, ``rows``, ``size`` in words)."""

    words: DataFrame
    labels: DataFrame


def _words(rows: DataFrame, *keys: str) -> DataFrame:
    listed = F.split(F.lower(F.coalesce("text", F.lit(""))), BETWEEN_WORDS)
    return rows.select(*keys, F.explode(listed).alias("word")).filter("word <> ''").groupBy(*keys, "word").agg(F.count(F.lit(1)).alias("n"))


def train(rows: DataFrame) -> Bayes:
    """Count the words of (text, label); rows without a label are left out."""
    labelled = rows.select("text", "label").filter("label IS NOT NULL")
    counts = _words(labelled, "label")
    # One entry per label of a word, so a list is as long as there are labels.
    words = counts.groupBy("word").agg(F.array_sort(F.collect_list(F.struct("label", "n"))).alias("counts"))
    sizes = counts.groupBy("label").agg(F.sum("n").alias("size"))
    seen = labelled.groupBy("label").agg(F.count(F.lit(1)).alias("rows"))
    return Bayes(words, seen.join(sizes, "label", "left").select("label", "rows", F.coalesce("size", F.lit(0)).alias("size")))


def save(model: Bayes, path: str) -> None:
    for name, table in model._asdict().items():
        table.write.mode("overwrite").parquet(f"{path.rstrip('/')}/{name}")


def load(spark: SparkSession, path: str) -> Bayes:
    return Bayes(*(spark.read.parquet(f"{path.rstrip('/')}/{name}") for name in Bayes._fields))


def scores(model: Bayes, rows: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """Per ``id`` of (id, text) and label the logarithm of prior times likelihood; words that training has not seen are left out.

    A word that a label has not seen adds the same whatever the word is, so only the pairs that were counted are joined. The repeats
    of a word in a text are counted first, and a word that is in every text meets one row.
    """
    met = _words(rows, "id").withColumnRenamed("n", "times").join(model.words, "word")
    known = met.groupBy("id").agg(F.sum("times").alias("known"))
    gain = F.col("times") * (F.ln(F.col("pair.n") + F.lit(alpha)) - F.ln(F.lit(alpha)))
    pairs = met.select("id", "times", F.explode("counts").alias("pair")).groupBy("id", F.col("pair.label").alias("label")).agg(F.sum(gain).alias("gain"))
    vocabulary, total = model.words.agg(F.count(F.lit(1))).scalar(), model.labels.agg(F.sum("rows")).scalar()
    labels = model.labels.select("label", F.ln(F.col("rows") / total).alias("prior"), (F.ln(F.lit(alpha)) - F.ln(F.col("size") + F.lit(alpha) * vocabulary)).alias("base"))
    listed = labels.agg(F.array_sort(F.collect_list(F.struct("label", "prior", "base")))).scalar()
    each = rows.select("id").join(known, "id", "left").select("id", F.coalesce("known", F.lit(0)).alias("known"), F.explode(listed).alias("l"))
    each = each.select("id", "known", "l.label", "l.prior", "l.base").join(pairs, ["id", "label"], "left")
    return each.select("id", "label", (F.col("prior") + F.col("known") * F.col("base") + F.coalesce("gain", F.lit(0.0))).alias("score"))


def predict(model: Bayes, rows: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """``rows`` (with a unique ``id``) with ``prediction`` and ``confidence``, its probability to ``DIGITS`` digits; ties go to the first label."""
    judged = scores(model, rows, alpha).groupBy("id").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("less"), "label"))).alias("order"))
    best = F.col("order")[0]
    share = F.aggregate("order", F.lit(0.0), lambda total, o: total + F.exp(best["less"] - o["less"]))
    named = judged.select("id", best["label"].alias("prediction"), F.round(F.lit(1.0) / share, DIGITS).alias("confidence"))
    return rows.drop("prediction", "confidence").join(named, "id", "left")
