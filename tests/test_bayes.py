"""Naive Bayes against a plain version, with words and labels of every kind."""

import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from linkloom.operators import bayes, train

SCHEMA = "id long, text string, label string"


def plain(training, texts, alpha=1.0):
    words = lambda t: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]
    counts, rows = {}, Counter()
    for _, text, label in training:
        if label is not None:
            rows[label] += 1
            counts.setdefault(label, Counter()).update(words(text))
    vocabulary = set().union(*counts.values())
    out = []
    for text in texts:
        known = [w for w in words(text) if w in vocabulary]
        scores = {
            label: math.log(n / sum(rows.values())) + sum(math.log((counts[label][w] + alpha) / (counts[label].total() + alpha * len(vocabulary))) for w in known)
            for label, n in rows.items()
        }
        top = max(scores.values())
        best = min(label for label, s in scores.items() if s > top - 1e-9)
        out.append((scores, best, 1 / sum(math.exp(s - top) for s in scores.values())))
    return out


def some_texts(n, seed=3):
    rng = random.Random(seed)
    words = {"a": ["sun", "Rain", "ÉTÉ", "the"], "b": ["bank", "coin", "the"], "c": ["the", "x1"]}
    rows = [(i, " ".join(rng.choices(words[k], k=rng.randrange(9))) + rng.choice(["", " the!", "; sun_bank", " жара"]), k) for i in range(n) for k in [rng.choice("aab")]]
    return rows + [(n, None, "c"), (n + 1, "", "c"), (n + 2, "lost", None), (n + 3, "the " * 400, "c")]


def test_scores_and_predictions(spark, tmp_path):
    training, texts = some_texts(200), some_texts(60, seed=4)
    texts.append((99, "never seen before", None))
    model = bayes.train(spark.createDataFrame(training, SCHEMA).repartition(5))
    bayes.save(model, str(tmp_path / "model"))
    loaded = bayes.load(spark, str(tmp_path / "model"))
    rows = spark.createDataFrame(texts, SCHEMA).select("id", "text", F.lit("old").alias("prediction"))
    want = plain(training, [t for _, t, _ in texts])
    for m in (model, loaded):
        got = {}
        for r in bayes.scores(m, rows).collect():
            got.setdefault(r["id"], {})[r["label"]] = r["score"]
        for (i, _, _), (scores, _, _) in zip(texts, want, strict=True):
            assert got[i].keys() == scores.keys() and all(abs(got[i][k] - s) < 1e-6 for k, s in scores.items())
        judged = {r["id"]: (r["prediction"], r["confidence"]) for r in bayes.predict(m, rows).collect()}
        for (i, _, _), (_, best, sure) in zip(texts, want, strict=True):
            assert judged[i][0] == best and abs(judged[i][1] - sure) < 1e-5


def test_it_learns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("id"), "text", F.col("lang").alias("label"))
    model = bayes.train(docs.filter("id % 2 = 0"))
    judged = bayes.predict(model, docs.filter("id % 2 = 1 AND label IS NOT NULL"))
    right = judged.agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0]
    largest = docs.groupBy("label").count().agg(F.max("count") / F.sum("count")).first()[0]
    assert right > max(0.8, largest)
    kept, passed = train.split_by_confidence(judged, 0.9)
    assert kept.count() + passed.count() == judged.count()


def test_nothing_to_learn_or_to_judge(spark):
    model = bayes.train(spark.createDataFrame([], SCHEMA))
    assert bayes.predict(model, spark.createDataFrame([(1, "x", None)], SCHEMA)).collect()[0]["prediction"] is None
    model = bayes.train(spark.createDataFrame([(1, "x", "a")], SCHEMA))
    assert bayes.predict(model, spark.createDataFrame([], SCHEMA)).collect() == []
