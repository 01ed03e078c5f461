"""Dataset, split, weights, classifier and metrics."""

import uuid

from pyspark.sql import functions as F

from linkloom.operators import bayes, dataset, metrics, train
from linkloom.plans.catalog import add
from linkloom.plans.entries.statistics import pct
from linkloom.plans.views import NORM_DOMAIN
from linkloom.schema import DRY_RUN_LOG
from linkloom.session import durable, shared_dir
from linkloom.sources import files

EXPORT = "export AS (SELECT id, url, title, description, category FROM urls WHERE status = 'done' AND coalesce(title, '') <> '' AND coalesce(category, '') <> '')"
LISTED = "listed AS (SELECT * FROM export WHERE lower(category) IN (SELECT lower(name) FROM categories))"
TEXT = f"concat_ws(' [SEP] ', trim(title), CASE WHEN trim(coalesce(description, '')) <> '' THEN substring(trim(description), 1, 200) END, {NORM_DOMAIN})"
CLASSES = ["A", "N", "R", "X"]


def listed(t):
    return dataset.in_taxonomy(dataset.exportable(t.urls), t.categories)


def scratch(t, name: str) -> str:
    return f"{shared_dir(t.spark)}/{name}-{uuid.uuid4().hex}"


def written_dataset(t):
    path = scratch(t, "dataset")
    files.write_dataset(dataset.dataset(t.urls, t.categories), path)
    return files.read_dataset(t.spark, path)


def documents(t):
    return t.documents.select(F.col("doc_id").alias("id"), "text", F.col("lang").alias("label"))


def both_predicted(t):
    """Train on the train part of the split, save, load, and predict the test part with the model as trained and as loaded."""
    parts = durable(dataset.stratified_split(documents(t)))
    path = scratch(t, "model")
    model = train.train(parts.filter("part = 'train'"))
    train.save(model, path)
    test = parts.filter("part = 'test'")
    return train.predict(model, test), train.predict(train.load(path), test)


def predicted(t):
    return both_predicted(t)[1].select("id", "label", "prediction", "confidence")


def prediction_facts(t):
    """What SQL can state of each prediction."""
    trained, loaded = both_predicted(t)
    first = trained.select("id", F.col("prediction").alias("_first"))
    return loaded.join(first, "id").select(
        "id",
        "label",
        F.col("prediction").isNotNull().alias("predicted"),
        F.col("confidence").between(0, 1).alias("confidence_valid"),
        (F.col("prediction") == F.col("_first")).alias("same_when_loaded"),
    )


def metric_facts(t):
    """Size of the test part, and whether the accuracy beats always naming the largest class."""
    rows = durable(predicted(t))
    sizes = rows.groupBy("label").count()
    largest = sizes.agg(F.max("count") / F.sum("count")).first()[0]
    return metrics.summary(rows).select("num_test", (F.col("accuracy") > F.lit(largest)).alias("beats_largest"))


def confidence_facts(t):
    """Every test row and how often it is kept or passed on."""
    rows = durable(predicted(t))
    kept, passed = train.split_by_confidence(rows)
    sides = kept.withColumn("kept", F.lit(1)).unionByName(passed.withColumn("kept", F.lit(0)))
    right = (F.col("confidence") >= train.CONFIDENCE) == (F.col("kept") == 1)
    return sides.groupBy("id").agg(F.count(F.lit(1)).alias("times"), F.every(right).alias("right_side"))


def review_facts(t):
    """The review list's size, and whether no other row is less confident than its most confident one."""
    rows = durable(predicted(t))
    listed = durable(train.least_confident(rows, 20))
    top = listed.agg(F.max("confidence")).first()[0]
    others = rows.join(listed.select("id"), "id", "left_anti").filter(F.col("confidence") < F.lit(top))
    return listed.agg(F.count(F.lit(1)).alias("listed")).crossJoin(others.agg(F.count(F.lit(1)).alias("less_confident")))


add("k1_exportable", lambda t: dataset.exportable(t.urls), "urls", f"WITH {EXPORT} SELECT * FROM export")
add("k2_in_taxonomy", listed, "urls categories", f"WITH {EXPORT}, {LISTED} SELECT * FROM listed")
add(
    "k2_k3_skipped",
    lambda t: dataset.skipped(t.urls, t.categories, 3),
    "urls categories",
    f"""WITH {EXPORT}, {LISTED}, big AS (SELECT category FROM listed GROUP BY category HAVING count(*) >= 3)
SELECT (SELECT count(*) FROM listed WHERE category IN (SELECT category FROM big)) AS exported, (SELECT count(*) FROM big) AS classes,
  (SELECT count(*) FROM export) - (SELECT count(*) FROM listed) AS skipped_taxonomy, (SELECT count(*) FROM listed WHERE category NOT IN (SELECT category FROM big)) AS skipped_rare""",
)
add(
    "k3_frequent_classes",
    lambda t: dataset.frequent_classes(listed(t), 3),
    "urls categories",
    f"WITH {EXPORT}, {LISTED} SELECT * FROM listed QUALIFY count(*) OVER (PARTITION BY category) >= 3",
)
add(
    "k4_dataset",
    lambda t: dataset.dataset(t.urls, t.categories),
    "urls categories",
    f"WITH {EXPORT}, {LISTED} SELECT id, {TEXT} AS text, category AS label FROM listed",
)
add(
    "k4_dataset_without_description",
    lambda t: dataset.dataset(t.urls, t.categories, with_description=False),
    "urls categories",
    f"WITH {EXPORT}, {LISTED} SELECT id, concat_ws(' [SEP] ', trim(title), {NORM_DOMAIN}) AS text, category AS label FROM listed",
)
add(
    "s4_s5_dataset_files",
    written_dataset,
    "urls categories",
    f"WITH {EXPORT}, {LISTED} SELECT {TEXT} AS text, category AS label FROM listed",
)


def run_log(t):
    """Dry runs, one per source of documents, written to the log and read back."""
    path = scratch(t, "runs")
    n = F.count(F.lit(1))
    runs = t.documents.groupBy("source").agg(n.alias("n"), (F.sum("n_chars") / 1000).alias("elapsed"))
    runs = runs.select(
        F.lit("2026-04-10").alias("date"),
        F.col("source").alias("model"),
        "elapsed",
        F.col("n").alias("processed"),
        F.when(F.col("n") % 2 == 0, F.col("n")).alias("limit"),
        (F.col("n") % 3 + 1).alias("batch"),
        (F.col("n") % 5 + 1).alias("workers"),
    )
    files.log_dry_runs(runs, path)
    return files.read_log(t.spark, path, DRY_RUN_LOG)


add(
    "s7_run_log",
    run_log,
    "",
    """WITH r AS (SELECT source, count(*) AS n, sum(n_chars) / CAST(1000 AS DOUBLE) AS elapsed FROM documents GROUP BY source)
SELECT '2026-04-10' AS date, source AS model, round(elapsed, 1) AS elapsed_sec, round(n / elapsed, 2) AS url_per_sec, n AS processed,
  concat_ws(' ', 'limit=' || CASE WHEN n % 2 = 0 THEN CAST(n AS VARCHAR) ELSE 'all' END, CASE WHEN n % 3 > 0 THEN 'batch=' || (n % 3 + 1) END,
    CASE WHEN n % 5 > 0 THEN 'workers=' || (n % 5 + 1) END) AS config FROM r""",
)
add(
    "k5_class_distribution",
    lambda t: dataset.class_distribution(listed(t)),
    "urls categories",
    f"""WITH {EXPORT}, {LISTED} SELECT category AS label, count(*) AS count, CAST(row_number() OVER (ORDER BY count(*) DESC, min(id)) AS INTEGER) AS rank,
  {pct('count(*)', '(SELECT count(*) FROM listed)')} AS pct FROM listed GROUP BY category""",
)
add(
    "k6_label_map",
    lambda t: dataset.label_map(documents(t)),
    "",
    "SELECT label, CAST(row_number() OVER (ORDER BY label) - 1 AS INTEGER) AS label_id FROM (SELECT DISTINCT lang AS label FROM documents) d",
)
SPLIT = """split AS (SELECT id, label, CASE WHEN n <= p THEN 'test' WHEN n <= 2 * p THEN 'val' ELSE 'train' END AS part
  FROM (SELECT doc_id AS id, lang AS label, row_number() OVER (PARTITION BY lang ORDER BY substr(md5('42:' || doc_id), 1, 15), doc_id) AS n,
    round(count(*) OVER (PARTITION BY lang) * CAST(0.15 AS DOUBLE)) AS p FROM documents) d)"""
add(
    "k7_stratified_split",
    lambda t: dataset.stratified_split(documents(t)).select("id", "label", "part"),
    "",
    f"WITH {SPLIT} SELECT * FROM split",
)
add(
    "k7_split_sizes",
    lambda t: dataset.stratified_split(documents(t)).groupBy("label", "part").agg(F.count(F.lit(1)).alias("count")),
    "",
    """WITH c AS (SELECT lang AS label, count(*) AS n FROM documents GROUP BY lang), s AS (SELECT label, n, CAST(round(n * CAST(0.15 AS DOUBLE)) AS BIGINT) AS p FROM c)
SELECT label, 'test' AS part, p AS count FROM s UNION ALL SELECT label, 'val', p FROM s UNION ALL SELECT label, 'train', n - 2 * p FROM s""",
)
add(
    "k8_class_weights",
    lambda t: dataset.class_weights(documents(t)),
    "",
    """WITH c AS (SELECT lang AS label, count(*) AS count FROM documents GROUP BY lang)
SELECT label, count, (SELECT count(*) FROM documents) / ((SELECT count(*) FROM c) * count) AS weight, (SELECT count(*) FROM documents) / ((SELECT count(*) FROM c) * count) > 3 AS rare FROM c""",
)
add(
    "k9_k10_k14_predictions",
    prediction_facts,
    "",
    f"WITH {SPLIT} SELECT id, label, true AS predicted, true AS confidence_valid, true AS same_when_loaded FROM split WHERE part = 'test'",
)
add("k9_metrics", metric_facts, "", f"WITH {SPLIT} SELECT count(*) AS num_test, true AS beats_largest FROM split WHERE part = 'test'")
add(
    "k11_metrics",
    lambda t: metrics.summary(t.predictions),
    "predictions",
    """WITH c AS (SELECT label FROM predictions UNION SELECT prediction FROM predictions),
f AS (SELECT c.label, (SELECT count(*) FROM predictions p WHERE p.label = c.label AND p.prediction = c.label) AS tp, (SELECT count(*) FROM predictions p WHERE p.label = c.label) AS support, (SELECT count(*) FROM predictions p WHERE p.prediction = c.label) AS pred FROM c)
SELECT CAST(printf('%.4f', CAST(sum(tp) / sum(support) AS DOUBLE)) AS DOUBLE) AS accuracy, CAST(printf('%.4f', avg(2 * tp / (support + pred))) AS DOUBLE) AS macro_f1, CAST(sum(support) AS BIGINT) AS num_test, count(*) AS num_labels, avg(2 * tp / (support + pred)) >= 0.8 AS goal_met FROM f""",
)
add(
    "k12_per_class",
    lambda t: metrics.per_class(t.predictions),
    "predictions",
    """WITH c AS (SELECT label FROM predictions UNION SELECT prediction FROM predictions),
f AS (SELECT c.label, (SELECT count(*) FROM predictions p WHERE p.label = c.label AND p.prediction = c.label) AS tp, (SELECT count(*) FROM predictions p WHERE p.label = c.label) AS support, (SELECT count(*) FROM predictions p WHERE p.prediction = c.label) AS pred FROM c)
SELECT label, CAST(printf('%.4f', coalesce(tp / nullif(pred, 0), 0)) AS DOUBLE) AS precision, CAST(printf('%.4f', coalesce(tp / nullif(support, 0), 0)) AS DOUBLE) AS recall,
  CAST(printf('%.4f', 2 * tp / (support + pred)) AS DOUBLE) AS f1, support FROM f""",
)
add(
    "k13_confusion",
    lambda t: metrics.confusion(t.predictions),
    "predictions",
    "SELECT label, prediction, count(*) AS count FROM predictions GROUP BY ALL",
)
add(
    "k13_confusion_wide",
    lambda t: metrics.confusion_wide(t.predictions, CLASSES),
    "predictions",
    "SELECT c.label, "
    + ", ".join(f"count(p.label) FILTER (p.prediction = '{c}') AS \"{c}\"" for c in CLASSES)
    + " FROM (SELECT unnest(['A', 'N', 'R', 'X']) AS label) c LEFT JOIN predictions p ON p.label = c.label GROUP BY c.label",
)
add(
    "s9_metrics_json",
    lambda t: metrics.report_json(t.predictions).select(
        F.get_json_object("value", "$.num_test").cast("long").alias("num_test"),
        F.get_json_object("value", "$.per_class.A.support").cast("long").alias("support_a"),
    ),
    "predictions",
    "SELECT count(*) AS num_test, count(*) FILTER (label = 'A') AS support_a FROM predictions",
)
add("o1_confident", confidence_facts, "", f"WITH {SPLIT} SELECT id, CAST(1 AS BIGINT) AS times, true AS right_side FROM split WHERE part = 'test'")
add(
    "o2_least_confident",
    review_facts,
    "",
    f"WITH {SPLIT} SELECT least(count(*), 20) AS listed, CAST(0 AS BIGINT) AS less_confident FROM split WHERE part = 'test'",
)
add(
    "o3_review_sample_sizes",
    lambda t: dataset.review_sample(documents(t)).groupBy("label").agg(F.count(F.lit(1)).alias("count")),
    "",
    "SELECT lang AS label, CASE WHEN count(*) < 50 THEN count(*) WHEN count(*) <= 150 THEN CAST(ceil(count(*) / 2) AS BIGINT) ELSE 100 END AS count FROM documents GROUP BY lang",
)
add(
    "o4_needs_retraining",
    lambda t: dataset.needs_retraining(t.urls, F.lit("2026-04-10").cast("timestamp"), 3),
    "urls",
    "SELECT count(*) AS fixes, count(*) >= 3 AS retrain FROM urls WHERE coalesce(manual_override, 0) = 1 AND processed_at >= TIMESTAMP '2026-04-10 00:00:00'",
)


def bayes_scored(t):
    """The test part, judged by counts of the train part that were written and read again."""
    parts = durable(dataset.stratified_split(documents(t)))
    path = scratch(t, "bayes")
    bayes.save(bayes.train(parts.filter("part = 'train'")), path)
    return bayes.load(t.spark, path), parts.filter("part = 'test'").select("id", "text", "label")


def bayes_scores(t):
    model, test = bayes_scored(t)
    return bayes.scores(model, test).select("id", "label", F.round("score", 4).alias("score"))


def bayes_predicted(t):
    model, test = bayes_scored(t)
    return bayes.predict(model, test).select("id", "label", "prediction", "confidence")


BAYES = (
    SPLIT
    + """,
tokens AS MATERIALIZED (SELECT id, word, count(*) AS n FROM (SELECT doc_id AS id, unnest(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+')) AS word FROM documents) WHERE word <> '' GROUP BY ALL),
learned AS MATERIALIZED (SELECT label, word, CAST(sum(n) AS BIGINT) AS n FROM tokens JOIN split USING (id) WHERE part = 'train' AND label IS NOT NULL GROUP BY ALL),
sizes AS (SELECT label, sum(n) AS size FROM learned GROUP BY 1),
labels AS (SELECT s.label, count(*) AS docs, coalesce(any_value(size), 0) + (SELECT count(DISTINCT word) FROM learned) AS room FROM split s LEFT JOIN sizes ON sizes.label = s.label WHERE part = 'train' AND s.label IS NOT NULL GROUP BY 1),
known AS (SELECT t.id, t.word, t.n FROM tokens t SEMI JOIN learned USING (word)),
scored AS MATERIALIZED (SELECT s.id, l.label, ln(l.docs / (SELECT sum(docs) FROM labels)) + coalesce(sum(k.n * (ln(coalesce(c.n, 0) + 1) - ln(l.room))), 0) AS score
  FROM (SELECT id FROM split WHERE part = 'test') s CROSS JOIN labels l LEFT JOIN known k ON k.id = s.id LEFT JOIN learned c ON c.label = l.label AND c.word = k.word GROUP BY s.id, l.label, l.docs),
judged AS (SELECT p.id, p.label, b.prediction, b.confidence FROM (SELECT id, label FROM split WHERE part = 'test') p
  JOIN (SELECT id, arg_min(label, {'s': -score, 'l': label}) AS prediction, round(1 / sum(exp(score - top)), 6) AS confidence FROM (SELECT *, max(score) OVER (PARTITION BY id) AS top FROM scored) GROUP BY id) b USING (id))"""
)
add("k9_bayes_scores", bayes_scores, "", f"WITH {BAYES} SELECT id, label, round(score, 4) AS score FROM scored")
add("k9_k10_k14_bayes_predictions", bayes_predicted, "", f"WITH {BAYES} SELECT * FROM judged")
add("k11_bayes_metrics", lambda t: metrics.summary(bayes_predicted(t).filter("label IS NOT NULL")).select("num_test", "accuracy"), "",
    f"WITH {BAYES} SELECT count(*) AS num_test, round(count(*) FILTER (label = prediction) / count(*), 4) AS accuracy FROM judged WHERE label IS NOT NULL")
add("o1_bayes_confident", lambda t: train.split_by_confidence(bayes_predicted(t), 0.95)[0], "", f"WITH {BAYES} SELECT * FROM judged WHERE confidence >= 0.95")
add(
    "o2_bayes_review",
    lambda t: train.least_confident(bayes_predicted(t), 20),
    "",
    f"WITH {BAYES} SELECT * FROM judged ORDER BY confidence, id LIMIT 20",
)
