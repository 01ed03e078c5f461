"""Training and applying the link classifier with Spark ML."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, IndexToString, RegexTokenizer, StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.operators.dataset import with_weights
from linkloom.session import durable

CONFIDENCE = 0.70


def pipeline(labels: list[str], max_iter: int = 30, features: int = 1 << 18, reg: float = 1e-3) -> Pipeline:
    """Words -> hashed TF-IDF -> weighted multinomial logistic regression."""
    return Pipeline(
        stages=[
            RegexTokenizer(inputCol="text", outputCol="words", pattern=r"(?U)\W+"),
            HashingTF(inputCol="words", outputCol="tf", numFeatures=features),
            IDF(inputCol="tf", outputCol="features"),
            LogisticRegression(
                featuresCol="features",
                labelCol="label_id",
                weightCol="weight",
                predictionCol="prediction_id",
                maxIter=max_iter,
                regParam=reg,
            ),
            IndexToString(inputCol="prediction_id", outputCol="prediction", labels=labels),
        ]
    )


def train(rows: DataFrame, **settings) -> PipelineModel:
    """Fit on (text, label). The label index is part of the saved model.

    The word counts are kept in the shared folder: the texts are read once, not again for each of the statistics and the fit.
    """
    indexer = StringIndexer(inputCol="label", outputCol="label_id", stringOrderType="alphabetAsc")
    weighted = with_weights(rows.select("text", "label"))
    indexed = indexer.fit(weighted)
    words, tf, *rest = pipeline(list(indexed.labels), **settings).getStages()
    counted = durable(tf.transform(words.transform(indexed.transform(weighted))).select("tf", "label_id", "weight"))
    return PipelineModel([indexed, words, tf, *Pipeline(stages=rest).fit(counted).stages])


def predict(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """Add ``prediction`` and ``confidence``, the largest class probability."""
    indexer, *rest = model.stages
    scored = rows
    for stage in rest:
        scored = stage.transform(scored)
    return scored.select(*rows.columns, "prediction", F.array_max(vector_to_array("probability")).alias("confidence"))


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def labels(model: PipelineModel) -> list[str]:
    return list(model.stages[0].labels)


def split_by_confidence(predicted: DataFrame, threshold: float = CONFIDENCE) -> tuple[DataFrame, DataFrame]:
    """Rows to keep, and rows to pass on to the slower model."""
    sure = F.col("confidence") >= threshold
    return predicted.filter(sure), predicted.filter(~sure)


def least_confident(predicted: DataFrame, k: int) -> DataFrame:
    """Review list, least confident first."""
    return predicted.orderBy("confidence", "id").limit(k)
