"""A binary classifier of short texts on character n-grams."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import grams

#: Below the first a text is no object, above the second it is one; between them another judge decides.
IGNORE, ACCEPT = 0.01, 0.99
LEAST, LEAST_EACH = 50, 10


def fit(samples: DataFrame, text: str, label: str, features: int = 1 << 16) -> PipelineModel | None:
    """Logistic regression with balanced classes; None under 50 samples or 10 of a class."""
    counts = {r[label]: r["n"] for r in samples.groupBy(label).agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    if total < LEAST or min(counts.get(0, 0), counts.get(1, 0)) < LEAST_EACH:
        return None
    weight = F.when(F.col(label) == 1, total / (2 * counts[1])).otherwise(total / (2 * counts[0]))
    rows = samples.select(F.col(label).cast("double").alias("label"), grams(F.lower(text), 2, 5).alias("grams"), weight.alias("weight"))
    return Pipeline(stages=[HashingTF(inputCol="grams", outputCol="tf", numFeatures=features), IDF(inputCol="tf", outputCol="features", minDocFreq=2), LogisticRegression(weightCol="weight", regParam=0.001, maxIter=30)]).fit(rows)


def classify(items: DataFrame, model: PipelineModel, text: str) -> DataFrame:
    """items with probability and verdict (ignore, accept or ask)."""
    scored = model.transform(items.withColumn("grams", grams(F.lower(text), 2, 5)))
    p = vector_to_array("probability")[1]
    return scored.select(*items.columns, F.round(p, 6).alias("p"), F.when(p < IGNORE, "ignore").when(p > ACCEPT, "accept").otherwise("ask").alias("verdict"))
