"""A class-balanced logistic classifier of vectors."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fitted(train: DataFrame, held: DataFrame, strength: float = 0.01, rounds: int = 100) -> DataFrame:
    """held (features, label 0.0 or 1.0, ...) with p, the probability of 1, by a model of train; both labels weigh the same."""
    share = train.agg(F.avg("label")).head()[0]
    if not share or share == 1:
        raise ValueError("both labels are needed")
    rows = train.select(array_to_vector("features").alias("features"), "label", F.when(F.col("label") == 1, 0.5 / share).otherwise(0.5 / (1 - share)).alias("weight"))
    model = LogisticRegression(maxIter=rounds, regParam=strength, weightCol="weight").fit(rows)
    out = model.transform(held.withColumn("features", array_to_vector("features")))
    return out.withColumn("p", F.get(vector_to_array("probability"), F.lit(1))).drop("rawPrediction", "probability", "prediction", "features")
