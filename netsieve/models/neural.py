"""Feed-forward classifier on scaled features."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import MultilayerPerceptronClassificationModel, MultilayerPerceptronClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, functions as F

from netsieve.functions.guards import col
from netsieve.models.linear import class_index, distinct_labels
from netsieve.models.preprocess import Scaler, fit_scaler
from netsieve.session import spread


@dataclass
class NeuralModel:
    classes: list[str]
    scaler: Scaler
    net: MultilayerPerceptronClassificationModel

    def add_probabilities(self, df: DataFrame, prefix: str = "_p") -> DataFrame:
        names = df.columns
        m = self.net.copy().setFeaturesCol("_x").setProbabilityCol("_prob").setRawPredictionCol("_raw").setPredictionCol("_pred")
        out = m.transform(df.withColumn("_x", array_to_vector(self.scaler.array()))).withColumn("_a", vector_to_array("_prob"))
        return out.select(*[col(n) for n in names], *[F.col("_a")[i].alias(f"{prefix}{i}") for i in range(len(self.classes))])


def _log_loss(model: MultilayerPerceptronClassificationModel, rows: DataFrame) -> float:
    scored = model.transform(rows).withColumn("_a", vector_to_array(model.getProbabilityCol()))
    p = F.greatest(F.get("_a", F.col("_y").cast("int")), F.lit(1e-15))
    return scored.agg(F.avg(-F.log(p))).first()[0]


def fit_neural(
    df: DataFrame, label: str, features: Sequence[str], hidden: Sequence[int] = (256, 128), max_iter: int = 100,
    balanced: bool = True, validation: DataFrame | None = None, patience: int = 0, stage: int = 10, seed: int = 42,
) -> NeuralModel:
    """Spark's multilayer perceptron: sigmoid hidden units and L-BFGS instead of ReLU units and AdamW; it has neither
    batch normalisation, dropout nor row weights.

    Balancing therefore repeats rows of smaller classes (no row is dropped). With a validation table, training runs
    in stages of ``stage`` iterations, continues from the last weights, keeps the best stage, and with ``patience``
    stops after that many stages without improvement.
    """
    scaler = fit_scaler(df, features)
    classes = distinct_labels(df, label)
    prep = lambda t: t.select(class_index(col(label), classes).alias("_y"), array_to_vector(scaler.array()).alias("_x")).where(F.col("_y").isNotNull())
    train = prep(df)
    if balanced:
        counts = {r["_y"]: r["count"] for r in train.groupBy("_y").count().collect()}
        times = F.when(F.lit(False), F.lit(1))
        for y, n in counts.items():
            times = times.when(F.col("_y") == y, F.lit(int(round(max(counts.values()) / n))))
        train = train.withColumn("_r", F.explode(F.sequence(F.lit(1), times.otherwise(1)))).drop("_r")
    cached = train = train.persist()
    train = spread(train, train.count()).persist()
    try:
        net = MultilayerPerceptronClassifier(
            featuresCol="_x", labelCol="_y", layers=[len(scaler.columns), *hidden, len(classes)], seed=seed, blockSize=128,
        )
        if validation is None:
            return NeuralModel(classes, scaler, net.setMaxIter(max_iter).fit(train))
        val = prep(validation).persist()
        best, best_loss, left, weights = None, math.inf, patience, None
        for _ in range(math.ceil(max_iter / stage)):
            net = net.setMaxIter(stage)
            if weights is not None:
                net = net.setInitialWeights(weights)
            m = net.fit(train)
            weights = m.weights
            loss = _log_loss(m, val)
            if loss < best_loss - 1e-6:
                best, best_loss, left = m, loss, patience
            elif patience > 0:
                left -= 1
                if left <= 0:
                    break
        val.unpersist()
        return NeuralModel(classes, scaler, best)
    finally:
        train.unpersist()
        cached.unpersist()
