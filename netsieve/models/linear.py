"""Linear classifiers: fitting, scoring as column expressions, contributions, soft voting."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, functions as F

from netsieve import __version__
from netsieve.functions.guards import col
from netsieve.models.preprocess import Scaler, fit_scaler
from netsieve.operators.mapping import ATTACK
from netsieve.operators.metrics import class_weights
from netsieve.operators.schema import probability_columns
from netsieve.session import spread
from netsieve.sources.bundles import Bundle


def class_index(label: Column, classes: Sequence[str]) -> Column:
    out = F.when(F.lit(False), F.lit(0.0))
    for i, c in enumerate(classes):
        out = out.when(label.cast("string") == c, F.lit(float(i)))
    return out


def distinct_labels(df: DataFrame, label: str) -> list[str]:
    """The class names, sorted. The class set is part of the model, so it is small by definition."""
    return sorted(r[0] for r in df.where(col(label).isNotNull()).select(col(label).cast("string")).distinct().collect())


def argmax_label(probs: Sequence[Column], classes: Sequence[str]) -> Column:
    """Class of the first largest probability."""
    top = F.greatest(*probs) if len(probs) > 1 else probs[0]
    out = F.when(F.lit(False), F.lit(classes[0]))
    for p, c in zip(probs, classes):
        out = out.when(p == top, F.lit(c))
    return out


@dataclass(frozen=True)
class LinearModel:
    """Softmax over linear scores of scaled features; with two classes one row of coefficients, for the second."""

    classes: list[str]
    scaler: Scaler
    coef: list[list[float]]
    intercept: list[float]
    version: str = __version__

    @property
    def feature_columns(self) -> list[str]:
        return self.scaler.columns

    def logits(self, features: Sequence[Column] | None = None) -> list[Column]:
        x = list(features) if features is not None else self.scaler.expressions()
        out = []
        for weights, b in zip(self.coef, self.intercept):
            z = F.lit(float(b))
            for w, f in zip(weights, x):
                z = z + F.lit(float(w)) * f
            out.append(z)
        return out

    def probabilities(self, logits: Sequence[Column], temperature: float = 1.0) -> list[Column]:
        """Class probabilities from logit columns; two classes count as logits (0, z)."""
        z = [F.lit(0.0), *logits] if len(logits) == 1 else list(logits)
        top = F.greatest(*z)
        e = [F.exp((v - top) / F.lit(float(temperature))) for v in z]
        total = e[0]
        for v in e[1:]:
            total = total + v
        return [v / total for v in e]

    def add_probabilities(self, df: DataFrame, prefix: str = "_p", temperature: float = 1.0, features: Sequence[Column] | None = None) -> DataFrame:
        """Add one column per class, computing each logit once."""
        z = self.logits(features)
        df = df.withColumns({f"{prefix}z{i}": v for i, v in enumerate(z)})
        probs = self.probabilities([F.col(f"{prefix}z{i}") for i in range(len(z))], temperature)
        return df.withColumns({f"{prefix}{i}": p for i, p in enumerate(probs)}).drop(*[f"{prefix}z{i}" for i in range(len(z))])

    def to_bundle(self, **config) -> Bundle:
        model = {"kind": "linear", "classes": self.classes, "scaler": self.scaler.to_dict(), "coef": self.coef, "intercept": self.intercept}
        return Bundle(self.feature_columns, {"classes": self.classes, **config}, model)

    @staticmethod
    def from_bundle(b: Bundle) -> "LinearModel":
        m = b.model
        return LinearModel(m["classes"], Scaler(**m["scaler"]), m["coef"], m["intercept"], b.config.get("bundle_version", ""))


def score_supervised(
    df: DataFrame, model: LinearModel, keep: Sequence[str], predictions: bool = True, proba_all: bool = False,
    proba_max: bool = True,
) -> DataFrame:
    """Scores with ids passed through: ``score`` is the attack probability for a Benign/Attack model, else the second
    class's; optional prediction, largest probability and per-class probabilities."""
    out = model.add_probabilities(df)
    probs = [F.col(f"_p{i}") for i in range(len(model.classes))]
    cols: list[Column] = []
    if ATTACK in model.classes and len(model.classes) == 2:
        p = probs[model.classes.index(ATTACK)]
        cols += [p.alias("p_attack"), p.alias("score")]
    else:
        cols.append(probs[min(1, len(probs) - 1)].alias("score"))
    if proba_max:
        cols.append((F.greatest(*probs) if len(probs) > 1 else probs[0]).alias("proba_max"))
    if proba_all:
        cols += [p.alias(n) for p, n in zip(probs, probability_columns(model.classes))]
    if predictions:
        cols.append(argmax_label(probs, model.classes).alias("prediction"))
    return out.select(*[col(k) for k in keep], *cols, F.lit(model.version).alias("model_version"))


def fit_logistic(
    df: DataFrame, label: str, features: Sequence[str], balanced: bool = False, rare_power: float = 0.0,
    c: float = 1.0, max_iter: int = 100, scaler: Scaler | None = None, classes: Sequence[str] | None = None,
) -> LinearModel:
    """L2 logistic regression minimising ``C*sum(w*loss) + |b|^2/2``; Spark's objective averages the loss, hence
    ``regParam = 1/(C*sum(w))``. Weights: balanced, a rare-class boost, or their product."""
    scaler = scaler or fit_scaler(df, features)
    classes = list(classes) if classes is not None else distinct_labels(df, label)
    if len(classes) < 2:
        raise ValueError(f"need at least two classes, got {classes}")
    train = df.select(
        class_index(col(label), classes).alias("_y"), col(label).cast("string").alias("_label"),
        array_to_vector(scaler.array()).alias("_x"),
    ).where(F.col("_y").isNotNull())
    weight = F.lit(1.0)
    for use, power in ((balanced, None), (rare_power > 0, rare_power)):
        if use:
            table = {r["_class"]: r["_w"] for r in class_weights(train, "_label", power).collect()}
            w = F.when(F.lit(False), F.lit(1.0))
            for name, value in table.items():
                w = w.when(F.col("_label") == name, F.lit(float(value)))
            weight = weight * w.otherwise(1.0)
    cached = train = train.select("_y", "_x", weight.alias("_w")).persist()
    try:
        total, rows = train.agg(F.sum("_w"), F.count(F.lit(1))).first()
        train = spread(train, rows).persist()
        lr = LogisticRegression(
            featuresCol="_x", labelCol="_y", weightCol="_w", regParam=1.0 / (c * total), elasticNetParam=0.0,
            standardization=False, maxIter=max_iter, tol=1e-6, family="binomial" if len(classes) == 2 else "multinomial",
        )
        m = lr.fit(train)
    finally:
        train.unpersist()
        cached.unpersist()
    if len(classes) == 2:
        return LinearModel(classes, scaler, [m.coefficients.toArray().tolist()], [float(m.intercept)])
    return LinearModel(classes, scaler, m.coefficientMatrix.toArray().tolist(), m.interceptVector.toArray().tolist())


def top_contributions(df: DataFrame, model: LinearModel, k: int = 8, class_row: int = 0, out: str = "top_features") -> DataFrame:
    """Per row the k features with the largest ``|coefficient * scaled value|``, as an array of
    (name, value, contribution); ties in contract order. ``class_row`` picks the coefficient row."""
    entries = []
    for i, (name, x, w) in enumerate(zip(model.scaler.columns, model.scaler.expressions(), model.coef[class_row])):
        part = F.lit(float(w)) * x
        entries.append(
            F.struct((-F.abs(part)).alias("order"), F.lit(i).alias("i"), F.lit(name).alias("name"),
                     col(name).cast("double").alias("value"), part.alias("contribution"))
        )
    ranked = F.slice(F.array_sort(F.array(*entries)), 1, k)
    return df.withColumn(out, F.transform(ranked, lambda e: F.struct(e["name"].alias("name"), e["value"].alias("value"), e["contribution"].alias("contribution"))))


def soft_vote(members: Sequence[Sequence[Column]]) -> list[Column]:
    """Mean of several models' class probabilities."""
    n = float(len(members))
    out = []
    for per_class in zip(*members):
        total = per_class[0]
        for p in per_class[1:]:
            total = total + p
        out.append(total / F.lit(n))
    return out


def model_from_literals(classes: Sequence[str], scaler: Scaler, coef: Mapping[str, Sequence[float]], intercept: Mapping[str, float]) -> LinearModel:
    """A model with given coefficients, per class (for two classes: only the second's)."""
    rows = [c for c in classes if c in coef]
    return LinearModel(list(classes), scaler, [list(coef[c]) for c in rows], [float(intercept[c]) for c in rows])
