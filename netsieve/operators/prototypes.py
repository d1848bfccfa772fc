"""Open-set scoring: class means and the distance to the nearest one."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from netsieve.functions.guards import col
from netsieve.operators.triage import minmax_score


@dataclass(frozen=True)
class Prototypes:
    """Mean vector per class. Classes times dimensions numbers, part of a model bundle like its coefficients."""

    classes: list[str]
    means: list[list[float]]

    def __post_init__(self) -> None:
        if not self.classes:
            raise ValueError("no class has any rows")


def class_means(df: DataFrame, label: str, features: Sequence[Column]) -> DataFrame:
    """One row per class present: label and mean vector. One aggregate with map-side partial sums."""
    means = [F.avg(f.cast("double")).alias(f"m{i}") for i, f in enumerate(features)]
    per = df.where(col(label).isNotNull()).groupBy(col(label).cast("string").alias("class")).agg(*means)
    return per.select("class", F.array(*[F.col(f"m{i}") for i in range(len(features))]).alias("mean"))


def fit_prototypes(df: DataFrame, label: str, features: Sequence[Column], classes: Sequence[str] | None = None) -> Prototypes:
    """Class means as model state; classes without rows are skipped."""
    found = {r["class"]: list(r["mean"]) for r in class_means(df, label, features).collect()}
    order = [c for c in (classes or sorted(found)) if c in found]
    return Prototypes(order, [found[c] for c in order])


def nearest_distance(features: Sequence[Column], prototypes: Prototypes) -> Column:
    """Euclidean distance to the nearest mean, for features in flat columns: one compiled expression."""
    squares = []
    for mean in prototypes.means:
        total = F.lit(0.0)
        for x, m in zip(features, mean):
            d = x.cast("double") - F.lit(float(m))
            total = total + d * d
        squares.append(total)
    return F.sqrt(F.least(*squares) if len(squares) > 1 else squares[0])


def nearest_distance_vector(vector: Column, prototypes: Prototypes) -> Column:
    """The same for an array column. NULL for a NULL vector, one with a NULL component or one of another length."""
    squares = []
    for mean in prototypes.means:
        gaps = F.zip_with(vector.cast("array<double>"), F.array(*[F.lit(float(m)) for m in mean]), lambda x, m: (x - m) * (x - m))
        squares.append(F.aggregate(gaps, F.lit(0.0), lambda total, x: total + x))
    return F.sqrt(F.least(*squares) if len(squares) > 1 else squares[0])


def score_open_set(df: DataFrame, distance: Column, lo: float | None = None, hi: float | None = None) -> DataFrame:
    """Add ``open_set_nearest_distance`` and ``open_set_ood_score``; pass a stored range to score a stream."""
    return minmax_score(df.withColumn("open_set_nearest_distance", distance), "open_set_nearest_distance", "open_set_ood_score", lo, hi)
