"""Probability calibration on held-out rows: sigmoid or isotonic, one class against the rest."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, functions as F

from netsieve.functions.guards import clip, col


@dataclass(frozen=True)
class Calibrator:
    """Per calibrated class a sigmoid (slope, offset) or the knots of a monotone step curve."""

    classes: list[str]
    method: str
    curves: list[dict]

    def _curve(self, i: int, f: Column) -> Column:
        c = self.curves[i]
        if self.method == "sigmoid":
            return F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.lit(c["slope"]) * f + F.lit(c["offset"]))))
        return clip(isotonic_value(f, c), 0.0, 1.0)

    def probabilities(self, scores: Sequence[Column]) -> list[Column]:
        """Calibrated probabilities from per-class scores (two classes: the second's), summing to 1."""
        raw = [self._curve(i, f) for i, f in enumerate(scores)]
        if len(self.classes) == 2:
            return [F.lit(1.0) - raw[0], raw[0]]
        total = raw[0]
        for r in raw[1:]:
            total = total + r
        even = F.lit(1.0 / len(raw))
        return [F.when(total > 0, r / F.when(total > 0, total).otherwise(1.0)).otherwise(even) for r in raw]


def fit_calibrator(df: DataFrame, label: str, classes: Sequence[str], scores: Sequence[str], method: str = "sigmoid") -> Calibrator:
    """Fit one curve per class from score columns; ``scores`` lists one column per class, or for two classes the
    second's alone."""
    if method not in ("sigmoid", "isotonic"):
        raise ValueError(f"unknown calibration method {method!r}")
    targets = list(classes)[1:] if len(classes) == 2 else list(classes)
    if len(targets) != len(scores):
        raise ValueError("one score column per calibrated class is needed")
    curves = []
    for name, score in zip(targets, scores):
        pos = F.coalesce(col(label).cast("string") == name, F.lit(False)).cast("double")
        work = df.select(col(score).cast("double").alias("f"), pos.alias("y"))
        curves.append(_fit_sigmoid(work) if method == "sigmoid" else fit_isotonic(work))
    return Calibrator(list(classes), method, curves)


def _fit_sigmoid(work: DataFrame) -> dict:
    """Platt scaling. The softened targets enter as two weighted rows per input."""
    n = work.agg(F.count_if(F.col("y") == 1).alias("p"), F.count_if(F.col("y") == 0).alias("n")).first()
    hi, lo = (n["p"] + 1.0) / (n["p"] + 2.0), 1.0 / (n["n"] + 2.0)
    target = F.when(F.col("y") == 1, F.lit(hi)).otherwise(F.lit(lo))
    rows = work.withColumn("_t", target).select(
        array_to_vector(F.array("f")).alias("x"),
        F.explode(F.array(F.struct(F.lit(1.0).alias("y"), F.col("_t").alias("w")), F.struct(F.lit(0.0).alias("y"), (1.0 - F.col("_t")).alias("w")))).alias("r"),
    ).select("x", "r.y", "r.w")
    m = LogisticRegression(featuresCol="x", labelCol="y", weightCol="w", regParam=0.0, standardization=True, maxIter=100, tol=1e-8).fit(rows)
    return {"slope": float(m.coefficients[0]), "offset": float(m.intercept)}


def pooled_blocks(x_lo: np.ndarray, x_hi: np.ndarray, total: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Neighbouring blocks (first and last score, sum of outcomes, weight) pooled until their means rise."""
    lo, hi, s, w = [], [], [], []
    for a, b, t, n in zip(x_lo.tolist(), x_hi.tolist(), total.tolist(), weight.tolist(), strict=True):
        while s and s[-1] * n >= t * w[-1]:
            a, t, n = lo.pop(), t + s.pop(), n + w.pop()
            hi.pop()
        lo.append(a)
        hi.append(b)
        s.append(t)
        w.append(n)
    return tuple(np.array(v, float) for v in (lo, hi, s, w))


BLOCKS = "part long, lo double, hi double, total double, weight double"
MERGE = 16  # neighbouring ranges pooled by one task


def fit_isotonic(work: DataFrame, ranges: int | None = None) -> dict:
    """The monotone curve of ``y`` (0 or 1) over ``f``: knots ``x`` and values ``y``.

    Rows of one score are added up first. Ranges of scores are pooled where they lie, then neighbouring ranges together, up
    a tree. Means of 0 and 1 that rise strictly over n rows are at most in the order of n to the two thirds, so the
    last pooling holds few blocks."""
    points = work.where(F.col("f").isNotNull() & ~F.isnan("f")).groupBy("f").agg(F.sum("y").alias("total"), F.count(F.lit(1)).cast("double").alias("weight"))
    parts = ranges or int(work.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    points = points.repartitionByRange(parts, "f").sortWithinPartitions("f").select(F.spark_partition_id().cast("long").alias("part"), F.col("f").alias("lo"), F.col("f").alias("hi"), "total", "weight")

    def pool(b: pd.DataFrame, part: int) -> pd.DataFrame:
        b = b.sort_values("lo")
        return pd.DataFrame(dict(zip(("lo", "hi", "total", "weight"), pooled_blocks(*(b[c].to_numpy() for c in ("lo", "hi", "total", "weight"))), strict=True))).assign(part=part)[["part", "lo", "hi", "total", "weight"]]

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for b in batches:  # blocks of a range so far, and the next rows
            if len(b):
                held = pool(b if held is None else pd.concat([held, b]), int(b["part"].iloc[0]))
        if held is not None:
            yield held

    blocks = points.mapInPandas(first, BLOCKS)
    while parts > 1:
        blocks = blocks.groupBy(F.floor(F.col("part") / MERGE).alias("part")).applyInPandas(lambda key, b: pool(b, key[0]), BLOCKS)
        parts = -(-parts // MERGE)
    rows = blocks.toPandas().sort_values("lo")
    mean = (rows["total"] / rows["weight"]).to_numpy()
    ends = np.column_stack([rows["lo"], rows["hi"]]).ravel()
    keep = np.concatenate(([True], np.diff(ends) > 0)) if len(ends) else np.zeros(0, bool)
    return {"x": ends[keep].tolist(), "y": np.repeat(mean, 2)[keep].tolist()}


def isotonic_value(f: Column, curve: dict) -> Column:
    """The curve at ``f``, by binary search among its knots: straight between them, level beyond; null for null or NaN."""
    x, y = np.array(curve["x"], float), np.array(curve["y"], float)

    @F.pandas_udf("double")
    def look_up(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            v = b.to_numpy(float)
            out = np.interp(v, x, y) if len(x) else np.full(len(v), np.nan)
            yield pd.Series(np.where(np.isnan(v), np.nan, out))

    found = look_up(f)
    return F.when(~F.isnan(found), found)
