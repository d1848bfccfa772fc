"""Median imputation and standardisation, fitted once and applied as column expressions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, functions as F

from netsieve.functions.guards import col, finite_to_null
from netsieve.operators.ranking import exact_quantiles


@dataclass(frozen=True)
class Scaler:
    """Per-column median, mean and population deviation. A column without any value is not part of it."""

    columns: list[str]
    medians: list[float]
    means: list[float]
    stds: list[float]

    def expressions(self) -> list[Column]:
        """Scaled features, in order, with missing and infinite values replaced by the median."""
        out = []
        for c, med, mean, std in zip(self.columns, self.medians, self.means, self.stds):
            x = F.coalesce(finite_to_null(col(c)), F.lit(float(med)))
            out.append((x - F.lit(float(mean))) / F.lit(float(std)))
        return out

    def add_scaled(self, df: DataFrame, prefix: str) -> tuple[DataFrame, list[Column]]:
        """Scaled features as columns, so that several models read them without computing them again."""
        names = [f"{prefix}{i}" for i in range(len(self.columns))]
        return df.withColumns(dict(zip(names, self.expressions()))), [F.col(n) for n in names]

    def array(self) -> Column:
        return F.array(*self.expressions())

    def to_dict(self) -> dict:
        return asdict(self)


def fit_scaler(df: DataFrame, columns: Sequence[str], impute: bool = True) -> Scaler:
    """Exact medians, then means and deviations of the imputed columns in one aggregate. A constant column is
    divided by 1. ``impute=False`` skips the medians and fills with the mean, which changes neither statistic.
    Infinite values count as missing: one of them would make every mean and deviation useless."""
    columns = list(columns)
    x = {c: finite_to_null(col(c)) for c in columns}
    if impute:
        medians = {c: v[0] for c, v in exact_quantiles(df.select(*[e.alias(c) for c, e in x.items()]), columns, [0.5]).items()}
    else:
        row = df.agg(*[F.avg(x[c]).alias(f"m{i}") for i, c in enumerate(columns)]).first()
        medians = {c: row[f"m{i}"] for i, c in enumerate(columns)}
    kept = [c for c in columns if medians[c] is not None]
    if not kept:
        raise ValueError("no feature column has any value")
    aggs = []
    for i, c in enumerate(kept):
        filled = F.coalesce(x[c], F.lit(float(medians[c])))
        aggs += [F.avg(filled).alias(f"m{i}"), F.stddev_pop(filled).alias(f"s{i}")]
    row = df.agg(*aggs).first()
    means = [row[f"m{i}"] for i in range(len(kept))]
    stds = [row[f"s{i}"] or 1.0 for i in range(len(kept))]
    return Scaler(kept, [float(medians[c]) for c in kept], means, stds)
