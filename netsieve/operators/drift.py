"""Numeric drift between a reference table and a sample."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F, types as T

from netsieve.functions.guards import col, nan_to_null


def _numeric(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def column_stats(df: DataFrame, columns: Sequence[str], prefix: str) -> DataFrame:
    """One row per column with mean and population deviation, from a single aggregate over the table."""
    aggs = []
    for i, c in enumerate(columns):
        x = nan_to_null(col(c))
        aggs += [F.avg(x).alias(f"m{i}"), F.stddev_pop(x).alias(f"s{i}")]
    rows = [
        F.struct(F.lit(c).alias("column"), F.col(f"m{i}").alias(f"{prefix}_mean"), F.col(f"s{i}").alias(f"{prefix}_std"))
        for i, c in enumerate(columns)
    ]
    return df.agg(*aggs).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def numeric_drift(reference: DataFrame, sample: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Mean shift per shared numeric column, relative to the reference mean (absolute when that is about 0)."""
    if columns is None:
        other = set(_numeric(sample))
        columns = [c for c in _numeric(reference) if c in other]
    else:
        columns = [c for c in columns if c in reference.columns and c in sample.columns]
    if not columns:
        raise ValueError("the tables share no numeric columns")
    both = column_stats(reference, columns, "ref").join(column_stats(sample, columns, "sample"), "column")
    base = F.abs("ref_mean")
    scale = F.when(base > 1e-12, base).otherwise(1.0)
    shift = F.abs(F.col("sample_mean") - F.col("ref_mean")) / scale
    return both.withColumn("abs_mean_shift_ratio", shift).orderBy(F.col("abs_mean_shift_ratio").desc(), "column")


def drift_report(reference: DataFrame, sample: DataFrame, columns: Sequence[str] | None = None, top: int = 20) -> DataFrame:
    """Every column's drift with the column count and whether it is among the ``top`` shifts."""
    drift = numeric_drift(reference, sample, columns)
    count = drift.agg(F.count(F.lit(1))).scalar()
    entry = F.struct((-F.col("abs_mean_shift_ratio")).alias("neg"), F.col("column"))
    # One entry per column of the table: bounded by the schema.
    worst = drift.agg(F.transform(F.slice(F.array_sort(F.collect_list(entry)), 1, top), lambda e: e["column"])).scalar()
    return drift.withColumn("column_count", count).withColumn("in_top", F.array_contains(worst, F.col("column")))
