"""Which rows of a vector table take part, and their integer components. Shared by codes and whitening."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def kept_vectors(vectors: DataFrame, key: str, embedding: str, others: list[str], multiple: int = 1) -> tuple[DataFrame, int, int]:
    """``id``, ``v`` (array<double>) and ``others`` of the rows that take part, their number, and the vectors' length.

    A row is dropped if its vector is null or holds null or non-finite components. Vectors of another length than most
    (ties: the longer), empty ones, and lengths that ``multiple`` does not divide take no part either.
    """
    value = F.col("v")
    good = (
        vectors.select(F.col(key).alias("id"), F.transform(embedding, lambda x: x.cast("double")).alias("v"), *others)
        .where(value.isNotNull() & (F.size("v") > 0) & (F.size("v") % multiple == 0))
        .where(F.forall(value, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))))
    )
    first = good.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    if first is None:
        return good, 0, 0
    return good.where(F.size("v") == first["n"]), first["count"], first["n"]


def scaled(v: str, bound: int, shift: int = 0) -> Column:
    """Components as longs: floor(1024 * x) + ``shift``, held between ``-bound`` and ``bound`` before the shift."""
    return F.transform(v, lambda x: F.greatest(F.least(F.floor(F.greatest(F.least(x * 1024, F.lit(9e18)), F.lit(-9e18))), F.lit(bound)), F.lit(-bound)) + F.lit(shift))
