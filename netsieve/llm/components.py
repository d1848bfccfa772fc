"""Connected components of links between numbered nodes, with tables only: hooking and pointer jumping.

Every node points to a smaller node of its component. A round lets each link whose ends point to different nodes hang
the larger of the two under the smaller, then shortens all pointers until they end. Rounds write their tables to the
shared folder, so lineage stays short and joins read plain tables, whose hot keys adaptive execution splits.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from netsieve.session import materialize


def _shorten(to: DataFrame) -> DataFrame:
    while True:
        nxt = to.withColumnRenamed("to", "mid").join(to.select(F.col("node").alias("mid"), F.col("to").alias("end")), "mid")
        nxt = materialize(nxt.select("node", F.col("end").alias("to"), (F.col("end") != F.col("mid")).alias("moved")), "pointers")
        to = nxt.select("node", "to")
        if nxt.where("moved").isEmpty():
            return to


def connected_components(links: DataFrame) -> DataFrame:
    """``node`` and ``component`` (the smallest node that can be reached) for all nodes of ``links`` (columns a, b)."""
    links = materialize(links.select("a", "b").where("a IS NOT NULL AND b IS NOT NULL"), "links")
    both = links.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(links.select(F.col("b").alias("node"), F.col("a").alias("other")))
    to = materialize(both.groupBy("node").agg(F.least("node", F.min("other")).alias("to")), "pointers")
    while True:
        to = _shorten(to)
        a = to.select(F.col("node").alias("a"), F.col("to").alias("ta"))
        b = to.select(F.col("node").alias("b"), F.col("to").alias("tb"))
        apart = links.join(a, "a").join(b, "b").where("ta <> tb")
        hooks = materialize(apart.groupBy(F.greatest("ta", "tb").alias("node")).agg(F.min(F.least("ta", "tb")).alias("under")), "hooks")
        if hooks.isEmpty():
            return to.withColumnRenamed("to", "component")
        to = materialize(to.join(hooks, "node", "left").select("node", F.coalesce("under", "to").alias("to")), "pointers")


def join_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Merge the sets of ``a`` and ``b`` in place; ``label`` holds each item's smallest member so far."""
    while len(a):
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            nxt = label[label]
            if (nxt == label).all():
                break
            label[:] = nxt
