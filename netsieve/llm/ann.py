"""Nearest neighbours by collision counting over single projections (virtual rehashing).

Largest inner products become smallest distances by one more coordinate that evens out the norms. It must stay small
beside the others, so a shard of vectors is divided into classes of like norms, each with a largest norm of its own. A
class keeps one sorted array of positions per random projection. A query opens a window around its own position in every
array and counts, for each vector, the windows it stands in; windows widen by a factor until enough vectors have
collided in a share of the projections above the threshold. These are verified: their exact inner products, in double
precision on the original vectors, decide. Every vector is indexed, and a class with few vectors verifies all. Classes
are searched from the largest norm down, until no vector of the rest can reach the best found.

Queries and vectors are dealt as blocks: each pair of a query block and a shard is one task's work, so neither side is
sent to everyone and no hot spot arises. Vectors that are null, zero, of another length than most, or hold null or
non-finite components take no part. Repeated ids are separate candidates; a query never finds rows of its own id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

NEAREST = 20
PROJECTIONS = 64
FRACTION = 0.55  # share of the projections in which a candidate must collide
WIDER = 1.12  # growth of the windows from level to level
FIRST = 0.9  # half width of the first windows, in standard deviations of the projections
VERIFY, LEAST = 0.36, 600  # a class stops widening at this share of its vectors, and not below so many
ALIKE = 1.25  # largest norm of a class by its smallest
SHARD, QUERIES = 20_000, 2_000  # vectors and queries of a task
SPREAD = 24  # shards at least, so that small tables use more than one task
COUNTERS = 2_000_000  # collision counters at once
SEED = 11


class Lines:
    """Sorted projections of vectors of like norms."""

    def __init__(self, vectors: np.ndarray, norm: np.ndarray):
        self.size, self.top = len(vectors), norm.max()
        rng = np.random.default_rng(SEED)
        self.lines = rng.normal(size=(PROJECTIONS, vectors.shape[1] + 1)).astype(np.float32)
        lifted = np.column_stack([vectors, np.sqrt(np.maximum(self.top**2 - norm**2, 0))]).astype(np.float32)
        at = self.lines @ lifted.T
        self.order = np.argsort(at, axis=1)
        self.places = np.take_along_axis(at, self.order, 1)
        self.spread = float(at.std()) or 1.0

    def candidates(self, queries: np.ndarray, enough: int) -> list[np.ndarray]:
        """For each query the vectors that collide with it in enough projections."""
        n, m = self.size, len(queries)
        if n <= enough:
            return [np.arange(n)] * m
        need = int(np.ceil(FRACTION * PROJECTIONS))
        scale = self.top / np.maximum(np.linalg.norm(queries, axis=1), 1e-300)  # a query's length does not change the order
        at = self.lines[:, :-1] @ (queries * scale[:, None]).astype(np.float32).T
        count, half = np.zeros((m, n), np.int32), FIRST * self.spread
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * m
        live, lo, hi = np.arange(m), None, None
        while len(live):
            left = np.stack([np.searchsorted(line, x - half) for line, x in zip(self.places, at[:, live], strict=True)])
            right = np.stack([np.searchsorted(line, x + half, side="right") for line, x in zip(self.places, at[:, live], strict=True)])
            go_on = []
            for i, q in enumerate(live):
                if lo is None:
                    gained = [line[s:e] for line, s, e in zip(self.order, left[:, i].tolist(), right[:, i].tolist(), strict=True)]
                else:  # only what the windows gain
                    gained = [line[s:e] for line, s, e in zip(self.order, left[:, i].tolist(), lo[:, i].tolist(), strict=True)]
                    gained += [line[s:e] for line, s, e in zip(self.order, hi[:, i].tolist(), right[:, i].tolist(), strict=True)]
                count[q] += np.bincount(np.concatenate(gained), minlength=n).astype(np.int32)
                found = np.flatnonzero(count[q] >= need)
                if len(found) >= enough or (right[:, i] - left[:, i]).min() == n:
                    out[q] = found
                else:
                    go_on.append(i)
            live, lo, hi, half = live[go_on], left[:, go_on], right[:, go_on], half * WIDER
        return out


class Shard:
    """Some vectors, in classes of like norms."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        norm = np.linalg.norm(vectors, axis=1)
        order = np.argsort(-norm, kind="stable")
        self.ids, self.vectors, norm = ids[order], vectors[order], norm[order]
        self.first = [0]
        while self.first[-1] < len(norm):
            self.first.append(int(np.searchsorted(-norm, -norm[self.first[-1]] / ALIKE, side="right")))
        self.place = order
        self.classes = [Lines(self.vectors[s:e], norm[s:e]) for s, e in zip(self.first, self.first[1:])]

    def found(self, c: int, queries: np.ndarray, enough: int) -> list[np.ndarray]:
        """Candidates of a class among the sorted vectors, if about ``enough`` of the shard are wanted."""
        lines = self.classes[c]
        return [self.first[c] + at for at in lines.candidates(queries, max(LEAST, -(-enough * lines.size // len(self.ids))))]

    def candidates(self, queries: np.ndarray, enough: int) -> list[np.ndarray]:
        """For each query the vectors that collide with it in enough projections."""
        every = [self.found(c, queries, enough) for c in range(len(self.classes))]
        return [self.place[np.concatenate(own)] for own in zip(*every, strict=True)]

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each query the ids and inner products of the best ``k`` found."""
        enough = max(LEAST, int(VERIFY * len(self.ids)), 4 * k)
        step = max(1, COUNTERS // len(self.ids))
        length = np.linalg.norm(queries, axis=1)
        for s in range(0, len(queries), step):
            some, size = queries[s : s + step], length[s : s + step]
            best = [(np.zeros(0, self.ids.dtype), np.zeros(0))] * len(some)
            for c, lines in enumerate(self.classes):
                least = np.array([score[-1] if len(score) == k else -np.inf for _, score in best])
                live = np.flatnonzero(lines.top * size * (1 + 1e-9) >= least)  # the others' best are beyond all that is left
                if not len(live):
                    break
                for i, at in zip(live, self.found(c, some[live], enough), strict=True):
                    best[i] = self.better(best[i], at, query_ids[s + i], some[i], k)
            for i, (ids, score) in enumerate(best):
                yield query_ids[s + i], ids, score

    def better(self, best: tuple[np.ndarray, np.ndarray], at: np.ndarray, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The best ``k`` of those so far and of the candidates ``at``."""
        at = at[self.ids[at] != query_id]
        rough = self.vectors[at] @ query
        if len(at) > 2 * k:  # the last digits depend on the order of summation, so a little more is summed anew
            least = np.partition(rough, len(at) - k)[len(at) - k]
            at = at[rough >= least - 1e-9 * max(1.0, abs(least))]
        ids, score = np.append(best[0], self.ids[at]), np.append(best[1], (self.vectors[at] * query).sum(1))
        order = np.lexsort((ids, -score))[:k]
        return ids[order], score[order]


def nearest(vectors: DataFrame, is_query: F.Column, k: int = NEAREST, key: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``query_id``, ``rank``, ``vec_id`` and ``score`` (double) of the ``k`` nearest found for each query row."""
    value = F.col("v")
    good = (
        vectors.select(F.col(key).cast("long").alias("id"), F.transform(embedding, lambda x: x.cast("double")).alias("v"), is_query.alias("asks"))
        .where(F.col("id").isNotNull() & value.isNotNull())
        .where(F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(value, lambda x: x != 0))
    )
    sizes = {r["n"]: (r["rows"], r["asks"]) for r in good.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("rows"), F.count_if("asks").alias("asks")).collect()}
    width = max(sizes, key=lambda n: (sizes[n][0], n), default=0)
    rows, asks = sizes.get(width, (0, 0))
    shards, blocks = max(SPREAD, -(-rows // SHARD)), max(1, -(-asks // QUERIES))
    good = good.where(F.size("v") == width)

    def spread(n: int, salt: int) -> F.Column:
        return F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(n)).cast("int")

    base = good.withColumn("shard", spread(shards, 1)).select("id", "v", "shard", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(False).alias("asks"))
    ask = good.where("asks").withColumn("block", spread(blocks, 2)).select("id", "v", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), "block", F.lit(True).alias("asks"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        asks = pdf["asks"].to_numpy()
        out = []
        if asks.any() and not asks.all():
            at = np.flatnonzero(~asks)
            shard = Shard(pdf["id"].to_numpy()[at], np.stack(pdf["v"].to_numpy()[at]))
            ask = np.flatnonzero(asks)
            for q, ids, score in shard.search(pdf["id"].to_numpy()[ask], np.stack(pdf["v"].to_numpy()[ask]), k):
                out.append(pd.DataFrame({"query_id": q, "vec_id": ids, "score": score}))
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})

    found = base.unionByName(ask.select(base.columns)).groupBy("shard", "block").applyInPandas(run, "query_id long, vec_id long, score double")

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
