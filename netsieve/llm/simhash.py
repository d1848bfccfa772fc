"""SimHash near-duplicates with BK-trees: fingerprints that differ in few bits are linked, links make components.

Fingerprints are reduced to distinct ones. Two that differ in at most ``RADIUS`` bits agree in all bits of some
choice of pieces of the 64 bits, so they share a shard, keyed by the bits of those pieces: the search is exact.
Each shard's fingerprints form a BK-tree (children keyed by their Hamming distance to the parent), and a search goes
down only along edges within the radius of the distance found. A shard too large for one task is cut into parts, and
each pair of parts is a task of its own: one part's tree, the other's searches. Tasks give back a spanning forest of
the links they find, never all pairs. Trees live where their shard is dealt to; sending all of them to all executors
would not be bounded by anything but the input.

Null texts count as empty; texts without words have fingerprint zero and link like any other. Repeated ids are one
node of their component with each of their fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from netsieve.llm.components import connected_components, join_labels
from netsieve.llm.textops import ragged, tidy
from netsieve.session import materialize

RADIUS, WORDS, SEED = 3, 3, 42
CROWD = 64  # distinct fingerprints a shard should hold on average, at most
PART = 2048  # fingerprints of a shard in one task
FRONTIER = 2_000_000  # visits kept in memory


def fingerprint(text: str) -> int:
    """64 bits of the 3-word shingles of the text, A-Z in lower case, repeats included; 0 without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    join, digest = b" ".join, xxhash.xxh64_intdigest
    n = max(1, len(words) - WORDS + 1)
    total, step = np.zeros(64, np.int64), 1 << 16
    for lo in range(0, n, step):
        h = np.array([digest(join(words[i : i + WORDS]), SEED) for i in range(lo, min(n, lo + step))], "<u8")
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key`` and ``fp``, the 64 bits as a signed number."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({key: b[key].to_numpy(), "fp": np.array([fingerprint(t) for t in b["_text"]], np.uint64).view(np.int64)})

    return docs.selectExpr(f"`{key}`", f"coalesce(`{text}`, '') AS _text").mapInPandas(tidy(run), f"`{key}` {kind}, fp long")


def shard_keys(distinct: int, radius: int = RADIUS) -> list[list[tuple[int, int]]]:
    """The choices of pieces (offset, width) that serve as shard keys, finer for more fingerprints."""
    for pieces in range(radius + 1, 2 * radius + 2):
        cuts = [64 * i // pieces for i in range(pieces + 1)]
        spans = [(a, b - a) for a, b in zip(cuts, cuts[1:])]
        keys = [list(c) for c in combinations(spans, pieces - radius)]
        if distinct >> min(sum(w for _, w in k) for k in keys) <= CROWD:
            break
    return keys


class BkForest:
    """A BK-tree for each group of fingerprints, all in the same arrays."""

    def __init__(self, fps: np.ndarray, group: np.ndarray):
        """``group``: sorted; distinct fingerprints within a group."""
        self.fps = fps
        first = np.ones(len(fps), bool)
        first[1:] = group[1:] != group[:-1]
        self.roots = np.flatnonzero(first)
        at = self.roots[np.cumsum(first) - 1]  # the node that each item has come to
        item = np.flatnonzero(~first)
        at, edges, child = at[item], [], []
        while len(item):
            key = at * 65 + np.bitwise_count(fps[item] ^ fps[at])
            order = np.argsort(key, kind="stable")
            key, item = key[order], item[order]
            new = np.ones(len(key), bool)
            new[1:] = key[1:] != key[:-1]
            edges.append(key[new])
            child.append(item[new])
            at = item[new][np.cumsum(new) - 1][~new]
            item = item[~new]
        self.edges = np.concatenate(edges) if edges else np.zeros(0, np.int64)
        order = np.argsort(self.edges)
        self.edges, self.child = self.edges[order], (np.concatenate(child) if child else np.zeros(0, np.int64))[order]

    def within(self, queries: np.ndarray, tree: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (number of query, node) at most ``radius`` apart, level by level; ``tree``: each query's group number."""
        q, node = np.arange(len(queries)), self.roots[tree]
        while len(q):
            d = np.bitwise_count(queries[q] ^ self.fps[node]).astype(np.int64)
            near = d <= radius
            yield q[near], node[near]
            lo = np.searchsorted(self.edges, node * 65 + np.maximum(d - radius, 0))
            n = np.searchsorted(self.edges, node * 65 + np.minimum(d + radius, 64), side="right") - lo
            q, node = np.repeat(q, n), self.child[ragged(lo, n)]


def linked(rows: pd.DataFrame, radius: int) -> pd.DataFrame:
    """A spanning forest of the links within complete groups (shard, lo, hi), as pairs of representatives.

    A row stands in part ``part``; the tree is made of part ``lo``, and the searches come from part ``hi``."""
    rows = rows.sort_values(["shard", "lo", "hi", "fp"], kind="stable")
    fp, rep = rows["fp"].to_numpy().view(np.uint64), rows["rep"].to_numpy()
    cols = rows[["shard", "lo", "hi"]].to_numpy()
    new = np.ones(len(rows), bool)
    new[1:] = (cols[1:] != cols[:-1]).any(1)
    group = np.cumsum(new) - 1
    part = rows["part"].to_numpy()
    in_tree, asks = part == cols[:, 1], part == cols[:, 2]
    nodes = np.flatnonzero(in_tree)
    has = np.isin(group, group[nodes])
    forest = BkForest(fp[nodes], group[nodes])
    tree_of = np.cumsum(np.isin(np.arange(group[-1] + 1), group[nodes])) - 1
    label = np.arange(len(rows))
    queries = np.flatnonzero(asks & has)
    size = np.bincount(group[nodes], minlength=group[-1] + 1)[group[queries]]
    block = np.cumsum(size) // FRONTIER
    for _, some in pd.Series(queries).groupby(block, sort=True):
        some = some.to_numpy()
        for q, node in forest.within(fp[some], tree_of[group[some]], radius):
            join_labels(label, some[q], nodes[node])
    moved = np.flatnonzero(rep != rep[label])
    return pd.DataFrame({"a": rep[moved], "b": rep[label[moved]]})


def links(reps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) between representatives of distinct fingerprints (columns fp, rep), enough for the components."""
    total = reps.count()
    part = max(PART, total // 10_000)  # keeps the table of crowded shards at 40,000 or, with finer keys, 350,000 short rows
    shards = [F.concat_ws(":", F.lit(i), *[F.expr(f"shiftrightunsigned(fp, {at}) & {(1 << width) - 1}") for at, width in key]) for i, key in enumerate(shard_keys(total, radius))]
    rows = reps.select("fp", "rep", F.explode(F.array(*[F.xxhash64(s) for s in shards])).alias("shard"))
    crowded = materialize(rows.groupBy("shard").count().where(F.col("count") > part).select("shard", F.ceil(F.col("count") / part).cast("int").alias("parts")), "shards")
    rows = rows.join(F.broadcast(crowded), "shard", "left")
    own = F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("fp"), "parts")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("parts") - 1, F.lit(0))))
    rows = rows.withColumn("part", own).withColumn("other", other)
    rows = rows.select("shard", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"), "part", "fp", "rep")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for b in batches:
            held.append(b)
            if sum(map(len, held)) < 100_000:
                continue
            every = pd.concat(held, ignore_index=True)
            last = (every[["shard", "lo", "hi"]] == every[["shard", "lo", "hi"]].iloc[-1]).all(axis=1)
            held = [every[last]]
            if not last.all():
                yield linked(every[~last], radius)
        if held and sum(map(len, held)):
            yield linked(pd.concat(held, ignore_index=True), radius)

    n = int(reps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(n, "shard", "lo", "hi").sortWithinPartitions("shard", "lo", "hi")
    return dealt.mapInPandas(tidy(run), "a long, b long")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key``, ``fp`` and ``component_id``, the smallest key that links lead to."""
    own = materialize(fingerprints(docs.where(F.col(key).isNotNull()), text, key), "fingerprints")
    reps = materialize(own.groupBy("fp").agg(F.min(key).alias("rep")), "distinct")
    found = links(reps, radius)
    same = own.groupBy(key).agg(F.min("fp").alias("x"), F.max("fp").alias("y")).where("x <> y")  # an id with several texts
    if not same.isEmpty():
        more = own.join(materialize(same.select(key), "repeated"), key).join(reps, "fp").where(f"`{key}` <> rep")
        found = found.unionByName(more.select(F.col(key).alias("a"), F.col("rep").alias("b")))
    label = connected_components(found)
    classes = materialize(reps.join(label.withColumnRenamed("node", "rep"), "rep", "left").select("fp", F.coalesce("component", "rep").alias("component_id")), "classes")
    return own.join(classes, "fp").select(key, "fp", "component_id")
