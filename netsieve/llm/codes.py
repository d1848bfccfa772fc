"""Vector code compression: product codebooks whose entries stand in a GNAT (geometric near-neighbour access tree).

Vectors of integers are cut into equal parts, and every part is told by its nearest entry of that part position's
codebook. An entry search walks a tree of split points. A node keeps, for every split point and every child, the range
of distances from the point to the child's entries. With the distances of a part to the split points, a child whose
range cannot reach the best distance so far is left out, whole. Only children that are *strictly* farther go: ranges
and distances are rounded outwards first, and what remains is decided on exact integer squared distances, ties to the
lower index. Parts are searched together, as rows of arrays.

Codebooks start as the parts of the smallest keys. In each round every part is assigned, tasks add up their parts per
entry, Spark adds up the tasks, and entries become the floor of their mean; unused ones stay. Only codebooks (at most
``ENTRIES`` entries for each position) reach the driver; vectors are written once to the shared folder and read by
each round, so lost executors only repeat their tasks.

Null keys sort after all others; rows of one key are separate vectors, in the order of their components. Vectors of
another length than most, or of one that the number of parts does not divide, take no part. Components are held to a
bound at which a vector's error still fits a long (131,072 for 64 components). Fewer rows than entries give smaller
codebooks; an empty table has no codebooks and no codes. Columns other than those named do not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from netsieve.llm.vectors import kept_vectors, scaled
from netsieve.session import broadcast_if_small, materialize

ENTRIES, PARTS, ROUNDS = 256, 4, 4
ARITY, LEAF = 8, 32  # split points of a node; a node with at most so many entries has no children
ROUNDING = 1e-12  # relative, far above the error of a square root or a difference
EXACT = 1 << 53  # up to here integers in doubles are exact
LONG = (1 << 63) - 1


@dataclass
class _Node:
    index: np.ndarray  # entries compared in this node, ascending: its split points, or all of a leaf
    children: list  # (child, split point it belongs to)
    low: np.ndarray  # [split point, child]: least distance to an entry of the child, rounded down
    high: np.ndarray  # and largest, rounded up


class Gnat:
    """Exact nearest entries, lowest index on ties."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.reach = int(np.abs(entries).max(initial=0))
        self.root = self._build(np.arange(len(entries)))

    def _build(self, own: np.ndarray) -> _Node:
        none = np.zeros((0, 0))
        if len(own) <= max(LEAF, ARITY):
            return _Node(own, [], none, none)
        far = self._squares(self.entries[own], self.entries[own[:1]])[:, 0]
        splits = [int(far.argmax())]  # each next split point is the farthest from those before
        near = self._squares(self.entries[own], self.entries[own[splits]])[:, 0]
        while len(splits) < ARITY and near.max() > 0:
            splits.append(int(near.argmax()))
            near = np.minimum(near, self._squares(self.entries[own], self.entries[own[splits[-1:]]])[:, 0])
        if len(splits) == 1:  # all entries are equal
            return _Node(own, [], none, none)
        points = np.sort(own[splits])
        rest = np.setdiff1d(own, points)
        squares = self._squares(self.entries[rest], self.entries[points])
        home, dist = squares.argmin(1), np.sqrt(squares.astype(float))
        kids = [j for j in range(len(points)) if (home == j).any()]
        low = np.column_stack([dist[home == j].min(0) for j in kids]) * (1 - ROUNDING)
        high = np.column_stack([dist[home == j].max(0) for j in kids]) * (1 + ROUNDING)
        return _Node(points, [(self._build(rest[home == j]), j) for j in kids], low, high)

    def _squares(self, some: np.ndarray, others: np.ndarray) -> np.ndarray:
        """Exact squared distances of all rows of both."""
        kind = self._kind(some)
        some = some.astype(kind)
        return self._from(some, (some * some).sum(1), others)

    def _kind(self, some: np.ndarray) -> type:
        """Doubles where they hold every sum exactly, else longs, whose overflows cancel."""
        reach = max(int(some.max(initial=0)), -int(some.min(initial=0)), self.reach)
        return np.float64 if 4 * some.shape[1] * reach * reach < EXACT else np.int64

    @staticmethod
    def _from(some: np.ndarray, norms: np.ndarray, others: np.ndarray) -> np.ndarray:
        others = others.astype(some.dtype)
        out = some @ (others.T * -2)
        out += norms[:, None]
        out += (others * others).sum(1)
        return out

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Index and squared distance of each part's nearest entry, and how many distances were computed."""
        parts = parts.astype(self._kind(parts))
        index, best = np.full(len(parts), len(self.entries), np.int64), np.full(len(parts), LONG).astype(parts.dtype)
        seen = self._visit(self.root, parts, (parts * parts).sum(1), np.arange(len(parts)), index, best)
        return index, best.astype(np.int64), seen

    def _visit(self, node: _Node, parts: np.ndarray, norms: np.ndarray, rows: np.ndarray, index: np.ndarray, best: np.ndarray) -> int:
        squares = self._from(parts[rows], norms[rows], self.entries[node.index])
        at = squares.argmin(1)  # the first of equal ones, which is the lowest index
        found, which, had = squares[np.arange(len(rows)), at], node.index[at], best[rows]
        better = np.flatnonzero((found < had) | ((found == had) & (which < index[rows])))
        best[rows[better]], index[rows[better]] = found[better], which[better]
        seen = squares.size
        if not node.children:
            return seen
        dist = np.sqrt(squares.astype(float))
        first = dist[:, [j for _, j in node.children]].argmin(1)  # the child of the nearest split point is searched first
        nearer, farther = dist * (1 - ROUNDING), dist * (1 + ROUNDING)
        for turn in (True, False):
            for c, (child, _) in enumerate(node.children):
                go = np.flatnonzero((first == c) == turn)
                reach = np.sqrt(best[rows[go]].astype(float)) * (1 + ROUNDING)
                for j in range(len(node.index)):  # a split point that leaves the child out settles it
                    gone = (nearer[go, j] - reach > node.high[j, c]) | (farther[go, j] + reach < node.low[j, c])
                    go, reach = go[~gone], reach[~gone]
                if len(go):
                    seen += self._visit(child, parts, norms, rows[go], index, best)
        return seen


@dataclass
class Codebooks:
    """Entries by part position: [parts, entries, components of a part]."""

    entries: np.ndarray

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def integer_vectors(vectors: DataFrame, key: str = "vec_id", embedding: str = "embedding", label: str = "label", parts: int = PARTS) -> tuple[DataFrame, int]:
    """``id``, ``v`` (array<long>) and ``label`` of the rows that take part, written to the shared folder; and their length."""
    good, _, width = kept_vectors(vectors, key, embedding, [F.col(label).alias("label")], parts)
    bound = isqrt(LONG // (4 * max(width, 1)))
    return materialize(good.select("id", scaled("v", bound).alias("v"), "label"), "vectors"), width


def _searcher(books: np.ndarray):
    def search(v: pd.Series) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The parts [position, row, component] of some vectors, the indexes of their entries, and squared distances."""
        cut = np.stack(v.to_numpy()).astype(np.int64).reshape(len(v), len(books), -1).transpose(1, 0, 2)
        found = [tree.nearest(own) for tree, own in zip(trees, cut, strict=True)]
        return cut, np.stack([f[0] for f in found]), np.stack([f[1] for f in found])

    trees = [Gnat(book) for book in books]
    return search


def fit_codebooks(ints: DataFrame, width: int, entries: int = ENTRIES, parts: int = PARTS, rounds: int = ROUNDS) -> Codebooks:
    """Codebooks for the table of :func:`integer_vectors`."""
    first = ints.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).collect()
    books = np.array([r["v"] for r in first], np.int64).reshape(len(first), parts, width // parts).transpose(1, 0, 2).copy()
    for _ in range(rounds if len(first) else 0):
        sums = _entry_sums(ints, books).collect()  # at most one row for each entry
        for r in sums:
            books[r["part"], r["entry"]] = [s // r["n"] for s in r["total"]]
    return Codebooks(books)


def _entry_sums(ints: DataFrame, books: np.ndarray) -> DataFrame:
    """``part``, ``entry``, ``n`` and ``total`` (array) of the parts assigned to each entry that is used."""
    parts, size, long = books.shape

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        search = _searcher(books)
        n, total = np.zeros((parts, size), np.int64), np.zeros((parts, size, long), np.int64)
        for b in batches:
            if not len(b):
                continue
            cut, code, _ = search(b["v"])
            for p in range(parts):
                order = np.argsort(code[p], kind="stable")
                used, start = np.unique(code[p][order], return_index=True)
                total[p, used] += np.add.reduceat(cut[p][order], start)
                n[p] += np.bincount(code[p], minlength=size)
        part, entry = np.nonzero(n)
        if len(part):
            yield pd.DataFrame({"part": part, "entry": entry, "n": n[part, entry], "total": list(total[part, entry])})

    sums = ints.select("v").mapInPandas(run, "part int, entry int, n long, total array<long>")
    return sums.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("total")[i]) for i in range(long)]).alias("total"))


def encode(ints: DataFrame, books: Codebooks) -> DataFrame:
    """``id``, ``label``, ``codes`` (array<int>, an index for each part) and ``errors`` (array<long>, squared distances)."""
    entries, kind = books.entries, ints.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        search = _searcher(entries)
        for b in batches:
            if len(b):
                _, code, error = search(b["v"])
                yield pd.DataFrame({"id": b["id"], "label": b["label"], "codes": list(code.T.astype(np.int32)), "errors": list(error.T)})

    return ints.mapInPandas(run, f"id {kind}, label {ints.schema['label'].dataType.simpleString()}, codes array<int>, errors array<long>")


def decode(codes: DataFrame, books: Codebooks) -> DataFrame:
    """``codes`` with a column ``approximate`` (array<long>): the entries they stand for, one after another."""
    entries = books.entries

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(approximate=[np.concatenate([entries[p, c] for p, c in enumerate(own)]) for own in b["codes"]])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in codes.schema.fields)
    return codes.mapInPandas(run, f"{kinds}, approximate array<long>")


def code_rows(vectors: DataFrame) -> DataFrame:
    """``vec_id``, ``code`` (hex digits), ``error``, ``label_error`` and ``codebooks_sha256`` of each vector that takes part."""
    ints, width = integer_vectors(vectors)
    books = fit_codebooks(ints, width)
    byte = F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c), 2, "0")))
    error = F.aggregate("errors", F.lit(0).cast("long"), lambda s, e: s + e)
    rows = materialize(encode(ints, books).select(F.col("id").alias("vec_id"), "label", F.array_join(byte, "").alias("code"), error.alias("error")), "codes")
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LONG).cast("decimal(38,0)")).cast("long")
    by_label = broadcast_if_small(rows.groupBy(F.col("label").alias("of")).agg(total.alias("label_error")), "label-errors")
    return rows.join(by_label, F.col("label").eqNullSafe(F.col("of"))).select("vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


CODE_SQL = """
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), x AS MATERIALIZED (
  SELECT vec_id, label, u.p AS p, v[u.p * len(v) // 4 + 1 : (u.p + 1) * len(v) // 4] AS part FROM kept, (SELECT unnest(range(4)) AS p) u
), c0 AS MATERIALIZED (
  SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, part AS entry FROM x
  WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT 256)
)"""


def _code_sql() -> str:
    """The rounds written out as one query: assignment and new entries of each."""
    assign = """, a{i} AS MATERIALIZED (
  SELECT vec_id, label, p, arg_min(e, d * 256 + e) AS e, min(d) AS d, any_value(part) AS part FROM (
    SELECT x.*, c.e, CAST(list_sum(list_transform(list_zip(x.part, c.entry), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d FROM x JOIN c{i} c ON c.p = x.p)
  GROUP BY vec_id, label, p
)"""
    means = """, m{i} AS (
  SELECT p, e, list(m ORDER BY j) AS entry FROM (
    SELECT p, e, j, CAST((sum(t) - ((sum(t) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS m FROM (
      SELECT p, e, unnest(part) AS t, unnest(range(len(part))) AS j FROM a{i}) GROUP BY p, e, j) GROUP BY p, e
), c{n} AS MATERIALIZED (SELECT c.p, c.e, coalesce(m.entry, c.entry) AS entry FROM c{i} c LEFT JOIN m{i} m ON m.p = c.p AND m.e = c.e)"""
    rounds = "".join(assign.format(i=i) + means.format(i=i, n=i + 1) for i in range(ROUNDS))
    return f"""{CODE_SQL}{rounds}{assign.format(i=ROUNDS)}, r AS (
  SELECT vec_id, any_value(label) AS label, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY vec_id
), h AS (SELECT sha256(string_agg(array_to_string(entry, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM c{ROUNDS})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM r, h"""


ORACLE_SQL = _code_sql()
