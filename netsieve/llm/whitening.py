"""Embedding whitening: blockwise QR, Householder bidiagonalisation, dqds, and twisted factorisations.

The covariance is never formed. Tasks reduce their centred rows block by block to one triangle each, triangles are
merged a few at a time up a tree, and the last triangle R (as many rows as components) holds it: R'R = n V. On the
driver, which only ever sees R, Householder reflections make R bidiagonal, differential quotient-difference steps with
shifts find its singular values to high relative accuracy, and for each of the leading ones a twisted factorisation
(a factorisation from the top and one from the bottom, joined where they agree best) solves for the vector without
iterating. Vectors of values that are too close are made orthogonal within their cluster. Then every row is projected.

Rows are centred before anything is multiplied: n x - S is an exact integer. A component without variance (a singular
value that is zero to rounding) has explained 0 and no whitened value (null); it stands outside ``identity_error``,
which is null if no component is left. Deviations beyond a long are null. Components are held to +-2**31 before the
shift. Null and repeated ids are separate rows, vectors of another length than most take no part, fewer components
than asked for are all returned, and an empty table gives no rows. Other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from netsieve.llm.vectors import kept_vectors, scaled
from netsieve.session import materialize

COMPONENTS = 8
SHIFT, BOUND = 100_000, 1 << 31
BLOCK = 4_096  # rows reduced at once
MERGE = 16  # triangles merged by one task
CLOSE = 1e-3  # values with a smaller relative gap form a cluster
EPS = float(np.finfo(float).eps)


def triangle(rows: np.ndarray, above: np.ndarray | None = None) -> np.ndarray:
    """The triangle of rows below another triangle."""
    return np.linalg.qr(rows if above is None else np.vstack([above, rows]), mode="r")


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal a, superdiagonal b and right rotation V of R = U B V' by Householder reflections."""
    m = r.astype(float).copy()
    n = m.shape[0]
    right = np.eye(n)
    for k in range(n):
        _reflect(m[k:, k:])
        if k < n - 2:
            v = _reflect(m[k:, k + 1 :].T)
            right[:, k + 1 :] -= np.outer(right[:, k + 1 :] @ v, 2 * v)
    return np.diag(m).copy(), np.diag(m, 1).copy(), right


def _reflect(m: np.ndarray) -> np.ndarray:
    """Reflect the rows of ``m`` in place so that its first column ends after one entry; the unit vector of it."""
    v = m[:, 0].copy()
    size = np.abs(v).max(initial=0)
    if size == 0 or not np.abs(v[1:]).max(initial=0):
        return np.zeros(len(v))
    v /= size
    v[0] += np.copysign(np.linalg.norm(v), v[0])
    v /= np.linalg.norm(v)
    m -= np.outer(2 * v, v @ m)
    return v


def singular_values(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared singular values of the bidiagonal (a, b), falling, by dqds."""
    q, e = a.astype(float) ** 2, b.astype(float) ** 2
    largest = max(q.max(initial=0), e.max(initial=0))
    if largest == 0:
        return np.zeros(len(q))
    q = np.maximum(q / largest, (EPS * 1e-4) ** 2)  # a zero becomes a number far below rounding
    e = e / largest
    found: list[float] = []
    todo = [(q.tolist(), e.tolist(), 0.0)]
    while todo:
        q, e, moved = todo.pop()
        if len(q) > 1 and q[0] < q[-1]:  # values should fall towards the end
            q, e = q[::-1], e[::-1]
        while q:
            n = len(q)
            if n == 1 or e[-1] <= EPS * EPS * (moved + q[-1]):
                found.append(moved + q.pop())
                e = e[: n - 2]
                continue
            cut = next((i for i in range(n - 2, -1, -1) if e[i] <= EPS * EPS * (moved + min(q[i], q[i + 1]))), None)
            if cut is not None:
                todo.append((q[: cut + 1], e[:cut], moved))
                q, e = q[cut + 1 :], e[cut + 1 :]
                continue
            # The end two by two gives the next shift; too large a shift shows as a negative number and is made smaller.
            half = (q[-1] + e[-1] - q[-2]) / 2 if n > 1 else 0.0
            shift = max(0.0, q[-1] + e[-1] - max(0.0, half) - np.sqrt(half * half + q[-2] * e[-1]))
            shift = min(shift, q[-1])
            for _ in range(4):
                step = _shifted(q, e, shift)
                if step is not None:
                    break
                shift *= 0.5
            else:
                shift, step = 0.0, _shifted(q, e, 0.0)
            (q, e), moved = step, moved + shift
    return np.sort(np.array(found) * largest)[::-1]


def _shifted(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float]] | None:
    """One dqds step: q and e of B'B - shift, or None if that is not positive."""
    d, qs, es = q[0] - shift, [], []
    for below, right in zip(q[1:], e, strict=True):
        if d < 0:
            return None
        top = d + right
        ratio = below / top if top > 0 else 0.0
        qs.append(top)
        es.append(right * ratio)
        d = d * ratio - shift
    if d < 0:
        return None
    return [*qs, d], es


def vectors_of(a: np.ndarray, b: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit right singular vectors (columns) of the bidiagonal (a, b) for its squared singular values, falling.

    The bidiagonal is divided where b vanishes to rounding, since equal values can only stand in different blocks.
    """
    size = max(np.abs(a).max(initial=0), np.abs(b).max(initial=0))
    edge = [0, *(np.flatnonzero(np.abs(b) <= EPS * size) + 1).tolist(), len(a)]
    owned = [(float(v), i, s, t) for i, (s, t) in enumerate(zip(edge, edge[1:])) for v in singular_values(a[s:t], b[s : t - 1])]
    owned.sort(key=lambda x: -x[0])
    out = np.zeros((len(a), len(values)))
    before: dict[int, list[tuple[float, np.ndarray]]] = {}
    for k, (value, block, s, t) in enumerate(owned[: len(values)]):
        mine = before.setdefault(block, [])
        near = []
        for other, z in reversed(mine):  # a cluster is a run of values, each close to the next
            if other - (near[-1][0] if near else value) > CLOSE * max(other, EPS * size * size):
                break
            near.append((other, z))
        z = twisted(a[s:t], b[s : t - 1], value, [z for _, z in near])
        mine.append((value, z))
        out[s:t, k] = z
    return out


def twisted(a: np.ndarray, b: np.ndarray, value: float, others: list[np.ndarray]) -> np.ndarray:
    """The unit vector of B'B for one value, orthogonal to ``others``, which belong to values close by."""
    n = len(a)
    if n == 1:
        return np.ones(1)
    tiny = EPS * max(float(np.abs(a).max()) ** 2, float(np.abs(b).max(initial=0)) ** 2, 1e-300)
    diagonal = np.maximum(a * a, tiny * EPS)
    lower = a[:-1] * b / diagonal[:-1]

    def nonzero(x: float) -> float:
        return x if abs(x) > tiny * EPS else tiny * EPS

    def apart(z: np.ndarray) -> np.ndarray:
        for _ in range(2):
            for o in others:
                z = z - (o @ z) * o
        return z

    for turn in range(3):
        down, s = np.zeros(n - 1), np.zeros(n)  # L D L' - value = L+ D+ L+' from the top
        s[0] = -value
        for i in range(n - 1):
            down[i] = diagonal[i] * lower[i] / nonzero(s[i] + diagonal[i])
            s[i + 1] = down[i] * lower[i] * s[i] - value
        up, p = np.zeros(n - 1), np.zeros(n)  # and = U- D- U-' from the bottom
        p[-1] = diagonal[-1] - value
        for i in range(n - 2, -1, -1):
            ratio = diagonal[i] / nonzero(diagonal[i] * lower[i] ** 2 + p[i + 1])
            up[i] = lower[i] * ratio
            p[i] = p[i + 1] * ratio - value
        residual = s + p + value
        best, left, correction = np.zeros(n), -1.0, 0.0
        for k in np.argsort(np.abs(residual), kind="stable")[: 1 + 4 * len(others)]:
            z = np.zeros(n)
            z[k] = 1
            for i in range(k - 1, -1, -1):
                z[i] = -down[i] * z[i + 1]
            for i in range(k, n - 1):
                z[i + 1] = -up[i] * z[i]
            long = np.linalg.norm(z)
            if not np.isfinite(long) or (others and abs(residual[k]) > 64 * tiny * long):  # only what solves for the value
                continue
            free = apart(z / long)
            if np.linalg.norm(free) > left:
                best, left, correction = free, np.linalg.norm(free), residual[k] / long**2
            if left > 0.7:
                break
        if left < 0.1:  # no twist leaves the cluster
            break
        if others or abs(correction) <= 4 * EPS * abs(value):
            return apart(best) / np.linalg.norm(apart(best))
        value += correction  # the Rayleigh quotient of what was found
    else:
        return best / left
    # Equal values to rounding: the factorisation from the top solves for any start, kept apart from the cluster so far.
    z = np.random.default_rng(len(others)).normal(size=n)
    for _ in range(4):
        z = apart(z / np.linalg.norm(z))
        for i in range(1, n):
            z[i] -= down[i - 1] * z[i - 1]
        z /= np.array([nonzero(x) for x in s + diagonal])
        for i in range(n - 2, -1, -1):
            z[i] -= down[i] * z[i + 1]
        z /= np.abs(z).max()
    z = apart(z / np.linalg.norm(z))
    return z / np.linalg.norm(z)


@dataclass
class Whitening:
    """What whitens the vectors it was fitted on. ``values`` are eigenvalues of their covariance, falling."""

    n: int
    sums: list[int]
    directions: np.ndarray  # a unit eigenvector in each column
    values: np.ndarray
    trace: float

    def live(self) -> np.ndarray:
        """Which components have any variance."""
        return self.values > self.values.max(initial=0) * (EPS * len(self.sums)) ** 2

    def explained(self) -> list[float]:
        return [float(v / self.trace) if ok else 0.0 for v, ok in zip(self.values, self.live(), strict=True)]


def fit(ints: DataFrame, n: int, width: int, components: int = COMPONENTS) -> Whitening:
    """The leading components of a table with ``x`` (array<long>), ``n`` rows of ``width`` numbers."""
    one = ints.agg(F.array(*[F.sum(F.col("x")[i]) for i in range(width)]).alias("s")).first()
    sums = [int(s or 0) for s in one["s"]]
    whole = np.array(sums)

    def reduce(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        r = None
        for b in batches:
            for i in range(0, len(b), BLOCK):
                r = triangle(centred(b["x"].iloc[i : i + BLOCK], n, whole), r)
        if r is not None:
            yield pd.DataFrame({"at": [TaskContext.get().partitionId()], "r": [r.ravel()]})

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        r = np.vstack([np.asarray(own).reshape(-1, width) for own in pdf.sort_values("at")["r"]])
        return pd.DataFrame({"at": [int(pdf["at"].min()) // MERGE], "r": [triangle(r).ravel()]})

    parts = ints.select("x").mapInPandas(reduce, "at long, r array<double>")
    left = ints.rdd.getNumPartitions()
    while left > 1:
        parts, left = parts.groupBy((F.col("at") / MERGE).cast("long")).applyInPandas(merge, "at long, r array<double>"), -(-left // MERGE)
    square = np.zeros((width, width))
    for r in parts.collect():  # one triangle
        own = np.array(r["r"]).reshape(-1, width)
        square[: len(own)] = own
    return solve(square, n, sums, components)


def solve(square: np.ndarray, n: int, sums: list[int], components: int = COMPONENTS) -> Whitening:
    """The leading components, given the triangle of all centred rows."""
    k = min(components, len(square))
    a, b, right = bidiagonal(square)
    values = singular_values(a, b)[:k]
    directions = right @ vectors_of(a, b, values)
    return Whitening(n, sums, directions, values / n, float((square * square).sum()) / n)


def centred(x: pd.Series, n: int, sums: np.ndarray) -> np.ndarray:
    """Rows less their mean; the numerators are exact."""
    return (n * np.stack(x.to_numpy()) - sums) / n


def _deviation(y: np.ndarray) -> list[int | None]:
    """Exact sums of squares of rows of integers; None beyond a long."""
    rough = (y.astype(float) ** 2).sum(1)
    out: list[int | None] = (y * y).sum(1).tolist() if rough.max(initial=0) < 9e18 else [sum(int(v) ** 2 for v in row) for row in y]
    return [d if d < 1 << 63 else None for d in out]


def whiten(ints: DataFrame, model: Whitening) -> DataFrame:
    """``id``, ``deviation`` and ``whitened`` (array<double>, NaN where a component has no variance) of each row."""
    n, sums = model.n, np.array(model.sums)
    with np.errstate(divide="ignore"):
        onto = np.where(model.live(), model.directions / np.sqrt(model.values), np.nan) if n else model.directions

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                y = n * np.stack(b["x"].to_numpy()) - sums
                yield pd.DataFrame({"id": b["id"], "deviation": pd.array(_deviation(y), "Int64"), "whitened": list((y / n) @ onto)})

    return ints.select("id", "x").mapInPandas(run, f"id {ints.schema['id'].dataType.simpleString()}, deviation long, whitened array<double>")


def identity_error(white: DataFrame, live: np.ndarray) -> float | None:
    """Largest absolute entry of the covariance of ``whitened`` less the identity."""
    w, at = F.col("whitened"), np.flatnonzero(live).tolist()
    if not at:
        return None
    mean = white.agg(*[F.avg(w[i]).alias(f"m{i}") for i in at]).first()
    pairs = [(i, j) for i in at for j in at if i <= j]
    got = white.agg(*[F.avg((w[i] - F.lit(mean[f"m{i}"])) * (w[j] - F.lit(mean[f"m{j}"]))).alias(f"c{i}_{j}") for i, j in pairs]).first()
    return max(abs(got[f"c{i}_{j}"] - (i == j)) for i, j in pairs)


def integer_vectors(vectors: DataFrame, key: str = "vec_id", embedding: str = "embedding") -> tuple[DataFrame, int, int]:
    """``id`` and ``x`` (array<long>) of the rows that take part, their number, and the vectors' length."""
    good, n, width = kept_vectors(vectors, key, embedding, [])
    return good.select("id", scaled("v", BOUND, SHIFT).alias("x")), n, width


def whitened_rows(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """A row for each vector and component: ``vec_id``, ``component``, ``n``, ``deviation``, ``whitened``, ``explained``, ``identity_error``."""
    ints, n, width = integer_vectors(vectors)
    model = fit(ints, n, width, components) if n else Whitening(0, [], np.zeros((0, 0)), np.zeros(0), 0.0)
    white = materialize(whiten(ints, model), "whitened")
    error = identity_error(white, model.live()) if n else None
    shares = F.array(*[F.lit(x) for x in model.explained()]).cast("array<double>")
    rows = white.select("id", "deviation", F.posexplode("whitened").alias("at", "w"))
    return rows.select(
        F.col("id").alias("vec_id"),
        (F.col("at") + 1).alias("component"),
        F.lit(n).cast("long").alias("n"),
        "deviation",
        F.when(~F.isnan("w"), F.col("w")).alias("whitened"),
        F.element_at(shares, F.col("at") + 1).alias("explained"),
        F.lit(error).cast("double").alias("identity_error"),
    )
