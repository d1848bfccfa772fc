"""Exact order statistics, running totals, splits and top-k without collecting rows anywhere.

A global ``Window.orderBy`` puts a table into one task and Spark's exact ``percentile`` keeps every distinct value
of a group in one task's memory. The helpers here reach the same results by narrowing value ranges with mergeable
aggregates, so only counts and a bounded number of values ever meet in one place.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from netsieve.functions.guards import col, nan_to_null
from netsieve.session import broadcast_if_small, materialize

# Sketch accuracy, and how many distinct values of one column may be collected to read a rank off.
ACCURACY = 10_000
SMALL = 100_000
GRID = [i / 500 for i in range(501)]


@dataclass
class _Range:
    """Values of one column among which one wanted rank lies, and about how many rows they are."""

    column: str
    rank: int
    lo: float
    hi: float
    rows: float


def _locate(base: DataFrame, todo: list[_Range]) -> list[tuple[_Range, int, list[tuple[float, int]]]]:
    """Per range the rows below it and its (value, count) pairs, for all ranges together.

    One aggregate counts what lies below. A second pass keeps only the values inside a range, as one short array per
    row, and counts them per value; most rows yield nothing, so little is shuffled or collected.
    """
    spans = sorted({(t.column, t.lo, t.hi) for t in todo})
    below = base.agg(*[F.count_if(F.col(c) < lo).alias(f"b{i}") for i, (c, lo, _) in enumerate(spans)]).first()
    hits = [
        F.when((F.col(c) >= lo) & (F.col(c) <= hi), F.struct(F.lit(i).alias("i"), F.col(c).alias("v")))
        for i, (c, lo, hi) in enumerate(spans)
    ]
    rows = base.select(F.explode(F.array_compact(F.array(*hits))).alias("k")).groupBy("k.i", "k.v").count().collect()
    inside: dict[int, list[tuple[float, int]]] = {}
    for r in rows:
        inside.setdefault(r["i"], []).append((r["v"], r["count"]))
    at = {span: i for i, span in enumerate(spans)}
    which = [at[t.column, t.lo, t.hi] for t in todo]
    return [(t, below[f"b{i}"], sorted(inside.get(i, []))) for t, i in zip(todo, which)]


def _reopen(t: _Range, below: int, inside: int, ends: dict[str, tuple[int, float, float]]) -> _Range:
    """The side of a range on which its rank lies, when a sketch has missed it."""
    n, lowest, highest = ends[t.column]
    if t.rank < below:
        return _Range(t.column, t.rank, lowest, t.lo, below)
    return _Range(t.column, t.rank, t.hi, highest, n - below - inside)


def _narrow(base: DataFrame, todo: list[_Range], ends: dict[str, tuple[int, float, float]]) -> list[_Range]:
    """Ranges cut to about 1/250 of their rows: one pass counts what lies below and sketches what lies inside.

    ``ends``: rows, minimum and maximum of each column, for ranges that turn out not to hold their rank."""
    aggs = []
    for i, t in enumerate(todo):
        x = F.col(t.column)
        inside = F.when((x >= t.lo) & (x <= t.hi), x)
        aggs += [
            F.count_if(x < t.lo).alias(f"b{i}"), F.count(inside).alias(f"n{i}"),
            F.percentile_approx(inside, F.array(*[F.lit(g) for g in GRID]), ACCURACY).alias(f"q{i}"),
        ]
    got = base.agg(*aggs).first()
    out = []
    for i, t in enumerate(todo):
        below, n, q = got[f"b{i}"], got[f"n{i}"], got[f"q{i}"]
        if not below <= t.rank < below + n:
            out.append(_reopen(t, below, n, ends))
            continue
        at = int((t.rank - below) / n * (len(GRID) - 1))
        lo, hi = q[max(0, at - 1)], q[min(len(GRID) - 1, at + 2)]
        # A value that fills the range cannot be cut further, nor need it be: it is one distinct value.
        rows = 1.0 if lo == hi else n * 4.0 / (len(GRID) - 1)
        same = (lo, hi) == (t.lo, t.hi)  # so few distinct values that the grid cannot tell them apart
        out.append(_Range(t.column, t.rank, lo, hi, 1.0 if same else rows))
    return out


def _select(base: DataFrame, probs: dict[str, Sequence[float]], ranks_of: Callable[[str, int], list[list[int]]], small: int) -> tuple[dict[str, int], dict[str, dict[int, float]]]:
    """Row counts, and the values at the ranks that ``ranks_of(column, rows)`` lists for each probability."""
    slack = 2.0 / ACCURACY
    grid = {c: [min(1.0, max(0.0, p + d)) for p in ps for d in (-slack, slack)] for c, ps in probs.items()}
    first = base.agg(
        *[F.count(c).alias(f"n_{c}") for c in probs],
        *[F.min(c).alias(f"lo_{c}") for c in probs],
        *[F.max(c).alias(f"hi_{c}") for c in probs],
        *[F.percentile_approx(F.col(c), F.array(*[F.lit(g) for g in grid[c]]), ACCURACY).alias(f"q_{c}") for c in probs],
    ).first()
    counts = {c: first[f"n_{c}"] for c in probs}
    todo: list[_Range] = []
    for c in probs:
        n = counts[c]
        for i, ranks in enumerate(ranks_of(c, n) if n else []):
            whole = n * len(probs) <= small
            lo, hi = (first[f"lo_{c}"], first[f"hi_{c}"]) if whole else first[f"q_{c}"][2 * i:2 * i + 2]
            todo += [_Range(c, r, lo, hi, n if whole else n * 3 * slack) for r in sorted(set(ranks))]
    ends = {c: (counts[c], first[f"lo_{c}"], first[f"hi_{c}"]) for c in probs}
    found: dict[str, dict[int, float]] = {c: {} for c in probs}
    while todo:
        share = max(1.0, small / len(todo))  # all ranges together stay within the budget
        while any(t.rows > share for t in todo):
            wide = [t for t in todo if t.rows > share]
            todo = [t for t in todo if t.rows <= share] + _narrow(base, wide, ends)
        again = []
        for t, below, inside in _locate(base, todo):
            total = below
            for value, n in inside:
                total += n
                if below <= t.rank < total:
                    found[t.column][t.rank] = value
                    break
            else:
                again.append(_reopen(t, below, total - below, ends))
        todo = again
    return counts, found


def exact_quantiles(
    df: DataFrame, columns: Sequence[str], probs: Sequence[float], small: int = SMALL, stage: bool = False
) -> dict[str, list[float | None]]:
    """Exact linearly interpolated quantiles of several columns; NULL and NaN are left out.

    A sketch pass brackets every wanted rank; brackets with more than ``small`` rows are narrowed 250-fold per pass;
    a last pass collects the few distinct values left and counts what lies below them. No pass holds more than
    sketches, counts, or ``small`` values in all. Returns None for a column without values. ``stage`` writes the
    columns once before the passes: for scores, which would otherwise be computed in each pass.
    """
    probs = [float(p) for p in probs]
    alias = {c: f"c{i}" for i, c in enumerate(columns)}
    base = df.select(*[nan_to_null(col(c)).alias(a) for c, a in alias.items()])
    base = materialize(base, "quantiles") if stage else base

    def around(p: float, n: int) -> tuple[int, int, float]:
        pos = p * (n - 1)
        lo = math.floor(pos)
        return lo, min(lo + 1, n - 1), pos - lo

    counts, found = _select(base, {a: probs for a in alias.values()}, lambda _, n: [list(around(p, n)[:2]) for p in probs], small)
    out: dict[str, list[float | None]] = {}
    for c, a in alias.items():
        vals: list[float | None] = []
        for p in probs:
            if not counts[a]:
                vals.append(None)
                continue
            lo, hi, w = around(p, counts[a])
            x, y = found[a][lo], found[a][hi]
            vals.append(x if w == 0 or x == y else x + (y - x) * w)
        out[c] = vals
    return out


def select_ranks(base: DataFrame, column: str, ranks: Sequence[int], n: int, small: int = SMALL) -> dict[int, float]:
    """The values at 0-based ranks of a numeric column with ``n`` values, exactly."""
    probs = [(r + 0.5) / n for r in ranks]
    return _select(base, {column: probs}, lambda _, __: [[r] for r in ranks], small)[1][column]


def running_totals(df: DataFrame, order: str, sums: Sequence[str], descending: bool = True, buckets: int | None = None) -> DataFrame:
    """Per distinct value of ``order``: the sums, their running totals, and the next value's sums (``next_<c>``).

    Rows are combined per distinct value before any shuffle, so a value held by a third of the table costs one row
    per task. The combined table is written once, because several passes need it and the input may be expensive.
    Distinct values are cut into ranges; windows run inside a range, and range totals (one row per range) supply each
    range's starting point and its successor.
    """
    spark = df.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = "_x"
    base = df.select(nan_to_null(col(order)).alias(name), *[col(s).alias(s) for s in sums]).where(F.col(name).isNotNull())
    per = materialize(base.groupBy(name).agg(*[F.sum(s).alias(s) for s in sums]), "totals")
    cuts = sorted(set(per.approxQuantile(name, [i / buckets for i in range(1, buckets)], 0.25 / buckets))) if buckets > 1 else []
    splits = [float("-inf"), *[c for c in cuts if abs(c) != float("inf")], float("inf")]
    if len(splits) > 2:
        per = Bucketizer(splits=splits, inputCol=name, outputCol="_b").transform(per)
    else:
        per = per.withColumn("_b", F.lit(0.0))

    def sort(c: str) -> Column:
        return F.col(c).desc() if descending else F.col(c).asc()

    # One row per range: total, and the sums of its first value in the chosen order.
    pick = F.max_by if descending else F.min_by
    ranges = per.groupBy("_b").agg(
        *[F.sum(s).alias(f"_t_{s}") for s in sums],
        *[pick(F.col(s), F.col(name)).alias(f"_f_{s}") for s in sums],
    )
    across = W.orderBy(sort("_b"))
    ranges = ranges.select(
        "_b",
        *[F.coalesce(F.sum(f"_t_{s}").over(across.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias(f"_o_{s}") for s in sums],
        *[F.lead(f"_f_{s}").over(across).alias(f"_n_{s}") for s in sums],
    )
    within = W.partitionBy("_b").orderBy(sort(name))
    return (
        per.join(ranges, "_b")
        .select(
            F.col(name).alias(order),
            *sums,
            *[(F.col(f"_o_{s}") + F.sum(s).over(within.rowsBetween(W.unboundedPreceding, 0))).alias(f"cum_{s}") for s in sums],
            *[F.coalesce(F.lead(s).over(within), F.col(f"_n_{s}")).alias(f"next_{s}") for s in sums],
        )
    )


def top_n_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], n: int, tie: Sequence[str], salts: int = 32) -> DataFrame:
    """First ``n`` rows of each group. Each group is cut down in ``salts`` slices first, so a hot group is never
    ranked by one task over all its rows."""
    slice_ = F.pmod(F.xxhash64(*[col(t) for t in tie]), F.lit(salts))
    keys = [col(g) for g in group]
    first = df.withColumn("_s", slice_).withColumn("_rn", F.row_number().over(W.partitionBy(*keys, "_s").orderBy(*order)))
    cut = first.where(F.col("_rn") <= n).drop("_rn", "_s")
    return cut.withColumn("_rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("_rn") <= n).drop("_rn")


def latest_per_key(df: DataFrame, key: Sequence[str], version: Sequence[str]) -> DataFrame:
    """The newest row of each key, by map-side combined ``max_by`` instead of a sort."""
    rest = [c for c in df.columns if c not in key]
    newest = F.max_by(F.struct(*[col(c) for c in rest]), F.struct(*[col(v) for v in version])).alias("_r")
    picked = df.groupBy(*[col(k) for k in key]).agg(newest)
    return picked.select(*[col(c) if c in key else F.col("_r").getField(c).alias(c) for c in df.columns])


def hash_key(seed: int, *columns: Column) -> Column:
    """Uniform, engine-independent hex key of a row: MD5 of the seed and the key columns."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[c.cast("string") for c in columns]))


def stratified_split(
    df: DataFrame,
    key: Sequence[str],
    strata: str | None,
    shares: Sequence[tuple[str, float]],
    rest: str,
    seed: int = 42,
    digits: int = 4,
    out: str = "split",
) -> DataFrame:
    """Random split with exact per-stratum counts: the first ``floor(share*n)`` rows by hash get each share's name.

    Rows are never ranked as a whole. Counts per (stratum, hash prefix) show in which prefix each cut falls; only the
    rows of those prefixes are ranked, which gives one cut hash per stratum and share. The table itself is then
    labelled by comparing hashes with its stratum's cuts: they are broadcast after a count, so rows are not shuffled
    unless there are millions of strata.
    """
    h = hash_key(seed, *[col(k) for k in key])
    stratum = (F.coalesce(col(strata).cast("string"), F.lit("\u0000")) if strata else F.lit("")).alias("_st")
    hashed = df.select(stratum, h.alias("_h")).withColumn("_p", F.substring("_h", 1, digits))
    per = hashed.groupBy("_st", "_p").agg(F.count(F.lit(1)).alias("_n"))
    run = W.partitionBy("_st").orderBy("_p").rowsBetween(W.unboundedPreceding, 0)
    per = per.withColumn("_hi", F.sum("_n").over(run)).withColumn("_tot", F.sum("_n").over(W.partitionBy("_st")))
    acc, cut_rows = 0.0, []
    for i, (_, share) in enumerate(shares):
        acc += share
        # A tiny amount is added so that 0.1 + 0.2 of 10 rows counts 3, not 2.
        cut_rows.append(F.struct(F.lit(i).alias("i"), F.floor(F.col("_tot") * F.lit(acc) + F.lit(1e-9)).alias("k")))
    bounds = per.withColumn("_c", F.explode(F.array(*cut_rows))).where(
        (F.col("_c.k") > F.col("_hi") - F.col("_n")) & (F.col("_c.k") <= F.col("_hi"))
    )
    bounds = bounds.select("_st", "_p", F.col("_c.i").alias("_i"), (F.col("_c.k") - (F.col("_hi") - F.col("_n"))).alias("_r"))
    ranked = hashed.join(bounds, ["_st", "_p"]).withColumn(
        "_rn", F.row_number().over(W.partitionBy("_st", "_p", "_i").orderBy("_h"))
    )
    cuts = (
        ranked.where(F.col("_rn") == F.col("_r"))
        .groupBy("_st")
        .agg(*[F.max(F.when(F.col("_i") == i, F.col("_h"))).alias(f"_cut{i}") for i in range(len(shares))])
        .withColumnRenamed("_st", "_cst")
    )
    name = F.when(F.lit(False), F.lit(rest))
    for i, (label, _) in enumerate(shares):
        name = name.when(F.col("_h") <= F.col(f"_cut{i}"), F.lit(label))
    return (
        df.withColumn("_h", h)
        .withColumn("_st", stratum)
        .join(broadcast_if_small(cuts, "cuts"), F.col("_st") == F.col("_cst"), "left")
        .withColumn(out, name.otherwise(F.lit(rest)))
        .drop("_h", "_st", "_cst", *[f"_cut{i}" for i in range(len(shares))])
    )


def split_train_val_test(df: DataFrame, key: Sequence[str], label: str, test: float = 0.2, val: float = 0.2, seed: int = 42, stratify: bool = True) -> DataFrame:
    """Label every row train, val or test with exact proportions per label. A stratum too small for a share simply
    gives that share no row, so no fallback to an unstratified split is needed."""
    if label not in df.columns:
        raise KeyError(f"missing label column: {label}")
    return stratified_split(df, key, label if stratify else None, [("test", test), ("val", val)], "train", seed)


def time_split(df: DataFrame, time: Column, key: Sequence[str], train: float = 0.64, val: float = 0.16, seed: int = 0, out: str = "split") -> DataFrame:
    """Time-ordered split at row counts ``int(n*train)`` and ``int(n*(train+val))``; equal times are ordered by hash.

    ``time`` is numeric. The cut times come from exact rank selection, the cut within one time from a second selection
    over the hashes of that time's rows; rows are then labelled by comparison with literals.
    """
    # 15 hex digits fit a long; doubles would lose the low bits, so the tie order is kept in two halves.
    digest = hash_key(seed, *[col(k) for k in key])
    base = df.select(time.cast("double").alias("t"), digest.alias("d"))
    n = base.count()
    ends = [int(n * train), int(n * (train + val))]
    wanted = sorted({e - 1 for e in ends if 0 < e <= n})
    times = select_ranks(base, "t", wanted, n) if wanted else {}

    def before(end: int) -> Column:
        if end <= 0:
            return F.lit(False)
        t = times[end - 1]
        below = base.where(F.col("t") < t).count()
        ties = base.where(F.col("t") == t)
        cut = _nth_hash(ties, "d", end - below)
        return (F.col("_t") < t) | ((F.col("_t") == t) & (F.col("_d") <= F.lit(cut)))

    return (
        df.withColumn("_t", time.cast("double"))
        .withColumn("_d", digest)
        .withColumn(out, F.when(before(ends[0]), "train").when(before(ends[1]), "val").otherwise("test"))
        .drop("_t", "_d")
    )


def _nth_hash(df: DataFrame, name: str, k: int, digits: int = 3, small: int = 10_000) -> str:
    """The k-th smallest (1-based) of a column of uniform hex digests, one prefix level per pass."""
    prefix, width = "", digits
    while True:
        inside = df.where(F.col(name).startswith(prefix)) if prefix else df
        counts = sorted((r[0], r[1]) for r in inside.groupBy(F.substring(name, 1, width)).count().collect())
        for p, n in counts:
            if k <= n:
                break
            k -= n
        prefix = p
        if n <= small or width >= 32:
            rows = sorted(r[0] for r in df.where(F.col(name).startswith(prefix)).select(name).collect()) if n <= small else [prefix]
            return rows[k - 1] if n <= small else prefix
        width += digits


def tail(df: DataFrame, ingest: Sequence[str], n: int) -> DataFrame:
    """The last ``n`` rows by ingest key, newest first."""
    return df.orderBy(*[col(c).desc() for c in ingest]).limit(n)


def head(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """The first ``n`` rows in a stated order; Spark tables have no order of their own."""
    return df.orderBy(*[col(c) for c in order]).limit(n)
