"""Threshold searches under an alert budget.

Each row is reduced to the cell of the threshold grid it falls into and the cells are counted in one aggregate. The
grid bounds the number of cells, so trying every combination works on that small table with suffix sums, however many
rows there are.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, functions as F

from netsieve.functions.guards import col, ge, nan_to_null
from netsieve.operators.mapping import unknown_label
from netsieve.operators.metrics import recall_and_alert_rates
from netsieve.operators.ranking import exact_quantiles

# The search grids.
SCORE_GRID = [float(t) for t in np.linspace(0.0, 1.0, 1001)]
P_GRID = [float(t) for t in np.linspace(0.05, 0.95, 19)]
SZD_GRID = [float(t) for t in np.linspace(50.0, 95.0, 10)]
OPEN_GRID = [float(t) for t in np.linspace(0.40, 0.95, 12)]
BLOCK_GRID = [float(t) for t in np.linspace(0.5, 0.999, 200)]
QUANTILES = [0.90, 0.93, 0.95, 0.97, 0.98, 0.99]
BUDGETS = [0.08, 0.10, 0.12, 0.15, 0.20, 0.25]


def grid_index(df: DataFrame, source: str, grid: Sequence[float], out: str) -> DataFrame:
    """Number of grid thresholds at or below the value (0 for a missing one), by binary search in the JVM."""
    df = df.withColumn("_g", F.coalesce(nan_to_null(col(source)), F.lit(float("-inf"))))
    cut = Bucketizer(splits=[float("-inf"), *grid, float("inf")], inputCol="_g", outputCol=out)
    return cut.transform(df).withColumn(out, F.col(out).cast("int")).drop("_g")


def _suffix(counts: np.ndarray) -> np.ndarray:
    """counts[i.., j.., ...] summed: rows at or above each cell in every direction."""
    for axis in range(counts.ndim):
        counts = np.flip(np.cumsum(np.flip(counts, axis), axis), axis)
    return counts


def _cells(df: DataFrame, flags: dict[str, Column], dims: list[tuple[str, str, Sequence[float]]]) -> dict[str, np.ndarray]:
    """Per flag, the number of rows per grid cell, as suffix sums. ``dims`` are (column, index name, grid)."""
    shape = tuple(len(g) + 1 for _, _, g in dims)
    for source, name, grid in dims:
        df = grid_index(df, source, grid, name)
    names = [name for _, name, _ in dims]
    rows = df.groupBy(*names).agg(*[F.count_if(f).alias(k) for k, f in flags.items()]).collect()
    out = {k: np.zeros(shape, dtype=np.int64) for k in flags}
    for r in rows:
        for k in flags:
            out[k][tuple(r[n] for n in names)] += r[k]
    return {k: _suffix(v) for k, v in out.items()}


def choose_thresholds(df: DataFrame, score: str, unknown: Column, budgets: Sequence[float]) -> list[dict]:
    """Per budget the highest unknown recall with the alert rate within it; the lowest threshold wins ties, and .5
    stands when none fits. The rows are counted once for all budgets."""
    work = df.select(col(score).cast("double").alias("s"), unknown.alias("u"))
    cells = _cells(work, {"all": F.lit(True), "unknown": F.col("u")}, [("s", "i", SCORE_GRID)])
    n, n_unknown = int(cells["all"][0]), int(cells["unknown"][0])
    out = []
    for budget in budgets:
        best, top = {"threshold": 0.5, "alert_rate": 1.0, "unknown_recall": 0.0}, -1.0
        for i, t in enumerate(SCORE_GRID):
            rate = cells["all"][i + 1] / n if n else float("nan")
            recall = cells["unknown"][i + 1] / max(n_unknown, 1)
            if not rate > budget and recall > top:
                top = recall
                best = {"threshold": t, "alert_rate": float(rate), "unknown_recall": float(recall)}
        out.append(best)
    return out


def choose_threshold(df: DataFrame, score: str, unknown: Column, max_alert_rate: float) -> dict:
    return choose_thresholds(df, score, unknown, [max_alert_rate])[0]


def choose_budget_thresholds(
    df: DataFrame,
    label: str,
    known_labels: Sequence[str],
    max_alert_rate: float = 0.10,
    p_attack: str = "p_attack",
    szd: str = "suspected_zero_day_pct",
    open_set: str = "open_set_ood_score",
) -> dict:
    """Best alert rule over attack probability, zero-day score and (if present) open-set score.

    Combinations are tried by probability, then zero-day threshold, then rule: both, probability alone, probability
    with either signal. Only a strictly better recall replaces the choice.
    """
    known = [k.strip() for k in known_labels if k.strip()]
    if not known:
        raise ValueError("name at least one known label")
    has_open = open_set in df.columns
    work = df.select(
        col(p_attack).cast("double").alias("p"), col(szd).cast("double").alias("z"),
        *([col(open_set).cast("double").alias("o")] if has_open else []),
        unknown_label(col(label), known).alias("u"),
    )
    dims = [("p", "pi", P_GRID), ("z", "zi", SZD_GRID), *([("o", "oi", OPEN_GRID)] if has_open else [])]
    cells = _cells(work, {"all": F.lit(True), "unknown": F.col("u")}, dims)
    if not has_open:
        cells = {k: v[..., None] for k, v in cells.items()}
    n, n_unknown = int(cells["all"][0, 0, 0]), int(cells["unknown"][0, 0, 0])
    best: dict | None = None

    def consider(mode: str, p: float, z: float | None, o: float | None, alert: int, hit: int) -> None:
        nonlocal best
        rate, recall = alert / n, hit / max(n_unknown, 1)
        if rate <= max_alert_rate and (best is None or recall > best["unknown_recall"]):
            best = {
                "mode": mode, "p_attack_threshold": p, "szd_threshold": z, "open_set_threshold": o,
                "unknown_recall": float(recall), "alert_rate": float(rate),
            }

    a, u = cells["all"], cells["unknown"]
    for i, p in enumerate(P_GRID, 1):
        if not n:
            break
        for j, z in enumerate(SZD_GRID, 1):
            consider("p_attack_and_szd", p, z, None, a[i, j, 0], u[i, j, 0])
            consider("p_attack_only", p, None, None, a[i, 0, 0], u[i, 0, 0])
            for m, o in enumerate(OPEN_GRID if has_open else [], 1):
                either = lambda c: c[i, j, 0] + c[i, 0, m] - c[i, j, m]
                consider("p_attack_and_szd_or_open_set", p, z, o, either(a), either(u))
    if best is None:
        raise ValueError("no threshold combination keeps the alert rate within the budget")
    return {"rows": n, "unknown_rows": n_unknown, "max_alert_rate": float(max_alert_rate), "recommendation": best}


def choose_block_threshold(
    df: DataFrame, label: str, benign_label: str = "BENIGN", max_fpr: float = 0.01,
    pred: str = "prediction", proba: str = "proba_max", pick: str = "largest",
) -> dict:
    """Blocking threshold whose share of benign rows that would be blocked stays within ``max_fpr``.

    ``pick="largest"`` returns the largest qualifying threshold, as existing deployments expect; ``"smallest"`` the
    least strict one that still qualifies. Without a qualifying one it is .99.
    """
    benign = df.where(F.trim(col(label).cast("string")) == benign_label)
    attack = F.coalesce(F.trim(col(pred).cast("string")) != benign_label, F.lit(True))
    work = benign.select(col(proba).cast("double").alias("s"), attack.alias("a"))
    cells = _cells(work, {"all": F.lit(True), "attack": F.col("a")}, [("s", "i", BLOCK_GRID)])
    n = int(cells["all"][0])
    if n == 0:
        raise ValueError("no benign rows to estimate the false-positive rate on")
    fits = [t for i, t in enumerate(BLOCK_GRID) if cells["attack"][i + 1] / n <= max_fpr]
    chosen = 0.99 if not fits else (fits[-1] if pick == "largest" else fits[0])
    return {"block_min_proba": chosen, "target_max_benign_fpr": float(max_fpr), "benign_rows": n}


GATE_SCORES = ["open_set_ood_score", "suspected_zero_day_pct", "anomaly_score"]


def gate_flag(thresholds: dict[str, float | None]) -> Column:
    """True when any gated score reaches its threshold."""
    flag = F.lit(False)
    for name, t in thresholds.items():
        if t is not None:
            flag = flag | ge(col(name), F.lit(float(t)))
    return flag


def adaptive_gates(df: DataFrame, unknown: Column, q: float = 0.97, scores: Sequence[str] = GATE_SCORES) -> dict[str, float | None]:
    """Per-score thresholds: the q-quantile over known rows."""
    names = [s for s in scores if s in df.columns]
    got = exact_quantiles(df.where(~unknown), names, [q], stage=True)
    return {s: got[s][0] for s in names}


def adaptive_decisions(df: DataFrame, thresholds: dict[str, float | None], decision: str = "decision_label") -> DataFrame:
    """Override the decision to AttackUncertain wherever a gate is hit."""
    return df.withColumn(
        "adaptive_decision", F.when(gate_flag(thresholds), F.lit("AttackUncertain")).otherwise(col(decision))
    )


def adaptive_candidates(df: DataFrame, unknown: Column, quantiles: Sequence[float] = QUANTILES, scores: Sequence[str] = GATE_SCORES) -> list[dict]:
    """Rates of the gates at several quantiles; all quantiles and all flags are evaluated together."""
    names = [s for s in scores if s in df.columns]
    got = exact_quantiles(df.where(~unknown), names, list(quantiles), stage=True)
    gates = [{s: got[s][i] for s in names} for i in range(len(quantiles))]
    marked = df.select(unknown.alias("_u"), *[gate_flag(g).alias(f"_f{i}") for i, g in enumerate(gates)])
    aggs = [F.count(F.lit(1)).alias("n"), F.count_if("_u").alias("nu")]
    for i in range(len(gates)):
        aggs += [F.count_if(f"_f{i}").alias(f"a{i}"), F.count_if(F.col(f"_f{i}") & F.col("_u")).alias(f"h{i}")]
    r = marked.agg(*aggs).first()
    return [
        {
            "method": "adaptive", "quantile": q, "thresholds": gates[i],
            "unknown_recall": r[f"h{i}"] / max(r["nu"], 1),
            "alert_rate": r[f"a{i}"] / max(r["n"], 1),
            "known_alert_rate": (r[f"a{i}"] - r[f"h{i}"]) / max(r["n"] - r["nu"], 1),
        }
        for i, q in enumerate(quantiles)
    ]


def pick_best(candidates: Sequence[dict], max_known_alert: float, max_alert: float) -> dict:
    """Best unknown recall among candidates within both limits; the best overall when none is."""
    fits = [c for c in candidates if c["known_alert_rate"] <= max_known_alert and c["alert_rate"] <= max_alert]
    return max(fits or candidates, key=lambda c: c["unknown_recall"])


def tune_profiles(df: DataFrame, unknown: Column, extra: Sequence[dict] = ()) -> dict:
    """Balanced and high-recall profiles from the adaptive candidates and any further ones."""
    candidates = [*adaptive_candidates(df, unknown), *extra]
    return {
        "balanced_profile": pick_best(candidates, 0.08, 0.20),
        "high_recall_profile": pick_best(candidates, 0.12, 0.26),
        "all_candidates": candidates,
    }


def flag_rates(df: DataFrame, flag: str, unknown: Column) -> DataFrame:
    return recall_and_alert_rates(df, col(flag), unknown)
