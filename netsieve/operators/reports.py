"""Operational reports, quality gates and comparisons of runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from netsieve.functions.guards import col, ratio
from netsieve.operators.metrics import classification_report
from netsieve.operators.policy import tenant_scope
from netsieve.operators.triage import ATTACK_UNCERTAIN


def merge_scores(left: DataFrame, right: DataFrame, key: Sequence[str], prefix: str = "anomaly_") -> DataFrame:
    """Join two score tables of the same rows by key; right-hand columns get the prefix.

    Row tables have no position in Spark, so the key replaces it. A key that one side lacks, or that a side has twice,
    stops the job. The repeats are counted in the partitions the join needs anyway.
    """
    times = F.count(F.lit(1)).over(W.partitionBy(*[col(k) for k in key]))
    l = left.withColumn("_l", times)
    r = right.select(*[col(k) for k in key], *[col(c).alias(prefix + c) for c in right.columns if c not in key]).withColumn("_r", times)
    joined = l.join(r, list(key), "full_outer")
    fault = F.when(F.col("_l").isNull() | F.col("_r").isNull(), F.lit("row in only one of the score tables: ")).when(
        (F.col("_l") > 1) | (F.col("_r") > 1), F.lit("key repeated in a score table: ")
    )
    error = F.raise_error(F.concat(fault, F.concat_ws(",", *[col(k).cast("string") for k in key])))
    # The check is part of the filter, so column pruning cannot remove it.
    return joined.where(F.when(fault.isNotNull(), error.cast("boolean")).otherwise(F.lit(True))).drop("_l", "_r")


def shadow_report(pred: DataFrame, analyst: DataFrame, case_id: str = "case_id", pred_col: str = "decision_label", analyst_col: str = "analyst_label") -> DataFrame:
    """Classification report of predictions against analyst labels of the same cases."""
    for df, need in ((pred, [case_id, pred_col]), (analyst, [case_id, analyst_col])):
        gone = [c for c in need if c not in df.columns]
        if gone:
            raise ValueError(f"missing columns {gone}")
    both = pred.select(col(case_id), col(pred_col).alias("_p")).join(analyst.select(col(case_id), col(analyst_col).alias("_y")), case_id)
    return classification_report(both, "_y", "_p")


def stream_jobs(jobs: DataFrame, artifacts: DataFrame, role: str, tenant_id: int | None, limit: int = 50) -> DataFrame:
    """Newest stream jobs with their artifact paths, where there are any. The limit is taken before the join."""
    seen = jobs.where((F.col("job_type") == "stream_collect") & tenant_scope(role, tenant_id, F.col("tenant_id")))
    newest = seen.orderBy(F.col("id").desc()).limit(limit)
    return newest.join(artifacts, newest["id"] == artifacts["job_id"], "left").drop("job_id")


def detection_runs(history: DataFrame, role: str, tenant_id: int | None, limit: int = 100) -> DataFrame:
    return history.where(tenant_scope(role, tenant_id, F.col("tenant_id"))).orderBy(F.col("id").desc()).limit(limit)


def recent_scored(events: DataFrame, role: str, tenant_id: int | None, limit: int = 50, preview: int = 400) -> DataFrame:
    newest = events.where(tenant_scope(role, tenant_id, F.col("tenant_id"))).orderBy(F.col("id").desc()).limit(limit)
    return newest.withColumn("raw_json_preview", F.substring("raw_json", 1, preview)).drop("raw_json")


def compare_runs(a: DataFrame, b: DataFrame, label: str = "decision_label") -> DataFrame:
    """Counts per label of two runs side by side; a label only one run has counts 0 in the other."""
    ca = a.groupBy(col(label).cast("string").alias("label")).agg(F.count(F.lit(1)).alias("n_a"))
    cb = b.groupBy(col(label).cast("string").alias("label")).agg(F.count(F.lit(1)).alias("n_b"))
    return ca.join(cb, "label", "full_outer").select(
        "label", F.coalesce("n_a", F.lit(0)).alias("n_a"), F.coalesce("n_b", F.lit(0)).alias("n_b")
    )


def operational_health(df: DataFrame, decision: str = "decision_label", max_rate: float = 0.25) -> DataFrame:
    if decision not in df.columns:
        raise ValueError(f"missing decision column: {decision}")
    uncertain = F.count_if(col(decision) == ATTACK_UNCERTAIN)
    share = ratio(uncertain, F.count(F.lit(1)))
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"), uncertain.alias("n_uncertain"), share.alias("attack_uncertain_rate"),
        (share <= F.lit(float(max_rate))).alias("healthy"),
    )


# Case states that count as closed.
CLOSED = ["resolved", "closed"]


def ops_summary(alerts: DataFrame, cases: DataFrame, jobs: DataFrame, role: str, tenant_id: int | None) -> DataFrame:
    """One row: alerts, cases, open cases and the newest stream job."""
    scope = tenant_scope(role, tenant_id, F.col("tenant_id"))
    n_alerts = alerts.where(scope).agg(F.count(F.lit(1))).scalar()
    job = jobs.where(scope & (F.col("job_type") == "stream_collect")).agg(
        F.max(F.struct("id", "status", F.when(F.col("status") == "completed", F.col("risk_level")).alias("risk_level")))
    ).scalar()
    return cases.where(scope).agg(
        F.count(F.lit(1)).alias("cases_total"), F.count_if(~F.col("status").isin(CLOSED)).alias("cases_open")
    ).select(
        n_alerts.alias("alerts_total"), "cases_total", "cases_open",
        job.getField("id").alias("last_job_id"), job.getField("status").alias("last_job_status"),
        job.getField("risk_level").alias("last_job_risk_level"),
    )


def model_deltas(base: DataFrame, boost: DataFrame) -> DataFrame:
    """Differences of two one-row metric tables (``macro_f1``, ``accuracy``)."""
    b = boost.agg(F.struct(F.max("macro_f1").alias("f"), F.max("accuracy").alias("a"))).scalar()
    f, a = b.getField("f"), b.getField("a")
    return base.select(
        F.col("macro_f1").alias("base_macro_f1"), f.alias("boost_macro_f1"), (f - F.col("macro_f1")).alias("delta_macro_f1"),
        F.col("accuracy").alias("base_accuracy"), a.alias("boost_accuracy"), (a - F.col("accuracy")).alias("delta_accuracy"),
    )


def _metric(name: str, default: float) -> Column:
    return F.coalesce(F.max(F.when(F.col("metric") == name, F.col("value"))), F.lit(float(default)))


def worst_rare_f1(rare: Sequence[str], boost_report: DataFrame | None, baseline_report: DataFrame) -> Column:
    """Lowest F1 of the rare classes, from the boosted model's report or else the baseline's ten weakest classes.

    Scalar subqueries; 1.0 when neither names any of them.
    """
    listed = F.col("label").isin(list(rare))
    weakest = baseline_report.where(F.col("kind") == "class").orderBy(F.col("f1").asc(), F.col("label").asc()).limit(10)
    options = [weakest.where(listed).agg(F.min("f1")).scalar(), F.lit(1.0)]
    if boost_report is not None:
        options.insert(0, boost_report.where((F.col("kind") == "class") & listed).agg(F.min("f1")).scalar())
    return F.coalesce(*options)


def kpi_gate(metrics: DataFrame, policy: dict, worst_rare: Column | None = None) -> DataFrame:
    """The five quality checks. ``metrics`` is a (metric, value) table; one it lacks takes its default.

    The table holds one row per check with the limit, the value, whether it passes and whether all five do.
    """
    m = metrics.agg(
        _metric("boost_macro_f1", 0.0).alias("macro_f1"),
        F.greatest(
            _metric("adaptive_unknown_recall_attack_uncertain", 0.0), _metric("calibrator_unknown_recall", 0.0)
        ).alias("external_unknown_recall"),
        _metric("calibrator_known_alert_rate", 1.0).alias("known_alert_rate"),
        _metric("calibrator_alert_rate", 1.0).alias("external_alert_rate"),
    ).withColumn("worst_rare_f1", worst_rare if worst_rare is not None else F.lit(1.0))
    # Check, policy field, its default, and whether the limit is a floor.
    checks = [
        ("macro_f1", "macro_f1_min", 0.0, True),
        ("worst_rare_f1", "rare_class_f1_min", 0.0, True),
        ("external_unknown_recall", "unknown_recall_external_min", 0.0, True),
        ("known_alert_rate", "known_alert_rate_max", 1.0, False),
        ("external_alert_rate", "max_alert_rate_external", 1.0, False),
    ]
    rows = []
    for name, key, default, floor in checks:
        limit = F.lit(float(policy.get(key, default)))
        ok = F.col(name) >= limit if floor else F.col(name) <= limit
        rows.append(F.struct(F.lit(name).alias("check"), F.col(name).alias("actual"), limit.alias("limit"), ok.alias("passed")))
    every = F.aggregate(F.col("rows"), F.lit(True), lambda s, x: s & x["passed"])
    return m.select(F.array(*rows).alias("rows")).select(F.explode("rows").alias("r"), every.alias("gate_passed")).select("r.*", "gate_passed")


def scorecard_score(metrics: DataFrame) -> DataFrame:
    """Improvement points out of 11 from a (metric, value) table."""
    default_recall = _metric("unknown_recall_attack_uncertain", 0.0)
    points = (
        F.when(_metric("delta_macro_f1", 0.0) > 0, 4.0).otherwise(0.0)
        + F.when(_metric("holdout_thresholds_selected", 0.0) > 0, 3.0).otherwise(0.0)
        + F.when(default_recall > 0.1, 3.0).otherwise(0.0)
        + F.when(_metric("calibrator_unknown_recall", 0.0) > F.greatest(F.lit(0.1), default_recall), 1.0).otherwise(0.0)
    )
    return metrics.agg(points.alias("overall_improvement_score"))


def quality_report(metrics: DataFrame) -> DataFrame:
    """Before/after summary with the strategy of the better unknown recall (adaptive gates win ties)."""
    m = metrics.agg(
        _metric("base_macro_f1", 0.0).alias("macro_f1_before"), _metric("boost_macro_f1", 0.0).alias("macro_f1_after"),
        _metric("unknown_recall_attack_uncertain", 0.0).alias("unknown_recall_default"),
        _metric("adaptive_unknown_recall_attack_uncertain", 0.0).alias("unknown_recall_adaptive"),
        _metric("calibrator_unknown_recall", 0.0).alias("unknown_recall_calibrator"),
        _metric("calibrator_known_alert_rate", 0.0).alias("_cal"), _metric("adaptive_known_alert_rate", 0.0).alias("_ada"),
    )
    adaptive = F.col("unknown_recall_adaptive") >= F.col("unknown_recall_calibrator")
    return m.select(
        "macro_f1_before", "macro_f1_after", (F.col("macro_f1_after") - F.col("macro_f1_before")).alias("macro_f1_delta"),
        "unknown_recall_default", "unknown_recall_adaptive", "unknown_recall_calibrator",
        F.greatest("unknown_recall_adaptive", "unknown_recall_calibrator").alias("selected_unknown_recall"),
        F.when(adaptive, F.lit("adaptive_gates")).otherwise(F.lit("novelty_calibrator")).alias("selected_unknown_strategy"),
        F.when(adaptive, F.col("_ada")).otherwise(F.col("_cal")).alias("known_alert_rate_selected"),
    )


def metric_rows(row: DataFrame, names: dict[str, str]) -> DataFrame:
    """Turn columns of a one-row table into (metric, value) rows."""
    cells = [F.struct(F.lit(metric).alias("metric"), col(c).cast("double").alias("value")) for c, metric in names.items()]
    return row.select(F.explode(F.array(*cells)).alias("r")).select("r.*")
