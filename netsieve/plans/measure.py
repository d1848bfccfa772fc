"""Metric, drift, search, gate and report queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from netsieve.functions.guards import col
from netsieve.models.novelty import detect_attack_uncertain, detect_novel
from netsieve.operators import drift, metrics as me, ranking as rk, reports as rp, search as se
from netsieve.operators.mapping import unknown_label
from netsieve.plans.registry import query
from netsieve.plans.views import (
    ALERTS, CASES, EVENT_DECISIONS, FLOWS, JOBS, TO_FUSED, TO_OPEN, TO_UNCERTAIN, alert_table, case_table, contract,
    detector, event_decisions, flows, fused, job_table, table, with_,
)


def scored(spark: SparkSession, sf: str) -> DataFrame:
    return detect_novel(contract(spark, sf), detector(spark, sf))


def triaged(spark: SparkSession, sf: str) -> DataFrame:
    return detect_attack_uncertain(contract(spark, sf), detector(spark, sf), open_set=True)


def r6(*names: str) -> list:
    return [F.round(n, 6).alias(n) for n in names]


# ---- classification ------------------------------------------------------------------------------------------

CM = "cm AS (SELECT label AS y, supervised_prediction AS p, count(*) AS n FROM uncertain GROUP BY ALL)"
CLASSES = """labels_all AS (SELECT y AS label FROM cm UNION SELECT p FROM cm),
per AS (SELECT label, (SELECT coalesce(sum(n), 0) FROM cm WHERE y = label AND p = label) AS tp,
  (SELECT coalesce(sum(n), 0) FROM cm WHERE y = label) AS support, (SELECT coalesce(sum(n), 0) FROM cm WHERE p = label) AS predicted FROM labels_all),
cls AS (SELECT label, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0 END AS precision, CASE WHEN support > 0 THEN tp / support ELSE 0 END AS recall,
  CASE WHEN support + predicted > 0 THEN 2.0 * tp / (support + predicted) ELSE 0 END AS f1, CAST(support AS BIGINT) AS support, tp FROM per)"""
REPORT = """SELECT 'class' AS kind, label, round(precision::DOUBLE, 6) AS precision, round(recall::DOUBLE, 6) AS recall, round(f1::DOUBLE, 6) AS f1, support FROM cls
UNION ALL SELECT 'average', 'accuracy', round((sum(tp) / sum(support))::DOUBLE, 6), round((sum(tp) / sum(support))::DOUBLE, 6), round((sum(tp) / sum(support))::DOUBLE, 6), CAST(sum(support) AS BIGINT) FROM cls
UNION ALL SELECT 'average', 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), CAST(sum(support) AS BIGINT) FROM cls
UNION ALL SELECT 'average', 'weighted avg', round((sum(precision * support) / sum(support))::DOUBLE, 6), round((sum(recall * support) / sum(support))::DOUBLE, 6), round((sum(f1 * support) / sum(support))::DOUBLE, 6), CAST(sum(support) AS BIGINT) FROM cls"""


@query("a3_classification_report", with_(*TO_UNCERTAIN, CM, CLASSES, select=REPORT))
def a3(spark: SparkSession, sf: str) -> DataFrame:
    rep = me.classification_report(scored(spark, sf), "label", "supervised_prediction")
    return rep.select("kind", "label", *r6("precision", "recall", "f1"), "support")


@query("a4_confusion_matrix", with_(*TO_UNCERTAIN, CM, select="SELECT y, p, n FROM cm"))
def a4(spark: SparkSession, sf: str) -> DataFrame:
    return me.confusion(scored(spark, sf), "label", "supervised_prediction")


@query("t1_lowest_f1", with_("cm AS (SELECT source AS y, CASE WHEN doc_id % 3 = 0 THEN 'src0' ELSE source END AS p, count(*) AS n FROM documents GROUP BY ALL)", CLASSES, select="SELECT label, round(f1::DOUBLE, 6) AS f1, support FROM cls ORDER BY cls.f1, support, label LIMIT 15"))
def t1(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("source", F.when(F.col("doc_id") % 3 == 0, F.lit("src0")).otherwise(F.col("source")).alias("guess"))
    out = me.lowest_f1(me.classification_report(docs, "source", "guess"), 15, by_support=True)
    return out.select("label", *r6("f1"), "support")


CURVE = """g AS (SELECT score, count(*) FILTER (WHERE positive) AS pos, count(*) FILTER (WHERE NOT positive) AS neg FROM sc GROUP BY score),
cu AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, lead(pos) OVER o AS npos, lead(neg) OVER o AS nneg, row_number() OVER o AS rn
  FROM g WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING), o AS (ORDER BY score DESC)),
tot AS (SELECT sum(pos) AS p, sum(neg) AS n FROM g),
auc AS (SELECT round((sum(neg * (tp - pos / 2.0)) / (max(p) * max(n)))::DOUBLE, 6) AS roc_auc, round((sum(pos * (tp / (tp + fp))) / max(p))::DOUBLE, 6) AS pr_auc FROM cu, tot)"""
PICK = """targets AS (SELECT unnest([0.001, 0.01, 0.05])::DOUBLE AS target_fpr),
kept AS (SELECT score, tp / p AS tpr, fp / n AS fpr, rn FROM cu, tot WHERE rn = 1 OR npos IS NULL OR npos <> pos OR nneg <> neg
  UNION ALL SELECT 'inf'::DOUBLE, 0, 0, 0),
last AS (SELECT target_fpr, max(rn) AS rn FROM targets JOIN kept ON fpr <= target_fpr GROUP BY target_fpr)"""


@query(
    "a5_binary_curves",
    with_(*TO_UNCERTAIN, "sc AS (SELECT round(p_attack, 9) AS score, label <> 'Benign' AS positive FROM uncertain)", CURVE, PICK,
          select="SELECT roc_auc, pr_auc, target_fpr, round(score, 6) AS threshold, round(tpr::DOUBLE, 6) AS tpr, round(fpr::DOUBLE, 6) AS fpr FROM last JOIN kept USING (rn), auc"),
)
def a5(spark: SparkSession, sf: str) -> DataFrame:
    s = triaged(spark, sf).select("label", F.round("p_attack", 9).alias("score"))
    out = me.binary_curves(s, "label", "score", "Benign")
    return out.select(*r6("roc_auc", "pr_auc"), "target_fpr", *r6("threshold", "tpr", "fpr"))


@query(
    "w4_curve_points",
    with_("sc AS (SELECT value AS score, event_type = 'error' AS positive FROM events)", CURVE, select="SELECT score, pos, neg, CAST(tp AS BIGINT) AS cum_pos, CAST(fp AS BIGINT) AS cum_neg, npos AS next_pos, nneg AS next_neg FROM cu"),
)
def w4(spark: SparkSession, sf: str) -> DataFrame:
    return me.curve_points(table(spark, sf, "events"), F.col("event_type") == "error", "value")


@query(
    "a6_anomaly_evaluation",
    with_(*TO_UNCERTAIN, "sc AS (SELECT round(anomaly_score, 9) AS score, label <> 'Benign' AS positive FROM uncertain)", CURVE,
          """c AS (SELECT count(*) AS n_rows, count(*) FILTER (WHERE label = 'Benign') AS nb, count(*) FILTER (WHERE label <> 'Benign') AS na,
          count(*) FILTER (WHERE label = 'Benign' AND anomaly_score > thr) AS fp, count(*) FILTER (WHERE label <> 'Benign' AND anomaly_score > thr) AS tp FROM uncertain)""",
          select="""SELECT n_rows, nb AS n_benign_gt, na AS n_attack_gt, nb - fp AS tn, fp, na - tp AS fn, tp, round(fp / greatest(nb, 1), 6) AS fpr, round(tp / greatest(na, 1), 6) AS tpr,
          round(tp / (tp + fp), 6) AS precision_attack, round(2.0 * tp / (2 * tp + fp + na - tp), 6)::DOUBLE AS f1_attack, roc_auc AS roc_auc_score, round((tp + fp) / n_rows * 10000.0, 4) AS alerts_per_10k_rows FROM c, auc"""),
)
def a6(spark: SparkSession, sf: str) -> DataFrame:
    s = scored(spark, sf).select("label", "anomaly_score")
    d = detector(spark, sf)
    out = me.anomaly_evaluation(s.withColumn("rounded", F.round("anomaly_score", 9)), "label", "rounded", d.threshold)
    return out.select(
        "n_rows", "n_benign_gt", "n_attack_gt", "tn", "fp", "fn", "tp", F.round("false_positive_rate_benign", 6).alias("fpr"),
        F.round("true_positive_rate_attack", 6).alias("tpr"), *r6("precision_attack", "f1_attack", "roc_auc_score"),
        F.round("alerts_per_10k_rows", 4).alias("alerts_per_10k_rows"),
    )


@query(
    "a7_class_balance",
    "WITH c AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1) SELECT CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_classes, (SELECT event_type FROM c ORDER BY n DESC, event_type LIMIT 1) AS majority_class, max(n) AS majority_count, round(max(n) / min(n), 6) AS max_min_ratio FROM c",
)
def a7(spark: SparkSession, sf: str) -> DataFrame:
    out = me.class_balance(table(spark, sf, "events"), "event_type")
    return out.select("n_rows", "n_classes", "majority_class", "majority_count", *r6("max_min_ratio"))


# ---- drift ---------------------------------------------------------------------------------------------------

DRIFT_COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]
DRIFT = "d AS (" + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", avg({c}) FILTER (WHERE l_returnflag = 'N') AS ref_mean, stddev_pop({c}) FILTER (WHERE l_returnflag = 'N') AS ref_std,
    avg({c}) FILTER (WHERE l_returnflag <> 'N') AS sample_mean, stddev_pop({c}) FILTER (WHERE l_returnflag <> 'N') AS sample_std FROM lineitem""" for c in DRIFT_COLUMNS
) + """), shift AS (SELECT *, abs(sample_mean - ref_mean) / CASE WHEN abs(ref_mean) > 1e-12 THEN abs(ref_mean) ELSE 1 END AS s FROM d)"""


def _drift_sides(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    li = table(spark, sf, "lineitem")
    return li.where(F.col("l_returnflag") == "N"), li.where(F.col("l_returnflag") != "N")


@query("a8_numeric_drift", with_(DRIFT, select='SELECT "column", round(ref_mean, 4) AS ref_mean, round(ref_std, 4) AS ref_std, round(sample_mean, 4) AS sample_mean, round(sample_std, 4) AS sample_std, round(s, 6) AS abs_mean_shift_ratio FROM shift'))
def a8(spark: SparkSession, sf: str) -> DataFrame:
    ref, smp = _drift_sides(spark, sf)
    out = drift.numeric_drift(ref, smp, DRIFT_COLUMNS)
    return out.select("column", *[F.round(c, 4).alias(c) for c in ("ref_mean", "ref_std", "sample_mean", "sample_std")], *r6("abs_mean_shift_ratio"))


@query(
    "a9_drift_report",
    with_(DRIFT, "r AS (SELECT *, row_number() OVER (ORDER BY s DESC, \"column\") AS rn, count(*) OVER () AS column_count FROM shift)", select='SELECT "column", round(s, 6) AS abs_mean_shift_ratio, column_count, rn <= 3 AS in_top FROM r'),
)
def a9(spark: SparkSession, sf: str) -> DataFrame:
    ref, smp = _drift_sides(spark, sf)
    return drift.drift_report(ref, smp, DRIFT_COLUMNS, 3).select("column", *r6("abs_mean_shift_ratio"), "column_count", "in_top")


# ---- health, percentiles, weights ----------------------------------------------------------------------------


@query(
    "a10_operational_health",
    with_(*TO_FUSED, select="SELECT count(*) AS n_rows, count(*) FILTER (WHERE decision_label = 'AttackUncertain') AS n_uncertain, round(count(*) FILTER (WHERE decision_label = 'AttackUncertain') / count(*), 6) AS attack_uncertain_rate, count(*) FILTER (WHERE decision_label = 'AttackUncertain') / count(*) <= 0.25 AS healthy FROM fused"),
)
def a10(spark: SparkSession, sf: str) -> DataFrame:
    return rp.operational_health(fused(spark, sf)).select("n_rows", "n_uncertain", *r6("attack_uncertain_rate"), "healthy")


def one_row(spark: SparkSession, values: dict) -> DataFrame:
    """Numbers computed by a search or fit as a one-row table."""
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])


@query(
    "a12_run_percentiles",
    with_(*TO_UNCERTAIN, select="SELECT round(quantile_cont(anomaly_score, 0.5), 6) AS score_p50, round(quantile_cont(anomaly_score, 0.99), 6) AS score_p99, round(quantile_cont(max_class_probability, 0.5), 6) AS proba_max_p50, round(quantile_cont(suspected_zero_day_pct, 0.5), 6) AS szd_median FROM uncertain"),
)
def a12(spark: SparkSession, sf: str) -> DataFrame:
    wanted = [
        ("score_p50", "anomaly_score", 50), ("score_p99", "anomaly_score", 99), ("proba_max_p50", "max_class_probability", 50),
        ("szd_median", "suspected_zero_day_pct", 50), ("skipped", "no_such_column", 50),
    ]
    got = me.run_percentiles(scored(spark, sf), wanted)
    return one_row(spark, got).select(*r6(*got))


@query("a13_benign_threshold", with_(FLOWS, select="SELECT round(quantile_cont(orig_bytes, 0.99), 6) AS threshold FROM flows WHERE label = 'Benign'"))
def a13(spark: SparkSession, sf: str) -> DataFrame:
    benign = flows(spark, sf).where(F.col("label") == "Benign")
    return one_row(spark, {"threshold": me.benign_threshold(benign, "orig_bytes")}).select(*r6("threshold"))


@query(
    "a16_class_weights",
    """WITH c AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1), t AS (SELECT sum(n) AS total, count(*) AS k FROM c),
    b AS (SELECT event_type, n, total / (k * n) AS balanced FROM c, t), m AS (SELECT sum(n * sqrt(balanced)) / sum(n) AS mean FROM b)
    SELECT event_id, round(balanced, 6) AS balanced, round(sqrt(balanced) / mean, 6) AS rare FROM events JOIN b USING (event_type), m""",
)
def a16(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select("event_id", "event_type")
    both = me.with_class_weight(me.with_class_weight(rows, "event_type", None, "balanced"), "event_type", 0.5, "rare")
    return both.select("event_id", *r6("balanced", "rare"))


# ---- gates and searches --------------------------------------------------------------------------------------

KNOWN = ["Benign", "DoS"]
GATES = """kn AS (SELECT quantile_cont(open_set_ood_score, 0.97) AS o, quantile_cont(suspected_zero_day_pct, 0.97) AS s, quantile_cont(anomaly_score, 0.97) AS a FROM fused WHERE label IN ('Benign', 'DoS')),
ad AS (SELECT label NOT IN ('Benign', 'DoS') AS u, CASE WHEN open_set_ood_score >= o OR suspected_zero_day_pct >= s OR anomaly_score >= a THEN 'AttackUncertain' ELSE decision_label END AS d FROM fused, kn)"""


@query(
    "a14_adaptive_gates",
    with_(*TO_FUSED, GATES, select="""SELECT round(max(o), 6) AS open_set_threshold, round(max(s), 6) AS szd_threshold, round(max(a), 6) AS anomaly_threshold,
    round(count(*) FILTER (WHERE d = 'AttackUncertain' AND u) / greatest(count(*) FILTER (WHERE u), 1), 6) AS unknown_recall,
    round(count(*) FILTER (WHERE d = 'AttackUncertain') / count(*), 6) AS alert_rate,
    round(count(*) FILTER (WHERE d = 'AttackUncertain' AND NOT u) / greatest(count(*) FILTER (WHERE NOT u), 1), 6) AS known_alert_rate FROM ad, kn"""),
)
def a14(spark: SparkSession, sf: str) -> DataFrame:
    f = fused(spark, sf)
    unknown = unknown_label(F.col("label"), KNOWN, trim=False)
    t = se.adaptive_gates(f, unknown)
    out = se.adaptive_decisions(f, t)
    rates = me.recall_and_alert_rates(out, F.col("adaptive_decision") == "AttackUncertain", unknown)
    cut = lambda k, name: F.round(F.lit(t[k]), 6).alias(name)
    return rates.select(
        cut("open_set_ood_score", "open_set_threshold"), cut("suspected_zero_day_pct", "szd_threshold"), cut("anomaly_score", "anomaly_threshold"),
        *r6("unknown_recall", "alert_rate", "known_alert_rate"),
    )


@query(
    "a15_flag_rates",
    with_(*TO_UNCERTAIN, select="""SELECT round(count(*) FILTER (WHERE is_novel_flagged AND label = 'PortScan') / greatest(count(*) FILTER (WHERE label = 'PortScan'), 1), 6) AS unknown_recall,
    round(count(*) FILTER (WHERE is_novel_flagged) / count(*), 6) AS alert_rate,
    round(count(*) FILTER (WHERE is_novel_flagged AND label <> 'PortScan') / greatest(count(*) FILTER (WHERE label <> 'PortScan'), 1), 6) AS known_alert_rate FROM uncertain"""),
)
def a15(spark: SparkSession, sf: str) -> DataFrame:
    out = se.flag_rates(scored(spark, sf), "is_novel_flagged", unknown_label(F.col("label"), KNOWN))
    return out.select(*r6(*out.columns))


@query(
    "m11a_choose_threshold",
    with_(*TO_UNCERTAIN, """grid AS (SELECT i, i * 0.001::DOUBLE AS t FROM range(1001) g(i)),
    n AS (SELECT round(p_attack, 6) AS s, label = 'PortScan' AS u, count(*) AS k FROM uncertain GROUP BY ALL),
    b AS (SELECT n.*, CAST(floor(s * 1000.0) AS BIGINT) + d AS j FROM n, (SELECT unnest([-1, 0, 1]) AS d)),
    located AS (SELECT s, u, k, max(i) AS i FROM b JOIN grid ON i = j AND t <= s GROUP BY ALL),
    cell AS (SELECT i, sum(k) AS a, sum(CASE WHEN u THEN k ELSE 0 END) AS h FROM located GROUP BY i),
    suf AS (SELECT g.i, g.t, coalesce(sum(cell.a), 0) AS a, coalesce(sum(cell.h), 0) AS h FROM grid g LEFT JOIN cell ON cell.i >= g.i GROUP BY ALL),
    tot AS (SELECT count(*) AS n, count(*) FILTER (WHERE label = 'PortScan') AS nu FROM uncertain)""",
    select="SELECT round(t, 6) AS threshold, round((a / n)::DOUBLE, 6) AS alert_rate, round((h / nu)::DOUBLE, 6) AS unknown_recall FROM suf, tot WHERE a / n <= 0.10 ORDER BY h DESC, t LIMIT 1"),
)
def m11a(spark: SparkSession, sf: str) -> DataFrame:
    s = triaged(spark, sf).select(F.round("p_attack", 6).alias("s"), unknown_label(F.col("label"), KNOWN).alias("u"))
    got = se.choose_threshold(s, "s", F.col("u"), 0.10)
    return one_row(spark, got).select(*r6(*got))


def _list(values: list[float]) -> str:
    return "[" + ", ".join(f"{v!r}::DOUBLE" for v in values) + "]"


BUDGET = f"""r AS (SELECT round(p_attack, 6) AS p, round(suspected_zero_day_pct, 4) AS z, round(open_set_ood_score, 6) AS o, label = 'PortScan' AS u FROM open_set),
pg AS (SELECT unnest({_list(se.P_GRID)}) AS pt, unnest(range(19)) AS pi), zg AS (SELECT unnest({_list(se.SZD_GRID)}) AS zt, unnest(range(10)) AS zi),
og AS (SELECT unnest({_list(se.OPEN_GRID)}) AS ot, unnest(range(12)) AS oi),
cells AS (SELECT (SELECT count(*) FROM pg WHERE pt <= p) AS pc, (SELECT count(*) FROM zg WHERE zt <= z) AS zc, (SELECT count(*) FROM og WHERE ot <= o) AS oc, count(*) AS n, count(*) FILTER (WHERE u) AS h FROM r GROUP BY ALL),
cand AS (SELECT pi, zi, 0 AS k, 'p_attack_and_szd' AS mode, pt, zt, NULL::DOUBLE AS ot, NULL AS oi FROM pg, zg
  UNION ALL SELECT pi, zi, 1, 'p_attack_only', pt, NULL, NULL, NULL FROM pg, zg
  UNION ALL SELECT pi, zi, 2 + oi, 'p_attack_and_szd_or_open_set', pt, zt, ot, oi FROM pg, zg, og),
res AS (SELECT cand.pi, cand.zi, k, mode, pt, zt, ot, sum(n) AS a, sum(h) AS h FROM cand JOIN cells ON pc > pi AND (mode = 'p_attack_only' OR zc > zi OR (oi IS NOT NULL AND oc > oi)) GROUP BY ALL),
tot AS (SELECT count(*) AS n, count(*) FILTER (WHERE u) AS nu FROM r)"""


@query(
    "m11b_budget_thresholds",
    with_(*TO_OPEN, BUDGET, select="SELECT mode, round(pt, 6) AS p_attack_threshold, round(zt, 6) AS szd_threshold, round(ot, 6) AS open_set_threshold, round((h / nu)::DOUBLE, 6) AS unknown_recall, round((a / n)::DOUBLE, 6) AS alert_rate, n AS n_rows, nu AS unknown_rows FROM res, tot WHERE a / n <= 0.10 ORDER BY h DESC, pi, zi, k LIMIT 1"),
)
def m11b(spark: SparkSession, sf: str) -> DataFrame:
    s = triaged(spark, sf).select(
        "label", F.round("p_attack", 6).alias("p_attack"), F.round("suspected_zero_day_pct", 4).alias("suspected_zero_day_pct"),
        F.round("open_set_ood_score", 6).alias("open_set_ood_score"),
    )
    got = se.choose_budget_thresholds(s, "label", KNOWN)
    best = got["recommendation"]
    values = {k: F.lit(best[k]).cast("double") for k in ("p_attack_threshold", "szd_threshold", "open_set_threshold", "unknown_recall", "alert_rate")}
    return spark.range(1).select(
        F.lit(best["mode"]).alias("mode"), *[F.round(v, 6).alias(k) for k, v in values.items()],
        F.lit(got["rows"]).cast("bigint").alias("n_rows"), F.lit(got["unknown_rows"]).cast("bigint").alias("unknown_rows"),
    )


@query(
    "m11c_block_threshold",
    with_(*TO_UNCERTAIN, f"""g AS (SELECT unnest({_list(se.BLOCK_GRID)}) AS t), b AS (SELECT round(max_class_probability, 6) AS s, supervised_prediction <> 'Benign' AS a FROM uncertain WHERE label = 'Benign'),
    f AS (SELECT t, (SELECT count(*) FROM b WHERE a AND s >= t) / (SELECT count(*) FROM b) AS fpr FROM g), n AS (SELECT count(*) AS benign_rows FROM b)""",
    select="SELECT round(coalesce(max(t) FILTER (WHERE fpr <= 0.05), 0.99), 6) AS largest, round(coalesce(min(t) FILTER (WHERE fpr <= 0.05), 0.99), 6) AS smallest, max(benign_rows) AS benign_rows FROM f, n"),
)
def m11c(spark: SparkSession, sf: str) -> DataFrame:
    s = scored(spark, sf).select("label", F.col("supervised_prediction").alias("prediction"), F.round("max_class_probability", 6).alias("proba_max"))
    big = se.choose_block_threshold(s, "label", "Benign", 0.05)
    small = se.choose_block_threshold(s, "label", "Benign", 0.05, pick="smallest")
    return one_row(spark, {"largest": big["block_min_proba"], "smallest": small["block_min_proba"]}).select(
        *r6("largest", "smallest"), F.lit(big["benign_rows"]).cast("bigint").alias("benign_rows")
    )


QS = [0.90, 0.93, 0.95, 0.97, 0.98, 0.99]
TUNE = "t AS (SELECT label NOT IN ('Benign', 'DoS') AS u, round(open_set_ood_score, 9) AS o, round(suspected_zero_day_pct, 9) AS s, round(anomaly_score, 9) AS a FROM open_set), " + ", ".join(
    f"q{i} AS (SELECT quantile_cont(o, {q}) AS o{i}, quantile_cont(s, {q}) AS s{i}, quantile_cont(a, {q}) AS a{i} FROM t WHERE NOT u)" for i, q in enumerate(QS)
) + ", c AS (" + " UNION ALL ".join(
    f"""SELECT {i} AS i, {q}::DOUBLE AS quantile, count(*) FILTER (WHERE f AND u) / greatest(count(*) FILTER (WHERE u), 1) AS r, count(*) FILTER (WHERE f) / count(*) AS al,
    count(*) FILTER (WHERE f AND NOT u) / greatest(count(*) FILTER (WHERE NOT u), 1) AS k FROM (SELECT u, o >= o{i} OR s >= s{i} OR a >= a{i} AS f FROM t, q{i})""" for i, q in enumerate(QS)
) + "), " + ", ".join(
    f"best_{n} AS (SELECT '{n}' AS profile, * FROM c ORDER BY CASE WHEN k <= {k} AND al <= {a} THEN 0 ELSE 1 END, r DESC, i LIMIT 1)" for n, k, a in (("balanced", 0.08, 0.20), ("high_recall", 0.12, 0.26))
)


@query(
    "m11d_tune_profiles",
    with_(*TO_OPEN, TUNE, select=" UNION ALL ".join(f"SELECT profile, quantile, round(r, 6) AS unknown_recall, round(al, 6) AS alert_rate, round(k, 6) AS known_alert_rate FROM best_{n}" for n in ("balanced", "high_recall"))),
)
def m11d(spark: SparkSession, sf: str) -> DataFrame:
    s = triaged(spark, sf).select("label", *[F.round(c, 9).alias(c) for c in se.GATE_SCORES])
    got = se.tune_profiles(s, unknown_label(F.col("label"), KNOWN, trim=False))
    rows = [
        F.struct(F.lit(name).alias("profile"), *[F.lit(float(got[f"{name}_profile"][k])).alias(k) for k in ("quantile", "unknown_recall", "alert_rate", "known_alert_rate")])
        for name in ("balanced", "high_recall")
    ]
    out = spark.range(1).select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    return out.select("profile", "quantile", *r6("unknown_recall", "alert_rate", "known_alert_rate"))


# ---- windows and splits --------------------------------------------------------------------------------------


@query(
    "w5_time_split",
    """WITH r AS (SELECT event_id, row_number() OVER (ORDER BY epoch(date_trunc('day', ts)), md5(concat_ws('|', '0', event_id))) AS rn, count(*) OVER () AS n FROM events)
    SELECT event_id, CASE WHEN rn <= CAST(floor(n * 0.64::DOUBLE) AS BIGINT) THEN 'train' WHEN rn <= CAST(floor(n * (0.64::DOUBLE + 0.16::DOUBLE)) AS BIGINT) THEN 'val' ELSE 'test' END AS split FROM r""",
)
def w5(spark: SparkSession, sf: str) -> DataFrame:
    """Ordered by day, so that each cut falls inside one day's events."""
    e = table(spark, sf, "events").select("event_id", "ts")
    day = F.date_diff(F.col("ts"), F.lit("2000-01-01").cast("date"))
    return rk.time_split(e, day, ["event_id"]).select("event_id", "split")


@query(
    "w6_stratified_split",
    """WITH r AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY md5(concat_ws('|', '42', event_id))) AS rn, count(*) OVER (PARTITION BY event_type) AS n FROM events)
    SELECT event_id, event_type, CASE WHEN rn <= floor(n * 0.2::DOUBLE + 1e-9) THEN 'test' WHEN rn <= floor(n * (0.2::DOUBLE + 0.2::DOUBLE) + 1e-9) THEN 'val' ELSE 'train' END AS split FROM r""",
)
def w6(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("event_id", "event_type")
    return rk.split_train_val_test(e, ["event_id"], "event_type")


@query("t2_top_families", "SELECT source AS family, count(*) AS n FROM documents WHERE lower(trim(source)) <> 'src0' GROUP BY 1 ORDER BY n DESC, family LIMIT 4")
def t2(spark: SparkSession, sf: str) -> DataFrame:
    from netsieve.models.evaluate import top_label_counts

    return top_label_counts(table(spark, sf, "documents"), "source", 4, skip_benign=True, benign="src0").withColumnRenamed("label", "family")


# ---- joins and reports ---------------------------------------------------------------------------------------


@query(
    "j1_merge_scores",
    with_(*TO_UNCERTAIN, select="SELECT uid, round(p_attack, 6) AS score, round(anomaly_score, 6) AS anomaly_anomaly_score, anomaly_score > thr AS anomaly_is_anomaly FROM uncertain"),
)
def j1(spark: SparkSession, sf: str) -> DataFrame:
    t = triaged(spark, sf)
    left = t.select("uid", F.round("p_attack", 6).alias("score"))
    right = t.select("uid", F.round("anomaly_score", 6).alias("anomaly_score"), (F.col("anomaly_score") > F.col("anomaly_threshold")).alias("is_anomaly"))
    return rp.merge_scores(left, right, ["uid"])


@query(
    "j2_shadow_report",
    with_("cm AS (SELECT CAST(toxic AS VARCHAR) AS y, CASE WHEN lang = 'en' THEN '1' ELSE '0' END AS p, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY ALL)", CLASSES, select=REPORT),
)
def j2(spark: SparkSession, sf: str) -> DataFrame:
    pred = table(spark, sf, "documents").select(F.col("doc_id").alias("case_id"), F.when(F.col("lang") == "en", "1").otherwise("0").alias("decision_label"))
    ann = table(spark, sf, "labels").select(F.col("doc_id").alias("case_id"), F.col("toxic").cast("string").alias("analyst_label"))
    return rp.shadow_report(pred, ann).select("kind", "label", *r6("precision", "recall", "f1"), "support")


ARTIFACTS = "artifacts AS (SELECT l_orderkey AS job_id, 'part ' || max(l_partkey) AS parquet_path FROM lineitem GROUP BY l_orderkey)"


@query(
    "j3_stream_jobs",
    with_(JOBS, ARTIFACTS, select="SELECT id, status, parquet_path FROM (SELECT * FROM jobs WHERE job_type = 'stream_collect' AND (tenant_id = 1 OR tenant_id IS NULL) ORDER BY id DESC LIMIT 50) j LEFT JOIN artifacts a ON a.job_id = j.id"),
)
def j3(spark: SparkSession, sf: str) -> DataFrame:
    artifacts = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("job_id")).agg(F.concat(F.lit("part "), F.max("l_partkey")).alias("parquet_path"))
    return rp.stream_jobs(job_table(spark, sf), artifacts, "analyst", 1).select("id", "status", "parquet_path")


@query(
    "t4_history",
    """SELECT 'run' AS kind, event_id AS id, event_type AS text FROM (SELECT * FROM events WHERE user_id % 4 = 2 OR user_id % 4 = 0 ORDER BY event_id DESC LIMIT 100)
    UNION ALL SELECT 'scored', doc_id, substring(text, 1, 400) FROM (SELECT * FROM documents WHERE doc_id % 4 = 2 OR doc_id % 4 = 0 ORDER BY doc_id DESC LIMIT 50)""",
)
def t4(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col
    owner = lambda x: F.when(x % 4 != 0, x % 4)
    runs = table(spark, sf, "events").select(c("event_id").alias("id"), c("event_type").alias("text"), owner(c("user_id")).alias("tenant_id"))
    events = table(spark, sf, "documents").select(c("doc_id").alias("id"), c("text").alias("raw_json"), owner(c("doc_id")).alias("tenant_id"))
    a = rp.detection_runs(runs, "analyst", 2).select(F.lit("run").alias("kind"), "id", "text")
    b = rp.recent_scored(events, "analyst", 2).select(F.lit("scored").alias("kind"), "id", c("raw_json_preview").alias("text"))
    return a.unionByName(b)


@query(
    "j7_compare_runs",
    with_(EVENT_DECISIONS, """a AS (SELECT decision_label AS label, count(*) AS n_a FROM decisions WHERE ts < '2024-01-15' GROUP BY 1),
    b AS (SELECT decision_label AS label, count(*) AS n_b FROM decisions WHERE ts >= '2024-01-15' GROUP BY 1)""",
    select="SELECT label, coalesce(n_a, 0) AS n_a, coalesce(n_b, 0) AS n_b FROM a FULL JOIN b USING (label)"),
)
def j7(spark: SparkSession, sf: str) -> DataFrame:
    d = event_decisions(spark, sf)
    cut = F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")
    return rp.compare_runs(d.where(F.col("ts") < cut), d.where(F.col("ts") >= cut))


@query(
    "a17_ops_summary",
    with_(ALERTS, CASES, JOBS, """last_job AS (SELECT * FROM jobs WHERE job_type = 'stream_collect' AND (tenant_id = 2 OR tenant_id IS NULL) ORDER BY id DESC LIMIT 1)""",
    select="""SELECT (SELECT count(*) FROM alerts WHERE tenant_id = 2 OR tenant_id IS NULL) AS alerts_total, (SELECT count(*) FROM cases WHERE tenant_id = 2 OR tenant_id IS NULL) AS cases_total,
    (SELECT count(*) FROM cases WHERE (tenant_id = 2 OR tenant_id IS NULL) AND status NOT IN ('resolved', 'closed')) AS cases_open, id AS last_job_id, status AS last_job_status,
    CASE WHEN status = 'completed' THEN risk_level END AS last_job_risk_level FROM last_job"""),
)
def a17(spark: SparkSession, sf: str) -> DataFrame:
    return rp.ops_summary(alert_table(spark, sf), case_table(spark, sf), job_table(spark, sf), "analyst", 2)


# ---- model comparison and quality gates ----------------------------------------------------------------------

# Two stand-in models: one reads the supervised prediction, the other also corrects low-tax rows.
F1S = """base_cm AS (SELECT label AS y, supervised_prediction AS p, count(*) AS n FROM uncertain GROUP BY ALL),
boost_cm AS (SELECT label AS y, CASE WHEN c2 < 2000000 THEN label ELSE supervised_prediction END AS p, count(*) AS n FROM uncertain GROUP BY ALL),
names AS (SELECT unnest(['Benign', 'DoS', 'PortScan']) AS label),
bf AS (SELECT label, 2.0 * (SELECT coalesce(sum(n), 0) FROM base_cm WHERE y = label AND p = label) / (SELECT sum(n) FROM (SELECT n FROM base_cm WHERE y = label UNION ALL SELECT n FROM base_cm WHERE p = label)) AS f FROM names),
sf AS (SELECT label, 2.0 * (SELECT coalesce(sum(n), 0) FROM boost_cm WHERE y = label AND p = label) / (SELECT sum(n) FROM (SELECT n FROM boost_cm WHERE y = label UNION ALL SELECT n FROM boost_cm WHERE p = label)) AS f FROM names),
m AS (SELECT (SELECT avg(f) FROM bf) AS base_f, (SELECT avg(f) FROM sf) AS boost_f, (SELECT sum(n) FILTER (WHERE y = p) / sum(n) FROM base_cm) AS base_a, (SELECT sum(n) FILTER (WHERE y = p) / sum(n) FROM boost_cm) AS boost_a)"""


def _two_models(spark: SparkSession, sf: str) -> DataFrame:
    s = scored(spark, sf)
    better = F.when(col("Flow Duration") < 2_000_000, F.col("label")).otherwise(F.col("supervised_prediction"))
    return s.select("label", "supervised_prediction", better.alias("boosted"))


def _deltas(spark: SparkSession, sf: str) -> DataFrame:
    both = _two_models(spark, sf)
    return rp.model_deltas(me.macro_f1(both, "label", "supervised_prediction"), me.macro_f1(both, "label", "boosted"))


@query(
    "a19_model_deltas",
    with_(*TO_UNCERTAIN, F1S, select="SELECT round(base_f::DOUBLE, 6) AS base_macro_f1, round(boost_f::DOUBLE, 6) AS boost_macro_f1, round((boost_f - base_f)::DOUBLE, 6) AS delta_macro_f1, round(base_a::DOUBLE, 6) AS base_accuracy, round(boost_a::DOUBLE, 6) AS boost_accuracy, round((boost_a - base_a)::DOUBLE, 6) AS delta_accuracy FROM m"),
)
def a19(spark: SparkSession, sf: str) -> DataFrame:
    out = _deltas(spark, sf)
    return out.select(*r6(*out.columns))


POLICY = {
    "macro_f1_min": 0.40, "rare_class_f1_min": 0.45, "rare_classes": ["PortScan", "Bot"], "unknown_recall_external_min": 0.05,
    "known_alert_rate_max": 0.08, "max_alert_rate_external": 0.5,
}


def _quality_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """(metric, value) rows: model deltas, the default and adaptive recall, and the novelty flag as calibrator."""
    unknown = unknown_label(F.col("label"), KNOWN)
    f = fused(spark, sf)
    flag = me.recall_and_alert_rates(f, F.col("is_novel_flagged"), unknown)
    default = me.recall_and_alert_rates(f, F.col("decision_label") == "AttackUncertain", unknown)
    parts = [
        rp.metric_rows(_deltas(spark, sf), {c: c for c in ("base_macro_f1", "boost_macro_f1", "delta_macro_f1")}),
        rp.metric_rows(flag, {"unknown_recall": "calibrator_unknown_recall", "known_alert_rate": "calibrator_known_alert_rate", "alert_rate": "calibrator_alert_rate"}),
        rp.metric_rows(default, {"unknown_recall": "unknown_recall_attack_uncertain", "known_alert_rate": "adaptive_known_alert_rate"}),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


QUALITY = F1S + """,
q AS (SELECT count(*) FILTER (WHERE is_novel_flagged AND label = 'PortScan') / count(*) FILTER (WHERE label = 'PortScan') AS cr, count(*) FILTER (WHERE is_novel_flagged AND label <> 'PortScan') / count(*) FILTER (WHERE label <> 'PortScan') AS ck,
  count(*) FILTER (WHERE is_novel_flagged) / count(*) AS ca, count(*) FILTER (WHERE decision_label = 'AttackUncertain' AND label = 'PortScan') / count(*) FILTER (WHERE label = 'PortScan') AS ur,
  count(*) FILTER (WHERE decision_label = 'AttackUncertain' AND label <> 'PortScan') / count(*) FILTER (WHERE label <> 'PortScan') AS uk FROM fused)"""


@query(
    "a22_kpi_gate",
    with_(*TO_FUSED, QUALITY, """w AS (SELECT f AS worst FROM sf WHERE label = 'PortScan'),
    g AS (SELECT 'macro_f1' AS "check", boost_f::DOUBLE AS actual, 0.40::DOUBLE AS lim, boost_f >= 0.40 AS passed FROM m UNION ALL SELECT 'worst_rare_f1', worst, 0.45, worst >= 0.45 FROM w
    UNION ALL SELECT 'external_unknown_recall', cr, 0.05, cr >= 0.05 FROM q UNION ALL SELECT 'known_alert_rate', ck, 0.08, ck <= 0.08 FROM q UNION ALL SELECT 'external_alert_rate', ca, 0.5, ca <= 0.5 FROM q)""",
    select='SELECT "check", round(actual, 6) AS actual, lim AS "limit", passed, bool_and(passed) OVER () AS gate_passed FROM g'),
)
def a22(spark: SparkSession, sf: str) -> DataFrame:
    both = _two_models(spark, sf)
    worst = rp.worst_rare_f1(
        POLICY["rare_classes"], me.classification_report(both, "label", "boosted"),
        me.classification_report(both, "label", "supervised_prediction"),
    )
    return rp.kpi_gate(_quality_metrics(spark, sf), POLICY, worst).select("check", *r6("actual"), "limit", "passed", "gate_passed")


@query(
    "a23_scorecard",
    with_(*TO_FUSED, QUALITY, select="SELECT (CASE WHEN boost_f > base_f THEN 4.0 ELSE 0 END + CASE WHEN ur > 0.1 THEN 3.0 ELSE 0 END + CASE WHEN cr > greatest(0.1, ur) THEN 1.0 ELSE 0 END)::DOUBLE AS overall_improvement_score FROM m, q"),
)
def a23(spark: SparkSession, sf: str) -> DataFrame:
    return rp.scorecard_score(_quality_metrics(spark, sf))


@query(
    "a23_quality_report",
    with_(*TO_FUSED, QUALITY, select="""SELECT round(base_f::DOUBLE, 6) AS macro_f1_before, round(boost_f::DOUBLE, 6) AS macro_f1_after, round((boost_f - base_f)::DOUBLE, 6) AS macro_f1_delta, round(ur, 6) AS unknown_recall_default,
    0.0::DOUBLE AS unknown_recall_adaptive, round(cr, 6) AS unknown_recall_calibrator, round(cr, 6) AS selected_unknown_recall, CASE WHEN 0 >= cr THEN 'adaptive_gates' ELSE 'novelty_calibrator' END AS selected_unknown_strategy,
    round(CASE WHEN 0 >= cr THEN uk ELSE ck END, 6) AS known_alert_rate_selected FROM m, q"""),
)
def a23b(spark: SparkSession, sf: str) -> DataFrame:
    out = rp.quality_report(_quality_metrics(spark, sf))
    return out.select(*[F.round(c, 6).alias(c) if c != "selected_unknown_strategy" else F.col(c) for c in out.columns])
