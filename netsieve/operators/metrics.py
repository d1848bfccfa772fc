"""Classification reports, ROC/PR, anomaly evaluation, class balance and weights, run percentiles."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from netsieve.functions.guards import col, gt, nan_to_null, ratio
from netsieve.operators.ranking import exact_quantiles, running_totals
from netsieve.session import broadcast_if_small


def confusion(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """(y, p, n) for every pair that occurs: one aggregate, one row per pair."""
    return df.groupBy(col(truth).cast("string").alias("y"), col(pred).cast("string").alias("p")).agg(
        F.count(F.lit(1)).alias("n")
    )


def safe_div(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / F.when(b > 0, b).otherwise(1)).otherwise(0.0)


def per_class(cm: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support over the union of true and predicted labels; empty denominators give 0."""
    side = F.explode(
        F.array(
            F.struct(
                F.col("y").alias("label"), F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0).alias("tp"),
                F.col("n").alias("support"), F.lit(0).cast("bigint").alias("predicted"),
            ),
            F.struct(
                F.col("p").alias("label"), F.lit(0).cast("bigint").alias("tp"),
                F.lit(0).cast("bigint").alias("support"), F.col("n").alias("predicted"),
            ),
        )
    )
    sums = cm.select(side.alias("s")).select("s.*").groupBy("label").agg(
        F.sum("tp").alias("tp"), F.sum("support").alias("support"), F.sum("predicted").alias("predicted")
    )
    precision, recall = safe_div(F.col("tp"), F.col("predicted")), safe_div(F.col("tp"), F.col("support"))
    f1 = safe_div(2.0 * F.col("tp"), F.col("support") + F.col("predicted"))
    return sums.select("label", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"), "support", "tp")


def classification_report(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """Per-class rows plus ``accuracy``, ``macro avg`` and ``weighted avg`` (long form)."""
    classes = per_class(confusion(df, truth, pred))
    n = F.sum("support")
    weighted = lambda c: safe_div(F.sum(F.col(c) * F.col("support")), n)
    accuracy = safe_div(F.sum("tp"), n)
    total = classes.agg(
        F.array(
            F.struct(F.lit("accuracy").alias("label"), accuracy.alias("precision"), accuracy.alias("recall"), accuracy.alias("f1"), n.alias("support")),
            F.struct(F.lit("macro avg").alias("label"), F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), F.avg("f1").alias("f1"), n.alias("support")),
            F.struct(F.lit("weighted avg").alias("label"), weighted("precision").alias("precision"), weighted("recall").alias("recall"), weighted("f1").alias("f1"), n.alias("support")),
        ).alias("rows")
    )
    averages = total.where(F.col("rows")[0]["support"].isNotNull()).select(F.explode("rows").alias("r")).select("r.*")
    fields = ["label", "precision", "recall", "f1", "support"]
    tagged = classes.select(F.lit("class").alias("kind"), *fields)
    return tagged.unionByName(averages.select(F.lit("average").alias("kind"), *fields))


def macro_f1(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """One row: macro F1 and accuracy."""
    c = per_class(confusion(df, truth, pred))
    return c.agg(F.avg("f1").alias("macro_f1"), safe_div(F.sum("tp"), F.sum("support")).alias("accuracy"))


def lowest_f1(report: DataFrame, k: int = 12, by_support: bool = False) -> DataFrame:
    """The k weakest classes of a report."""
    tie = [F.col("support").asc()] if by_support else []
    return report.where(F.col("kind") == "class").orderBy(F.col("f1").asc(), *tie, F.col("label").asc()).limit(k)


# ---- binary curves -------------------------------------------------------------------------------------------


def curve_points(df: DataFrame, positive: Column, score: str) -> DataFrame:
    """Per distinct score, descending: positives, negatives, and their running totals."""
    marked = df.select(
        col(score).cast("double").alias("score"),
        positive.cast("bigint").alias("pos"),
        (~positive).cast("bigint").alias("neg"),
    )
    return running_totals(marked, "score", ["pos", "neg"])


def curve_summary(points: DataFrame, target_fprs: Sequence[float] = (0.001, 0.01, 0.05)) -> DataFrame:
    """ROC AUC, average precision, and per target the last kept ROC point with FPR within it.

    Everything is a sum, or a maximum by FPR, over the points, so the curve is never ordered in one task. A point is
    dropped from the ROC when it lies on a straight run: its step equals the next point's step, and it is neither the
    first nor the last.
    """
    p, n = F.sum("pos"), F.sum("neg")
    first = F.col("cum_pos") + F.col("cum_neg") == F.col("pos") + F.col("neg")
    kept = first | F.col("next_pos").isNull() | (F.col("next_pos") != F.col("pos")) | (F.col("next_neg") != F.col("neg"))
    totals = points.agg(F.struct(p.alias("p"), n.alias("n")).alias("t")).scalar()
    tp_all, fp_all = totals.getField("p"), totals.getField("n")
    # Trapezoid area in counts: this point's negatives times the mean height before and after.
    area = F.col("neg") * (F.col("cum_pos") - F.col("pos") / 2.0)
    precision = F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))
    fpr = safe_div(F.col("cum_neg").cast("double"), fp_all)
    tpr = safe_div(F.col("cum_pos").cast("double"), tp_all)
    picks = []
    for i, target in enumerate(target_fprs):
        inside = F.when(kept & (fpr <= F.lit(float(target))), F.struct("cum_neg", "cum_pos", F.col("score"), fpr.alias("fpr"), tpr.alias("tpr")))
        picks.append(F.max(inside).alias(f"pick{i}"))
    agg = points.agg(
        p.alias("positives"), n.alias("negatives"), F.sum(area).alias("area"),
        F.sum(F.col("pos") * precision).alias("ap"), *picks,
    )
    # (0, 0) with an infinite threshold is the curve's starting point, so every target has an answer.
    chosen = []
    for i, target in enumerate(target_fprs):
        q = F.col(f"pick{i}")
        chosen.append(
            F.struct(
                F.lit(float(target)).alias("target_fpr"),
                F.coalesce(q["score"], F.lit(float("inf"))).alias("threshold"),
                F.coalesce(q["tpr"], F.lit(0.0)).alias("tpr"),
                F.coalesce(q["fpr"], F.lit(0.0)).alias("fpr"),
            )
        )
    both = (F.col("positives") > 0) & (F.col("negatives") > 0)
    cells = F.col("positives").cast("double") * F.col("negatives")
    return agg.select(
        F.when(both, F.col("area") / F.when(both, cells).otherwise(1.0)).alias("roc_auc"),
        safe_div(F.col("ap"), F.col("positives")).alias("pr_auc"),
        F.explode(F.array(*chosen)).alias("c"),
    ).select("roc_auc", "pr_auc", "c.*")


def binary_curves(df: DataFrame, label: str, score: str, benign_label: str, target_fprs: Sequence[float] = (0.001, 0.01, 0.05)) -> DataFrame:
    positive = F.coalesce(col(label).cast("string") != F.lit(benign_label), F.lit(True))
    return curve_summary(curve_points(df, positive, score), target_fprs)


def anomaly_evaluation(df: DataFrame, label: str, score: str, threshold: float, benign: Iterable[str] = ("BENIGN", "Benign", "benign")) -> DataFrame:
    """Benign-versus-attack evaluation of an anomaly score at its threshold; one row."""
    attack = ~F.coalesce(col(label).cast("string").isin(sorted(benign)), F.lit(False))
    flagged = gt(col(score), F.lit(float(threshold)))
    counts = df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(~attack).alias("n_benign_gt"),
        F.count_if(attack).alias("n_attack_gt"),
        F.count_if(~attack & ~flagged).alias("tn"),
        F.count_if(~attack & flagged).alias("fp"),
        F.count_if(attack & ~flagged).alias("fn"),
        F.count_if(attack & flagged).alias("tp"),
    )
    auc = curve_summary(curve_points(df, attack, score), [0.0]).select("roc_auc").scalar()
    c = F.col
    return counts.select(
        F.lit(float(threshold)).alias("threshold"), "n_rows", "n_benign_gt", "n_attack_gt", "tn", "fp", "fn", "tp",
        ratio(c("fp"), c("n_benign_gt")).alias("false_positive_rate_benign"),
        ratio(c("tp"), c("n_attack_gt")).alias("true_positive_rate_attack"),
        safe_div(c("tp"), c("tp") + c("fp")).alias("precision_attack"),
        safe_div(c("tp"), c("tp") + c("fn")).alias("recall_attack"),
        safe_div(2.0 * c("tp"), 2 * c("tp") + c("fp") + c("fn")).alias("f1_attack"),
        auc.alias("roc_auc_score"),
        (ratio(c("tp") + c("fp"), c("n_rows")) * 10000.0).alias("alerts_per_10k_rows"),
    )


# ---- class balance and weights -------------------------------------------------------------------------------


def class_balance(df: DataFrame, label: str) -> DataFrame:
    """Rows, classes, majority class (ties by name) and the largest to smallest ratio (NULL for one class)."""
    per = df.where(col(label).isNotNull()).groupBy(col(label).cast("string").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    top = F.min(F.struct((-F.col("n")).alias("neg"), F.col("label"))).alias("top")
    return per.agg(
        F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_classes"), top,
        F.max("n").alias("hi"), F.min("n").alias("lo"),
    ).select(
        F.coalesce("n_rows", F.lit(0)).alias("n_rows"), "n_classes", F.col("top.label").alias("majority_class"),
        F.coalesce("hi", F.lit(0)).alias("majority_count"),
        F.when(F.col("n_classes") > 1, F.col("hi") / F.col("lo")).alias("max_min_ratio"),
    )


def class_weights(df: DataFrame, label: str, power: float | None = None) -> DataFrame:
    """One row per class: balanced weight ``n/(k*n_c)``, or with ``power`` its power normalised to mean 1 over rows."""
    per = df.groupBy(col(label).alias("_class")).agg(F.count(F.lit(1)).alias("_n"))
    totals = per.agg(F.struct(F.sum("_n").alias("n"), F.count(F.lit(1)).alias("k")).alias("t")).scalar()
    balanced = totals.getField("n").cast("double") / (totals.getField("k") * F.col("_n"))
    if power is None:
        return per.select("_class", "_n", balanced.alias("_w"))
    raw = per.select("_class", "_n", F.pow(balanced, F.lit(float(power))).alias("_m"))
    mean = raw.agg(F.sum(F.col("_n") * F.col("_m")) / F.sum("_n")).scalar()
    return raw.select("_class", "_n", (F.col("_m") / mean).alias("_w"))


def with_class_weight(df: DataFrame, label: str, power: float | None = None, out: str = "weight") -> DataFrame:
    w = class_weights(df, label, power).select("_class", F.col("_w").alias(out))
    return df.join(broadcast_if_small(w, "weights"), col(label).eqNullSafe(F.col("_class")), "left").drop("_class")


# ---- run percentiles -----------------------------------------------------------------------------------------


def run_percentiles(df: DataFrame, wanted: Sequence[tuple[str, str, float]], approximate: bool = False) -> dict[str, float | None]:
    """Named percentiles, e.g. ``("score_p99", "score", 99)``; columns the table lacks are skipped.

    Exact by default. ``approximate`` uses the one-pass sketch instead.
    """
    wanted = [w for w in wanted if w[1] in df.columns]
    if not wanted:
        return {}
    if approximate:
        row = df.agg(*[F.percentile_approx(nan_to_null(col(c)), F.lit(p / 100.0)).alias(k) for k, c, p in wanted]).first()
        return row.asDict()
    names = list(dict.fromkeys(c for _, c, _ in wanted))
    probs = sorted({p / 100.0 for _, _, p in wanted})
    got = exact_quantiles(df, names, probs, stage=True)
    return {k: got[c][probs.index(p / 100.0)] for k, c, p in wanted}


def benign_threshold(df: DataFrame, score: str, percentile: float = 99.0) -> float | None:
    """Anomaly threshold: a percentile of the scores of benign rows."""
    return exact_quantiles(df, [score], [percentile / 100.0], stage=True)[score][0]


def recall_and_alert_rates(df: DataFrame, flag: Column, unknown: Column) -> DataFrame:
    """Unknown recall, alert rate and known alert rate of a boolean flag, in one aggregate."""
    hit = F.coalesce(flag, F.lit(False))
    return df.agg(
        ratio(F.count_if(hit & unknown), F.count_if(unknown)).alias("unknown_recall"),
        ratio(F.count_if(hit), F.count(F.lit(1))).alias("alert_rate"),
        ratio(F.count_if(hit & ~unknown), F.count_if(~unknown)).alias("known_alert_rate"),
    )


def flip_rate(df: DataFrame, before: str, after: str) -> DataFrame:
    return df.agg(F.avg((~col(before).eqNullSafe(col(after))).cast("double")).alias("prediction_flip_rate"), F.count(F.lit(1)).alias("n_rows"))
