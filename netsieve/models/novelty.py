"""The detection jobs that combine a binary, a multiclass and an anomaly model, and the novelty calibrator."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from netsieve.functions.guards import col, ge, nan_to_null
from netsieve.models.linear import LinearModel, argmax_label, fit_logistic
from netsieve.models.preprocess import fit_scaler
from netsieve.operators.mapping import ATTACK, unknown_label
from netsieve.operators.prototypes import Prototypes, nearest_distance, score_open_set
from netsieve.operators.ranking import stratified_split
from netsieve.operators.search import choose_thresholds
from netsieve.operators.triage import (
    NOVEL_LABEL, add_suspected_zero_day, attack_uncertain, fuse_decisions, minmax_score, novelty_labels,
)
from netsieve.session import materialize
from netsieve.sources.bundles import Bundle


@dataclass(frozen=True)
class NoveltyOptions:
    """Settings of the novelty rule. ``reference_max`` and ``tier_cut`` fix what would otherwise be read from the
    scored table; streams need them."""

    novel_label: str = NOVEL_LABEL
    confidence_threshold: float = 0.55
    require_low_confidence: bool = True
    tier_strong_label: str | None = None
    tier_percentile: float = 90.0
    tier_cut: float | None = None
    weight_anomaly: float = 0.5
    weight_uncertainty: float = 0.5
    temperature: float = 1.0
    reference_max: float | None = None
    min_szd_pct: float = 70.0


@dataclass(frozen=True)
class Detector:
    """Three models over one contract: Benign/Attack, families, and an anomaly score with its threshold.

    ``anomaly_score`` gives the score column from the feature columns; ``prototypes`` adds the open-set score.
    """

    binary: LinearModel
    families: LinearModel
    anomaly_score: Column
    threshold: float
    anomaly_type: str = ""
    anomaly_version: str = ""
    prototypes: Prototypes | None = None
    open_set_range: tuple[float, float] | None = None

    def __post_init__(self) -> None:
        if self.binary.feature_columns != self.families.feature_columns:
            raise ValueError("binary and family models must share the same feature_columns")
        if ATTACK not in self.binary.classes:
            raise ValueError(f"binary model needs a class {ATTACK!r}, has {self.binary.classes}")


def _with_scores(df: DataFrame, d: Detector, options: NoveltyOptions, binary: bool, open_set: bool) -> DataFrame:
    """Add what the models say, over features that are scaled once.

    The scores leave through ``inline``, a generator over one struct. Spark pushes a filter on a decision through plain
    projections by copying their arithmetic into the condition, once per use and level, which for three models makes
    an expression too large to plan; a generator's output columns stop that.
    """
    names = df.columns
    out, z = d.families.scaler.add_scaled(df, "_z")
    out = d.families.add_probabilities(out, "_f", features=z)
    probs = [F.col(f"_f{i}") for i in range(len(d.families.classes))]
    added = {"supervised_prediction": argmax_label(probs, d.families.classes), "max_class_probability": F.greatest(*probs), "anomaly_score": d.anomaly_score}
    if options.temperature != 1.0:
        out = d.families.add_probabilities(out, "_t", options.temperature, z)
        added["max_class_probability"] = F.greatest(*[F.col(f"_t{i}") for i in range(len(probs))])
    if binary:
        same = d.binary.scaler == d.families.scaler
        out, y = (out, z) if same else d.binary.scaler.add_scaled(out, "_y")
        out = d.binary.add_probabilities(out, "_b", features=y)
        pair = [F.col(f"_b{i}") for i in range(len(d.binary.classes))]
        added["binary_prediction"] = argmax_label(pair, d.binary.classes)
        added["p_attack"] = pair[d.binary.classes.index(ATTACK)]
    if open_set and d.prototypes is not None:
        added["open_set_nearest_distance"] = nearest_distance(z, d.prototypes)
    out = out.withColumns({f"_s_{name}": c for name, c in added.items()})
    scores = F.struct(*[F.col(f"_s_{name}").alias(name) for name in added])
    return out.select(*[col(n) for n in names], F.inline(F.array(scores)))


def _reference(df: DataFrame, d: Detector, options: NoveltyOptions, open_set: bool) -> Column:
    """Largest anomaly score and distance range, as one struct: stored values where given, otherwise read from the
    table by a single scalar subquery that needs only the feature columns."""
    lo, hi = d.open_set_range or (None, None)
    stored_set = not open_set or d.prototypes is None or lo is not None
    if options.reference_max is not None and stored_set:
        return F.struct(F.lit(float(options.reference_max)).alias("top"), F.lit(lo).cast("double").alias("lo"), F.lit(hi).cast("double").alias("hi"))
    score = nan_to_null(d.anomaly_score)
    if stored_set:
        rows = df.select(score.alias("s"))
        ends = [F.lit(lo).cast("double"), F.lit(hi).cast("double")]
    else:
        out, z = d.families.scaler.add_scaled(df, "_z")
        rows = out.select(score.alias("s"), nan_to_null(nearest_distance(z, d.prototypes)).alias("d"))
        ends = [F.min("d"), F.max("d")]
    top = F.max("s") if options.reference_max is None else F.lit(float(options.reference_max))
    return rows.agg(F.struct(top.alias("top"), ends[0].alias("lo"), ends[1].alias("hi"))).scalar()


def _detect(df: DataFrame, d: Detector, options: NoveltyOptions, binary: bool, open_set: bool) -> DataFrame:
    names = df.columns
    with_set = open_set and d.prototypes is not None
    out = _with_scores(df, d, options, binary, with_set).withColumn("_ref", _reference(df, d, options, with_set))
    out = novelty_labels(
        out, d.threshold, options.confidence_threshold, options.require_low_confidence, options.novel_label,
        options.tier_strong_label, options.tier_percentile, tier_cut=options.tier_cut,
    )
    out = add_suspected_zero_day(out, d.threshold, F.col("_ref.top"), options.weight_anomaly, options.weight_uncertainty)
    if with_set:
        out = minmax_score(out, "open_set_nearest_distance", "open_set_ood_score", F.col("_ref.lo"), F.col("_ref.hi"))
    if binary:
        out = attack_uncertain(out, options.min_szd_pct)
    # Output columns, in order.
    cols = ["binary_prediction", "p_attack"] if binary else []
    cols += [
        "prediction", "supervised_prediction", "max_class_probability", "anomaly_score", "anomaly_threshold",
        "suspected_zero_day_pct", "is_novel_flagged",
    ]
    versions = {"supervised_model_version": d.families.version, "anomaly_model_type": d.anomaly_type, "anomaly_bundle_version": d.anomaly_version}
    if binary:
        versions["binary_bundle_version"] = d.binary.version
    tail = (["is_attack_uncertain"] if binary else []) + (["open_set_nearest_distance", "open_set_ood_score"] if with_set else [])
    return out.select(*[col(n) for n in names], *cols, *[F.lit(v).alias(k) for k, v in versions.items()], *tail)


def detect_novel(df: DataFrame, d: Detector, options: NoveltyOptions = NoveltyOptions()) -> DataFrame:
    """Family prediction, anomaly score, novelty flag and suspected-zero-day score; input columns are kept."""
    return _detect(df, d, options, binary=False, open_set=False)


def detect_attack_uncertain(df: DataFrame, d: Detector, options: NoveltyOptions = NoveltyOptions(), open_set: bool = False) -> DataFrame:
    """:func:`detect_novel` plus the binary prediction, the attack probability and ``is_attack_uncertain``; with
    ``open_set`` also the distance to the nearest prototype and its score."""
    return _detect(df, d, options, binary=True, open_set=open_set)


def add_open_set(df: DataFrame, d: Detector) -> DataFrame:
    """Open-set distance and score in the family model's scaled space, when the detector has prototypes."""
    if d.prototypes is None:
        return df
    lo, hi = d.open_set_range or (None, None)
    return score_open_set(df, nearest_distance(d.families.scaler.expressions(), d.prototypes), lo, hi)


def score_and_fuse(
    df: DataFrame, d: Detector, thresholds: Mapping[str, float] | None = None, options: NoveltyOptions = NoveltyOptions(),
    open_set: bool = True,
) -> DataFrame:
    """From contract rows to decisions in one lazy plan; the same function serves batch and stream."""
    return fuse_decisions(detect_attack_uncertain(df, d, options, open_set), **dict(thresholds or {}))


# ---- novelty calibrator --------------------------------------------------------------------------------------

# The five scores the calibrator reads by default.
CALIBRATOR_FEATURES = ["p_attack", "suspected_zero_day_pct", "anomaly_score", "open_set_ood_score", "max_class_probability"]


@dataclass(frozen=True)
class NoveltyCalibrator:
    model: LinearModel
    threshold: float
    max_alert_rate: float
    known_labels: list[str]

    def to_bundle(self) -> Bundle:
        return self.model.to_bundle(threshold=self.threshold, max_alert_rate=self.max_alert_rate, known_labels=self.known_labels)


def fit_novelty_calibrators(
    df: DataFrame, key: Sequence[str], label: str, known_labels: Iterable[str], features: Sequence[str], budgets: Sequence[float],
    seed: int = 42,
) -> list[tuple[NoveltyCalibrator, dict]]:
    """Balanced logistic regression from scores to P(unknown), fitted on a stratified 70%, and on the other 30% one
    threshold per alert budget. The budgets share the fit, which does not depend on them."""
    missing = [c for c in [*features, label] if c not in df.columns]
    if missing:
        raise ValueError(f"novelty calibrator needs columns {missing}")
    known = sorted(set(known_labels))
    unknown = unknown_label(col(label), known, trim=False)
    named = df.withColumn("_u", F.when(unknown, F.lit("unknown")).otherwise(F.lit("known")))
    # The split reads its input several times, and the scores may be expensive: they are written once.
    narrow = materialize(named.select(*[col(c) for c in dict.fromkeys([*key, *features])], "_u"), "calibrator")
    split = stratified_split(narrow, key, "_u", [("val", 0.3)], "train", seed, out="_part").select(
        *[col(c) for c in features], "_u", "_part"
    ).persist()
    try:
        train, val = split.where(F.col("_part") == "train"), split.where(F.col("_part") == "val")
        scaler = fit_scaler(train, features, impute=False)
        model = fit_logistic(train, "_u", features, balanced=True, max_iter=200, scaler=scaler, classes=["known", "unknown"])
        scored = calibrated_score(val, model).select("novelty_calibrated_score", (F.col("_u") == "unknown").alias("u"))
        picks = choose_thresholds(scored, "novelty_calibrated_score", F.col("u"), budgets)
        sizes = {r["_part"]: r["count"] for r in split.groupBy("_part").count().collect()}
    finally:
        split.unpersist()
    return [
        (
            NoveltyCalibrator(model, pick["threshold"], float(budget), known),
            {
                "rows_train": sizes.get("train", 0), "rows_val": sizes.get("val", 0), "chosen_threshold": pick["threshold"],
                "budget_max_alert_rate": float(budget), "val_alert_rate": pick["alert_rate"], "val_unknown_recall": pick["unknown_recall"],
            },
        )
        for budget, pick in zip(budgets, picks)
    ]


def fit_novelty_calibrator(
    df: DataFrame, key: Sequence[str], label: str, known_labels: Iterable[str],
    features: Sequence[str] = CALIBRATOR_FEATURES, max_alert_rate: float = 0.10, seed: int = 42,
) -> tuple[NoveltyCalibrator, dict]:
    """One calibrator and its summary for one alert budget."""
    return fit_novelty_calibrators(df, key, label, known_labels, features, [max_alert_rate], seed)[0]


def calibrator_candidates(df: DataFrame, calibrators: Sequence[NoveltyCalibrator], unknown: Column) -> list[dict]:
    """Rates of calibrators that share a model, for the profile tuner: scored once, counted in one aggregate."""
    scored = calibrated_score(df, calibrators[0].model).select("novelty_calibrated_score", unknown.alias("_u"))
    aggs = [F.count(F.lit(1)).alias("n"), F.count_if("_u").alias("nu")]
    for i, c in enumerate(calibrators):
        flag = ge(F.col("novelty_calibrated_score"), F.lit(c.threshold))
        aggs += [F.count_if(flag).alias(f"a{i}"), F.count_if(flag & F.col("_u")).alias(f"h{i}")]
    r = scored.agg(*aggs).first()
    return [
        {
            "method": "calibrator", "max_alert_budget": c.max_alert_rate, "chosen_threshold": c.threshold,
            "unknown_recall": r[f"h{i}"] / max(r["nu"], 1), "alert_rate": r[f"a{i}"] / max(r["n"], 1),
            "known_alert_rate": (r[f"a{i}"] - r[f"h{i}"]) / max(r["n"] - r["nu"], 1),
        }
        for i, c in enumerate(calibrators)
    ]


def calibrated_score(df: DataFrame, model: LinearModel, out: str = "novelty_calibrated_score") -> DataFrame:
    return model.add_probabilities(df, "_n").withColumn(out, F.col("_n1")).drop("_n0", "_n1")


def apply_novelty_calibrator(df: DataFrame, c: NoveltyCalibrator) -> DataFrame:
    out = calibrated_score(df, c.model)
    return out.withColumn("novelty_calibrated_flag", ge(F.col("novelty_calibrated_score"), F.lit(c.threshold)))
