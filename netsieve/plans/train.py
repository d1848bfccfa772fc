"""Model queries: fitted statistics with SQL counterparts, trained models by rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from netsieve.functions.guards import col
from netsieve.models import anomaly as an, boosting as bo, evaluate as ev
from netsieve.models.calibrate import fit_calibrator, fit_isotonic, isotonic_value
from netsieve.models.linear import argmax_label, fit_logistic, score_supervised, soft_vote, top_contributions
from netsieve.models.neural import fit_neural
from netsieve.models.novelty import (
    CALIBRATOR_FEATURES, Detector, apply_novelty_calibrator, calibrator_candidates, fit_novelty_calibrator,
    fit_novelty_calibrators, score_and_fuse,
)
from netsieve.models.preprocess import fit_scaler
from netsieve.operators import prototypes as pt, retrieval as rt
from netsieve.operators.mapping import to_benign_attack
from netsieve.operators.metrics import classification_report
from netsieve.operators.ranking import exact_quantiles
from netsieve.operators.triage import count_by, decision_counts
from netsieve.plans.measure import one_row, r6, triaged
from netsieve.plans.registry import query
from netsieve.plans.views import (
    BINARY_COEF, BINARY_INTERCEPT, CONTRACT, CONTRACT_COLUMNS, FAMILY_COEF, FAMILY_INTERCEPT, FLOWS, SCALED, STATS, TO_PROBS, contract, detector, family_model, flows, fused,
    table, with_,
)

# ---- preprocessing and fixed-coefficient scoring -------------------------------------------------------------


def _gappy(spark: SparkSession, sf: str) -> DataFrame:
    """Contract rows with gaps: no duration where it is 0, one constant and one empty column."""
    c = contract(spark, sf).withColumn("Flow Duration", F.when(col("Flow Duration") > 0, col("Flow Duration")))
    return c.withColumns({"Total Backward Packets": F.lit(3.0), "Empty": F.lit(None).cast("double")})


@query(
    "m1_impute_and_scale",
    with_(FLOWS, CONTRACT, "g AS (SELECT uid, CASE WHEN c2 > 0 THEN c2 END AS c2, c5 FROM contract)", "md AS (SELECT median(c2) AS m FROM g)",
          "f AS (SELECT uid, coalesce(c2, m) AS c2, c5 FROM g, md)", "st AS (SELECT avg(c2) AS m2, stddev_pop(c2) AS s2, avg(c5) AS m5, stddev_pop(c5) AS s5 FROM f)",
          select="SELECT uid, round((c2 - m2) / s2, 6) AS duration, round((c5 - m5) / s5, 6) AS bytes, 0.0::DOUBLE AS constant, 3 AS kept FROM f, st"),
)
def m1(spark: SparkSession, sf: str) -> DataFrame:
    g = _gappy(spark, sf)
    scaler = fit_scaler(g, ["Flow Duration", "Flow Bytes/s", "Total Backward Packets", "Empty"])
    names = dict(zip(scaler.columns, scaler.expressions()))
    return g.select(
        "uid", F.round(names["Flow Duration"], 6).alias("duration"), F.round(names["Flow Bytes/s"], 6).alias("bytes"),
        F.round(names["Total Backward Packets"], 6).alias("constant"), F.lit(len(scaler.columns)).alias("kept"),
    )


@query(
    "m7_supervised_scores",
    with_(*TO_PROBS, select="SELECT uid, round(p1, 6) AS score, round(greatest(p0, p1, p2), 6) AS proba_max, round(p0, 6) AS p_Benign, round(p1, 6) AS p_DoS, round(p2, 6) AS p_PortScan, CASE WHEN p0 >= p1 AND p0 >= p2 THEN 'Benign' WHEN p1 >= p2 THEN 'DoS' ELSE 'PortScan' END AS prediction FROM probs"),
)
def m7(spark: SparkSession, sf: str) -> DataFrame:
    d = detector(spark, sf)
    out = score_supervised(contract(spark, sf), family_model(d.families.scaler), ["uid"], proba_all=True)
    return out.select("uid", *r6("score", "proba_max", "p_Benign", "p_DoS", "p_PortScan"), "prediction")


@query(
    "m4_soft_vote",
    with_(*TO_PROBS, select="SELECT uid, round((p0 + 1 - p_attack) / 2, 6) AS benign, round((p1 + p_attack / 2) / 2, 6) AS dos, round((p2 + p_attack / 2) / 2, 6) AS scan FROM probs"),
)
def m4(spark: SparkSession, sf: str) -> DataFrame:
    """Family probabilities averaged with the binary model's, its attack share halved between the families."""
    d = detector(spark, sf)
    out = d.binary.add_probabilities(d.families.add_probabilities(contract(spark, sf), "_f"), "_b")
    attack = F.col("_b0")
    both = soft_vote([[F.col("_f0"), F.col("_f1"), F.col("_f2")], [F.col("_b1"), attack / 2.0, attack / 2.0]])
    return out.select("uid", *[F.round(v, 6).alias(n) for v, n in zip(both, ("benign", "dos", "scan"))])


CONTRIB = "contrib AS (" + " UNION ALL ".join(
    f"SELECT uid, {i} AS i, '{n}' AS name, {w}::DOUBLE * z{i} AS contribution FROM scaled" for i, (n, w) in enumerate(zip(CONTRACT_COLUMNS, [-0.3, 0.8, 0.7, -0.2, 0.4, -0.6]), 1)
) + "), ranked AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY round(abs(contribution), 9) DESC, i) AS rn FROM contrib)"


@query(
    "m14_top_contributions",
    with_(FLOWS, CONTRACT, STATS, SCALED, CONTRIB, select="SELECT uid, string_agg(name, ',' ORDER BY rn) AS names, round(max(abs(contribution)), 6) AS largest FROM ranked WHERE rn <= 3 GROUP BY uid"),
)
def m14(spark: SparkSession, sf: str) -> DataFrame:
    out = top_contributions(contract(spark, sf), detector(spark, sf).families, 3, class_row=1)
    f = F.col("top_features")
    return out.select("uid", F.array_join(f["name"], ",").alias("names"), F.round(F.abs(f[0]["contribution"]), 6).alias("largest"))


# ---- open set and retrieval ----------------------------------------------------------------------------------

DIM = 64
MEANS = "means AS (SELECT label, " + ", ".join(f"avg(CAST(embedding[{i}] AS DOUBLE)) AS m{i}" for i in range(1, DIM + 1)) + " FROM embeddings GROUP BY label)"
DISTANCES = "nearest AS (SELECT vec_id, min(sqrt(" + " + ".join(f"(embedding[{i}]::DOUBLE - m{i}) * (embedding[{i}]::DOUBLE - m{i})" for i in range(1, DIM + 1)) + ")) AS d FROM embeddings, means GROUP BY vec_id)"


def _vector_columns() -> list:
    return [F.col("embedding")[i] for i in range(DIM)]


@query("a11_class_means", "SELECT CAST(label AS VARCHAR) AS class, i AS dim, round(avg(CAST(embedding[i] AS DOUBLE)), 6) AS mean FROM embeddings, range(1, 65) r(i) GROUP BY label, i")
def a11(spark: SparkSession, sf: str) -> DataFrame:
    out = pt.class_means(table(spark, sf, "embeddings"), "label", _vector_columns())
    return out.select("class", F.posexplode("mean").alias("dim", "mean")).select("class", (F.col("dim") + 1).cast("bigint").alias("dim"), F.round("mean", 6).alias("mean"))


@query("j8_nearest_prototype", with_(MEANS, DISTANCES, select="SELECT vec_id, round(d, 6) AS distance FROM nearest"))
def j8(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    protos = pt.fit_prototypes(e, "label", _vector_columns())
    return e.select("vec_id", F.round(pt.nearest_distance_vector(F.col("embedding"), protos), 6).alias("distance"))


@query(
    "m9_open_set",
    with_(MEANS, DISTANCES, "ends AS (SELECT min(d) AS lo, max(d) AS hi FROM nearest)", select="SELECT vec_id, round(d, 6) AS open_set_nearest_distance, round((d - lo) / (hi - lo), 6) AS open_set_ood_score FROM nearest, ends"),
)
def m9(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    protos = pt.fit_prototypes(e, "label", _vector_columns())
    out = pt.score_open_set(e, pt.nearest_distance_vector(F.col("embedding"), protos))
    return out.select("vec_id", *r6("open_set_nearest_distance", "open_set_ood_score"))


TOKENS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')"
TFIDF = f"""dt AS (SELECT doc_id, {TOKENS} AS t FROM documents), qt AS (SELECT item_id, {TOKENS} AS t FROM benchmark),
dg AS (SELECT doc_id, unnest(list_concat(t, [t[i] || ' ' || t[i + 1] for i in range(1, len(t))])) AS term FROM dt),
qg AS (SELECT item_id, unnest(list_concat(t, [t[i] || ' ' || t[i + 1] for i in range(1, len(t))])) AS term FROM qt),
dc AS (SELECT doc_id, term, count(*) AS tf FROM dg GROUP BY ALL), qc AS (SELECT item_id, term, count(*) AS tf FROM qg GROUP BY ALL),
voc AS (SELECT term, count(*) AS df FROM dc GROUP BY term),
idf AS (SELECT term, df, ln((1.0 + (SELECT count(*) FROM documents)) / (1.0 + df)) + 1.0 AS idf FROM voc),
dr AS (SELECT doc_id, term, tf * idf AS w FROM dc JOIN idf USING (term)), qr AS (SELECT item_id, term, tf * idf AS w FROM qc JOIN idf USING (term)),
dw AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS w FROM dr), qw AS (SELECT item_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY item_id)) AS w FROM qr)"""


@query("m12_index", with_(TFIDF, select="SELECT doc_id, count(*) AS n_terms, round(max(w), 6) AS top_weight FROM dw GROUP BY doc_id"))
def m12(spark: SparkSession, sf: str) -> DataFrame:
    _, stored = rt.build_index(table(spark, sf, "documents"), "doc_id", "text")
    return stored.select("doc_id", "n_terms", F.round("top", 6).alias("top_weight"))


@query("m12_vocabulary", with_(TFIDF, select="SELECT term, df, round(idf, 6) AS idf FROM idf"))
def m12b(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    return rt.vocabulary(d, rt.term_counts(d, "doc_id", "text")).select("term", "df", *r6("idf"))


@query(
    "j9_retrieve",
    with_(TFIDF, """hits AS (SELECT item_id, doc_id, round(sum(dw.w * qw.w), 9) AS score FROM dw JOIN qw USING (term) GROUP BY ALL),
    every AS (SELECT b.item_id, d.doc_id, coalesce(h.score, 0) AS score FROM benchmark b CROSS JOIN documents d LEFT JOIN hits h ON h.item_id = b.item_id AND h.doc_id = d.doc_id),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rn FROM every)""",
    select="SELECT item_id, doc_id, round(score, 6) AS score, rn AS rank FROM ranked WHERE rn <= 5"),
)
def j9(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    index = rt.build_index(docs, "doc_id", "text")
    out = rt.retrieve(docs, index, table(spark, sf, "benchmark"), "doc_id", "item_id", "text", 5)
    return out.select("item_id", "doc_id", *r6("score"), F.col("rank").cast("bigint").alias("rank"))


def _corpus(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as a knowledge corpus, each naming a family and a few words a triage query uses."""
    c = F.col
    family = F.when(c("doc_id") % 3 == 0, F.lit("PortScan")).when(c("doc_id") % 3 == 1, F.lit("DoS")).otherwise(F.lit("Benign"))
    return table(spark, sf, "documents").select(
        "doc_id", F.concat(F.lit("doc "), "doc_id").alias("title"), family.alias("family"), "source",
        F.concat_ws(" ", F.lit("prediction"), family, F.when(c("doc_id") % 2 == 0, F.lit("novel_flag high_open_set_ood")), c("text")).alias("text"),
    )


@query("m13_explain_rows")
def m13(spark: SparkSession, sf: str) -> DataFrame:
    corpus = _corpus(spark, sf)
    out = rt.explain_rows(fused(spark, sf), corpus, rt.build_index(corpus, "doc_id", "text"))
    return out.select("uid", "decision_label", "llm_explanation_json")


# ---- trained models ------------------------------------------------------------------------------------------


def _split(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Two thirds of the flows to train, one third to validate, by key hash."""
    rows = contract(spark, sf)
    part = F.pmod(F.xxhash64("uid"), F.lit(3))
    return rows.where(part != 0), rows.where(part == 0)


@query("m2_logistic")
def m2(spark: SparkSession, sf: str) -> DataFrame:
    train, val = _split(spark, sf)
    model = fit_logistic(train, "label", CONTRACT_COLUMNS, balanced=True, rare_power=0.5)
    return classification_report(ev.predict(val, model), "label", "prediction")


@query("m3_boosting")
def m3(spark: SparkSession, sf: str) -> DataFrame:
    """Production settings: up to 400 rounds of 63 leaves, early stopping."""
    train, val = _split(spark, sf)
    return classification_report(ev.predict(val, bo.fit_boosted(train, "label", CONTRACT_COLUMNS)), "label", "prediction")


CUTS = 16
LONG = "long AS (" + " UNION ALL ".join(f"SELECT label, '{n}' AS feature, c{i} AS x FROM contract" for i, n in enumerate(CONTRACT_COLUMNS, 1)) + ")"


@query(
    "m3_first_cuts",
    with_(
        FLOWS, CONTRACT, LONG,
        f"q AS (SELECT feature, list_distinct(quantile_cont(x, [{', '.join(f'{i / CUTS!r}' for i in range(1, CUTS))}])) AS e, max(x) AS top FROM long GROUP BY feature)",
        "edges AS (SELECT feature, edge FROM (SELECT feature, unnest(e) AS edge, top FROM q) WHERE edge < top)",
        "prior AS (SELECT label AS class, count(*) / (SELECT count(*) FROM contract) AS p, (SELECT count(*) FROM contract) AS n FROM contract GROUP BY label)",
        "lefts AS (SELECT feature, edge, class, n, p, count(*) AS rows_left, count(*) * p - count(*) FILTER (WHERE label = class) AS g, count(*) * p * (1 - p) AS h FROM edges JOIN long USING (feature), prior WHERE x <= edge GROUP BY feature, edge, class, n, p)",
        select="""SELECT class, feature, round(edge, 6) AS edge, rows_left, floor(g * 10000 + 0.318) / 10000 + 0.0 AS gradient_left, floor(h * 1000 + 0.318) / 1000 AS hessian_left,
        CASE WHEN rows_left >= 15 AND n - rows_left >= 15 AND h >= 0.001 AND n * p * (1 - p) - h >= 0.001 THEN round(g * g / (h + 0.05) + g * g / (n * p * (1 - p) - h + 0.05), 5) END AS gain FROM lefts""",
    ),
)
def m3b(spark: SparkSession, sf: str) -> DataFrame:
    """The exact histograms of the first trees, as sums below each cut, and the gains of all cuts."""
    rows = contract(spark, sf)
    found = exact_quantiles(rows, CONTRACT_COLUMNS, [i / CUTS for i in range(1, CUTS)])
    top = rows.agg(*[F.max(col(c)).alias(f"m{i}") for i, c in enumerate(CONTRACT_COLUMNS)]).first()
    edges = [sorted({v for v in found[c] if v < top[i]}) for i, c in enumerate(CONTRACT_COLUMNS)]
    booster = bo.Booster(rows, "label", CONTRACT_COLUMNS, [bo.Task(bo.BoostingSettings(early_stopping=False))], edges=edges)
    booster.start()
    return booster.cuts().select("class", "feature", F.round("edge", 6).alias("edge"), "rows_left", 
        # sums of fractions often end in 5: cut where they do not
        (F.floor(F.col("gradient_left") * 10000 + 0.318) / 10000 + 0.0).alias("gradient_left"), (F.floor(F.col("hessian_left") * 1000 + 0.318) / 1000).alias("hessian_left"), F.round("gain", 5).alias("gain"),
    )


@query("m4_voting_ensemble")
def m4b(spark: SparkSession, sf: str) -> DataFrame:
    train, val = _split(spark, sf)
    lr = fit_logistic(train, "label", CONTRACT_COLUMNS)
    out = bo.fit_boosted(train, "label", CONTRACT_COLUMNS).add_probabilities(lr.add_probabilities(val, "_a"), "_b")
    k = range(len(lr.classes))
    probs = soft_vote([[F.col(f"_a{i}") for i in k], [F.col(f"_b{i}") for i in k]])
    return classification_report(out.withColumn("prediction", argmax_label(probs, lr.classes)), "label", "prediction")


def _calibrated(spark: SparkSession, sf: str, method: str) -> DataFrame:
    train, val = _split(spark, sf)
    lr = fit_logistic(train, "label", CONTRACT_COLUMNS)
    scored = val
    for i, z in enumerate(lr.logits()):
        scored = scored.withColumn(f"_s{i}", z)
    names = [f"_s{i}" for i in range(len(lr.classes))]
    cal = fit_calibrator(scored, "label", lr.classes, names, method)
    probs = cal.probabilities([F.col(n) for n in names])
    return scored.select("uid", "label", *[F.round(p, 9).alias(f"p{i}") for i, p in enumerate(probs)])


@query("m5_sigmoid_calibration")
def m5(spark: SparkSession, sf: str) -> DataFrame:
    return _calibrated(spark, sf, "sigmoid")


@query("m5_isotonic_calibration")
def m5b(spark: SparkSession, sf: str) -> DataFrame:
    return _calibrated(spark, sf, "isotonic")


@query(
    "m5_isotonic_fit",
    with_(
        FLOWS, "points AS (SELECT orig_pkts AS x, avg(CASE WHEN label = 'DoS' THEN 1.0::DOUBLE ELSE 0.0 END) AS y, count(*) AS w FROM flows GROUP BY orig_pkts)",
        "sums AS (SELECT x, sum(y * w) OVER (ORDER BY x) AS s, sum(w) OVER (ORDER BY x) AS n, y * w AS own, w FROM points)",
        "means AS (SELECT a.x AS lo, b.x AS hi, (b.s - a.s + a.own) / (b.n - a.n + a.w) AS m FROM sums a JOIN sums b ON a.x <= b.x)",
        "least_of AS (SELECT p.x, m.lo, min(m.m) AS m FROM points p JOIN means m ON m.lo <= p.x AND m.hi >= p.x GROUP BY p.x, m.lo)",
        select="SELECT x AS score, round(max(m), 9) AS fitted FROM least_of GROUP BY x",
    ),
)
def m5c(spark: SparkSession, sf: str) -> DataFrame:
    """The share of DoS flows by number of packets, made monotone: the largest, over beginnings, of the least mean over ends."""
    rows = flows(spark, sf).select(F.col("orig_pkts").alias("f"), (F.col("label") == "DoS").cast("double").alias("y"))
    curve = fit_isotonic(rows)
    return rows.select("f").distinct().select(F.col("f").alias("score"), F.round(isotonic_value(F.col("f"), curve), 9).alias("fitted"))


@query("m6_neural_classifier")
def m6(spark: SparkSession, sf: str) -> DataFrame:
    train, val = _split(spark, sf)
    model = fit_neural(train, "label", CONTRACT_COLUMNS, hidden=(16, 8), max_iter=20, validation=val, patience=1, stage=10)
    return classification_report(ev.predict(val, model), "label", "prediction")


def _benign(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    train, val = _split(spark, sf)
    return train.where(F.col("label") == "Benign"), val.where(F.col("label") == "Benign")


@query("m8a_isolation_forest")
def m8a(spark: SparkSession, sf: str) -> DataFrame:
    train, val = _benign(spark, sf)
    model = an.fit_isolation_forest(train, ["uid"], CONTRACT_COLUMNS)
    return an.score_anomaly(contract(spark, sf), model, an.fit_threshold(val, model), ["uid", "label"])


@query("m8b_autoencoder")
def m8b(spark: SparkSession, sf: str) -> DataFrame:
    train, val = _benign(spark, sf)
    model = an.fit_autoencoder(train, CONTRACT_COLUMNS, epochs=3, hidden=(16, 8), latent=3)
    return an.score_anomaly(contract(spark, sf), model, an.fit_threshold(val, model), ["uid", "label"])


@query("m8c_anomaly_job")
def m8c(spark: SparkSession, sf: str) -> DataFrame:
    """Train on benign rows, store, load, score everything, count the flags per label."""
    from netsieve.session import run_dir
    from netsieve.sources.bundles import load_bundle, save_bundle

    train, val = _benign(spark, sf)
    model = an.fit_isolation_forest(train, ["uid"], CONTRACT_COLUMNS, trees=50)
    path = run_dir(spark, "m8c")
    save_bundle(spark, path, model.to_bundle(an.fit_threshold(val, model), percentile=99.0))
    bundle = load_bundle(spark, path)
    out = an.score_anomaly(contract(spark, sf), an.load_anomaly_model(bundle), bundle.config["threshold"], ["label"])
    return count_by(out, "label", "is_anomaly", "model_type")


KNOWN = ["Benign", "DoS"]


@query("m10_novelty_calibrator")
def m10(spark: SparkSession, sf: str) -> DataFrame:
    s = triaged(spark, sf)
    cal, _ = fit_novelty_calibrator(s, ["uid"], "label", KNOWN)
    out = apply_novelty_calibrator(s, cal)
    return out.select("uid", "label", *r6("novelty_calibrated_score"), "novelty_calibrated_flag")


@query("m11d_calibrator_profiles")
def m11d(spark: SparkSession, sf: str) -> DataFrame:
    """The profile tuner with both kinds of candidates: six quantiles and six calibrator budgets."""
    from netsieve.operators.mapping import unknown_label
    from netsieve.operators.search import BUDGETS, tune_profiles
    from netsieve.session import materialize

    s = materialize(triaged(spark, sf).select("uid", "label", *CALIBRATOR_FEATURES), "m11d")
    unknown = unknown_label(F.col("label"), KNOWN, trim=False)
    fits = fit_novelty_calibrators(s, ["uid"], "label", KNOWN, CALIBRATOR_FEATURES, BUDGETS)
    got = tune_profiles(s, unknown, calibrator_candidates(s, [c for c, _ in fits], unknown))
    rows = [
        F.struct(F.lit(n).alias("profile"), F.lit(got[n]["method"]).alias("method"), F.lit(float(got[n]["unknown_recall"])).alias("unknown_recall"), F.lit(float(got[n]["alert_rate"])).alias("alert_rate"))
        for n in ("balanced_profile", "high_recall_profile")
    ]
    return spark.range(1).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def _noise(j: int) -> str:
    unit = [f"((CAST('0x' || substr(md5(CAST(uid AS VARCHAR) || '|42|{j}|{k}'), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0::DOUBLE)" for k in (0, 1)]
    return f"sqrt(-2.0::DOUBLE * ln({unit[0]})) * cos(6.283185307179586::DOUBLE * {unit[1]})"


NOISE = "noise AS (SELECT scaled.*, " + ", ".join(f"{_noise(j)} AS g{j + 1}" for j in range(6)) + " FROM scaled)"
SPREADS = "spreads AS (SELECT " + ", ".join(f"CASE WHEN stddev_pop(z{i}) > 0 THEN stddev_pop(z{i}) ELSE 1.0 END AS d{i}" for i in range(1, 7)) + " FROM scaled)"


def _noisy(scale: float) -> str:
    return "noisy AS (SELECT " + ", ".join(f"z{i}, z{i} + g{i} * {scale!r}::DOUBLE * d{i} AS y{i}" for i in range(1, 7)) + " FROM noise, spreads)"


def _dot_sql(weights: list[float], bias: float, x: str) -> str:
    return f"{bias}::DOUBLE" + "".join(f" + ({w}::DOUBLE) * {x}{i}" for i, w in enumerate(weights, 1))


def _family_sql(x: str) -> str:
    a, b, c = (f"({_dot_sql(w, bias, x)})" for w, bias in zip(FAMILY_COEF, FAMILY_INTERCEPT))
    return f"CASE WHEN {a} >= {b} AND {a} >= {c} THEN 0 WHEN {b} >= {c} THEN 1 ELSE 2 END"


FLIPS = "SELECT avg(CASE WHEN before <> after THEN 1.0::DOUBLE ELSE 0.0 END) AS prediction_flip_rate, count(*) AS n_rows FROM pairs"


@query("m15_perturbation", with_(FLOWS, CONTRACT, STATS, SCALED, NOISE, SPREADS, _noisy(0.02), f"pairs AS (SELECT {_family_sql('z')} AS before, {_family_sql('y')} AS after FROM noisy)", select=FLIPS))
def m15(spark: SparkSession, sf: str) -> DataFrame:
    return ev.perturbation_flip_rate(contract(spark, sf), detector(spark, sf).families, ["uid"], max_rows=None)


@query("a18_flip_rate", with_(FLOWS, CONTRACT, STATS, SCALED, NOISE, SPREADS, _noisy(0.1), f"pairs AS (SELECT ({_dot_sql(BINARY_COEF, BINARY_INTERCEPT, 'z')}) > 0 AS before, ({_dot_sql(BINARY_COEF, BINARY_INTERCEPT, 'y')}) > 0 AS after FROM noisy)", select=FLIPS))
def a18(spark: SparkSession, sf: str) -> DataFrame:
    return ev.perturbation_flip_rate(contract(spark, sf), detector(spark, sf).binary, ["uid"], 0.1, max_rows=None)


@query("m16_leave_family_out")
def m16(spark: SparkSession, sf: str) -> DataFrame:
    return ev.leave_family_out_matrix(contract(spark, sf), "label", CONTRACT_COLUMNS, 3, max_iter=20)


@query("m17_holdout_thresholds")
def m17(spark: SparkSession, sf: str) -> DataFrame:
    train, val = _split(spark, sf)
    got = ev.holdout_thresholds(train, val, "label", CONTRACT_COLUMNS, detector(spark, sf), 2, max_iter=20)
    return one_row(spark, got["selected_fusion_thresholds"])


@query("m18_random_search")
def m18(spark: SparkSession, sf: str) -> DataFrame:
    """The best of 12 of the 648 settings, each under three folds."""
    return one_row(spark, bo.search_boosting(contract(spark, sf), ["uid"], "label", CONTRACT_COLUMNS, ev.BOOSTING_SPACE)[0])


@query("m19_lab_chain")
def m19(spark: SparkSession, sf: str) -> DataFrame:
    """Trained models, prototypes, fusion and evidence in one chain, written once and summarised."""
    from netsieve.session import materialize

    train, val = _split(spark, sf)
    named = train.withColumn("binary", to_benign_attack(F.col("label")))
    scaler = fit_scaler(train, CONTRACT_COLUMNS)
    binary = fit_logistic(named, "binary", CONTRACT_COLUMNS, scaler=scaler, max_iter=20)
    families = fit_logistic(train, "label", CONTRACT_COLUMNS, scaler=scaler, max_iter=20)
    forest = an.fit_isolation_forest(train.where(F.col("label") == "Benign"), ["uid"], CONTRACT_COLUMNS, trees=50)
    threshold = an.fit_threshold(val.where(F.col("label") == "Benign"), forest, 95.0)
    protos = pt.fit_prototypes(train, "label", scaler.expressions(), families.classes)
    d = Detector(binary, families, forest.score(), threshold, forest.model_type, forest.version, protos)
    corpus = _corpus(spark, sf)
    triage = materialize(score_and_fuse(val, d), "m19")
    out = rt.explain_rows(triage, corpus, rt.build_index(corpus, "doc_id", "text"))
    return decision_counts(out).withColumn("has_open_set", F.lit(True)).withColumn(
        "rows_with_explanations", out.agg(F.count_if(F.length("llm_explanation_json") > 0)).scalar()
    )
