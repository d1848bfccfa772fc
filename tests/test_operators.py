"""Rank selection, splits, metrics, searches, mapping and schema operators against plain re-computation."""

import math
import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from netsieve.operators import drift, mapping as mp, metrics as me, ranking as rk, reports as rp, schema as sc, search as se

NAN = float("nan")


def frame(spark, values, name="x", parts=3):
    return spark.createDataFrame([(v,) for v in values], f"{name} double").repartition(parts)


@pytest.mark.parametrize("small", [3, 100_000])
def test_exact_quantiles(spark, small):
    rng = np.random.default_rng(1)
    heavy = [5.0] * 400 + list(rng.normal(size=600))
    probs = [0.0, 0.01, 0.5, 0.97, 1.0]
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(heavy, rng.integers(0, 3, 1000))], "a double, b double")
    got = rk.exact_quantiles(df, ["a", "b"], probs, small)
    for name, values in (("a", heavy), ("b", [r["b"] for r in df.collect()])):
        assert got[name] == pytest.approx([np.percentile(values, 100 * p) for p in probs])


def test_exact_quantiles_skip_missing(spark):
    df = frame(spark, [1.0, None, NAN, 3.0])
    assert rk.exact_quantiles(df.withColumn("e", F.lit(None).cast("double")), ["x", "e"], [0.5]) == {"x": [2.0], "e": [None]}


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(values=st.lists(st.integers(-5, 5), min_size=1, max_size=40), p=st.floats(0, 1))
def test_quantile_property(spark, values, p):
    got = rk.exact_quantiles(frame(spark, [float(v) for v in values]), ["x"], [p], small=2)["x"][0]
    assert got == pytest.approx(np.percentile(values, 100 * p))


def test_running_totals_ascending_and_next(spark):
    df = spark.createDataFrame([(float(i % 7), 1) for i in range(70)], "x double, n bigint")
    rows = sorted(rk.running_totals(df, "x", ["n"], descending=False, buckets=3).collect(), key=lambda r: r["x"])
    assert [r["cum_n"] for r in rows] == [10 * (i + 1) for i in range(7)]
    assert [r["next_n"] for r in rows] == [10] * 6 + [None]


def test_top_n_and_latest(spark):
    df = spark.createDataFrame([("a", i) for i in range(50)] + [("b", 1)], "g string, v int")
    got = rk.top_n_per_group(df, ["g"], [F.col("v").desc()], 3, ["v"]).collect()
    assert sorted((r["g"], r["v"]) for r in got) == [("a", 47), ("a", 48), ("a", 49), ("b", 1)]
    assert sorted(map(tuple, rk.latest_per_key(df, ["g"], ["v"]).collect())) == [("a", 49), ("b", 1)]


def test_split_does_not_depend_on_partitioning(spark):
    df = spark.createDataFrame([(i, "ab"[i % 10 == 0]) for i in range(500)], "id int, y string")
    one = rk.split_train_val_test(df.repartition(1), ["id"], "y")
    many = rk.split_train_val_test(df.repartition(7), ["id"], "y")
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, many.collect()))
    counts = {(r["y"], r["split"]): r["count"] for r in one.groupBy("y", "split").count().collect()}
    assert counts == {("a", "test"): 90, ("a", "val"): 90, ("a", "train"): 270, ("b", "test"): 10, ("b", "val"): 10, ("b", "train"): 30}
    tiny = spark.createDataFrame([(1, "only"), (2, None)], "id int, y string")
    assert {r["split"] for r in rk.split_train_val_test(tiny, ["id"], "y").collect()} == {"train"}
    with pytest.raises(KeyError):
        rk.split_train_val_test(df, ["id"], "nope")


def test_time_split_with_one_time_holding_everything(spark):
    df = spark.createDataFrame([(i, 7) for i in range(100)], "id int, t int")
    got = {r["split"]: r["count"] for r in rk.time_split(df, F.col("t"), ["id"]).groupBy("split").count().collect()}
    assert got == {"train": 64, "val": 16, "test": 20}


# ---- metrics -------------------------------------------------------------------------------------------------


def test_report_with_absent_classes(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("b", "b"), ("c", "a")], "y string, p string")
    rep = {r["label"]: r for r in me.classification_report(df, "y", "p").collect()}
    assert (rep["a"]["precision"], rep["a"]["recall"]) == (0.5, 0.5)
    assert rep["b"]["precision"] == pytest.approx(2 / 3) and rep["b"]["recall"] == 1.0
    assert (rep["c"]["precision"], rep["c"]["recall"], rep["c"]["f1"], rep["c"]["support"]) == (0, 0, 0, 1)
    assert rep["accuracy"]["f1"] == pytest.approx(0.6) and rep["macro avg"]["f1"] == pytest.approx((0.5 + 0.8 + 0) / 3)
    assert rep["weighted avg"]["recall"] == pytest.approx(0.6)
    assert me.classification_report(df.limit(0), "y", "p").count() == 0


def curve_by_hand(y, s):
    """ROC with straight-run points dropped, and average precision, computed directly."""
    order = sorted(set(s), reverse=True)
    p, n = sum(y), len(y) - sum(y)
    pts = [(t, sum(a for a, b in zip(y, s) if b >= t), sum(1 - a for a, b in zip(y, s) if b >= t)) for t in order]
    area, ap, last = 0.0, 0.0, (0, 0)
    for _, tp, fp in pts:
        area += (fp - last[1]) * (tp + last[0]) / 2
        ap += (tp - last[0]) / p * (tp / (tp + fp))
        last = (tp, fp)
    keep = []
    for i, (t, tp, fp) in enumerate(pts):
        if 0 < i < len(pts) - 1:
            d0 = (tp - pts[i - 1][1], fp - pts[i - 1][2])
            d1 = (pts[i + 1][1] - tp, pts[i + 1][2] - fp)
            if d0 == d1:
                continue
        keep.append((t, tp / p, fp / n))
    return area / (p * n), ap, [(math.inf, 0.0, 0.0), *keep]


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=st.lists(st.tuples(st.integers(0, 1), st.integers(0, 8)), min_size=4, max_size=40))
def test_curves_property(spark, rows):
    rows = rows + [(0, 3), (1, 4)]
    y, s = [a for a, _ in rows], [b / 8 for _, b in rows]
    df = spark.createDataFrame([("Benign" if a == 0 else "x", b) for a, b in zip(y, s)], "label string, score double").repartition(3)
    got = me.binary_curves(df, "label", "score", "Benign", (0.0, 0.1, 0.5)).collect()
    auc, ap, kept = curve_by_hand(y, s)
    for r in got:
        want = [k for k in kept if k[2] <= r["target_fpr"]][-1]
        assert (r["roc_auc"], r["pr_auc"]) == (pytest.approx(auc), pytest.approx(ap))
        assert (r["threshold"], r["tpr"], r["fpr"]) == pytest.approx(want)


def test_curve_of_one_class_has_no_auc(spark):
    df = spark.createDataFrame([("x", 0.1), ("x", 0.2)], "label string, score double")
    assert me.binary_curves(df, "label", "score", "Benign").first()["roc_auc"] is None


def test_anomaly_evaluation(spark):
    df = spark.createDataFrame([("BENIGN", 0.1), ("BENIGN", 0.9), ("x", 0.9), ("x", 0.5), ("y", NAN)], "label string, s double")
    r = me.anomaly_evaluation(df, "label", "s", 0.5).first()
    assert (r["tn"], r["fp"], r["fn"], r["tp"], r["alerts_per_10k_rows"]) == (1, 1, 2, 1, 4000.0)


def test_class_balance_and_weights(spark):
    df = spark.createDataFrame([("a",)] * 6 + [("b",)] * 2, "y string")
    r = me.class_balance(df, "y").first()
    assert (r["n_rows"], r["n_classes"], r["majority_class"], r["majority_count"], r["max_min_ratio"]) == (8, 2, "a", 6, 3.0)
    assert me.class_balance(df.where("y = 'a'"), "y").first()["max_min_ratio"] is None
    w = {r["_class"]: r["_w"] for r in me.class_weights(df, "y").collect()}
    assert w == {"a": pytest.approx(8 / 12), "b": pytest.approx(2.0)}
    boosted = me.with_class_weight(df, "y", 0.5)
    assert boosted.agg(F.avg("weight")).first()[0] == pytest.approx(1.0)


def test_drift(spark):
    ref = spark.createDataFrame([(1.0, 3.0), (2.0, 4.0)], "a double, b double")
    smp = spark.createDataFrame([(10.0, 3.0), (20.0, 4.0)], "a double, b double")
    rows = drift.numeric_drift(ref, smp).collect()
    assert [r["column"] for r in rows] == ["a", "b"] and rows[0]["abs_mean_shift_ratio"] == pytest.approx(9.0) and rows[1]["ref_std"] == 0.5


# ---- searches ------------------------------------------------------------------------------------------------


def test_choose_threshold_against_loop(spark):
    rng = random.Random(3)
    rows = [(round(rng.random(), 3), rng.random() < 0.2) for _ in range(300)] + [(NAN, True), (1.0, True), (0.3, False)]
    df = spark.createDataFrame(rows, "s double, u boolean")
    best, top = 0.5, -1.0
    for t in np.linspace(0, 1, 1001):
        hit = [s >= t for s, _ in rows]
        rec = sum(h and u for h, (_, u) in zip(hit, rows)) / sum(u for _, u in rows)
        if sum(hit) / len(rows) <= 0.1 and rec > top:
            top, best = rec, t
    got = se.choose_threshold(df, "s", F.col("u"), 0.1)
    assert got["threshold"] == pytest.approx(best) and got["unknown_recall"] == pytest.approx(top)
    never = se.choose_threshold(spark.createDataFrame([(2.0, True)], "s double, u boolean"), "s", F.col("u"), 0.1)
    assert never == {"threshold": 0.5, "alert_rate": 1.0, "unknown_recall": 0.0}


@pytest.mark.parametrize("with_open", [True, False])
def test_budget_search_against_loop(spark, with_open):
    rng = random.Random(5)
    rows = [(rng.choice(["k ", "u"]), rng.random(), rng.uniform(40, 100), rng.random()) for _ in range(120)]
    df = spark.createDataFrame(rows, "label string, p_attack double, suspected_zero_day_pct double, open_set_ood_score double")
    unknown = [r[0] == "u" for r in rows]
    best = None

    def consider(*key, alert):
        nonlocal best
        rate = sum(alert) / len(rows)
        rec = sum(a and u for a, u in zip(alert, unknown)) / sum(unknown)
        if rate <= 0.1 and (best is None or rec > best[0]):
            best = (rec, rate, *key)

    for p in np.linspace(0.05, 0.95, 19):
        for z in np.linspace(50, 95, 10):
            consider("p_attack_and_szd", p, z, None, alert=[r[1] >= p and r[2] >= z for r in rows])
            consider("p_attack_only", p, None, None, alert=[r[1] >= p for r in rows])
            for o in np.linspace(0.4, 0.95, 12) if with_open else []:
                consider("p_attack_and_szd_or_open_set", p, z, o, alert=[r[1] >= p and (r[2] >= z or r[3] >= o) for r in rows])
    got = se.choose_budget_thresholds(df if with_open else df.drop("open_set_ood_score"), "label", ["k"])["recommendation"]
    assert (got["unknown_recall"], got["alert_rate"], got["mode"], got["p_attack_threshold"], got["szd_threshold"], got["open_set_threshold"]) == pytest.approx(best)


def test_budget_search_errors(spark):
    df = spark.createDataFrame([("u", 1.0, 100.0)], "label string, p_attack double, suspected_zero_day_pct double")
    with pytest.raises(ValueError, match="budget"):
        se.choose_budget_thresholds(df, "label", ["k"])
    with pytest.raises(ValueError, match="known"):
        se.choose_budget_thresholds(df, "label", [" "])


def test_block_threshold(spark):
    rows = [("BENIGN", "x", 0.5 + i / 200) for i in range(100)]
    df = spark.createDataFrame(rows, "label string, prediction string, proba_max double")
    big, small = se.choose_block_threshold(df, "label"), se.choose_block_threshold(df, "label", pick="smallest")
    assert big["block_min_proba"] == pytest.approx(0.999) and small["block_min_proba"] < 0.999
    with pytest.raises(ValueError):
        se.choose_block_threshold(df, "label", "other")


def test_pick_best_falls_back():
    rows = [{"unknown_recall": 0.9, "alert_rate": 0.9, "known_alert_rate": 0.9}, {"unknown_recall": 0.1, "alert_rate": 0.1, "known_alert_rate": 0.05}]
    assert se.pick_best(rows, 0.08, 0.2) is rows[1] and se.pick_best(rows, 0.01, 0.01) is rows[0]


# ---- schema and mapping --------------------------------------------------------------------------------------


def test_contract_errors(spark):
    df = spark.createDataFrame([(1.0, 2.0, "x", 3)], "a double, b double, Label string, id long")
    assert sc.align_columns_strict(df, ["b", "a"]).columns == ["b", "a"]
    with pytest.raises(ValueError, match="zz"):
        sc.align_columns_strict(df, ["a", "zz"])
    with pytest.raises(KeyError, match="Label"):
        sc.split_xy(df, sc.FeatureSpec(["a"], "label"))
    with pytest.raises(ValueError):
        sc.numeric_columns(df.select("Label"))
    assert sc.numeric_columns(df) == ["a", "b", "id"]


def test_normalize(spark):
    df = spark.createDataFrame([(1, 6, 2.0, "B")], "flow_id long, protocol long, FLOW_DURATION double, Label string")
    out = sc.normalize_columns(df, ["Protocol", "Flow Duration"], "Label")
    assert out.columns == ["Protocol", "Flow Duration", "Label"]
    none, report = sc.normalize_to_contract(df, ["Protocol", "Other"], "Label")
    assert none is None and report == {"missing": ["Other"], "extra": ["FLOW_DURATION"], "complete": False}
    clash = spark.createDataFrame([(1, 2)], "`flow duration` int, flow_duration int")
    with pytest.raises(ValueError, match="Flow Duration"):
        sc.normalize_columns(clash, ["Flow Duration"])


def test_probability_columns():
    assert sc.probability_columns(["a b", "a-b", "1x", " "]) == ["p_a_b", "p_a_b_1", "p_c_1x", "p_cls"]


def test_conn_mapping(spark):
    row = ("tcp", 0.0, 100.0, None, 4.0, 0.0, 1234, 80)
    df = spark.createDataFrame([row], "proto string, duration double, orig_bytes double, resp_bytes double, orig_pkts double, resp_pkts double, `id.orig_p` long, `id.resp_p` long")
    names = ["Protocol", "Flow Bytes/s", "Fwd Packet Length Mean", "Bwd Packet Length Mean", "Init Bwd Win Bytes", "Unheard Of"]
    assert tuple(mp.prepare_input(df, names).first()) == (6.0, 100.0, 25.0, 0.0, 80.0, 0.0)
    with pytest.raises(ValueError):
        mp.prepare_input(df.select("proto"), names)


def test_derived_features_skip_gaps(spark):
    df = spark.createDataFrame([(200.0, 200.0, 5.0, -1.0), (1.0, None, 1.0, 300.0)], "a double, b double, c double, d double")
    assert mp.derived_features(df).columns == ["a", "b", "c", "d", "der_log1p_a"]


def test_merge_scores_rejects_unmatched_rows(spark):
    a = spark.createDataFrame([(1, 0.1), (2, 0.2)], "id int, s double")
    b = spark.createDataFrame([(1, 0.3), (2, 0.4)], "id int, t double")
    assert sorted(map(tuple, rp.merge_scores(a, b, ["id"]).collect())) == [(1, 0.1, 0.3), (2, 0.2, 0.4)]
    with pytest.raises(Exception, match="only one"):
        rp.merge_scores(a, b.limit(1), ["id"]).collect()


def test_health(spark):
    df = spark.createDataFrame([("KnownAttack",), ("AttackUncertain",), ("BenignOrLowRisk",)], "decision_label string")
    assert rp.operational_health(df, max_rate=0.5).first()["healthy"] and not rp.operational_health(df).first()["healthy"]
    assert rp.operational_health(df.limit(0)).first()["attack_uncertain_rate"] == 0.0


def test_kpi_gate_defaults(spark):
    empty = spark.createDataFrame([], "metric string, value double")
    rows = {r["check"]: (r["actual"], r["passed"]) for r in rp.kpi_gate(empty, {"macro_f1_min": 0.5, "known_alert_rate_max": 0.1}).collect()}
    assert rows["macro_f1"] == (0.0, False) and rows["known_alert_rate"] == (1.0, False) and rows["worst_rare_f1"] == (1.0, True)


def test_missing_and_infinite_values(spark):
    from netsieve.functions.guards import clip
    from netsieve.models.preprocess import fit_scaler
    from netsieve.operators import prototypes as pt
    from netsieve.operators.reports import merge_scores
    from netsieve.operators.triage import suspected_zero_day_pct

    nan, inf = float("nan"), float("inf")
    df = spark.createDataFrame([(nan, 0.5), (None, 0.5), (3.0, None), (inf, 0.5), (-inf, 0.5), (3.0, 0.5)], "s double, p double")
    assert [r[0] for r in df.select(clip(F.col("s"), 0, 2)).collect()] == [None, None, 2.0, 2.0, 0.0, 2.0]
    pct = [r[0] for r in df.select(suspected_zero_day_pct(F.col("s"), F.lit(1.0), F.col("p"), F.lit(5.0))).collect()]
    assert pct == [None, None, None, 75.0, 25.0, 50.0]
    s = fit_scaler(df, ["s"])
    assert s.medians == [3.0] and s.means == [3.0] and s.stds == [1.0]
    assert [r[0] for r in df.select(s.expressions()[0]).collect()] == [0.0] * 6
    vectors = spark.createDataFrame([([3.0, 4.0],), (None,), ([None, 1.0],), ([1.0],)], "v array<float>")
    protos = pt.Prototypes(["a", "b"], [[0.0, 0.0], [9.0, 9.0]])
    assert [r[0] for r in vectors.select(pt.nearest_distance_vector(F.col("v"), protos)).collect()] == [5.0, None, None, None]
    one, two = spark.createDataFrame([(1, 0.5)], "k int, s double"), spark.createDataFrame([(1, 0.5), (1, 0.6)], "k int, s double")
    assert merge_scores(one, one, ["k"]).count() == 1
    for left, right in ((one, two), (two, one), (two, two)):
        with pytest.raises(Exception, match="repeated"):
            merge_scores(left, right, ["k"]).collect()


def test_rank_outside_a_missed_range_is_found(spark, monkeypatch):
    from netsieve.operators import ranking

    df = spark.range(20000).selectExpr("CAST(id AS DOUBLE) AS x", "CAST(id % 7 AS DOUBLE) AS y")
    real, missed = ranking._narrow, []

    def off(base, todo, ends):
        if not missed:
            missed.append(1)
            return [ranking._Range(t.column, t.rank, 1.0, 2.0, 5000.0) for t in todo]
        return real(base, todo, ends)

    monkeypatch.setattr(ranking, "_narrow", off)
    got = ranking.exact_quantiles(df, ["x", "y"], [0.25, 0.5], small=8)
    assert missed and got == {"x": [4999.75, 9999.5], "y": [1.0, 3.0]}


def test_quantiles_of_many_columns_share_the_budget(spark):
    from netsieve.operators import ranking

    df = spark.range(3000).select(*[((F.col("id") * (i + 3)) % 3001).cast("double").alias(f"c{i}") for i in range(78)])
    got = ranking.exact_quantiles(df, df.columns, [0.5], small=2000)
    row = df.agg(*[F.percentile(c, 0.5).alias(c) for c in df.columns]).first()
    assert {c: v[0] for c, v in got.items()} == row.asDict()
