"""Truth tables of the decision operators, with NaN, NULL, ties and empty inputs."""

import math
import random

import pytest
from pyspark.sql import Row, functions as F

from netsieve.operators import policy as po, triage as tr
from netsieve.functions.guards import ge, lt, to_number

NAN = float("nan")
SCORED = "id int, binary_prediction string, p_attack double, is_attack_uncertain boolean, is_novel_flagged boolean, suspected_zero_day_pct double, open_set_ood_score double"


def by_id(df, *cols):
    return {r["id"]: tuple(r[c] for c in cols) for r in df.collect()}


def test_guards_treat_nan_and_null_as_missing(spark):
    df = spark.createDataFrame([(1, NAN), (2, None), (3, 0.9), (4, math.inf)], "id int, x double")
    out = by_id(df.select("id", ge(F.col("x"), 0.9).alias("a"), lt(F.col("x"), 0.9).alias("b")), "a", "b")
    assert out == {1: (False, False), 2: (False, False), 3: (True, False), 4: (True, False)}


def test_to_number(spark):
    df = spark.createDataFrame([(1, "-"), (2, ""), (3, " 2.5 "), (4, None), (5, "nan"), (6, "1e3")], "id int, x string")
    out = by_id(df.select("id", to_number(F.col("x")).alias("n")), "n")
    assert out == {1: (0.0,), 2: (0.0,), 3: (2.5,), 4: (0.0,), 5: (0.0,), 6: (1000.0,)}


def test_fusion_truth_table(spark):
    rows = [
        (1, " Attack ", 0.9, False, False, 10.0, 0.1),
        (2, "Attack", 0.9, True, True, 80.0, 0.7),
        (3, "attack", 0.5, False, False, 10.0, 0.1),
        (4, "Benign", 0.1, False, False, 10.0, 0.1),
        (5, "Benign", 0.1, False, True, 10.0, 0.1),
        (6, "Benign", 0.1, False, True, 90.0, 0.6),
        (7, "Attack", 0.7, False, False, 70.0, NAN),
        (8, "Attack", NAN, False, False, NAN, None),
        (9, None, 0.9, False, False, 69.999, 0.599),
    ]
    out = by_id(tr.fuse_decisions(spark.createDataFrame(rows, SCORED)), "decision_label", "decision_risk_tier", "reason_codes")
    assert out == {
        1: ("KnownAttack", "high", "binary_attack_high_conf"),
        2: ("AttackUncertain", "high", "binary_attack_high_conf;attack_uncertain_signal;novel_flag;high_szd_pct;high_open_set_ood"),
        3: ("AttackUncertain", "medium", "binary_attack_low_conf"),
        4: ("BenignOrLowRisk", "low", "benign_binary_pred"),
        5: ("AttackUncertain", "medium", "benign_pred_novelty_signal"),
        6: ("AttackUncertain", "medium", "benign_pred_high_open_set_ood"),
        7: ("AttackUncertain", "high", "binary_attack_high_conf;high_szd_pct"),
        8: ("KnownAttack", "high", "binary_attack_low_conf"),
        9: ("BenignOrLowRisk", "low", "benign_binary_pred"),
    }


def test_fusion_without_open_set_and_with_missing_columns(spark):
    df = spark.createDataFrame([(1, "Benign", 0.1, False, False, 1.0, 0.9)], SCORED)
    assert tr.fuse_decisions(df.drop("open_set_ood_score")).first()["decision_label"] == "BenignOrLowRisk"
    with pytest.raises(ValueError, match="p_attack"):
        tr.fuse_decisions(df.drop("p_attack"))
    assert tr.fuse_decisions(df.limit(0)).count() == 0


def test_soc_policy(spark):
    rows = [(1, "BENIGN ", 0.99, 0.1), (2, "DoS", 0.95, 0.1), (3, "DoS", 0.92, 0.1), (4, "DoS", 0.5, 0.1), (5, "DoS", NAN, 0.1), (6, "DoS", math.inf, 0.1), (7, "benign", None, 5.0), (8, "benign", 0.1, NAN), (9, "Benign", 0.2, 9.0)]
    df = spark.createDataFrame(rows, "id int, prediction string, proba_max double, a double")
    out = by_id(tr.apply_soc_policy(df, anomaly_col="a", anomaly_benign_escalate=5.0), "soc_action", "soc_reason")
    assert out[1] == ("allow", "benign_prediction")
    assert out[2] == ("block_candidate", "attack_high_confidence_proba_max=0.9500")
    assert out[3][0] == "block_candidate"
    assert out[4] == ("alert_review", "attack_low_confidence_proba_max=0.5000")
    assert out[5] == out[6] == ("alert_review", "attack_prediction_missing_or_invalid_proba")
    assert out[7] == ("alert_review", "benign_prediction_high_anomaly_score")
    assert out[8] == ("allow", "benign_prediction")
    assert out[9][0] == "alert_review" and out[9][1].startswith("attack_low")
    with pytest.raises(ValueError):
        tr.apply_soc_policy(df, pred_col="nope")
    boundary = spark.createDataFrame([(1, "X", 0.6)], "id int, prediction string, proba_max double")
    assert tr.apply_soc_policy(boundary, block_min_proba=0.99).first()["soc_action"] == "alert_review"
    assert tr.apply_soc_policy(boundary, block_min_proba=0.5).first()["soc_action"] == "block_candidate"
    assert tr.apply_soc_policy(boundary.drop("proba_max")).first()["soc_action"] == "alert_review"


def test_zero_day_pct(spark):
    df = spark.createDataFrame([(1, 1.0, 0.5), (2, 3.0, 0.2), (3, 2.0, 1.5), (4, 0.0, 1.0)], "id int, anomaly_score double, max_class_probability double")
    out = by_id(tr.add_suspected_zero_day(df, 1.0), "suspected_zero_day_pct")
    assert out[1][0] == pytest.approx(25.0) and out[2][0] == pytest.approx(90.0)
    assert out[3][0] == pytest.approx(25.0) and out[4][0] == pytest.approx(0.0)
    fixed = by_id(tr.add_suspected_zero_day(df, 1.0, 5.0, 1.0, 0.0), "suspected_zero_day_pct")
    assert fixed[2][0] == pytest.approx(50.0)
    flat = by_id(tr.add_suspected_zero_day(df, 10.0, weight_anomaly=-1, weight_uncertainty=0.5), "suspected_zero_day_pct")
    assert flat[4][0] == pytest.approx(0.0) and flat[1][0] == pytest.approx(25.0)


def test_minmax_of_equal_distances_is_zero(spark):
    df = spark.createDataFrame([(1, 2.0), (2, 2.0)], "id int, d double")
    assert by_id(tr.minmax_score(df, "d", "s"), "s") == {1: (0.0,), 2: (0.0,)}


def test_novelty_tiers(spark):
    df = spark.createDataFrame([(i, float(i), 0.3, "DoS") for i in range(1, 11)], "id int, anomaly_score double, max_class_probability double, supervised_prediction string")
    out = by_id(tr.novelty_labels(df, 0.0, tier_strong_label="Strong", tier_percentile=90.0), "prediction")
    assert out[10] == ("Strong",) and all(out[i] == ("Suspected_ZeroDay",) for i in range(1, 10))
    none = tr.novelty_labels(df, 100.0, tier_strong_label="Strong")
    assert none.where("is_novel_flagged").count() == 0 and none.first()["prediction"] == "DoS"


def test_profiles():
    profiles = {"balanced_profile": {"thresholds": {"open_set_ood_score": 0.4}}, "high_recall_profile": {"chosen_threshold": 0.2}}
    assert tr.fusion_thresholds("balanced", profiles)["min_open_set_uncertain"] == 0.4
    assert tr.fusion_thresholds("high_recall", profiles) == {"min_p_attack_known": 0.2, "min_szd_uncertain": 55.0, "min_open_set_uncertain": 0.5}
    assert tr.fusion_thresholds("other", profiles) == tr.FUSION_DEFAULTS


def test_risk_levels_and_verdicts(spark):
    df = spark.createDataFrame([(1, 0, 0, 0), (2, 5, 0, 0), (3, 5, 1, 0), (4, 5, 0, 2)], "id int, rows_scored int, known_attack int, attack_uncertain int")
    out = by_id(tr.add_risk(df), "risk_level", "attack_indicators", "danger_verdict")
    assert out == {
        1: ("unknown", "none", "no_traffic_scored"), 2: ("low", "none", "no_significant_danger_in_window"),
        3: ("elevated", "present", "potential_danger_review_recommended"), 4: ("elevated", "present", "potential_danger_review_recommended"),
    }


def test_summary_and_families(spark):
    rows = [("KnownAttack", "DoS"), ("KnownAttack", "DoS"), ("KnownAttack", "Analysis"), ("AttackUncertain", "x"), ("BenignOrLowRisk", "Benign")]
    df = spark.createDataFrame(rows, "decision_label string, supervised_prediction string")
    s = tr.summarize_risk(df).first()
    assert (s["known_attack"], s["attack_uncertain"], s["alerts"], s["top_families"]) == (3, 1, 4, "DoS (2), Analysis (1)")
    assert "3 flow(s)" in s["risk_plain_summary"]
    empty = tr.summarize_risk(df.limit(0)).first()
    assert empty["rows_scored"] == 0 and empty["risk_level"] == "unknown"
    assert {r["family"]: r["n"] for r in tr.known_attack_type_counts(df).collect()} == {"DoS": 2, "Analysis": 1}
    assert tr.known_attack_type_counts(df.select("decision_label")).count() == 0


def test_queue_order(spark):
    df = spark.createDataFrame([("BenignOrLowRisk", 0.99), ("KnownAttack", 0.2), ("AttackUncertain", 0.5), ("KnownAttack", None)], "decision_label string, p_attack double")
    assert [r["decision_label"] for r in tr.triage_queue(df, 3).collect()] == ["KnownAttack", "KnownAttack", "AttackUncertain"]


def test_softmax(spark):
    df = spark.createDataFrame([(1, [1.0, 1.0]), (2, [0.0]), (3, [1000.0, 0.0, -1000.0])], "id int, z array<double>")
    assert by_id(df.select("id", tr.softmax_max(F.col("z")).alias("p")), "p") == {1: (0.5,), 2: (0.5,), 3: (1.0,)}


# ---- rules and suppressions ----------------------------------------------------------------------------------

RULE_CASES = [
    ("x > 1", 1.5, True), ("x > 1", 1.0, False), ("X>=1", 1.0, True), (" x < 1 ", 0.5, True), ("x <= 1", 1.0, True),
    ("x == 1", 1.0 + 1e-10, True), ("x = 1", 1.1, False), ("x != 2", 1.0, False), ("x >> 1", 5.0, False), ("x > 1 or x < 0", 5.0, False),
    ("x > 1e0", 1.5, True), ("x > .", 1.5, False), ("x > 1", NAN, False), ("x > 1", None, False), ("y > 0", 1.0, False),
    ('{"field":"x","op":"==","value":1}', 1.0 + 1e-10, False), ('{"field":"x","op":">","value":"0.5"}', 1.0, True),
    ('{"field":"x","op":">","value":null}', 1.0, False), ('{"field":"x"', 1.0, False), ('{"op":">","value":0}', 1.0, False),
    ('{"field":"x","op":"!=","value":0}', 1.0, False), ('{"field":"x","op":"<","value":NaN}', 1.0, False), ("", 1.0, False),
]


@pytest.mark.parametrize("rule,value,want", RULE_CASES)
def test_rule(spark, rule, value, want):
    df = spark.createDataFrame([(value,)], "x double")
    assert df.select(po.compile_rule(df, rule).alias("r")).first()["r"] is want


def test_rule_on_text_column(spark):
    df = spark.createDataFrame([("abc", "3"), (None, "nan")], "`My Name` string, n string")
    got = df.select(po.compile_rule(df, "my_name > 0").alias("a"), po.compile_rule(df, "n > 1").alias("b")).collect()
    assert got == [Row(a=False, b=True), Row(a=False, b=False)]


SUPP = "id int, target_type string, target_value string, until_ts long, tenant_id long"


def suppressed(spark, rules, ip, label="KnownAttack", tenant=None, dst=None):
    supp = spark.createDataFrame(rules, SUPP)
    df = spark.createDataFrame([(ip, dst, label, tenant)], "ip string, dst_ip string, decision_label string, tenant long")
    out = po.is_suppressed(df, supp, "tenant", 100)
    assert out.count() == 1 and out.columns == [*df.columns, "_suppressed"]
    return out.first()["_suppressed"]


@pytest.mark.parametrize("sent", [0, 200_000])
def test_suppressions_looked_up_or_joined(spark, monkeypatch, sent):
    monkeypatch.setattr(po, "SENT", sent)
    rng = random.Random(4)
    ips = [f"10.{a}.{b}.{c}" for a in range(2) for b in range(3) for c in range(4)]
    rows = [(i, rng.choice([*ips, "", None]), rng.choice(["KnownAttack", "Benign", None]), rng.choice([1, 2, None])) for i in range(300)]
    supp = [(rng.choice(["ip", "subnet", "label", "decision"]), rng.choice([*ips, "10.0.", "10.1.2", "Benign", "KnownAttack", "", None]), rng.choice([None, 50, 150]), rng.choice([None, None, 1, 2])) for _ in range(14)]
    df = spark.createDataFrame(rows, "_sup_own long, ip string, decision_label string, tenant long")
    table = spark.createDataFrame([(i, *r) for i, r in enumerate(supp)], "id long, target_type string, target_value string, until_ts long, tenant_id long")
    out = po.is_suppressed(df, table, "tenant", 100)

    def covered(ip, label, tenant):
        for kind, value, until, owner in supp:
            if (until is None or until > 100) and value is not None and owner in (None, tenant):
                if kind == "ip" and ip and ip == value or kind in ("label", "decision") and label == value or kind == "subnet" and (ip or "").startswith(value):
                    return True
        return False

    assert {r["_sup_own"]: r["_suppressed"] for r in out.collect()} == {i: covered(ip, label, t) for i, ip, label, t in rows}
    if sent:  # the rows stay where they are
        assert "Exchange hashpartitioning" not in out._jdf.queryExecution().executedPlan().toString().replace("BroadcastExchange", "")


def test_suppressions(spark):
    assert suppressed(spark, [(1, "IP", "1.1.1.1", None, None)], "1.1.1.1")
    assert not suppressed(spark, [(1, "ip", "1.1.1.1", None, None)], "1.1.1.2")
    assert not suppressed(spark, [(1, "ip", "1.1.1.1", 100, None)], "1.1.1.1")
    assert suppressed(spark, [(1, "ip", "1.1.1.1", 101, None)], "1.1.1.1")
    assert suppressed(spark, [(1, "ip", "2.2.2.2", None, None)], "", dst="2.2.2.2")
    assert not suppressed(spark, [(1, "subnet", "2.2", None, None)], "", dst="2.2.2.2")
    assert suppressed(spark, [(1, "subnet", "1.1", None, None)], "1.1.9.9")
    assert suppressed(spark, [(1, "subnet", "1.1", None, None)], "1.10.9.9")
    assert suppressed(spark, [(1, "subnet", "", None, None)], None)
    assert suppressed(spark, [(1, "label", "KnownAttack", None, None)], None)
    assert suppressed(spark, [(1, "decision", "KnownAttack", None, 3)], None, tenant=3)
    assert not suppressed(spark, [(1, "decision", "KnownAttack", None, 3)], None, tenant=4)
    assert not suppressed(spark, [(1, "decision", "KnownAttack", None, 3)], None)
    assert suppressed(spark, [(1, "ip", "1.1.1.1", None, 4), (2, "ip", "1.1.1.1", None, None), (3, "ip", "1.1.1.1", None, None)], "1.1.1.1", tenant=3)


def test_rule_hits_respect_tenant_and_order(spark):
    df = spark.createDataFrame([(1, 0.95, 1), (2, 0.95, None), (3, 0.1, 1)], "id int, p_attack double, tenant int")
    rules = [
        {"name": "b", "enabled": 1, "expression": "p_attack > 0.9", "tenant_id": None},
        {"name": "a", "enabled": 1, "expression": "p_attack > 0.5", "tenant_id": 1},
        {"name": "off", "enabled": 0, "expression": "p_attack > 0", "tenant_id": None},
    ]
    out = by_id(df.select("id", po.rule_hits(df, rules, F.col("tenant")).alias("h")), "h")
    assert out == {1: (["b", "a"],), 2: (["b"],), 3: ([],)}
    assert df.select(po.rule_hits(df, [], F.col("tenant")).alias("h")).first()["h"] == []


def test_effective_settings_without_global_row(spark):
    rows = spark.createDataFrame([(1, 1), (2, 2)], "id int, t int")
    settings = spark.createDataFrame([(1, "x"), (3, "y")], "tenant_id int, mode string")
    out = by_id(po.effective_settings(rows, "t", settings, {"mode": "batch", "poll": 2.0}), "mode", "poll")
    assert out == {1: ("x", 2.0), 2: ("batch", 2.0)}
