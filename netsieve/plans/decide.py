"""Decision, policy, action and summary queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from netsieve.functions.text import query_text
from netsieve.models.novelty import NoveltyOptions, detect_attack_uncertain, detect_novel
from netsieve.operators import policy as po, triage as tr
from netsieve.operators.mapping import proto_code
from netsieve.plans.registry import query
from netsieve.plans.views import (
    ALERTS, CASES, EVENT_DECISIONS, FLOWS, TO_FUSED, TO_OPEN, TO_UNCERTAIN,
    alert_table, case_table, contract, detector, event_decisions, flows, fused, fused_sql, table, with_,
)

# ---- scalar functions ----------------------------------------------------------------------------------------


@query("f1_proto_code", with_(FLOWS, select="SELECT uid, CASE WHEN proto = 'TCP ' THEN 6.0 WHEN proto = 'udp' THEN 17.0 ELSE 1.0 END::DOUBLE AS code FROM flows"))
def f1(spark: SparkSession, sf: str) -> DataFrame:
    return flows(spark, sf).select("uid", proto_code(F.col("proto")).alias("code"))


@query(
    "f2_softmax_temperature",
    """WITH v AS (SELECT vec_id, [CAST(x AS DOUBLE) * 10 for x in embedding] AS z FROM embeddings),
    e AS (SELECT vec_id, z, list_max(z) AS m FROM v)
    SELECT vec_id, round(1.0 / list_sum([exp((x - m) / 2.5) for x in z]), 6) AS max_p,
      round(1.0 / (1.0 + exp(-abs(z[1]))), 6) AS max_p_binary FROM e""",
)
def f2(spark: SparkSession, sf: str) -> DataFrame:
    z = F.transform("embedding", lambda x: x.cast("double") * 10.0)
    return table(spark, sf, "embeddings").select(
        "vec_id", F.round(tr.softmax_max(z, 2.5), 6).alias("max_p"), F.round(tr.softmax_max(F.slice(z, 1, 1)), 6).alias("max_p_binary")
    )


# ---- novelty, uncertainty, fusion ----------------------------------------------------------------------------

FLAG_COLUMNS = "uid, supervised_prediction, prediction, round(max_class_probability, 6) AS max_class_probability, round(anomaly_score, 6) AS anomaly_score, is_novel_flagged"


@query("f3_novelty_flag", with_(*TO_UNCERTAIN, select=f"SELECT {FLAG_COLUMNS} FROM uncertain"))
def f3(spark: SparkSession, sf: str) -> DataFrame:
    d = detector(spark, sf)
    scored = detect_novel(contract(spark, sf), d).select("uid", "supervised_prediction", "max_class_probability", "anomaly_score")
    out = tr.novelty_labels(scored, d.threshold)
    return out.select(
        "uid", "supervised_prediction", "prediction", F.round("max_class_probability", 6).alias("max_class_probability"),
        F.round("anomaly_score", 6).alias("anomaly_score"), "is_novel_flagged",
    )


@query(
    "f4_novelty_job",
    with_(*TO_UNCERTAIN, select="""SELECT uid, prediction, supervised_prediction, round(max_class_probability, 6) AS max_class_probability, round(anomaly_score, 6) AS anomaly_score,
    round(thr, 6) AS anomaly_threshold, round(suspected_zero_day_pct, 6) AS suspected_zero_day_pct, is_novel_flagged, 'mean_square' AS anomaly_model_type FROM uncertain"""),
)
def f4(spark: SparkSession, sf: str) -> DataFrame:
    out = detect_novel(contract(spark, sf), detector(spark, sf))
    r = lambda c: F.round(c, 6).alias(c)
    return out.select(
        "uid", "prediction", "supervised_prediction", r("max_class_probability"), r("anomaly_score"), r("anomaly_threshold"),
        r("suspected_zero_day_pct"), "is_novel_flagged", "anomaly_model_type",
    )


TIERED = """hits AS (SELECT quantile_cont(anomaly_score, 0.9) AS tier FROM loose WHERE flagged),
final AS (SELECT uid, flagged, CASE WHEN flagged AND anomaly_score >= tier THEN 'Strong' WHEN flagged THEN 'Suspected_ZeroDay' ELSE supervised_prediction END AS prediction FROM loose, hits)"""


@query("w1_novelty_tiers", with_(*TO_UNCERTAIN, "loose AS (SELECT *, anomaly_score > thr AS flagged FROM uncertain)", TIERED, select="SELECT prediction, flagged, count(*) AS n FROM final GROUP BY ALL"))
def w1(spark: SparkSession, sf: str) -> DataFrame:
    options = NoveltyOptions(require_low_confidence=False, tier_strong_label="Strong")
    out = detect_novel(contract(spark, sf), detector(spark, sf), options)
    return out.groupBy("prediction", F.col("is_novel_flagged").alias("flagged")).agg(F.count(F.lit(1)).alias("n"))


@query("w2_suspected_zero_day", with_(*TO_UNCERTAIN, select="SELECT uid, round(suspected_zero_day_pct, 6) AS suspected_zero_day_pct FROM uncertain"))
def w2(spark: SparkSession, sf: str) -> DataFrame:
    d = detector(spark, sf)
    scored = detect_novel(contract(spark, sf), d).select("uid", "anomaly_score", "max_class_probability")
    return tr.add_suspected_zero_day(scored, d.threshold).select("uid", F.round("suspected_zero_day_pct", 6).alias("suspected_zero_day_pct"))


@query("w3_minmax_distance", with_(*TO_OPEN, select="SELECT uid, round(open_set_nearest_distance, 6) AS distance, round(open_set_ood_score, 6) AS score FROM open_set"))
def w3(spark: SparkSession, sf: str) -> DataFrame:
    out = detect_attack_uncertain(contract(spark, sf), detector(spark, sf), open_set=True)
    again = tr.minmax_score(out.select("uid", "open_set_nearest_distance"), "open_set_nearest_distance", "s")
    return again.select("uid", F.round("open_set_nearest_distance", 6).alias("distance"), F.round("s", 6).alias("score"))


@query("f5_attack_uncertain", with_(*TO_UNCERTAIN, select="SELECT uid, binary_prediction, round(p_attack, 6) AS p_attack, is_attack_uncertain FROM uncertain"))
def f5(spark: SparkSession, sf: str) -> DataFrame:
    out = detect_attack_uncertain(contract(spark, sf), detector(spark, sf))
    return out.select("uid", "binary_prediction", F.round("p_attack", 6).alias("p_attack"), "is_attack_uncertain")


@query("f6_fuse_decisions", with_(*TO_FUSED, select="SELECT uid, decision_label, decision_risk_tier, reason_codes FROM fused"))
def f6(spark: SparkSession, sf: str) -> DataFrame:
    return fused(spark, sf).select("uid", "decision_label", "decision_risk_tier", "reason_codes")


SOC_SQL = """SELECT uid,
  CASE WHEN supervised_prediction = 'Benign' THEN CASE WHEN anomaly_score >= 2.0 THEN 'alert_review' ELSE 'allow' END
    WHEN proba IS NOT NULL AND proba >= 0.8 THEN 'block_candidate' ELSE 'alert_review' END AS soc_action,
  CASE WHEN supervised_prediction = 'Benign' THEN CASE WHEN anomaly_score >= 2.0 THEN 'benign_prediction_high_anomaly_score' ELSE 'benign_prediction' END
    WHEN proba IS NULL THEN 'attack_prediction_missing_or_invalid_proba'
    WHEN proba >= 0.8 THEN 'attack_high_confidence_proba_max' ELSE 'attack_low_confidence_proba_max' END AS reason,
  CASE WHEN supervised_prediction <> 'Benign' THEN round(proba, 4) END AS reason_proba
FROM (SELECT *, CASE WHEN tenant_id IS NULL THEN NULL ELSE round(max_class_probability, 3) END AS proba FROM uncertain)"""


@query("f7_soc_policy", with_(*TO_UNCERTAIN, select=SOC_SQL))
def f7(spark: SparkSession, sf: str) -> DataFrame:
    """Every fifth supplier's rows have no usable probability: NaN here, NULL in the SQL."""
    scored = detect_novel(contract(spark, sf), detector(spark, sf)).select(
        "uid", F.concat("supervised_prediction", F.lit(" ")).alias("prediction"), "anomaly_score",
        F.when(F.col("tenant_id").isNull(), F.lit(float("nan"))).otherwise(F.round("max_class_probability", 3)).alias("proba_max"),
    )
    out = tr.apply_soc_policy(scored, ["Benign"], block_min_proba=0.8, anomaly_col="anomaly_score", anomaly_benign_escalate=2.0)
    reason = F.split("soc_reason", "=")
    return out.select("uid", "soc_action", reason[0].alias("reason"), F.get(reason, F.lit(1)).try_cast("double").alias("reason_proba"))


PROFILES = {
    "balanced_profile": {"thresholds": {"open_set_ood_score": 0.3, "suspected_zero_day_pct": 40.0}},
    "high_recall_profile": {"chosen_threshold": 0.45},
}
F8_SOURCE = """profiled AS (SELECT *, CASE tenant_id WHEN 1 THEN 0.70 WHEN 2 THEN 0.45 ELSE 0.70 END AS tp,
  CASE tenant_id WHEN 1 THEN 40.0 WHEN 2 THEN 55.0 ELSE 70.0 END AS tz,
  CASE tenant_id WHEN 1 THEN 0.3 WHEN 2 THEN 0.5 ELSE 0.6 END AS too FROM open_set)"""


@query(
    "f8_threshold_profiles",
    with_(*TO_OPEN, F8_SOURCE, fused_sql("tp", "tz", "too", "by_profile", "profiled"), select="SELECT tenant_id, decision_label, reason_codes, count(*) AS n FROM by_profile GROUP BY ALL"),
)
def f8(spark: SparkSession, sf: str) -> DataFrame:
    """Tenant 1 runs the balanced profile, tenant 2 high recall, the others an unknown one."""
    scored = detect_attack_uncertain(contract(spark, sf), detector(spark, sf), open_set=True)
    name = F.when(F.col("tenant_id") == 1, F.lit("balanced")).when(F.col("tenant_id") == 2, F.lit("high_recall")).otherwise(F.lit("other"))
    rows = tr.profile_thresholds(scored.withColumn("profile", name), "profile", PROFILES)
    out = tr.fuse_decisions(rows, **{k: F.col(k) for k in tr.FUSION_DEFAULTS})
    return out.groupBy("tenant_id", "decision_label", "reason_codes").agg(F.count(F.lit(1)).alias("n"))


@query(
    "f12_query_text",
    with_(*TO_FUSED, select="""SELECT uid, 'decision_label=' || decision_label || ' | reason_codes=' || reason_codes || ' | binary_prediction=' || binary_prediction
    || ' | supervised_prediction=' || supervised_prediction || ' | prediction=' || prediction AS head, round(suspected_zero_day_pct, 1) AS szd, round(open_set_ood_score, 2) AS ood FROM fused"""),
)
def f12(spark: SparkSession, sf: str) -> DataFrame:
    """The text up to its numbers, and the numbers, which the two engines format differently at halves."""
    f = fused(spark, sf).withColumns({"suspected_zero_day_pct": F.round("suspected_zero_day_pct", 1), "open_set_ood_score": F.round("open_set_ood_score", 2)})
    text = query_text(f)
    parts = F.split(text, r" \| suspected_zero_day_pct=")
    nums = F.split(parts[1], r" \| open_set_ood_score=")
    return f.select("uid", parts[0].alias("head"), nums[0].cast("double").alias("szd"), nums[1].cast("double").alias("ood"))


# ---- rules, suppressions, tenants ----------------------------------------------------------------------------

RULES = [
    {"id": 1, "name": "likely attack", "enabled": 1, "expression": "p_attack > 0.9", "tenant_id": None},
    {"id": 2, "name": "odd and open", "enabled": 1, "expression": '{"field": "Anomaly Score", "op": ">=", "value": "1.5"}', "tenant_id": None},
    {"id": 3, "name": "tenant one", "enabled": 1, "expression": "suspected_zero_day_pct<=30", "tenant_id": 1},
    {"id": 4, "name": "never equal", "enabled": 1, "expression": "p_attack != 0.5", "tenant_id": None},
    {"id": 5, "name": "broken", "enabled": 1, "expression": "p_attack >> nothing", "tenant_id": None},
    {"id": 6, "name": "text field", "enabled": 1, "expression": "decision_label > 1", "tenant_id": None},
    {"id": 7, "name": "missing field", "enabled": 1, "expression": "no_such_field > 0", "tenant_id": None},
    {"id": 8, "name": "protocol six", "enabled": 1, "expression": "protocol = 6", "tenant_id": 2},
    {"id": 9, "name": "switched off", "enabled": 0, "expression": "p_attack >= 0", "tenant_id": None},
]
RULES_SQL = """concat_ws(',', CASE WHEN p_attack > 0.9 THEN 'likely attack' END, CASE WHEN anomaly_score >= 1.5 THEN 'odd and open' END,
  CASE WHEN tenant_id = 1 AND suspected_zero_day_pct <= 30 THEN 'tenant one' END, CASE WHEN tenant_id = 2 AND abs(c1 - 6) < 1e-9 THEN 'protocol six' END)"""


@query("j5_rule_hits", with_(*TO_FUSED, select=f"SELECT uid, {RULES_SQL} AS hits FROM fused"))
def j5(spark: SparkSession, sf: str) -> DataFrame:
    f = fused(spark, sf)
    return f.select("uid", F.array_join(po.rule_hits(f, RULES, F.col("tenant_id")), ",").alias("hits"))


@query(
    "f9_rule_expressions",
    """SELECT event_id, value > 50 AS gt, value >= 50.5 AS ge, value < 20 AS lt, value <= 20.25 AS le, value = 6.55 AS json_eq, abs(value - 6.55) < 1e-9 AS plain_eq,
    false AS not_equal, false AS unknown_op, event_id > 100 AS by_spelling FROM events""",
)
def f9(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    text = e.select("event_id", F.col("value").cast("string").alias("value"), F.col("event_id").alias("Event No"))
    rule = lambda x, name: po.compile_rule(text, x).alias(name)
    return text.select(
        "event_id", rule("value > 50", "gt"), rule('{"field":"value","op":">=","value":50.5}', "ge"), rule(" VALUE<20 ", "lt"),
        rule('{"field":"value","op":"<=","value":"20.25"}', "le"), rule('{"field":"value","op":"==","value":6.55}', "json_eq"),
        rule("value = 6.55", "plain_eq"), rule("value != 6.55", "not_equal"), rule('{"field":"value","op":"~","value":1}', "unknown_op"),
        rule("event_no > 100", "by_spelling"),
    )


NOW = 1_000_000_000


def suppression_table(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers as suppressions: by IP, by label, by subnet prefix; some expired, some of one tenant."""
    c = F.col
    k = c("s_suppkey")
    return table(spark, sf, "supplier").select(
        k.alias("id"),
        F.when(k % 7 == 3, F.lit("Subnet")).when(k % 11 == 5, F.lit("decision")).otherwise(F.lit("ip")).alias("target_type"),
        F.when(k % 7 == 3, F.concat(F.lit("10."), k % 4, F.lit("."), k % 20))
        .when(k % 11 == 5, F.when(k % 2 == 0, F.lit("KnownAttack")).otherwise(F.lit("other")))
        .otherwise(F.concat(F.lit("10."), k % 4, F.lit("."), (k * 37) % 256, F.lit("."), k % 7 + 1)).alias("target_value"),
        F.when(k % 3 == 0, F.lit(NOW - 1)).when(k % 3 == 1, F.lit(NOW + 1)).cast("bigint").alias("until_ts"),
        F.when((k % 2 == 0) | (k % 11 == 5), k % 5).alias("tenant_id"),
    )


SUPPRESSIONS = f"""supp AS (
  SELECT s_suppkey AS id, CASE WHEN s_suppkey % 7 = 3 THEN 'subnet' WHEN s_suppkey % 11 = 5 THEN 'decision' ELSE 'ip' END AS kind,
    CASE WHEN s_suppkey % 7 = 3 THEN '10.' || (s_suppkey % 4) || '.' || (s_suppkey % 20)
      WHEN s_suppkey % 11 = 5 THEN CASE WHEN s_suppkey % 2 = 0 THEN 'KnownAttack' ELSE 'other' END
      ELSE '10.' || (s_suppkey % 4) || '.' || ((s_suppkey * 37) % 256) || '.' || (s_suppkey % 7 + 1) END AS value,
    CASE WHEN s_suppkey % 2 = 0 OR s_suppkey % 11 = 5 THEN s_suppkey % 5 END AS owner
  FROM supplier WHERE s_suppkey % 3 <> 0)"""
SUPPRESSED = """EXISTS (SELECT 1 FROM supp s WHERE (s.owner IS NULL OR s.owner = f.tenant_id) AND (
    (s.kind = 'ip' AND s.value = f.ip) OR (s.kind = 'decision' AND s.value = f.decision_label) OR (s.kind = 'subnet' AND starts_with(f.ip, s.value))))"""


@query("j4_is_suppressed", with_(*TO_FUSED, SUPPRESSIONS, select=f"SELECT uid, {SUPPRESSED} AS suppressed FROM fused f"))
def j4(spark: SparkSession, sf: str) -> DataFrame:
    f = fused(spark, sf).select("uid", "tenant_id", "ip", "decision_label")
    return po.is_suppressed(f, suppression_table(spark, sf), "tenant_id", NOW, "suppressed").select("uid", "suppressed")


@query("j6_enrich", with_(*TO_FUSED, SUPPRESSIONS, select=f"SELECT uid, {SUPPRESSED} AS suppressed, {RULES_SQL} AS hits FROM fused f"))
def j6(spark: SparkSession, sf: str) -> DataFrame:
    out = po.enrich(fused(spark, sf), suppression_table(spark, sf), RULES, "tenant_id", NOW)
    return out.select("uid", F.col("_suppressed").alias("suppressed"), F.array_join("_rule_hits", ",").alias("hits"))


@query(
    "p18_tenant_scope",
    with_(ALERTS, select="""SELECT 'admin' AS who, id FROM alerts UNION ALL SELECT 'tenant 3', id FROM alerts WHERE tenant_id = 3 OR tenant_id IS NULL
    UNION ALL SELECT 'nobody', id FROM alerts WHERE tenant_id IS NULL"""),
)
def p18(spark: SparkSession, sf: str) -> DataFrame:
    a = alert_table(spark, sf).select("id", "tenant_id")
    see = lambda who, role, tid: a.where(po.tenant_scope(role, tid, F.col("tenant_id"))).select(F.lit(who).alias("who"), "id")
    return see("admin", "admin", None).unionByName(see("tenant 3", "admin", 3)).unionByName(see("nobody", "viewer", None))


@query(
    "p19_list_alerts",
    with_(ALERTS, select="""SELECT id, status, created_at, ip, CASE WHEN second_rule IS NULL THEN NULL ELSE 'rule a,' || second_rule END AS hits FROM alerts
    WHERE (tenant_id = 2 OR tenant_id IS NULL) AND status = 'open' AND created_at >= 800000000 ORDER BY id DESC LIMIT 100 OFFSET 20"""),
)
def p19(spark: SparkSession, sf: str) -> DataFrame:
    out = po.list_alerts(alert_table(spark, sf), "analyst", 2, "open", 800_000_000, 100, 20)
    return out.select("id", "status", "created_at", F.col("payload")["ip"].alias("ip"), F.array_join("rule_hits", ",").alias("hits"))


@query("p20_list_cases", with_(CASES, select="SELECT id, title, status FROM cases WHERE (tenant_id = 1 OR tenant_id IS NULL) AND status = 'open' ORDER BY id DESC LIMIT 50 OFFSET 5"))
def p20(spark: SparkSession, sf: str) -> DataFrame:
    return po.list_cases(case_table(spark, sf), "viewer", 1, "open", 50, 5).select("id", "title", "status")


@query(
    "p20_case_timeline",
    with_(CASES, select="SELECT c.conv_id AS case_id, c.turn AS id, c.role FROM conversations c WHERE c.conv_id IN (SELECT id FROM cases WHERE tenant_id = 1 OR tenant_id IS NULL)"),
)
def p20b(spark: SparkSession, sf: str) -> DataFrame:
    entries = table(spark, sf, "conversations").select(F.col("conv_id").alias("case_id"), F.col("turn").alias("id"), "role")
    return po.case_entries(case_table(spark, sf), entries, "viewer", 1)


@query(
    "p22_effective_settings",
    """SELECT c_custkey, CASE WHEN n_nationkey % 3 = 0 THEN 'EUROPE' ELSE n_name END AS mode, CAST(n_regionkey AS BIGINT) AS poll, 'balanced' AS profile
    FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey""",
)
def p22(spark: SparkSession, sf: str) -> DataFrame:
    """Nations hold their customers' settings; a blank one falls back to a global row."""
    c = F.col
    per = table(spark, sf, "nation").select(
        c("n_nationkey").alias("tenant_id"), F.when(c("n_nationkey") % 3 == 0, F.lit("  ")).otherwise(c("n_name")).alias("mode"), c("n_regionkey").cast("bigint").alias("poll")
    )
    shared = table(spark, sf, "region").where(c("r_name") == "EUROPE").select(F.lit(None).cast("int").alias("tenant_id"), c("r_name").alias("mode"), F.lit(None).cast("bigint").alias("poll"))
    rows = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    out = po.effective_settings(rows, "c_nationkey", per.unionByName(shared), {"mode": "batch", "poll": 2, "profile": "balanced"})
    return out.select("c_custkey", "mode", F.col("poll").cast("bigint").alias("poll"), "profile")


# ---- counts and summaries ------------------------------------------------------------------------------------


@query("a1_decision_counts", with_(*TO_FUSED, select="SELECT decision_label, decision_risk_tier, reason_codes, count(*) AS n FROM fused GROUP BY ALL"))
def a1(spark: SparkSession, sf: str) -> DataFrame:
    return tr.count_by(fused(spark, sf), "decision_label", "decision_risk_tier", "reason_codes")


@query("a2_known_attack_types", with_(*TO_FUSED, select="SELECT tenant_id, supervised_prediction AS family, count(*) AS n FROM fused WHERE decision_label = 'KnownAttack' GROUP BY ALL"))
def a2(spark: SparkSession, sf: str) -> DataFrame:
    return tr.known_attack_type_counts(fused(spark, sf), ["tenant_id"])


RISK = """counts AS (SELECT tenant_id, count(*) AS rows_scored, count(*) FILTER (WHERE decision_label = 'KnownAttack') AS known_attack,
  count(*) FILTER (WHERE decision_label = 'AttackUncertain') AS attack_uncertain FROM decisions GROUP BY tenant_id)"""
LEVEL = "CASE WHEN known_attack = 0 AND attack_uncertain = 0 THEN 'low' ELSE 'elevated' END"


@query(
    "a20_risk_summary",
    with_(EVENT_DECISIONS, RISK, select=f"SELECT tenant_id, rows_scored, known_attack, attack_uncertain, {LEVEL} AS risk_level, CASE WHEN known_attack + attack_uncertain > 0 THEN 'present' ELSE 'none' END AS attack_indicators FROM counts"),
)
def a20(spark: SparkSession, sf: str) -> DataFrame:
    out = tr.summarize_risk(event_decisions(spark, sf), ["tenant_id"])
    return out.select("tenant_id", "rows_scored", "known_attack", "attack_uncertain", "risk_level", "attack_indicators")


@query(
    "a21_danger_verdict",
    with_(EVENT_DECISIONS, RISK, select=f"SELECT tenant_id, {LEVEL} AS risk_level, CASE WHEN known_attack + attack_uncertain > 0 THEN 'potential_danger_review_recommended' ELSE 'no_significant_danger_in_window' END AS danger_verdict FROM counts"),
)
def a21(spark: SparkSession, sf: str) -> DataFrame:
    return tr.add_risk(tr.decision_counts(event_decisions(spark, sf), ["tenant_id"])).select("tenant_id", "risk_level", "danger_verdict")


@query(
    "t5_top_families",
    with_(EVENT_DECISIONS, """f AS (SELECT tenant_id, supervised_prediction AS family, count(*) AS n FROM decisions WHERE decision_label = 'KnownAttack' GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY n DESC, family) AS rn FROM f)""",
    select="SELECT tenant_id, string_agg(family || ' (' || n || ')', ', ' ORDER BY rn) AS top_families FROM r WHERE rn <= 6 GROUP BY tenant_id"),
)
def t5(spark: SparkSession, sf: str) -> DataFrame:
    return tr.top_families_text(event_decisions(spark, sf), ["tenant_id"])


@query("t3_triage_queue", with_(*TO_FUSED, select="SELECT uid, decision_label, round(p_attack, 6) AS p_attack FROM fused ORDER BY CASE decision_label WHEN 'KnownAttack' THEN 2 WHEN 'AttackUncertain' THEN 1 ELSE 0 END DESC, fused.p_attack DESC, uid LIMIT 50"))
def t3(spark: SparkSession, sf: str) -> DataFrame:
    out = tr.triage_queue(fused(spark, sf).select("uid", "decision_label", "p_attack"), 50, ["uid"])
    return out.select("uid", "decision_label", F.round("p_attack", 6).alias("p_attack"))
