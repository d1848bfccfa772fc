"""How the given tables stand for flows, alerts, cases and so on: once as Spark tables, once as SQL text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from netsieve.functions.guards import col
from netsieve.models.linear import LinearModel
from netsieve.models.novelty import Detector, NoveltyOptions, score_and_fuse
from netsieve.models.preprocess import Scaler, fit_scaler
from netsieve.operators.mapping import conn_to_contract, to_benign_attack
from netsieve.operators.metrics import benign_threshold
from netsieve.operators.prototypes import fit_prototypes


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def epoch(c: Column) -> Column:
    """Seconds since 1970 of a zone-less timestamp, whatever the session time zone."""
    return F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), c.cast("timestamp_ntz"))


def with_(*ctes: str, select: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + select


# ---- flows ---------------------------------------------------------------------------------------------------

KEEP = ["uid", "label", "tenant_id"]


def flows(spark: SparkSession, sf: str) -> DataFrame:
    return as_flows(table(spark, sf, "lineitem"))


def as_flows(lineitem: DataFrame) -> DataFrame:
    c = F.col
    return lineitem.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", epoch(c("l_shipdate")).cast("string")).alias("uid"),
        F.when(c("l_suppkey") % 5 != 0, c("l_suppkey") % 5).alias("tenant_id"),
        epoch(c("l_shipdate")).alias("ts"),
        F.when(c("l_linenumber") == 7, F.lit("icmp")).when(c("l_linestatus") == "O", F.lit("TCP ")).otherwise(F.lit("udp")).alias("proto"),
        (c("l_tax") * 100.0 + 0.0).alias("duration"),
        c("l_extendedprice").alias("orig_bytes"),
        (c("l_extendedprice") * (1.0 - c("l_discount"))).alias("resp_bytes"),
        c("l_quantity").alias("orig_pkts"),
        c("l_linenumber").cast("double").alias("resp_pkts"),
        F.concat(F.lit("10."), c("l_suppkey") % 4, F.lit("."), c("l_partkey") % 256, F.lit("."), c("l_linenumber")).alias("ip"),
        c("l_partkey").cast("double").alias("id.orig_p"),
        c("l_suppkey").cast("double").alias("id.resp_p"),
        F.when(c("l_returnflag") == "N", F.lit("Benign")).when(c("l_returnflag") == "A", F.lit("DoS")).otherwise(F.lit("PortScan")).alias("label"),
    )


FLOWS = """flows AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(floor(epoch(l_shipdate)) AS BIGINT)) AS uid,
    CASE WHEN l_suppkey % 5 <> 0 THEN l_suppkey % 5 END AS tenant_id,
    CAST(floor(epoch(l_shipdate)) AS BIGINT) AS ts,
    CASE WHEN l_linenumber = 7 THEN 'icmp' WHEN l_linestatus = 'O' THEN 'TCP ' ELSE 'udp' END AS proto,
    l_tax * 100.0::DOUBLE + 0.0::DOUBLE AS duration,
    l_extendedprice AS orig_bytes,
    l_extendedprice * (1.0::DOUBLE - l_discount) AS resp_bytes,
    l_quantity AS orig_pkts,
    CAST(l_linenumber AS DOUBLE) AS resp_pkts,
    '10.' || (l_suppkey % 4) || '.' || (l_partkey % 256) || '.' || l_linenumber AS ip,
    CAST(l_partkey AS DOUBLE) AS orig_p,
    CAST(l_suppkey AS DOUBLE) AS resp_p,
    CASE l_returnflag WHEN 'N' THEN 'Benign' WHEN 'A' THEN 'DoS' ELSE 'PortScan' END AS label
  FROM lineitem)"""

# The small contract of the example models.
CONTRACT_COLUMNS = [
    "Protocol", "Flow Duration", "Total Fwd Packets", "Total Backward Packets", "Flow Bytes/s", "Flow Packets/s",
]

CONTRACT = """contract AS (
  SELECT uid, label, tenant_id, ts, ip,
    CASE lower(trim(proto)) WHEN 'tcp' THEN 6.0::DOUBLE WHEN 'udp' THEN 17.0::DOUBLE WHEN 'icmp' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS c1,
    duration * 1000000.0::DOUBLE AS c2,
    orig_pkts AS c3,
    resp_pkts AS c4,
    (orig_bytes + resp_bytes) / (CASE WHEN duration > 0 THEN duration ELSE 1.0::DOUBLE END) AS c5,
    (orig_pkts + resp_pkts) / (CASE WHEN duration > 0 THEN duration ELSE 1.0::DOUBLE END) AS c6
  FROM flows)"""


def contract(spark: SparkSession, sf: str, extra: tuple[str, ...] = ()) -> DataFrame:
    return conn_to_contract(flows(spark, sf), CONTRACT_COLUMNS, [*KEEP, *extra])


# ---- models with given coefficients --------------------------------------------------------------------------

BINARY_CLASSES = ["Attack", "Benign"]
# With two classes the coefficients are those of the second class, here Benign.
BINARY_COEF = [-0.8, 0.5, -1.1, -0.4, -0.9, 0.7]
BINARY_INTERCEPT = -0.3
FAMILY_CLASSES = ["Benign", "DoS", "PortScan"]
FAMILY_COEF = [
    [0.6, -0.4, -0.9, 0.3, -0.5, 0.2],
    [-0.3, 0.8, 0.7, -0.2, 0.4, -0.6],
    [-0.2, -0.5, 0.1, 0.6, 0.3, 0.5],
]
FAMILY_INTERCEPT = [0.2, -0.1, 0.05]
BENIGN_QUANTILE = 90.0


def binary_model(scaler: Scaler) -> LinearModel:
    return LinearModel(BINARY_CLASSES, scaler, [BINARY_COEF], [BINARY_INTERCEPT])


def family_model(scaler: Scaler) -> LinearModel:
    return LinearModel(FAMILY_CLASSES, scaler, FAMILY_COEF, FAMILY_INTERCEPT)


def mean_square(scaler: Scaler) -> Column:
    """A fixed anomaly score: the mean square of the scaled features."""
    total = F.lit(0.0)
    for z in scaler.expressions():
        total = total + z * z
    return total / F.lit(float(len(scaler.columns)))


_fitted: dict[tuple[str, str], Detector] = {}


def detector(spark: SparkSession, sf: str) -> Detector:
    """Scaler, threshold and prototypes fitted on the flows, coefficients given. Fitted once per session and folder,
    as a saved bundle would be."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _fitted:
        rows = contract(spark, sf)
        scaler = fit_scaler(rows, CONTRACT_COLUMNS)
        score = mean_square(scaler)
        threshold = benign_threshold(rows.where(F.col("label") == "Benign").select(score.alias("s")), "s", BENIGN_QUANTILE)
        protos = fit_prototypes(rows, "label", scaler.expressions(), FAMILY_CLASSES)
        _fitted[key] = Detector(binary_model(scaler), family_model(scaler), score, threshold, "mean_square", "1", protos)
    return _fitted[key]


def fused(spark: SparkSession, sf: str, thresholds: dict | None = None, options: NoveltyOptions = NoveltyOptions()) -> DataFrame:
    """Flows to decisions: the central plan of the engine."""
    return score_and_fuse(contract(spark, sf, ("ts", "ip")), detector(spark, sf), thresholds, options)


def binary_label() -> Column:
    return to_benign_attack(col("label"))


def _dot(weights: list[float], bias: float) -> str:
    return f"{bias}::DOUBLE" + "".join(f" + ({w}::DOUBLE) * z{i}" for i, w in enumerate(weights, 1))


STATS = "stats AS (SELECT " + ", ".join(
    f"avg(c{i}) AS m{i}, CASE WHEN stddev_pop(c{i}) = 0 THEN 1.0 ELSE stddev_pop(c{i}) END AS s{i}" for i in range(1, 7)
) + " FROM contract)"
SCALED = "scaled AS (SELECT contract.*, " + ", ".join(f"(c{i} - m{i}) / s{i} AS z{i}" for i in range(1, 7)) + " FROM contract, stats)"
LOGITS = (
    "logits AS (SELECT *, " + _dot(BINARY_COEF, BINARY_INTERCEPT) + " AS lb, "
    + ", ".join(f"{_dot(w, b)} AS l{i}" for i, (w, b) in enumerate(zip(FAMILY_COEF, FAMILY_INTERCEPT)))
    + ", (" + " + ".join(f"z{i}*z{i}" for i in range(1, 7)) + ") / 6.0 AS anomaly_score FROM scaled)"
)
PROBS = """probs AS (
  SELECT *, 1.0 / (1.0 + exp(lb)) AS p_attack,
    exp(l0 - greatest(l0, l1, l2)) / (exp(l0 - greatest(l0, l1, l2)) + exp(l1 - greatest(l0, l1, l2)) + exp(l2 - greatest(l0, l1, l2))) AS p0,
    exp(l1 - greatest(l0, l1, l2)) / (exp(l0 - greatest(l0, l1, l2)) + exp(l1 - greatest(l0, l1, l2)) + exp(l2 - greatest(l0, l1, l2))) AS p1,
    exp(l2 - greatest(l0, l1, l2)) / (exp(l0 - greatest(l0, l1, l2)) + exp(l1 - greatest(l0, l1, l2)) + exp(l2 - greatest(l0, l1, l2))) AS p2
  FROM logits)"""
CUT = f"cut AS (SELECT quantile_cont(anomaly_score, {BENIGN_QUANTILE / 100}) AS thr FROM probs WHERE label = 'Benign')"
TOP = "top AS (SELECT max(anomaly_score) AS hi FROM probs)"
NOVEL = """novel AS (
  SELECT probs.*, thr, greatest(p0, p1, p2) AS max_class_probability,
    CASE WHEN p0 >= p1 AND p0 >= p2 THEN 'Benign' WHEN p1 >= p2 THEN 'DoS' ELSE 'PortScan' END AS supervised_prediction,
    CASE WHEN p_attack >= 0.5 THEN 'Attack' ELSE 'Benign' END AS binary_prediction,
    anomaly_score > thr AND greatest(p0, p1, p2) < 0.55 AS is_novel_flagged,
    least(greatest(100.0 * (0.5 * least(greatest((anomaly_score - thr) / greatest(hi - thr, 1e-9), 0.0), 1.0)
      + 0.5 * (1.0 - least(greatest(greatest(p0, p1, p2), 0.0), 1.0))), 0.0), 100.0) AS suspected_zero_day_pct
  FROM probs, cut, top)"""
UNCERTAIN = """uncertain AS (
  SELECT *, CASE WHEN is_novel_flagged THEN 'Suspected_ZeroDay' ELSE supervised_prediction END AS prediction,
    binary_prediction = 'Attack' AND (is_novel_flagged OR suspected_zero_day_pct >= 70.0) AS is_attack_uncertain
  FROM novel)"""
PROTOS = "protos AS (SELECT " + ", ".join(
    f"avg(z{i}) FILTER (WHERE label = '{c}') AS {n}{i}" for n, c in (("b", "Benign"), ("d", "DoS"), ("s", "PortScan")) for i in range(1, 7)
) + " FROM uncertain)"
DIST = "dist AS (SELECT uncertain.*, sqrt(least(" + ", ".join(
    " + ".join(f"(z{i} - {n}{i}) * (z{i} - {n}{i})" for i in range(1, 7)) for n in ("b", "d", "s")
) + ")) AS open_set_nearest_distance FROM uncertain, protos)"
SPAN = "span AS (SELECT min(open_set_nearest_distance) AS lo, max(open_set_nearest_distance) AS hi2 FROM dist)"
OPEN = """open_set AS (
  SELECT dist.*, CASE WHEN hi2 - lo >= 1e-12 THEN (open_set_nearest_distance - lo) / (hi2 - lo) ELSE 0.0 END AS open_set_ood_score
  FROM dist, span)"""


def fused_sql(p: str = "0.70", szd: str = "70.0", ood: str = "0.60", name: str = "fused", source: str = "open_set") -> str:
    signal = f"(is_novel_flagged OR suspected_zero_day_pct >= {szd} OR open_set_ood_score >= {ood})"
    weak = f"(is_attack_uncertain OR {signal} OR p_attack < {p})"
    return f"""{name} AS (
  SELECT *,
    CASE WHEN binary_prediction = 'Attack' AND NOT {weak} THEN 'KnownAttack'
      WHEN binary_prediction = 'Attack' OR {signal} THEN 'AttackUncertain' ELSE 'BenignOrLowRisk' END AS decision_label,
    CASE WHEN binary_prediction = 'Attack' AND (p_attack >= {p} OR NOT {weak}) THEN 'high'
      WHEN binary_prediction = 'Attack' OR {signal} THEN 'medium' ELSE 'low' END AS decision_risk_tier,
    CASE WHEN binary_prediction = 'Attack' THEN concat_ws(';',
        CASE WHEN p_attack >= {p} THEN 'binary_attack_high_conf' ELSE 'binary_attack_low_conf' END,
        CASE WHEN is_attack_uncertain THEN 'attack_uncertain_signal' END,
        CASE WHEN is_novel_flagged THEN 'novel_flag' END,
        CASE WHEN suspected_zero_day_pct >= {szd} THEN 'high_szd_pct' END,
        CASE WHEN open_set_ood_score >= {ood} THEN 'high_open_set_ood' END)
      WHEN open_set_ood_score >= {ood} THEN 'benign_pred_high_open_set_ood'
      WHEN is_novel_flagged OR suspected_zero_day_pct >= {szd} THEN 'benign_pred_novelty_signal'
      ELSE 'benign_binary_pred' END AS reason_codes
  FROM {source})"""


FUSED = fused_sql()
TO_PROBS = [FLOWS, CONTRACT, STATS, SCALED, LOGITS, PROBS]
TO_UNCERTAIN = [*TO_PROBS, CUT, TOP, NOVEL, UNCERTAIN]
TO_OPEN = [*TO_UNCERTAIN, PROTOS, DIST, SPAN, OPEN]
TO_FUSED = [*TO_OPEN, FUSED]


# ---- operational tables --------------------------------------------------------------------------------------


def tenant_of(c: Column) -> Column:
    return F.when(c % 4 != 0, c % 4)


def alert_table(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as alerts."""
    c = F.col
    ip = F.concat(F.lit("10.0."), c("o_custkey") % 256, F.lit("."), c("o_orderkey") % 256)
    return table(spark, sf, "orders").select(
        c("o_orderkey").alias("id"),
        tenant_of(c("o_custkey")).alias("tenant_id"),
        F.substring("o_orderpriority", 3, 20).alias("severity"),
        F.concat(F.lit("alert "), c("o_orderkey")).alias("title"),
        F.when(c("o_orderstatus") == "F", F.lit("KnownAttack")).otherwise(F.lit("AttackUncertain")).alias("decision_label"),
        F.to_json(F.create_map(F.lit("ip"), ip, F.lit("customer"), c("o_custkey").cast("string"))).alias("payload_json"),
        F.when(c("o_orderstatus") == "O", F.lit("open")).when(c("o_orderstatus") == "F", F.lit("closed")).otherwise(F.lit("new")).alias("status"),
        (c("o_orderkey") % 3 == 0).cast("int").alias("suppressed"),
        F.when(c("o_orderkey") % 2 == 0, F.to_json(F.array(F.lit("rule a"), F.col("o_orderpriority")))).alias("rule_hits_json"),
        epoch(c("o_orderdate")).alias("created_at"),
    )


ALERTS = """alerts AS (
  SELECT o_orderkey AS id, CASE WHEN o_custkey % 4 <> 0 THEN o_custkey % 4 END AS tenant_id,
    substring(o_orderpriority, 3, 20) AS severity, 'alert ' || o_orderkey AS title,
    CASE WHEN o_orderstatus = 'F' THEN 'KnownAttack' ELSE 'AttackUncertain' END AS decision_label,
    '10.0.' || (o_custkey % 256) || '.' || (o_orderkey % 256) AS ip,
    CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'closed' ELSE 'new' END AS status,
    CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END AS suppressed,
    CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority END AS second_rule,
    CAST(floor(epoch(o_orderdate)) AS BIGINT) AS created_at
  FROM orders)"""


def case_table(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as cases."""
    c = F.col
    return table(spark, sf, "customer").select(
        c("c_custkey").alias("id"), tenant_of(c("c_custkey")).alias("tenant_id"), c("c_name").alias("title"),
        F.when(c("c_nationkey") % 3 == 0, F.lit("resolved")).when(c("c_nationkey") % 3 == 1, F.lit("closed")).otherwise(F.lit("open")).alias("status"),
        c("c_mktsegment").alias("priority"), (c("c_custkey") * 10).alias("created_at"),
    )


CASES = """cases AS (
  SELECT c_custkey AS id, CASE WHEN c_custkey % 4 <> 0 THEN c_custkey % 4 END AS tenant_id, c_name AS title,
    CASE c_nationkey % 3 WHEN 0 THEN 'resolved' WHEN 1 THEN 'closed' ELSE 'open' END AS status,
    c_mktsegment AS priority, c_custkey * 10 AS created_at
  FROM customer)"""


def job_table(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as background jobs."""
    c = F.col
    return table(spark, sf, "orders").select(
        c("o_orderkey").alias("id"), tenant_of(c("o_custkey")).alias("tenant_id"),
        F.when(c("o_orderpriority").startswith("1"), F.lit("export_alerts_csv")).otherwise(F.lit("stream_collect")).alias("job_type"),
        F.when(c("o_orderstatus") == "F", F.lit("completed")).otherwise(F.lit("failed")).alias("status"),
        F.when(c("o_totalprice") > 200000, F.lit("elevated")).otherwise(F.lit("low")).alias("risk_level"),
    )


JOBS = """jobs AS (
  SELECT o_orderkey AS id, CASE WHEN o_custkey % 4 <> 0 THEN o_custkey % 4 END AS tenant_id,
    CASE WHEN o_orderpriority LIKE '1%' THEN 'export_alerts_csv' ELSE 'stream_collect' END AS job_type,
    CASE WHEN o_orderstatus = 'F' THEN 'completed' ELSE 'failed' END AS status,
    CASE WHEN o_totalprice > 200000 THEN 'elevated' ELSE 'low' END AS risk_level
  FROM orders)"""


def event_decisions(spark: SparkSession, sf: str) -> DataFrame:
    return as_decisions(table(spark, sf, "events"))


def as_decisions(events: DataFrame) -> DataFrame:
    """Events as scored decisions of tenants."""
    c = F.col
    return events.select(
        "event_id", "ts", (c("user_id") % 4).alias("tenant_id"), c("value").alias("p_attack"),
        F.when(c("event_type") == "error", F.lit("KnownAttack")).when(c("event_type") == "signup", F.lit("AttackUncertain"))
        .otherwise(F.lit("BenignOrLowRisk")).alias("decision_label"),
        F.concat(F.lit("family "), c("user_id") % 9).alias("supervised_prediction"),
    )


EVENT_DECISIONS = """decisions AS (
  SELECT event_id, ts, user_id % 4 AS tenant_id, value AS p_attack,
    CASE event_type WHEN 'error' THEN 'KnownAttack' WHEN 'signup' THEN 'AttackUncertain' ELSE 'BenignOrLowRisk' END AS decision_label,
    'family ' || (user_id % 9) AS supervised_prediction
  FROM events)"""
