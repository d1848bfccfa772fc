"""Streaming queries: one-shot and timed scoring, log tailing, progress, sessions, uploads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from netsieve.operators.triage import count_by
from netsieve.plans.decide import NOW, RULES, RULES_SQL, SUPPRESSED, SUPPRESSIONS, suppression_table
from netsieve.plans.prepare import LOG_FIELDS, LOG_SQL, log_view, write_log
from netsieve.plans.registry import query
from netsieve.plans.views import (
    EVENT_DECISIONS, KEEP, TO_FUSED, TO_OPEN, as_decisions, as_flows, contract, detector, event_decisions, flows,
    fused_sql, table, with_,
)
from netsieve.session import run_dir
from netsieve.sources.conn_log import read_conn_log
from netsieve.streaming import scoring as st
from netsieve.streaming.tail_source import tail_log


def flow_stream(spark: SparkSession, sf: str) -> DataFrame:
    return as_flows(st.table_stream(spark, sf, "lineitem.parquet", table(spark, sf, "lineitem").schema))


@query("r1_stream_once", with_(*TO_FUSED, select="SELECT uid, decision_label, decision_risk_tier, reason_codes FROM fused"))
def r1(spark: SparkSession, sf: str) -> DataFrame:
    """One pass over what is there, exactly-once into Parquet: the same decisions as the batch job."""
    options, d = st.stored_reference(contract(spark, sf), detector(spark, sf))
    base = run_dir(spark, "r1")
    q = st.start_scoring(flow_stream(spark, sf), d, KEEP, f"{base}/out", f"{base}/state", options=options)
    st.run_once(q, f"{base}/state")
    return st.read_output(spark, f"{base}/out").select("uid", "decision_label", "decision_risk_tier", "reason_codes")


SESSION = """s AS (SELECT count(*) AS rows_scored, count(*) FILTER (WHERE decision_label = 'KnownAttack') AS known_attack,
  count(*) FILTER (WHERE decision_label = 'AttackUncertain') AS attack_uncertain FROM fused)"""
SESSION_COLUMNS = """SELECT rows_scored, known_attack, attack_uncertain, CASE WHEN rows_scored = 0 THEN 'unknown' WHEN known_attack + attack_uncertain > 0 THEN 'elevated' ELSE 'low' END AS risk_level,
  CASE WHEN rows_scored = 0 THEN 'no_traffic_scored' WHEN known_attack + attack_uncertain > 0 THEN 'potential_danger_review_recommended' ELSE 'no_significant_danger_in_window' END AS danger_verdict FROM s"""


@query("r2_timed_collection", with_(*TO_FUSED, SESSION, select=SESSION_COLUMNS))
def r2(spark: SparkSession, sf: str) -> DataFrame:
    """A polling session of a few seconds with alerts per batch, what had arrived finished, then its summary."""
    options, d = st.stored_reference(contract(spark, sf), detector(spark, sf))
    base = run_dir(spark, "r2")

    def start(poll: float | None):
        return st.start_scoring(
            flow_stream(spark, sf), d, KEEP, f"{base}/out", f"{base}/state", options=options, alerts=f"{base}/alerts", poll_seconds=poll
        )

    st.run_for(start, 5, f"{base}/state")
    out = st.session_summary(st.read_output(spark, f"{base}/out"))
    return out.select("rows_scored", "known_attack", "attack_uncertain", "risk_level", "danger_verdict")


@query("r3_tail_log", LOG_SQL)
def r3(spark: SparkSession, sf: str) -> DataFrame:
    """Follow a log that grows between two passes; the second continues at the first one's bytes."""
    base = run_dir(spark, "r3")
    rows = flows(spark, sf)
    for part in (0, 1):
        write_log(rows.where(F.pmod(F.xxhash64("uid"), F.lit(2)) == part), LOG_FIELDS, f"{base}/log")
        source = tail_log(spark, f"{base.removeprefix('file:')}/log/*.txt", LOG_FIELDS, 1 << 20)
        q = source.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
        q.awaitTermination()
    return log_view(spark.read.parquet(f"{base}/out"))


@query("r4_stream_progress", "SELECT count(*) AS rows_scored FROM lineitem")
def r4(spark: SparkSession, sf: str) -> DataFrame:
    options, d = st.stored_reference(contract(spark, sf), detector(spark, sf))
    base = run_dir(spark, "r4")
    q = st.start_scoring(flow_stream(spark, sf), d, KEEP, f"{base}/out", f"{base}/state", options=options)
    st.run_once(q, f"{base}/state")
    return st.progress_rows(spark, f"{base}/state").agg(F.max("rows_scored").alias("rows_scored"))


STRICT = {"min_p_attack_known": 0.8, "min_szd_uncertain": 45.0, "min_open_set_uncertain": 0.5}


@query("r5_batch_thresholds", with_(*TO_OPEN, fused_sql("0.8", "45.0", "0.5", "strict"), select="SELECT decision_label, reason_codes, count(*) AS n FROM strict GROUP BY ALL"))
def r5(spark: SparkSession, sf: str) -> DataFrame:
    """The batch job with a stored threshold file."""
    path = run_dir(spark, "r5")
    spark.range(1).select(*[F.lit(v).alias(k) for k, v in STRICT.items()]).write.json(path)
    out = st.triage(flows(spark, sf), detector(spark, sf), KEEP, st.load_thresholds(spark, path))
    return count_by(out, "decision_label", "reason_codes")


WINDOWS = """win AS (SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS w, count(*) AS rows_scored, count(*) FILTER (WHERE decision_label = 'KnownAttack') AS known_attack,
  count(*) FILTER (WHERE decision_label = 'AttackUncertain') AS attack_uncertain FROM decisions GROUP BY 1)"""
WINDOW_COLUMNS = "SELECT CAST(epoch(w) AS BIGINT) AS window_start, rows_scored, known_attack, attack_uncertain, CASE WHEN known_attack + attack_uncertain > 0 THEN 'elevated' ELSE 'low' END AS risk_level FROM win"


def _window_view(df: DataFrame) -> DataFrame:
    start = F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("window_start").cast("timestamp_ntz"))
    return df.select(start.alias("window_start"), "rows_scored", "known_attack", "attack_uncertain", "risk_level")


@query("r6_session_windows", with_(EVENT_DECISIONS, WINDOWS, select=WINDOW_COLUMNS))
def r6(spark: SparkSession, sf: str) -> DataFrame:
    return _window_view(st.windowed_counts(event_decisions(spark, sf), "ts", "6 hours"))


@query(
    "r6_session_windows_stream",
    with_(EVENT_DECISIONS, WINDOWS, select=WINDOW_COLUMNS + " WHERE w + INTERVAL 6 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM decisions)"),
)
def r6b(spark: SparkSession, sf: str) -> DataFrame:
    """The windows the watermark has closed by the end of the stream."""
    events = as_decisions(st.table_stream(spark, sf, "events.parquet", table(spark, sf, "events").schema))
    counts = st.windowed_counts(events, "ts", "6 hours", "10 minutes")
    return _window_view(st.collect_stream(counts, "r6"))


UPLOAD_FIELDS = [*LOG_FIELDS, "ip", "tenant_id"]


@query("r7_triage_upload", with_(*TO_FUSED, SUPPRESSIONS, select=f"SELECT uid, decision_label, {SUPPRESSED} AS suppressed, {RULES_SQL} AS hits FROM fused f"))
def r7(spark: SparkSession, sf: str) -> DataFrame:
    """An uploaded log, read as text, through triage, suppressions and rules."""
    path = run_dir(spark, "r7")
    write_log(flows(spark, sf), UPLOAD_FIELDS, path)
    raw = read_conn_log(spark, path).withColumn("tenant_id", F.col("tenant_id").try_cast("bigint"))
    out = st.triage_enriched(raw, detector(spark, sf), ["uid", "ip", "tenant_id"], suppression_table(spark, sf), RULES, "tenant_id", NOW)
    return out.select("uid", "decision_label", F.col("_suppressed").alias("suppressed"), F.array_join("_rule_hits", ",").alias("hits"))


@query("s11_stream_alerts", with_(*TO_FUSED, select="SELECT uid, decision_label FROM fused WHERE decision_label IN ('KnownAttack', 'AttackUncertain')"))
def s11(spark: SparkSession, sf: str) -> DataFrame:
    """Alerts written per micro-batch next to the scored rows."""
    options, d = st.stored_reference(contract(spark, sf), detector(spark, sf))
    base = run_dir(spark, "s11s")
    q = st.start_scoring(flow_stream(spark, sf), d, KEEP, f"{base}/out", f"{base}/state", options=options, alerts=f"{base}/alerts")
    st.run_once(q, f"{base}/state")
    return spark.read.schema("uid string, decision_label string").json(f"{base}/alerts").select("uid", "decision_label")
