"""Reading, writing, cleaning and mapping queries."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from netsieve.functions.guards import col, to_number
from netsieve.functions.text import redact_columns, redact_ip_cells
from netsieve.models.linear import LinearModel, score_supervised
from netsieve.operators import mapping as mp, schema as sc
from netsieve.operators.ranking import head, tail
from netsieve.plans.registry import query
from netsieve.plans.views import (
    ALERTS, CONTRACT, CONTRACT_COLUMNS, FLOWS, TO_FUSED, TO_PROBS, alert_table, contract, detector, epoch, flows,
    fused, table, with_,
)
from netsieve.session import run_dir
from netsieve.sources import sinks, tables
from netsieve.sources.bundles import load_bundle, save_bundle
from netsieve.sources.conn_log import read_conn_log, read_plain_log, to_log_lines

# ---- sources and sinks ---------------------------------------------------------------------------------------


@query("s1_read_table", "SELECT * FROM part")
def s1(spark: SparkSession, sf: str) -> DataFrame:
    return tables.read_table(spark, f"{sf}/part.parquet")


@query("s2_write_table", "SELECT * FROM part")
def s2(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part")
    path = run_dir(spark, "s2") + "/part.csv"
    tables.write_table(part, path)
    return tables.read_table(spark, path, part.schema)


TABLE_NAMES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "benchmark", "labels", "conversations"]


@query(
    "s3_load_raw_tables",
    " UNION ALL ".join(f"SELECT '{t}' AS label, count(*) AS n FROM {t}" for t in TABLE_NAMES)
    + " UNION ALL SELECT CAST(label AS VARCHAR) AS label, count(*) AS n FROM embeddings GROUP BY label",
)
def s3(spark: SparkSession, sf: str) -> DataFrame:
    """Every table of the folder as one; files without a label are labelled by their name."""
    return tables.load_raw_tables(spark, sf).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query(
    "s4_label_from_filename",
    "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN source || '-' || lang WHEN doc_id % 3 = 1 THEN source ELSE lang END AS label FROM documents",
)
def s4(spark: SparkSession, sf: str) -> DataFrame:
    d = F.col("doc_id") % 3
    name = (
        F.when(d == 0, F.concat("source", F.lit("-"), "lang", F.lit("-Monday-no-metadata.parquet")))
        .when(d == 1, F.concat("source", F.lit("-part.csv")))
        .otherwise(F.concat("lang", F.lit(".parquet")))
    )
    return table(spark, sf, "documents").select("doc_id", tables.label_from_filename(name).alias("label"))


@query(
    "s5_capped_per_source",
    """WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents),
    k AS (SELECT greatest(1, ceil(300.0 / count(DISTINCT source))) AS cap FROM documents)
    SELECT doc_id, source FROM r, k WHERE rn <= cap""",
)
def s5(spark: SparkSession, sf: str) -> DataFrame:
    return tables.capped_per_source(table(spark, sf, "documents").select("doc_id", "source"), "source", ["doc_id"], 300)


@query("s6_read_limited", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 1000")
def s6(spark: SparkSession, sf: str) -> DataFrame:
    return head(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), ["o_orderkey"], 1000)


LOG_FIELDS = ["uid", "ts", "proto", "duration", "orig_bytes", "resp_bytes", "orig_pkts", "resp_pkts", "id.orig_p", "id.resp_p"]


def write_log(rows: DataFrame, fields: list[str], path: str) -> None:
    """Flows as a tab-separated log with its header lines, written as text parts."""
    lines = to_log_lines(rows, fields)
    header = rows.sparkSession.range(1).select(F.explode(F.array(F.lit("#separator \\x09"), F.lit("\t".join(["#fields", *fields])), F.lit(""))).alias("value"))
    header.write.mode("append").text(path)
    lines.write.mode("append").text(path)


LOG_SQL = with_(
    FLOWS,
    select="SELECT uid, ts, trim(proto) AS proto, round(duration, 6) AS duration, round(orig_bytes, 4) AS orig_bytes, "
    "round(resp_bytes, 4) AS resp_bytes, orig_pkts, resp_pkts, orig_p, resp_p FROM flows",
)


def log_view(df: DataFrame) -> DataFrame:
    n = lambda c: to_number(col(c))
    return df.select(
        "uid", col("ts").try_cast("bigint").alias("ts"), F.trim("proto").alias("proto"), F.round(n("duration"), 6).alias("duration"),
        F.round(n("orig_bytes"), 4).alias("orig_bytes"), F.round(n("resp_bytes"), 4).alias("resp_bytes"),
        n("orig_pkts").alias("orig_pkts"), n("resp_pkts").alias("resp_pkts"), n("id.orig_p").alias("orig_p"), n("id.resp_p").alias("resp_p"),
    )


@query("s7_read_conn_log", LOG_SQL)
def s7(spark: SparkSession, sf: str) -> DataFrame:
    path = run_dir(spark, "s7")
    write_log(flows(spark, sf), LOG_FIELDS, path)
    return log_view(read_conn_log(spark, path))


@query("s8_read_plain_log", LOG_SQL)
def s8(spark: SparkSession, sf: str) -> DataFrame:
    path = run_dir(spark, "s8")
    flows(spark, sf).select(*[col(c) for c in LOG_FIELDS]).write.csv(path, sep="\t", header=True)
    return log_view(read_plain_log(spark, path))


CORPUS_SQL = "SELECT source || '-' || doc_id AS title, lang AS family, source, md5(text) AS digest, CAST(length(text) AS BIGINT) AS n FROM documents WHERE doc_id % 5 <> 0"


@query("s9_read_corpus", CORPUS_SQL)
def s9(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as JSON lines, every fifth without its text, read back as a corpus."""
    d = table(spark, sf, "documents").select(
        F.concat("source", F.lit("-"), "doc_id").alias("title"), F.col("lang").alias("family"), "source",
        F.when(F.col("doc_id") % 5 != 0, F.col("text")).alias("text"),
    )
    path = run_dir(spark, "s9")
    tables.write_jsonl(d, path)
    return tables.read_corpus(spark, path).select("title", "family", "source", F.md5("text").alias("digest"), F.length("text").cast("bigint").alias("n"))


@query("s10_write_jsonl", with_(*TO_PROBS, select="SELECT uid, round(p_attack, 6) AS score FROM probs"))
def s10(spark: SparkSession, sf: str) -> DataFrame:
    path = run_dir(spark, "s10")
    tables.write_jsonl(score_supervised(contract(spark, sf), detector(spark, sf).binary, ["uid"]).select("uid", "score"), path)
    return spark.read.schema("uid string, score double").json(path).select("uid", F.round("score", 6).alias("score"))


@query("s11_emit_alerts", with_(*TO_FUSED, select="SELECT uid, decision_label, round(p_attack, 6) AS p_attack FROM fused WHERE decision_label IN ('KnownAttack', 'AttackUncertain')"))
def s11(spark: SparkSession, sf: str) -> DataFrame:
    path = run_dir(spark, "s11")
    sinks.emit_alerts(fused(spark, sf).select("uid", "decision_label", "p_attack"), path)
    back = spark.read.schema("uid string, decision_label string, p_attack double").json(path)
    return back.select("uid", "decision_label", F.round("p_attack", 6).alias("p_attack"))


@query(
    "s12_scored_events",
    """SELECT CAST(7 AS BIGINT) AS tenant_id, CAST(event_id AS VARCHAR) AS row_id, CAST(epoch_us(ts) AS VARCHAR) AS timestamp,
    value AS score, event_type AS label, CAST(NULL AS VARCHAR) AS model_version, value AS json_score, CAST(1700000000 AS BIGINT) AS created_at FROM events""",
)
def s12(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col
    us = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), c("ts"))
    events = table(spark, sf, "events").select(
        c("event_id").alias("id"), us.alias("timestamp"), c("value").alias("score"), c("event_type").alias("label"), "props"
    )
    path = run_dir(spark, "s12")
    sinks.append_scored_events(events, path, 7, 1_700_000_000)
    back = spark.read.parquet(path)
    return back.withColumn("json_score", F.get_json_object("raw_json", "$.score").cast("double")).drop("raw_json")


@query(
    "s13_export_alerts",
    with_(ALERTS, select="SELECT id, tenant_id, severity, title, decision_label, status, suppressed, created_at FROM alerts WHERE tenant_id = 2 OR tenant_id IS NULL"),
)
def s13(spark: SparkSession, sf: str) -> DataFrame:
    out = sinks.alert_export(alert_table(spark, sf), "analyst", 2)
    path = run_dir(spark, "s13") + "/alerts.csv"
    tables.write_table(out, path)
    return tables.read_table(spark, path, out.schema)


@query(
    "s14_export_audit",
    "SELECT event_id AS id, CAST(user_id AS VARCHAR) AS actor, event_type AS action, props AS payload_json, CAST(floor(epoch(ts)) AS BIGINT) AS created_at, "
    "CASE WHEN user_id % 4 <> 0 THEN user_id % 4 END AS tenant_id FROM events WHERE user_id % 4 = 0 OR user_id % 4 = 1 ORDER BY id DESC LIMIT 5000",
)
def s14(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col
    audit = table(spark, sf, "events").select(
        c("event_id").alias("id"), c("user_id").cast("string").alias("actor"), c("event_type").alias("action"),
        c("props").alias("payload_json"), epoch(c("ts")).alias("created_at"),
        F.when(c("user_id") % 4 != 0, c("user_id") % 4).alias("tenant_id"),
    )
    return sinks.audit_export(audit, "analyst", 1)


@query(
    "s15_run_history",
    """SELECT doc_id AS created_at, CAST(length(text) AS BIGINT) AS row_count, length(text) > 5000 AS truncated,
    CASE WHEN length(text) > 5000 THEN md5(substring(text, 1, 4920)) ELSE md5(text) END AS digest FROM documents""",
)
def s15(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text", F.length("text").alias("n"))
    runs = docs.select("doc_id", "n", sinks.bounded_detail(F.col("text"), 5000, 4920).alias("detail"))
    rows = sinks.history_rows(runs, "detail", "score", "n", "analyst", F.col("doc_id"))
    cut = F.get_json_object("detail_json", "$._truncated") == "true"
    text = F.when(cut, F.get_json_object("detail_json", "$.preview")).otherwise(F.col("detail_json"))
    return rows.select("created_at", "row_count", F.coalesce(cut, F.lit(False)).alias("truncated"), F.md5(text).alias("digest"))


@query(
    "s15_audit_rows",
    r"""SELECT doc_id AS ts, md5(regexp_replace(regexp_replace(text, '\b(?:\d{1,3}\.){3}\d{1,3}\b', '[REDACTED_IP]', 'g'),
      '\b[a-zA-Z0-9-]{1,63}(?:\.[a-zA-Z0-9-]{1,63})+\b', '[REDACTED_DOMAIN]', 'g')) AS digest FROM documents""",
)
def s15b(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", F.create_map(F.lit("text"), F.col("text")).alias("detail"))
    rows = sinks.audit_rows(docs, "document", ["detail"], F.col("doc_id"))
    return rows.select("ts", F.md5(F.from_json("payload", "detail map<string,string>")["detail"]["text"]).alias("digest"))


@query(
    "s17_upsert_latest",
    """WITH merged AS (SELECT c_custkey AS job_id, c_name AS parquet_path, CAST(-1 AS BIGINT) AS updated_at FROM customer
      UNION ALL SELECT o_custkey, 'order ' || o_orderkey, o_orderkey FROM orders),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY updated_at DESC) AS rn FROM merged)
    SELECT job_id, parquet_path, updated_at FROM ranked WHERE rn = 1""",
)
def s17(spark: SparkSession, sf: str) -> DataFrame:
    current = table(spark, sf, "customer").select(F.col("c_custkey").alias("job_id"), F.col("c_name").alias("parquet_path"), F.lit(-1).cast("bigint").alias("updated_at"))
    changes = table(spark, sf, "orders").select(F.col("o_custkey").alias("job_id"), F.concat(F.lit("order "), "o_orderkey").alias("parquet_path"), F.col("o_orderkey").alias("updated_at"))
    return sinks.upsert_latest(current, changes)


@query("s18_model_bundle", with_(*TO_PROBS, select="SELECT uid, round(p_attack, 6) AS p_attack FROM probs"))
def s18(spark: SparkSession, sf: str) -> DataFrame:
    """Save a model, load it, score with the loaded one."""
    path = run_dir(spark, "s18")
    save_bundle(spark, path, detector(spark, sf).binary.to_bundle(dataset_slug="flows"))
    model = LinearModel.from_bundle(load_bundle(spark, path))
    return score_supervised(contract(spark, sf), model, ["uid"]).select("uid", F.round("p_attack", 6).alias("p_attack"))


@query("s19_export_benign", with_(FLOWS, select="SELECT uid, label FROM flows WHERE label = 'Benign'"))
def s19(spark: SparkSession, sf: str) -> DataFrame:
    return mp.export_benign(flows(spark, sf).select("uid", "label"), "label")


@query("s20_splits_and_manifest", with_(FLOWS, select="SELECT 'flows' AS dataset_slug, count(*) AS n_rows, CAST(4 AS BIGINT) AS n_columns, CAST(42 AS BIGINT) AS split_seed, 'label' AS label_column FROM flows"))
def s20(spark: SparkSession, sf: str) -> DataFrame:
    """Split, write, read the written splits back, describe them."""
    from netsieve.operators.ranking import split_train_val_test

    path = run_dir(spark, "s20")
    rows = flows(spark, sf).select("uid", "label", "ts")
    sinks.write_splits(split_train_val_test(rows, ["uid"], "label"), path)
    m = sinks.manifest(spark.read.parquet(path), "flows", sf, "label", 42)
    return m.select("dataset_slug", "n_rows", F.size("columns").cast("bigint").alias("n_columns"), F.col("split_seed").cast("bigint").alias("split_seed"), "label_column")


# ---- projections and schema ----------------------------------------------------------------------------------


@query("p1_feature_columns", "SELECT * EXCLUDE (l_returnflag, l_linestatus, l_shipdate) FROM lineitem")
def p1(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    return li.select(sc.infer_feature_columns(li, ["l_returnflag", "l_linestatus", "l_shipdate"]))


@query("p2_split_xy", "SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority AS y FROM orders")
def p2(spark: SparkSession, sf: str) -> DataFrame:
    x, y = sc.split_xy(
        table(spark, sf, "orders"), sc.FeatureSpec(["o_custkey", "o_totalprice"], "o_orderpriority", ["o_orderkey"])
    )
    return x.join(y.withColumnRenamed("o_orderpriority", "y"), "o_orderkey")


@query("p3_numeric_columns", "SELECT c_custkey, c_nationkey, c_acctbal FROM customer")
def p3(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    return c.select(sc.numeric_columns(c))


@query("p4_align_columns", "SELECT p_retailprice, p_size, p_partkey FROM part")
def p4(spark: SparkSession, sf: str) -> DataFrame:
    return sc.align_columns_strict(table(spark, sf, "part"), ["p_retailprice", "p_size", "p_partkey"])


@query(
    "p5_validate_features",
    """SELECT 'orig_bytes' AS "column", true AS found, true AS numeric, CAST(0 AS BIGINT) AS bad_values
    UNION ALL SELECT 'rate', true, true, count(*) FILTER (WHERE l_tax = 0) FROM lineitem
    UNION ALL SELECT 'proto', true, false, NULL UNION ALL SELECT 'nowhere', false, false, NULL""",
)
def p5(spark: SparkSession, sf: str) -> DataFrame:
    rows = flows(spark, sf).withColumn("rate", F.when(F.col("duration") == 0, F.lit(float("nan"))).otherwise(F.col("orig_bytes")))
    return sc.validate_features(rows, ["orig_bytes", "rate", "proto", "nowhere"])


def _variants(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col
    return contract(spark, sf).select(
        c("uid").alias("Flow ID"), c("`Protocol`").alias("PROTOCOL"), c("`Flow Duration`").alias("flow_duration"),
        c("`Total Fwd Packets`").alias("totalfwdpackets"), c("`Total Backward Packets`").alias(" Total Backward Packets "),
        c("`Flow Bytes/s`").alias("bytes per second"), c("`Flow Packets/s`").alias("Flow Packets/s"),
        c("tenant_id").alias("extra column"), c("label").alias("Label"),
    )


ALIASES = {"Bytes per second": "Flow Bytes/s"}
CONTRACT_ROUNDED = "round(c1, 8) AS c1, round(c2, 8) AS c2, round(c3, 8) AS c3, round(c4, 8) AS c4, round(c5, 8) AS c5, round(c6, 8) AS c6"


def _rounded(df: DataFrame, *more: str) -> DataFrame:
    return df.select(*more, *[F.round(col(n), 8).alias(f"c{i}") for i, n in enumerate(CONTRACT_COLUMNS, 1)])


@query("p7_normalize_columns", with_(FLOWS, CONTRACT, select=f"SELECT {CONTRACT_ROUNDED}, tenant_id AS extra, label FROM contract"))
def p7(spark: SparkSession, sf: str) -> DataFrame:
    out = sc.normalize_columns(_variants(spark, sf), CONTRACT_COLUMNS, "Label", ALIASES)
    return _rounded(out.withColumnsRenamed({"extra column": "extra", "Label": "label"}), "extra", "label")


@query("p9_normalize_to_contract", with_(FLOWS, CONTRACT, select=f"SELECT {CONTRACT_ROUNDED}, label FROM contract"))
def p9(spark: SparkSession, sf: str) -> DataFrame:
    out, report = sc.normalize_to_contract(_variants(spark, sf), CONTRACT_COLUMNS, "Label", ALIASES)
    if out is None:
        raise ValueError(report)
    return _rounded(out.withColumnRenamed("Label", "label"), "label")


@query("p10_benign_attack", with_(FLOWS, select="SELECT uid, CASE WHEN label = 'Benign' THEN 'Benign' ELSE 'Attack' END AS binary_label FROM flows"))
def p10(spark: SparkSession, sf: str) -> DataFrame:
    noisy = F.when(F.col("tenant_id") == 1, F.concat(F.lit(" "), F.upper("label"))).otherwise(F.col("label"))
    return flows(spark, sf).select("uid", mp.to_benign_attack(noisy).alias("binary_label"))


@query("p11_clean", "SELECT DISTINCT user_id, event_type AS label FROM events WHERE event_type <> 'signup'")
def p11(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select("user_id", F.when(F.col("event_type") != "signup", F.col("event_type")).alias("label"))
    return mp.clean(rows, "label")


@query(
    "p12_derived_features",
    with_(FLOWS, CONTRACT, select="SELECT uid, round(ln(1 + c2), 6) AS log_duration, round(ln(1 + c5), 6) AS log_bytes, round(c3 / (c4 + 1.0), 6) AS packet_ratio, CAST(0 AS BIGINT) AS narrow FROM contract"),
)
def p12(spark: SparkSession, sf: str) -> DataFrame:
    """Protocol stays at or below 17, so it gets no logarithm."""
    out = mp.derived_features(contract(spark, sf), CONTRACT_COLUMNS)
    return out.select(
        "uid", F.round("`der_log1p_Flow Duration`", 6).alias("log_duration"), F.round("`der_log1p_Flow Bytes/s`", 6).alias("log_bytes"),
        F.round("der_fwd_bwd_packet_ratio", 6).alias("packet_ratio"),
        F.lit(int("der_log1p_Protocol" in out.columns)).cast("bigint").alias("narrow"),
    )


@query(
    "p13_conn_basic_features",
    with_(FLOWS, select="SELECT uid, round(orig_bytes, 4) AS orig_bytes, round(resp_bytes, 4) AS resp_bytes, round(duration, 6) AS duration, resp_p AS dst_port, orig_p AS src_port, orig_pkts, resp_pkts, proto FROM flows"),
)
def p13(spark: SparkSession, sf: str) -> DataFrame:
    out = mp.conn_basic_features(flows(spark, sf), ["uid"])
    return out.withColumns({"orig_bytes": F.round("orig_bytes", 4), "resp_bytes": F.round("resp_bytes", 4), "duration": F.round("duration", 6)})


P14_SQL = {
    "Protocol": "CASE lower(trim(proto)) WHEN 'tcp' THEN 6.0 WHEN 'udp' THEN 17.0 WHEN 'icmp' THEN 1.0 ELSE 0.0 END",
    "Flow Duration": "duration * 1000000.0", "Total Fwd Packets": "orig_pkts", "Total Backward Packets": "resp_pkts",
    "Fwd Packets Length Total": "orig_bytes", "Bwd Packets Length Total": "resp_bytes",
    "Flow Bytes/s": "(orig_bytes + resp_bytes) / sd", "Flow Packets/s": "(orig_pkts + resp_pkts) / sd",
    "Fwd Packets/s": "orig_pkts / sd", "Bwd Packets/s": "resp_pkts / sd",
    "Fwd Packet Length Max": "orig_bytes", "Fwd Packet Length Min": "CASE WHEN orig_bytes > 0 THEN orig_bytes ELSE 0 END",
    "Fwd Packet Length Mean": "CASE WHEN orig_pkts > 0 THEN orig_bytes / orig_pkts ELSE 0 END",
    "Bwd Packet Length Max": "resp_bytes", "Bwd Packet Length Min": "CASE WHEN resp_bytes > 0 THEN resp_bytes ELSE 0 END",
    "Bwd Packet Length Mean": "CASE WHEN resp_pkts > 0 THEN resp_bytes / resp_pkts ELSE 0 END",
    "Packet Length Min": "CASE WHEN orig_bytes + resp_bytes > 0 THEN orig_bytes + resp_bytes ELSE 0 END",
    "Packet Length Max": "orig_bytes + resp_bytes",
    "Packet Length Mean": "CASE WHEN orig_pkts + resp_pkts > 0 THEN (orig_bytes + resp_bytes) / (orig_pkts + resp_pkts) ELSE 0 END",
    "Avg Packet Size": "CASE WHEN orig_pkts + resp_pkts > 0 THEN (orig_bytes + resp_bytes) / (orig_pkts + resp_pkts) ELSE 0 END",
    "Subflow Fwd Packets": "orig_pkts", "Subflow Fwd Bytes": "orig_bytes", "Subflow Bwd Packets": "resp_pkts",
    "Subflow Bwd Bytes": "resp_bytes", "Init Fwd Win Bytes": "orig_p", "Init Bwd Win Bytes": "resp_p",
    "Idle Mean": "0",
}


# Quotients of prices end in a 5 often enough for the two engines to round them apart; a scaled value does not.
SCALE = 0.7310585786300049


def _plain(name: str) -> str:
    return re.sub(r"\W+", "_", name).lower()


@query(
    "p14_conn_to_contract",
    with_(
        FLOWS, "f AS (SELECT *, CASE WHEN duration > 0 THEN duration ELSE 1.0 END AS sd FROM flows)",
        select="SELECT uid, " + ", ".join(f"round(CAST({e} AS DOUBLE) * {SCALE}::DOUBLE, 3) AS {_plain(n)}" for n, e in P14_SQL.items()) + " FROM f",
    ),
)
def p14(spark: SparkSession, sf: str) -> DataFrame:
    names = list(P14_SQL)
    out = mp.conn_to_contract(flows(spark, sf), names, ["uid"])
    return out.select("uid", *[F.round(col(n) * SCALE, 3).alias(_plain(n)) for n in names])


@query("p15_prepare_input", with_(FLOWS, CONTRACT, select=f"SELECT uid, {CONTRACT_ROUNDED} FROM contract"))
def p15(spark: SparkSession, sf: str) -> DataFrame:
    """A log becomes contract rows, and contract rows pass through unchanged."""
    once = mp.prepare_input(flows(spark, sf), CONTRACT_COLUMNS, ["uid"])
    return _rounded(mp.prepare_input(once, CONTRACT_COLUMNS, ["uid"]), "uid")


@query(
    "p16_to_number",
    """SELECT event_id, round(CASE event_type WHEN 'error' THEN 0 WHEN 'view' THEN 0 WHEN 'signup' THEN 0 ELSE value END, 6) AS x, CAST(0 AS DOUBLE) AS absent FROM events""",
)
def p16(spark: SparkSession, sf: str) -> DataFrame:
    v, t = F.col("value").cast("string"), F.col("event_type")
    text = F.when(t == "error", F.lit("-")).when(t == "view", F.concat(v, F.lit("x"))).when(t == "signup", F.lit("")).when(t == "click", F.concat(F.lit(" "), v, F.lit(" "))).otherwise(v)
    rows = table(spark, sf, "events").select("event_id", text.alias("x"))
    return rows.select("event_id", F.round(mp.num_column(rows, "x"), 6).alias("x"), mp.num_column(rows, "missing").alias("absent"))


@query(
    "p17_external_to_contract",
    with_(FLOWS, select="""SELECT uid, CASE proto WHEN 'udp' THEN 17.0 WHEN 'icmp' THEN 1.0 ELSE 0.0 END::DOUBLE AS c1, round(duration * 1000000.0, 8) AS c2, orig_pkts AS c3, resp_pkts AS c4,
    round(CASE WHEN duration = 0 THEN 0 ELSE (orig_bytes + resp_bytes) / duration END, 8) AS c5,
    round(CASE WHEN duration = 0 THEN 0 ELSE (orig_pkts + resp_pkts) / duration END, 8) AS c6,
    CASE WHEN label = 'Benign' THEN 'Benign' WHEN tenant_id IS NULL THEN 'UnknownAttack' ELSE label END AS label FROM flows"""),
)
def p17(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col
    src = flows(spark, sf).select(
        "uid", "proto", c("duration").alias("dur"), c("orig_pkts").alias("spkts"), c("resp_pkts").alias("dpkts"),
        c("orig_bytes").alias("sbytes"), c("resp_bytes").alias("dbytes"), (c("label") != "Benign").cast("int").alias("label"),
        F.when(c("tenant_id").isNotNull(), c("label")).alias("attack_cat"),
    )
    out = mp.external_to_contract(src, CONTRACT_COLUMNS, "label", ["uid"])
    return _rounded(out, "uid", "label")


@query("p21_unknown_label", with_(FLOWS, select="SELECT uid, label NOT IN ('Benign', 'DoS') AS unknown_trimmed, tenant_id IS NULL OR label NOT IN ('Benign', 'DoS') AS unknown_exact FROM flows"))
def p21(spark: SparkSession, sf: str) -> DataFrame:
    padded = F.when(F.col("tenant_id").isNull(), F.concat("label", F.lit(" "))).otherwise(F.col("label"))
    known = ["Benign", "DoS"]
    return flows(spark, sf).select(
        "uid", mp.unknown_label(padded, known).alias("unknown_trimmed"), mp.unknown_label(padded, known, trim=False).alias("unknown_exact")
    )


# ---- set operations and tails --------------------------------------------------------------------------------


@query("u1_union_by_name", "SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance, c_mktsegment AS segment FROM customer UNION ALL SELECT s_suppkey, s_name, s_acctbal, NULL FROM supplier")
def u1(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "customer").selectExpr("c_mktsegment AS segment", "c_custkey AS id", "c_name AS name", "c_acctbal AS balance")
    b = table(spark, sf, "supplier").selectExpr("s_suppkey AS id", "s_name AS name", "s_acctbal AS balance")
    return tables.union_by_name([a, b])


@query("u2_append", "SELECT c_custkey AS id, c_acctbal AS balance FROM customer UNION ALL SELECT s_suppkey, s_acctbal FROM supplier")
def u2(spark: SparkSession, sf: str) -> DataFrame:
    """Batches are appended to the output instead of rewriting it."""
    path = run_dir(spark, "u2")
    for name, p in (("customer", "c"), ("supplier", "s")):
        key = "c_custkey" if p == "c" else "s_suppkey"
        table(spark, sf, name).selectExpr(f"{key} AS id", f"{p}_acctbal AS balance").write.mode("append").parquet(path)
    return spark.read.parquet(path)


@query("u3_distinct", "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem")
def u3(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber").dropDuplicates()


@query("w7_tail", "SELECT event_id, value FROM events ORDER BY ts DESC, event_id DESC LIMIT 100")
def w7(spark: SparkSession, sf: str) -> DataFrame:
    return tail(table(spark, sf, "events").select("event_id", "value", "ts"), ["ts", "event_id"], 100).select("event_id", "value")


# ---- text ----------------------------------------------------------------------------------------------------


def _redact_sql(c: str) -> str:
    return rf"""regexp_replace(regexp_replace({c}, '\b(?:\d{{1,3}}\.){{3}}\d{{1,3}}\b', '[REDACTED_IP]', 'g'), '\b[a-zA-Z0-9-]{{1,63}}(?:\.[a-zA-Z0-9-]{{1,63}})+\b', '[REDACTED_DOMAIN]', 'g')"""


@query(
    "f10_redact_text",
    f"SELECT 'document' AS kind, doc_id AS id, md5({_redact_sql('text')}) AS digest FROM documents "
    f"UNION ALL SELECT 'page', page_id, md5({_redact_sql('html')}) FROM pages "
    f"UNION ALL SELECT 'turn', conv_id * 1000 + turn, md5({_redact_sql('text')}) FROM conversations",
)
def f10(spark: SparkSession, sf: str) -> DataFrame:
    def part(kind: str, df: DataFrame) -> DataFrame:
        return redact_columns(df, ["text"]).select(F.lit(kind).alias("kind"), "id", F.md5("text").alias("digest"))

    d = table(spark, sf, "documents").selectExpr("doc_id AS id", "text")
    p = table(spark, sf, "pages").selectExpr("page_id AS id", "html AS text")
    t = table(spark, sf, "conversations").selectExpr("conv_id * 1000 + turn AS id", "text")
    return part("document", d).unionByName(part("page", p)).unionByName(part("turn", t))


OCTET = "(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)"


@query(
    "f11_redact_ip_cells",
    rf"SELECT doc_id, source, md5(regexp_replace(text, '\b(?:{OCTET}\.){{3}}{OCTET}\b', '[redacted-ip]', 'g')) AS digest FROM documents",
)
def f11(spark: SparkSession, sf: str) -> DataFrame:
    return redact_ip_cells(table(spark, sf, "documents").select("doc_id", "source", "text")).select("doc_id", "source", F.md5("text").alias("digest"))


@query("f15_helpers", "SELECT event_id, round(ln(1 + value), 6) AS log_value, round(least(greatest(value / 100.0, 0), 1), 6) AS clipped, upper(trim(event_type)) AS label, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, coalesce(nullif(CASE WHEN event_type = 'view' THEN '' ELSE event_type END, ''), 'none') AS first_text FROM events")
def f15(spark: SparkSession, sf: str) -> DataFrame:
    from netsieve.functions.guards import clip

    c = F.col
    blank = F.when(c("event_type") == "view", F.lit("")).otherwise(c("event_type"))
    return table(spark, sf, "events").select(
        "event_id", F.round(F.log1p("value"), 6).alias("log_value"), F.round(clip(c("value") / 100.0, 0, 1), 6).alias("clipped"),
        F.upper(F.trim("event_type")).alias("label"), F.get_json_object("props", "$.k").cast("bigint").alias("k"),
        F.coalesce(F.nullif(blank, F.lit("")), F.lit("none")).alias("first_text"),
    )


ODD_CLASSES = """CASE c_nationkey % 5 WHEN 0 THEN '7 ' || c_mktsegment WHEN 1 THEN repeat(c_mktsegment, 30) WHEN 2 THEN ' ' || c_mktsegment || ' / x '
  WHEN 3 THEN CASE WHEN c_nationkey = 3 THEN ' ' ELSE c_mktsegment || '-' || c_nationkey END ELSE c_mktsegment END"""


@query(
    "p23_class_columns",
    with_(
        f"classes AS (SELECT DISTINCT {ODD_CLASSES} AS class FROM customer)",
        "safe AS (SELECT class, regexp_replace(trim(class), '[^A-Za-z0-9_]+', '_', 'g') AS s FROM classes)",
        "named AS (SELECT class, 'p_' || substr(CASE WHEN s = '' THEN 'cls' WHEN regexp_matches(s, '^[0-9]') THEN 'c_' || s ELSE s END, 1, 120) AS base FROM safe)",
        "counted AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY class) - 1 AS again FROM named)",
        select="SELECT class, base || CASE WHEN again > 0 THEN '_' || again ELSE '' END AS column_name FROM counted",
    ),
)
def p23(spark: SparkSession, sf: str) -> DataFrame:
    """Names of probability columns for class names with leading digits, blanks, signs, and of many characters."""
    rows = table(spark, sf, "customer").select(F.expr(ODD_CLASSES).alias("class"))
    return sc.class_columns(rows, "class")
