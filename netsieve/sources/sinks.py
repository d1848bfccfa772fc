"""Result tables: alerts, scored events, audit rows, exports, artifact index, splits and manifests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, functions as F

from netsieve.functions.guards import col
from netsieve.functions.text import redact_columns
from netsieve.operators.policy import tenant_scope
from netsieve.operators.ranking import latest_per_key
from netsieve.operators.triage import alerts


# Every alert repeats its field names, so as plain text alerts take over ten times the scored rows. A gzip file is read
# by one task, so its rows are bounded.
ALERTS_A_FILE = 1_000_000


def emit_alerts(df: DataFrame, path: str, only_known: bool = False, batch_id: int | None = None) -> int:
    """Append alert rows as JSON lines, gzip files of at most ``ALERTS_A_FILE`` rows, and return how many there were.

    With a batch id (from ``foreachBatch``) the rows go to that batch's own folder, which a retry replaces: a
    repeated batch leaves the sink as it was.
    """
    seen = Observation()
    out = alerts(df, only_known).observe(seen, F.count(F.lit(1)).alias("n"))
    writer = out.write.options(compression="gzip", maxRecordsPerFile=ALERTS_A_FILE)
    if batch_id is None:
        writer.mode("append").json(path)
    else:
        writer.mode("overwrite").json(f"{path}/batch={batch_id}")
    return seen.get.get("n", 0)


def scored_events(df: DataFrame, tenant_id: int | None, created_at: int) -> DataFrame:
    """Rows for the scored-events table, the full record kept as JSON. A ``score`` column is required."""
    if "score" not in df.columns:
        raise ValueError("results need a 'score' column")

    def text(name: str) -> Column:
        return col(name).cast("string") if name in df.columns else F.lit(None).cast("string")

    return df.select(
        F.lit(tenant_id).cast("bigint").alias("tenant_id"),
        text("id").alias("row_id"),
        text("timestamp").alias("timestamp"),
        col("score").cast("double").alias("score"),
        text("label").alias("label"),
        text("model_version").alias("model_version"),
        F.to_json(F.struct(*[col(c) for c in df.columns]), {"ignoreNullFields": "false"}).alias("raw_json"),
        F.lit(created_at).cast("bigint").alias("created_at"),
    )


def append_scored_events(df: DataFrame, path: str, tenant_id: int | None, created_at: int) -> None:
    scored_events(df, tenant_id, created_at).write.mode("append").parquet(path)


# Columns and order of the alert and audit exports.
ALERT_EXPORT = ["id", "tenant_id", "severity", "title", "decision_label", "status", "suppressed", "created_at"]
AUDIT_EXPORT = ["id", "actor", "action", "payload_json", "created_at", "tenant_id"]
AUDIT_LIMIT = 5000
DETAIL_LIMIT = 64_000
DETAIL_PREVIEW = 63_920


def alert_export(df: DataFrame, role: str, tenant_id: int | None) -> DataFrame:
    seen = df.where(tenant_scope(role, tenant_id, F.col("tenant_id")))
    return seen.select(*ALERT_EXPORT).orderBy(F.col("id").desc())


def audit_export(df: DataFrame, role: str, tenant_id: int | None, limit: int = AUDIT_LIMIT) -> DataFrame:
    """The newest ``limit`` audit rows a user may see."""
    seen = df.where(tenant_scope(role, tenant_id, F.col("tenant_id")))
    return seen.select(*AUDIT_EXPORT).orderBy(F.col("id").desc()).limit(limit)


def bounded_detail(json: Column, limit: int = DETAIL_LIMIT, preview: int = DETAIL_PREVIEW) -> Column:
    """JSON text as it is, or beyond ``limit`` characters an object with its first part."""
    cut = F.to_json(F.struct(F.lit(True).alias("_truncated"), F.substring(json, 1, preview).alias("preview")))
    return F.when(F.length(json) > limit, cut).otherwise(json)


def history_rows(
    runs: DataFrame, detail: str, kind: str, row_count: str, actor: str, created_at: Column, tenant: Column | None = None,
    limit: int = DETAIL_LIMIT, preview: int = DETAIL_PREVIEW,
) -> DataFrame:
    """One history row per job or micro-batch, the detail JSON bounded in length."""
    return runs.select(
        (tenant if tenant is not None else F.lit(None)).cast("bigint").alias("tenant_id"),
        F.lit(kind).alias("kind"), created_at.cast("bigint").alias("created_at"),
        col(row_count).cast("bigint").alias("row_count"),
        bounded_detail(col(detail), limit, preview).alias("detail_json"), F.lit(actor).alias("actor_username"),
    )


def audit_rows(events: DataFrame, event_type: str, payload: Sequence[str], ts: Column) -> DataFrame:
    """Audit rows with the payload columns redacted, nested values included."""
    clean = redact_columns(events, payload)
    return clean.select(
        ts.cast("bigint").alias("ts"), F.lit(event_type).alias("event_type"),
        F.to_json(F.struct(*[col(c) for c in payload])).alias("payload"),
    )


def upsert_latest(current: DataFrame, changes: DataFrame, key: str = "job_id", version: str = "updated_at") -> DataFrame:
    """Current rows with the changes applied, the newest row of each key winning."""
    merged = current.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    order = [c for c in (version, "_new") if c in merged.columns]
    return latest_per_key(merged, [key], order).drop("_new")


def write_splits(df: DataFrame, out: str, split: str = "split") -> None:
    """Write train, val and test in one pass, one folder per split."""
    df.write.mode("overwrite").partitionBy(split).parquet(out)


def manifest(df: DataFrame, slug: str, raw_dir: str, label: str, seed: int) -> DataFrame:
    """One row describing a prepared table."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        F.lit(slug).alias("dataset_slug"), F.lit(raw_dir).alias("raw_dir"), "n_rows",
        F.array(*[F.lit(c) for c in df.columns]).alias("columns"),
        F.lit(seed).alias("split_seed"), F.lit(label).alias("label_column"),
    )


def write_manifest(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
