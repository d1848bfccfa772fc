"""Scoring streams: one-shot and timed passes, sinks, progress, session summaries; the batch job they share."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Mapping, Sequence
from dataclasses import replace

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession, Window as W, functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from netsieve.functions.guards import col, nan_to_null
from netsieve.models.novelty import Detector, NoveltyOptions, score_and_fuse
from netsieve.operators.mapping import prepare_input
from netsieve.operators.policy import enrich
from netsieve.operators.prototypes import nearest_distance
from netsieve.operators.triage import FUSION_DEFAULTS, add_risk, decision_counts, fuse_decisions, summarize_risk
from netsieve.session import run_dir
from netsieve.sources.sinks import emit_alerts


def table_stream(spark: SparkSession, folder: str, file_glob: str, schema) -> DataFrame:
    """Stream over the Parquet files of a folder whose names match."""
    return spark.readStream.schema(schema).option("pathGlobFilter", file_glob).parquet(folder)


def triage(df: DataFrame, d: Detector, keep: Sequence[str], thresholds: Mapping[str, float] | None = None, options: NoveltyOptions = NoveltyOptions()) -> DataFrame:
    """Raw rows (contract or connection log) to decisions; works on batch and streaming tables."""
    return score_and_fuse(prepare_input(df, d.binary.feature_columns, keep), d, thresholds, options)


def _check_streamable(d: Detector, options: NoveltyOptions) -> None:
    if options.reference_max is None:
        raise ValueError("a stream needs a reference maximum for the suspected-zero-day scale")
    if options.tier_strong_label is not None and options.tier_cut is None:
        raise ValueError("a stream needs a stored tier cut")
    if d.prototypes is not None and d.open_set_range is None:
        raise ValueError("a stream needs a stored open-set distance range")


def start_scoring(
    source: DataFrame, d: Detector, keep: Sequence[str], output: str, checkpoint: str,
    thresholds: Mapping[str, float] | None = None, options: NoveltyOptions = NoveltyOptions(), alerts: str | None = None,
    only_known: bool = False, poll_seconds: float | None = None, name: str | None = None,
) -> StreamingQuery:
    """Start a scoring query that appends decisions to ``output``, and alerts as JSON lines if a folder is named.

    Every batch writes into folders named by its id, which a repeated batch replaces, so the result is the same however
    often it runs, and notes its rows and end offset beside the checkpoint. ``poll_seconds`` keeps the query running;
    None processes what is there and ends.
    """
    _check_streamable(d, options)
    scored = triage(source, d, keep, thresholds, options)
    writer = scored.writeStream.option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if poll_seconds is None else writer.trigger(processingTime=f"{max(0.5, poll_seconds)} seconds")
    if name:
        writer = writer.queryName(name)

    def write(batch: DataFrame, batch_id: int) -> None:
        seen = Observation()
        place = f"{output}/batch={batch_id}"
        batch.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").option("compression", "zstd").parquet(place)
        if alerts is not None:
            emit_alerts(batch.sparkSession.read.schema(batch.schema).parquet(place), alerts, only_known, batch_id)
        _note_batch(batch.sparkSession, checkpoint, batch_id, seen.get.get("n", 0))

    return writer.foreachBatch(write).start()


def _note_batch(spark: SparkSession, checkpoint: str, batch_id: int, rows: int) -> None:
    """One row per batch, replaced when the batch is repeated. The source's end offset is the last line of the batch's
    entry in the checkpoint, which keeps only the newest entries."""
    lines = [r["value"] for r in spark.read.text(f"{checkpoint}/offsets/{batch_id}").collect()]
    noted = spark.createDataFrame([(int(rows), lines[-1] if lines else None)], "rows bigint, end_offset string")
    noted.coalesce(1).write.mode("overwrite").parquet(f"{checkpoint}-batches/batch_id={batch_id}")


def noted_batches(spark: SparkSession, checkpoint: str) -> DataFrame:
    """Rows and end offset of every batch of a query, however many there were."""
    schema = "rows bigint, end_offset string, batch_id bigint"
    try:
        return spark.read.schema(schema).parquet(f"{checkpoint}-batches")
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], schema)
        raise


def rows_scored(spark: SparkSession, checkpoint: str) -> int:
    return noted_batches(spark, checkpoint).agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]


def run_once(query: StreamingQuery, checkpoint: str) -> int:
    """Wait for a one-shot pass, which fails if the query fails; returns the rows scored so far."""
    query.awaitTermination()
    return rows_scored(SparkSession.active(), checkpoint)


def run_for(start: Callable[[float | None], StreamingQuery], seconds: float, checkpoint: str, poll_seconds: float = 0.5, grace_seconds: float = 30.0) -> int:
    """Poll for a while, then finish what has arrived; returns the rows scored so far.

    ``start(poll_seconds)`` starts the query on its checkpoint. After the time the polling query is stopped between two
    batches, or after ``grace_seconds`` more inside one where batches follow each other without a gap; a one-shot pass
    reads the rest, a batch that the stop has cut short included. A failed query raises.
    """
    query = start(poll_seconds)
    query.awaitTermination(max(1, int(seconds)))
    last = time.monotonic() + grace_seconds
    while query.isActive and query.status["isTriggerActive"] and time.monotonic() < last:
        time.sleep(0.1)
    query.stop()
    if query.exception() is not None:
        raise query.exception()
    return run_once(start(None), checkpoint)


def progress_rows(spark: SparkSession, checkpoint: str) -> DataFrame:
    """All batches of a query as a table: batch id, rows so far, end offset of its source. One short row per batch."""
    so_far = F.sum("rows").over(W.orderBy("batch_id"))
    return noted_batches(spark, checkpoint).select("batch_id", so_far.alias("rows_scored"), "end_offset")


def stored_reference(df: DataFrame, d: Detector) -> tuple[NoveltyOptions, Detector]:
    """Options and detector for a stream, with the anomaly maximum and the distance range of a reference table, so
    that a row's scores do not depend on where micro-batches end."""
    aggs = [F.max(nan_to_null(d.anomaly_score)).alias("top")]
    if d.prototypes is not None:
        distance = nan_to_null(nearest_distance(d.families.scaler.expressions(), d.prototypes))
        aggs += [F.min(distance).alias("lo"), F.max(distance).alias("hi")]
    row = df.agg(*aggs).first()
    fixed = replace(d, open_set_range=(row["lo"], row["hi"])) if d.prototypes is not None else d
    return NoveltyOptions(reference_max=row["top"]), fixed


def load_thresholds(spark: SparkSession, path: str) -> dict[str, float]:
    """Fusion thresholds from a JSON object; fields it lacks keep their defaults."""
    schema = ", ".join(f"{k} double" for k in FUSION_DEFAULTS)
    row = spark.read.schema(schema).option("multiLine", "true").json(path).first()
    return {k: v if row is None or row[k] is None else row[k] for k, v in FUSION_DEFAULTS.items()}


def read_output(spark: SparkSession, output: str, schema=None) -> DataFrame:
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(output)


def session_summary(scored: DataFrame) -> DataFrame:
    """Summary row of everything a session wrote."""
    return summarize_risk(scored)


def windowed_counts(events: DataFrame, ts: str, duration: str, watermark: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Decision counts per event-time window (and group), with risk columns. On a stream the watermark bounds the
    state: a window is final, and its state dropped, once the watermark has passed it."""
    if watermark:
        # Watermarks are defined on instants, so zone-less times are read in the session time zone.
        events = events.withColumn(ts, col(ts).cast("timestamp")).withWatermark(ts, watermark)
    keyed = events.withColumn("_win", F.window(col(ts), duration))
    counts = decision_counts(keyed, ["_win", *by])
    return add_risk(counts).select(F.col("_win.start").alias("window_start"), F.col("_win.end").alias("window_end"), *[c for c in counts.columns if c != "_win"], "risk_level", "attack_indicators", "danger_verdict")


def collect_stream(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is available and read its result back from the shared folder."""
    spark = stream.sparkSession
    base = run_dir(spark, name)
    q = (
        stream.writeStream.format("parquet").outputMode(mode).option("path", f"{base}/out")
        .option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    )
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def triage_enriched(
    df: DataFrame, d: Detector, keep: Sequence[str], suppressions: DataFrame, rules: Sequence[Mapping], tenant: str | None,
    now_ts: int, thresholds: Mapping[str, float] | None = None, options: NoveltyOptions = NoveltyOptions(),
) -> DataFrame:
    """Triage plus suppression flag and rule hits. Rows that already carry a binary prediction are only fused."""
    if "binary_prediction" in df.columns:
        out = fuse_decisions(df, **dict(thresholds or {}))
    else:
        out = triage(df, d, keep, thresholds, options)
    return enrich(out, suppressions, rules, tenant, now_ts)


class ProgressLog(StreamingQueryListener):
    """Hands every batch's progress to ``emit`` as a small row: batch id, rows so far, end offset, time."""

    def __init__(self, emit: Callable[[dict], None]):
        self.emit = emit
        self.rows: dict[str, int] = {}

    def onQueryStarted(self, event) -> None:
        self.rows[str(event.id)] = 0

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.rows[str(p.id)] = self.rows.get(str(p.id), 0) + p.numInputRows
        self.emit(
            {
                "query_id": str(p.id), "batch_id": p.batchId, "rows_scored": self.rows[str(p.id)],
                "end_offset": json.dumps([s.endOffset for s in p.sources]), "updated_at": p.timestamp,
            }
        )

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
