"""Session set-up and the shared folder used for written intermediates."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F


def build_session(app: str = "netsieve", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with the settings the engine relies on.

    On a cluster leave ``master`` and ``shuffle_partitions`` unset: they come from spark-submit and
    AQE coalesces the shuffle partitions it does not need.
    """
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        b = b.master(master).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = b.getOrCreate()
    tune(spark)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it in ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own; a cluster without it is an error,
    because a machine-local folder is lost with its executor.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        base = tempfile.mkdtemp(prefix="netsieve-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base


# Beyond 8000 bytes of bytecode HotSpot leaves a method interpreted. Below that limit Spark keeps whole-stage code;
# above it, wide contracts run as one compiled projection per operator, which is several times faster.
METHOD_LIMIT = ("spark.sql.codegen.hugeMethodLimit", "8000")


def tune(spark: SparkSession) -> None:
    """Runtime settings the engine's plans want; a value the user has set stays."""
    key, value = METHOD_LIMIT
    if spark.conf.get(key) == "65535":
        spark.conf.set(key, value)


# A batch of texts stands in a Python worker as Arrow, as pandas and as results, and in the JVM beside it, whose allocators
# keep what they once had. Bytes bound it whatever a row holds, and narrow rows still go 10,000 at a time.
BATCH_BYTES = ("spark.sql.execution.arrow.maxBytesPerBatch", str(2 << 20))


def bound_batches(spark: SparkSession) -> None:
    """Small batches for Python workers, by bytes, in what the session plans from now on; a value the user has set stays."""
    key, value = BATCH_BYTES
    if spark.conf.get(key) in ("67108864", "67108864b"):
        spark.conf.set(key, value)


def spread(df: DataFrame, rows: int, limit: int = 20_000_000) -> DataFrame:
    """A table of known, moderate size over all cores, when it was read in fewer partitions than there are cores.

    For cached inputs of iterative fits. Tables beyond ``limit`` rows keep the partitions they have.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if rows <= limit and df.rdd.getNumPartitions() < cores else df


def run_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder of one run below :func:`shared_dir`."""
    return f"{shared_dir(spark)}/netsieve/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` to the shared folder and read it back, cutting lineage in a way that survives executor loss."""
    path = run_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, name: str, rows: int = 1_000_000) -> DataFrame:
    """``df`` written once and read back, with a broadcast hint if it turns out to have at most ``rows`` rows. Beyond
    that a join shuffles plain tables, whose hot keys adaptive execution can split."""
    done = materialize(df, name)
    return F.broadcast(done) if done.count() <= rows else done


def broadcast_smaller(left: DataFrame, right: DataFrame, rows: int = 1_000_000) -> tuple[DataFrame, DataFrame]:
    """Both sides of a join, with a broadcast hint on one only if counting shows that it has at most ``rows`` rows."""
    if right.limit(rows + 1).count() <= rows:
        return left, F.broadcast(right)
    if left.limit(rows + 1).count() <= rows:
        return F.broadcast(left), right
    return left, right


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of :func:`run_dir` that no table in use reads any more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
