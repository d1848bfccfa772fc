"""Connection logs in tab-separated form."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from netsieve.session import broadcast_if_small


def _is_data(value: Column) -> Column:
    return (F.length(value) > 0) & ~value.startswith("#")


def log_layouts(text: DataFrame) -> DataFrame:
    """(file, layout): per file the fields of its last ``#fields`` line, or of the folder's last file with such a line, or
    positions where there is none or it does not fit the file's first data line. One aggregate over the lines, whose order within a file is the place they were
    read from."""
    value = F.col("value")
    order = F.struct("_start", "_line")
    named = F.slice(F.split(F.max_by(F.when(value.startswith("#fields"), value), F.when(value.startswith("#fields"), order)), "\t", -1), 2, 1 << 20)
    width = F.min_by(F.when(_is_data(value), F.size(F.split(value, "\t", -1))), F.when(_is_data(value), order))
    per = text.groupBy("_file").agg(named.alias("named"), width.alias("width"))
    common = per.where(F.col("named").isNotNull()).agg(F.max(F.struct("_file", "named")).getField("named")).scalar()
    per = per.where(F.col("width").isNotNull()).withColumn("named", F.coalesce("named", common))
    positions = F.transform(F.sequence(F.lit(0), F.col("width") - 1), lambda i: i.cast("string"))
    return per.select("_file", F.when(F.size("named") == F.col("width"), F.col("named")).otherwise(positions).alias("layout"))


def parse_lines(lines: DataFrame, fields: Sequence[str], value: str = "value") -> DataFrame:
    """Split data lines into string columns. Comment and blank lines are skipped; short lines end in NULLs."""
    parts = F.split(F.col(value), "\t", -1)
    data = lines.where(_is_data(F.col(value)))
    return data.select(*[F.get(parts, F.lit(i)).alias(f) for i, f in enumerate(fields)])


def read_conn_log(spark: SparkSession, path: str) -> DataFrame:
    """A log, or a folder of logs, with ``#fields`` headers; all columns are strings.

    Each file's values are named by its own header, those of a file without one by the header of the folder's last file
    that has one; fields that a file lacks are NULL in its rows. Without any header, or
    when it does not fit the first data line, columns are named by position. A missing file is an empty table.
    """
    try:
        text = spark.read.text(path)
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], T.StructType([]))
        raise
    text = text.select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_line"))
    by_file = broadcast_if_small(log_layouts(text), "layouts")
    layouts = sorted(tuple(r["layout"]) for r in by_file.select("layout").distinct().collect())
    if len(layouts) <= 1:
        return parse_lines(text, layouts[0] if layouts else [])
    parts = F.split("value", "\t", -1)
    data = text.where(_is_data(F.col("value"))).join(by_file, "_file").withColumn("_parts", parts)
    fields = list(dict.fromkeys(f for layout in layouts for f in layout))
    at = {f: [(layout, layout.index(f)) for layout in layouts if f in layout] for f in fields}
    which = {layout: F.col("layout") == F.array(*[F.lit(f) for f in layout]) for layout in layouts}

    def value(f: str) -> Column:
        return F.coalesce(*[F.when(which[layout], F.get("_parts", F.lit(i))) for layout, i in at[f]])

    return data.select(*[value(f).alias(f) for f in fields])


def read_plain_log(spark: SparkSession, path: str) -> DataFrame:
    """A tab-separated log with a header row; lines starting with ``#`` are comments."""
    return spark.read.csv(path, sep="\t", comment="#", header=True, inferSchema=True)


def to_log_lines(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """The inverse of :func:`parse_lines`: one text line per row, ``-`` for missing values."""
    def cell(f: str) -> Column:
        return F.coalesce(F.col(f"`{f}`").cast("string"), F.lit("-"))

    return df.select(F.concat_ws("\t", *[cell(f) for f in fields]).alias("value"))
