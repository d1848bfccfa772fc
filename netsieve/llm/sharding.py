"""Sharding by a hierarchical weighted hash tree: regions hold racks, racks hold shards.

A row descends level by level. At each node every child draws: a hash of the row's key and the child's name gives u
between 0 and 1, the draw is -ln(u) / weight, and the smallest draw wins (the earlier child on a tie). A child wins in
proportion to its weight, and a weight above the shards is the sum of those below. A draw depends on nothing but key,
name and weight. So when a shard's weight grows, a row changes its region only into that shard's region, inside it its
rack only into that shard's rack, and inside that its shard only into that shard; when one shrinks, only out of them.
``grown`` gives one more shard a region of its own, so that all rows it takes come to the new shard and no other moves.

The key is the row's id as text (null: the empty text) and nothing else: repeated ids share a shard, and a hot id makes
its shard larger, as the law wants. All work is column expressions. Slots count the rows of a shard from 0, ordered by id
(nulls first), size and checksum; rows alike in all that are interchangeable. They come from one range-partitioned sort
of the short columns, cut by position as well, so that neither a shard nor a repeated row has to fit in a task. Null
texts count as empty, an empty table gives no rows, other columns do not matter.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from netsieve.session import broadcast_if_small, materialize

DIGITS = 13  # hexadecimal digits of a hash that make a draw: 52 bits
RANGE = 2_000_000  # rows of a sorted partition


@dataclass(frozen=True)
class Shard:
    region: str
    rack: str
    number: int
    weight: float = 1.0


def grid(regions: int, racks: int, shards: int) -> list[Shard]:
    """A full tree of equal shards, numbered from 0."""
    places = [(r, k) for r in range(regions) for k in range(racks) for _ in range(shards)]
    return [Shard(f"region {r}", f"rack {r}.{k}", i) for i, (r, k) in enumerate(places)]


def grown(tree: list[Shard], weight: float = 1.0) -> list[Shard]:
    """``tree`` and one more shard, in a region of its own."""
    new = max((s.number for s in tree), default=-1) + 1
    return [*tree, Shard(f"region of shard {new}", f"rack of shard {new}", new, weight)]


def _levels(tree: list[Shard]) -> list[list[list[tuple[str, float, int]]]]:
    """For each level, the children of every node of the level above: name, weight, and place in the level below
    (on the last level, the shard's number). Shards without weight are left out."""
    live = [s for s in tree if s.weight > 0]
    if not live:
        raise ValueError("a tree needs a shard with a weight above zero")
    regions = list(dict.fromkeys(s.region for s in live))
    racks = list(dict.fromkeys((s.region, s.rack) for s in live))
    top = [(r, sum(s.weight for s in live if s.region == r), i) for i, r in enumerate(regions)]
    middle = [[(f"{r}/{k}", sum(s.weight for s in live if (s.region, s.rack) == (r, k)), i) for i, (r2, k) in enumerate(racks) if r2 == r] for r in regions]
    bottom = [[(f"{r}/{k}/shard {s.number}", s.weight, s.number) for s in live if (s.region, s.rack) == (r, k)] for r, k in racks]
    return [[top], middle, bottom]


def _literal(nodes: list[list[tuple[str, float, int]]]) -> Column:
    return F.array(*[F.array(*[F.struct(F.lit(n).alias("name"), F.lit(float(w)).alias("weight"), F.lit(i).alias("at")) for n, w, i in own]) for own in nodes])


def shard_of(key: Column, tree: list[Shard]) -> Column:
    """The number of the shard that ``key`` descends to."""
    text = F.coalesce(key.cast("string"), F.lit(""))

    def draw(child: Column) -> Column:
        bits = F.conv(F.substring(F.md5(F.concat(text, F.lit("@"), child["name"])), 1, DIGITS), 16, 10).cast("double")
        return F.struct((-F.log((bits + 0.5) / F.lit(float(16**DIGITS))) / child["weight"]).alias("draw"), child["at"].alias("at"))

    at = F.lit(0)
    for nodes in _levels(tree):
        at = F.array_min(F.transform(F.element_at(_literal(nodes), at + 1), draw))["at"]
    return at.cast("int")


def shard_rows(docs: DataFrame, tree: list[Shard], more: list[Shard] | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``size`` (bytes and one), ``text_crc32``, ``law``, ``shard``, ``slot`` and ``grown_shard`` (in the tree ``more``)."""
    whole = F.coalesce(F.col(text), F.lit(""))
    short = docs.select(
        F.col(key).alias("id"),
        (F.octet_length(whole) + F.lit(1).cast("long")).alias("size"),
        F.crc32(whole).alias("text_crc32"),
        shard_of(F.col(key), tree).alias("shard"),
        (shard_of(F.col(key), more) if more else F.lit(None).cast("int")).alias("grown_shard"),
        F.monotonically_increasing_id().alias("place"),
    )
    rows = number_slots(materialize(short, "shards"), "shard", ["id", "size", "text_crc32"])
    return rows.select(F.col("id").alias(key), "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def number_slots(rows: DataFrame, group: str, order: list[str], place: str = "place") -> DataFrame:
    """``rows``, a written table with a unique column ``place``, with ``slot``: their number in ``group`` from 0, by ``order``."""
    by = [group, *order, place]
    ranges = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // RANGE))
    ordered = rows.repartitionByRange(ranges, *by).sortWithinPartitions(*by)
    ordered = materialize(ordered.withColumn("_task", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()), "ordered")
    runs = ordered.groupBy("_task", group).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    # One run for each range and group at most. Those of a group lie in consecutive ranges: sums over ranges, not rows.
    before = F.sum("_n").over(Window.partitionBy(group).orderBy("_task").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_n")
    runs = broadcast_if_small(runs.withColumn("_before", before).select("_task", group, "_first", "_before"), "runs")
    return ordered.join(runs, ["_task", group]).withColumn("slot", F.col("_at") - F.col("_first") + F.col("_before")).drop("_task", "_at", "_first", "_before", place)


def write_shards(docs: DataFrame, tree: list[Shard], path: str, key: str = "doc_id") -> None:
    """Whole rows as Parquet, a folder ``_shard=N`` for each shard, of as many files as there are input tasks."""
    docs.withColumn("_shard", shard_of(F.col(key), tree)).write.partitionBy("_shard").parquet(path)


def _sql(tree: list[Shard], name: str) -> str:
    """The descent in SQL: a table of children, and one step for each level."""
    levels = _levels(tree)
    values = ", ".join(f"({lv}, {up}, '{n}', {w!r}, {at})" for lv, nodes in enumerate(levels) for up, own in enumerate(nodes) for n, w, at in own)
    steps = "".join(
        f""", {name}{lv + 1} AS (
  SELECT id, arg_min(place, (draw, place)) AS place FROM (
    SELECT k.id, c.place, -ln((CAST(('0x' || substr(md5(coalesce(CAST(k.id AS VARCHAR), '') || '@' || c.child), 1, {DIGITS})) AS BIGINT) + 0.5) / {float(16**DIGITS)!r}) / c.weight AS draw
    FROM {name}{lv} k JOIN {name}_children c ON c.level = {lv} AND c.up = k.place)
  GROUP BY id
)"""
        for lv in range(len(levels))
    )
    return f"{name}_children(level, up, child, weight, place) AS (VALUES {values}), {name}0 AS (SELECT DISTINCT doc_id AS id, 0 AS place FROM documents){steps}"


TREE = grid(2, 2, 2)
ORACLE_SQL = f"""
WITH RECURSIVE steps(byte, k, v) AS (
  SELECT CAST(i AS BIGINT), 0, CAST(i AS BIGINT) FROM range(256) s(i)
  UNION ALL SELECT byte, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM steps WHERE k < 8
), crc AS MATERIALIZED (SELECT list(v ORDER BY byte) AS t FROM steps WHERE k = 8
), bytes AS (
  SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda s: CAST('0x' || s AS BIGINT)) AS data FROM documents
), rows AS (
  SELECT doc_id, size, xor(list_reduce(data, lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1]), 4294967295), 4294967295) AS text_crc32 FROM bytes, crc
), {_sql(TREE, 'now')}, {_sql(grown(TREE), 'more')}
SELECT doc_id, size, text_crc32, 'key' AS law, CAST(n.place AS INT) AS shard, CAST(m.place AS INT) AS grown_shard,
  row_number() OVER (PARTITION BY n.place ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1 AS slot
FROM rows JOIN now3 n ON n.id IS NOT DISTINCT FROM doc_id JOIN more3 m ON m.id IS NOT DISTINCT FROM doc_id"""


def document_rows(docs: DataFrame) -> DataFrame:
    """:func:`shard_rows` for eight shards, and for nine as ``grown_shard``."""
    return shard_rows(docs, TREE, grown(TREE))
