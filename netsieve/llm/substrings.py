"""Substring dedup: paragraph MinHash banding, verified by exact Jaccard, removals clustered by components.

Units. A paragraph is a line of at least ``LEAST`` words, or shorter lines in a row up to a blank or a long one, if they
have as many. Pieces of such blocks, cut behind lines that their last word chooses, are units among themselves and never
compared with blocks, which they are part of. The 5-word shingles of a unit give ``BANDS`` keys of ``ROWS`` minima
each, tuned so that 99.8 % of the pairs at similarity 0.8 meet in one. Passages that repeat inside different paragraphs
are found as stretches: among every ``SPREAD`` places in a row the one with the smallest hash begins a stretch of
``LEAST`` words, whose hash is its only band. A passage of ``LEAST + SPREAD - 1`` (50) words or more therefore shares
one with each of its copies, wherever it stands.

Steps. All units are written once. Equal units are counted map-side first, and all but the first of each are removals.
Every place of a stretch that more than one place has is read again with ``SPREAD`` words before it and as many behind,
as its two sides. Equal sides are one row. These rows are sorted, so that the places which share most words with one
stand next to it, and for each the longest run of words is found that any earlier place has as well. Ranges of the
sorted table are tasks, however many places a stretch has; what spans ranges is settled by a few numbers of each. So
each word of a passage of ``LEAST + SPREAD - 1`` words that an earlier place has is removed, whoever else quotes a part
of it. Words of sides are compared by 32 bits: one wrong word beside a stretch in 4 billion stretches may be taken for
equal and removed with it.
Different paragraphs that share a band are verified by exact Jaccard similarity, all pairs of them: a band with many
is cut into parts, and each pair of parts is a group of its own, whose shared shingles are counted by one matrix
product. A group gives back a spanning forest of the pairs it verified, never the pairs. Paragraphs that match form
connected components; each keeps its first member, all other members are removals. A removal always names an earlier
place.

Null texts count as empty; rows without an id take no part; rows of one id should be one document (of several, units
of all count, at the same word positions; rows with equal id and text are equal places, none of which is removed). Ties
are settled by (id, place). Other columns do not matter, whatever they are called; an empty table gives no rows. Lines
of 5 to 19 words that belong to no larger unit are never removed alone, only within a passage. Words are what white
space separates; equality is that of 64-bit hashes (xxh3), and a unit goes as a whole: the end of a near paragraph may
be words that do not repeat.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from netsieve.llm.components import connected_components, join_labels
from netsieve.llm.textops import U64, binaries, chunks, code_points, mix, ragged, tidy, windows, word_hashes, words
from netsieve.session import broadcast_if_small, drop_folder, materialize, run_dir

SHINGLE, SIMILAR = 5, 0.8
LEAST, SPREAD = 20, 31  # words of a unit; places among which one begins a stretch
BANDS, ROWS = 6, 2
BLOCK = 1 << 19
PART, COLUMNS, LINES = 1024, 512, 128  # paragraphs of a band in one group's part; shared shingles counted, and rows of counts judged, at once
PLACES = 1_000_000  # at most so many are broadcast
KEYS = 1_000_000  # hashes of stretches sent to the tasks
SENT = 200_000  # sides sent to the tasks
RANGE = 50_000  # sides of a sorted range
FEW = 24  # paragraphs of a group that are compared pair by pair
PARAGRAPH, STRETCH, BAND = 0, 1, 2
NOWHERE = np.iinfo(np.uint64).max
_PIECE = U64(0xA24BAED4963EE407)
_SEEDS = mix(np.arange(1, BANDS * ROWS + 1).astype(U64) * U64(0xD1B54A32D192ED03))


class Words:
    """The words of some texts: hashes, and the text and line each stands in."""

    def __init__(self, texts: list[str]):
        whole = "\n".join(texts)
        codes = code_points(whole)
        self.lo, self.hi = words(codes)
        self.hash = word_hashes(whole)
        end = np.cumsum([len(t) + 1 for t in texts])
        self.doc = np.searchsorted(end, self.lo, side="right")
        self.line = np.searchsorted(np.flatnonzero(codes == 10), self.lo)
        self.first = np.searchsorted(self.doc, np.arange(len(texts) + 1))  # of each text
        self.offset = end - np.array([len(t) + 1 for t in texts])

    @cached_property
    def shingles(self) -> np.ndarray:
        return windows(self.hash, SHINGLE)


def _word_blocks(texts: pa.Array) -> Iterator[tuple[int, int, Words]]:
    """The words of texts ``lo`` to ``hi`` of a batch, block by block, so that few texts stand as strings at once."""
    for lo, hi in chunks(pc.utf8_length(texts).to_pylist(), BLOCK):
        yield lo, hi, Words(texts.slice(lo, hi - lo).to_pylist())


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and length of runs of equal values."""
    at = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1]))) if len(x) else np.zeros(0, np.int64)
    return at, np.diff(np.append(at, len(x)))


def _fold(h: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A hash of each range of word hashes, by its length and content."""
    order = np.argsort(-size, kind="stable")  # so that those with more words stand first
    begin, size = begin[order], size[order]
    folded = mix(size.astype(U64))
    for i in range(int(size[0]) if len(size) else 0):
        more = len(size) if size[-1] > i else int(np.searchsorted(-size, -i))
        folded[:more] = mix(folded[:more] * U64(0x100000001B3) + h[begin[:more] + i])
    out = np.empty_like(folded)
    out[order] = folded
    return out


def _smallest(v: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each ``width`` values in a row."""
    out, have = v, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def _pieces(size: np.ndarray, stop: np.ndarray) -> list[int]:
    """First lines of the pieces of a block: each has ``LEAST`` words and ends where a line says ``stop``, or the block."""
    out, have, left = [0], 0, int(size.sum())
    for i, (n, s) in enumerate(zip(size.tolist(), stop.tolist(), strict=True)):
        have, left = have + n, left - n
        if s and have >= LEAST and left >= LEAST:
            out.append(i + 1)
            have = 0
    return out


def blocks(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and number of words of long lines and blocks of short ones, and of the pieces of blocks; whether a piece."""
    begin, size = _runs(w.line)
    if not len(begin):
        return begin, size, np.zeros(0, bool)
    long, line, doc = size >= LEAST, w.line[begin], w.doc[begin]
    apart = long[1:] | long[:-1] | (line[1:] - line[:-1] > 1) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(np.concatenate(([True], apart)))
    whole = np.add.reduceat(size, first)
    stop = mix(w.hash[begin + size - 1]) & U64(1) == 1
    at: list[int] = []
    n: list[int] = []
    for i in np.flatnonzero((whole >= 2 * LEAST) & ~long[first]):
        lo, hi = first[i], first[i + 1] if i + 1 < len(first) else len(begin)
        own = _pieces(size[lo:hi], stop[lo:hi])
        if len(own) > 1:
            at += begin[lo:hi][own].tolist()
            n += np.add.reduceat(size[lo:hi], own).tolist()
    some = whole >= LEAST
    both = np.concatenate([begin[first][some], np.array(at, np.int64)]), np.concatenate([whole[some], np.array(n, np.int64)])
    return *both, np.arange(len(both[0])) >= some.sum()


def paragraphs(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Begin, number of words, hash and band keys of every unit of lines."""
    begin, size, piece = blocks(w)
    if not len(begin):
        return begin, size, np.zeros(0, U64), np.zeros((0, BANDS), U64)
    shingle = np.append(w.shingles, U64(0))  # the last only ends ranges
    edges = np.column_stack([begin, begin + size - SHINGLE + 1]).ravel()
    least = np.stack([np.minimum.reduceat(mix(shingle ^ seed), edges)[0::2] for seed in _SEEDS])
    bands = np.stack([mix(sum((least[b * ROWS + r] * U64(2 * r + 1) for r in range(1, ROWS)), least[b * ROWS]) + U64(b + 1)) for b in range(BANDS)], axis=1)
    whole = np.empty(len(begin), U64)
    short = size <= 256
    whole[short] = _fold(w.hash, begin[short], size[short])
    for i in np.flatnonzero(~short):
        h = w.hash[begin[i] : begin[i] + size[i]]
        whole[i] = mix(np.array([(mix(h + np.arange(len(h), dtype=U64) * U64(0x9E3779B97F4A7C15))).sum() + U64(len(h))]))[0]
    whole[piece], bands[piece] = mix(whole[piece] ^ _PIECE), mix(bands[piece] ^ _PIECE)
    return begin, size, whole, bands


def stretches(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Begin and hash of the chosen stretches."""
    places = len(w.hash) - LEAST + 1
    if places <= 0:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    inside = w.doc[:places] == w.doc[LEAST - 1 :]
    value = w.shingles[:places] & U64(NOWHERE << 28 & NOWHERE) | np.arange(places, dtype=U64)  # ties: the first
    value[~inside] = NOWHERE
    chosen = []
    if places >= SPREAD:
        full = inside[SPREAD - 1 :] & (w.doc[: places - SPREAD + 1] == w.doc[SPREAD - 1 : places])
        chosen.append(_smallest(value, SPREAD)[full])
    size = np.bincount(w.doc[:places][inside], minlength=len(w.first) - 1)
    few = np.flatnonzero((size > 0) & (size < SPREAD))
    if len(few):
        edges = np.column_stack([w.first[few], w.first[few] + size[few]]).ravel()
        edges = edges if edges[-1] < places else edges[:-1]
        chosen.append(np.minimum.reduceat(value, edges)[0::2])
    at = np.unique((np.concatenate(chosen) & U64((1 << 28) - 1)).astype(np.int64)) if chosen else np.zeros(0, np.int64)
    return at, _fold(w.hash, at, np.full(len(at), LEAST))


def units(docs: DataFrame, text: str, key: str) -> DataFrame:
    """``kind``, ``key``, ``whole`` (bands only), ``doc``, ``place`` (first word) and ``n`` (words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("doc").to_numpy()
            for lo, hi, w in _word_blocks(b.column("_text")):
                if not len(w.lo):
                    continue
                begin, size, whole, bands = paragraphs(w)
                at, h = stretches(w)
                for kind, k, full, p, n in (
                    (PARAGRAPH, whole, None, begin, size),
                    (STRETCH, h, None, at, np.full(len(at), LEAST)),
                    (BAND, bands.ravel(), np.repeat(whole, BANDS).view(np.int64), None, None),
                ):
                    if not len(k):
                        continue
                    stands = [None] * 3 if p is None else [ids[lo:hi][w.doc[p]], p - w.first[w.doc[p]], n]
                    own = [np.full(len(k), kind, np.int32), k.view(np.int64), full, *stands]
                    own = [pa.nulls(len(k), pa.int64()) if x is None else pa.array(x) for x in own]
                    yield pa.RecordBatch.from_arrays(own, names=["kind", "key", "whole", "doc", "place", "n"])

    src = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("doc"), F.coalesce(text, F.lit("")).alias("_text"))
    return src.mapInArrow(tidy(run), "kind int, key long, whole long, doc long, place long, n long")


def fetch(docs: DataFrame, wanted: DataFrame, text: str, key: str, read: Callable, schema: str) -> DataFrame:
    """Rows that ``read`` makes of the places ``wanted`` (doc, place, n, tag): it gets words, and for each place the
    number of its first word, n, tag, and the document's id. Of documents that share an id, each gives what it has there.

    The places are gathered by document and meet the texts in a join. Up to ``PLACES`` of them, 24 bytes each, are sent
    round; beyond that both sides are shuffled."""
    by_doc = materialize(wanted.groupBy("doc").agg(F.collect_list(F.struct("place", "n", "tag")).alias("places")), "places")
    texts = docs.select(F.col(key).cast("long").alias("doc"), F.coalesce(text, F.lit("")).alias("_text"))
    if (by_doc.agg(F.sum(F.size("places"))).first()[0] or 0) <= PLACES:
        by_doc = F.broadcast(by_doc)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, lists = b.column("doc").to_numpy(), b.column("places")
            own = np.repeat(np.arange(len(ids)), np.diff(lists.offsets.to_numpy()))
            place, n, tag = (x.to_numpy() for x in lists.flatten().flatten())
            for lo, hi, w in _word_blocks(b.column("_text")):
                some = slice(*np.searchsorted(own, [lo, hi]))
                at, doc = w.first[own[some] - lo] + place[some], own[some]
                has = at + n[some] <= w.first[doc - lo + 1]
                yield read(w, at[has], n[some][has], tag[some][has], ids[doc[has]])

    return texts.join(by_doc, "doc").mapInArrow(tidy(run), schema)


SIDES = "key long, ahead boolean, name long, side binary, doc long, place long"


def sides_of(w: Words, at: np.ndarray, _: np.ndarray, tag: np.ndarray, doc: np.ndarray) -> pa.RecordBatch:
    """For stretches that begin at words ``at``: the ``SPREAD`` words of the text before and behind, nearest first."""
    own = w.doc[at]
    place, names, sides = at - w.first[own], [], []
    for ahead in (True, False):
        start, step = (at - 1, -1) if ahead else (at + LEAST, 1)
        have = np.minimum(at - w.first[own] if ahead else w.first[own + 1] - start, SPREAD)
        words = np.zeros((SPREAD, len(at)), U64)  # the words next to the stretches, those behind them, and so on
        name = mix(tag.view(U64) + U64(0x5851F42D4C957F2D + ahead))  # a side may hold the words of its stretch
        for m in range(SPREAD):
            more = np.flatnonzero(have > m) if m >= have.min(initial=SPREAD) else slice(None)
            words[m, more] = w.hash[start[more] + step * m]
            name[more] = mix(name[more] * U64(0x100000001B3) + words[m, more])
        names.append(name.view(np.int64))
        sides.append(binaries(words.T.astype(np.uint32)[np.arange(SPREAD) < have[:, None]], 4 * have))
    key, doc, place = (pa.array(np.concatenate([x, x])) for x in (tag, doc, place))
    columns = [key, pa.array(np.repeat([True, False], len(at))), pa.array(np.concatenate(names)), pa.concat_arrays(sides), doc, place]
    return pa.RecordBatch.from_arrays(columns, names=["key", "ahead", "name", "side", "doc", "place"])


def repeated_sides(docs: DataFrame, shared: DataFrame, every: DataFrame, text: str, key: str) -> DataFrame:
    """The sides of all stretches (``every``) that more than one place has, whose keys are ``shared``.

    Up to ``KEYS`` keys, 8 bytes each, are sent to the tasks, which find the stretches again in their texts. Beyond that
    the places are joined to the texts."""
    if shared.count() > KEYS:
        return fetch(docs, every.join(shared, "key").select("doc", "place", "n", F.col("key").alias("tag")), text, key, sides_of, SIDES)
    packed = shared.select("key").mapInPandas(lambda batches: (pd.DataFrame({"keys": [b["key"].to_numpy(np.int64).tobytes()]}) for b in batches), "keys binary")
    known = docs.sparkSession.sparkContext.broadcast(np.sort(np.frombuffer(b"".join(r["keys"] for r in packed.toLocalIterator()), np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = known.value
        for b in batches:
            ids = b.column("doc").to_numpy()
            for lo, hi, w in _word_blocks(b.column("_text")):
                at, h = stretches(w)
                tag = h.view(np.int64)
                near = np.minimum(np.searchsorted(keys, tag), max(len(keys) - 1, 0))
                again = keys[near] == tag if len(keys) else np.zeros(len(tag), bool)
                yield sides_of(w, at[again], at[again], tag[again], ids[lo:hi][w.doc[at[again]]])

    src = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("doc"), F.coalesce(text, F.lit("")).alias("_text"))
    return src.mapInArrow(tidy(run), SIDES)


def _agreement(words: np.ndarray, have: np.ndarray, group: np.ndarray) -> np.ndarray:
    """How many words each row shares with the row before; -1 for another group."""
    same = words[1:] == words[:-1]
    n = np.where(same.all(1), SPREAD, same.argmin(1))
    n = np.minimum(n, np.minimum(have[1:], have[:-1]))
    return np.concatenate(([-1], np.where(group[1:] == group[:-1], n, -1)))


def _unpack(sides: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    have = np.array([len(x) // 4 for x in sides], np.int64)
    words = np.frombuffer(b"".join(bytes(x).ljust(4 * SPREAD, b"\0") for x in sides), np.uint32).reshape(-1, SPREAD)
    return words, have


def _sorted_range(b: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray]:
    """A range in order, and the agreement of each row with the one before."""
    b = b.sort_values("at", kind="stable").reset_index(drop=True)
    words, have = _unpack(b["side"])
    return b, _agreement(words, have, b["key"].to_numpy().view(U64) * U64(2) + b["ahead"].to_numpy().astype(U64))


def range_edges(b: pd.DataFrame) -> pd.DataFrame:
    """What other ranges need of one: its first and last row, and for each number of words the earliest place among
    the rows that share so many with the first row, and with the last; and whether that is all rows."""
    b, agreed = _sorted_range(b)
    doc, place = b["doc"].to_numpy(), b["place"].to_numpy()
    out = {"task": [int(b["task"].iloc[0])]}
    for m in range(SPREAD + 1):
        start = np.flatnonzero(agreed < m)
        head, tail = int(start[1]) if len(start) > 1 else len(b), int(start[-1])
        for name, s, e in (("head", 0, head), ("tail", tail, len(b))):
            i = s + np.lexsort((place[s:e], doc[s:e]))[0]
            out.setdefault(name, []).append((int(doc[i]), int(place[i])))
        out.setdefault("through", []).append(len(start) == 1)
    row = {"task": out["task"][0]}
    for name in ("head", "tail"):
        row[f"{name}_doc"], row[f"{name}_place"] = [d for d, _ in out[name]], [p for _, p in out[name]]
    row["through"] = out["through"]
    for name, i in (("first", 0), ("last", len(b) - 1)):
        row[f"{name}_key"], row[f"{name}_ahead"], row[f"{name}_side"] = int(b["key"].iloc[i]), bool(b["ahead"].iloc[i]), bytes(b["side"].iloc[i])
    return pd.DataFrame([row])


def with_edges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows of a sorted range, and one row more that holds its edges."""
    rows = pd.concat(list(batches), ignore_index=True)  # a range
    if len(rows):
        rows = rows.assign(at=np.arange(len(rows)))
        yield rows.assign(edges=None)
        yield pd.DataFrame([{"task": rows["task"].iloc[0], "edges": range_edges(rows).iloc[0].to_dict()}]).reindex(columns=[*rows.columns, "edges"])


EDGES = (
    "task int, head_doc array<long>, head_place array<long>, tail_doc array<long>, tail_place array<long>, through array<boolean>, "
    "first_key long, first_ahead boolean, first_side binary, last_key long, last_ahead boolean, last_side binary"
)
Place = tuple[int, int]


def carried(edges: list) -> list[tuple[int, list[Place | None], list[Place | None]]]:
    """For each range, in order, and each number of words: the earliest place in ranges before it that shares so many
    with its first row, and in ranges behind it with its last row."""
    edges = sorted(edges, key=lambda r: r["task"])
    shared = []
    for x, y in zip(edges, edges[1:]):
        a, b = np.frombuffer(x["last_side"], np.uint32), np.frombuffer(y["first_side"], np.uint32)
        n = min(len(a), len(b))
        same = a[:n] == b[:n]
        agreed = n if same.all() else int(same.argmin())
        shared.append(agreed if (x["last_key"], x["last_ahead"]) == (y["first_key"], y["first_ahead"]) else -1)

    def sweep(order: list[int], name: str) -> list[list[Place | None]]:
        out: list[list[Place | None]] = [[None] * (SPREAD + 1) for _ in edges]
        for at, nxt in zip(order, order[1:]):
            own = [*zip(edges[at][f"{name}_doc"], edges[at][f"{name}_place"], strict=True)]
            for m in range(shared[min(at, nxt)] + 1):
                through = out[at][m] if edges[at]["through"][m] else None
                out[nxt][m] = own[m] if through is None else min(own[m], through)
        return out

    n = list(range(len(edges)))
    return [(r["task"], a, b) for r, a, b in zip(edges, sweep(n, "tail"), sweep(n[::-1], "head"), strict=True)]


def earliest(b: pd.DataFrame, before: list[Place | None], behind: list[Place | None]) -> pd.DataFrame:
    """For each row of a range, the largest number of words that it shares with an earlier place, and the earliest of
    those places: ``name``, ``more``, ``kept_doc``, ``kept_place``. Rows without an earlier place are left out."""
    b, agreed = _sorted_range(b)
    doc = np.append(b["doc"].to_numpy(), [p[0] for p in [*before, *behind] if p])
    place = np.append(b["place"].to_numpy(), [p[1] for p in [*before, *behind] if p])
    order = np.lexsort((place, doc))
    rank = np.empty(len(order), np.int64)
    new = np.concatenate(([False], (np.diff(doc[order]) != 0) | (np.diff(place[order]) != 0)))
    rank[order] = np.cumsum(new)
    n = len(b)
    outer = iter(rank[n:].tolist())
    ahead, after = [[next(outer) if p else None for p in own] for own in (before, behind)]
    own, best, kept = rank[:n], np.full(n, -1), np.zeros(n, np.int64)
    for m in range(SPREAD, -1, -1):
        start = np.flatnonzero(agreed < m)
        least = np.minimum.reduceat(own, start)
        if ahead[m] is not None:
            least[0] = min(least[0], ahead[m])
        if after[m] is not None:
            least[-1] = min(least[-1], after[m])
        least = np.repeat(least, np.diff(np.append(start, n)))
        found = (best < 0) & (least < own)
        best[found], kept[found] = m, least[found]
    some = best >= 0
    by_rank = np.empty(int(rank.max()) + 1, np.int64)
    by_rank[rank] = np.arange(len(rank))
    at = by_rank[kept[some]]
    return pd.DataFrame({"name": b["name"].to_numpy()[some], "more": best[some].astype(np.int32), "kept_doc": doc[at], "kept_place": place[at]})


class Scratch:
    """Written tables that are deleted as soon as nothing reads them any more."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = run_dir(self.spark, name)
        df.write.parquet(path)
        self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        while self.paths:
            drop_folder(self.spark, self.paths.pop())


def passages(sides: DataFrame, scratch: Scratch) -> DataFrame:
    """Removals (doc, place, n, kept_doc, kept_place) around the stretches that more than one place has: on either side
    as far as any earlier place agrees.

    Equal sides are one row. The rows are sorted as text is, so that the places which share most words with one stand
    next to it; ranges of the sorted table are tasks, and what spans ranges is settled by their edges."""
    spark = sides.sparkSession
    firsts = sides.groupBy("name", "key", "ahead", "side").agg(F.min(F.struct("doc", "place")).alias("f")).select("name", "key", "ahead", "side", "f.doc", "f.place")
    firsts = scratch.write(firsts, "first-sides")
    ranges = max(spark.sparkContext.defaultParallelism, -(-firsts.count() // RANGE))
    ordered = firsts.repartitionByRange(ranges, "key", "ahead", "side").sortWithinPartitions("key", "ahead", "side").withColumn("task", F.spark_partition_id())
    kinds = "name long, key long, ahead boolean, side binary, doc long, place long, task int, at long"
    ordered = scratch.write(ordered.mapInPandas(tidy(with_edges), f"{kinds}, edges struct<{EDGES.replace(' ', ':').replace(',:', ', ')}>"), "ordered")
    edges = carried([r["edges"] for r in ordered.where("edges IS NOT NULL").select("edges").collect()])  # one row a range
    places = pa.list_(pa.list_(pa.int64()))
    flat = {"task": pa.array([t for t, _, _ in edges], pa.int32()), "before": pa.array([a for _, a, _ in edges], places), "behind": pa.array([b for _, _, b in edges], places)}
    across = spark.createDataFrame(pa.table(flat))  # from Arrow, which unlike rows needs no Python workers of its own

    def settle(b: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        own = [[None if p is None else (int(p[0]), int(p[1])) for p in c[name].iloc[0]] for name in ("before", "behind")]
        found = b[["name", "doc", "place"]].merge(earliest(b, *own), on="name", how="left")
        return found.rename(columns={"doc": "first_doc", "place": "first_place"}).astype({"more": "Int32", "kept_doc": "Int64", "kept_place": "Int64"})

    rows = ordered.where("edges IS NULL").drop("edges").groupBy("task").cogroup(across.groupBy("task"))
    best = rows.applyInPandas(settle, "name long, first_doc long, first_place long, more int, kept_doc long, kept_place long")
    best = broadcast_if_small(best, "best-sides", SENT)
    is_first = (F.col("doc") == F.col("first_doc")) & (F.col("place") == F.col("first_place"))
    words = (F.octet_length("side") / 4).cast("int")
    found = sides.join(best, "name").select(
        "ahead", "doc", "place",
        F.when(is_first, F.col("more")).otherwise(words).cast("long").alias("more"),
        F.when(is_first, F.col("kept_doc")).otherwise(F.col("first_doc")).alias("kept_doc"),
        F.when(is_first, F.col("kept_place")).otherwise(F.col("first_place")).alias("kept_place"),
    ).where("kept_doc IS NOT NULL")
    back = F.when(F.col("ahead"), F.col("more")).otherwise(F.lit(0))
    found = found.select("doc", (F.col("place") - back).alias("place"), (F.col("more") + LEAST).alias("n"), "kept_doc", (F.col("kept_place") - back).alias("kept_place"))
    return joined(found)


def joined(spans: DataFrame) -> DataFrame:
    """Spans (doc, place, n, kept_doc, kept_place) that overlap or meet at the same distance, as one."""
    line = Window.partitionBy("doc", "kept_doc", "shift").orderBy("place", "n")
    reach = F.max(F.col("place") + F.col("n")).over(line.rowsBetween(Window.unboundedPreceding, -1))
    own = spans.withColumn("shift", F.col("kept_place") - F.col("place")).withColumn("new", F.coalesce(F.col("place") > reach, F.lit(True)).cast("int"))
    own = own.withColumn("run", F.sum("new").over(line)).groupBy("doc", "kept_doc", "shift", "run").agg(F.min("place").alias("place"), F.max(F.col("place") + F.col("n")).alias("end"))
    return own.select("doc", "place", (F.col("end") - F.col("place")).alias("n"), "kept_doc", (F.col("place") + F.col("shift")).alias("kept_place"))


def inside_of(w: Words, at: np.ndarray, n: np.ndarray, tag: np.ndarray, _: np.ndarray) -> pa.RecordBatch:
    """The words of each unit."""
    return pa.RecordBatch.from_arrays([pa.array(tag), binaries(w.hash[ragged(at, n)], 8 * n)], names=["whole", "words"])


def similar(sets: list[np.ndarray], rows: np.ndarray, cols: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) of ``rows`` and ``cols`` whose sets of distinct numbers have a Jaccard similarity of ``SIMILAR``."""
    size = np.array([len(x) for x in sets])
    owner = np.repeat(np.arange(len(sets)), size)
    _, name, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    often = n > 1  # what only one paragraph has is never shared
    owner, name = owner[often[name]], (np.cumsum(often) - 1)[name[often[name]]]
    order = np.argsort(name, kind="stable")
    owner, name = owner[order], name[order]
    both = np.zeros((len(rows), len(cols)), np.float32)
    for lo in range(0, int(often.sum()), COLUMNS):
        some = slice(*np.searchsorted(name, [lo, lo + COLUMNS]))
        has = np.zeros((len(sets), COLUMNS), np.float32)
        has[owner[some], name[some] - lo] = 1
        both += has[rows] @ has[cols].T
    for lo in range(0, len(rows), LINES):
        own = both[lo : lo + LINES]
        i, j = np.nonzero(own >= SIMILAR * (size[rows[lo : lo + LINES]][:, None] + size[cols][None, :] - own) - 1e-3)
        exact = own[i, j].astype(np.int64)
        i += lo
        near = (exact >= SIMILAR * (size[rows[i]] + size[cols[j]] - exact)) & (rows[i] != cols[j])
        yield rows[i[near]], cols[j[near]]


def contents(whole: np.ndarray, words: pd.Series) -> dict[int, np.ndarray]:
    """The distinct shingles of each paragraph, in order. Paragraphs are hashed together, those met before not again."""
    out: dict[int, np.ndarray] = {}
    first = np.sort(np.unique(whole, return_index=True)[1])
    whole, words = whole[first], words.iloc[first].tolist()
    for lo, hi in chunks([len(x) // 8 for x in words], BLOCK):
        end = np.cumsum([len(x) // 8 for x in words[lo:hi]])
        every = windows(np.frombuffer(b"".join(words[lo:hi]), U64), SHINGLE)
        for name, s, e in zip(whole[lo:hi].tolist(), [0, *end.tolist()], (end - SHINGLE + 1).tolist()):
            own = np.sort(every[s : max(s, e)])
            again = own[1:] == own[:-1]
            out[name] = np.delete(own, np.flatnonzero(again)) if again.any() else own
    return out


def _common(m: np.ndarray, n: np.ndarray) -> int:
    """How many numbers two ordered arrays of distinct ones share."""
    both = np.concatenate((m, n))
    both.sort(kind="stable")
    return int(np.count_nonzero(both[1:] == both[:-1]))


def matched(rows: pd.DataFrame) -> pd.DataFrame:
    """A spanning forest of the similar pairs of complete groups: part ``lo`` against part ``hi`` of a band."""
    rows = rows.sort_values(["key", "lo", "hi", "whole"], kind="stable")
    whole, part = rows["whole"].to_numpy(), rows["part"].to_numpy()
    low, high = part == rows["lo"].to_numpy(), part == rows["hi"].to_numpy()
    content = contents(whole, rows["words"])
    cols = rows[["key", "lo", "hi"]].to_numpy()
    edge = np.flatnonzero(np.concatenate(([True], (cols[1:] != cols[:-1]).any(1), [True])))
    found: dict[tuple[int, int], bool] = {}  # pairs meet in several bands
    a, b = [], []
    for s, e in zip(edge[:-1].tolist(), edge[1:].tolist()):
        i, j = np.flatnonzero(low[s:e]), np.flatnonzero(high[s:e])
        if e - s > FEW:
            sets, label = [content[w] for w in whole[s:e].tolist()], np.arange(e - s)
            for x, y in similar(sets, i, j) if len(i) and len(j) else ():
                join_labels(label, x, y)
            moved = np.flatnonzero(label != np.arange(e - s))
            a += whole[s:e][moved].tolist()
            b += whole[s:e][label[moved]].tolist()
            continue
        for x in whole[s:e][i].tolist():
            for y in whole[s:e][j].tolist():
                if x < y or (x > y and len(i) < e - s):
                    near = found.get((x, y))
                    if near is None:
                        m, n = content[x], content[y]
                        both = _common(m, n) if SIMILAR * len(m) <= len(n) <= len(m) / SIMILAR else 0
                        near = found[x, y] = both >= SIMILAR * (len(m) + len(n) - both)
                        if near:
                            a.append(x)
                            b.append(y)
    return pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})


def near_paragraphs(bands: DataFrame, firsts: DataFrame, docs: DataFrame, text: str, key: str) -> DataFrame | None:
    """Links (a, b) between hashes of different paragraphs that are similar, enough for the components; None if no band
    is shared."""
    shared = bands.groupBy("key").agg(F.min("whole").alias("lo"), F.max("whole").alias("hi")).where("lo <> hi").select("key")
    shared = materialize(shared, "bands")
    if shared.isEmpty():
        return None
    members = materialize(bands.join(shared, "key").select("key", "whole").distinct(), "members")
    names = members.select(F.col("whole").alias("key")).distinct()
    at = materialize(firsts.join(names, "key").select(F.col("key").alias("whole"), "doc", "place", "n"), "paragraphs")
    content = fetch(docs, at.select("doc", "place", "n", F.col("whole").alias("tag")), text, key, inside_of, "whole long, words binary")
    content = materialize(content.dropDuplicates(["whole"]), "content")  # rows of one id would give a paragraph more than once
    most = max(PART, members.count() // 100_000)  # so that crowded bands are at most 100,000 short rows
    crowded = materialize(members.groupBy("key").count().where(F.col("count") > most).select("key", F.ceil(F.col("count") / most).cast("int").alias("parts")), "crowded")
    dealt = members.join(F.broadcast(crowded), "key", "left").withColumn("part", F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("whole"), "parts")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("parts") - 1, F.lit(0)))))
    dealt = dealt.select("key", "whole", "part", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"))
    rows = dealt.join(content, "whole").select("key", "lo", "hi", "part", "whole", "words")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for b in batches:
            held.append(b)
            if sum(map(len, held)) < 4 * PART:
                continue
            every = pd.concat(held, ignore_index=True)
            last = (every[["key", "lo", "hi"]] == every[["key", "lo", "hi"]].iloc[-1]).all(axis=1)
            held = [every[last]]
            if not last.all():
                yield matched(every[~last])
        if held and sum(map(len, held)):
            yield matched(pd.concat(held, ignore_index=True))

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "key", "lo", "hi").sortWithinPartitions("key", "lo", "hi").mapInPandas(tidy(run), "a long, b long")


def duplicate_spans(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Removals: ``doc_id``, ``start_word``, ``n_words``, ``kind`` (paragraph, near_paragraph or passage), and the place
    that stays, ``kept_doc_id`` and ``kept_start_word``. Spans of one document may overlap."""
    lasting, passing = Scratch(docs.sparkSession), Scratch(docs.sparkSession)
    every = lasting.write(units(docs, text, key), "units")
    exact = every.where(F.col("kind") != BAND)
    place = F.struct("doc", "place", "n")
    paragraph = exact.where(f"kind = {PARAGRAPH}")
    single = paragraph.groupBy("key").agg(F.min(place).alias("first"), F.count("*").alias("c"))
    single = materialize(single.select("key", "first.*", "c"), "firsts")
    kept = [F.col("kept_doc"), F.col("kept_place")]
    shared = materialize(exact.where(f"kind = {STRETCH}").groupBy("key").count().where("count > 1").select("key"), "shared")
    sides = passing.write(repeated_sides(docs, shared, exact.where(f"kind = {STRETCH}"), text, key), "sides")
    out = [materialize(passages(sides, passing), "passages").withColumn("kind", F.lit("passage"))]
    passing.drop()
    again = single.where("c > 1").select("key", F.col("doc").alias("kept_doc"), F.col("place").alias("kept_place"))
    hits = paragraph.join(again, "key").where("doc <> kept_doc OR place <> kept_place")
    hits = materialize(hits.select("key", "doc", "place", "n", *kept), "hits")
    equal = hits.select("key", "doc", "place", "n", *kept)
    links = near_paragraphs(every.where(F.col("kind") == BAND), single, docs, text, key)
    links = None if links is None else materialize(links, "similar")
    lasting.drop()
    if links is None:
        out.append(equal.drop("key").withColumn("kind", F.lit("paragraph")))
    else:
        label = connected_components(links).select(F.col("node").alias("key"), "component")
        member = materialize(single.join(label, "key").select("key", "component", "doc", "place", "n"), "clusters")
        stays = materialize(member.groupBy("component").agg(F.min(place).alias("s")).select("component", F.col("s.doc").alias("kept_doc"), F.col("s.place").alias("kept_place")), "keepers")
        near = materialize(member.join(stays, "component"), "near")
        moved = near.select("key", F.col("kept_doc").alias("to_doc"), F.col("kept_place").alias("to_place"))
        # copies of a clustered paragraph go with it to the cluster's keeper
        out.append(equal.join(moved, "key", "left").select("doc", "place", "n", F.coalesce("to_doc", "kept_doc").alias("kept_doc"), F.coalesce("to_place", "kept_place").alias("kept_place"), F.lit("paragraph").alias("kind")))
        out.append(near.where("doc <> kept_doc OR place <> kept_place").select("doc", "place", "n", *kept, F.lit("near_paragraph").alias("kind")))
    spans = out[0]
    for more in out[1:]:
        spans = spans.unionByName(more)
    return spans.select(F.col("doc").alias(key), F.col("place").alias("start_word"), F.col("n").alias("n_words"), "kind", F.col("kept_doc").alias(f"kept_{key}"), F.col("kept_place").alias("kept_start_word"))


def cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the words of the spans (first word, number) and the white space behind each."""
    w = Words([text])
    keep, last = [], 0
    for s, n in sorted(spans):
        e = min(s + n, len(w.lo))
        if s < e:
            begin = int(w.lo[s])
            if begin > last:
                keep.append(text[last:begin])
            last = max(last, int(w.lo[e]) if e < len(w.lo) else len(text))
    return "".join([*keep, text[last:]])


def _islands(spans: DataFrame, key: str) -> DataFrame:
    """``doc``, and ``spans``: its spans without overlaps (begin, number of words)."""
    line = Window.partitionBy("doc").orderBy("s", "e")
    own = spans.select(F.col(key).alias("doc"), F.col("start_word").alias("s"), (F.col("start_word") + F.col("n_words")).alias("e")).distinct()
    new = F.col("s") > F.max("e").over(line.rowsBetween(Window.unboundedPreceding, -1))
    own = own.withColumn("new", F.coalesce(new, F.lit(True)).cast("int")).withColumn("island", F.sum("new").over(line))
    own = own.groupBy("doc", "island").agg(F.min("s").alias("s"), F.max("e").alias("e"))
    return own.groupBy("doc").agg(F.collect_list(F.struct("s", (F.col("e") - F.col("s")).alias("n"))).alias("spans"))


def remove_spans(docs: DataFrame, spans: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``docs`` with the spans cut out; documents of which nothing is left are dropped, all others kept."""
    by_doc = materialize(_islands(spans, key), "spans")
    if (by_doc.agg(F.sum(F.size("spans"))).first()[0] or 0) <= PLACES:
        by_doc = F.broadcast(by_doc)
    schema = docs.schema
    names = [f"c{i}" for i in range(len(schema))]  # whatever the columns are called
    whole, cut = docs.toDF(*names), names[schema.names.index(text)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            old = b[cut].tolist()
            new = [t if t is None or s is None else cut_words(t, [(x["s"], x["n"]) for x in s]) for t, s in zip(old, b["spans"], strict=True)]
            empty = np.array([bool(t and t.strip()) and not n.strip() for t, n in zip(old, new, strict=True)], bool)
            yield b.assign(**{cut: new})[~empty][names]

    kinds = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, schema, strict=True))
    return whole.join(by_doc, F.col(names[schema.names.index(key)]) == F.col("doc"), "left").mapInPandas(tidy(run), kinds).toDF(*schema.names)
