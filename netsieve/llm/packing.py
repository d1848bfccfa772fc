"""Best-fit packing of documents into token sequences, improved by swaps until bins empty.

Every document (its ids and an end id) is cut into pieces of at most ``capacity`` tokens; all pieces but the first of
a longer document are full. Full pieces are sequences of their own. The others are dealt evenly over tasks by a hash of
their place, and each task packs its share: best fit in decreasing order, then a local search over underfull bins.
Exchanges of one piece for one or for two smaller ones, and moves, are made when they raise the sum of squared
fills: receivers become full, donors run empty and disappear. A task holds numbers only, never texts or ids.

Null texts count as empty (one piece, the end id); repeated ids are separate documents; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from netsieve.llm.bpe import BLOCK, encoder
from netsieve.llm.textops import chunks, tidy
from netsieve.session import materialize

CAPACITY = 1024
SHARE = 25_000  # pieces packed together at most, on average
FEW = 256  # and, if there is more than one share, at least
MEET, LOOSE, FULL = 14, 64, 0.995  # tasks whose emptiest bins (so many, if less full than that) are packed anew together
SLACK = 24  # how far from a perfect fit an exchange may end
ROUNDS = 4


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """Start and length of the pieces of a document of ``n`` tokens."""
    if n <= capacity:
        return [(0, n)]
    head = n % capacity or capacity
    return [(0, head), *((s, capacity) for s in range(head, n, capacity))]


def token_pieces(docs: DataFrame, path: str, end_id: int, capacity: int = CAPACITY, with_ids: bool = True, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per piece: ``key``, ``piece``, ``start``, ``length``, ``ids_crc32``, and if asked for the tokens, ``ids``."""
    kind = docs.schema[key].dataType.simpleString()
    cols = [key, "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(path)
        for b in batches:
            texts, keys = b["_text"].tolist(), b[key].tolist()
            for lo, hi in chunks([len(t) for t in texts], BLOCK):
                rows = []
                for k, ids in zip(keys[lo:hi], enc.encode(texts[lo:hi]), strict=True):
                    ids = np.append(ids, end_id).astype("<u4")
                    for i, (s, n) in enumerate(cut(len(ids), capacity)):
                        part = ids[s : s + n]
                        rows.append((k, i, s, n, zlib.crc32(part.tobytes()), *([part.astype(np.int32)] if with_ids else [])))
                yield pd.DataFrame(rows, columns=cols)

    src = docs.selectExpr(f"`{key}`", f"coalesce(`{text}`, '') AS _text")
    return src.mapInPandas(tidy(run), f"`{key}` {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)


class Bins:
    """Open bins of one task: contents, and indexes of pieces by size and of bins by room."""

    def __init__(self, capacity: int):
        self.capacity, self.items, self.fill = capacity, [], []
        self.by_room: dict[int, set[int]] = defaultdict(set)
        self.rooms: list[int] = []  # rooms that some open bin has, in order
        self.by_size: dict[int, set[int]] = defaultdict(set)  # bins holding a piece of that size
        self.indexed = False

    def _open(self, b: int) -> None:
        room = self.capacity - self.fill[b]
        if room > 0 and self.fill[b] > 0:
            if not self.by_room[room]:
                insort(self.rooms, room)
            self.by_room[room].add(b)

    def _shut(self, b: int) -> None:
        room = self.capacity - self.fill[b]
        if b in self.by_room.get(room, ()):
            self.by_room[room].remove(b)
            if not self.by_room[room]:
                self.rooms.pop(bisect_left(self.rooms, room))

    def tightest(self, size: int, other: int = -1) -> int:
        """The open bin with the least room for ``size``, or -1."""
        for room in self.rooms[bisect_left(self.rooms, size) :]:
            for b in self.by_room[room]:
                if b != other:
                    return b
        return -1

    def put(self, b: int, item: int, size: int) -> None:
        if b < 0:
            b = len(self.items)
            self.items.append([])
            self.fill.append(0)
        self._shut(b)
        self.items[b].append((size, item))
        self.fill[b] += size
        self._open(b)
        if self.indexed:
            self.by_size[size].add(b)

    def take(self, b: int, size: int) -> int:
        """Remove one piece of ``size`` from ``b``."""
        self._shut(b)
        at = next(i for i, (s, _) in enumerate(self.items[b]) if s == size)
        item = self.items[b].pop(at)[1]
        self.fill[b] -= size
        if not any(s == size for s, _ in self.items[b]):
            self.by_size[size].discard(b)
        self._open(b)
        return item

    def index(self) -> None:
        self.indexed = True
        for b, own in enumerate(self.items):
            if self.fill[b] < self.capacity:
                for s, _ in own:
                    self.by_size[s].add(b)

    def exchange(self, b: int) -> bool:
        """Fill ``b`` with a larger piece of an emptier bin for one of its pieces, or for two of them."""
        room, own = self.capacity - self.fill[b], sorted({s for s, _ in self.items[b]})
        sets = [(s,) for s in own] + [(x, y) for i, x in enumerate(own[:6]) for y in own[i + 1 : 7]]
        for miss in range(min(SLACK, room)):
            for out in sets:
                size = sum(out) + room - miss
                if size > self.capacity:
                    continue
                for a in list(self.by_size.get(size, ()))[:4]:
                    gain = room - miss
                    if a != b and self.fill[b] + gain > self.fill[a] and self.fill[a] < self.capacity:
                        given = self.take(a, size)
                        back = [(self.take(b, s), s) for s in out]
                        self.put(b, given, size)
                        for item, s in back:
                            self.put(a, item, s)
                        return True
        return False

    def unload(self, b: int) -> bool:
        """Move pieces of ``b`` into fuller bins with room; whether it ran empty."""
        for size, _ in sorted(self.items[b], reverse=True):
            to = self.tightest(size, b)
            if to >= 0 and self.fill[to] + size > self.fill[b]:
                self.put(to, self.take(b, size), size)
        return not self.items[b]


def pack_sizes(sizes: list[int], capacity: int, rounds: int = ROUNDS) -> list[list[int]]:
    """Bins of item numbers. Best fit decreasing, then the local search for ``rounds`` rounds or until nothing moves."""
    bins = Bins(capacity)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        bins.put(bins.tightest(sizes[i]), i, sizes[i])
    bins.index()
    for _ in range(rounds):
        open_ = sorted((b for b in range(len(bins.items)) if 0 < bins.fill[b] < capacity), key=lambda b: -bins.fill[b])
        changed = sum(bins.exchange(b) for b in open_ if 0 < bins.fill[b] < capacity)
        emptied = sum(bins.unload(b) for b in reversed(open_) if 0 < bins.fill[b] < capacity)
        if not changed and not emptied:
            break
    return [[i for _, i in own] for own in bins.items if own]


def pack(pieces: DataFrame, capacity: int = CAPACITY, key: str = "doc_id") -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``.

    Tasks pack their shares; then the pieces in the few emptiest bins of ``MEET`` tasks are packed anew together, and so
    on until one task is left. A task never holds more than its share or what ``MEET`` tasks have passed on."""
    spark = pieces.sparkSession
    total = pieces.count()
    shares = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), total // FEW), -(-total // SHARE))
    cols = pieces.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long, loose boolean"
    done, level, todo = None, 0, pieces
    while True:
        packed = materialize(_packed(todo.select(cols), shares, level, capacity, key, schema), f"packed{level}")
        final = packed if shares == 1 else packed.where("NOT loose")
        done = final if done is None else done.unionByName(final)
        if shares == 1:
            return done.drop("loose")
        shares, level, todo = -(-shares // MEET), level + 1, packed.where("loose")


def _packed(pieces: DataFrame, shares: int, level: int, capacity: int, key: str, schema: str) -> DataFrame:
    cols = pieces.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        rows = pd.concat(list(batches) or [pd.DataFrame(columns=cols)], ignore_index=True)
        if rows.empty:
            return
        rows = rows.sort_values([key, "piece", "length"], kind="stable").reset_index(drop=True)
        size = rows["length"].to_numpy(np.int64)
        seq, off, loose = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64), np.zeros(len(rows), bool)
        part, whole = np.flatnonzero(size < capacity), np.flatnonzero(size >= capacity)
        base = (level << 56) + (TaskContext.get().partitionId() << 32)
        seq[whole] = base + np.arange(len(whole))
        packed = pack_sizes(size[part].tolist(), capacity)
        packed.sort(key=lambda own: size[part[own]].sum())
        for n, own in enumerate(packed):
            at = part[own]
            seq[at] = base + len(whole) + n
            off[at] = np.cumsum(size[at]) - size[at]
            loose[at] = n < LOOSE and size[at].sum() < FULL * capacity
        yield rows.assign(sequence_id=seq, offset=off, loose=loose)

    dealt = pieces.repartition(1) if shares == 1 else pieces.repartition(shares, F.xxhash64(key, "piece", "start"))
    return dealt.mapInPandas(tidy(run), schema)


def pack_documents(docs: DataFrame, path: str, end_id: int = 2, capacity: int = CAPACITY, with_ids: bool = True) -> DataFrame:
    """Tokenise, cut and pack ``docs``. The pieces are written once to the shared folder, so a lost task re-reads them."""
    return pack(materialize(token_pieces(docs, path, end_id, capacity, with_ids), "pieces"), capacity)
