"""BPE encoding by speculation: greedy longest match, a check of every adjacent pair, exact merges for the rest.

A token sequence is what the merges give exactly when each adjacent pair is: two neighbours are wrong if, on the way
to them, some token at the right edge of the first and one at the left edge of the second lived at the same time and
had a merge of their own that came earlier. Words are proposed by longest match, all pairs are checked at once, and
only words with a wrong pair are merged step by step. Each distinct word of a block is encoded once.

Texts: null counts as empty; an empty text has no ids. A special token's string in a text becomes its id, as the
tokenizers library does it.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame

from netsieve.llm.textops import U64, IntMap, chunks, code_points, ragged, span_hashes, spans_equal

SPACE, LETTER, DIGIT, OTHER = 0, 1, 2, 3
BLOCK = 1 << 19  # characters encoded at once
NEVER = 1 << 40
KNOWN = 200_000  # words kept from block to block


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


@functools.lru_cache(1)
def char_classes() -> np.ndarray:
    out = np.full(0x110000, OTHER, np.uint8)
    codes = np.arange(0x110000, dtype="<u4")
    every = np.delete(codes, np.s_[0xD800:0xE000]).tobytes().decode("utf-32-le")
    for kind, pattern in ((LETTER, r"\p{L}+"), (DIGIT, r"\p{N}+"), (SPACE, r"\p{White_Space}+")):
        for m in regex.finditer(pattern, every):
            a, b = ord(every[m.start()]), ord(every[m.end() - 1])
            out[a : b + 1] = kind
            if a < 0xD800 <= b:
                out[0xD800:0xE000] = OTHER
    return out


def piece_starts(codes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where the pieces of ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+`` begin.

    ``first`` marks the characters that begin a text.
    """
    n = len(codes)
    kind = char_classes()[codes]
    run = first.copy()
    run[1:] |= kind[1:] != kind[:-1]
    at = run.copy()
    solid = np.flatnonzero(run & (kind != SPACE) & ~first)
    after = solid[kind[solid - 1] == SPACE]
    at[after - 1] = True  # the last space of a run goes with what follows, or stands alone
    at[after[codes[after - 1] == 32]] = False
    ticks = np.flatnonzero((codes == 39) & at)
    ticks = ticks[ticks + 1 < n]
    ticks = ticks[(kind[ticks + 1] == LETTER) & ~first[ticks + 1] & (codes[ticks] == 39)]
    one = np.isin(codes[ticks + 1], [ord(c) for c in "stmd"])
    two = np.zeros(len(ticks), bool)
    far = np.flatnonzero(~one & (ticks + 2 < n))
    t = ticks[far]
    a, b = codes[t + 1], codes[t + 2]
    two[far] = ~first[t + 2] & (((a == 114) | (a == 118)) & (b == 101) | (a == 108) & (b == 108))
    for hit, size in ((one, 2), (two, 3)):
        p = ticks[hit]
        at[p + 1] = False
        end = p + size
        at[end[end < n]] = True
    return np.flatnonzero(at)


class Encoder:
    """A byte-level BPE vocabulary read from a tokenizers file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letter, model = byte_letters(), spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.token: list[bytes] = [b""] * size
        for t, i in vocab.items():
            self.token[i] = bytes(letter[c] for c in t)
        self.of_byte = np.array([vocab[c] for c, _ in sorted(letter.items(), key=lambda x: x[1])], np.int64)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        a, b, c = (np.array(x, np.int64) for x in zip(*((vocab[x], vocab[y], vocab[x + y]) for x, y in merges), strict=True))
        rank = np.arange(len(a))
        self.left, self.right, self.born = np.full(size, -1, np.int64), np.full(size, -1, np.int64), np.zeros(size, np.int64)
        self.left[c[::-1]], self.right[c[::-1]], self.born[c[::-1]] = a[::-1], b[::-1], rank[::-1] + 1
        self.rank, self.made = IntMap(a << 32 | b, rank + 1), c
        self.pairs = dict(zip(zip(a.tolist(), b.tolist(), strict=True), zip((rank + 1).tolist(), c.tolist(), strict=True), strict=True))
        edges: dict[int, int] = {}
        ends = {}
        for i in vocab.values():
            node = 0
            for x in self.token[i]:
                node = edges.setdefault(node << 8 | x, len(edges) + 1)
            ends[node] = i
        self.edges = IntMap(np.fromiter(edges.keys(), np.int64, len(edges)), np.fromiter(edges.values(), np.int64, len(edges)))
        self.ends = np.full(len(edges) + 1, -1, np.int64)
        self.ends[list(ends)] = list(ends.values())
        every = [*self.token]
        for s, i in self.special.items():
            every[i] = s.encode()
        self.flat = np.frombuffer(b"".join(every), np.uint8)
        self.width = np.array([len(t) for t in every], np.int64)
        self.place = np.cumsum(self.width) - self.width
        self._forget()

    def _forget(self) -> None:
        self.known, self.known_ids = np.zeros(0, U64), np.zeros(0, np.int64)  # hashes of words met more than once, in order
        self.known_at, self.known_n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.known_bytes, self.known_from, self.known_size = np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _distinct(self, key: np.ndarray, often: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of distinct words in one array, and where each word's begin and how many they are; ``key`` in order."""
        at = np.searchsorted(self.known, key)
        old = at < len(self.known)
        old[old] = self.known[at[old]] == key[old]
        taken, size = old.copy(), ends - starts  # a hash may belong to another word: bytes decide
        old[old] = spans_equal(self.known_bytes, self.known_from[at[old]], self.known_size[at[old]], data, starts[old], size[old])
        new = np.flatnonzero(~old)
        ids, n, _ = self.words(data, starts[new], ends[new])
        begin, count = np.empty(len(key), np.int64), np.empty(len(key), np.int64)
        begin[old], count[old] = self.known_at[at[old]], self.known_n[at[old]]
        begin[new], count[new] = len(self.known_ids) + np.cumsum(n) - n, n
        every = np.concatenate([self.known_ids, ids])
        keep = new[(often & ~taken)[new]]
        if len(self.known) + len(keep) > KNOWN:
            self._forget()
        else:
            held = ragged(begin[keep], count[keep])
            known = np.concatenate([self.known, key[keep]])
            order = np.argsort(known)
            self.known_at = np.concatenate([self.known_at, len(self.known_ids) + np.cumsum(count[keep]) - count[keep]])[order]
            self.known, self.known_n = known[order], np.concatenate([self.known_n, count[keep]])[order]
            self.known_from = np.concatenate([self.known_from, len(self.known_bytes) + np.cumsum(size[keep]) - size[keep]])[order]
            self.known_bytes = np.concatenate([self.known_bytes, data[ragged(starts[keep], size[keep])]])
            self.known_size = np.concatenate([self.known_size, size[keep]])[order]
            self.known_ids = np.concatenate([self.known_ids, every[held]])
        return every, begin, count

    def greedy(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Longest matches of every word: all ids in order, and how many each word has."""
        who, pos, took, ids = np.arange(len(starts)), starts.copy(), [], []
        while len(who):
            best, length = np.full(len(who), -1, np.int64), np.zeros(len(who), np.int64)
            live, node, k = np.arange(len(who)), np.zeros(len(who), np.int64), 0
            while len(live):
                live_ok = pos[live] + k < ends[who[live]]
                live, node = live[live_ok], node[live_ok]
                node = self.edges.get(node << 8 | data[pos[live] + k].astype(np.int64), -1)
                ok = node >= 0
                live, node, k = live[ok], node[ok], k + 1
                end = self.ends[node]
                hit = end >= 0
                best[live[hit]], length[live[hit]] = end[hit], k
            took.append(who)
            ids.append(best)
            pos = pos + length
            more = pos < ends[who]
            who, pos = who[more], pos[more]
        owner = np.concatenate(took) if took else np.zeros(0, np.int64)
        order = np.argsort(owner, kind="stable")
        flat = np.concatenate(ids)[order] if ids else np.zeros(0, np.int64)
        return flat, np.bincount(owner, minlength=len(starts))

    def fits(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether token ``b`` may stand after token ``a`` in a merged word."""
        ok = np.ones(len(a), bool)
        row, x, x_end = np.arange(len(a)), a, np.full(len(a), NEVER)
        while len(row):
            r, y, y_end, xx, xe = row, b[row], np.full(len(row), NEVER), x, x_end
            while len(r):
                when = self.rank.get(xx << 32 | y, NEVER)
                ok[r[(when < xe) & (when <= y_end) & (when < NEVER)]] = False
                deeper = (self.left[y] >= 0) & ok[r]
                r, xx, xe, y = r[deeper], xx[deeper], xe[deeper], y[deeper]
                y_end, y = self.born[y], self.left[y]
            deeper = (self.right[x] >= 0) & ok[row]
            row, x = row[deeper], x[deeper]
            x_end, x = self.born[x], self.right[x]
        return ok

    def merge_all(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The merges in order, for many short words at once: ids and counts."""
        n, width = len(starts), int((ends - starts).max())
        ids = np.full((n, width + 1), -1, np.int64)
        size = ends - starts
        inside = np.arange(width)[None, :] < size[:, None]
        ids[:, :width][inside] = self.of_byte[data[ragged(starts, size)]]
        live = np.flatnonzero(size > 1)
        while len(live):
            m = ids[live]
            a, b = m[:, :-1], m[:, 1:]
            both = b >= 0
            rank = np.full(a.shape, NEVER)
            rank[both] = self.rank.get(a[both] << 32 | b[both], NEVER)
            at = rank.argmin(1)
            best = rank[np.arange(len(live)), at]
            go = best < NEVER
            live, m, at, best = live[go], m[go], at[go], best[go]
            if not len(live):
                break
            col = np.arange(width + 1)[None, :]
            src = np.minimum(col + (col > at[:, None]), width)
            m = np.take_along_axis(m, src, 1)
            m[np.arange(len(live)), at] = self.made[best - 1]
            m[:, width] = -1
            ids[live] = m
        keep = ids >= 0
        return ids[keep], keep.sum(1)

    def merge_one(self, word: bytes) -> list[int]:
        """The merges in order, for one long word: a heap of pairs over a linked list."""
        ids = self.of_byte[np.frombuffer(word, np.uint8)].tolist()
        n = len(ids)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(p[0], i, ids[i], ids[i + 1]) for i in range(n - 1) if (p := self.pairs.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = self.pairs[a, b][1], -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if p := self.pairs.get((ids[i], ids[k])):
                    heapq.heappush(heap, (p[0], i, ids[i], ids[k]))
            if (h := before[i]) >= 0 and (p := self.pairs.get((ids[h], ids[i]))):
                heapq.heappush(heap, (p[0], h, ids[h], ids[i]))
        return [x for x in ids if x >= 0]

    def words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Ids of distinct words, how many each has, and for how many the proposal failed."""
        flat, count = self.greedy(data, starts, ends)
        owner = np.repeat(np.arange(len(starts)), count)
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        pair, back = np.unique(flat[inner] << 32 | flat[inner + 1], return_inverse=True)
        wrong = np.zeros(len(starts), bool)
        if len(pair):
            wrong[owner[inner[~self.fits(pair >> 32, pair & 0xFFFFFFFF)[back]]]] = True
        bad = np.flatnonzero(wrong)
        if not len(bad):
            return flat, count, 0
        size = (ends - starts)[bad]
        kept = ~wrong[owner]
        parts, owners = [flat[kept]], [owner[kept]]
        edge = 0
        for most in (8, 16, 32, 64):
            some = bad[(size > edge) & (size <= most)]
            edge = most
            if len(some):
                ids, n = self.merge_all(data, starts[some], ends[some])
                parts.append(ids)
                owners.append(np.repeat(some, n))
        for w in bad[size > edge]:
            ids = np.array(self.merge_one(data[starts[w] : ends[w]].tobytes()), np.int64)
            parts.append(ids)
            owners.append(np.full(len(ids), w))
        flat, owner = np.concatenate(parts), np.concatenate(owners)
        return flat[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(starts)), len(bad)

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        codes = code_points("".join(texts))
        length = np.array([len(t) for t in texts], np.int64)
        begin = np.cumsum(length) - length
        if not len(codes):
            return np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
        first = np.zeros(len(codes), bool)
        first[begin[length > 0]] = True
        at = piece_starts(codes, first)
        byte = np.concatenate(([0], np.cumsum(1 + (codes > 0x7F) + (codes > 0x7FF).astype(np.int64) + (codes > 0xFFFF))))
        data = np.frombuffer("".join(texts).encode("utf-8", "surrogatepass"), np.uint8)
        starts, ends = byte[at], byte[np.append(at[1:], len(codes))]
        key = span_hashes(data, starts, ends)
        key, one, back, met = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
        ids, offset, n = self._distinct(key, met > 1, data, starts[one], ends[one])
        each, offset, first = n[back], offset[back], one[back]
        odd = np.flatnonzero(~spans_equal(data, starts[first], ends[first] - starts[first], data, starts, ends - starts))
        if len(odd):  # words with the hash of another
            more, n, _ = self.words(data, starts[odd], ends[odd])
            each[odd], offset[odd] = n, len(ids) + np.cumsum(n) - n
            ids = np.concatenate([ids, more])
        flat = ids[ragged(offset, each)]
        text_of = np.searchsorted(begin + length, at, side="right")
        return flat, np.bincount(text_of, weights=each, minlength=len(texts)).astype(np.int64)

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text, in order."""
        for lo, hi in chunks([len(t) for t in texts], BLOCK):
            some = texts[lo:hi]
            if not any(s in t for t in some for s in self.special):
                flat, n = self._encode(some)
                yield from np.split(flat, np.cumsum(n)[:-1])
                continue
            cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
            parts = [cut.split(t) for t in some]
            flat, n = self._encode([x for p in parts for x in p[::2]])
            pieces = iter(np.split(flat, np.cumsum(n)[:-1]))
            for p in parts:
                yield np.concatenate([np.array([self.special[x]]) if i % 2 else next(pieces) for i, x in enumerate(p)])

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids, special tokens included; bytes that are no UTF-8 become U+FFFD."""
        return self.flat[ragged(self.place[ids], self.width[ids])].tobytes().decode("utf-8", "replace")


@functools.lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encode_documents(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key``, ``ids`` of the text, and ``decoded``, the text that the ids give back. ``path``: a tokenizers file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(path)
        for b in batches:
            texts = b["_text"].tolist()
            for lo, hi in chunks([len(t) for t in texts], BLOCK):
                ids = list(enc.encode(texts[lo:hi]))
                yield pd.DataFrame({key: b[key].iloc[lo:hi].to_numpy(), "ids": [x.astype(np.int32) for x in ids], "decoded": [enc.decode(x) for x in ids]})

    kind = docs.schema[key].dataType.simpleString()
    src = docs.selectExpr(f"`{key}`", f"coalesce(`{text}`, '') AS _text")
    return src.mapInPandas(run, f"`{key}` {kind}, ids array<int>, decoded string")


def id_digests(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``encode_documents`` reduced to ``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` without moving ids."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(path)
        for b in batches:
            out = []
            for ids in enc.encode(b["_text"].tolist()):
                out.append((len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(enc.decode(ids).encode()).hexdigest()))
            n, a, d = zip(*out, strict=True) if out else ([], [], [])
            yield pd.DataFrame({key: b[key].to_numpy(), "n_tokens": np.array(n, np.int64), "ids_sha256": list(a), "decoded_sha256": list(d)})

    kind = docs.schema[key].dataType.simpleString()
    src = docs.selectExpr(f"`{key}`", f"coalesce(`{text}`, '') AS _text")
    return src.mapInPandas(run, f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
