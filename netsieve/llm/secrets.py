"""Secret scans by one combined automaton: regexes to NFA, subset construction, minimisation, transition arrays.

Two automata are compiled from the same rules. The first reads bytes from the end to the beginning and is never reset
by a mismatch: its state tells, for all rules at once, at which bytes a match begins. This is the one pass over the
text. The second reads forward from such a byte and tells where the longest match ends. A text is scanned in segments
that begin at bytes after which no rule is under way (a byte that leads every state to the first), thousands of
segments in step, so that one array lookup serves a byte of each.

Spans are in code points, end exclusive, leftmost and not overlapping per kind. Null and empty texts have none.
"""

from __future__ import annotations

import functools
import hashlib
import re
import re._constants as sre
import re._parser as parser
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from netsieve.llm.textops import chunks, tidy

#: Kinds in the order of the reports, with their rules. The first three are the base kinds, fixed values.
ASSIGN = rb"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
ASSIGN_VALUE = re.compile(rb"""[A-Za-z_]+["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
RULES: dict[str, bytes] = {
    "assign": ASSIGN,
    "access": rb"AKIA[A-Z0-9]+",
    "hex": rb"[0-9a-f]{24,}",
    "github": rb"gh[pousr]_[A-Za-z0-9]+",
    "slack": rb"xox[baprs]-[A-Za-z0-9-]+",
    "pem": rb"-----BEGIN [A-Z ]*PRIVATE KEY-----",
}
BASE = ("assign", "access", "hex")
#: A found match counts if it passes; a failing one still covers its text.
FILTERS: dict[str, Callable[[bytes], bool]] = {
    "assign": lambda m: len(ASSIGN_VALUE.fullmatch(m)[1]) >= 6,
    "access": lambda m: len(m) >= 20,
    "github": lambda m: len(m) >= 40,
    "slack": lambda m: len(m) >= 15,
}
SEGMENT = 256
BLOCK = 4 << 20


class Nfa:
    """States with edges by byte class and empty edges; ``backward`` reads every sequence from its end."""

    def __init__(self, backward: bool):
        self.backward = backward
        self.edges: list[list[tuple[frozenset[int], int]]] = []
        self.empty: list[list[int]] = []

    def state(self) -> int:
        self.edges.append([])
        self.empty.append([])
        return len(self.edges) - 1

    def add(self, parts, start: int, fold: bool) -> int:
        """Attach a parsed pattern behind ``start``; its end state."""
        for op, arg in reversed(list(parts)) if self.backward else parts:
            start = self._one(op, arg, start, fold)
        return start

    def _bytes(self, start: int, some: set[int], fold: bool) -> int:
        if fold:
            some = some | {x ^ 32 for x in some if chr(x).isalpha() and x < 128}
        end = self.state()
        self.edges[start].append((frozenset(some), end))
        return end

    def _one(self, op, arg, start: int, fold: bool) -> int:
        if op is sre.LITERAL:
            return self._bytes(start, {arg}, fold)
        if op is sre.IN:
            some = {x for kind, v in arg for x in (range(v[0], v[1] + 1) if kind is sre.RANGE else [v])}
            return self._bytes(start, some, fold)
        if op is sre.SUBPATTERN:
            return self.add(arg[3], start, (fold or bool(arg[1] & re.IGNORECASE)) and not arg[2] & re.IGNORECASE)
        if op is sre.BRANCH:
            end = self.state()
            for branch in arg[1]:
                inner = self.state()
                self.empty[start].append(inner)
                self.empty[self.add(branch, inner, fold)].append(end)
            return end
        if op is sre.MAX_REPEAT:
            least, most, body = arg
            for _ in range(least):
                start = self.add(body, start, fold)
            if most is sre.MAXREPEAT:
                loop = self.state()
                self.empty[start].append(loop)
                self.empty[self.add(body, loop, fold)].append(loop)
                return loop
            end = self.state()
            self.empty[start].append(end)
            for _ in range(most - least):
                start = self.add(body, start, fold)
                self.empty[start].append(end)
            return end
        raise ValueError(f"rules have no {op}")

    def closure(self, some: set[int]) -> frozenset[int]:
        todo, seen = list(some), set(some)
        while todo:
            for s in self.empty[todo.pop()]:
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return frozenset(seen)


class Automaton:
    """The minimal deterministic automaton of all rules: ``step`` (states x 256), ``accept`` (a bit for each rule)."""

    def __init__(self, rules: list[bytes], backward: bool):
        nfa = Nfa(backward)
        root = nfa.state()
        ends: dict[int, int] = {}
        for k, rule in enumerate(rules):
            inner = nfa.state()
            nfa.empty[root].append(inner)
            ends[nfa.add(parser.parse(rule), inner, False)] = 1 << k
        start = nfa.closure({root})
        number, rows, accept = {start: 0}, [], []
        todo = [start]
        if not backward:
            number[frozenset()] = 1
            todo.append(frozenset())
        for now in todo:  # grows while it is read
            to: list[set[int]] = [set() for _ in range(256)]
            for s in now:
                for some, end in nfa.edges[s]:
                    for x in some:
                        to[x].add(end)
            row = []
            for x in range(256):
                nxt = nfa.closure(to[x] | ({root} if backward else set()))
                if nxt not in number:
                    number[nxt] = len(number)
                    todo.append(nxt)
                row.append(number[nxt])
            rows.append(row)
            accept.append(sum({ends[s] for s in now if s in ends}))
        self._minimise(np.array(rows), np.array(accept))

    def _minimise(self, step: np.ndarray, accept: np.ndarray) -> None:
        """Split states by what they accept, then by where they lead, until nothing splits (Moore)."""
        group = np.unique(accept, return_inverse=True)[1]
        while True:
            _, one, new = np.unique(np.column_stack([group, group[step]]), axis=0, return_index=True, return_inverse=True)
            new = new.ravel()
            if new.max() == group.max():
                break
            group = new
        self.start = int(group[0])
        first = np.unique(group, return_index=True)[1]
        self.step = np.ascontiguousarray(group[step[first]].astype(np.int32))
        self.accept = accept[first].astype(np.int32)
        self.resets = (self.step == self.start).all(0)
        self.dead = int(group[1]) if len(step) > 1 else -1


class Scanner:
    """All rules compiled. ``spans`` gives what the rules find in texts."""

    def __init__(self, rules: dict[str, bytes] = RULES):
        self.kinds = list(rules)
        self.back = Automaton(list(rules.values()), backward=True)
        self.ahead = Automaton(list(rules.values()), backward=False)
        if not self.back.resets[10]:
            raise ValueError("a rule crosses line ends")

    def begins(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes at which a match begins, with the rules' bits. ``data`` ends with a line end."""
        stops = np.flatnonzero(self.back.resets[data])
        _, one = np.unique(stops // SEGMENT, return_index=True)
        cuts = np.append(stops[one], len(data))
        lo, hi = np.concatenate(([0], cuts[:-1])), cuts
        order = np.argsort(lo - hi, kind="stable")
        size, at = (hi - lo)[order], hi[order] - 1
        live = np.searchsorted(-size, -np.arange(1, int(size[0]) + 1), side="right") if len(size) else []
        step, accept = self.back.step.ravel(), self.back.accept
        state, where, what = np.full(len(size), self.back.start, np.int32), [], []
        for t, n in enumerate(live):
            now = at[:n] - t
            state = step[(state[:n] << 8) + data[now]]
            bits = accept[state]
            hit = np.flatnonzero(bits)
            if len(hit):
                where.append(now[hit])
                what.append(bits[hit])
        if not where:
            return np.zeros(0, np.int64), np.zeros(0, np.int32)
        where, what = np.concatenate(where), np.concatenate(what)
        order = np.argsort(where)
        return where[order], what[order]

    def end(self, data: bytes, start: int, bit: int) -> int:
        """The end of the longest match of one rule that begins at ``start``."""
        step, accept, s, last = self.ahead.step, self.ahead.accept, self.ahead.start, start
        for i in range(start, len(data)):
            s = step[s, data[i]]
            if s == self.ahead.dead:
                break
            if accept[s] & bit:
                last = i + 1
        return last

    def spans(self, texts: list[str]) -> Iterator[list[tuple[str, int, int]]]:
        """Per text: kind, start and end in code points, by start, then kind as listed."""
        for lo, hi in chunks([len(t) for t in texts], BLOCK):
            coded = [t.encode("utf-8", "surrogatepass") for t in texts[lo:hi]]
            joined = b"\n".join(coded) + b"\n"
            where, what = self.begins(np.frombuffer(joined, np.uint8))
            begin = np.cumsum([0, *(len(c) + 1 for c in coded)])
            found: list[list[tuple[int, int, int]]] = [[] for _ in coded]
            for k, kind in enumerate(self.kinds):
                covered = 0
                good = FILTERS.get(kind, lambda m: True)
                for start in where[(what >> k) & 1 == 1].tolist():
                    if start < covered:
                        continue
                    covered = self.end(joined, start, 1 << k)
                    if good(joined[start:covered]):
                        doc = int(np.searchsorted(begin, start, side="right")) - 1
                        found[doc].append((start - int(begin[doc]), k, covered - int(begin[doc])))
            for text, data, own in zip(texts[lo:hi], coded, found, strict=True):
                own.sort()
                if own and len(data) != len(text):
                    places = np.array(sorted({x for s, _, e in own for x in (s, e)}))
                    heads = np.concatenate(([0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)))
                    point = dict(zip(places.tolist(), heads[places].tolist(), strict=True))
                    yield [(self.kinds[k], point[s], point[e]) for s, k, e in own]
                else:
                    yield [(self.kinds[k], s, e) for s, k, e in own]


@functools.lru_cache(1)
def scanner() -> Scanner:
    return Scanner()


SPANS = "array<struct<kind:string,start:long,end:long>>"


def find_secrets(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key`` and ``spans``: every span that a rule finds in the text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scan = scanner()
        for b in batches:
            out = [[{"kind": k, "start": s, "end": e} for k, s, e in own] for own in scan.spans(b["_text"].tolist())]
            yield pd.DataFrame({key: b[key].to_numpy(), "spans": out})

    kind = docs.schema[key].dataType.simpleString()
    return docs.selectExpr(f"`{key}`", f"coalesce(`{text}`, '') AS _text").mapInPandas(tidy(run), f"`{key}` {kind}, spans {SPANS}")


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts of the base kinds, a digest of their spans, and all spans as text."""
    kinds = ", ".join(f"'{k}'" for k in BASE)
    said = "transform({}, x -> concat(x.kind, ':', x.start, ':', x.end))"
    base = f"filter(spans, x -> x.kind IN ({kinds}))"
    return found.selectExpr(
        f"`{key}`",
        *[f"CAST(size(filter(spans, x -> x.kind = '{k}')) AS BIGINT) AS n_{k}" for k in BASE],
        f"sha2(array_join({said.format(base)}, ','), 256) AS base_sha256",
        f"array_join({said.format('spans')}, ',') AS spans",
    )


def redact(docs: DataFrame, mark: str = "[secret]", text: str = "text") -> DataFrame:
    """``docs`` with every found span replaced by ``mark``; null texts stay null, all other columns as they are."""
    cols = docs.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scan = scanner()
        for b in batches:
            own = b[text].tolist()
            out = []
            for t, spans in zip(own, scan.spans([t or "" for t in own]), strict=True):
                if spans:
                    parts, last = [], 0
                    for _, s, e in spans:
                        if e > last:
                            parts += [t[last : max(s, last)], mark if s >= last else ""]
                            last = e
                    t = "".join([*parts, t[last:]])
                out.append(t)
            yield b.assign(**{text: out})[cols]

    return docs.mapInPandas(tidy(run), docs.schema)


def base_sha256(spans: list[tuple[str, int, int]]) -> str:
    """The digest of one text's base spans, as ``digest`` gives it."""
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans if k in BASE).encode()).hexdigest()
