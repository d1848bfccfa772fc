"""Toxicity by compression distance: zstandard dictionaries of toxic and of ordinary text, and window lengths under each.

Training reads a bounded sample of labelled rows that are not held out. A window is a word in a fixed frame. The toxic
dictionary is made of windows, and of beginnings of windows, that stand in far more toxic than ordinary documents of the
sample, the commonest last; the ordinary one is trained on windows of ordinary text; and both follow the same stretch
of ordinary text, so that an ordinary window costs the same under either. Every byte is written twice, the second
time with its highest bit flipped: literals then cost double and matches the same, which makes even a short match
visible in a length counted in bytes. A window that shares no ``SHARED`` bytes with the toxic dictionary cannot be shorter
under it, and is not compressed. A document's evidence is the largest savings of its windows under the toxic
dictionary, their sum, and their sum by its length. A logistic curve fitted across two halves of the sample, with the
labels' true proportion, calibrates it; if more than ``FALSE_ALARMS`` of the sample's ordinary rows would be rejected,
the curve is moved down until they are not.

Null and empty texts have no evidence and score as such. Equal texts score alike, repeated rows stay, rows without an id
are scored and not learnt from. Labels other than 0 and 1 are ignored; a document labelled twice counts as toxic if one
label says so; without both labels every score is the share of toxic labels, or 0. Other columns do not matter.
"""

from __future__ import annotations

import functools
import heapq
import random
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from netsieve.llm.langid import below, held_out
from netsieve.llm.textops import tidy

TOXIC_ROWS, ORDINARY_ROWS = 2000, 5000  # labelled rows that training reads at most
EXCERPT = 6000  # characters of a training row
SHARED = 6  # bytes a window must share with the dictionary to gain from it
BEGINNINGS = range(5, 10)  # bytes of a window's beginning, blank included
OFTEN, TIMES = 0.01, 10  # share of toxic rows that have a string of the dictionary; how much commoner it is there
TOXIC, DICTIONARY, COMMON = 16000, 3000, 110_000  # bytes of the toxic and the ordinary dictionary, and of what both follow
LEVEL, TOP, CAP = 16, 6, 16
FALSE_ALARMS = 0.005
FRAME = b" the quick onion said to which in the "
LONGEST = 64  # bytes of a window; longer words are several
THRESHOLD = 0.3
CACHE = 50_000
_FLIP = bytes(x ^ 0x80 for x in range(256))


def doubled(data: bytes) -> bytes:
    out = bytearray(2 * len(data))
    out[0::2], out[1::2] = data, data.translate(_FLIP)
    return bytes(out)


def windows_of(text: str) -> list[bytes]:
    """The words of a text, lower case, long ones in parts."""
    own = text.lower().encode("utf-8", "surrogatepass").split()
    if any(len(w) > LONGEST for w in own):
        own = [w[i : i + LONGEST] for w in own for i in range(0, len(w), LONGEST)]
    return own


def trained(samples: list[bytes], size: int) -> bytes:
    """A zstandard dictionary's content; too few samples stand for themselves."""
    try:
        return zstandard.train_dictionary(size + 1096, samples).as_bytes()[-size:]
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


@dataclass(frozen=True)
class Model:
    common: bytes
    toxic: bytes
    ordinary: bytes
    weights: tuple[float, ...]  # of the TOP largest savings, their sum, their mean, the number of words, and a constant

    def scores(self, texts: list[str]) -> np.ndarray:
        savings = _savings(self.common, self.toxic, self.ordinary)
        x = np.array([evidence(windows_of(t), savings) for t in texts], float).reshape(len(texts), TOP + 3)
        return 1 / (1 + np.exp(-(x @ np.array(self.weights[:-1]) + self.weights[-1])))


class Savings:
    """Bytes that a window saves under the toxic dictionary; 0 where it shares nothing with it."""

    def __init__(self, common: bytes, toxic: bytes, ordinary: bytes):
        toxic, ordinary = toxic or b" ", ordinary or b" "
        spec = zstandard.ZstdCompressionParameters.from_level(
            LEVEL, source_size=128, dict_size=2 * (len(common) + TOXIC), min_match=4, write_content_size=0, write_checksum=0, write_dict_id=0, format=zstandard.FORMAT_ZSTD1_MAGICLESS
        )
        self.sides = []
        for own in (ordinary, toxic):
            content = zstandard.ZstdCompressionDict(doubled(common + own + FRAME), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            content.precompute_compress(compression_params=spec)
            self.sides.append(zstandard.ZstdCompressor(dict_data=content, compression_params=spec).compress)
        self.shared = {toxic[i : i + SHARED] for i in range(len(toxic) - SHARED + 1)}
        self.known: dict[bytes, int] = {}

    def of(self, words: list[bytes]) -> list[int]:
        known = self.known
        if len(known) > CACHE:
            known.clear()
        out = []
        for w in words:
            v = known.get(w)
            if v is None:
                x = b" " + w + b" "
                v = 0
                if any(x[i : i + SHARED] in self.shared for i in range(len(x) - SHARED + 1)):
                    window = doubled(FRAME + w + b" ")
                    v = max(0, len(self.sides[0](window)) - len(self.sides[1](window)))
                known[w] = v
            if v:
                out.append(v)
        return out


@functools.lru_cache(1)  # a worker outlives a model
def _savings(common: bytes, toxic: bytes, ordinary: bytes) -> Savings:
    return Savings(common, toxic, ordinary)


def evidence(words: list[bytes], savings: Savings) -> list[float]:
    every = [min(v, CAP) / CAP for v in savings.of(words)]
    best, total = heapq.nlargest(TOP, every), sum(every)
    return [*best, *[0.0] * (TOP - len(best)), np.log1p(total), np.sqrt(total / max(1, len(words))), np.log1p(len(words)) / 8]


def strings_of(words: list[bytes]) -> set[bytes]:
    """The windows of a document, blanks around them, and their beginnings."""
    out = {b" " + w + b" " for w in words}
    return out | {x[:n] for x in out for n in BEGINNINGS if n < len(x) - 1}


def marked_strings(toxic: list[list[bytes]], ordinary: list[list[bytes]]) -> dict[bytes, int]:
    """Strings that are far commoner in toxic documents, and how many of those have them."""
    least = max(4, OFTEN * len(toxic))
    here = {x: n for x, n in Counter(x for w in toxic for x in strings_of(w)).items() if n >= least}
    there = Counter(x for w in ordinary for x in strings_of(w) if x in here)
    return {x: n for x, n in here.items() if n / len(toxic) >= TIMES * (there[x] + 0.5) / max(1, len(ordinary))}


def fit_logistic(x: np.ndarray, y: np.ndarray, share: float) -> np.ndarray:
    """Weights and constant; rows are weighted so that ``share`` of them is positive."""
    x = np.column_stack([x, np.ones(len(x))])
    weight = np.where(y == 1, share / max(y.mean(), 1e-9), (1 - share) / max(1 - y.mean(), 1e-9))
    w, ridge = np.zeros(x.shape[1]), np.diag([0.2] * (x.shape[1] - 1) + [1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge, x.T @ (weight * (y - p)) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def dictionaries(bad: list[list[bytes]], good: list[list[bytes]], rng: random.Random) -> tuple[bytes, bytes, bytes]:
    """Common stretch, toxic and ordinary dictionary of some documents' words."""
    toxic = b"".join(x for x, _ in sorted(marked_strings(bad, good).items(), key=lambda x: (x[1], x[0])))[-TOXIC:]
    plain = [b" " + b" ".join(w[i : i + 8]) + b" " for w in good for i in range(0, len(w), 32)]
    rng.shuffle(plain)
    return b"".join(plain)[:COMMON], toxic, trained(plain[-4000:], DICTIONARY) if plain else b""


def train(toxic: list[str], ordinary: list[str], share: float, seed: int = 5) -> Model:
    """Dictionaries of all rows. The curve is fitted on evidence that each half of the rows gets from dictionaries of the
    other half, so that no row is judged by itself."""
    rng = random.Random(seed)
    bad, good = [windows_of(t) for t in dict.fromkeys(toxic)], [windows_of(t) for t in dict.fromkeys(ordinary)]
    x, y = [], []
    for half in (0, 1):
        savings = Savings(*dictionaries(bad[half::2], good[half::2], rng))
        for docs, mark in ((bad[1 - half :: 2], 1), (good[1 - half :: 2], 0)):
            x += [evidence(w, savings) for w in docs]
            y += [mark] * len(docs)
    x, y = np.array(x), np.array(y)
    weights = fit_logistic(x, y, share)
    highest = np.quantile(x[y == 0] @ weights[:-1] + weights[-1], 1 - FALSE_ALARMS) if (y == 0).any() else 0.0
    weights[-1] += min(0.0, np.log(THRESHOLD / (1 - THRESHOLD)) - highest)
    return Model(*dictionaries(bad, good, rng), tuple(map(float, weights)))


def labelled_sample(docs: DataFrame, labels: DataFrame, text: str, key: str) -> tuple[list[str], list[str], float]:
    """Toxic and ordinary texts, chosen by a hash of the key, and the share of toxic labels among all that may be learnt."""
    spark = docs.sparkSession
    known = labels.where(F.col("toxic").isin(0, 1) & F.col(key).isNotNull() & ~held_out(key)).groupBy(key).agg(F.max("toxic").alias("toxic"))
    n = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    side = {}
    for mark, most in ((1, TOXIC_ROWS), (0, ORDINARY_ROWS)):
        h = F.xxhash64(key)
        some = known.where((F.col("toxic") == mark) & below(h, most, n.get(mark, 0)))
        for r in some.orderBy(F.pmod(h, F.lit(1 << 40)), key).limit(most).select(key).collect():
            side[r[0]] = mark
    if not side:
        return [], [], 0.0
    # from Arrow, which unlike rows needs no Python workers of its own
    ids = spark.createDataFrame(pa.table({key: pa.array(sorted(side))}), f"`{key}` {docs.schema[key].dataType.simpleString()}")
    cut = F.expr(f"substring(`{text}`, 1 + pmod(xxhash64(`{key}`), greatest(1, length(`{text}`) - {EXCERPT})), {EXCERPT})")
    rows = docs.where(F.col(text).isNotNull()).join(F.broadcast(ids), key).select(key, cut.alias("t")).orderBy(key, "t").limit(2 * len(side)).collect()
    return [r["t"] for r in rows if side[r[key]] == 1], [r["t"] for r in rows if side[r[key]] == 0], n.get(1, 0) / max(1, sum(n.values()))


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id") -> Model | float:
    """The model, or the share of toxic labels if there is nothing to tell apart."""
    bad, good, share = labelled_sample(docs, labels, text, key)
    return train(bad, good, min(max(share, 1e-4), 1 - 1e-4)) if bad and good else share


def score(docs: DataFrame, model: Model | float, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key``, ``held_out``, ``score`` and ``predicted`` of every text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            s = model.scores(b["_text"].tolist()) if isinstance(model, Model) else np.full(len(b), float(model))
            yield pd.DataFrame({key: b[key].to_numpy(), "held_out": b["held_out"].to_numpy(), "score": s, "predicted": (s >= THRESHOLD).astype(np.int32)})

    kind = docs.schema[key].dataType.simpleString()
    src = docs.select(key, F.coalesce(held_out(key), F.lit(False)).alias("held_out"), F.coalesce(text, F.lit("")).alias("_text"))
    return src.mapInPandas(tidy(run), f"`{key}` {kind}, held_out boolean, score double, predicted int")


def keep_ordinary(docs: DataFrame, model: Model | float, text: str = "text") -> DataFrame:
    """``docs`` without the rows predicted to be toxic."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            s = model.scores([t or "" for t in b[text]]) if isinstance(model, Model) else np.full(len(b), float(model))
            yield b[s < THRESHOLD]

    return docs.mapInPandas(tidy(run), docs.schema)
