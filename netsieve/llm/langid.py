"""Language identification: averaged hashed subword embeddings with a linear softmax, trained by SGD in numpy.

A text is the mean of the embeddings of its character 1- to 4-grams (within words, boundaries included, hashed into
``BUCKETS``); a linear layer and softmax give the languages. Training draws a bounded sample of labelled rows (the
bound is a parameter), cut into excerpts. Beyond the training, embeddings times weights is one table of numbers per
bucket, so scoring is a sum of looked-up rows over whole texts. A temperature fitted on excerpts kept aside calibrates
the probabilities, and the threshold below which a prediction is marked as rejected is their lowest percentile.

A text that is null or has no letter is ``und`` with score 0. With no labelled row at all every text is ``und``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from netsieve.llm.bpe import LETTER, char_classes
from netsieve.llm.textops import U64, chunks, code_points, mix

BUCKETS, DIM, SIZES = 1 << 17, 16, (1, 2, 3, 4)
SAMPLE = 4000  # labelled rows that training reads at most
EXCERPT, EXCERPTS = 240, 2  # characters of a training excerpt; excerpts per row
EPOCHS, BATCH, RATE = 4, 64, 4.0
REJECT = 0.005  # share of correct excerpts that the rejection threshold gives up
BLOCK = 1 << 20
SEED = 7


def grams(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all grams by letter runs, the position each begins at, and which characters are letters."""
    letter = char_classes()[codes] == LETTER
    c = np.where(letter, codes, 32).astype(U64)
    buckets, places = [], []
    h = np.zeros(len(c), U64)
    for n in range(1, max(SIZES) + 1):
        if len(c) < n:
            break
        h = h[: len(c) - n + 1] * U64(0x100000001B3) + c[n - 1 :]
        if n not in SIZES:
            continue
        first, last = letter[: len(h)], letter[n - 1 :]
        use = first | last if n > 1 else first
        for k in range(1, n - 1):  # a space inside would join two words
            use = use & letter[k : k + len(h)]
        at = np.flatnonzero(use)
        buckets.append((mix(h[at] + U64(n << 40)) & U64(BUCKETS - 1)).astype(np.int64))
        places.append(at)
    if not buckets:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), letter
    return np.concatenate(buckets), np.concatenate(places), letter


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # BUCKETS x languages
    bias: np.ndarray
    temperature: float
    threshold: float

    def scores(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities of the languages, and which texts have a letter."""
        k = len(self.languages)
        out, some = np.zeros((len(texts), k)), np.zeros(len(texts), bool)
        own = [t or "" for t in texts]
        for lo, hi in chunks([len(t) for t in own], BLOCK):
            codes = code_points("\n".join(own[lo:hi]))
            bucket, at, letter = grams(codes)
            if not letter.any():
                continue
            end = np.cumsum([len(t) + 1 for t in own[lo:hi]])
            doc = np.searchsorted(end, at, side="right")
            n = np.bincount(doc, minlength=hi - lo)
            rows = self.table[bucket]
            total = np.column_stack([np.bincount(doc, weights=rows[:, j], minlength=hi - lo) for j in range(k)])
            some[lo:hi] = np.bincount(np.searchsorted(end, np.flatnonzero(letter), side="right"), minlength=hi - lo) > 0
            out[lo:hi] = total / np.maximum(n, 1)[:, None] + self.bias
        return softmax(out / self.temperature), some


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def train(texts: list[str], langs: list[str], seed: int = SEED) -> Model:
    """SGD on excerpts; every fifth row is kept aside for the temperature and the threshold."""
    rng = np.random.default_rng(seed)
    names = sorted(set(langs))
    bags, labels, aside = [], [], []
    for i, (t, lang) in enumerate(zip(texts, langs, strict=True)):
        for _ in range(EXCERPTS):
            s = int(rng.integers(0, max(1, len(t) - EXCERPT + 1)))
            size = int(rng.integers(20, EXCERPT + 1))
            bucket = grams(code_points(" " + t[s : s + size] + " "))[0]
            if len(bucket):
                bags.append(bucket)
                labels.append(names.index(lang))
                aside.append(i % 5 == 0)
    labels, aside = np.array(labels, np.int64), np.array(aside, bool)
    emb, w, b = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32), np.zeros((DIM, len(names)), np.float32), np.zeros(len(names), np.float32)
    learn = np.flatnonzero(~aside) if (~aside).any() else np.arange(len(labels))
    weight = len(learn) / np.maximum(np.bincount(labels[learn], minlength=len(names)), 1) / len(names) if len(learn) else np.ones(len(names))
    steps, done = max(1, EPOCHS * -(-len(learn) // BATCH)), 0
    for _ in range(EPOCHS):
        for _ in range(0, len(learn), BATCH):
            some = learn[rng.integers(0, len(learn), BATCH)]
            rate = RATE * (1 - done / steps)
            done += 1
            flat = np.concatenate([bags[j] for j in some])
            size = np.array([len(bags[j]) for j in some])
            owner = np.repeat(np.arange(len(some)), size)
            mean = np.add.reduceat(emb[flat], np.cumsum(size) - size, axis=0) / size[:, None]
            grad = softmax(mean @ w + b)
            grad[np.arange(len(some)), labels[some]] -= 1
            grad *= np.minimum(weight[labels[some]], 5)[:, None] / len(some)
            back = ((grad @ w.T) / size[:, None]).astype(np.float32)
            w -= (rate * mean.T @ grad).astype(np.float32)
            b -= (0.1 * rate * grad.sum(0)).astype(np.float32)
            order = np.argsort(flat, kind="stable")
            touched, at = np.unique(flat[order], return_index=True)
            emb[touched] -= rate * len(some) * np.add.reduceat(back[owner[order]], at, axis=0)
    table = emb @ w
    kept = np.flatnonzero(aside)
    raw = np.array([table[bags[j]].mean(0) + b for j in kept]).reshape(len(kept), len(names))
    temperature, threshold = 1.0, 0.0
    if len(kept):
        loss = {t: -np.log(softmax(raw / t)[np.arange(len(kept)), labels[kept]] + 1e-12).mean() for t in (0.5, 0.7, 1.0, 1.4, 2.0, 3.0)}
        temperature = min(loss, key=loss.get)
        p = softmax(raw / temperature)
        right = p.argmax(1) == labels[kept]
        threshold = float(np.quantile(p.max(1)[right], REJECT)) if right.any() else 0.0
    return Model(names, table.astype(np.float32), b, temperature, threshold)


def held_out(key: str) -> F.Column:
    return (F.crc32(F.col(key).cast("string").cast("binary")) % 4) == 2


def below(h: F.Column, sample: int, total: int) -> F.Column:
    """Rows whose hash lies in a share that holds about twice the sample, so that tasks hand on that much in all."""
    return F.pmod(h, F.lit(1 << 40)) < int((1 << 40) * min(1.0, 2 * sample / max(1, total)))


def training_rows(docs: DataFrame, sample: int = SAMPLE, text: str = "text", label: str = "lang", key: str = "doc_id") -> tuple[list[str], list[str]]:
    """A bounded sample of labelled texts that are not held out, chosen by a hash of the key; whole texts are cut to a
    stretch that holds the excerpts, at a place that the hash decides."""
    room = 4 * EXCERPT
    labelled = docs.where(F.col(label).isNotNull() & ~F.coalesce(held_out(key), F.lit(False)))
    h = F.xxhash64(F.lit(SEED), key)
    rows = (
        labelled.where(below(h, sample, labelled.count()) & (F.length(text) > 0))
        .select(h.alias("h"), F.col(label).alias("lang"), F.col(text).alias("t"))
        .withColumn("t", F.expr(f"substring(t, 1 + pmod(h, greatest(1, length(t) - {room})), {room})"))
        .orderBy(F.pmod("h", F.lit(1 << 40)), "h", "lang", "t")
        .limit(sample)
        .collect()
    )
    return [r["t"] for r in rows], [r["lang"] for r in rows]


def identify(docs: DataFrame, text: str = "text", label: str = "lang", key: str = "doc_id", sample: int = SAMPLE) -> DataFrame:
    """Train on a sample of ``docs`` and score all of them: ``key``, ``held_out``, ``lang_pred``, ``score``, ``rejected``."""
    texts, langs = training_rows(docs, sample, text, label, key)
    model = train(texts, langs) if texts else None
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x languages numbers

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for b in batches:
            if m is None:
                pred, score = ["und"] * len(b), np.zeros(len(b))
            else:
                p, some = m.scores(b["_text"].tolist())
                best = p.argmax(1)
                pred = [m.languages[j] if s else "und" for j, s in zip(best, some, strict=True)]
                score = np.where(some, p.max(1), 0.0)
            low = m.threshold if m else 1.0
            yield pd.DataFrame({key: b[key].to_numpy(), "held_out": b["held_out"].to_numpy(), "lang_pred": pred, "score": score, "rejected": score < low})

    kind = docs.schema[key].dataType.simpleString()
    src = docs.select(key, F.coalesce(held_out(key), F.lit(False)).alias("held_out"), F.col(text).alias("_text"))
    return src.mapInPandas(run, f"`{key}` {kind}, held_out boolean, lang_pred string, score double, rejected boolean")
