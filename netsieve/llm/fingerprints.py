"""Document fingerprints by consistent weighted sampling.

Terms are 5-word shingles of the lower-cased text (a shorter text is one term), weighted by how often they occur. For
every sample a term gets two gamma-distributed numbers and a uniform one from its hash; its weight is quantised on the
grid they set up, and the term with the smallest resulting value is the sample. The chance that two texts have a
sample in common is their generalised Jaccard similarity, the sum of smaller weights over the sum of larger ones.

A fingerprint is ``SAMPLES`` 16-bit numbers in hexadecimal. Null counts as empty; a text without words has the all-zero
fingerprint, which is like itself (1) and unlike all others (0). Equal texts have equal fingerprints.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from netsieve.llm.textops import U64, chunks, code_points, mix, windows, word_hashes, words
from netsieve.session import materialize

SAMPLES, SHINGLE = 64, 5
BLOCK = 1 << 19  # characters of texts sampled at once
SLICE = 1 << 13  # terms drawn at once, so that the numbers stay in the processor's cache
_KEYS = mix(np.arange(1, 2 * SAMPLES + 1).astype(U64) * U64(0x9E3779B97F4A7C15))


def weighted_terms(texts: list[str], k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, term hash and count, by text."""
    own = [t.lower() for t in texts]
    whole = "\n".join(own)
    lo, _ = words(code_points(whole))
    if not len(lo):
        return np.zeros(0, np.int64), np.zeros(0, U64), np.zeros(0, np.int64)
    doc = np.searchsorted(np.cumsum([len(t) + 1 for t in own]), lo, side="right")
    h = word_hashes(whole)
    term = windows(h, k)
    inside = doc[: len(term)] == doc[k - 1 :] if len(term) else np.zeros(0, bool)
    docs, terms = [doc[: len(term)][inside]], [term[inside]]
    n = np.bincount(doc, minlength=len(own))
    first = np.cumsum(n) - n
    for d in np.flatnonzero((n > 0) & (n < k)):
        docs.append(np.array([d]))
        terms.append(windows(h[first[d] : first[d] + n[d]], int(n[d])))
    doc, term = np.concatenate(docs), np.concatenate(terms)
    order = np.lexsort((term, doc))
    doc, term = doc[order], term[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (term[1:] != term[:-1])
    at = np.flatnonzero(new)
    return doc[at], term[at], np.diff(np.append(at, len(doc)))


def _uniform(bits: np.ndarray, width: int) -> np.ndarray:
    """Numbers in (0, 1) from the low ``width`` bits."""
    return ((bits & U64((1 << width) - 1)).astype(np.float32) + np.float32(0.5)) * np.float32(2.0**-width)


def _draw(term: np.ndarray, key: np.uint64) -> np.ndarray:
    """Fresh bits of well-mixed hashes."""
    x = (term ^ key) * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(32)
    x *= U64(0x94D049BB133111EB)
    return x ^ (x >> U64(29))


def sample_values(term: np.ndarray, log_weight: np.ndarray | None, k: int) -> np.ndarray:
    """The values among which sample ``k`` takes the smallest. A value names its term and grid step.

    No ``log_weight``: all weights are 1, so the grid step is 0."""
    a, b = _draw(term, _KEYS[2 * k]), _draw(term, _KEYS[2 * k + 1])
    r = -np.log(_uniform(a, 20) * _uniform(a >> U64(20), 20))
    log_c = np.log(-np.log(_uniform(b, 20) * _uniform(b >> U64(20), 20)))
    beta = _uniform(b >> U64(41), 23)
    step = np.float32(0) if log_weight is None else np.floor(log_weight / r + beta)
    return log_c - r * (step - beta) - r


def signatures(texts: list[str]) -> np.ndarray:
    """One row of ``SAMPLES`` 16-bit numbers per text; rows of texts without words are 0."""
    out = np.zeros((len(texts), SAMPLES), np.uint16)
    doc, term, count = weighted_terms(texts)
    if not len(doc):
        return out
    back = np.zeros(len(doc), np.int64)
    values, used = [], 0
    for some, heavy in ((count == 1, False), (count > 1, True)):
        if not some.any():
            continue
        if heavy:
            pair, inverse = np.unique(np.rec.fromarrays([term[some], count[some]], names="t,w"), return_inverse=True)
            each, weight = pair["t"].copy(), np.log(pair["w"].astype(np.float32))
        else:
            each, inverse = np.unique(term[some], return_inverse=True)
            weight = None
        back[some] = inverse + used
        used += len(each)
        part = np.empty((SAMPLES, len(each)), np.float32)
        for lo in range(0, len(each), SLICE):
            hi = lo + SLICE
            for k in range(SAMPLES):
                part[k, lo:hi] = sample_values(each[lo:hi], None if weight is None else weight[lo:hi], k)
        values.append(part)
    every = np.concatenate(values, axis=1) if len(values) > 1 else values[0]
    has, first = np.unique(doc, return_index=True)
    for k in range(SAMPLES):
        least = np.minimum.reduceat(every[k][back], first)
        out[has, k] = (mix(least.view(np.uint32).astype(U64) + U64(k << 32)) % U64(0xFFFF)).astype(np.uint16) + 1
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The share of equal samples, row by row; rows of zeros are like each other only."""
    return (a == b).mean(1)


def hexed(sig: np.ndarray) -> list[str]:
    return [row.tobytes().hex() for row in sig.astype(">u2")]


def edit(text: str, after: str) -> str:
    """``text`` with its last half replaced by as much of the beginning of ``after``."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def compare(pairs: list[tuple[object, str, str]], key: str) -> Iterator[pd.DataFrame]:
    """Result rows for (key, text, next text)."""
    for lo, hi in chunks([2 * len(t) for _, t, _ in pairs], BLOCK):
        some = pairs[lo:hi]
        edited = [edit(t, n) for _, t, n in some]
        # mostly the next text is that of the next row
        texts = list(dict.fromkeys(x for _, t, a in some for x in (t, a)))
        place = {t: i for i, t in enumerate(texts)}
        sig = signatures(texts + edited)
        own, after, changed = sig[[place[t] for _, t, _ in some]], sig[[place[a] for _, _, a in some]], sig[len(texts) :]
        yield pd.DataFrame(
            {
                key: [k for k, _, _ in some],
                "n_chars": np.array([len(t) for _, t, _ in some], np.int64),
                "edited_sha256": [hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest() for e in edited],
                "fingerprint": hexed(own),
                "edited_fingerprint": hexed(changed),
                "near_edited": likeness(own, changed),
                "near_next": likeness(own, after),
            }
        )


def fingerprint(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key`` and ``fingerprint`` of every text."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = b["_text"].tolist()
            for lo, hi in chunks([len(t) for t in texts], BLOCK):
                yield pd.DataFrame({key: b[key].iloc[lo:hi].to_numpy(), "fingerprint": hexed(signatures(texts[lo:hi]))})

    return docs.selectExpr(f"`{key}`", f"coalesce(`{text}`, '') AS _text").mapInPandas(run, f"`{key}` {kind}, fingerprint string")


def fingerprint_with_edit(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Fingerprints of every text and of its edited text, made with the next document in descending ``key``.

    Texts are dealt over tasks by ranges of the key and sorted there, once; a task sees all neighbours but the one
    behind its last row. The first and last text of each task meet in a small second step. Rows without a key come
    last. Results of the first step are written to the shared folder.
    """
    spark = docs.sparkSession
    kind = docs.schema[key].dataType.simpleString()
    result = f"`{key}` {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def inner(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, last = TaskContext.get().partitionId(), None
        for b in batches:
            rows = list(zip(b[key].tolist(), b["_text"].tolist(), strict=True))
            if last is None and rows:
                yield pd.DataFrame({key: [rows[0][0]], "_text": [rows[0][1]], "_part": [part], "_role": ["head"]})
            if last is not None:
                rows = [last, *rows]
            if rows:
                last = rows[-1]
            yield from compare([(k, t, after) for (k, t), (_, after) in zip(rows, rows[1:])], key)
        if last is not None:
            yield pd.DataFrame({key: [last[0]], "_text": [last[1]], "_part": [part], "_role": ["tail"]})

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cols = [c.split()[0].strip("`") for c in result.split(", ")] + ["_text", "_part", "_role"]
        for b in inner(batches):
            yield pd.DataFrame({c: b[c].astype(object) if c in b else pd.Series([None] * len(b), dtype=object) for c in cols})

    src = docs.selectExpr(f"`{key}`", f"coalesce(`{text}`, '') AS _text").repartitionByRange(n, F.col(key).desc_nulls_last())
    made = materialize(src.sortWithinPartitions(F.col(key).desc_nulls_last(), "_text").mapInPandas(whole, f"{result}, _text string, _part int, _role string"), "fingerprints")
    edges = made.where("_role IS NOT NULL")
    parts = sorted(r[0] for r in edges.where("_role = 'head'").select("_part").collect())  # one number per task
    follow = spark.createDataFrame(list(zip(parts, parts[1:] + parts[:1])), "_part int, _next int")
    heads = edges.where("_role = 'head'").select(F.col("_part").alias("_next"), F.col("_text").alias("_after"))
    pairs = edges.where("_role = 'tail'").select(key, "_text", "_part").join(follow, "_part").join(heads, "_next").select(key, "_text", "_after")

    def outer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield from compare(list(zip(b[key].tolist(), b["_text"].tolist(), b["_after"].tolist(), strict=True)), key)

    done = made.where("_role IS NULL").drop("_text", "_part", "_role")
    return done.unionByName(pairs.mapInPandas(outer, result))
