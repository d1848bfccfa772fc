"""What the pipeline's stages keep in the executors' Python workers."""

import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark import SparkContext

import corpus_pipeline
from netsieve.llm import bpe, substrings, textops, toxicity
from netsieve.session import BATCH_BYTES, bound_batches


@pytest.fixture()
def default_batches(spark):
    spark.conf.unset(BATCH_BYTES[0])
    yield spark
    spark.conf.unset(BATCH_BYTES[0])


@pytest.mark.parametrize("stage", ["secrets", "packing"])
def test_stages_get_long_texts_in_small_batches(default_batches, stage):
    docs = default_batches.range(0, 1000, 1, 1).selectExpr("id AS doc_id", "repeat('some words ', 2000) AS text", "'en' AS lang", "'x' AS source", "22000L AS n_chars")
    dict(corpus_pipeline.STAGES)[stage](default_batches, docs, "")

    def sizes(batches):
        for b in batches:
            yield pd.DataFrame({"n": [int(b["text"].str.len().sum())], "rows": [len(b)]})

    got = docs.mapInPandas(sizes, "n long, rows long").collect()
    assert sum(r["rows"] for r in got) == 1000
    assert max(r["n"] for r in got) <= 2 * int(BATCH_BYTES[1])


def test_a_batch_size_of_the_user_stays(default_batches):
    default_batches.conf.set(BATCH_BYTES[0], "1048576")
    bound_batches(default_batches)
    assert default_batches.conf.get(BATCH_BYTES[0]).rstrip("b") == "1048576"


def test_small_tables_need_no_workers_of_their_own(frame, spark, monkeypatch):
    passage = " ".join(f"word{i}" for i in range(80))
    docs = frame([(i, f"begin {i} {passage} end {i}") for i in range(1, 9)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 9)], "doc_id long, toxic int")
    monkeypatch.setattr(SparkContext, "parallelize", lambda *_, **__: pytest.fail("rows went through Python workers"))
    bad, good, _ = toxicity.labelled_sample(docs, labels, "text", "doc_id")
    assert bad and good
    spans = substrings.duplicate_spans(docs).where("kind = 'passage'").collect()
    assert {r["doc_id"] for r in spans} == set(range(2, 9)) and {r["kept_doc_id"] for r in spans} == {1}


def test_a_worker_keeps_one_model():
    model = toxicity.train(["awful nasty words here"] * 2 + ["nasty awful things"], ["plain words here", "good things there", "more plain words"], 0.3)
    other = toxicity.train(["vile rotten words"] * 2 + ["rotten vile things"], ["plain words there", "good things here", "more good words"], 0.3)
    for m in (model, other):
        m.scores(["plain words"])
    assert toxicity._savings.cache_info().currsize == 1


def most_held(work):
    tracemalloc.start()
    try:
        return work(), tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_a_crowded_band_is_compared_in_little_memory():
    rng = np.random.default_rng(1)
    words = np.tile(rng.integers(0, 1 << 63, 60, dtype=np.uint64), (1500, 1))
    words[np.arange(1500), rng.integers(0, 60, 1500)] = np.arange(1500)
    words[-1] = rng.integers(0, 1 << 63, 60, dtype=np.uint64)  # like none of the others
    rows = pd.DataFrame({"key": 7, "lo": 0, "hi": 0, "part": 0, "whole": np.arange(1500), "words": [w.tobytes() for w in words]})
    links, most = most_held(lambda: substrings.matched(rows))
    assert set(links["a"]) == set(range(1, 1499)) and set(links["b"]) == {0}
    assert most < 45


def test_classes_of_characters_need_no_string_each():
    bpe.char_classes.cache_clear()
    classes, most = most_held(bpe.char_classes)
    assert classes[[ord(c) for c in "a1 ."]].tolist() == [bpe.LETTER, bpe.DIGIT, bpe.SPACE, bpe.OTHER] and (classes[0xD800:0xE000] == bpe.OTHER).all()
    assert most < 40


def test_a_worker_gives_back_what_is_free_behind_a_task(monkeypatch):
    done = []
    monkeypatch.setattr(textops, "release", lambda: done.append("released"))
    for _ in textops.tidy(lambda batches: (b + 1 for b in batches))(iter([1, 2])):
        done.append("batch")
    assert done == ["batch", "batch", "released"]
