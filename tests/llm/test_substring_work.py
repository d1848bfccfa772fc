"""What the paragraph dedup computes per text: each thing once, for a block of texts together."""

import random

import numpy as np
import pandas as pd
import xxhash

from netsieve.llm import substrings, textops


def counted(monkeypatch, name):
    """The lengths that a function of the module was called with."""
    calls, plain = [], getattr(substrings, name)
    monkeypatch.setattr(substrings, name, lambda h, *more: calls.append(len(h)) or plain(h, *more))
    return calls


def some_words(seed, n):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(5000)}" for _ in range(n))


def test_a_block_of_texts_is_shingled_once(monkeypatch):
    w = substrings.Words([some_words(i, 80) for i in range(30)])
    calls = counted(monkeypatch, "windows")
    begin, _, _, _ = substrings.paragraphs(w)
    at, _ = substrings.stretches(w)
    assert len(begin) == 30 and len(at) >= 60
    assert calls == [2400]


def test_paragraphs_of_a_batch_are_shingled_together(monkeypatch):
    texts = [some_words(i, 60) for i in range(300)]
    texts += [t.replace(t.split()[30], "other", 1) for t in texts[:100]] + ["one " * 25]
    words = [textops.word_hashes(t) for t in texts]
    rows = pd.DataFrame({"key": [i % 300 for i in range(401)], "lo": 0, "hi": 0, "part": 0, "whole": range(401), "words": [h.tobytes() for h in words]})
    rows = pd.concat([rows, rows.assign(key=rows["key"] + 1000)], ignore_index=True)  # they meet in two bands
    calls = counted(monkeypatch, "windows")
    got = substrings.matched(rows)
    assert calls == [sum(map(len, words))]
    sets = [{tuple(h[i : i + 5].tolist()) for i in range(len(h) - 4)} for h in words]
    near = {(i, i + 300) for i in range(100) if len(sets[i] & sets[i + 300]) >= 0.8 * len(sets[i] | sets[i + 300])}
    assert len(near) > 50
    assert {(min(p), max(p)) for p in zip(got["a"], got["b"])} == near


def test_words_are_hashed_as_they_stand():
    r = random.Random(5)
    letters = ["a", "b", "é", "中", "😀", "\ud800", "\x00", "\x85", "«", "’", *map(chr, textops.SPACES.tolist())]
    for _ in range(3000):
        text = "".join(r.choices(letters, k=r.randrange(30)))
        want = [xxhash.xxh3_64_intdigest(x.encode("utf-8", "surrogatepass"), 1) for x in text.split()]
        assert textops.word_hashes(text).tolist() == want
    assert textops.word_hashes("").dtype == np.uint64


def test_documents_that_share_an_id_when_keys_are_many(spark, frame, monkeypatch):
    monkeypatch.setattr(substrings, "KEYS", 0)
    passage = some_words(1, 70)
    rows = [(1, some_words(2, 30) + " " + passage), (2, some_words(3, 400) + " " + passage + " end"), (2, "short")]
    got = substrings.duplicate_spans(frame(rows)).collect()
    assert {(r["doc_id"], r["start_word"], r["n_words"], r["kept_doc_id"], r["kept_start_word"]) for r in got} == {(2, 400, 70, 1, 30)}
