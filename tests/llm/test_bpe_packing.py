"""Encoding against the tokenizers library; packing by its invariants and against a plain first fit."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from netsieve.llm import bpe, packing, textops
from netsieve.llm.queries import op2, op5
from tokenizers import Tokenizer

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def encoder():
    return bpe.encoder(PATH)


def odd_texts(n=1500):
    rng = random.Random(1)
    letters = " '\nabstmdrelv.,!?19éß日😀\t  \x1c\x0b"
    out = ["", " ", "  ", "\n", "it's 'round we'll they've I'M don''t", "a  b   c\n\n d\t\te ", "'s", "x'", "'re're'll", " 's", "\n's"]
    out += ["<|endoftext|>x<|endoftext|><|endoftext|> y", "a" * 5000 + "!" * 300 + " " * 100, "ſ'ſ K'd", "\x00\x1c\x85\xa0b"]
    out += ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(n)]
    return out + ["".join(chr(rng.choice([rng.randint(1, 0x2FF), rng.randint(0x300, 0xD7FF), rng.randint(0xE000, 0x10FFFF)])) for _ in range(40)) for _ in range(n // 5)]


def test_ids_equal_the_library(encoder, library):
    texts = odd_texts()
    for text, ids in zip(texts, encoder.encode(texts), strict=True):
        want = library.encode(text, add_special_tokens=False).ids
        assert ids.tolist() == want, repr(text)
        assert encoder.decode(ids) == library.decode(want, skip_special_tokens=False)


def test_decode_replaces_broken_bytes(encoder, library):
    for text in ("😀", "日本"):
        ids = library.encode(text, add_special_tokens=False).ids
        for cut in range(len(ids)):
            assert encoder.decode(np.array(ids[:cut], np.int64)) == library.decode(ids[:cut], skip_special_tokens=False)


def test_some_words_need_exact_merging(encoder):
    words = ["disgustingly", "erthndhaha", "unhappiness", "tokenization"] * 3
    data = np.frombuffer("".join(words).encode(), np.uint8)
    ends = np.cumsum([len(w) for w in words])
    assert 0 < encoder.words(data, ends - [len(w) for w in words], ends)[2] <= len(words)


def test_op5_on_whole_table(spark, sf, texts, library):
    got = {r["doc_id"]: r for r in op5(spark, sf).collect()}
    assert got.keys() == texts.keys()
    for k, t in texts.items():
        want = library.encode(t, add_special_tokens=False).ids
        assert got[k]["n_tokens"] == len(want)
        assert got[k]["ids_sha256"] == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert got[k]["decoded_sha256"] == hashlib.sha256(library.decode(want, skip_special_tokens=False).encode()).hexdigest()


def alike(bits=10):
    """Two different words that a polynomial hash modulo 2**64 cannot tell apart, whatever its base."""
    word = "".join("ab"[i.bit_count() & 1] for i in range(1 << bits))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_words_with_equal_hashes(encoder, library):
    a, b = alike()
    lo, hi = np.array([0, len(a)]), np.array([len(a), 2 * len(a)])
    x, y = textops.span_hashes(np.frombuffer((a + b).encode(), np.uint8), lo, hi).tolist()
    assert x == y
    for texts in ([f"{a} {b}"], [f"{a}\n{b}\n{b} {a}"], [f"{a} {a}", f"{b} {b}", f"{a} {b}"], [a, b]):
        for _ in range(2):  # the second time from what earlier blocks left
            for text, ids in zip(texts, encoder.encode(texts), strict=True):
                assert ids.tolist() == library.encode(text, add_special_tokens=False).ids and encoder.decode(ids) == text
    # a block that knows one of the two meets the other
    fresh = bpe.Encoder(PATH)
    for text in (f"{a} {a}", f" {b} {b}", f"{b} {a}"):
        (ids,) = fresh.encode([text])
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids


def test_op5_and_op2_tell_words_with_equal_hashes_apart(spark, frame, library):
    a, b = alike()
    rows = [(1, f"word {a}\n{b}"), (2, a), (3, b), (4, f" {b} {a}")]
    for r in bpe.id_digests(frame(rows), PATH).collect():
        want = library.encode(dict(rows)[r["doc_id"]], add_special_tokens=False).ids
        assert r["ids_sha256"] == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
    check_packing(packing.pack_documents(frame(rows), PATH, with_ids=False).collect(), dict(rows), library, slack=2)


def test_op2_on_whole_table(spark, sf, texts, library):
    check_packing(op2(spark, sf).collect(), texts, library, slack=1.01)


def check_packing(rows, texts, library, slack):
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    assert by_doc.keys() == texts.keys()
    for k, own in by_doc.items():
        ids = np.array(library.encode(texts[k] or "", add_special_tokens=False).ids + [2], "<u4")
        own.sort(key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(len(own)))
        at = 0
        for r in own:
            assert r["start"] == at and (r["length"] == 1024 or r["piece"] == 0)
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids) and (len(own) == 1) == (len(ids) <= 1024)
    for own in by_seq.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024
    sizes = [r["length"] for r in rows]
    assert len(by_seq) <= slack * len(packing.pack_sizes(sizes, 1024, 0)) + 1  # all pieces in one task, best fit only


def test_null_empty_tie_and_repeated_rows(spark, frame, library):
    rows = [(1, None), (2, ""), (3, "a b"), (4, "a b"), (5, "word " * 3000)]
    check_packing(packing.pack_documents(frame(rows), PATH, with_ids=False).collect(), dict(rows), library, slack=2)
    got = {r["doc_id"]: list(r["ids"]) for r in packing.pack_documents(frame(rows[:4]), PATH).collect()}
    assert got[1] == [2] and got[3] == got[4]
    assert bpe.id_digests(frame(rows + rows), PATH).count() == 10
    out = {r["doc_id"]: r for r in bpe.encode_documents(frame(rows), PATH).collect()}
    assert out[1]["decoded"] == "" and out[5]["decoded"] == "word " * 3000


def test_empty_table(spark, frame):
    none = frame([(1, "x")]).where("false")
    assert packing.pack_documents(none, PATH).count() == 0 and bpe.id_digests(none, PATH).count() == 0


def test_local_search_beats_best_fit():
    rng = random.Random(4)
    better = 0
    for seed in range(20):
        sizes = [rng.randint(200, 700) for _ in range(300)]
        plain, searched = packing.pack_sizes(sizes, 1024, 0), packing.pack_sizes(sizes, 1024, 8)
        assert sorted(i for own in searched for i in own) == list(range(300))
        assert all(sum(sizes[i] for i in own) <= 1024 for own in searched)
        assert len(searched) <= len(plain)
        better += len(searched) < len(plain)
    assert better


def test_cut():
    assert packing.cut(5, 1024) == [(0, 5)] and packing.cut(1024, 1024) == [(0, 1024)]
    assert packing.cut(2049, 1024) == [(0, 1), (1, 1024), (1025, 1024)] and packing.cut(2048, 1024) == [(0, 1024), (1024, 1024)]
