"""Vector codes, hash-tree shards and whitening against brute force, on the whole tables and on odd rows."""

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from netsieve.llm import codes, sharding, whitening
from netsieve.llm.queries import op11, op12, op13
from netsieve.llm.vectors import kept_vectors
from pyspark.sql import functions as F


def plain_codes(rows, entries=256, parts=4, rounds=4):
    """(id, label, vector) rows coded one after another: {row number: (codes, error)} and the codebooks."""
    v = np.array([[math.floor(1024 * float(c)) for c in r[2]] for r in rows], np.int64)
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, v[i].tolist()))
    width = v.shape[1] // parts
    cut = [v[:, p * width : (p + 1) * width] for p in range(parts)]
    books = [own[order[:entries]].copy() for own in cut]

    def assign():
        dist = [((own[:, None, :] - book[None]) ** 2).sum(2) for own, book in zip(cut, books, strict=True)]
        return [d.argmin(1) for d in dist], [d.min(1) for d in dist]

    for _ in range(rounds):
        at, _ = assign()
        for p, book in enumerate(books):
            for e in set(at[p].tolist()):
                book[e] = [int(s) // int((at[p] == e).sum()) for s in cut[p][at[p] == e].sum(0)]
    at, error = assign()
    return ["".join(f"{a[i]:02x}" for a in at) for i in range(len(rows))], sum(error), books


def check_codes(got, rows):
    want, errors, books = plain_codes(rows)
    by_label = Counter()
    for r, e in zip(rows, errors, strict=True):
        by_label[r[1]] += int(e)
    sha = hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry.tolist()).encode()).hexdigest()
    have = sorted((str(r["vec_id"]), r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in got)
    assert have == sorted((str(r[0]), c, int(e), by_label[r[1]], sha) for r, c, e in zip(rows, want, errors, strict=True))


def test_op11_on_whole_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "label", "embedding").collect()]
    check_codes(op11(spark, sf).collect(), rows)


def vector_frame(spark, rows):
    """Vectors with extra columns named like those used inside."""
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    for name in ("id", "v", "x", "codes", "error", "n", "of", "component"):
        df = df.selectExpr("*", f"'x' AS `{name}`")
    return df.repartition(3)


def odd_vectors(width=8):
    rng = np.random.default_rng(3)
    good = [(int(i), None if i % 3 == 0 else int(i % 2), [float(x) for x in rng.integers(-3, 3, width) / 4]) for i in range(60)]
    good += [good[5], good[5], (7, 1, [0.0] * width), (None, None, [0.5] * width), (None, 2, [-1.0 / 3] * width)]
    bad = [(100, 1, None), (101, 1, [None] + [0.0] * (width - 1)), (102, None, [float("nan")] * width), (103, 1, [float("-inf")] + [1.0] * (width - 1)), (104, 1, []), (105, 1, [1.0] * 4)]
    return good, bad


def test_codes_of_null_tie_and_repeated_rows(spark):
    good, bad = odd_vectors()
    check_codes(codes.code_rows(vector_frame(spark, good + bad)).collect(), good)


def test_codes_of_few_and_no_rows(spark):
    good, bad = odd_vectors()
    check_codes(codes.code_rows(vector_frame(spark, good[:1] + bad)).collect(), good[:1])
    assert codes.code_rows(vector_frame(spark, bad[:5])).count() == 0
    assert codes.code_rows(vector_frame(spark, [])).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]


@pytest.mark.parametrize("reach", [3, 900, 1 << 27])
def test_gnat_is_exact_with_ties(reach):
    rng = np.random.default_rng(reach)
    centres = rng.integers(-reach, reach, (12, 6))
    entries = np.vstack([centres[rng.integers(0, 12, 230)] + rng.integers(-2, 3, (230, 6)), centres, centres[:6], centres[:6]])
    tree = codes.Gnat(entries)
    parts = np.vstack([entries, rng.integers(-reach, reach, (500, 6)), centres[rng.integers(0, 12, 500)] + rng.integers(-3, 4, (500, 6))])
    at, best, seen = tree.nearest(parts)
    squares = ((parts[:, None] - entries[None]) ** 2).sum(2)
    assert (at == squares.argmin(1)).all() and (best == squares.min(1)).all()
    if reach > 3:  # subtrees are left out
        assert seen < 0.5 * squares.size


def test_gnat_of_equal_entries():
    tree = codes.Gnat(np.ones((100, 4), np.int64))
    at, best, _ = tree.nearest(np.arange(8).reshape(2, 4))
    assert at.tolist() == [0, 0] and best.tolist() == [6, 86]


def test_decode_returns_entries(spark):
    good, _ = odd_vectors()
    ints, width = codes.integer_vectors(vector_frame(spark, good[:40]))
    books = codes.fit_codebooks(ints, width, entries=4)
    for r in codes.decode(codes.encode(ints, books), books).collect():
        assert r["approximate"] == [x for p, c in enumerate(r["codes"]) for x in books.entries[p, c].tolist()]
        assert len(r["errors"]) == 4 and max(r["codes"]) < 4


def test_components_are_held_to_a_bound(spark):
    rows = [(1, 0, [1e300] * 8), (2, 0, [-3e38] * 8), (3, 0, [0.0] * 8)]
    assert {r["error"] for r in codes.code_rows(vector_frame(spark, rows)).collect()} == {0}
    assert whitening.whitened_rows(vector_frame(spark, rows)).where("whitened IS NOT NULL").count() > 0


# ---- shards


def plain_shard(key, tree):
    """The descent, one level after another."""
    text = "" if key is None else str(key)

    def winner(children):
        def draw(name, weight):
            bits = int(hashlib.md5(f"{text}@{name}".encode()).hexdigest()[: sharding.DIGITS], 16)
            return -math.log((bits + 0.5) / 16**sharding.DIGITS) / weight

        return min(children, key=lambda c: draw(*c))[0]

    live = [s for s in tree if s.weight > 0]
    weight = Counter()
    for s in live:
        weight[s.region] += s.weight
        weight[f"{s.region}/{s.rack}"] += s.weight
    region = winner([(r, weight[r]) for r in dict.fromkeys(s.region for s in live)])
    rack = winner([(k, weight[k]) for k in dict.fromkeys(f"{s.region}/{s.rack}" for s in live if s.region == region)])
    own = {f"{rack}/shard {s.number}": s for s in live if f"{s.region}/{s.rack}" == rack}
    return own[winner([(name, s.weight) for name, s in own.items()])].number


def check_shards(rows, docs):
    tree = sharding.TREE
    assert len(rows) == len(docs)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == Counter((k, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for k, t in docs)
    slots = {}
    for r in rows:
        assert r["law"] == "key" and r["shard"] == plain_shard(r["doc_id"], tree) and r["grown_shard"] == plain_shard(r["doc_id"], sharding.grown(tree))
        assert r["grown_shard"] in (r["shard"], 8)
        slots.setdefault(r["shard"], []).append(r)
    for own in slots.values():
        own.sort(key=lambda r: r["slot"])
        assert [r["slot"] for r in own] == list(range(len(own)))
        order = [(r["doc_id"] is not None, r["doc_id"] or 0, r["size"], r["text_crc32"]) for r in own]
        assert order == sorted(order)


def test_op12_on_whole_table(spark, sf, texts):
    check_shards(op12(spark, sf).collect(), list(texts.items()))


def test_shards_of_null_empty_long_and_repeated_rows(spark, frame):
    docs = [(1, None), (2, ""), (3, "é" * 300_000), (None, "x"), (None, None), (5, "same"), (5, "same"), (6, "same"), *[(9, "hot")] * 300]
    check_shards(sharding.document_rows(frame(docs).withColumn("shard", F.lit(1)).withColumn("_task", F.lit(2)).repartition(5)).collect(), docs)


def test_no_shards_of_an_empty_table(spark, frame):
    none = sharding.document_rows(frame([(1, "x")]).where("false"))
    assert none.count() == 0 and none.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]


def shards_of(spark, tree, n=6000):
    return [r[0] for r in spark.range(n).select("id", sharding.shard_of(F.col("id"), tree).alias("s")).orderBy("id").select("s").collect()]


def test_movement_stays_in_subtrees_whose_weights_change(spark):
    tree = sharding.grid(3, 2, 2)
    place = {s.number: (s.region, s.rack, s.number) for s in tree}
    heavy = [sharding.Shard(s.region, s.rack, s.number, 3.0 if s.number == 5 else s.weight) for s in tree]
    before, after = shards_of(spark, tree), shards_of(spark, heavy)
    moved = [(place[a], place[b]) for a, b in zip(before, after, strict=True) if a != b]
    assert moved
    for a, b in moved:  # the first level on which the places differ is one where the new place holds the changed shard
        level = next(i for i in range(3) if a[i] != b[i])
        assert b[level] == place[5][level]
    # One shard more takes rows only into itself, and its share of all.
    more = shards_of(spark, sharding.grown(tree))
    assert {b for a, b in zip(before, more, strict=True) if a != b} == {12}
    assert abs(more.count(12) / 6000 - 1 / 13) < 0.02
    assert all(abs(before.count(s) / 6000 - 1 / 12) < 0.02 for s in range(12))


def test_weights_set_the_shares(spark):
    tree = [sharding.Shard("a", "x", 0, 1.0), sharding.Shard("a", "y", 1, 2.0), sharding.Shard("b", "z", 2, 5.0), sharding.Shard("b", "z", 3, 0.0)]
    got = Counter(shards_of(spark, tree))
    assert set(got) == {0, 1, 2} and all(abs(got[s] / 6000 - w / 8) < 0.03 for s, w in ((0, 1), (1, 2), (2, 5)))
    with pytest.raises(ValueError, match="weight"):
        sharding.shard_of(F.lit(1), tree[3:])


def test_write_shards_keeps_whole_rows(spark, frame, tmp_path):
    docs = frame([(i, f"text {i}") for i in range(40)])
    sharding.write_shards(docs, sharding.TREE, f"{tmp_path}/out")
    back = spark.read.parquet(f"{tmp_path}/out")
    assert sorted((r["doc_id"], r["text"]) for r in back.collect()) == [(i, f"text {i}") for i in range(40)]
    assert all(r["_shard"] == plain_shard(r["doc_id"], sharding.TREE) for r in back.collect())


# ---- whitening


def check_whitened(got, rows, k=8):
    x = [[math.floor(1024 * float(c)) + 100_000 for c in v] for _, v in rows]
    n, width = len(x), len(x[0])
    sums = [sum(own[j] for own in x) for j in range(width)]
    y = np.array([[n * own[j] - sums[j] for j in range(width)] for own in x], object)
    c = np.array(y, float) / n
    values, vectors = np.linalg.eigh(c.T @ c / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(k, width)
    by_id = {}
    for r in got:
        by_id.setdefault(r["vec_id"], {})[r["component"]] = r
    assert len(got) == n * k and {r["n"] for r in got} == {n} and len({r["identity_error"] for r in got}) == 1
    ids = [i for i, _ in rows]
    for i, own in zip(ids, y, strict=True):
        if ids.count(i) == 1:
            assert {r["deviation"] for r in by_id[i].values()} == {sum(int(v) ** 2 for v in own)}
    for m in range(1, k + 1):
        share = values[m - 1] / values.sum() if values.sum() else 0
        if share < 1e-12:
            assert all(own[m]["whitened"] is None and own[m]["explained"] == pytest.approx(0, abs=1e-12) for own in by_id.values())
            continue
        assert next(iter(by_id.values()))[m]["explained"] == pytest.approx(share, rel=1e-9)
        gap = min([abs(values[m - 1] - v) for j, v in enumerate(values) if j != m - 1], default=1)
        if gap > 1e-6 * values[0]:  # otherwise any basis of the equal values' space is right
            want = {i: w for i, w in zip(ids, c @ vectors[:, m - 1] / math.sqrt(values[m - 1]), strict=True) if ids.count(i) == 1}
            have = np.array([by_id[i][m]["whitened"] for i in want])
            sign = np.sign(have @ np.array(list(want.values())))
            assert np.abs(sign * have - np.array(list(want.values()))).max() < 1e-6
    error = got[0]["identity_error"]
    if error is not None:
        assert error < 1e-9
        w = np.array([[by_id[i][m]["whitened"] for m in range(1, k + 1) if by_id[i][m]["whitened"] is not None] for i in ids], float)
        w = w - w.mean(0)
        if len(set(ids)) == n:
            assert np.abs(w.T @ w / n - np.eye(w.shape[1])).max() == pytest.approx(error, abs=1e-12)


def test_op13_on_whole_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    check_whitened(op13(spark, sf).collect(), rows)


def test_whitening_of_null_repeated_and_equal_rows(spark):
    good, bad = odd_vectors()
    check_whitened(whitening.whitened_rows(vector_frame(spark, good + bad)).collect(), [(r[0], r[2]) for r in good])


def test_whitening_without_variance(spark):
    same = [(i, 0, [0.25] * 8) for i in range(5)]
    got = whitening.whitened_rows(vector_frame(spark, same)).collect()
    assert len(got) == 40 and all(r["whitened"] is None and r["explained"] == 0 and r["deviation"] == 0 and r["identity_error"] is None for r in got)
    one = whitening.whitened_rows(vector_frame(spark, same[:1])).collect()
    assert len(one) == 8 and {r["n"] for r in one} == {1}


def test_fewer_components_and_few_rows(spark):
    few = [(i, 0, [float(i * i), 1.0, float(-i)]) for i in range(4)]
    check_whitened(whitening.whitened_rows(vector_frame(spark, few)).collect(), [(r[0], r[2]) for r in few])


def test_whitening_of_an_empty_table(spark):
    _, bad = odd_vectors()
    for rows in ([], bad[:5]):
        none = whitening.whitened_rows(vector_frame(spark, rows))
        assert none.count() == 0 and none.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_deviation_beyond_a_long():
    y = np.array([[1 << 32, 0], [3, 4], [3_000_000_000, 0]])
    assert whitening._deviation(y) == [None, 25, 9 * 10**18]


def solved(rows, k):
    y = rows - rows.mean(0)
    square = np.zeros((rows.shape[1],) * 2)
    r = whitening.triangle(y)
    square[: len(r)] = r
    return y.T @ y / len(y), whitening.solve(square, len(y), [0] * rows.shape[1], k)


def spectrum(seed, values):
    rng = np.random.default_rng(seed)
    n = len(values)
    turn = np.linalg.qr(rng.normal(size=(n, n)))[0]
    half = np.diag(np.sqrt(values))
    return rng.permutation(np.vstack([half, -half])) @ turn * 300


@pytest.mark.parametrize("gap", [1e-3, 1e-6, 1e-10, 1e-14, 0])
@pytest.mark.parametrize("seed", range(4))
def test_solver_with_clusters(gap, seed):
    values = np.r_[2 + gap * np.arange(4), 1.5 + gap * np.arange(4), np.ones(40)]
    cov, model = solved(spectrum(seed, values), 48)
    d = model.directions
    assert np.abs(d.T @ d - np.eye(48)).max() < 1e-11
    assert np.abs(cov @ d - d * model.values).max() < 1e-11 * model.values[0]


@pytest.mark.parametrize("shape", [(500, 64), (30, 64), (3, 10), (200, 1), (200, 2)])
def test_solver_on_random_rows(shape):
    cov, model = solved(np.random.default_rng(1).normal(size=shape), 8)
    want = np.linalg.eigvalsh(cov)[::-1][:8]
    assert np.abs(model.values - want).max() < 1e-13 * want[0]
    d = model.directions
    assert np.abs(d.T @ d - np.eye(d.shape[1])).max() < 1e-11 and np.abs(cov @ d - d * model.values).max() < 1e-13 * want[0]


def test_small_values_are_found_to_high_relative_accuracy():
    a = 10.0 ** -np.arange(12)
    b = a[:-1] * 0.3
    got = whitening.singular_values(a, b)
    from fractions import Fraction

    # The product of all is the determinant of B'B, which is that of its diagonal.
    exact = Fraction(1)
    for x in a:
        exact *= Fraction(float(x)) ** 2
    product = Fraction(1)
    for x in got:
        product *= Fraction(float(x))
    assert abs(product / exact - 1) < Fraction(1, 10**12)


def test_most_common_length_takes_part(spark):
    rows = [(1, 0, [1.0, 2.0]), (2, 0, [1.0, 2.0]), (3, 0, [1.0] * 4), (4, 0, [1.0] * 4), (5, 0, [1.0] * 3)]
    df = vector_frame(spark, rows)
    assert kept_vectors(df, "vec_id", "embedding", [])[1:] == (2, 4)
    assert kept_vectors(df, "vec_id", "embedding", [], 3)[1:] == (1, 3)
