"""Near-duplicates, repeated passages, neighbours, fingerprints, archives and the pipeline against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from netsieve.llm import ann, components, fingerprints, simhash, substrings, textops, warc
from netsieve.llm.queries import op1, op7, op8, op9, op10
from pyspark.sql import functions as F


def component_of(nodes, linked):
    to = {n: n for n in nodes}

    def find(x):
        while to[x] != x:
            x = to[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        to[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components_of_random_links(spark):
    rng = random.Random(5)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(70)] + [(2000, 2001 + i) for i in range(300)] + [(7, 7)]
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == component_of({x for e in links for x in e}, links)
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_components(fps):
    ids = sorted(fps)
    return component_of(ids, [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if (fps[a] ^ fps[b]).bit_count() <= 3])


def test_op7_on_whole_table(spark, sf, texts):
    got = {r["doc_id"]: r for r in op7(spark, sf).collect()}
    fps = {k: int(r["fingerprint"], 16) for k, r in got.items()}
    assert got.keys() == texts.keys() and all(len(r["fingerprint"]) == 16 for r in got.values())
    assert {k: r["component_id"] for k, r in got.items()} == plain_components(fps)
    for k, t in list(texts.items())[:40]:
        assert fps[k] == plain_fingerprint(t)


def plain_fingerprint(text):
    import xxhash

    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text).encode().split()
    s = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize(("part", "crowd"), [(8, 64), (2048, 64), (8, 1)])
def test_links_of_dense_clusters(spark, monkeypatch, part, crowd):
    monkeypatch.setattr(simhash, "PART", part)
    monkeypatch.setattr(simhash, "CROWD", crowd)
    monkeypatch.setattr(simhash, "FRONTIER", 500)
    rng = random.Random(6)
    centres = [rng.getrandbits(64) for _ in range(6)]
    fps = {}
    for i in range(240):
        x = centres[i % 6]
        for _ in range(rng.randrange(5)):
            x ^= 1 << rng.randrange(64)
        fps[i] = x
    first = {}
    for i, x in sorted(fps.items()):
        first.setdefault(x, i)
    reps = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x, i) for x, i in first.items()], "fp long, rep long")
    found = [(r["a"], r["b"]) for r in simhash.links(reps).collect()]
    own = {i: x for x, i in first.items()}
    assert component_of(own, found) == plain_components(own)
    assert len(found) < 16 * len(own)


def test_simhash_of_odd_tables(spark, frame):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "a b c d e"), (5, "A b  c d e"), (6, "one"), (6, "a b c d e"), (None, "x"), (9, "w " * 60000)]
    got = {(r["doc_id"], r["fp"]): r["component_id"] for r in simhash.near_duplicates(frame(rows)).collect()}
    assert {k: c for (k, f), c in got.items() if f == 0} == {1: 1, 2: 1, 3: 1}
    assert {c for (k, _), c in got.items() if k in (4, 5, 6)} == {4} and all(k is not None for k, _ in got)
    assert simhash.near_duplicates(frame(rows).where("false")).count() == 0


def test_shard_keys_leave_no_pair_out():
    rng = random.Random(7)
    for distinct in (10, 10**7, 10**12):
        keys = simhash.shard_keys(distinct)
        for _ in range(200):
            x = rng.getrandbits(64)
            y = x
            for b in rng.sample(range(64), 3):
                y ^= 1 << b
            assert any(all((x ^ y) >> at & (1 << w) - 1 == 0 for at, w in key) for key in keys)


def repeated(texts, n=50):
    """(doc, place) of every ``n``-word passage that an earlier place of another document has."""
    first, out = {}, []
    for k in sorted(texts):
        w = (texts[k] or "").split()
        for i in range(len(w) - n + 1):
            at = first.setdefault(tuple(w[i : i + n]), (k, i))
            if at[0] != k:
                out.append((k, i))
    return out


def check_spans(rows, texts):
    words = {k: (t or "").split() for k, t in texts.items()}
    covered = {k: np.zeros(len(w), bool) for k, w in words.items()}
    for r in rows:
        s, n = r["start_word"], r["n_words"]
        assert (r["kept_doc_id"], r["kept_start_word"]) < (r["doc_id"], s) and s + n <= len(words[r["doc_id"]])
        covered[r["doc_id"]][s : s + n] = True
        a, b = words[r["doc_id"]][s : s + n], words[r["kept_doc_id"]][r["kept_start_word"] :][:n]
        if r["kind"] == "passage":
            assert sum(x == y for x, y in zip(a, b)) >= 0.5 * n
        elif r["kind"] == "paragraph" and a != b:  # by way of a cluster
            assert any(x["kind"] == "near_paragraph" for x in rows)
    return covered


def test_op1_on_whole_table(spark, sf, texts):
    rows = op1(spark, sf).collect()
    covered = check_spans(rows, texts)
    wanted = repeated(texts)
    assert wanted and np.mean([covered[k][i : i + 50].all() for k, i in wanted]) > 0.98
    assert all(covered[k][i : i + 50].any() for k, i in wanted)
    touched = {r["doc_id"] for r in rows}
    plain = repeated(texts, substrings.LEAST)
    assert {k for k, _ in wanted} <= touched
    clean = set(texts) - {k for k, _ in plain}
    near = {r["doc_id"] for r in rows if r["kind"] == "near_paragraph" or r["doc_id"] == r["kept_doc_id"]}
    assert not (touched - near) & clean


def planted(seed=8):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(4000)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, paragraph = text(51), text(60)
    rows = [(i, text(rng.randint(10, 40)) + " " + passage + " " + text(rng.randint(10, 40)) + "\n" + text(30)) for i in range(0, 20, 2)]
    for i in range(1, 20, 2):
        w = paragraph.split()
        w[5 * (i % 3)] = f"other{i}"
        rows.append((i, text(25) + "\n" + (" ".join(w) if i > 1 else paragraph) + "\n" + text(25)))
    return rows + [(i, text(120)) for i in range(20, 30)], passage, paragraph


def test_planted_passages_and_paragraphs(spark, frame):
    rows, passage, paragraph = planted()
    texts = dict(rows)
    spans = substrings.duplicate_spans(frame(rows))
    got = spans.collect()
    covered = check_spans(got, texts)
    n = len(passage.split())
    for k in range(0, 20, 2):
        w = texts[k].split()
        at = next(i for i in range(len(w)) if w[i : i + n] == passage.split())
        assert covered[k][at : at + n].all() == (k > 0) and covered[k].sum() == (n if k else 0)
    assert {r["doc_id"] for r in got if r["kind"] == "near_paragraph"} == set(range(3, 20, 2))
    assert not {r["doc_id"] for r in got} & set(range(20, 30))
    out = {r["doc_id"]: r["text"] for r in substrings.remove_spans(frame(rows), spans).collect()}
    assert sum(passage in t for t in out.values()) == 1 and all(out[k] == texts[k] for k in range(20, 30))


@pytest.mark.parametrize(("part", "few"), [(2, 24), (3, 2), (1024, 24), (1024, 2)])
def test_chains_of_similar_paragraphs(spark, frame, monkeypatch, part, few):
    monkeypatch.setattr(substrings, "PART", part)
    monkeypatch.setattr(substrings, "FEW", few)
    monkeypatch.setattr(substrings, "COLUMNS", 100)
    rng = random.Random(9)
    base = [f"w{i}" for i in range(300)]
    chain = []
    for i in range(12):  # neighbours are similar, ends are not
        w = base[:]
        for j in range(i * 3):
            w[(j * 8) % 300] = f"x{j}"
        chain.append((i, " ".join(w)))
    rng.shuffle(chain)
    got = substrings.duplicate_spans(frame(chain)).where("kind = 'near_paragraph'").collect()
    sets = {k: {tuple(t.split()[i : i + 5]) for i in range(296)} for k, t in chain}
    near = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8]
    to = component_of(sets, near)
    assert {r["doc_id"]: r["kept_doc_id"] for r in got} == {k: c for k, c in to.items() if k != c}


def wrapped(words, width):
    return "\n".join(" ".join(words[i : i + width]) for i in range(0, len(words), width))


def test_near_copies_of_wrapped_paragraphs(spark, frame):
    rng = random.Random(13)
    text = lambda n: [f"w{rng.randrange(4000)}" for _ in range(n)]
    paragraph, rows = text(120), []
    for i in range(12):
        w = paragraph[:]
        if i:
            w[38 + i % 3], w[80 - i % 3] = f"x{i}", f"y{i}"
        rows.append((i, "\n\n".join([wrapped(text(60), 9), wrapped(w, 7 + i), wrapped(text(60), 9)])))
    got = substrings.duplicate_spans(frame(rows)).collect()
    covered = check_spans(got, dict(rows))
    assert not covered[0].any() and all(covered[i].tolist() == [False] * 60 + [True] * 120 + [False] * 60 for i in range(1, 12))


def test_pieces_of_long_blocks():
    rng = random.Random(14)
    lines = [" ".join(f"w{rng.randrange(4000)}" for _ in range(rng.randint(1, 12))) for _ in range(400)]
    found = []
    for ahead in ("", "one line more\n", "\n"):
        w = substrings.Words(["other words\n" + " ".join(["long"] * 30), ahead + "\n".join(lines) + "\n \nlast"])
        begin, size, piece = substrings.blocks(w)
        assert (size >= substrings.LEAST).all() and piece.sum() > 20 and (~piece).sum() == 2
        at, n = begin[piece], size[piece]
        assert (at[1:] == at[:-1] + n[:-1]).all() and n.sum() == size[~piece][-1]
        b, _, whole, bands = substrings.paragraphs(w)
        assert bands.shape == (len(b), substrings.BANDS) and len(set(whole.tolist())) == len(whole)
        found.append(set(whole[piece].tolist()))
    assert found[0] == found[2] and len(found[0] & found[1]) > 0.8 * len(found[0])


def test_passages_that_earlier_documents_quote_in_part(spark, frame):
    rng = random.Random(12)
    text = lambda n: [f"w{rng.randrange(4000)}" for _ in range(n)]
    rows = []
    for i, (size, quote) in enumerate([(60, 40), (80, 40), (120, 40), (60, 25)] * 30):
        p = text(size)
        cut, other = rng.randrange(size - quote + 1), rng.randrange(size - 29)
        edited = p[:]
        edited[rng.randrange(size)] = "edited"
        for part in (p[cut : cut + quote], p[other : other + 30], edited, p, p, p):
            rows.append((len(rows), " ".join(text(rng.randint(5, 60)) + part + text(rng.randint(5, 60)))))
    covered = check_spans(substrings.duplicate_spans(frame(rows)).collect(), dict(rows))
    wanted = repeated(dict(rows))
    assert len(wanted) > 1000 and all(covered[k][i : i + 50].all() for k, i in wanted)
    assert not any(covered[k][:5].any() or covered[k][-5:].any() for k, _ in rows)


@pytest.mark.parametrize("size", [60, 120, 300])
def test_blocks_repeated_without_a_break(spark, frame, size):
    rng = random.Random(size)
    text = lambda n: [f"w{rng.randrange(4000)}" for _ in range(n)]
    rows = []
    for i in range(12):
        w = text(25) + text(size) * (3 + i % 3) + text(25)
        rows.append((i, "\n".join(" ".join(w[j : j + 11]) for j in range(0, len(w), 11))))
    covered = check_spans(substrings.duplicate_spans(frame(rows)).collect(), dict(rows))
    for i in range(12):
        assert covered[i][25 + size : -25].all() and not covered[i][: 25 + size].any() and not covered[i][-25:].any()


def alike(n=40, bits=10):
    """Two different lines of words that a polynomial hash modulo 2**64 cannot tell apart, whatever its base."""
    word = "".join("ab"[i.bit_count() & 1] for i in range(1 << bits))
    return [" ".join([w] * 2 + [f"x{i}" for i in range(n)]) for w in (word, word.translate(str.maketrans("ab", "ba")))]


def test_lines_with_words_made_to_collide_stay(spark, frame):
    a, b = ("\n".join(" ".join(f"{w}{i}{j}" for j in range(25)) for i in range(3)) for w in (x.split()[0] for x in alike()))
    assert substrings.duplicate_spans(frame([(1, a), (2, b)])).count() == 0
    x, y = alike()
    assert fingerprints.likeness(*(fingerprints.signatures([t]) for t in (" ".join(x.split()[:2]), " ".join(y.split()[:2]))))[0] == 0


@pytest.mark.parametrize("ranges", [1, 2, 7, 40])
def test_what_spans_sorted_ranges_is_settled_by_their_edges(ranges):
    rng = random.Random(ranges)
    rows, seen = [], set()
    while len(rows) < 160:
        words = [rng.choice([0, 0, 0, 1, 2])] * rng.randrange(4) + [rng.randrange(3) for _ in range(rng.randrange(4))] + [7] * rng.choice([0, 25])
        side = np.array(words[: substrings.SPREAD], np.uint32).tobytes()
        key, ahead = rng.choice([-5, 5, 5]), rng.random() < 0.5
        if (key, ahead, side) not in seen:
            seen.add((key, ahead, side))
            rows.append({"key": key, "ahead": ahead, "side": side, "doc": rng.randrange(30) - 3, "place": rng.randrange(4)})
    rows.sort(key=lambda r: (r["key"], r["ahead"], r["side"]))
    cuts = sorted(rng.sample(range(1, len(rows)), ranges - 1))
    table = pd.DataFrame(rows).assign(at=range(len(rows)), name=range(len(rows)), task=np.searchsorted(cuts, range(len(rows)), side="right").astype(np.int32))
    parts = [p.sample(frac=1, random_state=1) for _, p in table.groupby("task")]
    edges = [r for p in parts for r in substrings.range_edges(p).to_dict("records")]
    rng.shuffle(edges)
    got = {}
    for (task, before, behind), p in zip(substrings.carried(edges), parts, strict=True):
        assert set(p["task"]) == {task}
        got.update({r["name"]: (r["more"], r["kept_doc"], r["kept_place"]) for r in substrings.earliest(p, before, behind).to_dict("records")})
    for i, r in enumerate(rows):
        best = None
        for o in rows:
            if (o["key"], o["ahead"]) == (r["key"], r["ahead"]) and (o["doc"], o["place"]) < (r["doc"], r["place"]):
                a, b = np.frombuffer(r["side"], np.uint32), np.frombuffer(o["side"], np.uint32)
                n = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
                best = max(best or (-1, 0, 0), (n, -o["doc"], -o["place"]))
        assert got.get(i) == (best and (best[0], -best[1], -best[2]))


def test_passages_over_many_ranges(spark, frame, monkeypatch):
    monkeypatch.setattr(substrings, "RANGE", 40)
    rows, passage, _ = planted()
    rows = [(k, t + " " + passage) for k, t in rows]
    covered = check_spans(substrings.duplicate_spans(frame(rows)).collect(), dict(rows))
    wanted = repeated(dict(rows))
    assert wanted and all(covered[k][i : i + 50].all() for k, i in wanted)


def test_spans_are_cut_whatever_columns_are_called(spark):
    line = " ".join(f"t{i}" for i in range(30))
    df = spark.createDataFrame([(1, line, 5, "a"), (2, line + "\nend", 6, "b"), (None, line, 7, "c")], "doc_id long, text string, _spans long, `c0` string")
    spans = substrings.duplicate_spans(df)
    out = substrings.remove_spans(df, spans)
    assert out.columns == df.columns
    assert sorted((str(r["doc_id"]), r["text"].strip(), r["_spans"], r["c0"]) for r in out.collect()) == [("1", line, 5, "a"), ("2", "end", 6, "b"), ("None", line, 7, "c")]


def test_substrings_of_odd_tables(spark, frame):
    line = " ".join(f"t{i}" for i in range(30))
    rows = [(1, None), (2, ""), (3, line), (4, line), (None, line), (5, "short one"), (6, "the " * 30000), (7, f"{line}\n{line}")]
    spans = substrings.duplicate_spans(frame(rows))
    out = {r["doc_id"]: r["text"] for r in substrings.remove_spans(frame(rows), spans).collect()}
    assert out[1] is None and out[2] == "" and out[3] == line and out[5] == "short one" and out[None] == line
    assert 4 not in out and 7 not in out
    none = frame(rows).where("false")
    assert substrings.duplicate_spans(none).count() == 0 and substrings.remove_spans(none, spans).count() == 0
    assert substrings.remove_spans(frame(rows), spans).columns == frame(rows).columns


def plain_nearest(rows, asks, k):
    good = [(i, np.array(v, float)) for i, v in rows if v and None not in v and np.isfinite(v).all() and np.any(v)]
    return {i: sorted(((-float((q * v).sum()), j) for j, v in good if j != i))[:k] for i, q in good if i in asks}


def test_op8_recall(spark, sf):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want = plain_nearest(rows, {i for i, _ in rows if i % 20 == 0}, 20)
    found = {}
    for r in op8(spark, sf).collect():
        found.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    assert found.keys() == want.keys() and all(sorted(x) == list(range(1, 21)) for x in found.values())
    assert np.mean([len({v for v, _ in found[q].values()} & {j for _, j in want[q]}) / 20 for q in want]) >= 0.9
    scores = {j: -s for q in want for s, j in want[q] if q == 0}
    assert all(abs(scores[v] - s) < 1e-12 for v, s in found[0].values() if v in scores)


def test_recall_of_a_full_shard():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(10, 32))
    v = centres[rng.integers(0, 10, 6000)] + rng.normal(size=(6000, 32))
    shard, hit, seen = ann.Shard(np.arange(6000), v), 0, []
    for q, ids, score in shard.search(np.arange(40), v[:40], 20):
        s = v @ v[q]
        s[q] = -np.inf
        hit += len(set(ids.tolist()) & set(np.argsort(-s)[:20].tolist()))
        assert (np.diff(score) <= 0).all()
    for c in shard.candidates(v[:20], int(ann.VERIFY * 6000)):
        seen.append(len(c))
    assert hit / 800 >= 0.9 and np.mean(seen) < 0.7 * 6000


@pytest.mark.parametrize("kind", ["lognormal 0.5", "lognormal 1", "one of ten times the norm"])
@pytest.mark.parametrize("n", [2000, 20000])
def test_recall_with_unequal_norms(kind, n):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(n, 64))
    v /= np.linalg.norm(v, axis=1)[:, None]
    if kind.startswith("lognormal"):
        v *= rng.lognormal(0, float(kind.split()[1]), n)[:, None]
    else:
        v[n // 2] *= 10
    hit = 0
    for q, ids, score in ann.Shard(np.arange(n), v).search(np.arange(40), v[:40], 20):
        s = v @ v[q]
        s[q] = -np.inf
        hit += len(set(ids.tolist()) & set(np.argsort(-s)[:20].tolist()))
        assert len(ids) == 20 and (np.diff(score) <= 0).all()
    assert hit / 800 >= 0.9


def test_neighbours_of_odd_tables(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=4)]) for i in range(60)]
    rows += [(60, None), (80, [0.0] * 4), (100, [1.0, None, 0.0, 0.0]), (120, [float("nan")] * 4), (140, [1.0, float("inf"), 0.0, 0.0]), (160, []), (180, [1.0, 2.0])]
    rows += [(61, rows[40][1]), (62, rows[40][1]), (63, rows[40][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("id", F.lit(1)).withColumn("v", F.lit(2)).withColumn("rank", F.lit(3))
    exact = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows if i not in (180,)]
    want = plain_nearest([(i, v) for i, v in exact if v and None not in v], {0, 20, 40}, 5)
    got = {}
    for r in ann.nearest(df, F.col("vec_id") % 20 == 0, 5).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert got == {q: [j for _, j in x] for q, x in want.items()}
    assert ann.nearest(df.where("false"), F.col("vec_id") % 20 == 0).count() == 0


def weighted_jaccard(a, b):
    def terms(t):
        w = t.lower().split()
        return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])

    x, y = terms(a), terms(b)
    return sum((x & y).values()) / max(1, sum((x | y).values()))


def test_op9_on_whole_table(spark, sf, texts):
    got = {r["doc_id"]: r for r in op9(spark, sf).collect()}
    order = sorted(texts, reverse=True)
    off = []
    assert got.keys() == texts.keys()
    for k, after in zip(order, order[1:] + order[:1]):
        edited = fingerprints.edit(texts[k], texts[after])
        assert got[k]["n_chars"] == len(texts[k]) and got[k]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert (got[k]["fingerprint"], got[k]["edited_fingerprint"]) == tuple(fingerprints.hexed(fingerprints.signatures([texts[k], edited])))
        off += [got[k]["near_edited"] - weighted_jaccard(texts[k], edited), got[k]["near_next"] - weighted_jaccard(texts[k], texts[after])]
    assert abs(np.mean(off)) < 0.02 and np.sqrt(np.mean(np.square(off))) < 0.07


def test_weights_count():
    a, b = "a b c d e " * 30 + "f g h i j", "a b c d e " * 6 + "f g h i j " * 10
    rng = random.Random(3)
    off = []
    for i in range(60):
        x, y = (" ".join(f"{w}{i}" for w in t.split()) for t in (a, b))
        s = fingerprints.signatures([x, y])
        off.append(fingerprints.likeness(s[:1], s[1:])[0] - weighted_jaccard(x, y))
    assert rng and abs(np.mean(off)) < 0.03


def test_fingerprints_of_odd_tables(spark, frame):
    rows = [(1, None), (2, ""), (3, "a b"), (4, "a b"), (5, "é " * 40000), (None, "z")]
    got = {r["doc_id"]: r for r in fingerprints.fingerprint_with_edit(frame(rows)).collect()}
    assert len(got) == 6 and got[1]["fingerprint"] == got[2]["fingerprint"] == "0" * 256 and got[2]["near_next"] == 1.0
    assert got[3]["fingerprint"] == got[4]["fingerprint"] and got[4]["near_next"] == 1.0 and got[3]["near_next"] == 0.0
    (only,) = fingerprints.fingerprint_with_edit(frame([(7, "a b c")])).collect()
    assert only["near_next"] == 1.0 and only["edited_sha256"] == hashlib.sha256(b"a b" + b"a ").hexdigest()
    assert fingerprints.fingerprint_with_edit(frame(rows).where("false")).count() == 0
    assert {r["fingerprint"] for r in fingerprints.fingerprint(frame(rows)).where("doc_id IN (3, 4)").collect()} == {got[3]["fingerprint"]}


def plain_archive(pages):
    best = {}
    for k, html in pages:
        if len(html) >= 1000:
            best[html] = max(best.get(html, -1), k)
    out = {}
    for k, html in pages:
        to = best[html] if len(html) >= 1000 and best[html] != k else None
        out[k] = (len(html), hashlib.sha1(html).hexdigest(), "response" if to is None else "revisit", to)
    return out


def as_rows(df):
    return {r["page_id"]: (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in df.collect()}


def test_op10_on_whole_table(spark, sf):
    pages = [(r["page_id"], bytes(r["html"] if not isinstance(r["html"], str) else r["html"].encode())) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    assert as_rows(op10(spark, sf)) == plain_archive(pages)


def test_archives_of_odd_tables(spark):
    big, tricky = "é" * 600, "x\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\n" * 40
    rows = [(1, "http://a/1", big), (2, None, big), (3, "http://a/3\nb", big), (4, "u", None), (5, "u", ""), (6, "u", "s" * 999), (7, "u", "s" * 999), (8, "v", tricky), (9, "v", tricky)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("x")).withColumn("payload", F.lit(1))
    assert as_rows(warc.page_rows(warc.archive(df))) == plain_archive([(k, (h or "").encode()) for k, _, h in rows])
    full = {r["metadata"]["fields"]["page-id"]: r for r in warc.archive(df).collect()}
    assert bytes(full["8"]["response"]["payload"] or b"") == b"" and bytes(full["9"]["response"]["payload"]) == tricky.encode()
    assert full["1"]["request"]["http"].startswith("GET http://a/1 ") and full["2"]["request"]["http"].startswith("GET / ")
    assert warc.archive(df.where("false")).count() == 0
    twice = warc.page_rows(warc.archive(df.unionByName(df).selectExpr("page_id", "url", "html").unionByName(spark.createDataFrame([(None, "n", big)], "page_id long, url string, html string"))))
    assert twice.count() == 19 and twice.where("page_id IS NULL AND record_type = 'response'").count() == 1


def test_captures_without_partners(spark):
    rows = [("response", "r1", None, None), ("response", "r2", None, None), ("request", "q1", "r1", None), ("request", "q0", "r1", None), ("metadata", "m9", "gone", {"a": "b"}), ("request", "q5", None, None)]
    df = spark.createDataFrame([(t, i, c, None, None, None, None, None, f) for t, i, c, f in rows], warc.RECORD)
    got = {r["response"]["record_id"]: r for r in warc.assemble(df).collect()}
    assert got["r1"]["request"]["record_id"] == "q0" and got["r2"]["request"] is None and got["r1"]["metadata"] is None and len(got) == 2


def test_text_helpers():
    rng = random.Random(2)
    text = "".join(rng.choice(" \t\n\x0b\x1c\x85　ab€😀") for _ in range(3000))
    codes = textops.code_points(text)
    lo, hi = textops.words(codes)
    assert [text[a:b] for a, b in zip(lo, hi)] == text.split()
    h = textops.span_hashes(codes, lo, hi)
    by_word = {}
    for w, x in zip(text.split(), h.tolist(), strict=True):
        assert by_word.setdefault(w, x) == x
    assert len(set(by_word.values())) == len(by_word)
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 60, 5000))
    table = textops.IntMap(keys[::2], np.arange(len(keys[::2])))
    got = table.get(keys, -1)
    assert (got[::2] == np.arange(len(keys[::2]))).all() and (got[1::2] == -1).all()
    assert list(textops.chunks([5, 1, 9, 2], 6)) == [(0, 2), (2, 3), (3, 4)]
