"""Secret scans against Python's regexes; toxicity and language on held-out rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from netsieve.llm import langid, secrets, toxicity
from netsieve.llm.queries import op3, op4, op6

ANY_CASE = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w).replace("[_]?", "_?") for w in ("password", "passwd", "secret", "token", "api_?key"))
ASSIGN = re.compile(rf"""(?:{ANY_CASE})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def plain_spans(text):
    out = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    out += [("access", m.start(), m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [("hex", m.start(), m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out, key=lambda x: (x[1], secrets.BASE.index(x[0])))


def odd_texts(n=3000):
    rng = random.Random(2)
    parts = ["password", "token", "api_key", "APIKEY", "sEcret", "passwd", "=", ":", " ", "'", '"', "AKIA", "0123456789abcdef", "ABCDEFGH12", "é", "\n"]
    parts += ["abc", "deadbeef" * 3, "==", "-", "😀", "ghp_", "token=token:abcdefgh", "ſecret=", "\x00"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(n)] + ["", "a" * 30000, "f" * 100000, "AKIA" * 9]


def test_spans_equal_regexes():
    texts = odd_texts()
    for text, got in zip(texts, secrets.scanner().spans(texts), strict=True):
        assert [x for x in got if x[0] in secrets.BASE] == plain_spans(text), text[:200]


def test_added_rules():
    text = "x ghp_" + "a1B2" * 9 + " xoxb-123456789012 -----BEGIN RSA PRIVATE KEY-----"
    (got,) = secrets.scanner().spans([text])
    assert [k for k, _, _ in got] == ["github", "slack", "pem"]


def test_automaton_is_minimal_and_deterministic():
    one = secrets.Automaton([rb"ab+c", rb"ab+d|abd"], backward=False)
    assert len(one.step) == 6  # dead, start, a, ab with any more b, and an end for each rule; abd is a case of ab+d
    again = secrets.Automaton([rb"ab+c", rb"ab+d|abd"], backward=False)
    assert (one.step == again.step).all()


def test_op3_on_whole_table(spark, sf, texts):
    got = {r["doc_id"]: r for r in op3(spark, sf).collect()}
    assert got.keys() == texts.keys()
    for k, t in texts.items():
        want = plain_spans(t)
        assert [got[k][f"n_{kind}"] for kind in secrets.BASE] == [sum(x[0] == kind for x in want) for kind in secrets.BASE]
        assert got[k]["base_sha256"] == hashlib.sha256(",".join(f"{a}:{b}:{c}" for a, b, c in want).encode()).hexdigest() == secrets.base_sha256(want)


def test_redact(spark, frame):
    rows = [(1, None), (2, ""), (3, "é password=hunter22 end"), (4, "é password=hunter22 end"), (5, "x" * 200000)]
    got = {r["doc_id"]: r["text"] for r in secrets.redact(frame(rows)).collect()}
    assert got == {1: None, 2: "", 3: "é [secret] end", 4: "é [secret] end", 5: "x" * 200000}
    assert secrets.redact(frame(rows)).columns == frame(rows).columns
    assert secrets.find_secrets(frame(rows).where("false")).count() == 0


def held(key):
    return zlib.crc32(str(key).encode()) % 4 == 2


@pytest.fixture(scope="module")
def larger():
    return "/root/testdata/sf0.01"


def test_op4_on_held_out_rows(spark, larger):
    got = {r["doc_id"]: r for r in op4(spark, larger).collect()}
    assert len(got) == spark.read.parquet(f"{larger}/documents.parquet").count()
    assert all(r["held_out"] == held(k) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for k, r in got.items())
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{larger}/labels.parquet").collect() if held(r["doc_id"])}
    # two or three toxic rows of each other language are too few to learn from: English must be right
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{larger}/documents.parquet").collect()}
    yes, no = ([got[k]["score"] for k, v in labels.items() if v == mark and (v == 0 or lang[k] == "en")] for mark in (1, 0))
    assert len(yes) >= 5 and np.mean([(a > b) + 0.5 * (a == b) for a in yes for b in no]) > 0.97
    assert np.mean([s >= 0.3 for s in yes]) > 0.9 and np.mean([s >= 0.3 for s in no]) < 0.05


def test_op4_in_each_language(spark):
    sf = "/root/testdata/sf0.1"
    marks = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if held(r["doc_id"])}
    got = {r["doc_id"]: r["score"] for r in op4(spark, sf).collect() if r["doc_id"] in marks}
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    alarms = []
    for name in ("en", "fr", "de", "es"):
        yes, no = (np.array([s for k, s in got.items() if lang[k] == name and marks[k] == m]) for m in (1, 0))
        assert len(yes) > 10 and np.mean((yes[:, None] > no) + 0.5 * (yes[:, None] == no)) >= 0.9, name
        alarms += (no >= 0.3).tolist()
        assert np.mean(yes >= 0.3) > (0.85 if name == "en" else 0.1)
    assert np.mean(alarms) < 0.02


def test_repeated_rows_and_rows_without_an_id_are_scored(spark, frame):
    rows = [(k, "good words here " * 5 if k % 3 else "utterly vile words here " * 5) for k in range(1, 60)]
    labels = spark.createDataFrame([(k, 0 if k % 3 else 1) for k in range(1, 60)], "doc_id long, toxic int")
    docs = frame(rows + rows[:5] + [(None, "utterly vile words"), (None, None)])
    got = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
    assert len(got) == 66 and all(not r["held_out"] for r in got if r["doc_id"] is None)
    assert len({(r["doc_id"], r["score"]) for r in got if r["doc_id"] is not None}) == 59


def test_scores_do_not_depend_on_labels_of_held_out_rows(spark, larger):
    docs, labels = spark.read.parquet(f"{larger}/documents.parquet").limit(300), spark.read.parquet(f"{larger}/labels.parquet")
    flipped = labels.selectExpr("doc_id", "CASE WHEN crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 4 = 2 THEN 1 - toxic ELSE toxic END AS toxic")
    one, other = (toxicity.fit(docs, x) for x in (labels, flipped))
    assert one == other


def test_toxicity_of_odd_tables(spark, frame):
    rows = [(k, t) for k in range(1, 60) for t in ["good words here " * 5 if k % 3 else "utterly vile words here " * 5]] + [(99, None), (100, ""), (101, "y" * 100000)]
    labels = spark.createDataFrame([(k, 0 if k % 3 else 1) for k in range(1, 60)] + [(None, 1), (5, None), (98, 7)], "doc_id long, toxic int")
    docs = frame(rows)
    model = toxicity.fit(docs, labels)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    assert len(got) == len(rows) and got[99] == got[100] and got[3] > got[1]
    kept = {r["doc_id"] for r in toxicity.keep_ordinary(docs, model).collect()}
    assert kept == {k for k, s in got.items() if s < toxicity.THRESHOLD}
    assert toxicity.fit(docs, labels.where("false")) == 0.0
    assert toxicity.score(docs, 0.0).count() == len(rows) and toxicity.score(docs.where("false"), model).count() == 0


def test_op6_on_held_out_rows(spark, larger):
    docs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{larger}/documents.parquet").collect()}
    got = {r["doc_id"]: r for r in op6(spark, larger).collect()}
    assert got.keys() == docs.keys() and all(r["held_out"] == held(k) for k, r in got.items())
    assert np.mean([got[k]["lang_pred"] == v for k, v in docs.items() if held(k)]) > 0.97
    right = [r["rejected"] for k, r in got.items() if r["lang_pred"] == docs[k]]
    assert np.mean(right) < 0.05


def test_language_of_odd_tables(spark, frame):
    rows = [(k, ("der und die nicht " if k % 2 else "the and of that ") * 10) for k in range(40)] + [(50, None), (51, ""), (52, "12 +! \n"), (53, "the " * 50000)]
    docs = frame(rows).drop("lang").selectExpr("*", "CASE WHEN doc_id < 40 THEN IF(doc_id % 2 = 1, 'de', 'en') END AS lang")
    got = {r["doc_id"]: r for r in langid.identify(docs).collect()}
    assert [got[k]["lang_pred"] for k in (0, 1, 50, 51, 52, 53)] == ["en", "de", "und", "und", "und", "en"]
    none = {r["lang_pred"] for r in langid.identify(docs.selectExpr("doc_id", "text", "CAST(NULL AS STRING) AS lang")).collect()}
    assert none == {"und"} and langid.identify(docs.where("false")).count() == 0
