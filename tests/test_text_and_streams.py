"""Redaction, retrieval, file sources and sinks, log tailing and streams."""

import math
import os
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from netsieve.functions import text as tx
from netsieve.models.linear import LinearModel
from netsieve.models.novelty import Detector, NoveltyOptions
from netsieve.models.preprocess import Scaler
from netsieve.operators import retrieval as rt
from netsieve.sources import conn_log, sinks, tables
from netsieve.streaming import scoring as sg, tail_source as ts


def test_redaction_of_nested_values(spark):
    df = spark.sql("SELECT 'see 10.0.0.1 at a.example.com, p=0.93' AS t, map('10.0.0.1', array('x.y 1')) AS m, struct(1 AS n, 'h.io' AS s) AS s, 5 AS k")
    r = tx.redact_columns(df).first()
    assert r["t"] == "see [REDACTED_IP] at [REDACTED_DOMAIN], p=[REDACTED_DOMAIN]"
    assert r["m"] == {"10.0.0.1": ["[REDACTED_DOMAIN] 1"]} and r["s"]["s"] == "[REDACTED_DOMAIN]" and r["k"] == 5
    only = tx.redact_columns(df, ["t"], domains=False).first()
    assert only["t"].endswith("a.example.com, p=0.93") and only["s"]["s"] == "h.io"
    ips = spark.createDataFrame([("192.168.1.10 999.1.1.1", 3)], "`id.orig_h` string, x long")
    assert tuple(tx.redact_ip_cells(ips).first()) == ("[redacted-ip] 999.1.1.1", 3)


def test_terms(spark):
    df = spark.createDataFrame([("A b, Cc dd_1 ÉÉ!",), ("",), ("xx",)], "t string")
    assert [r[0] for r in df.select(tx.terms(F.col("t"))).collect()] == [["cc", "dd_1", "éé", "cc dd_1", "dd_1 éé"], [], ["xx"]]


def test_query_text(spark):
    df = spark.createDataFrame([("AttackUncertain", None, 12.345, None)], "decision_label string, reason_codes string, suspected_zero_day_pct double, open_set_ood_score double")
    assert df.select(tx.query_text(df)).first()[0] == "decision_label=AttackUncertain | suspected_zero_day_pct=12.35"


def brute_force(docs, query, k, max_terms=20000):
    def grams(t):
        w = re.findall(r"\b\w\w+\b", t.lower())
        return Counter(w + [f"{a} {b}" for a, b in zip(w, w[1:])])

    tf = {i: grams(t) for i, t in docs.items()}
    total = Counter()
    for c in tf.values():
        total.update(c)
    vocab = sorted(total, key=lambda t: (-total[t], t.encode()))[:max_terms]
    idf = {t: math.log((1 + len(docs)) / (1 + sum(t in c for c in tf.values()))) + 1 for t in vocab}

    def vec(c):
        v = {t: n * idf[t] for t, n in c.items() if t in idf}
        norm = math.sqrt(sum(x * x for x in v.values())) or 1.0
        return {t: x / norm for t, x in v.items()}

    q = vec(grams(query))
    sims = {i: round(sum(x * q.get(t, 0) for t, x in vec(c).items()), 9) for i, c in tf.items()}
    return [(i, sims[i]) for i in sorted(sims, key=lambda i: (-sims[i], i))[:k]]


@pytest.mark.parametrize("max_terms", [20000, 6])
def test_retrieval_against_brute_force(spark, max_terms):
    docs = {1: "port scan port scan", 2: "dos flood of port", 3: "web attack", 4: "port scan port scan", 5: "quiet"}
    d = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(3)
    queries = {1: "a port scan now", 2: "nothing known here", 3: "web web flood"}
    q = spark.createDataFrame(list(queries.items()), "query_id long, text string")
    got = rt.retrieve(d, rt.build_index(d, "doc_id", "text", max_terms), q, top_k=3).collect()
    for i, text in queries.items():
        mine = [(r["doc_id"], r["score"]) for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == i]
        want = brute_force(docs, text, 3, max_terms)
        assert [m[0] for m in mine] == [w[0] for w in want] and [m[1] for m in mine] == pytest.approx([w[1] for w in want])


def shuffled_rows(df):
    """Rows that all exchanges of a plan that has run wrote."""
    total, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            todo.append(node.plan())
        else:
            found = node.metrics().get("shuffleRecordsWritten")
            total += found.get().value() if found.isDefined() else 0
            todo += [node.children().apply(i) for i in range(node.children().size())]
    return total


def test_retrieval_shuffles_no_pairs(spark):
    docs = spark.range(1, 401).selectExpr("id AS doc_id", "concat('prediction flow', id % 7, ' word', id) AS text").repartition(2)
    queries = spark.range(300).selectExpr("id AS query_id", "concat('prediction flow', id % 5, ' word', id) AS text")
    got = rt.retrieve(docs, rt.build_index(docs, "doc_id", "text"), queries, top_k=3)
    assert len(got.collect()) == 900 and shuffled_rows(got) < 30_000  # every query shares a word with all 400 documents


@pytest.mark.parametrize("small", [False, True])
def test_retrieval_of_common_and_rare_terms(spark, small, monkeypatch):
    if small:
        monkeypatch.setattr(rt, "SLICE", 60)
        monkeypatch.setattr(rt, "CELLS", 500)
    rng = np.random.default_rng(7)
    words = np.array([f"w{i}" for i in range(60)])
    share = 1 / np.arange(1, 61)
    texts = [" ".join(rng.choice(words, rng.integers(1, 30), p=share / share.sum())) for _ in range(150)]
    docs = {i: texts[i % 120] for i in range(300)}  # most texts are there several times
    docs[300] = "w1"
    d = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(4)
    # Queries of common terms only, with rarer ones beside them, of one term several times, and of none.
    queries = {i: " ".join(rng.choice(words[: 6 if i % 2 else 60], rng.integers(1, 9))) for i in range(60)} | {60: "w0 w0 w0 w1", 61: "none of them"}
    q = spark.createDataFrame(list(queries.items()), "query_id long, text string")
    got = rt.retrieve(d, rt.build_index(d, "doc_id", "text"), q, top_k=5).collect()
    for i, text in queries.items():
        mine = [(r["doc_id"], r["score"]) for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == i]
        want = brute_force(docs, text, 5)
        assert [m[0] for m in mine] == [w[0] for w in want] and [m[1] for m in mine] == pytest.approx([w[1] for w in want])


@pytest.mark.parametrize("frequent", [1_000_000, 12, 3])
@pytest.mark.parametrize("max_terms", [None, 25])
def test_index_of_terms_sent_and_shuffled(spark, frequent, max_terms, monkeypatch):
    monkeypatch.setattr(rt, "FREQUENT", frequent)
    rng = np.random.default_rng(3)
    docs = {i: " ".join(f"w{w}" for w in rng.zipf(1.6, 12) if w < 50) for i in range(40)} | {40: "", 41: "single"}
    d = spark.createDataFrame([*docs.items(), (42, None)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in rt.build_index(d, "doc_id", "text", max_terms)[1].collect()}
    words = {i: re.findall(r"\w\w+", t) for i, t in docs.items()}
    tf = {i: Counter(w + [f"{a} {b}" for a, b in zip(w, w[1:])]) for i, w in words.items()}
    total = sum(tf.values(), Counter())
    kept = set(sorted(total, key=lambda t: (-total[t], t))[:max_terms])
    idf = {t: math.log(44 / (1 + sum(t in c for c in tf.values()))) + 1 for t in kept}
    for i, c in tf.items():
        w = [n * idf[t] for t, n in c.items() if t in kept]
        if not w:
            assert i not in got
            continue
        norm = math.sqrt(sum(x * x for x in w))
        assert got[i]["n_terms"] == len(w) and got[i]["norm"] == pytest.approx(norm) and got[i]["top"] == pytest.approx(max(w) / norm)


def test_index_takes_little_disk(spark, tmp_path, monkeypatch):
    """What is written, shuffles aside: counts, totals, vocabulary and weights stood there before, a row a term."""
    monkeypatch.setattr(rt, "run_dir", lambda spark, name: str(tmp_path / name))
    monkeypatch.setattr(rt, "materialize", lambda df, name="stage": (df.write.parquet(str(tmp_path / name)), spark.read.parquet(str(tmp_path / name)))[1])
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(f"word{w}" for w in rng.integers(0, 5000, 300))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    rt.build_index(docs, "doc_id", "text")[1].count()
    assert folder_bytes(tmp_path) < 2 * sum(len(t) for _, t in rows)


def test_explain_rows(spark):
    docs = spark.createDataFrame([(1, "T1", "fam", "src.example.org", "novel_flag attack"), (2, "T2", None, None, "other words")], "doc_id long, title string, family string, source string, text string")
    rows = spark.createDataFrame([(1, "AttackUncertain", "novel_flag"), (2, "KnownAttack", "novel_flag"), (3, "AttackUncertain", "zzz")], "id int, decision_label string, reason_codes string")
    index = rt.build_index(docs, "doc_id", "text")
    out = {r["id"]: r["llm_explanation_json"] for r in rt.explain_rows(rows, docs, index).collect()}
    assert out[2] == "" and '"name":"fam"' in out[1] and "src.example.org" not in out[1] and "[REDACTED_DOMAIN]" in out[1]
    assert '"confidence_band":"medium"' in out[3]
    assert all(r["llm_explanation_json"] for r in rt.explain_rows(rows, docs, index, only_uncertain=False).collect())


# ---- files ---------------------------------------------------------------------------------------------------


def test_tables_and_labels(spark, tmp_path):
    one = spark.createDataFrame([(1, 2.0)], "a int, b double")
    tables.write_table(one, str(tmp_path / "t.csv"))
    assert tables.read_table(spark, str(tmp_path / "t.csv")).collect() == one.collect()
    with pytest.raises(ValueError):
        tables.read_table(spark, str(tmp_path / "t.txt"))
    names = spark.createDataFrame([("Benign-Monday-no-metadata.parquet",), ("WebAttacks-Thursday.csv",), ("Plain.parquet",), ("A-B-C.parquet",)], "n string")
    assert [r[0] for r in names.select(tables.label_from_filename(F.col("n"))).collect()] == ["Benign", "WebAttacks", "Plain", "A-B"]


def test_load_raw_tables(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    os.makedirs(tmp_path / "raw" / "deep")
    pq.write_table(pa.table({"x": [1, 2, 3]}), tmp_path / "raw" / "deep" / "Benign-Monday-no-metadata.parquet")
    pq.write_table(pa.table({"x": [4], "Label": ["DoS"]}), tmp_path / "raw" / "DoS-Friday.parquet")
    (tmp_path / "raw" / "more.csv").write_text("x,Label\n5,Bot\n6,Bot\n7,Bot\n")
    df = tables.load_raw_tables(spark, str(tmp_path / "raw"))
    assert sorted((r["x"], r["Label"]) for r in df.collect()) == [(1, "Benign"), (2, "Benign"), (3, "Benign"), (4, "DoS"), (5, "Bot"), (6, "Bot"), (7, "Bot")]
    capped = tables.load_raw_tables_capped(spark, str(tmp_path / "raw"), 6)
    assert sorted(r["x"] for r in capped.collect()) == [1, 2, 4, 5, 6]
    os.makedirs(tmp_path / "none")
    with pytest.raises(FileNotFoundError):
        tables.load_raw_tables(spark, str(tmp_path / "none"))


def test_conn_log(spark, tmp_path):
    log = tmp_path / "conn.log"
    log.write_text("#separator x\n#fields\told\n#fields\tts\tproto\tid.orig_p\n\n1.0\ttcp\t80\n#close\n2.0\tudp\t-\n")
    df = conn_log.read_conn_log(spark, str(log))
    assert df.columns == ["ts", "proto", "id.orig_p"] and sorted(map(tuple, df.collect())) == [("1.0", "tcp", "80"), ("2.0", "udp", "-")]
    (tmp_path / "odd.log").write_text("#fields\ta\tb\n1\t2\t3\n")
    assert conn_log.read_conn_log(spark, str(tmp_path / "odd.log")).columns == ["0", "1", "2"]
    assert conn_log.read_conn_log(spark, str(tmp_path / "absent.log")).count() == 0
    (tmp_path / "plain.log").write_text("#c\nts\tx\n1\t2\n")
    assert conn_log.read_plain_log(spark, str(tmp_path / "plain.log")).first().asDict() == {"ts": 1, "x": 2}


def test_corpus(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"title":"a","text":"x"}\n\n{"title":"b"}\n')
    assert [r["title"] for r in tables.read_corpus(spark, str(tmp_path / "c.jsonl")).collect()] == ["a"]
    (tmp_path / "e.jsonl").write_text('{"title":"b"}\n')
    with pytest.raises(ValueError):
        tables.read_corpus(spark, str(tmp_path / "e.jsonl"))


def test_alert_sink_is_idempotent_per_batch(spark, tmp_path):
    df = spark.createDataFrame([("KnownAttack", 1), ("AttackUncertain", 2), ("BenignOrLowRisk", 3)], "decision_label string, x int")
    path = str(tmp_path / "alerts")
    assert sinks.emit_alerts(df, path, batch_id=0) == 2 and sinks.emit_alerts(df, path, batch_id=0) == 2
    assert spark.read.json(path).count() == 2
    assert sinks.emit_alerts(df, str(tmp_path / "k"), only_known=True) == 1 and sinks.emit_alerts(df, str(tmp_path / "k"), only_known=True) == 1
    assert spark.read.json(str(tmp_path / "k")).count() == 2
    with pytest.raises(ValueError, match="score"):
        sinks.scored_events(df, None, 0)


def folder_bytes(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names)


def test_alerts_are_small_on_disk(spark, tmp_path):
    rows = spark.range(20_000).selectExpr("concat('uid-', id) AS uid", "'AttackUncertain' AS decision_label", "rand(1) AS p_attack", "'binary_attack_low_conf' AS reason_codes")
    rows = rows.withColumns({f"a_rather_long_column_name_{i}": F.lit(f"value {i}") for i in range(20)}).cache()
    path = str(tmp_path / "alerts")
    assert sinks.emit_alerts(rows, path, batch_id=0) == 20_000
    text = rows.agg(F.sum(F.length(F.to_json(F.struct("*"))) + 1)).first()[0]
    assert folder_bytes(path) < text / 8
    assert sorted(spark.read.schema(rows.schema).json(path).select("uid", "p_attack").collect()) == sorted(rows.select("uid", "p_attack").collect())


def test_history_and_audit(spark):
    df = spark.createDataFrame([("a" * 64_000, 1), ("a" * 64_001, 2)], "d string, n int")
    got = sinks.history_rows(df, "d", "score", "n", "me", F.lit(5)).collect()
    assert got[0]["detail_json"] == "a" * 64_000 and '"_truncated":true' in got[1]["detail_json"] and len(got[1]["detail_json"]) < 64_000
    rows = sinks.audit_rows(spark.createDataFrame([("at 1.2.3.4", 9)], "p string, t long"), "login", ["p"], F.col("t")).first()
    assert rows["payload"] == '{"p":"at [REDACTED_IP]"}' and rows["event_type"] == "login"


# ---- streams -------------------------------------------------------------------------------------------------


def test_line_ranges_cover_every_line_once(tmp_path):
    p = tmp_path / "f"
    lines = [b"x" * (i % 7) + b"\n" for i in range(50)]
    p.write_bytes(b"".join(lines) + b"unfinished")
    size = ts.complete_size(str(p), block=8)
    assert size == sum(map(len, lines))
    for step in (1, 3, 10, 1000):
        got = []
        for at in range(0, size, step):
            got += list(ts.lines_between(str(p), at, min(at + step, size)))
        assert got == lines


def tail_into(spark, log, base):
    src = ts.tail_log(spark, str(log), ["a", "b"], 8)
    q = src.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return sorted((r["a"], r["b"]) for r in spark.read.schema("a string, b string").parquet(f"{base}/out").collect())


def test_tail_resumes_and_survives_truncation(spark, tmp_path):
    log = tmp_path / "conn.log"
    log.write_text("#fields\ta\tb\n1\tx\n2\ty\n3")
    assert tail_into(spark, log, tmp_path) == [("1", "x"), ("2", "y")]
    with log.open("a") as f:
        f.write("\tz\textra\n\n4\n")
    want = [("1", "x"), ("2", "y"), ("3", "z"), ("4", None)]
    assert tail_into(spark, log, tmp_path) == want
    log.write_text("9\tq\n")
    assert tail_into(spark, log, tmp_path) == want


@pytest.fixture()
def detector():
    s = Scaler(["Total Fwd Packets", "Flow Duration"], [0.0, 0.0], [5.0, 0.0], [2.0, 1e6])
    return Detector(
        LinearModel(["Attack", "Benign"], s, [[-1.0, 0.2]], [0.1]), LinearModel(["Benign", "DoS"], s, [[1.0, 0.0]], [0.0]),
        F.col("`Total Fwd Packets`") / 10.0, 0.5,
    )


def test_stream_equals_batch_in_many_batches(spark, tmp_path, detector):
    rows = [(i, str(i % 13), str(i / 10)) for i in range(90)]
    df = spark.createDataFrame(rows, "uid int, orig_pkts string, duration string")
    df.repartition(6).write.parquet(str(tmp_path / "in"))
    options = NoveltyOptions(reference_max=1.2)
    batch = sg.triage(df, detector, ["uid"], options=options)
    src = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for name, alerts in (("plain", None), ("alerts", str(tmp_path / "a"))):
        q = sg.start_scoring(src, detector, ["uid"], str(tmp_path / name), str(tmp_path / f"s{name}"), options=options, alerts=alerts)
        assert sg.run_once(q, str(tmp_path / f"s{name}")) == 90 and len(q.recentProgress) >= 6
        assert sg.progress_rows(spark, str(tmp_path / f"s{name}")).agg(F.max("rows_scored")).first()[0] == 90
        cols = ["uid", "decision_label", "reason_codes", "suspected_zero_day_pct"]
        got = sg.read_output(spark, str(tmp_path / name)).select(*cols)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, batch.select(*cols).collect()))
    assert spark.read.json(str(tmp_path / "a")).count() == batch.where("decision_label <> 'BenignOrLowRisk'").count()
    with pytest.raises(ValueError, match="reference"):
        sg.start_scoring(src, detector, ["uid"], "x", "y")
    assert sg.session_summary(batch).first()["rows_scored"] == 90


def test_totals_of_more_batches_than_spark_remembers(spark, tmp_path, detector):
    rows = [(i, str(i % 13), str(i / 10)) for i in range(104)]
    df = spark.createDataFrame(rows, "uid int, orig_pkts string, duration string")
    df.repartition(104, "uid").write.option("maxRecordsPerFile", 1).parquet(str(tmp_path / "in"))
    src = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = sg.start_scoring(src, detector, ["uid"], str(tmp_path / "out"), str(tmp_path / "state"), options=NoveltyOptions(reference_max=1.2))
    assert sg.run_once(q, str(tmp_path / "state")) == 104 and len(q.recentProgress) <= 101
    got = sg.progress_rows(spark, str(tmp_path / "state")).orderBy("batch_id").collect()
    assert [r["rows_scored"] for r in got] == list(range(1, 105)) and all("logOffset" in r["end_offset"] for r in got)


def test_timed_session_finishes_what_had_arrived(spark, tmp_path, detector):
    df = spark.createDataFrame([(i, "3", "1.5") for i in range(50)], "uid int, orig_pkts string, duration string")
    df.repartition(5).write.parquet(str(tmp_path / "in"))
    src = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    options, state = NoveltyOptions(reference_max=1.2), str(tmp_path / "state")
    start = lambda poll: sg.start_scoring(src, detector, ["uid"], str(tmp_path / "out"), state, options=options, poll_seconds=poll)
    assert sg.run_for(start, 1, state) == 50
    assert sg.read_output(spark, str(tmp_path / "out")).select("uid").distinct().count() == 50
    assert sg.rows_scored(spark, str(tmp_path / "none")) == 0
    failing = df.select((F.raise_error(F.lit("broken input")).cast("int")).alias("uid"), "orig_pkts", "duration")
    bad = lambda poll: sg.start_scoring(src.select(failing.columns).withColumn("uid", F.raise_error(F.lit("broken input")).cast("int")), detector, ["uid"], str(tmp_path / "o2"), str(tmp_path / "s2"), options=options, poll_seconds=poll)
    with pytest.raises(Exception, match="broken input"):
        sg.run_for(bad, 20, str(tmp_path / "s2"))


def test_logs_with_headers_of_their_own(spark, tmp_path):
    from netsieve.sources.conn_log import read_conn_log

    for name, text in {"a": "#fields\tuid\tproto\n1\ttcp\n", "b": "#fields\tproto\tuid\tsize\nudp\t2\t9\n", "c": "#fields\tx\n3\ticmp\n", "d": "# empty\n"}.items():
        (tmp_path / name).write_text(text)
    got = {tuple(sorted((k, v) for k, v in r.asDict().items() if v is not None)) for r in read_conn_log(spark, str(tmp_path)).collect()}
    assert got == {(("proto", "tcp"), ("uid", "1")), (("proto", "udp"), ("size", "9"), ("uid", "2")), (("0", "3"), ("1", "icmp"))}


def test_load_thresholds(spark, tmp_path):
    (tmp_path / "t.json").write_text('{"min_p_attack_known": 0.8,\n "source": "x"}')
    assert sg.load_thresholds(spark, str(tmp_path / "t.json")) == {"min_p_attack_known": 0.8, "min_szd_uncertain": 70.0, "min_open_set_uncertain": 0.6}


def test_timed_session_writes_packed_files(spark, tmp_path, detector):
    df = spark.createDataFrame([(i, "3", "1.5") for i in range(50)], "uid int, orig_pkts string, duration string")
    df.write.parquet(str(tmp_path / "in"))
    src = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))

    def start(poll):
        return sg.start_scoring(src, detector, ["uid"], str(tmp_path / "out"), str(tmp_path / "state"), options=NoveltyOptions(reference_max=1.2), alerts=str(tmp_path / "a"), poll_seconds=poll)

    assert sg.run_for(start, 1, str(tmp_path / "state")) == 50
    files = [f for place in ("out", "a") for _, _, names in os.walk(tmp_path / place) for f in names if f.startswith("part-")]
    assert files and all(f.endswith((".zstd.parquet", ".json.gz")) for f in files)
