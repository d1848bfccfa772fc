"""Fitted models against numeric re-computation and their stated properties."""

import math
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from netsieve.models import anomaly as an, boosting as bo, evaluate as ev
from netsieve.models.boosting import fit_boosted
from netsieve.models.calibrate import fit_calibrator, fit_isotonic, isotonic_value
from netsieve.models.linear import LinearModel, fit_logistic, score_supervised, top_contributions
from netsieve.models.neural import fit_neural
from netsieve.models.novelty import Detector, NoveltyOptions, detect_novel, fit_novelty_calibrator, apply_novelty_calibrator
from netsieve.models.preprocess import Scaler, fit_scaler
from netsieve.operators import prototypes as pt
from netsieve.operators.metrics import macro_f1
from netsieve.operators.ranking import stratified_split
from netsieve.sources.bundles import Bundle, feature_hash, load_bundle, same_contract, save_bundle

FEATURES = ["f0", "f1", "f2"]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(600):
        y = i % 3
        x = rng.normal(size=3) + [2.0 * (y == 1), 2.0 * (y == 2), 0]
        rows.append((i, *map(float, x), ["Benign", "DoS", "PortScan"][y]))
    return spark.createDataFrame(rows, "id int, f0 double, f1 double, f2 double, label string").repartition(4).cache()


def test_scaler(spark):
    df = spark.createDataFrame([(1.0, 5.0, None), (None, 5.0, None), (3.0, 5.0, None), (8.0, 5.0, None)], "a double, b double, c double")
    s = fit_scaler(df, ["a", "b", "c"])
    filled = np.array([1, 3, 3, 8.0])
    assert s.columns == ["a", "b"] and s.medians == [3.0, 5.0] and s.stds[1] == 1.0
    assert s.means[0] == pytest.approx(filled.mean()) and s.stds[0] == pytest.approx(filled.std())
    with pytest.raises(ValueError):
        fit_scaler(df, ["c"])


def gradient_norm(model, x, y, w, c):
    """Largest gradient entry of ``C*sum(w*loss) + |b|^2/2`` at the fitted coefficients."""
    z = (x - np.array(model.scaler.means)) / np.array(model.scaler.stds)
    coef, icept = np.array(model.coef), np.array(model.intercept)
    if len(coef) == 1:
        coef, icept = np.vstack([np.zeros_like(coef[0]), coef[0]]), np.array([0, icept[0]])
        free = [1]
    else:
        free = range(len(coef))
    s = z @ coef.T + icept
    p = np.exp(s - s.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    d = (p - np.eye(len(coef))[y]) * w[:, None]
    return max(abs((c * d.T @ z + coef)[k]).max() for k in free) / (c * w.sum())


@pytest.mark.parametrize("binary,balanced", [(False, False), (False, True), (True, False)])
def test_logistic_minimises_the_stated_objective(data, binary, balanced):
    df = data.where("label <> 'PortScan' OR id % 6 = 2")
    df = df.withColumn("label", F.when(F.col("label") == "Benign", "Benign").otherwise("Attack")) if binary else df
    model = fit_logistic(df, "label", FEATURES, balanced=balanced, c=0.05, max_iter=500)
    rows = df.collect()
    y = np.array([model.classes.index(r["label"]) for r in rows])
    counts = np.bincount(y)
    w = (len(y) / (len(counts) * counts))[y] if balanced else np.ones(len(y))
    x = np.array([[r[f] for f in FEATURES] for r in rows])
    assert gradient_norm(model, x, y, w, 0.05) < 1e-3


def test_scores_and_contributions(spark):
    scaler = Scaler(["a", "b"], [0.0, 0.0], [1.0, 0.0], [2.0, 1.0])
    m = LinearModel(["Attack", "Benign"], scaler, [[1.0, -3.0]], [0.5])
    df = spark.createDataFrame([(7, 3.0, 1.0), (8, None, 0.0)], "id int, a double, b double")
    got = {r["id"]: r for r in score_supervised(df, m, ["id"], proba_all=True).collect()}
    z = 0.5 + 1.0 - 3.0
    assert got[7]["p_attack"] == pytest.approx(1 / (1 + math.exp(z))) == got[7]["score"]
    assert got[7]["prediction"] == "Attack" and got[7]["p_Attack"] + got[7]["p_Benign"] == pytest.approx(1)
    top = top_contributions(df, m, 1).where("id = 7").first()["top_features"]
    assert [(t["name"], t["value"], t["contribution"]) for t in top] == [("b", 1.0, -3.0)]


def test_bundle_round_trip(spark, tmp_path, data):
    m = fit_logistic(data, "label", FEATURES)
    path = str(tmp_path / "b")
    save_bundle(spark, path, m.to_bundle(dataset_slug="x"))
    b = load_bundle(spark, path)
    assert b.config["feature_columns_hash"] == feature_hash(FEATURES) and len(feature_hash(FEATURES)) == 16
    back = LinearModel.from_bundle(b)
    assert back.coef == m.coef and back.scaler == m.scaler
    with pytest.raises(ValueError):
        same_contract(b, Bundle(["other"], {}, {}))
    spark.createDataFrame([("config", "{}")], "part string, body string").write.json(str(tmp_path / "bad"))
    with pytest.raises(FileNotFoundError, match="model"):
        load_bundle(spark, str(tmp_path / "bad"))


def test_boosting_and_neural_learn(data):
    for model in (fit_boosted(data, "label", FEATURES, max_iter=5, max_depth=3), fit_neural(data, "label", FEATURES, hidden=(8,), max_iter=40)):
        scored = model.add_probabilities(data)
        total = F.col("_p0") + F.col("_p1") + F.col("_p2")
        assert scored.where(F.abs(total - 1) > 1e-9).count() == 0
        right = ev.predict(data, model).where("prediction = label").count()
        assert right > 400


def leaf_by_leaf(bins, grad, hess, s):
    """A tree grown one leaf at a time from exact sums: (feature, bin, missing left) of each split, by gain, and leaf values by row."""

    def best(rows):
        sums = [np.zeros((1, 257, 3)) for _ in range(bins.shape[1])]
        for j, h in enumerate(sums):
            at = np.where(bins[rows, j] == bo.MISSING, 256, bins[rows, j].astype(int))
            for i, v in enumerate((grad[rows], hess[rows], np.ones(len(rows)))):
                h[0, :, i] = np.bincount(at, v, minlength=257)
        found = [{k: v[0] for k, v in bo.best_splits(h, s).items()} for h in sums]
        j = int(np.argmax([f["gain"] for f in found]))
        return found[j]["gain"], j, int(found[j]["bin"]), bool(found[j]["missing_left"])

    leaves, splits = [(0, np.arange(len(bins)))], []
    while len(leaves) < s.max_leaf_nodes:
        options = [(*best(rows), i) for i, (d, rows) in enumerate(leaves) if d < (s.max_depth or 99) and len(rows) >= 2 * s.min_samples_leaf]
        if not options or max(options)[0] <= 0:
            break
        gain, j, cut, missing, i = max(options, key=lambda o: o[0])
        depth, rows = leaves.pop(i)
        b = bins[rows, j]
        left = np.where(b == bo.MISSING, missing, b <= cut)
        splits.append((j, cut, missing))
        leaves += [(depth + 1, rows[left]), (depth + 1, rows[~left])]
    value = np.zeros(len(bins))
    for _, rows in leaves:
        value[rows] = -s.learning_rate * grad[rows].sum() / (hess[rows].sum() + s.l2_regularization)
    return splits, value


@pytest.mark.parametrize("leaves", [2, 5, 12])
def test_boosted_trees_equal_leaf_by_leaf_growth(spark, leaves):
    rng = np.random.default_rng(leaves)
    x = rng.normal(size=(700, 3)).round(1)
    x[rng.random(700) < 0.15, 0] = np.nan
    y = (np.nan_to_num(x[:, 0], nan=1.0) + x[:, 1] ** 2 + rng.normal(size=700) > 1).astype(int) + (x[:, 2] > 1)
    rows = [("abc"[c], *[None if np.isnan(v) else float(v) for v in r]) for c, r in zip(y, x, strict=True)]
    df = spark.createDataFrame(rows, "label string, f0 double, f1 double, f2 double").repartition(3)
    s = bo.BoostingSettings(max_iter=2, max_leaf_nodes=leaves, min_samples_leaf=10, max_depth=4, early_stopping=False)
    model = fit_boosted(df, "label", ["f0", "f1", "f2"], settings=s)
    bins = bo.to_bins(x, model.edges)
    raw = np.tile(np.array(model.baseline), (700, 1))
    for trees in model.trees:
        p = bo.probabilities(raw)
        for k, tree in enumerate(trees):
            splits, value = leaf_by_leaf(bins, p[:, k] - (y == k), p[:, k] * (1 - p[:, k]), s)
            have = [(f, b, m) for f, b, m in zip(tree.feature, tree.bin, tree.missing_left) if f >= 0]
            assert sorted(have) == sorted(splits) and len(tree.feature) == 2 * len(splits) + 1
            assert np.abs(model.raw_scores(bins)[:, k] - raw[:, k]).max() >= 0
            a = tree.arrays()
            assert np.abs(a["value"][bo.walk(a, bins)] - value).max() < 1e-5
            raw[:, k] += a["value"][bo.walk(a, bins)]
    scored = model.add_probabilities(df).collect()
    want = {tuple(r[1:]): p for r, p in zip(rows, bo.probabilities(raw), strict=True)}
    assert all(np.allclose([r["_p0"], r["_p1"], r["_p2"]], want[r["f0"], r["f1"], r["f2"]]) for r in scored)


def test_boosting_stops_early_and_uses_weights(spark):
    rng = np.random.default_rng(7)
    rows = [("ab"[int(rng.random() < 0.5)], float(v)) for v in rng.normal(size=1500)]
    df = spark.createDataFrame(rows, "label string, f0 double").withColumn("w", F.when(F.col("label") == "a", 3.0).otherwise(1.0))
    s = bo.BoostingSettings(max_leaf_nodes=4, n_iter_no_change=3, validation_fraction=0.3)
    model = fit_boosted(df, "label", ["f0"], settings=s)
    assert len(model.trees) < 60 and len(model.losses) == len(model.trees) + 1 and min(model.losses[-3:]) > model.losses[-4] - s.tol
    heavy = fit_boosted(df, "label", ["f0"], weight="w", settings=s)
    assert heavy.baseline[0] == pytest.approx(model.baseline[0] - np.log(3), abs=0.2)


def test_leaf_wise_and_sampled_boosting(data):
    for s in (bo.LEAF_WISE, bo.DEPTH_WISE):
        model = fit_boosted(data, "label", FEATURES, max_iter=4, settings=replace(s, column_fraction=0.5))
        assert ev.predict(data, model).where("prediction = label").count() > 400
        assert any({f for f in t.feature if f >= 0} != set(range(len(FEATURES))) for r in model.trees for t in r)


def test_boosting_of_odd_tables(spark):
    schema = "label string, f0 double, f1 double"
    with pytest.raises(ValueError, match="two classes"):
        fit_boosted(spark.createDataFrame([("a", 1.0, 2.0)], schema), "label", ["f0", "f1"])
    with pytest.raises(ValueError, match="two classes"):
        fit_boosted(spark.createDataFrame([], schema), "label", ["f0", "f1"])
    rows = [("ab"[i % 2], None, float("inf") if i % 3 else 1.0) for i in range(60)] + [(None, 5.0, 5.0)]
    model = fit_boosted(spark.createDataFrame(rows, schema), "label", ["f0", "f1"], max_iter=3)
    assert len(model.trees) >= 1 and model.edges == [[], []]


def test_searching_settings_together_equals_fitting_each(spark, data):
    df = data.withColumn("id", F.monotonically_increasing_id())
    space = {"learning_rate": [0.1, 0.3], "max_leaf_nodes": [3, 8], "max_iter": [3]}
    got = bo.search_boosting(df, ["id"], "label", FEATURES, space, n_iter=3, folds=2)
    assert len(got) == 3 and [r["macro_f1"] for r in got] == sorted((r["macro_f1"] for r in got), reverse=True)
    assert all(0.5 < r["macro_f1"] <= 1 for r in got)
    # one of them alone
    best = got[0]
    rows = stratified_split(df, ["id"], "label", [("0", 0.5)], "1", 42, out="_fold").persist()
    s = bo.BoostingSettings(validation_fraction=0.1, n_iter_no_change=10, l2_regularization=0.0, max_leaf_nodes=best["max_leaf_nodes"], learning_rate=best["learning_rate"], max_iter=3)
    edges, scores = bo.bin_edges(rows, FEATURES), []
    for f in "01":
        b = bo.Booster(rows, "label", FEATURES, [bo.Task(s, int(f))], fold="_fold", edges=edges)
        b.run()
        held = ev.predict(rows.where(F.col("_fold") == f), b.model(), "_pred")
        scores.append(macro_f1(held, "label", "_pred").first()["macro_f1"])
        b.close()
    assert best["macro_f1"] == pytest.approx(np.mean(scores), abs=1e-9)


@pytest.mark.parametrize("ranges", [1, 5, 40])
def test_isotonic_curve_equals_pooling_in_one_go(spark, ranges):
    rng = np.random.default_rng(ranges)
    f = rng.normal(size=3000).round(2)
    y = (rng.random(3000) < 1 / (1 + np.exp(-f))).astype(float)
    df = spark.createDataFrame([*zip(f.tolist(), y.tolist()), (None, 1.0), (float("nan"), 0.0)], "f double, y double").repartition(6)
    curve = fit_isotonic(df, ranges)
    xs = np.unique(f)
    means = [[y[f == x].sum(), (f == x).sum(), 1] for x in xs]
    pooled = []
    for m in means:
        pooled.append(m)
        while len(pooled) > 1 and pooled[-2][0] / pooled[-2][1] >= pooled[-1][0] / pooled[-1][1]:
            a = pooled.pop()
            pooled[-1] = [p + q for p, q in zip(pooled[-1], a, strict=True)]
    want = np.concatenate([[s / n] * k for s, n, k in pooled])
    got = {r["f"]: r["v"] for r in df.select("f", isotonic_value(F.col("f"), curve).alias("v")).collect() if r["f"] is not None}
    assert np.allclose([got[x] for x in xs], want)
    odd = spark.createDataFrame([(-99.0,), (99.0,), (None,), (float("nan"),)], "f double").select(isotonic_value(F.col("f"), curve).alias("v")).collect()
    assert odd[0]["v"] == pytest.approx(want[0]) and odd[1]["v"] == pytest.approx(want[-1]) and odd[2]["v"] is None and odd[3]["v"] is None
    assert fit_isotonic(df.where("false")) == {"x": [], "y": []}


@pytest.mark.parametrize("method", ["sigmoid", "isotonic"])
def test_calibration(data, method):
    m = fit_logistic(data, "label", FEATURES)
    df = data
    for i, z in enumerate(m.logits()):
        df = df.withColumn(f"s{i}", z)
    names = ["s0", "s1", "s2"]
    cal = fit_calibrator(df, "label", m.classes, names, method)
    out = df.select("label", *[p.alias(f"p{i}") for i, p in enumerate(cal.probabilities([F.col(n) for n in names]))])
    assert out.where(F.abs(F.col("p0") + F.col("p1") + F.col("p2") - 1) > 1e-9).count() == 0
    share = out.agg(F.avg("p1")).first()[0]
    assert share == pytest.approx(1 / 3, abs=0.05)


def test_isolation_forest(spark):
    rng = np.random.default_rng(2)
    rows = [(i, *map(float, rng.normal(size=4))) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, f0 double, f1 double, f2 double, f3 double")
    cols = ["f0", "f1", "f2", "f3"]
    one = an.fit_isolation_forest(df.repartition(1), ["id"], cols)
    two = an.fit_isolation_forest(df.repartition(5), ["id"], cols)
    assert len(one.trees) == 200 and one.rows_per_tree == 256
    # The same rows go to the same trees; only the last digits of the scaler may differ with summation order.
    assert [t["feature"] for t in one.trees] == [t["feature"] for t in two.trees]
    thr = an.fit_threshold(df, one)
    scored = an.score_anomaly(df, one, thr, ["id"])
    assert scored.where("NOT is_anomaly").count() >= 380
    far = spark.createDataFrame([(1, 9.0, 9.0, 9.0, 9.0), (2, 0.0, 0.0, 0.0, 0.0)], "id int, f0 double, f1 double, f2 double, f3 double")
    got = {r["id"]: r["anomaly_score"] for r in an.score_anomaly(far, one, thr, ["id"]).collect()}
    assert got[1] > thr > got[2] and 0 < got[2] < got[1] < 1
    back = an.load_anomaly_model(one.to_bundle(thr))
    assert an.score_anomaly(far, back, thr, ["id"]).where("id = 1").first()["anomaly_score"] == pytest.approx(got[1])


def test_packed_tree_walk_equals_recursion():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(64, 3))
    t = an.grow_tree(x, 5, np.random.default_rng(1))

    def walk(row, i=0):
        while t["feature"][i] >= 0:
            i = t["left"][i] if row[t["feature"][i]] <= t["cut"][i] else t["right"][i]
        return t["depth"][i]

    q = rng.normal(size=(50, 3)) * 2
    assert an.path_lengths([an.pack_tree(t)], q) == pytest.approx([walk(r) for r in q])


def test_autoencoder(spark):
    sizes = an.layer_sizes(3, (4,), 2)
    w = an.init_weights(sizes, 1)
    x = np.random.default_rng(1).normal(size=(5, 3))
    loss = lambda v: float(((an.reconstruct(v, sizes, x)[-1] - x) ** 2).mean())
    g = an.gradient(w, sizes, x)
    for i in range(0, len(w), 7):
        step = np.zeros_like(w)
        step[i] = 1e-6
        assert g[i] == pytest.approx((loss(w + step) - loss(w - step)) / 2e-6, abs=1e-6)
    rng = np.random.default_rng(3)
    base = rng.normal(size=500)
    df = spark.createDataFrame([(float(b), float(2 * b), float(-b)) for b in base], "f0 double, f1 double, f2 double").repartition(3)
    short = an.fit_autoencoder(df, FEATURES, epochs=1, batch_size=32, hidden=(8,), latent=1)
    long = an.fit_autoencoder(df, FEATURES, epochs=8, batch_size=32, lr=0.01, hidden=(8,), latent=1)
    error = lambda m: df.select(m.score().alias("e")).agg(F.avg("e")).first()[0]
    assert error(long) < error(short) and error(long) < 0.3
    odd = spark.createDataFrame([(2.0, -4.0, 2.0)], "f0 double, f1 double, f2 double")
    assert odd.select(long.score().alias("e")).first()["e"] > 5 * error(long)


def test_prototypes(spark):
    df = spark.createDataFrame([(0.0, 0.0, "a"), (10.0, 10.0, "b"), (4.0, 6.0, None)], "x double, y double, label string")
    protos = pt.Prototypes(["a", "b"], [[0.0, 0.0], [5.0, 5.0]])
    flat = [r[0] for r in df.select(pt.nearest_distance([F.col("x"), F.col("y")], protos)).collect()]
    vec = [r[0] for r in df.select(pt.nearest_distance_vector(F.array("x", "y"), protos)).collect()]
    assert flat == pytest.approx([0.0, math.sqrt(50), math.sqrt(2)]) and vec == pytest.approx(flat)
    fitted = pt.fit_prototypes(df, "label", [F.col("x"), F.col("y")], ["b", "zz", "a"])
    assert fitted == pt.Prototypes(["b", "a"], [[10.0, 10.0], [0.0, 0.0]])


def test_detector_contract_and_temperature(data):
    s = fit_scaler(data, FEATURES)
    fam = LinearModel(["a", "b", "c"], s, [[1.0, 0, 0], [0, 1.0, 0], [0, 0, 1.0]], [0.0, 0.0, 0.0])
    bin_ = LinearModel(["Attack", "Benign"], s, [[1.0, 1.0, 1.0]], [0.0])
    d = Detector(bin_, fam, F.col("f0"), 0.5)
    cold = detect_novel(data, d).agg(F.avg("max_class_probability")).first()[0]
    hot = detect_novel(data, d, NoveltyOptions(temperature=5.0)).agg(F.avg("max_class_probability")).first()[0]
    assert hot < cold
    other = LinearModel(["a", "b"], Scaler(["f0"], [0.0], [0.0], [1.0]), [[1.0]], [0.0])
    with pytest.raises(ValueError, match="feature_columns"):
        Detector(bin_, other, F.col("f0"), 0.5)
    with pytest.raises(ValueError, match="Attack"):
        Detector(fam, fam, F.col("f0"), 0.5)


def test_novelty_calibrator(data):
    df = data.withColumnsRenamed({"f0": "p_attack", "f1": "suspected_zero_day_pct"})
    cal, summary = fit_novelty_calibrator(df, ["id"], "label", ["Benign", "DoS"], ["p_attack", "suspected_zero_day_pct"], 0.3)
    assert summary["rows_train"] + summary["rows_val"] == 600 and summary["val_alert_rate"] <= 0.3
    out = apply_novelty_calibrator(df, cal)
    hit = out.where("novelty_calibrated_flag").groupBy((F.col("label") == "PortScan").alias("u")).count().collect()
    counts = {r["u"]: r["count"] for r in hit}
    assert counts[True] > 4 * counts.get(False, 0)
    with pytest.raises(ValueError, match="open_set"):
        fit_novelty_calibrator(df, ["id"], "label", ["Benign"])


def test_leave_family_out_and_noise(data):
    rep = ev.leave_family_out(data, "label", FEATURES, "DoS")
    held = {r["label"]: r for r in rep.collect()}["DoS"]
    assert held["support"] == 200 and held["recall"] == 0.0
    with pytest.raises(ValueError):
        ev.leave_family_out(data, "label", FEATURES, "absent")
    m = fit_logistic(data, "label", FEATURES)
    calm = ev.perturbation_flip_rate(data, m, ["id"], 0.0).first()["prediction_flip_rate"]
    wild = ev.perturbation_flip_rate(data, m, ["id"], 2.0).first()["prediction_flip_rate"]
    again = ev.perturbation_flip_rate(data.repartition(2), m, ["id"], 2.0).first()["prediction_flip_rate"]
    assert calm == 0.0 and wild > 0.2 and wild == pytest.approx(again, abs=0.01)


def test_memory_of_many_boosted_models(spark):
    """Workers that search 24 models hold blocks and histograms of bounded size, and give the same trees."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(12_000, 3))
    y = np.where(x[:, 0] + rng.normal(size=12_000) > 0, "b", "a")
    df = spark.createDataFrame([(str(c), *map(float, v)) for c, v in zip(y, x)], "label string, f0 double, f1 double, f2 double").coalesce(1)
    s = bo.BoostingSettings(max_iter=1, max_leaf_nodes=31, early_stopping=False)
    booster = bo.Booster(df, "label", ["f0", "f1", "f2"], [bo.Task(s) for _ in range(240)])
    booster.start()
    # Raw scores of all models: 11.5 MB in one row before.
    assert booster.blocks.agg(F.max(F.length("raw"))).first()[0] <= bo.BLOCK_BYTES
    keys = {(t, 0): list(range(30)) for t in range(240)}
    shares = list(booster.shares(keys, {key: [0, 1, 2] for key in keys}))
    assert sum(map(len, shares)) == 240 and len(shares) > 1  # 132 MB at once before
    assert all(24 * 30 * 3 * 256 * len(share) <= bo.HELD for share in shares)
    booster.close()


def test_shares_of_histograms_give_the_same_trees(spark, data, monkeypatch):
    def leaves():
        tasks = [bo.Task(bo.BoostingSettings(max_iter=2, max_leaf_nodes=n, min_samples_leaf=2, early_stopping=False)) for n in (4, 8)]
        booster = bo.Booster(data, "label", FEATURES, tasks)
        booster.run()
        booster.close()
        return [(t.feature, t.bin, [round(v, 9) for v in t.value]) for task in tasks for r in task.trees for t in r]

    whole = leaves()
    monkeypatch.setattr(bo, "HELD", 1)
    assert leaves() == whole
