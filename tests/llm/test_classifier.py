import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from logloom.llm import catalog, classifier


def auc(score, label):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    n1 = label.sum()
    return (rank[label == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(label) - n1))


def test_held_out_accuracy(spark, data):
    big = data.replace("0.001", "0.01")
    got = catalog.op10_classifier(spark, big)
    docs = spark.read.parquet(f"{big}/documents.parquet")
    rows = got.collect()
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in docs.select("doc_id").collect())
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
    held = got.where("held_out").join(spark.read.parquet(f"{big}/labels.parquet"), "doc_id").collect()
    label, score = np.array([r.quality for r in held]), np.array([r.score for r in held])
    assert auc(score, label) > 0.97
    assert (np.array([r.predicted for r in held]) == label).mean() > 0.93


def test_held_out_labels_are_never_used(spark, data):
    docs, labels = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "labels"))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    turned = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = ({r.doc_id: r.score for r in classifier.classify(docs, x).collect()} for x in (labels, turned))
    assert a.keys() == b.keys()
    assert max(abs(a[i] - b[i]) for i in a) < 1e-9


def test_normal_equations_are_those_of_all_rows(spark):
    rng = np.random.default_rng(0)
    x, y = rng.standard_normal((300, len(classifier.NAMES))), rng.integers(0, 2, 300)
    model = classifier.Model(features=20)
    df = spark.createDataFrame([(r.tolist(), float(v)) for r, v in zip(x, y, strict=True)], "__ll_x array<double>, y double").repartition(7)
    z = np.concatenate([model.mapped(x), y[:, None]], axis=1)
    assert np.allclose(classifier._summed_equations(df, model, 3), z.T @ z)


def test_random_features_approximate_the_kernel():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((40, len(classifier.NAMES)))
    model = classifier.Model(features=4000, width=5.0)
    z = model.mapped(x)[:, :-1]
    exact = np.exp(-((x[:, None] - x[None]) ** 2).sum(axis=2) / (2 * 5.0**2))
    assert np.abs(z @ z.T - exact).max() < 0.12


def test_isotonic():
    good, total = np.array([0, 3, 1, 0, 9]), np.array([4, 4, 4, 0, 9])
    p = classifier.isotonic(good, total)
    assert len(p) == 5 and (np.diff(p) >= 0).all()
    assert p[1] == p[2]


def test_scores_of_the_whole_query_by_hand(spark, data):
    """The whole method again on one machine: fold by fold, dense ridge, calibration by the means of all intervals."""
    top = data.replace("0.001", "0.01")
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{top}/documents.parquet").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{top}/labels.parquet").collect() if r.quality is not None}
    x = {i: np.array(classifier.document_statistics(t.encode())) for i, t in docs.items()}
    fold = {i: zlib.crc32(str(i).encode()) % 5 for i in docs}
    known = [i for i in docs if i in labels and fold[i]]
    mean, scale = np.mean([x[i] for i in known], axis=0), np.std([x[i] for i in known], axis=0)
    scale[scale == 0] = 1
    rng = np.random.default_rng(classifier.SEED)
    turn = rng.standard_normal((len(classifier.NAMES), classifier.FEATURES)) / classifier.WIDTH
    phase = rng.uniform(0, 2 * np.pi, classifier.FEATURES)

    def mapped(ids):
        z = np.clip((np.array([x[i] for i in ids]) - mean) / scale, -8, 8)
        return np.concatenate([np.cos(z @ turn + phase) * np.sqrt(2 / classifier.FEATURES), np.ones((len(ids), 1))], axis=1)

    fitting, calibrating = ([i for i in known if (fold[i] == 1) == c] for c in (False, True))
    a, y = mapped(fitting), np.array([labels[i] for i in fitting], dtype=float)
    weights = np.linalg.solve(a.T @ a / len(y) + classifier.RIDGE / classifier.FEATURES * np.eye(a.shape[1]), a.T @ y / len(y))
    place = lambda raw: np.clip(((raw + 0.5) / 2 * classifier.BINS).astype(int), 0, classifier.BINS - 1)
    good, total = np.zeros(classifier.BINS), np.zeros(classifier.BINS)
    np.add.at(good, place(mapped(calibrating) @ weights), [labels[i] for i in calibrating])
    np.add.at(total, place(mapped(calibrating) @ weights), 1)
    step = classifier.isotonic(good, total)
    ids = sorted(docs)
    raw = mapped(ids) @ weights
    want = dict(zip(ids, np.clip(step[place(raw)] * 0.999 + 0.001 * np.clip(raw, 0, 1), 0, 1), strict=True))
    got = {r.doc_id: r.score for r in catalog.op10_classifier(spark, top).collect()}
    off = [i for i in ids if abs(got[i] - want[i]) > 1e-6]
    assert got.keys() == want.keys() and len(off) <= 0.001 * len(ids)  # a raw score on the edge of a bin may fall on either side


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 1000), st.integers(0, 1000)), min_size=1, max_size=12))
def test_isotonic_never_decreases(pairs):
    good, total = np.array([min(p) for p in pairs]), np.array([max(p) for p in pairs])
    p = classifier.isotonic(good, total)
    assert len(p) == len(pairs) and (np.diff(p) >= 0).all() and (p > 0).all() and (p < 1).all()


def test_isotonic_of_unequal_totals():
    p = classifier.isotonic(np.array([0, 0, 10, 900]), np.array([1, 0, 1000, 1000]))
    assert (np.diff(p) >= 0).all() and abs(p[-1] - 900.5 / 1001) < 1e-12


def test_repeated_labels(spark, documents, data):
    labels = spark.read.parquet(f"{data}/labels.parquet")
    docs = documents.select("doc_id", "text")
    torn = labels.where("doc_id % 7 = 0").withColumn("quality", 1 - F.col("quality"))
    stats = classifier.statistics(docs).cache()
    plain, twice, less, mixed = (classifier.fit(stats, x).weights for x in (labels, labels.unionByName(labels), labels.where("doc_id % 7 != 0"), labels.unionByName(torn)))
    assert np.allclose(plain, twice) and np.allclose(less, mixed) and not np.allclose(plain, mixed)


def test_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(3, 1, "x"), (4, 0, "x"), (6, None, "x"), (7, 5, "x"), (None, 1, "x")], "doc_id long, quality int, text string")
    got = classifier.classify(odd, labels).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    assert [r.held_out for r in got if r.doc_id is None] == [False]
    assert classifier.classify(empty, labels).collect() == []
    assert {r.score for r in classifier.classify(odd, labels.where("false")).collect()} != set()
