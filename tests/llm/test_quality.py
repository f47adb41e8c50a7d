"""The quality classifier against direct minimisation of its risk, and on held-out labels."""

import numpy as np
import pyarrow as pa
import pytest

from strataweave.llm import quality

DATA = "/root/testdata/sf0.01"


def risk(x, p, prior, w):
    u = ((1 + x @ w) ** 2).mean() / 4
    return prior * ((1 - p @ w) ** 2).mean() / 4 + max(0.0, u - prior * ((1 + p @ w) ** 2).mean() / 4) + quality.RIDGE / 2 * (w @ w)


@pytest.mark.parametrize("prior", [0.3, 0.9])
def test_least_risk(prior):
    rng = np.random.default_rng(1)
    x, p = np.c_[rng.normal(size=(300, 3)), np.ones(300)], np.c_[rng.normal(1, 1, size=(60, 3)), np.ones(60)]
    w = quality.minimum(x.T @ x / 300, p.T @ p / 60, prior)
    best = risk(x, p, prior, w)
    for _ in range(3000):
        assert risk(x, p, prior, w + rng.normal(size=4) * rng.choice([0.3, 0.03, 0.003])) >= best - 1e-6


def test_moments_and_histogram(spark):
    rows = [(1, "Hello, World."), (2, None), (None, "abc def"), (3, "x"), (4, "a b\nc"), (1, "again 12"), (5, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    u, p = quality.moments(docs, np.array([1, 5]))
    x, ok = quality.describe(pa.array([t for _, t in rows]))
    assert u == pytest.approx(x[ok].T @ x[ok], abs=1e-5)
    mine = ok & np.array([i in (1, 5) for i, _ in rows])
    assert p == pytest.approx(x[mine].T @ x[mine], abs=1e-5) and u[-1, -1] == 4 and p[-1, -1] == 2
    a, b = quality.histogram(docs, np.zeros(quality.WIDTH), np.array([1]))
    assert a.sum() == 4 and b.sum() == 2


def test_prior():
    rng = np.random.default_rng(2)
    good, bad = rng.normal(1, 0.3, 20000), rng.normal(-1, 0.3, 20000)
    bins = np.linspace(-3, 3, 400)
    u = np.histogram(np.r_[good[:14000], bad[:6000]], bins)[0]
    assert quality.estimated_prior(u, np.histogram(good[14000:], bins)[0]) == pytest.approx(0.7, abs=0.03)


def test_held_out(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    model = quality.fitted(docs, labels.where("doc_id % 2 = 0"))
    got = {r["doc_id"]: r["accepted"] for r in quality.scored(docs, model).collect()}
    held = [(got[r["doc_id"]], r["quality"]) for r in labels.where("doc_id % 2 = 1").collect()]
    assert np.mean([a for a, q in held if q == 1]) > 0.97 and np.mean([not a for a, q in held if q == 0]) > 0.8
    assert 0.6 < model.prior < 0.99


def test_defined_cases(spark):
    docs = spark.createDataFrame([(1, "Some text here.", True, 0.5), (None, "Other text.", True, 0.5), (2, None, None, None), (3, "", False, 1.0)], "doc_id long, text string, accepted boolean, score double")
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (None, 1, None)], "doc_id long, quality int, toxic int")
    none = quality.fitted(docs, labels)
    assert none.weights is None
    assert {(r["doc_id"], r["score"], r["accepted"]) for r in quality.scored(docs, none).collect()} == {(1, None, True), (None, None, True), (2, None, False), (3, None, False)}
    kept = quality.only_accepted(docs, none)
    assert kept.dtypes == docs.dtypes and {r["doc_id"] for r in kept.collect()} == {1, None}
    assert quality.scored(docs.limit(0), quality.fitted(docs.limit(0), labels)).count() == 0


def test_toxic_prose_is_rejected(spark):
    data = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")
    model = quality.fitted(docs, labels.where("doc_id % 2 = 0"))
    got = {r["doc_id"]: r["accepted"] for r in quality.scored(docs, model).collect()}
    held = [(got[r["doc_id"]], r["toxic"]) for r in labels.where("doc_id % 2 = 1 and quality = 1").collect()]
    assert np.mean([a for a, t in held if not t]) > 0.99 and np.mean([not a for a, t in held if t]) > 0.5


def test_levels_of_words(spark):
    rows = [(i, "plain words" + (" vile" if i % 2 else " kind") * (1 + i % 3)) for i in range(400)] + [(None, "VILE, words")]
    levels = quality.word_levels(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), np.arange(0, 400, 2))
    bucket, _ = quality.word_buckets(pa.array(["vile kind words new"]))
    assert levels[bucket].tolist() == [3, quality.LEVELS, 0, 0]
    x, _ = quality.describe(pa.array(["Vile words", None]), levels)
    assert x[0, -1 - quality.LEVELS : -1] == pytest.approx([0, 0, 0.5**0.5, 0]) and not x[1, :-1].any()
