"""Whitening, hard negatives and toxicity on small tables: exact arithmetic, brute force, held-out accuracy, hard rows."""

from __future__ import annotations

import math
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from surety.llm import hard_negatives, toxicity, whitening
from surety.llm.common import fold, importable

VECTORS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())),
                        T.StructField("label", T.IntegerType())])
NAN, INF = float("nan"), float("inf")
#: Vectors that take no part in whitening or mining.
BAD = [None, [1.0, None, 0.0], [NAN, 1.0, 2.0], [1.0, INF, 0.0], [-INF, 0.0, 0.0]]


def table(spark, rows, parts=3):
    """The rows, and extra columns under names that operators use themselves."""
    importable(spark)
    df = spark.createDataFrame(rows, VECTORS).repartition(parts)
    return df.withColumns({c: F.lit("x") for c in ("x", "shard", "deal", "key", "n", "score", "rank", "Component", "dim", "windows")})


# ---------------------------------------------------------------- whitening

def exact_covariance(x):
    n, dim = len(x), len(x[0])
    mean = [Fraction(sum(r[i] for r in x), n) for i in range(dim)]
    return np.array([[float(sum((r[i] - mean[i]) * (r[j] - mean[j]) for r in x) / n) for j in range(dim)] for i in range(dim)])


def quantised(v):
    return [math.floor(1024 * float(np.float32(c))) + 100_000 for c in v]


def test_whitening_against_exact_fractions(spark):
    rng = np.random.default_rng(5)
    mix = rng.normal(size=(10, 10))
    good = [(n, (rng.normal(size=10) @ mix).tolist(), 1) for n in range(60)]
    good += [good[3], good[3], (None, [0.0] * 10, None), (7, [-0.0001] * 10, 0)]
    rows = good + [(100 + n, v, 0) for n, v in enumerate(BAD)]
    out = whitening.whiten(table(spark, rows)).collect()
    x = [quantised(v) for _, v, _ in good]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    assert len(out) == 8 * n and {r.n for r in out} == {n}
    covariance = exact_covariance(x)
    values, _ = np.linalg.eigh(covariance)
    deviations = defaultdict(list)
    for (i, _, _), r in zip(good, x):
        deviations[i].append(sum((n * c - s) ** 2 for c, s in zip(r, sums)))
    for r in out:
        assert r.deviation in deviations[r.vec_id] and int(r.deviation_exact) == r.deviation
        assert r.explained == pytest.approx(values[::-1][r.component - 1] / np.trace(covariance), rel=1e-9)
        assert r.identity_error <= 1e-9
    model = whitening.fit(table(spark, rows))[10]
    assert np.allclose(model.covariance, covariance, rtol=1e-15, atol=0)
    y = (n * np.array(x, dtype=object) - np.array(sums, dtype=object)).astype(float) / n
    mine = {(r.vec_id, r.component): r.whitened for r in out if len(deviations[r.vec_id]) == 1}
    for k in range(8):
        want = y @ model.components[:, k] / np.sqrt(model.values[k])
        assert np.allclose(covariance @ model.components[:, k], model.values[k] * model.components[:, k], atol=1e-6)
        for (i, _, _), w in zip(good, want):
            if len(deviations[i]) == 1:
                assert mine[i, k + 1] == pytest.approx(w, abs=1e-9)


def test_whitening_totals_are_exact_beyond_64_bits():
    rng = np.random.default_rng(6)
    for width in (20, 45, 70):      # bits of y: one limb, two limbs, Python's numbers
        y = [[int(v) * (1 << max(0, width - 30)) + 1 for v in r] for r in rng.integers(-(1 << min(width, 30)), 1 << min(width, 30), (37, 4))]
        totals = whitening.PairTotals(4)
        kind = object if width >= 50 else np.int64
        for part in (y[:20], y[20:]):
            totals.add(np.array(part, dtype=kind))
        for i in range(4):
            assert totals.total(i, i) == sum(r[i] ** 2 for r in y)
            for j in range(i + 1, 4):
                assert totals.total(i, j) == sum((r[i] + r[j]) ** 2 for r in y)
        assert whitening._deviations(np.array(y, dtype=kind)) == [sum(v * v for v in r) for r in y]


def test_whitening_does_not_depend_on_the_layout(spark):
    rng = np.random.default_rng(8)
    rows = [(n, rng.normal(size=6).tolist(), 0) for n in range(300)]
    one, many = (whitening.fit(table(spark, rows, parts))[6] for parts in (1, 7))
    assert (one.covariance == many.covariance).all() and (one.components == many.components).all()


@pytest.mark.parametrize("rows, expected", [
    ([], 0), ([(n, v, 0) for n, v in enumerate(BAD)], 0), ([(1, [], 0)], 0),
    ([(1, [0.5, 1.5], 0)], 2),                      # one row: nothing varies
    ([(n, [0.25, 0.25, 0.25], 0) for n in range(9)], 27),
    ([(1, [1.0, 2.0], 0), (2, [3.0, 1.0], 0), (3, [1.0, 2.0, 3.0], 0), (4, [2.0, 2.0, 3.5], 0)], 10),    # two lengths
    ([(n, [1e30 * n, -1e30, float(n)], 0) for n in range(4)], 12),
])
def test_whitening_of_hard_tables(spark, rows, expected):
    out = whitening.whiten(table(spark, rows)).collect()
    assert len(out) == expected
    for r in out:
        assert r.whitened is None or math.isfinite(r.whitened)
        assert r.identity_error <= 1e-4
    if expected in (2, 27):
        assert all(r.whitened is None and r.explained is None and r.deviation == 0 for r in out)


# ---------------------------------------------------------------- hard negatives

def brute_negatives(rows, asked, positives=5, negatives=5):
    own = [(i, l, [math.floor(256 * float(np.float32(c))) for c in v]) for i, v, l in rows
           if i is not None and l is not None and v and all(c is not None and math.isfinite(c) for c in v)]
    out, anchors = [], {(i, l, tuple(x)) for i, l, x in own if asked(i)}
    for i, label, x in anchors:
        scored = sorted((-sum(a * b for a, b in zip(x, y)), j, m) for j, m, y in own if j != i and len(y) == len(x))
        for s, j, _ in [t for t in scored if t[2] == label][:positives]:
            fits = [t for t in scored if t[2] != label and 80 * -s <= 100 * -t[0] <= 100 * -s][:negatives]
            out += [(i, j, k + 1, t[1], -s, -t[0]) for k, t in enumerate(fits)]
    return sorted(out)


@pytest.mark.parametrize("seed, shard", [(1, 200), (2, 1 << 19), (3, 64)])
def test_hard_negatives_against_brute_force(spark, seed, shard, monkeypatch):
    """Clusters, a vector that a third of the rows share, ties, rare labels, repeated ids, vectors of two lengths."""
    monkeypatch.setattr(hard_negatives, "SHARD", shard)
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(4, 5)) * 2
    rows = [(n, (centres[n % 4] + rng.normal(size=5) * 0.3).tolist(), int(rng.integers(0, 4))) for n in range(240)]
    rows += [(1000 + n, [0.5] * 5, n % 3) for n in range(130)]
    rows += [(3000 + n, rng.normal(size=5).tolist(), 50 + n) for n in range(20)]      # labels of one row each
    rows += [rows[0], rows[0], (0, rows[1][1], 2), (20, rows[2][1], None), (None, [1.0] * 5, 1), (40, [0.0] * 5, 1)]
    rows += [(5000 + n, rng.normal(size=3).tolist(), n % 2) for n in range(30)] + [(7000 + n, v, 1) for n, v in enumerate(BAD)] + [(8000, [], 1)]
    got = hard_negatives.mine(table(spark, rows), F.col("vec_id") % 20 == 0).collect()
    assert sorted(map(tuple, got)) == brute_negatives(rows, lambda i: i % 20 == 0)
    assert len(got) > 100


def test_hard_negatives_of_long_and_extreme_vectors(spark):
    rng = np.random.default_rng(9)
    rows = [(n, (rng.normal(size=4) * 30000).tolist(), n % 2) for n in range(80)]       # scores beyond what a double holds
    got = hard_negatives.mine(table(spark, rows), F.col("vec_id") % 5 == 0).collect()
    assert sorted(map(tuple, got)) == brute_negatives(rows, lambda i: i % 5 == 0) and got
    assert hard_negatives.mine(table(spark, [(0, [1e38, -1e38], 0), (1, [1e38, -1e38], 0), (2, [1e38, -1e38], 1)]), F.col("vec_id") == 0).count() == 1


def test_hard_negatives_without_rows_or_partners(spark):
    assert hard_negatives.mine(table(spark, []), F.lit(True)).count() == 0
    assert hard_negatives.mine(table(spark, [(0, [1.0], 1)]), F.lit(True)).count() == 0
    assert hard_negatives.mine(table(spark, [(0, [1.0], 1), (1, [1.0], 1)]), F.lit(True)).count() == 0       # no other label
    assert hard_negatives.mine(table(spark, [(0, [1.0], 1), (1, [-1.0], 1), (2, [-1.0], 2)]), F.lit(True)).count() == 0  # below zero
    assert hard_negatives.mine(table(spark, [(0, [0.0], 1), (1, [1.0], 1), (2, [1.0], 2)]), F.col("vec_id") == 0).count() == 1


def test_tree_opens_few_leaves_where_clusters_are_apart():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(64, 4)) * 50
    x = np.floor((centres[:, None] + rng.normal(size=(64, 64, 4))).reshape(-1, 4) * 16).astype(np.int64)
    tree = hard_negatives.Tree(np.arange(len(x)), np.zeros(len(x), np.int64), x)
    (best,) = tree.best(-1, 0, x[0], [(-1 << 62, 1 << 62)], True, 5)
    scores = x @ x[0]
    want = sorted(zip((-scores).tolist(), range(len(x))))[:5]
    assert best == want
    bounds = np.maximum(x[0], 0) @ tree.high.T + np.minimum(x[0], 0) @ tree.low.T
    opened = (bounds[:tree.leaves] >= -best[-1][0]).sum()
    assert opened < tree.leaves / 4


# ---------------------------------------------------------------- toxicity

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])
LABELS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("toxic", T.IntegerType())])
RUDE = ["dreadfool", "scumbler", "vileling"]


def spoken(rng, rude):
    words = [f"{a}{b}" for a, b in zip(rng.choice(["ba", "lo", "mi", "te", "ru"], 60), rng.choice(["na", "sel", "tor", "wen"], 60))]
    if rude:
        for at in rng.integers(0, 60, 2):
            words[at] = str(rng.choice(RUDE))
    return " ".join(words)


@pytest.fixture(scope="module")
def judged(spark):
    importable(spark)
    rng = np.random.default_rng(11)
    rows = [(n, spoken(rng, n % 5 == 0), int(n % 5 == 0)) for n in range(600)]
    docs = [(i, t) for i, t, _ in rows] + [(601, None), (602, ""), (603, "..."), (604, spoken(rng, False) + " " + "ba " * 60000 + "Scumbler!"),
                                            (None, "no id"), (5, rows[5][1]), (5, rows[5][1])]
    labels = [(i, y) for i, _, y in rows if i % 3] + [(1, None), (None, 1), (2, 0), (2, 0), (9999, 1)]
    df = spark.createDataFrame(docs, DOCS).repartition(3).withColumns({c: F.lit(1) for c in ("toxic", "pick", "Score", "bins", "label")})
    return df, spark.createDataFrame(labels, LABELS), rows


def slow_grams(text):
    c = " ".join("".join(ch if ch.isalnum() else " " for ch in text.lower()).split())
    c = f" {c} " if c else " "
    return {(n, c[i:i + n]) for n in toxicity.LENGTHS for i in range(len(c) - n + 1)}


def test_toxicity_features_are_the_distinct_character_ngrams():
    for text in ("Ab, c!", "", "ÉCOLE  d'été\n東京 x", "a" * 50, "?!", "abcdefg hij"):
        want = slow_grams(text)
        assert len(np.unique(toxicity.grams(text.encode()))) == len(want)      # no two of these few share a bin
    assert set(toxicity.grams(b"IDIOT").tolist()) == set(toxicity.grams(b"--idiot!").tolist())
    assert set(toxicity.grams("idiot".encode())) <= set(toxicity.grams("you idiot.".encode()))


def test_toxicity_held_out_accuracy_and_hard_rows(judged):
    docs, labels, rows = judged
    model = toxicity.fit(docs, labels, fold("doc_id", 5) != 0)
    out = {r.doc_id: r for r in toxicity.predict(docs.withColumn("held", fold("doc_id", 5) == 0), model).collect()}
    truth = {i: y for i, _, y in rows}
    held = [i for i in truth if out[i].held]
    assert len(held) > 50 and all(out[i].predicted == truth[i] for i in held)
    assert out[604].predicted == 1                      # one word in a text of 180,000 characters
    assert out[601].score == out[602].score == out[603].score < 0.5
    assert all(0 <= r.score <= 1 for r in out.values())


def test_toxicity_scores_against_a_plain_loop(judged):
    """Counts, ratios and scores once more, by sets of bins."""
    docs, labels, rows = judged
    model = toxicity.fit(docs, labels, F.lit(True))
    known = {i for i, _, _ in rows if i % 3}
    texts = [(set(toxicity.grams(t.encode()).tolist()), y) for i, t, y in rows if i in known]
    texts += [texts[[i for i, _, _ in rows if i in known].index(5)]] * 2           # the repeated row
    n = [sum(y == c for _, y in texts) for c in (0, 1)]
    for b in np.flatnonzero(model.weights)[:200].tolist():
        held = [sum(b in g for g, y in texts if y == c) for c in (0, 1)]
        share = n[1] / sum(n)
        ratio = math.log((held[1] + 10 * share) / n[1]) - math.log((held[0] + 10 * (1 - share)) / n[0])
        one = toxicity.ratios(np.array([held[1]]), np.array([held[0]]), n[1], n[0])[0]
        assert one == pytest.approx(ratio) and ratio * model.weights[b] != 0
    for i, t, _ in rows[:40]:
        z = model.intercept + sum(model.weights[b] for b in set(toxicity.grams(t.encode()).tolist()))
        assert model.score(t.encode()) == pytest.approx(1 / (1 + math.exp(-z)), rel=1e-9)


def test_toxicity_regression_reaches_the_minimum():
    rng = np.random.default_rng(2)
    x = (rng.random((80, 6)) < 0.4) * rng.normal(size=6)
    y = (x @ rng.normal(size=6) + rng.normal(size=80) > 0).astype(float)
    at = np.cumsum([0, *(x != 0).sum(1)])
    columns = np.concatenate([np.flatnonzero(r) for r in x])
    w = toxicity.regression(at, columns, x[x != 0], y, np.ones(80), 6)
    p = 1 / (1 + np.exp(-(x @ w[:-1] + w[-1])))
    assert np.abs(x.T @ (p - y) + toxicity.RIDGE * w[:-1]).max() < 0.02 and abs((p - y).sum()) < 0.02


def test_toxicity_learns_from_training_rows_only(judged):
    docs, labels, rows = judged
    flipped = labels.withColumn("toxic", F.when(fold("doc_id", 5) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one, two = (toxicity.fit(docs, l, fold("doc_id", 5) != 0) for l in (labels, flipped))
    assert (one.weights == two.weights).all() and one.intercept == two.intercept


def test_toxicity_without_labels_or_documents(spark, judged):
    docs, labels, _ = judged
    none = toxicity.fit(docs, labels.limit(0), F.lit(True))
    assert toxicity.predict(docs, none).agg(F.max("score")).first()[0] < 1e-9
    only = toxicity.fit(docs, labels.filter("toxic = 1"), F.lit(True))
    assert toxicity.predict(docs, only).filter("predicted <> 1").count() == 0
    assert toxicity.predict(docs.limit(0), none).count() == 0 and toxicity.fit(docs.limit(0), labels, F.lit(True)).score(b"x") < 1e-9
