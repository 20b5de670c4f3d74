"""Quality and toxicity: brute-force risks, out-of-fold chaining, held-out accuracy, edge cases."""

import zlib

import numpy as np
import pytest

from barflow.llm import quality, toxicity
from barflow.llm.common import read
from barflow.llm.text_features import STATS

TABLES = "/root/testdata/sf0.1"
DOCS = "doc_id long, text string, key string, score string, x string, words string, y0 string, part string"
LABELS = "doc_id long, quality int, toxic int, text string, x string"
GOOD, BAD, VILE = "A calm and well written line about rivers. ", "BUY!!! $$$ NOW >>> 0000 ", "you vile stupid wretch "


def docs_of(spark, texts, ids=None):
    return spark.createDataFrame([(i, t, "k", "s", "x", "w", "y", "p") for i, t in zip(ids or range(len(texts)), texts)], DOCS)


def labels_of(spark, rows):
    return spark.createDataFrame([(d, q, t, "t", "x") for d, q, t in rows], LABELS)


def corpus(n=300):
    rng = np.random.default_rng(1)
    texts = ["".join((GOOD, BAD, VILE)[k] for k in rng.choice(3, 8, p=((0.9, 0.1, 0), (0.1, 0.9, 0), (0.5, 0.1, 0.4))[i % 3])) + str(i) for i in range(n)]
    return texts, [(i, int(i % 3 != 1), int("vile" in t)) for i, t in enumerate(texts)]


def test_quality_minimises_the_risk():
    rng = np.random.default_rng(0)
    one = lambda n, at: np.concatenate((np.ones((n, 1)), rng.normal(at, 1, (n, 3))), 1)
    p, u, prior = one(400, 0.7), np.concatenate((one(500, 0.7), one(500, -0.7))), 0.5
    w = quality.minimise(lambda w: (quality.sums(p, w, True), quality.sums(u, w, False)), 4, prior)

    def risk(w):
        loss = lambda x, y: np.logaddexp(0, -y * (x @ w)).mean()
        return prior * loss(p, 1) + max(0.0, loss(u, -1) - prior * loss(p, -1)) + quality.RIDGE / 2 * w @ w

    slope = [(risk(w + e) - risk(w - e)) / 2e-5 for e in 1e-5 * np.eye(4)]
    assert np.abs(slope).max() < 1e-3
    assert risk(w) <= min(risk(w + d) for d in rng.normal(0, 0.1, (200, 4)))


def test_quality_risk_stays_non_negative():
    x = np.concatenate((np.ones((6, 1)), np.random.default_rng(2).normal(0, 1, (6, 9))), 1)
    p, u, prior = x[:3], x[3:], 0.9  # so few rows that the bracket would go below zero
    w = quality.minimise(lambda w: (quality.sums(p, w, True), quality.sums(u, w, False)), 10, prior, ridge=1e-4)
    loss = lambda x, y: np.logaddexp(0, -y * (x @ w)).mean()
    assert -1e-9 <= loss(u, -1) - prior * loss(p, -1) < 0.05


@pytest.mark.parametrize("parts", [1, 5])
def test_quality_sums_are_of_all_rows(spark, parts):
    texts, labels = corpus()
    got = quality.quality_scores(docs_of(spark, texts).repartition(parts), labels_of(spark, labels)).collect()
    held = {i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert {r.doc_id for r in got if r.held_out} == held
    right = [(r.score >= 0.5) == (r.doc_id % 3 != 1) for r in got if r.held_out]
    assert np.mean(right) > 0.9
    assert all(r.predicted == int(r.score >= 0.3) for r in got)
    test_quality_sums_are_of_all_rows.scores = getattr(test_quality_sums_are_of_all_rows, "scores", []) + [{r.doc_id: r.score for r in got}]
    first, *rest = test_quality_sums_are_of_all_rows.scores
    assert all(max(abs(first[d] - s[d]) for d in first) < 1e-6 for s in rest)


def test_held_out_labels_are_not_learnt(spark):
    texts, labels = corpus()
    wrong = [(d, 1 - q, t) if zlib.crc32(str(d).encode()) % 5 == 0 else (d, q, t) for d, q, t in labels]
    one, two = ({r.doc_id: r.score for r in quality.quality_scores(docs_of(spark, texts), labels_of(spark, x)).collect()} for x in (labels, wrong))
    assert max(abs(one[d] - two[d]) for d in one) < 1e-12


def test_accuracy_on_the_tables(spark):
    docs, labels = read(spark, TABLES, "documents"), read(spark, TABLES, "labels")
    q = {r.doc_id: r for r in quality.quality_scores(docs, labels).collect()}
    known = {r.doc_id: r for r in labels.collect()}
    held = [(q[d].predicted, r.quality) for d, r in known.items() if d in q and q[d].held_out]
    assert np.mean([a == b for a, b in held]) > 0.98
    # toxicity: fitted without the held-out rows, judged on them
    split = labels.where(quality.fold(labels.doc_id) != 0)
    t = {r.doc_id: r.rejected for r in toxicity.toxicity_scores(docs, split).collect()}
    held = [(t[d], bool(r.toxic)) for d, r in known.items() if d in q and q[d].held_out]
    assert np.mean([a == b for a, b in held]) > 0.98


def test_chain_predicts_out_of_fold():
    rng = np.random.default_rng(3)
    n = 240
    x, part = rng.normal(0, 1, (n, STATS)), np.arange(n) % toxicity.PARTS
    labels = (x[:, :2] + rng.normal(0, 1, (n, 2)) > 0).astype(float)
    labels[::7, 0] = np.nan
    none = [[np.zeros(0, np.int32)] * (toxicity.PARTS + 1)] * 2
    words = [np.zeros(0, np.int32)] * n
    chain = toxicity.fit_chain(x, words, part, labels, none)
    stats = toxicity.expand(x, chain["mean"], chain["std"])
    known = np.isfinite(labels[:, 0])
    before = np.zeros(n)
    for f in range(toxicity.PARTS):  # each part by a link that has not seen it
        rest = known & (part != f)
        w = np.zeros(stats.shape[1])
        for _ in range(60):
            p = 1 / (1 + np.exp(-(stats[rest] @ w)))
            penalty = np.full(len(w), toxicity.RIDGE)
            penalty[0] = 1e-6
            w += np.linalg.solve((stats[rest].T * (p * (1 - p))) @ stats[rest] + np.diag(penalty), stats[rest].T @ (labels[rest, 0] - p) - penalty * w)
        before[part == f] = 1 / (1 + np.exp(-(stats[part == f] @ w)))
    last = toxicity.Fit(stats, words, before[:, None], labels[:, 1], none[0][0])
    assert np.abs(last.weights - chain["links"][1].weights).max() < 1e-2


def test_toxic_words_decide(spark):
    texts, labels = corpus()
    got = {r.doc_id: r.rejected for r in toxicity.toxicity_scores(docs_of(spark, texts).repartition(4), labels_of(spark, labels[::2])).collect()}
    assert np.mean([got[d] == bool(t) for d, _, t in labels[1::2]]) > 0.95
    few = {r.doc_id: r.rejected for r in toxicity.toxicity_scores(docs_of(spark, texts), labels_of(spark, labels), max_labelled=150, least_texts=2).collect()}
    assert np.mean([few[d] == bool(t) for d, _, t in labels]) > 0.9


ODD = [GOOD, None, "", GOOD, "word " * 200_000, BAD, VILE, "é" * 10]
IDS = [0, 1, 2, 3, 4, 5, None, 0]


@pytest.mark.parametrize(
    ("rows", "score", "p_toxic"),
    [
        ([], 0.5, 0.0),
        ([(None, 1, 1)], 0.5, 0.0),
        ([(0, None, None)], 0.5, 0.0),
        ([(1, 0, 0), (2, 0, 0), (4, 0, 0)], 0.0, 0.0),
        ([(i, 1, 1) for i in range(1, 6)], None, 1.0),
        ([(900, 1, 1), (901, 0, 0)], None, 0.0),  # labels without documents
        ([(1, 0, 0), (1, 1, 1), (2, 0, 0), (5, 0, 1), (5, 0, 0)], None, None),  # conflicting labels
    ],
)
def test_edges(spark, rows, score, p_toxic):
    docs, labels = docs_of(spark, ODD, IDS), labels_of(spark, rows)
    q = quality.quality_scores(docs, labels).collect()
    t = toxicity.toxicity_scores(docs, labels).collect()
    order = lambda rows: sorted(-1 if r.doc_id is None else r.doc_id for r in rows)
    assert order(q) == order(t) == sorted(-1 if d is None else d for d in IDS)
    assert all(0 <= r.score <= 1 and (score is None or r.score == score) for r in q)
    assert all(0 <= r.p_toxic <= 1 and (p_toxic is None or r.p_toxic == p_toxic) for r in t)
    assert q[0].held_out is not None and {r.held_out for r in q if r.doc_id is None} == {True}
    kept = toxicity.without_toxic(docs, labels)
    assert kept.columns == docs.columns
    assert kept.count() == sum(not r.rejected for r in t)


def test_empty_tables(spark):
    none, labels = docs_of(spark, []), labels_of(spark, corpus()[1])
    assert quality.quality_scores(none, labels).count() == 0
    assert toxicity.toxicity_scores(none, labels).count() == 0
    assert toxicity.without_toxic(none, labels_of(spark, [])).count() == 0


def test_conflicting_labels_take_the_largest(spark):
    texts, labels = corpus()
    twice = [*labels, *((d, 0, 0) for d, _, _ in labels)]
    for run in (lambda x: quality.quality_scores(docs_of(spark, texts), x), lambda x: toxicity.toxicity_scores(docs_of(spark, texts), x)):
        one, two = (sorted(map(tuple, run(labels_of(spark, x)).collect())) for x in (labels, twice))
        assert one == two
