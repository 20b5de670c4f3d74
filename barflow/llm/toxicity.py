"""Toxicity by a chain of linear classifiers.

The chain goes through the label columns in the order given.  Each link is a ridge logistic
regression on text statistics, on the word features that tell its classes apart best, and on the
probabilities of the links before it.  In training those are out-of-fold: each part of the sample is
predicted by a link fitted on the others, so later links see earlier ones as they are on new text.

Spark counts the word features of each part and class and picks each fit's features; the driver gets,
of at most about max_labelled labelled rows, the statistics and the picked features, a bounded number
of numbers a row however long the texts are.

The table `labels` has one toxicity column, so the registered chain is quality, then toxic.
Nulls: a null text is empty; a null doc_id has no label; null labels are left out of the link that
needs them.  Of several labels of one doc_id the largest counts.  Very long texts are read whole.
Repeated rows each give a row.  Without labels of both kinds, or without labelled documents, a link gives
its share of ones (0 without any).  An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barflow.llm.common import each_batch, texts, written
from barflow.llm.text_features import STATS, expand, sigmoid, text_stats, word_features

CHAIN = ("quality", "toxic")
WORDS = 300  # word features of a link
PARTS = 3  # of the sample, for out-of-fold predictions
RIDGE = 1.0
TOLERANCE = 1e-4  # of a Newton step's largest entry
STEPS = 100  # Newton steps after which a fit fails; about ten are used


def _logistic(x: np.ndarray, y: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by Newton steps; column 0 is the constant."""
    penalty = np.full(x.shape[1], RIDGE)
    penalty[0] = 1e-6

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float(np.logaddexp(0, z).sum() - y @ z + penalty @ w**2 / 2)

    w, now = start, loss(start)
    for _ in range(STEPS):
        p = sigmoid(x @ w)
        step = np.linalg.solve((x.T * np.maximum(p * (1 - p), 1e-6)) @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        size = 1.0
        while (then := loss(w + size * step)) > now + 1e-9 * abs(now) and size > 1e-6:
            size /= 2
        w, now = w + size * step, then
        if np.abs(size * step).max() < TOLERANCE:
            return w
    raise ArithmeticError(f"no minimum after {STEPS} Newton steps")


class Fit:
    """One fit of a link: its word features, sorted, and its weights; or the share of ones of a single class."""

    def __init__(self, stats: np.ndarray, words: list[np.ndarray], before: np.ndarray, y: np.ndarray, chosen: np.ndarray, like: Fit | None = None):
        self.share = float(y.mean()) if len(y) and y.min() == y.max() else None if len(y) else 0.0
        self.chosen = chosen if self.share is None else chosen[:0]
        if self.share is None:
            first = stats.shape[1] + before.shape[1]
            start = np.zeros(first + len(chosen))
            if like is not None and like.share is None:  # another fit's weights are a good start
                start[:first] = like.weights[:first]
                _, here, there = np.intersect1d(chosen, like.chosen, return_indices=True)
                start[first + here] = like.weights[first + there]
            self.weights = _logistic(self._columns(stats, words, before), y, start)

    def _columns(self, stats: np.ndarray, words: list[np.ndarray], before: np.ndarray) -> np.ndarray:
        has = np.zeros((len(stats), len(self.chosen)))
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        flat = np.concatenate([*words, np.zeros(0, np.int32)])
        if len(self.chosen) and len(flat):
            at = np.minimum(np.searchsorted(self.chosen, flat), len(self.chosen) - 1)
            hit = self.chosen[at] == flat
            has[np.repeat(np.arange(len(words)), sizes)[hit], at[hit]] = 1
        return np.concatenate((stats, before, has), axis=1)

    def predict(self, stats: np.ndarray, words: list[np.ndarray], before: np.ndarray) -> np.ndarray:
        if self.share is not None:
            return np.full(len(stats), self.share)
        return sigmoid(self._columns(stats, words, before) @ self.weights)


def fit_chain(x: np.ndarray, words: list[np.ndarray], part: np.ndarray, labels: np.ndarray, chosen: list[list[np.ndarray]]) -> dict:
    """Links for the columns of labels (NaN: unknown), in their order.  part deals the rows to out-of-fold parts;
    chosen[k][f] are link k's word features without part f, chosen[k][PARTS] those of all rows."""
    mean, std = (x.mean(0), x.std(0) + 1e-6) if len(x) else (np.zeros(STATS), np.ones(STATS))
    stats = expand(x, mean, std)
    before = np.zeros((len(x), 0))
    links = []
    for k in range(labels.shape[1]):
        known = np.isfinite(labels[:, k])
        take = lambda mask: (stats[mask], [words[i] for i in np.flatnonzero(mask)], before[mask])  # noqa: B023,E731
        links.append(Fit(*take(known), labels[known, k], chosen[k][PARTS]))
        out = np.zeros(len(x))
        for f in range(PARTS if k + 1 < labels.shape[1] else 0):
            rest = known & (part != f)
            out[part == f] = Fit(*take(rest), labels[rest, k], chosen[k][f], links[-1]).predict(*take(part == f))
        before = np.concatenate((before, out[:, None]), axis=1)
    return {"mean": mean, "std": std, "links": links}


def _features(docs: DataFrame) -> DataFrame:
    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        t = b.column("text").to_pylist()
        return pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([text_stats(x).tolist() for x in t], pa.list_(pa.float64())), pa.array([np.array(sorted(word_features(x)), np.uint32).view(np.int32) for x in t], pa.list_(pa.int32()))], ["doc_id", "x", "words"])

    return each_batch(docs.select("doc_id", "text"), run, "doc_id long, x array<double>, words array<int>")


def chosen_words(sample: DataFrame, links: int, least_texts: int) -> list[list[np.ndarray]]:
    """Per link and left-out part (last: none) the WORDS features whose share differs most between the classes,
    against chance, of those that at least least_texts of its texts have; sorted."""
    sums = lambda k: (F.count(f"y{k}").alias(f"n{k}"), F.coalesce(F.sum(f"y{k}"), F.lit(0.0)).alias(f"p{k}"))
    every = [c for k in range(links) for c in sums(k)]
    texts_of = {r["part"]: r for r in sample.groupBy("part").agg(*every).collect()}  # PARTS rows
    counts = sample.select("part", *(f"y{k}" for k in range(links)), F.explode("words").alias("word")).groupBy("word").pivot("part", list(range(PARTS))).agg(*every)
    counts = written(counts.na.fill(0), "counts")
    out = []
    for k in range(links):
        fits = []
        for f in range(PARTS + 1):
            parts = [p for p in range(PARTS) if p != f]
            n, ones = (float(sum(texts_of[p][f"{c}{k}"] for p in parts if p in texts_of)) for c in "np")
            if not 0 < ones < n or (f < PARTS and k + 1 == links):  # nothing is left out for the last link
                fits.append(np.zeros(0, np.int32))
                continue
            has, one = (sum((F.col(f"{p}_{c}{k}") for p in parts), F.lit(0.0)) for c in "np")
            share = has / n
            z = F.abs(one / ones - (has - one) / (n - ones)) / F.sqrt(share * (1 - share) + 1e-12)
            top = counts.where(has >= least_texts).select("word", z.alias("z")).orderBy(F.desc("z"), "word").limit(WORDS).collect()
            fits.append(np.sort(np.array([r["word"] for r in top], np.int32)))
        out.append(fits)
    return out


def train(docs: DataFrame, labels: DataFrame, chain: tuple[str, ...], max_labelled: int, least_texts: int) -> dict:
    """The chain from frame (doc_id, text) and labels; a hash of the doc_id picks the labelled rows where there are more."""
    known = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(*(F.max(F.col(c).cast("double")).alias(f"y{k}") for k, c in enumerate(chain)))
    n = known.count()
    cut = 1 << 30 if n <= max_labelled else int((1 << 30) * max_labelled / n)
    at = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 30))
    part = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(PARTS)).cast("int").alias("part")
    picked = docs.where(at < cut).join(known.where(at < cut), "doc_id")
    sample = written(_features(picked).join(known, "doc_id").withColumn("part", part), "sample")
    chosen = chosen_words(sample, len(chain), least_texts)
    union = np.unique(np.concatenate([c for fits in chosen for c in fits]))
    used = F.lit(union.astype(np.int32)) if len(union) else F.expr("cast(array() as array<int>)")
    rows = sample.select("doc_id", "x", F.array_intersect("words", used).alias("words"), "part", *(f"y{k}" for k in range(len(chain))))
    got = rows.orderBy("doc_id", F.xxhash64("x", "words")).toArrow()
    x = np.array(got.column("x").to_pylist(), float).reshape(got.num_rows, STATS)
    words = [np.array(w, np.int32) for w in got.column("words").to_pylist()]
    y = np.stack([got.column(f"y{k}").to_numpy().astype(float) for k in range(len(chain))], 1)
    return fit_chain(x, words, got.column("part").to_numpy(), y, chosen)


def toxicity_scores(docs: DataFrame, labels: DataFrame, chain: tuple[str, ...] = CHAIN, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text", max_labelled: int = 12_000, least_texts: int = 4) -> DataFrame:
    """(doc_id, key, p_<label> for each link, rejected): rejected from threshold on in the last link.

    max_labelled: labelled rows in the fit, about.  least_texts: texts of the fit that a word feature must be in."""
    base = texts(docs, id_col, text_col).withColumn("key", F.xxhash64("text"))
    model = docs.sparkSession.sparkContext.broadcast(train(base, labels, chain, max_labelled, least_texts))
    names = [f"p_{c}" for c in chain]

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        m, t = model.value, b.column("text").to_pylist()
        mine = set(np.concatenate([link.chosen for link in m["links"]]).view(np.uint32).tolist())
        words = [np.array(sorted(mine & word_features(v)), np.uint32).view(np.int32) for v in t]
        stats = expand(np.array([text_stats(v) for v in t]).reshape(len(t), STATS), m["mean"], m["std"])
        before = np.zeros((len(t), 0))
        for link in m["links"]:
            before = np.concatenate((before, link.predict(stats, words, before)[:, None]), axis=1)
        columns = [pa.array(before[:, k], pa.float64()) for k in range(len(chain))]
        return pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("key"), *columns, pa.array(before[:, -1] >= threshold, pa.bool_())], ["doc_id", "key", *names, "rejected"])

    return each_batch(base, run, f"doc_id long, key long, {', '.join(f'{x} double' for x in names)}, rejected boolean")


def without_toxic(docs: DataFrame, labels: DataFrame, chain: tuple[str, ...] = CHAIN, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, all columns, without the documents that the chain rejects."""
    bad = toxicity_scores(docs, labels, chain, threshold, id_col, text_col).where("rejected").select(F.col("doc_id").alias("d"), F.col("key").alias("k")).distinct()
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(id_col).cast("long").alias("d"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("k"))
    kept = rows.join(bad, rows.d.eqNullSafe(bad.d) & (rows.k == bad.k), "left_anti")
    return kept.select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns))
