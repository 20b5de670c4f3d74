"""Quality scores by positive-unlabelled learning with the non-negative risk.

The classifier is linear in expanded text statistics.  Its risk is  p R+(1) + max(0, Ru(-1) - p R+(-1)):
p is the class prior, R+ the logistic loss over all trusted positives, Ru over all unlabelled web text,
which is every document outside the held-out fold.  For the logistic loss R+(1) - R+(-1) is linear, so
while the bracket is not negative the risk is convex and Newton steps lead down; a step that turns the
bracket negative is halved until it doesn't, so the risk can't fall below zero by overfitting.  Spark
sums risk, gradient and curvature over the stored statistics of all rows in one pass a step; only
those sums, a row a partition, come to the driver.  The prior is the share of positives among the labels.

Nulls: a null text is empty and scored as such; a null doc_id counts as crc32("") for the fold and
has no label; labels that are null are left out.  Of several labels of one doc_id the largest counts.
Very long texts are read whole.  Repeated rows each give a row.  Without any label nothing is known and
every score is 0.5; where no label is positive, or no positive document is there, every score is the
share of positives.  An empty table gives no rows.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barflow.llm.common import each_batch, texts, written
from barflow.llm.text_features import STATS, expand, sigmoid, text_stats

FOLDS = 5
PASSES = 60  # over the rows, at most; about a dozen are used
RIDGE = 0.03  # on the squared weights, against the mean losses
LONGEST = 8.0  # step, where few rows make the curvature flat


def fold(doc_id):
    """crc32 of doc_id's decimal text, mod 5; fold 0 is held out."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS))


def _rows_of(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, STATS))


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, x): each whole text's statistics."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        rows = [text_stats(t or "") for t in b.column("text").to_pylist()]
        flat = np.concatenate([*rows, np.zeros(0)])
        return pa.RecordBatch.from_arrays([b.column("doc_id"), pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * STATS, pa.int32()), pa.array(flat))], ["doc_id", "x"])

    return each_batch(docs.select("doc_id", "text"), run, "doc_id long, x array<double>")


def softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, z)


def sums(x: np.ndarray, w: np.ndarray, trusted: bool) -> np.ndarray:
    """What a run of rows adds to the risk: count, sum of the loss of -1, of x, its gradient and curvature (unlabelled rows)."""
    z = x @ w
    s = sigmoid(z)
    curve = (x.T * (s * (1 - s))) @ x if not trusted else np.zeros((len(w), len(w)))
    return np.concatenate(([len(x), softplus(z).sum()], x.sum(0), x.T @ s, curve.ravel()))


def _added(batches, width: int):
    """The sums of a partition's rows (t, s, i), with its first i to order them by."""
    both, first = np.zeros((2, 2 + 2 * width + width * width)), None
    for b in batches:
        for t, s, i in zip(b.column("t").to_pylist(), b.column("s"), b.column("i").to_pylist()):
            both[int(t)] += s.values.to_numpy()
            first = i if first is None else first
    if first is not None:
        yield pa.RecordBatch.from_arrays([pa.array([False, True]), pa.array(both.tolist(), pa.list_(pa.float64())), pa.array([first] * 2, pa.int32())], ["t", "s", "i"])


def minimise(total: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], width: int, prior: float, ridge: float = RIDGE, passes: int = PASSES) -> np.ndarray:
    """Weights of least non-negative risk; total(w) gives the sums of positive and of unlabelled rows."""

    def at(w: np.ndarray):
        p, u = total(w)
        bracket = u[1] / u[0] - prior * p[1] / p[0]
        mean = p[2 : 2 + width] / p[0]
        gradient = -prior * mean + u[2 + width : 2 + 2 * width] / u[0] + ridge * w
        curve = u[2 + 2 * width :].reshape(width, width) / u[0] + ridge * np.eye(width)
        # R+(1) = R+(-1) - w.mean
        risk = prior * (p[1] / p[0] - w @ mean) + max(0.0, bracket) + ridge / 2 * w @ w
        return risk, bracket, gradient, curve

    w = np.zeros(width)
    risk, _, gradient, curve = at(w)
    used, size = 1, 1.0
    while used < passes:
        step = -np.linalg.solve(curve, gradient)
        if -gradient @ step < 1e-7:
            break
        length = np.sqrt(step @ step)
        size = min(1.0, 2 * size, LONGEST / length)
        while used < passes:
            new = at(w + size * step)
            used += 1
            if new[1] >= 0 and new[0] <= risk + 1e-4 * size * (gradient @ step):
                break
            size /= 2
            if size * length < 1e-3:  # the bracket is at zero
                return w
        else:
            return w
        w = w + size * step
        risk, _, gradient, curve = new
    return w


def fit(stored: DataFrame, labels: DataFrame, label_col: str = "quality") -> dict:
    """The model from frame (doc_id, x) and labels: mean, std and weights.  Labels come only from folds other than 0."""
    known = labels.where(F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != 0) & F.col(label_col).isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col(label_col).cast("int")).alias("y"))
    share = known.agg(F.avg("y").alias("p")).first()["p"]
    if not share:
        return {"share": 0.5 if share is None else 0.0}
    web = stored.where(fold(F.col("doc_id")) != 0)
    trusted = written(web.join(known.where("y = 1").select("doc_id"), "doc_id", "left_semi"), "trusted")
    if trusted.isEmpty():
        return {"share": float(share)}
    columns = [F.get("x", F.lit(i)) for i in range(STATS)]
    moments = web.agg(*(F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)), *(F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(columns))).first()
    mean, std = np.array(moments[:STATS], float), np.array(moments[STATS:], float) + 1e-6
    width = 4 * STATS + 1
    rows = trusted.select(F.lit(True).alias("t"), "x").union(web.select(F.lit(False).alias("t"), "x"))

    groups = max(1, math.isqrt(rows.rdd.getNumPartitions()))

    def total(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        def run(batches):
            out = np.zeros((2, 2 + 2 * width + width * width))
            for b in batches:
                x, t = expand(_rows_of(b.column("x")), mean, std), b.column("t").to_numpy(zero_copy_only=False)
                for k in (0, 1):
                    if (t == bool(k)).any():
                        out[k] += sums(x[t == bool(k)], w, bool(k))
            yield pa.RecordBatch.from_arrays([pa.array([False, True]), pa.array(out.tolist(), pa.list_(pa.float64()))], ["t", "s"])

        # a pair of rows a partition, added up in about as many tasks as its root, always in the same order
        parts = rows.mapInArrow(run, "t boolean, s array<double>").withColumn("i", F.spark_partition_id())
        dealt = parts.repartition(groups, F.pmod("i", F.lit(groups))).sortWithinPartitions("i", "t")
        both = [np.zeros(2 + 2 * width + width * width) for _ in range(2)]
        last = dealt.mapInArrow(lambda batches: _added(batches, width), "t boolean, s array<double>, i int").toArrow().sort_by("i")
        for t, s in zip(last.column("t").to_pylist(), last.column("s")):
            both[t] += s.values.to_numpy()
        return both[1], both[0]

    prior = min(float(share), 0.98)
    return {"mean": mean, "std": std, "prior": prior, "w": minimise(total, width, prior)}


def quality_scores(docs: DataFrame, labels: DataFrame, label_col: str = "quality", threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) per document."""
    stored = written(features(texts(docs, id_col, text_col)), "statistics")
    model = docs.sparkSession.sparkContext.broadcast(fit(stored, labels, label_col))

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        m, ids, x = model.value, b.column("doc_id").to_pylist(), _rows_of(b.column("x"))
        score = np.full(len(ids), m["share"]) if "share" in m else sigmoid(expand(x, m["mean"], m["std"]) @ m["w"])
        held = [zlib.crc32(("" if d is None else str(d)).encode()) % FOLDS == 0 for d in ids]
        return pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(held, pa.bool_()), pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return each_batch(stored, run, "doc_id long, held_out boolean, score double, predicted int")
