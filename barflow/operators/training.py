"""Probability models of all pairs at once: cross-validation, calibration, importance, the run over all pairs.

A pass over the rows sums loss, gradient and curvature of every pair's and fold's model together; the driver only
solves for their coefficients (a catalog of pairs, five folds, eleven numbers each).  Each model is the
L1 logistic one with strength C: sum of absolute coefficients, the intercept's too, plus C times the losses,
minimised by proximal Newton steps until its optimality conditions hold.  Models are tables, and scores column
expressions over them.  Benchmarks are in operators.trees.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barflow.operators import evaluation as E
from barflow.operators.features import TECHNICAL
from barflow.sources.bars import SERIES, SIZE, settled, with_pos

C = 0.3
PASSES = 80  # over the rows, at most; about ten are used
PART_ROWS, LEAST_ROWS = 1 << 17, 1 << 12  # of a file of training rows: at most, and worth a task of its own
OPTIMAL = 1e-9  # violation of the optimality conditions, a row, at which a model is done
MODEL = "symbol string, timeframe string, parts array<struct<bias: double, w: array<double>, slope: double, shift: double>>, residual double, train_s double"


def training_rows(labeled: DataFrame, columns: list[str] = TECHNICAL, folds: int = E.FOLDS) -> tuple[DataFrame, list[tuple[str, str, int]]]:
    """(rows, pairs): labelled rows with pos, fold, _pair (its place in pairs) and _x (the columns), settled; pairs with their numbers of rows."""
    placed = E.with_folds(with_pos(labeled.drop("pos", SIZE), SIZE), folds)
    x = F.array(*(F.col(c).cast("double") for c in columns))
    pairs = [tuple(r) for r in labeled.groupBy(*SERIES).count().orderBy(*SERIES).collect()]  # the catalog's few
    spark = labeled.sparkSession
    named = spark.createDataFrame([(s, t, i) for i, (s, t, _) in enumerate(pairs)], "symbol string, timeframe string, _pair int")
    # the rows are read many times: dealt anew, since adaptively coalesced shuffles leave a few large files and so few tasks
    total = sum(n for *_, n in pairs)
    parts = max(-(-total // PART_ROWS), min(spark.sparkContext.defaultParallelism, -(-total // LEAST_ROWS)), 1)
    return settled(placed.join(F.broadcast(named), SERIES).withColumn("_x", x).repartition(parts, "_pair", "pos"), "training"), pairs


def matrix_of(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def each_pair(b: pa.RecordBatch, name: str = "_pair") -> Iterator[tuple[int, np.ndarray]]:
    """(pair, its rows) of a batch."""
    pair = b.column(name).to_numpy()
    for p in np.unique(pair):
        yield int(p), np.flatnonzero(pair == p)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -700, 700)))


def _sums(rows: DataFrame, problems: list[dict], weights: np.ndarray, design: Callable, active: list[int]) -> dict[int, np.ndarray]:
    """Rows, loss, gradient and curvature of each active problem at its weights, in one pass."""
    q = weights.shape[1]
    upper = np.triu_indices(q)
    size = 2 + q + len(upper[0])
    of_pair: dict[int, list[int]] = {}
    for i in active:
        of_pair.setdefault(problems[i]["pair"], []).append(i)
    model = rows.sparkSession.sparkContext.broadcast((problems, weights, of_pair))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        problems_, w, own = model.value
        found: dict[int, np.ndarray] = {}
        for b in batches:
            if not b.num_rows:
                continue
            x, fold, label = matrix_of(b.column("_x"), len(b.column("_x")[0])), b.column("fold").to_numpy(), b.column("label").to_numpy().astype(float)
            for p, of in each_pair(b):
                for i in own.get(p, []):
                    d, t = design(problems_[i], x[of], fold[of], label[of])
                    if not len(d):
                        continue
                    z = d @ w[i]
                    s = sigmoid(z)
                    part = np.concatenate(([len(d), (np.logaddexp(0, z) - t * z).sum()], d.T @ (s - t), ((d.T * (s * (1 - s))) @ d)[upper]))
                    found[i] = found.get(i, 0) + part
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array([v.tolist() for v in found.values()], pa.list_(pa.float64()))], ["problem", "s"])

    parts = rows.select("_pair", "_x", "fold", "label").mapInArrow(run, "problem int, s array<double>")
    out = {}
    for r in parts.groupBy("problem").agg(F.array(*(F.sum(F.get("s", F.lit(j))) for j in range(size))).alias("s")).collect():
        out[r["problem"]] = np.array(r["s"])
    model.unpersist()
    return out


def _step(g: np.ndarray, h: np.ndarray, w: np.ndarray, penalty: float) -> np.ndarray:
    """The d that minimises g.d + d.H.d / 2 + penalty |w + d|, coordinate by coordinate."""
    d, hd = np.zeros_like(w), np.zeros_like(w)
    diagonal = np.diag(h) + 1e-12 * max(1.0, np.diag(h).max())
    for _ in range(500):
        moved = 0.0
        for j in range(len(w)):
            a, c = g[j] + hd[j], w[j] + d[j]
            z = c - a / diagonal[j]
            new = math.copysign(max(abs(z) - penalty / diagonal[j], 0.0), z) - c
            if new:
                d[j] += new
                hd += new * h[:, j]
                moved = max(moved, abs(new))
        if moved < 1e-13:
            break
    return d


def violation(g: np.ndarray, w: np.ndarray, penalty: float) -> float:
    """How far the optimality conditions are from holding: the largest distance of -g from the penalty's slopes."""
    return float(np.where(w != 0, np.abs(g + penalty * np.sign(w)), np.maximum(np.abs(g) - penalty, 0)).max())


def minimise(rows: DataFrame, problems: list[dict], q: int, design: Callable, penalty: float, passes: int = PASSES) -> tuple[np.ndarray, np.ndarray]:
    """(weights, violations a row) of all problems; design(problem, x, fold, label) gives a problem's rows and targets."""
    w, tried = np.zeros((len(problems), q)), np.zeros((len(problems), q))
    value, size, direction, slope = [math.inf] * len(problems), [1.0] * len(problems), [None] * len(problems), [0.0] * len(problems)
    residual, active = np.full(len(problems), np.inf), list(range(len(problems)))
    upper = np.triu_indices(q)
    for _ in range(passes):
        sums, left = _sums(rows, problems, tried, design, active), []
        for i in active:
            if i not in sums:  # no rows
                residual[i] = 0.0
                continue
            n, loss, g = sums[i][0], sums[i][1], sums[i][2 : 2 + q]
            h = np.zeros((q, q))
            h[upper] = sums[i][2 + q :]
            h = h + np.triu(h, 1).T
            total = loss + penalty * np.abs(tried[i]).sum()
            if total > value[i] + 1e-4 * size[i] * slope[i] + 1e-12 * abs(total) and size[i] > 1e-6:
                size[i] /= 2
                tried[i] = w[i] + size[i] * direction[i]
                left.append(i)
                continue
            w[i], value[i], size[i] = tried[i], total, 1.0
            residual[i] = violation(g, w[i], penalty) / n
            if residual[i] > OPTIMAL:
                direction[i] = _step(g, h, w[i], penalty)
                slope[i] = min(0.0, g @ direction[i] + penalty * (np.abs(w[i] + direction[i]).sum() - np.abs(w[i]).sum()))
                tried[i] = w[i] + direction[i]
                left.append(i)
        active = left
        if not active:
            break
    return w, residual


def _moments(rows: DataFrame, width: int) -> dict[tuple[int, int], tuple[int, int, np.ndarray, np.ndarray]]:
    """(pair, fold) -> rows, ones, mean and sum of squared deviations of x."""
    x = [F.get("_x", F.lit(j)) for j in range(width)]
    by = rows.groupBy("_pair", "fold").agg(F.count("*").alias("n"), F.sum("label").alias("y"), F.array(*map(F.avg, x)).alias("m"), F.array(*map(F.var_pop, x)).alias("v"))
    return {(r["_pair"], r["fold"]): (r["n"], int(r["y"]), np.array(r["m"]), r["n"] * np.array(r["v"])) for r in by.collect()}


def _scale(parts: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """Mean and population deviation (0 counts as 1) of folds together."""
    n = sum(p[0] for p in parts)
    mean = sum(p[0] * p[2] for p in parts) / n
    square = sum(p[3] + p[0] * (p[2] - mean) ** 2 for p in parts) / n
    deviation = np.sqrt(square)
    return mean, np.where(deviation > 1e-12 * (1 + np.abs(mean)), deviation, 1.0)


def _standard(problem: dict, x: np.ndarray) -> np.ndarray:
    return np.concatenate(((x - problem["mean"]) / problem["std"], np.ones((len(x), 1))), axis=1)


def _before(problem: dict, x: np.ndarray, fold: np.ndarray, label: np.ndarray):
    of = fold < problem["fold"]
    return _standard(problem, x[of]), label[of]


def _margin(problem: dict, x: np.ndarray, fold: np.ndarray, label: np.ndarray):
    """Rows of a Platt fit: the fold's margins; targets are smoothed."""
    of = fold == problem["fold"]
    z = _standard(problem, x[of]) @ problem["w"]
    return np.stack((z, np.ones(len(z))), 1), np.where(label[of] == 1, problem["high"], problem["low"])


def _fitted(rows: DataFrame, pairs: list, columns: list[str], c: float, whole: bool, folds: int) -> list[dict]:
    """A problem for each pair and fold, solved: scaled by the rows before the fold, or by all rows (whole)."""
    moments = _moments(rows, len(columns))
    problems = []
    for p in range(len(pairs)):
        for k in range(1, folds + 1):
            parts = [m for (pair, fold), m in moments.items() if pair == p and (whole or fold < k)]
            if any(fold < k for pair, fold in moments if pair == p) and (p, k) in moments:
                mean, std = _scale(parts)
                n, ones = moments[p, k][:2]
                problems.append({"pair": p, "fold": k, "mean": mean, "std": std, "high": (ones + 1.0) / (ones + 2.0), "low": 1.0 / (n - ones + 2.0)})
    w, residual = minimise(rows, problems, len(columns) + 1, _before, 1.0 / c)
    return [q | {"w": w[i], "residual": float(residual[i])} for i, q in enumerate(problems)]


def _model(spark: SparkSession, pairs: list, problems: list[dict], seconds: float, calibration: np.ndarray | None = None) -> DataFrame:
    """The MODEL table: a row a pair with its folds' parts, in the columns' own units."""
    out = []
    for p, (symbol, timeframe, _) in enumerate(pairs):
        parts = []
        for i, q in enumerate(problems):
            if q["pair"] == p:
                raw = q["w"][:-1] / q["std"]
                a, b = (1.0, 0.0) if calibration is None else calibration[i]
                parts.append((float(q["w"][-1] - raw @ q["mean"]), raw.tolist(), float(a), float(b)))
        if parts:
            out.append((symbol, timeframe, parts, max(q["residual"] for q in problems if q["pair"] == p), seconds))
    return spark.createDataFrame(out, MODEL)


def _chance(part: Column, x: Column) -> Column:
    dot = F.aggregate(F.zip_with(part["w"], x, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    return 1 / (1 + F.exp(-(part["slope"] * (part["bias"] + dot) + part["shift"])))


def out_of_sample(labeled: DataFrame, columns: list[str] = TECHNICAL, c: float = C, folds: int = E.FOLDS) -> tuple[DataFrame, DataFrame]:
    """(rows, model): labelled rows of all pairs with their fold and, from fold 1 on, the probability of the model of all rows before it."""
    began = time.time()
    rows, pairs = training_rows(labeled, columns, folds)
    model = _model(labeled.sparkSession, pairs, _fitted(rows, pairs, columns, c, False, folds), time.time() - began)
    part = F.get("parts", F.col("fold") - 1)
    return rows.join(F.broadcast(model), SERIES, "left").withColumn("proba", F.when(F.col("fold") > 0, _chance(part, F.col("_x")))).drop("parts", "residual", "train_s", "_x", "_pair"), model


def calibrated(labeled: DataFrame, columns: list[str] = TECHNICAL, c: float = C, folds: int = E.FOLDS) -> DataFrame:
    """The MODEL table of all pairs: each fold's model is fitted on the rows before it and calibrated (Platt) on its own; scores average them."""
    began = time.time()
    rows, pairs = training_rows(labeled, columns, folds)
    problems = _fitted(rows, pairs, columns, c, True, folds)
    platt, _ = minimise(rows, problems, 2, _margin, 0.0)
    return _model(labeled.sparkSession, pairs, problems, time.time() - began, platt)


def score(rows: DataFrame, model: DataFrame, columns: list[str] = TECHNICAL, how: str = "inner") -> DataFrame:
    """rows of pairs that have a model, with proba: the mean of its parts (a table of the catalog's pairs: broadcast).

    how="left" keeps the other rows, without proba."""
    x = F.array(*(F.col(c).cast("double") for c in columns))
    chances = F.transform("parts", lambda part: _chance(part, F.col("_x")))
    met = rows.withColumn("_x", x).join(F.broadcast(model.select(*SERIES, "parts")), SERIES, how)
    return met.withColumn("proba", F.aggregate(chances, F.lit(0.0), lambda s, v: s + v) / F.size("parts")).drop("_x", "parts")


def importance(model: DataFrame, labeled: DataFrame, columns: list[str] = TECHNICAL) -> DataFrame:
    """(symbol, timeframe, rank, feature, coefficient): standardised coefficients of the first part, largest first; equal shares where all are 0."""
    scales = labeled.groupBy(*SERIES).agg(F.array(*(F.stddev_pop(F.col(c).cast("double")) for c in columns)).alias("_s"))
    w = F.zip_with(F.col("parts")[0]["w"], F.col("_s"), lambda a, s: a * F.coalesce(F.nullif(s, F.lit(0.0)), F.lit(1.0)))
    df = model.join(scales, SERIES).withColumn("_w", w)
    df = df.withColumn("_w", F.when(F.exists("_w", lambda v: v != 0), F.col("_w")).otherwise(F.array_repeat(F.lit(1.0 / len(columns)), len(columns))))
    items = F.array_sort(F.zip_with(F.array(*map(F.lit, columns)), "_w", lambda f, v: F.struct((-F.abs(v)).alias("o"), f.alias("feature"), v.alias("coefficient"))))
    return df.select(*SERIES, F.posexplode(items).alias("i", "v")).select(*SERIES, (F.col("i") + 1).alias("rank"), "v.feature", "v.coefficient")


def save(model: DataFrame, path: str) -> None:
    model.write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MODEL).parquet(path)


def trained_pairs(labeled: DataFrame, timeframes: DataFrame) -> DataFrame:
    """The rows of the pairs that pass their gate."""
    ok = E.training_gate(labeled, timeframes).where("trained").select(*SERIES)
    return labeled.join(F.broadcast(ok), SERIES, "left_semi")  # the catalog's few pairs


def run_pairs(labeled: DataFrame, timeframes: DataFrame, symbols: list[str] | None = None, only: list[str] | None = None) -> DataFrame:
    """(symbol, timeframe, rows, status, brier, auc): trains all pairs that pass their gate together; the others are skipped.

    A pair whose model misses its optimum has status failed, and the others go on.  brier is the mean over folds."""
    labeled = labeled.where(F.col("symbol").isin(symbols)) if symbols else labeled
    labeled = labeled.where(F.col("timeframe").isin(only)) if only else labeled
    gate = E.training_gate(labeled, timeframes)
    scored, model = out_of_sample(trained_pairs(labeled, timeframes))
    scored = settled(scored, "scored")
    found = E.brier_skill(scored).join(E.roc_auc(scored.where("fold > 0")), SERIES, "left").join(model.select(*SERIES, "residual"), SERIES, "left")
    sizes = labeled.groupBy(*SERIES).agg(F.count("*").alias("rows"))
    df = sizes.join(gate.select(*SERIES, "trained"), SERIES, "left").join(found, SERIES, "left")
    good = F.col("residual") <= 100 * OPTIMAL
    status = F.when(~F.coalesce("trained", F.lit(False)), "skipped").when(F.coalesce(good, F.lit(False)), "ok").otherwise("failed: no optimum")
    return df.select(*SERIES, "rows", status.alias("status"), F.col("fold_brier").alias("brier"), "auc")
