"""The benchmark models of all pairs, outer folds and inner folds at once: forests, boosted trees, stumps, naive Bayes.

Columns are cut at quantiles of their pair into at most BINS bins.  A level of every tree of every fit grows by one
pass: tasks sum what the model needs (weights, labels, residuals) by (fit, tree, node, column, bin), Spark brings the
parts of a tree together and tasks choose its splits; only splits come to the driver.  A fit is one pair's rows
before an inner fold, which calibrates it (isotonic, over GRID score steps); an outer fold's probability is the mean
of its inner fits'.  Boosting passes recompute scores from the trees since margins were last settled.
"""

from __future__ import annotations

import time
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barflow.operators import evaluation as E
from barflow.operators.features import TECHNICAL
from barflow.operators.training import each_pair, matrix_of, sigmoid, training_rows
from barflow.sources.bars import SERIES, settled

BINS = 32
HELD = 1 << 17  # rows that a task sums at once
GRID = 10_000  # steps of scores between 0 and 1 that a calibration tells apart
SETTLED = 20  # rounds of boosting after which margins are written
#: Trees, depth and learning rate of the published benchmarks.
FOREST = {"trees": 100, "depth": 5}
BOOST = {"rounds": 100, "depth": 3, "rate": 0.1}
STUMPS = {"rounds": 50, "rate": 0.5}
BENCHMARKS = ("random_forest", "gradient_boost", "ada_boost", "naive_bayes")
OPEN, LEAF = -2, -1  # a node that may be split, one that is not
_POISSON = np.cumsum([np.exp(-1) / f for f in (1, 1, 2, 6, 24, 120, 720, 5040)])


def inner_fits(pairs: list, folds: int, inner: int) -> list[dict]:
    """Fits: a pair's rows before position a, calibrated on a..b, for the outer fold that starts at `test`."""
    out = []
    for p, (_, _, n) in enumerate(pairs):
        size = n // (folds + 1)
        for k in range(1, folds + 1):
            m = n - size * folds + (k - 1) * size
            s = m // (inner + 1)
            out += [{"pair": p, "fold": k, "a": m - s * (inner - i), "b": m - s * (inner - i - 1)} for i in range(inner)] if size and s else []
    for p in range(len(pairs)):
        for slot, fit in enumerate(f for f in out if f["pair"] == p):
            fit["slot"] = slot
    return out


#: A block's columns, each packed into one binary value; codes lie column by column, margins have one number a fit.
PACKED = {"pos": "<i8", "fold": "<i4", "label": "u1", "codes": "u1", "x": "<f8", "margins": "<f8"}
BLOCK = "pair int, " + ", ".join(f"{c} binary" for c in PACKED)


def binned(rows: DataFrame, pairs: list, width: int) -> DataFrame:
    """(pair, pos, fold, label, codes one byte a column, x) of training rows."""
    steps = [i / BINS for i in range(1, BINS)]
    by = rows.groupBy("_pair").agg(*(F.percentile_approx(F.get("_x", F.lit(j)), steps, 20_000).alias(f"c{j}") for j in range(width))).collect()
    edges = rows.sparkSession.sparkContext.broadcast({r["_pair"]: [np.unique(np.array(r[f"c{j}"], float)) for j in range(width)] for r in by})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x, codes = matrix_of(b.column("x"), width), np.zeros((b.num_rows, width), np.uint8)
            for p, of in each_pair(b, "pair"):
                for j, e in enumerate(edges.value[p]):
                    codes[of, j] = np.searchsorted(e, x[of, j])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([c.tobytes() for c in codes], pa.binary())], [*b.schema.names, "codes"])

    shape = "pair int, pos long, fold int, label int, x array<double>, codes binary"
    return rows.select(F.col("_pair").alias("pair"), "pos", "fold", F.col("label").cast("int").alias("label"), F.col("_x").alias("x")).mapInArrow(run, shape)


def packed(table: DataFrame, width: int) -> DataFrame:
    """Binned rows in blocks of one pair, of about HELD rows at most, settled; blocks stay as they are.

    Every level of every tree reads all rows, and Spark hands over a few large values far faster than as many rows."""
    if dict(table.dtypes)["pos"] == "binary":
        return table

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _gathered(batches):
            x, codes = matrix_of(b.column("x"), width), np.frombuffer(b"".join(b.column("codes").to_pylist()), np.uint8).reshape(-1, width)
            pos, fold, label = (b.column(c).to_numpy() for c in ("pos", "fold", "label"))
            for p, of in each_pair(b, "pair"):
                yield _block(p, {"pos": pos[of], "fold": fold[of], "label": label[of], "codes": codes[of].T, "x": x[of], "margins": np.zeros(0)})

    return settled(table.mapInArrow(run, BLOCK), "blocks")


def _block(pair: int, columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    values = [pa.array([columns[c].astype(kind).tobytes()], pa.binary()) for c, kind in PACKED.items()]
    return pa.RecordBatch.from_arrays([pa.array([pair], pa.int32()), *values], ["pair", *PACKED])


def _blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[int, dict[str, np.ndarray]]]:
    """(pair, its rows' columns) of each block, of the columns that were selected."""
    for b in batches:
        for i in range(b.num_rows):
            out = {c: np.frombuffer(b.column(c)[i].as_buffer(), PACKED[c]) for c in b.schema.names if c != "pair"}
            shapes = {"codes": lambda v: v.reshape(width, -1).T, "x": lambda v: v.reshape(-1, width), "label": lambda v: v.astype(float)}
            yield b.column("pair")[i].as_py(), {c: shapes[c](v) if c in shapes else v for c, v in out.items()}


class Trees:
    """Trees of fits, nodes as in a heap: column and bin of the split, value as a leaf."""

    def __init__(self, fits: int, trees: int, depth: int):
        shape = (fits, trees, 2 ** (depth + 1) - 1)
        self.depth, self.column, self.bin, self.value = depth, np.full(shape, LEAF, np.int16), np.zeros(shape, np.int16), np.zeros(shape)
        self.column[:, :, 0] = OPEN
        self.wrong = np.zeros((fits, trees))  # of a stump: the weighted share that it gets wrong

    def node(self, fit: int, tree: int, codes: np.ndarray) -> np.ndarray:
        """The leaf, or open node, that each row is in; nodes are fewer than 256."""
        column, cut, inner = self.column[fit, tree].tolist(), self.bin[fit, tree].tolist(), 2**self.depth - 1

        def below(i: int):
            """The node under i that each row reaches; i itself where it isn't split."""
            if i >= inner or column[i] < 0:
                return np.uint8(i)
            right = np.negative((codes[:, column[i]] > cut[i]).view(np.uint8))  # all bits, or none
            lo, hi = below(2 * i + 1), below(2 * i + 2)
            right &= lo ^ hi
            right ^= lo
            return right

        at = below(0)
        return at if at.ndim else np.full(len(codes), at)

    def scores(self, fit: int, tree: int, codes: np.ndarray) -> np.ndarray:
        return self.value[fit, tree].take(self.node(fit, tree, codes))


def _drawn(fit: int, tree: int, nodes: int, width: int) -> np.ndarray:
    """The columns that a forest's nodes may split on: as many as the root of their number."""
    rng = np.random.default_rng((7, fit, tree))
    return np.argsort(rng.random((nodes, width)), axis=1)[:, : max(1, int(width**0.5))]


def _bootstrap(pos: np.ndarray, fit: int, tree: int) -> np.ndarray:
    """How often each row is in a tree's sample (Poisson of mean 1), the same wherever it is computed."""
    h = pos.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((fit * 1_000_003 + tree) * 2_654_435_761 % (1 << 63))
    for s in (30, 27, 31):
        h ^= h >> np.uint64(s)
        h *= np.uint64(0xBF58476D1CE4E5B9)
    h >>= np.uint64(11)
    u = h / float(1 << 53)
    return sum((u > p).view(np.uint8) for p in _POISSON)


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in larger ones, of about HELD rows."""
    held, n = [], 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            n += b.num_rows
        if n >= HELD:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, n = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _some(codes: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Rows of codes, again column by column."""
    return codes.T.take(of, axis=1).T


def _margins(block: dict[str, np.ndarray], slots: int) -> np.ndarray:
    """What earlier rounds gave the rows in each of the pair's fits; nothing was settled yet where they are empty."""
    m = block["margins"]
    return m.reshape(-1, slots) if len(m) else np.zeros((len(block["label"]), slots))


def _row_values(kind: str, fit: dict, q: int, tree: int, pos: np.ndarray, label: np.ndarray, margin: np.ndarray):
    """The channels that a level sums for rows: weight and weighted label; for boosting also the curvature."""
    if kind == "random_forest":
        w = _bootstrap(pos, q, tree).astype(float)
        return w, w * label
    if kind == "ada_boost":
        w = np.exp(margin)
        return w, w * label
    p = sigmoid(margin)
    return np.ones(len(label)), label - p, p * (1 - p)


def _grown(hist: np.ndarray, kind: str, columns: np.ndarray):
    """(column or LEAF, bin, value, left value, right value, share of the left rows' weight) of each node of hist (node, column, bin, channel)."""
    nodes = len(hist)
    left = hist.cumsum(2)[:, :, :-1]
    whole = hist.sum(2)[:, :1, None]
    right = whole - left
    with np.errstate(divide="ignore", invalid="ignore"):
        if kind == "gradient_boost":
            away = left[..., 1] / left[..., 0] - right[..., 1] / right[..., 0]
            gain = left[..., 0] * right[..., 0] / whole[..., 0] * away**2
            value = lambda s: np.where(s[..., 2] > 1e-12, s[..., 1] / np.maximum(s[..., 2], 1e-12), 0.0)
        else:
            mixed = lambda s: 2 * s[..., 1] * (s[..., 0] - s[..., 1]) / s[..., 0]
            gain = mixed(whole) - mixed(left) - mixed(right)
            value = lambda s: np.where(s[..., 0] > 0, s[..., 1] / np.where(s[..., 0] > 0, s[..., 0], 1), 0.0)
    gain = np.where((left[..., 0] > 0) & (right[..., 0] > 0), gain, -1.0).reshape(nodes, -1)
    best = gain.argmax(1)
    slot, cut = np.divmod(best, left.shape[2])
    every = np.arange(nodes)
    column = np.where(gain[every, best] > 1e-10, columns[every, slot], LEAF)
    share = left[every, slot, cut][:, 0] / np.maximum(whole[:, 0, 0, 0], 1e-300)
    return column, cut, value(whole[:, 0, 0]), value(left[every, slot, cut]), value(right[every, slot, cut]), share


def _cells(codes: np.ndarray, rows: np.ndarray, local: np.ndarray, columns: np.ndarray, values: list[np.ndarray], counted: bool) -> np.ndarray:
    """Sums of the rows' values by (node, its slot of columns, bin), a column a channel; counted: the first one's values are all 1."""
    nodes, slots = columns.shape
    out, base, size = np.zeros((nodes, slots, BINS, len(values))), local * BINS, nodes * BINS
    every = len(rows) == len(codes)
    for s in range(slots):
        one = (columns[:, s] == columns[0, s]).all()
        cell = base + ((codes[:, columns[0, s]] if every else codes[:, columns[0, s]].take(rows)) if one else codes[rows, columns[local, s]])
        for k, v in enumerate(values):
            out[:, s, :, k] = (np.bincount(cell, minlength=size) if counted and not k else np.bincount(cell, v, size)).reshape(nodes, BINS)
    return out.reshape(-1, len(values))


def _level(table: DataFrame, fits: list[dict], trees: Trees, kind: str, level: int, width: int, first: int, now: list[int], weights: np.ndarray, active: np.ndarray) -> None:
    """Splits the open nodes of a level of the trees `now` of the active fits; margins are settled up to tree first."""
    nodes, offset, channels = 2**level, 2**level - 1, 3 if kind == "gradient_boost" else 2
    every = np.broadcast_to(np.arange(width), (nodes, width))
    drawn = lambda q, t: _drawn(q, t, 2 ** (trees.depth + 1), width)[offset : offset + nodes] if kind == "random_forest" else every
    own: dict[int, list[int]] = {}
    slots: dict[int, int] = {}
    for q, fit in enumerate(fits):
        slots[fit["pair"]] = max(slots.get(fit["pair"], 0), fit["slot"] + 1)
        if active[q]:
            own.setdefault(fit["pair"], []).append(q)
    model = table.sparkSession.sparkContext.broadcast((fits, own, slots, trees, weights))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fits_, own_, slots_, trees_, weights_ = model.value
        found: dict[tuple[int, int], np.ndarray] = {}
        for p, block in _blocks(batches, width):
            pos, label, codes = block["pos"], block["label"], block["codes"]
            margins = None if kind == "random_forest" else _margins(block, slots_[p])
            for q in own_.get(p, []):
                at = np.flatnonzero(pos < fits_[q]["a"])
                if not len(at):
                    continue
                c, y = _some(codes, at), label[at]
                margin = None if margins is None else scored(kind, trees_, q, c, margins[at, fits_[q]["slot"]], y, first, now[0], weights_)
                for t in now:
                    node = trees_.node(q, t, c)
                    rows = np.flatnonzero((trees_.column[q, t] == OPEN)[node] & (node >= offset))
                    if not len(rows):
                        continue
                    values = _row_values(kind, fits_[q], q, t, pos[at], y, margin)
                    if kind == "random_forest":  # rows that the tree's sample leaves out add nothing
                        rows = rows[values[0][rows] > 0]
                    part = _cells(c, rows, node[rows].astype(np.intp) - offset, drawn(q, t), [v[rows] for v in values], kind == "gradient_boost")
                    part = part.astype(np.float64 if channels == 3 or kind == "ada_boost" else np.float32)
                    found[q, t] = found[q, t] + part if (q, t) in found else part
        items = list(found.items())
        for a in range(0, len(items), 256):
            some = items[a : a + 256]
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k, _ in some], pa.int32()), pa.array([k[1] for k, _ in some], pa.int32()), pa.array([v.astype("<f8").tobytes() for _, v in some], pa.binary())], ["fit", "tree", "hist"])

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key, out = None, None, []

        def end() -> None:
            columns = drawn(*key)
            grown = _grown(held.reshape(nodes, columns.shape[1], BINS, channels), kind, columns)
            out.append((*key, *(g.astype(float).tolist() for g in grown)))

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), [pa.int32(), pa.int32(), *[pa.list_(pa.float64())] * 6])], ["fit", "tree", "column", "bin", "value", "left", "right", "share"])

        for b in batches:
            for q, t, hist in zip(*(b.column(c).to_pylist() for c in ("fit", "tree", "hist"))):
                if key is not None and (q, t) != key:
                    end()
                    held = None
                key, part = (q, t), np.frombuffer(hist, "<f8")
                held = part if held is None else held + part
            if len(out) >= 256:
                yield batch()
                out.clear()
        if key is not None:
            end()
        if out:
            yield batch()

    needs = ["pair", "pos", "label", "codes", *([] if kind == "random_forest" else ["margins"])]
    parts = table.select(*needs).mapInArrow(sums, "fit int, tree int, hist binary").repartition("fit", "tree").sortWithinPartitions("fit", "tree")
    numbers = "array<double>"
    for r in parts.mapInArrow(choose, f"fit int, tree int, column {numbers}, bin {numbers}, value {numbers}, left {numbers}, right {numbers}, share {numbers}").toArrow().to_pylist():
        q, t = r["fit"], r["tree"]
        if kind == "ada_boost":
            split = r["column"][0] >= 0
            lo, hi, share = (r["left"][0], r["right"][0], r["share"][0]) if split else (r["value"][0], 0.0, 1.0)
            trees.wrong[q, t] = share * min(lo, 1 - lo) + (1 - share) * min(hi, 1 - hi)
        for i in range(nodes):
            at = offset + i
            if trees.column[q, t, at] == OPEN:
                trees.column[q, t, at], trees.bin[q, t, at], trees.value[q, t, at] = r["column"][i], r["bin"][i], r["value"][i]
                if r["column"][i] >= 0:
                    for child, v in ((2 * at + 1, r["left"][i]), (2 * at + 2, r["right"][i])):
                        trees.value[q, t, child] = v
                        trees.column[q, t, child] = OPEN if level + 1 < trees.depth else LEAF
    model.unpersist()


def scored(kind: str, trees: Trees, q: int, codes: np.ndarray, margin: np.ndarray, label: np.ndarray, first: int, last: int, weights: np.ndarray) -> np.ndarray:
    """A fit's margins after the trees first..last: sums of leaf values, or log weights of what stumps got wrong."""
    out = margin.copy()
    if first == 0 and kind == "gradient_boost":
        out += weights[q, -1]
    for t in range(first, last):
        v = trees.scores(q, t, codes)
        out += weights[q, t] * (v if kind == "gradient_boost" else ((v > 0.5) != (label > 0.5)))
    return out


def _settle(table: DataFrame, fits: list[dict], trees: Trees, kind: str, width: int, first: int, last: int, weights: np.ndarray) -> DataFrame:
    """table with the margins of all fits after the trees first..last."""
    own: dict[int, list[int]] = {}
    for q, fit in enumerate(fits):
        own.setdefault(fit["pair"], []).append(q)
    model = table.sparkSession.sparkContext.broadcast((own, trees, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_, trees_, weights_ = model.value
        for p, block in _blocks(batches, width):
            mine = own_.get(p, [])
            if mine:
                c, before = np.asfortranarray(block["codes"]), _margins(block, len(mine))
                block["margins"] = np.array([scored(kind, trees_, q, c, before[:, s], block["label"], first, last, weights_) for s, q in enumerate(mine)]).T
            yield _block(p, block | {"codes": block["codes"].T})

    return settled(table.mapInArrow(run, BLOCK), "margins")


def _classes(table: DataFrame, fits: list[dict], width: int) -> np.ndarray:
    """Rows, sums and squares of x of each fit's training rows, by label."""
    own: dict[int, list[int]] = {}
    for q, fit in enumerate(fits):
        own.setdefault(fit["pair"], []).append(q)
    size = 1 + 2 * width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros((len(fits), 2, size))
        for p, block in _blocks(batches, width):
            pos, x, label = block["pos"], block["x"], block["label"]
            for q in own.get(p, []):
                for y in (0, 1):
                    at = np.flatnonzero((pos < fits[q]["a"]) & (label == y))
                    found[q, y] += np.concatenate(([len(at)], x[at].sum(0), (x[at] ** 2).sum(0)))
        at = np.flatnonzero(found[:, :, 0].sum(1))
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(found[at].reshape(len(at), -1).tolist(), pa.list_(pa.float64()))], ["fit", "s"])

    out = np.zeros((len(fits), 2, size))
    parts = table.select("pair", "pos", "label", "x").mapInArrow(run, "fit int, s array<double>")
    for r in parts.groupBy("fit").agg(F.array(*(F.sum(F.get("s", F.lit(j))) for j in range(2 * size))).alias("s")).collect():
        out[r["fit"]] = np.array(r["s"]).reshape(2, size)
    return out


def _bayes(sums: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Log odds of a Gaussian naive Bayes of one fit's sums."""
    width = x.shape[1]
    n, total = sums[:, 0], sums[:, 0].sum()
    if (n == 0).any():
        return np.full(len(x), 30.0 if n[1] else -30.0)
    whole = sums.sum(0)
    spread = 1e-9 * (whole[1 + width :] / total - (whole[1 : 1 + width] / total) ** 2).max()
    odds = np.full(len(x), np.log(n[1] / n[0]))
    for y, sign in ((1, 1), (0, -1)):
        mean = sums[y, 1 : 1 + width] / n[y]
        var = np.maximum(sums[y, 1 + width :] / n[y] - mean**2, 0) + max(spread, 1e-12)
        odds += sign * (-0.5 * np.log(var) - 0.5 * (x - mean) ** 2 / var).sum(1)
    return odds


class Fitted:
    """One benchmark of all fits: scores from 0 to 1."""

    def __init__(self, kind: str, sums: np.ndarray, trees: Trees | None = None, weights: np.ndarray | None = None):
        self.kind, self.sums, self.trees, self.weights = kind, sums, trees, weights

    def scores(self, q: int, codes: np.ndarray, x: np.ndarray) -> np.ndarray:
        if self.kind == "naive_bayes":
            return sigmoid(np.clip(_bayes(self.sums[q], x), -600, 600) / 4)
        leaves = (self.trees.scores(q, t, codes) for t in range(self.trees.column.shape[1]))
        if self.kind == "random_forest":
            return sum(leaves) / self.trees.column.shape[1]
        w = self.weights[q]
        if self.kind == "gradient_boost":
            return sigmoid(w[-1] + sum(a * v for a, v in zip(w, leaves)))
        return 0.5 + sum(a * np.where(v > 0.5, 0.5, -0.5) for a, v in zip(w, leaves)) / max(w[:-1].sum(), 1e-12)


def fitted(table: DataFrame, fits: list[dict], kind: str, width: int, rounds: dict | None = None) -> Fitted:
    """One benchmark, fitted for all fits together."""
    table = packed(table, width)
    sums = _classes(table, fits, width)
    count = sums[:, :, 0]
    if kind == "naive_bayes":
        return Fitted(kind, sums)
    size = {"random_forest": FOREST, "gradient_boost": BOOST, "ada_boost": STUMPS}[kind] | (rounds or {})
    many, depth = size.get("trees") or size["rounds"], size.get("depth", 1)
    trees, weights, settled_at = Trees(len(fits), many, depth), np.zeros((len(fits), many + 1)), 0
    if kind == "random_forest":
        for level in range(depth):
            _level(table, fits, trees, kind, level, width, 0, list(range(many)), weights, count.sum(1) > 0)
        return Fitted(kind, sums, trees)
    active = (count > 0).all(1)
    if kind == "gradient_boost":
        weights[:, :-1] = size["rate"] * active[:, None]
        weights[:, -1] = np.log(np.maximum(count[:, 1], 1e-3) / np.maximum(count[:, 0], 1e-3))
    for t in range(many):
        for level in range(depth):
            _level(table, fits, trees, kind, level, width, settled_at, [t], weights, active)
        if kind == "ada_boost":
            for q in np.flatnonzero(active):
                wrong = trees.wrong[q, t]
                if 0 < wrong < 0.5:
                    weights[q, t] = size["rate"] * np.log((1 - wrong) / wrong)
                else:
                    weights[q, t], active[q] = (1.0 if t == 0 or wrong <= 0 else 0.0), False
        if not active.any():
            break
        if (t + 1) % SETTLED == 0 and t + 1 < many:
            table, settled_at = _settle(table, fits, trees, kind, width, settled_at, t + 1, weights), t + 1
    return Fitted(kind, sums, trees, weights)


def _isotonic(points: list[tuple[int, int, int]]) -> tuple[list[float], list[float]]:
    """Knots of the isotonic fit of (score step, rows, ones), steps ascending."""
    blocks: list[list[float]] = []
    for step, n, y in points:
        blocks.append([step, step, n, y])
        while len(blocks) > 1 and blocks[-2][3] * blocks[-1][2] >= blocks[-1][3] * blocks[-2][2]:
            _, last, n1, y1 = blocks.pop()
            blocks[-1][1:] = [last, blocks[-1][2] + n1, blocks[-1][3] + y1]
    x = [v / GRID for a, b, _, _ in blocks for v in ((a, b) if a < b else (a,))]
    return x, [y / n for a, b, n, y in blocks for _ in range(1 + (a < b))]


def _calibrations(table: DataFrame, fits: list[dict], score: Fitted, width: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    own: dict[int, list[int]] = {}
    for q, fit in enumerate(fits):
        own.setdefault(fit["pair"], []).append(q)
    model = table.sparkSession.sparkContext.broadcast((score, own))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score_, own_ = model.value
        for p, block in _blocks(batches, width):
            pos, x, label, codes = block["pos"], block["x"], block["label"], block["codes"]
            for q in own_.get(p, []):
                at = np.flatnonzero((pos >= fits[q]["a"]) & (pos < fits[q]["b"]))
                if len(at):
                    step = np.rint(score_.scores(q, _some(codes, at), x[at]) * GRID).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), q, np.int32)), pa.array(step), pa.array(label[at].astype(np.int64))], ["fit", "step", "y"])

    steps = table.drop("margins").mapInArrow(run, "fit int, step int, y long").groupBy("fit", "step").agg(F.count("*").alias("n"), F.sum("y").alias("y"))

    def knots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key, out = [], None, []
        for b in batches:  # at most GRID + 1 steps a fit
            for q, *point in zip(*(b.column(c).to_pylist() for c in ("fit", "step", "n", "y"))):
                if key is not None and q != key:
                    out.append((key, *_isotonic(held)))
                    held = []
                key = q
                held.append(tuple(point))
        if key is not None:
            out.append((key, *_isotonic(held)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), [pa.int32(), pa.list_(pa.float64()), pa.list_(pa.float64())])], ["fit", "x", "p"])

    found = steps.repartition("fit").sortWithinPartitions("fit", "step").mapInArrow(knots, "fit int, x array<double>, p array<double>").toArrow().to_pylist()
    return {r["fit"]: (np.array(r["x"]), np.array(r["p"])) for r in found}


def tested(table: DataFrame, pairs: list, fits: list[dict], kind: str, width: int, rounds: dict | None = None) -> DataFrame:
    """(symbol, timeframe, fold, label, proba) of the outer test rows."""
    table = packed(table, width)
    score = fitted(table, fits, kind, width, rounds)
    knots = _calibrations(table, fits, score, width)
    own: dict[tuple[int, int], list[int]] = {}
    for q, fit in enumerate(fits):
        own.setdefault((fit["pair"], fit["fold"]), []).append(q)
    model = table.sparkSession.sparkContext.broadcast((score, knots, own))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score_, knots_, own_ = model.value
        for p, block in _blocks(batches, width):
            fold, x, label, codes = block["fold"], block["x"], block["label"], block["codes"]
            for k in np.unique(fold):
                mine = own_.get((p, int(k)), [])
                if not mine:
                    continue
                at = np.flatnonzero(fold == k)
                proba = sum(np.interp(score_.scores(q, _some(codes, at), x[at]), *knots_[q]) for q in mine) / len(mine)
                names = [pa.array([v] * len(at), t) for v, t in ((pairs[p][0], pa.string()), (pairs[p][1], pa.string()), (int(k), pa.int32()))]
                yield pa.RecordBatch.from_arrays([*names, pa.array(label[at].astype(np.int32)), pa.array(proba)], ["symbol", "timeframe", "fold", "label", "proba"])

    return table.drop("margins").mapInArrow(run, "symbol string, timeframe string, fold int, label int, proba double")


def benchmarks(labeled: DataFrame, columns: list[str] = TECHNICAL, folds: int = E.FOLDS, inner: int = 3, names: tuple[str, ...] = BENCHMARKS, rounds: dict[str, dict] | None = None) -> DataFrame:
    """(symbol, timeframe, model, brier, auc, confidence, train_s) of every benchmark of each pair: means over the outer folds.

    train_s is the time that all pairs' fits took together."""
    rows, pairs = training_rows(labeled, columns, folds)
    table, fits, out = packed(binned(rows, pairs, len(columns)), len(columns)), inner_fits(pairs, folds, inner), []
    for name in names:
        began = time.time()
        test = settled(tested(table, pairs, fits, name, len(columns), (rounds or {}).get(name)), "tested")
        seconds = time.time() - began
        loss = F.avg(F.pow(F.col("proba") - F.col("label"), 2)).alias("brier")
        by = test.groupBy(*SERIES, "fold").agg(loss).join(E.roc_auc(test, [*SERIES, "fold"]), [*SERIES, "fold"], "left")
        means = by.groupBy(*SERIES).agg(F.avg("brier").alias("brier"), F.avg(F.coalesce("auc", F.lit(0.5))).alias("auc"))
        out.append(means.select(*SERIES, F.lit(name).alias("model"), "brier", "auc", F.greatest(1 - F.col("brier"), F.lit(0.0)).alias("confidence"), F.lit(seconds).alias("train_s")))
    every = out[0]
    for df in out[1:]:
        every = every.unionByName(df)
    return every
