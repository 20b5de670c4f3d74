"""Hard negatives by an inverted multi-index of half vectors.

Two codebooks, one for each half of the vectors, are fitted on a bounded sample (SAMPLE_BYTES); a vector's
nearest word in each makes its cell, and every vector is indexed.  The bound of a cell's inner products
is the sum of two half bounds, q1.c1 + |q1| r1 + q2.c2 + |q2| r2, with the largest distance r of a
word's members.  Neighbouring cells are dealt to shards of bounded bytes, a large cell to several.  An
anchor first searches its own shard; what it finds there gives the score that others must reach, and it is
sent only to shards that hold a cell whose bound does.  In a shard a heap visits the cells in descending
order of their bounds (multi-sequence), and the search stops when the next bound cannot change any window:
all are certified.  Positives come first; their scores give the windows of the negatives, which are then
searched the same way.  The results are exact, whatever the sample.

Vectors that are null or hold null or non-finite components, null labels and null ids take no part;
vectors of different lengths never meet; lengths that the sample lacks have one cell.  Ties go to the
smaller vec_id.  Rows that repeat a vec_id are rows of their own, but no positive of an anchor has
its vec_id; equal anchors count once.  Scores are exact; beyond 2**53 they are summed as whole numbers, and
beyond 64 bits they are held at the largest.  An empty table, no anchors or one label give no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barflow.llm.common import written

SAMPLE_BYTES = 16 << 20  # of vectors that the codebooks are fitted on
SAMPLE_ROWS = 16_384
MOST_WORDS = 256  # of a codebook
CELL_ROWS = 32  # of a cell, about
SHARD_BYTES = 32 << 20
LEAST_ROWS = 8192  # of a shard, where more shards would only keep more cores busy
SOME_ROWS = 256  # that are scored together while cells are visited
ROUNDS = 8  # of the codebooks' fit
LOWEST, HIGHEST = -(1 << 63), (1 << 63) - 1


def halves(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return x[:, : x.shape[1] // 2], x[:, x.shape[1] // 2 :]


def nearest(x: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word, distance) of each row."""
    word = (words**2).sum(1)[None, :] - 2 * x @ words.T
    word = word.argmin(1)
    return word, np.sqrt(((x - words[word]) ** 2).sum(1))


def codebook(x: np.ndarray, size: int) -> np.ndarray:
    """At most size words of the rows of x."""
    if not x.shape[1]:
        return np.zeros((1, 0))
    words = np.unique(x, axis=0)
    if len(words) > size:
        words = words[np.random.default_rng(0).choice(len(words), size, replace=False)]
        for _ in range(ROUNDS):
            word, _ = nearest(x, words)
            n = np.bincount(word, minlength=len(words))
            total = np.zeros_like(words)
            np.add.at(total, word, x)
            words = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], words)
    return words


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def vectors(table: DataFrame, is_anchor: Column, scale: int, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(vec_id, label string, asks, dim, v): whole numbers floor(scale * x) of rows that take part."""
    x = F.col(vector_col)
    sound = x.isNotNull() & ~F.exists(x, lambda e: e.isNull() | F.isnan(e.cast("double")) | (F.abs(e.cast("double")) == float("inf")))
    whole = F.transform(x, lambda e: F.floor(F.lit(float(scale)) * e.cast("double")).cast("double"))
    rows = table.where(sound & F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & (F.size(x) > 0))
    return rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.coalesce(is_anchor, F.lit(False)).alias("asks"), F.size(x).alias("dim"), whole.alias("v"))


class Cells:
    """What is known of the cells of one vector length: codebooks, radii of their words, shards of the cells."""

    def __init__(self, first: np.ndarray, second: np.ndarray):
        self.words = first, second
        self.radii = np.zeros(len(first)), np.zeros(len(second))

    def deal(self, i: np.ndarray, j: np.ndarray, n: np.ndarray, rows: int) -> None:
        """Neighbouring cells (i, j) of n rows come into shards of about so many rows, a larger cell into several."""
        self.i, self.j = i, j
        blocks = np.maximum(1, -(-n // rows))
        base, now, full = np.zeros(len(n), np.int64), 0, 0
        for at, (size, b) in enumerate(zip(n.tolist(), blocks.tolist())):
            if full and (b > 1 or full + size > rows):
                now, full = now + 1, 0
            base[at] = now
            now, full = (now + b, 0) if b > 1 else (now, full + size)
        self.base, self.blocks = base, blocks

    def reached(self, q: np.ndarray, floor: float) -> np.ndarray:
        """The shards that hold a cell whose bound is not below floor."""
        first, second = (h @ w.T + np.sqrt((h**2).sum(1)) * r for h, w, r in zip(halves(q[None, :]), self.words, self.radii))
        bound = first.ravel()[self.i] + second.ravel()[self.j]
        at = np.flatnonzero(bound + 1 + 1e-9 * np.abs(bound) >= floor)
        return np.unique(np.concatenate([np.arange(a, a + b) for a, b in zip(self.base[at], self.blocks[at])] or [np.zeros(0, np.int64)]))


class MultiIndex:
    """The inverted multi-index of one shard's rows."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, labels: np.ndarray, i: np.ndarray, j: np.ndarray, words: tuple[np.ndarray, np.ndarray]):
        order = np.lexsort((j, i))
        self.x, self.ids, self.labels = x[order], ids[order], labels[order]
        self.largest = float(np.abs(x).max())
        i, j = i[order], j[order]
        (self.first, i), (self.second, j) = (np.unique(k, return_inverse=True) for k in (i, j))
        self.words = words[0][self.first], words[1][self.second]
        self.radii = tuple(self._radii(h, w, k) for h, w, k in zip(halves(self.x), self.words, (i, j)))
        cut = np.flatnonzero(np.concatenate(([True], (i[1:] != i[:-1]) | (j[1:] != j[:-1]))))
        self.cells = {(int(i[a]), int(j[a])): (int(a), int(b)) for a, b in zip(cut, [*cut[1:], len(i)])}

    @staticmethod
    def _radii(half: np.ndarray, words: np.ndarray, of: np.ndarray) -> np.ndarray:
        out = np.zeros(len(words))
        np.maximum.at(out, of, np.sqrt(((half - words[of]) ** 2).sum(1)))
        return out

    def visits(self, q: np.ndarray) -> Iterator[tuple[float, int, int]]:
        """(bound, start, end) of the cells' rows, bounds descending."""
        bounds = [(h @ w.T).ravel() + np.sqrt((h**2).sum()) * r for h, w, r in zip(halves(q[None, :]), self.words, self.radii)]
        orders = [np.argsort(-b, kind="stable") for b in bounds]
        sums = [b[o].tolist() for b, o in zip(bounds, orders)]
        names = [o.tolist() for o in orders]
        heap, seen = [(-(sums[0][0] + sums[1][0]), 0, 0)], {(0, 0)}
        while heap:
            less, a, b = heapq.heappop(heap)
            for c in ((a + 1, b), (a, b + 1)):
                if c[0] < len(sums[0]) and c[1] < len(sums[1]) and c not in seen:
                    seen.add(c)
                    heapq.heappush(heap, (-(sums[0][c[0]] + sums[1][c[1]]), *c))
            cell = self.cells.get((names[0][a], names[1][b]))
            if cell:
                yield -less + 1 + 1e-9 * abs(less), *cell

    def scores(self, q: np.ndarray, at: np.ndarray) -> np.ndarray:
        if self.largest * np.abs(q).max() * len(q) < 1 << 53:
            return (self.x[at] @ q).astype(np.int64)
        exact = [int(e) for e in q.tolist()]
        return np.array([min(HIGHEST, max(LOWEST, sum(int(a) * b for a, b in zip(row, exact)))) for row in self.x[at].tolist()], np.int64)

    def search(self, q: np.ndarray, takes: np.ndarray, windows: list[tuple[int, int]], k: int, floor: int) -> tuple[list[tuple[np.ndarray, np.ndarray]], int]:
        """For each window (lowest, highest score) its k best (score, id) among the rows that are taken, none below floor; and how many rows were scored."""
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in windows]
        floors = [max(low, floor) for low, _ in windows]
        scored, held, size = 0, [], 0

        def score() -> None:
            nonlocal scored
            at = np.concatenate(held)
            at = at[takes[at]]
            scored += len(at)
            s = self.scores(q, at)
            for w, (_, high) in enumerate(windows):
                fits = (s >= floors[w]) & (s <= high)
                if fits.any():
                    values, ids = np.concatenate((best[w][0], s[fits])), np.concatenate((best[w][1], self.ids[at[fits]]))
                    top = np.lexsort((ids, ~values))[:k]
                    best[w] = values[top], ids[top]
                    if len(top) == k:
                        floors[w] = max(floors[w], int(best[w][0][-1]))
            held.clear()

        for bound, a, b in self.visits(q):
            if bound < min(floors):
                break
            held.append(np.arange(a, b))
            size += b - a
            if size >= SOME_ROWS:
                score()
                size = 0
        if held:
            score()
        return best, scored


def window(positive: int, least: int, most: int) -> tuple[int, int]:
    """Scores s with least * positive <= 100 s <= most * positive."""
    return -(-least * positive // 100), most * positive // 100


def _searched(held: DataFrame, asked: DataFrame, model, parts: int, k: int, share: tuple[int, int] | None) -> DataFrame:
    """(anchor, target, vec_id, score): the k best rows in the shards that anchors are sent to.

    Without share: of the anchor's own label, target 0.  Else: of other labels, target being each of
    the anchor's positive scores and share the percentages of it between which a score must lie."""
    asks = F.lit(True).alias("asks")
    none = [F.lit(None).cast(t).alias(c) for c, t in (("anchor", "long"), ("floor", "long"), ("targets", "array<long>"))]
    columns = ["dim", "shard", "asks", "vec_id", "label", "v", "i", "j", "anchor", "floor", "targets"]
    rows = held.select("dim", "shard", F.lit(False).alias("asks"), "vec_id", "label", "v", "i", "j", *none).union(asked.select("dim", "shard", asks, *columns[3:]))
    dealt = rows.repartition(parts, "dim", "shard").sortWithinPartitions("dim", "shard", "asks")  # a shard's vectors come before its anchors

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, gathered, index, names = None, [], None, {}
        for b in batches:
            dim, shard, asks_ = (b.column(c).to_numpy(zero_copy_only=False) for c in ("dim", "shard", "asks"))
            cut = np.flatnonzero((dim[1:] != dim[:-1]) | (shard[1:] != shard[:-1]) | (asks_[1:] != asks_[:-1])) + 1
            for a, e in zip([0, *cut.tolist()], [*cut.tolist(), len(dim)]):
                if a == e:
                    continue
                if (dim[a], shard[a]) != now:
                    now, gathered, index = (dim[a], shard[a]), [], None
                part = b.slice(a, e - a)
                if not asks_[a]:
                    gathered.append(part)
                    continue
                if index is None and gathered:
                    x = pa.Table.from_batches(gathered).combine_chunks()
                    labels = x.column("label").combine_chunks().dictionary_encode()
                    labels = labels.combine_chunks() if isinstance(labels, pa.ChunkedArray) else labels
                    names = {n: c for c, n in enumerate(labels.dictionary.to_pylist())}
                    cells = model.value["cells"].get(int(now[0]))
                    words = cells.words if cells else tuple(np.zeros((1, h.shape[1])) for h in halves(np.zeros((1, int(now[0])))))
                    vector = x.column("v").combine_chunks()
                    index = MultiIndex(_matrix(vector), x.column("vec_id").to_numpy(), labels.indices.to_numpy(), x.column("i").to_numpy(), x.column("j").to_numpy(), words)
                    gathered = []
                if index is None:
                    continue
                out: list[list] = [[], [], [], []]
                for anchor, vec_id, label, q, floor, targets in zip(*(part.column(c).to_pylist() for c in ("anchor", "vec_id", "label")), _matrix(part.column("v")), *(part.column(c).to_pylist() for c in ("floor", "targets"))):
                    same = index.labels == names.get(label, -1)
                    if share:
                        kept = [(t, w) for t in targets if (w := window(t, *share))[0] <= w[1]]
                        takes = ~same
                    else:
                        kept, takes = [(0, (LOWEST, HIGHEST))], same & (index.ids != vec_id)
                    if not kept:
                        continue
                    best, _ = index.search(q, takes, [w for _, w in kept], k, floor)
                    for (t, _), (score, ids) in zip(kept, best):
                        for place, values in enumerate(([anchor] * len(ids), [t] * len(ids), ids.tolist(), score.tolist())):
                            out[place] += values
                if out[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["anchor", "target", "vec_id", "score"])

    return dealt.mapInArrow(run, "anchor long, target long, vec_id long, score long")


def indexed(rows: DataFrame, words: int | None = None) -> tuple[DataFrame, dict, int]:
    """(rows with their cells and shards, what is known of the cells, how many shards): every row is indexed."""
    spark = rows.sparkSession
    size = rows.agg(F.count("*").alias("n"), F.sum("dim").alias("numbers"), F.max("dim").alias("dim")).first()
    n = size["n"]
    several = words or max(1, min(MOST_WORDS, round((n / CELL_ROWS) ** 0.5)))
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(max(1, min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * (size["dim"] or 1))))).select("dim", "v").toArrow()
    lengths = sample.column("dim").to_numpy()
    cells = {int(d): Cells(*(codebook(h, several) for h in halves(_matrix(sample.filter(pa.array(lengths == d)).column("v").combine_chunks())))) for d in np.unique(lengths)}
    books = spark.sparkContext.broadcast({d: c.words for d, c in cells.items()})

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = 0
        for b in batches:
            if not b.num_rows:
                continue
            dim = b.column("dim").to_numpy()
            i, j, far1, far2 = np.zeros(len(dim), np.int32), np.zeros(len(dim), np.int32), np.zeros(len(dim)), np.zeros(len(dim))
            for d in np.unique(dim):
                of = np.flatnonzero(dim == d)
                if int(d) in books.value:
                    for h, w, word, far in zip(halves(_matrix(b.column("v").take(pa.array(of)))), books.value[int(d)], (i, j), (far1, far2)):
                        word[of], far[of] = nearest(h, w)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(i), pa.array(j), pa.array(far1), pa.array(far2), pa.array(np.arange(at, at + len(dim)))], [*b.schema.names, "i", "j", "far1", "far2", "place"])
            at += len(dim)

    placed = written(rows.mapInArrow(assign, "vec_id long, label string, asks boolean, dim int, v array<double>, i int, j int, far1 double, far2 double, place long"), "indexed")
    cores = spark.sparkContext.defaultParallelism
    shards = max(1, -(-8 * (size["numbers"] or 0) // SHARD_BYTES), min(2 * cores, -(-n // LEAST_ROWS)))
    each = max(1, -(-n // shards))
    # lengths of the sample have at most MOST_WORDS**2 cells; rows of other lengths are dealt without cells
    of_sample = placed.where(F.col("dim").isin([int(d) for d in cells]))
    counted = of_sample.groupBy("dim", "i", "j").agg(F.count("*").alias("n"), F.max("far1").alias("far1"), F.max("far2").alias("far2")).toArrow().sort_by([("dim", "ascending"), ("i", "ascending"), ("j", "ascending")])
    table, total = [], 0
    for d, known in cells.items():
        mine = counted.filter(pa.array(counted.column("dim").to_numpy() == d))
        i, j, m, far1, far2 = (mine.column(c).to_numpy() for c in ("i", "j", "n", "far1", "far2"))
        total += int(m.sum())
        for radii, word, far in zip(known.radii, (i, j), (far1, far2)):
            np.maximum.at(radii, word, far)
        known.deal(i, j, m, each)
        table += zip([d] * len(i), *(c.tolist() for c in (i, j, known.base, known.blocks)))
    others = max(1, -(-(n - total) // each))
    where = spark.createDataFrame(table, "dim int, i int, j int, base long, blocks long")
    shard = F.coalesce(F.col("base") + F.pmod("place", "blocks"), F.pmod("place", F.lit(others)))
    dealt = placed.join(F.broadcast(where), ["dim", "i", "j"], "left").withColumn("shard", shard).drop("base", "blocks", "far1", "far2", "place")
    return dealt, {"cells": cells, "others": others}, shards


def hard_negatives(table: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, least: int = 30, most: int = 90, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", words: int | None = None) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    An anchor's positives are its best rows of the same label; the negatives of a pair are the best rows of
    other labels whose scores lie between least and most percent of the positive's."""
    held, known, parts = indexed(vectors(table, is_anchor, scale, id_col, vector_col, label_col), words)
    model = table.sparkSession.sparkContext.broadcast(known)
    once = held.where("asks").groupBy("vec_id", "label", "dim", "v", "i", "j").agg(F.min("shard").alias("own")).withColumn("anchor", F.xxhash64("vec_id", "label", "v"))
    anchors = written(once, "anchors")

    def sent(found: DataFrame) -> DataFrame:
        """Anchors with floors, once for each further shard that they must search."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                at, to = [], []
                for row, (dim, own, floor, q) in enumerate(zip(*(b.column(c).to_pylist() for c in ("dim", "own", "floor", "v")))):
                    cells = model.value["cells"].get(dim)
                    shards = cells.reached(np.array(q), floor) if cells else np.arange(model.value["others"])
                    shards = shards[shards != own]
                    at += [row] * len(shards)
                    to += shards.tolist()
                for a in range(0, len(at), 4096):
                    out = b.take(pa.array(at[a : a + 4096], pa.int64()))
                    yield pa.RecordBatch.from_arrays([*out.columns, pa.array(to[a : a + 4096], pa.int64())], [*out.schema.names, "shard"])

        return found.mapInArrow(run, "vec_id long, label string, dim int, v array<double>, i int, j int, own long, anchor long, floor long, targets array<long>, shard long")

    def both(asked: DataFrame, floors, k: int, share: tuple[int, int] | None, name: str) -> DataFrame:
        """Seeds of the own shard, then the rest from the floors that floors(seeds) gives."""
        seeds = written(_searched(held, asked.withColumn("shard", F.col("own")), model, parts, k, share), name)
        asked = asked.drop("floor").join(floors(seeds), "anchor", "left").withColumn("floor", F.coalesce("floor", F.lit(LOWEST)))
        rest = sent(asked.select("vec_id", "label", "dim", "v", "i", "j", "own", "anchor", "floor", "targets"))
        return _searched(held, rest, model, parts, k, share).union(seeds)

    by_score = Window.partitionBy("anchor", "target").orderBy(F.desc("score"), "vec_id")

    def ranked(found: DataFrame, k: int) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k)

    asked = anchors.withColumn("floor", F.lit(LOWEST)).withColumn("targets", F.lit(None).cast("array<long>"))
    kth = lambda seeds: ranked(seeds, positives).where(F.col("rank") == positives).select("anchor", F.col("score").alias("floor"))
    pairs = written(ranked(both(asked, kth, positives, None, "near"), positives).select("anchor", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")

    targets = pairs.groupBy("anchor").agg(F.array_sort(F.collect_set("positive_score")).alias("targets"))  # at most as many as positives
    asked = anchors.withColumn("floor", F.lit(LOWEST)).join(targets, "anchor")

    def lowest(seeds: DataFrame) -> DataFrame:
        """The least score that can still enter a window of an anchor: a full one's last, else its lower end."""
        full = ranked(seeds, negatives).where(F.col("rank") == negatives).select("anchor", F.col("target"), F.col("score"))
        low = -F.floor(F.lit(-least) * F.col("positive_score").cast("decimal(20,0)") / 100)
        every = pairs.where("positive_score >= 0").select("anchor", F.col("positive_score").alias("target"), low.cast("long").alias("low")).distinct()
        return every.join(full, ["anchor", "target"], "left").groupBy("anchor").agg(F.min(F.coalesce("score", "low")).alias("floor"))

    found = ranked(both(asked, lowest, negatives, (least, most), "far"), negatives)
    ids = anchors.select("anchor", F.col("vec_id").alias("anchor_id"))
    joined = pairs.join(found.withColumnRenamed("target", "positive_score"), ["anchor", "positive_score"]).join(ids, "anchor")
    return joined.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
