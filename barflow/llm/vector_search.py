"""Exact top-k inner products by ball trees.

A ball tree over a bounded sample (SAMPLE_BYTES) has a leaf for each shard of bounded bytes; every vector
goes to the shard whose leaf's centre is nearest, a large shard to several blocks.  A task gets a block's vectors,
builds its ball tree once, and then streams the queries through it, batch by batch; vectors are never copied.
Every query first searches its own block, which gives a kth score; it is sent only to blocks that can reach it: the
inner products of a shard, as those of a node, are at most q.c + |q| r.  In a block each query takes the child
of the higher bound first and leaves out nodes below its current kth score.

Vectors that are null or hold null or non-finite components take no part; vectors of different
lengths never meet.  Ties go to the smaller vec_id.  Of rows that repeat a vec_id each is a
candidate; a query never returns rows of its own vec_id.  Query rows of one vec_id and different vectors have a
list each; equal ones have one.  Scores are exact: sums that could pass 2**53 are taken as whole numbers, and those
beyond 64 bits are held at the largest.  No queries or no vectors: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barflow.llm.common import written

SCALE = 1024
LEAF = 96
SHARD_BYTES = 32 << 20  # of vectors as doubles
LEAST_ROWS = 8192  # of a shard, where more shards would only keep more cores busy
BATCH = 2048  # queries that go through a tree together
SAMPLE_BYTES, SAMPLE_ROWS = 16 << 20, 16_384  # of vectors that shards are cut by
LOWEST, HIGHEST = -(1 << 63), (1 << 63) - 1


class BallTree:
    """Nodes over the rows of x: (start, end) in self.order, centre, radius, children."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF):
        self.x, self.leaf = x, leaf
        self.order = np.arange(len(x))
        self.nodes: list[tuple] = []
        self._build(0, len(x))

    def _build(self, a: int, b: int) -> int:
        rows = self.x[self.order[a:b]]
        centre = rows.mean(0)
        away = ((rows - centre) ** 2).sum(1)
        at = len(self.nodes)
        self.nodes.append(())
        children = None
        if b - a > self.leaf and away.max() > 0:
            p = rows[away.argmax()]
            q = rows[((rows - p) ** 2).sum(1).argmax()]
            side = np.argsort(rows @ (p - q), kind="stable")
            self.order[a:b] = self.order[a:b][side]
            middle = (a + b) // 2
            children = (self._build(a, middle), self._build(middle, b))
        self.nodes[at] = (a, b, centre, float(np.sqrt(away.max())), children)
        return at


def products(q: np.ndarray, x: np.ndarray, largest: float) -> np.ndarray:
    """Inner products of whole numbers, as whole numbers."""
    if largest * np.abs(q).max(initial=0) * x.shape[1] < 1 << 53:
        return (q @ x.T).astype(np.int64)
    rows = [[int(v) for v in row] for row in x.tolist()]
    return np.array([[max(LOWEST + 1, min(HIGHEST, sum(a * b for a, b in zip(row, other)))) for other in rows] for row in ([int(v) for v in r] for r in q.tolist())], np.int64).reshape(len(q), len(x))


def tree_search(tree: BallTree, ids: np.ndarray, q: np.ndarray, q_ids: np.ndarray, floor: np.ndarray, k: int, seen: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Per query its k best (score, id) among the tree's rows, of those not below its floor; LOWEST where fewer.

    seen, where given, gets the number of rows that each visit of a leaf scored."""
    x = tree.x
    best = np.full((len(q), k), LOWEST, np.int64)
    found = np.full((len(q), k), -1, np.int64)
    norm = np.sqrt((q**2).sum(1)) * (1 + 1e-9)
    largest = float(np.abs(x).max(initial=0))

    def bound(node: int, of: np.ndarray) -> np.ndarray:
        _, _, centre, radius, _ = tree.nodes[node]
        b = q[of] @ centre + norm[of] * radius
        return b + 1 + 1e-9 * np.abs(b)

    def visit(node: int, of: np.ndarray, upper: np.ndarray) -> None:
        of = of[upper >= np.maximum(best[of, -1], floor[of])]
        if not len(of):
            return
        a, b, _, _, children = tree.nodes[node]
        if children is None:
            rows = tree.order[a:b]
            if seen is not None:
                seen.append(len(of) * len(rows))
            score = products(q[of], x[rows], largest)
            score[(q_ids[of][:, None] == ids[rows][None, :]) | (score < floor[of][:, None])] = LOWEST
            s = np.concatenate((best[of], score), 1)
            i = np.concatenate((found[of], np.broadcast_to(ids[rows], score.shape)), 1)
            top = np.lexsort((i, ~s), axis=1)[:, :k]
            best[of] = np.take_along_axis(s, top, 1)
            found[of] = np.take_along_axis(i, top, 1)
            return
        left, right = (bound(c, of) for c in children)
        first = left >= right
        for group, order in ((first, (0, 1)), (~first, (1, 0))):
            if group.any():
                for c in order:
                    visit(children[c], of[group], (left, right)[c][group])

    every = np.arange(len(q))
    visit(0, every, bound(0, every))
    return best, found


def vectors(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE, asks_col: str = "_asks") -> DataFrame:
    """(dim int, vec_id long, v array<double>, asks boolean) of whole numbers floor(scale * x), rows that take part only."""
    x = F.col(vector_col)
    sound = x.isNotNull() & ~F.exists(x, lambda e: e.isNull() | F.isnan(e.cast("double")) | (F.abs(e.cast("double")) == float("inf")))
    whole = F.transform(x, lambda e: F.floor(F.lit(float(scale)) * e.cast("double")).cast("double"))
    return table.where(sound & F.col(id_col).isNotNull() & (F.size(x) > 0)).select(F.size(x).alias("dim"), F.col(id_col).cast("long").alias("vec_id"), whole.alias("v"), F.col(asks_col).alias("asks"))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _searched(held: DataFrame, asked: DataFrame, parts: int, k: int) -> DataFrame:
    """(query, query_id, vec_id, score): each query's k best in the blocks that it is sent to.

    held: (dim, shard, vec_id, v).  asked has query and floor too: scores below it don't count."""
    rows = held.select("dim", "shard", F.lit(False).alias("asks"), "vec_id", "v", F.lit(0).cast("long").alias("query"), F.lit(0).cast("long").alias("floor")).union(asked.select("dim", "shard", F.lit(True).alias("asks"), "vec_id", "v", "query", "floor"))
    dealt = rows.repartition(parts, "dim", "shard").sortWithinPartitions("dim", "shard", "asks")  # a block's vectors come before its queries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, vectors_, ids, tree = None, [], [], None
        for b in batches:
            dim, shard, asks = (b.column(c).to_numpy(zero_copy_only=False) for c in ("dim", "shard", "asks"))
            cut = np.flatnonzero((dim[1:] != dim[:-1]) | (shard[1:] != shard[:-1]) | (asks[1:] != asks[:-1])) + 1
            for i, j in zip([0, *cut.tolist()], [*cut.tolist(), len(dim)]):
                if j == i:
                    continue
                if (dim[i], shard[i]) != now:
                    now, vectors_, ids, tree = (dim[i], shard[i]), [], [], None
                part = b.slice(i, j - i)
                if not asks[i]:
                    vectors_.append(_matrix(part.column("v")))
                    ids.append(part.column("vec_id").to_numpy())
                    continue
                if not vectors_:
                    continue
                if tree is None:
                    tree, ids = BallTree(np.concatenate(vectors_)), [np.concatenate(ids)]
                for at in range(0, part.num_rows, BATCH):
                    some = part.slice(at, BATCH)
                    q_ids = some.column("vec_id").to_numpy()
                    best, found = tree_search(tree, ids[0], _matrix(some.column("v")), q_ids, some.column("floor").to_numpy(), k)
                    hit = best > LOWEST
                    of = lambda c: pa.array(np.broadcast_to(some.column(c).to_numpy()[:, None], found.shape)[hit])  # noqa: B023, E731
                    yield pa.RecordBatch.from_arrays([of("query"), of("vec_id"), pa.array(found[hit]), pa.array(best[hit])], ["query", "query_id", "vec_id", "score"])

    return dealt.mapInArrow(run, "query long, query_id long, vec_id long, score long")


class Shards:
    """What is known of the shards of one vector length: centres, radii, and the blocks that each has."""

    def __init__(self, sample: np.ndarray, leaf: int):
        tree = BallTree(sample, max(1, leaf))
        self.centres = np.array([node[2] for node in tree.nodes if node[4] is None])
        self.radii, self.first, self.blocks = (np.zeros(len(self.centres), t) for t in (float, np.int64, np.int64))

    def reached(self, q: np.ndarray, floor: float) -> np.ndarray:
        """The blocks of the shards whose bound is not below floor."""
        bound = self.centres @ q + np.sqrt((q**2).sum()) * self.radii * (1 + 1e-9)
        at = np.flatnonzero(bound + 1 + 1e-9 * np.abs(bound) >= floor)
        return np.concatenate([np.arange(self.first[s], self.first[s] + self.blocks[s]) for s in at] or [np.zeros(0, np.int64)])


def dealt_shards(every: DataFrame) -> tuple[DataFrame, dict[int, Shards], int, int]:
    """(rows with shard, their block; Shards by length; blocks of a length that the sample lacks; parts)."""
    spark = every.sparkSession
    size = every.agg(F.count("*").alias("n"), F.sum("dim").alias("numbers"), F.max("dim").alias("dim")).first()
    n, cores = size["n"], spark.sparkContext.defaultParallelism
    shards = max(1, -(-8 * (size["numbers"] or 0) // SHARD_BYTES), min(2 * cores, -(-n // LEAST_ROWS)))
    each = max(1, -(-n // shards))
    sample = every.orderBy(F.xxhash64("vec_id"), "vec_id").limit(max(1, min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * (size["dim"] or 1))))).select("dim", "v").toArrow()
    lengths = sample.column("dim").to_numpy()
    known = {int(d): Shards(_matrix(sample.filter(pa.array(lengths == d)).column("v").combine_chunks()), len(lengths) // shards) for d in np.unique(lengths)}
    centres = spark.sparkContext.broadcast({d: s.centres for d, s in known.items()})

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = 0
        for b in batches:
            if not b.num_rows:
                continue
            dim = b.column("dim").to_numpy()
            own, far = np.zeros(len(dim), np.int32), np.zeros(len(dim))
            for d in np.unique(dim):
                c = centres.value.get(int(d))
                if c is None:
                    continue
                of = np.flatnonzero(dim == d)
                x = _matrix(b.column("v").take(pa.array(of)))
                own[of] = ((c**2).sum(1)[None, :] - 2 * x @ c.T).argmin(1)
                far[of] = np.sqrt(((x - c[own[of]]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(own), pa.array(far), pa.array(np.arange(place, place + len(dim)))], [*b.schema.names, "leaf", "far", "place"])
            place += len(dim)

    placed = written(every.mapInArrow(assign, "dim int, vec_id long, v array<double>, asks boolean, leaf int, far double, place long"), "placed")
    # a leaf for each shard of the sample's lengths; rows of other lengths are dealt without
    table, total = [], 0
    for r in placed.where(F.col("dim").isin([int(d) for d in known])).groupBy("dim", "leaf").agg(F.count("*").alias("n"), F.max("far").alias("far")).orderBy("dim", "leaf").collect():
        s = known[r["dim"]]
        s.radii[r["leaf"]], s.blocks[r["leaf"]] = r["far"], max(1, round(r["n"] / each))
        total += r["n"]
    for d, s in known.items():
        s.first = np.concatenate(([0], np.cumsum(s.blocks)[:-1]))
        table += zip([d] * len(s.first), range(len(s.first)), s.first.tolist(), s.blocks.tolist())
    others = max(1, -(-(n - total) // each))
    where = spark.createDataFrame(table, "dim int, leaf int, first long, blocks long")
    block = F.coalesce(F.col("first") + F.pmod("place", F.greatest("blocks", F.lit(1))), F.pmod("place", F.lit(others)))
    return placed.join(F.broadcast(where), ["dim", "leaf"], "left").select("dim", block.alias("shard"), "vec_id", "v", "asks"), known, others, shards


def top_k(table: DataFrame, is_query, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows of table that the condition is_query picks."""
    asking = table.withColumn("_asks", F.coalesce(is_query, F.lit(False)))
    held, known, others, parts = dealt_shards(vectors(asking, id_col, vector_col, scale, "_asks"))
    model = table.sparkSession.sparkContext.broadcast((known, others))
    once = held.where("asks").groupBy("dim", "vec_id", "v").agg(F.min("shard").alias("own"))
    queries = written(once.withColumn("query", F.xxhash64("vec_id", "v")), "queries")
    by_score = Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id")
    seeds = written(_searched(held, queries.withColumnRenamed("own", "shard").withColumn("floor", F.lit(LOWEST)), parts, k), "seeds")
    kth = seeds.withColumn("r", F.row_number().over(by_score)).where(F.col("r") == k).select("query", F.col("score").alias("floor"))

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards, more = model.value
        for b in batches:
            at, to = [], []
            for row, (dim, own, floor, q) in enumerate(zip(*(b.column(c).to_pylist() for c in ("dim", "own", "floor")), b.column("v").to_pylist())):
                blocks = shards[dim].reached(np.array(q), floor) if dim in shards else np.arange(more)
                blocks = blocks[blocks != own]
                at += [row] * len(blocks)
                to += blocks.tolist()
            for i in range(0, len(at), 4096):
                out = b.take(pa.array(at[i : i + 4096], pa.int64()))
                yield pa.RecordBatch.from_arrays([*out.columns, pa.array(to[i : i + 4096], pa.int64())], [*out.schema.names, "shard"])

    # the own block's answers are there already; the others must reach their kth score
    floors = queries.join(kth, "query", "left").select("dim", "vec_id", "v", "own", "query", F.coalesce("floor", F.lit(LOWEST)).alias("floor"))
    rest = floors.mapInArrow(sent, "dim int, vec_id long, v array<double>, own long, query long, floor long, shard long")
    found = _searched(held, rest, parts, k).union(seeds)
    return found.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
