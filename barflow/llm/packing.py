"""Packing of documents into sequences by linear grouping.

Only how many pieces of each length there are decides how sequences are filled: a table of at most
`capacity` numbers, whatever the corpus.  Large lengths are cut into groups of equally many pieces
and rounded up to their group's longest; the few sizes that are left get fractional
configurations by column generation; whole multiples of them are filled with actual lengths, each
place with the longest that it holds; what is left over and the small lengths then go best-fit,
longest first, into the room of the configurations too.  The plan says which ranks of each length go
to which sequences, and Spark ranks the pieces within their length.  Other columns of the documents are never read.

Nulls: a null text is empty, so it has the end id alone; a null doc_id stays null.  A very long text
is encoded whole and cut into pieces.  Repeated rows are packed each, pieces of equal length in the
order of their ids.  An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barflow.llm.common import crc, each_batch, parts_for, texts, written
from barflow.llm.pretoken import encoder

CAPACITY = 2048
GROUPS = 96  # sizes that large lengths are rounded up to
LARGE = 4  # lengths over capacity / LARGE are large
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
RANK_BITS = 44
STEPS = 16  # of room, from which on configurations are tried without


def packed_pieces(docs: DataFrame, path: str = "", kind: str = "byte", end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): documents' ids and the end id, cut where over capacity.

    A longer document has a first piece of what is over whole multiples, then full pieces."""
    end = np.array([end_id], "<u4").tobytes()

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        enc = encoder(path, kind)
        out: list[tuple] = []
        for d, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
            ids = enc.ids(t) + end
            n = len(ids) // 4
            cuts = [0, n] if n <= capacity else [0, *range(n % capacity or capacity, n + 1, capacity)]
            out += [(d, k, x, y - x, crc(ids[4 * x : 4 * y])) for k, (x, y) in enumerate(zip(cuts, cuts[1:]))]
        cols = list(zip(*out)) or [[]] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return each_batch(texts(docs), run, PIECE)


def configurations(sizes: list[int], demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, float]]:
    """Fractional multiplicities of configurations that meet the demand of each size: column generation.

    sizes are descending.  Every step's basis is feasible, so the bound on steps costs quality at most."""
    k, order = len(sizes), np.array(sizes)
    basis = np.diag([float(capacity // s) for s in sizes])
    x = demand / np.diag(basis)
    room = np.arange(capacity + 1)[None, :] - order[:, None]  # what a size leaves of each room
    fits, room = room >= 0, np.maximum(room, 0)
    for _ in range(24 * k):
        price = np.linalg.solve(basis.T, np.ones(k))
        # best value of each room with one item more at each level, and which item that is
        best, picks = np.zeros(capacity + 1), []
        for _ in range(capacity // sizes[-1]):
            gain = np.where(fits, price[:, None] + best[room], 0)
            pick = gain.argmax(0)
            top = gain[pick, np.arange(capacity + 1)]
            picks.append(np.where(top > best + 1e-12, pick, -1))
            best = np.maximum(best, top)
        if best[capacity] <= 1 + 1e-6:
            break
        column, c = np.zeros(k), capacity
        for pick in picks[::-1]:
            if pick[c] >= 0:
                column[pick[c]] += 1
                c -= sizes[pick[c]]
        step = np.linalg.solve(basis, column)
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(step > 1e-9, x / step, np.inf)
        out = int(ratio.argmin())
        x = np.maximum(x - ratio[out] * step, 0)
        x[out] = ratio[out]
        basis[:, out] = column
    return [(basis[:, i].astype(int), float(x[i])) for i in range(k)]


def rounded_sizes(left: np.ndarray, lengths: list[int], groups: int) -> tuple[list[int], np.ndarray]:
    """Sizes, descending, that groups of equally many pieces are rounded up to, and the pieces of each."""
    each = -(-int(left[lengths].sum()) // groups)
    sizes: dict[int, int] = {}
    size = need = 0
    for n in lengths:
        c = int(left[n])
        while c:
            if not need:
                size, need = n, each
            take = min(c, need)
            sizes[size] = sizes.get(size, 0) + take
            c -= take
            need -= take
    return list(sizes), np.array(list(sizes.values()), float)


def _substituted(left: np.ndarray, places: list[int], times: int, capacity: int, least: int) -> list[list]:
    """Sequences of one configuration with actual lengths for its sizes, as [how many, room, items].

    A place takes the longest length that its size holds, the last place the longest that the room left
    holds: rounding leaves no room that a piece could use.  What is placed is taken from left."""
    done: list[list] = []
    todo: list[list] = [[times, capacity, []]]
    while todo:
        many, room, items = todo.pop()
        k = len(items)
        if k == len(places):
            done.append([many, room, items])
            continue
        limit = min(room, places[k] if k + 1 < len(places) else room)
        there = np.flatnonzero(left[least : limit + 1])
        if not len(there):  # the pieces have run out
            if items:
                done.append([many, room, items])
            continue
        n = least + int(there[-1])
        take = min(many, int(left[n]))
        left[n] -= take
        if take < many:
            todo.append([many - take, room, items])
        todo.append([take, room - n, [*items, (n, 1)]])
    return done


def _best_fit(left: np.ndarray, by_room: list[list], capacity: int) -> list[list]:
    """All sequences, once what is left is put, longest first, where the room is least; by_room is used up."""
    for n in range(capacity - 1, 0, -1):
        c = int(left[n])
        room = n
        while c and room <= capacity:
            if not by_room[room]:
                room += 1
                continue
            many, _, items = by_room[room].pop()
            copies = max(1, min(room // n, c // many))
            take = min(many, c // copies)
            if take < many:
                by_room[room].append([many - take, room, items])
            by_room[room - n * copies].append([take, room - n * copies, [*items, (n, copies)]])
            c -= take * copies
            room = n
        per = capacity // n
        if c >= per:
            by_room[capacity - n * per].append([c // per, capacity - n * per, [(n, per)]])
        if c % per:
            by_room[capacity - n * (c % per)].append([1, capacity - n * (c % per), [(n, c % per)]])
    return [b for row in by_room for b in row]


def plan_sequences(counts: np.ndarray, capacity: int = CAPACITY, groups: int = GROUPS) -> list[tuple[int, list[tuple[int, int]]]]:
    """Classes of equal sequences: (how many, [(length, copies), ...]) for counts[length] pieces.

    The classes are bounded by lengths, groups and configurations, not by the pieces.  Configurations that their
    lengths fill worst are dissolved as long as that saves sequences, at the end all of them: never more than best fit."""
    left = np.array(counts, np.int64).copy()
    full: list[tuple[int, list]] = []
    if left[capacity]:
        full.append((int(left[capacity]), [(capacity, 1)]))
        left[capacity] = 0
    filled: list[list] = []  # [how many, room, items]
    least = capacity // LARGE + 1
    lengths = [n for n in range(capacity - 1, least - 1, -1) if left[n]]
    if lengths:
        sizes, demand = rounded_sizes(left, lengths, groups)
        chosen = []
        for config, times in configurations(sizes, demand, capacity):
            places = [sizes[j] for j in np.flatnonzero(config) for _ in range(int(config[j]))]
            if times >= 1 - 1e-6:
                chosen.append((places, int(times + 1e-6)))
        for places, times in sorted(chosen, reverse=True):  # long places first: they have fewest lengths to choose from
            filled += _substituted(left, places, times, capacity, least)
    rooms = sorted({room for _, room, _ in filled}, reverse=True)
    best: list[list] | None = None
    for most in [capacity, *(rooms[i] for i in np.unique(np.linspace(0, len(rooms) - 1, STEPS).astype(int)) if rooms), -1]:
        loose, by_room = left.copy(), [[] for _ in range(capacity + 1)]
        for many, room, items in filled:
            if room <= most:
                by_room[room].append([many, room, items])
            else:
                for n, copies in items:
                    loose[n] += many * copies
        plan = _best_fit(loose, by_room, capacity)
        if best is None or sum(b[0] for b in plan) < sum(b[0] for b in best):
            best = plan
    return full + [(many, items) for many, _, items in best or []]


def places(classes: list[tuple[int, list[tuple[int, int]]]]) -> dict[str, np.ndarray]:
    """Per run of ranks of a length: length << RANK_BITS | first rank, first sequence, offset; sorted."""
    rank: dict[int, int] = {}
    rows, sequence = [], 0
    for many, items in classes:
        offset = 0
        for n, copies in items:
            for _ in range(copies):
                r = rank.get(n, 0)
                rows.append(((n << RANK_BITS) | r, sequence, offset))
                rank[n] = r + many
                offset += n
        sequence += many
    table = np.array(sorted(rows), np.int64).reshape(-1, 3)
    return {"key": table[:, 0], "sequence": table[:, 1], "offset": table[:, 2]}


def pack_documents(docs: DataFrame, path: str, kind: str = "byte", end_id: int = 0, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset), one row for each piece.

    Only the id and the text of docs are read: other columns, whatever their names, change nothing."""
    return pack_pieces(packed_pieces(texts(docs, id_col, text_col), path, kind, end_id, capacity), capacity, parts_for(docs, 12 << 20))


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, chunks: int = 12) -> DataFrame:
    """Pieces (doc_id, piece, start, length, ids_crc32) with their sequence_id and offset."""
    dealt = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(chunks)).cast("int")
    pieces = written(pieces.select("doc_id", "piece", "start", "length", "ids_crc32").withColumn("chunk", dealt), "pieces")
    cells = pieces.groupBy("length", "chunk").agg(F.count("*").alias("n"))
    counts = np.zeros(capacity + 1, np.int64)
    for r in cells.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most `capacity` rows
        counts[r["length"]] = r["n"]
    plan = pieces.sparkSession.sparkContext.broadcast(places(plan_sequences(counts, capacity)))
    before = cells.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("chunk")) - F.col("n")).drop("n")
    # a piece's rank in its length: its rank in its chunk, after the chunks before
    local = F.row_number().over(Window.partitionBy("length", "chunk").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = pieces.withColumn("local", local).join(before, ["length", "chunk"]).withColumn("rank", F.col("local") + F.col("before"))

    def place(b: pa.RecordBatch) -> pa.RecordBatch:
        p = plan.value
        key = (b.column("length").to_numpy() << RANK_BITS) | b.column("rank").to_numpy()
        at = np.searchsorted(p["key"], key, "right") - 1
        return pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(p["sequence"][at] + key - p["key"][at]), pa.array(p["offset"][at])], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return each_batch(ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank"), place, f"{PIECE}, sequence_id long, offset long")
