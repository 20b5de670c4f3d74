"""Benchmark decontamination with suffix arrays of the training text.

Every Arrow batch of documents is a shard.  Its words become ids of the benchmark's vocabulary,
and the suffixes that could start a window (their words follow each other in the benchmark too)
are sorted by their first WINDOW words.  Each test suffix is then binary-searched in the shard: the
range of its matches gives all places where a window occurs, its neighbours the longest match.

A window is 13 consecutive words of an item; a shorter item is one window, one without words none.
The benchmark is dealt to blocks of about BLOCK_BYTES of text, each turned into arrays and broadcast by
itself; the driver holds one block at a time.  A pass over the documents searches up to BLOCKS blocks; a
larger benchmark takes more passes, whose hits are joined per document.

Nulls: a null document text or item text has no words; items with a null item_id take no part; a
null doc_id stays.  Very long texts are a shard of their own.  Repeated rows each give a row.  Empty tables give no rows, or rows without hits.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barflow.llm.common import each_batch, shared_folder

WINDOW = 13
BLOCK_BYTES = 8 << 20
BLOCKS = 4  # in a pass over the documents
SHARD_WORDS = 1 << 20
#: A-Z become a-z; what is neither digit, letter nor beyond ASCII separates words.
WORD_BYTES = bytes(c if c in b"0123456789abcdefghijklmnopqrstuvwxyz" or c >= 0x80 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(WORD_BYTES).split()


class TestSet:
    """Words, windows and word pairs of one block of benchmark items."""

    __test__ = False

    def __init__(self, items: list[tuple[int, str]], window: int = WINDOW):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        number = self.vocabulary.setdefault
        texts_ = [np.array([number(w, len(self.vocabulary) + 1) for w in words_of(text)], np.int64) for _, text in items]
        self.size = len(self.vocabulary) + 1
        self.pairs = np.unique(np.concatenate([np.zeros(0, np.int64), *(t[:-1] * self.size + t[1:] for t in texts_)]))
        rows, owner = [np.zeros((0, window), ">u4")], [np.zeros(0, np.int64)]
        for k, t in enumerate(texts_):
            if len(t):
                padded = np.concatenate((t, np.zeros(max(0, window - len(t)), np.int64)))
                rows.append(np.lib.stride_tricks.sliding_window_view(padded, window).astype(">u4"))
                owner.append(np.full(len(rows[-1]), k))
        every, of = as_keys(np.concatenate(rows).astype(">u4")), np.concatenate(owner)  # concatenate takes the native order
        self.low, inverse = np.unique(every, return_inverse=True)
        found = np.frombuffer(self.low.tobytes(), ">u4").reshape(-1, window)
        self.lengths = (found > 0).sum(1).astype(np.int64)
        self.high = as_keys(np.where(found > 0, found, 0xFFFFFFFF).astype(">u4"))
        self.least = int(self.lengths.min()) if len(self.low) else 0
        # the items of each window, in a row: window w has items[first[w] : first[w + 1]]
        both = np.unique(np.stack([inverse, of], 1), axis=0)
        self.first = np.searchsorted(both[:, 0], np.arange(len(self.low) + 1))
        self.items = np.array([i for i, _ in items])[both[:, 1]] if len(both) else np.zeros(0, np.int64)


def as_keys(rows: np.ndarray) -> np.ndarray:
    """Rows of big-endian words as byte strings, which sort as the rows do."""
    return np.ascontiguousarray(rows).view(f"S{4 * rows.shape[1]}")[:, 0] if len(rows) else np.zeros(0, f"S{4 * rows.shape[1]}")


class Shard:
    """The suffix array of a run of documents: self.at holds word positions in suffix order."""

    def __init__(self, ids: np.ndarray, test: TestSet):
        n = len(ids)
        follows = np.zeros(n, bool)
        if n > 1 and len(test.pairs):
            code = ids[:-1] * test.size + ids[1:]
            both = np.flatnonzero((ids[:-1] > 0) & (ids[1:] > 0))
            spot = np.minimum(np.searchsorted(test.pairs, code[both]), len(test.pairs) - 1)
            follows[both[test.pairs[spot] == code[both]]] = True
        stops = np.flatnonzero(~follows)
        run = stops[np.searchsorted(stops, np.arange(n))] - np.arange(n) + 1 if n else np.zeros(0, np.int64)
        starts = np.flatnonzero((ids > 0) & (run >= test.least))
        depth = np.arange(test.window)
        place = starts[:, None] + depth
        rows = np.where(depth < run[starts][:, None], ids[np.minimum(place, n - 1)] if n else 0, 0).astype(">u4")
        keys = as_keys(rows)
        order = np.argsort(keys, kind="stable")
        self.keys, self.at = keys[order], starts[order]

    def ranges(self, test: TestSet) -> tuple[np.ndarray, np.ndarray]:
        return np.searchsorted(self.keys, test.low, "left"), np.searchsorted(self.keys, test.high, "right")


def _shards(b: pa.RecordBatch, test: TestSet):
    """Runs of documents of about SHARD_WORDS words: (first row, ids with zeros between documents, starts, sizes)."""
    get, zero = test.vocabulary.get, itertools.repeat(0)
    ids: list[int] = []
    starts, sizes, first = [], [], 0
    for row, t in enumerate(b.column("text").to_pylist()):
        w = words_of(t)
        starts.append(len(ids))
        sizes.append(len(w))
        ids.extend(map(get, w, zero))
        ids.append(0)
        if len(ids) >= SHARD_WORDS:
            yield first, np.array(ids, np.int64), np.array(starts), np.array(sizes)
            ids, starts, sizes, first = [], [], [], row + 1
    if starts:
        yield first, np.array(ids, np.int64), np.array(starts), np.array(sizes)


def _expand(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All positions of the ranges, and the range that each is of."""
    n = hi - lo
    which = np.repeat(np.arange(len(n)), n)
    return np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n), which


def _blocks(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[list[tuple[int, str]]]:
    """The benchmark's items, a block of bounded size after the other."""
    items = benchmark.where(F.col(item_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(item_col).alias("item"), F.col(text_col).alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-int(size) // BLOCK_BYTES)
    if n < 2:
        yield [tuple(r) for r in items.collect()]
        return
    spark, path = items.sparkSession, shared_folder(items.sparkSession, "benchmark")
    items.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(n))).write.partitionBy("block").parquet(path)
    for k in range(n):  # a block's folder is all that is read
        yield [tuple(r) for r in spark.read.schema("item long, text string, block long").parquet(path).where(F.col("block") == k).select("item", "text").collect()]


def _passes(docs: DataFrame, benchmark: DataFrame, window: int, item_col: str, text_col: str, keep_items: bool = False) -> Iterator[list]:
    """Broadcast blocks of the benchmark, at most BLOCKS together."""
    held = []
    for items in _blocks(benchmark, item_col, text_col):
        test = TestSet(items, window)
        held.append(docs.sparkSession.sparkContext.broadcast((test, items) if keep_items else test))
        if len(held) == BLOCKS:
            yield held
            held = []
    if held:
        yield held


def find_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, key, n_words, hits array<int>, items array<long>) per document: word positions hit and the items whose windows occur."""
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("key"), F.col(text_col).alias("text"))
    shape = "doc_id long, key long, n_words long, hits array<int>, items array<long>"

    def search(b: pa.RecordBatch, tests: list) -> pa.Table:
        n = b.num_rows
        sizes = np.zeros(n, np.int64)
        hits: list[set] = [set() for _ in range(n)]
        items: list[set] = [set() for _ in range(n)]
        for shared in tests:
            test = shared.value
            for row, ids, starts, counts in _shards(b, test):
                sizes[row : row + len(starts)] = counts
                if not len(test.low):
                    continue
                shard = Shard(ids, test)
                place, which = _expand(*shard.ranges(test))
                at = shard.at[place]
                edge = np.zeros(len(ids) + 1, np.int64)
                np.add.at(edge, at, 1)
                np.add.at(edge, at + test.lengths[which], -1)
                hit = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
                doc = np.searchsorted(starts, hit, "right") - 1
                cut = np.searchsorted(doc, np.arange(len(starts) + 1))
                for d in np.unique(doc).tolist():
                    hits[row + d].update((hit[cut[d] : cut[d + 1]] - starts[d]).tolist())
                doc = np.searchsorted(starts, at, "right") - 1
                for d, w in np.unique(np.stack([doc, which], 1), axis=0).tolist():
                    items[row + d].update(test.items[test.first[w] : test.first[w + 1]].tolist())
        return pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("key"), pa.array(sizes, pa.int64()), pa.array([sorted(x) for x in hits], pa.list_(pa.int32())), pa.array([sorted(x) for x in items], pa.list_(pa.int64()))], ["doc_id", "key", "n_words", "hits", "items"])

    found = [each_batch(base, lambda b, tests=tests: search(b, tests), shape) for tests in _passes(docs, benchmark, window, item_col, item_text_col)]
    if len(found) == 1:
        return found[0]
    every = found[0]
    for f in found[1:]:
        every = every.union(f)
    merged = every.groupBy("doc_id", "key", "n_words").agg(F.array_distinct(F.flatten(F.collect_list("hits"))).alias("hits"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"), F.count("*").alias("n"))
    copies = F.explode(F.sequence(F.lit(1), (F.col("n") / len(found)).cast("int")))
    return merged.select("doc_id", "key", "n_words", "hits", "items", copies.alias("copy")).drop("copy")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, **columns: str) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated): contaminated from a twentieth of the words."""
    found = find_hits(docs, benchmark, window, **columns)
    n_hit = F.size("hits").cast("long")
    names = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, all columns, without the contaminated documents."""
    key = [F.col(id_col).cast("long").alias("d"), F.xxhash64(text_col).alias("k")]
    found = find_hits(docs, benchmark, window, id_col, text_col)
    n_hit = F.size("hits")
    bad = found.where((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).select(F.col("doc_id").alias("d"), F.col("key").alias("k")).distinct()
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), *key)
    kept = rows.join(bad, rows.d.eqNullSafe(bad.d) & (rows.k == bad.k), "left_anti")
    return kept.select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns))


def longest_matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(item_id, item_word, n_words, doc_id, doc_word): the longest verbatim match, however long, of the suffix that
    starts at each item word, and its first place by doc_id; suffixes without a match give no row.

    All places that share a whole window with the suffix are followed word by word until they differ; a suffix
    that shares no window has its longest match at a neighbour in suffix order."""
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    shape = "item_id long, item_word int, n_words int, doc_id long, doc_word int"

    def search(b: pa.RecordBatch, tests: list) -> pa.Table:
        out = []
        for shared in tests:
            test, its = shared.value
            test.least = 1
            texts_ = [np.array([test.vocabulary[w] for w in words_of(t)], np.int64) for _, t in its]
            flat = np.concatenate([np.zeros(0, np.int64), *(np.append(t, -1) for t in texts_), np.full(window, -1)])
            owner = np.concatenate([np.zeros(0, np.int64), *(np.full(len(t) + 1, k) for k, t in enumerate(texts_))])
            suffix = np.flatnonzero(flat[: len(owner)] > 0)
            if not len(suffix):
                continue
            begin = np.cumsum([0, *(len(t) + 1 for t in texts_)])
            lines = flat[suffix[:, None] + np.arange(window)]
            rows = np.where(np.cumprod(lines > 0, axis=1) > 0, lines, 0).astype(">u4")
            keys = as_keys(rows)
            for row, ids, starts, _ in _shards(b, test):
                shard = Shard(ids, test)
                if not len(shard.at):
                    continue
                of = np.frombuffer(shard.keys.tobytes(), ">u4").reshape(-1, window)
                lo, hi = np.searchsorted(shard.keys, keys, "left"), np.searchsorted(shard.keys, keys, "right")
                whole, which = _expand(lo, np.where(rows[:, -1] > 0, hi, lo))
                near = np.concatenate([np.clip(lo + s, 0, len(of) - 1) for s in (-1, 0)])  # neighbours share most with it
                who = np.concatenate((which, *[np.arange(len(suffix))] * 2))
                spot = np.concatenate((whole, near))
                place = shard.at[spot]
                size = np.cumprod((of[spot] == rows[who]) & (rows[who] > 0), axis=1).sum(1)
                live = np.flatnonzero(size == window)
                text = np.append(ids, 0)
                while len(live):  # beyond the window, word by word
                    one, two = suffix[who[live]] + size[live], place[live] + size[live]
                    live = live[(two < len(ids)) & (flat[np.minimum(one, len(flat) - 1)] == text[np.minimum(two, len(ids))]) & (flat[np.minimum(one, len(flat) - 1)] > 0)]
                    size[live] += 1
                doc = np.searchsorted(starts, place, "right") - 1
                ids_of = b.column("doc_id").slice(row, len(starts)).to_numpy(zero_copy_only=False)[doc].astype(float)
                order = np.lexsort((place, np.nan_to_num(ids_of, nan=np.inf), -size, who))
                best = order[np.flatnonzero(np.append(True, who[order][1:] != who[order][:-1]))]
                best = best[size[best] > 0]
                item = owner[suffix[who[best]]]
                out.append(pa.RecordBatch.from_arrays([pa.array([its[k][0] for k in item.tolist()], pa.int64()), pa.array(suffix[who[best]] - begin[item], pa.int32()), pa.array(size[best], pa.int32()), b.column("doc_id").slice(row, len(starts)).take(pa.array(doc[best])), pa.array(place[best] - starts[doc[best]], pa.int32())], ["item_id", "item_word", "n_words", "doc_id", "doc_word"]))
        return pa.Table.from_batches(out) if out else None

    every = [each_batch(base, lambda b, tests=tests: search(b, tests), shape) for tests in _passes(docs, benchmark, window, item_col, item_text_col, keep_items=True)]
    union = every[0]
    for e in every[1:]:
        union = union.union(e)
    best = F.max_by(F.struct("n_words", "doc_id", "doc_word"), F.struct("n_words", -F.col("doc_id"), -F.col("doc_word"))).alias("m")
    return union.groupBy("item_id", "item_word").agg(best).select("item_id", "item_word", "m.n_words", "m.doc_id", "m.doc_word")
