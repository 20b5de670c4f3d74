"""SimHash near-duplicates by anchor-point covering.

A fingerprint's 64 bits are cut into blocks so that fingerprints within the threshold differ in at
most one bit of some block.  The anchors of a block are the words of a perfect Hamming code on it,
whose covering radius is 1: each fingerprint goes to every anchor within radius plus one, its own
nearest anchor being its home, so two such fingerprints meet at the home of either.  Each anchor's
members are compared there, and a spanning forest of their links is passed on, never all pairs: small
groups are compared place by place, a large one member by member with those that are not reached yet, so
a dense group costs little more than its size and no pair is kept.  Equal fingerprints are one node
throughout.

Nulls: a null text is empty; a text without words has fingerprint zero and links like any other; a
null doc_id never becomes a component's id.  Very long texts are read whole.  Repeated rows stay.  An
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barflow.llm.common import each_batch, texts, written
from barflow.llm.components import components, forest

SEED = 42
CHUNK = 1 << 17  # hashes whose bits are counted at once
SLICE = 8192  # an anchor's members beyond so many are compared slice against slice
PLACES = 64  # groups up to this size are compared all at once


def shingle_hashes(text: str, words: int) -> list[int]:
    parts = text.encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return []
    joined = b" ".join(parts)
    if len(parts) <= words:
        return [xxhash.xxh64_intdigest(joined, SEED)]
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = [0, *(ends[: len(parts) - words] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], SEED) for a, b in zip(starts, ends[words - 1 :].tolist())]


def majority(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Of each run of hashes the 64 bits that over half of them have."""
    out = np.zeros(len(sizes), np.uint64)
    ends = np.cumsum(sizes)
    counts = np.zeros((len(sizes), 64), np.int64)
    for at in range(0, len(hashes), CHUNK):
        part = hashes[at : at + CHUNK]
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").view(np.uint64)
        # eight one-byte counters a word: they hold 255 rows
        cut = np.unique(np.concatenate((np.arange(0, len(part), 255), (ends - sizes)[(ends - sizes >= at) & (ends - sizes < at + len(part))] - at)))
        sums = np.add.reduceat(bits, cut, axis=0).view(np.uint8).reshape(-1, 64)
        np.add.at(counts, np.searchsorted(ends, cut + at, "right"), sums)
    over = 2 * counts > sizes[:, None]
    out[:] = np.packbits(over, axis=1, bitorder="little").view(np.uint64)[:, 0] if len(sizes) else 0
    return out


def fingerprints(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id long, fp long): each whole text's fingerprint, as a signed 64-bit number."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        prints, hashes, sizes = [], [], []

        def flush():
            size = np.array(sizes, np.int64)
            some = size > 0
            fp = np.zeros(len(size), np.uint64)
            fp[some] = majority(np.array(hashes, np.uint64), size[some])
            prints.append(fp)

        for t in b.column("text").to_pylist():
            h = shingle_hashes(t, words)
            hashes += h
            sizes.append(len(h))
            if len(hashes) >= CHUNK:
                flush()
                hashes, sizes = [], []
        flush()
        return pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.concatenate(prints).view(np.int64))], ["doc_id", "fp"])

    return each_batch(texts(docs, id_col, text_col), run, "doc_id long, fp long")


def blocks(threshold: int) -> list[tuple[int, int]]:
    """(first bit, bits) of each block's code: blocks enough that one holds at most one difference."""
    n = threshold // 2 + 1
    width = 64 // n
    length = (1 << (width + 1).bit_length() - 1) - 1
    return [(k * width, length) for k in range(n)]


def syndromes(x: np.ndarray, length: int) -> np.ndarray:
    """The exclusive or of the (one-based) positions of the set bits."""
    out = np.zeros(len(x), np.uint64)
    for k in range((length + 1).bit_length() - 1):
        mask = np.uint64(sum(1 << (p - 1) for p in range(1, length + 1) if p >> k & 1))
        out |= (np.bitwise_count(x & mask) & np.uint64(1)).astype(np.uint64) << np.uint64(k)
    return out


def anchors(fp: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor key, index of the fingerprint, is its home) of all anchors within radius plus one."""
    keys, index, home = [], [], []
    for k, (first, length) in enumerate(blocks(threshold)):
        x = fp >> np.uint64(first) & np.uint64((1 << length) - 1)
        s = syndromes(x, length)
        flip = lambda p: np.where(p > 0, np.uint64(1) << np.maximum(p, np.uint64(1)) - np.uint64(1), np.uint64(0))
        near = x ^ flip(s)
        one = np.uint64(k) << np.uint64(63)  # at most two blocks keep the key in 64 bits; more mix it in below
        mixed = lambda word: (word * np.uint64(2 * k + 1)) ^ (np.uint64(k) << np.uint64(58)) if len(blocks(threshold)) > 2 else word | one
        keys.append(mixed(near))
        index.append(np.arange(len(fp)))
        home.append(np.ones(len(fp), bool))
        for i in range(1, length + 1):  # two flips i and j with i ^ j the syndrome
            j = s ^ np.uint64(i)
            ok = np.flatnonzero((s > 0) & (j > np.uint64(i)))
            keys.append(mixed(x[ok] ^ np.uint64(1 << (i - 1)) ^ flip(j[ok])))
            index.append(ok)
            home.append(np.zeros(len(ok), bool))
    return np.concatenate(keys), np.concatenate(index), np.concatenate(home)


def links(prints: DataFrame, threshold: int = 3) -> DataFrame:
    """(a long, b long): links between distinct fingerprints (column fp) that connect all of each component."""

    def replicate(b: pa.RecordBatch) -> pa.RecordBatch:
        fp = b.column("fp").to_numpy().view(np.uint64)
        key, i, home = anchors(fp, threshold)
        return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(home), pa.array(fp[i].view(np.int64))], ["key", "home", "fp"])

    dealt = each_batch(prints.select("fp"), replicate, "key long, home boolean, fp long")
    crowded = dealt.groupBy("key").count().where(F.col("count") > SLICE).select("key", F.ceil(F.col("count") / SLICE).cast("int").alias("n"))
    # members of a crowded anchor go to each pair of slices that has theirs, so no task gets them all
    n, own, other = F.coalesce("n", F.lit(1)), F.pmod(F.xxhash64("fp"), F.coalesce("n", F.lit(1))).cast("int"), F.col("other")
    cells = dealt.join(crowded, "key", "left").select("key", "home", "fp", n.alias("n"), own.alias("own"), F.explode(F.sequence(F.lit(0), n - 1)).alias("other"))
    cells = cells.select("key", "home", "fp", (F.least("own", other) * F.col("n") + F.greatest("own", other)).alias("cell"))
    ready = cells.repartition("key", "cell").sortWithinPartitions("key", "cell")

    def pairs(key: np.ndarray, home: np.ndarray, fp: np.ndarray):
        """Links of complete, sorted groups."""
        found_a, found_b = [], []
        cut = np.flatnonzero(key[1:] != key[:-1]) + 1
        sizes = np.diff(np.concatenate(([0], cut, [len(key)])))
        in_group = np.repeat(sizes, sizes)
        starts = np.concatenate(([0], cut))
        for s in np.flatnonzero(sizes > PLACES).tolist():
            x, y = reach(fp[starts[s] : starts[s] + sizes[s]], home[starts[s] : starts[s] + sizes[s]], threshold)
            found_a.append(x)
            found_b.append(y)
        some = (in_group > 1) & (in_group <= PLACES)
        key, home, fp, in_group = key[some], home[some], fp[some], in_group[some]
        for far in range(1, int(in_group.max()) if len(in_group) else 0):
            left = np.flatnonzero(in_group > far)
            left = left[left + far < len(key)]
            left = left[key[left] == key[left + far]]
            if not len(left):
                break
            right = left + far
            hit = (home[left] | home[right]) & (np.bitwise_count(fp[left] ^ fp[right]) <= threshold)
            found_a.append(fp[left[hit]])
            found_b.append(fp[right[hit]])
        if not found_a:
            return None
        a, b = forest(np.concatenate(found_a).view(np.int64), np.concatenate(found_b).view(np.int64))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"]) if len(a) else None

    def compare(batches: Iterator[pa.RecordBatch]):
        kept: tuple[np.ndarray, ...] | None = None
        for b in batches:
            if not b.num_rows:
                continue
            # one number for (key, cell); a chance collision only adds comparisons
            key = b.column("key").to_numpy() * np.int64(1_000_003) + b.column("cell").to_numpy()
            part = (key, b.column("home").to_numpy(zero_copy_only=False), b.column("fp").to_numpy().view(np.uint64))
            if kept is not None:
                part = tuple(np.concatenate(x) for x in zip(kept, part))
            last = int(np.flatnonzero(part[0] != part[0][-1])[-1]) + 1 if (part[0] != part[0][-1]).any() else 0
            kept = tuple(x[last:] for x in part)
            if last and (out := pairs(*(x[:last] for x in part))) is not None:
                yield out
        if kept is not None and (out := pairs(*kept)) is not None:
            yield out

    return ready.mapInArrow(compare, "a long, b long")


def reach(fp: np.ndarray, home: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what is connected in one group, one less than the members of each component.

    A pair counts if one of both is at home here.  Members that are reached are not looked at again."""
    open_, open_home, a, b = fp, home, [], []
    while len(open_):
        queue = [(open_[-1], open_home[-1])]
        open_, open_home = open_[:-1], open_home[:-1]
        while queue and len(open_):
            of, at_home = queue.pop()
            hit = np.bitwise_count(open_ ^ of) <= threshold
            if not at_home:
                hit &= open_home
            if hit.any():
                a.append(np.full(int(hit.sum()), of))
                b.append(open_[hit])
                queue += zip(open_[hit], open_home[hit])
                open_, open_home = open_[~hit], open_home[~hit]
    none = np.zeros(0, np.uint64)
    return np.concatenate([*a, none]), np.concatenate([*b, none])


def near_duplicates(docs: DataFrame, words: int = 3, threshold: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id): component_id is the least doc_id that links reach."""
    prints = written(fingerprints(docs, words, id_col, text_col), "prints")
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    found = components(links(nodes, threshold))
    rooted = nodes.join(found, nodes.fp == found.node, "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = rooted.join(ids, "root").select("fp", "component_id")
    return prints.join(classes, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
