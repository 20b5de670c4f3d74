"""Near-duplicates by SimHash fingerprints and, for links that these miss, by rare shingles that both texts have.

Texts are first linked as op6 does, by fingerprints that differ in few bits and meet at anchors; a link counts if the
exact similarity of the two texts is reached.  Fingerprints of appended or cut copies differ in more bits, so an exact way
follows for the rest.  Texts of similarity t or more share at least t of the shingles of either.  So a text of which fewer
are in other texts has no partner; of the rest, with shingles taken rarest first, both of a pair have
a common one among their first (1 - t) n + 1, and l common ones among l - 1 more.  No pair is lost.
There a text is first decided against the hub that most of its shingles lead to, then against the one of each other
group that it shares most with; at last every candidate pair that is not yet in one group is decided, all by
the exact similarity.  A pair is a candidate only if its sketches, a parity bit for each class of shingles, differ in no more
bits than similar texts have shingles apart, so texts of a family that are less alike mostly never become pairs.

Texts that are equal but for white space and A-Z are one node.  Very long texts are read whole.  Nulls: a null text is empty; texts
without words are one node; a null doc_id loses to any other in its group.  An empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barflow.llm.common import each_batch, parts_for, runs, stored_bytes, texts, written
from barflow.llm.components import components
from barflow.llm.simhash import SEED, fingerprints, links, shingle_hashes

BUCKET_BITS, BUCKET_BYTES = 10, 64 << 20  # of a shingle's hash, by which the first count is dealt: at least, and stored bytes of a bucket
HELD = 1 << 21  # hashes held at once there
PART_BYTES, LEAST_PARTS = 32 << 20, 64  # of the texts whose sums are added together
CHUNK = 256  # members of a shingle that are listed together
BITS = 1024  # of a text's sketch
MEMBER = np.dtype([("label", "<i8"), ("node", "<i8"), ("n", "<i4"), ("l", "<i4"), ("p", "<i4"), ("many", "<i4"), ("sketch", "<u8", BITS // 64)])  # many: in a group already
PACKED = ((0, "<i8"), (1, "<i4"), (2, "<i8"))  # others, needed, labels as they are sent
LOW = np.uint64(0xFFFFFFFF)


def _node(text: str) -> int:
    return xxhash.xxh64_intdigest(b" ".join(text.encode("utf-8", "surrogatepass").lower().split()), SEED)


def _shingles(text: str, words: int) -> np.ndarray:
    return np.unique(np.array(shingle_hashes(text, words), np.uint64))


def named_sizes(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, key, node, n): of frame (doc_id, key, text) each text's name and number of distinct shingles."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        rows = b.column("text").to_pylist()
        node = np.array([_node(t) for t in rows], np.uint64).view(np.int64)
        n = np.array([len(set(shingle_hashes(t, words))) for t in rows], np.int32)
        return pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("key"), pa.array(node), pa.array(n)], ["doc_id", "key", "node", "n"])

    return each_batch(docs, run, "doc_id long, key long, node long, n int")


def shared_counts(docs: DataFrame, words: int) -> DataFrame:
    """(low, c): by the low 32 bits of a text's name, at most how many of its shingles are in another row.

    Hashes are cut to BUCKET_BITS and 32 bits, more for larger inputs: ones that fall together only count more.  A task sums what its buckets say of a
    text and sends sums packed, a row for each part of the texts."""
    parts = parts_for(docs, PART_BYTES, LEAST_PARTS)
    bits = min(30, max(BUCKET_BITS, (stored_bytes(docs) // BUCKET_BYTES).bit_length()))

    def deal(batches: Iterator[pa.RecordBatch]):
        held: list[tuple] = []

        def flush():
            h, who = np.concatenate([x for x, _ in held]), np.repeat(np.array([w for _, w in held], np.uint64), [len(x) for x, _ in held])
            bucket = (h >> np.uint64(64 - bits)).astype(np.int32)
            data = (h >> np.uint64(32 - bits) << np.uint64(32)) | who
            order = np.argsort(bucket, kind="stable")
            bucket, data = bucket[order], data[order]
            cut = runs(bucket)
            return pa.RecordBatch.from_arrays([pa.array(bucket[cut[:-1]]), pa.array([data[i:j].tobytes() for i, j in zip(cut[:-1], cut[1:])], pa.binary())], ["bucket", "data"])

        size = 0
        for b in batches:
            for t in b.column("text").to_pylist():
                h = _shingles(t, words)
                held.append((h, _node(t) & 0xFFFFFFFF))
                size += len(h)
                if size >= HELD:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    def count(batches: Iterator[pa.RecordBatch]):
        now, held, found, size = None, [], [], 0

        def shared() -> np.ndarray:
            data = np.sort(np.frombuffer(b"".join(held), np.uint64))
            cut = runs(data >> np.uint64(32))
            return (data & LOW)[np.repeat(np.diff(cut) > 1, np.diff(cut))]

        def summed():
            low, c = np.unique(np.concatenate(found), return_counts=True)
            part = (low % np.uint64(parts)).astype(np.int32)
            order = np.argsort(part, kind="stable")
            part, data = part[order], (low << np.uint64(32) | c.astype(np.uint64))[order]
            cut = runs(part)
            return pa.RecordBatch.from_arrays([pa.array(part[cut[:-1]]), pa.array([data[i:j].tobytes() for i, j in zip(cut[:-1], cut[1:])], pa.binary())], ["part", "data"])

        for b in batches:
            for bucket, data in zip(b.column("bucket").to_pylist(), b.column("data").to_pylist()):
                if bucket != now and held:
                    found.append(shared())
                    size += len(found[-1])
                    held = []
                    if size >= HELD:
                        yield summed()
                        found, size = [], 0
                now = bucket
                held.append(data)
        if held:
            found.append(shared())
        if found:
            yield summed()

    dealt = docs.select("text").mapInArrow(deal, "bucket int, data binary").repartition("bucket").sortWithinPartitions("bucket")
    sums = dealt.mapInArrow(count, "part int, data binary").repartition("part").sortWithinPartitions("part")
    return sums.mapInArrow(_merged, "low long, c long")


def _merged(batches: Iterator[pa.RecordBatch]):
    """(low, c): the sums of all tasks, part by part."""
    now, held = None, []

    def flush():
        data = np.frombuffer(b"".join(held), np.uint64)
        low, inverse = np.unique(data >> np.uint64(32), return_inverse=True)
        c = np.bincount(inverse, (data & LOW).astype(float)).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(low.astype(np.int64)), pa.array(c)], ["low", "c"])

    for b in batches:
        for part, data in zip(b.column("part").to_pylist(), b.column("data").to_pylist()):
            if part != now and held:
                yield flush()
                held = []
            now = part
            held.append(data)
    if held:
        yield flush()


def _needed(least: float):
    """Shingles of a text of n that one of similarity `least` or more has, whatever its size."""
    return F.ceil(F.col("n") * least - 1e-6).cast("int")


def rare_lists(named: DataFrame, words: int, least: float) -> DataFrame:
    """(h, node, n, l, p, core): each text's rarest shared shingles, of which it has l with any partner or all of the partner's l.

    p is a shingle's place from 0 among all of the text's, the ones that no other text has first."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        sets = [_shingles(t, words) for t in b.column("text").to_pylist()]
        size = np.array([len(x) for x in sets], np.int64)
        h = np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(h), pa.array(np.repeat(b.column("node").to_numpy(), size)), pa.array(np.repeat(size, size).astype(np.int32))], ["h", "node", "n"])

    every = each_batch(named.select("node", "text"), run, "h long, node long, n int")
    common = every.join(every.groupBy("h").agg(F.count("*").alias("df")).where("df > 1"), "h")
    by = Window.partitionBy("node")
    ranked = common.withColumns({"m": F.count("*").over(by), "at": F.row_number().over(by.orderBy("df", "h")), "core": F.sum("df").over(by) / F.col("n")})
    ranked = ranked.withColumn("l", F.least(F.floor(F.col("n") / 20) + 1, _needed(least)).cast("int"))
    # shingles that no other text has come first: n - m of them
    return ranked.where(F.col("at") <= F.col("m") - _needed(least) + F.col("l")).select("h", "node", "n", "l", (F.col("n") - F.col("m") + F.col("at") - 1).cast("int").alias("p"), "core")


def sketches(named: DataFrame, words: int) -> DataFrame:
    """(node, sketch): of each of BITS classes of hashes whether the text has an odd number of its shingles.

    Two sketches differ in no more bits than shingles are in one text only."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        of = [(_shingles(t, words) & np.uint64(BITS - 1)).astype(np.int64) for t in b.column("text").to_pylist()]
        odd = [np.packbits((np.bincount(h, minlength=BITS) & 1).astype(np.uint8)).tobytes() for h in of]
        return pa.RecordBatch.from_arrays([b.column("node"), pa.array(odd, pa.binary())], ["node", "sketch"])

    return each_batch(named.select("node", "text"), run, "node long, sketch binary")


def _sizes_fit(n, other, least: float):
    return F.least(n, other) >= F.greatest(n, other) * least - 1e-6


def print_pairs(named: DataFrame, words: int = 3, threshold: int = 3) -> DataFrame:
    """(a, b): texts with one SimHash fingerprint, and ones whose fingerprints the anchors link; a forest connects each component."""
    prints = written(fingerprints(named, words, "node"), "prints").withColumnRenamed("doc_id", "node")
    firsts = prints.groupBy("fp").agg(F.min("node").alias("first"))
    same = prints.join(firsts, "fp").where("node != first").select("first", "node")
    ends = [firsts.select(F.col("fp").alias(c), F.col("first").alias(f"of_{c}")) for c in "ab"]
    near = links(firsts, threshold).distinct().join(ends[0], "a").join(ends[1], "b").select("of_a", "of_b")
    both = same.union(near).toDF("x", "y")
    return both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def hub_pairs(lists: DataFrame, least: float) -> DataFrame:
    """(a, b): each text with the text of most common shingles that most of its lists lead to."""
    hubs = lists.groupBy("h").agg(F.max(F.struct("core", "node", "n")).alias("hub"))
    led = lists.join(hubs, "h").where((F.col("node") != F.col("hub.node")) & _sizes_fit(F.col("n"), F.col("hub.n"), least))
    votes = led.groupBy("node", F.col("hub.node").alias("other")).agg(F.count("*").alias("votes"))
    best = votes.groupBy("node").agg(F.max_by("other", F.struct("votes", "other")).alias("other"))
    return best.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()


def met(rows: pa.RecordBatch, least: float, best: bool = False) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(a, others, needed, labels) of frame (a, b; members as packed arrays): each member of a with the members of b that it may be similar to.

    A pair of two groups stays if its sizes fit, if what both have up to their common shingle and after it
    can reach the overlap of similar texts (position filter), and if its sketches differ in no more bits than similar
    texts have shingles apart.  needed: how many lists the pair must share.  best: only
    pairs with a text that is in a group already; the other one, if it is in none, comes as a."""
    for left, right, same in zip(rows.column("left").to_pylist(), rows.column("right").to_pylist(), rows.column("same").to_pylist()):
        x, y = (np.frombuffer(v, MEMBER) for v in (left, right))
        n, m = x["n"][:, None].astype(np.int64), y["n"][None, :].astype(np.int64)
        p, q = x["p"][:, None].astype(np.int64), y["p"][None, :].astype(np.int64)
        overlap = np.minimum(p, q) + 1 + np.minimum(n - p, m - q) - 1
        fit = (x["label"][:, None] != y["label"][None, :]) & (np.minimum(n, m) >= np.maximum(n, m) * least - 1e-6) & (overlap >= least / (1 + least) * (n + m) - 1e-6)
        if same:
            fit &= x["node"][:, None] < y["node"][None, :]
        i, j = np.nonzero(fit)
        fit[i, j] = np.bitwise_count(x["sketch"][i] ^ y["sketch"][j]).sum(1) <= (1 - least) / (1 + least) * (x["n"][i].astype(np.int64) + y["n"][j]) + 1e-6
        ways = [(x, y, fit)]
        if best:
            ways = [(x, y, fit & (y["many"] == 1)[None, :]), (y, x, (fit & (x["many"] == 1)[:, None] & (y["many"] == 0)[None, :]).T)]
        for own, other, pair in ways:
            for i in np.flatnonzero(pair.any(1)):
                of = other[pair[i]]
                yield int(own["node"][i]), of["node"], np.minimum(of["l"], own["l"][i]), of["label"]


def open_pairs(lists: DataFrame, labels: DataFrame, least: float, best: bool = False, sketched: DataFrame | None = None) -> DataFrame:
    """(a, b): all candidate pairs of two groups; labels are (node, root) of the texts that are in one, sketched their sketches.

    best: of a text's candidates in each other group of several texts only the one that it shares most lists with.

    Members of a shingle lie in chunks of about CHUNK: of one group where it has many members there, else mixed.
    Chunks meet in tasks, which send each text its partners packed, and a text's task counts them: a pair is a row only
    where it shares as many lists as similar texts do."""
    rows = lists.join(labels, "node", "left").select("h", F.coalesce("root", "node").alias("label"), "node", "n", "l", "p", F.col("root").isNotNull().cast("int").alias("many"))
    per = rows.groupBy("h", "label").agg(F.count("*").alias("c"))
    of_h = per.groupBy("h").agg(F.count("*").alias("labels"), F.sum(F.when(F.col("c") <= CHUNK, F.col("c")).otherwise(0)).alias("mixed")).where("labels > 1").select("h", "mixed")
    chunks = per.join(of_h, "h").select("h", "label", F.when(F.col("c") > CHUNK, F.col("label")).alias("own"), F.ceil(F.when(F.col("c") > CHUNK, F.col("c")).otherwise(F.col("mixed")) / CHUNK).alias("k"))
    kept = rows.join(sketched, "node") if sketched is not None else rows.withColumn("sketch", F.lit(bytes(BITS // 8)))
    dealt = kept.join(chunks, ["h", "label"]).withColumn("chunk", F.pmod(F.xxhash64("node", "h"), "k"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            of = b.column("of")
            flat, cut = of.flatten(), np.concatenate(([0], np.cumsum(pa.compute.list_value_length(of).to_numpy(zero_copy_only=False))))
            members = np.empty(len(flat), MEMBER)
            for i, name in enumerate(MEMBER.names[:-1]):
                members[name] = flat.field(i).to_numpy(zero_copy_only=False)
            members["sketch"] = np.frombuffer(b"".join(flat.field("sketch").to_pylist()), np.uint64).reshape(-1, BITS // 64)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("h", "own", "chunk")), pa.array([members[i:j].tobytes() for i, j in zip(cut[:-1], cut[1:])], pa.binary())], ["h", "own", "chunk", "of"])

    grouped = dealt.groupBy("h", "own", "chunk").agg(F.collect_list(F.struct(*MEMBER.names)).alias("of"))
    grouped = written(grouped.mapInArrow(packed, "h long, own long, chunk long, of binary"), "grouped")
    place = lambda own, chunk: F.struct(F.col(own).isNotNull(), F.coalesce(own, F.lit(0)), F.col(chunk))
    other = grouped.select("h", F.col("own").alias("own2"), F.col("chunk").alias("chunk2"), F.col("of").alias("right"))
    apart = F.coalesce(F.col("own") != F.col("own2"), F.lit(True))  # two chunks of one group have nothing to decide
    both = grouped.withColumnRenamed("of", "left").join(other, "h").where((place("own", "chunk") <= place("own2", "chunk2")) & (apart | F.col("own").isNull()))
    both = both.select("left", "right", (F.col("own").isNull() & F.col("own2").isNull() & (F.col("chunk") == F.col("chunk2"))).alias("same"))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: dict[int, list] = {}
            for node, *of in met(b, least, best):
                found.setdefault(node, []).append(of if best else of[:2])
            for some in (list(found.items())[i : i + 512] for i in range(0, len(found), 512)):
                columns = [[np.concatenate([v[k] for v in of]).astype(t).tobytes() for _, of in some] for k, t in PACKED[: 3 if best else 2]]
                columns += [] if best else [[None] * len(some)]
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in some], pa.int64()), *(pa.array(c, pa.binary()) for c in columns)], ["a", "others", "needed", "labels"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def flush():
            others, needed, *label = (np.concatenate([np.frombuffer(v[k], t) for v in held]) for k, t in PACKED[: 3 if best else 2])
            node, first, c = np.unique(others, return_index=True, return_counts=True)
            stays = c >= needed[first]
            node, first, c = node[stays], first[stays], c[stays]
            if best:
                order = np.lexsort((node, -c, label[0][first]))
                of = label[0][first][order]
                node = node[order[np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1]))[: len(of)])]]
            a, b = np.minimum(node, now), np.maximum(node, now)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for b in batches:
            for a, *of in zip(*(b.column(c).to_pylist() for c in ("a", "others", "needed", "labels"))):
                if a != now and held:
                    yield flush()
                    held = []
                now = a
                held.append(of)
        if held:
            yield flush()

    sent = both.mapInArrow(meet, "a long, others binary, needed binary, labels binary")
    pairs = sent.repartition("a").sortWithinPartitions("a").mapInArrow(count, "a long, b long")
    return pairs.distinct() if best else pairs


@lru_cache(256)  # pairs come by text: a text's set serves all of its pairs
def _shingle_set(text: str, words: int) -> frozenset[int]:
    return frozenset(shingle_hashes(text, words))


def similarity(a: str, b: str, words: int) -> float:
    """Jaccard similarity of the sets of word shingles."""
    x, y = _shingle_set(a, words), _shingle_set(b, words)
    return len(x & y) / len(x | y) if x or y else 1.0


def decided(pairs: DataFrame, named: DataFrame, words: int, least: float) -> DataFrame:
    """Of pairs (a, b) the ones whose texts have the similarity."""
    pair = pairs.join(named.select(F.col("node").alias("a"), F.col("text").alias("s")), "a").join(named.select(F.col("node").alias("b"), F.col("text").alias("t")), "b")

    def decide(b: pa.RecordBatch) -> pa.RecordBatch:
        hit = [similarity(s, t, words) >= least for s, t in zip(b.column("s").to_pylist(), b.column("t").to_pylist())]
        return b.select(["a", "b"]).filter(pa.array(hit, pa.bool_()))

    return each_batch(pair.select("a", "b", "s", "t").sortWithinPartitions("b"), decide, "a long, b long")


def representatives(docs: DataFrame, words: int = 5, least: float = 0.8) -> DataFrame:
    """(d, k): doc_id and key of the one row of each group of the frame (doc_id, key, text) that stays."""
    sizes = written(named_sizes(docs, words), "sizes")
    # a node's row is its least doc_id's; a null doc_id comes last
    nodes = sizes.groupBy("node").agg(F.first("n").alias("n"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("row"))
    alive = nodes.withColumn("low", F.col("node").bitwiseAND(F.lit(0xFFFFFFFF))).join(shared_counts(docs, words), "low").where(F.col("c") >= _needed(least)).select("node", F.col("row.doc_id").alias("d"), F.col("row.key").alias("k"))
    named = written(docs.join(alive, docs.doc_id.eqNullSafe(F.col("d")) & (docs.key == F.col("k"))).groupBy("node").agg(F.first("text").alias("text")), "named")
    lists, sketched = written(rare_lists(named, words, least), "lists"), written(sketches(named, words), "sketches")
    printed = written(decided(print_pairs(named), named, words, least), "links")
    first = written(decided(hub_pairs(lists, least).join(printed, ["a", "b"], "left_anti"), named, words, least).union(printed), "links")
    second = written(decided(open_pairs(lists, written(components(first), "labels"), least, best=True, sketched=sketched), named, words, least).union(first), "links")
    rest = written(decided(open_pairs(lists, written(components(second), "labels"), least, sketched=sketched), named, words, least), "links")
    found = components(second.union(rest)).withColumnRenamed("node", "name")
    rooted = nodes.join(found, nodes.node == found.name, "left").select("row", F.coalesce("root", "node").alias("root"))
    best = rooted.groupBy("root").agg(F.min("row").alias("row"))
    return best.select(F.col("row.doc_id").alias("d"), F.col("row.key").alias("k"))


def one_of_each(docs: DataFrame, words: int = 5, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, all columns, with one document of each group of near-duplicates: the one of least doc_id."""
    stays = representatives(texts(docs, id_col, text_col).select("doc_id", F.xxhash64("text").alias("key"), "text"), words, least)
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(id_col).cast("long").alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("key"))
    out = rows.join(stays, rows.id.eqNullSafe(stays.d) & (rows.key == stays.k)).dropDuplicates(["d", "k"])
    return out.select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns))
