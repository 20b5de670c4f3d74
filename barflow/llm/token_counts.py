"""Token counts without token ids.

Every distinct pre-token of the corpus is merged once and only the number of its pieces is kept.
Frequent pre-tokens (a bounded table) are summed where the document is read; the others are
joined, document by document, to the table of piece counts.  No id is ever materialised.

Very long texts are counted whole.  Nulls: a null text counts as empty (0 tokens).  A null doc_id is kept.  Repeated rows each give a
row.  An empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barflow.llm.common import each_batch, texts, written
from barflow.llm.pretoken import encoder

FREQUENT = 300_000  # pre-tokens in the broadcast table, at most
FREQUENT_CHARS = 32  # longer ones never enter it: the broadcast stays under about 20 MB
TOP_COUNT = 1 << 20


def _parts(text: str, enc) -> tuple[int, list[str]]:
    """How many special tokens' strings the text holds, and its pre-tokens."""
    if "<|" not in text:
        return 0, enc.split(text)
    special, pieces = 0, []
    for is_special, part in enc.segments(text):
        if is_special:
            special += 1
        else:
            pieces += enc.split(part)
    return special, pieces


def piece_table(docs: DataFrame, path: str, kind: str) -> DataFrame:
    """(pre string, n long, pieces int): each distinct pre-token, its frequency and its pieces."""

    def distinct(b: pa.RecordBatch) -> pa.RecordBatch:
        enc, seen = encoder(path, kind), Counter()
        for t in b.column("text").to_pylist():
            seen.update(_parts(t, enc)[1])
        return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["pre", "n"])

    def count(b: pa.RecordBatch) -> pa.RecordBatch:
        enc = encoder(path, kind)
        pieces = [enc.count(p) for p in b.column("pre").to_pylist()]
        return pa.RecordBatch.from_arrays([b.column("pre"), b.column("n"), pa.array(pieces, pa.int32())], ["pre", "n", "pieces"])

    found = each_batch(docs.select("text"), distinct, "pre string, n long").groupBy("pre").agg(F.sum("n").alias("n"))
    return written(each_batch(found, count, "pre string, n long, pieces int"), "pieces")


def frequent_from(pieces: DataFrame, most: int = FREQUENT) -> int:
    """The least frequency of which at most `most` short pre-tokens have it or more."""
    by = pieces.where(F.length("pre") <= FREQUENT_CHARS).groupBy(F.least("n", F.lit(TOP_COUNT)).alias("n")).count()
    least, total = TOP_COUNT + 1, 0
    for n, c in sorted(by.where(F.col("n") > 1).collect(), reverse=True):
        total += c
        if total > most:
            break
        least = n
    return least


def count_tokens(docs: DataFrame, path: str, kind: str = "byte", limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_bytes, n_pre (pre-tokens), n_tokens, over_limit (n_tokens > limit)."""
    base = texts(docs, id_col, text_col)
    pieces = piece_table(base, path, kind)
    least = frequent_from(pieces)
    rows = pieces.where((F.col("n") >= least) & (F.length("pre") <= FREQUENT_CHARS)).select("pre", "pieces").toArrow()
    frequent = base.sparkSession.sparkContext.broadcast(dict(zip(rows.column("pre").to_pylist(), rows.column("pieces").to_pylist())))

    def per_document(b: pa.RecordBatch) -> pa.RecordBatch:
        enc, known = encoder(path, kind), frequent.value
        ids, keys, pre, n, size, n_pre = [], [], [], [], [], []
        for d, key, t in zip(b.column("doc_id").to_pylist(), b.column("key").to_pylist(), b.column("text").to_pylist()):
            local, parts = _parts(t, enc)
            n_pre_here = local + len(parts)
            counts = [*map(known.get, parts)]
            rest = Counter(p for p, c in zip(parts, counts) if c is None) if None in counts else {}
            local += sum(filter(None, counts))
            ids += [d] * (1 + len(rest))
            keys += [key] * (1 + len(rest))
            pre += [None, *rest]
            n += [local, *rest.values()]
            size += [len(t.encode("utf-8", "surrogatepass"))] + [None] * len(rest)
            n_pre += [n_pre_here] + [None] * len(rest)
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in ((ids, pa.int64()), (keys, pa.int64()), (pre, pa.string()), (n, pa.int64()), (size, pa.int64()), (n_pre, pa.int64()))], ["doc_id", "key", "pre", "n", "n_bytes", "n_pre"])

    keyed = base.select("doc_id", F.xxhash64("text").alias("key"), "text")
    found = each_batch(keyed, per_document, "doc_id long, key long, pre string, n long, n_bytes long, n_pre long")
    # a document's own row has no pre-token: it joins nothing, under a key of its own so that no task gets them all
    probe = found.select("*", F.coalesce(F.xxhash64("pre"), F.xxhash64("doc_id", "key")).alias("at"))
    table = pieces.select(F.xxhash64("pre").alias("at"), F.col("pre").alias("of"), "pieces")
    joined = probe.join(table, (probe.at == table.at) & (probe.pre == table.of), "left")
    summed = joined.groupBy("doc_id", "key").agg(
        F.sum(F.col("n") * F.coalesce("pieces", F.lit(1))).alias("tokens"),
        F.sum("n_bytes").alias("bytes"),
        F.sum("n_pre").alias("pres"),
        F.count("n_bytes").alias("rows"),
    )
    # rows that repeat in full fall into one group: their sums are shared out again
    each = summed.select("doc_id", "tokens", "bytes", "pres", "rows", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))))
    total = (F.col("tokens") / F.col("rows")).cast("long")
    return each.select("doc_id", (F.col("bytes") / F.col("rows")).cast("long").alias("n_bytes"), total.alias("n_tokens"), (total > limit).alias("over_limit"), (F.col("pres") / F.col("rows")).cast("long").alias("n_pre"))
