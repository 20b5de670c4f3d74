"""Token-id files of Simple-8b blocks.

write_tokens() encodes documents in ascending doc_id order (rows of equal doc_id by the hash of
their text) and writes rows (shard, before, n_ids, n_docs, docs, blocks, words) with Spark's
Parquet writer, which any shared store takes.  A row is a segment of whole documents of about
SEGMENT ids, `before` the ids before it in its shard: `docs` has (doc_id, valid, n_ids) as three little-endian int64 each, `blocks` the
(first word, values) of each block as two uint32, `words` the 64-bit words.  A shard is a range of
doc_ids.  read_tokens() decodes the files to (doc_id, start, n_tokens, ids).

Very long texts are encoded whole.  Nulls: a null text is empty, so it has the end id alone; a null doc_id sorts first and stays null.
An empty table gives files without rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barflow.llm import simple8b
from barflow.llm.common import crc, parts_for, shared_folder, texts
from barflow.llm.pretoken import encoder

SEGMENT = 1 << 19
SCHEMA = "shard int, before long, n_ids long, n_docs int, docs binary, blocks binary, words binary"


def write_tokens(docs: DataFrame, path: str, tokenizer: str, kind: str = "word", end_id: int | None = 1, id_col: str = "doc_id", text_col: str = "text") -> None:
    base = texts(docs, id_col, text_col).withColumn("key", F.xxhash64("text"))
    dealt = base.repartitionByRange(parts_for(docs, 12 << 20), "doc_id", "key").sortWithinPartitions("doc_id", "key").select("doc_id", "text")
    tail = b"" if end_id is None else np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]):
        enc, shard, before = encoder(tokenizer, kind), TaskContext.get().partitionId(), 0
        docs, coded, total = [], [], 0

        def flush():
            ids = np.frombuffer(b"".join(coded), "<u4")
            lengths = np.array([d[2] for d in docs], np.int64)
            sizes = simple8b.blocks_of(lengths)
            words, starts = simple8b.encode(ids, sizes)
            row = [[shard], [before], [int(lengths.sum())], [len(docs)], [np.array(docs, "<i8").tobytes()], [np.stack([starts, sizes], 1).astype("<u4").tobytes()], [words.astype("<u8").tobytes()]]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()))], ["shard", "before", "n_ids", "n_docs", "docs", "blocks", "words"])

        for b in batches:
            for d, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                ids = enc.ids(t) + tail
                docs.append((d or 0, d is not None, len(ids) // 4))
                coded.append(ids)
                total += len(ids) // 4
                if total >= SEGMENT:
                    yield flush()
                    docs, coded, total, before = [], [], 0, before + total
        if docs:
            yield flush()

    dealt.mapInArrow(run, SCHEMA).write.parquet(path)


def read_tokens(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """(doc_id long, start long, n_tokens long, ids array<int>), or ids_crc32 long for ids where digest."""
    files = spark.read.schema(SCHEMA).parquet(path)
    # shards are as many as the writer's partitions: their totals are small, whatever the corpus
    totals = files.groupBy("shard").agg(F.sum("n_ids").alias("n")).orderBy("shard").collect()
    shards = dict(zip((r["shard"] for r in totals), np.cumsum([0, *(r["n"] for r in totals)]).tolist()))
    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            for row in b.to_pylist():
                docs = np.frombuffer(row["docs"], "<i8").reshape(-1, 3)
                blocks = np.frombuffer(row["blocks"], "<u4").reshape(-1, 2).astype(np.int64)
                ids = simple8b.decode(np.frombuffer(row["words"], "<u8"), blocks[:, 1], blocks[:, 0]).astype("<u4")
                ends = np.cumsum(docs[:, 2])
                start = ends - docs[:, 2] + shards[row["shard"]] + row["before"]
                cut = zip((ends - docs[:, 2]).tolist(), ends.tolist())
                if digest:
                    last = pa.array([crc(ids[x:y].tobytes()) for x, y in cut], pa.int64())
                else:
                    last = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([pa.array(docs[:, 0], mask=docs[:, 1] == 0), pa.array(start), pa.array(docs[:, 2]), last], ["doc_id", "start", "n_tokens", "last"])

    out = files.mapInArrow(run, f"doc_id long, start long, n_tokens long, last {'long' if digest else 'array<int>'}")
    return out.withColumnRenamed("last", "ids_crc32" if digest else "ids")


def stored_tokens(docs: DataFrame, tokenizer: str, kind: str = "word", end_id: int | None = 1) -> DataFrame:
    """Writes the corpus to a new folder of the shared store and reads it back, as digests."""
    path = shared_folder(docs.sparkSession, "tokens")
    write_tokens(docs, path, tokenizer, kind, end_id)
    return read_tokens(docs.sparkSession, path, digest=True)
