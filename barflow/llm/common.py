"""What the operators share: input columns, shared folders, digests."""

from __future__ import annotations

import tempfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only (doc_id long, text string); null texts become empty.  Other columns never clash."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def row_hash(*cols: str):
    """A stable number for a row, so that a recomputed task deals rows the same way."""
    return F.xxhash64(*cols)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one that the session names in spark.checkpoint.dir."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(base)
    return f"{base}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: its lineage ends there."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def parts_for(df: DataFrame, bytes_each: int, least: int = 12) -> int:
    """How many parts of about bytes_each of df's files there are; at least the session's shuffle partitions."""
    shuffles = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, shuffles, -(-stored_bytes(df) // bytes_each))


def stored_bytes(df: DataFrame) -> int:
    """Bytes of the files that df reads, from their listing; half the bytes of the texts where there are no files."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    if size < 1 << 58:
        return size
    strings = [F.octet_length(F.col(f"`{c}`")) for c, kind in df.dtypes if kind == "string"]
    return int(df.select(sum(map(lambda x: F.coalesce(x, F.lit(0)), strings), F.lit(0)).alias("n")).agg(F.sum("n")).first()[0] or 0) // 2


def each_batch(df: DataFrame, make, schema: str) -> DataFrame:
    """make(batch) -> an Arrow batch or table, for every Arrow batch of df."""

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            out = make(b)
            if out is None:
                continue
            yield from out.to_batches() if isinstance(out, pa.Table) else [out]

    return df.mapInArrow(run, schema)


def crc(data: bytes) -> int:
    return zlib.crc32(data) & 0xFFFFFFFF


def runs(sorted_keys: np.ndarray) -> np.ndarray:
    """Offsets at which runs of equal keys start, and the length at the end."""
    if not len(sorted_keys):
        return np.zeros(1, np.int64)
    return np.concatenate(([0], np.flatnonzero(sorted_keys[1:] != sorted_keys[:-1]) + 1, [len(sorted_keys)]))
