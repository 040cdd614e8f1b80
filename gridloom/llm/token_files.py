"""Token ids in ORC files (operator 6).

Documents are ordered by id over the files, encoded where they are written, and stored one row each:
id, place within the file, count and the ids as a list of integers, which ORC keeps as run-length and
delta encoded streams in stripes. Each stripe has row indexes and a Bloom filter of the document ids,
so a reader prunes stripes by id and reads the others in parallel. The place of a document in the whole
corpus is its place in the file plus the counts of the files before it; those totals (one number a
file) are the only thing the driver gathers.

Defined cases: null counts as the empty text, stored as the end id alone; null ids come first; rows
that share an id follow one another in an order set by a hash of the text; texts of any length are one
row; an empty table gives an empty folder that reads as no rows; extra columns are not stored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.bpe_ids import ByteBpe, vocabulary
from gridloom.llm.textops import byte_texts, slices_by_bytes
from gridloom.shared import scratch_path

SCHEMA = "doc_id long, part int, place long, n_tokens long, ids array<int>"


def write_tokens(docs: DataFrame, folder: str, path: str, end_id: int | None = 2, id_col="doc_id", text_col="text", stripe_bytes: int = 64 << 20, stride: int = 1000) -> None:
    """Encode every whole text and write the ids in ascending order of ids to ORC files in ``folder``."""
    end = np.array([] if end_id is None else [end_id], np.uint32)

    def run(batches):
        bpe, place, part = ByteBpe.load(path), 0, TaskContext.get().partitionId()
        for batch in slices_by_bytes(batches, "text", 2 << 20, vocabulary=True):
            ids = [np.concatenate([bpe.encode(t.decode("utf-8", "replace")), end]) for t in byte_texts(batch, "text")]
            counts = np.array([len(x) for x in ids], np.int64)
            offsets = np.concatenate([[0], np.cumsum(counts)])
            lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(np.concatenate(ids).astype(np.int32)))
            columns = [batch.column(0), pa.array(np.full(len(ids), part, np.int32)), pa.array(place + offsets[:-1]), pa.array(counts), lists]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "part", "place", "n_tokens", "ids"])
            place += int(offsets[-1])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    tie = F.xxhash64("text")
    ordered = source.repartitionByRange(F.col("doc_id"), tie).sortWithinPartitions(F.col("doc_id"), tie)
    options = {
        "compression": "zstd", "orc.create.index": "true", "orc.row.index.stride": str(stride), "orc.stripe.size": str(stripe_bytes),
        "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.encoding.strategy": "SPEED",
    }
    ordered.mapInArrow(run, SCHEMA).write.options(**options).orc(folder)


def read_tokens(spark, folder: str, ids: list[int] | None = None) -> DataFrame:
    """The stored rows with ``start``, the number of ids of all documents before. With ``ids`` only those
    documents are read: the predicate reaches ORC's stripe statistics and Bloom filters."""
    rows = spark.read.schema(SCHEMA).orc(folder)
    totals = sorted(tuple(r) for r in rows.groupBy("part").agg(F.sum("n_tokens")).collect())  # one row a file
    before = np.concatenate([[0], np.cumsum([n for _, n in totals])])[: len(totals)].tolist()
    base = spark.createDataFrame(list(zip([p for p, _ in totals], before)), "part int, base long")
    if ids is not None:
        rows = rows.where(F.col("doc_id").isin(ids))
    return rows.join(F.broadcast(base), "part").withColumn("start", F.col("base") + F.col("place")).drop("base")


def checksums(rows: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of rows as ``read_tokens`` returns them."""

    def run(batches):
        for batch in batches:
            lists = batch.column(3)
            values = np.asarray(lists.values.to_numpy(zero_copy_only=False), "<u4") if len(lists) else np.zeros(0, "<u4")
            offsets = lists.offsets.to_numpy().tolist()
            crc = [zlib.crc32(values[s:e].tobytes()) for s, e in zip(offsets, offsets[1:])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return rows.select("doc_id", "start", "n_tokens", "ids").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op6_token_files(spark, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "tokens-orc")
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder, vocabulary("byte_bpe_50k.json"))
    return checksums(read_tokens(spark, folder))
