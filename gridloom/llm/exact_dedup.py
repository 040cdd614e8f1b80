"""Exact deduplication with a log-structured merge index (operator 8).

Arriving documents fill a memtable per task (digest -> members). A full memtable is flushed as a run
sorted by digest: one row per distinct digest with its members. Compaction merges the runs by digest
and keeps one identifier for each (the smallest by default, the largest on request). Digests with
more than one member are hits: a Bloom filter of them prunes the documents whose texts are then
compared byte by byte (grouped by the whole text, not by the digest). Texts that share a digest but
differ are split into groups of their own, so the result does not rest on the digest.

Defined cases: null text counts as empty, and empty texts equal one another; a null id never beats an
id and stays only when the whole group has null ids; rows repeated with the same id are members like
any others, and exactly one row of a group is kept; an empty table gives an empty result; extra
columns do not take part (join them back by id).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.bloom import bloom_of_digests, digest_keys
from gridloom.llm.textops import LOWER, byte_texts, slices_by_bytes
from gridloom.shared import materialize

_RUN = "digest binary, run long, ids array<bigint>, best_at int, best bigint, n bigint"


def _best_position(ids: list, keep: str) -> int:
    known = [(v, -i) if keep == "max" else (-v, -i) for i, v in enumerate(ids) if v is not None]
    return -max(known)[1] if known else 0


def _flush(table: dict, run: int, keep: str) -> pa.RecordBatch:
    rows = sorted(table.items())
    at = [_best_position(ids, keep) for _, ids in rows]
    return pa.RecordBatch.from_pydict(
        {
            "digest": pa.array([d for d, _ in rows], pa.binary()),
            "run": pa.array([run] * len(rows), pa.int64()),
            "ids": pa.array([ids for _, ids in rows], pa.list_(pa.int64())),
            "best_at": pa.array(at, pa.int32()),
            "best": pa.array([ids[i] for (_, ids), i in zip(rows, at)], pa.int64()),
            "n": pa.array([len(ids) for _, ids in rows], pa.int64()),
        }
    )


def _runs(memtable_rows: int, keep: str, digest_bytes: int):
    def run(batches):
        table, held, seq = {}, 0, TaskContext.get().partitionId() << 24
        for batch in slices_by_bytes(batches, "text", 8 << 20):
            for i, text in zip(batch.column(0).to_pylist(), byte_texts(batch, "text")):
                table.setdefault(hashlib.sha256(text.translate(LOWER)).digest()[:digest_bytes], []).append(i)
            held += batch.num_rows
            if held >= memtable_rows:
                yield _flush(table, seq, keep)
                table, held, seq = {}, 0, seq + 1
        if table:
            yield _flush(table, seq, keep)

    return run


def _hit_texts(filter_, digest_bytes: int):
    """The normalised texts whose digest may be a hit, once per slice, with their members."""

    def hits(batches):
        bloom = filter_.value
        for batch in slices_by_bytes(batches, "text", 16 << 20):
            texts = [t.translate(LOWER) for t in byte_texts(batch, "text")]
            digests = [hashlib.sha256(t).digest()[:digest_bytes] for t in texts]
            table: dict = {}
            ids = batch.column(0).to_pylist()
            for i in np.flatnonzero(bloom.has(digest_keys(digests))).tolist():
                table.setdefault((digests[i], texts[i]), []).append(ids[i])
            yield pa.RecordBatch.from_pydict(
                {
                    "digest": pa.array([d for d, _ in table], pa.binary()),
                    "text": pa.array([t for _, t in table], pa.binary()),
                    "ids": pa.array(list(table.values()), pa.list_(pa.int64())),
                }
            )

    return hits


def exact_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "min",
    memtable_rows: int = 1 << 16,
    digest_bytes: int = 32,
) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, digest (binary, of the normalised text).

    ``memtable_rows`` bounds the members a run can hold for one digest, so a hot text is spread over
    the runs. ``digest_bytes`` below 32 shortens the index's keys; results stay exact.
    """
    if keep not in ("min", "max"):
        raise ValueError("keep is 'min' or 'max'")
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    runs = materialize(source.mapInArrow(_runs(memtable_rows, keep, digest_bytes), _RUN), "lsm-runs")

    sign = 1 if keep == "max" else -1
    best = F.max(F.struct((sign * F.col("best")).alias("v"), (-F.col("run")).alias("r")))
    index = materialize(runs.groupBy("digest").agg(best.alias("b"), F.sum("n").alias("group_size")), "lsm-index")
    hits = index.where("group_size > 1")
    split = _collisions(spark, source, hits, digest_bytes, keep)

    merged = runs.join(index, "digest")
    if split is not None:
        merged = merged.join(split.select("digest").distinct(), "digest", "left_anti")
    out = _members(merged.select("digest", "run", "ids", "best_at", "b", "group_size"), sign)
    return out if split is None else out.unionByName(_members(split, sign))


def _members(merged: DataFrame, sign: int) -> DataFrame:
    return merged.select(
        "digest", "group_size", (sign * F.col("b.v")).alias("keep_id"), (F.col("b.r") == -F.col("run")).alias("here"), "best_at", F.posexplode("ids").alias("at", "doc_id")
    ).select("doc_id", "keep_id", "group_size", (F.col("here") & (F.col("at") == F.col("best_at"))).alias("kept"), "digest")


def _collisions(spark, source: DataFrame, hits: DataFrame, digest_bytes: int, keep: str) -> DataFrame | None:
    """Byte verification. None if every hit holds one text; else the groups of the digests that don't."""
    count = hits.count()
    if not count:
        return None
    filter_ = spark.sparkContext.broadcast(bloom_of_digests(hits, "digest", count))
    texts = source.mapInArrow(_hit_texts(filter_, digest_bytes), "digest binary, text binary, ids array<bigint>")
    mixed = materialize(texts.groupBy("digest", "text").agg(F.lit(1).alias("one")).groupBy("digest").count().where("count > 1").select("digest"), "lsm-mixed")
    if mixed.isEmpty():
        return None
    sign = 1 if keep == "max" else -1
    rows = materialize(texts.join(mixed, "digest", "left_semi"), "lsm-mixed-texts").withColumn("run", F.monotonically_increasing_id())
    pick = F.array_max if keep == "max" else F.array_min
    rows = rows.withColumn("best", pick("ids")).withColumn("best_at", F.coalesce(F.array_position("ids", F.col("best")) - 1, F.lit(0)).cast("int"))
    rows = materialize(rows, "lsm-mixed-runs")
    best = F.max(F.struct((sign * F.col("best")).alias("v"), (-F.col("run")).alias("r")))
    groups = rows.groupBy("digest", "text").agg(best.alias("b"), F.sum(F.size("ids")).alias("group_size"))
    return rows.join(groups, ["digest", "text"]).select("digest", "run", "ids", "best_at", "b", "group_size")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", **options) -> DataFrame:
    """The rows of ``docs`` that stay: one of each group of equal texts, with all their columns.

    Which row stays is decided by id; of rows that repeat both id and text one stays.
    """
    norm = F.translate(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    digest = F.substring(F.unhex(F.sha2(norm.cast("binary"), 256)), 1, options.get("digest_bytes", 32))
    groups = materialize(exact_groups(docs, id_col, text_col, keep, **options), "lsm-groups")
    stays = groups.where("kept").select(F.col("doc_id").alias("__id"), F.col("digest").alias("__digest")).distinct()
    marked = docs.withColumn("__d", digest)
    out = marked.join(stays, marked[id_col].cast("long").eqNullSafe(stays["__id"]) & (marked["__d"] == stays["__digest"]), "left_semi")
    repeated = groups.groupBy("doc_id", "digest").count().where("count > 1")
    return (out if repeated.isEmpty() else out.dropDuplicates([id_col, "__d"])).drop("__d")


def op8_exact_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = exact_groups(docs, keep="max")
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


ORACLE_SQL = {
    "op8_exact_dedup": """
WITH t AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents
), g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.norm) AS text_sha256
FROM t JOIN g ON t.norm = g.norm
"""
}
