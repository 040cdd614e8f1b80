"""Exact top-k by inner product with norm-sorted blocks and rotated partial sums (operator 7).

Vectors become integers, are sorted by descending length over the partitions and packed into blocks.
Their second-moment matrix (dims x dims, summed by executors) gives the right singular vectors; rotated
by them, the first coordinates hold most of the energy. Queries, packed into blocks too, meet the
longest block first, which gives each a k-th score; after that a block whose longest vector cannot
reach that score (Cauchy-Schwarz) is not even sent; the others come in order of their longest vector, so
that what was found prunes what follows. Within a block the rotated partial sum plus the product of the
residual lengths bounds each score, and only pairs whose bound reaches the k-th score are multiplied
out, exactly: in doubles where no sum can reach 2**53, in 64-bit integers below 2**63, in unbounded
integers beyond.

Defined cases: vectors that are null or hold null or non-finite components, and rows with a null id, take
no part; all others do; a scaled component or a score of 2**63 or more, which no long can hold, is an error; shorter vectors count as padded with zeros; ties go to the smaller id; rows repeated with one
id are rows of their own (a query leaves out only its own row); fewer than k candidates give all;
an empty table gives an empty result; extra columns do not take part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.shared import materialize

BLOCK, QUERIES = 4096, 512


def _integers(scale: float):
    def run(batches):
        for batch in batches:
            ids, lists = batch.column(0), batch.column(1)
            x = np.floor(scale * lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64))  # null components become NaN
            n = np.where(lists.is_valid().to_numpy(zero_copy_only=False), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), 0)
            ends = np.cumsum(n)
            row = np.repeat(np.arange(len(n)), n)
            raw = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            keep = lists.is_valid().to_numpy(zero_copy_only=False) & ids.is_valid().to_numpy(zero_copy_only=False)
            keep[row[~np.isfinite(raw)]] = False
            x[~keep[row]] = 0
            if (np.abs(x) >= 2.0**63).any():
                raise OverflowError("a scaled component does not fit in 64 bits")
            norms = np.sqrt(np.bincount(row, x * x, len(n)))
            at = np.flatnonzero(keep)
            packed = [x[e - k : e].astype(np.int64).tobytes() for e, k in zip(ends[at].tolist(), n[at].tolist())]
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(at)), pa.array(norms[at]), pa.array(packed, pa.binary())], names=["vec_id", "norm", "v"])

    return run


def _matrix(packed: list[bytes], dims: int) -> np.ndarray:
    out = np.zeros((len(packed), dims), np.int64)
    for row, p in zip(out, packed):
        v = np.frombuffer(p, np.int64)
        row[: len(v)] = v
    return out


def _packed(rows: int, dims: int):
    """Rows in the order they come -> blocks: id, ids, vectors, longest."""

    def block(number, ids, norms, vectors):
        order = np.argsort(ids, kind="stable")
        m = _matrix([vectors[i] for i in order], dims)
        return pa.RecordBatch.from_pydict(
            {"block": pa.array([number], pa.int64()), "longest": pa.array([max(norms)]), "ids": pa.array([np.array(ids, np.int64)[order].tobytes()], pa.binary()), "m": pa.array([m.tobytes()], pa.binary())}
        )

    def run(batches):
        number, ids, norms, vectors = TaskContext.get().partitionId() << 32, [], [], []
        for batch in batches:
            ids += batch.column(0).to_pylist()
            norms += batch.column(1).to_pylist()
            vectors += batch.column(2).to_pylist()
            while len(ids) >= rows:
                yield block(number, ids[:rows], norms[:rows], vectors[:rows])
                ids, norms, vectors, number = ids[rows:], norms[rows:], vectors[rows:], number + 1
        if ids:
            yield block(number, ids, norms, vectors)

    return run


def _moments(dims: int):
    def run(batches):
        total = np.zeros((dims, dims))
        for batch in batches:
            for p in batch.column(0).to_pylist():
                m = np.frombuffer(p, np.int64).reshape(-1, dims).astype(float)
                total += m.T @ m
        yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId() % 32], pa.int32()), "g": pa.array([total.tobytes()], pa.binary())})

    return run


def _sum_moments(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(g, float) for g in table.column("g").to_pylist())
    return pa.table({"part": table.column("part").slice(0, 1), "g": pa.array([total.tobytes()], pa.binary())})


def _query_blocks(dims: int, rows: int, every: int):
    """The queries among the rows of blocks, packed again."""

    def run(batches):
        number, held = TaskContext.get().partitionId() << 32, []
        count = 0

        def out():
            nonlocal number, held, count
            q, u, m = (np.concatenate([h[i] for h in held]) for i in range(3))
            held, count = [], 0
            for s in range(0, len(q), rows):
                number += 1
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *(pa.array([x[s : s + rows].tobytes()], pa.binary()) for x in (q, u, m))], names=["qblock", "qids", "own", "qm"])

        for batch in batches:
            for block, ids, m in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                ids = np.frombuffer(ids, np.int64)
                at = np.flatnonzero(ids % every == 0)
                if len(at):
                    own = np.stack([np.full(len(at), block), at], axis=1)
                    held.append((ids[at], own, np.frombuffer(m, np.int64).reshape(-1, dims)[at]))
                    count += len(at)
                if count >= rows:
                    yield from out()
        if held:
            yield from out()

    return run


def _search(k: int, dims: int, rotation, head: int):
    """Rows (qblock, qids, own, qm, least, block, longest, ids, m). Rows of one query block that follow one
    another share what they have found, so later blocks are pruned by it."""

    def run(batches):
        now = None
        for batch in batches:
            for row in batch.to_pylist():
                if now is None or now.number != row["qblock"]:
                    if now is not None:
                        yield now.result()
                    now = _Search(row, k, dims, rotation.value, head)
                now.meet(row)
        if now is not None:
            yield now.result()

    return run


def _seeded(k: int, dims: int, rotation, head: int, seed):
    """Query blocks with each query's k-th score in the seed block, and the least length that a block
    needs for any of them."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                s = _Search(row, k, dims, rotation.value, head)
                s.meet(seed.value)
                with np.errstate(divide="ignore", invalid="ignore"):
                    reach = np.where(s.norm > 0, (s.least - 1e-6 * np.abs(s.least)) / s.norm, np.where(s.least > 0, np.inf, -np.inf))
                reach = float(max(reach.min(), -1.0)) * (1 - 1e-9)
                yield pa.RecordBatch.from_arrays([*(pa.array([row[c]], t) for c, t in (("qblock", pa.int64()), ("qids", pa.binary()), ("own", pa.binary()), ("qm", pa.binary()))), pa.array([s.least.tobytes()], pa.binary()), pa.array([reach])], names=["qblock", "qids", "own", "qm", "least", "reach"])

    return run


def _long_products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products of rows in unbounded integers."""
    out = [sum(a * b for a, b in zip(*rows)) for rows in zip(x.tolist(), y.tolist())]
    if any(not -(2**63) <= s < 2**63 for s in out):
        raise OverflowError("a score does not fit in 64 bits")
    return np.array(out, np.int64)


class _Search:
    def __init__(self, row: dict, k: int, dims: int, rotation: np.ndarray, head: int):
        self.k, self.dims, self.rotation, self.head, self.number = k, dims, rotation, head, row["qblock"]
        self.ids = np.frombuffer(row["qids"], np.int64)
        self.own = np.frombuffer(row["own"], np.int64).reshape(-1, 2)
        self.q = np.frombuffer(row["qm"], np.int64).reshape(-1, dims)
        r = self.q @ rotation
        self.norm = np.sqrt((self.q.astype(float) ** 2).sum(axis=1))
        self.lead, self.rest = r[:, :head], np.sqrt((r[:, head:] ** 2).sum(axis=1))
        self.found = [np.zeros((0, 3), np.int64)]  # query, score, id
        self.least = np.frombuffer(row["least"], float).copy() if row.get("least") else np.full(len(self.ids), -np.inf)
        self.pairs = 0

    def meet(self, row: dict) -> None:
        slack = 1e-6 * (1 + self.norm * row["longest"])
        live = np.flatnonzero(self.norm * row["longest"] >= self.least - slack)
        if not len(live):
            return
        ids = np.frombuffer(row["ids"], np.int64)
        m = np.frombuffer(row["m"], np.int64).reshape(-1, self.dims)
        r = m @ self.rotation
        bound = self.lead[live] @ r[:, : self.head].T + self.rest[live, None] * np.sqrt((r[:, self.head :] ** 2).sum(axis=1))
        may = bound >= (self.least - slack)[live, None]
        own = self.own[live]
        here = np.flatnonzero(own[:, 0] == row["block"])
        may[here, own[here, 1]] = False
        # abs() of the least 64-bit integer would wrap; as doubles it does not
        largest = float(np.abs(m.astype(float)).max(initial=0)) * float(np.abs(self.q.astype(float)).max(initial=0)) * self.dims
        exact = largest < 2**53
        a, b = np.nonzero(may)
        self.pairs += len(a)
        if exact and len(a) > 0.1 * may.size:
            score = (self.q[live].astype(float) @ m.T.astype(float)).astype(np.int64)[a, b]
        else:
            score = np.empty(len(a), np.int64)
            for s in range(0, len(a), 1 << 16):
                x, y = self.q[live[a[s : s + (1 << 16)]]], m[b[s : s + (1 << 16)]]
                score[s : s + (1 << 16)] = (x * y).sum(axis=1) if largest < 2**62 else _long_products(x, y)
        good = score >= self.least[live[a]]
        self.found.append(np.stack([live[a[good]], score[good], ids[b[good]]], axis=1))
        self.settle()

    def settle(self) -> None:
        rows = np.concatenate(self.found)
        rows = rows[np.lexsort((rows[:, 2], -rows[:, 1], rows[:, 0]))]
        starts = np.searchsorted(rows[:, 0], rows[:, 0])
        rank = np.arange(len(rows)) - starts
        rows, rank = rows[rank < self.k], rank[rank < self.k]
        full = rows[rank == self.k - 1]
        self.least[full[:, 0]] = np.maximum(self.least[full[:, 0]], full[:, 1])
        self.found = [rows]

    def result(self) -> pa.RecordBatch:
        rows = np.concatenate(self.found)
        own = self.own[rows[:, 0]]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (own[:, 0], own[:, 1], self.ids[rows[:, 0]], rows[:, 2], rows[:, 1])], names=["b", "p", "query_id", "vec_id", "score"])


def top_k(vectors: DataFrame, every: int, k: int = 5, id_col="vec_id", vec_col="embedding", scale: float = 256.0, head: int = 16, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by ``every`` its k best others."""
    spark = vectors.sparkSession
    ints = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("e")).mapInArrow(_integers(scale), "vec_id long, norm double, v binary")
    ints = materialize(ints, "topk-vectors")
    stats = ints.agg(F.max(F.length("v")).alias("w"), F.count("*").alias("n")).first()
    if not stats["n"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    dims = max(1, stats["w"] // 8)
    head = min(head, dims)
    parts = -(-stats["n"] // block)
    ordered = ints.repartitionByRange(parts, F.desc("norm"), "vec_id").sortWithinPartitions(F.desc("norm"), "vec_id")
    blocks = materialize(ordered.mapInArrow(_packed(block, dims), "block long, longest double, ids binary, m binary"), "topk-blocks")

    grams = blocks.select("m").mapInArrow(_moments(dims), "part int, g binary").groupBy("part").applyInArrow(_sum_moments, "part int, g binary").collect()
    gram = sum(np.frombuffer(bytes(r["g"]), float) for r in grams).reshape(dims, dims)
    rotation = spark.sparkContext.broadcast(np.ascontiguousarray(np.linalg.eigh(gram)[1][:, ::-1]))

    queries = materialize(blocks.select("block", "ids", "m").mapInArrow(_query_blocks(dims, QUERIES, every), "qblock long, qids binary, own binary, qm binary"), "topk-queries")
    # the longest block first: its scores give every query a k-th score to prune by, before anything is sent
    longest = blocks.orderBy(F.desc("longest"), "block").limit(1).first()
    seed = spark.sparkContext.broadcast({c: longest[c] if c in ("block", "longest") else bytes(longest[c]) for c in ("block", "longest", "ids", "m")})
    seeded = queries.mapInArrow(_seeded(k, dims, rotation, head, seed), "qblock long, qids binary, own binary, qm binary, least binary, reach double")
    queries = materialize(seeded, "topk-seeded")
    # the stated query set meets all rows block by block: query blocks are sent to groups of blocks
    n_blocks, n_queries = blocks.count(), max(1, queries.count())
    groups = max(1, min(n_blocks, -(-4 * spark.sparkContext.defaultParallelism // n_queries)))
    dealt = blocks.withColumn("group", F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int"))
    sent = queries.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    # both sides come dealt and sorted as a merge join needs them, so it keeps their order: each query block
    # meets the blocks of a group one after another, longest first
    dealt = dealt.repartition(groups, "group").sortWithinPartitions("group", F.desc("longest"), "block")
    sent = sent.repartition(groups, "group").sortWithinPartitions("group", "qblock").hint("merge")
    met = sent.join(dealt, (sent["group"] == dealt["group"]) & (dealt["longest"] >= sent["reach"]))
    found = met.select("qblock", "qids", "own", "qm", "least", "block", "longest", "ids", "m").mapInArrow(_search(k, dims, rotation, head), "b long, p long, query_id long, vec_id long, score long")
    order = Window.partitionBy("b", "p").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_exact_top_k(spark, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), every=50, k=5)


ORACLE_SQL = {
    "op7_exact_top_k": """
WITH v AS (
  SELECT vec_id, [floor(256 * CAST(x AS DOUBLE)) for x in embedding] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
}
