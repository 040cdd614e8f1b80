"""Connected components: stars inside tasks first, then alternating large-star and small-star steps.

Edges are dealt to tasks in portions of about ``PORTION``; each task replaces its portion by stars (every
node tied to the least of its local component), which shortens paths. The steps between tasks go on until
the edges are a forest of stars, which is looked up and not assumed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.shared import delete, materialize, scratch_path


#: Edges that one task turns into stars at a time.
PORTION = 500_000


def _stars(batches):
    """Edges u, v -> for each portion of them the edges node, least of its local component."""
    held, size = [], 0
    for batch in batches:
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        size += batch.num_rows
        if size >= PORTION:
            yield from _star_rows(held)
            held, size = [], 0
    if size:
        yield from _star_rows(held)


def _star_rows(held: list):
    edges = [np.concatenate(side) for side in zip(*held)]
    nodes, at = np.unique(np.concatenate(edges), return_inverse=True)
    u, v = at[: len(at) // 2], at[len(at) // 2 :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[u], label[v])
        new = label.copy()
        for side in (u, v, label[u], label[v]):  # the roots as well, so that long paths close fast
            np.minimum.at(new, side, least)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    for s in range(0, len(nodes), 1 << 16):
        part = slice(s, s + (1 << 16))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[part]), pa.array(nodes[label[part]])], names=["u", "v"])


def _is_forest_of_stars(edges: DataFrame) -> bool:
    """Every node but the centres has one edge, and no centre is tied to another."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("tied"), F.lit(0).alias("centre")), F.struct(F.col("v").alias("node"), F.lit(0).alias("tied"), F.lit(1).alias("centre")))).alias("e"))
    return ends.groupBy("e.node").agg(F.sum("e.tied").alias("tied"), F.max("e.centre").alias("centre")).where("tied + centre > 1").isEmpty()


def connected_components(edges: DataFrame, most_rounds: int = 60, portion_tasks: int | None = None) -> DataFrame:
    """(node, label) of every node that has an edge; label is the smallest node of its component.

    ``edges`` has columns u and v, both long. Each round costs two shuffles of the edges
    and the number of rounds grows with the logarithm of the longest path; a hub is handled by
    aggregates, never gathered into one task. Each round's table is written to the shared folder.
    """
    spark = edges.sparkSession
    tasks = portion_tasks or max(1, -(-edges.count() // PORTION))
    dealt = edges.select("u", "v").repartition(tasks) if portion_tasks else edges.select("u", "v").coalesce(tasks)
    path = scratch_path(spark, "edges")
    current = materialize(dealt.mapInArrow(_stars, "u long, v long"), "edges", path)
    alone = current.where("u = v").select(F.col("u").alias("node"), F.col("v").alias("label"))  # a centre, or a node tied to itself
    current = current.where("u <> v")
    used = [path]
    for _ in range(most_rounds):
        if _is_forest_of_stars(current):
            break
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # large star leaves edges from each node to a smaller one; small star ties those to their least
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        after = scratch_path(spark, "edges")
        current = materialize(small.select("e.u", "e.v").where("u <> v").distinct(), "edges", after)
        for old in used[1:]:
            delete(spark, old)
        used = [path, after]
    else:
        raise RuntimeError("components did not settle")
    tied = current.select(F.col("u").alias("node"), F.col("v").alias("label"))
    centres = alone.join(tied.select("node"), "node", "left_anti").select("node", "label").distinct()
    return tied.distinct().unionByName(centres)
