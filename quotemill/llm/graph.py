"""Connected components by alternating star contraction, as joins and aggregates on tables of edges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_batch, discard, materialise

#: So many counted edges of 16 bytes are contracted within one task; more of them by joins.
TASK_EDGES = 1 << 18


def _star(edges: DataFrame, own_too: bool) -> DataFrame:
    # Written, so that both sides of the join are dealt out anew and a node with very many edges can be split.
    least = materialise(edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), "least")
    moved = edges.join(least, "u")
    if own_too:
        low = moved.select(F.col("v").alias("u"), F.col("m").alias("v"))
        return low.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
    return moved.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def smallest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) of edges: labels are hooked to smaller ones, then followed to their roots."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(nodes))
    while True:
        lo, hi = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
        if (lo == hi).all():
            return nodes, nodes[label]
        np.minimum.at(label, hi, lo)
        while (label[label] != label).any():
            label = label[label]


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if held:
        node, component = smallest(*(np.concatenate(x) for x in zip(*held, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(component)], ["node", "component"])


def components(edges: DataFrame, task_edges: int | None = None, tasks: int | None = None) -> DataFrame:
    """(node, component) for every node of ``edges`` (u, v: long); the component is its smallest node.

    Up to ``task_edges`` (None: ``TASK_EDGES``) counted edges go to one task.  Of more, large-star and small-star steps in turn until nothing changes; each
    round is written to shared storage.  ``tasks`` is how many are to write the edges given.
    """
    given = materialise(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), "edges", tasks)
    if given.count() <= (TASK_EDGES if task_edges is None else task_edges):
        return given.coalesce(1).mapInArrow(by_batch(_solve), "node long, component long")
    now = materialise(given.distinct(), "edges")
    discard(given)
    mark = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
    while mark[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        nxt = materialise(_star(_star(both, False), True), "edges")
        new = nxt.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        discard(now)
        now, same, mark = nxt, new == mark, new
        if same:
            break
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
