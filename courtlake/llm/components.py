"""Connected components by alternating large-star and small-star steps.

Each step is a grouped minimum (combined map-side) and an equi-join whose hot
keys adaptive execution can split; edges never leave the executors, and each
round is checkpointed.  Edges so few that one task holds them at ease are
joined up there at once, without rounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courtlake.llm.common import materialise

#: Edges of one task at most; they are two numbers each.
TASK_EDGES = 1 << 18


def _fingerprint(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()


def merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``label`` (each row's smallest connected row) after the edges (a, b), by hooking and pointer jumping."""
    while True:
        split = label[a] != label[b]
        a, b = a[split], b[split]
        if not len(a):
            return label
        least = label.copy()
        np.minimum.at(least, a, label[b])
        np.minimum.at(least, b, label[a])
        np.minimum.at(least, label, least)
        while not np.array_equal(least, least[least]):
            least = least[least]
        label = least


def _in_one_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ends = [np.stack([b.column("a").to_numpy(), b.column("b").to_numpy()]) for b in batches]
    if not ends:
        return
    nodes, place = np.unique(np.concatenate(ends, 1), return_inverse=True)
    a, b = place.reshape(2, -1)
    label = merge(np.arange(len(nodes)), a, b)
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    yield pa.RecordBatch.from_arrays([pa.array(nodes[moved], pa.int64()), pa.array(nodes[label[moved]], pa.int64())], names=["node", "component"])


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(a, b) links -> (node, component): the smallest node reachable, for nodes other than it.

    Nodes that are smallest in their component, or have no link, are not
    listed.  Self links and repeats are ignored; no edges give no rows.
    """
    a, b = edges.columns[:2]
    now = materialise(
        edges.select(F.greatest(a, b).cast("long").alias("a"), F.least(a, b).cast("long").alias("b")).filter("a <> b").distinct()
    )
    before = _fingerprint(now)
    if before[0] <= TASK_EDGES:
        return materialise(now.coalesce(1).mapInArrow(_in_one_task, "node long, component long"))
    for _ in range(max_rounds):
        now = materialise(_small_star(_large_star(now)))
        after = _fingerprint(now)
        if after == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
        before = after
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
