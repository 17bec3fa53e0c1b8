"""Components against union-find, by rounds and in one task, and how little a small table costs whatever the number of partitions."""

import numpy as np
import pytest

from courtlake.llm import components
from courtlake.llm import packing as p

RNG = np.random.default_rng(23)


def brute(edges):
    root = {}

    def find(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in root if find(i) != i}


def tasks_of(spark, run):
    """What ``run`` returns, and how many tasks it started."""
    spark.sparkContext.setJobGroup(name := f"count-{RNG.integers(1 << 40)}", name)
    try:
        out = run()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    tracker = spark.sparkContext.statusTracker()
    stages = {s for j in tracker.getJobIdsForGroup(name) for s in tracker.getJobInfo(j).stageIds}
    return out, sum(tracker.getStageInfo(s).numCompletedTasks for s in stages if tracker.getStageInfo(s))


def graph():
    chain = [(i, i + 1) for i in range(-40, 40)]
    return [*chain, *chain[:5], (7, 7), (900, 900), *((int(a), int(b)) for a, b in RNG.integers(1000, 1400, (220, 2))), (2**62, -(2**62)), (2**62, 5000)]


@pytest.mark.parametrize("most", [0, 1 << 18])
def test_components_of_chains_and_random_edges(spark, monkeypatch, most):
    monkeypatch.setattr(components, "TASK_EDGES", most)
    for edges in (graph(), [(1, 1)], []):
        out = components.connected_components(spark.createDataFrame(edges, "x long, y long")).collect()
        assert {r["node"]: r["component"] for r in out} == brute(edges) and len(out) == len(brute(edges))


def test_few_edges_take_no_rounds(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)], "a long, b long")
    out, tasks = tasks_of(spark, lambda: components.connected_components(edges).collect())
    assert len(out) == 300 and tasks < 40


def test_sweeps_of_few_rows_are_not_dealt(spark, monkeypatch):
    frame = type(spark.range(0))
    for name in ("repartition", "repartitionByRange"):  # a session that deals everything to 32 tasks
        monkeypatch.setattr(frame, name, lambda self, n, *cols, f=getattr(frame, name): f(self, max(n, 32), *cols))
    made = spark.createDataFrame([(i, int(n)) for i, n in enumerate(RNG.integers(1, 100, 400))], "tie long, length int")
    out, tasks = tasks_of(spark, lambda: p._assign(made, 100).collect())
    assert sorted(r["tie"] for r in out) == [r["tie"] for r in made.filter("length < 100").orderBy("tie").collect()]
    assert tasks < 32 * max(r["sweep"] for r in out)


def test_sweeps_of_one_task_and_of_several_agree(spark, monkeypatch):
    made = spark.createDataFrame([(i, int(n)) for i, n in enumerate(RNG.integers(1, 100, 300))], "tie long, length int")
    one = sorted(map(tuple, p._assign(made, 100).collect()))
    monkeypatch.setattr(p, "SWEEP_ROWS", 100)
    assert sorted(map(tuple, p._assign(made, 100).collect())) == one
