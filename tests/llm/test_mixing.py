"""Mixing against the dual solved in numpy, targets against plain water filling, and sources without words."""

import collections

import numpy as np
import pytest

from courtlake.llm import mixing

RNG = np.random.default_rng(3)
SCHEMA = "doc_id long, text string, source string, size string, target int, row int"


def table(spark, rows):
    return spark.createDataFrame([(i, t, s, "x", 0, 0) for i, t, s in rows], SCHEMA)


def targets(sizes, share=1.5, most=2, weights=(5, 2, 1)):
    """Raise a common level by bisection until the capped targets sum to the share."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    low, high = 0.0, 1e12
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(most * sizes[s], mid * w[s]) for s in sizes) < share * sum(sizes.values()) else (low, mid)
    return {s: min(most * sizes[s], high * w[s]) for s in sizes}


@pytest.mark.parametrize("sources", [1, 2, 5, 40])
def test_targets_equal_bisection(spark, sources):
    sizes = {f"s{i}é" if i % 3 else f"S{i}": int(RNG.integers(0, 2000)) for i in range(sources)} | {None: 77, "empty": 0}
    got = mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long"))
    want = targets(sizes)
    assert {r.source: pytest.approx(r.target, abs=1e-6) for r in got.collect()} == want


def test_rates_equal_the_dual_solved_in_numpy(spark):
    rows = [(i, "w " * int(RNG.integers(1, 60)), f"s{i % 4}") for i in range(600)]
    got = mixing.mix(table(spark, rows)).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r.source].append(r)
    assert len(by) == 4
    inside = 0
    for rows_ in by.values():
        size = np.array([r["size"] for r in rows_], float)
        goal, mean = rows_[0].target, size.mean()
        if goal < 2 * size.sum():
            low, high = -50.0, 50.0
            for _ in range(200):  # the dual's gradient grows with the multiplier
                mid = (low + high) / 2
                low, high = (mid, high) if (size * 2 / (1 + np.exp(-mid * size / mean))).sum() < goal else (low, mid)
            assert np.allclose([r.rate for r in rows_], 2 / (1 + np.exp(-high * size / mean)), atol=1e-3)
            inside += 1
        assert abs(sum(r.taken for r in rows_) - goal) <= 0.5 + 1e-6
        assert all(0 <= r.taken <= 2 * r["size"] for r in rows_)
        assert sum(r.taken % r["size"] != 0 for r in rows_) <= 1
    assert inside


def test_sources_without_words_repeats_and_null_ids(spark):
    rows = [(1, None, "none"), (2, "", "none"), (3, " \n", None)] + [(i, "a b c", "some") for i in range(10, 20)]
    rows += [(50, "same text here", "copies")] * 30 + [(None, "no id at all", "copies"), (None, None, "copies")]
    got = mixing.mix(table(spark, rows)).collect()
    assert len(got) == len(rows)
    assert {(r.source, r.source_size, r.target, r.taken) for r in got if r.source in (None, "none")} == {(None, 0, 0.0, 0), ("none", 0, 0.0, 0)}
    taken = collections.Counter()
    for r in got:
        taken[r.source] += r.taken
    assert all(abs(taken[r.source] - r.target) <= 1 for r in got)
    only = mixing.mix(table(spark, rows[:3])).collect()
    assert [(r["size"], r.target, r.taken) for r in only] == [(0, 0.0, 0)] * 3
    assert sorted(map(str, mixing.mix(table(spark, rows)).collect())) == sorted(map(str, got))
