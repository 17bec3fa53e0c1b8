"""The vector-approximation search against brute force: what it prunes, huge scores, repeats, mixed lengths."""

import numpy as np
import pytest

from courtlake.llm import topk_search as t

RNG = np.random.default_rng(11)
SCHEMA = "vec_id long, embedding array<double>, score string, cells int"


def brute(rows, every, k, scale=256):
    """[(query_id, rank, vec_id, score)] by Python's integers, over rows."""
    whole = lambda v: None if v is None or not v or any(x is None or not np.isfinite(x) for x in v) else [int(np.floor(x * scale)) if abs(x) < 1e300 else int(x) * scale for x in v]
    good = [(i, w) for i, v in rows if i is not None and (w := whole(v))]
    out = []
    for a, (i, q) in enumerate(good):
        if i % every == 0:
            others = [(-sum(x * y for x, y in zip(q, v)), j) for b, (j, v) in enumerate(good) if a != b and len(v) == len(q)]
            out += [(i, r + 1, j, max(-(1 << 63), min((1 << 63) - 1, -s))) for r, (s, j) in enumerate(sorted(others)[:k])]
    return sorted(out)


def search(spark, rows, **options):
    table = spark.createDataFrame([(i, v, "x", 0) for i, v in rows], SCHEMA)
    return sorted(map(tuple, t.top_k(table, **options).collect()))


@pytest.mark.parametrize("size", [0.2, 2.0**20, 2.0**31, 1e150])
def test_scores_of_any_size(spark, size):
    rows = [(i, (RNG.normal(size=8) * size).tolist()) for i in range(120)]
    assert search(spark, rows, every=10) == brute(rows, 10, 5)


def test_repeats_ties_lengths_and_nulls(spark):
    base = [RNG.normal(size=6).tolist() for _ in range(30)]
    rows = list(enumerate(base)) + [(0, base[3]), (0, base[0]), (5, base[5]), (None, base[1]), (40, None), (50, []), (60, [1.0, None] + [0.0] * 4), (70, [float("inf")] * 6)]
    rows += [(-10, base[2])] + [(100 + i, RNG.normal(size=3).tolist()) for i in range(12)] + [(200, [0.0] * 6), (210, [1.0])]
    assert search(spark, rows, every=10) == brute(rows, 10, 5)
    assert search(spark, [], every=10) == []


def test_a_third_of_all_rows_are_copies(spark):
    rows = [(i, [1.0, 2.0, -0.5] if i % 3 == 0 else RNG.normal(size=3).tolist()) for i in range(240)]
    assert search(spark, rows, every=20) == brute(rows, 20, 5)


def test_slices_and_blocks(spark, monkeypatch):
    for name, value in (("_SLICE", 16), ("_ASKED", 3), ("QUERY_BLOCK", 4), ("FRAGMENT", 40)):
        monkeypatch.setattr(t, name, value)
    rows = [(i, RNG.normal(size=5).tolist()) for i in range(150)]
    assert search(spark, rows, every=7, k=3) == brute(rows, 7, 3)


def test_bounds_hold_and_prune():
    x = np.floor(256 * RNG.normal(size=(4000, 32)))
    edges = np.quantile(x, np.arange(1, t.CELLS) / t.CELLS, axis=0, method="lower")
    cells = t.approximate(x, edges)
    low, high = t.extents(x, cells)
    at = np.arange(32)
    lower, upper = t.score_bounds(x[:20], low[cells, at], high[cells, at])
    true = x[:20] @ x.T
    assert (lower <= true).all() and (true <= upper).all()
    q, r, *_ = t.scan_fragment(x[:20], cells, low, high, 5)
    best = {i: set(np.argsort(-true[i])[:5].tolist()) for i in range(20)}
    assert all(best[i] <= set(r[q == i].tolist()) for i in range(20))
    # Of 4,000 rows a query reads few exactly.
    assert len(q) / 20 < 40
