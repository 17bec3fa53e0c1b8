"""Near vectors against brute force: recall at the threshold for as many functions as larger corpora choose, large buckets, odd vectors."""

import numpy as np
import pytest

from courtlake.llm import embedding_dedup as e

RNG = np.random.default_rng(17)
SCHEMA = "vec_id long, embedding array<double>, dim string, copies int, links int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, "x", 0, 0) for i, v in rows], SCHEMA)


def brute(rows, threshold=0.95):
    """vec_id -> (links, component) by all cosines, one vector at a time; ids have to be distinct."""
    good = {i: np.array(v, float) / np.abs(v).max() for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v)}
    good = {i: v / np.linalg.norm(v) for i, v in good.items()}
    root = {i: i for i, _ in rows}
    links = dict.fromkeys(root, 0)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(good)
    for a, i in enumerate(ids):
        for j in ids[a + 1 :]:
            if len(good[i]) == len(good[j]) and good[i] @ good[j] >= threshold:
                links[i] += 1
                links[j] += 1
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: (links[i], find(i)) for i in root}


def found(spark, rows):
    return {r.vec_id: (r.n_links, r.component_id) for r in e.near_vectors(table(spark, rows)).collect()}


def pairs_at(cosine, dim, n):
    x = RNG.normal(size=(n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    side = RNG.normal(size=(n, dim))
    side -= (side * x).sum(1, keepdims=True) * x
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    return x, cosine * x + np.sqrt(1 - cosine**2) * side


@pytest.mark.parametrize("functions", [1, 2, 3, 4, 5])
def test_recall_at_the_threshold(functions):
    x, y = pairs_at(0.95, 64, 1500)
    a, b = (e.bucket_codes(v, e.TABLES, functions, e.PROBES) for v in (x, y))
    met = (a[:, :, :, None] == b[:, :, None, :]).any((1, 2, 3))
    assert met.mean() >= 0.9


def test_functions_grow_with_the_corpus():
    assert [e.functions_for(n, 64, 3) for n in (10, 1000, 10**5, 10**7, 10**9)] == sorted(e.functions_for(n, 64, 3) for n in (10, 1000, 10**5, 10**7, 10**9))
    assert e.functions_for(10**9, 64, 3) <= 5


def test_a_bucket_of_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(e, "BLOCK", 40)
    monkeypatch.setattr(e, "STRIP", 16)
    monkeypatch.setattr(e, "PAIRS", 50)
    centre = RNG.normal(size=24)
    rows = [(i, (centre + RNG.normal(size=24) * 0.02).tolist()) for i in range(300)] + [(1000 + i, RNG.normal(size=24).tolist()) for i in range(60)]
    assert found(spark, rows) == brute(rows)


def test_recall_of_links_at_mixed_cosines(spark):
    x, y = pairs_at(0.95 + 1e-9, 32, 150)
    rows = [(2 * i, v.tolist()) for i, v in enumerate(x)] + [(2 * i + 1, v.tolist()) for i, v in enumerate(y)]
    want, got = brute(rows), found(spark, rows)
    assert sum(n for n, _ in got.values()) >= 0.9 * sum(n for n, _ in want.values()) > 0
    assert all(got[i][0] <= want[i][0] for i in got)


def test_odd_vectors(spark):
    base = RNG.normal(size=8)
    rows = [(1, (base * 1e-200).tolist()), (2, (base * 1e200).tolist()), (3, base.tolist()), (4, (base * 5e-320).tolist()), (5, [0.0] * 8), (6, [-0.0] * 8), (7, None), (8, [])]
    rows += [(9, [1.0] * 7 + [None]), (10, [float("nan")] * 8), (11, base[:4].tolist()), (12, (base[:4] * 3).tolist()), (13, [2.0]), (14, [1.0]), (15, [-1.0])]
    got, want = found(spark, rows), brute(rows)
    del got[4], want[4]  # so few bits are left of it that its cosine is anyone's
    assert got == want and got[1] == (3 if brute(rows)[4][0] else 2, 1)
    repeated = [(1, base.tolist()), (1, base.tolist()), (None, base.tolist()), (None, (base * 2).tolist()), (None, None), (2, RNG.normal(size=8).tolist())]
    out = sorted(((r.vec_id or -1), r.n_links, r.component_id, r.kept) for r in e.near_vectors(table(spark, repeated)).collect())
    assert [x[:2] for x in out] == [(-1, 0), (-1, 3), (-1, 3), (1, 3), (1, 3), (2, 0)]
    assert {x[2] for x in out if x[1] == 3} == {1} and [x[3] for x in out] == [False, False, False, True, True, True]
    assert e.near_vectors(table(spark, [])).count() == 0
