"""The tree over blocks of a large cluster: it loses no link, and it prunes."""

import numpy as np
import pyarrow as pa
import pytest

from courtlake.llm import ngram_join as j

RNG = np.random.default_rng(23)


def linked(a, b, percent=75):
    both = len(a & b)
    return both and 100 * both >= percent * len(a | b)


def components(sets):
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(sets)):
        for b in range(a):
            if linked(sets[a], sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(sets))]


def one_cluster(groups, copies, length):
    """Texts that all share rare shingles, in groups of near copies of very different sizes."""
    head = [f"h{i}" for i in range(12)]
    texts = []
    for g in range(groups):
        base = head + [f"g{g}w{i}" for i in range(length * (1 + g))]
        for k in range(copies):
            w = list(base)
            for at in RNG.choice(len(w) - 12, int(RNG.integers(0, 1 + len(w) // 40)), replace=False):
                w[12 + at] = f"n{g}_{k}_{at}"
            texts.append(" ".join(w))
    return texts


@pytest.mark.parametrize("top", [1, 64])
def test_a_large_cluster_through_all_levels(spark, monkeypatch, top):
    for name, value in (("CLUSTER_SETS", 20), ("BLOCK_SETS", 4), ("FAN_BITS", 1), ("TOP_NODES", top)):
        monkeypatch.setattr(j, name, value)
    texts = one_cluster(5, 14, 40)
    words = [t.split() for t in texts]
    want = components([{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in words])
    rows = [(i, t) for i, t in enumerate(texts)]
    got = {r.doc_id: r.component_id for r in j.ngram_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(texts))] == want and len(set(want)) >= 5


def test_node_pairs_without_a_link_are_pruned_and_others_never():
    def node(sets):
        bitmap, crowd = j.signature(sets)
        return {"low": min(map(len, sets)), "high": max(map(len, sets)), "crowd": crowd, "bitmap": bitmap}

    draw = lambda n, of: np.unique(RNG.choice(of, n, replace=False))
    worlds = [RNG.integers(0, 2**63, 400).astype(np.uint64) for _ in range(4)]
    blocks = [[draw(int(RNG.integers(lo, hi)), worlds[w]) for _ in range(16)] for w in range(4) for lo, hi in ((60, 70), (150, 170), (360, 400))]
    nodes = [node(b) for b in blocks]
    pairs = [(x, y) for x in range(len(nodes)) for y in range(x)]
    table = pa.table({f"{k}_{s}": pa.array([nodes[p[e]][k] for p in pairs]) for e, s in enumerate("ij") for k in nodes[0]})
    kept = j.possible(table, 75)
    for (x, y), k in zip(pairs, kept):
        if any(linked(set(a.tolist()), set(b.tolist())) for a in blocks[x] for b in blocks[y]):
            assert k
    # Of 66 pairs of nodes, those of other sizes or of other worlds go.
    assert kept.sum() <= 12


def test_traversal_verifies_few_pairs():
    worlds = [RNG.integers(0, 2**63, 300).astype(np.uint64) for _ in range(16)]
    sets = [np.unique(RNG.choice(w, 299, replace=False)) for w in worlds for _ in range(16)]
    tree = j._Links(np.array([len(s) for s in sets]), sets, 75)
    looked = []
    leaves = tree.leaves
    tree.leaves = lambda x, y: (looked.append((x, y)), leaves(x, y))
    tree.run()
    assert len({tree.find(i) for i in range(len(sets))}) == 16
    # 256 sets are 136 pairs of leaves of 16; sets of one world lie together, so few pairs of leaves are left.
    assert len(looked) <= 40


def test_null_repeated_ids_and_clashing_columns(spark):
    same = " ".join(f"w{i}" for i in range(30))
    rows = [(7, same, 1), (7, same, 1), (3, same, 1), (None, same, 1), (None, " ".join(f"x{i}" for i in range(30)), 1), (None, None, 1), (4, "", 1), (4, None, 1)]
    got = j.ngram_components(spark.createDataFrame(rows, "doc_id long, text string, n int").repartition(3)).collect()
    assert sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1, r.n_copies) for r in got) == sorted(
        [(7, 26, 3, 4), (7, 26, 3, 4), (3, 26, 3, 4), (-1, 26, 3, 4), (-1, 26, -1, 1), (-1, 0, -1, 1), (4, 0, 4, 1), (4, 0, 4, 1)]
    )
