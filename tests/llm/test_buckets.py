"""Buckets checked together, few and many vectors each, against every pair on its own."""

import collections

import numpy as np
import pyarrow as pa

from courtlake.llm import embedding_dedup as e

RNG = np.random.default_rng(29)


def rows_of(n, dim, buckets, centres):
    """A row per vector and bucket that it is in, sorted as they arrive; vectors near one of the centres."""
    vectors = RNG.normal(size=(centres, dim))[RNG.integers(0, centres, n)] + RNG.normal(size=(n, dim)) * 0.05
    held = [sorted(set(RNG.integers(0, buckets, 6).tolist())) for _ in range(n)]
    rows = [(dim, b, 0, 0, k, v.tolist(), int(k % 3 + 1), h, 0) for k, (v, h) in enumerate(zip(vectors, held)) for b in h]
    rows += [(dim, 10**6, 0, 1, k, v.tolist(), 1, [*h, 10**6], k % 2) for k, (v, h) in enumerate(zip(vectors, held))]
    return sorted(rows, key=lambda r: (r[:4], RNG.random()))


def brute(rows):
    links, root = collections.Counter(), {}
    groups = collections.defaultdict(list)
    for r in rows:
        groups[r[:4]].append(r)
    for (dim, bucket, i, j), of in groups.items():
        for a, x in enumerate(of):
            for y in of[a + 1 :]:
                u, v = np.array(x[5]), np.array(y[5])
                first = min(set(x[7]) & set(y[7])) == bucket
                if first and (i == j or x[8] != y[8]) and u @ v / np.linalg.norm(u) / np.linalg.norm(v) >= 0.95:
                    links[dim, x[4]] += y[6]
                    links[dim, y[4]] += x[6]
                    root.setdefault((dim, bucket, i, j), []).append((x[4], y[4]))
    return links, root


def test_buckets_checked_together_count_each_pair_once():
    for rows in (rows_of(150, 8, 90, 30), rows_of(150, 8, 6, 4), rows_of(60, 5, 40, 9) + rows_of(60, 8, 3, 2)):
        names = ["dim", "bucket", "i", "j", "key", "vec", "copies", "buckets", "block"]
        kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.float64()), pa.int64(), pa.list_(pa.int64()), pa.int32()]
        table = pa.table([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names=names).combine_chunks()
        links, pairs = brute(rows)
        dims = sorted({r[0] for r in rows})
        out = list(e._checked(table, 0.95))
        assert len(out) == len(dims)  # one go a dimension, however many buckets
        for dim, b in zip(dims, out):
            got, forest = collections.Counter(), set()
            for key, n, root in zip(*(b.column(x).to_pylist() for x in ("key", "links", "root"))):
                got[dim, key] += n
                if root is not None:
                    forest.add((key, root))
            assert {k: n for k, n in got.items() if n} == {k: n for k, n in links.items() if k[0] == dim}
            want = {p for g, of in pairs.items() if g[0] == dim for p in of}
            assert components(forest) == components(want)


def components(edges):
    root = {x: x for p in edges for x in p}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    return {(a, b) for a, b in root.items() if a != b}
