"""Embedding near-dedup: cross-polytope hashing with multiprobe buckets.

A vector is normalised, turned by three rounds of random signs and a fast
Hadamard transform, and hashed to the nearest signed axis.  ``functions`` such
hashes make a table's bucket; every table also puts the vector into the buckets
that its next-nearest axes give (multiprobe on both sides).  Candidates are
pairs that share a bucket; each is verified by its cosine in double precision
and counted in the first bucket that the pair shares only.

A bucket is cut into blocks of ``BLOCK`` vectors, and pairs of blocks are
separate tasks, so a third of all vectors in one bucket do not meet in one task.
A pair of blocks returns link counts per vector and the edges of a spanning
forest, never pairs.

Buckets are found on keys alone; a vector travels only to the buckets that it
shares with another.  A table has so many functions that unrelated vectors seldom
share one, so that is about as often as a vector has near ones.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courtlake.llm import common as c
from courtlake.llm.components import connected_components, merge
from courtlake.llm.vectors import digest, matrix, usable

THRESHOLD, TABLES, PROBES, SEED = 0.95, 8, 3, 20240229
BLOCK = 1024
#: Rows compared with a block at once, and found pairs looked at together.
STRIP, PAIRS = 128, 1 << 13
#: Vectors of a bucket up to which it is compared along with others.
FEW = 24
_NONE = np.iinfo(np.int64).max


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row (length a power of two), orthonormal."""
    x = x.copy()
    n, h = x.shape[1], 1
    while h < n:
        x = x.reshape(len(x), -1, 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(-1, n)
        h *= 2
    return x / math.sqrt(n)


def bucket_codes(x: np.ndarray, tables: int, functions: int, probes: int, seed: int = SEED) -> np.ndarray:
    """(rows, tables, probes) bucket numbers; probe 0 is the vector's own bucket.

    The next probes change the one function whose next-nearest axis costs the
    least in distance.
    """
    n, d = x.shape
    width = 1 << max(1, (d - 1).bit_length())
    padded = np.zeros((n, width))
    padded[:, :d] = x
    signs = np.random.default_rng([seed, width]).choice([-1.0, 1.0], (tables, functions, 3, width))
    out = np.empty((n, tables, probes), np.int64)
    rows = np.arange(n)
    for t in range(tables):
        best, second, cost = [], [], []
        for f in range(functions):
            y = padded
            for r in range(3):
                y = hadamard(y * signs[t, f, r])
            size = np.abs(y)
            near = np.argpartition(-size, 1, axis=1)[:, :2] if width > 2 else np.argsort(-size, axis=1)[:, :2]
            swap = size[rows, near[:, 0]] < size[rows, near[:, 1]]
            near[swap] = near[swap][:, ::-1]
            code = 2 * near + (y[rows[:, None], near] < 0)
            best.append(code[:, 0])
            second.append(code[:, 1])
            cost.append(size[rows, near[:, 0]] - size[rows, near[:, 1]])
        own = np.zeros(n, np.int64)
        for b in best:
            own = own * (2 * width) + b
        out[:, t, 0] = own
        ranked = np.argsort(np.stack(cost, 1), axis=1, kind="stable")
        for p in range(1, probes):
            f = ranked[:, min(p, functions) - 1]
            scale = (2 * width) ** (functions - 1 - f)
            change = (np.stack(second, 1)[rows, f] - np.stack(best, 1)[rows, f]) * scale
            out[:, t, p] = own + change
    return out


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1 in double precision, however small or large they were."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def padded(lists: pa.ChunkedArray) -> np.ndarray:
    """Lists of numbers as rows; a shorter one is filled up with numbers that no other row has."""
    column = lists.combine_chunks()
    lengths = np.diff(column.offsets.to_numpy())
    out = -1 - np.arange(len(column) * int(lengths.max())).reshape(len(column), -1)
    out[np.arange(out.shape[1]) < lengths[:, None]] = column.flatten().to_numpy()
    return out


def earlier(codes: np.ndarray, bucket: int) -> np.ndarray:
    """As bits of each row, the buckets below ``bucket`` that two rows at least are in."""
    row, column = np.nonzero((codes >= 0) & (codes < bucket))
    _, number, rows = np.unique(codes[row, column], return_inverse=True, return_counts=True)
    shared = rows > 1
    kept = shared[number]
    row, number = row[kept], (np.cumsum(shared) - 1)[number[kept]]
    bits = np.zeros((len(codes), -(-int(shared.sum()) // 64)), np.uint64)
    np.bitwise_or.at(bits, (row, number >> 6), np.uint64(1) << (number & 63).astype(np.uint64))
    return bits


def _starts(table: pa.Table) -> np.ndarray:
    """Where each pair of blocks begins in the sorted rows."""
    of = np.stack([table.column(x).to_numpy().astype(np.int64) for x in ("dim", "bucket", "i", "j")])
    return np.flatnonzero(np.concatenate([[True], (of[:, 1:] != of[:, :-1]).any(0)]))


def _checked(table: pa.Table, threshold: float):
    """Link counts (``root`` null) and forest edges (``links`` 0) within each pair of blocks of the sorted rows."""
    dims = table.column("dim").to_numpy()
    edges = [*np.flatnonzero(np.concatenate([[True], dims[1:] != dims[:-1]])).tolist(), len(dims)]
    for low, high in zip(edges[:-1], edges[1:], strict=True):
        yield from _of_one_dim(table.slice(low, high - low).combine_chunks(), threshold)


def _of_one_dim(table: pa.Table, threshold: float):
    starts = np.append(_starts(table), table.num_rows)
    keys, block, copies, bucket, i, j = (table.column(x).to_numpy() for x in ("key", "block", "copies", "bucket", "i", "j"))
    x, codes = unit(matrix(table.column("vec"))), padded(table.column("buckets"))
    links, label = np.zeros(len(keys), np.int64), np.arange(len(keys))

    def count(u: np.ndarray, v: np.ndarray) -> None:
        np.add.at(links, u, copies[v])
        np.add.at(links, v, copies[u])

    # Most buckets hold a few vectors: all such of the rows at once, each row with the k-th after it.
    sizes = np.diff(starts)
    few = np.repeat(sizes <= FEW, sizes)
    group = np.repeat(np.arange(len(sizes)), sizes)
    for k in range(1, int(sizes[sizes <= FEW].max(initial=0))):
        at = np.flatnonzero(few[:-k] & (group[:-k] == group[k:]) & ((i == j)[:-k] | (block[:-k] != block[k:])))
        at = at[np.einsum("ij,ij->i", x[at], x[at + k]) >= threshold]
        for t in range(0, len(at), PAIRS):
            u, v = at[t : t + PAIRS], at[t : t + PAIRS] + k
            # A pair counts in the first bucket that it shares.
            both = (codes[u][:, :, None] == codes[v][:, None, :]).any(2)
            first = np.where(both, codes[u], _NONE).min(1) == bucket[u]
            count(u[first], v[first])
            label = merge(label, u[first], v[first])
    for g in np.flatnonzero(sizes > FEW):
        low, high = int(starts[g]), int(starts[g + 1])
        mine, bits = x[low:high], earlier(codes[low:high], int(bucket[low]))
        own = np.arange(len(mine))
        for s in range(0, len(mine), STRIP):  # a strip of rows at a time, so memory is bounded by STRIP * BLOCK
            near = mine[s : s + STRIP] @ mine[: s + STRIP].T >= threshold
            near &= np.tri(*near.shape, k=s - 1, dtype=bool)
            if i[low] != j[low]:
                near &= block[low + s : low + s + len(near), None] != block[None, low : low + near.shape[1]]
            a, b = np.nonzero(near)
            a += s
            for t in range(0, len(a), PAIRS):
                u, v = a[t : t + PAIRS], b[t : t + PAIRS]
                first = ~(bits[u] & bits[v]).any(1)
                count(low + u[first], low + v[first])
                own = merge(own, u[first], v[first])
        label[low:high] = low + own
    has = np.flatnonzero(links)
    moved = np.flatnonzero(label != np.arange(len(keys)))
    node, root = keys[moved], keys[label[moved]]
    yield pa.RecordBatch.from_arrays(
        [
            pa.array(np.concatenate([keys[has], node]), pa.int64()),
            pa.array(np.concatenate([links[has], np.zeros(len(node), np.int64)]), pa.int64()),
            pa.array([None] * len(has) + root.tolist(), pa.int64()),
        ],
        names=["key", "links", "root"],
    )


def functions_for(n: int, dim: int, probes: int) -> int:
    """So many hash functions per table that a bucket holds a quarter of an unrelated vector at any size."""
    return max(1, math.ceil(math.log(max(2, 4 * n * probes), 2 * (1 << max(1, (dim - 1).bit_length())))))


def near_vectors(
    rows: DataFrame, threshold: float = THRESHOLD, tables: int = TABLES, probes: int = PROBES, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """Links between vectors with a cosine of ``threshold`` or more, and their components.

    Returns one row per input row: ``vec_id``, ``n_links`` (other rows linked
    directly), ``component_id`` (smallest vec_id reachable), ``kept``
    (vec_id = component_id).

    * Vectors that are null, empty, zero or hold null or non-finite components
      link with nothing, nor do vectors of different length.
    * Equal vectors collapse before hashing and link with each other; rows that
      repeat a vec_id are vectors of their own.  A null vec_id ranks above all
      others and is never ``kept``.
    * Recall is that of the hashing (tested against brute force); no pair below
      the threshold is linked.
    * An empty table gives no rows; other columns are ignored.
    """
    spark = rows.sparkSession
    every = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vec"))
    linkable = F.coalesce(usable(F.col("vec")) & F.exists("vec", lambda x: x != 0), F.lit(False))
    links_with_none = every.filter(~linkable).select("vec_id", F.lit(0).cast("long").alias("links"), F.col("vec_id").alias("component"))
    hashed = every.filter(linkable).select("vec_id", "vec", F.size("vec").alias("dim"), *digest("vec"))
    same = ("dim", "d1", "d2")
    classes = hashed.groupBy(*same).agg(F.first("vec").alias("vec"), F.min("vec_id").alias("least"), F.count("*").alias("copies"))
    classes = c.materialise(classes.withColumn("key", F.monotonically_increasing_id()))
    sizes = {r["dim"]: r["n"] for r in classes.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    functions = {dim: functions_for(n, dim, probes) for dim, n in sizes.items()}

    def deal(batches):
        for b in batches:
            dims = b.column("dim").to_numpy()
            for d in np.unique(dims):
                part = b.take(pa.array(np.flatnonzero(dims == d)))
                codes = bucket_codes(unit(matrix(part.column("vec"))), tables, functions[int(d)], probes)
                numbered = (codes * tables + np.arange(tables)[None, :, None]).reshape(len(codes), -1)
                yield pa.RecordBatch.from_arrays([part.column("key"), part.column("dim"), pa.array(numbered.tolist(), pa.list_(pa.int64()))], names=["key", "dim", "buckets"])

    # Only keys and buckets meet here; the vectors stay where they are.
    entries = c.materialise(classes.select("key", "dim", "vec").mapInArrow(deal, "key long, dim int, buckets array<long>"))
    entries = entries.select("key", "dim", F.explode(F.array_distinct("buckets")).alias("bucket"))
    held = entries.groupBy("dim", "bucket").agg(F.count("*").alias("held")).filter("held > 1")
    shared = entries.join(held, ["dim", "bucket"])
    # A vector is fetched once, then goes along to each bucket that it shares with another, and there to every pair of
    # blocks that its own block is part of.
    of_key = shared.groupBy("key").agg(F.collect_list(F.struct("bucket", "held")).alias("shared"))
    met = classes.select("key", "dim", "vec", "copies").join(of_key, "key").withColumn("buckets", F.transform("shared", lambda x: x["bucket"]))
    met = met.withColumn("at", F.explode("shared")).withColumn("blocks", F.ceil(F.col("at.held") / BLOCK).cast("int"))
    met = met.withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("key", "dim", "vec", "copies", "buckets", F.col("at.bucket").alias("bucket"), "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))

    def verify(batches):
        """Pairs of blocks come one after the other; the last one of a batch may go on in the next."""
        held = None
        for b in batches:
            table = pa.Table.from_batches([b] if held is None else [*held.to_batches(), b]).combine_chunks()
            if table.num_rows:
                last = int(_starts(table)[-1])
                if last:
                    yield from _checked(table.slice(0, last), threshold)
                held = table.slice(last)
        if held is not None:
            yield from _checked(held, threshold)

    along = ["dim", "bucket", "i", "j"]
    met = met.repartition(c.shuffle_partitions(spark), *along).sortWithinPartitions(*along)
    checked = c.materialise(met.mapInArrow(verify, "key long, links long, root long"))
    counts = checked.filter("root is null").groupBy("key").agg(F.sum("links").alias("links"))
    parts = connected_components(checked.filter("root is not null").select(F.col("key").alias("a"), F.col("root").alias("b")))
    named = classes.select("key", *same, "least", "copies").join(parts.withColumnRenamed("node", "key"), "key", "left")
    named = named.withColumn("component", F.coalesce("component", "key")).join(counts, "key", "left")
    smallest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.join(smallest, "component").select(
        *same, (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.col("component_id").alias("component")
    )
    out = hashed.select("vec_id", *same).join(named, list(same)).select("vec_id", "links", "component").unionByName(links_with_none)
    return out.select(
        "vec_id",
        F.col("links").cast("long").alias("n_links"),
        F.col("component").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.col("component"), F.lit(False)).alias("kept"),
    )
