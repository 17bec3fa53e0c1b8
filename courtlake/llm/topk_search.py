"""Exact top-k inner-product search with vector-approximation files.

Vectors are turned to integers, floor(scale * x).  The approximation file keeps
one byte per component, its cell between quantiles fitted on a bounded sample;
every row is in it.  Each cell's true extent over all rows is known, so a row's
cells bound its score with any query from above and below.

1. **Scan**: query blocks and fragments of the file meet on a grid.  Only bytes
   travel to it, each side as often as the other has blocks; no side is
   broadcast.  A task goes through its fragment in slices and carries the k
   best lower bounds of each query along, so a slice yields only rows whose
   upper bound reaches them.
2. **Prune**: over all fragments, a query's k-th best lower bound drops every
   row whose upper bound is below it.
3. **Read**: the exact vectors of the rows left are fetched and read in the
   order of their upper bounds until the k-th exact score is above the next
   one's bound.

Equal vectors score alike, so of a group of copies only the first k + 1 ids go
into the file, and equal queries are asked once, for k + 1 rows: each takes the
first k that are not itself.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from courtlake.llm import common as c
from courtlake.llm.vectors import digest, matrix, valid_vectors

SCALE, EVERY, K = 256, 50, 5
CELLS = 256
#: Rows on which the cells' edges are fitted; the result does not depend on it.
SAMPLE = 4096
QUERY_BLOCK, FRAGMENT = 1024, 65536
#: Rows and queries bounded at once.
_SLICE, _ASKED = 2048, 128
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


def cell_edges(vectors: DataFrame) -> np.ndarray:
    """(CELLS - 1, dim) quantiles of a bounded sample."""
    x = matrix(vectors.select("vec").limit(SAMPLE).toArrow().column("vec"))
    return np.quantile(x, np.arange(1, CELLS) / CELLS, axis=0, method="lower")


def approximate(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """The cell of each component: how many edges are at or below it."""
    return np.stack([np.searchsorted(edges[:, d], x[:, d], side="right") for d in range(x.shape[1])], 1).astype(np.uint8)


def extents(x: np.ndarray, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(CELLS, dim) least and largest component found in each cell; inf and -inf where none is."""
    low, high = np.full((CELLS, x.shape[1]), np.inf), np.full((CELLS, x.shape[1]), -np.inf)
    at = np.broadcast_to(np.arange(x.shape[1]), x.shape)
    np.minimum.at(low, (cells, at), x)
    np.maximum.at(high, (cells, at), x)
    return low, high


def score_bounds(queries: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of each query's score with each row, rounded outwards."""
    up, down = np.maximum(queries, 0), np.minimum(queries, 0)
    with np.errstate(over="ignore", invalid="ignore"):
        lower, upper = up @ low.T + down @ high.T, up @ high.T + down @ low.T
        # More than the rounding errors of sums of so many products, whatever their order.
        slack = np.abs(queries) @ np.maximum(np.abs(low), np.abs(high)).T * (4 * queries.shape[1] * np.finfo(float).eps)
        return np.nan_to_num(lower - slack, nan=-np.inf, neginf=-np.inf), np.nan_to_num(upper + slack, nan=np.inf, posinf=np.inf)


def whole_numbers(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x), exactly: 64-bit where that holds all of them, else Python's integers."""
    with np.errstate(over="ignore"):
        floored = np.floor(x * scale)
    if not x.size or np.abs(floored).max() < 2.0**62:
        return floored.astype(np.int64)
    return np.array([[int(f) if math.isfinite(f) else int(v) * scale for f, v in zip(fs, vs, strict=True)] for fs, vs in zip(floored, x, strict=True)], object)


def exact_scores(rows: np.ndarray, query: np.ndarray, scale: int) -> list[int]:
    """Integer inner products of each row with the query, of any size."""
    a, b = whole_numbers(rows, scale), whole_numbers(query[None], scale)[0]
    if a.dtype != object and b.dtype != object and a.size:
        if int(np.abs(a).max()) * int(np.abs(b).max()) * a.shape[1] > _MOST:
            a, b = a.astype(object), b.astype(object)
    return [int(s) for s in a @ b]


def scan_fragment(queries: np.ndarray, cells_of: np.ndarray, low: np.ndarray, high: np.ndarray, k: int):
    """(query, row, lower, upper) of what may be among the k best of this fragment."""
    at = np.arange(low.shape[1])
    found = []
    for a in range(0, len(queries), _ASKED):
        some = queries[a : a + _ASKED]
        best = np.full((len(some), k), -np.inf)  # the k best lower bounds so far
        parts = []
        for b in range(0, len(cells_of), _SLICE):
            cells = cells_of[b : b + _SLICE]
            lower, upper = score_bounds(some, low[cells, at], high[cells, at])
            best = -np.partition(-np.concatenate([best, lower], 1), k - 1, axis=1)[:, :k]
            q, r = np.nonzero(upper >= best.min(1)[:, None])
            parts.append((a + q, b + r, lower[q, r], upper[q, r]))
        q, r, lower, upper = (np.concatenate(x) for x in zip(*parts, strict=True))
        late = upper >= best.min(1)[q - a]  # slices seen before the bound rose
        found.append((q[late], r[late], lower[late], upper[late]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def top_k(
    rows: DataFrame, k: int = K, every: int = EVERY, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """The ``k`` highest integer inner products of each query among all other rows.

    Queries are the rows whose id is divisible by ``every``.  Returns
    ``query_id``, ``rank`` (from 1), ``vec_id``, ``score``; ties go to the
    smaller vec_id; fewer rows if there are fewer others.

    * Vectors that are null or empty or hold null or non-finite components take
      no part, nor do rows without an id.
    * Vectors meet only those of their own length.
    * Rows that repeat an id are rows of their own: each such query is asked and
      answered for itself, and only the very row that asks is left out.
    * Scores are exact integers of any size; one beyond 64 bits ranks by its
      true value and is returned as the nearest 64-bit number.
    * An empty table gives no rows; other columns are ignored.
    """
    spark = rows.sparkSession
    vectors = valid_vectors(rows, id_col, vector_col).filter("vec_id is not null")
    vectors = vectors.select(F.monotonically_increasing_id().alias("key"), "vec_id", "vec", F.size("vec").alias("dim"), *digest("vec"))
    vectors = c.materialise(vectors)
    same = ("dim", "d1", "d2")
    among_copies = F.row_number().over(Window.partitionBy(*same).orderBy("vec_id", "key"))
    file = vectors.withColumn("place", among_copies).filter(F.col("place") <= k + 1).drop("place")
    queries = vectors.filter(F.col("vec_id") % every == 0).select("key", "vec_id", *same)
    asked = vectors.filter(F.col("vec_id") % every == 0).groupBy(*same).agg(F.min("key").alias("query"), F.first("vec").alias("vec"))
    file, asked = c.materialise(file), c.materialise(asked)
    sizes = {r["dim"]: r["n"] for r in file.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    out = None
    for r in sorted(asked.groupBy("dim").agg(F.count("*").alias("q")).collect()):
        of_dim = F.col("dim") == r["dim"]
        found = _search(file.filter(of_dim).select("key", "vec_id", "vec"), asked.filter(of_dim).select("query", "vec"), sizes[r["dim"]], r["q"], k + 1, scale, c.shuffle_partitions(spark))
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    put = queries.join(asked.select("query", *same), list(same)).select("query", F.col("key").alias("own"), F.col("vec_id").alias("query_id"))
    others = out.join(put, "query").filter(F.col("key") != F.col("own"))
    rank = F.row_number().over(Window.partitionBy("own").orderBy("rank"))
    return others.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _search(vectors: DataFrame, queries: DataFrame, n: int, q: int, k: int, scale: int, least: int) -> DataFrame:
    """(query, key, vec_id, rank, score) of the k best rows of ``vectors`` for each of the ``queries``."""
    edges = cell_edges(vectors)
    dim = edges.shape[1]

    def index(batches):
        low, high = np.full((CELLS, dim), np.inf), np.full((CELLS, dim), -np.inf)
        for b in batches:
            x = matrix(b.column("vec"))
            found = extents(x, approximate(x, edges))
            low, high = np.minimum(low, found[0]), np.maximum(high, found[1])
        yield pa.RecordBatch.from_arrays([pa.array([x.ravel()], pa.list_(pa.float64())) for x in (low, high)], names=["low", "high"])

    # CELLS * dim rows, whatever the number of vectors.
    parts = vectors.select("vec").mapInArrow(index, "low array<double>, high array<double>").select(F.posexplode(F.arrays_zip("low", "high")).alias("at", "x"))
    found = parts.groupBy("at").agg(F.min("x.low").alias("low"), F.max("x.high").alias("high")).toArrow().sort_by("at")
    low, high = (found.column(name).to_numpy().reshape(CELLS, dim) for name in ("low", "high"))
    # The integers lie between the floors of the extents.
    with np.errstate(over="ignore"):
        low, high = np.floor(low * scale), np.floor(high * scale)

    def encode(batches):
        for b in batches:
            cells = approximate(matrix(b.column("vec")), edges)
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array([r.tobytes() for r in cells], pa.binary())], names=["key", "cells"])

    blocks = math.ceil(q / QUERY_BLOCK)
    fragments = max(math.ceil(n / FRAGMENT), min(math.ceil(least / blocks), math.ceil(n / _SLICE)))
    cell = (F.col("i") * fragments + F.col("j")).alias("cell")
    asked = (
        queries.withColumn("i", F.pmod(F.xxhash64("query"), F.lit(blocks)))
        .withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(fragments - 1))))
        .select(cell, F.col("query").alias("key"), "vec", F.lit(None).cast("binary").alias("cells"))
    )
    file = vectors.select("key", "vec").mapInArrow(encode, "key long, cells binary")
    filed = (
        file.withColumn("j", F.pmod(F.xxhash64("key"), F.lit(fragments)))
        .withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        .select(cell, "key", F.lit(None).cast("array<double>").alias("vec"), "cells")
    )

    def scan(table: pa.Table) -> pa.Table:
        is_query = table.column("cells").is_null().to_numpy(zero_copy_only=False)
        keys, mask = table.column("key").to_numpy(), pa.array(is_query)
        with np.errstate(over="ignore"):
            some = np.floor(matrix(table.column("vec").filter(mask)) * scale)
        blob = b"".join(table.column("cells").drop_null().to_pylist())
        cells_of = np.frombuffer(blob, np.uint8).reshape(-1, dim)
        if not len(some) or not len(cells_of):
            empty = np.empty(0)
            return pa.table({"query": pa.array(empty, pa.int64()), "key": pa.array(empty, pa.int64()), "lower": empty, "upper": empty})
        q_at, r_at, lower, upper = scan_fragment(some, cells_of, low, high, k)
        return pa.table({"query": keys[is_query][q_at], "key": keys[~is_query][r_at], "lower": lower, "upper": upper})

    met = asked.union(filed).groupBy("cell").applyInArrow(scan, "query long, key long, lower double, upper double")
    ranked = met.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(F.col("lower").desc(), "key")))
    bar = F.min(F.when(F.col("place") <= k, F.col("lower"))).over(Window.partitionBy("query"))
    left = ranked.withColumn("bar", bar).filter(F.col("upper") >= F.col("bar")).select("query", "key", "upper")

    fetched = left.join(vectors, "key").join(queries.withColumnRenamed("vec", "query_vec"), "query")

    def read(table: pa.Table) -> pa.Table:
        upper, ids, keys, x = table.column("upper").to_numpy(), table.column("vec_id").to_numpy(), table.column("key").to_numpy(), matrix(table.column("vec"))
        query = np.array(table.column("query_vec")[0].as_py())
        order = np.argsort(-upper, kind="stable")
        best: list[tuple[int, int, int]] = []
        for b in range(0, len(order), 4 * k):
            if len(best) == k and upper[order[b]] < -best[-1][0]:
                break
            rows = order[b : b + 4 * k]
            best = sorted([*best, *zip((-s for s in exact_scores(x[rows], query, scale)), ids[rows].tolist(), keys[rows].tolist(), strict=True)])[:k]
        return pa.table(
            {
                "query": pa.array([table.column("query")[0].as_py()] * len(best), pa.int64()),
                "key": pa.array([key for _, _, key in best], pa.int64()),
                "vec_id": pa.array([i for _, i, _ in best], pa.int64()),
                "rank": pa.array(range(1, len(best) + 1), pa.int32()),
                "score": pa.array([max(_LEAST, min(_MOST, -s)) for s, _, _ in best], pa.int64()),
            }
        )

    return fetched.groupBy("query").applyInArrow(read, "query long, key long, vec_id long, rank int, score long")
