"""N-gram Jaccard join with signature trees.

Documents are sets of word shingles; two link when
``100 * |x & y| >= percent * |x | y|``.

1. Equal sets collapse to one representative, by digest.
2. A hash exchange finds how many representatives hold each shingle.  A set
   needs ``percent`` of its shingles shared with others to link at all; the
   rest of the corpus drops out here, exactly.
3. The rarest shared shingles (prefix filter) gather the survivors into
   clusters outside of which no link is possible.
4. In each cluster a signature tree is built: leaves of similar sets, nodes
   with the OR of their token bitmaps and the range of their sizes.  A dual
   traversal drops pairs of nodes whose greatest possible overlap is too small,
   or that are in one component already, and verifies what is left exactly.
   Large clusters are first compared with a pivot, then range-sorted by size and
   cut into blocks; above the blocks the tree's levels are tables, whose node
   pairs are pruned from the top down before the traversal goes on inside.
5. Components over the links.

Nothing is lost: steps 2 and 3 are exact filters and 4 verifies whole sets.
Pairs inside a component are not listed, which is what keeps a group of
thousands of near copies from making millions of rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courtlake.llm import common as c
from courtlake.llm.components import connected_components

WORDS, PERCENT = 5, 75
#: Sets in one traversal; a larger cluster is cut into blocks.
CLUSTER_SETS, BLOCK_SETS = 1024, 256
#: Nodes under one of the next level (a power of two), and nodes of a cluster at which the tree has its top.
FAN_BITS, TOP_NODES = 4, 256
#: Blocks on a side of a tile (a power of two).
TILE_BITS = 2
_KEY_BITS = 52
_WORDS64 = 64  # 4096-bit signatures


def _sets(blob: bytes, words: int, cache: c.WordHashes, only: np.ndarray | None = None) -> tuple[pa.Array, list[np.ndarray | None]]:
    """Sorted distinct shingle hashes of each document (of those in ``only``)."""
    ids, texts = c.unpack(blob)
    wanted = np.ones(len(texts), bool) if only is None else np.isin(np.arange(len(texts)), only)
    split = [(t.lower().split() if t else []) if w else [] for t, w in zip(texts, wanted, strict=True)]
    lengths = np.array([len(s) for s in split], np.int64)
    hashes = np.concatenate([c.hash_words(s, cache) for s in split]) if split else np.empty(0, np.uint64)
    runs = c.window_hashes(hashes, words)
    out: list[np.ndarray | None] = []
    for begin, n, w in zip(np.cumsum(lengths) - lengths, lengths, wanted, strict=True):
        if not w:
            out.append(None)
        elif n >= words:
            out.append(np.unique(runs[begin : begin + n - words + 1]))
        elif n:
            out.append(c.mix(c.window_hashes(hashes[begin : begin + n], int(n)) + np.uint64(n)))
        else:
            out.append(np.empty(0, np.uint64))
    return ids, out


def least_overlap(size: int, percent: int) -> int:
    """Shingles that a set must share with another to link with it."""
    return -(-percent * size // 100)


class _Links:
    """Union-find over the sets of one traversal, and the signature tree's nodes."""

    def __init__(self, sizes: np.ndarray, tokens: list[np.ndarray], percent: int, same: np.ndarray | None = None):
        self.percent, self.root = percent, list(range(len(sizes)))
        flat = np.concatenate(tokens)
        owner = np.repeat(np.arange(len(tokens)), [len(t) for t in tokens])
        least = np.array([int(c.mix(t).min()) if len(t) else 0 for t in tokens], np.uint64)
        self.order = np.lexsort((sizes, least))
        place = np.empty(len(sizes), np.int64)
        place[self.order] = np.arange(len(sizes))
        self.sizes = sizes[self.order].astype(np.int64)
        number = np.unique(flat, return_inverse=True)[1]
        ends = np.cumsum([len(t) for t in tokens])
        self.sets = [frozenset(number[ends[i] - len(tokens[i]) : ends[i]].tolist()) for i in self.order]
        shared = np.array([len(s) for s in self.sets], np.int64)
        self.outside = self.sizes - shared  # shingles that no other set holds
        bit = (flat >> np.uint64(52)).astype(np.int64)
        self.bitmaps = np.zeros((len(sizes), _WORDS64), np.uint64)
        np.bitwise_or.at(self.bitmaps, (place[owner], bit >> 6), np.uint64(1) << (bit & 63).astype(np.uint64))
        crowd = np.bincount(owner * (64 * _WORDS64) + bit, minlength=0)
        most = int(crowd.max()) if len(crowd) else 0
        if same is not None:
            first: dict[int, int] = {}
            for i, s in enumerate(same[self.order].tolist()):
                if s >= 0:
                    self.union(first.setdefault(s, i), i)
        self.levels = [(self.bitmaps, self.sizes, self.sizes)]
        while len(self.levels[-1][1]) > 1:
            maps, low, high = self.levels[-1]
            cut = np.arange(0, len(low), 16)
            self.levels.append((np.bitwise_or.reduceat(maps, cut), np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut)))
        self.crowd, self.links, self.whole = most, [], set()

    def find(self, i: int) -> int:
        root = self.root
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def union(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        if i == j:
            return False
        self.root[max(i, j)] = min(i, j)
        return True

    def label(self, level: int, node: int) -> int:
        """The component of all sets below, or -1 if they have several."""
        span = 16**level
        low, high = node * span, min((node + 1) * span, len(self.sizes))
        if (level, node) not in self.whole:
            first = self.find(low)
            if any(self.find(i) != first for i in range(low + 1, high)):
                return -1
            self.whole.add((level, node))
        return self.find(low)

    def hopeless(self, level: int, i: int, j: int) -> bool:
        maps, low, high = self.levels[level]
        if 100 * high[i] < self.percent * low[j] or 100 * high[j] < self.percent * low[i]:
            return True
        overlap = int(np.bitwise_count(maps[i] & maps[j]).sum()) * self.crowd
        if overlap * (100 + self.percent) < self.percent * (low[i] + low[j]):
            return True
        a = self.label(level, i)
        return a >= 0 and a == self.label(level, j)

    def run(self) -> list[tuple[int, int]]:
        stack = [(len(self.levels) - 1, 0, 0)]
        while stack:
            level, i, j = stack.pop()
            if self.hopeless(level, i, j):
                continue
            if level > 1:
                below = len(self.levels[level - 1][1])
                kids = [range(16 * k, min(16 * k + 16, below)) for k in (i, j)]
                stack += [(level - 1, x, y) for x in kids[0] for y in kids[1] if i != j or x <= y][::-1]
            else:
                self.leaves(16 * i, 16 * j)
        return [(int(self.order[x]), int(self.order[y])) for x, y in self.links]

    def leaves(self, i: int, j: int) -> None:
        stop = min(j + 16, len(self.sizes))
        for x in range(i, min(i + 16, len(self.sizes))):
            start = max(j, x + 1)
            if start >= stop:
                continue
            other = self.bitmaps[start:stop]
            n, m = self.sizes[x], self.sizes[start:stop]
            # A bit that only one side has stands for a shingle that the other lacks.
            miss = np.bitwise_count(self.bitmaps[x] & ~other).sum(1) + self.outside[x]
            lack = np.bitwise_count(other & ~self.bitmaps[x]).sum(1) + self.outside[start:stop]
            most = np.minimum(n - miss, m - lack)
            for y in start + np.flatnonzero(most * (100 + self.percent) >= self.percent * (n + m)):
                y = int(y)
                if self.find(x) != self.find(y):
                    both = len(self.sets[x] & self.sets[y])
                    if 100 * both >= self.percent * (int(self.sizes[x] + self.sizes[y]) - both):
                        self.union(x, y)
                        self.links.append((x, y))


def tree_links(keys: np.ndarray, sizes: np.ndarray, tokens: list[np.ndarray], percent: int, same: np.ndarray | None = None) -> pa.Table:
    """Links that connect the sets as all links would; ``same`` numbers sets known to be connected (-1: unknown)."""
    if len(keys) < 2:
        pairs = []
    else:
        pairs = _Links(sizes, tokens, percent, same).run()
    return pa.table({"a": pa.array(keys[[p[0] for p in pairs]] if pairs else [], pa.int64()), "b": pa.array(keys[[p[1] for p in pairs]] if pairs else [], pa.int64())})


def _tokens(column) -> list[np.ndarray]:
    return [np.frombuffer(b, np.uint64) for b in column.to_pylist()]


def _linked(one: np.ndarray, n: int, other: np.ndarray, m: int, percent: int) -> bool:
    both = len(np.intersect1d(one, other, assume_unique=True))
    return 100 * both >= percent * (n + m - both)


def signature(tokens: list[np.ndarray]) -> tuple[bytes, int]:
    """OR of the sets' token bitmaps, and how many tokens of one set share a bit at most."""
    bitmap, crowd = np.zeros(64 * _WORDS64, bool), 0
    for t in tokens:
        bit = (t >> np.uint64(52)).astype(np.int64)
        bitmap[bit] = True
        crowd = max(crowd, int(np.bincount(bit).max()) if len(bit) else 0)
    return np.packbits(bitmap).tobytes(), crowd


def possible(pairs: pa.RecordBatch | pa.Table, percent: int) -> np.ndarray:
    """Which pairs of nodes (columns ending in _i and _j) may hold linked sets, by their greatest possible overlap."""
    low_i, low_j, high_i, high_j, crowd_i, crowd_j = (pairs.column(x).to_numpy().astype(np.int64) for x in ("low_i", "low_j", "high_i", "high_j", "crowd_i", "crowd_j"))
    maps = [np.frombuffer(b"".join(pairs.column(x).to_pylist()), np.uint64).reshape(-1, _WORDS64) for x in ("bitmap_i", "bitmap_j")]
    overlap = np.bitwise_count(maps[0] & maps[1]).sum(1).astype(np.int64) * np.minimum(crowd_i, crowd_j)
    sizes = (100 * high_i >= percent * low_j) & (100 * high_j >= percent * low_i)
    return sizes & (overlap * (100 + percent) >= percent * (low_i + low_j))


_NODE = "cluster long, near boolean, node long, low int, high int, crowd int, bitmap binary"
_BLOCK = ["cluster", "near", "node", "low", "high", "crowd", "bitmap", "hub", "keys", "blob"]


def _parents(nodes: DataFrame) -> DataFrame:
    """One level up: every ``FAN`` nodes that follow each other, with the OR of their bitmaps and the range of their sizes."""

    def merge(table: pa.Table) -> pa.Table:
        maps = np.frombuffer(b"".join(table.column("bitmap").to_pylist()), np.uint64).reshape(-1, _WORDS64)
        row = {x: table.column(x)[:1] for x in ("cluster", "near", "node")}
        row |= {x: pa.array([f(table.column(x).to_numpy())], pa.int32()) for x, f in (("low", np.min), ("high", np.max), ("crowd", np.max))}
        return pa.table(row | {"bitmap": pa.array([np.bitwise_or.reduce(maps).tobytes()])})

    up = nodes.withColumn("node", F.shiftright("node", FAN_BITS))
    return up.groupBy("cluster", "near", "node").applyInArrow(merge, _NODE)


def _node_pairs(level: DataFrame, above: DataFrame | None, percent: int) -> DataFrame:
    """Pairs of this level's nodes that may hold linked sets, below the pairs found ``above``, or all of a cluster if there are none."""
    of = level.columns[1:]
    left = level.select("cluster", *(F.col(x).alias(f"{x}_i") for x in of))
    right = level.select("cluster", *(F.col(x).alias(f"{x}_j") for x in of))
    if above is None:
        met = left.join(right, "cluster")
    else:
        up = [F.col(f"{x}_{s}").alias(f"up_{x}_{s}") for s in "ij" for x in ("near", "node")]
        met = above.select("cluster", *up)
        for side, table in (("i", left), ("j", right)):
            parent = table.withColumn(f"up_near_{side}", F.col(f"near_{side}")).withColumn(f"up_node_{side}", F.shiftright(f"node_{side}", FAN_BITS))
            met = met.join(parent, ["cluster", f"up_near_{side}", f"up_node_{side}"])
    # Sets linked through the pivot are in one component: no pair of them is looked at.
    met = met.filter("not (near_i and near_j) and (near_i < near_j or (near_i = near_j and node_i <= node_j))")
    met = met.filter(f"100L * high_i >= {percent}L * low_j and 100L * high_j >= {percent}L * low_i")
    columns = ["cluster", "near_i", "node_i", "near_j", "node_j", *(f"{x}_{s}" for x in ("low", "high", "crowd", "bitmap") for s in "ij")]

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(possible(b, percent))).select(columns[:5])

    return met.select(*columns).mapInArrow(prune, "cluster long, near_i boolean, node_i long, near_j boolean, node_j long")


def _large_clusters(large: DataFrame, percent: int) -> DataFrame:
    """Links in clusters too large for one traversal.

    All sets are compared with one of them, the pivot.  The others and those linked with it are range-sorted by size and
    least token and cut into blocks, the lowest nodes of a tree whose levels are distributed tables.  The dual traversal
    goes down from pairs of the highest nodes on bitmaps and size ranges alone; only the blocks of pairs left at the end
    fetch their sets, tile by tile.
    """
    spark = large.sparkSession
    parts = c.shuffle_partitions(spark)
    pivot = large.groupBy("cluster").agg(F.min_by(F.struct("key", "n", "tokens"), "key").alias("pivot"))

    def against_pivot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near, least = [], []
            for n, t, p in zip(b.column("n").to_pylist(), b.column("tokens").to_pylist(), b.column("pivot").to_pylist(), strict=True):
                mine = np.frombuffer(t, np.uint64)
                near.append(_linked(mine, n, np.frombuffer(p["tokens"], np.uint64), p["n"], percent))
                least.append(int(c.mix(mine).min() >> np.uint64(1)) if len(mine) else 0)
            pivots = pa.array([p["key"] for p in b.column("pivot").to_pylist()], pa.int64())
            columns = [b.column("cluster"), b.column("key"), b.column("n"), b.column("tokens"), pivots, pa.array(near, pa.bool_()), pa.array(least, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["cluster", "key", "n", "tokens", "hub", "near", "least"])

    marked = large.join(pivot, "cluster").mapInArrow(against_pivot, "cluster long, key long, n int, tokens binary, hub long, near boolean, least long")
    order = ["cluster", "near", "n", "least", "key"]

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks of BLOCK_SETS sets at most that follow each other in the sort, numbered along it."""
        node, held = TaskContext.get().partitionId() << 22, []

        def emit() -> pa.RecordBatch:
            nonlocal node, held
            table = pa.Table.from_batches(held).combine_chunks()
            n = table.column("n").to_numpy()
            bitmap, crowd = signature(_tokens(table.column("tokens")))
            row = {x: table.column(x)[:1].combine_chunks() for x in ("cluster", "near", "hub")} | {
                "node": pa.array([node], pa.int64()), "low": pa.array([int(n.min())], pa.int32()), "high": pa.array([int(n.max())], pa.int32()), "crowd": pa.array([crowd], pa.int32()),
                "bitmap": pa.array([bitmap], pa.binary()), "keys": pa.array([table.column("key").to_numpy()], pa.list_(pa.int64())), "blob": pa.array([c._ipc(table.select(["key", "n", "tokens"]))], pa.binary()),
            }
            node, held = node + 1, []
            return pa.RecordBatch.from_arrays([row[x] for x in _BLOCK], names=_BLOCK)

        for b in batches:
            group = np.array([b.column("cluster").to_numpy(), b.column("near").to_numpy(zero_copy_only=False).astype(np.int64)])
            at = 0
            while at < b.num_rows:
                if held and (held[0].column("cluster")[0], held[0].column("near")[0]) != (b.column("cluster")[at], b.column("near")[at]):
                    yield emit()
                other = np.flatnonzero((group[:, at:] != group[:, [at]]).any(0))
                room = BLOCK_SETS - sum(h.num_rows for h in held)
                size = min(room, int(other[0]) if len(other) else b.num_rows - at)
                held.append(b.slice(at, size))
                at += size
                if size == room:
                    yield emit()
        if held:
            yield emit()

    along = marked.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    blocks = c.materialise(along.mapInArrow(build, _NODE + ", hub long, keys array<long>, blob binary"))
    levels = [blocks.drop("blob", "keys", "hub")]
    while levels[-1].groupBy("cluster").count().filter(F.col("count") > TOP_NODES).limit(1).count() and len(levels) < 12:
        levels.append(c.materialise(_parents(levels[-1])))
    pairs = None
    for level in reversed(levels):
        pairs = c.materialise(_node_pairs(level, pairs, percent))
    # Pairs go in tiles of TILE x TILE blocks, so that a block's sets are copied once per tile, not once per pair.
    tile = ["cluster", "near_i", "tile_i", "near_j", "tile_j"]
    tiled = pairs.withColumns({f"tile_{x}": F.shiftright(f"node_{x}", TILE_BITS) for x in "ij"})
    ends = [tiled.select(*tile, F.col(f"near_{x}").alias("near"), F.col(f"node_{x}").alias("node")) for x in "ij"]
    fetched = ends[0].union(ends[1]).distinct().join(blocks.select("cluster", "near", "node", "blob"), ["cluster", "near", "node"])
    none = F.lit(None)
    met = fetched.select(*tile, "near", "node", "blob", none.cast("long").alias("i"), none.cast("long").alias("j")).union(
        tiled.select(*tile, none.cast("boolean"), none.cast("long"), none.cast("binary"), "node_i", "node_j")
    )

    def traverse(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        near = {s: rows[0][f"near_{s}"] for s in "ij"}
        sets = {(r["near"], r["node"]): pa.ipc.open_stream(r["blob"]).read_all() for r in rows if r["blob"] is not None}
        links = []
        for r in rows:
            if r["blob"] is None:
                one = near["i"] == near["j"] and r["i"] == r["j"]
                sides = [(near["i"], r["i"])] if one else [(near["i"], r["i"]), (near["j"], r["j"])]
                both = pa.concat_tables([sets[s] for s in sides])
                same = np.concatenate([np.full(sets[s].num_rows, 0 if s[0] else -1) for s in sides])
                links.append(tree_links(both.column("key").to_numpy(), both.column("n").to_numpy(), _tokens(both.column("tokens")), percent, same))
        return pa.concat_tables(links) if links else pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})

    found = met.groupBy(*tile).applyInArrow(traverse, "a long, b long")
    return found.union(blocks.filter("near").select(F.explode("keys").alias("a"), F.col("hub").alias("b")))


def _components(docs: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """The packed chunks, and a row per document: doc_id, key, n, component_id, class_id, n_copies, group (equal for one component)."""
    spark = docs.sparkSession
    chunks = c.pack_documents(docs)
    buckets = c.bucket_count(spark, c.text_bytes(chunks))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = c.WordHashes()
        for batch in batches:
            for chunk, blob in zip(batch.column("chunk").to_pylist(), batch.column("blob"), strict=True):
                ids, sets = _sets(blob.as_py(), words, cache)
                key = (chunk << c.ROW_BITS) + np.arange(len(sets))
                digests = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(key, pa.int64()), pa.array([len(s) for s in sets], pa.int32()), pa.array(digests, pa.binary())],
                    names=["doc_id", "key", "n", "digest"],
                )

    rows = c.materialise(chunks.mapInArrow(describe, "doc_id long, key long, n int, digest binary"))
    classes = c.materialise(
        rows.filter("n > 0").groupBy("digest").agg(F.min("key").alias("key"), F.min("doc_id").alias("class_id"), F.count("*").alias("n_copies"))
    )
    first = classes.groupBy(F.shiftright("key", c.ROW_BITS).alias("chunk")).agg(
        F.collect_list(F.col("key").bitwiseAND((1 << c.ROW_BITS) - 1).cast("int")).alias("first")
    )
    own = chunks.join(first.hint("merge"), "chunk")

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = c.WordHashes()
        for batch in batches:
            for row in range(batch.num_rows):
                _, sets = _sets(batch.column("blob")[row].as_py(), words, cache, np.array(batch.column("first")[row].as_py()))
                flat = np.concatenate([s for s in sets if s is not None]) >> np.uint64(64 - _KEY_BITS)
                unique, times, _ = c.unique_counts(flat)
                held = np.minimum(times, 0xFFFF).astype(np.uint16)
                yield c.probe_rows(
                    batch.column("chunk")[row].as_py(), unique, lambda lo, hi, t=held: c.squeeze(t[lo:hi]), buckets, _KEY_BITS
                )

    def rarity(keys: np.ndarray, _: np.ndarray, aux: list[bytes]) -> np.ndarray:
        """0: held by one set; else grows with the number of sets that hold it."""
        order, group, held = c.count_groups(keys, np.concatenate([c.unsqueeze(a, np.uint16) for a in aux]))
        code = np.where(held > 1, np.clip(np.floor(6 * np.log2(np.maximum(held, 2))), 1, 255), 0)
        out = np.empty(len(keys), np.uint8)
        out[order] = code[group]
        return out

    held = c.decide_buckets(own.mapInArrow(send, c.PROBE_SCHEMA), rarity)

    def survive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = c.WordHashes()
        for batch in batches:
            for row in range(batch.num_rows):
                chunk, got = batch.column("chunk")[row].as_py(), batch.column("held")[row].as_py()
                if not got:
                    continue
                _, sets = _sets(batch.column("blob")[row].as_py(), words, cache, np.array(batch.column("first")[row].as_py()))
                flat = np.concatenate([s for s in sets if s is not None]) >> np.uint64(64 - _KEY_BITS)
                unique, _, inverse = c.unique_counts(flat)
                codes, begin = c.read_replies(got, unique, buckets, _KEY_BITS)[inverse], 0
                keys, sizes, tokens, prefixes = [], [], [], []
                for i, s in enumerate(sets):
                    if s is None:
                        continue
                    code, begin = codes[begin : begin + len(s)], begin + len(s)
                    spare = int((code > 0).sum()) - least_overlap(len(s), percent)
                    if spare < 0:
                        continue
                    shared = s[code > 0]
                    rare = np.lexsort((shared, code[code > 0]))[: spare + 1]
                    keys.append((chunk << c.ROW_BITS) + i)
                    sizes.append(len(s))
                    tokens.append(shared.tobytes())
                    prefixes.append(shared[rare].view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.int64()), pa.array(sizes, pa.int32()), pa.array(tokens, pa.binary()), pa.array(prefixes, pa.list_(pa.int64()))],
                    names=["key", "n", "tokens", "prefix"],
                )

    survivors = c.materialise(c.with_replies(own, held, "held").mapInArrow(survive, "key long, n int, tokens binary, prefix array<long>"))

    # Clusters: each rare shingle ties its sets to the first of them.
    prefix = survivors.select("key", F.explode("prefix").alias("token"))
    hubs = prefix.groupBy("token").agg(F.min("key").alias("hub"), F.count("*").alias("held")).filter("held > 1").drop("held")
    ties = prefix.join(hubs, "token").filter("key <> hub").select("key", "hub").distinct()
    cluster = connected_components(ties)
    heads = cluster.groupBy(F.col("component").alias("cluster")).agg((F.count("*") + 1).alias("sets"))
    named = cluster.select(F.col("node").alias("key"), F.col("component").alias("cluster")).unionByName(heads.select(F.col("cluster").alias("key"), "cluster"))
    sized = c.materialise(named.join(heads, "cluster"))
    placed = survivors.select("key", "n", "tokens").join(sized, "key")

    def small(table: pa.Table) -> pa.Table:
        return tree_links(table.column("key").to_numpy(), table.column("n").to_numpy(), _tokens(table.column("tokens")), percent)

    links = placed.filter(F.col("sets") <= CLUSTER_SETS).groupBy("cluster").applyInArrow(small, "a long, b long")
    large = placed.filter(F.col("sets") > CLUSTER_SETS).drop("sets")
    if heads.filter(F.col("sets") > CLUSTER_SETS).limit(1).count():
        links = links.union(_large_clusters(large, percent))
    found = connected_components(links)

    joined = classes.join(found.withColumnRenamed("node", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))
    names = joined.groupBy("component").agg(F.min("class_id").alias("component_id"))
    named = joined.join(names, "component").select("digest", "class_id", "n_copies", "component_id", "component")
    # Rows without shingles all have one digest; they stay out of the join.
    alone = rows.filter("n = 0").select("doc_id", "key", "n", F.col("doc_id").alias("component_id"), F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("n_copies"), F.col("key").alias("group"))
    linked = rows.filter("n > 0").join(named, "digest", "left").select("doc_id", "key", "n", "component_id", "class_id", F.col("n_copies").cast("long").alias("n_copies"), F.col("component").alias("group"))
    return chunks, linked.unionByName(alone)


def ngram_components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Groups of documents connected by shingle Jaccard similarity of ``percent``/100 or more.

    Returns one row per input row: ``doc_id``, ``n_shingles``, ``component_id``
    (smallest doc_id reachable by links, itself included), ``class_id``
    (smallest doc_id with the same set) and ``n_copies`` (rows with that set).

    * Shingles are runs of ``words`` words, A-Z in lower case; a shorter text is
      one shingle.  Null, empty and blank texts have none and link with nothing.
    * A null doc_id ranks above all others; a component of such rows alone has
      a null component_id.  Repeated rows are documents of their own.
    * Other columns are ignored.
    """
    _, rows = _components(c.id_and_text(docs, id_col, text_col), words, percent)
    return rows.select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id", "class_id", "n_copies")


def one_of_each(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, with all its columns: the smallest id (null above all others), the first of equal ones.

    The rows come from the packed chunks, so texts are neither dealt again nor written a second time.  Documents without
    shingles are components of their own.
    """
    names = docs.columns
    packed = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.struct(*[F.col(f"`{x}`") for x in names if x not in (id_col, text_col)], F.lit(0).alias("_")).alias("rest"))
    chunks, rows = _components(packed, words, percent)
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key")
    kept = rows.groupBy("group").agg(F.min(order).alias("first")).select("first.key")
    of_chunk = kept.groupBy(F.shiftright("key", c.ROW_BITS).alias("chunk")).agg(F.sort_array(F.collect_list(F.col("key").bitwiseAND((1 << c.ROW_BITS) - 1))).alias("kept"))

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in range(b.num_rows):
                table = pa.ipc.open_stream(b.column("blob")[row].as_py()).read_all().combine_chunks()
                yield from table.take(pa.array(b.column("kept")[row].as_py(), pa.int64())).to_batches()

    out = chunks.join(of_chunk.hint("merge"), "chunk").select("blob", "kept").mapInArrow(take, packed.schema)
    back = {id_col: F.col("doc_id"), text_col: F.col("text")}
    return out.select(*[(back[x] if x in back else F.col(f"rest.`{x}`")).alias(x) for x in names])
