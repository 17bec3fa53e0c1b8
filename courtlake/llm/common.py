"""What the corpus operators share: scratch space, packed documents, hash exchange.

The exact operators on words, shingles and lines follow one pattern:

1. ``pack_documents`` packs documents into chunks of a few megabytes of text
   (Arrow IPC, zstd), deals the chunks over the cluster by their number and
   checkpoints them.  Later passes read the chunks where they are.
2. A pass over the chunks turns texts into 64-bit hashes, removes repeats
   *within* the chunk and sends what is left to hash-range buckets as sorted,
   delta-coded arrays.  So a hash held by a third of all rows costs one entry
   per chunk: pre-aggregation is what keeps hot keys from landing in one task.
3. Each bucket sorts what it got, decides, and answers every chunk with one
   byte per entry, in the order sent (``decide_buckets``).
4. The next pass joins the answers to their chunk and applies them.

Nothing here is collected to the driver and lineage is cut by ``checkpoint()``
in the folder that ``spark.checkpoint.dir`` names.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes per packed chunk; a longer document is a chunk of its own.
CHUNK_BYTES = 4 << 20
#: Each row counts as this many bytes more, so a chunk has at most CHUNK_BYTES / ROW_BYTES + 1 rows.
ROW_BYTES = 64
#: ``chunk << ROW_BITS`` leaves room for the row's place in its chunk.
ROW_BITS = 17
#: Hash-range buckets per shuffle partition, and text bytes behind one bucket at most, so that a bucket's arrays stay small
#: whatever the number of partitions.
BUCKETS_PER_PARTITION, BUCKET_BYTES = 2, 64 << 20
#: Words whose hash a Python worker remembers before it starts afresh.
CACHED_WORDS = 400_000


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the session's ``spark.checkpoint.dir``; make one only where it is unset and no other machine takes part (tests)."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured and not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is unset; it has to name a folder that all executors share")
    sc.setCheckpointDir(configured or tempfile.mkdtemp(prefix="courtlake-checkpoint-"))


def materialise(df: DataFrame, keep_partitioning: bool = False) -> DataFrame:
    """Cut the lineage with a reliable checkpoint (never a local one).

    A plan that is adaptive forgets how its rows are dealt; with
    ``keep_partitioning`` this one is planned statically, so later joins on the
    key of its last ``repartition`` need not move it.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    if not keep_partitioning:
        return df.checkpoint(eager=True)
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return df.checkpoint(eager=True)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(chunks: DataFrame) -> int:
    return chunks.agg(F.sum("text_bytes")).first()[0] or 0


def bucket_count(spark: SparkSession, text_bytes: int) -> int:
    """Hash-range buckets for the exchange of a corpus of so many bytes."""
    return max(shuffle_partitions(spark) * BUCKETS_PER_PARTITION, -(-text_bytes // BUCKET_BYTES))


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns that are read, so other columns cannot clash."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


# --------------------------------------------------------------- packed chunks


def _ipc(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_table(table)
    return sink.getvalue().to_pybytes()


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, seq, held, size = TaskContext.get().partitionId(), 0, [], 0

    def emit() -> pa.RecordBatch:
        nonlocal seq, held, size
        table = pa.Table.from_batches(held).combine_chunks()
        row = pa.RecordBatch.from_arrays(
            [pa.array([(part << 22) + seq], pa.int64()), pa.array([_ipc(table)], pa.binary()), pa.array([size], pa.int64())],
            names=["chunk", "blob", "text_bytes"],
        )
        seq, held, size = seq + 1, [], 0
        return row

    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64) + ROW_BYTES
        start = 0
        while start < batch.num_rows:
            reach = np.cumsum(lengths[start:])
            end = start + max(1, int(np.searchsorted(reach, CHUNK_BYTES - size, side="right")))
            held.append(batch.slice(start, end - start))
            size += int(lengths[start:end].sum())
            start = end
            if size >= CHUNK_BYTES or start < batch.num_rows:
                yield emit()
    if held:
        yield emit()


def pack_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> checkpointed (chunk, blob, text_bytes), dealt by chunk.

    The checkpoint keeps its hash partitioning, so joining answers to chunks
    moves the answers only.
    """
    spark = docs.sparkSession
    packed = docs.mapInArrow(_pack, "chunk long, blob binary, text_bytes long")
    return materialise(packed.repartition(shuffle_partitions(spark), "chunk"), keep_partitioning=True)


def unpack(blob: bytes) -> tuple[pa.Array, list[bytes | None]]:
    """The ids (Arrow, nullable) and UTF-8 texts of a chunk."""
    table = pa.ipc.open_stream(blob).read_all().combine_chunks()
    text = table.column("text").cast(pa.large_binary()).to_pylist()
    return table.column("doc_id").combine_chunks() if table.num_rows else pa.array([], pa.int64()), text


# --------------------------------------------------------------- word hashing


class WordHashes(dict):
    """word bytes -> 64-bit hash, remembering up to CACHED_WORDS words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def hash_words(words: list[bytes], cache: WordHashes) -> np.ndarray:
    return np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads all bits (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        up, down = np.full(size, base, np.uint64), np.full(size, pow(base, -1, 1 << 64), np.uint64)
        up[:1] = down[:1] = 1
        have = _POWERS[base] = (np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64))
    return have[0][:n], have[1][:n]


BASE_A, BASE_B = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


def window_hashes(words: np.ndarray, width: int, base: int = BASE_A) -> np.ndarray:
    """64-bit hash of every run of ``width`` words, by start (len - width + 1 of them)."""
    n = len(words)
    if n < width:
        return np.empty(0, np.uint64)
    up, down = _powers(base, n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(words * up, out=total[1:])
    return mix((total[width:] - total[:-width]) * down[: n - width + 1])


def windows_inside(lengths: np.ndarray, width: int) -> np.ndarray:
    """For a concatenation of documents: does the window starting here end in its document?"""
    n = int(lengths.sum())
    ends = np.repeat(np.cumsum(lengths), lengths)
    return (np.arange(n) + width <= ends)[: max(0, n - width + 1)]


# --------------------------------------------------------------- hash exchange


def squeeze(a: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(a.tobytes())


def unsqueeze(b: bytes, dtype) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(b), dtype)


def encode_sorted(keys: np.ndarray) -> bytes:
    """Sorted uint64 as zstd of the byte planes of their differences."""
    d = np.diff(keys, prepend=np.uint64(0))
    wide = 8 if len(d) and int(d.max()) >> 32 else 4
    planes = d.astype(f"<u{wide}").view(np.uint8).reshape(-1, wide).T
    return bytes([wide]) + squeeze(np.ascontiguousarray(planes))


def decode_sorted(b: bytes) -> np.ndarray:
    wide = b[0]
    planes = unsqueeze(b[1:], np.uint8).reshape(wide, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(f"<u{wide}").ravel().astype(np.uint64), dtype=np.uint64)


def bucket_bounds(keys: np.ndarray, buckets: int, bits: int) -> np.ndarray:
    """Where each hash range begins in the sorted keys (buckets + 1 positions)."""
    edges = np.array([(b << bits) // buckets for b in range(1, buckets)], np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])


PROBE_SCHEMA = "bucket int, chunk long, keys binary, aux binary"
REPLY_SCHEMA = "chunk long, bucket int, reply binary"


def probe_rows(chunk: int, keys: np.ndarray, aux: Callable[[int, int], bytes], buckets: int, bits: int) -> pa.RecordBatch:
    """One row per hash range that got keys; ``aux(lo, hi)`` gives what goes along with keys[lo:hi]."""
    bounds = bucket_bounds(keys, buckets, bits)
    at = np.flatnonzero(np.diff(bounds))
    offset = [np.uint64((int(b) << bits) // buckets) for b in at]
    rows = [(encode_sorted(keys[bounds[b] : bounds[b + 1]] - o), aux(bounds[b], bounds[b + 1])) for b, o in zip(at, offset, strict=True)]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(at.astype(np.int32)),
            pa.array(np.full(len(at), chunk, np.int64)),
            pa.array([r[0] for r in rows], pa.binary()),
            pa.array([r[1] for r in rows], pa.binary()),
        ],
        names=["bucket", "chunk", "keys", "aux"],
    )


#: What a bucket decides on: keys, the index of the sending row for each key, each row's aux.
Decide = Callable[[np.ndarray, np.ndarray, list[bytes]], np.ndarray]


def decide_buckets(probes: DataFrame, decide: Decide) -> DataFrame:
    """Gather each hash range, decide, and answer each chunk with a byte per key; all-zero answers are left out."""

    def reduce(table: pa.Table) -> pa.Table:
        parts = [decode_sorted(b) for b in table.column("keys").to_pylist()]
        lengths = np.array([len(p) for p in parts])
        keys = np.concatenate(parts) if parts else np.empty(0, np.uint64)
        answer = decide(keys, np.repeat(np.arange(len(parts)), lengths), table.column("aux").to_pylist())
        pieces = np.split(answer.astype(np.uint8), np.cumsum(lengths)[:-1])
        keep = [i for i, p in enumerate(pieces) if p.any()]
        return pa.table(
            {
                "chunk": table.column("chunk").take(pa.array(keep, pa.int64())),
                "bucket": table.column("bucket").take(pa.array(keep, pa.int64())),
                "reply": pa.array([squeeze(pieces[i]) for i in keep], pa.binary()),
            }
        )

    return probes.groupBy("bucket").applyInArrow(reduce, REPLY_SCHEMA)


def with_replies(chunks: DataFrame, replies: DataFrame, name: str) -> DataFrame:
    """Chunks with the array of (bucket, reply) that came back for each, or null."""
    gathered = replies.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "reply")).alias(name))
    return chunks.join(gathered.hint("merge"), "chunk", "left")


def read_replies(got: list[dict] | None, keys: np.ndarray, buckets: int, bits: int) -> np.ndarray:
    """The byte for each of the sorted keys, zero where no answer came."""
    out, bounds = np.zeros(len(keys), np.uint8), bucket_bounds(keys, buckets, bits)
    for r in got or ():
        out[bounds[r["bucket"]] : bounds[r["bucket"] + 1]] = unsqueeze(r["reply"], np.uint8)
    return out


def count_groups(keys: np.ndarray, weight: np.ndarray, check: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, group number along that order, total weight per group) of equal keys."""
    order = np.argsort(keys, kind="stable") if check is None else np.lexsort((check, keys))
    k = keys[order]
    new = np.ones(len(k), bool)
    new[1:] = k[1:] != k[:-1]
    if check is not None:
        c = check[order]
        new[1:] |= c[1:] != c[:-1]
    group = np.cumsum(new) - 1
    totals = np.bincount(group, weights=weight[order], minlength=int(group[-1]) + 1 if len(group) else 0)
    return order, group, totals


def unique_counts(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, how often each occurs, and the distinct key's number for each input."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    new = np.ones(len(k), bool)
    new[1:] = k[1:] != k[:-1]
    group = np.cumsum(new) - 1
    inverse = np.empty(len(k), np.int64)
    inverse[order] = group
    return k[new], np.bincount(group, minlength=int(new.sum())), inverse


def crc32_of(column: Column) -> Column:
    """CRC-32 of a number's decimal text, as the folds of the labelled rows use."""
    return F.crc32(column.cast("string").cast("binary"))
