"""Bulk-synchronous best-fit packing of tokenised documents.

A document's ids are those of a byte-level BPE plus an end id.  Only documents
longer than a sequence are cut, into full pieces and one shorter first piece.

Pieces longer than half a sequence open one each.  All others are placed by
sweeps over two distributed tables, the pieces and the gaps (what is free in
each open sequence), both range-sorted by size:

* **Successor.**  Sizes are run through from large to small.  A gap is pushed,
  a piece pops the gap pushed last, which is the smallest that is large enough
  and not taken by a longer piece of the sweep.  A push and its pop have the same
  *level*: the number of gaps then open.  So a sweep deals both tables by level,
  and within a level each piece follows its gap.
* **Rank.**  The level of a row is its rank within its size plus what the larger
  sizes leave open.  Pieces of one size claim gaps of one size by rank, so no two
  claim the same.
* **Update.**  A gap shrinks by the pieces it got; the next sweep sorts the gaps
  again.  A gap that holds the longest piece left several times is that many
  slots.  A sweep takes pieces down to ``FRACTION`` of the longest one, so shorter
  ones do not take gaps from those that are still to come.  Where no gap holds the
  longest piece, sequences are opened.

Only the numbers of pieces and gaps by size come to the driver, at most
``capacity`` of each (and one more per task); rows are never collected, and no
size, level or sequence is one task.
"""

from __future__ import annotations

import base64
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from courtlake.llm import common as c

CAPACITY, END_ID = 2048, 0
#: A sweep takes pieces of at least this part of the longest one left.
FRACTION = 0.25
#: Rows of a sweep per task; they are a few numbers each.
SWEEP_ROWS = 1 << 16


def _dealt(table: DataFrame, tasks: int, key: str) -> DataFrame:
    """Rows of one ``key`` in one task; a single task needs no exchange."""
    return table.coalesce(1) if tasks == 1 else table.repartition(tasks, key)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Token ids of whole texts, as little-endian uint32 bytes.

    Where the vocabulary also lies beside the tokenizer's file as ranks, the
    ranks are used: they give the same ids several times faster.  Texts that
    hold one of the tokenizer's special strings go through the tokenizer itself.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.fast = self._ranks(path.removesuffix(".json") + ".tiktoken")

    @staticmethod
    def _ranks(path: str):
        import public_tokenizers
        import tiktoken

        if not os.path.exists(path):
            return None
        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> bytes:
        if self.fast is not None and not any(s in text for s in self.special):
            return np.array(self.fast.encode_ordinary(text), "<u4").tobytes()
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long"


def pieces_of(docs: DataFrame, capacity: int, tokenizer: str | None, with_ids: bool) -> DataFrame:
    path = tokenizer or default_tokenizer()

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        end = np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            ids, piece, start, length, crc, blob = [], [], [], [], [], []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                data = encoder.encode(text.as_py() or "") + end
                n, at, k = len(data) // 4, 0, 0
                while at < n:
                    size = (n - 1) % capacity + 1 if k == 0 else capacity
                    part = data[4 * at : 4 * (at + size)]
                    ids.append(doc)
                    piece.append(k)
                    start.append(at)
                    length.append(size)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        blob.append(part)
                    at, k = at + size, k + 1
            columns = [pa.array(ids, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int32()), pa.array(crc, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns.append(pa.array(blob, pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(tokenise, PIECES + ", ids binary" * with_ids)


def _lookup(spark: SparkSession, rows: list[tuple], names: str) -> DataFrame:
    """A table by size for the join with the rows: at most one row per size, and one more per task."""
    columns = zip(*rows, strict=True) if rows else [()] * len(names.split())
    return F.broadcast(spark.createDataFrame(pa.table({n: pa.array(v, pa.int64()) for n, v in zip(names.split(), columns, strict=True)})))


def _by_size(table: DataFrame, key: str, tasks: int) -> tuple[DataFrame, dict[int, int]]:
    """(``key``, ``size``) range-sorted, each row with its ``rank`` (from 0) among those of its size; rows by size.

    A size that many rows have spreads over the ranges, as ``key`` is sorted on too.
    """
    spark = table.sparkSession
    order = [F.col("size").desc(), F.col(key)]
    dealt = table.coalesce(1) if tasks == 1 else table.repartitionByRange(tasks, *order)
    rows = c.materialise(dealt.sortWithinPartitions(*order).select(key, "size", F.monotonically_increasing_id().alias("at")))
    runs = rows.groupBy(F.shiftright("at", 33).alias("part"), "size").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    held: dict[int, int] = {}
    shifts = []  # by (part, size) in one number, the cheapest key to broadcast
    for r in sorted(runs.collect(), key=lambda r: r["part"]):  # sizes are sorted, so at most one row more than sizes per part
        shifts.append(((r["part"] << 31) + r["size"], held.get(r["size"], 0) - r["first"]))
        held[r["size"]] = held.get(r["size"], 0) + r["n"]
    shift = _lookup(spark, shifts, "run shift")
    ranked = rows.join(shift, F.shiftleft(F.shiftright("at", 33), 31) + F.col("size") == F.col("run"))
    return ranked.select(key, "size", (F.col("at") + F.col("shift")).alias("rank")), held


def plan_levels(gaps: dict[int, int], pieces: dict[int, int], longest: int) -> tuple[list[tuple[int, ...]], list[tuple[int, ...]]]:
    """The levels of one sweep, from the numbers of gaps and of pieces by size.

    Gaps: (size, order, slots, base, first): the gap of rank ``r`` is ``slots`` slots, slot ``t`` of it has the level
    ``base + r * slots + t + 1``, and only slots from number ``first`` of the size on are taken.  Pieces: (size, order,
    base, taken): the first ``taken`` are placed, the one of rank ``r`` at the level ``base - r``.
    """
    events, height = [], 0
    for size in sorted(gaps.keys() | pieces.keys(), reverse=True):
        if gaps.get(size):
            slots = max(1, size // longest)
            events.append((True, size, slots, height, gaps[size] * slots))
            height += gaps[size] * slots
        if taken := min(height, pieces.get(size, 0)):
            events.append((False, size, 0, height, taken))
            height -= taken
    pushed, popped, lowest = [], [], height
    for order in range(len(events) - 1, -1, -1):
        push, size, slots, base, n = events[order]
        if not push:
            lowest = min(lowest, base - n)
            popped.append((size, order, base, n))
        elif lowest < base + n:
            pushed.append((size, order, slots, base, max(0, lowest - base)))
            lowest = min(lowest, base)
    return pushed, popped


def _sweep(gaps: DataFrame, pieces: DataFrame, held: dict[int, int], placed: dict[int, int], part: dict[int, int], tasks: int) -> tuple[DataFrame, dict[int, int]]:
    """One sweep: (tie, size, sequence) of the pieces it places, and how many of each size."""
    spark = gaps.sparkSession
    pushed, popped = plan_levels(held, part, max(part))
    take = {size: n for size, _, _, n in popped}
    slots = _lookup(spark, pushed, "p_size order slots base first")
    begin = F.greatest(F.col("first") - F.col("rank") * F.col("slots"), F.lit(0))
    open_slots = (
        gaps.join(slots, F.col("size") == F.col("p_size")).filter((F.col("rank") + 1) * F.col("slots") > F.col("first"))
        .withColumn("slot", F.explode(F.sequence(begin, F.col("slots") - 1)))
        .select((F.col("base") + F.col("rank") * F.col("slots") + F.col("slot") + 1).alias("level"), "order", "sequence", F.lit(None).cast("long").alias("tie"), F.lit(None).cast("int").alias("size"))
    )
    claims = _lookup(spark, [(s, o, b, placed.get(s, 0), placed.get(s, 0) + n) for s, o, b, n in popped], "p_size order base low high")
    claiming = pieces.join(claims, F.col("size") == F.col("p_size")).filter("rank >= low and rank < high")
    claiming = claiming.select((F.col("base") - (F.col("rank") - F.col("low"))).alias("level"), "order", F.lit(None).cast("long").alias("sequence"), "tie", "size")
    along = Window.partitionBy("level").orderBy("order")
    met = _dealt(open_slots.unionByName(claiming), tasks, "level").withColumn("sequence", F.coalesce("sequence", F.lag("sequence").over(along)))
    return c.materialise(met.filter("tie is not null").select("tie", "size", "sequence")), take


def _assign(made: DataFrame, capacity: int) -> DataFrame | None:
    """(tie, size, sequence, sweep) of all pieces shorter than a sequence; None if there are none."""
    spark = made.sparkSession
    short = c.materialise(made.filter(F.col("length") < capacity).select("tie", F.col("length").alias("size")))
    tasks = -(-short.count() // SWEEP_ROWS) or 1
    pieces, left = _by_size(short, "tie", tasks)
    if not left:
        return None
    large = {s: n for s, n in left.items() if 2 * s > capacity}
    before, opened = [], 0
    for size in sorted(large, reverse=True):
        before.append((size, opened))
        opened += large[size]
        del left[size]
    starts = _lookup(spark, before, "p_size before")
    done = pieces.join(starts, F.col("size") == F.col("p_size")).select("tie", "size", (F.col("before") + F.col("rank")).alias("sequence"))
    assigned = done.withColumn("sweep", F.lit(0))
    gaps = done.select("sequence", (capacity - F.col("size")).alias("size"))
    placed: dict[int, int] = {}
    sweep = 0
    while left:
        longest, sweep = max(left), sweep + 1
        ranked, held = _by_size(gaps.filter(F.col("size") >= min(left)), "sequence", tasks)
        part = {s: n for s, n in left.items() if s >= FRACTION * longest}
        roomiest = max(held, default=0)
        if longest > roomiest:
            new = -(-sum(s * n for s, n in part.items() if s > roomiest) // capacity)
            ranked = ranked.unionByName(spark.range(0, new, 1, -(-new // SWEEP_ROWS)).select((F.col("id") + opened).alias("sequence"), F.lit(capacity).alias("size"), F.col("id").alias("rank")))
            held, opened = {**held, capacity: new}, opened + new
        met, take = _sweep(ranked, pieces, held, placed, part, tasks)
        for size, n in take.items():
            placed[size] = placed.get(size, 0) + n
            left[size] -= n
        left = {s: n for s, n in left.items() if n}
        assigned = assigned.unionByName(met.withColumn("sweep", F.lit(sweep)))
        shrunk = ranked.select("sequence", "size").unionByName(met.select("sequence", (-F.col("size")).alias("size")))
        gaps = _dealt(shrunk, tasks, "sequence").groupBy("sequence").agg(F.sum("size").cast("int").alias("size"))
    return assigned


def pack(
    docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False
) -> DataFrame:
    """Pack documents into sequences of at most ``capacity`` token ids.

    Returns one row per piece: ``doc_id``, ``piece``, ``start``, ``length``,
    ``ids_crc32``, ``sequence_id``, ``offset``, and ``ids`` (little-endian
    uint32) with ``with_ids``.  Pieces fill a sequence from 0 without gaps.

    * Null and empty texts are the end id alone.  Every input row is a document
      of its own, repeats included; null ids stay null.
    * ``sequence_id`` are distinct numbers, not consecutive.
    * Empty input gives no rows; other columns are ignored.
    """
    made = c.materialise(
        pieces_of(c.id_and_text(docs, id_col, text_col), capacity, tokenizer, with_ids).withColumn("tie", F.monotonically_increasing_id())
    )
    out = made.columns[:-1]
    alone = made.filter(F.col("length") == capacity).select(*out, (-1 - F.col("tie")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    assigned = _assign(made, capacity)
    if assigned is not None:
        inside = Window.partitionBy("sequence").orderBy("sweep", F.col("size").desc(), "tie")
        offset: Column = F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
        placed = assigned.withColumn("offset", offset).select("tie", F.col("sequence").alias("sequence_id"), "offset")
        alone = made.join(placed, "tie").select(*out, "sequence_id", "offset").unionByName(alone)
    return alone.withColumn("length", F.col("length").cast("long"))
