"""Substring dedup by fixed-block anchors.

Words are runs of anything but ASCII white space.  A repeated window of
``window`` words holds, in every one of its occurrences, a whole block of
``window // 2 + 1`` words that starts at a multiple of that length.  So

* **index**: the non-overlapping blocks of every document,
* **probe**: every rolling run of a block's length looks for an equal block
  elsewhere; both sides meet in hash-range buckets,
* **extend**: each hit is extended over all windows around it; those windows'
  96-bit hashes are compared over the corpus, and the union of the windows that
  occur twice is the set of maximal exact repeats.

Only windows around a hit travel in the second exchange.  Both exchanges send
a value once per chunk whatever its frequency, so a passage in a third of all
documents is no hot key.

Equality is that of hashes: words by 64 bits, windows by 96 bits of their words'
hashes.  Two different words of one hash (a chance of 3e-4 among 10**8 different
words) would pass for the same; the words themselves are not compared.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courtlake.llm import common as c

WINDOW = 35


def _words(blob: bytes, cache: c.WordHashes) -> tuple[pa.Array, list[list[bytes]], np.ndarray, np.ndarray]:
    ids, texts = c.unpack(blob)
    docs = [t.split() if t else [] for t in texts]
    lengths = np.array([len(d) for d in docs], np.int64)
    hashes = np.concatenate([c.hash_words(d, cache) for d in docs]) if docs else np.empty(0, np.uint64)
    return ids, docs, lengths, hashes


def _anchor_keys(hashes: np.ndarray, lengths: np.ndarray, block: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts of rolling runs, their keys, is the run an indexed block)."""
    starts = np.flatnonzero(c.windows_inside(lengths, block))
    keys = c.window_hashes(hashes, block)[starts] >> np.uint64(64 - bits)
    begin = np.repeat(np.cumsum(lengths) - lengths, lengths)
    return starts, keys, (starts - begin[starts]) % block == 0


def _candidates(hot_starts: np.ndarray, lengths: np.ndarray, window: int, block: int) -> np.ndarray:
    """Starts of the windows inside a document that hold one of the hot runs."""
    n = int(lengths.sum())
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, np.maximum(hot_starts - (window - block), 0), 1)
    np.add.at(change, hot_starts + 1, -1)
    inside = c.windows_inside(lengths, window)
    return np.flatnonzero((np.cumsum(change)[: len(inside)] > 0) & inside)


def _window_keys(hashes: np.ndarray, starts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct (key, check) of the windows at these starts, how often each occurs, and the number of each start's."""
    key = c.window_hashes(hashes, window, c.BASE_A)[starts] if len(starts) else np.empty(0, np.uint64)
    check = (c.window_hashes(hashes, window, c.BASE_B)[starts] >> np.uint64(32)).astype(np.uint32) if len(starts) else np.empty(0, np.uint32)
    order, group, totals = c.count_groups(key, np.ones(len(key)), check)
    inverse = np.empty(len(key), np.int64)
    inverse[order] = group
    first = order[np.flatnonzero(np.diff(group, prepend=-1))]
    return key[first], check[first], totals.astype(np.int64), inverse


def substring_dedup(
    docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True
) -> DataFrame:
    """Remove every word covered by a ``window``-word run that also starts anywhere else.

    Returns one row per input row: ``doc_id``, ``n_words``, ``n_removed``,
    ``spans`` (the maximal removed [begin, end) word ranges) and, with
    ``with_text``, ``kept_text`` (kept words joined by one space).

    * Null or empty text: no words, nothing removed, ``kept_text`` empty.
    * Texts shorter than the window are kept whole.  Rows are documents of their
      own even if they repeat a doc_id or hold the same text: equal texts of at
      least ``window`` words remove each other.  Null ids stay null.
    * Windows are judged on the input, so overlapping repeats vanish together.
    * Other columns are ignored.
    """
    spark = docs.sparkSession
    block = window // 2 + 1
    chunks = c.pack_documents(c.id_and_text(docs, id_col, text_col))
    size = c.text_bytes(chunks)
    buckets, total = c.bucket_count(spark, size), max(2, size // 5)
    # Enough bits that chance hits stay few at any size; the second exchange is exact in any case.
    bits = min(64, math.ceil(math.log2(total)) + math.ceil(math.log2(max(2, total / block))) - 4)
    bits = max(bits, 34)

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = c.WordHashes()
        for batch in batches:
            for chunk, blob in zip(batch.column("chunk").to_pylist(), batch.column("blob"), strict=True):
                _, _, lengths, hashes = _words(blob.as_py(), cache)
                _, keys, is_block = _anchor_keys(hashes, lengths, block, bits)
                unique, times, inverse = c.unique_counts(keys)
                flags = (times > 1).astype(np.uint8)
                flags[inverse[is_block]] |= 2
                yield c.probe_rows(chunk, unique, lambda lo, hi, f=flags: c.squeeze(f[lo:hi]), buckets, bits)

    def hits(keys: np.ndarray, _: np.ndarray, aux: list[bytes]) -> np.ndarray:
        flags = np.concatenate([c.unsqueeze(a, np.uint8) for a in aux])
        order, group, times = c.count_groups(keys, 1 + (flags & 1))
        blocks = np.bincount(group, weights=flags[order] & 2, minlength=len(times))
        out = np.empty(len(keys), np.uint8)
        out[order] = ((times > 1) & (blocks > 0))[group]
        return out

    def hot_windows(hashes: np.ndarray, lengths: np.ndarray, got) -> tuple[np.ndarray, ...]:
        starts, keys, _ = _anchor_keys(hashes, lengths, block, bits)
        unique, _, inverse = c.unique_counts(keys)
        hot = c.read_replies(got, unique, buckets, bits)[inverse] > 0
        at = _candidates(starts[hot], lengths, window, block)
        return at, *_window_keys(hashes, at, window)

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = c.WordHashes()
        for batch in batches:
            for row in range(batch.num_rows):
                got = batch.column("anchors")[row].as_py()
                if not got:
                    continue
                _, _, lengths, hashes = _words(batch.column("blob")[row].as_py(), cache)
                _, key, check, times, _ = hot_windows(hashes, lengths, got)
                both = (times > 1).astype(np.uint8)
                yield c.probe_rows(
                    batch.column("chunk")[row].as_py(), key, lambda lo, hi, k=check, b=both: c.squeeze(b[lo:hi]) + k[lo:hi].tobytes(), buckets, 64
                )

    def repeats(keys: np.ndarray, source: np.ndarray, aux: list[bytes]) -> np.ndarray:
        sizes = np.bincount(source, minlength=len(aux))
        check = np.concatenate([np.frombuffer(a[len(a) - 4 * n :], np.uint32) for a, n in zip(aux, sizes, strict=True)])
        both = np.concatenate([c.unsqueeze(a[: len(a) - 4 * n], np.uint8) for a, n in zip(aux, sizes, strict=True)])
        order, group, times = c.count_groups(keys, 1 + both, check)
        out = np.empty(len(keys), np.uint8)
        out[order] = (times > 1)[group]
        return out

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = c.WordHashes()
        for batch in batches:
            for row in range(batch.num_rows):
                ids, docs_words, lengths, hashes = _words(batch.column("blob")[row].as_py(), cache)
                got, again = batch.column("anchors")[row].as_py(), batch.column("windows")[row].as_py()
                n = int(lengths.sum())
                change = np.zeros(n + 1, np.int64)
                if got and again:
                    at, key, _, _, inverse = hot_windows(hashes, lengths, got)
                    twice = at[c.read_replies(again, key, buckets, 64)[inverse] > 0]
                    np.add.at(change, twice, 1)
                    np.add.at(change, twice + window, -1)
                gone = np.cumsum(change)[:n] > 0
                yield _result(ids, docs_words, lengths, gone, with_text)

    found = c.materialise(c.decide_buckets(chunks.mapInArrow(anchors, c.PROBE_SCHEMA), hits))
    hit = c.with_replies(chunks, found, "anchors")
    twice = c.materialise(c.decide_buckets(hit.mapInArrow(extend, c.PROBE_SCHEMA), repeats))
    gathered = twice.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "reply")).alias("windows"))
    schema = "doc_id long, n_words long, n_removed long, spans array<struct<begin:long,end:long>>" + ", kept_text string" * with_text
    return hit.join(gathered.hint("merge"), "chunk", "left").mapInArrow(apply, schema)


def _result(ids: pa.Array, docs: list[list[bytes]], lengths: np.ndarray, gone: np.ndarray, with_text: bool) -> pa.RecordBatch:
    begin = np.cumsum(lengths) - lengths
    removed, spans, texts = [], [], []
    for words, b in zip(docs, begin, strict=True):
        mask = gone[b : b + len(words)]
        edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
        spans.append([{"begin": int(x), "end": int(y)} for x, y in zip(edges[::2], edges[1::2], strict=True)])
        removed.append(int(mask.sum()))
        if with_text:
            left, kept = 0, []
            for x, y in zip(edges[::2], edges[1::2], strict=True):
                kept += words[left:x]
                left = y
            texts.append(b" ".join(kept + words[left:]).decode("utf-8", "surrogatepass"))
    kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
    columns = [ids, pa.array(lengths), pa.array(removed, pa.int64()), pa.array(spans, kind)]
    names = ["doc_id", "n_words", "n_removed", "spans"]
    if with_text:
        columns.append(pa.array(texts, pa.string()))
        names.append("kept_text")
    return pa.RecordBatch.from_arrays(columns, names=names)
