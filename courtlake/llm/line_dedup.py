"""Line dedup over hash ranges.

A line's key is the line without white space at its ends, A-Z in lower case.
Keys of ``min_chars`` code points or more that ``min_docs`` documents hold lose
all their lines but those of the largest doc_id that holds the key.

Hashes are range-partitioned.  Within a range they are sorted by hash and then
by document, largest first, and streamed: the first document of a key is the
one that keeps it.  Every chunk sends a key once, with its ``min_docs`` largest
documents, which is all that the decision needs, so a line in a third of all
documents costs one entry per chunk.  What comes back is a byte per key; the
result is one compressed keep bitmap per document, not text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courtlake.llm import common as c

MIN_CHARS, MIN_DOCS = 20, 3
_SPACE = b" \t\n\v\f\r"
_NO_ID = np.iinfo(np.int64).min


def key_of(line: bytes) -> bytes:
    return line.strip(_SPACE).lower()


def _long_enough(key: bytes, min_chars: int) -> bool:
    return len(key) >= min_chars and (key.isascii() or len(key.decode("utf-8", "replace")) >= min_chars)


def _lines(blob: bytes, min_chars: int) -> tuple[pa.Array, list[list[bytes]], np.ndarray, np.ndarray, np.ndarray]:
    """(ids, lines of each document, place of each keyed line in the chunk, its 64-bit key, its 32-bit check)."""
    ids, texts = c.unpack(blob)
    docs = [(t or b"").split(b"\n") for t in texts]
    at, keys, checks, n = [], [], [], 0
    for lines in docs:
        for line in lines:
            key = key_of(line)
            if _long_enough(key, min_chars):
                h = xxhash.xxh3_128_intdigest(key)
                at.append(n)
                keys.append(h >> 64)
                checks.append(h & 0xFFFFFFFF)
            n += 1
    return ids, docs, np.array(at, np.int64), np.array(keys, np.uint64), np.array(checks, np.uint32)


def _holders(ids: pa.Array, docs: list, at: np.ndarray, keys: np.ndarray, checks: np.ndarray, most: int):
    """Distinct (key, check) in order, each with its ``most`` largest documents, and every keyed line's number and document."""
    owner = np.repeat(ids.fill_null(_NO_ID).to_numpy(zero_copy_only=False).astype(np.int64), [len(d) for d in docs])[at] if len(at) else np.empty(0, np.int64)
    order, group, totals = c.count_groups(keys, np.ones(len(keys)), checks)
    inverse = np.empty(len(keys), np.int64)
    inverse[order] = group
    first = order[np.flatnonzero(np.diff(group, prepend=-1))]
    return keys[first], checks[first], owner, inverse, *_largest(inverse, owner, len(totals), most)


def _largest(group: np.ndarray, doc: np.ndarray, groups: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """For each group how many of its distinct documents follow (``most`` at most), and those, largest first."""
    order = np.lexsort((~doc, group))
    g, d = group[order], doc[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (d[1:] != d[:-1])
    g, d = g[new], d[new]
    begin = np.searchsorted(g, np.arange(groups))
    keep = np.arange(len(g)) - begin[g] < most
    return np.bincount(g[keep], minlength=groups).astype(np.uint8), d[keep]


def line_dedup(
    docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False
) -> DataFrame:
    """Drop lines that many documents share, except in the largest doc_id.

    Returns one row per input row: ``doc_id``, ``n_lines``, ``n_dropped``,
    ``keep_bitmap`` (zstd of one bit per line, first line in the lowest bit, set
    if kept) and, with ``with_text``, ``kept_text`` and ``text_md5`` (hex, of the
    text as it came; a null one's is that of the empty text).

    * Null or empty text is one empty line, which is kept.
    * Rows of one doc_id count as one document, and if it is the largest all of
      them keep the line; a null doc_id is below all others.
    * Repeats of a key within the document that keeps it all stay.
    * Other columns are ignored.
    """
    spark = docs.sparkSession
    chunks = c.pack_documents(c.id_and_text(docs, id_col, text_col))
    buckets = c.bucket_count(spark, c.text_bytes(chunks))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, blob in zip(batch.column("chunk").to_pylist(), batch.column("blob"), strict=True):
                ids, lines, at, keys, checks = _lines(blob.as_py(), min_chars)
                key, check, _, _, counts, docs_of = _holders(ids, lines, at, keys, checks, min_docs)
                ends = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])

                def aux(lo: int, hi: int, check=check, counts=counts, docs_of=docs_of, ends=ends) -> bytes:
                    return check[lo:hi].tobytes() + counts[lo:hi].tobytes() + docs_of[ends[lo] : ends[hi]].tobytes()

                yield c.probe_rows(chunk, key, aux, buckets, 64)

    def stream(keys: np.ndarray, source: np.ndarray, aux: list[bytes]) -> np.ndarray:
        """1: these lines go; 2: the chunk has the document that keeps them."""
        sizes = np.bincount(source, minlength=len(aux))
        check = np.concatenate([np.frombuffer(a[: 4 * n], np.uint32) for a, n in zip(aux, sizes, strict=True)])
        counts = np.concatenate([np.frombuffer(a[4 * n : 5 * n], np.uint8) for a, n in zip(aux, sizes, strict=True)])
        doc = np.concatenate([np.frombuffer(a[5 * n :], np.int64) for a, n in zip(aux, sizes, strict=True)])
        order, group, totals = c.count_groups(keys, np.ones(len(keys)), check)
        of_key = np.empty(len(keys), np.int64)
        of_key[order] = group
        held, largest = _largest(np.repeat(of_key, counts), doc, len(totals), min_docs)
        top = largest[np.cumsum(held) - held]
        own = doc[np.cumsum(counts) - counts]
        return np.where(held[of_key] < min_docs, 0, np.where(own == top[of_key], 2, 1)).astype(np.uint8)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                ids, lines, at, keys, checks = _lines(batch.column("blob")[row].as_py(), min_chars)
                key, _, owner, inverse, counts, docs_of = _holders(ids, lines, at, keys, checks, min_docs)
                answer = c.read_replies(batch.column("ranges")[row].as_py(), key, buckets, 64)[inverse]
                top = docs_of[np.cumsum(counts) - counts][inverse] if len(inverse) else owner
                gone = np.zeros(sum(map(len, lines)), bool)
                gone[at] = (answer == 1) | ((answer == 2) & (owner != top))
                yield _result(ids, lines, gone, with_text)

    answers = c.decide_buckets(chunks.mapInArrow(send, c.PROBE_SCHEMA), stream)
    schema = "doc_id long, n_lines long, n_dropped long, keep_bitmap binary" + ", kept_text string, text_md5 string" * with_text
    return c.with_replies(chunks, answers, "ranges").mapInArrow(apply, schema)


def _result(ids: pa.Array, docs: list[list[bytes]], gone: np.ndarray, with_text: bool) -> pa.RecordBatch:
    squeeze = zstandard.ZstdCompressor(level=1).compress
    dropped, bitmaps, texts, digests, begin = [], [], [], [], 0
    for lines in docs:
        mask = gone[begin : begin + len(lines)]
        begin += len(lines)
        dropped.append(int(mask.sum()))
        bitmaps.append(squeeze(np.packbits(~mask, bitorder="little").tobytes()))
        if with_text:
            kept = [x for x, g in zip(lines, mask, strict=True) if not g] if dropped[-1] else lines
            texts.append(b"\n".join(kept).decode("utf-8", "surrogatepass"))
            digests.append(hashlib.md5(b"\n".join(lines)).hexdigest())
    columns = [ids, pa.array([len(d) for d in docs], pa.int64()), pa.array(dropped, pa.int64()), pa.array(bitmaps, pa.binary())]
    names = ["doc_id", "n_lines", "n_dropped", "keep_bitmap"]
    if with_text:
        columns += [pa.array(texts, pa.string()), pa.array(digests, pa.string())]
        names += ["kept_text", "text_md5"]
    return pa.RecordBatch.from_arrays(columns, names=names)


def apply_bitmap(text: str | None, bitmap: bytes) -> str:
    """The text that a keep bitmap leaves of a document."""
    lines = (text or "").split("\n")
    bits = np.unpackbits(np.frombuffer(zstandard.ZstdDecompressor().decompress(bitmap), np.uint8), bitorder="little")
    return "\n".join(x for x, keep in zip(lines, bits[: len(lines)], strict=True) if keep)


def kept_digest(docs: DataFrame) -> DataFrame:
    """The contract's columns: the digest comes from the kept text."""
    out = line_dedup(docs, with_text=True)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))
