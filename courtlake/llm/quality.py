"""Quality classifier: nearest-neighbour voting over latent-semantic vectors.

A text is a bag of hashed words, of word shapes (case and symbols, as
``Aa.`` or ``A!!``) and of a few terms for how much it repeats itself.  Document
frequencies come from all documents.  The latent space is the truncated SVD of
a bounded, class-balanced sample of labelled documents; their latent vectors
are broadcast.  Every document is folded in, its cosines with all labelled
vectors are computed exactly in blocks, and its nearest ones vote with their
similarity.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courtlake.llm import common as c

#: Labelled documents of each class that are broadcast, at most; those with the smallest hash of their id.
PER_CLASS = 2000
WORD_TERMS, SHAPE_TERMS, REPEAT_TERMS = 1024, 512, 24
TERMS = WORD_TERMS + SHAPE_TERMS + REPEAT_TERMS
RANK, NEIGHBOURS, SHARPNESS = 48, 15, 8
#: How much each kind of term counts in a document's vector.
WEIGHTS = (0.35, 1.0, 1.0)
THRESHOLD = 0.7
_BLOCK = 256
_RUNS = re.compile(r"(.)\1+")


def shape(word: str) -> str:
    """Letters by case, digits as 0, other characters as they are; runs of one kind once, of one symbol twice."""
    kinds = "".join("A" if ch.isupper() else "a" if ch.isalpha() else "0" if ch.isdigit() else ch for ch in word)
    return _RUNS.sub(lambda m: m[1] if m[1] in "Aa0" else m[1] * 2, kinds)


class Terms(dict):
    """word -> its word term, shape term and a 32-bit hash, packed in one number."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= c.CACHED_WORDS:
            self.clear()
        text = word.decode("utf-8", "replace")
        h = xxhash.xxh3_64_intdigest(text.lower().encode())
        s = xxhash.xxh3_64_intdigest(shape(text).encode()) % SHAPE_TERMS
        value = self[word] = (h >> 40) % WORD_TERMS | s << 16 | (h & 0xFFFFFFFF) << 32
        return value


def term_counts(text: bytes, cache: Terms) -> np.ndarray:
    """Counts of all terms; a text without words has none."""
    words = text.split()
    out = np.zeros(TERMS)
    if not words:
        return out
    packed = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
    out[:WORD_TERMS] = np.bincount((packed & np.uint64(0xFFFF)).astype(np.int64), minlength=WORD_TERMS)
    out[WORD_TERMS : WORD_TERMS + SHAPE_TERMS] = np.bincount((packed >> np.uint64(16) & np.uint64(0xFFFF)).astype(np.int64), minlength=SHAPE_TERMS)
    name = packed >> np.uint64(32)
    twice = float((name[1:] == name[:-1]).mean()) if len(name) > 1 else 0.0
    distinct = len(set(words)) / len(words)
    out[WORD_TERMS + SHAPE_TERMS + min(11, int(twice * 12))] = 1
    out[WORD_TERMS + SHAPE_TERMS + 12 + min(11, int(distinct * 12))] = 1
    return out


def document_vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Each kind of term scaled to its own weight."""
    x = np.log1p(counts) * idf
    x[:, WORD_TERMS + SHAPE_TERMS :] = counts[:, WORD_TERMS + SHAPE_TERMS :]
    at = np.cumsum([0, WORD_TERMS, SHAPE_TERMS, REPEAT_TERMS])
    for lo, hi, w in zip(at, at[1:], WEIGHTS, strict=False):
        norm = np.linalg.norm(x[:, lo:hi], axis=1, keepdims=True)
        x[:, lo:hi] *= w / np.where(norm > 0, norm, 1)
    return x


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """In how many of all documents each term occurs (TERMS numbers), and the number of documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, df, n = Terms(), np.zeros(TERMS, np.int64), 0
        for b in batches:
            for t in b.column("text").cast(pa.large_binary()).to_pylist():
                df += term_counts(t or b"", cache) > 0
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([df.tolist()], pa.list_(pa.int64())), pa.array([n], pa.int64())], names=["df", "n"])

    parts = docs.select("text").mapInArrow(count, "df array<long>, n long")
    summed = parts.select(F.posexplode("df"), "n").groupBy("pos").agg(F.sum("col").alias("df"), F.sum("n").alias("n")).collect()
    df = np.zeros(TERMS)
    for r in summed:
        df[r["pos"]] = r["df"]
    return df, summed[0]["n"] if summed else 0


def _sample(docs: DataFrame, labelled: DataFrame, per_class: int) -> tuple[np.ndarray, np.ndarray]:
    """Term counts and labels of the sample."""
    # The bound holds in every case: a class adds no more than per_class rows.
    picked = None
    for y in (0, 1):
        one = labelled.filter(F.col("label") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        picked = one if picked is None else picked.unionByName(one)
    # An id may be repeated by any number of rows; the text with the smallest hash stands for it, so the bound holds for rows.
    one_each = docs.join(picked, "doc_id").groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.min("label").alias("label"))
    texts = one_each.orderBy(F.xxhash64("doc_id"), "doc_id").select("text", "label")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = Terms()
        for b in batches:
            counts = [term_counts(t or b"", cache) for t in b.column("text").cast(pa.large_binary()).to_pylist()]
            at = [np.flatnonzero(x) for x in counts]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([a.astype(np.int16) for a in at], pa.list_(pa.int16())),
                    pa.array([x[a].astype(np.float32) for x, a in zip(counts, at, strict=True)], pa.list_(pa.float32())),
                    b.column("label"),
                ],
                names=["at", "times", "label"],
            )

    rows = texts.mapInArrow(count, "at array<short>, times array<float>, label int").toArrow()
    x = np.zeros((rows.num_rows, TERMS))
    for i, (a, v) in enumerate(zip(rows.column("at"), rows.column("times"), strict=True)):
        x[i, np.array(a.as_py(), int)] = v.as_py()
    return x, rows.column("label").to_numpy()


def nearest(cosine: np.ndarray, k: int) -> np.ndarray:
    """Columns of each row's ``k`` largest values, in their order; of equal values the earlier columns."""
    at = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
    least = np.take_along_axis(cosine, at, 1).min(1, keepdims=True)
    for row in np.flatnonzero((cosine >= least).sum(1) > k):  # more than k reach the k-th value
        above, level = np.flatnonzero(cosine[row] > least[row]), np.flatnonzero(cosine[row] == least[row])
        at[row] = np.concatenate([above, level[: k - len(above)]])
    return np.sort(at, axis=1)


def labelled_rows(labels: DataFrame, label: str, keep: Column) -> DataFrame:
    """(doc_id, label) of the rows to learn from; documents labelled both ways or with null are left out."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).filter(keep & F.col("label").isin(0, 1))
    return rows.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("high")).filter("label = high").drop("high")


def score_quality(
    docs: DataFrame,
    labels: DataFrame,
    learn: Column | None = None,
    per_class: int = PER_CLASS,
    threshold: float = THRESHOLD,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Quality of every document, learnt from ``labels(doc_id, quality)``.

    ``learn`` says, in terms of ``doc_id``, which labels may be learnt from
    (all by default).  Returns one row per input row: ``doc_id``, ``score``
    (0 to 1, higher: label 1 likelier) and ``predicted`` (score >= threshold).

    * Null, empty and blank texts, and any text if nothing can be learnt from,
      get the share of label 1 among the rows learnt from (0.5 without any).
    * Ties between neighbours go to the earlier sample row, in the order of the
      hash of its id; of rows that repeat a labelled id one is learnt from.
    * Repeated rows each get a row; null ids stay null; other columns are ignored.
    """
    docs = c.id_and_text(docs, id_col, text_col)
    rows = labelled_rows(labels, "quality", F.lit(True) if learn is None else learn)
    shares = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    prior = shares.get(1, 0) / sum(shares.values()) if shares else 0.5
    counts, y = _sample(docs, rows, per_class)
    known = counts.any(1)
    counts, y = counts[known], y[known].astype(np.float64)
    df, n = document_frequencies(docs)
    idf = np.log((1 + n) / (1 + df)) + 0.1
    base, near = np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32)
    if len(counts):
        x = document_vectors(counts, idf)
        values, vectors = np.linalg.eigh(x.T @ x)
        base = vectors[:, np.argsort(-values)[: min(RANK, len(x))]]
        base = base.astype(np.float32)
        near = x.astype(np.float32) @ base
        near /= np.maximum(np.linalg.norm(near, axis=1, keepdims=True), 1e-9)
    k = min(NEIGHBOURS, len(near))
    model = docs.sparkSession.sparkContext.broadcast((base, near, y, idf))  # at most 2 * per_class + TERMS rows of RANK numbers

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, near, y, idf = model.value
        cache = Terms()
        for b in batches:
            texts = b.column("text").cast(pa.large_binary()).to_pylist()
            out = np.full(len(texts), prior)
            for s in range(0, len(texts) if k else 0, _BLOCK):
                counts = np.array([term_counts(t or b"", cache) for t in texts[s : s + _BLOCK]])
                v = document_vectors(counts, idf).astype(np.float32) @ base
                v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
                cosine = v @ near.T
                at = nearest(cosine, k)
                w = np.maximum(np.take_along_axis(cosine, at, 1), 1e-6).astype(np.float64) ** SHARPNESS
                vote = (w * y[at]).sum(1) / w.sum(1)
                out[s : s + _BLOCK] = np.where(counts.any(1), np.clip(vote, 0, 1), prior)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out)], names=["doc_id", "score"])

    scored = docs.mapInArrow(score, "doc_id long, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
