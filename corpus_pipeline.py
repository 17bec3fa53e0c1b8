"""A training corpus from raw documents: five of the operators, one after the other.

Each stage takes the documents that the one before it left (written and read
again in between by whoever runs the stages) and returns documents with the
same columns; the last returns packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from courtlake.llm import common as c
from courtlake.llm import ngram_join
from courtlake.llm.line_dedup import line_dedup
from courtlake.llm.mixing import mix
from courtlake.llm.packing import pack
from courtlake.llm.toxicity import score_toxicity

_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
_REPLICA_BITS = 2
_WORD_END = r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])"


def _keyed(docs: DataFrame) -> DataFrame:
    """The rows with a key of their own, ``row``, that stays as it is however often they are read."""
    return c.materialise(docs.select(*_COLUMNS).withColumn("row", F.monotonically_increasing_id()))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text the lexicon rejects go; the others stay as they are, null texts and ids, repeats and empty tables too."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    held_out = F.coalesce(c.crc32_of(F.col("doc_id")) % 5 == 0, F.lit(False))
    # A score follows from the text alone, so the text's digest is key enough.
    digested = docs.withColumn("key", F.md5(F.coalesce("text", F.lit(""))))
    toxic = score_toxicity(digested, labels, learn=~held_out, key_col="key").filter("predicted = 1").select("key").distinct()
    return digested.join(toxic, "key", "left_anti").select(*_COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that three documents or more share stay in the largest doc_id only.

    Every row stays, repeats and null ids too; a null text becomes empty only where it loses a line, which it has not.
    """
    # What stays of a row follows from its doc_id and text, so these are key enough.
    kept = line_dedup(docs, with_text=True).filter("n_dropped > 0").select(F.col("doc_id").alias("k_id"), "text_md5", "kept_text").dropDuplicates(["k_id", "text_md5"])
    digested = docs.withColumn("md5", F.md5(F.coalesce("text", F.lit(""))))
    joined = digested.join(kept, F.col("doc_id").eqNullSafe(F.col("k_id")) & (F.col("md5") == F.col("text_md5")), "left").withColumn("text", F.coalesce("kept_text", "text"))
    return joined.withColumn("n_chars", F.length("text").cast("long")).select(*_COLUMNS)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one row of the smallest doc_id stays (a null one is above all others).

    Repeats of a text are one group.  Null, empty and blank texts are near nothing and all stay.
    """
    return ngram_join.one_of_each(docs.select(*_COLUMNS))


def to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; the last copy of a document may be cut to the words taken.

    The first copy keeps its doc_id; others get ids below all documents' ids: with ``floor`` the smallest of them, or 0
    if none is below, ``floor - 4 * (doc_id - floor) - copy - 1``.  A null doc_id stays null, and where the ids span so
    much that there is no room below, copies keep their document's doc_id.  Documents without words are not taken, nor
    is anything of an empty table; repeated rows are documents of their own.
    """
    keyed = _keyed(docs)
    ends = keyed.agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).first()
    floor = min(0, ends["least"] or 0)
    roomy = floor - ((max(0, ends["most"] or 0) - floor + 1) << _REPLICA_BITS) > -(1 << 63)
    taken = mix(keyed, key_col="row").filter("taken > 0").select(F.col("key").alias("row"), "size", "taken")
    copies = keyed.join(taken, "row").withColumn("copy", F.explode(F.sequence(F.lit(0), F.ceil(F.col("taken") / F.col("size")).cast("int") - 1)))
    left = F.col("taken") - F.col("copy") * F.col("size")
    # Split where words end: a repeated group would recurse once per word.
    cut = F.array_join(F.slice(F.split("text", _WORD_END), F.lit(1), left.cast("int")), "")
    text = F.when(left < F.col("size"), cut).otherwise(F.col("text"))
    below = F.lit(floor) - F.shiftleft(F.col("doc_id") - F.lit(floor), _REPLICA_BITS) - F.col("copy") - 1
    doc_id = F.when(F.col("copy") == 0, F.col("doc_id")).otherwise(below) if roomy else F.col("doc_id")
    out = copies.select(doc_id.alias("doc_id"), text.alias("text"), "lang", "source")
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*_COLUMNS)


def to_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces packed into sequences of 2048; null and empty texts are the end id alone, null and repeated ids stay."""
    return pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("ngram_jaccard", one_of_each),
    ("mixing", to_targets),
    ("packing", to_sequences),
]

#: Learnt scores and Newton's steps are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each cut off from the one before by a checkpoint."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = c.materialise(docs)
    return docs
