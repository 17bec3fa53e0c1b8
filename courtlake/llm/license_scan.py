"""License scans by canonical digests; DataFrame operations only.

A text is brought to a canonical form (case, copyright lines, equivalent
spellings, punctuation and white space), digested whole, and the digest is
joined to those of the known licences.  The same expressions make the digests
of the known texts, so both sides always agree.  Lines that are, in the same
form, a known one-line notice are listed beside it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from courtlake.llm.licenses import FULL_TEXTS, NOTICES, SPELLINGS

#: The known side is broadcast only while it has no more than this many licences; above, the join shuffles.
BROADCAST_LICENSES = 20_000
#: What licences go on with after "copyright", so that a line that a wrap begins there is prose, not an owner's name;
#: small words only in capitals, since in capitals alone they look like names ("Copyright The Authors" is one).
_LEGAL = r"acts?|claims?|disclaim\w*|doctrines?|holders?|information|interests?|laws?|legends?|licen[cs]\w*|management|markings?|notices?|owners?|ownership|permissions?|protections?|registrations?|rights?|statements?|status|terms?|treat(?:y|ies)"
_SMALL = r"A|AND|ARE|AS|BY|FOR|FROM|HAS|HAVE|IF|IN|INCLUDING|IS|MAY|MUST|NOT|OF|ON|OR|SHALL|THAT|THE|THIS|TO|UNDER|WAS|WERE|WHICH|WILL|WITH"
_COPYRIGHT = (
    r"(?m)^[^\p{L}\p{N}\n(©]*(?:(?i:copyright)\s+(?:(?i:\(c\))|©|\d|(?i:by)\b|[<\[{])|(?i:\(c\))\s|©)[^\n]*$"
    rf"|^[^\p{{L}}\p{{N}}\n(©]*(?i:copyright):?[ \t]+(?!(?:(?i:{_LEGAL})|{_SMALL})\b)[\p{{Lu}}\p{{Lo}}][^\n]*$"
    r"|^[^\p{L}\n]*(?i:all rights reserved)\.?[^\p{L}\n]*$"
)


def canonical_lines(text: Column) -> Column:
    """The text's lines in canonical form; empty ones are left out."""
    raw = F.coalesce(text, F.lit(""))
    t = F.lower(raw)
    named = F.contains(t, F.lit("copyright")) | F.contains(t, F.lit("(c)")) | F.contains(t, F.lit("©")) | F.contains(t, F.lit("all rights reserved"))
    # Before lower case: an owner's name begins with a capital letter.
    t = F.when(named, F.lower(F.regexp_replace(raw, _COPYRIGHT, ""))).otherwise(t)
    t = reduce(lambda x, pair: F.replace(x, F.lit(pair[0]), F.lit(pair[1])), SPELLINGS.items(), t)
    t = F.regexp_replace(t, r"[^\p{L}\p{N}\n]+", " ")
    return F.filter(F.transform(F.split(t, "\n"), lambda line: F.trim(line)), lambda line: line != "")


def known_licenses(spark: SparkSession, texts: dict[str, str] | None = None) -> DataFrame:
    """(license_id, digest) of the known licences; equal canonical texts go to the smallest id."""
    rows = spark.createDataFrame(sorted((FULL_TEXTS if texts is None else texts).items()), "license_id string, known string")
    digest = F.sha2(F.array_join(canonical_lines(F.col("known")), " "), 256)
    return rows.groupBy(digest.alias("known_digest")).agg(F.min("license_id").alias("license_id"))


def scan_licenses(
    docs: DataFrame, licenses: DataFrame | None = None, notices: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Which documents are, as a whole, a known licence, and which notices they carry.

    Returns one row per input row: ``doc_id``, ``digest`` (SHA-256 of the
    canonical text), ``license_id`` (null if unknown) and ``notices`` (sorted
    distinct ids of the known one-line notices among its lines).

    * Null, empty and blank texts have the digest of the empty text, and match
      a known licence only if that is empty too (none is).
    * Repeated rows each give a row; null ids stay null; other columns are
      ignored.  Very long texts are digested whole.
    """
    spark = docs.sparkSession
    known = known_licenses(spark) if licenses is None else licenses.select("license_id", F.col("digest").alias("known_digest"))
    lines = docs.select(F.col(id_col).cast("long").alias("doc_id"), canonical_lines(F.col(text_col)).alias("lines"))
    ids = NOTICES if notices is None else notices
    if ids:
        form = spark.createDataFrame(sorted(ids.items()), "id string, known string").select("id", F.array_join(canonical_lines(F.col("known")), " ").alias("line"))
        by_line = {r["line"]: r["id"] for r in form.collect()}
        table = F.create_map(*[F.lit(x) for pair in sorted(by_line.items()) for x in pair])
        wanted = F.array(*map(F.lit, sorted(by_line)))
        carried = F.transform(F.array_intersect("lines", wanted), lambda x: F.element_at(table, x))
        carried = F.sort_array(F.array_distinct(carried))
    else:
        carried = F.array().cast("array<string>")
    scanned = lines.select("doc_id", F.sha2(F.array_join("lines", " "), 256).alias("digest"), carried.alias("notices"))
    if known.limit(BROADCAST_LICENSES + 1).count() <= BROADCAST_LICENSES:
        known = F.broadcast(known)
    return scanned.join(known, F.col("digest") == F.col("known_digest"), "left").select("doc_id", "digest", "license_id", "notices")
