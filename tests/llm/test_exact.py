"""Substring and line dedup on repeats, null ids, clashing columns and a text that fills several chunks."""

import collections

from courtlake.llm.line_dedup import apply_bitmap, line_dedup
from courtlake.llm.substring_dedup import substring_dedup

SCHEMA = "doc_id long, text string, n_words int, n_lines string, chunk string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, 7, "x", "y") for i, t in rows], SCHEMA).repartition(3)


def test_substrings_of_odd_rows(spark):
    passage = " ".join(f"p{i}" for i in range(50))
    long = " ".join(f"w{i}" for i in range(900_000))
    rows = [(1, f"a b {passage} c"), (1, f"a b {passage} c"), (None, f"d {passage}"), (None, None), (2, "short"), (3, f"{long} {passage}"), (4, " ".join(f"w{i}" for i in range(1000, 1034))), (5, " ".join(f"w{i}" for i in range(1000, 1035)))]
    got = collections.Counter((r.doc_id, r.n_words, r.n_removed) for r in substring_dedup(table(spark, rows), with_text=False).collect())
    assert got == collections.Counter({(1, 53, 53): 2, (None, 51, 50): 1, (None, 0, 0): 1, (2, 1, 0): 1, (3, 900_050, 85): 1, (4, 34, 0): 1, (5, 35, 35): 1})


def test_lines_of_odd_rows(spark):
    shared, other = "a line that several documents share", "another line that several documents share"
    long = "\n".join(f"line number {i} of a very long text" for i in range(200_000))
    rows = [(1, f"{shared}\n{other}"), (1, f"{shared}\nx"), (None, shared), (None, f"{shared}\nz"), (2, f"{shared.upper()}  "), (9, f"{long}\n{other}"), (7, other), (4, None)]
    got = collections.Counter((r.doc_id, r.n_lines, r.n_dropped) for r in line_dedup(table(spark, rows)).collect())
    # Rows of one id, or without one, are one document: the first line has three (null, 1, 2) and stays in 2; the other has 1, 7 and 9.
    assert got == collections.Counter({(1, 2, 2): 1, (1, 2, 1): 1, (None, 1, 1): 1, (None, 2, 1): 1, (2, 1, 0): 1, (9, 200_001, 0): 1, (7, 1, 1): 1, (4, 1, 0): 1})
    kept = {r.doc_id: apply_bitmap(dict(rows)[r.doc_id], r.keep_bitmap) for r in line_dedup(table(spark, rows)).collect() if r.doc_id in (7, 9)}
    assert kept == {7: "", 9: rows[5][1]}
