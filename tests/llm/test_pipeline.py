"""Stages of the corpus pipeline whose own code goes beyond calling an operator."""

import re

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def cut_after(text, n):
    ends = [m.end() for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
    return text[: ends[n - 1]]


def test_mixing_cuts_whole_words_of_very_long_texts(spark):
    long = "  " + "\n\t ".join(f"w{i}" for i in range(60_000)) + " \n"
    texts = {1: long, 2: "one  two half three", 3: "lone", 4: "", 5: None}
    docs = spark.createDataFrame([(i, t, "en", "web", 0) for i, t in texts.items()], SCHEMA)
    taken = {r["doc_id"]: (r["size"], r["taken"]) for r in corpus_pipeline.mix(docs).collect()}
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.to_targets(spark, docs, "").collect()}
    want = {}
    for i, (size, n) in taken.items():
        for copy in range(-(-n // size) if n else 0):
            left = n - copy * size
            want[i if copy == 0 else -(i << 2) - copy - 1] = texts[i] if left >= size else cut_after(texts[i], left)
    assert taken[1][1] % taken[1][0]
    assert got == want


def words(n, of):
    return " ".join(f"{of}{i}" for i in range(n))


def test_near_duplicates_leave_one_row_of_a_group(spark):
    a, b, d, e = (words(40, x) for x in "abde")
    # 1 repeats; 2 is 1's text under another id; 3 holds a text of its own and 1's; rows without an id are documents too.
    rows = [(1, a), (1, a), (2, a), (3, b), (3, a), (None, d), (None, e), (None, e), (4, e)]
    out = corpus_pipeline.one_of_each(spark, spark.createDataFrame([(i, t, "en", "web", 0) for i, t in rows], SCHEMA), "")
    assert sorted((r["doc_id"] or 0, r["text"]) for r in out.collect()) == sorted([(1, a), (3, b), (0, d), (4, e)])


def test_line_dedup_does_not_multiply_repeats(spark):
    shared = "a line that many documents share\n"
    rows = [(1, shared + "x"), (1, shared + "x"), (1, shared + "y"), (None, shared + "z"), (None, shared + "z"), (2, shared), (3, shared), (4, None)]
    out = corpus_pipeline.drop_lines(spark, spark.createDataFrame([(i, t, "en", "web", 0) for i, t in rows], SCHEMA), "")
    got = sorted((r["doc_id"] or 0, r["text"] or "") for r in out.collect())
    assert got == sorted([(1, "x"), (1, "x"), (1, "y"), (0, "z"), (0, "z"), (2, ""), (3, shared), (4, "")])


def test_mixing_keeps_rows_apart(spark):
    rows = [(1, words(30, "a")), (1, words(30, "a")), (None, words(20, "b")), (None, words(25, "c")), *((i, words(30 + i, "d")) for i in range(2, 40))]
    docs = spark.createDataFrame([(i, t, "en", "web", 0) for i, t in rows], SCHEMA)
    want = sum(r["taken"] for r in corpus_pipeline.mix(docs).collect())
    out = [r["text"] for r in corpus_pipeline.to_targets(spark, docs, "").collect()]
    assert sum(len(t.split()) for t in out) == want
    assert any(t.startswith(("b0", "c0")) for t in out)


def test_toxic_rows_go_with_and_without_an_id(spark, tmp_path):
    docs = [(i, words(20, "w") + (" idiot" if i % 4 == 0 else " fine"), "en", "web", 0) for i in range(400)]
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(400)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    extra = [(None, "you idiot " + words(20, "w"), "en", "web", 0), (None, words(20, "w"), "en", "web", 0), (1, "such an idiot " + words(20, "w"), "en", "web", 0)]
    out = corpus_pipeline.drop_toxic(spark, spark.createDataFrame(docs + extra, SCHEMA), str(tmp_path))
    got = [(r["doc_id"], "idiot" in r["text"]) for r in out.collect()]
    assert len(got) == 301 and not any(bad for _, bad in got) and [i for i, _ in got].count(None) == 1


def test_ids_of_copies_are_those_of_no_document(spark):
    rows = [(i, words(20 + i, f"x{i}_"), "en", "web", 0) for i in range(-30, 30)]
    out = corpus_pipeline.to_targets(spark, spark.createDataFrame(rows, SCHEMA), "").collect()
    by_id = {}
    for r in out:
        by_id.setdefault(r["doc_id"], []).append(r["text"].split("_")[0])
    real = {i: f"x{i}" for i in range(-30, 30)}
    assert all(len(t) == 1 for t in by_id.values()) and len(by_id) > 60
    assert all(t == [real[i]] for i, t in by_id.items() if i in real)
    wide = [(-(2**63), words(30, "a"), "en", "web", 0), (2**63 - 1, words(31, "b"), "en", "web", 0), *((i, words(20 + i, "c"), "en", "web", 0) for i in range(9))]
    out = corpus_pipeline.to_targets(spark, spark.createDataFrame(wide, SCHEMA), "").collect()
    assert out and {r["doc_id"] for r in out} <= {i for i, *_ in wide}


def test_stages_on_an_empty_table_and_on_nulls(spark, tmp_path):
    labels = [(i, 1, i % 2) for i in range(10)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for rows, left in (([], 0), ([(None, None, None, None, None), (1, "", "en", None, 0), (1, "", "en", None, 0)], 3)):
        docs = spark.createDataFrame(rows, SCHEMA)
        for stage in (corpus_pipeline.drop_toxic, corpus_pipeline.drop_lines, corpus_pipeline.one_of_each):
            out = stage(spark, docs, str(tmp_path))
            assert out.count() == left and out.columns == docs.columns
        assert corpus_pipeline.to_targets(spark, docs, "").count() == 0
        assert corpus_pipeline.to_sequences(spark, docs, "").count() == left
