"""Toxicity, quality and licences beyond accuracy: weights, exceptions, votes recomputed, odd tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from courtlake.llm import common as c
from courtlake.llm import license_scan
from courtlake.llm import quality as q
from courtlake.llm.license_scan import known_licenses, scan_licenses
from courtlake.llm.licenses import FULL_TEXTS
from courtlake.llm.toxicity import ODDS, automaton, cover, features, score_toxicity, weigh

RNG = np.random.default_rng(29)
WORDS = ["river", "stone", "green", "paper", "morning", "window", "garden", "seven"]


def prose(n, of=WORDS):
    return " ".join(RNG.choice(of, n).tolist())


def tables(spark, rows):
    """Rows (id, text, label); the table has columns that clash with the operators' own names."""
    docs = spark.createDataFrame([(i, t, "x", 0.5, 1) for i, t, _ in rows], "doc_id long, text string, key string, score double, label int")
    return docs, spark.createDataFrame([(i, y, y) for i, _, y in rows if y is not None], "doc_id long, toxic int, quality int")


@pytest.mark.parametrize("share", [0.05, 0.5, 0.95])
def test_any_share_of_toxic_labels(spark, share):
    bad = ["zorkish", "blarfed"]
    rows = []
    for i in range(400):
        toxic = int(RNG.random() < share)
        # Long toxic texts and short clean ones: ordinary words are in more toxic texts than clean ones.
        text = prose(80 if toxic else 15)
        rows.append((i, f"{text} {bad[i % 2]} {bad[0]}" if toxic else text, toxic))
    docs, labels = tables(spark, rows)
    got = {r.doc_id: r for r in score_toxicity(docs, labels).collect()}
    assert all(0 <= r.score <= 1 for r in got.values()) and np.mean([got[i].predicted == y for i, _, y in rows]) > 0.95


def test_terms_have_positive_weight_and_length_counts():
    held = [np.array([0, 1]), np.array([0]), np.array([1])]
    terms = cover([("good", 2, 0), ("even", 2, 0)], held, 3, 40, 0.05, 1.0)
    assert terms and all(w > 0 for w in terms.values()) and ODDS > 1
    a = automaton({"scum ": 2.0, "zork": 1.5}, ["pond scum"])
    assert weigh(" you scum zorkish ", a) == 3.5 and weigh(" the pond scum grew ", a) == 0 and weigh(" pond scum and scum ", a) == 2.0 and weigh(" ascum scumbag ", a) == 0
    assert all(x > y for x, y in zip(features(3.0, 10)[1:], features(3.0, 1000)[1:])) and features(0.0, 5) == (1.0, 0.0, 0.0)


def test_phrases_that_clean_texts_use_are_exceptions(spark):
    rows = [(i, f"{prose(10)} you scum {prose(10)}", 1) for i in range(120)]
    rows += [(200 + i, f"{prose(10)} pond scum {prose(10)}", 0) for i in range(25)] + [(300 + i, prose(20), 0) for i in range(300)]
    rows += [(900, f"{prose(8)} pond scum {prose(8)}", None), (901, f"{prose(8)} you scum {prose(8)}", None)]
    docs, labels = tables(spark, rows)
    got = {r.doc_id: r.predicted for r in score_toxicity(docs, labels).collect()}
    assert (got[900], got[901]) == (0, 1)


def test_toxicity_of_odd_tables(spark):
    rows = [(i, f"{prose(10)} {'zorkish' if i % 4 == 0 else 'fine'}", int(i % 4 == 0)) for i in range(200)]
    odd = [(500, None, None), (501, "", None), (502, "zorkish " * 20000, None), (502, "zorkish " * 20000, None), (None, "zorkish", None)]
    docs, labels = tables(spark, rows + odd)
    # One labelled id on very many rows adds one text to what is learnt from.
    docs = docs.union(docs.filter("doc_id = 0").join(spark.range(50), how="cross").drop("id"))
    got = score_toxicity(docs, labels).collect()
    assert len(got) == 255 and sum(r.doc_id == 0 for r in got) == 51
    of = {r.doc_id: r.predicted for r in got}
    assert of[500] == of[501] == 0 and of[502] == of[None] == of[0] == 1
    assert score_toxicity(docs.limit(0), labels).count() == 0


def test_nearest_equals_a_stable_sort():
    x = RNG.integers(0, 6, (200, 30)) / 5
    got = q.nearest(x.astype(np.float32), 7)
    assert [r.tolist() for r in got] == [sorted(np.argsort(-r, kind="stable")[:7].tolist()) for r in x.astype(np.float32)]


def test_votes_equal_those_recomputed(spark):
    rows = [(i, prose(30) if i % 3 else prose(30).upper() + "!!", int(i % 3 > 0)) for i in range(150)]
    rows += [(200, "", None), (201, None, None), (202, rows[0][1], None), (202, rows[1][1], None), (203, "WORD " * 5, None), (None, rows[2][1], None)]
    docs, labels = tables(spark, rows)
    got = sorted(((-1 if r.doc_id is None else r.doc_id), round(r.score, 5)) for r in q.score_quality(docs, labels).collect())
    plain = c.id_and_text(docs)
    counts, y = q._sample(plain, q.labelled_rows(labels, "quality", F.lit(True)), q.PER_CLASS)
    df, n = q.document_frequencies(plain)
    cache = q.Terms()
    assert n == len(rows) and (df == sum((q.term_counts((t or "").encode(), cache) > 0 for _, t, _ in rows), np.zeros(q.TERMS))).all()
    idf = np.log((1 + n) / (1 + df)) + 0.1
    x = q.document_vectors(counts, idf)
    values, vectors = np.linalg.eigh(x.T @ x)
    base = vectors[:, np.argsort(-values)[: q.RANK]].astype(np.float32)
    near = x.astype(np.float32) @ base
    near /= np.linalg.norm(near, axis=1, keepdims=True)
    want = []
    for i, t, _ in rows:
        one = q.term_counts((t or "").encode(), cache)
        if not one.any():
            want.append((i, 2 / 3))
            continue
        v = (q.document_vectors(one[None], idf).astype(np.float32) @ base)[0]
        cosine = near @ (v / np.linalg.norm(v))
        best = sorted(range(len(cosine)), key=lambda k: (-cosine[k], k))[: q.NEIGHBOURS]
        w = np.maximum(cosine[best], 1e-6).astype(float) ** q.SHARPNESS
        want.append((-1 if i is None else i, float((w * y[best]).sum() / w.sum())))
    assert [i for i, _ in got] == [i for i, _ in sorted(want)] and np.allclose(sorted(s for _, s in got), sorted(s for _, s in want), atol=2e-3)
    assert q.score_quality(docs.limit(0), labels).count() == 0


def test_licences_of_odd_tables(spark, monkeypatch):
    rows = [(1, FULL_TEXTS["MIT"], "a"), (1, FULL_TEXTS["MIT"], "a"), (None, FULL_TEXTS["ISC"], "b"), (2, "x " * 200_000, "c"), (3, None, "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, digest string")
    got = sorted((r.doc_id or 0, r.license_id or "") for r in scan_licenses(docs).collect())
    assert got == [(0, "ISC"), (1, "MIT"), (1, "MIT"), (2, ""), (3, "")] and scan_licenses(docs.limit(0)).count() == 0
    monkeypatch.setattr(license_scan, "BROADCAST_LICENSES", 0)
    shuffled = scan_licenses(docs)
    assert sorted((r.doc_id or 0, r.license_id or "") for r in shuffled.collect()) == got
    own = known_licenses(spark, {"Mine": "Do what\n you LIKE."}).withColumnRenamed("known_digest", "digest")
    mine = spark.createDataFrame([(1, "do what you like"), (2, "(c) 2020 Me\nDo  WHAT, you like!"), (3, "do what you like now")], "doc_id long, text string")
    assert [r.license_id for r in scan_licenses(mine, own).orderBy("doc_id").collect()] == ["Mine", "Mine", None]
