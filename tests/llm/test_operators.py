"""The corpus operators against brute force, with nulls, empties, repeats, ties and clashing columns."""

import collections
import hashlib
import re
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from courtlake.llm import licenses, mixing
from courtlake.llm.embedding_dedup import near_vectors
from courtlake.llm.license_scan import scan_licenses
from courtlake.llm.licenses import FULL_TEXTS
from courtlake.llm.line_dedup import apply_bitmap, kept_digest, line_dedup
from courtlake.llm.mixing import mix
from courtlake.llm.ngram_join import ngram_components, tree_links
from courtlake.llm.packing import Encoder, default_tokenizer, pack
from courtlake.llm.quality import Terms, score_quality
from courtlake.llm.substring_dedup import substring_dedup
from courtlake.llm.topk_search import top_k
from courtlake.llm.toxicity import fold, score_toxicity

from best_fit import plan_sweeps  # isort: skip

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
RNG = np.random.default_rng(7)


def prose(n):
    return " ".join(RNG.choice(["alpha", "beta", "gamma", "Delta", "naïve", "straße", "x", "omega"], n).tolist())


@pytest.fixture(scope="module")
def texts():
    shared, base = prose(60), prose(300)
    near = base.split(" ")
    near[150] = "changed"
    lines = "A line that is long enough to count\n" * 2 + prose(5)
    out = [None, "", " \t\n", "one two", "One TWO", base, base, " ".join(near), prose(40) + " " + shared, shared + "\n" + prose(10), lines, lines + "\nmore", "x\n  a LINE that is long enough to count\t"]
    out += [prose(30) + "  double  spaces here \n\n" + prose(5), prose(9000)]
    return list(enumerate(out))


@pytest.fixture
def docs(spark, texts):
    rows = [(i, t, "src" if i % 3 else None, 1) for i, t in texts]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, chunk int").repartition(3)


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string")


def words(t):
    return WORD.findall((t or "").encode())


def test_substring_dedup(docs, texts, empty):
    seen = collections.Counter(tuple(w[i : i + 35]) for _, t in texts for w in [words(t)] for i in range(len(w) - 34))
    for r in substring_dedup(docs).collect():
        w = words(dict(texts)[r.doc_id])
        gone = [False] * len(w)
        for i in range(len(w) - 34):
            if seen[tuple(w[i : i + 35])] > 1:
                gone[i : i + 35] = [True] * 35
        assert (r.n_words, r.n_removed, r.kept_text.encode()) == (len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g))
        assert sum(s.end - s.begin for s in r.spans) == r.n_removed
    assert substring_dedup(empty).count() == 0


def test_substring_dedup_inside_one_document(spark):
    t = " ".join(f"w{i}" for i in range(40))
    r = substring_dedup(spark.createDataFrame([(1, t + " mid " + t)], "doc_id long, text string")).first()
    assert (r.n_words, r.n_removed, r.kept_text) == (81, 80, "mid")


def test_line_dedup(docs, texts, empty):
    key = lambda line: line.strip(" \t\n\v\f\r").translate({c: c + 32 for c in range(65, 91)})
    held = collections.defaultdict(set)
    for i, t in texts:
        for line in (t or "").split("\n"):
            held[key(line)].add(i)
    want = {}
    for i, t in texts:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(key(x)) >= 20 and len(held[key(x)]) >= 3 and max(held[key(x)]) != i)]
        want[i] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    for r in line_dedup(docs).collect():
        assert (r.n_lines, r.n_dropped, apply_bitmap(dict(texts)[r.doc_id], r.keep_bitmap)) == want[r.doc_id]
    assert {r.doc_id: r.kept_sha256 for r in kept_digest(docs).collect()} == {i: hashlib.sha256(w[2].encode()).hexdigest() for i, w in want.items()}
    assert any(w[1] for w in want.values()) and line_dedup(empty).count() == 0


def components(sets, percent=75):
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


def shingles(t):
    w = [x.lower() for x in words(t)]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_ngram_components(docs, texts, empty):
    sets = {i: shingles(t) for i, t in texts}
    want = components(sets)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_components(docs).collect()}
    assert got == {i: (len(s), want[i]) for i, s in sets.items()}
    assert want[7] == 5 and want[4] == 3 and ngram_components(empty).count() == 0


def test_ngram_components_large_cluster(spark, monkeypatch):
    from courtlake.llm import ngram_join

    monkeypatch.setattr(ngram_join, "CLUSTER_SETS", 20)
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", 8)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(90):
        w = list(base)
        for at in RNG.choice(120, int(RNG.integers(1, 9)), replace=False):
            w[at] = f"n{i}_{at}"
        rows.append((i, " ".join(w)))
    want = components({i: shingles(t) for i, t in rows})
    got = {r.doc_id: r.component_id for r in ngram_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want and len(set(want.values())) > 1


def test_tree_links_equal_brute_force():
    base = RNG.integers(0, 2**63, 300).astype(np.uint64)
    sets = []
    for _ in range(120):
        keep = base[RNG.random(300) < RNG.choice([0.5, 0.8, 0.97])]
        sets.append(np.unique(np.concatenate([keep, RNG.integers(0, 2**63, int(RNG.integers(1, 40))).astype(np.uint64)])))
    links = tree_links(np.arange(120), np.array([len(s) for s in sets]), sets, 75)
    want = components({i: set(s.tolist()) for i, s in enumerate(sets)})
    root = {i: i for i in range(120)}
    for a, b in zip(links["a"].to_pylist(), links["b"].to_pylist()):
        x, y = root[a], root[b]
        root = {k: min(x, y) if v in (x, y) else v for k, v in root.items()}
    assert root == want


def test_top_k(spark):
    x = RNG.normal(0, 0.2, (400, 16))
    x[7] = x[9]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(1000, None, 0), (1001, [float("nan")] * 16, 0), (1050, [1.0] * 15 + [None], 0)]
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), every=20).collect()}
    v = np.floor(256 * x).astype(np.int64)
    want = {}
    for q in range(0, 400, 20):
        s = v @ v[q]
        for k, i in enumerate([i for i in np.lexsort((np.arange(400), -s)) if i != q][:5]):
            want[q, k + 1] = (i, s[i])
    assert got == want
    none = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert top_k(none).count() == 0
    assert top_k(spark.createDataFrame([(0, [1.0]), (1, [0.5])], "vec_id long, embedding array<double>")).collect()[0][:] == (0, 1, 1, 256 * 128)


def test_near_vectors(spark):
    base = RNG.normal(size=(150, 32))
    rows = [(3 * i, v.tolist()) for i, v in enumerate(base)]
    rows += [(3 * i + 1, (v + RNG.normal(size=32) * 0.05).tolist()) for i, v in enumerate(base[:40])]
    rows += [(1000 + i, (base[0] + RNG.normal(size=32) * 0.03).tolist()) for i in range(60)]
    rows += [(2000, None), (2001, [0.0] * 32), (2002, [float("inf")] * 32), (2003, base[1].tolist()), (2004, base[1].tolist())]
    got = {r.vec_id: r for r in near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    ids = [i for i, v in rows if v and np.isfinite(v).all() and any(v)]
    x = np.array([v for i, v in rows if i in ids])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.95
    np.fill_diagonal(near, False)
    assert sum(got[i].n_links for i in ids) >= 0.95 * near.sum() and all(got[i].n_links <= n for i, n in zip(ids, near.sum(1)))
    assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i in (2000, 2001, 2002))
    assert got[1000].component_id == 0 and not got[1000].kept and got[2004].component_id == 3
    assert near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_packing(docs, texts, empty):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(default_tokenizer())
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in pack(docs, with_ids=True).collect():
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    for i, t in texts:
        ids, at = tokenizer.encode(t or "", add_special_tokens=False).ids + [0], 0
        for k, p in enumerate(sorted(pieces[i], key=lambda p: p.piece)):
            part = np.array(ids[at : at + p.length], "<u4").tobytes()
            assert (p.piece, p.start, p.ids_crc32, bytes(p.ids)) == (k, at, zlib.crc32(part), part)
            at += p.length
        assert at == len(ids)
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 2048
    assert pack(empty).count() == 0


def test_encoder_runs():
    e = Encoder(default_tokenizer())
    for t in ("a  b", " a", "a ", "a \n b\n\nc", "it's fine x  y", "　 a b", "a b\tc d", "é ü  ß", "  ", "\n", "x <|endoftext|> y", ""):
        assert np.frombuffer(e.encode(t), "<u4").tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids, t


def test_plan_sweeps_bounds():
    counts = {int(k): int(v) for k, v in zip(RNG.integers(1, 2048, 300), RNG.integers(1, 50, 300))}
    plan, opened = plan_sweeps(counts, 2048)
    placed = collections.Counter()
    for length, lo, hi, *_ in plan:
        placed[length] += hi - lo
    assert placed == counts
    least = -(-sum(k * v for k, v in counts.items()) // 2048)
    assert opened <= 1.1 * least + 1


def test_mix(docs, texts, empty, spark):
    got = mix(docs).collect()
    assert len(got) == len(texts) and sorted(map(str, got)) == sorted(map(str, mix(docs).collect()))
    by = collections.defaultdict(lambda: [0, 0, 0, 0])
    for r in got:
        assert r["size"] == len(words(dict(texts)[r.doc_id])) and 0 <= r.taken <= 2 * r["size"]
        x = by[r.source]
        x[0], x[1], x[2], x[3] = x[0] + r["size"], x[1] + r.taken, r.target, r.source_size
    assert all(abs(t - goal) <= 1 and size == s for size, t, goal, s in by.values())
    assert mix(empty).count() == 0
    rows = [(i, "w " * (5 + i % 7), f"s{i % 4}") for i in range(200)]
    made = mix(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    goals = {r.source: r.target for r in made.select("source", "target").distinct().collect()}
    assert abs(sum(goals.values()) - 1.5 * sum(5 + i % 7 for i in range(200))) < 1e-6
    assert goals["s0"] == 2 * sum(5 + i % 7 for i in range(0, 200, 4)) and abs(goals["s1"] - 2 * goals["s2"]) < 1e-6 and "Python" not in made._jdf.queryExecution().toString()


def test_licenses(spark):
    mit = FULL_TEXTS["MIT"].replace("MIT License\n", "MIT Licence\n\nCopyright (c) 2020 A. Person\n").upper().replace("\n", "  \n ")
    rows = [(1, mit), (2, None), (3, ""), (4, "hello\nReleased under the MIT license\nbye"), (5, FULL_TEXTS["ISC"] + " and more"), (5, FULL_TEXTS["Zlib"])]
    got = scan_licenses(spark.createDataFrame(rows, "doc_id long, text string"))
    by = sorted((r.doc_id, r.license_id or "", r.notices) for r in got.collect())
    assert by == [(1, "MIT", []), (2, "", []), (3, "", []), (4, "", ["MIT"]), (5, "", []), (5, "Zlib", [])]
    assert "Python" not in got._jdf.queryExecution().toString()


def test_licenses_of_common_texts_in_all_forms(spark):
    def whole(name, cut=None):
        text = (Path(licenses.__file__).with_name("license_texts") / f"{name}.txt").read_text("utf-8")
        return text if cut is None else text.partition(cut)[2]

    bsd, zlib = FULL_TEXTS["BSD-3-Clause"], FULL_TEXTS["Zlib"]
    cases = {name: whole(name) for name in ("Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "BSL-1.0", "Unlicense", "CC0-1.0")}
    cases |= {"Apache-2.0 (cut)": whole("Apache-2.0", "http://www.apache.org/licenses/").partition("APPENDIX:")[0], "GPL-3.0 (cut)": whole("GPL-3.0", "29 June 2007")}
    cases |= {"MPL-2.0 (cut)": whole("MPL-2.0", "Version 2.0"), "BSL-1.0 (cut)": whole("BSL-1.0", "17th, 2003"), "CC0-1.0 (cut)": whole("CC0-1.0", "Legal Code")}
    cases |= {"GPL-2.0 (59)": re.sub(r"51 Franklin Street, Fifth Floor, Boston, MA\s+02110-1301,? USA", "59 Temple Place, Suite 330, Boston, MA 02111-1307 USA", whole("GPL-2.0"))}
    cases |= {"BSD-3-Clause": f"BSD 3-Clause License\n\nCopyright (c) 2020, A\n{bsd}", "BSD-2-Clause": "BSD 2-Clause License\n" + FULL_TEXTS["BSD-2-Clause"], "Zlib": f"zlib License\n{zlib}"}
    cases |= {"0BSD": "BSD Zero Clause License\n" + FULL_TEXTS["0BSD"], "MIT": "Copyright Joyent, Inc. and other Node contributors.\n" + FULL_TEXTS["MIT"], "ISC": "Copyright The Authors\n" + FULL_TEXTS["ISC"]}
    got = scan_licenses(spark.createDataFrame(list(enumerate(cases.values())), "doc_id long, text string")).collect()
    found = {list(cases)[r.doc_id]: r.license_id for r in got}
    assert {k: (v or "").split(" ")[0] for k, v in found.items()} == {k: k.split(" ")[0] for k in cases}


def test_licenses_do_not_depend_on_wraps_before_copyright(spark):
    owner = re.compile(r"copyright\s+(?:\(c\)|©|\d|by\b|[<\[{])", re.I)
    wrap = lambda line: line if owner.search(line) else re.sub(r"[ \t]+(?=copyright\b)", "\n", line, flags=re.I)
    texts = [x for t in FULL_TEXTS.values() for x in (t, t.upper())]
    rows = [(i, x) for i, t in enumerate(texts) for x in (t, "\n".join(map(wrap, t.split("\n"))))]
    got = scan_licenses(spark.createDataFrame(rows, "doc_id long, text string"), notices={}).groupBy("doc_id").agg(F.countDistinct("digest").alias("n"), F.count("license_id").alias("known"))
    assert {(r.n, r.known) for r in got.collect()} == {(1, 2)}


def labelled(spark):
    docs, labels = [], []
    for i in range(400):
        bad, toxic = i % 4 == 0, i % 5 == 0
        w = prose(60).split(" ")
        if toxic:
            w[int(RNG.integers(60))] = ["idiot", "1d10t", "ІDIOT", "scum"][i % 4 if i % 3 else 0]
        docs.append((i, " ".join(x.upper() + "!!" if bad else x for x in w)))
        labels.append((i, 0 if bad else 1, int(toxic)))
    docs += [(1000, None), (1001, ""), (1002, "idiot " + prose(20)), (1003, prose(50))]
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality(spark):
    docs, labels = labelled(spark)
    got = {r.doc_id: r for r in score_quality(docs, labels, learn=F.col("doc_id") % 3 != 0).collect()}
    assert np.mean([got[r.doc_id].predicted == r.quality for r in labels.collect() if r.doc_id % 3 == 0]) > 0.95
    assert 0 <= got[1000].score <= 1 and got[1000].score == got[1001].score
    assert {r.score for r in score_quality(docs, labels.limit(0)).collect()} == {0.5}


def test_toxicity(spark):
    docs, labels = labelled(spark)
    got = {r.doc_id: r for r in score_toxicity(docs, labels, learn=F.col("doc_id") % 3 != 0).collect()}
    assert np.mean([got[r.doc_id].predicted == r.toxic for r in labels.collect() if r.doc_id % 3 == 0]) > 0.95
    assert got[1002].predicted == 1 and got[1003].predicted == 0 and got[1000].predicted == 0
    assert {r.predicted for r in score_toxicity(docs, labels.limit(0)).collect()} == {0}


def test_fold():
    assert fold("1d10t").strip() == "idiot" and fold("ｉｄｉｏｔ").strip() == "idiot" and fold("scüm").strip() == "scum"
    assert fold("in 2024 $5").split() == ["in"]


@pytest.mark.parametrize("bad,good", [("zog", "zogu"), ("дурак", "мир"), ("笨蛋", "早安"), ("احمق", "سلام")])
def test_toxicity_of_short_words_and_other_scripts(spark, bad, good):
    docs = [(i, f"{prose(12)} {bad if i % 4 == 0 else good} {prose(12)}", int(i % 4 == 0)) for i in range(400)]
    table = spark.createDataFrame([(i, t) for i, t, _ in docs], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in docs], "doc_id long, toxic int")
    got = {r.doc_id: r.predicted for r in score_toxicity(table, labels, learn=F.col("doc_id") % 3 != 0).collect()}
    assert all(got[i] == y for i, _, y in docs)


def test_toxicity_does_not_depend_on_padding(spark):
    docs, labels = labelled(spark)
    text = "idiot " + prose(20)
    padded = spark.createDataFrame([(2000, text), (2001, text.replace(" ", "   \n--- 123 !!! ") + " " * 5000)], docs.schema)
    got = {r.doc_id: r.score for r in score_toxicity(docs.unionByName(padded), labels, learn=F.col("doc_id") < 1000).collect()}
    assert got[2000] == got[2001]


@pytest.mark.parametrize("gap", [1, 37, 700, -955, 4001])
def test_mixing_closes_gaps_of_any_size(spark, gap):
    rows = [("a", gap, room, 0, int(RNG.integers(-(2**63), 2**63)) if i % 3 else 9, i if i % 3 else 0, i) for i, room in enumerate([5] * 600 + [7] * 200)]
    roomy = spark.createDataFrame(rows, "source string, gap long, room long, size long, tie long, doc_id long, row long")
    changed = {r.f_row: r.f_change for r in mixing._closing(roomy).collect()}
    assert sum(changed.values()) == gap
    assert all(abs(x) <= rows[i][2] for i, x in changed.items()) and sum(abs(x) < rows[i][2] for i, x in changed.items()) <= 1


def test_quality_shape_is_that_of_the_whole_word():
    shape_of = lambda word: Terms()[word.encode()] >> 16 & 0xFFFF
    assert shape_of("字" * 64 + "!!!0A") != shape_of("字" * 64) == shape_of("字" * 5000)
