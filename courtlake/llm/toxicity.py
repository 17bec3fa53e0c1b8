"""Toxicity by a weighted lexicon.

Texts are folded first: compatibility forms and accents, look-alike letters of
other scripts, digits and signs that stand for letters inside words; i and l
become one letter, since 1 stands for both.  Letters of scripts without look-alikes
stay, and runs of scripts that put no spaces become pairs of letters.  The lexicon's
terms are word beginnings and whole words, learnt from labelled documents by sequential covering: the one whose
excess in the toxic documents not yet explained is largest is taken, while that
excess is beyond chance among all candidates.  Words that hold a term
but are mostly seen in clean documents, alone or with a neighbour, are learnt
as exception phrases.  One Aho-Corasick automaton matches terms and exceptions;
an exception cancels the terms inside it.  The weights found, against the
text's length, give the score through a logistic curve fitted on the same rows.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courtlake.llm import common as c
from courtlake.llm.quality import labelled_rows

#: Labelled documents of each class that are learnt from, at most; those with the smallest hash of their id.
PER_CLASS = 8000
#: Letters of the word beginnings that may be terms; a whole word may be of any length.
SHORTEST, LONGEST = 4, 9
#: A term is in so many times more toxic documents than clean ones, both by number and by the classes' shares.
ODDS = 4
THRESHOLD = 0.5

#: Letters of other scripts that look like Latin ones (after compatibility decomposition).
HOMOGLYPHS = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x",
    "ѕ": "s", "і": "i", "ј": "j", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ѵ": "v", "ո": "n", "օ": "o", "ս": "u",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "σ": "o", "τ": "t", "υ": "u", "χ": "x", "ω": "w",
    "ß": "ss", "ø": "o", "æ": "ae", "œ": "oe", "đ": "d", "ħ": "h", "ı": "i", "ł": "l", "ŧ": "t", "ɑ": "a", "ɡ": "g", "ɩ": "i", "ʀ": "r", "ѐ": "e",
}
#: Digits and signs that stand for letters.
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "l": "i", "|": "i"}
_HOMOGLYPHS = str.maketrans(HOMOGLYPHS)
_BYTES = bytes(
    ord(SUBSTITUTES[chr(b)]) if chr(b) in SUBSTITUTES else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
_SIGNS = re.compile(rb"[0-9@$|]")
# Numbers, and signs that do not begin or break up a word, are not letters.
_NOT_LETTERS = re.compile(
    rb"(?<![a-z\x80-\xff0-9@$])[0-9@$]+(?![a-z\x80-\xff0-9@$])|[@$]+(?![a-z\x80-\xff0-9@$])|(?<![a-z\x80-\xff])\|+|\|+(?![a-z\x80-\xff])|[0-9]*[26][0-9]*(?![a-z\x80-\xff])"
)
_FOREIGN = re.compile(r"[^\x00-\x7f]+")
#: Scripts without spaces: Thai, Lao, Myanmar, Khmer, kana, ideographs.
_UNSPACED = re.compile(r"[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3041-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]+")


def _letters(run: re.Match) -> str:
    """Letters, and the vowel signs of Indic scripts and their neighbours; accents, points and signs go."""
    return "".join(ch for ch in run[0] if ch.isalpha() or "\u0900" <= ch <= "\u1aaf" and unicodedata.category(ch) in ("Mn", "Mc"))


def _pairs(run: re.Match) -> str:
    """Every two letters that follow each other, as words."""
    x = run[0]
    return " " + (" ".join(x[i : i + 2] for i in range(len(x) - 1)) or x) + " "


def fold(text: str) -> str:
    """Words of letters, each after one space; ends with a space."""
    if not text.isascii():
        text = _FOREIGN.sub(_letters, unicodedata.normalize("NFKD", text).lower().translate(_HOMOGLYPHS))
        raw = _UNSPACED.sub(_pairs, text).encode("utf-8", "ignore")
    else:
        raw = text.encode()
    raw = raw.lower().replace(b"'", b"")
    if _SIGNS.search(raw):
        raw = _NOT_LETTERS.sub(b" ", raw)
    return " " + "".join(f"{w} " for w in raw.translate(_BYTES).decode().split())


def _candidates(word: str) -> list[str]:
    """The whole word, with a space at its end, and its beginnings."""
    return [word + " ", *(word[:n] for n in range(SHORTEST, min(len(word), LONGEST) + 1))]


def _beginnings(words: set[str]) -> set[str]:
    return {x for w in words for x in _candidates(w)}


def excess(toxic: Column, clean: Column, share: float) -> Column:
    """Log-likelihood gained over chance by a term in so many toxic and clean documents; 0 if it is no likelier in toxic ones.

    ``share`` is the toxic documents' part of all words: what chance would give.
    """
    p = toxic / (toxic + clean)
    gain = toxic * F.log(p / share) + F.when(clean > 0, clean * F.log((1 - p) / (1 - share))).otherwise(0.0)
    return F.when(p > share, gain).otherwise(0.0)


def term_weight(toxic: int, clean: int, of: tuple[int, int]) -> float:
    """Log ratio of a term's shares in the (toxic, clean) documents."""
    return math.log((toxic + 0.5) / (of[0] + 1)) - math.log((clean + 0.5) / (of[1] + 1))


def cover(candidates: list[tuple[str, int, int]], held: list[np.ndarray], toxic: int, clean: int, share: float, bound: float) -> dict[str, float]:
    """Sequential covering: the term that explains most of the toxic documents not yet explained, again and again.

    ``held`` has the numbers of the candidates in each toxic document.  What
    copies of one toxic document have in common is explained by its true terms,
    so it does not enter the lexicon by its copies' number.
    """
    n = len(candidates)
    of_doc = [[] for _ in range(n)]
    for d, terms in enumerate(held):
        for t in terms.tolist():
            of_doc[t].append(d)
    left = np.array([len(x) for x in of_doc], np.int64)
    open_docs, found = np.ones(len(held), bool), {}
    clean_of = np.array([x[2] for x in candidates], np.float64)
    # Where a whole word explains no more than a beginning does, the beginning also finds its other forms.
    length = np.array([0 if x[0].endswith(" ") else len(x[0]) for x in candidates])
    while n:
        p = left / np.maximum(left + clean_of, 1)
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = np.where(p > share, left * np.log(p / share) + np.where(clean_of > 0, clean_of * np.log(np.maximum(1 - p, 1e-12) / (1 - share)), 0), 0)
        best = int(np.lexsort((-length, -gain))[0])
        if gain[best] < bound:
            break
        term, t, c_ = candidates[best]
        found[term] = term_weight(t, c_, (toxic, clean))
        for d in of_doc[best]:
            if open_docs[d]:
                open_docs[d] = False
                left[held[d]] -= 1
    return found


def automaton(terms: dict[str, float], exceptions: list[str]) -> ahocorasick.Automaton | None:
    a = ahocorasick.Automaton()
    for t, w in terms.items():
        a.add_word(" " + t, (len(t) + 1, w, False))
    for e in exceptions:
        a.add_word(f" {e} ", (len(e) + 2, 0.0, True))
    if not len(a):
        return None
    a.make_automaton()
    return a


def weigh(folded: str, a: ahocorasick.Automaton | None) -> float:
    """Summed weights of the terms outside exceptions."""
    if a is None:
        return 0.0
    hits, spared = [], []
    for end, (size, weight, exception) in a.iter(folded):
        (spared if exception else hits).append((end - size + 1, end, weight))
    if spared:
        hits = [h for h in hits if not any(s <= h[0] and h[1] <= e for s, e, _ in spared)]
    return sum(w for _, _, w in hits)


def features(weight: float, words: int) -> tuple[float, float, float]:
    """What the curve is fitted on: the weight found for the text's length, twice.  Weights are never negative."""
    density = weight / math.log2(8 + words)
    return 1.0, math.log1p(density), density


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    b = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(b)), x.T @ (y - p) - ridge * b)
        b += step
        if np.abs(step).max() < 1e-8:
            break
    return b


def learn_lexicon(docs: DataFrame, rows: DataFrame, per_class: int = PER_CLASS) -> tuple[dict[str, float], list[str], np.ndarray]:
    """(terms, exceptions, curve) from the texts of the labelled rows (doc_id, label)."""
    picked = None
    for y in (0, 1):
        one = rows.filter(F.col("label") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        picked = one if picked is None else picked.unionByName(one)
    # An id may be repeated by any number of rows; the text with the smallest hash stands for it, so the bound holds for rows.
    one_each = docs.join(picked, "doc_id").groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.min("label").alias("label"))
    texts = c.materialise(one_each.select("text", "label"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: tuple[Counter, Counter] = (Counter(), Counter())
        docs_of, words_of = [0, 0], [0, 0]
        for b in batches:
            for t, y in zip(b.column("text").to_pylist(), b.column("label").to_pylist(), strict=True):
                words = fold(t or "").split()
                docs_of[y] += 1
                words_of[y] += len(words)
                found[y].update(_beginnings(set(words)))
        names = sorted(found[0].keys() | found[1].keys())
        # Rows named "" carry the documents, those named " " the words.
        table = [("", *docs_of[::-1]), (" ", *words_of[::-1])] + [(x, found[1][x], found[0][x]) for x in names]
        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*table, strict=True), (pa.string(), pa.int64(), pa.int64()), strict=True)], names=["term", "toxic", "clean"])

    summed = texts.mapInArrow(count, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    summed = c.materialise(summed)
    total = {r["term"]: (r["toxic"], r["clean"]) for r in summed.filter("trim(term) = ''").collect()}
    toxic, clean = total.get("", (0, 0))
    words = total.get(" ", (0, 0))
    if not toxic or not clean or not sum(words):
        return {}, [], np.array([-2.0, 0.0, 0.0])
    share = min(max(words[0] / sum(words), 1e-4), 1 - 1e-4)
    bound = math.log(max(2, summed.count())) + 1
    # Only what may pass, each likelier in a toxic document than in a clean one, so that its weight is above 0.
    odds = f"toxic >= {ODDS} * clean and toxic * {clean}L >= {ODDS} * clean * {toxic}L"
    passing = summed.filter("toxic >= 3 and trim(term) <> ''").filter(odds).filter(excess(F.col("toxic"), F.col("clean"), share) >= bound)
    counts = [x for r in passing.orderBy(F.desc("toxic"), "term").collect() if term_weight((x := tuple(r))[1], x[2], (toxic, clean)) > 0]
    numbers = {x[0]: i for i, x in enumerate(counts)}

    def hold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [sorted(numbers[x] for x in _beginnings(set(fold(t or "").split())) if x in numbers) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.int32()))], names=["held"])

    held = [np.array(x.as_py(), np.int64) for x in texts.filter("label = 1").select("text").mapInArrow(hold, "held array<int>").toArrow().column("held")]
    terms = cover(counts, held, toxic, clean, share, bound)
    exceptions = _learn_exceptions(texts, terms)
    lexicon = (terms, exceptions)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = automaton(*lexicon)
        for b in batches:
            folded = [fold(t or "") for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([weigh(f, a) for f in folded], pa.float64()), pa.array([len(f.split()) for f in folded], pa.int64()), b.column("label")], names=["weight", "words", "label"]
            )

    measured = texts.mapInArrow(measure, "weight double, words long, label int").toPandas()
    x = np.array([features(w, n) for w, n in zip(measured["weight"], measured["words"], strict=True)])
    return terms, exceptions, fit_logistic(x, measured["label"].to_numpy(np.float64))


def _learn_exceptions(texts: DataFrame, terms: dict[str, float]) -> list[str]:
    """Words and word pairs that hold a term and are seen more in clean documents than in toxic ones."""

    def phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: tuple[Counter, Counter] = (Counter(), Counter())
        for b in batches:
            for t, y in zip(b.column("text").to_pylist(), b.column("label").to_pylist(), strict=True):
                words, here = fold(t or "").split(), set()
                for i, w in enumerate(words):
                    if any(x in terms for x in _candidates(w)):
                        here.update({w, " ".join(words[max(0, i - 1) : i + 1]), " ".join(words[i : i + 2])})
                found[y].update(here)
        names = sorted(found[0].keys() | found[1].keys())
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array([found[1][n] for n in names], pa.int64()), pa.array([found[0][n] for n in names], pa.int64())], names=["phrase", "toxic", "clean"]
        )

    if not terms:
        return []
    summed = texts.mapInArrow(phrases, "phrase string, toxic long, clean long").groupBy("phrase").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    return [r["phrase"] for r in summed.filter("clean >= 2 and clean > 2 * toxic").orderBy(F.desc("clean"), "phrase").collect()]


def score_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    learn: Column | None = None,
    per_class: int = PER_CLASS,
    threshold: float = THRESHOLD,
    id_col: str = "doc_id",
    text_col: str = "text",
    key_col: str | None = None,
) -> DataFrame:
    """Toxicity of every document, learnt from ``labels(doc_id, toxic)``.

    ``learn`` says, in terms of ``doc_id``, which labels may be learnt from
    (all by default).  Returns one row per input row: ``doc_id``, ``score``
    (0 to 1, higher: toxic likelier) and ``predicted`` (score >= threshold);
    with ``key_col`` also ``key``, that column as text.

    * Null and empty texts have no hits and score as any text without hits.
    * Without toxic and clean labels to learn from, nothing is a term and every
      text scores low.  Of rows that repeat a labelled id one is learnt from.  Repeated rows each get a row; null ids stay null; other
      columns are ignored.  Whole texts are scanned, however long.
    """
    carried = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *([F.col(key_col).cast("string").alias("key")] if key_col else []))
    docs = c.id_and_text(docs, id_col, text_col)
    terms, exceptions, curve = learn_lexicon(docs, labelled_rows(labels, "toxic", F.lit(True) if learn is None else learn), per_class)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = automaton(terms, exceptions)
        for b in batches:
            out = []
            for t in b.column("text").to_pylist():
                folded = fold(t or "")
                weight = weigh(folded, a)
                x = features(weight, len(folded.split()))
                out.append(1 / (1 + math.exp(-max(-30.0, min(30.0, float(np.dot(x, curve)))))))
            keys = [b.column("key")] if key_col else []
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.float64()), *keys], names=["doc_id", "score", "key"][: 2 + len(keys)])

    return carried.mapInArrow(score, "doc_id long, score double" + ", key string" * bool(key_col)).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
