"""The sweeps against a stack run row by row, and packing against sequential best fit."""

import collections

import numpy as np
import pyarrow as pa
import pytest

from courtlake.llm import packing as p

from best_fit import plan_sweeps  # isort: skip

RNG = np.random.default_rng(5)


def by_stack(gaps, pieces, longest):
    """(gap size, gap rank, piece size, piece rank) of the pairs: gaps and pieces from large to small, gaps first, one by one."""
    stack, pairs = [], []
    for size in sorted(gaps.keys() | pieces.keys(), reverse=True):
        slots = max(1, size // longest)
        stack += [(size, r) for r in range(gaps.get(size, 0)) for _ in range(slots)]
        for r in range(pieces.get(size, 0)):
            if stack:
                pairs.append((*stack.pop(), size, r))
    return sorted(pairs)


def by_level(gaps, pieces, longest):
    pushed, popped = p.plan_levels(gaps, pieces, longest)
    events = collections.defaultdict(list)
    for size, order, slots, base, first in pushed:
        for r in range(gaps[size]):
            for t in range(max(0, first - r * slots), slots):
                events[base + r * slots + t + 1].append((order, size, r))
    for size, order, base, taken in popped:
        for r in range(taken):
            events[base - r].append((order, size, r))
    pairs = []
    for level in events.values():
        level.sort()
        assert len(level) % 2 == 0 and len({o for o, *_ in level}) == len(level)
        pairs += [(*gap[1:], *piece[1:]) for gap, piece in zip(level[::2], level[1::2])]
    return sorted(pairs)


@pytest.mark.parametrize("seed", range(40))
def test_levels_pair_as_a_stack_does(seed):
    rng = np.random.default_rng(seed)
    draw = lambda top, n: dict(collections.Counter(rng.integers(1, top, n).tolist()))
    gaps, pieces = draw(60, int(rng.integers(0, 30))), draw(int(rng.integers(2, 60)), int(rng.integers(1, 60)))
    assert by_level(gaps, pieces, max(pieces)) == by_stack(gaps, pieces, max(pieces))


def packed(spark, monkeypatch, lengths, capacity):
    """(doc_id, length, sequence, offset) of documents with so many ids each."""
    def pieces_of(docs, capacity, tokenizer, with_ids):
        def cut(batches):
            for b in batches:
                rows = [(i, k, k * capacity, min(capacity, int(t) - k * capacity), 0) for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()) for k in range(-(-int(t) // capacity))]
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64())
                columns = list(zip(*rows)) if rows else [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

        return docs.mapInArrow(cut, p.PIECES)

    monkeypatch.setattr(p, "pieces_of", pieces_of)
    docs = spark.createDataFrame([(i, str(n)) for i, n in enumerate(lengths)], "doc_id long, text string")
    return [(r.doc_id, r.length, r.sequence_id, r.offset) for r in p.pack(docs, capacity).collect()]


CASES = {
    "mixed": RNG.integers(1, 300, 400),
    "one length": np.full(300, 7),
    "ones": np.ones(500, int),
    "above half": RNG.integers(51, 100, 60),
    "hot length": np.concatenate([np.full(200, 3), RNG.integers(1, 99, 60)]),
    "all full": np.full(9, 100),
    "few": np.array([1]),
}


@pytest.mark.parametrize("name", CASES)
def test_pack_places_every_piece_once_in_about_best_fits_number(spark, monkeypatch, name):
    lengths, capacity = CASES[name], 100
    got = packed(spark, monkeypatch, lengths.tolist(), capacity)
    of_doc, of_sequence = collections.Counter(), collections.defaultdict(list)
    for i, n, s, o in got:
        of_doc[i] += n
        of_sequence[s].append((o, n))
    assert of_doc == dict(enumerate(lengths.tolist()))
    for pieces in of_sequence.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= capacity
    short = collections.Counter(n for _, n, _, _ in got if n < capacity)
    best = plan_sweeps(short, capacity)[1] + sum(n == capacity for _, n, _, _ in got)
    assert len(of_sequence) <= 1.01 * best + 1


def test_pack_treats_repeated_and_null_ids_and_clashing_columns_as_documents(spark):
    rows = [(1, "one two", 0), (1, "one two", 0), (None, "three", 0), (None, None, 0), (2, "", 0)]
    got = p.pack(spark.createDataFrame(rows, "doc_id long, text string, size int")).collect()
    assert sorted((r.doc_id or 0, r.length) for r in got) == [(0, 1), (0, 2), (1, 3), (1, 3), (2, 1)]
    assert sorted(r.offset for r in got) == sorted(np.cumsum([0, 3, 3, 2, 1]).tolist()) and len({r.sequence_id for r in got}) == 1
