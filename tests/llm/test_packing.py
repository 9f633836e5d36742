"""Packing: every id in place once, gapless sequences, near the lower bound, carries against a plain stack."""
from __future__ import annotations

import bisect
import math
import random
import zlib

import numpy as np
import pytest

from sparklog.llm import packing, tokens


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(tokens.vocabulary_path(None))


def best_fit_decreasing(lengths, capacity):
    gaps, n = [], 0
    for x in sorted(lengths, reverse=True):
        i = bisect.bisect_left(gaps, x)
        if i < len(gaps):
            g = gaps.pop(i)
        else:
            g, n = capacity, n + 1
        bisect.insort(gaps, g - x)
    return n


def check(docs, library, capacity=2048):
    got = packing.packed_documents(docs, capacity).collect()
    want = []
    for r in docs.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids + [0]
        cut = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
        for k, (a, b) in enumerate(zip(cut[:-1], cut[1:])):
            want.append((r.doc_id, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(want, key=str)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    least = math.ceil(sum(x[3] for x in want) / capacity)
    assert least <= len(by) <= max(best_fit_decreasing([x[3] for x in want], capacity) * 1.02 + 1, least)


def test_odd_documents(spark, edge_docs, no_docs, library):
    special = spark.createDataFrame([(None, "no id"), (None, "a <|endoftext|> b"), (None, None), (70, "<|endoftext|> x" * 3000)],
                                    "doc_id long, text string")
    check(edge_docs.select("doc_id", "text").union(special), library)
    assert packing.packed_documents(no_docs).count() == 0


def test_table(small_docs, library):
    check(small_docs, library)


def test_many_short_pieces_over_several_ranges(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANGE_ROWS", 500)
    rnd = random.Random(4)
    lengths = [rnd.choice([1, 2, 3, 7, 7, 7, 30, rnd.randint(1, 2048)]) for _ in range(3000)] + [700] * 500
    df = packing.written(spark.createDataFrame([(i, n) for i, n in enumerate(lengths)], "uid long, length long"), "t")
    got = dict(packing.pack(df).collect())
    assert sorted(got) == list(range(len(lengths)))
    fill: dict = {}
    for i, s in got.items():
        fill[s] = fill.get(s, 0) + lengths[i]
    assert max(fill.values()) <= 2048 and len(fill) <= best_fit_decreasing(lengths, 2048) * 1.02 + 1


def test_carry_is_a_stack():
    rnd = random.Random(9)
    for _ in range(200):
        counts = [(p, rnd.randint(0, 4), rnd.randint(0, 4)) for p in range(rnd.randint(0, 8))]
        stack, want = [], {}
        for p, pieces, slots in counts:
            for i in range(pieces):
                if stack:
                    want[p, i] = stack.pop()
            stack += [(p, i) for i in range(slots)]
        got = {(p, a + i): (q, top - i) for p, a, n, q, top in packing.carry(counts) for i in range(n)}
        assert got == want
