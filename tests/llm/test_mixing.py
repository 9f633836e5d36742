"""Source mixing: water-filling against a plain loop, taken words near their targets, whole repetitions, odd rows."""
from __future__ import annotations

import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from sparklog.llm import mixing

ROWS = "doc_id long, source string, text string, size string, epoch string, row string, cut string"


def filled(sizes: dict, weights=(1, 2, 3), epochs=3) -> dict:
    """Plain water-filling: clamp, share the excess by weight, until nothing is above its cap."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, fixed = sum(sizes.values()), set()
    while True:
        rest = total - sum(epochs * sizes[s] for s in fixed)
        share = sum(weight[s] for s in order if s not in fixed)
        target = {s: epochs * sizes[s] if s in fixed else rest * weight[s] / share for s in order}
        new = {s for s in order if target[s] > epochs * sizes[s]}
        if not new:
            return target
        fixed |= new


def odd_rows():
    rows = [(i, "hot", "a b c " * (i % 40 + 1), "x", "x", "x", "x") for i in range(900)]
    rows += [(1000 + i, f"s{i % 7}", "w " * (i % 11), "x", "x", "x", "x") for i in range(200)]
    rows += [(2000, None, "one two three", "x", "x", "x", "x"), (2001, None, None, "x", "x", "x", "x"), (2002, "", "", "x", "x", "x", "x")]
    rows += [(2003, "é", "lang " * 60000, "x", "x", "x", "x"), (2003, "é", "lang " * 60000, "x", "x", "x", "x")]
    rows += [(None, "s1", "no id here", "x", "x", "x", "x")] * 2 + [(2005, "𝄞", "astral", "x", "x", "x", "x"), (2006, "￿", "bmp", "x", "x", "x", "x")]
    return rows


def size_of(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


@pytest.mark.parametrize("weights,epochs", [((1, 2, 3), 3), ((5,), 2), ((0, 1, 50), 1)])
def test_targets_and_taken_words(spark, weights, epochs):
    rows = odd_rows()
    got = mixing.mix_sources(spark.createDataFrame(rows, ROWS), weights, epochs).collect()
    assert len(got) == len(rows)
    sizes, longest, taken = defaultdict(int), defaultdict(int), defaultdict(int)
    for doc_id, source, text, *_ in rows:
        sizes[source] += size_of(text)
        longest[source] = max(longest[source], size_of(text))
    if weights == (0, 1, 50):  # what weighs nothing takes nothing, and one epoch may not hold all words
        assert all(0 <= r.repetitions <= epochs and r.target <= epochs * r.source_size for r in got)
        return
    want = filled(sizes, weights, epochs)
    for r in got:
        assert r.size == size_of(r.text) and r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source], rel=1e-9) and 0 <= r.repetitions <= epochs
        taken[r.source] += r.size * r.repetitions
    for s in sizes:
        # rows that repeat an id are taken alike: the repeated long document counts as one of twice its length
        assert abs(taken[s] - want[s]) <= longest[s] * (1 if s == "é" else 0.5) + 1e-6, s


def test_water_fill_clamps_in_rounds(spark):
    sizes = {"a": 1, "b": 10, "c": 100, "d": 1000, "e": 10000, "f": 3, None: 7}
    got = mixing.water_fill(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
    want = filled(sizes)
    assert {r.source: r.target for r in got} == pytest.approx(want) and sum(want.values()) == pytest.approx(sum(sizes.values()))


def test_mixture_repeats_rows_and_reruns_agree(spark, edge_docs):
    mixed = mixing.mix_sources(edge_docs).select("doc_id", "text", "repetitions").collect()
    again = mixing.mix_sources(edge_docs.repartition(7)).select("doc_id", "text", "repetitions").collect()
    key = lambda r: (r.doc_id, r.text or "", r.repetitions)
    assert sorted(mixed, key=key) == sorted(again, key=key)
    out = mixing.mixture(edge_docs)
    assert out.columns == edge_docs.columns + ["epoch"]
    assert out.count() == sum(r.repetitions for r in mixed)
    assert out.where(F.col("kept") != "clash").count() == 0
    other = mixing.mix_sources(edge_docs, seed=99).agg(F.sum("repetitions")).first()[0]
    assert other is not None


def test_without_words_and_empty(spark, no_docs):
    assert mixing.mix_sources(no_docs).count() == 0 and mixing.mixture(no_docs).count() == 0
    blank = spark.createDataFrame([(1, "a", " "), (2, None, None)], "doc_id long, source string, text string")
    assert [(r.size, r.target, r.repetitions) for r in mixing.mix_sources(blank).collect()] == [(0, 0.0, 0)] * 2


def test_no_python_on_the_executors(spark, sf_small):
    plan = mixing.op13_source_mix(spark, sf_small)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "InPandas"))
