"""The pipeline stage by stage: each stage's result against a brute-force version over its own input."""
from __future__ import annotations

import pytest

import corpus_pipeline
from sparklog.llm.common import written
from tests.llm import test_decontaminate, test_neardup, test_packing, test_quality, test_substrings
from tests.llm.test_packing import library  # noqa: F401

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def rows(df):
    return [tuple(r) for r in df.select(*COLUMNS).collect()]


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "edge"])
def test_stages(spark, edge_docs, library, sf):  # noqa: F811
    d = "/root/testdata/sf0.001"
    docs = edge_docs if sf == "edge" else spark.read.parquet(f"{sf}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]

    good = written(stages["quality_rules"](spark, docs, d), "t")
    assert good.columns == docs.columns
    kept = rows(good)
    given = rows(docs)
    assert sorted(kept, key=str) == sorted((r for r, k in zip(given, test_quality.verdicts([r[1] for r in given])) if k), key=str)

    alone = written(stages["near_dedup"](spark, good, d), "t")
    group = test_neardup.brute({r[0]: r[1] for r in kept}.items())
    assert sorted(rows(alone), key=str) == sorted((r for r in kept if group[r[0]][1] == r[0]), key=str)

    cut = written(stages["substring_dedup"](spark, alone, d), "t")
    before = rows(alone)
    want = [(r[0], k if n else r[1], *r[2:4], len(k) if n else r[4])
            for r, (_, _, n, k) in zip(before, test_substrings.brute([r[:2] for r in before]))]
    assert sorted(rows(cut), key=str) == sorted(want, key=str)

    clean = written(stages["benchmark_decontamination"](spark, cut, d), "t")
    hit = test_decontaminate.brute([r[:2] for r in want], bench)
    assert sorted(rows(clean), key=str) == sorted((r for r, h in zip(want, hit) if not h[5]), key=str)
    assert clean.columns == docs.columns

    test_packing.check(clean, library)


def test_run(spark, sf_small):
    out = corpus_pipeline.run(spark, sf_small)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and out.count() > 0
