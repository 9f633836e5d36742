"""Substring deduplication against a plain loop, over the automata and over the hot way."""
from __future__ import annotations

import hashlib
import random
import re

import pytest

from sparklog.llm import substrings as sub

DOC = "doc_id long, text string, n_chars long, _fp string, _starts string"


def brute(docs):
    words = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in docs]
    least: dict = {}
    for d, w in words:
        if d is not None:
            for i in range(len(w) - 12):
                s = tuple(w[i:i + 13])
                least[s] = min(d, least.get(s, d))
    out = []
    for d, w in words:
        gone = set()
        for i in range(len(w) - 12):
            if d is not None and least[tuple(w[i:i + 13])] < d:
                gone |= set(range(i, i + 13))
        out.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def rows():
    rnd = random.Random(12)
    vocab = [f"w{i}" for i in range(300)] + ["the"] * 40 + ["é漢", "a\x00b"]
    text = lambda n: [rnd.choice(vocab) for _ in range(n)]
    passages = [text(rnd.randint(10, 90)) for _ in range(12)]
    docs = []
    for i in range(150):
        w = text(rnd.randint(0, 40))
        for _ in range(rnd.randint(0, 3)):
            p = passages[min(rnd.randrange(12), rnd.randrange(12))]
            a = rnd.randint(0, len(p) - 5)
            w += p[a:a + rnd.randint(5, 90)] + text(rnd.randint(0, 6))
        docs.append((i, rnd.choice([" ", "\n", "  "]).join(w)))
    docs += [(200, docs[3][1]), (200, docs[4][1]), (200, docs[4][1]), (201, None), (202, ""), (203, "the " * 700), (204, "the " * 20),
             (None, docs[3][1]), (205, " ".join(passages[0] * 30))]
    rnd.shuffle(docs)
    return docs


@pytest.mark.parametrize("hot,shard", [(2000, 20_000), (6, 50), (0, 10)])
def test_against_a_plain_loop(spark, monkeypatch, hot, shard):
    monkeypatch.setattr(sub, "HOT", hot)
    monkeypatch.setattr(sub, "SHARD_SEGMENTS", shard)
    docs = rows()
    df = spark.createDataFrame([(d, t, len(t or ""), "c", "c") for d, t in docs], DOC)
    assert sorted(map(str, map(tuple, sub.deduplicated_words(df).collect()))) == sorted(map(str, brute(docs)))


def test_rewritten_table(spark):
    docs = rows()
    df = spark.createDataFrame([(d, t, len(t or ""), "c", "k") for d, t in docs], DOC)
    got = sub.remove_repeats(df)
    assert got.schema == df.schema
    want = [(d, k if n else t, len(k) if n else len(t or ""), "c", "k") for (d, t), (_, _, n, k) in zip(docs, brute(docs))]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_tables(spark, edge_docs, no_docs, small_docs):
    for docs in (edge_docs, small_docs):
        want = brute([(r.doc_id, r.text) for r in docs.collect()])
        assert sorted(map(str, map(tuple, sub.deduplicated_words(docs).collect()))) == sorted(map(str, want))
    assert sub.deduplicated_words(no_docs).count() == 0
    assert hashlib.sha256(b"").hexdigest()


def test_one_anchor_in_very_many_surroundings(spark):
    """Two long texts repeat a gram in 100,000 surroundings, 40 of them shared: no shard holds more than its bound."""
    gram = "to be or not that".split()
    text = lambda name, n: [x for i in range(n) for x in (*gram, f"{name}{i}", f"{name}x{i}", f"{name}y{i}")]
    one, two = text("a", 100_000), text("b", 50_000)
    two[80_000:80_000 + 8 * 40] = one[24:24 + 8 * 40]
    df = spark.createDataFrame([(1, " ".join(one)), (2, " ".join(two))], "doc_id long, text string").repartition(2)
    seen = {hash(tuple(one[i:i + 13])) for i in range(len(one) - 12)}
    gone = set()
    for i in range(len(two) - 12):
        if hash(tuple(two[i:i + 13])) in seen:
            gone |= set(range(i, i + 13))
    cold = sub.repeated_segments(df).where("not hot").groupBy("key").count().agg({"count": "max"}).first()[0]
    assert cold is None or cold <= sub.HOT
    got = {r.doc_id: (r.n_words, r.n_removed) for r in sub.deduplicated_words(df).collect()}
    assert got == {1: (len(one), 0), 2: (len(two), len(gone))} and len(gone) >= 8 * 40
