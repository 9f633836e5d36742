"""Decontamination against a plain search: hits, items, longest matches, blocks, odd rows."""
from __future__ import annotations

import hashlib
import random
import re

import pytest

from sparklog.llm import decontaminate as dc

BENCH = "item_id long, text string, doc_id string, matches string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOC = "doc_id long, text string, n_words string, matches string"


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, bench):
    wins = {}
    for item, text in bench:
        w = words(text)
        if item is not None and w:
            m = min(10, len(w))
            for i in range(len(w) - m + 1):
                wins.setdefault(tuple(w[i:i + m]), set()).add(item)
    sizes = {len(w) for w in wins}
    out = []
    for doc, text in docs:
        w, hit, items = words(text), set(), set()
        for m in sizes:
            for i in range(len(w) - m + 1):
                if got := wins.get(tuple(w[i:i + m])):
                    items |= got
                    hit |= set(range(i, i + m))
        ids = ",".join(sorted(map(str, items)))
        out.append((doc, len(w), len(hit), len(items), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)))
    return out


def cases():
    rnd = random.Random(8)
    vocab = [f"w{i}" for i in range(40)] + ["É", "ü1", "Z"]
    text = lambda n: " ".join(rnd.choice(vocab) for _ in range(n))
    bench = [(i, text(rnd.randint(8, 40))) for i in range(30)] + [(40, "One two"), (41, None), (42, "..."), (None, "w1 w2"), (43, ""), (1, text(20))]
    bench.append((50, " ".join(bench[3][1].split() * 2)))
    docs = []
    for i in range(120):
        parts = [text(rnd.randint(0, 60))]
        for _ in range(rnd.randint(0, 3)):
            b = (rnd.choice(bench)[1] or "").split()
            a = rnd.randint(0, max(0, len(b) - 3))
            parts += [" ".join(b[a:a + rnd.randint(5, 40)]).upper(), text(rnd.randint(0, 5))]
        docs.append((i, ", ".join(parts)))
    docs += [(200, None), (201, ""), (202, "one TWO"), (202, "one-two"), (203, (bench[0][1] + "! ") * 500), (None, bench[2][1])]
    return docs, bench


@pytest.mark.parametrize("block", [16 << 20, 1500])
def test_against_a_plain_search(spark, monkeypatch, block):
    docs, bench = cases()
    monkeypatch.setattr(dc, "BLOCK_BYTES", block)
    d = spark.createDataFrame([(i, t, "c", "c") for i, t in docs], DOC)
    b = spark.createDataFrame([(i, t, "c", "c") for i, t in bench], BENCH)
    found = dc.find_matches(d, b)
    assert sorted(map(str, map(tuple, dc.digest(found).collect()))) == sorted(map(str, brute(docs, bench)))
    kept = dc.decontaminate(d, b)
    assert kept.schema == d.schema
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r[0]) for r in brute(docs, bench) if not r[5])


def test_longest_match_and_place(spark):
    d = spark.createDataFrame([(1, "x y a b c d e f g h i j k l m n z", "", "")], DOC)
    b = spark.createDataFrame([(7, "q a b c d e f g h i j k l m n r", "", "")], BENCH)
    assert [tuple(m) for m in dc.find_matches(d, b).first().matches] == [(7, 1, 2, 14)]


def test_empty_tables(spark, edge_docs, no_docs):
    none = spark.createDataFrame([], BENCH)
    some = spark.createDataFrame([(1, "a b c", "", "")], BENCH)
    assert dc.digest(dc.find_matches(edge_docs, none)).where("contaminated").count() == 0
    assert dc.find_matches(no_docs, some).count() == 0 and dc.decontaminate(no_docs, some).count() == 0
