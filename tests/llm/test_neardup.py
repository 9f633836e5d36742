"""Near-duplicates against an all-pairs computation; sketches; components; odd rows."""
from __future__ import annotations

import random
import re

from sparklog.llm import neardup as nd

DOC = "doc_id long, text string, n long, component string"


def sets_of(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(docs):
    """doc -> (size, component) over all pairs."""
    sets = {d: sets_of(t) for d, t in docs}
    up = {d: d for d in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    index: dict = {}
    for d, s in sets.items():
        for x in s:
            index.setdefault(x, []).append(d)
    tried = set()
    for ds in index.values():
        for a in ds:
            for b in ds:
                if a < b and (a, b) not in tried:
                    tried.add((a, b))
                    n = len(sets[a] & sets[b])
                    if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
                        x, y = sorted((root(a), root(b)))
                        up[y] = x
    return {d: (len(s), root(d)) for d, s in sets.items()}


def check(docs):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in nd.near_duplicates(docs).collect()}
    want = brute({r.doc_id: r.text for r in docs.where("doc_id is not null").collect()}.items())
    assert got == {d: (n, c, c == d) for d, (n, c) in want.items()}


def test_tables(small_docs, edge_docs, no_docs):
    check(small_docs)
    check(edge_docs)
    assert nd.near_duplicates(no_docs).count() == 0


def test_groups_chains_and_thresholds(spark, monkeypatch):
    monkeypatch.setattr(nd, "BLOCK", 8)  # buckets of several blocks
    rnd = random.Random(6)
    docs, i = [], 0
    for g in range(12):
        base = [f"g{g}w{j}" for j in range(rnd.choice([6, 20, 80, 300]))]
        text = list(base)
        for k in range(rnd.choice([1, 3, 30])):
            docs.append((i, " ".join(text)))
            i += 1
            text = list(text if g % 3 else base)  # every third group: copies of one text, else a drifting chain
            for _ in range(rnd.randint(0, 1 + len(text) // 40)):
                text[rnd.randrange(len(text))] = f"x{rnd.random()}"
    passage = " ".join(f"p{j}" for j in range(60))  # a passage that many short documents share
    for _ in range(60):
        docs.append((i, " ".join(f"y{rnd.random()}" for _ in range(rnd.randint(5, 60))) + " " + passage))
        i += 1
    for cut in range(30):  # similarities around the threshold
        docs.append((i, " ".join(f"t{j}" for j in range(100 + cut))))
        i += 1
    rnd.shuffle(docs)
    docs = [(100 + k, t) for k, (_, t) in enumerate(docs)]
    docs += [(1, None), (2, ""), (3, "a b c"), (4, "A  b\nc"), (5, "a b"), (None, docs[0][1]), (6, "a b"), (6, "a b")]
    check(spark.createDataFrame([(d, t, 1, "c") for d, t in docs], DOC))


def test_filter_keeps_one_of_each_group(spark, edge_docs):
    kept = nd.deduplicate(edge_docs)
    assert kept.columns == edge_docs.columns
    ids = sorted(r.doc_id for r in kept.collect())
    want = brute({r.doc_id: r.text for r in edge_docs.collect()}.items())
    assert sorted(set(ids)) == sorted(d for d, (_, c) in want.items() if c == d)


def test_sketches_never_exclude_a_link():
    import numpy as np
    rnd = random.Random(1)
    for _ in range(300):
        n = rnd.choice([1, 5, 60, 64, 65, 127, 200, 700])
        words = [f"w{rnd.random()}" for _ in range(n + 4)]
        other = words + [f"z{rnd.random()}" for _ in range(rnd.randint(0, n // 3))]
        sk = []
        for w in (words, other):
            data = np.frombuffer(" ".join(w).encode(), np.uint8)
            s, _ = nd.shingle_sets(data, np.array([0, len(data)]))
            bits = 1 << int(np.ceil(np.log2(max(len(s), 64))))
            spot = nd.mix(s ^ np.uint64(0x9D2C5680)) & np.uint64(bits - 1)
            sk.append((set(s.tolist()), np.packbits((np.bincount(spot.astype(int), minlength=bits) & 1).astype(np.uint8)).tobytes()))
        (a, x), (b, y) = sk
        if 100 * len(a & b) >= 75 * len(a | b):
            assert not nd.far_apart(len(a), len(b), x, y)
