"""Merkle manifest: roots, witnesses and folds against a plain tree, at every border of blocks; odd rows."""
from __future__ import annotations

import hashlib
import random
import zlib

import pytest

from sparklog.llm import merkle


def H(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(r) -> str:
    return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in r))


def tree(nodes):
    """(root, per leaf the siblings level by level, left to right), as stated: runs of two until one node is left."""
    proofs, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, p in enumerate(at):
            run = range(p // 2 * 2, min(p // 2 * 2 + 2, len(nodes)))
            proofs[i] += [(q < p, nodes[q]) for q in run if q != p]
            if len(run) == 1:
                proofs[i].append((None, ""))
            at[i] = p // 2
        nodes = [H("".join(nodes[i:i + 2])) for i in range(0, len(nodes), 2)]
    return nodes[0], proofs


def fold(d, proof):
    for before, sib in proof:
        d = H(sib + d if before else d + sib)
    return d


def brute(rows):
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    by = {g: sorted((r for r in rows if r[2] == g), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for g in langs}
    sub = {g: tree([leaf(r) for r in by[g]]) for g in langs}
    root, tops = tree([sub[g][0] for g in langs])
    out = []
    for k, g in enumerate(langs):
        for r, proof in zip(by[g], sub[g][1]):
            way = proof + tops[k]
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None
            given = leaf((*r[:3], r[3] + 1, r[4]) if bad else r)
            out.append((r[0], leaf(r), sub[g][0], root, H("".join(s for _, s in way)), fold(given, way), fold(given, way) == root))
    return out


def corpus(tmp_path, spark, rows):
    spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def odd_rows():
    rnd = random.Random(5)
    rows = [(i, rnd.choice(["a", None]), "hot", rnd.choice([None, 3, i]), f"text {i} é漢") for i in range(300)]
    for lang, n in (("one", 1), ("two", 2), ("three", 3), ("é", 8), ("", 9), (None, 17), ("z", 16)):
        rows += [(1000 + len(rows) + i, "s", lang, i, rnd.choice(["", "x", None])) for i in range(n)]
    rows += [(None, None, None, None, None), (None, "s", "two", 1, "no id"), (5, None, "hot", 7, "same id"), (5, None, "hot", 7, "same id")]
    rows.append((99999, "s", "hot", 0, "long " * 200_000))
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("levels", [1, 3, 10])
def test_against_a_plain_tree(spark, tmp_path, levels):
    rows = odd_rows()
    got = merkle.op12_merkle_manifest(spark, corpus(tmp_path, spark, rows), levels)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    key = lambda r: (r[1], r[4])
    assert sorted(map(tuple, got.collect()), key=key) == sorted(brute(rows), key=key)


def test_single_leaf_and_empty(spark, tmp_path):
    row = (4, "s", "en", 1, "alone")
    (got,) = merkle.op12_merkle_manifest(spark, corpus(tmp_path / "a", spark, [row])).collect()
    assert got.leaf == got.subroot == got.root == leaf(row) and got.proof_sha256 == H("")
    assert merkle.op12_merkle_manifest(spark, corpus(tmp_path / "b", spark, [])).collect() == []


def test_manifest_ignores_other_columns(spark, edge_docs):
    clash = edge_docs.selectExpr("*", "'x' AS pos", "'x' AS witness", "'x' AS tree", "'x' AS id", "'x' AS grp")
    want = {tuple(r) for r in merkle.manifest(edge_docs).select("id", "leaf", "root", "witness").collect()}
    found = merkle.folded(merkle.manifest(clash), "leaf").collect()
    assert {(r.id, r.leaf, r.root, r.witness) for r in found} == want and all(r.folded_root == bytes(r.root).hex() for r in found)


def test_every_size_of_a_block():
    for n in range(1, 40):
        leaves = [hashlib.sha256(bytes([i])).digest() for i in range(n)]
        block = merkle.Append()
        for d in leaves:
            block.add(d)
        root = block.close(merkle.height(n))
        want, _ = tree([d.hex() for d in leaves])
        assert root.hex() == want
        assert all(merkle.fold(d, i, n, b"".join(block.witness[i])) == (root, 32 * len(block.witness[i])) for i, d in enumerate(leaves))
