"""Merkle dataset manifest (operator 12): incremental witnesses from a streaming aligned append.

A leaf is the digest of a document's fields.  The leaves of a group (``lang``), ascending by id, form a binary
tree (the last node of an odd level is hashed alone); the groups' roots form another one, whose root stands for the
whole table.  A leaf's witness are the siblings on its way up, with which anybody can fold it to the root.

1. Leaves are range-sorted and numbered, so that ``2 ** LEVELS`` consecutive places of a group are one aligned block, and
   blocks are dealt out to tasks: a hot group is many blocks.
2. A task appends a block's leaves one after another to a list of open subtrees, largest first.  An append that
   finds an open sibling of its own size completes it: the witnesses of the leaves on both sides grow by the other
   side's digest, and the joined subtree goes on the same way.  No more than a block is held.
3. The roots of the blocks are appended in turn as the leaves of smaller trees, until every
   group is one node; so are the groups' roots.  A block root's witness, joined back by block, extends those of the
   block's leaves.
4. ``folded`` folds leaves with their witnesses to roots, which verifies a table against a manifest.

Defined cases: a null field is ``-``; a null group comes first, a null id first in its group; rows that repeat an id
are leaves of their own, ordered by digest; other columns are ignored; an empty table gives no row.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.stats import row_positions
from .common import CRC_SQL, table, written

#: Levels of a block of ``2 ** LEVELS`` leaves.
LEVELS = 10
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def leaf_digest(*values: Column) -> Column:
    """Lower-case hex SHA-256 of the fields: ``-`` for null, else UTF-8 byte count, ``:``, value."""
    texts = [c.cast("string") for c in values]
    return F.sha2(F.encode(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]),
                           "UTF-8"), 256)


def parent(*digests: bytes) -> bytes:
    return hashlib.sha256(b"".join(digests).hex().encode()).digest()


class Append:
    """Streaming append of one aligned block: open subtrees (level, first leaf, digest) and a witness a leaf."""

    def __init__(self):
        self.open: list[tuple[int, int, bytes]] = []
        self.witness: list[list[bytes]] = []

    def _join(self, level: int, first: int, digest: bytes) -> tuple[int, int, bytes]:
        """The subtree joined with the open sibling of its size."""
        _, begin, left = self.open.pop()
        for w in self.witness[begin:first]:
            w.append(digest)
        for w in self.witness[first:]:
            w.append(left)
        return level + 1, begin, parent(left, digest)

    def add(self, digest: bytes) -> None:
        node = (0, len(self.witness), digest)
        self.witness.append([])
        while self.open and self.open[-1][0] == node[0]:
            node = self._join(*node)
        self.open.append(node)

    def close(self, height: int) -> bytes:
        """The block's root at ``height``: a subtree without a sibling is hashed alone, level by level."""
        node = self.open.pop()
        while node[0] < height:
            if self.open and self.open[-1][0] == node[0]:
                node = self._join(*node)
            else:
                node = (node[0] + 1, node[1], parent(node[2]))
        return node[2]


def height(n: int) -> int:
    return (n - 1).bit_length()


def fold(digest: bytes, pos: int, n: int, witness: bytes, at: int = 0) -> tuple[bytes, int]:
    """Root from a node at ``pos`` of ``n`` and its witness from byte ``at``; where the witness goes on."""
    while n > 1:
        if pos ^ 1 < n:
            other = witness[at:at + 32]
            at += 32
            digest = parent(other, digest) if pos & 1 else parent(digest, other)
        else:
            digest = parent(digest)
        pos, n = pos >> 1, (n + 1) >> 1
    return digest, at


def _appender(levels: int):
    """Rows (tree, pos, n, digest, ..) sorted by (tree, pos) -> the same with witness and, at a block's first row, its root."""
    def closed(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        block = Append()
        for d in rows.column("digest").to_pylist():
            block.add(d)
        root = block.close(min(height(rows.column("n")[0].as_py()), levels))
        roots = pa.array([root] + [None] * (rows.num_rows - 1), pa.binary())
        return pa.RecordBatch.from_arrays([*rows.columns, pa.array([b"".join(w) for w in block.witness], pa.binary()), roots],
                                          names=[*rows.schema.names, "witness", "block_root"])

    def run(batches):
        held: list[pa.RecordBatch] = []
        of = None
        for batch in batches:
            trees, places = batch.column("tree").to_pylist(), batch.column("pos").to_pylist()
            begin = 0
            for i in range(batch.num_rows):
                key = (trees[i], places[i] >> levels)
                if key != of:
                    if i > begin:
                        held.append(batch.slice(begin, i - begin))
                    if held:
                        yield closed(held)
                    held, of, begin = [], key, i
            if batch.num_rows > begin:
                held.append(batch.slice(begin))
        if held:
            yield closed(held)

    return run


def _schema(df: DataFrame, more: str) -> str:
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), more])


def append_blocks(nodes: DataFrame, levels: int) -> DataFrame:
    """Nodes (tree, pos, n, digest, ..) with their witness inside the block and, once a block, ``block_root``."""
    dealt = nodes.repartition("tree", F.shiftright("pos", levels)).sortWithinPartitions("tree", "pos")
    return written(dealt.mapInArrow(_appender(levels), _schema(nodes, "witness binary, block_root binary")), "merkle-blocks")


def block_roots(blocks: DataFrame, levels: int) -> DataFrame:
    """The blocks' roots as the nodes of the next trees, smaller by a block."""
    return blocks.where("block_root is not null").select(
        "tree", F.shiftright("pos", levels).alias("pos"), F.shiftright(F.col("n") + ((1 << levels) - 1), levels).alias("n"),
        F.col("block_root").alias("digest"))


def witnessed(nodes: DataFrame, levels: int) -> DataFrame:
    """Nodes (tree, pos, n, digest) -> (tree, pos, witness up to the tree's root, root)."""
    if nodes.where("n > 1").isEmpty():
        return nodes.select("tree", "pos", F.lit(b"").alias("witness"), F.col("digest").alias("root"))
    blocks = append_blocks(nodes, levels)
    return _extended(blocks.select("tree", "pos", "witness"), witnessed(block_roots(blocks, levels), levels), levels)


def _extended(blocks: DataFrame, above: DataFrame, levels: int) -> DataFrame:
    """Witnesses of a block's nodes extended by that of the block."""
    up = above.withColumnsRenamed({"pos": "block", "witness": "rest"})
    return (blocks.withColumn("block", F.shiftright("pos", levels)).join(up, ["tree", "block"])
            .withColumn("witness", F.concat("witness", "rest")).drop("block", "rest"))


def manifest(docs: DataFrame, fields: list[str] = FIELDS, key: str = "doc_id", group: str = "lang", levels: int = LEVELS) -> DataFrame:
    """Manifest of a table: id, grp and leaf of every row, with its place and witness (see ``manifest_of``)."""
    leaves = docs.select(F.col(group).alias("grp"), F.col(key).alias("id"), leaf_digest(*[F.col(c) for c in fields]).alias("leaf"))
    return manifest_of(written(leaves, "merkle-leaves"), levels)


def manifest_of(leaves: DataFrame, levels: int = LEVELS) -> DataFrame:
    """Leaves (grp, id, leaf as hex, ..) -> the same with tree, pos, n, trees, witness, subroot and root (binary).

    ``tree`` is the place of the group among ``trees`` groups, ``pos`` the leaf's among the ``n`` of its group.
    """
    first = [F.col("grp").asc_nulls_first()]
    placed = row_positions(leaves, [*first, F.col("id").asc_nulls_first(), F.col("leaf")], "_pos")
    groups = placed.groupBy("grp").agg(F.min("_pos").alias("first"), F.count(F.lit(1)).alias("n"))
    # written, so that Spark knows its size before it chooses the join
    groups = written(row_positions(groups, first, "tree"), "merkle-groups")
    trees = groups.count()
    nodes = (placed.alias("p").join(groups.alias("g"), F.expr("p.grp <=> g.grp"))
             .select("p.*", "g.tree", (F.col("p._pos") - F.col("g.first")).alias("pos"), "g.n", F.unhex("p.leaf").alias("digest")).drop("_pos"))
    blocks = append_blocks(nodes, levels)
    above = written(witnessed(block_roots(blocks, levels), levels), "merkle-roots")
    tops = above.where("pos = 0").select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("pos"),
                                         F.lit(trees).cast("long").alias("n"), F.col("root").alias("digest"))
    higher = witnessed(tops, levels).select(F.col("pos").alias("tree"), F.col("witness").alias("higher"), F.col("root").alias("top"))
    above = written(above.join(higher, "tree").select("tree", "pos", F.concat("witness", "higher").alias("witness"),
                                                      F.struct("root", "top").alias("roots")), "merkle-tops")
    out = _extended(blocks.drop("digest", "block_root"), above, levels)
    return out.select(*[c for c in out.columns if c != "roots"], F.lit(trees).cast("long").alias("trees"),
                      F.col("roots.root").alias("subroot"), F.col("roots.top").alias("root"))


def folded(manifest: DataFrame, leaf: str, out: str = "folded_root") -> DataFrame:
    """The manifest with the root recomputed from the hex digest in column ``leaf`` and the witness."""
    i = manifest.columns.index(leaf)
    names = [*manifest.columns, out]

    def run(batches):
        for batch in batches:
            part = [batch.column(c).to_pylist() for c in ("pos", "n", "tree", "trees", "witness")]
            roots = []
            for digest, pos, n, tree, trees, witness in zip(batch.column(i).to_pylist(), *part):
                sub, at = fold(bytes.fromhex(digest), pos, n, witness)
                roots.append(fold(sub, tree, trees, witness, at)[0].hex())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(roots, pa.string())], names=names)

    return manifest.mapInArrow(run, _schema(manifest, f"{out} string"))


def op12_merkle_manifest(spark, sf_dir: str, levels: int = LEVELS) -> DataFrame:
    """Contract query: manifest of all documents, checked against a table in which some ``n_chars`` are off by one."""
    fields = [F.col(c) for c in FIELDS]
    changed = [F.col("n_chars") + 1 if c == "n_chars" else F.col(c) for c in FIELDS]
    tampered = (F.crc32(F.col("doc_id").cast("string")) % 7 == 0) & F.col("n_chars").isNotNull()
    docs = table(spark, sf_dir, "documents")
    leaves = docs.select(F.col("lang").alias("grp"), F.col("doc_id").alias("id"), leaf_digest(*fields).alias("leaf"),
                         F.when(tampered, leaf_digest(*changed)).alias("changed"))
    found = folded(manifest_of(written(leaves, "merkle-leaves"), levels).withColumn("given", F.coalesce("changed", "leaf")), "given")
    hex_root = F.lower(F.hex("root"))
    return found.select(F.col("id").alias("doc_id"), "leaf", F.lower(F.hex("subroot")).alias("subroot"), hex_root.alias("root"),
                        F.sha2(F.encode(F.lower(F.hex("witness")), "UTF-8"), 256).alias("proof_sha256"), "folded_root",
                        (F.col("folded_root") == hex_root).alias("verified"))


_LEAF = " || ".join(f"coalesce(CAST(octet_length(encode(CAST({c} AS VARCHAR))) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')" for c in FIELDS)
ORACLE = rf"""
WITH RECURSIVE {CRC_SQL.format(keys="SELECT DISTINCT CAST(doc_id AS VARCHAR) AS s FROM documents WHERE doc_id IS NOT NULL")},
leaf AS (SELECT doc_id, lang, sha256({_LEAF}) AS leaf,
    CASE WHEN c % 7 = 0 AND n_chars IS NOT NULL THEN sha256({_LEAF.replace("n_chars", "n_chars + 1")}) END AS changed
  FROM documents LEFT JOIN crc32 ON s = CAST(doc_id AS VARCHAR)),
groups AS (SELECT lang, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree, n, count(*) OVER () AS trees
  FROM (SELECT lang, count(*) AS n FROM leaf GROUP BY lang)),
placed AS (SELECT doc_id, leaf, changed, tree, n, trees, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos
  FROM leaf JOIN groups ON leaf.lang IS NOT DISTINCT FROM groups.lang),
nodes(tree, level, pos, n, d) AS (
  SELECT tree, 0, pos, n, leaf FROM placed
  UNION ALL SELECT tree, level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(d, '' ORDER BY pos)) FROM nodes WHERE n > 1
    GROUP BY tree, level, pos // 2, n),
subroot AS (SELECT tree, d AS subroot, level AS high FROM nodes WHERE n = 1),
tops(level, pos, n, d) AS (
  SELECT 0, tree, (SELECT count(*) FROM subroot), subroot FROM subroot
  UNION ALL SELECT level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(d, '' ORDER BY pos)) FROM tops WHERE n > 1 GROUP BY level, pos // 2, n),
root AS (SELECT d AS root FROM tops WHERE n = 1),
sib AS (
  SELECT p.tree, p.pos, n.level, n.d FROM placed p JOIN nodes n ON n.tree = p.tree AND n.n > 1 AND n.pos = xor(p.pos >> n.level, 1)
  UNION ALL SELECT p.tree, p.pos, s.high + t.level, t.d FROM placed p JOIN subroot s USING (tree)
    JOIN tops t ON t.n > 1 AND t.pos = xor(p.tree >> t.level, 1)),
proof AS (SELECT tree, pos, sha256(string_agg(d, '' ORDER BY level)) AS proof FROM sib GROUP BY tree, pos),
side AS (  -- place on every level of the way up
  SELECT p.tree, p.pos, n.level, n.pos % 2 AS odd FROM placed p JOIN nodes n ON n.tree = p.tree AND n.n > 1 AND n.pos = p.pos >> n.level
  WHERE changed IS NOT NULL
  UNION ALL SELECT p.tree, p.pos, s.high + t.level, t.pos % 2 FROM placed p JOIN subroot s USING (tree)
    JOIN tops t ON t.n > 1 AND t.pos = p.tree >> t.level WHERE changed IS NOT NULL),
way AS (SELECT side.*, sib.d FROM side LEFT JOIN sib USING (tree, pos, level)),
fold(tree, pos, level, v) AS (
  SELECT tree, pos, 0, changed FROM placed WHERE changed IS NOT NULL
  UNION ALL SELECT f.tree, f.pos, f.level + 1, sha256(CASE WHEN w.odd = 1 THEN coalesce(w.d, '') || v ELSE v || coalesce(w.d, '') END)
    FROM fold f JOIN way w USING (tree, pos, level)),
folded AS (SELECT tree, pos, arg_max(v, level) AS v FROM fold GROUP BY tree, pos)
SELECT doc_id, leaf, subroot, root, coalesce(proof, sha256('')) AS proof_sha256, coalesce(v, root) AS folded_root, coalesce(v, root) = root AS verified
FROM placed JOIN subroot USING (tree) CROSS JOIN root LEFT JOIN proof USING (tree, pos) LEFT JOIN folded USING (tree, pos)
"""
