"""MinHash near-duplicates (operator 1) with tensored banding and exact verification.

A document is its set of distinct 5-word shingles.  ``COLLECTIONS`` small hash collections of ``ROWS``
minhashes each are computed per set; a table key is the pair of two collections' values, so m
collections give m (m - 1) / 2 tables of 2 * ROWS minhashes for m * ROWS minhashes computed.  Two sets
meet in a table when two collections agree; at similarity 0.75 they miss every table with probability
(1 - p) ** m + m p (1 - p) ** (m - 1), p = 0.75 ** ROWS, which is 6e-7 for m = 32, ROWS = 3.

1. Documents with equal sets become one representative (their smallest id), by a partial aggregation.
2. Collection values that only one set has are dropped before pairs are formed.
3. Every table bucket is linked as a star to its smallest id; candidate links are checked against a
   parity sketch (one bit per shingle, its Hamming distance never exceeds the symmetric difference, so
   nothing is lost) and then on the full sets.  Components of these links are found by alternating
   large-star / small-star rounds.
4. What a star can miss is a link between bucket members of different components.  Those pairs are
   compared block by block inside tasks (``BLOCK`` members to a block) on the sketches; a pair that the
   sketches can't exclude is handed on by the first table in which it meets, checked on the full sets,
   and joins the components.

No pair inside a component is formed, nothing is capped, and no table or component reaches the driver.

Defined cases: a null or wordless text has an empty set and is linked with nothing; a text of fewer
than five words is one shingle; rows sharing a doc_id are one document, with the text of the smallest
set fingerprint; rows without a doc_id are left out by ``near_duplicates`` and kept by ``deduplicate``;
other columns are ignored or kept unchanged; an empty table gives no row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _ODD, LOWER, NON_SPACE, Words, mix, packed, signed, small_batches, table, text_chunks, written

SHINGLE = 5
#: Linked when 100 * intersection >= SHARE * union.
SHARE = 75
COLLECTIONS, ROWS = 32, 3
#: Members of one block when bucket members of different components are compared.
BLOCK = 512

_random = np.random.default_rng(2024)
_XOR = _random.integers(1, 2**63, COLLECTIONS * ROWS, dtype=np.uint64)
_MUL = _random.integers(1, 2**63, COLLECTIONS * ROWS, dtype=np.uint64) | np.uint64(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes document by document, their offsets)."""
    words = Words(data, offsets, NON_SPACE, LOWER)
    at, shingles = words.windows(SHINGLE)
    doc = words.doc[at]
    short = np.flatnonzero((words.count > 0) & (words.count < SHINGLE))
    if len(short):
        whole = [mix((words.hash[a:a + n] * _ODD[:n]).sum(dtype=np.uint64)[None] + mix(np.array([n], np.uint64)))[0]
                 for a, n in zip(words.first[short], words.count[short])]
        doc, shingles = np.concatenate([doc, short]), np.concatenate([shingles, np.array(whole, np.uint64)])
        order = np.argsort(doc, kind="stable")
        doc, shingles = doc[order], shingles[order]
    docs = len(offsets) - 1
    bounds = np.searchsorted(doc, np.arange(docs + 1))
    for a, b in zip(bounds[:-1], bounds[1:]):
        shingles[a:b].sort()
    keep = np.ones(len(shingles), bool)
    keep[1:] = (shingles[1:] != shingles[:-1]) | (doc[1:] != doc[:-1])
    return shingles[keep], np.concatenate([[0], np.cumsum(keep)])[bounds]


def _fingerprints(sets: np.ndarray, at: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums over each non-empty set (``docs``: their rows)."""
    begin = at[docs]
    if not len(begin):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return tuple(mix(np.add.reduceat(mix(sets ^ np.uint64(salt)), begin)) for salt in (0x51ED270B, 0x2545F491))


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, n, fa, fb, coll, sketch): set size, fingerprint, collection values and parity sketch."""
    small_batches(docs.sparkSession)

    def sign(batches):
        for batch in batches:
            for rows, data, offsets in text_chunks(batch):
                sets, at = shingle_sets(data, offsets)
                n = np.diff(at)
                some = np.flatnonzero(n)
                fa, fb = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
                fa[some], fb[some] = _fingerprints(sets, at, some)
                least = np.zeros((COLLECTIONS * ROWS, len(some)), np.uint64)
                for k in range(COLLECTIONS * ROWS if len(some) else 0):
                    least[k] = np.minimum.reduceat((sets ^ _XOR[k]) * _MUL[k], at[some])
                coll = np.zeros((len(some), COLLECTIONS), np.uint64)
                for c in range(COLLECTIONS):
                    mixed = np.full(len(some), c + 1, np.uint64)
                    for r in range(ROWS):
                        mixed = mix(mixed + least[c * ROWS + r])
                    coll[:, c] = mixed
                size = np.where(n > 0, COLLECTIONS, 0)
                # parity of the shingles per bit, in as many bits as the set has members (a power of two)
                bits = (1 << np.ceil(np.log2(np.maximum(n, 64))).astype(np.int64)) * (n > 0)
                base = np.cumsum(bits) - bits
                owner = np.repeat(np.arange(len(n)), n)
                spot = base[owner] + (mix(sets ^ np.uint64(0x9D2C5680)) & (bits[owner] - 1).astype(np.uint64)).astype(np.int64)
                packed = np.packbits((np.bincount(spot, minlength=int(bits.sum())) & 1).astype(np.uint8)).tobytes()
                sketch = [packed[b // 8:(b + w) // 8] for b, w in zip(base, bits)]
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), pa.array(n.astype(np.int64)), pa.array(signed(fa)), pa.array(signed(fb)),
                     pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(signed(coll.ravel()))),
                     pa.array(sketch, pa.binary())], ["doc_id", "n", "fa", "fb", "coll", "sketch"])

    return docs.select("doc_id", "text").where("doc_id is not null").mapInArrow(
        sign, "doc_id long, n long, fa long, fb long, coll array<long>, sketch binary")


def far_apart(na: int, nb: int, a: bytes, b: bytes) -> bool:
    """True if the sketches prove that the sets are not linked."""
    if len(a) > len(b):
        a, b = b, a
    x, width = int.from_bytes(b, "big"), 8 * len(b)
    while width > 8 * len(a):  # folding the longer sketch in halves gives the sketch of the shorter length
        width //= 2
        x = (x >> width) ^ (x & ((1 << width) - 1))
    # linked: (100 + SHARE) * difference <= (100 - SHARE) * (na + nb), and the difference is at least both of these
    least = max((x ^ int.from_bytes(a, "big")).bit_count(), abs(na - nb))
    return (100 + SHARE) * least > (100 - SHARE) * (na + nb)


def verified(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Of ``pairs(a, b, afa, bfa)`` (document ids and set fingerprints) the linked ones, on the full sets: (a, b)."""
    small_batches(docs.sparkSession)

    def one(text: bytes) -> tuple[np.ndarray, int]:
        data = np.frombuffer(text, np.uint8)
        sets, at = shingle_sets(data, np.array([0, len(data)]))
        return sets, int(signed(_fingerprints(sets, at, np.array([0]))[0])[0]) if len(sets) else 0

    def compare(batches):
        spread, seen = zstandard.ZstdDecompressor(), {}

        def get(blob: bytes):
            if blob not in seen:
                if len(seen) >= 64:
                    seen.clear()
                seen[blob] = one(spread.decompress(blob))
            return seen[blob]

        for batch in batches:
            cols = [batch.column(i).to_pylist() for i in range(6)]
            out = []
            for a, b, afa, bfa, ta, tb in zip(*cols):
                (x, fx), (y, fy) = get(ta), get(tb)
                if fx == afa and fy == bfa:
                    both = np.intersect1d(x, y, assume_unique=True).size
                    if 100 * both >= SHARE * (len(x) + len(y) - both):
                        out.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in out], pa.int64()) for i in (0, 1)], ["a", "b"])

    texts = packed(docs.select("doc_id", "text").where("doc_id is not null")).withColumnRenamed("text", "packed")
    joined = (pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("packed").alias("ta")), "a")
              .join(texts.select(F.col("doc_id").alias("b"), F.col("packed").alias("tb")), "b"))
    return joined.select("a", "b", "afa", "bfa", "ta", "tb").mapInArrow(compare, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable, for every id in ``edges(a, b)``."""
    links = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "cc")
    before = None
    while True:
        # large star: every larger neighbour of u is linked to the smallest of u and its neighbours
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        # small star: u and its smaller neighbours are linked to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
        links = written(small.where("u != v").distinct(), "cc")
        now = tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").bitwiseAND((1 << 40) - 1))).first())
        if now == before:
            return links.select(F.col("u").alias("id"), F.col("v").alias("component"))
        before = now


def _near(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of candidate ``pairs(a, b)`` those that the sketches don't exclude, with set fingerprints."""
    def keep(batches):
        for batch in batches:
            na, nb, ska, skb = (batch.column(i).to_pylist() for i in (4, 5, 6, 7))
            mask = [not far_apart(*x) for x in zip(na, nb, ska, skb)]
            out = batch.filter(pa.array(mask, pa.bool_()))
            yield pa.RecordBatch.from_arrays([out.column(i) for i in range(4)], ["a", "b", "afa", "bfa"])

    side = lambda s: sets.select(F.col("id").alias(s), F.col("fa").alias(f"{s}fa"), F.col("n").alias(f"n{s}"), F.col("sketch").alias(f"sk{s}"))
    rows = pairs.join(side("a"), "a").join(side("b"), "b").where(
        (100 + SHARE) * F.abs(F.col("na") - F.col("nb")) <= (100 - SHARE) * (F.col("na") + F.col("nb")))
    return rows.select("a", "b", "afa", "bfa", "na", "nb", "ska", "skb").mapInArrow(keep, "a long, b long, afa long, bfa long")


def _cells(batches):
    """Pairs of different components inside each cell (rows sorted by cell) that the sketches don't exclude."""
    cell, members = None, []

    def close():
        members.sort(key=lambda m: m[4])
        for i, (t, p, side, comp, n, fa, sketch, coll) in enumerate(members):
            for _, q, other, comp2, n2, fa2, sketch2, coll2 in members[i + 1:]:
                if (100 + SHARE) * (n2 - n) > (100 - SHARE) * (n + n2):
                    break  # sorted by size: all further ones are larger still
                if comp != comp2 and (side != other or side == 2) and not far_apart(n, n2, sketch, sketch2):
                    first, second = np.flatnonzero(coll == coll2)[:2]
                    if t == first * COLLECTIONS + second:  # of all tables that the pair meets in, only the first
                        yield (p, q, fa, fa2) if p < q else (q, p, fa2, fa)

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(4)], ["a", "b", "afa", "bfa"])

    for batch in batches:
        out = []
        coll = np.asarray(batch.column(10).flatten()).reshape(-1, COLLECTIONS)
        for key, ci, cj, *member in zip(*(batch.column(i).to_pylist() for i in range(10)), coll):
            if (key, ci, cj) != cell:
                out += close()
                cell, members = (key, ci, cj), []
            members.append(member)
        yield batch_of(out)
    yield batch_of(list(close()))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, kept."""
    sig = written(signatures(docs), "sig")
    chosen = sig.groupBy("doc_id").agg(F.min(F.struct("fa", "fb", "n")).alias("s")).select("doc_id", "s.*")
    rep = chosen.where("n > 0").groupBy("fa", "fb", "n").agg(F.min("doc_id").alias("id"))
    content = sig.where("n > 0").groupBy("fa", "fb", "n").agg(F.first("coll").alias("coll"), F.first("sketch").alias("sketch"))
    sets = written(rep.join(content, ["fa", "fb", "n"]), "sets")  # one row per distinct set

    values = sets.select("id", F.posexplode("coll").alias("c", "value"))
    common = values.groupBy("value").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("value")
    mine = values.join(common, "value").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("c", "value"))).alias("v")).where(F.size("v") > 1)
    keys = F.flatten(F.transform("v", lambda x, i: F.transform(
        F.slice("v", i + 2, COLLECTIONS), lambda y: F.struct(
            F.xxhash64(x["value"], y["value"]).alias("key"), (x["c"] * COLLECTIONS + y["c"]).alias("t")))))
    buckets = mine.select("id", F.explode(keys).alias("b")).select("id", "b.key", "b.t")
    size = buckets.groupBy("key").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("k")).where("k > 1")
    buckets = written(buckets.join(size, "key"), "buckets")

    stars = buckets.where("id != low").select(F.col("low").alias("a"), F.col("id").alias("b")).distinct()
    links = written(verified(written(_near(stars, sets), "star-pairs"), docs), "star-links")
    label = components(links)

    # members of a bucket that are in different components so far
    told = buckets.join(label, "id", "left").select("key", "t", "id", "k", F.coalesce("component", F.col("id")).alias("comp"))
    mixed = told.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x != y").select("key")
    rows = told.join(mixed, "key").join(sets.select("id", "n", "fa", "sketch", "coll"), "id")
    rows = rows.withColumn("blocks", F.ceil(F.col("k") / BLOCK).cast("int"))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select(
        "key", F.least("own", "other").alias("ci"), F.greatest("own", "other").alias("cj"), "t", "id",
        F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1).alias("side"),
        "comp", "n", "fa", "sketch", "coll")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rest = (rows.repartition(parts, "key", "ci", "cj").sortWithinPartitions("key", "ci", "cj")
            .mapInArrow(_cells, "a long, b long, afa long, bfa long"))
    more = written(verified(written(rest, "rest-pairs"), docs), "rest-links")
    if more.isEmpty():
        final = label
    else:
        final = components(label.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(more))

    owner = rep.join(final, "id", "left").select("fa", "fb", "n", F.coalesce("component", F.col("id")).alias("component"))
    return chosen.join(owner, ["fa", "fb", "n"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", F.col("doc_id")).alias("component_id"),
        (F.coalesce("component", F.col("doc_id")) == F.col("doc_id")).alias("kept"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not near copies of a document with a smaller id; columns unchanged."""
    gone = near_duplicates(docs).where("not kept").select(F.col("doc_id").alias("_gone"))
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")


def op1_near_duplicates(spark, sf_dir: str) -> DataFrame:
    """Contract query: near-duplicate components of all documents."""
    return near_duplicates(table(spark, sf_dir, "documents"))
