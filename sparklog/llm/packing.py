"""Best-fit packing of token sequences (operator 6): bulk-synchronous rounds of range-sorted sweeps.

Texts are tokenised and cut into pieces of at most ``capacity`` ids (only longer documents are cut; the
first piece takes the remainder).  A piece of more than half the capacity opens a sequence of its own.
Every round then

1. splits each gap into as many equal slots as hold the longest piece left (one, while pieces are long),
   and range-sorts slots and pieces together by size, longest first;
2. sweeps each range: a piece takes the smallest slot met so far that is at least as long (its successor);
3. settles what the ranges left over by rank: the k-th unplaced piece of a range takes the k-th smallest
   slot still free in the ranges before it.  Only the two counts of each range reach the driver;
4. subtracts what was placed from the gaps, drops gaps that are smaller than every piece left, and opens
   new sequences (total length / capacity) for pieces that are longer than every gap.

It ends when every piece is placed.  Each round's tables are written to the shared folder, so a lost
executor costs one round's work, and the number of rounds depends on the spread of lengths, not on the
number of documents.

Defined cases: a null text is empty and is packed as its end id; rows repeating a document id are packed
once per row; rows without an id are packed with a null id; other columns are ignored; an empty table
packs into nothing.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, table, written
from .tokens import encoded_chunks

CAPACITY = 2048
END_ID = 0
#: Rows of one range of a sweep (slots and pieces); sets the number of ranges.
RANGE_ROWS = 100_000


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): the pieces of every document's ids."""
    small_batches(docs.sparkSession)

    def cut(batches):
        for rows, ids, at in encoded_chunks(batches, vocabulary, end_id):
            n = np.diff(at)
            pieces = -(-n // capacity)
            doc = np.repeat(np.arange(len(n)), pieces)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            # the remainder comes first: piece k ends at n - (pieces - 1 - k) * capacity
            end = n[doc] - (pieces[doc] - 1 - piece) * capacity
            start = np.maximum(end - capacity, 0)
            flat = np.ascontiguousarray(ids, dtype="<u4")
            crc = [zlib.crc32(flat[a:b]) for a, b in zip(at[doc] + start, at[doc] + end)]
            yield pa.RecordBatch.from_arrays(
                [rows.column(0).take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start.astype(np.int64)),
                 pa.array((end - start).astype(np.int64)), pa.array(crc, pa.int64())],
                ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


_SWEPT = "kind int, part int, rank long, uid long, length long, seq long"
_MATCH, _PIECE, _SLOT = 0, 1, 2


def _sweep(batches):
    """One range, longest first: pieces pop the last (smallest) slot pushed; what is left keeps its rank."""
    from pyspark import TaskContext
    part, open_slots, waiting, rows = TaskContext.get().partitionId(), [], 0, []

    def flush():
        cols = list(zip(*rows)) if rows else [[]] * 6
        types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
        out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["kind", "part", "rank", "uid", "length", "seq"])
        rows.clear()
        return out

    for batch in batches:
        for is_piece, size, uid in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if not is_piece:
                open_slots.append(uid)
            elif open_slots:
                rows.append((_MATCH, part, 0, uid, size, open_slots.pop()))
            else:
                rows.append((_PIECE, part, waiting, uid, size, None))
                waiting += 1
        yield flush()
    for rank in range(0, len(open_slots), 10_000):
        rows.extend((_SLOT, part, rank + i, None, None, s) for i, s in enumerate(open_slots[rank:rank + 10_000]))
        yield flush()


def carry(counts: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """Which slots the unplaced pieces take: (part, first rank, how many, slots' part, rank of the first's slot).

    ``counts``: (part, unplaced pieces, free slots) in order.  Pieces of a range take, by rank, the latest
    free slots of the ranges before it; ranks of slots fall as ranks of pieces rise.
    """
    stack, out = [], []
    for part, pieces, slots in counts:
        at = 0
        while at < pieces and stack:
            other, left = stack.pop()
            n = min(left, pieces - at)
            out.append((part, at, n, other, left - 1))
            at += n
            if left > n:
                stack.append((other, left - n))
        if slots:
            stack.append((part, slots))
    return out


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(uid, sequence_id) for ``pieces(uid, length)`` with unique uid and 1 <= length <= capacity.

    ``pieces`` is read several times, so hand in a written table.
    """
    spark = pieces.sparkSession
    rows = pieces.select("uid", "length")
    alone = rows.where(F.col("length") * 2 > capacity)
    placed = [alone.select("uid", F.col("uid").alias("seq"))]
    gaps = written(alone.where(F.col("length") < capacity).select(F.col("uid").alias("seq"), (capacity - F.col("length")).alias("free")), "pack-gaps")
    left = written(rows.where(F.col("length") * 2 <= capacity), "pack-left")
    opened = 0
    while True:
        gap = gaps.agg(F.count(F.lit(1)).alias("n"), F.max("free").alias("most")).first()
        most = gap["most"] or 0
        todo = left.agg(F.count(F.lit(1)).alias("n"), F.max("length").alias("longest"),
                        F.sum(F.when(F.col("length") > most, F.col("length"))).alias("unfit")).first()
        if not todo["n"]:
            break
        slots_from = gaps
        n_gaps = gap["n"]
        if todo["unfit"]:
            new = math.ceil(todo["unfit"] / capacity)
            slots_from = gaps.unionByName(spark.range(new).select(
                (-(F.col("id") + 1 + opened)).alias("seq"), F.lit(capacity).cast("long").alias("free")))
            opened += new
            n_gaps += new
        per_gap = max(1, math.ceil(todo["n"] / n_gaps))
        count = F.greatest(F.lit(1), F.least(F.floor(F.col("free") / todo["longest"]), F.lit(per_gap)))
        slots = slots_from.select(F.lit(0).alias("is_piece"), F.floor(F.col("free") / count).alias("size"),
                                  F.explode(F.array_repeat("seq", count.cast("int"))).alias("uid"))
        both = slots.unionByName(left.select(F.lit(1).alias("is_piece"), F.col("length").alias("size"), "uid"))
        ranges = max(1, math.ceil((todo["n"] + n_gaps * min(per_gap, 2)) / RANGE_ROWS))
        order = [F.col("size").desc(), F.col("is_piece"), F.col("uid")]
        swept = written(both.repartitionByRange(ranges, *order).sortWithinPartitions(*order).mapInArrow(_sweep, _SWEPT), "pack-swept")
        sums = swept.where(f"kind != {_MATCH}").groupBy("part").agg(
            F.sum((F.col("kind") == _PIECE).cast("long")).alias("p"), F.sum((F.col("kind") == _SLOT).cast("long")).alias("s"))
        runs = spark.createDataFrame(carry(sorted(map(tuple, sums.collect()))),  # one row per range
                                     "part int, first long, n long, slot_part int, top long")
        unplaced = swept.where(f"kind = {_PIECE}").select("part", "rank", "uid", "length")
        taken = unplaced.join(runs, "part").where("rank >= first and rank < first + n").select(
            "uid", "length", F.col("slot_part").alias("part"), (F.col("top") - F.col("rank") + F.col("first")).alias("rank"))
        late = taken.join(swept.where(f"kind = {_SLOT}").select("part", "rank", "seq"), ["part", "rank"]).select("uid", "length", "seq")
        matched = written(swept.where(f"kind = {_MATCH}").select("uid", "length", "seq").unionByName(late), "pack-matched")
        placed.append(matched.select("uid", "seq"))
        left = written(unplaced.join(matched.select("uid"), "uid", "left_anti").select("uid", "length"), "pack-left")
        shortest = left.agg(F.min("length")).first()[0]
        if shortest is None:
            break
        used = matched.groupBy("seq").agg(F.sum("length").alias("used"))
        gaps = written(slots_from.join(used, "seq", "left").select("seq", (F.col("free") - F.coalesce("used", F.lit(0))).alias("free"))
                       .where(F.col("free") >= shortest), "pack-gaps")
    out = placed[0]
    for p in placed[1:]:
        out = out.unionByName(p)
    return out.select("uid", F.col("seq").alias("sequence_id"))


def packed_documents(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: every piece with its place."""
    pieces = written(token_pieces(docs, capacity, vocabulary, end_id).withColumn("uid", F.monotonically_increasing_id()), "pieces")
    at = Window.partitionBy("sequence_id").orderBy(F.col("length").desc(), "uid").rowsBetween(Window.unboundedPreceding, -1)
    whole = pieces.where(F.col("length") == capacity).withColumn("sequence_id", F.col("uid")).withColumn("offset", F.lit(0).cast("long"))
    rest = written(pieces.where(F.col("length") < capacity), "pieces-rest")
    parts = rest.join(pack(rest, capacity), "uid").withColumn("offset", F.coalesce(F.sum("length").over(at), F.lit(0)).cast("long"))
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    return whole.select(*names).unionByName(parts.select(*names))


def op6_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """Contract query: all documents packed into sequences of 2048 ids."""
    return packed_documents(table(spark, sf_dir, "documents"))
