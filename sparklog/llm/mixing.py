"""Mixing sources to target weights (operator 13): capped water-filling, in DataFrame functions only.

Sources, in code point order with null last, weigh ``weights[0]``, ``weights[1]``, ... repeating, and share the
words of the whole corpus.  A source's target stops at ``epochs`` times its size; what it can't take is shared
again by weight among the others, round by round, until no target is above its cap.  A round is one aggregation
over the table of sources; two numbers (the words and the weights still to be shared) travel between rounds.

A target of ``r`` times the source's size takes every document ``floor(r)`` times and a seeded sample of the
source once more: its documents in the order of a seeded hash, as long as at least half of a document's words
fit.  So a source's taken words differ from its target by at most half of one document, and runs agree.
The order is range-partitioned by (source, hash), with running sums inside a range and carried from range to
range, so a hot source fills as many tasks as its rows do; the sample reaches the documents as one cut-off hash a
source.

Defined cases: a null or empty text has size 0 and takes 0 words; a null source is a source of its own; rows that
repeat a (doc_id, size) are taken alike, null ids included; a corpus without words has targets of 0;
a source of weight 0 has target 0, and if all others are at their caps the mix is smaller than the corpus; other columns
are kept, but a column named like an added one gives way to it; an empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.stats import in_ranges, row_positions
from .common import table, written

WEIGHTS = (1, 2, 3)
EPOCHS = 3
SEED = 13


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def _key(doc_id: Column, size: Column, seed: int) -> Column:
    """The seeded place of a document in its source's order."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("-")), size.cast("string")))


def water_fill(sources: DataFrame, weights: Sequence[int] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """(source, source_size) -> the same with ``target``: weighted shares of all words, none above its cap."""
    order = [F.col("source").asc_nulls_last()]
    weight = F.element_at(F.array(*[F.lit(int(x)) for x in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = written(row_positions(sources, order, "rank").select(
        "source", "source_size", weight.alias("weight"), (F.col("source_size") * epochs).cast("double").alias("cap")), "mix-sources")
    words, share = ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    rest, share, clamped = words, share or 1, 0
    while True:
        wanted = F.lit(float(rest)) * F.col("weight") / F.lit(float(share))
        over = F.col("cap") < wanted
        row = ranked.agg(F.count_if(over).alias("n"), F.coalesce(F.sum(F.when(over, F.col("source_size") * epochs)), F.lit(0)).alias("held"),
                         F.sum(F.when(~over, F.col("weight"))).alias("weights")).first()
        if row["n"] == clamped or not row["weights"]:  # feasible, or nothing left that may take more
            return ranked.select("source", "source_size", F.least(F.col("cap"), wanted).alias("target"))
        clamped, rest, share = row["n"], words - row["held"], row["weights"]


def _cuts(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, source_size, target, whole, cut): whole repetitions, and the last hash of the fractional one."""
    targets = targets.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
    ranges = in_ranges(sized.select("source", "key", "size"), ["source", "key"])
    carried = ranges.groupBy("source", "_p").agg(F.sum("size").alias("words")).withColumn(
        "before", F.sum("words").over(W.partitionBy("source").orderBy("_p")) - F.col("words"))
    part = carried.alias("c").join(targets.alias("t"), F.expr("c.source <=> t.source")).select(
        F.col("c.source").alias("source"), F.col("c._p").alias("_p"),
        (F.col("target") - F.col("whole") * F.col("source_size") - F.col("before")).alias("room"))
    part = written(part, "mix-ranges")
    # rows of one hash stand and fall together: half of their words must fit
    running = ranges.withColumn("end", F.sum("size").over(W.partitionBy("_p", "source").orderBy("key"))).withColumn(
        "middle", F.col("end") - F.sum("size").over(W.partitionBy("_p", "source", "key")) / 2)
    last = (running.alias("r").join(part.alias("p"), F.expr("r._p = p._p AND r.source <=> p.source"))
            .where(F.col("middle") < F.col("room"))
            .groupBy(F.col("r.source").alias("source")).agg(F.max("key").alias("cut")))
    return written(targets.alias("t").join(last.alias("l"), F.expr("t.source <=> l.source"), "left").select("t.*", "l.cut"), "mix-cuts")


_ADDED = ["size", "source_size", "target", "repetitions"]


def _repeated(rows: DataFrame, cuts: DataFrame, seed: int) -> DataFrame:
    """Rows (doc_id, source, size, ..) with source_size, target and repetitions."""
    key = _key(F.col("d.doc_id"), F.col("d.size"), seed)
    more = F.coalesce((key <= F.col("c.cut")).cast("long"), F.lit(0))
    return rows.alias("d").join(cuts.alias("c"), F.expr("d.source <=> c.source")).select(
        "d.*", "c.source_size", "c.target", (F.col("c.whole") + more).cast("long").alias("repetitions"))


def _mixed(docs: DataFrame, weights: Sequence[int], epochs: int, seed: int) -> DataFrame:
    """(doc_id, source, row, size, source_size, target, repetitions): ``row`` holds all columns of ``docs``."""
    rows = docs.select("doc_id", "source", F.struct("*").alias("row"), word_count(F.col("text")).alias("size"))
    # one scan of the texts; after it only ids, sources and sizes are exchanged
    sized = written(rows.select("source", "size", _key(F.col("doc_id"), F.col("size"), seed).alias("key")), "mix-sizes")
    targets = water_fill(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, epochs)
    return _repeated(rows, _cuts(sized, targets), seed)


def mix_sources(docs: DataFrame, weights: Sequence[int] = WEIGHTS, epochs: int = EPOCHS, seed: int = SEED) -> DataFrame:
    """``docs`` with size, source_size, target and ``repetitions``: how often the mix takes the row's text."""
    keep = [F.col("row").getField(c).alias(c) for c in docs.columns if c not in _ADDED]
    return _mixed(docs, weights, epochs, seed).select(*keep, *_ADDED)


def mixture(docs: DataFrame, weights: Sequence[int] = WEIGHTS, epochs: int = EPOCHS, seed: int = SEED) -> DataFrame:
    """The mixed corpus: every row of ``docs`` as often as the mix takes it, numbered from 1 in ``epoch``."""
    keep = [F.col("row").getField(c).alias(c) for c in docs.columns if c != "epoch"]
    return _mixed(docs, weights, epochs, seed).where("repetitions > 0").select(
        *keep, F.explode(F.sequence(F.lit(1), F.col("repetitions").cast("int"))).alias("epoch"))


def op13_source_mix(spark, sf_dir: str) -> DataFrame:
    """Contract query: the words that the mix takes of every document."""
    docs = written(table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("size")), "mix-documents")
    sized = docs.select("source", "size", _key(F.col("doc_id"), F.col("size"), SEED).alias("key"))
    targets = water_fill(docs.groupBy("source").agg(F.sum("size").alias("source_size")))
    out = _repeated(docs, _cuts(sized, targets), SEED)
    return out.select("doc_id", "size", "source_size", "target", (F.col("repetitions") * F.col("size")).alias("taken"))


#: The level closes at the first source, in the order of cap over weight, that its share does not overflow.
ORACLE = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight FROM s),
o AS (SELECT *, sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER w, 0) AS rest,
        sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) AS share,
        row_number() OVER (ORDER BY CAST(source_size AS DOUBLE) / weight, source NULLS LAST) AS k
      FROM r WINDOW w AS (ORDER BY CAST(source_size AS DOUBLE) / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT CAST(rest AS DOUBLE) AS rest, CAST(share AS DOUBLE) AS share FROM o
      WHERE CAST(3 * source_size AS DOUBLE) >= CAST(rest AS DOUBLE) * weight / CAST(share AS DOUBLE) ORDER BY k LIMIT 1),
t AS (SELECT source, source_size, least(CAST(3 * source_size AS DOUBLE), l.rest * weight / l.share) AS target FROM r, l),
f AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t),
k AS (SELECT d.*, f.source_size, f.target, f.whole, md5('13:' || coalesce(CAST(doc_id AS VARCHAR), '-') || ':' || size) AS key
      FROM d JOIN f ON d.source IS NOT DISTINCT FROM f.source),
c AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY key) - sum(size) OVER (PARTITION BY source, key) / 2 AS middle FROM k),
m AS (SELECT *, max(CASE WHEN middle < target - whole * source_size THEN key END) OVER (PARTITION BY source) AS cut FROM c)
SELECT doc_id, size, source_size, target, CAST(size * (whole + CASE WHEN key <= cut THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM m
"""
