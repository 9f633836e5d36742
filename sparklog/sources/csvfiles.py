"""CSV files whose quoted fields may span lines, read in splits.

A line's place is outside or inside a quoted field, and a split does not know in which state it starts.  Each
line is therefore reduced to two booleans: whether it ends inside a field when it starts outside, and when it
starts inside.  Such steps compose: a line either fixes the state, keeps it or swaps it, so the state before a line is
the last fixed state, swapped as often as lines after it swap.  This is scanned inside every split for both starts, and
the splits' own steps are then carried along each file (a row per split), which settles every split's start.  Lines that
start outside begin a record.  Files without any line that opens a field over its end need none of this: every line of
theirs is a record, and their text is not exchanged.

Fields follow Python's csv module (default dialect): a quote opens a field only as its first character, ``""`` inside
quotes is a quote, text after the closing quote belongs to the field, line ends inside quotes are kept as they stand.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import parse as P

#: Characters of a record that spans lines, above which it is left out (a quote that never closes takes the rest of the file).
RECORD_LIMIT = 16 << 20

_QUOTED = r'[^"]*+(?:""[^"]*+)*+'
_FIELDS = rf'(?:(?:"{_QUOTED}"[^,]*+|[^",][^,]*+|),)*+'
#: A line that starts outside (inside) a quoted field and ends inside one.
OPENS = rf'\A{_FIELDS}"{_QUOTED}\z'
STAYS = rf'\A{_QUOTED}(?:\z|"[^,]*+,{_FIELDS}"{_QUOTED}\z)'
FIELD = rf'("{_QUOTED}"[^,]*+|[^,]*+),'
UNQUOTED = rf'(?s)\A"({_QUOTED})"(.*)\z'


def csv_fields(record: Column) -> Column:
    """The fields of one complete CSV record as an array."""
    cells = F.regexp_extract_all(F.concat(record, F.lit(",")), F.lit(FIELD), 1)
    inner = lambda c: F.replace(F.regexp_extract(c, UNQUOTED, 1), F.lit('""'), F.lit('"'))
    return F.transform(cells, lambda c: F.when(c.startswith('"'), F.concat(inner(c), F.regexp_extract(c, UNQUOTED, 2))).otherwise(c))


def csv_lines(spark: SparkSession, path: str | list[str], glob: str | None = None, ignore_corrupt: bool = True) -> DataFrame:
    """(file_path, blk, mid, sub, text, end, opens, stays): the lines of files with their ends, as read; ``sub`` tells
    the lines apart that a lone carriage return ends."""
    reader = spark.read.option("recursiveFileLookup", "true").option("lineSep", "\n").option("ignoreCorruptFiles", str(ignore_corrupt).lower())
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    raw = reader.text(path).select(F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_block_start").alias("blk"),
                                   F.monotonically_increasing_id().alias("mid"), P.clean_utf8(F.col("value")).alias("value"))
    parts = raw.select("file_path", "blk", "mid", F.posexplode(F.split("value", r"(?<=\r)(?!\z)")).alias("sub", "piece"), F.char_length("value").alias("n"),
                       F.size(F.split("value", r"(?<=\r)(?!\z)")).alias("parts"))
    text = F.regexp_replace("piece", r"\r\z", "")
    end = F.concat(F.when(F.col("piece").endswith("\r"), "\r").otherwise(""), F.when(F.col("sub") == F.col("parts") - 1, "\n").otherwise(""))
    lines = parts.select("file_path", "blk", "mid", "sub", text.alias("text"), end.alias("end"))
    quoted = F.col("text").contains('"')   # a line without a quote keeps its state
    return lines.withColumn("opens", quoted & F.col("text").rlike(OPENS)).withColumn("stays", ~quoted | F.col("text").rlike(STAYS))


def _before(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Adds ``before0`` and ``before1``: whether a row starts inside a field when the first row of its keys starts outside, inside."""
    w = W.partitionBy(*keys).orderBy(*order)
    earlier = w.rowsBetween(W.unboundedPreceding, -1)
    swap = (F.col("opens") & ~F.col("stays")).cast("int")
    rows = rows.withColumn("_s", F.sum(swap).over(w.rowsBetween(W.unboundedPreceding, W.currentRow)))
    fixed = F.when(F.col("opens") == F.col("stays"), F.struct(F.col("opens").cast("int").alias("state"), F.col("_s").alias("s")))
    rows = rows.withColumn("_f", F.last(fixed, ignorenulls=True).over(earlier)).withColumn("_p", F.coalesce(F.max("_s").over(earlier), F.lit(0)))

    def state(start: int) -> Column:
        return (F.coalesce(F.col("_f.state"), F.lit(start)) + F.col("_p") - F.coalesce(F.col("_f.s"), F.lit(0))) % 2 == 1

    return rows.withColumn("before0", state(0)).withColumn("before1", state(1)).drop("_s", "_f", "_p")


def _numbers(lines: DataFrame) -> DataFrame:
    """(file_path, blk, first, lines_before): a row per split, to number its lines."""
    splits = lines.groupBy("file_path", "blk").agg(F.min("mid").alias("first"), F.count_if(F.col("sub") == 0).alias("n"))
    return splits.select("file_path", "blk", "first", F.coalesce(F.sum("n").over(
        W.partitionBy("file_path").orderBy("blk").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("lines_before"))


def _spanning(lines: DataFrame) -> DataFrame:
    """Records (file_path, blk, mid, sub, record) of files in which a quoted field spans lines."""
    order = ["mid", "sub"]
    inside = _before(lines, ["file_path", "blk"], order)
    after = lambda k: F.when(F.col(f"before{k}"), F.col("stays")).otherwise(F.col("opens"))
    ends = inside.select("file_path", "blk", F.struct(*order).alias("at"), "before0", "before1", after(0).alias("e0"), after(1).alias("e1"))
    place = F.struct("blk", "at.mid", "at.sub")
    splits = ends.groupBy("file_path", "blk").agg(
        F.max_by(F.struct("e0", "e1"), "at").alias("e"),
        F.max(F.when(~F.col("before0"), place)).alias("last0"), F.max(F.when(~F.col("before1"), place)).alias("last1"))
    splits = _before(splits.select("file_path", "blk", F.col("e.e0").alias("opens"), F.col("e.e1").alias("stays"), "last0", "last1"), ["file_path"], ["blk"])
    splits = splits.withColumn("last", F.when(F.col("before0"), F.col("last1")).otherwise(F.col("last0")))
    carried = splits.select("file_path", "blk", F.col("before0").alias("start"), F.max("last").over(   # places rise along a file
        W.partitionBy("file_path").orderBy("blk").rowsBetween(W.unboundedPreceding, -1)).alias("open"))
    placed = inside.join(carried, ["file_path", "blk"])
    placed = placed.withColumn("inside", F.when(F.col("start"), F.col("before1")).otherwise(F.col("before0")))
    begun = F.max(F.when(~F.col("inside"), F.struct("blk", "mid", "sub"))).over(W.partitionBy("file_path", "blk").orderBy(*order))
    placed = placed.withColumn("rec", F.coalesce(begun, "open")).withColumn(
        "still", F.when(F.col("inside"), F.col("stays")).otherwise(F.col("opens")))
    whole = placed.where(~F.col("inside") & ~F.col("still")).select("file_path", "rec", F.col("text").alias("record"))
    pieces = placed.where(F.col("inside") | F.col("still"))
    sizes = pieces.groupBy("file_path", "rec").agg(F.sum(F.char_length("text") + 2).alias("n")).where(F.col("n") <= RECORD_LIMIT).drop("n")
    joined = (pieces.join(sizes, ["file_path", "rec"]).groupBy("file_path", "rec")
              .agg(F.sort_array(F.collect_list(F.struct("blk", "mid", "sub", "text", "end", "still"))).alias("p")))
    last = F.element_at("p", -1)
    body = F.concat(F.array_join(F.transform(F.slice("p", 1, F.size("p") - 1), lambda x: F.concat(x["text"], x["end"])), ""), last["text"],
                    F.when(last["still"], '"').otherwise(""))   # a field that the file's end closes
    return whole.unionByName(joined.select("file_path", "rec", body.alias("record"))).select("file_path", "rec.*", "record")


def csv_records(lines: DataFrame) -> DataFrame:
    """(file_path, line_number, record) of ``csv_lines``: complete, non-empty records with the number of their first line."""
    spanning = lines.groupBy("file_path").agg(F.bool_or("opens").alias("o")).where("o").select("file_path")
    plain = lines.join(spanning, "file_path", "left_anti").select("file_path", "blk", "mid", "sub", F.col("text").alias("record"))
    records = plain.unionByName(_spanning(lines.join(spanning, "file_path", "left_semi")))
    return (records.where("record <> ''").join(_numbers(lines), ["file_path", "blk"])
            .select("file_path", (F.col("lines_before") + F.col("mid") - F.col("first") + 1).cast("bigint").alias("line_number"), "record", "sub"))
