"""Substring deduplication (operator 8): repeated phrases confirmed, compiled into Aho-Corasick automata, located.

A window is ``WINDOW`` consecutive words of one document.  Words covered by a window whose words also
start in a document with a smaller id are removed.

1. Anchors.  Of the ``ANCHOR``-word grams inside a window the one with the smallest hash stands for the
   window, so equal windows have equal anchors.  One pass counts on how many documents an anchor falls
   (partial aggregation); an anchor of one document can't belong to a repeated window.
2. Documents get back their repeated anchors and cut out, per place of one, the segment of words that its
   windows cover.  Only these segments can hold a repeated window; they are streamed, each to the
   shard of its anchor.
3. A shard confirms the windows that occur in two documents or more, compiles them into an Aho-Corasick
   automaton (phrases of ``PHRASE`` words as its letters, built with pyahocorasick, a bounded number of segments
   at a time) and runs every segment through it: each occurrence is located, and those that have a smaller document
   elsewhere are hits.
4. An anchor of more than ``HOT`` places (a line or passage that a great part of all documents shares, or one that a
   long text repeats in ever new surroundings) would fill one shard.  Its segments are compared as wholes instead, by a partial aggregation on
   the words, and the windows of each segment's first document one by one; occurrences are joined back (a
   skewed join is split by Spark).  Both ways find every occurrence.
5. Hits return to their documents, which drop the covered words.

Defined cases: a null text has no words; a text shorter than a window loses nothing; rows sharing a
doc_id are one document (they don't count against each other) and each is returned; a row without a
doc_id loses nothing and costs nobody anything; other columns are ignored or kept unchanged; an empty
table gives no row.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _ODD, NON_SPACE, SAME, Words, dropped, mix, packed, signed, small_batches, table, text_chunks, unpacked, written

WINDOW = 13
ANCHOR = 5
#: Words of a phrase that the automata spell, and words from one phrase to the next: two phrases cover a window.
PHRASE = 7
STEP = WINDOW - PHRASE
#: Bits of a letter (a hash of the phrase; what is located is compared by the window's own hash).
BITS = 6
#: Places of an anchor, over all documents, above which its windows are confirmed one by one.
HOT = 2000
#: Segments compiled into one automaton (whole anchors; fewer than this plus ``HOT``).
SHARD_SEGMENTS = 20_000


def _anchors(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window starts, each window's anchor position, hash of the anchor gram at every word)."""
    n = len(words.hash)
    if n < WINDOW:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    grams = np.zeros(n - ANCHOR + 1, np.uint64)
    for k in range(ANCHOR):
        grams += words.hash[k:k + len(grams)] * _ODD[k]
    grams = mix(grams)
    count = n - WINDOW + 1
    best, at = grams[:count].copy(), np.zeros(count, np.int64)
    for k in range(1, WINDOW - ANCHOR + 1):
        smaller = grams[k:k + count] < best
        best[smaller] = grams[k:k + count][smaller]
        at[smaller] = k
    start = np.flatnonzero(words.doc[:count] == words.doc[WINDOW - 1:])
    return start, start + at[start], grams


def _by_row(row: np.ndarray, value: np.ndarray) -> np.ndarray:
    """One key per (row, value)."""
    return mix(value + mix(row.astype(np.uint64) + np.uint64(1)))


def anchor_rows(docs: DataFrame) -> DataFrame:
    """(g, doc_id, n): the anchors of every row, each once, with the number of its places."""
    def find(batches):
        for batch in batches:
            for rows, data, offsets in text_chunks(batch):
                words = Words(data, offsets, NON_SPACE, SAME)
                _, anchor, grams = _anchors(words)
                at = anchor[np.flatnonzero(np.diff(anchor, prepend=-1))]  # anchors never move back
                _, one, places = np.unique(_by_row(words.doc[at], grams[at]), return_index=True, return_counts=True)
                at = at[one]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(grams[at])), rows.column(0).take(pa.array(words.doc[at])), pa.array(places.astype(np.int32))],
                    ["g", "doc_id", "n"])

    return docs.select("doc_id", "text").where("doc_id is not null").mapInArrow(find, "g long, doc_id long, n int")


def _joined(data: np.ndarray, start: np.ndarray, end: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the words joined by one space (none after a ``last`` word); where each word begins there."""
    size = end - start
    step = size + ~last
    begin = np.cumsum(step) - step
    out = np.full(int(step.sum()), 0x20, np.uint8)
    within = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    out[np.repeat(begin, size) + within] = data[np.repeat(start, size) + within]
    return out, begin


def _strings(data: np.ndarray, bounds: np.ndarray, kind=pa.large_string()) -> pa.Array:
    """Consecutive pieces of ``data`` as an Arrow array."""
    return pa.Array.from_buffers(kind, len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int64).tobytes()), pa.py_buffer(data.tobytes())])


def _runs(words: Words, start: np.ndarray, anchor: np.ndarray, window: np.ndarray, chosen: np.ndarray):
    """Runs of the ``chosen`` windows that share an anchor, equal runs of one row taken together.

    Returns, per distinct run: row, key (of its words), first and last window (index), and how many of the
    places (first words, row by row) that follow are its own.
    """
    new = np.ones(len(chosen), bool)
    new[1:] = (anchor[chosen][1:] != anchor[chosen][:-1]) | (words.doc[start[chosen]][1:] != words.doc[start[chosen]][:-1])
    begin = np.flatnonzero(new)
    until = np.append(begin[1:], len(chosen))[:len(begin)] - 1
    first, last = chosen[begin], chosen[until]
    low = start[first]
    row = words.doc[low]
    # the first and the last window of a run cover all of its words
    key = mix(window[first] + mix(window[last] + (until - begin).astype(np.uint64)))
    order = np.argsort(_by_row(row, key), kind="stable")
    row, key, first, last, low = (x[order] for x in (row, key, first, last, low))
    head = np.ones(len(order), bool)
    head[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(head)
    return row[at], key[at], first[at], last[at], np.diff(np.append(at, len(order))), (low - words.first[row]).astype(np.int32)


def _lists(counts: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), values)


def _segments(batches):
    """Packed documents with their repeated anchors -> (hot, key, doc_id, fp, starts, words, windows)."""
    for batch in batches:
        batch = unpacked(batch, "text")
        for rows, data, offsets in text_chunks(batch):
            words = Words(data, offsets, NON_SPACE, SAME)
            start, anchor, grams = _anchors(words)
            window = words.windows(WINDOW)[1]
            own = _by_row(words.doc[anchor], grams[anchor])
            kinds = []
            for c in (3, 4):
                given = rows.column(c)
                row = np.repeat(np.arange(rows.num_rows), np.diff(np.asarray(given.offsets)))
                kinds.append(np.isin(own, _by_row(row, np.asarray(given.flatten()).astype(np.int64).view(np.uint64))))
            # hot anchors: a run's key and the hashes of its windows; others: the segment as it stands, by anchor
            row_h, key_h, first_h, last_h, n_h, place_h = _runs(words, start, anchor, window, np.flatnonzero(kinds[1]))
            row_c, _, first_c, last_c, n_c, place_c = _runs(words, start, anchor, window, np.flatnonzero(kinds[0]))
            many = last_h - first_h + 1
            inner = window[np.repeat(first_h - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))]
            low, high = start[first_c], start[last_c] + WINDOW
            size = words.end[high - 1] - words.start[low]
            within = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
            text = data[np.repeat(words.start[low], size) + within]
            hot, cold = len(row_h), len(row_c)
            doc = np.concatenate([row_h, row_c])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(hot + cold) < hot), pa.array(signed(np.concatenate([key_h, grams[anchor[first_c]]]))),
                 rows.column(0).take(pa.array(doc)), rows.column(1).take(pa.array(doc)),
                 _lists(np.concatenate([n_h, n_c]), pa.array(np.concatenate([place_h, place_c]))),
                 _strings(text, np.concatenate([np.zeros(hot + 1, np.int64), np.cumsum(size)]), pa.large_binary()).cast(pa.binary()),
                 _lists(np.concatenate([many, np.zeros(cold, np.int64)]), pa.array(signed(inner)))],
                ["hot", "key", "doc_id", "fp", "starts", "words", "windows"])


def shard_hits(doc: np.ndarray, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Of segments (document, words as bytes) the windows that a smaller document has too: (segment, word in it).

    Equal segments go through the automaton once.
    """
    import ahocorasick
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    coded = texts.dictionary_encode()
    code, distinct = np.asarray(coded.indices), coded.dictionary.cast(pa.large_binary())
    by_text = np.lexsort((doc, code))
    first = np.searchsorted(code[by_text], np.arange(len(distinct) + 1))
    low, high = doc[by_text[first[:-1]]], doc[by_text[first[1:] - 1]]  # smallest and largest document of each text
    sizes = np.diff(np.frombuffer(distinct.buffers()[1], np.int64, len(distinct) + 1, 8 * distinct.offset))
    flat = np.frombuffer(b"".join(distinct.to_pylist()), np.uint8)
    # set apart by a space: texts begin and end with words
    apart = np.full(len(flat) + len(sizes), 0x20, np.uint8)
    apart[np.arange(len(flat)) + np.repeat(np.arange(len(sizes)), sizes)] = flat
    words = Words(apart, np.concatenate([[0], np.cumsum(sizes + 1)]).astype(np.int64), NON_SPACE, SAME)
    at, window = words.windows(WINDOW)
    if not len(at):
        return none
    # confirm: windows of two documents or more, with the smallest
    order = np.argsort(window, kind="stable")
    head = np.flatnonzero(np.concatenate([[True], window[order][1:] != window[order][:-1]]))
    owner = words.doc[at[order]]
    least, most = np.minimum.reduceat(low[owner], head), np.maximum.reduceat(high[owner], head)
    repeated = np.flatnonzero(least < most)
    if not len(repeated):
        return none
    # compile: two letters spell a phrase of PHRASE words, each of an alphabet of its own (a node's children are
    # searched one by one, so alphabets are small); a segment is spelled once per phase, a phrase every STEP words, so
    # that a window is two neighbouring phrases; a letter of no phrase stands after each spelling
    begin, phrase = words.windows(PHRASE)
    phase = words.doc[begin] * STEP + (begin - words.first[words.doc[begin]]) % STEP
    turn = np.argsort(phase, kind="stable")
    begin, phase, phrase = begin[turn], phase[turn], phrase[turn] >> np.uint64(64 - 2 * BITS)
    moved = 2 * np.arange(len(begin)) + np.cumsum(np.concatenate([[False], phase[1:] != phase[:-1]]))
    spelled = np.zeros(moved[-1] + 3, np.uint32)
    spelled[moved] = (phrase >> np.uint64(BITS)) + np.uint64(1)
    spelled[moved + 1] = (phrase & np.uint64((1 << BITS) - 1)) + np.uint64((1 << BITS) + 1)
    text = spelled.astype("<u4").tobytes().decode("utf-32-le")
    spot = np.zeros(len(words.start), np.int64)
    spot[begin] = moved
    automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
    for p in spot[at[order[head[repeated]]]].tolist():
        automaton.add_word(text[p:p + 4])
    automaton.make_automaton()
    # locate: every place in the distinct segments whose window is one of the repeated ones, then every segment of that text
    place = begin[np.searchsorted(moved, np.fromiter((e for e, _ in automaton.iter(text)), np.int64) - 3)]
    known, here = window[order[head[repeated]]], window[np.searchsorted(at, place)]
    which_window = np.minimum(np.searchsorted(known, here), len(known) - 1)
    same = known[which_window] == here
    place, lowest = place[same], least[repeated[which_window[same]]]
    which = words.doc[place]
    times = first[which + 1] - first[which]
    segment = by_text[np.repeat(first[which] - (np.cumsum(times) - times), times) + np.arange(int(times.sum()))]
    hit = np.repeat(lowest, times) < doc[segment]
    return segment[hit], np.repeat(place - words.first[which], times)[hit]


def _shards(batches):
    """Segments sorted by anchor -> hits, a bounded number of whole anchors at a time."""
    held: list[pa.RecordBatch] = []

    def close():
        t = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        segment, word = shard_hits(np.asarray(t.column(1)), t.column(4))
        order = np.lexsort((segment, np.asarray(t.column(2))[segment], np.asarray(t.column(1))[segment]))
        segment, word = segment[order], word[order]
        # every hit at every place of its segment
        places = t.column(3)
        bounds, flat = np.asarray(places.offsets), np.asarray(places.flatten())
        many = (bounds[1:] - bounds[:-1])[segment]
        upto = np.cumsum(many)
        starts = flat[np.repeat(bounds[segment] - bounds[0] - (upto - many), many) + np.arange(int(many.sum()))] + np.repeat(word, many)
        # a row per document and text
        doc, fp = np.asarray(t.column(1))[segment], np.asarray(t.column(2))[segment]
        head = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (fp[1:] != fp[:-1])])[:len(doc)])
        ends = np.append(upto[head[1:] - 1], upto[-1:]) if len(head) else head
        return pa.RecordBatch.from_arrays([pa.array(doc[head]), pa.array(fp[head]), _lists(np.diff(ends, prepend=0), pa.array(starts.astype(np.int32)))],
                                          ["doc_id", "fp", "starts"])

    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.asarray(batch.column(0))
        ends = np.append(np.flatnonzero(key[1:] != key[:-1]) + 1, len(key))
        begin = 0
        if held and held[-1].column(0)[-1].as_py() != key[0] and rows >= SHARD_SEGMENTS:
            yield close()
            held, rows = [], 0
        for end in ends:
            if rows + end - begin >= SHARD_SEGMENTS and end < len(key):
                held.append(batch.slice(begin, end - begin))
                yield close()
                held, rows, begin = [], 0, end
        held.append(batch.slice(begin))
        rows += len(key) - begin
    if held:
        yield close()


def repeated_segments(docs: DataFrame) -> DataFrame:
    """(hot, key, doc_id, fp, starts, words, windows): what may hold repeated windows; a cold key has at most ``HOT`` rows."""
    small_batches(docs.sparkSession)
    found = written(anchor_rows(docs), "anchors")   # read by the count and by the join
    shared = (found.groupBy("g").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.sum("n").alias("k"))
              .where("a < b").select("g", (F.col("k") > HOT).alias("hot")))
    places = found.join(shared, "g").groupBy("doc_id").agg(
        F.collect_list(F.when(~F.col("hot"), F.col("g"))).alias("cold"), F.collect_list(F.when(F.col("hot"), F.col("g"))).alias("hot"))
    texts = packed(docs.where("doc_id is not null").select("doc_id", F.xxhash64("text").alias("fp"), "text"))
    cut = written(texts.join(places, "doc_id").select("doc_id", "fp", "text", "cold", "hot").mapInArrow(
        _segments, "hot boolean, key long, doc_id long, fp long, starts array<int>, words binary, windows array<long>"), "segments")
    dropped(found)
    return cut


def repeated_windows(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, starts): per document (and text, by its hash ``fp``) the windows that a smaller document has."""
    cut = repeated_segments(docs)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cold = (cut.where("not hot").select("key", "doc_id", "fp", "starts", "words").repartition(parts, "key").sortWithinPartitions("key")
            .mapInArrow(_shards, "doc_id long, fp long, starts array<int>"))
    runs = cut.where("hot").select("key", "doc_id", "fp", "starts", "windows")
    least = runs.groupBy("key").agg(F.min("doc_id").alias("least"))
    # a run that a smaller document has word for word is a hit as a whole
    hot = runs.join(least, "key").where("doc_id > least").select("doc_id", "fp", F.flatten(F.transform(
        "starts", lambda s: F.sequence(s, s + F.size("windows") - 1))).alias("starts"))
    # of the first document of each run every window by itself
    alone = (runs.join(least.select("key", F.col("least").alias("doc_id")), ["key", "doc_id"])
             .select("doc_id", "fp", "starts", F.posexplode("windows").alias("o", "window"))
             .select("window", "doc_id", "fp", F.transform("starts", lambda s: s + F.col("o")).alias("starts")))
    low = alone.groupBy("window").agg(F.min("doc_id").alias("least"))
    hot = hot.unionByName(alone.join(low, "window").where("doc_id > least").select("doc_id", "fp", "starts"))
    return cold.unionByName(hot).groupBy("doc_id", "fp").agg(F.flatten(F.collect_list("starts")).alias("starts"))


def _kept(batches, text: str, out):
    """Rows (.., text, _starts) -> ``out(rows, n_words, n_removed, kept texts)``."""
    for batch in batches:
        batch = unpacked(batch, text)
        for rows, data, offsets in text_chunks(batch, text):
            words = Words(data, offsets, NON_SPACE, SAME, hashes=False)
            change = np.zeros(len(words.start) + WINDOW + 1, np.int64)
            starts = rows.column(rows.num_columns - 1)
            row = np.repeat(np.arange(rows.num_rows), np.diff(np.asarray(starts.offsets)))
            at = words.first[row] + np.asarray(starts.flatten()).astype(np.int64)
            np.add.at(change, at, 1)
            np.add.at(change, at + WINDOW, -1)
            keep = np.flatnonzero(np.cumsum(change)[:len(words.start)] == 0)
            doc = words.doc[keep]
            count = np.bincount(doc, minlength=rows.num_rows)
            last = np.ones(len(keep), bool)
            last[:-1] = doc[1:] != doc[:-1]
            flat, begin = _joined(data, words.start[keep], words.end[keep], last)
            bounds = np.append(begin, len(flat))[np.concatenate([[0], np.cumsum(count)])]
            removed = words.count - count
            texts = _strings(flat, bounds)
            yield out(rows, words.count, removed, texts)


def _free(name: str, columns: list[str]) -> str:
    """``name``, with as many underscores as make it a new column name (in any case)."""
    while name.lower() in {c.lower() for c in columns}:
        name = "_" + name
    return name


def _with_starts(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The columns with the text packed, and as the last one the hits of the row."""
    fp, doc, of, starts = (_free(x, columns) for x in ("_fp", "_d", "_f", "_starts"))
    hits = repeated_windows(docs).select(F.col("doc_id").alias(doc), F.col("fp").alias(of), F.col("starts").alias(starts))
    rows = packed(docs.select(*columns, F.xxhash64("text").alias(fp)))
    return rows.join(hits, (F.col("doc_id") == F.col(doc)) & (F.col(fp) == F.col(of)), "left").select(*columns, starts)


def deduplicated_words(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_text (kept words joined by one space)."""
    def out(rows, n, removed, texts):
        return pa.RecordBatch.from_arrays([rows.column(0), pa.array(n.astype(np.int64)), pa.array(removed.astype(np.int64)),
                                           texts.cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept_text"])

    return _with_starts(docs, ["doc_id", "text"]).mapInArrow(
        lambda batches: _kept(batches, "text", out), "doc_id long, n_words long, n_removed long, kept_text string")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated windows cut out of ``text``: a text that loses words becomes its kept words joined
    by one space (``n_chars``, where there is one, follows), any other text, null included, stays as it is."""
    names = docs.columns
    chars = names.index("n_chars") if "n_chars" in names else None

    def out(rows, n, removed, texts):
        cols = [rows.column(i) for i in range(len(names))]
        i = names.index("text")
        olds = cols[i].to_pylist()
        texts = texts.to_pylist()
        cols[i] = pa.array([t if r else old for t, r, old in zip(texts, removed, olds)], pa.string())
        if chars is not None:
            cols[chars] = pa.array([len(t) if r else old for t, r, old in zip(texts, removed, cols[chars].to_pylist())], cols[chars].type)
        return pa.RecordBatch.from_arrays(cols, names=names)

    return _with_starts(docs, names).mapInArrow(lambda batches: _kept(batches, "text", out), docs.schema)


def op8_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Contract query: what every document keeps."""
    kept = deduplicated_words(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
low AS (SELECT s, min(doc_id) AS m FROM win GROUP BY s),
hit AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM win JOIN low USING (s) WHERE doc_id > m),
pos AS (SELECT doc_id, w[p] AS x, p FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d)),
k AS (SELECT pos.doc_id, string_agg(x, ' ' ORDER BY p) AS kept, count(*) AS n FROM pos ANTI JOIN hit USING (doc_id, p) GROUP BY pos.doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(len(d.w) - coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""
