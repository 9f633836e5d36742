"""Benchmark decontamination (operator 3): suffix arrays of the training words, searched by test suffixes.

Each task cuts its documents into shards (``common.CHUNK_BYTES`` of text, documents whole) and builds a
suffix array over a shard's words: the word positions sorted by the words that follow, inside the
document, down to the length of the longest test item.  Words are represented by their rank in the test
vocabulary, several ranks to a 64-bit key; a position from which a word outside the vocabulary is met
before the shortest window is full cannot start a match and is not entered.  Every suffix of every test
item is binary-searched (all at once) for its first ``window`` words, which gives the range of all
places where they occur; runs of such places along one item are joined into the longest verbatim match
and compared with the item's words as strings.

Test items are a stated query set.  They are taken in blocks of bounded size (``BLOCK_BYTES``), one
pass over the documents per block, so neither the driver nor a worker holds more than one block.
Documents are never shuffled.

Defined cases: a null text has no words; an item without words, without text or without id matches
nothing; an item of fewer than ``window`` words is one window; rows repeating a document id are judged
one by one; several rows of one item id count as one item; other columns are kept by
``decontaminate`` and ignored by ``find_matches``; empty tables give empty (or clean) results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, LOWER, Words, small_batches, table, text_chunks, written

WINDOW = 10
#: Text of the test items searched in one pass.
BLOCK_BYTES = 16 << 20


class TestItems:
    """One block of test items: its vocabulary, its distinct windows, and where they occur in the items."""

    def __init__(self, rows: list[tuple[int, str]], window: int):
        self.ids = [r[0] for r in rows]
        data = "\n".join(r[1] for r in rows).encode()
        sizes = np.array([len(r[1].encode()) + 1 for r in rows], np.int64)
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        data = np.frombuffer(data + b"\n", np.uint8)
        words = Words(data, offsets, ALNUM, LOWER)
        self.text = [LOWER[data[a:b]].tobytes() for a, b in zip(words.start, words.end)]
        self.first, self.count = words.first, words.count
        self.vocabulary, rank = np.unique(words.hash, return_inverse=True)
        rank = rank.astype(np.int64) + 1
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(self.vocabulary >> np.uint64(44)).astype(np.int64)] = True
        self.bits = max(1, int(len(self.vocabulary)).bit_length())
        self.per_key = 63 // self.bits
        self.window = window
        self.shortest = min((min(int(n), window) for n in self.count if n), default=0)
        self.longest = int(self.count.max()) if len(self.count) else 0
        # every test suffix of window words or more, by those first words; a shorter item is one window
        wanted: dict[tuple, list[tuple[int, int]]] = {}
        for item, (a, n) in enumerate(zip(self.first, self.count)):
            for off in range(max(1, int(n) - window + 1) if n else 0):
                wanted.setdefault(tuple(rank[a + off:a + min(off + window, int(n))]), []).append((item, off))
        self.windows = sorted(wanted)
        self.size = np.array([len(w) for w in self.windows], np.int64)
        self.uses = [wanted[w] for w in self.windows]
        self.levels = -(-window // self.per_key)
        flat = np.zeros((len(self.windows), self.levels * self.per_key), np.int64)
        for i, w in enumerate(self.windows):
            flat[i, :len(w)] = w
        self.query = self._pack(flat)
        full = (1 << self.bits) - 1
        self.mask = self._pack(np.where(np.arange(flat.shape[1])[None, :] < self.size[:, None], full, 0)) if len(flat) else flat

    def _pack(self, ranks: np.ndarray) -> np.ndarray:
        out = np.zeros((len(ranks), self.levels), np.int64)
        for k in range(self.levels):
            for j in range(self.per_key):
                out[:, k] = (out[:, k] << self.bits) | ranks[:, k * self.per_key + j]
        return out

    def ranks(self, hashes: np.ndarray) -> np.ndarray:
        out = np.zeros(len(hashes), np.int64)
        maybe = np.flatnonzero(self.seen[(hashes >> np.uint64(44)).astype(np.int64)])
        place = np.minimum(np.searchsorted(self.vocabulary, hashes[maybe]), len(self.vocabulary) - 1)
        good = self.vocabulary[place] == hashes[maybe]
        out[maybe[good]] = place[good] + 1
        return out


class SuffixArray:
    """Word positions of a shard in the order of the words that follow them."""

    def __init__(self, items: TestItems, words: Words):
        self.items = items
        n, width = len(words.hash), items.per_key
        rank = np.zeros(n + items.longest + items.levels * width + width, np.int64)
        rank[:n] = items.ranks(words.hash)
        self.rank, self.end = rank, np.append(words.first[1:], n)
        known = np.concatenate([[0], np.cumsum(rank > 0)])
        start = np.flatnonzero(rank[:n])
        room = self.end[words.doc[start]] - start
        start = start[(room >= items.shortest) & (known[start + items.shortest] - known[start] == items.shortest)]
        self.limit = self.end[words.doc[start]]
        keys = [self._key(start, self.limit, k) for k in range(items.levels)]
        order = np.lexsort(keys[::-1])
        self.position, self.limit = start[order], self.limit[order]
        self.keys = np.stack([k[order] for k in keys], 1) if len(order) else np.zeros((0, items.levels), np.int64)
        # positions that agree on these keys are ordered by the words further on, as far as an item reaches
        depth = items.levels
        same = np.concatenate([[False], (self.keys[1:] == self.keys[:-1]).all(1)]) if len(order) else np.zeros(0, bool)
        group = np.cumsum(~same)
        while depth * width < items.longest and same.any():
            tied = np.flatnonzero(same | np.append(same[1:], False))
            key = self._key(self.position[tied], self.limit[tied], depth)
            again = np.lexsort((key, group[tied]))
            self.position[tied], self.limit[tied], key = self.position[tied][again], self.limit[tied][again], key[again]
            same_now = np.zeros(len(same), bool)
            same_now[tied[1:]] = (key[1:] == key[:-1]) & same[tied[1:]]
            same = same_now
            group = np.cumsum(~same)
            depth += 1

    def _key(self, position: np.ndarray, limit: np.ndarray, level: int) -> np.ndarray:
        out = np.zeros(len(position), np.int64)
        for j in range(self.items.per_key):
            at = position + level * self.items.per_key + j
            out = (out << self.items.bits) | np.where(at < limit, self.rank[np.minimum(at, len(self.rank) - 1)], 0)
        return out

    def _bound(self, right: bool) -> np.ndarray:
        items, n = self.items, len(self.position)
        low = np.zeros(len(items.windows), np.int64)
        high = np.full(len(items.windows), n, np.int64)
        while (live := np.flatnonzero(low < high)).size:
            mid = (low[live] + high[live]) >> 1
            have, want = self.keys[mid] & items.mask[live], items.query[live]
            differ = have != want
            column = np.where(differ.any(1), differ.argmax(1), 0)
            pick = np.arange(len(live))
            a, b = have[pick, column], want[pick, column]
            go = (a <= b) if right else (a < b)
            low[live[go]] = mid[go] + 1
            high[live[~go]] = mid[~go]
        return low

    def occurrences(self) -> tuple[np.ndarray, np.ndarray]:
        """(window index, word position) of every place where a test window stands."""
        low, high = self._bound(False), self._bound(True)
        n = high - low
        which = np.repeat(np.arange(len(n)), n)
        at = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        return which, self.position[at]


def shard_matches(items: TestItems, words: Words, data: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """Longest verbatim matches: (row, item index, word in the item, word in the document, words)."""
    if not items.windows or not len(words.hash):
        return []
    which, position = SuffixArray(items, words).occurrences()
    if not len(which):
        return []
    uses = [len(items.uses[w]) for w in which]
    position, size = np.repeat(position, uses), np.repeat(items.size[which], uses)
    item, off = np.array([u for w in which for u in items.uses[w]], np.int64).reshape(-1, 2).T
    doc = words.doc[position]
    order = np.lexsort((position, position - off, item, doc))
    doc, item, off, position, size = (x[order] for x in (doc, item, off, position, size))
    new = np.ones(len(doc), bool)
    new[1:] = ((doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (position[1:] - off[1:] != position[:-1] - off[:-1])
               | (position[1:] != position[:-1] + 1))
    begin = np.flatnonzero(new)
    last = np.append(begin[1:], len(doc)) - 1
    out = []
    for a, b in zip(begin, last):
        length = int(position[b] - position[a] + size[b])
        at, own = int(position[a]), int(items.first[item[a]] + off[a])
        spelled = [LOWER[data[words.start[at + i]:words.end[at + i]]].tobytes() for i in range(length)]
        if spelled == items.text[own:own + length]:
            out.append((int(doc[a]), int(item[a]), int(off[a]), at - int(words.first[doc[a]]), length))
    return out


def item_blocks(benchmark: DataFrame) -> list[DataFrame]:
    """The test items in blocks of about ``BLOCK_BYTES`` of text."""
    rows = benchmark.select("item_id", F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_BYTES))
    if blocks == 1:
        return [rows]
    return [rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b) for b in range(blocks)]


def _load(block: DataFrame, window: int):
    rows = sorted((r["item_id"], r["text"]) for r in block.collect())  # at most one block
    return block.sparkSession.sparkContext.broadcast(TestItems(rows, window))


_MATCHES = "array<struct<item_id:bigint,item_start:int,doc_start:int,length:int>>"


def find_matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per row: doc_id, n_words, matches (longest verbatim matches with their places)."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select("doc_id", "text", F.lit(0).cast("long").alias("n_words"), F.array().cast(_MATCHES).alias("matches"))
    schema, kind = "doc_id long, text string, n_words long, matches " + _MATCHES, None
    blocks = item_blocks(benchmark)
    for k, block in enumerate(blocks):
        items = _load(block, window)

        def search(batches, items=items):
            for batch in batches:
                for part, data, offsets in text_chunks(batch):
                    words = Words(data, offsets, ALNUM, LOWER)
                    found = part.column(3).to_pylist()
                    for doc, item, off, at, length in shard_matches(items.value, words, data):
                        found[doc] = (found[doc] or []) + [{"item_id": items.value.ids[item], "item_start": off, "doc_start": at, "length": length}]
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0), part.column(1), pa.array(words.count.astype(np.int64)), pa.array(found, part.schema.field(3).type)],
                        names=["doc_id", "text", "n_words", "matches"])

        rows = rows.mapInArrow(search, schema)
        if k + 1 < len(blocks):
            rows = written(rows, "matches")
    return rows.select("doc_id", "n_words", "matches")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` without any match, columns unchanged."""
    small_batches(docs.sparkSession)
    rows = docs
    for k, block in enumerate(blocks := item_blocks(benchmark)):
        items = _load(block, window)

        def clean(batches, items=items):
            for batch in batches:
                for part, data, offsets in text_chunks(batch):
                    keep = np.ones(part.num_rows, bool)
                    keep[[m[0] for m in shard_matches(items.value, Words(data, offsets, ALNUM, LOWER), data)]] = False
                    yield part.filter(pa.array(keep))

        rows = rows.mapInArrow(clean, docs.schema)
        if k + 1 < len(blocks):
            rows = written(rows, "clean")
    return rows


def digest(matches: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    ranges = F.array_sort(F.transform("matches", lambda m: F.struct(m["doc_start"].alias("a"), (m["doc_start"] + m["length"]).alias("b"))))
    covered = F.aggregate(
        ranges, F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda s, r: F.struct((s["n"] + F.greatest(r["b"] - F.greatest(r["a"], s["end"]), F.lit(0))).alias("n"), F.greatest(r["b"], s["end"]).alias("end")),
        lambda s: s["n"])
    ids = F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["item_id"].cast("string"))))
    return matches.select(
        "doc_id", "n_words", covered.cast("long").alias("n_hit"), F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.encode(F.array_join(ids, ","), "UTF-8"), 256).alias("items_sha256"), (F.size("matches") > 0).alias("contaminated"))


def op3_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Contract query: which words of every document stand in a benchmark window."""
    return digest(find_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS m, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT m FROM bw),
dw AS (SELECT doc_id, i, m, array_to_string(w[i:i + m - 1], ' ') AS win
  FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, sizes WHERE len(w) >= m)),
h AS (SELECT dw.doc_id, dw.i, dw.m, bw.item_id FROM dw JOIN bw USING (m, win)),
p AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS pos FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN t USING (doc_id)
"""
