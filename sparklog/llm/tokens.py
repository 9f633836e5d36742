"""Token ids of whole texts, and the ORC token files (operator 4).

Encoding uses the tokenizers library.  A byte-level BPE never merges across pre-tokens, so a worker
splits a chunk of texts into pre-tokens with numpy, asks the library only for pre-tokens that it has
not met before, and takes the rest from a table hash -> ids (bounded, started anew when full).  The
split follows the vocabulary's published pattern for code points below U+0250; a text with any other
code point, or with a control or no-break white space, is handed to the library as a whole, and so is one
with the string of a special token, which becomes that token's id, as the library has it (``literal_specials``
takes such strings as ordinary text instead).

Token files: ORC, range-partitioned and sorted by document id, so that a stripe holds a run of ids.
The id list is an ORC integer column (run-length encoded), row indexes carry the id ranges and a Bloom
filter on ``doc_id`` sits beside them, so a read with ids pushed down skips stripes and row groups by
metadata, and readers take stripes in parallel.  A text is tokenised after the exchange, inside the
write, so the exchange carries text and the sampling pass of the range partitioner tokenises nothing.

Defined cases: a null text is empty (just the end id); rows repeating a document id are all written,
next to each other, smaller checksum first; a null id sorts first; other columns are ignored; an empty
table writes files without rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table, scratch_path, text_chunks, written

VOCABULARY = "byte_bpe_50k.json"
END_ID = 2
#: Pre-tokens that one worker keeps before it starts anew.
KEPT_PRETOKENS = 3_000_000
_GROUP = 2000
_FAST = 0x250


def _classes() -> np.ndarray:
    """Code point -> 0 other, 1 letter, 2 number, 3 white space, 9 not handled here."""
    import unicodedata
    out = np.full(0x110000, 9, np.uint8)
    for c in range(_FAST):
        kind = unicodedata.category(chr(c))[0]
        out[c] = 1 if kind == "L" else 2 if kind == "N" else 0
    out[[0x20, *range(0x09, 0x0E)]] = 3
    out[[*range(0x1C, 0x20), 0x85, 0xA0]] = 9
    return out


class Encoder:
    """Encodes chunks of texts with one vocabulary; one per worker process."""

    def __init__(self, path: str, literal_specials: bool = False):
        import os
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        from tokenizers import Tokenizer
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = literal_specials
        self.special = [] if literal_specials else [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.kind = _classes()
        self.code = np.random.default_rng(3).integers(1, 2**63, _FAST + 1, dtype=np.uint64)
        self.bytes_of: np.ndarray | None = None
        self._forget()

    def _forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int32)
        self.pool = np.zeros(0, np.int32)

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.int32) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _starts(self, code: np.ndarray, kind: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Starts of the pre-tokens of a chunk (offsets: starts of the texts in code points)."""
        n = len(code)
        head = np.zeros(n + 1, bool)
        head[offsets] = True
        run = head[:n].copy()
        run[1:] |= kind[1:] != kind[:-1]
        first = np.flatnonzero(run)
        last = np.append(first[1:], n)
        space = kind[first] == 3
        start = np.zeros(n + 1, bool)
        start[first[space]] = True
        start[last[space & ~head[last]] - 1] = True  # the last white space before a word stands alone or joins it
        word = first[~space]
        joined = (word > 0) & ~head[word] & (code[word - 1] == 0x20)
        start[word[~joined]] = True
        # 's 't 'm 'd 're 've 'll: an apostrophe that starts a pre-token takes these letters along
        quote = word[(code[word] == 0x27) & ~joined]
        if len(quote):
            padded = np.concatenate([code, np.zeros(3, code.dtype)])
            end = offsets[np.searchsorted(offsets, quote, "right")] if len(offsets) > 1 else np.full(len(quote), n)
            a, b = padded[quote + 1], padded[quote + 2]
            one = np.isin(a, [ord(x) for x in "stmd"]) & (quote + 1 < end)
            two = (((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))) & (quote + 2 < end)
            for size, hit in ((2, quote[one]), (3, quote[two & ~one])):
                start[hit + 1] = False
                inside = hit[hit + size < n]
                start[inside + size] = True
        return np.flatnonzero(start[:n])

    def _new_ids(self, tokens: list[str]) -> list[np.ndarray]:
        """Ids of distinct pre-tokens.  " word" pre-tokens are encoded many at a time and cut apart by length in bytes."""
        out: list = [None] * len(tokens)
        plain = [i for i, t in enumerate(tokens) if len(t) > 1 and t[0] == " " and t[1:].isalpha()]
        rest = sorted(set(range(len(tokens))) - set(plain))
        for i, ids in zip(rest, self.whole([tokens[i] for i in rest])):
            out[i] = ids
        if plain and self.bytes_of is None:
            # byte-level vocabulary: one letter of a token's spelling stands for one byte
            self.bytes_of = np.zeros(self.library.get_vocab_size(), np.int64)
            for token, i in self.library.get_vocab().items():
                self.bytes_of[i] = len(token)
        groups = [plain[k:k + _GROUP] for k in range(0, len(plain), _GROUP)]
        for group, ids in zip(groups, self.whole(["".join(tokens[i] for i in g) for g in groups])):
            ends = np.cumsum([len(tokens[i].encode()) for i in group])
            cut = np.searchsorted(np.cumsum(self.bytes_of[ids]), ends) + 1
            for i, part in zip(group, np.split(ids, cut[:-1])):
                out[i] = part
        return out

    def chunk(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, id offsets) of the texts ``data[offsets[i]:offsets[i + 1]]`` (UTF-8)."""
        docs = len(offsets) - 1
        text = data.tobytes().decode("utf-8")
        code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        lead = np.zeros(len(data) + 1, np.int64)
        np.cumsum((data & 0xC0) != 0x80, out=lead[1:])
        at = lead[offsets]
        kind = self.kind[code]
        odd = np.zeros(docs, bool)
        if (kind == 9).any():
            odd[np.searchsorted(at, np.flatnonzero(kind == 9), "right") - 1] = True
        for special in self.special:
            place = text.find(special)
            while place >= 0:
                odd[np.searchsorted(at, place, "right") - 1] = True
                place = text.find(special, place + 1)
        starts = self._starts(code, kind, at)
        doc = np.searchsorted(at, starts, "right") - 1
        ends = np.append(starts[1:], len(code))
        total = np.zeros(len(code) + 1, np.uint64)
        from .common import _BASE, _INVERSE, _power, mix
        np.cumsum(self.code[np.minimum(code, _FAST)] * _power(_BASE, len(code)), out=total[1:])
        key = mix((total[ends] - total[starts]) * _power(_INVERSE, len(code) + 1)[starts] + (ends - starts).astype(np.uint64))
        good = ~odd[doc]
        starts, ends, key, doc = starts[good], ends[good], key[good], doc[good]
        distinct, sample, back = np.unique(key, return_index=True, return_inverse=True)
        if len(self.keys) + len(distinct) > KEPT_PRETOKENS:
            self._forget()
        place = np.searchsorted(self.keys, distinct)
        known = place < len(self.keys)
        known[known] = self.keys[place[known]] == distinct[known]
        if not known.all():
            new = np.flatnonzero(~known)
            ids = self._new_ids([text[starts[s]:ends[s]] for s in sample[new]])
            size = np.array([len(x) for x in ids], np.int32)
            begin = len(self.pool) + np.concatenate([[0], np.cumsum(size[:-1], dtype=np.int64)]).astype(np.int64)
            self.pool = np.concatenate([self.pool, *ids])
            where = place[new]
            self.keys = np.insert(self.keys, where, distinct[new])
            self.at = np.insert(self.at, where, begin)
            self.size = np.insert(self.size, where, size)
            place = np.searchsorted(self.keys, distinct)
        slot = place[back]
        size = self.size[slot].astype(np.int64)
        done = np.cumsum(size)
        flat = self.pool[np.repeat(self.at[slot] - (done - size), size) + np.arange(int(done[-1]) if len(done) else 0)]
        per_doc = np.zeros(docs, np.int64)
        np.add.at(per_doc, doc, size)
        if odd.any():
            parts = np.split(flat, np.cumsum(per_doc)[:-1])
            which = np.flatnonzero(odd)
            for d, ids in zip(which, self.whole([text[at[d]:at[d + 1]] for d in which])):
                parts[d] = ids
                per_doc[d] = len(ids)
            flat = np.concatenate(parts) if parts else flat
        return flat, np.concatenate([[0], np.cumsum(per_doc)])


_encoders: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, literal_specials: bool = False) -> Encoder:
    if (path, literal_specials) not in _encoders:
        _encoders[path, literal_specials] = Encoder(path, literal_specials)
    return _encoders[path, literal_specials]


def vocabulary_path(path: str | None) -> str:
    """The vocabulary's place; the public file of this machine (of the worker, when called there) by default."""
    if path is None:
        import public_tokenizers
        return public_tokenizers.path(VOCABULARY)
    return path


def encoded_chunks(batches, path: str | None, end_id: int,
                   literal_specials: bool = False) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, ids, id offsets) with ``end_id`` appended to every text's ids."""
    coder = encoder(vocabulary_path(path), literal_specials)
    for batch in batches:
        for rows, data, offsets in text_chunks(batch):
            ids, at = coder.chunk(data, offsets)
            yield rows, np.insert(ids, at[1:], np.int32(end_id)), at + np.arange(len(at))


def write_token_files(docs: DataFrame, path: str, vocabulary: str | None = None, end_id: int = END_ID,
                      literal_specials: bool = False) -> None:
    """Writes ORC files of (doc_id, ids) in ascending doc_id order at ``path``."""
    spark = docs.sparkSession
    small_batches(spark)

    def encode(batches):
        for rows, ids, at in encoded_chunks(batches, vocabulary, end_id, literal_specials):
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids))], ["doc_id", "ids"])

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.select("doc_id", "text").repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id")
    (ordered.mapInArrow(encode, "doc_id long, ids array<int>").write
     .option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01")
     .option("orc.create.index", "true").option("orc.row.index.stride", "1000").option("orc.stripe.size", str(16 << 20))
     .option("compression", "zstd").orc(path))


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, ids) of token files; a filter on doc_id is pushed into stripe and row-group metadata."""
    return spark.read.schema("doc_id long, ids array<int>").orc(path)


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """Per document in the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    small_batches(spark)

    def digest(batches):
        for batch in batches:
            ids = batch.column(2)
            at = np.asarray(ids.offsets)
            flat = np.ascontiguousarray(np.asarray(ids.values), dtype="<u4")
            crc = [zlib.crc32(flat[a:b]) for a, b in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(np.diff(at).astype(np.int64)), pa.array(crc, pa.int64())],
                ["file", "doc_id", "n_tokens", "ids_crc32"])

    rows = written(read_token_files(spark, path).select(F.col("_metadata.file_name").alias("file"), "doc_id", "ids").mapInArrow(
        digest, "file string, doc_id long, n_tokens long, ids_crc32 long"), "token-index")
    from pyspark.sql import Window
    # one row per file: the files hold disjoint, ascending id ranges, so a file starts where the ones before end
    per_file = rows.groupBy("file").agg(F.min(F.struct(F.col("doc_id").isNotNull(), "doc_id")).alias("low"), F.sum("n_tokens").alias("n"))
    begins = per_file.select("file", (F.sum("n").over(Window.orderBy("low")) - F.col("n")).alias("begin"))
    within = Window.partitionBy("file").orderBy("doc_id", "ids_crc32", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    return (rows.withColumn("before", F.coalesce(F.sum("n_tokens").over(within), F.lit(0))).join(begins, "file")
            .select("doc_id", (F.col("begin") + F.col("before")).cast("long").alias("start"), "n_tokens", "ids_crc32"))


def op4_token_files(spark, sf_dir: str) -> DataFrame:
    """Contract query: writes the token files of all documents and digests them as read back."""
    path = scratch_path(spark, "tokens")
    write_token_files(table(spark, sf_dir, "documents"), path)
    return token_index(spark, path)
