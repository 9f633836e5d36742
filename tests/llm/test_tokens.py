"""Token ids against the library, token files read back, pruning by metadata."""
from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from sparklog.llm import common, tokens


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(tokens.vocabulary_path(None))


@pytest.mark.parametrize("literal", [False, True])
def test_chunks_equal_the_library(literal):
    from tokenizers import Tokenizer
    library = Tokenizer.from_file(tokens.vocabulary_path(None))
    library.encode_special_tokens = literal
    rnd = random.Random(1)
    parts = ["a", "b", "é", " ", "  ", "\n", "'s", "'", "'re", "'ll", "ve", "1", "22", "!", "#", "\t", "漢", "<|endoftext|>", "don't", "st",
             "'v", "''", " ", "\x1c", "word", " The", "²", "ǅ"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 25))) for _ in range(5000)] + ["", " ", "\n\n", "x" * 300, "it's " * 50,
        "a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|> ", "<|endoftext", "|>"]
    coder, got = tokens.Encoder(tokens.vocabulary_path(None), literal), []
    for _, data, offsets in common.text_chunks(pa.record_batch([pa.array(texts)], ["text"])):
        ids, at = coder.chunk(data, offsets)
        got += [list(ids[a:b]) for a, b in zip(at[:-1], at[1:])]
    assert got == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def digest(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def check(spark, docs, library, tmp_path):
    path = f"{tmp_path}/files"
    tokens.write_token_files(docs, path)
    rows = sorted(((r.doc_id, library.encode(r.text or "", add_special_tokens=False).ids + [2]) for r in docs.collect()),
                  key=lambda r: (r[0] is not None, r[0] or 0, digest(r[1])))
    want, at = [], 0
    for doc, ids in rows:
        want.append((doc, at, len(ids), digest(ids)))
        at += len(ids)
    assert sorted(map(tuple, tokens.token_index(spark, path).collect()), key=str) == sorted(want, key=str)
    return path


def test_files_of_odd_documents(spark, edge_docs, no_docs, library, tmp_path):
    special = spark.createDataFrame([(None, "no id"), (None, "a <|endoftext|> b"), (None, None), (70, "<|endoftext|>"), (71, "x<|endoftext|>y" * 9)],
                                    "doc_id long, text string")
    check(spark, edge_docs.select("doc_id", "text").union(special), library, tmp_path)
    tokens.write_token_files(no_docs, f"{tmp_path}/none")
    assert tokens.token_index(spark, f"{tmp_path}/none").count() == 0


def test_files_of_the_table_and_reads_by_id(spark, small_docs, library, tmp_path):
    path = check(spark, small_docs, library, tmp_path)
    one = tokens.read_token_files(spark, path).where("doc_id = 77")
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,77)]" in one._jdf.queryExecution().toString()
    text = small_docs.where("doc_id = 77").first().text
    assert one.first().ids == library.encode(text, add_special_tokens=False).ids + [2]
