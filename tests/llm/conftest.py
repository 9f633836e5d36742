"""Small fixtures: a documents table with the awkward cases every operator must define."""
from __future__ import annotations

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, n_words string, kept string, _q string"


def edge_rows():
    base = " ".join(f"w{i}" for i in range(40))
    near = base.replace("w7 ", "x7 ")
    rows = [
        (0, base), (1, base), (2, near), (3, None), (4, ""), (5, " \n\t "), (6, "two words"), (7, "two words"),
        (8, "a b c d e f g h i j k l m n o p q r s t u v"), (9, "A B C D E F G H I J K L M N O P Q R S T U V"),
        (10, "line one here is some text to read\n" * 6), (11, "é à ü ß 漢字 " * 15), (12, "x " * 3000),
        (13, "### $$$ word*** other%%% " * 8), (14, " ".join(f"long{i % 977}" for i in range(30000))),
        (15, base + " tail " + " ".join(f"q{i}" for i in range(30))), (6, "two words"), (16, "\x00 nul \x0b vt"),
        (17, "IT IS ALL SHOUTED!! AND!! AGAIN!! " * 5),
    ]
    return [(i, t, "en", None if i % 3 else "src0", None if t is None else len(t), "clash", "clash", "clash") for i, t in rows]


@pytest.fixture(scope="session")
def edge_docs(spark):
    return spark.createDataFrame(edge_rows(), DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def small_docs(spark, sf_small):
    return spark.read.parquet(f"{sf_small}/documents.parquet")
