"""The queries that SQL can express against their DuckDB text; every registered query runs and keeps its columns."""
from __future__ import annotations

import pytest

from sparklog.llm.registered import ORACLE, QUERIES
from tests.oracle_check import compare, duck

COLUMNS = {
    "op1_near_duplicates": ["doc_id", "n_shingles", "component_id", "kept"],
    "op2_chat_format": ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
    "op3_decontaminate": ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
    "op4_token_files": ["doc_id", "start", "n_tokens", "ids_crc32"],
    "op5_main_text": ["page_id", "url", "text", "n_chars"],
    "op6_best_fit_packing": ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
    "op7_license_scan": ["doc_id", "n_words", "n_licenses", "licenses"],
    "op8_substring_dedup": ["doc_id", "n_words", "n_removed", "kept_sha256"],
    "op9_url_filter": ["page_id", "host", "path", "rule", "verdict"],
    "op10_quality_rules": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
    "op11_repair": ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"],
    "op12_merkle_manifest": ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"],
    "op13_source_mix": ["doc_id", "size", "source_size", "target", "taken"],
}


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_oracle(spark, sf_small, name):
    r = compare(spark, sf_small, name, QUERIES[name], ORACLE[name], duck(sf_small))
    assert r["cols"] and r["rows"] and r["values"], (r["sample_spark"], r["sample_duck"])


def test_registered_queries_and_columns(spark, sf_small):
    assert set(QUERIES) == set(COLUMNS)
    for name in sorted(set(QUERIES) - set(ORACLE) - {"op1_near_duplicates", "op6_best_fit_packing"}):
        assert QUERIES[name](spark, sf_small).columns == COLUMNS[name]
