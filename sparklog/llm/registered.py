"""Queries of this subpackage and, where SQL can express them, their DuckDB text."""

from __future__ import annotations

from . import chat, decontaminate, merkle, mixing, repair, substrings, urls
from .chat import op2_chat_format
from .decontaminate import op3_decontaminate
from .extract import op5_main_text
from .licenses import op7_license_scan
from .merkle import op12_merkle_manifest
from .mixing import op13_source_mix
from .neardup import op1_near_duplicates
from .packing import op6_best_fit_packing
from .quality import op10_quality_rules
from .repair import op11_repair
from .substrings import op8_substring_dedup
from .tokens import op4_token_files
from .urls import op9_url_filter

QUERIES = {
    "op1_near_duplicates": op1_near_duplicates,
    "op2_chat_format": op2_chat_format,
    "op3_decontaminate": op3_decontaminate,
    "op4_token_files": op4_token_files,
    "op5_main_text": op5_main_text,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_license_scan": op7_license_scan,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_url_filter": op9_url_filter,
    "op10_quality_rules": op10_quality_rules,
    "op11_repair": op11_repair,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_source_mix": op13_source_mix,
}
ORACLE: dict[str, str] = {
    "op2_chat_format": chat.ORACLE,
    "op3_decontaminate": decontaminate.ORACLE,
    "op8_substring_dedup": substrings.ORACLE,
    "op9_url_filter": urls.ORACLE,
    "op11_repair": repair.ORACLE,
    "op12_merkle_manifest": merkle.ORACLE,
    "op13_source_mix": mixing.ORACLE,
}
