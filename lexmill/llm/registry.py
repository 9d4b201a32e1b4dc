"""The queries of this subpackage and the SQL that they must agree with."""

from __future__ import annotations

from . import chat_format, decontamination, exact_dedup, merkle_manifest, mixing, near_dedup, quality, secret_scan, suffix_dedup, token_rollup, url_filter, vector_codes, warc

_MODULES = [near_dedup, secret_scan, warc, mixing, exact_dedup, token_rollup, chat_format, decontamination, quality, url_filter, vector_codes, suffix_dedup, merkle_manifest]


def queries() -> dict:
    return {k: f for m in _MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: s for m in _MODULES for k, s in m.ORACLES.items()}
