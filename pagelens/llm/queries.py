"""Registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from pagelens.llm import (
    decontaminate, fim, language_id, lexical_search, license_scan, packing, ppm, secret_scan, sharding, simhash, toxicity, url_filter, winnowing,
)

QUERIES = {
    "op1_toxicity": toxicity.query,
    "op2_packing": packing.query,
    "op3_license_scan": license_scan.query,
    "op4_url_filter": url_filter.query,
    "op5_decontamination": decontaminate.query,
    "op6_winnowing": winnowing.query,
    "op7_secret_scan": secret_scan.query,
    "op8_sharding": sharding.query,
    "op9_ppm": ppm.query,
    "op10_simhash": simhash.query,
    "op11_lexical_search": lexical_search.query,
    "op12_fill_in_middle": fim.query,
    "op13_language_id": language_id.query,
}

ORACLES: dict[str, str] = {
    "op3_license_scan": license_scan.ORACLE,
    "op4_url_filter": url_filter.ORACLE,
    "op7_secret_scan": secret_scan.ORACLE,
    "op11_lexical_search": lexical_search.ORACLE,
    "op12_fill_in_middle": fim.ORACLE,
}
