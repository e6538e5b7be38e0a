"""The gate of the license scan keeps every text with a detection."""
import re

from pagelens.llm import license_scan
from tests.llm.test_operators import brute_licenses

GRANTS = [
    "This package is distributed under the BSD 3 clause", "offered under the GNU General Public v2", "released under the BSD",
    "Available under the terms of the Boost Software", "published under Creative Commons Attribution ShareAlike 4.0", "under the BSD",
]


def test_grants_without_the_word_license_are_found(spark):
    df = spark.createDataFrame(list(enumerate(GRANTS)), "doc_id long, text string")
    got = {r["doc_id"]: ",".join(sorted({d["label"] for d in r["license"]["kept"]})) for r in license_scan.detect(df).collect()}
    assert got == {i: brute_licenses(t)[-1] for i, t in enumerate(GRANTS)}
    assert all(got[i] for i in range(5)) and not got[5]


def test_every_rule_needs_a_string_of_the_gate():
    stems = license_scan.gate(license_scan.rules())
    for r in license_scan.rules():
        options = license_scan.needed(r["regex"])
        assert any(all(any(s in x for s in stems) for x in strings) for strings in options), r
    # shortest forms of the rules, without what is optional
    for r in license_scan.rules():
        short = re.sub(r"\(\?:(?:[^()]|\([^()]*\))*\)\?", "", r["regex"])
        short = re.sub(r"\(\?:([^()|]*)(?:\|[^()]*)?\)", r"\1", short.replace("[sc]", "c").replace("[0-9]{2}", "19").replace("[^>]+", "x"))
        assert re.search(r["regex"], short), (r["regex"], short)
        plain = short.strip("<>").replace("><", " ")
        assert any(s in plain for s in stems), plain
