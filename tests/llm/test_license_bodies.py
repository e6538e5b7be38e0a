"""Bodies of licenses that do not say their name."""

import re

import pytest

from pagelens.llm import license_bodies, license_scan
from tests.llm.test_operators import brute_licenses

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
# of this software and associated documentation files (the "Software"), to deal
# in the Software without restriction, including without limitation the rights
# to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
# copies of the Software, and to permit persons to whom the Software is
# furnished to do so, subject to the following conditions:"""
BSD = """Redistribution and use in source and binary forms, with or without
 * modification, are permitted provided that the following conditions are met:
 * 1. Redistributions of source code must retain the above copyright notice,
 *    this list of conditions and the following disclaimer."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies."""
LGPL = """This library is free software; you can redistribute it and/or modify it
under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version."""


def labels(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = sorted(license_scan.detect(df).collect(), key=lambda r: r["doc_id"])
    return [{d["label"] for d in r["license"]["kept"]} for r in rows]


def test_pasted_bodies_are_found(spark):
    got = labels(spark, [MIT, BSD, ISC, LGPL, "We ask for permission to use the software and copy it", "software is provided as a service"])
    assert got == [{"mit"}, {"bsd"}, {"isc"}, {"lgpl", "gnu"}, set(), set()]


def with_base(found, text):
    """As the query lists them: the base phrases' labels too."""
    return ",".join(sorted(found | set(brute_licenses(text)[4].split(",")) - {""}))


def spelled(signature, pick):
    """One text that the signature means: optional words in or out, the first
    or last choice, wrapped, in capitals."""
    plain = re.sub(r"\[([^\]]+)\]", r"\1" if pick else "", signature)
    words = [w.split("|")[-pick] for w in plain.split()]
    return "// " + "\n// ".join(" ".join(words[i:i + 6]).upper() + "," for i in range(0, len(words), 6))


@pytest.mark.parametrize("pick", [0, 1])
def test_every_signature_alone_matches_brute_force(spark, pick):
    texts = [spelled(s, pick) for _, _, s in license_bodies.BODIES]
    for (_, label, s), text, found in zip(license_bodies.BODIES, texts, labels(spark, texts)):
        assert label in found, s
        assert with_base(found, text) == brute_licenses(text)[5], s
    # one word less in the middle is not the sentence
    cut = [" ".join(w for k, w in enumerate(t.split()) if k != len(t.split()) // 2) for t in texts]
    assert [with_base(found, t) for found, t in zip(labels(spark, cut), cut)] == [brute_licenses(t)[5] for t in cut]


def test_the_keyword_is_in_every_match():
    for _, _, s in license_bodies.BODIES:
        regex, keyword = license_bodies.regex_of(s), license_bodies.keyword_of(s)
        for pick in (0, 1):
            words = "".join(f"<{w}>" for w in re.findall(r"[a-z0-9]+", spelled(s, pick).lower()))
            assert re.fullmatch(regex, words) and keyword in words, s
