"""Texts with many hits, recurring passages and many short documents."""
import random
import re
from collections import Counter

import numpy as np
import pytest

from pagelens.llm import common, license_scan, packing, secret_scan, toxicity


@pytest.fixture(scope="module")
def model():
    return toxicity.Model({"=vile": (4.0, 9.0), "=nasty": (3.0, 8.0), "=awful": (3.0, 8.0)}, 0.1, 1.5, -2.0, 0.1)


PASSAGE = "vile nasty awful vile thing"


@pytest.mark.parametrize("copies", [1, 3, 10, 100])
def test_separated_copies_of_a_passage_are_all_found(model, copies):
    filler = " ".join(f"plain{i % 40}" for i in range(200))
    cache = toxicity._Cache(model)
    one, found = toxicity.score_text(f"{filler} {PASSAGE} {filler}", model, cache)
    many, places = toxicity.score_text(f"{filler} " + f" {filler} ".join([PASSAGE] * copies) + f" {filler}", model, cache)
    assert len(found) == 1 and len(places) == copies
    assert many >= one - 1e-3 and one > 0.9


def test_repeats_within_a_passage_count_less(model):
    words = "vile a vile b vile".split()
    w = np.array([4.0, -0.1, 4.0, -0.1, 4.0])
    assert np.allclose(toxicity.damped(words, w), [4, -0.1, 4 * np.log2(3 / 2), -0.1, 4 * np.log2(4 / 3)])
    apart = np.array([4.0, -9.0, 4.0, -0.1, 4.0])
    assert np.allclose(toxicity.damped(words, apart), [4, -9, 4, -0.1, 4 * np.log2(3 / 2)])


def test_damping_against_a_walk_over_every_word():
    rng = random.Random(4)
    for _ in range(200):
        words = rng.choices("abcdef", k=rng.randint(0, 40))
        weight = {c: rng.choice([2.0, 1.0, 0.5, -0.3, -1.5, 0.0]) for c in "abcdef"}
        want, seen, run = [], Counter(), 0.0
        for c in words:
            x = weight[c]
            if x > 0:
                if run <= 0:        # a new excursion
                    seen.clear()
                    run = 0.0
                seen[c] += 1
                x *= np.log2((seen[c] + 1) / seen[c])
            run = max(0.0, run) + x
            want.append(x)
        got = toxicity.damped(words, np.array([weight[c] for c in words]))
        assert np.allclose(got, want)


def test_places_are_distinct_runs():
    assert [toxicity.places(x.split()) for x in ("", "a", "a b", "a b c", "a b c a b c a b c")] == [0, 1, 2, 1, 3]


@pytest.mark.parametrize("size", [1, 5, 10, 20, 31])
def test_short_documents_leave_little_padding(size):
    pack, seqs = packing.Packer(packing.Limits()), []
    for i in range(5000):
        seqs += pack.add(i, size, size - 1)
    seqs += pack.finish()
    used = [sum(x[2] for x in s) for s in seqs]
    padded = [n if n & (n - 1) == 0 else packing.TOKENS for n in used]
    assert sum(used) == 5000 * size and sum(padded) <= 1.02 * sum(used)
    assert all(len(s) <= packing.SEGMENTS for s in seqs)
    got = Counter()
    for s in seqs:
        for key, start, n in s:
            got[key] += n
    assert set(got.values()) == {size} and len(got) == 5000


def test_running_rows(spark):
    for n in (0, 1, 31, 32, 33, 64, 1500):
        sql = common.running(f"slice(sequence(1, 2000), 1, {n})", "struct<before:int,x:int>", "0", lambda a, x: f"{a} + {x}", lambda a, b: f"{a} + {b}",
                             lambda a, x: f"struct({a} as before, {x} as x)")
        rows = spark.range(1).selectExpr(f"{sql} AS r").first()["r"]
        assert [(r["before"], r["x"]) for r in rows] == [(x * (x - 1) // 2, x) for x in range(1, n + 1)]


def test_thousands_of_secrets_in_one_text(spark):
    rng = random.Random(1)
    parts = [rng.choice(["x é ", "", "\U0001F600 word "]) + f'password = "abcdef{i:05d}"' for i in range(3000)]
    text = " ".join(parts)
    docs = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "none")], "doc_id long, text string")
    spans = {r["doc_id"]: r["spans"] for r in secret_scan.scan(docs).collect()}
    regex = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
    assert [(s["start"], s["end"]) for s in spans[1] if s["kind"] == 0] == [m.span() for m in regex.finditer(text)]
    assert spans[2] == spans[3] == spans[4] == []
    out = {r["doc_id"]: r["text"] for r in secret_scan.redact(docs).collect()}
    want, at = "", 0
    for s in sorted((s["start"], s["end"]) for s in spans[1]):
        if s[0] >= at:
            want += text[at:s[0]] + secret_scan.MARK
        at = max(at, s[1])
    assert out == {1: want + text[at:], 2: None, 3: "", 4: "none"}


def test_thousands_of_licenses_in_one_text(spark):
    text = " ".join(f"word{i} MIT License, or the Apache License {i % 7}" for i in range(3000))
    found = license_scan.detect(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()["license"]
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower())
    want = [i for i in range(len(words) - 1) if (words[i], words[i + 1]) in {("mit", "license"), ("apache", "license")}]
    assert sorted(d["start"] for d in found["base"]) == want
    kept = sorted((d["start"], d["start"] - d["size"], d["tier"]) for d in found["kept"])
    assert len(kept) >= 6000 and not any(a != b and b[0] <= a[0] and b[1] >= a[1] and b[2] < a[2] for a, b in zip(kept[1:], kept))
