"""Lexical search, fill-in-the-middle and language identification."""
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from pagelens.llm import common, fim, language_id, lexical_search as search
from tests.llm.test_operators import SF

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# ---------------------------------------------------------------- search

def brute_search(docs, items, k=10):
    """(item, rank, doc, score) by the formula, one item at a time."""
    rows = [(i, Counter(TERM.findall((t or "").translate(UPPER)))) for i, t in docs]
    rows = [(i, c, sum(c.values())) for i, c in rows if c]
    total, length = len(rows), sum(n for *_, n in rows)
    df = Counter(t for _, c, _ in rows for t in c)
    queries = {}
    for i, t in items:
        queries.setdefault(i, set()).update(TERM.findall((t or "").translate(UPPER)))
    out = []
    for item, terms in queries.items():
        found = []
        for i, c, n in rows:
            m = 100 - 90 + (90 * n * total) // length
            s = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms if c[t])
            if s > 0:
                found.append((-s, i is None, i))
        found.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(item, r, i, -s) for r, (s, _, i) in enumerate(found[:k], 1)]
    return sorted(out, key=repr)


def found(df):
    return sorted(map(tuple, df.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def test_search_is_brute_force(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)] + ["Été", "日本", "Ü", "x1"]
    draw = lambda n: " ".join(rng.choices(words, [1 / (1 + i) for i in range(len(words))], k=n))
    docs = [(i, draw(rng.randint(0, 40))) for i in range(300)] + [(7, "w1 w2 W3"), (7, "w1 w2 w3")] + [(400 + i, "W1-w2, w50") for i in range(40)]
    items = [(i, draw(rng.randint(1, 25))) for i in range(40)] + [(3, "w59 w58"), (41, ""), (42, None), (43, "nowhere"), (None, "w1 w50"), (44, "W1 w1 w1")]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    q = spark.createDataFrame(items, "item_id long, text string")
    want = brute_search(docs, items)
    assert found(search.search(d, q)) == want
    # many blocks, one group for each, and batches of a few documents
    assert found(search.search(d, q, block=7, group_pairs=40)) == want
    assert found(search.search(d, q, k=3)) == sorted([x for x in want if x[1] <= 3], key=repr)


def test_small_batches(spark, monkeypatch):
    docs = [(i, f"a b{i % 3} c{i % 7}") for i in range(100)]
    items = [(1, "a b1 c2"), (2, "a b1 c3"), (3, "a b1 c2")]
    shared = type("Shared", (), {"value": None})
    read = type("Shared", (), {"value": {}})
    sets = [set(search.terms_of(t)) for _, t in items]
    terms, leaf, left, right, nodes = search.mine([{x.decode() for x in s} for s in sets])
    starts = np.cumsum([0] + [len(x) for x in nodes]).tolist()
    plan = dict(items=[1, 2, 3], terms=terms, leaf=leaf, left=left, right=right, starts=starts, nodes=[x for n in nodes for x in n])
    for t in terms:
        read.value[t.encode()] = len(read.value)
    import pyarrow as pa
    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in docs]), pa.array([t for _, t in docs])], names=["doc", "text"])
    hits = list(search._read(read)([batch]))
    shared.value = ([plan], np.arange(1, len(terms) + 1), 100, 300)
    want = list(search._rank(shared, 4)(hits))
    monkeypatch.setattr(search, "BATCH_CELLS", 1)
    assert list(search._rank(shared, 4)(hits)) == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sets(st.sampled_from("abcdefghij"), min_size=1), min_size=1, max_size=12))
def test_mined_nodes_cover_each_query_once(queries):
    terms, leaf, left, right, nodes = search.mine(queries)
    leaves = max(leaf) + 1
    holds = [[t for t, c in zip(terms, leaf) if c == i] for i in range(leaves)]
    for a, b in zip(left, right):
        holds.append(holds[a] + holds[b])
    for q, own in zip(queries, nodes):
        assert sorted(t for n in own for t in holds[n]) == sorted(q)


def test_shared_sets_are_joined():
    core = set("abcdef")
    _, leaf, left, _, nodes = search.mine([core | {"x", "y"}, core | {"z"}, set("abc") | {"u"}, set("abc") | {"v"}])
    assert len(left) == 1 and sum(map(len, nodes)) == 8      # abc + def once, and one set for each query's own


def test_search_odd_tables(spark, odd, nothing):
    q = spark.createDataFrame([(1, "quick fox lorem"), (2, None)], "item_id long, text string").withColumn("score", F.lit("x"))
    docs = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert found(search.search(odd, q)) == brute_search(docs, [(1, "quick fox lorem")])
    assert found(search.search(nothing, q)) == [] and found(search.search(odd, q.limit(0))) == []
    with pytest.raises(TypeError):
        search.search(odd.withColumn("doc_id", F.col("doc_id").cast("string")), q)


def test_search_query(spark):
    docs = [(r["doc_id"], r["text"]) for r in common.documents(spark, SF).select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    assert found(search.query(spark, SF)) == brute_search(docs, items)


# ---------------------------------------------------------------- fill in the middle

UNIT = re.compile("[A-Za-z]+|[^A-Za-z]")


def brute_fim(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k:8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    pre, mid, suf = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(units), "plain", text, None, None
    if h[3] % 100 < 20:
        return len(units), "spm", f"<S>{suf}<P>{pre}<M>{mid}", len(pre), len(mid)
    return len(units), "psm", f"<P>{pre}<S>{suf}<M>{mid}", len(pre), len(mid)


def test_fim_is_brute_force_and_comes_back(spark):
    texts = ["a b c", "<S <P <M <M", "é ü\U0001F600日本\n\r\0x", "$1 \\2 {3} $", "x<P>y", "<M>", "<S", "P>", " ", "don't stop", "aB9 " * 50]
    rows = [(i, texts[i % len(texts)]) for i in range(200)] + [(None, "no id here"), (5, None), (6, ""), (-9, "minus nine"), (1 << 60, "a long id")]
    out = fim.transform(spark.createDataFrame(rows, "doc_id long, text string"))
    got = out.select("doc_id", "text", "fim.*", fim.restore("fim.output", "fim.form").alias("back")).collect()
    assert len(got) == len(rows) and {r["form"] for r in got} == {"plain", "psm", "spm"}
    for r in got:
        assert (r["n"], r["form"], r["output"], r["prefix_chars"], r["middle_chars"]) == brute_fim(r["doc_id"], r["text"])
        assert r["back"] == (r["text"] or "")


def test_fim_of_a_very_long_text(spark):
    text = "ab, cd\n" * 300_000                              # 1.5 million units
    row = next(r for i in range(50) if (r := fim.transform(spark.createDataFrame([(i, text)], "doc_id long, text string")).select(
        "fim.*", fim.restore("fim.output", "fim.form").alias("back")).first())["form"] != "plain")
    assert row["back"] == text and row["n"] == 1_500_000


def test_fim_odd_tables(spark, odd, nothing):
    got = fim.transform(odd.withColumn("fim", F.lit(1)))
    assert got.columns == [*odd.columns, "fim", "fim_"] and got.count() == odd.count()
    for r in got.select("doc_id", "text", "fim_.*").collect():
        assert (r["n"], r["form"], r["output"], r["prefix_chars"], r["middle_chars"]) == brute_fim(r["doc_id"], r["text"])
    assert fim.transform(nothing).count() == 0


# ---------------------------------------------------------------- language

def brute_kernel(a: bytes, b: bytes, counting: set) -> float:
    sets = [{x[i:i + n] for n in range(1, 5) for i in range(len(x) - n + 1)} & counting for x in (a, b)]
    return len(sets[0] & sets[1]) / math.sqrt(max(1, len(sets[0])) * max(1, len(sets[1])))


def test_kernels_are_those_of_sets(monkeypatch):
    marks = [language_id.normalised(t) for t in ("the cat sat on the mat", "le chat est sur la table", "Die Katze, die Maus!", "été ÉTÉ")]
    held = [{x[i:i + n] for n in range(1, 5) for i in range(len(x) - n + 1)} for x in marks]
    counting = {g for g, n in Counter(g for s in held for g in s).items() if n > 1}
    code = lambda g: (1 << (8 * len(g))) | int.from_bytes(g, "big")
    order = sorted(counting)
    has = np.array([[g in s for s in held] for g in order], np.uint8)
    model = language_id.Model(["a"], np.array([code(g) for g in order], np.uint64), np.packbits(has, axis=1), 4, np.zeros((4, 1)), np.zeros(1))
    texts = [language_id.normalised(t) for t in ("a cat is on the table", "", "日本", "the mat " * 30, "Été sur la MER")]
    want = [[brute_kernel(t, m, counting) for m in marks] for t in texts]
    assert np.allclose(language_id.Scorer(model).kernels(texts), want)
    for name, size in (("PIECE", 7), ("CELLS", 1), ("COLUMNS", 5)):   # in pieces
        monkeypatch.setattr(language_id, name, size)
    assert np.allclose(language_id.Scorer(model).kernels(texts), want)


def test_ridge_on_all_landmarks_is_kernel_ridge():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(12, 20))
    k = x @ x.T
    y = np.array([0, 1, 2] * 4)
    w, b = language_id.ridge(k, y, k, 0.5, 3)
    # the dual form with centred rows, each language weighing a third
    t = np.where(y[:, None] == np.arange(3), 1.0, -1.0)
    c = np.eye(12) - 1 / 12
    alpha = np.linalg.solve(c @ k @ c / 12 + 0.5 * np.eye(12), (t - t.mean(0)) / 12)
    assert np.allclose(k @ w + b, (k - k.mean(0, keepdims=True)) @ c @ alpha + t.mean(0), atol=1e-6)


def test_held_out_languages(spark):
    docs = common.documents(spark, SF).select("doc_id", "text", "lang")
    got = language_id.query(spark, SF).join(docs, "doc_id").collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r["held_out"] and language_id.has_letter(r["text"])]
    assert sum(r["lang_pred"] == r["lang"] for r in held) >= 0.98 * len(held)


def test_held_out_labels_are_not_read(spark):
    docs = common.documents(spark, SF).select("doc_id", "text", "lang")
    held = common.crc_of_id(modulus=4) == 2
    other = docs.withColumn("lang", F.when(held, "zz").otherwise(F.col("lang")))
    a, b = (language_id.train(d, usable=~held) for d in (docs, other))
    assert a.labels == b.labels and np.array_equal(a.weights, b.weights) and np.array_equal(np.sort(a.codes), np.sort(b.codes))


def test_language_odd_tables(spark, odd, nothing):
    model = language_id.train(odd)
    assert model.labels == ["en", "xx"]
    got = language_id.identify(odd.withColumn("language", F.lit(1)), model).collect()
    assert len(got) == odd.count()
    for r in got:
        assert (r["language_"]["lang"] == "und") == (not language_id.has_letter(r["text"]))
    assert language_id.identify(nothing, model).count() == 0
    empty = language_id.train(nothing)
    assert {r["language"]["lang"] for r in language_id.identify(odd, empty).collect()} == {"und"}
    one = language_id.train(odd.where("lang = 'en'"))
    assert {r["language"]["lang"] for r in language_id.identify(odd, one).collect()} == {"en", "und"}
