"""A trie above the broadcast's bound keeps its order and all of its counts."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from pagelens.llm import common, ppm
from tests.llm.test_operators import SF


def test_scores_do_not_depend_on_the_bound(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    more = spark.createDataFrame([(-1, None), (-2, ""), (-3, "é \U0001F600 \x00 zz"), (-4, "word " * 5000)], "doc_id long, text string")
    docs = common.written(docs.union(more), "ppm-test").repartition(3)
    held = common.crc_of_id(modulus=5) == 1
    monkeypatch.setattr(ppm, "TEXTS", 20_000)
    monkeypatch.setattr(ppm, "BUCKET", 1 << 13)
    want = {r["doc_id"]: r for r in ppm.score(docs, held).collect()}
    for bound in (200, 5_000, 40_000):                  # low levels of several orders
        assert ppm.train(docs.where(~held), max_pairs=bound)[0] < ppm.ORDER
        got = {r["doc_id"]: r for r in ppm.score(docs, held, max_pairs=bound).collect()}
        assert got.keys() == want.keys()
        for i, r in got.items():
            assert r["score"] == pytest.approx(want[i]["score"], rel=1e-9) and r[:-1] == want[i][:-1]


def test_a_model_on_a_low_one():
    data = [b"abracadabra", b"abc abd abe", b"", b"cadabra abc"] * 3
    whole = ppm.Model(5, *np.unique(ppm.grams_of(data, 5)[0], return_counts=True))
    grams, counts = np.unique(ppm.grams_of(data, 5)[0], return_counts=True)
    for order in (1, 2, 4):
        low = ppm.Model(order, *np.unique(ppm.grams_of(data, order)[0], return_counts=True))
        code = ppm.grams_of(data + [b"abrx cad", b"\xffzz"], 5)[0]
        end = (code >> np.uint64(8)) & np.uint64((1 << (8 * (order + 1))) - 1)
        of = (grams >> np.uint64(8)) & np.uint64((1 << (8 * (order + 1))) - 1)
        for e in np.unique(end):
            part = ppm.Model(5, grams[of == e], counts[of == e], low)
            assert np.allclose(part.log10(code[end == e]), whole.log10(code[end == e]))


def test_without_training_rows(spark):
    df = spark.createDataFrame([(1, "abc"), (2, None)], "doc_id long, text string")
    out = ppm.score(df, F.lit(True), max_pairs=0).collect()
    assert len(out) == 2 and all(r["score"] < 0 for r in out)
