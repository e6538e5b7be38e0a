"""Every benchmark row is looked for: shared and null ids, short items, scripts without spaces."""
import random
from collections import Counter

from pagelens.llm import decontaminate

BENCH = [
    (1, "the first question about rivers in the north of the country"), (1, "another question of the same id that is quite a bit longer than the first"),
    (None, "a row without an id about mountains and lakes"), (None, "one more row without any id about trees and birds"),
    (2, "capital of France"), (3, "日本の首都はどこですか"), (4, "ประเทศไทย"), (5, "the first question about rivers in the north of the country"),
    (5, "the first question about rivers in the north of the country"), (6, None), (7, "?!"), (8, "水"), (9, "xylophone"),
]
DOCS = [
    (1, "Q: The first question about rivers in the north of the country?"), (2, "it says: a row without an id about mountains and lakes."),
    (3, "one more row without any id about trees and birds"), (4, "what is the Capital of France, they ask"), (5, "質問：日本の首都はどこですか。答え"),
    (6, "ประเทศไทย อยู่ที่ไหน"), (7, "another question of the same id that is quite a bit longer than the first"), (8, "the capital of the land of France"),
    (9, "日本の町"), (10, "水"), (11, "a xylophone"), (12, None), (13, "nothing of it"), (14, "capital of france capital of France and the first question about rivers in the north of the country"),
]
WANT = {(1, 1), (1, 5), (2, None), (3, None), (4, 2), (5, 3), (6, 4), (7, 1), (10, 8), (11, 9), (14, 1), (14, 2), (14, 5)}


def frames(spark):
    return spark.createDataFrame(DOCS, "doc_id long, text string"), spark.createDataFrame(BENCH, "item_id long, text string")


def test_every_row_of_the_benchmark_is_looked_for(spark):
    docs, bench = frames(spark)
    rows = decontaminate.leaks(docs, bench).collect()
    assert Counter((r["doc_id"], r["item_id"]) for r in rows) == Counter(WANT)
    assert all(r["coverage"] == 1 for r in rows)
    assert rows[0].asDict().keys() == {"doc_id", "item_id", "n_tiles", "n_matched", "coverage"}


def test_clean_drops_them_without_ids(spark):
    docs, bench = frames(spark)
    # "a xylophone" and "what is the Capital of France, they ask" hold a short item inside a line: kept
    assert {r["doc_id"] for r in decontaminate.clean(docs, bench.select("text")).collect()} == ({d for d, _ in DOCS} - {d for d, _ in WANT}) | {4, 11}


def test_short_items_take_out_whole_lines_only(spark):
    texts = {1: "Paris is nice in spring and so is Rome", 2: "Paris", 3: "Q: which city?\r\n  Paris!\nnext question", 4: "yes, Paris",
             5: "Paris Paris", 6: "capital of\nFrance", 7: "x\ncapital of france.\ny", 8: "Yes\nno", 9: None, 10: "", 11: "\n\nparis", 12: "say yes no"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    bench = spark.createDataFrame([("Paris",), ("yes",), ("capital of France",), ("",), (None,)], "text string")
    kept = {r["doc_id"] for r in decontaminate.clean(docs, bench).collect()}
    assert kept == {1, 4, 5, 6, 9, 10, 12}


def test_a_common_lead_in_makes_no_pairs_and_loses_no_leak(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(800)]
    lead = rng.choices(words, k=9)
    items = [lead + rng.choices(words, k=rng.choice([3, 8, 14, 25])) for _ in range(25)] + [list(lead)]
    docs = []
    for i in range(120):
        body = lead + rng.choices(words, k=20)
        if i % 3 == 0:                      # halves of an item, in the other order
            item = rng.choice(items)
            cut = len(item) // 2
            body += item[cut:] + rng.choices(words, k=3) + item[:cut]
        docs.append((i, " ".join(body)))
    want = set()
    for d, text in docs:
        for k, item in enumerate(items):
            n = sum(x[3] for x in decontaminate.tiles([text.split()], item, decontaminate.SEED))
            if n >= decontaminate.COVERAGE * len(item):
                want.add((d, k, n))
    got = decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"),
                              spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)], "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"], r["n_matched"]) for r in got} == want and len(got) == len(want) > 150


def test_the_rare_seeds_leave_out_what_covers_too_little():
    import pyarrow as pa
    places = [[{"df": 9, "hash": h, "at": h} for h in range(5)] + [{"df": 1, "hash": h, "at": h} for h in range(5, 16)]]
    kind = pa.list_(pa.struct([("df", pa.int64()), ("hash", pa.int64()), ("at", pa.int32())]))
    batch = pa.RecordBatch.from_arrays([pa.array([7]), pa.array([20]), pa.array(places, kind)], names=["item", "words", "places"])
    out = pa.Table.from_batches(decontaminate._rare(5, 0.5)([batch])).to_pydict()
    # the five common ones cover words 0 to 8, one more would make ten of twenty
    assert sorted(out["hash"]) == list(range(5, 16)) and set(out["item"]) == {7}


def test_words_of_scripts_without_spaces():
    assert decontaminate.words_of("Tokyo東京2020年 カタ・café") == ["tokyo", "東", "京", "2020", "年", "カ", "タ", "café"]
    assert decontaminate.words_of("naïve two_words") == ["naïve", "two_words"]
