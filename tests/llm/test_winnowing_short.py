"""Short texts that share much are alike."""
from pagelens.llm import winnowing
from tests.llm.test_operators import SF


def test_short_edited_texts_are_not_reported_as_unlike(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    short = docs.selectExpr("doc_id", "substring(text, 1, 160 + cast(doc_id % 190 as int)) as text").where("length(text) >= 160")
    rows = winnowing.compare_successors(short).collect()
    assert len(rows) >= 50
    assert all(r["near_edited"] > 0 for r in rows)


def test_error_against_all_grams():
    words = [f"w{i * 7919 % 1009}" for i in range(4000)]
    error = []
    for i in range(0, 3900, 30):
        text, other = " ".join(words[i:i + 50]), " ".join(words[i + 50:i + 100])
        edited = text[:len(text) - len(text) // 2] + other[:len(text) // 2]
        grams = [{t[j:j + winnowing.GRAM] for j in range(len(t) - winnowing.GRAM + 1)} for t in (text, edited)]
        true = len(grams[0] & grams[1]) / len(grams[0] | grams[1])
        error.append(abs(true - winnowing.likeness(winnowing.winnow(text), winnowing.winnow(edited))))
    assert sum(error) / len(error) < 0.06
