"""The fixture pages and their SQL hold whole texts."""
from pagelens.plans import fixtures

SF = "/root/testdata/sf0.001"


def test_pages_hold_the_end_of_every_text(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) > 1000")
    ends = {r["doc_id"]: r["text"].split()[-3:] for r in docs.select("doc_id", "text").collect()}
    assert ends
    pages = {r["page_id"]: r["html"] for r in fixtures.content_pages(docs).collect()}
    for i, words in ends.items():
        assert all(fixtures_escape(w) in pages[i][-4000:] for w in words)
    listing = {r["page_id"]: r["html"] for r in fixtures.listing_pages(docs).collect()}
    for i, words in ends.items():
        if i % 3 != 1:
            assert all(fixtures_escape(w) in listing[i // fixtures.ROWS_PER_PAGE] for w in words)


def fixtures_escape(word):
    return word.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;")


def test_sql_has_no_prefix():
    for sql in (fixtures.CONTENT_MARKDOWN_SQL, fixtures.LINK_DENSITY_SQL, fixtures.LISTING_RESULTS_SQL):
        assert "left(text" not in sql
