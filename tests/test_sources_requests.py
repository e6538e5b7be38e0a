import json
import os
import tempfile

from pyspark.sql import functions as F

from pagelens.operators import process as PS
from pagelens.operators import requests as RQ
from pagelens.sources import pages as SP
from tests.conftest import pages_df


def test_readers(spark):
    root = tempfile.mkdtemp(prefix="pagelens-src-")
    with open(os.path.join(root, "replies.jsonl"), "w") as f:
        f.write(json.dumps({"html": "<p>x</p>", "status": 200, "url": "https://a.org/"}) + "\n")
        f.write(json.dumps({"html": "<p>y</p>", "url": "https://b.org/"}) + "\n")
    df = SP.read_scrape_replies(spark, os.path.join(root, "replies.jsonl"))
    rows = {r.url: r for r in df.collect()}
    assert rows["https://b.org/"].status == 0 and rows["https://a.org/"].final_url == "https://a.org/"
    os.makedirs(os.path.join(root, "html"))
    with open(os.path.join(root, "html", "a.html"), "w") as f:
        f.write("<html>\n<p>one</p>\n</html>")
    h = SP.read_html_files(spark, os.path.join(root, "html"))
    assert h.count() == 1 and "\n<p>one</p>\n" in h.first().html
    ok, bad = SP.split_missing_html(spark.createDataFrame([(1, "u", ""), (2, "v", "<p>")],
                                                          "page_id long, url string, html string"))
    assert ok.count() == 1 and bad.first().error == "Missing 'html' field"


def test_range_checks(spark):
    df = spark.createDataFrame([("https://a.org", 2.0, 30000), ("nope", 2.0, 30000),
                                ("https://a.org", 31.0, None), ("https://a.org", None, 500)],
                               "url string, wait double, timeout int")
    got = [(r.valid, r.reason) for r in RQ.range_checks(df).collect()]
    assert got == [(True, None), (False, "invalid url"), (False, "wait out of range"),
                   (False, "timeout out of range")]


def test_engine_and_format_switch(spark):
    pages = pages_df(spark, ["<article><h1>T</h1><p>x <img src=a.png width=10></p></article>"])
    assert [r.e for r in spark.createDataFrame([("ai",), ("x",), (None,)], "e string")
            .select(PS.normalise_engine("e").alias("e")).collect()] == ["ai", "standard", "standard"]
    html = PS.process(pages, "html", engine="ai").first()
    assert html.format == "html" and html.engine == "ai" and html.content.startswith("<article>")
    md = PS.process(pages, "markdown", engine="bogus").first()
    assert md.engine == "standard" and md.content == "# T\n\nx"
    ai = PS.process(pages, "markdown", engine="ai", images=True).first()
    assert "![" not in ai.content               # the ai path always drops images
    try:
        PS.process(pages, "xml")
        raise AssertionError("bad format accepted")
    except ValueError as e:
        assert "Invalid format" in str(e)


def test_charsets(spark, tmp_path):
    cases = {"mark8": (b"\xef\xbb\xbf<p>\xc3\xa9", None, "<p>é"), "mark16": ("﻿<p>é€😀".encode("utf-16-le"), None, "<p>é€😀"),
             "be": (b"\xfe\xff" + "<p>é€".encode("utf-16-be"), None, "<p>é€"), "header": (b"<meta charset=utf-8>\x93\xe9\x94\x80", "text/html; charset=windows-1252", '<meta charset=utf-8>“é”€'),
             "meta": (b"<meta http-equiv=Content-Type content='text/html; charset=ISO-8859-1'>\xe9\x80", None, "<meta http-equiv=Content-Type content='text/html; charset=ISO-8859-1'>é€"),
             "none": ("<p>日本".encode(), None, "<p>日本"), "western": (b"<p>\xe9", None, "<p>é"), "bad8": (b"<meta charset=utf-8>\xff", None, "<meta charset=utf-8>�"),
             "unknown": ("<meta charset=klingon>é".encode(), "text/html; charset=x", "<meta charset=klingon>é"), "odd": ("﻿ab".encode("utf-16-le") + b"c", None, "ab"),
             "empty": (b"", None, "")}
    df = spark.createDataFrame([(k, bytearray(b), h) for k, (b, h, _) in cases.items()], "k string, content binary, header string")
    got = df.select("k", SP.decode_html("content", SP.charset_of("content", F.col("header"))).alias("t")).collect()
    assert {r["k"]: r["t"] for r in got} == {k: t for k, (_, _, t) in cases.items()}
    (tmp_path / "a.html").write_bytes("﻿<p>ü".encode("utf-16-le"))
    assert [r["html"] for r in SP.read_html_files(spark, str(tmp_path)).collect()] == ["<p>ü"]
