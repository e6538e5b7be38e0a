"""Nothing of a page, link or history is lost without a word."""
import base64
import os

import pytest
from conftest import pages_df
from pyspark.sql import functions as F

from pagelens import session
from pagelens.functions import text as TX
from pagelens.operators import content as CT
from pagelens.operators import probes as PB
from pagelens.operators import process as PS
from pagelens.operators import profiles as PR
from pagelens.operators import report as RP
from pagelens.sources import pages as SP
from pagelens.sources import sinks
from pagelens.streaming import jobs as SJ

WORDS = "plain words of an ordinary article that must stay"


def rendered(spark, *htmls, article=False):
    pages = pages_df(spark, list(htmls))
    got = CT.render(pages, PS.content_nodes_table(pages), "markdown", article).collect()
    return [r["content"] for r in sorted(got, key=lambda r: r["page_id"])]


@pytest.mark.parametrize("html", [
    f'<body class="has-cookie-banner"><p>{WORDS}</p></body>',
    f'<body><form id="aspnetForm"><p>{WORDS}</p></form></body>',
    f'<body><div class="page social-links-on"><p>{WORDS}</p></div></body>',
    f'<body><nav><p>{WORDS}</p></nav></body>',
    f'<div class="share"><article class="widget"><p>{WORDS}</p></article></div>',
    f'<body><p class="shareholder">{WORDS}</p><div class="sharepoint">x</div></body>',
])
def test_removal_rules_never_empty_a_page(spark, html):
    assert WORDS in rendered(spark, html)[0]


def test_removal_rules_still_remove(spark):
    page = (f'<body><nav>menu one</nav><p>{WORDS}</p><div class="share-box">share me</div><div hidden>secret</div><p style="display: none">gone</p>'
            '<aside>side</aside><div class="social-links">like</div><img src="/s.png" width="10" alt="small"><img src="/b.png" width="300" alt="big"></body>')
    out = rendered(spark, page)[0]
    assert WORDS in out
    for gone in ("menu one", "share me", "secret", "gone", "side", "like", "small"):
        assert gone not in out.replace(WORDS, ""), gone


def test_hidden_text_never_comes_back(spark):
    assert rendered(spark, f"<body><div hidden>{WORDS}</div></body>")[0] == ""


def test_each_rule_changes_the_result(spark, monkeypatch):
    page = f'<body><p>{WORDS}</p><nav>a nav</nav><div hidden>hid</div><div class="promo-box">buy</div></body>'
    before = rendered(spark, page)
    assert before[0] == WORDS
    for rule, text in (("exact", "a nav"), ("partial", "buy")):
        rows = [r for r in CT.default_rules() if r[0] != rule]
        with monkeypatch.context() as m:
            m.setattr(CT, "default_rules", lambda: rows)  # noqa: B023
            assert text in rendered(spark, page)[0]
    monkeypatch.setattr(CT, "never_content", lambda: F.lit(False))
    assert "hid" in rendered(spark, page)[0]


def test_a_callers_rules(spark):
    page = (f'<body><p>{WORDS}</p><div class="Teaser big">t1</div><div id="x-teasers-2">t2</div><div id="myteaser">t3</div><div role="Teaser">t4</div>'
            '<teaser>t5</teaser><article class="teaser">t6</article><div class="share">s</div></body>')
    nodes = PS.content_nodes_table(pages_df(spark, [page]))

    def kept(rows):
        rules = spark.createDataFrame(rows, CT.RULES)
        texts = CT.content_nodes(nodes.filter("tag IS NULL OR tag <> 'article'"), rules=rules).filter("kind = 'text'").collect()
        return {r["text"] for r in texts if r["text"] != WORDS}
    every = {"t1", "t2", "t3", "t4", "t5", "t6", "s"}
    assert kept([("exact", "class", "teaser", None)]) == every - {"t1"}
    assert kept([("exact", "role", "teaser", None), ("exact", "tag", "teaser", None)]) == every - {"t4", "t5"}
    assert kept([("partial", "word", "teaser", None)]) == every - {"t1", "t2"}
    # a thousand more rules change neither rows nor plan
    more = [("partial", "word", f"none{i}", None) for i in range(1000)]
    assert kept([("partial", "word", "teaser", None), *more]) == every - {"t1", "t2"}


def test_dot_segments(spark):
    base = "https://h.org/a/b/c.html?q=1"
    cases = {"../../../../../x": "https://h.org/x", "x?u=/./y": "https://h.org/a/b/x?u=/./y", "../..": "https://h.org/", ".": "https://h.org/a/b/", "..": "https://h.org/a/",
             "./x/../y/./z": "https://h.org/a/b/y/z", "/a/./b/../../c/": "https://h.org/c/", "x#a/../b": "https://h.org/a/b/x#a/../b",
             "/" + "d/" * 8 + "../" * 7 + "e": "https://h.org/d/e", "mailto:a/../b": "mailto:a/../b", "...": "https://h.org/a/b/..."}
    df = spark.createDataFrame([(k,) for k in cases], "h string")
    assert {r.h: r.u for r in df.select("h", CT.resolve_url(F.col("h"), F.lit(base)).alias("u")).collect()} == cases


def test_escapes_that_are_no_utf8_give_null(spark):
    cases = {"%41": "A", "%FF": None, "%C3%28": None, "%C3%A9": "é", "%EF%BF%BD": "�", "%zz": None, "a+b": "a+b", "�": "�", "%EF%BF%BD%FF": None, "%ef%bf%bd": "�"}
    df = spark.createDataFrame([(k,) for k in cases], "s string")
    assert {r.s: r.d for r in df.select("s", TX.decode_uri_component("s").alias("d")).collect()} == cases


def test_news_links_never_abort(spark):
    def payload(url):
        return base64.urlsafe_b64encode(b"\x08\x13\x22" + url.encode() + b"\xd2\x01").decode().rstrip("=")
    link = "https://news.google.com/read/"
    cases = {link + p: link + p for p in ("A", "AAAAA", "AA=A", "", "!!!")}
    cases |= {link + payload("https://a.org/x") + "?hl=en": "https://a.org/x", link + payload("https://a.org/read/b"): "https://a.org/read/b",
              link + payload("https://b.org/y") + "=": "https://b.org/y"}
    df = spark.createDataFrame([(k,) for k in cases], "s string")
    got = {r.s: r.d for r in df.select("s", PR.decode_news_link(F.col("s")).alias("d")).collect()}
    assert got == cases
    twice = link + payload("https://c.org/z") + "/read/AAAA"
    first = spark.createDataFrame([(twice,)], "s string").select(PR.decode_news_link(F.col("s")).alias("d")).first().d
    assert first == "https://c.org/z"


def test_prefilter_lets_encoded_attributes_through(spark):
    web = '<div id="rso"><div class="&#77;jjYud"><a href="https://e.org/x"><h3>A title</h3></a></div></div>'
    news = '<article><a href=".&#47;read/abc">a headline of some length</a></article><article><a href="&period;/read/abcd">a second headline here</a></article>'
    for html, profile in ((web, "google_web"), (news, "google_news")):
        on, _ = PR.extract(pages_df(spark, [html]), profile, prefilter=True)
        off, _ = PR.extract(pages_df(spark, [html]), profile, prefilter=False)
        assert on.count() == off.count() > 0


def test_pages_without_results_have_a_row(spark):
    pages = pages_df(spark, ["<p>x</p>", "<p>y</p>", "<p>z</p>"])
    res = spark.createDataFrame([(0, 1, "https://e.org", "T", "C", None, None)], "page_id long, rank int, url string, title string, content string, fields map<string,string>, thumbnail string")
    sug = spark.createDataFrame([(0, 1, "more")], "page_id long, rank int, text string")
    got = {r.page_id: r.text for r in RP.listing(res, sug, "base", pages, pages.where("page_id = 2")).collect()}
    assert got == {0: "Found 1 results from base profile:\n\n1. T\n   URL: https://e.org\n   C\n\nRelated searches:\n  - more", 1: "Found 0 results from base profile:\n",
                   2: "CAPTCHA detected at https://example.org/p/2. The target site blocked the request."}
    tests = spark.createDataFrame([(0, "passed")], "page_id long, status string")
    score = {r.page_id: (r.score, r.percent) for r in PB.scorecard(tests, pages).collect()}
    assert score == {0: ("1/1 passed", "100%"), 1: ("0/0 passed", "0%"), 2: ("0/0 passed", "0%")}


def test_envelopes(spark):
    import json
    pages = pages_df(spark, ["<p>x</p>"] * 4).withColumn("final_url", F.col("url"))
    res = spark.createDataFrame([(0, 1, "https://e.org/é", 'T "q"', "C\n", None, None), (1, 1, "u", "t", None, {"k": "v"}, "pic"), (3, 1, "u", "t", "c", None, None)],
                                "page_id long, rank int, url string, title string, content string, fields map<string,string>, thumbnail string")
    sug = spark.createDataFrame([(0, 2, "b"), (0, 1, "a")], "page_id long, rank int, text string")
    errors = spark.createDataFrame([(3, "it broke")], "page_id long, message string")
    got = {r.page_id: json.loads(r.envelope) for r in RP.extract_envelope(pages, res, sug, errors=errors).collect()}
    assert got == {
        0: {"results": [{"url": "https://e.org/é", "title": 'T "q"', "content": "C\n"}], "suggestions": ["a", "b"], "captcha": False, "error": None},
        1: {"results": [{"url": "u", "title": "t", "content": {"k": "v"}, "thumbnail": "pic"}], "suggestions": [], "captcha": False, "error": None},
        2: {"results": [], "suggestions": [], "captcha": False, "error": None},
        3: {"results": [], "suggestions": [], "captcha": False, "error": "it broke"}}


def test_scrapes_of_one_url_are_pages_of_their_own(spark, tmp_path):
    import json
    rows = [{"html": h, "status": 200, "url": "https://e.org"} for h in ("v0", "v1", "v0")]
    (tmp_path / "r.json").write_text("\n".join(map(json.dumps, rows)))
    got = SP.read_scrape_replies(spark, str(tmp_path / "r.json"))
    assert sorted(r.html for r in got.collect()) == ["v0", "v1"] and got.select("page_id").distinct().count() == 2
    assert SP.check_page_ids(got).count() == 0
    assert [r.page_id for r in got.orderBy("html").collect()] == [r.page_id for r in SP.read_scrape_replies(spark, str(tmp_path)).orderBy("html").collect()]


def test_content_sinks_keep_types_and_text(spark, tmp_path):
    pages = pages_df(spark, [f"<title>t</title><body><p>{WORDS}</p><p>two</p></body>"])
    for fmt in ("json", "markdown", "html"):
        sinks.write_content(PS.process(pages, fmt), str(tmp_path / fmt))
    doc = spark.read.json(str(tmp_path / "json" / "json"))
    assert dict(doc.dtypes)["wordCount"] == "bigint" and doc.first()["title"] == "t"
    assert spark.read.option("lineSep", "\u001e\n").text(str(tmp_path / "markdown" / "markdown")).first()["value"] == f"{WORDS}\n\ntwo"
    assert "<p>two</p>" in spark.read.text(str(tmp_path / "html" / "html"), wholetext=True).first()["value"]


def test_history_survives_a_half_written_version(spark, tmp_path):
    schema = "id long, url string, mode string, ts long"
    table = str(tmp_path / "h")
    assert SJ.read_history(spark, table, schema).count() == 0
    spark.createDataFrame([(1, "u", "m", 1)], schema).write.parquet(f"{table}/v=3")
    spark.createDataFrame([(2, "u", "m", 2)], schema).write.parquet(f"{table}/v=4")
    os.remove(f"{table}/v=4/_SUCCESS")
    assert SJ.read_history(spark, table, spark.createDataFrame([], schema).schema).first()["id"] == 1
    assert SJ.read_history(spark, table, spark.createDataFrame([], schema).schema, before=3).count() == 0


def test_intermediate_tables_go_with_their_scope(spark):
    root = session.checkpoint_dir(spark).rstrip("/").removeprefix("file:")
    held = lambda: set(os.listdir(f"{root}/tables")) if os.path.isdir(f"{root}/tables") else set()
    before = held()
    pages = pages_df(spark, [f"<body><p>{WORDS}</p></body>"])
    with session.scratch(spark):
        assert CT.render(pages, PS.content_nodes_table(pages)).count() == 1
        assert held() - before
    assert held() == before


@pytest.mark.parametrize("html, want", [
    ("<pre>def f():\n    return 1\n\n\n\nx</pre>", "```\ndef f():\n    return 1\n\n\n\nx\n```"),
    ("<ul><li>a<ul><li>b<ol><li>c<li>d</ol></ul><li>e</ul>", "- a\n  - b\n    1. c\n    2. d\n- e"),
    ("<blockquote>q</blockquote><p>after</p>", "> q\n\nafter"),
    ("<p>x</p><blockquote><p>a</p><blockquote><p>b</p></blockquote><p>c</p></blockquote>", "x\n\n> a\n>\n> > b\n>\n> c"),
    ("<table><tr><th>h|1<th>k</tr><tr><td>a<td>b|c</tr></table>", "| h\\|1 | k |\n| --- | --- |\n| a | b\\|c |"),
    ('<p>see <a href="x">the <b>link</b></a> and <code>c|d</code></p>', "see [the **link**](https://example.org/p/x) and `c|d`"),
])
def test_markdown_structure(spark, html, want):
    assert rendered(spark, f"<body>{html}</body>")[0] == want


def test_micro_batches_leave_no_tables(spark, tmp_path):
    from pagelens.plans import fixtures as FX
    root = session.checkpoint_dir(spark).rstrip("/").removeprefix("file:")
    held = lambda: set(os.listdir(f"{root}/tables")) if os.path.isdir(f"{root}/tables") else set()
    pages = FX.search_pages(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")).withColumns({"status": F.lit(200), "final_url": F.col("url")})
    pages.repartition(3).write.parquet(str(tmp_path / "in"))
    before = held()
    stream = SJ.read_page_stream(spark, str(tmp_path / "in"), max_files=1)
    SJ.stream_extract(stream, "google_web", str(tmp_path / "out"), str(tmp_path / "ckpt")).awaitTermination()
    assert held() == before
    want, _ = PR.extract(pages, "google_web")
    assert spark.read.parquet(str(tmp_path / "out" / "results")).count() == want.count() > 0


def test_sessions_of_one_user_match_the_window(spark):
    ev = spark.read.parquet("/root/testdata/sf0.01/events.parquet").withColumn("user_id", F.lit(1))
    for gap in ("1 minute", "5 minutes", "3 hours"):
        a = SJ.sessions(ev, "user_id", gap)
        b = SJ.outcome_rates(ev, "session", gap, by="user_id", delay=None)
        assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
