from pyspark.sql import functions as F

from pagelens.operators import profiles as PR
from tests.conftest import pages_df


def results(spark, htmls, profile, options=None, urls=None, prefilter=True):
    res, sugg = PR.extract(pages_df(spark, htmls, urls), profile, options, prefilter=prefilter, materialize=False)
    return res.orderBy("page_id", "rank").collect(), sugg.orderBy("page_id", "rank").collect()


def block(href, title, snippet=""):
    return f'<div class="MjjYud"><a href="{href}"><h3>{title}</h3></a>{snippet}</div>'


def test_web_search_edge_rules(spark):
    html = ('<div id="rso">'
            + block("/url?q=https%3A%2F%2Fa.org%2Fx%2By+z&amp;sa=U", "A", '<div data-sncf="1"></div>'
                    '<div class="VwiC3b">late</div>')
            + block("/url?q=%zz", "Bad")
            + block("https://b.org/", "B", '<div class="VwiC3b"> b <script>s()</script> text </div>')
            + block("https://b.org/", "B again")
            + block("/relative", "Rel")
            + '</div><div class="ouy7Mc"><a> s1 </a><a></a></div>')
    res, sugg = results(spark, [html], "google_web")
    assert [(r.url, r.title, r.content) for r in res] == [
        ("https://a.org/x+y+z", "A", ""), ("https://b.org/", "B", "b text")]
    assert [s.text for s in sugg] == ["s1"]


def test_web_search_fallback_containers(spark):
    html = block("https://c.org/", "C") + '<div class="oIk2Cb"><a>first</a></div><div class="ouy7Mc"><a>no</a></div>'
    res, sugg = results(spark, [html], "google_web")
    assert [r.url for r in res] == ["https://c.org/"]
    assert [s.text for s in sugg] == ["first"]


def test_news_decode_and_failures(spark):
    import base64
    payload = b"\x08\x13" + "https://n.org/a?é=1".encode() + b"\xd2\x01\xff"
    b64 = base64.urlsafe_b64encode(payload).decode().rstrip("=")
    nolink = base64.urlsafe_b64encode(b"\x01\x02abc").decode().rstrip("=")
    html = (f'<div><div><a href="./read/{b64}?x=1">A long enough title</a><time>1h</time></div></div>'
            f'<div><a href="./read/{nolink}">Another long title</a><span data-n-tid="1">Src</span></div>'
            f'<div><a href="./read/{b64}">Duplicate of the first</a></div>'
            f'<div><a href="./read/xx">short</a></div>')
    res, _ = results(spark, [html], "google_news")
    assert [(r.url, r.content) for r in res] == [
        ("https://n.org/a?é=1", "1h"),
        (f"https://news.google.com/read/{nolink}", "Src")]


def test_debenture_fields(spark):
    html = ('<ul><li class="list-item__container"><h2 class="list-item__title"><a href="/d/X1">X1 Lei</a></h2>'
            '<dl><dt>Emissor</dt><dd>ACME</dd></dl><dl><dt>DURATION</dt><dd>-</dd></dl>'
            '<dl><dt>Unknown</dt><dd>z</dd></dl><dl><dt>setor</dt><dd>a</dd></dl><dl><dt>Setor</dt><dd>b</dd></dl>'
            '</li><li class="list-item__container"><h2 class="list-item__title"><a>NOHREF</a></h2></li></ul>')
    res, _ = results(spark, [html], "anbima_debentures")
    assert len(res) == 1
    assert res[0].title == "X1" and res[0].url == "/d/X1"
    assert res[0].fields == {"emissor": "ACME", "duration": "", "setor": "b"}


def test_base_profile(spark):
    html = ('<ul><li class="item"><a href="/a">A</a></li><li class="item"><a>https://t.org</a></li>'
            '<li class="item"><a href="/c"> </a></li><li class="item"><a href="/a">A</a></li></ul>'
            '<p class="s">one</p><p class="s"> </p>')
    opts = {"results_selector": "li.item", "url_selector": "a", "title_selector": "a", "suggestion_selector": "p.s"}
    res, sugg = results(spark, [html], "base", opts)
    assert [(r.url, r.title) for r in res] == [("/a", "A"), ("https://t.org", "https://t.org"), ("/a", "A")]
    assert [s.text for s in sugg] == ["one"]
    res, sugg = results(spark, [html], "base", {"results_selector": "li"})
    assert res == [] and sugg == []


def test_prefilter_is_equivalent(spark, tmp_path):
    from pagelens.plans import fixtures as FX
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    pages = FX.search_pages(docs).unionByName(
        spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select(
            (F.col("page_id") + 100000).alias("page_id"), "url", "html"))
    on, _ = PR.extract(pages, "google_web", prefilter=True, materialize=False)
    off, _ = PR.extract(pages, "google_web", prefilter=False, materialize=False)
    assert sorted(map(tuple, on.collect())) == sorted(map(tuple, off.collect()))


def test_unknown_profile():
    assert PR.get_profile("nope") is None
    assert PR.list_profiles() == ["google_web", "google_news", "base", "anbima_debentures"]


def test_news_link_decoding_cases(spark):
    import base64
    from pagelens.operators.profiles import decode_news_link

    def link(payload):
        return "https://news.google.com/read/" + base64.urlsafe_b64encode(payload).decode().rstrip("=") + "?hl=en"
    # bytes chosen so the base64url text contains '-' and '_'
    dash = b"\xfb\xff\xbf" + b"https://x.org/~a?b=\xc3\xa9" + b"\xd2tail"
    no_sep = b"\x01" + b"https://y.org/path"
    bad_utf8 = b"\x02" + b"https://z.org/\xff\xfe" + b"\xd2"
    no_http = b"\x03nothing here"
    cases = [link(dash), link(no_sep), link(bad_utf8), link(no_http), "https://news.google.com/other/x"]
    assert "-" in cases[0] or "_" in cases[0]
    df = spark.createDataFrame([(c,) for c in cases], "l string")
    got = [r.u for r in df.select(decode_news_link(F.col("l")).alias("u")).collect()]
    assert got == ["https://x.org/~a?b=é", "https://y.org/path", "https://z.org/��",
                   cases[3], cases[4]]


def test_bucketed_layout(spark):
    from pagelens.plans import fixtures as FX
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    pages = FX.search_pages(docs)
    plain, _ = PR.extract(pages, "google_web")
    spark.conf.set("spark.pagelens.nodeLayout", "bucketed")
    try:
        bucketed, _ = PR.extract(pages, "google_web")
        assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, bucketed.collect()))
    finally:
        spark.conf.unset("spark.pagelens.nodeLayout")


def test_a_callers_profile(spark):
    from pagelens.operators import dom

    def headings(nodes, options):
        rows = dom.select(nodes, (options or {}).get("selector", "h1")).select("page_id", "node_id", "open_pos", "close_pos").withColumn("tid", F.col("node_id"))
        text = dom.text_trim(nodes, rows)
        return text.selectExpr("page_id", "1 AS rank", "'' AS url", "text AS title", "CAST(NULL AS string) AS content",
                               "CAST(NULL AS map<string,string>) AS fields", "CAST(NULL AS string) AS thumbnail"), PR._empty_suggestions(nodes.sparkSession)
    PR.register_profile(PR.Profile("headings", ["/blocked"], 1.0, extract=headings))
    try:
        assert PR.list_profiles()[-1] == "headings"
        pages = pages_df(spark, ["<h1>a</h1><h2>b</h2>", "<h1>c</h1>"])
        assert sorted(r.title for r in PR.extract(pages, "headings")[0].collect()) == ["a", "c"]
        assert [r.title for r in PR.extract(pages, "headings", {"selector": "h2"})[0].collect()] == ["b"]
    finally:
        del PR.PROFILES["headings"]
