"""Steps whose work has to stay small on large tables."""
import os
import random
import tempfile
import time

from pyspark.sql import functions as F

from pagelens.functions.text import JS_WORD_RE, JS_WS, JS_WS_RUN_RE, js_collapse_ws, js_trim, word_count
from pagelens.operators import content as CT, dom, probes as PB, process as PS
from pagelens.operators import nodes as N, profiles as PR
from pagelens.operators.nodes import node_table
from pagelens.plans import fixtures as FX
from pagelens.streaming import jobs as SJ


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_history_state_runs_once_a_batch(spark):
    root = tempfile.mkdtemp(prefix="pagelens-stream-")
    rows = [[(1, "a", "2024-01-01 00:00:00"), (2, "b", "2024-01-02 00:00:00")], [(3, "b", None), (4, "a", "2024-01-03 00:00:00"), (None, "c", "2024-01-03 00:00:00")]]
    make = lambda part: spark.createDataFrame(part, "id long, url string, t string").select("id", "url", F.lit("render").alias("mode"), F.col("t").cast("timestamp").alias("ts"))
    for part in rows:
        make(part).coalesce(1).write.mode("append").parquet(os.path.join(root, "h"))
    s = spark.readStream.schema(make(rows[0]).schema).option("maxFilesPerTrigger", 1).parquet(os.path.join(root, "h"))
    q = SJ.stream_history(s, os.path.join(root, "table"), os.path.join(root, "ckpt"))
    q.awaitTermination(300)
    assert sum(p["numInputRows"] for p in q.recentProgress) == 5
    got = SJ.read_history(spark, os.path.join(root, "table"), make(rows[0]).schema)
    assert sorted((r["url"], r["id"] or 0) for r in got.collect()) == [("a", 4), ("b", 2), ("c", 0)]


def test_tls_fields_in_one_shuffle(spark):
    ip = '{"ip":"10.0.0.1"}'
    pages = [(1, f"<body> {ip}\x1c\n</body>"), (2, f"<body>x<pre> {ip}</pre><pre>{{}}</pre></body>"), (3, f"<body>x<pre> </pre><pre>{ip}</pre></body>"),
             (4, f'<body>x<pre>{{"ip":<b>"10.0.0.2"</b>}}</pre></body>'), (5, ""), (6, None), (7, f"<p>x<pre><pre>{ip}</pre></pre>")]
    nodes = node_table(spark.createDataFrame(pages, "page_id long, html string"), "tls-test", deal=False)
    out = PB.tls_fields(nodes)
    got = {r["page_id"]: (r["ip"], r["error"] is None) for r in out.collect()}
    assert got == {1: ("10.0.0.1", True), 2: ("10.0.0.1", True), 3: (None, False), 4: ("10.0.0.2", True), 5: (None, False), 6: (None, False), 7: ("10.0.0.1", True)}
    assert "Join" not in _plan(out) and "Window" not in _plan(out)
    # repeated ids: a row for each document row
    again = node_table(spark.createDataFrame([pages[0], pages[0], pages[4]], "page_id long, html string"), "tls-twice", deal=False)
    docs = sorted(r["page_id"] for r in again.filter("kind = 'doc'").collect())
    assert sorted(r["page_id"] for r in PB.tls_fields(again).collect()) == docs and docs.count(1) == 2
    # the one aggregate says what the helpers say
    want = {r["page_id"]: r["text"] for r in dom.page_text(nodes).collect()}
    assert {r["page_id"]: r["text"] for r in dom.page_texts(nodes, "pre").collect() if r["text"]} == want


def test_content_is_marked_once(spark):
    pages = spark.createDataFrame([(1, "https://e.org/1", "<body><p>two words<ul><li>three <b>four</b></ul><p> </body>"), (2, "https://e.org/2", None)], "page_id long, url string, html string")
    nodes = PS.content_nodes_table(pages)
    for fmt, render in (("markdown", "markdown"), ("html", "html"), ("json", "html")):
        out = PS.process(pages, fmt, nodes=nodes)
        assert [(r["page_id"], r["word_count"]) for r in out.orderBy("page_id").collect()] == [(1, 4), (2, 0)]
        windows = lambda df: _plan(df).count("Window [")
        assert windows(out) <= windows(CT.render(pages, nodes, render)) + windows(CT.metadata(pages, nodes)) + 1
    # a page that stands twice in the page table: its words count once
    twice = pages.unionByName(pages.filter("page_id = 1"))
    assert {(r["page_id"], r["word_count"]) for r in PS.process(twice, nodes=nodes).collect()} == {(1, 4), (2, 0)}


def test_texts_are_trimmed_and_counted(spark):
    d = spark.createDataFrame([("\ufeff a  b\u3000", "a  b", 2), ("a \x85", "a \x85", 2), ("\u2028", "", 0), ("", "", 0), (None, None, None)], "s string, t string, n int")
    for r in d.select("*", js_trim("s").alias("trimmed"), word_count("s").alias("words"), PB.py_strip("s").alias("py")).collect():
        assert (r["trimmed"], r["words"]) == (r["t"], r["n"]) and (r["s"] is None or r["py"] == r["s"].strip())
    # no regular expression over whole texts, no comparison by a lambda
    assert "regexp_replace" not in _plan(d.select(js_trim("s"))) and "lambda" not in _plan(d.select(word_count("s")))
    nodes = node_table(spark.createDataFrame([(1, "<table><tr><td>x<td class=passed>y</table>")], "page_id long, html string"), "rows-test")
    assert "array_sort(" not in _plan(dom.table_rows(nodes))
    assert [(r["name"], r["status"], r["value"]) for r in PB.test_rows(nodes).collect()] == [("x", "passed", "y")]


def _card(inner, title="<h2 class='x list-item__title'><a href=/d/1>T1 x</a></h2>"):
    return f"<li class='list-item__container y'>{title}{inner}</li>"


CARD_PAGES = [
    "<ul>" + _card("<dl><dt>Emissor<dd> A &amp; B </dl><dl><dt>setor</dt><dd>-</dd></dl><dl><dd>no label</dl>") + _card("", "<h2 class=list-item__title><a>none</a></h2>") + "</ul>",
    # the last of a label's lists wins; lists in lists, texts in cells and a script
    "<ul>" + _card("<dl><dt>pu <b>par</b></dt><dd>1</dd></dl><dl><dt>x<dd><dl><dt>PU PAR</dt><dd>2<script>3</script></dd></dl></dl>") + "</ul>",
    # cards in cards, the link outside a heading, two links, a heading around the cards
    "<ul>" + _card("<ul>" + _card("<dl><dt>duration</dt><dd>5</dd></dl>", "<a href=/no>N</a><h2 class=list-item__title></h2>") + "</ul>") + "</ul>",
    "<h2 class=list-item__title><a href=/o>O</a><ul>" + _card("", "<a href=/in>In</a>") + _card("", "") + "</ul></h2>" + _card("", "<a href=/out>Out</a>"),
    "<ul>" + _card("", "<h2 class=list-item__title><h2 class=list-item__title><i>i</i></h2><a href=/1>\ufeff K1\xa0z</a><a href=/2>2</a></h2>") + "</ul>",
    # broken: nothing ends, pairs cross, end tags without a start
    "<div></p><ul><li class=list-item__container><h2 class=list-item__title><a href=/b>B 1<dl><dt>Emissor<dd>e<li class=list-item__container><h2 class=list-item__title><a href=/c>C",
    "<ul><li class=list-item__container><h2 class=list-item__title><b><a href=/q>Q</b></a></h2></dl><dl><dt>Emissor</dt><dd>v</dl></li></ul>",
    "<!-- list-item__container --><title><li class=list-item__container></title>", "", None,
]


def test_cards_of_a_page_index_are_those_of_the_node_table(spark):
    pages = spark.createDataFrame([*enumerate(CARD_PAGES), (None, CARD_PAGES[0])], "page_id long, html string")
    index, nodes = PR.profile_nodes(pages, PR.get_profile("anbima_debentures"), prefilter=False), node_table(pages, "card-pages")
    rows = lambda df: sorted(map(str, df.collect()))
    assert "node_id" not in index.columns and index.count() == len(CARD_PAGES)
    assert rows(PR.debenture_table(index)) == rows(PR.debenture_table(nodes))
    assert rows(PR.extract(pages, "anbima_debentures")[0]) == rows(PR.extract_nodes(nodes, "anbima_debentures")[0])
    got = {(r["page_id"], r["rank"]): (r["url"], r["emissor"], r["setor"], r["duration"], r["pu_par"]) for r in PR.debenture_table(index).collect()}
    assert got[0, 1] == ("/d/1", "A & B", "", None, None) and (0, 2) not in got and got[1, 1][4] == "23" and got[2, 1][3] == "5" and (2, 2) not in got
    assert got[3, 1][0] == "/in" and (3, 2) not in got and got[4, 1][0] == "/1" and got[5, 1][:2] == ("/b", "e")
    # pages whose ids repeat are built as before
    twice = pages.unionByName(pages.filter("page_id = 0"))
    assert "node_id" in PR.profile_nodes(twice, PR.get_profile("anbima_debentures")).columns


def test_cards_need_one_shuffle_of_the_orders(spark):
    orders = spark.range(100).selectExpr("id AS o_orderkey", "id % 7 AS o_custkey", "id * 1.5D AS o_totalprice", "timestamp'2024-01-02 00:00:00' AS o_orderdate",
                                         "IF(id % 3 = 0, 'F', 'O') AS o_orderstatus", "'1-URGENT' AS o_orderpriority")
    out = PR.debenture_table(PR.profile_nodes(FX.card_pages(orders), PR.get_profile("anbima_debentures")))
    assert out.count() == sum(k % 17 != 5 for k in range(100))
    # the orders' columns are dealt out by page, and neither html nor nodes are
    plan = _plan(out)
    assert plan.count("Exchange") == 1 and "o_custkey" in plan.split("Exchange")[1] and "Window" not in plan and "Sort" not in plan


def test_one_pass_pairs_tags_as_the_rules_do(spark):
    rnd = random.Random(7)
    tags = [f"<{e}{t}>" for t in ("div", "p", "b", "li", "ul", "table", "tr", "td", "a", "tbody", "dl", "dt", "dd", "h2", "select", "option", "body") for e in ("", "/")] + ["x", "<br>", "<hr>", "</br>"]
    pages = ["".join(rnd.choices(rnd.sample(tags, rnd.randint(4, 14)), k=rnd.randint(1, 40))) for _ in range(400)]
    tokens = N.to_tags(spark.createDataFrame(list(enumerate(pages)), "page_id long, html string")).select("page_id", "seq", "kind", "tag").cache()
    want = {(r["page_id"], r["node_id"]): (r["parent_id"], r["close_pos"]) for r in spark.sql(N.structure_sql("{t}"), t=tokens).collect()}
    got = {}
    for i, html in enumerate(pages):
        rows = N.page_tags(html)
        around, stops = N.pair_by_rules(rows)
        got |= {(i, s): (None, 2 * stops[0] + 4) if not s else (around[s], 2 * stops[s] if kind == "open" else 2 * s + 1) for s, kind, *_ in rows if kind != "close"}
    assert got == want


def test_plain_pages_split_as_others_do(monkeypatch):
    rnd = random.Random(3)
    parts = ["<p>", "</p>", "<a href='x>y'>", '<a href="1" b=\'2\'>', "<br/>", "</br >", "a < b", "a > b", "&lt;x&amp", "<", ">", "<>", "</>", "< p>", "<p", '<i t="', "<i t=x\">", "<P Class=A>", "é\n", "</p x>", "<q/r=1>", "<x<y>", " ",
             "<!-- c > d -->", "<!-->", "<!--", "-->", "<!DOCTYPE html>", "<?x y?>", "<!", "<title>", "</title>", "<Title a='b>c'>x &amp; <b></TITLE >", "<script>if (a<b) '&amp;'</script>", "</script", "<style/>", "<textarea>", "</textarea\n>", "<titles>"]
    pages = ["".join(rnd.choices(parts, k=rnd.randint(0, 9))) for _ in range(30_000)] + ["<p " + "k=v " * 100 + ">x</p>"]
    fast = [[r for r in N.split_tags(h)] for h in pages]
    assert sum(N._plain_pieces(h) is not None for h in pages) > 2_000
    monkeypatch.setattr(N, "_plain_pieces", lambda html: None)
    assert [[(k, t, a and tuple(a), x) for k, t, a, x in r] for r in fast] == [[(k, t, a and tuple(a), x) for k, t, a, x in N.split_tags(h)] for h in pages]


def test_card_fields_need_one_shuffle_too(spark):
    orders = spark.createDataFrame([(1, 3, 10.5, "O", "2-HIGH"), (2, 4, 7.25, "F", None), (None, 5, 1.0, "O", "x"), (5, 6, 2.0, "O", "x"), (41, 7, None, "O", "y"), (41, 9, 3.0, "O", "z")],
                                   "o_orderkey long, o_custkey long, o_totalprice double, o_orderstatus string, o_orderpriority string").withColumn("o_orderdate", F.lit("2024-03-09").cast("timestamp"))
    out, _ = PR.extract(FX.card_pages(orders), "anbima_debentures")
    plan = _plan(out)
    assert plan.count("Exchange") == 1 and "Window" not in plan and "MapInArrow" in plan
    got = {(r["page_id"], r["rank"]): (r["url"], r["title"], r["fields"]) for r in out.collect()}
    # a card with a null column is no text; an order key may repeat
    want = {"emissor": "Cliente 3", "remuneracao": "1050", "vencimento": "09/03/2024", "duration": "3", "setor": "2-HIGH", "pu_par": "3"}
    assert got == {(0, 1): ("/debentures/DEB1", "DEB1", want),
                   (2, 1): ("/debentures/DEB41", "DEB41", {**want, "emissor": "Cliente 9", "remuneracao": "300", "duration": "9", "setor": "z", "pu_par": "9"})}


def test_unended_tags_are_split_in_linear_time():
    t = time.perf_counter()
    for part in ("<a ", "<!--", "<script>", "<title></titles>", "<!-->", "<script </script>", "<style>x</style", "a < b >", "<p '"):
        for end in ("", ">", "-->", "</script>", "</title x>"):
            rows = N.page_tags(part * 40_000 + end)
            assert "parse_error" not in rows[0][3]
    assert time.perf_counter() - t < 60


def test_visible_characters_are_told_first(spark):
    # every character up to U+FFFF, alone and between words
    chars = [chr(i) for i in range(1, 0x10000) if not 0xD800 <= i < 0xE000] + ["\U0001f600"]
    rows = spark.createDataFrame([(c, f"a{c}{c} b") for c in chars], "c string, s string").select("c", js_collapse_ws("s").alias("t"), word_count("s").alias("n")).collect()
    assert len(rows) == len(chars)
    assert all((r["t"], r["n"]) == (("a b", 2) if r["c"] in JS_WS else (f"a{r['c']}{r['c']} b", 2)) for r in rows)
    assert sorted(r["c"] for r in spark.createDataFrame([(c,) for c in chars], "c string").filter(F.col("c").rlike(f"^{JS_WS_RUN_RE}$") | ~F.col("c").rlike(JS_WORD_RE)).collect()) == sorted(JS_WS)
    assert JS_WS_RUN_RE.startswith("[[^!-~]&&") and JS_WORD_RE.startswith("[!-~[^")
