"""The split, and the tree that Spark builds of it."""
import time

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagelens.operators import dom
from pagelens.operators import nodes as N


def trees(spark, htmls, build=N.build_tree):
    """Each page as nested text: tag(children) and texts."""
    df = spark.createDataFrame(list(enumerate(htmls)), "page_id long, html string")
    pages = {i: [] for i in range(len(htmls))}
    for r in build(N.to_tags(df)).collect():
        pages[r["page_id"]].append(r)
    return [tree(rows) for _, rows in sorted(pages.items())]


def tree(rows):
    below = {}
    for r in sorted(rows, key=lambda r: r["open_pos"]):
        below.setdefault(r["parent_id"], []).append(r)

    def show(i):
        return " ".join(r["text"] if r["kind"] == "text" else f"{r['tag']}({show(r['node_id'])})" for r in below.get(i, []))
    return show(0)


CASES = [
    # end tags left out
    ("<p><b>x<br><p>y</p><ul><li>1<li>2</ul>", "p(b(x br())) p(y) ul(li(1) li(2))"),
    ("<table><tr><td>a<td>b<tr><td>c</table>", "table(tr(td(a) td(b)) tr(td(c)))"),
    ("<table><caption>c<thead><tr><th>h<tbody><tr><td>x</table>z", "table(caption(c) thead(tr(th(h))) tbody(tr(td(x)))) z"),
    ("<table><tr><td>A<table><tr><td>B</table>t</td></tr></table>", "table(tr(td(A table(tr(td(B))) t)))"),
    ("<dl><dt>a<dd>b<dt>c<dd>d</dl>", "dl(dt(a) dd(b) dt(c) dd(d))"),
    ("<select><option>a<option>b</select>", "select(option(a) option(b))"),
    ("<ul><li>a<ul><li>x</ul>t</li><li>y</ul>", "ul(li(a ul(li(x)) t) li(y))"),
    ("<html><head><title>t</title><body><p>a<div>b</div>", "html(head(title(t)) body(p(a) div(b)))"),
    # the page breaks off
    ("<html><body><div><table><tr><td>a</td></tr><tr><td>b <i>c", "html(body(div(table(tr(td(a)) tr(td(b  i(c)))))))"),
    # end tags without a start, pairs that cross
    ("</div><p>x</div></p></p>", "p(x)"),
    ("<div><span></div>a</span>", "div(span() a)"),
    ("<b><i>x</b>y</i>z", "b(i(x) y) z"),
    ("<table><tr><td><b>a</td></tr></table></b>c", "table(tr(td(b(a)))) c"),
    # links do not lie in links
    ("<a href=1>x<b>y<a href=2>z</a>", "a(x b(y)) a(z)"),
    ("<table><tr><td><a>u<td><a>v</table>", "table(tr(td(a(u)) td(a(v))))"),
    # text only
    ("<title>a <i>b</i></title>", "title(a <i>b</i>)"), ('<script>var t="</p>";</script>x &amp; y &copy;', 'script(var t="</p>";) x & y ©'),
    ("a<!-- c -->b<br>c", "ab br() c"), ("", ""), ("a < b", "a < b"),
]


def test_trees(spark):
    assert trees(spark, [h for h, _ in CASES]) == [t for _, t in CASES]


def test_the_short_way_and_the_rules_agree(spark):
    nested = [h for h in ("<p><b>x</b></p>y<br>", "<ul><li>a<ul><li>b</li></ul></li><li>c</li></ul>",
                          "<table><tr><td><p>a<div>b</div></p></td><td></td></tr></table>", "<a>x<a>y</a></a><p><ul></ul></p>")]

    def by_rules(tags):
        return tags.sparkSession.sql(N.structure_sql("{t}"), t=tags.select("page_id", "seq", "kind", "tag")).join(
            tags.select("page_id", F.col("seq").alias("node_id"), "text"), ["page_id", "node_id"])
    assert trees(spark, nested) == trees(spark, nested, by_rules)
    df = spark.createDataFrame(list(enumerate(nested)), "page_id long, html string")
    assert spark.sql(N.nested_sql("{t}"), t=N.to_tags(df)).filter("broken").count() == 0


@settings(max_examples=2, deadline=None)
@given(st.lists(st.lists(st.sampled_from(
    ["<div>", "</div>", "<p>", "</p>", "<b>", "</b>", "<br>", "x", " y ", "<li>", "<ul>", "</ul>", "<table>", "<tr>", "<td>", "</td>", "</table>",
     "<a>", "</a>", "<tbody>", "<section>", "</section>", "&amp;"]), max_size=25), min_size=40, max_size=40))
def test_intervals_nest_and_text_is_kept(spark, pages):
    df = spark.createDataFrame([(i, "".join(p)) for i, p in enumerate(pages)], "page_id long, html string")
    got = {}
    for r in N.to_nodes(df).collect():
        got.setdefault(r["page_id"], {})[r["node_id"]] = r
    for i, parts in enumerate(pages):
        rows = got[i]
        for r in rows.values():
            assert r["open_pos"] <= r["close_pos"]
            if r["parent_id"] is not None:
                up = rows[r["parent_id"]]
                assert up["open_pos"] < r["open_pos"] and r["close_pos"] <= up["close_pos"]
                # the parent is the innermost element around the node
                around = [x for x in rows.values() if x["open_pos"] < r["open_pos"] < x["close_pos"]]
                assert max(around, key=lambda x: x["open_pos"])["node_id"] == r["parent_id"]
        texts = [r["text"] for r in sorted(rows.values(), key=lambda r: r["open_pos"]) if r["kind"] == "text"]
        assert "".join(texts) == "".join("&" if p == "&amp;" else "" if p.startswith("<") else p for p in parts)
        opened = sum(p.startswith("<") and not p.startswith("</") for p in parts)
        assert sum(r["kind"] == "el" for r in rows.values()) == opened


def test_thousands_of_unclosed_tags_stay_linear(spark):
    t = time.perf_counter()
    nodes = N.to_nodes(spark.createDataFrame([(1, "<b>" * 8000 + "x"), (2, "<div>" * 8000 + "x")], "page_id long, html string")).cache()
    assert nodes.count() == 16_004
    # every element lies in all that began before
    assert nodes.filter("kind = 'el' AND parent_id <> node_id - 1").count() == 0
    assert dom.select(nodes, "div div").count() == 7999 and dom.select(nodes, "b").count() == 8000
    deepest = dom.select(nodes, "div").orderBy(F.desc("open_pos")).limit(1).withColumn("tid", F.col("node_id"))
    assert dom.text_trim(nodes, deepest).first()["text"] == "x"
    assert time.perf_counter() - t < 120
    nodes.unpersist()
    t = time.perf_counter()
    assert [r[1] for r in N.page_tags("<a " * 40_000)] == ["doc", "text"] and time.perf_counter() - t < 5


def test_broken_split_is_reported(spark, monkeypatch):
    def broken(html):
        yield "open", "p", [], None
        raise RuntimeError("no")
    monkeypatch.setattr(N, "split_tags", broken)
    rows = N.page_tags("<p>x")
    assert rows[0][3]["parse_error"] == "RuntimeError: no" and rows[1][2] == "p"


def test_attribute_rules():
    assert N._attrs(""" A=1 b='x y' c="p>q" d e= f=&lt; g==h =i a=2 j="&amp;" / k=l/m """) == [
        ("a", "1"), ("b", "x y"), ("c", "p>q"), ("d", None), ("e", "f=&lt;".replace("&lt;", "<")), ("g", "=h"), ("=i", None), ("a", "2"), ("j", "&"), ("k", "l/m")]
    rows = N.page_tags('<p title="a&amp;b" class="x  y" title=c>')
    assert rows[1][3] == {"title": "a&b", "class": "x  y"} and rows[1][4] == ["x", "y"]


def test_sql_table_functions(spark):
    N.register_sql(spark)
    spark.createDataFrame([(1, CASES[1][0]), (2, CASES[2][0]), (3, CASES[1][0]), (4, None)], "page_id long, html string").createOrReplaceTempView("some_pages")
    rows = spark.sql("SELECT p.page_id, n.* FROM some_pages p, LATERAL html_nodes(p.html) n").collect()
    got = {i: tree([r for r in rows if r["page_id"] == i]) for i in (1, 2, 3, 4)}
    assert got == {1: CASES[1][1], 2: CASES[2][1], 3: CASES[1][1], 4: ""}
    cells = spark.sql("SELECT p.page_id, count(*) AS n FROM some_pages p, LATERAL html_nodes(p.html) n WHERE n.tag = 'td' GROUP BY 1").collect()
    assert {(r[0], r[1]) for r in cells} == {(1, 3), (2, 1), (3, 3)}


def test_ancestors_by_interval(spark):
    nodes = N.to_nodes(spark.createDataFrame([(1, "<div><p>a</p></div><p>b</p><div><div><b><p>c</p></b></div></div><p>d</p>")], "page_id long, html string")).cache()
    for selector, want in [("div", 3), ("div p", 2), ("div > p", 1), ("div div p", 1), ("section > div > p", 0)]:
        assert dom.select(nodes, selector).count() == want, selector


def test_no_node_table_is_broadcast(spark, tmp_path):
    """Parquet packs a million nodes into a few MB: such a table must not pass through the driver."""
    for html in ("<p>x</p>" * 200, "<p>x" * 200):                     # nested, and by the rules
        pages = spark.range(300).select(F.col("id").alias("page_id"), F.lit(html).alias("html"))
        seen = []
        tags = N.to_tags(pages)
        tags.write.parquet(str(tmp_path / f"{len(html)}"))
        tags = spark.read.schema(tags.schema).parquet(str(tmp_path / f"{len(html)}"))
        nodes = N.build_tree(tags, lambda t: seen.append(t._jdf.queryExecution().executedPlan().toString()) or t)
        seen = seen[1:]          # the first is the list of ids that repeat
        for plan in [*seen, nodes._jdf.queryExecution().executedPlan().toString()]:
            assert "Broadcast" not in plan
        assert nodes.filter("kind = 'el'").count() == 300 * 200 and len(seen) == (1 if "</p>" not in html else 0)


def test_the_splitter_knows_nested_pages(spark):
    htmls = [h for h, _ in CASES] + ["<p></p></p><p>", "<a><b></a></b>", "</b><b>", "<i><br><u>x</u></i>y", "<p><p></p></p>", "<script>x"]
    df = spark.createDataFrame(list(enumerate(htmls)), "page_id long, html string")
    by_sql = {r[0] for r in spark.sql(N.nested_sql("{t}"), t=N.to_tags(df)).filter("NOT broken").select("page_id").distinct().collect()}
    assert by_sql == {i for i, h in enumerate(htmls) if N.pair_by_depth(N.page_tags(h))}
    # end tags are left out of nested pages only
    left = {r[0] for r in N.to_tags(df, ends=False).filter("kind = 'close'").select("page_id").distinct().collect()}
    assert left == {i for i, h in enumerate(htmls) if i not in by_sql and "</" in h}


def test_html_nodes_of_a_table_carries_no_html(spark):
    """The LATERAL join meets the nodes by digest, whatever the html's length; equal htmls are built once."""
    htmls = [CASES[1][0], CASES[2][0], CASES[1][0], None, "", "<p><b>y</b></p>"]
    pages = spark.createDataFrame([*enumerate(htmls), (0, htmls[0])], "page_id long, html string")
    N.register_sql(spark, pages)
    found = spark.sql("SELECT p.page_id, n.tag, count(*) AS n FROM {p} p, LATERAL html_nodes(p.html) n WHERE n.kind = 'el' GROUP BY ALL", p=pages)
    N.register_sql(spark)
    whole = spark.sql("SELECT p.page_id, n.tag, count(*) AS n FROM {p} p, LATERAL html_nodes(p.html) n WHERE n.kind = 'el' GROUP BY ALL", p=pages)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, whole.collect())) and found.count() == 15
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "<=>" not in plan and "html_tags" not in plan


def test_repeated_and_missing_page_ids(spark):
    """Pages of one id are one page, as the windows see it; pages without an id are dropped."""
    html = "<div><p>a<b>c</b></p><br></div>"
    pages = spark.createDataFrame([(1, html), (1, html), (2, html), (None, html)], "page_id long, html string")
    rows = N.node_table(pages, "repeated").collect()
    tokens = N.to_tags(pages.filter("page_id = 1"))
    want = {(r["node_id"], r["parent_id"], r["open_pos"], r["close_pos"]) for r in spark.sql(N.nested_sql("{t}"), t=tokens).collect()}
    of = lambda i: [(r["node_id"], r["parent_id"], r["open_pos"], r["close_pos"]) for r in rows if r["page_id"] == i]
    assert set(of(1)) == want and len(of(1)) == 2 * len(want) and len(of(2)) == len(want) and not of(None)
    assert {(a, c, d) for a, _, c, d in of(2)} == {(a, c, d) for a, _, c, d in want}


LEFT_OUT = [                                                           # only end tags that rule 4 supplies are missing
    "<ul><li>one<ul><li>two</ul><li>three</ul>", "<table><tr><th>k<th>v<tr><td>1<td>2</table>", "<div><p><b>x<br><p>y</div>z",
    "<p>a<div>b</div>c<hr><i>d", "<dl><dt>a<dd><i>b<dd>c</dl>", "<div><a>u<b>v<a>w</div>", "<table><tr><td>A<table><tr><td>B</table>t</table>",
    "<ul><li>a<ul><li>x</li></ul>t<li>y</li></ul>", "<select><option>a<option>b</select>"]
NOT_BY_RANK = ["<p>x<p>y", "<div><p>x", "<b><i>x</b>y</i>", "</b><p>x<i>y</p>", "<ul><li>x</ul></ul>", "<table><tr><td>x"]


def test_pages_that_lack_end_tags_need_no_windows(spark):
    """Content pages leave out the ends of items, cells and paragraphs: the splitter places their nodes as the windows do."""
    assert all(N.pair_by_rank(N.page_tags(h)) for h in LEFT_OUT) and not any(N.pair_by_rank(N.page_tags(h)) for h in NOT_BY_RANK)
    df = spark.createDataFrame(list(enumerate(LEFT_OUT)), "page_id long, html string")
    tags = N.to_tags(df)
    spot = ["page_id", "node_id", "parent_id", "open_pos", "close_pos", "kind", "tag"]
    want = spark.sql(N.structure_sql("{t}"), t=tags).select(*spot).collect()
    cuts = []
    nodes = N.build_tree(tags, lambda t: cuts.append(1) or t)
    assert len(cuts) == 1 and "Window" not in nodes._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, nodes.select(*spot).collect())) == sorted(map(tuple, want))


@given(st.lists(st.sampled_from("<p> </p> <li> </li> <ul> </ul> <td> </td> <tr> <table> </table> <b> </b> <a> </a> <div> </div> <br> <hr> <dd> </dd> x".split()), max_size=25))
@settings(max_examples=300, deadline=None)
def test_a_stack_pairs_only_what_nests(parts):
    rows = N.page_tags("".join(parts))
    found = N.pair_by_depth(rows) or N.pair_by_rank(rows)
    if found:
        around, stops = found
        for seq, kind, *_ in rows[1:]:
            assert kind == "close" or (around[seq] < seq and (around[seq] == 0 or stops[around[seq]] > seq))
        assert all((stops[seq] is not None) == (kind in ("open", "doc")) for seq, kind, *_ in rows)


def test_page_work_is_dealt_out_by_rows(spark, monkeypatch):
    """A task's share of the nodes stays the same as the table grows, whatever its bytes."""
    monkeypatch.setattr(N, "NODES_PER_TASK", 1000)
    parts = []
    for pages in (50, 500):
        nodes = N.node_table(spark.range(pages).select(F.col("id").alias("page_id"), F.lit("<div>x</div>" * 50).alias("html")), "dealt")
        by_page = nodes.groupBy("page_id").count()
        assert by_page.count() == pages and by_page.first()["count"] == 101
        parts.append(nodes.rdd.getNumPartitions())
    assert parts[1] == 500 * 101 // 1000 and parts[0] < parts[1]
