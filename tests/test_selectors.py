import pytest
from pyspark.sql import functions as F

from pagelens.operators import dom
from pagelens.operators.nodes import to_nodes
from tests.conftest import pages_df

HTML = ('<div id="rso"><div class="MjjYud x"><a href="/u1"><h3> T1 </h3></a><span data-sncf="1,2">s</span></div>'
        '<div class="MjjYud"><div class="MjjYud"><a><h3>T2</h3></a></div></div></div>'
        '<div class="MjjYud"><h3>no link</h3></div><img class="XNo5Ab" src="a"><img src="b">'
        '<table><tr><td>n<td class="passed">v<table><tr><td>i1<td class="warn">i2</table></table>')


def test_select_forms(spark):
    nodes = to_nodes(pages_df(spark, [HTML])).cache()

    def ids(sel):
        return sorted(r.node_id for r in dom.select(nodes, sel).collect())
    assert len(ids(".MjjYud")) == 4
    assert len(ids("#rso .MjjYud")) == 3
    assert len(ids("#rso > .MjjYud")) == 2
    assert len(ids("a h3")) == 2
    assert len(ids('[data-sncf*="1"]')) == 1
    assert len(ids('[data-sncf="1"]')) == 0
    assert len(ids("a[href^='/u']")) == 1
    assert len(ids("img:not(.XNo5Ab)")) == 1
    assert len(ids("h3, a")) == 5
    assert len(ids("div.MjjYud.x")) == 1


def test_first_within_text_and_closest(spark):
    nodes = to_nodes(pages_df(spark, [HTML])).cache()
    cont = dom.select(nodes, ".MjjYud").withColumn("cid", F.col("node_id"))
    h3 = dom.closest(nodes, dom.select(nodes, "a h3"), "a", "link_id")
    assert dom.within(h3, cont).count() == 3     # each match with each container around it
    first = dom.first_within(h3, cont, ["node_id", "link_id", "open_pos", "close_pos"])
    assert first.count() == 3          # the outer nested container sees the inner h3 too
    assert sorted(r.level for r in dom.walk_up(nodes, h3.limit(1), 2).collect()) == [1, 2]
    t = dom.text_trim(nodes, first.withColumn("tid", F.col("node_id")))
    assert sorted(r.text for r in t.collect()) == ["T1", "T2"]
    assert first.filter(F.col("link_id").isNull()).count() == 0


def test_table_rows_nested(spark):
    nodes = to_nodes(pages_df(spark, [HTML])).cache()
    rows = dom.table_rows(nodes).collect()
    # outer table: its row + the nested row; inner table: the nested row again
    assert len(rows) == 3
    assert sorted(r.cell1_class for r in rows) == ["passed", "warn", "warn"]


@pytest.mark.parametrize("sel, want", [
    ("h2 + p", ["p1", "p4"]), ("h2 ~ p", ["p1", "p2", "p4"]), ("h2 ~ p + p", ["p2"]), ("div > p:first-child", ["p3"]),
    ("p:last-child", ["p2", "p4"]), ("li:nth-child(odd)", ["l1", "l3"]), ("li:nth-child(2n)", ["l2", "l4"]),
    ("li:nth-child(-n+2)", ["l1", "l2"]), ("li:nth-child(3)", ["l3"]), ("li:nth-last-child(1)", ["l4"]), ("li:nth-child(n+3)", ["l3", "l4"]),
    ("li:not(:first-child)", ["l2", "l3", "l4"]), ("b:only-child", ["b1"]), ("li + li, h2 + p", ["l2", "l3", "l4", "p1", "p4"]), (".x ~ li", ["l3", "l4"]),
])
def test_siblings_and_places(sibling_nodes, sel, want):
    nodes = sibling_nodes
    got = dom.select(nodes, sel)
    assert got.columns == nodes.columns
    rows = got.collect()
    assert sorted(r["attrs"]["id"] for r in rows if r["page_id"] == 1) == want and len(rows) == 2 * len(want)


@pytest.fixture(scope="module")
def sibling_nodes(spark):
    html = ('<div><h2>a</h2>text<p id=p1>1</p><p id=p2>2</p></div><div><p id=p3><b id=b1>3</b></p><h2>b</h2><p id=p4>4</p></div>'
            '<ul><li id=l1>1<li id=l2 class=x>2<li id=l3>3<li id=l4>4</ul>')
    return to_nodes(spark.createDataFrame([(1, html), (2, html)], "page_id long, html string")).cache()


def test_text_within_in_one_pass(spark):
    """``with_text`` also tells what lies in an element, and needs one window of its own order for all of it."""
    html = "<h2><a>in<b> bold</b><script>s</script></a></h2><a>out</a>loose<h2>x<div><a>deep</a></div></h2><a></a>"
    nodes = to_nodes(spark.createDataFrame([(1, html)], "page_id long, html string"))
    rows = nodes.select("page_id", "node_id", "open_pos", "close_pos", "kind", "tag", "text")
    rows = spark.createDataFrame(rows.collect(), rows.schema)
    done = dom.with_text(rows, F.col("tag") == "a", in_head=F.col("tag") == "h2")
    got = [(r["content"], r["content_noscript"], r["in_head"]) for r in done.filter("tag = 'a'").orderBy("open_pos").collect()]
    assert got == [("in bolds", "in bold", True), ("out", "out", False), ("deep", "deep", True), ("", "", False)]
    plan = done._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Window [") == 2
