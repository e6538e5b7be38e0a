import os
import tempfile

from pyspark.sql import functions as F

from pagelens.operators import content as CT
from pagelens.operators import llm_batch as LB
from pagelens.operators import process as PS
from pagelens.sources import sinks
from tests.conftest import pages_df

LONG = "one two three four five six seven eight nine ten eleven twelve"
PAGE = ('<html><head><title> T &amp; t </title><meta name="description" content="d">'
        '<meta property="og:site_name" content="Site"></head><body>'
        '<nav><a href="/n">nav</a></nav><div class="ad">ad</div><header>h</header>'
        '<article><h1>Head</h1><p>' + LONG + '</p><p>short one</p><p>' + LONG + ' <a href="x/../y">link</a></p>'
        '<div hidden>hidden text</div><div class="share-bar">share</div><p>Share this</p>'
        '<ol><li>a</li><li>b</li></ol></article><footer>f</footer></body></html>')


def test_markdown_rules(spark):
    pages = pages_df(spark, [PAGE], ["https://www.example.org/dir/page.html"])
    nodes = PS.content_nodes_table(pages, materialize=False)
    md = CT.render(pages, nodes).first().content
    assert md == ("# Head\n\n" + LONG + "\n\nshort one\n\n" + LONG
                  + " [link](https://www.example.org/dir/y)\n\nShare this\n\n1. a\n2. b")
    art = CT.render(pages, nodes, article=True).first().content
    assert "short one" in art          # short block between two long ones stays
    assert "Share this" not in art     # short trailing block goes
    html = CT.render(pages, nodes, "html").first().content
    assert html.startswith("<article><h1>Head</h1>") and 'href="https://www.example.org/dir/y"' in html
    meta = CT.metadata(pages, nodes).first()
    assert (meta.title, meta.description, meta.site, meta.domain) == ("T & t", "d", "Site", "example.org")


def test_resolve_url(spark):
    base = "https://h.org/a/b/c.html?q=1#f"
    cases = {"x": "https://h.org/a/b/x", "../x": "https://h.org/a/x", "/x": "https://h.org/x",
             "//cdn.org/x": "https://cdn.org/x", "?z=2": "https://h.org/a/b/c.html?z=2",
             "#top": "https://h.org/a/b/c.html?q=1#top", "mailto:a@b": "mailto:a@b", "./x": "https://h.org/a/b/x"}
    df = spark.createDataFrame([(k,) for k in cases], "h string")
    got = {r.h: r.u for r in df.select("h", CT.resolve_url(F.col("h"), F.lit(base)).alias("u")).collect()}
    assert got == cases


def test_process_json_and_sinks(spark):
    pages = pages_df(spark, [PAGE])
    out = PS.process(pages, "json")
    row = out.first()
    assert row.format == "json" and row.engine == "standard" and '"title":"T & t"' in row.content
    root = tempfile.mkdtemp(prefix="pagelens-sink-")
    sinks.write_content(out, os.path.join(root, "c"))
    assert spark.read.parquet(os.path.join(root, "c", "content")).count() == 1
    summary = spark.createDataFrame([(1, 2, "x")], "score int, total int, _raw_html string")
    sinks.write_probe_report(summary, summary.select("_raw_html"), os.path.join(root, "p"), "2024-01-01_000000",
                             "sannysoft")
    back = spark.read.json(os.path.join(root, "p", "summary"))
    assert "_raw_html" not in back.columns and back.first().probe == "sannysoft"


def test_call_model_roundtrip(spark):
    docs = spark.createDataFrame([(1, "hello ![i](x.png) world"), (2, "plain")], "doc_id long, text string")
    req = LB.plan_requests(docs, "text", "doc_id")

    def fake_model(requests):
        import json
        return requests.map(lambda r: "```markdown\n" + json.loads(r)["messages"][1]["content"].upper() + "\n```")
    out = LB.apply_responses(req, LB.call_model(req, fake_model)).orderBy("key").collect()
    assert [r.content for r in out] == ["HELLO  WORLD", "PLAIN"] and all(r.error is None for r in out)
