import datetime as dt

from pyspark.sql import functions as F

from pagelens.functions import llm as L
from pagelens.operators import probes as PB
from pagelens.operators import report as RP
from pagelens.operators import requests as RQ


def one(spark, col, value, schema="s string"):
    return spark.createDataFrame([(value,)], schema).select(col.alias("o")).first()["o"]


def test_truncation_and_context(spark):
    n = L.max_chars(2000)
    assert one(spark, L.truncate_for_context("s", 2000), "x" * n) == "x" * n
    assert one(spark, L.truncate_for_context("s", 2000), "x" * (n + 1)) == "x" * n
    assert one(spark, L.truncation_warning("s", 2000), "x" * n) is None
    w = one(spark, L.truncation_warning("s", 2000), "x" * (n + 1))
    assert w == ("Content truncated from 6KB to 6KB to fit AI context window (2000 tokens). "
                 "Some content may be missing.")
    assert one(spark, L.estimate_tokens("s"), "abcd") == 2
    assert one(spark, L.dynamic_context(F.col("s").cast("long"), 2000), "10") == 4096
    assert one(spark, L.dynamic_context(F.col("s").cast("long")), "10000") == 15000
    assert one(spark, L.dynamic_context(F.col("s").cast("long")), "1000000") == 131072


def test_strip_images_and_fence(spark):
    md = "a [![x](i.png)](l) b ![y](j.png) c [](z)  d\n\n\n\ne"
    assert one(spark, L.strip_md_images("s"), md) == "a  b  c d\n\ne"
    assert one(spark, L.strip_code_fence("s"), "```markdown\n# T\n```") == "# T"
    assert one(spark, L.strip_code_fence("s"), "  ```\nbody\n```  ") == "body"
    assert one(spark, L.strip_code_fence("s"), "text ```x``` more") == "text ```x``` more"


def test_model_options(spark):
    df = spark.createDataFrame([("milkey/reader-lm-v2:latest",), ("qwen3:8b",), ("llama3",)], "m string")
    rows = df.select(L.model_options(F.col("m"), F.lit(9000).cast("long"), F.lit(4096).cast("long"))
                     .alias("o")).collect()
    assert rows[0].o.temperature == 0.0 and rows[0].o.top_k is None
    assert rows[1].o.temperature == 0.7 and rows[1].o.top_k == 20 and rows[1].o.num_predict == 8192
    assert rows[2].o.temperature == 0.0 and rows[2].o.num_predict is None


def test_cap_text(spark):
    assert one(spark, RP.cap_text("s"), "x" * 50000) == "x" * 50000
    assert one(spark, RP.cap_text("s"), "x" * 50001) == "x" * 50000 + "\n\n... [truncated, 1 chars omitted]"


def test_recency_boundaries(spark):
    now = dt.datetime(2024, 3, 10, 12, 0, 0)
    cases = [(59, "just now"), (60, "1m ago"), (59 * 60, "59m ago"), (3600, "1h ago"),
             (24 * 3600 - 1, "23h ago"), (24 * 3600, "1d ago"), (7 * 24 * 3600 - 1, "6d ago"),
             (7 * 24 * 3600, "3/3/2024")]
    df = spark.createDataFrame([(now - dt.timedelta(seconds=s),) for s, _ in cases], "ts timestamp")
    got = [r.o for r in df.select(RP.recency("ts", F.lit(now)).alias("o")).collect()]
    assert got == [e for _, e in cases]


def test_short_url_and_size(spark):
    assert one(spark, RP.short_url("s"), "https://Example.org/") == "example.org"
    assert one(spark, RP.short_url("s"), "https://example.org/a/b?x=1") == "example.org/a/b"
    assert one(spark, RP.short_url("s"), "not a url") == "not a url"
    assert one(spark, RP.size_label("s"), "x" * 1023) == "1023 chars"
    assert one(spark, RP.size_label("s"), "x" * 1280) == "1.3 KB"


def test_ip_modes(spark):
    df = spark.createDataFrame([(1, "a 172.19.0.1 b 172.200.0.1 c 0.0.0.0 10.1.2.3 8.8.8.8 1.2.3.4.5")],
                               "k int, t string")
    rows = {r.ip: r for r in PB.ip_report(df, "k", "t").collect()}
    assert set(rows) == {"172.19.0.1", "172.200.0.1", "10.1.2.3", "8.8.8.8", "1.2.3.4"}
    assert rows["172.19.0.1"].private_reference and rows["172.19.0.1"].private_strict
    assert rows["172.200.0.1"].private_reference and not rows["172.200.0.1"].private_strict
    assert not rows["8.8.8.8"].private_reference


def test_url_normalise_and_render_split(spark):
    assert one(spark, RQ.normalise_url("s"), "  example.org ") == "https://example.org"
    assert one(spark, RQ.normalise_url("s"), "HTTP://x") == "https://HTTP://x"
    assert one(spark, RQ.normalise_url("s"), "   ") is None
    df = spark.createDataFrame([("/render/https://a.org/p", "format=json&q=1&q=2&x=a+b")], "path string, query string")
    r = RQ.split_render_path(df).first()
    assert r.target_url == "https://a.org/p?q=1&x=a+b" and r.format == "json" and r.wait == 2.0
    r = RQ.split_render_path(df, keep_duplicates=True).first()
    assert r.target_url == "https://a.org/p?format=json&q=1&q=2&x=a+b" and r.wait == 2.0
