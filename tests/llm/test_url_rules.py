"""Rules that nest deeply, on one host and on its subdomains."""

import random

from pyspark.sql import functions as F

from pagelens.llm import url_filter
from tests.llm.test_operators import judge


def test_nested_rules_in_many_partitions_match_brute_force(spark):
    draw = random.Random(4)
    hosts = ["h.com", "com", "a.h.com", "b.a.h.com", "x.h.com", "net", "", "h.com.net"]
    path = lambda: "".join(draw.choice(["/a", "/b", "/", "a", "é"]) for _ in range(draw.randrange(7)))
    rules = list({(h, p): (v, h, p) for h, p, v in ((draw.choice(hosts), path(), draw.choice(["allow", "block"])) for _ in range(250))}.values())
    rows = [(i, draw.choice(["http://", "x://"]) + draw.choice(hosts + ["z.b.a.h.com", "q.net", "H.com", "h.comx"]) + "/" + path() + draw.choice(["", "?a", "#/a"]))
            for i in range(600)] + [(600, None), (601, "http://h.com"), (602, "://"), (603, "http://h.com/\U0010ffff")]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = {r["page_id"]: r for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string"), url_filter.rule_table(spark, rules)).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(out) == len(rows)
    for i, u in rows:
        assert (out[i]["host"], out[i]["path"], out[i]["rule"], out[i]["verdict"]) == judge(u, rules), u


def test_a_host_with_thousands_of_rules_costs_linear_rows(spark):
    n = 5000
    paths = spark.range(n).select(F.lit("allow").alias("verdict"), F.lit("h.com").alias("host"), F.concat(F.lit("/"), F.repeat(F.lit("d/"), (F.col("id") % 40).cast("int")), F.col("id")).alias("path"))
    subs = spark.range(n).select(F.lit("block").alias("verdict"), F.concat(F.lit("s"), F.col("id"), F.lit(".h.com")).alias("host"), F.lit("/").alias("path"))
    rules = paths.unionByName(subs)
    asked = spark.createDataFrame([("h.com", "/7"), ("s9.h.com", "/")], "host string, path string")
    assert url_filter.events(url_filter.plain_rules(rules), asked).count() == 2 * 2 * n + 2
    urls = spark.createDataFrame([(1, "http://h.com/0?7"), (2, "http://s9.h.com/d/41"), (3, "http://s9.h.com/"), (4, "http://t.h.com/d/d/d/43/x"), (5, "http://t.h.com/e")],
                                 "page_id long, url string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(urls, rules).collect()}
    listed = [("allow", "h.com", "/" + "d/" * (i % 40) + str(i)) for i in range(n)] + [("block", f"s{i}.h.com", "/") for i in range(n)]
    assert got == {r["page_id"]: judge(r["url"], listed) for r in urls.collect()}
    assert {r[2] for r in got.values()} == {"h.com/0", "h.com/d/41", "s9.h.com/", "h.com/d/d/d/43", None}
