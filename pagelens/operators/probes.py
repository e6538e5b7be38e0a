"""Analytics over saved probe pages (no site is contacted).

Bot-test tables become test rows (D11 + class status), a scorecard per
page, IPv4 reports with both private-range rules, JSON fingerprints read
with ``try_parse_json``/``variant_get``, and snapshot change detection as a
full outer join of two hashed snapshots.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelens.functions.text import col_
from pagelens.operators import dom

# Python's str.strip() whitespace set (str.isspace).
PY_WS = "\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
IPV4_RE = r"(?<![0-9A-Za-z_])(\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})(?![0-9A-Za-z_])"
# The address prefixes the probe treats as private.
REFERENCE_PRIVATE_PREFIXES = ["10.", "192.168.", "172.16.", "172.17.", "172.18.", "172.19.", "172.2", "172.3"]
NAME_SUFFIXES = ["(Old)", "(New)"]
VALUE_CHARS = 80


def py_strip(c) -> Column:
    return F.btrim(col_(c), F.lit(PY_WS))


# ---------------------------------------------------------------------------
# I1-I4
# ---------------------------------------------------------------------------
def test_rows(nodes: DataFrame) -> DataFrame:
    """(page_id, test_no, name, status, value) from every table row
    with two or more direct cells; rows without a status class are dropped."""
    rows = dom.table_rows(nodes).withColumnsRenamed({"cell0": "t0", "cell1": "t1"})
    name = py_strip(F.col("t0"))
    for sfx in NAME_SUFFIXES:
        name = py_strip(F.replace(name, F.lit(sfx), F.lit("")))
    cls = F.col("cell1_class")
    status = (F.when(cls.contains("passed"), F.lit("passed")).when(cls.contains("warn"), F.lit("warn"))
              .when(cls.contains("failed"), F.lit("failed")))
    j = rows.select("page_id", "table_pos", "tr_pos", name.alias("name"), status.alias("status"),
                 F.substring(py_strip("t1"), 1, VALUE_CHARS).alias("value")).filter(F.col("status").isNotNull())
    w = Window.partitionBy("page_id").orderBy("table_pos", "tr_pos")
    return j.withColumn("test_no", F.row_number().over(w)).select("page_id", "test_no", "name", "status", "value")


def scorecard(tests: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """Counts, score text, percent and the two traffic lights. With
    ``pages`` a page without tests has a row too (``0/0 passed``)."""
    if pages is not None:
        tests = tests.select("page_id", "status").unionByName(pages.select("page_id", F.lit(None).cast("string").alias("status")))
    agg = tests.groupBy("page_id").agg(
        F.count_if(F.col("status") == "passed").alias("passed"),
        F.count_if(F.col("status") == "warn").alias("warn"),
        F.count_if(F.col("status") == "failed").alias("failed"))
    total = F.col("passed") + F.col("warn") + F.col("failed")
    score = F.concat(F.col("passed").cast("string"), F.lit("/"), total.cast("string"), F.lit(" passed"),
                     F.when(F.col("warn") > 0, F.concat(F.lit(", "), F.col("warn").cast("string"),
                                                        F.lit(" warnings"))).otherwise(F.lit("")),
                     F.when(F.col("failed") > 0, F.concat(F.lit(", "), F.col("failed").cast("string"),
                                                          F.lit(" failed"))).otherwise(F.lit("")))
    pct = F.when(total > 0, F.col("passed") / total * F.lit(100.0)).otherwise(F.lit(0.0))
    return agg.select(
        "page_id", "passed", "warn", "failed", total.cast("long").alias("total"), score.alias("score"),
        F.concat(F.bround(pct, 0).cast("long").cast("string"), F.lit("%")).alias("percent"),
        F.when(pct >= 90, F.lit("green")).when(pct >= 70, F.lit("yellow")).otherwise(F.lit("red"))
        .alias("grade"),
        F.when(F.col("failed") == 0, F.lit("green")).when(F.col("failed") > 3, F.lit("red"))
        .otherwise(F.lit("yellow")).alias("failed_level"))


# ---------------------------------------------------------------------------
# I5-I8
# ---------------------------------------------------------------------------
def ipv4s(c) -> Column:
    """IPv4-looking tokens (ASCII word boundaries)."""
    return F.regexp_extract_all(col_(c), F.lit(IPV4_RE), 1)


def is_private_reference(ip) -> Column:
    ip = col_(ip)
    out = F.lit(False)
    for p in REFERENCE_PRIVATE_PREFIXES:
        out = out | ip.startswith(p)
    return out


def is_private_strict(ip) -> Column:
    """RFC 1918: 10/8, 172.16/12, 192.168/16."""
    parts = F.split(col_(ip), r"\.")
    a, b = parts[0].try_cast("int"), parts[1].try_cast("int")
    return F.coalesce((a == 10) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)), F.lit(False))


def ip_report(df: DataFrame, key: str, text_col: str) -> DataFrame:
    """Distinct leaked addresses per key with both private rules."""
    ips = df.select(key, F.explode(ipv4s(text_col)).alias("ip")).distinct()
    ips = ips.filter(~F.col("ip").startswith("0.") & (F.col("ip") != "0.0.0.0"))
    return ips.select(key, "ip", is_private_reference("ip").alias("private_reference"),
                      is_private_strict("ip").alias("private_strict"))


def _own_text_first(nodes: DataFrame) -> DataFrame:
    """First own text node of every element: (page_id, node_id, own_text)."""
    t = nodes.filter(F.col("kind") == "text").select("page_id", F.col("parent_id").alias("node_id"),
                                                     "open_pos", "text")
    return t.groupBy("page_id", "node_id").agg(F.min_by("text", "open_pos").alias("own_text"))


def webrtc_report(nodes: DataFrame) -> DataFrame:
    """I5/I7/I8 on a probe page: (page_id, leaked_ips, webrtc_support,
    spoofed, detected_ip)."""
    els = nodes.filter(F.col("kind") == "el")
    own = _own_text_first(nodes)
    e = els.join(own, ["page_id", "node_id"], "left")
    cls, idv = F.coalesce(F.col("attrs")["class"], F.lit("")), F.coalesce(F.col("attrs")["id"], F.lit(""))
    ice = e.filter(cls.contains("ice") | idv.contains("ice")
                   | F.coalesce(F.col("own_text").contains("candidate"), F.lit(False)))
    ice_txt = dom.subtree_text(nodes, ice.withColumn("tid", F.col("node_id")))
    ips = ip_report(ice_txt, "page_id", "text").groupBy("page_id").agg(
        F.array_sort(F.collect_set("ip")).alias("leaked_ips"))
    sup = e.filter(F.coalesce(F.col("own_text").contains("WebRTC Support"), F.lit(False))).groupBy("page_id") \
        .agg(F.min_by("parent_id", "open_pos").alias("node_id")).join(nodes.select("page_id", "node_id", "open_pos", "close_pos"), ["page_id", "node_id"]) \
        .withColumnRenamed("node_id", "tid")
    sup_txt = dom.subtree_text(nodes, sup).select(
        "page_id", py_strip(F.replace("text", F.lit("WebRTC Support"), F.lit(""))).alias("webrtc_support"))
    ip_el = e.filter(cls.contains("ip")).select("page_id", F.col("node_id").alias("tid"), "open_pos", "close_pos")
    ip_txt = dom.subtree_text(nodes, ip_el).join(ip_el, ["page_id", "tid"]) \
        .withColumn("first_ip", F.try_element_at(ipv4s("text"), F.lit(1))) \
        .filter(F.col("first_ip").isNotNull()).groupBy("page_id") \
        .agg(F.min_by("first_ip", "open_pos").alias("detected_ip"))
    pages = nodes.filter(F.col("kind") == "doc").select("page_id")
    return (pages.join(ips, "page_id", "left").join(sup_txt, "page_id", "left")
            .join(ip_txt, "page_id", "left")
            .withColumn("spoofed", F.lower("webrtc_support").contains("true")))


# ---------------------------------------------------------------------------
# I9-I11
# ---------------------------------------------------------------------------
_HDR = "array<struct<key:string,name:string,value:string>>"


def tls_fields(nodes: DataFrame) -> DataFrame:
    """JSON from the page body text, else the first <pre>, else an
    error row; then the flattened fingerprint fields. Both texts of a page come
    out of one aggregate: one shuffle, no join."""
    j = dom.page_texts(nodes, "pre").select("page_id", py_strip("text").alias("body"), py_strip("first_text").alias("pre"))
    j = j.select("page_id", F.coalesce(F.try_parse_json("body"), F.try_parse_json("pre")).alias("v"))

    def s(path):
        x = F.try_variant_get("v", path, "string")
        return F.when(x != "", x)
    # each in a step of its own: the array of headers is read out once
    j = j.withColumn("h1", F.try_variant_get("v", "$.http_1.headers", _HDR))
    headers = F.when(F.coalesce(F.size("h1"), F.lit(0)) > 0, F.col("h1")).otherwise(F.try_variant_get("v", "$.http_2.sent_headers", _HDR))
    j = j.withColumn("ua", F.try_element_at(F.filter(headers, lambda h: F.lower(F.coalesce(h["key"], h["name"], F.lit("")))
                                                     == "user-agent"), F.lit(1))["value"])
    ua = F.col("ua")
    out = j.select(
        "page_id",
        F.when(F.col("v").isNull(), F.lit("Could not parse TLS data as JSON")).alias("error"),
        s("$.tls.ja3").alias("ja3"), s("$.tls.ja3_hash").alias("ja3_hash"), s("$.tls.ja4").alias("ja4"),
        s("$.tls.peetprint_hash").alias("peetprint_hash"),
        s("$.http_2.akamai_fingerprint_hash").alias("h2_fingerprint_hash"),
        s("$.tls.tls_version_record").alias("tls_version"), s("$.ip").alias("ip"),
        F.when(ua != "", ua).alias("user_agent"))
    return out.withColumn("is_firefox", F.when(F.col("user_agent").isNotNull(),
                                               F.col("user_agent").contains("Firefox")
                                               | F.col("user_agent").contains("Gecko")))


# ---------------------------------------------------------------------------
# I12
# ---------------------------------------------------------------------------
def fingerprint(c) -> Column:
    """sha256, first 16 hex characters."""
    return F.substring(F.sha2(col_(c), 256), 1, 16)


def snapshot_diff(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """Per key the hash before and after and a status."""
    b = before.select(key, fingerprint(value).alias("hash_before"))
    a = after.select(key, fingerprint(value).alias("hash_after"))
    j = b.join(a, key, "full_outer")
    status = (F.when(F.col("hash_before").isNull(), F.lit("added"))
              .when(F.col("hash_after").isNull(), F.lit("removed"))
              .when(F.col("hash_before") == F.col("hash_after"), F.lit("same"))
              .otherwise(F.lit("changed")))
    return j.select(key, "hash_before", "hash_after", status.alias("status"))
