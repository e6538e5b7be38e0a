"""Result pages built by Spark from the given tables (round-trip fixtures).

Each builder renders rows of ``documents``/``orders``/``events`` into HTML
with one ``concat`` template per row and an ordered per-page aggregate, so
the page count grows with the tables. The matching SQL returns, straight
from the source columns, what an extraction of those pages must yield. The
planted traps (duplicate URLs, fallbacks, empty strategies, short titles,
deep metadata, bad labels, ...) are decided by arithmetic on the row id, so
every row of the table is used and each page mixes cases.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelens.functions.text import JS_WS_CLASS, js_collapse_ws
from pagelens.session import ensure_parallel

ROWS_PER_PAGE = 10


def html_escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def spread(pages: DataFrame) -> DataFrame:
    """Generated pages come out of one aggregate; give them as many
    partitions as there are cores so the parse runs in parallel."""
    n = pages.sparkSession.sparkContext.defaultParallelism * 2
    return pages.repartition(n, "page_id")


def _page_concat(rows: DataFrame, order: str, piece: str) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, piece))),
                                    lambda x: x[piece]), "")


def duck_collapse(expr: str) -> str:
    """JS ``s.replace(/\\s+/g,' ').trim()`` in DuckDB."""
    return (f"regexp_replace(regexp_replace({expr}, '[{JS_WS_CLASS}]+', ' ', 'g'), "
            f"'^ | $', '', 'g')")


def duck_trim(expr: str) -> str:
    return f"regexp_replace({expr}, '^[{JS_WS_CLASS}]+|[{JS_WS_CLASS}]+$', '', 'g')"


# ---------------------------------------------------------------------------
# web search result pages
# ---------------------------------------------------------------------------
def search_pages(documents: DataFrame) -> DataFrame:
    d = documents.select("doc_id", "text", "lang", "source",
                         (F.col("doc_id") / ROWS_PER_PAGE).cast("long").alias("page_id"))
    i = F.col("doc_id")
    key = F.when((i % 11 == 4) & (i % 10 != 0), i - 1).otherwise(i)
    url = F.concat(F.lit("https://example.org/doc/"), key, F.lit("?n="), key * 7 % 100)
    href = F.when(i % 13 == 6, F.concat(F.lit("/local/"), i)).when(
        i % 19 == 9, F.concat(F.lit("/url?q=bad%zz"), i)).otherwise(
        F.concat(F.lit("/url?q="), F.url_encode(url), F.lit("&amp;sa=U")))
    title = F.concat(F.lit("Result "), i, F.lit(" "), F.col("lang"), F.lit(" "), F.col("source"))
    esc = html_escape(F.col("text"))
    kind = i % 5
    snippet = (F.when(kind == 0, F.concat(F.lit('<div data-sncf="1">'), esc, F.lit("</div>")))
               .when(kind == 1, F.concat(F.lit('<div data-sncf="1,2"><span>'), esc, F.lit("</span></div>")))
               .when(kind == 2, F.concat(F.lit('<div class="VwiC3b x">'), esc, F.lit("</div>")))
               .when(kind == 3, F.concat(F.lit('<div data-sncf="1"></div><div class="VwiC3b">'), esc,
                                         F.lit("</div>")))
               .otherwise(F.concat(F.lit('<div data-snf="nke7rc">'), esc,
                                   F.lit("<script>var s=1;</script></div>"))))
    thumbs = (F.when(i % 3 == 0, F.concat(
        F.lit('<img class="XNo5Ab" src="https://img.example.org/logo.png">'
              '<img src="https://img.example.org/t/'), i, F.lit('.jpg">')))
        .when(i % 3 == 1, F.concat(F.lit('<img src="/t/'), i, F.lit('.png">')))
        .otherwise(F.lit("")))
    block = F.concat(F.lit('<div class="MjjYud"><div><a href="'), href, F.lit('"><h3>'), title,
                     F.lit("</h3></a></div>"), thumbs, snippet, F.lit("</div>"))
    sugg = F.concat(F.lit("<a> "), F.col("lang"), F.lit(" "), F.col("source"), F.lit(" </a>"))
    d = d.select("page_id", "doc_id", block.alias("block"), sugg.alias("sugg"))
    pages = d.groupBy("page_id").agg(_page_concat(d, "doc_id", "block").alias("blocks"),
                                     _page_concat(d, "doc_id", "sugg").alias("suggs"))
    p = F.col("page_id")
    wrapper = F.when(p % 4 == 3, F.lit("main")).otherwise(F.lit("rso"))
    sponsored = F.concat(F.lit('<div class="MjjYud"><a href="/url?q=https%3A%2F%2Fads.example.org%2F'), p,
                         F.lit('"><h3> Sponsored '), p, F.lit(" </h3></a></div>"))
    sugg_block = F.when(p % 5 == 2, F.concat(F.lit('<div class="ouy7Mc">'), F.col("suggs"), F.lit("</div>"))) \
        .otherwise(F.concat(F.lit('<div class="oIk2Cb">'), F.col("suggs"), F.lit("<a> </a></div>")))
    html = F.concat(F.lit("<!DOCTYPE html><html><head><title>Search "), p,
                    F.lit("</title></head><body><div id=\""), wrapper, F.lit('">'), F.col("blocks"),
                    F.lit("</div>"), sponsored, sugg_block, F.lit("</body></html>"))
    return spread(pages.select("page_id", F.concat(F.lit("https://www.google.com/search?q=p"), p).alias("url"),
                               html.alias("html")))


SEARCH_RESULTS_SQL = f"""
WITH d AS (
  SELECT doc_id, CAST(doc_id // 10 AS BIGINT) AS page_id, text, lang, source,
         CASE WHEN doc_id % 11 = 4 AND doc_id % 10 <> 0 THEN doc_id - 1 ELSE doc_id END AS k
  FROM documents),
r AS (
  SELECT page_id, doc_id AS pos,
         'https://example.org/doc/' || k || '?n=' || (k * 7 % 100) AS url,
         'Result ' || doc_id || ' ' || lang || ' ' || source AS title,
         CASE WHEN doc_id % 5 = 3 THEN '' ELSE {duck_collapse('text')} END AS content,
         CASE WHEN doc_id % 3 = 0 THEN 'https://img.example.org/t/' || doc_id || '.jpg' END AS thumbnail
  FROM d WHERE doc_id % 13 <> 6 AND doc_id % 19 <> 9
  UNION ALL
  SELECT DISTINCT page_id, 9223372036854775807 AS pos, 'https://ads.example.org/' || page_id,
         'Sponsored ' || page_id, '', CAST(NULL AS VARCHAR)
  FROM d WHERE page_id % 4 = 3),
u AS (SELECT *, row_number() OVER (PARTITION BY page_id, url ORDER BY pos) AS rn FROM r)
SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY pos) AS INTEGER) AS rank,
       url, title, content, thumbnail
FROM u WHERE rn = 1
"""

SEARCH_SUGGESTIONS_SQL = """
SELECT CAST(doc_id // 10 AS BIGINT) AS page_id,
       CAST(row_number() OVER (PARTITION BY doc_id // 10 ORDER BY doc_id) AS INTEGER) AS rank,
       lang || ' ' || source AS text
FROM documents
"""


# ---------------------------------------------------------------------------
# news listing pages
# ---------------------------------------------------------------------------
def news_pages(documents: DataFrame) -> DataFrame:
    i = F.col("doc_id")
    key = F.when((i % 11 == 4) & (i % 10 != 0), i - 1).otherwise(i)
    target = F.concat(F.lit("https://news.example.org/a/"), key)
    body = F.when(i % 9 != 5, F.encode(target, "UTF-8")).otherwise(
        F.encode(F.concat(F.lit("nolink/"), key), "UTF-8"))
    payload = F.concat(F.unhex(F.lit("0813")), body, F.unhex(F.lit("D201")))
    b64 = F.rtrim(F.translate(F.regexp_replace(F.base64(payload), r"[\r\n]", ""), "+/", "-_"), F.lit("="))
    href = F.concat(F.lit("./read/"), b64, F.lit("?hl="), F.col("lang"))
    title = (F.when(i % 8 == 7, F.lit("Short new")).when(i % 8 == 6, F.lit("Short news"))
             .otherwise(F.concat(F.lit("Headline "), i, F.lit(" from "), F.col("source"))))
    src_level = i % 6 + 1
    time_level = i % 5 + 2
    src_span = F.concat(F.lit('<span data-n-tid="7">'), F.col("source"), F.lit("</span>"))
    time_el = F.concat(F.lit("<time>T"), F.col("n_chars") % 1000, F.lit(" min ago</time>"))
    inner = F.concat(F.lit('<a href="'), href, F.lit('">'), F.lit(" "), title, F.lit(" </a>"))
    for level in range(1, 7):
        first = F.lit("")
        if level == 1:
            first = F.when(i % 3 != 2, F.concat(F.lit('<img src="/r/'), i, F.lit('.png">'))).otherwise("")
        if level == 2:
            first = F.when(i % 3 == 0, F.concat(F.lit('<img src="https://img.example.org/n/'), i,
                                                 F.lit('.jpg">'))).otherwise("")
        extra = F.concat(
            F.when(F.lit(level == 1) & (i % 7 == 2), F.lit('<span data-n-tid="0"> </span>')).otherwise(""),
            F.when(src_level == level, src_span).otherwise(""),
            F.when(time_level == level, time_el).otherwise(""))
        inner = F.concat(F.lit(f'<div class="n{level}">'), first, inner, extra, F.lit("</div>"))
    d = documents.select((i / ROWS_PER_PAGE).cast("long").alias("page_id"), "doc_id", inner.alias("block"))
    pages = d.groupBy("page_id").agg(_page_concat(d, "doc_id", "block").alias("blocks"))
    html = F.concat(F.lit("<html><body><main><h1>Top stories</h1>"), F.col("blocks"),
                    F.lit("</main></body></html>"))
    return spread(pages.select("page_id", F.concat(F.lit("https://news.google.com/topics/p"),
                                                   F.col("page_id")).alias("url"), html.alias("html")))


NEWS_RESULTS_SQL = f"""
WITH d AS (
  SELECT doc_id, CAST(doc_id // 10 AS BIGINT) AS page_id, lang, source, n_chars,
         CASE WHEN doc_id % 11 = 4 AND doc_id % 10 <> 0 THEN doc_id - 1 ELSE doc_id END AS k
  FROM documents),
e AS (
  SELECT *,
    CASE WHEN doc_id % 8 = 7 THEN 'Short new' WHEN doc_id % 8 = 6 THEN 'Short news'
         ELSE 'Headline ' || doc_id || ' from ' || source END AS title,
    CASE WHEN doc_id % 9 <> 5 THEN 'https://news.example.org/a/' || k
         ELSE 'https://news.google.com/read/'
              || rtrim(replace(replace(to_base64(unhex('0813') || encode('nolink/' || k) || unhex('D201')),
                                       '+', '-'), '/', '_'), '=')
              || '?hl=' || lang END AS url,
    CASE WHEN doc_id % 7 = 2 OR doc_id % 6 + 1 > 5 THEN NULL ELSE source END AS src,
    CASE WHEN doc_id % 5 + 2 > 5 THEN NULL ELSE 'T' || (n_chars % 1000) || ' min ago' END AS tm
  FROM d),
f AS (SELECT *, row_number() OVER (PARTITION BY page_id, url ORDER BY doc_id) AS rn
      FROM e WHERE length(title) >= 10)
SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY doc_id) AS INTEGER) AS rank,
       url, title, concat_ws(' / ', src, tm) AS content,
       CASE WHEN doc_id % 3 = 0 THEN 'https://img.example.org/n/' || doc_id || '.jpg' END AS thumbnail
FROM f WHERE rn = 1
"""


# ---------------------------------------------------------------------------
# debenture card pages (F18-F20), from orders
# ---------------------------------------------------------------------------
CARDS_PER_PAGE = 20
CARDS_PER_TASK = 20_000


def card_pages(orders: DataFrame) -> DataFrame:
    def dl(label, value):
        return F.concat(F.lit(f"<dl><dt>{label}</dt><dd>"), value, F.lit("</dd></dl>"))

    def card(o):
        k = o["o_orderkey"]
        anchor = F.when(k % 17 == 5, F.lit("<a>")).otherwise(
            F.concat(F.lit('<a href="/debentures/DEB'), k, F.lit('">')))
        return F.concat(
            F.lit('<li class="list-item__container"><h2 class="list-item__title">'), anchor,
            F.lit("DEB"), k, F.lit(" <span>Lei 12.431</span></a></h2>"),
            dl("Emissor", F.concat(F.lit("Cliente "), o["o_custkey"])),
            dl("Remuneração", F.round(o["o_totalprice"] * 100).cast("long").cast("string")),
            dl("Data de vencimento", F.date_format(o["o_orderdate"], "dd/MM/yyyy")),
            dl("Duration", F.when(o["o_orderstatus"] == "F", F.lit("-"))
               .otherwise((o["o_custkey"] % 97).cast("string"))),
            dl("SETOR", o["o_orderpriority"]),
            dl("Status", o["o_orderstatus"]),
            dl("PU PAR", F.lit("1000")),
            dl(" pu par ", o["o_custkey"].cast("string")),
            F.lit("</li>"))
    # the columns are shuffled, once, and the cards written where their page is
    columns = ["o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderstatus", "o_orderpriority"]
    parts = max(orders.sparkSession.sparkContext.defaultParallelism * 2, orders.count() // CARDS_PER_TASK)
    d = orders.select((F.col("o_orderkey") / CARDS_PER_PAGE).cast("long").alias("page_id"), *columns).repartition(parts, "page_id")
    pages = d.groupBy("page_id").agg(F.collect_list(F.struct(*columns)).alias("orders"))
    cards = F.array_sort(F.transform("orders", lambda o: F.struct(o["o_orderkey"].alias("k"), card(o).alias("card"))))
    html = F.concat(F.lit('<html><body><ul class="list">'), F.array_join(F.transform(cards, lambda c: c["card"]), ""), F.lit("</ul></body></html>"))
    return pages.select("page_id", F.concat(F.lit("https://data.example.org/busca/debentures?page="),
                                            F.col("page_id")).alias("url"), html.alias("html"))


CARDS_SQL = """
SELECT CAST(o_orderkey // 20 AS BIGINT) AS page_id,
       CAST(row_number() OVER (PARTITION BY o_orderkey // 20 ORDER BY o_orderkey) AS INTEGER) AS rank,
       '/debentures/DEB' || o_orderkey AS url, 'DEB' || o_orderkey AS ticker,
       'Cliente ' || o_custkey AS emissor,
       CAST(CAST(round(o_totalprice * 100) AS BIGINT) AS VARCHAR) AS remuneracao,
       strftime(o_orderdate, '%d/%m/%Y') AS vencimento,
       CASE WHEN o_orderstatus = 'F' THEN '' ELSE CAST(o_custkey % 97 AS VARCHAR) END AS duration,
       o_orderpriority AS setor, CAST(NULL AS VARCHAR) AS emissao,
       CAST(o_custkey AS VARCHAR) AS pu_par, CAST(NULL AS VARCHAR) AS pu_indicativo
FROM orders WHERE o_orderkey % 17 <> 5
"""

CARD_JSON_SQL = """
SELECT CAST(o_orderkey // 20 AS BIGINT) AS page_id,
       CAST(row_number() OVER (PARTITION BY o_orderkey // 20 ORDER BY o_orderkey) AS INTEGER) AS rank,
       '/debentures/DEB' || o_orderkey AS url, 'DEB' || o_orderkey AS title,
       '{"duration":"' || CASE WHEN o_orderstatus = 'F' THEN '' ELSE CAST(o_custkey % 97 AS VARCHAR) END
       || '","emissor":"Cliente ' || o_custkey
       || '","pu_par":"' || o_custkey
       || '","remuneracao":"' || CAST(CAST(round(o_totalprice * 100) AS BIGINT) AS VARCHAR)
       || '","setor":"' || o_orderpriority
       || '","vencimento":"' || strftime(o_orderdate, '%d/%m/%Y') || '"}' AS fields_json
FROM orders WHERE o_orderkey % 17 <> 5
"""


# ---------------------------------------------------------------------------
# bot-test probe pages (I1-I4), from events
# ---------------------------------------------------------------------------
EVENTS_PER_PAGE = 20


def bot_test_pages(events: DataFrame) -> DataFrame:
    e = F.col("event_id")
    v = F.col("value")
    suffix = F.when(e % 7 == 1, F.lit(" (Old)")).when(e % 7 == 2, F.lit(" (New)")).otherwise(F.lit(""))
    name = F.concat(F.col("event_type"), F.lit(" "), F.col("user_id"), suffix)
    cls = (F.when(v < 50, F.lit("result passed")).when(v < 100, F.lit("warn"))
           .when(v < 200, F.lit("result failed")).otherwise(F.lit("info")))
    value = F.concat(F.col("props"), F.lit(" "), F.repeat(F.lit("x"), (e % 90).cast("int")))
    row = F.when(e % 11 == 3, F.concat(F.lit("<tr><td>"), name, F.lit("</td></tr>"))).otherwise(
        F.concat(F.lit("<tr><td>"), name, F.lit('</td><td class="'), cls, F.lit('"> '), value,
                 F.lit(" </td></tr>")))
    d = events.select((e / EVENTS_PER_PAGE).cast("long").alias("page_id"), "event_id", row.alias("row"))
    pages = d.groupBy("page_id").agg(_page_concat(d, "event_id", "row").alias("rows"))
    p = F.col("page_id")
    nested = F.concat(F.lit('<table><tr><td>Summary</td><td class="info"><table><tr><td>nested '), p,
                      F.lit('</td><td class="passed">ok</td></tr></table></td></tr></table>'))
    html = F.concat(F.lit("<html><body><table><tr><th>Test Name</th><th>Result</th></tr>"), F.col("rows"),
                    F.lit("</table>"), nested, F.lit("</body></html>"))
    return spread(pages.select("page_id", F.concat(F.lit("https://probe.example.org/bot?p="), p).alias("url"),
                               html.alias("html")))


BOT_TESTS_SQL = """
WITH r AS (
  SELECT CAST(event_id // 20 AS BIGINT) AS page_id, 0 AS grp, event_id AS pos,
         event_type || ' ' || user_id AS name,
         CASE WHEN value < 50 THEN 'passed' WHEN value < 100 THEN 'warn' WHEN value < 200 THEN 'failed' END AS status,
         left(props || ' ' || repeat('x', CAST(event_id % 90 AS INTEGER)), 80) AS value
  FROM events WHERE event_id % 11 <> 3 AND value < 200
  UNION ALL
  SELECT DISTINCT CAST(event_id // 20 AS BIGINT), g, 0, 'nested ' || (event_id // 20), 'passed', 'ok'
  FROM events, (VALUES (1), (2)) t(g))
SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY grp, pos) AS INTEGER) AS test_no,
       name, status, rtrim(value) AS value
FROM r
"""


# ---------------------------------------------------------------------------
# TLS probe pages (I9-I11), from events
# ---------------------------------------------------------------------------
FIREFOX_UA = "Mozilla/5.0 (X11; Linux x86_64; rv:128.0) Gecko/20100101 Firefox/128.0"
OTHER_UA = "Mozilla/5.0 (Windows NT 10.0) AppleWebKit/537.36 Chrome/120.0 Safari/537.36"


def tls_pages(events: DataFrame) -> DataFrame:
    e = F.col("event_id")
    ua = F.when(F.col("user_id") % 2 == 0, F.lit(FIREFOX_UA)).otherwise(F.lit(OTHER_UA))
    none = F.lit(None).cast("string")
    hk = F.struct(F.lit("User-Agent").alias("key"), none.alias("name"), ua.alias("value"))
    hn = F.struct(none.alias("key"), F.lit("user-agent").alias("name"), ua.alias("value"))
    accept = F.struct(F.lit("accept").alias("key"), none.alias("name"), F.lit("*/*").alias("value"))
    tls = F.struct(F.concat(F.lit("771,"), F.col("user_id")).alias("ja3"),
                   F.md5(F.concat(F.lit("ja3-"), F.col("user_id"))).alias("ja3_hash"),
                   F.concat(F.lit("t13d"), F.col("user_id") % 100).alias("ja4"),
                   F.when(e % 5 == 0, F.lit("")).otherwise(F.md5(F.col("event_type"))).alias("peetprint_hash"),
                   F.lit("771").alias("tls_version_record"))
    kind = e % 4
    http1 = F.when(kind == 0, F.struct(F.array(accept, hk).alias("headers"))).when(
        kind == 2, F.struct(F.array().cast("array<struct<key:string,name:string,value:string>>").alias("headers")))
    http2 = F.struct(F.when(kind == 1, F.array(hn)).when(kind == 2, F.array(hk)).alias("sent_headers"),
                     F.md5(F.concat(F.lit("h2-"), F.col("event_type"))).alias("akamai_fingerprint_hash"))
    doc = F.to_json(F.struct(F.concat(F.lit("10.0."), F.col("user_id") % 256, F.lit(".1")).alias("ip"),
                             tls.alias("tls"), http1.alias("http_1"), http2.alias("http_2")))
    shape = e % 3
    html = (F.when(shape == 0, F.concat(F.lit("<html><body>"), doc, F.lit("</body></html>")))
            .when(shape == 1, F.concat(F.lit("<html><body><h1>TLS</h1><pre>"), doc, F.lit("</pre></body></html>")))
            .otherwise(F.concat(F.lit("<html><body><pre>{broken "), e, F.lit("</pre></body></html>"))))
    return events.select(F.col("event_id").alias("page_id"),
                         F.concat(F.lit("https://tls.example.org/api/all?e="), e).alias("url"), html.alias("html"))


TLS_SQL = f"""
SELECT event_id AS page_id,
  CASE WHEN event_id % 3 = 2 THEN 'Could not parse TLS data as JSON' END AS error,
  CASE WHEN event_id % 3 <> 2 THEN '771,' || user_id END AS ja3,
  CASE WHEN event_id % 3 <> 2 THEN md5('ja3-' || user_id) END AS ja3_hash,
  CASE WHEN event_id % 3 <> 2 THEN 't13d' || (user_id % 100) END AS ja4,
  CASE WHEN event_id % 3 <> 2 AND event_id % 5 <> 0 THEN md5(event_type) END AS peetprint_hash,
  CASE WHEN event_id % 3 <> 2 THEN md5('h2-' || event_type) END AS h2_fingerprint_hash,
  CASE WHEN event_id % 3 <> 2 THEN '771' END AS tls_version,
  CASE WHEN event_id % 3 <> 2 THEN '10.0.' || (user_id % 256) || '.1' END AS ip,
  CASE WHEN event_id % 3 <> 2 AND event_id % 4 <> 3
       THEN CASE WHEN user_id % 2 = 0 THEN '{FIREFOX_UA}' ELSE '{OTHER_UA}' END END AS user_agent,
  CASE WHEN event_id % 3 <> 2 AND event_id % 4 <> 3 THEN user_id % 2 = 0 END AS is_firefox
FROM events
"""


# ---------------------------------------------------------------------------
# WebRTC probe pages (I5, I7, I8), from documents
# ---------------------------------------------------------------------------
def webrtc_pages(documents: DataFrame) -> DataFrame:
    i = F.col("doc_id")
    esc = html_escape(F.col("text"))
    support = F.concat(F.lit("<table><tr><td>WebRTC Support</td><td> "),
                       F.when(i % 2 == 0, F.lit("True")).otherwise(F.lit("False")), F.lit(" </td></tr></table>"))
    ice = F.when(i % 3 != 0, F.concat(F.lit('<div id="ice-list">'), esc, F.lit("</div>"))).otherwise(
        F.concat(F.lit('<div class="log"><p>candidate: '), esc, F.lit("</p></div>")))
    ipbox = F.when(i % 5 != 0, F.concat(F.lit('<div class="ip-box">Your IP: 203.0.113.'), i % 250,
                                         F.lit("</div>"))).otherwise(F.lit(""))
    html = F.concat(F.lit("<html><body><h1>WebRTC Leak Test</h1>"), support, ice, ipbox, F.lit("</body></html>"))
    # a page per row: only a small table is dealt out, and before its rows become html
    return ensure_parallel(documents, "doc_id").select(
        i.alias("page_id"), F.concat(F.lit("https://probe.example.org/webrtc?d="), i).alias("url"), html.alias("html"))


WEBRTC_SQL = r"""
SELECT doc_id AS page_id,
  list_sort(list_distinct(list_filter(regexp_extract_all(text, '\b(\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})\b', 1),
            lambda ip: NOT ip LIKE '0.%' AND ip <> '0.0.0.0'))) AS leaked_ips,
  CASE WHEN doc_id % 2 = 0 THEN 'True' ELSE 'False' END AS webrtc_support,
  doc_id % 2 = 0 AS spoofed,
  CASE WHEN doc_id % 5 <> 0 THEN '203.0.113.' || (doc_id % 250) END AS detected_ip
FROM documents
"""


# ---------------------------------------------------------------------------
# Listing pages for the base profile (F1-F3), from documents
# ---------------------------------------------------------------------------
BASE_OPTIONS = {"results_selector": "div.item", "url_selector": "a.go", "title_selector": "h2", "content_selector": "p.sum",
                "thumbnail_selector": "img.pic", "suggestion_selector": "ul.more li"}


def listing_pages(documents: DataFrame) -> DataFrame:
    """Ten items a page. Planted: no href (the link's text counts), an empty
    href, no link at all, a blank or missing title, two titles (the first
    counts), no summary, pictures without a source, blank suggestions."""
    i = F.col("doc_id")
    n = i.cast("string")
    link = (F.when(i % 7 == 3, F.concat(F.lit('<a class="go"> go/'), n, F.lit(" </a>")))
            .when(i % 7 == 4, F.concat(F.lit('<a class="go" href="">empty/'), n, F.lit("</a>")))
            .when(i % 17 == 5, F.lit('<a href="/other">other</a>'))
            .otherwise(F.concat(F.lit('<a class="x go" href="/item?id='), n, F.lit('&amp;s=1">link</a>'))))
    title = (F.when(i % 11 == 6, F.lit("<h2>  </h2>")).when(i % 13 == 7, F.lit(""))
             .otherwise(F.concat(F.lit("<h2> Item <b>"), n, F.lit("</b> "), F.col("lang"), F.lit(" </h2><h2>second</h2>"))))
    summary = F.when(i % 3 == 1, F.lit("")).otherwise(F.concat(F.lit('<p class="sum">'), html_escape(F.col("text")), F.lit("</p>")))
    picture = F.when(i % 4 == 0, F.concat(F.lit('<img class="pic" src="/p/'), n, F.lit('.png">'))).when(i % 4 == 1, F.lit('<img class="pic">')).otherwise(F.lit(""))
    block = F.concat(F.lit('<div class="item">'), link, title, summary, picture, F.lit("</div>"))
    more = F.when(i % 5 == 2, F.lit("<li> </li>")).otherwise(F.concat(F.lit("<li> more "), n, F.lit("</li>")))
    d = documents.select((i / ROWS_PER_PAGE).cast("long").alias("page_id"), "doc_id", block.alias("block"), more.alias("more"))
    pages = d.groupBy("page_id").agg(_page_concat(d, "doc_id", "block").alias("blocks"), _page_concat(d, "doc_id", "more").alias("more"))
    html = F.concat(F.lit("<html><body><h2>Listing</h2>"), F.col("blocks"), F.lit('<ul class="more">'), F.col("more"), F.lit("</ul></body></html>"))
    return spread(pages.select("page_id", F.concat(F.lit("https://list.example.org/"), F.col("page_id")).alias("url"), html.alias("html")))


LISTING_RESULTS_SQL = f"""
WITH d AS (SELECT doc_id AS i, CAST(doc_id // 10 AS BIGINT) AS page_id, lang, text FROM documents),
r AS (
  SELECT page_id, i,
    CASE WHEN i % 7 = 3 THEN 'go/' || i WHEN i % 7 = 4 THEN 'empty/' || i WHEN i % 17 = 5 THEN '' ELSE '/item?id=' || i || '&s=1' END AS url,
    CASE WHEN i % 11 = 6 OR i % 13 = 7 THEN '' ELSE 'Item ' || i || ' ' || lang END AS title,
    CASE WHEN i % 3 = 1 THEN '' ELSE regexp_replace(text, '^[{JS_WS_CLASS}]+|[{JS_WS_CLASS}]+$', '', 'g') END AS content,
    CASE WHEN i % 4 = 0 THEN '/p/' || i || '.png' END AS thumbnail FROM d)
SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY i) AS INTEGER) AS rank, url, title, content, thumbnail
FROM r WHERE url <> '' AND title <> ''"""

LISTING_SUGGESTIONS_SQL = """
SELECT CAST(doc_id // 10 AS BIGINT) AS page_id, CAST(row_number() OVER (PARTITION BY doc_id // 10 ORDER BY doc_id) AS INTEGER) AS rank,
  'more ' || doc_id AS text FROM documents WHERE doc_id % 5 <> 2"""


# ---------------------------------------------------------------------------
# Article pages with everything the content rules name (C3-C7, E1-E16), one
# per document
# ---------------------------------------------------------------------------
_HREFS = ["/a/{i}", "rel?{i}", "../up/{i}", "./x/../y/{i}", "#f{i}", "//other.example.org/{i}", "https://abs.example.org/{i}", "?q={i}"]
_RESOLVED = ["https://c.example.org/a/{i}", "https://c.example.org/d/e/rel?{i}", "https://c.example.org/d/up/{i}", "https://c.example.org/d/e/y/{i}",
             "https://c.example.org/d/e/{i}.html#f{i}", "https://other.example.org/{i}", "https://abs.example.org/{i}", "https://c.example.org/d/e/{i}.html?q={i}"]
_HEAD = ('<html><head><meta property="og:title" content=" OG {i} "><meta name="author" content="Author {lang}"><meta name="description" content="About &amp; {i}">'
         '<meta property="article:published_time" content="2024-01-02T00:00:{i}"><meta property="og:site_name" content="Site {lang}"><title>T {i}</title></head>')
_ARTICLE = ('<body><header>top {i}</header><nav>menu {i}</nav><article><h1>Head {i}</h1><div hidden>hidden {i}</div><p style="display: none">none {i}</p>'
            '<div aria-hidden="true">aria {i}</div><p>{t}</p><div class="share-box">share {i}</div><nav>inner {i}</nav><div class="sidebar">side {i}</div>'
            '<svg><text>drawn {i}</text></svg><noscript>nos {i}</noscript><iframe src="f">framed</iframe><picture><img src="/p.png" width="300"></picture>'
            '<ul><li>one {i}<ul><li>two {i}</ul><li>three</ul><ol><li>first<li>second {i}</ol><pre>code {i}\n  indented\n\n\nend</pre>'
            '<blockquote>quote {i}</blockquote><table><tr><th>k<th>v|w</tr><tr><td>{i}<td>{lang}</tr></table>'
            '<p>see <a href="{href}">link {i}</a> <em>em</em> <strong>st</strong> <code>c</code></p><hr><p>last {i}</p></article><footer>foot {i}</footer></body></html>')
_MARKDOWN = ("# Head {i}\n\n{t}\n\n- one {i}\n  - two {i}\n- three\n\n1. first\n2. second {i}\n\n```\ncode {i}\n  indented\n\n\nend\n```\n\n> quote {i}\n\n"
             "| k | v\\|w |\n| --- | --- |\n| {i} | {lang} |\n\nsee [link {i}]({href}) *em* **st** `c`\n\n---\n\nlast {i}")


def _filled(template: str, **values: Column) -> Column:
    import re
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*[values[x] if k % 2 else F.lit(x) for k, x in enumerate(parts)])


def _filled_sql(template: str, **values: str) -> str:
    import re
    parts = re.split(r"\{(\w+)\}", template)
    lit = lambda x: "'" + x.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
    return " || ".join(values[x] if k % 2 else lit(x) for k, x in enumerate(parts) if x)


def content_pages(documents: DataFrame) -> DataFrame:
    i = F.col("doc_id").cast("string")
    href = F.element_at(F.array(*[_filled(h, i=i) for h in _HREFS]), (F.col("doc_id") % 8 + 1).cast("int"))
    text = html_escape(js_collapse_ws(F.col("text")))
    html = _filled(_HEAD + _ARTICLE, i=i, lang=F.col("lang"), t=text, href=href)
    # as in webrtc_pages
    return ensure_parallel(documents, "doc_id").select(F.col("doc_id").alias("page_id"), F.concat(F.lit("https://c.example.org/d/e/"), i, F.lit(".html")).alias("url"), html.alias("html"))


_HREF_SQL = "CASE doc_id % 8 " + " ".join(f"WHEN {k} THEN {_filled_sql(h, i='doc_id')}" for k, h in enumerate(_RESOLVED)) + " END"
_HREF_RAW_SQL = "CASE doc_id % 8 " + " ".join(f"WHEN {k} THEN {_filled_sql(h, i='doc_id')}" for k, h in enumerate(_HREFS)) + " END"
CONTENT_MARKDOWN_SQL = f"""SELECT doc_id AS page_id, {_filled_sql(_MARKDOWN, i='doc_id', lang='lang', t=duck_collapse('text'), href=_HREF_SQL)} AS content
FROM documents"""
CONTENT_METADATA_SQL = """SELECT doc_id AS page_id, 'OG ' || doc_id AS title, 'Author ' || lang AS author, 'About & ' || doc_id AS description,
  '2024-01-02T00:00:' || doc_id AS published, 'c.example.org' AS domain, 'Site ' || lang AS site FROM documents"""
CONTENT_LINKS_SQL = f"SELECT doc_id AS page_id, {_HREF_RAW_SQL} AS href, {_HREF_SQL} AS url, 'link ' || doc_id AS text FROM documents"
# words outside scripts: two of every planted two-word piece, the fixed ones, and the text's own
LINK_DENSITY_SQL = f"""SELECT doc_id AS page_id, CAST(2 AS BIGINT) AS link_words,
  CAST(48 + len(list_filter(regexp_split_to_array(text, '[{JS_WS_CLASS}]+'), lambda x: x <> '')) AS BIGINT) AS words FROM documents"""


# ---------------------------------------------------------------------------
# Event batches that arrive out of order (L3, L4): eight slices of time, a
# tenth of the events three batches late, a third of them twice, and at the
# end events of another time that let the watermark pass all others
# ---------------------------------------------------------------------------
SLICES, LATE_BY = 8, 3
LATE_BATCHES_SQL = f"""
WITH span AS (SELECT min(epoch_us(ts)) AS a, max(epoch_us(ts)) AS b FROM events),
sliced AS (SELECT event_id, user_id, ts, CAST(({SLICES} * (epoch_us(ts) - a)) // (b - a + 1) AS INTEGER) AS slice FROM events, span),
arrived AS (SELECT *, event_id % 10 = 0 AND slice + {LATE_BY} < {SLICES} AS late FROM sliced)"""


def event_batches(events: DataFrame):
    """The arriving batches in order, as DataFrames (event_id, user_id, ts)."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    span = events.agg(F.min(us).alias("a"), F.max(us).alias("b"))
    e = events.crossJoin(F.broadcast(span)).select(
        "event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), F.expr(f"int(({SLICES} * (unix_micros(cast(ts AS timestamp)) - a)) div (b - a + 1))").alias("slice"))
    late = (F.col("event_id") % 10 == 0) & (F.col("slice") + LATE_BY < SLICES)
    e = e.withColumn("batch", F.when(late, F.col("slice") + LATE_BY).otherwise(F.col("slice")))
    e = e.withColumn("copy", F.explode(F.when(F.col("event_id") % 3 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    for i in range(SLICES):
        yield e.filter(F.col("batch") == i).select("event_id", "user_id", "ts")
    for i in (1, 2, 3):
        yield span.select(F.lit(-i).cast(events.schema["event_id"].dataType).alias("event_id"), F.lit(-1).cast(events.schema["user_id"].dataType).alias("user_id"),
                          F.timestamp_micros(F.col("b") + F.lit(i * 30 * 86_400_000_000)).alias("ts"))
