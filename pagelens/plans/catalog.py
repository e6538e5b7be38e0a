"""Registered queries: name -> (spark, sf_dir) -> DataFrame, plus the
DuckDB SQL that computes the same result from the same parquet tables.

Every query reads the given tables (or data Spark derives from them), so
its work grows with the tables. Names say what is computed; the SURVEY
operator ids are in the comments.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pagelens.functions.cleaning import duck_pre_clean_sql
from pagelens.operators.cleaning_report import cleaning_report
from pagelens.session import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


DUCK_HOST = r"regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:@]+)', 1)"


# C1-C9 ---------------------------------------------------------------------
@register("clean_bytes_by_host", f"""
SELECT {DUCK_HOST} AS host,
       count(*) AS pages,
       CAST(sum(strlen(html)) AS BIGINT) AS raw_bytes,
       CAST(sum(strlen({duck_pre_clean_sql('html')})) AS BIGINT) AS clean_bytes,
       CAST(sum(strlen(html)) - sum(strlen({duck_pre_clean_sql('html')})) AS BIGINT) AS saved_bytes
FROM pages GROUP BY 1
""")
def q_clean_bytes_by_host(spark, sf):
    return cleaning_report(read_table(spark, sf, "pages"))
FLAGSHIP = "page_markdown"


# F1-F21 profiles on round-trip pages ----------------------------------------
from pagelens.plans import fixtures as FX  # noqa: E402
from pagelens.operators import profiles as PR  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

RESULT_OUT = ["page_id", "rank", "url", "title", "content", "thumbnail"]


@register("web_search_results", FX.SEARCH_RESULTS_SQL)
def q_web_search_results(spark, sf):
    pages = FX.search_pages(read_table(spark, sf, "documents"))
    res, _ = PR.extract(pages, "google_web")
    return res.select(*RESULT_OUT)


@register("web_search_suggestions", FX.SEARCH_SUGGESTIONS_SQL)
def q_web_search_suggestions(spark, sf):
    pages = FX.search_pages(read_table(spark, sf, "documents"))
    _, sugg = PR.extract(pages, "google_web")
    return sugg


@register("news_results", FX.NEWS_RESULTS_SQL)
def q_news_results(spark, sf):
    pages = FX.news_pages(read_table(spark, sf, "documents"))
    res, _ = PR.extract(pages, "google_news")
    return res.select(*RESULT_OUT)


@register("base_results", FX.LISTING_RESULTS_SQL)
def q_base_results(spark, sf):
    """A site that the caller describes by selectors."""
    res, _ = PR.extract(FX.listing_pages(read_table(spark, sf, "documents")), "base", FX.BASE_OPTIONS)
    return res.select(*RESULT_OUT)


@register("base_suggestions", FX.LISTING_SUGGESTIONS_SQL)
def q_base_suggestions(spark, sf):
    _, sugg = PR.extract(FX.listing_pages(read_table(spark, sf, "documents")), "base", FX.BASE_OPTIONS)
    return sugg


@register("debenture_cards", FX.CARDS_SQL)
def q_debenture_cards(spark, sf):
    pages = FX.card_pages(read_table(spark, sf, "orders"))
    nodes = PR.profile_nodes(pages, PR.get_profile("anbima_debentures"))
    return PR.debenture_table(nodes)


@register("debenture_fields", FX.CARD_JSON_SQL)
def q_debenture_fields(spark, sf):
    pages = FX.card_pages(read_table(spark, sf, "orders"))
    res, _ = PR.extract(pages, "anbima_debentures")
    return res.select("page_id", "rank", "url", "title",
                      F.to_json(F.map_from_entries(F.array_sort(F.map_entries("fields")))).alias("fields_json"))


# E7-E16 on the pages table ---------------------------------------------------
from pagelens.functions.text import JS_WS_CLASS  # noqa: E402
from pagelens.operators import content as CT  # noqa: E402
from pagelens.operators import process as PS  # noqa: E402

NL = "chr(10)"


def duck_unescape(expr: str, keep_amp: bool = False) -> str:
    """Entities that occur in the pages table, decoded like the parser."""
    out = (f"replace(replace(replace(replace(replace(replace({expr}, '&quot;', '\"'), '&copy;', '©'), "
           f"'&middot;', '·'), '&lt;', '<'), '&gt;', '>'), '&nbsp;', chr(160))")
    return out if keep_amp else f"replace({out}, '&amp;', '&')"


ARTICLE = r"regexp_extract(html, '<article>([\s\S]*?)</article>', 1)"


def duck_tidy_md(expr: str) -> str:
    e = f"regexp_replace({expr}, '[ \\t]+\\n', {NL}, 'g')"
    e = f"regexp_replace({e}, '\\n[ \\t]+', {NL}, 'g')"
    e = f"regexp_replace({e}, '\\n(\\*\\*|\\*|`)\\n', '\\1' || {NL}, 'g')"
    e = f"regexp_replace({e}, '\\n{{3,}}', {NL} || {NL}, 'g')"
    return f"regexp_replace({e}, '^[{JS_WS_CLASS}]+|[{JS_WS_CLASS}]+$', '', 'g')"


_MD = f"regexp_replace({ARTICLE}, '[{JS_WS_CLASS}]+', ' ', 'g')"
_MD = f"regexp_replace({_MD}, '<h1>([^<]*)</h1>', {NL}||{NL}||'# \\1'||{NL}||{NL}, 'g')"
_MD = f"regexp_replace({_MD}, '<p><b>([^<]*)<br>', {NL}||{NL}||'**\\1'||{NL}||'**'||{NL}||{NL}, 'g')"
_MD = f"regexp_replace({_MD}, '<p>([^<]*)</p>', {NL}||{NL}||'\\1'||{NL}||{NL}, 'g')"


@register("page_markdown", f"SELECT page_id, {duck_tidy_md(duck_unescape(_MD))} AS content FROM pages")
def q_page_markdown(spark, sf):
    pages = read_table(spark, sf, "pages")
    nodes = PS.content_nodes_table(pages)
    return CT.render(pages, nodes, "markdown")


_HT = f"regexp_replace({ARTICLE}, '<p><b>([^<]*)<br>', '<p><b>\\1<br></b></p>', 'g')"


@register("page_html", f"SELECT page_id, '<article>' || {duck_unescape(_HT, keep_amp=True)} || '</article>' "
                       f"AS content FROM pages")
def q_page_html(spark, sf):
    pages = read_table(spark, sf, "pages")
    nodes = PS.content_nodes_table(pages)
    return CT.render(pages, nodes, "html")


@register("content_markdown", FX.CONTENT_MARKDOWN_SQL)
def q_content_markdown(spark, sf):
    """One page per document that holds what the removal
    and rendering rules name."""
    pages = FX.content_pages(read_table(spark, sf, "documents"))
    return CT.render(pages, PS.content_nodes_table(pages), "markdown")


@register("content_metadata", FX.CONTENT_METADATA_SQL)
def q_content_metadata(spark, sf):
    pages = FX.content_pages(read_table(spark, sf, "documents"))
    return CT.metadata(pages, PS.content_nodes_table(pages))


@register("content_links", FX.CONTENT_LINKS_SQL)
def q_content_links(spark, sf):
    pages = FX.content_pages(read_table(spark, sf, "documents"))
    return CT.links(pages, PS.content_nodes_table(pages)).select("page_id", "href", "url", "text")


_SEGS = f"regexp_split_to_array({ARTICLE}, '<[^>]*>')"
_WC = (f"CAST(list_sum(list_transform({_SEGS}, lambda s: len(list_filter(regexp_split_to_array("
       f"{duck_unescape('s')}, '[{JS_WS_CLASS}]+'), lambda x: x <> '')))) AS BIGINT)")
_TITLE = duck_unescape("regexp_extract(html, '<title>([^<]*)</title>', 1)")


@register("page_metadata", f"""
SELECT page_id,
       regexp_replace({_TITLE}, '^[{JS_WS_CLASS}]+|[{JS_WS_CLASS}]+$', '', 'g') AS title,
       CAST(NULL AS VARCHAR) AS author, CAST(NULL AS VARCHAR) AS description,
       CAST(NULL AS VARCHAR) AS published,
       regexp_replace({DUCK_HOST}, '^www\\.', '') AS domain, CAST(NULL AS VARCHAR) AS site,
       {_WC} AS word_count
FROM pages""")
def q_page_metadata(spark, sf):
    pages = read_table(spark, sf, "pages")
    nodes = PS.content_nodes_table(pages)
    meta = CT.metadata(pages, nodes)
    words = CT.content_word_count(CT.content_nodes(nodes))
    return meta.join(words, "page_id", "left").withColumn(
        "word_count", F.coalesce("word_count", F.lit(0).cast("long")))


_LINKS = r"regexp_extract_all(html, '<a href=\"([^\"]*)\">([^<]*)</a>', 0)"


@register("page_links", f"""
WITH l AS (SELECT page_id, url AS page_url, unnest({_LINKS}) AS tag FROM pages)
SELECT page_id, regexp_extract(tag, 'href="([^"]*)"', 1) AS href,
       {DUCK_HOST.replace('url', 'page_url')} AS host_check,
       CASE WHEN regexp_extract(tag, 'href="([^"]*)"', 1) LIKE '/%'
            THEN regexp_extract(page_url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1)
                 || regexp_extract(tag, 'href="([^"]*)"', 1)
            ELSE regexp_extract(tag, 'href="([^"]*)"', 1) END AS url,
       regexp_replace(regexp_replace({duck_unescape("regexp_extract(tag, '>([^<]*)<', 1)")},
                      '[{JS_WS_CLASS}]+', ' ', 'g'), '^ | $', '', 'g') AS text
FROM l""")
def q_page_links(spark, sf):
    pages = read_table(spark, sf, "pages")
    nodes = PS.content_nodes_table(pages)
    out = CT.links(pages, nodes).join(pages.select("page_id", "url").withColumnRenamed("url", "page_url"),
                                      "page_id")
    return out.select("page_id", "href", F.try_parse_url("page_url", F.lit("HOST")).alias("host_check"),
                      "url", "text")


@register("page_json", f"""
WITH h AS ({ORACLES["page_html"]}), m AS ({ORACLES["page_metadata"]})
SELECT page_id, '{{"title":' || CAST(to_json(title) AS VARCHAR) || coalesce(',"domain":' || CAST(to_json(nullif(domain, '')) AS VARCHAR), '')
  || ',"content":' || CAST(to_json(content) AS VARCHAR) || ',"wordCount":' || word_count || '}}' AS content, 'json' AS format, 'standard' AS engine
FROM m JOIN h USING (page_id)""")
def q_page_json(spark, sf):
    """E9 but for the parse time, which differs from run to run."""
    out = PS.process(read_table(spark, sf, "pages"), "json")
    return out.select("page_id", F.regexp_replace("content", ',"parseTime":[0-9.E+-]+', "").alias("content"), "format", "engine")


# G: request planning ----------------------------------------------------------
from pagelens.functions import llm as LL  # noqa: E402
from pagelens.operators import llm_batch as LB  # noqa: E402

_WSC = JS_WS_CLASS


def _duck_strip_images(e: str) -> str:
    e = f"regexp_replace({e}, '\\[!\\[[^\\]]*\\]\\([^)]+\\)\\]\\([^)]+\\)', '', 'g')"
    e = f"regexp_replace({e}, '!\\[[^\\]]*\\]\\([^)]+\\)', '', 'g')"
    e = f"regexp_replace({e}, '\\[\\]\\([^)]+\\)[{_WSC}]*', '', 'g')"
    return f"regexp_replace({e}, '\\n{{3,}}', {NL} || {NL}, 'g')"


def _llm_sql(model: str, max_context: int) -> str:
    n = max_context * 3
    qwen = "qwen" in model and "reader-lm" not in model
    prompt = _duck_strip_images(f"CASE WHEN length(text) > {n} THEN left(text, {n}) ELSE text END")
    tokens = "CAST(ceil(length(prompt) / 3.0) AS BIGINT)"
    ctx = f"greatest(4096, least(CAST(ceil({tokens} * 1.5) AS BIGINT), {max_context}))"
    return f"""
WITH p AS (SELECT doc_id, text, {prompt} AS prompt FROM documents)
SELECT doc_id AS key, length(text) AS input_chars, length(text) > {n} AS truncated,
       CASE WHEN length(text) > {n} THEN 'Content truncated from ' || CAST(floor(length(text) / 1024.0 + 0.5) AS BIGINT)
            || 'KB to {round(n / 1024)}KB to fit AI context window ({max_context} tokens). Some content may be missing.'
       END AS warning,
       {tokens} AS tokens, {ctx} AS num_ctx,
       CAST({0.7 if qwen else 0.0} AS DOUBLE) AS temperature,
       {'CAST(0.8 AS DOUBLE)' if qwen else 'CAST(NULL AS DOUBLE)'} AS top_p,
       {'20' if qwen else 'CAST(NULL AS INTEGER)'} AS top_k,
       {f'least({tokens}, 8192)' if qwen else 'CAST(NULL AS BIGINT)'} AS num_predict,
       sha256(prompt) AS prompt_sha
FROM p"""


def _llm_query(model, max_context):
    def q(spark, sf):
        docs = read_table(spark, sf, "documents")
        r = LB.plan_requests(docs, "text", "doc_id", model, max_context)
        return r.select("key", "input_chars", "truncated", "warning", "tokens", "num_ctx",
                        F.col("options.temperature").alias("temperature"), F.col("options.top_p").alias("top_p"),
                        F.col("options.top_k").alias("top_k"), F.col("options.num_predict").alias("num_predict"),
                        F.sha2("prompt", 256).alias("prompt_sha"))
    return q


register("llm_requests", _llm_sql(LL.DEFAULT_MODEL, LL.DEFAULT_MAX_CONTEXT))(
    _llm_query(LL.DEFAULT_MODEL, LL.DEFAULT_MAX_CONTEXT))
register("llm_requests_qwen_4k", _llm_sql("qwen3:8b", 4096))(_llm_query("qwen3:8b", 4096))


@register("llm_token_report", f"""
WITH r AS ({_llm_sql("qwen3:8b", 4096)}), d AS (SELECT doc_id, source FROM documents)
SELECT source, count(*) AS requests, CAST(sum(CAST(truncated AS INTEGER)) AS BIGINT) AS truncated,
       CAST(sum(tokens) AS BIGINT) AS tokens, max(tokens) AS max_tokens,
       CAST(sum(CASE WHEN num_ctx <= 4096 THEN 1 ELSE 0 END) AS BIGINT) AS ctx_4k,
       CAST(sum(CASE WHEN num_ctx > 4096 AND num_ctx <= 32768 THEN 1 ELSE 0 END) AS BIGINT) AS ctx_32k,
       CAST(sum(CASE WHEN num_ctx > 32768 THEN 1 ELSE 0 END) AS BIGINT) AS ctx_large
FROM r JOIN d ON r.key = d.doc_id GROUP BY source""")
def q_llm_token_report(spark, sf):
    docs = read_table(spark, sf, "documents")
    r = LB.plan_requests(docs, "text", "doc_id", "qwen3:8b", 4096, keep=("source",))
    return LB.token_report(r, "source")


@register("chat_requests", """
SELECT conv_id, CAST(count(*) + 1 AS INTEGER) AS n_messages,
       CAST(ceil(sum(length(text)) / 3.0) AS BIGINT) AS tokens,
       greatest(4096, least(CAST(ceil(CAST(ceil(sum(length(text)) / 3.0) AS BIGINT) * 1.5) AS BIGINT), 131072))
         AS num_ctx,
       sha256('{"model":"' || """ + f"'{LL.DEFAULT_MODEL}'" + """ || '","messages":[{"role":"system","content":' || CAST(to_json(""" + "'" + LL.SYSTEM_PROMPT.replace("'", "''") + "'" + """) AS VARCHAR) || '},'
         || string_agg('{"role":' || CAST(to_json(role) AS VARCHAR) || ',"content":' || CAST(to_json(text) AS VARCHAR) || '}', ',' ORDER BY turn)
         || '],"options":{"temperature":0.0,"num_ctx":' || greatest(4096, least(CAST(ceil(CAST(ceil(sum(length(text)) / 3.0) AS BIGINT) * 1.5) AS BIGINT), 131072))
         || '}}') AS request_sha
FROM conversations GROUP BY conv_id""")
def q_chat_requests(spark, sf):
    c = LB.chat_requests(read_table(spark, sf, "conversations"))
    return c.select("conv_id", (F.col("n_messages") + 1).alias("n_messages"), "tokens", "num_ctx", F.sha2("request", 256).alias("request_sha"))


# B: request table ---------------------------------------------------------------
from pagelens.operators import requests as RQ  # noqa: E402

_B_FMT = ("CASE page_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'format=json&' WHEN 2 THEN 'format=html&' "
          "ELSE 'format=xml&' END")
_B_WAIT = "CASE page_id % 5 WHEN 0 THEN '3' WHEN 1 THEN '0.5' WHEN 2 THEN '' WHEN 3 THEN '10s' ELSE '7' END"
_B_Q = "regexp_extract(url, '^[^?#]*\\?([^#]*)', 1)"
_B_T = "regexp_extract(url, '^([^?#]*)', 1)"


def _render_requests(spark, sf):
    p = read_table(spark, sf, "pages").select("page_id", "url")
    fmt = F.expr(_B_FMT)
    orig_q = F.regexp_extract("url", r"^[^?#]*\?([^#]*)", 1)
    target = F.regexp_extract("url", r"^([^?#]*)", 1)
    q = F.concat(F.when(orig_q == "", F.lit("")).otherwise(F.concat(orig_q, F.lit("&"))), fmt,
                 F.lit("wait="), F.expr(_B_WAIT),
                 F.lit("&article="), F.expr("CASE WHEN page_id % 2 = 0 THEN 'true' ELSE 'True' END"),
                 F.lit("&q=p"), F.col("page_id"), F.lit("&q=dup&engine=ai&blank"))
    return p.select("page_id", F.concat(F.lit("/render/"), target).alias("path"), q.alias("query"))


@register("render_requests", f"""
WITH r AS (SELECT page_id, {_B_T} AS t, {_B_Q} AS q FROM pages)
SELECT page_id,
  t || '?' || CASE WHEN q = '' THEN '' ELSE q || '&' END || 'q=p' || page_id || '&blank=' AS target_url,
  CASE page_id % 4 WHEN 0 THEN 'markdown' WHEN 1 THEN 'json' WHEN 2 THEN 'html' ELSE 'xml' END AS format,
  'ai' AS engine,
  CAST(CASE page_id % 5 WHEN 0 THEN 3.0 WHEN 1 THEN 0.5 WHEN 2 THEN 2.0 WHEN 3 THEN 10.0 ELSE 7.0 END AS DOUBLE) AS wait,
  page_id % 2 = 0 AS article, false AS images,
  CASE WHEN page_id % 4 = 3 THEN 'Invalid format. Must be ''markdown'', ''html'', or ''json''' END AS error
FROM r""")
def q_render_requests(spark, sf):
    s = RQ.split_render_path(_render_requests(spark, sf))
    ok, bad = RQ.validate_render(s)
    both = ok.withColumn("error", F.lit(None).cast("string")).unionByName(bad)
    return both.select("page_id", "target_url", "format", "engine", "wait", "article", "images", "error")


@register("scraper_render_requests", f"""
WITH r AS (SELECT page_id, {_B_T} AS t, {_B_Q} AS q FROM pages)
SELECT page_id,
  t || '?' || CASE WHEN q = '' THEN '' ELSE q || '&' END
    || CASE page_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'format=json&' WHEN 2 THEN 'format=html&' ELSE 'format=xml&' END
    || 'article=' || CASE WHEN page_id % 2 = 0 THEN 'true' ELSE 'True' END
    || '&q=p' || page_id || '&q=dup&engine=ai&blank=' AS target_url,
  CAST(CASE page_id % 5 WHEN 0 THEN 3.0 WHEN 1 THEN 0.5 WHEN 2 THEN 2.0 WHEN 3 THEN 2.0 ELSE 7.0 END AS DOUBLE) AS wait
FROM r""")
def q_scraper_render_requests(spark, sf):
    s = RQ.split_render_path(_render_requests(spark, sf), keep_duplicates=True)
    return s.select("page_id", "target_url", "wait")


_PROFILES_SQL = "['google_web', 'google_news', 'base', 'anbima_debentures', 'bing']"


def _extract_requests(spark, sf):
    p = read_table(spark, sf, "pages").select("page_id", "url")
    raw = F.expr("CASE page_id % 3 WHEN 0 THEN regexp_replace(url, '^https?://', '') "
                 "WHEN 1 THEN '  ' || url || ' ' ELSE url END")
    prof = F.element_at(F.array(*[F.lit(x) for x in
                                  ["google_web", "google_news", "base", "anbima_debentures", "bing"]]),
                        (F.col("page_id") % 5 + 1).cast("int"))
    return p.select("page_id", RQ.normalise_url(raw).alias("url"), prof.alias("profile"),
                    F.when(F.col("page_id") % 2 == 1, F.lit(1.5)).alias("wait_after_load"),
                    F.when(F.col("page_id") % 3 == 1, F.lit(15000)).alias("timeout"))


@register("extract_requests", f"""
WITH r AS (
  SELECT page_id,
    CASE WHEN page_id % 3 = 0 AND NOT (url LIKE 'http://%' OR url LIKE 'https://%') THEN url
         WHEN page_id % 3 = 0 THEN 'https://' || regexp_replace(url, '^https?://', '') ELSE url END AS url,
    {_PROFILES_SQL}[page_id % 5 + 1] AS profile, page_id % 2 = 1 AS odd, page_id % 3 = 1 AS t15
  FROM pages)
SELECT page_id, url, profile,
  CASE WHEN profile = 'bing' THEN 'Unknown profile: bing. Available: google_web, google_news, base, anbima_debentures'
  END AS error,
  CASE WHEN profile = 'bing' THEN NULL WHEN odd THEN 1.5
       WHEN profile IN ('google_web', 'base') THEN 2.0 ELSE 3.0 END::DOUBLE AS wait_after_load,
  CASE WHEN profile = 'bing' THEN NULL WHEN t15 THEN 15000 ELSE 30000 END AS timeout,
  CASE WHEN profile = 'google_web' THEN 'a h3' WHEN profile = 'anbima_debentures' THEN 'li.list-item__container'
  END AS wait_for_selector
FROM r""")
def q_extract_requests(spark, sf):
    ok, bad = RQ.validate_extract(_extract_requests(spark, sf))
    ok = RQ.resolve_profile(ok).withColumn("error", F.lit(None).cast("string"))
    bad = bad.select("page_id", "url", "profile", "error",
                     F.lit(None).cast("double").alias("wait_after_load"),
                     F.lit(None).cast("int").alias("timeout"),
                     F.lit(None).cast("string").alias("wait_for_selector"))
    return ok.select("page_id", "url", "profile", "error", "wait_after_load", "timeout",
                     "wait_for_selector").unionByName(bad)


@register("captcha_split", """
SELECT page_id, CAST(page_id % 7 = 3 AS BOOLEAN) AS captcha FROM pages""")
def q_captcha_split(spark, sf):
    p = read_table(spark, sf, "pages").select(
        "page_id", "url", "html",
        F.when(F.col("page_id") % 7 == 3, F.concat(F.lit("https://www.google.com/sorry/index?continue="),
                                                    F.col("url"))).otherwise(F.col("url")).alias("final_url"))
    ok, blocked = RQ.split_captcha(p, PR.get_profile("google_web").captcha_patterns)
    return ok.select("page_id", F.lit(False).alias("captcha")).unionByName(
        blocked.select("page_id", F.lit(True).alias("captcha")))


# H: reports -----------------------------------------------------------------------
from pagelens.operators import report as RP  # noqa: E402

NOW = "2024-01-31 12:00:00"


@register("capped_documents", """
SELECT doc_id, length(text) AS chars,
  sha256(CASE WHEN length(text) > 50000 THEN left(text, 50000) || chr(10) || chr(10) || '... [truncated, '
              || (length(text) - 50000) || ' chars omitted]' ELSE text END) AS capped_sha,
  CASE WHEN length(text) > 20000 THEN right(left(text, 20000) || chr(10) || chr(10) || '... [truncated, '
              || (length(text) - 20000) || ' chars omitted]', 40) ELSE right(text, 40) END AS cap20k_tail,
  CASE WHEN length(text) < 1024 THEN length(text) || ' chars'
       ELSE printf('%.1f', round(length(text) / 1024.0, 1)) || ' KB' END AS size_label
FROM documents""")
def q_capped_documents(spark, sf):
    d = read_table(spark, sf, "documents")
    return d.select("doc_id", F.length("text").alias("chars"), F.sha2(RP.cap_text("text"), 256).alias("capped_sha"),
                    F.substring(RP.cap_text("text", 20000), -40, 40).alias("cap20k_tail"),
                    RP.size_label("text").alias("size_label"))


_HIST_SRC = """SELECT event_id AS id, 'https://example.org/u/' || user_id || '/' || event_type AS url,
       CASE WHEN event_type IN ('click', 'view') THEN 'render' ELSE 'extract' END AS mode, ts FROM events"""


@register("history_latest", f"""
WITH h AS ({_HIST_SRC}),
l AS (SELECT *, row_number() OVER (PARTITION BY url, mode ORDER BY ts DESC, id DESC) AS rn FROM h)
SELECT id, url, mode, ts FROM l WHERE rn = 1 ORDER BY ts DESC, id DESC LIMIT 20""")
def q_history_latest(spark, sf):
    return RP.upsert_history(_history_entries(spark, sf))


def _history_entries(spark, sf):
    e = read_table(spark, sf, "events")
    return e.select(F.col("event_id").alias("id"),
                 F.concat(F.lit("https://example.org/u/"), F.col("user_id"), F.lit("/"), F.col("event_type"))
                 .alias("url"),
                 F.when(F.col("event_type").isin("click", "view"), F.lit("render")).otherwise(F.lit("extract"))
                 .alias("mode"), "ts")


@register("recency_labels", f"""
WITH d AS (SELECT event_id, ts, CAST(floor((epoch_ms(TIMESTAMP '{NOW}') - epoch_ms(ts)) / 60000.0) AS BIGINT) AS m
           FROM events)
SELECT event_id,
  CASE WHEN m < 1 THEN 'just now' WHEN m < 60 THEN m || 'm ago'
       WHEN floor(m / 60.0) < 24 THEN CAST(floor(m / 60.0) AS BIGINT) || 'h ago'
       WHEN floor(floor(m / 60.0) / 24.0) < 7 THEN CAST(floor(floor(m / 60.0) / 24.0) AS BIGINT) || 'd ago'
       ELSE strftime(ts, '%-m/%-d/%Y') END AS label
FROM d""")
def q_recency_labels(spark, sf):
    e = read_table(spark, sf, "events")
    return e.select("event_id", RP.recency("ts", F.lit(NOW).cast("timestamp")).alias("label"))


@register("short_urls", f"""
SELECT page_id, lower({DUCK_HOST}) || CASE WHEN regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1)
       IN ('', '/') THEN '' ELSE regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1) END AS short
FROM pages""")
def q_short_urls(spark, sf):
    return read_table(spark, sf, "pages").select("page_id", RP.short_url("url").alias("short"))


_LIST_SQL = f"""
WITH res AS ({FX.SEARCH_RESULTS_SQL}),
sug AS ({FX.SEARCH_SUGGESTIONS_SQL}),
rb AS (SELECT page_id, count(*) AS n,
         string_agg(rank || '. ' || title || {NL} || '   URL: ' || url
                    || CASE WHEN content <> '' THEN {NL} || '   ' || content ELSE '' END || {NL},
                    {NL} ORDER BY rank) AS blocks FROM res GROUP BY page_id),
sb AS (SELECT page_id, string_agg('  - ' || text, {NL} ORDER BY rank) AS sugg FROM sug GROUP BY page_id),
pg AS (SELECT DISTINCT CAST(doc_id // 10 AS BIGINT) AS page_id FROM documents UNION ALL SELECT page_id + 1000000000 FROM pages)
SELECT pg.page_id,
  concat_ws({NL}, 'Found ' || coalesce(n, 0) || ' results from google_web profile:' || {NL},
            CASE WHEN coalesce(n, 0) > 0 THEN blocks END,
            CASE WHEN sugg IS NOT NULL THEN 'Related searches:' || {NL} || sugg END) AS text
FROM pg LEFT JOIN rb USING (page_id) LEFT JOIN sb USING (page_id)"""


@register("result_listing", _LIST_SQL)
def q_result_listing(spark, sf):
    # ordinary pages have no results: each still has its line
    pages = FX.search_pages(read_table(spark, sf, "documents")).unionByName(_ordinary(spark, sf))
    res, sugg = PR.extract(pages, "google_web")
    return RP.listing(res, sugg, "google_web", pages)


def _ordinary(spark, sf):
    """The pages table with ids of its own."""
    return read_table(spark, sf, "pages").select((F.col("page_id") + 10 ** 9).alias("page_id"), "url", "html")


@register("search_page_status", f"""
WITH res AS ({FX.SEARCH_RESULTS_SQL}), sug AS ({FX.SEARCH_SUGGESTIONS_SQL}),
pg AS (SELECT DISTINCT CAST(doc_id // 10 AS BIGINT) AS page_id FROM documents)
SELECT page_id,
  CAST(CASE WHEN page_id % 9 = 4 THEN 0 ELSE coalesce((SELECT count(*) FROM res WHERE res.page_id = pg.page_id), 0) END
       AS BIGINT) AS results,
  CAST(CASE WHEN page_id % 9 = 4 THEN 0 ELSE coalesce((SELECT count(*) FROM sug WHERE sug.page_id = pg.page_id), 0) END
       AS BIGINT) AS suggestions,
  page_id % 9 = 4 AS captcha,
  CASE WHEN page_id % 9 = 4 THEN 'CAPTCHA detected' END AS error
FROM pg""")
def q_search_page_status(spark, sf):
    pages = FX.search_pages(read_table(spark, sf, "documents")).withColumn(
        "final_url", F.when(F.col("page_id") % 9 == 4, F.lit("https://www.google.com/sorry/index"))
        .otherwise(F.col("url")))
    ok, blocked = RQ.split_captcha(pages, PR.get_profile("google_web").captcha_patterns)
    res, sugg = PR.extract(ok, "google_web")
    return RP.page_status(pages, res, sugg, blocked)


# I: probe analytics --------------------------------------------------------------
from pagelens.operators import probes as PB  # noqa: E402
from pagelens.operators.nodes import node_table as _node_table  # noqa: E402


def _to_nodes(pages, deal=True):
    """Probe pages -> node table written once (several branches read it)."""
    return _node_table(pages.select("page_id", "html"), "probe_nodes", deal=deal)


@register("bot_tests", FX.BOT_TESTS_SQL)
def q_bot_tests(spark, sf):
    nodes = _to_nodes(FX.bot_test_pages(read_table(spark, sf, "events")))
    return PB.test_rows(nodes)


@register("bot_scorecard", f"""
WITH t AS ({FX.BOT_TESTS_SQL}),
u AS (SELECT page_id, status FROM t UNION ALL SELECT page_id + 1000000000, NULL FROM pages),
a AS (SELECT page_id, count(*) FILTER (status = 'passed') AS passed, count(*) FILTER (status = 'warn') AS warn,
             count(*) FILTER (status = 'failed') AS failed FROM u GROUP BY page_id)
SELECT page_id, passed, warn, failed, CAST(passed + warn + failed AS BIGINT) AS total,
  passed || '/' || (passed + warn + failed) || ' passed'
    || CASE WHEN warn > 0 THEN ', ' || warn || ' warnings' ELSE '' END
    || CASE WHEN failed > 0 THEN ', ' || failed || ' failed' ELSE '' END AS score,
  CAST(round_even(coalesce(passed / nullif(passed + warn + failed, 0), 0) * 100.0, 0) AS BIGINT) || '%' AS percent,
  CASE WHEN passed / nullif(passed + warn + failed, 0) * 100.0 >= 90 THEN 'green'
       WHEN passed / nullif(passed + warn + failed, 0) * 100.0 >= 70 THEN 'yellow' ELSE 'red' END AS grade,
  CASE WHEN failed = 0 THEN 'green' WHEN failed > 3 THEN 'red' ELSE 'yellow' END AS failed_level
FROM a""")
def q_bot_scorecard(spark, sf):
    pages = FX.bot_test_pages(read_table(spark, sf, "events")).unionByName(_ordinary(spark, sf))
    return PB.scorecard(PB.test_rows(_to_nodes(pages)), pages)


_IP_RE = r"\b(\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})\b"


@register("ip_report", f"""
WITH x AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '{_IP_RE}', 1)) AS ip FROM documents)
SELECT doc_id, ip,
  ip LIKE '10.%' OR ip LIKE '192.168.%' OR ip LIKE '172.16.%' OR ip LIKE '172.17.%' OR ip LIKE '172.18.%'
    OR ip LIKE '172.19.%' OR ip LIKE '172.2%' OR ip LIKE '172.3%' AS private_reference,
  coalesce(TRY_CAST(split_part(ip, '.', 1) AS INTEGER) = 10
    OR (TRY_CAST(split_part(ip, '.', 1) AS INTEGER) = 172 AND TRY_CAST(split_part(ip, '.', 2) AS INTEGER) BETWEEN 16 AND 31)
    OR (TRY_CAST(split_part(ip, '.', 1) AS INTEGER) = 192 AND TRY_CAST(split_part(ip, '.', 2) AS INTEGER) = 168), false)
    AS private_strict
FROM x WHERE NOT ip LIKE '0.%' AND ip <> '0.0.0.0'""")
def q_ip_report(spark, sf):
    return PB.ip_report(read_table(spark, sf, "documents"), "doc_id", "text")


@register("tls_fingerprints", FX.TLS_SQL)
def q_tls_fingerprints(spark, sf):
    nodes = _to_nodes(FX.tls_pages(read_table(spark, sf, "events")), deal=False)
    return PB.tls_fields(nodes)


@register("clean_snapshot_diff", f"""
SELECT page_id, left(sha256(html), 16) AS hash_before,
       left(sha256({duck_pre_clean_sql('html')}), 16) AS hash_after,
       CASE WHEN sha256(html) = sha256({duck_pre_clean_sql('html')}) THEN 'same' ELSE 'changed' END AS status
FROM pages""")
def q_clean_snapshot_diff(spark, sf):
    from pagelens.functions.cleaning import pre_clean
    p = read_table(spark, sf, "pages")
    return PB.snapshot_diff(p.select("page_id", "html"), p.select("page_id", pre_clean("html").alias("html")),
                            "page_id", "html")


# L4 in batch form (the streaming jobs run the same expressions) -------------------
from pagelens.streaming import jobs as SJ  # noqa: E402


@register("event_rates_tumbling", """
SELECT time_bucket(INTERVAL '10 minutes', ts) AS window_start,
       time_bucket(INTERVAL '10 minutes', ts) + INTERVAL '10 minutes' AS window_end,
       event_type, count(*) AS n
FROM events GROUP BY ALL""")
def q_event_rates_tumbling(spark, sf):
    return SJ.outcome_rates(read_table(spark, sf, "events"), "tumbling", "10 minutes", by="event_type",
                            delay=None)


@register("event_rates_sliding", """
WITH w AS (
  SELECT time_bucket(INTERVAL '5 minutes', ts) AS window_start, event_type FROM events
  UNION ALL
  SELECT time_bucket(INTERVAL '5 minutes', ts) - INTERVAL '5 minutes', event_type FROM events)
SELECT window_start, window_start + INTERVAL '10 minutes' AS window_end, event_type, count(*) AS n
FROM w GROUP BY ALL""")
def q_event_rates_sliding(spark, sf):
    return SJ.outcome_rates(read_table(spark, sf, "events"), "sliding", "10 minutes", "5 minutes",
                            by="event_type", delay=None)


@register("user_sessions", """
WITH o AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS prev FROM events),
s AS (SELECT user_id, ts, sum(CASE WHEN prev IS NULL OR ts >= prev + INTERVAL '5 minutes' THEN 1 ELSE 0 END)
        OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM o)
SELECT min(ts) AS window_start, max(ts) + INTERVAL '5 minutes' AS window_end, user_id, count(*) AS n
FROM s GROUP BY user_id, sid""")
def q_user_sessions(spark, sf):
    return SJ.sessions(read_table(spark, sf, "events"), "user_id", "5 minutes")


# Model replies joined back by request id -------------------------------
def _replies(req):
    """Replies derived by Spark from the requests: even keys come back
    fenced, odd keys plain, every seventh key has no reply."""
    k = F.col("key")
    reply = F.when(k % 2 == 0, F.concat(F.lit("```markdown\n"), F.col("prompt"), F.lit("\n```")))\
        .otherwise(F.col("prompt"))
    return req.filter(k % 7 != 0).select("request_id", reply.alias("reply"))


_REPLY_SQL = f"""
WITH r AS ({_llm_sql("qwen3:8b", 4096).replace("sha256(prompt) AS prompt_sha", "prompt")})
SELECT key,
  CASE WHEN key % 7 = 0 THEN NULL ELSE sha256(
    regexp_replace(prompt, '^[{_WSC}]+|[{_WSC}]+$', '', 'g')
    || CASE WHEN warning IS NULL THEN '' ELSE {NL} || {NL} || '---' || {NL} || '_' || warning || '_' END) END
    AS content_sha,
  CASE WHEN key % 7 = 0 THEN 'no model response' END AS error
FROM r"""


@register("llm_replies", _REPLY_SQL)
def q_llm_replies(spark, sf):
    req = LB.plan_requests(read_table(spark, sf, "documents"), "text", "doc_id", "qwen3:8b", 4096)
    out = LB.apply_responses(req, _replies(req))
    return out.select("key", F.sha2("content", 256).alias("content_sha"), "error")


# Article-mode block scores on the pages table ---------------------------------
_BLOCKS = r"regexp_extract_all(" + ARTICLE + r", '<(h1|p)>(?:<b>)?([^<]*)', 0)"


@register("article_blocks", f"""
WITH b AS (SELECT page_id, unnest({_BLOCKS}) AS blk, generate_subscripts({_BLOCKS}, 1) AS i FROM pages),
w AS (SELECT page_id, i, starts_with(blk, '<h1>') AS heading,
        CAST(len(list_filter(regexp_split_to_array({duck_unescape("regexp_replace(blk, '^<(h1|p)>(<b>)?', '')")},
             '[{JS_WS_CLASS}]+'), lambda x: x <> '')) AS BIGINT) AS words
      FROM b),
s AS (SELECT *, coalesce(lag(words) OVER (PARTITION BY page_id ORDER BY i), 0) AS prev_words,
                coalesce(lead(words) OVER (PARTITION BY page_id ORDER BY i), 0) AS next_words FROM w)
SELECT page_id, CAST(i AS INTEGER) AS block_no, words, CAST(0 AS BIGINT) AS link_words,
       heading OR words >= 10 OR (prev_words >= 10 AND next_words >= 10) AS kept
FROM s""")
def q_article_blocks(spark, sf):
    pages = read_table(spark, sf, "pages")
    nodes = PS.content_nodes_table(pages)
    b = CT.block_scores(CT.content_nodes(nodes))
    w = Window.partitionBy("page_id").orderBy("bpos")
    return b.select("page_id", F.row_number().over(w).alias("block_no"), "words", "link_words", "kept")


from pyspark.sql import Window  # noqa: E402


@register("webrtc_report", FX.WEBRTC_SQL)
def q_webrtc_report(spark, sf):
    nodes = _to_nodes(FX.webrtc_pages(read_table(spark, sf, "documents")))
    r = PB.webrtc_report(nodes)
    return r.select("page_id", F.coalesce("leaked_ips", F.array().cast("array<string>")).alias("leaked_ips"),
                    "webrtc_support", "spoofed", "detected_ip")


_ENVELOPE_SQL = f"""
WITH res AS ({FX.SEARCH_RESULTS_SQL}), sug AS ({FX.SEARCH_SUGGESTIONS_SQL}),
pg AS (SELECT DISTINCT CAST(doc_id // 10 AS BIGINT) AS page_id FROM documents),
a AS (SELECT page_id, string_agg('{{"url":' || CAST(to_json(url) AS VARCHAR) || ',"title":' || CAST(to_json(title) AS VARCHAR) || ',"content":' || CAST(to_json(content) AS VARCHAR)
        || coalesce(',"thumbnail":' || CAST(to_json(thumbnail) AS VARCHAR), '') || '}}', ',' ORDER BY rank) AS j FROM res GROUP BY page_id),
b AS (SELECT page_id, string_agg(CAST(to_json(text) AS VARCHAR), ',' ORDER BY rank) AS j FROM sug GROUP BY page_id)
SELECT page_id, CASE WHEN page_id % 9 = 4 THEN '{{"results":[],"suggestions":[],"captcha":true,"error":"CAPTCHA detected"}}'
  ELSE '{{"results":[' || coalesce(a.j, '') || '],"suggestions":[' || coalesce(b.j, '') || '],"captcha":false,"error":null}}' END AS envelope
FROM pg LEFT JOIN a USING (page_id) LEFT JOIN b USING (page_id)"""


@register("extract_envelopes", _ENVELOPE_SQL)
def q_extract_envelopes(spark, sf):
    """A4: one JSON envelope per search page, captcha pages included."""
    pages = FX.search_pages(read_table(spark, sf, "documents")).withColumn(
        "final_url", F.when(F.col("page_id") % 9 == 4, F.lit("https://www.google.com/sorry/index"))
        .otherwise(F.col("url")))
    ok, blocked = RQ.split_captcha(pages, PR.get_profile("google_web").captcha_patterns)
    res, sugg = PR.extract(ok, "google_web")
    return RP.extract_envelope(pages, res, sugg, blocked)


# L1-L3: streams run to the end of what is there, their sinks read back --------------
def _stream_folder(spark, name):
    from pagelens.session import scratch_folder
    return scratch_folder(spark, f"stream-{name}")


@register("stream_search_results", FX.SEARCH_RESULTS_SQL)
def q_stream_search_results(spark, sf):
    """L1: the search pages arrive as files."""
    at = _stream_folder(spark, "extract")
    pages = FX.search_pages(read_table(spark, sf, "documents"))
    pages.withColumns({"status": F.lit(200), "final_url": F.col("url")}).write.parquet(f"{at}/in")
    SJ.stream_extract(SJ.read_page_stream(spark, f"{at}/in"), "google_web", f"{at}/out", f"{at}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{at}/out/results").select(*RESULT_OUT)


@register("stream_history_latest", ORACLES["history_latest"])
def q_stream_history_latest(spark, sf):
    """L2: history entries arrive as files, a few at a time."""
    at = _stream_folder(spark, "history")
    h = _history_entries(spark, sf)
    files = spark.sparkContext.defaultParallelism     # of a batch: a task each
    h.repartition(3 * files, "id").write.parquet(f"{at}/in")
    stream = spark.readStream.schema(h.schema).option("maxFilesPerTrigger", files).parquet(f"{at}/in")
    SJ.stream_history(stream, f"{at}/table", f"{at}/checkpoint").awaitTermination()
    return SJ.read_history(spark, f"{at}/table", h.schema)


@register("stream_first_sightings", "SELECT DISTINCT user_id FROM events")
def q_stream_first_sightings(spark, sf):
    """L3: one row for each key of the stream."""
    at = _stream_folder(spark, "dedupe")
    e = read_table(spark, sf, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    e.write.parquet(f"{at}/in")
    first = SJ.stream_dedupe(spark.readStream.schema(e.schema).parquet(f"{at}/in"), "user_id", "ts", "36500 days")
    (first.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/checkpoint")
     .trigger(availableNow=True).start().awaitTermination())
    return spark.read.parquet(f"{at}/out").select("user_id")


def _event_stream(spark, sf, at):
    """The batches of ``FX.event_batches`` as files of a stream, a batch each."""
    batches = FX.event_batches(read_table(spark, sf, "events"))
    schema = None
    for batch in batches:
        schema = batch.schema
        batch.coalesce(1).write.mode("append").parquet(f"{at}/in")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/in")


def _run_append(df, at):
    (df.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/checkpoint")
     .outputMode("append").trigger(availableNow=True).start().awaitTermination())
    return df.sparkSession.read.schema(df.schema).parquet(f"{at}/out")


@register("stream_late_events", FX.LATE_BATCHES_SQL + """
SELECT event_id, late FROM arrived""")
def q_stream_late_events(spark, sf):
    """L3: events that arrive out of order and twice, with a watermark of an
    hour: those that came out once, and the side table of those dropped."""
    at = _stream_folder(spark, "late")
    stream = _event_stream(spark, sf, at)
    first = _run_append(SJ.stream_dedupe(stream, "event_id", "ts", "1 hour"), at)
    arrived = spark.read.schema(stream.schema).parquet(f"{at}/in")
    late = SJ.dropped_rows(arrived, first, "event_id").select("event_id").distinct()
    return first.select("event_id", F.lit(False).alias("late")).unionByName(late.withColumn("late", F.lit(True))).filter("event_id >= 0")


@register("stream_user_sessions", FX.LATE_BATCHES_SQL + """,
o AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS prev
      FROM (SELECT user_id, ts FROM arrived WHERE NOT late UNION ALL SELECT user_id, ts FROM arrived WHERE NOT late AND event_id % 3 = 0)),
s AS (SELECT user_id, ts, sum(CASE WHEN prev IS NULL OR ts >= prev + INTERVAL '6 hours' THEN 1 ELSE 0 END)
        OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM o)
SELECT min(ts) AS window_start, max(ts) + INTERVAL '6 hours' AS window_end, user_id, count(*) AS n
FROM s GROUP BY user_id, sid""")
def q_stream_user_sessions(spark, sf):
    """L4: sessions on a stream in append mode. They span batches and merge
    there; each comes out once the watermark has passed it, late events do not."""
    at = _stream_folder(spark, "sessions")
    stream = _event_stream(spark, sf, at)
    out = _run_append(SJ.outcome_rates(stream, "session", "6 hours", by="user_id", delay="1 hour"), at)
    ntz = lambda c: F.col(c).cast("timestamp_ntz").alias(c)
    return out.filter("user_id >= 0").select(ntz("window_start"), ntz("window_end"), "user_id", "n")


# A1, A2, B4b, B6, G1 and E16 ------------------------------------------------------------
from pagelens.sources import pages as SP  # noqa: E402


@register("scrape_replies", """
SELECT url, html, CAST(CASE WHEN page_id % 3 = 0 THEN 0 ELSE 200 END AS INTEGER) AS status FROM pages WHERE html IS NOT NULL AND html <> ''
UNION ALL SELECT url, html || '<!-- again -->', 200 FROM pages WHERE page_id % 2 = 0""")
def q_scrape_replies(spark, sf):
    """A1: replies as JSON lines; every second url is scraped twice with other
    content, every fifth reply is delivered twice. A2: none lacks html."""
    at = _stream_folder(spark, "replies")
    p = read_table(spark, sf, "pages")
    reply = p.select("url", "html", F.when(F.col("page_id") % 3 != 0, 200).cast("int").alias("status"), "page_id")
    again = reply.where("page_id % 2 = 0").select("url", F.concat("html", F.lit("<!-- again -->")).alias("html"), F.lit(200).alias("status"), "page_id")
    reply.unionByName(again).unionByName(reply.where("page_id % 5 = 0")).drop("page_id").write.json(at)
    got = SP.read_scrape_replies(spark, at)
    ok, _ = SP.split_missing_html(got)
    return ok.join(SP.check_page_ids(got).select("page_id"), "page_id", "left_anti").select("url", "html", "status")


@register("request_ranges", """
WITH r AS (SELECT page_id, CASE WHEN page_id % 6 = 5 THEN 'not a url' ELSE url END AS url, page_id % 40 - 4 AS wait,
    CASE WHEN page_id % 4 = 0 THEN NULL ELSE page_id * 977 % 130000 END AS timeout FROM pages),
c AS (SELECT page_id, CASE WHEN url = 'not a url' THEN 'invalid url' WHEN wait < 0 OR wait > 30 THEN 'wait out of range'
    WHEN timeout < 1000 OR timeout > 120000 THEN 'timeout out of range' END AS reason FROM r)
SELECT page_id, reason, reason IS NULL AS valid FROM c""")
def q_request_ranges(spark, sf):
    r = read_table(spark, sf, "pages").select(
        "page_id", F.when(F.col("page_id") % 6 == 5, "not a url").otherwise(F.col("url")).alias("url"), (F.col("page_id") % 40 - 4).alias("wait"),
        F.when(F.col("page_id") % 4 != 0, F.col("page_id") * 977 % 130000).alias("timeout"))
    return RQ.range_checks(r).select("page_id", "reason", "valid")


@register("engine_names", """
SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'ai' ELSE 'standard' END AS engine FROM documents""")
def q_engine_names(spark, sf):
    asked = F.element_at(F.array(F.lit("ai"), F.lit("AI"), F.lit(""), F.lit(None)), (F.col("doc_id") % 4 + 1).cast("int"))
    return read_table(spark, sf, "documents").select("doc_id", PS.normalise_engine(asked).alias("engine"))


@register("ai_requests", f"""
WITH c AS ({ORACLES["page_markdown"]}),
p AS (SELECT page_id, content, {_duck_strip_images("CASE WHEN length(content) > 1536 THEN left(content, 1536) ELSE content END")} AS prompt FROM c)
SELECT page_id, length(content) AS input_chars, length(content) > 1536 AS truncated, CAST(ceil(length(prompt) / 3.0) AS BIGINT) AS tokens, sha256(prompt) AS prompt_sha
FROM p""")
def q_ai_requests(spark, sf):
    """G1 end to end: pages -> clean -> markdown without images -> request."""
    out = PS.process(read_table(spark, sf, "pages"), "markdown", "ai", images=True)
    r = LB.plan_requests(out, "content", "page_id", LL.DEFAULT_MODEL, 512)
    return r.select(F.col("key").alias("page_id"), "input_chars", "truncated", "tokens", F.sha2("prompt", 256).alias("prompt_sha"))


@register("page_link_density", FX.LINK_DENSITY_SQL)
def q_page_link_density(spark, sf):
    pages = FX.content_pages(read_table(spark, sf, "documents"))
    nodes = PS.content_nodes_table(pages)
    return CT.link_density(pages, nodes).select("page_id", "link_words", "words")


# Requests with a profile, options, engine and format of their own ------------
from pagelens.operators import dom as DM  # noqa: E402
from pagelens.operators import jobs as JB  # noqa: E402

# pages of four sites in one table; an id tells the site
_SITES = 4


def _mixed_pages(spark, sf):
    docs = read_table(spark, sf, "documents")
    made = [FX.search_pages(docs), FX.news_pages(docs), FX.listing_pages(docs), FX.content_pages(docs)]
    out = None
    for i, pages in enumerate(made):
        pages = pages.select((F.col("page_id") * _SITES + i).alias("page_id"), "url", "html")
        out = pages if out is None else out.unionByName(pages)
    n = F.col("page_id")
    return out.select("page_id", "url", F.when((n % _SITES == 0) & (F.floor(n / _SITES) % 9 == 4), F.lit("https://www.google.com/sorry/index")).otherwise(F.col("url")).alias("final_url"),
                      F.when(F.floor(n / _SITES) % 13 != 5, F.col("html")).alias("html"))


def _bold_words(nodes, options):
    """A caller's profile: the headings of a page, as results."""
    rows = DM.select(nodes, options["selector"]).withColumn("tid", F.col("node_id")).select("page_id", "tid", "open_pos", "close_pos")
    text = DM.text_trim(nodes, rows).join(rows.select("page_id", "tid", "open_pos"), ["page_id", "tid"])
    res = PR._rank(text, "open_pos").select("page_id", "rank", F.lit("").alias("url"), F.col("text").alias("title"), F.lit("").alias("content"),
                                            F.lit(None).cast(PR.FIELDS_TYPE).alias("fields"), F.lit(None).cast("string").alias("thumbnail"))
    return res, PR._empty_suggestions(nodes.sparkSession)


_HASH = "sha256(coalesce(string_agg(rank || ' ' || url || ' ' || title, chr(10) ORDER BY rank), ''))"


@register("mixed_requests", f"""
WITH web AS ({FX.SEARCH_RESULTS_SQL}), news AS ({FX.NEWS_RESULTS_SQL}), listing AS ({FX.LISTING_RESULTS_SQL}),
content AS ({FX.CONTENT_MARKDOWN_SQL}),
results AS (
  SELECT page_id * {_SITES} AS page_id, rank, url, title FROM web UNION ALL SELECT page_id * {_SITES} + 1, rank, url, title FROM news
  UNION ALL SELECT page_id * {_SITES} + 2, rank, url, title FROM listing
  UNION ALL SELECT doc_id * {_SITES} + 3, 1, '', 'Head ' || doc_id FROM documents),
pages AS (
  SELECT DISTINCT CAST(doc_id // 10 AS BIGINT) * {_SITES} + i AS page_id FROM documents, (VALUES (0), (1), (2)) t(i)
  UNION ALL SELECT doc_id * {_SITES} + 3 FROM documents),
requests AS (
  SELECT page_id * 3 AS request_id, page_id, 'extract' AS kind, page_id // {_SITES} AS n, page_id % {_SITES} AS site FROM pages
  UNION ALL SELECT page_id * 3 + 1, page_id, 'render', page_id // {_SITES}, 3 FROM pages WHERE page_id % {_SITES} = 3
  UNION ALL SELECT page_id * 3 + 2, page_id, 'extract', page_id // {_SITES}, 9 FROM pages WHERE page_id % 50 = 1),
status AS (
  SELECT *, CASE WHEN site = 9 THEN 'Unknown profile: bing. Available: google_web, google_news, base, anbima_debentures, headings'
                 WHEN n % 13 = 5 THEN '{JB.NO_PAGE}' WHEN site = 0 AND n % 9 = 4 THEN 'CAPTCHA detected' END AS error FROM requests),
digests AS (SELECT page_id, count(*) AS n, {_HASH} AS hash FROM results GROUP BY page_id)
SELECT s.request_id, s.kind, s.error, CAST(CASE WHEN s.error IS NULL AND s.kind = 'extract' THEN coalesce(d.n, 0) ELSE 0 END AS BIGINT) AS results,
  CASE WHEN s.error IS NOT NULL THEN NULL WHEN s.kind = 'render' THEN sha256(c.content) ELSE coalesce(d.hash, sha256('')) END AS digest,
  CASE WHEN s.kind = 'render' AND s.error IS NULL THEN CASE WHEN s.n % 2 = 0 THEN 'ai' ELSE 'standard' END END AS engine
FROM status s LEFT JOIN digests d ON d.page_id = s.page_id AND s.kind = 'extract' LEFT JOIN content c ON c.page_id = s.n AND s.kind = 'render'""")
def q_mixed_requests(spark, sf):
    """Four profiles (one of them the caller's), two engines, captchas, failed
    pages and unknown profiles in one table; a digest for each request."""
    PR.register_profile(PR.Profile("headings", [], 1.0, extract=_bold_words))
    try:
        pages = _mixed_pages(spark, sf)
        n = F.col("page_id")
        site = (n % _SITES).cast("int")
        base = F.create_map(*[F.lit(x) for kv in FX.BASE_OPTIONS.items() for x in kv])
        common = ["page_id", "url", F.lit(None).cast("boolean").alias("article"), F.lit(None).cast("boolean").alias("images")]
        extract = pages.select((n * 3).alias("request_id"), F.lit("extract").alias("kind"), *common, F.lit(None).cast("string").alias("format"), F.lit(None).cast("string").alias("engine"),
                               F.element_at(F.array(*[F.lit(x) for x in ("google_web", "google_news", "base", "headings")]), site + 1).alias("profile"),
                               F.when(site == 2, base).when(site == 3, F.create_map(F.lit("selector"), F.lit("article h1"))).alias("options"))
        render = pages.filter(site == 3).select((n * 3 + 1).alias("request_id"), F.lit("render").alias("kind"), *common, F.lit("markdown").alias("format"),
                                                F.when(F.floor(n / _SITES) % 2 == 0, "ai").otherwise("reader").alias("engine"),
                                                F.lit(None).cast("string").alias("profile"), F.lit(None).cast("map<string,string>").alias("options"))
        unknown = extract.filter(n % 50 == 1).withColumn("request_id", n * 3 + 2).withColumn("profile", F.lit("bing"))
        done = JB.run_requests(extract.unionByName(render).unionByName(unknown), pages)
    finally:
        del PR.PROFILES["headings"]
    line = F.concat_ws(" ", F.col("rank").cast("string"), "url", "title")
    found = done.results.groupBy("request_id").agg(F.count("*").alias("n"), F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda x: x["line"]), "\n").alias("lines"))
    out = done.status.join(found, "request_id", "left").join(done.rendered.select("request_id", "content", "engine"), "request_id", "left")
    text = F.when(F.col("kind") == "render", F.col("content")).otherwise(F.coalesce("lines", F.lit("")))
    return out.select("request_id", "kind", "error", F.coalesce("n", F.lit(0)).alias("results"),
                      F.when(F.col("error").isNull(), F.sha2(text.cast("binary"), 256)).alias("digest"), "engine")


# D1 in SQL: the node table as a table function --------------------------------------------
@register("page_tag_counts", """
WITH p AS (SELECT page_id, regexp_replace(html, '<(script|style)[^>]*>.*?</(script|style)>', '<\\1>', 'gs') AS h FROM pages),
t AS (SELECT page_id, unnest(regexp_extract_all(regexp_replace(h, '<!--.*?-->', '', 'gs'), '<([A-Za-z][A-Za-z0-9]*)', 1)) AS tag FROM p)
SELECT page_id, lower(tag) AS tag, count(*) AS n FROM t GROUP BY ALL""")
def q_page_tag_counts(spark, sf):
    """LATERAL html_nodes(html): how often each tag stands on each page."""
    from pagelens.operators.nodes import register_sql
    pages = read_table(spark, sf, "pages").select("page_id", "html")
    register_sql(spark, pages)
    return spark.sql("""
        SELECT p.page_id, n.tag, count(*) AS n FROM {pages} p, LATERAL html_nodes(p.html) n WHERE n.kind = 'el' GROUP BY p.page_id, n.tag""",
                     pages=pages)


# G11 quantiles, H2 on the command line, A2 bytes ---------------------------------------------
@register("llm_token_quantiles", """
SELECT source, count(*) AS n, q, true AS within FROM documents, (VALUES (0.5), (0.9), (0.99)) t(q) GROUP BY ALL""")
def q_llm_token_quantiles(spark, sf):
    """Sketches per source and language, merged per source; each quantile is
    held against the exact ranks of all rows."""
    r = LB.plan_requests(read_table(spark, sf, "documents"), "text", "doc_id", "qwen3:8b", 4096, keep=("source", "lang"))
    found = LB.token_quantiles(LB.token_sketches(r, "source", "lang"), "source")
    # a value may hold a whole range of ranks
    ranks = r.join(F.broadcast(found.select("source", F.col("tokens").alias("t"), "q", "n")), "source").groupBy("source", "n", "q").agg(
        (F.count_if(F.col("tokens") < F.col("t")) / F.count("*")).alias("low"), (F.count_if(F.col("tokens") <= F.col("t")) / F.count("*")).alias("high"))
    within = (F.col("low") <= F.col("q") + LB.RANK_ERROR) & (F.col("high") >= F.col("q") - LB.RANK_ERROR)
    return ranks.select("source", "n", F.col("q").cast("decimal(3,2)").alias("q"), within.alias("within"))


@register("result_listing_short", _LIST_SQL.replace("   URL: ", "   ").replace(" results from google_web profile:", " results:"))
def q_result_listing_short(spark, sf):
    """H2: the command line's form."""
    pages = FX.search_pages(read_table(spark, sf, "documents")).unionByName(_ordinary(spark, sf))
    res, sugg = PR.extract(pages, "google_web")
    return RP.listing(res, sugg, "google_web", pages, short=True)


_LATIN = "regexp_replace(text, '[^\\x00-\\xFF]', '?', 'g')"


@register("page_bytes", f"""
SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'utf-8' WHEN 1 THEN 'utf-16le' WHEN 2 THEN 'utf-16be' ELSE 'windows-1252' END AS charset,
  sha256(CASE WHEN doc_id % 5 = 3 THEN '<meta charset="ISO-8859-1">' ELSE '' END || CASE WHEN doc_id % 5 >= 3 THEN '\u00fc' || {_LATIN} ELSE coalesce(text, '') END) AS html_sha
FROM documents WHERE text IS NOT NULL""")
def q_page_bytes(spark, sf):
    """A2: texts as bytes of four charsets, named by a mark, a meta tag or
    nothing, decoded again."""
    d = read_table(spark, sf, "documents").filter("text IS NOT NULL").select("doc_id", "text")
    k = F.col("doc_id") % 5
    latin = F.concat(F.lit("\u00fc"), F.regexp_replace("text", r"[^\x00-\xFF]", "?"))
    content = (F.when(k == 0, F.encode("text", "UTF-8")).when(k == 1, F.concat(F.unhex(F.lit("FFFE")), F.encode("text", "UTF-16LE")))
               .when(k == 2, F.concat(F.unhex(F.lit("FEFF")), F.encode("text", "UTF-16BE")))
               .when(k == 3, F.encode(F.concat(F.lit('<meta charset="ISO-8859-1">'), latin), "ISO-8859-1")).otherwise(F.encode(latin, "ISO-8859-1")))
    d = d.select("doc_id", content.alias("content")).withColumn("charset", SP.charset_of("content"))
    return d.select("doc_id", "charset", F.sha2(SP.decode_html("content", "charset").cast("binary"), 256).alias("html_sha"))
