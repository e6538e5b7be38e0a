"""Structured extraction profiles as DataFrame plans.

``extract(pages, profile, options)`` returns two tables:

* results ``(page_id, rank, url, title, content, fields, thumbnail)``;
  ``content`` is text, ``fields`` a string map (the card profile's
  structured content; the reference's string-or-record union is split);
* suggestions ``(page_id, rank, text)``.

A container that fails a rule is skipped, never the page. Ranks follow
document order of the containers after the per-page dedupe.

Physical plan: pages -> necessary-condition prefilter on raw html (native
``contains``) -> D1 node table (cut to the shared checkpoint folder) -> one
scan of it that tags the rows of all selectors at once -> windows and
aggregates keyed by ``page_id``, which share one shuffle. No joins; no ordered
aggregate crosses pages.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagelens.functions.text import (JS_WS_CLASS, base64url_to_latin1, decode_uri_component,
                                     js_collapse_ws, js_trim, latin1_to_utf8)
from pagelens.operators import dom
from pagelens.operators.nodes import Indexed, ids_differ, node_table, page_index

RESULT_COLS = ["page_id", "rank", "url", "title", "content", "fields", "thumbnail"]
FIELDS_TYPE = T.MapType(T.StringType(), T.StringType())


@dataclass
class Profile:
    name: str
    captcha_patterns: list
    wait_after_load: float
    wait_for_selector: str | None = None
    # necessary condition on raw html: pages without it cannot yield rows
    prefilter: list = field(default_factory=list)
    # (nodes, options) -> (results, suggestions), as DataFrames
    extract: Callable | None = None
    # elements of a page index; ``extract`` then takes that in place of the node table too
    index: dict | None = None


# The profile catalogue (name, captcha URL patterns, wait
# selector, wait seconds), listed in registry order.
PROFILES = {
    "google_web": Profile("google_web", ["/sorry", "consent.google", "recaptcha"], 2,
                          "a h3", ["MjjYud", "oIk2Cb", "ouy7Mc"]),
    "google_news": Profile("google_news", ["/sorry", "consent.google", "recaptcha"], 3,
                           None, ["./read/"]),
    "base": Profile("base", [], 2, None, []),
    "anbima_debentures": Profile("anbima_debentures", [], 3,
                                 "li.list-item__container", ["list-item__container"]),
}


def register_profile(profile: Profile) -> None:
    """add a caller's profile, or replace one. Its ``extract`` gets the
    node table and the options and returns results (``RESULT_COLS``) and
    suggestions (``page_id, rank, text``)."""
    if profile.extract is None:
        raise ValueError(f"profile {profile.name} has no extract function")
    PROFILES[profile.name] = profile


def get_profile(name):
    """lookup by name; unknown -> None."""
    return PROFILES.get(name) if name else None


def list_profiles():
    return list(PROFILES)


def profile_catalogue(spark) -> DataFrame:
    """F21 as a small table (broadcast side of B4/B5 joins)."""
    rows = [(i, p.name, p.captcha_patterns, p.wait_for_selector, float(p.wait_after_load))
            for i, p in enumerate(PROFILES.values())]
    return spark.createDataFrame(
        rows, "ord int, profile string, captcha_patterns array<string>, "
              "wait_for_selector string, wait_after_load double")


# ---------------------------------------------------------------------------
def _empty_results(spark):
    return spark.createDataFrame([], T.StructType([
        T.StructField("page_id", T.LongType()), T.StructField("rank", T.IntegerType()),
        T.StructField("url", T.StringType()), T.StructField("title", T.StringType()),
        T.StructField("content", T.StringType()), T.StructField("fields", FIELDS_TYPE),
        T.StructField("thumbnail", T.StringType())]))


def _empty_suggestions(spark):
    return spark.createDataFrame([], "page_id long, rank int, text string")


def _rank(df: DataFrame, pos: str) -> DataFrame:
    w = Window.partitionBy("page_id").orderBy(pos)
    return df.withColumn("rank", F.row_number().over(w))


def _dedupe_first(df: DataFrame, key: str, pos: str) -> DataFrame:
    """first row per (page, key) in document order."""
    w = Window.partitionBy("page_id", key).orderBy(pos)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def _ordered_texts(rows: DataFrame, cond: Column) -> DataFrame:
    """trimmed non-empty texts of the rows of ``cond``, ranked."""
    rows = rows.filter(cond).select("page_id", "open_pos", js_trim("content").alias("text")).filter(F.col("text") != "")
    return _rank(rows, "open_pos").select("page_id", "rank", "text")


SPOT = ["page_id", "node_id", "open_pos", "close_pos", "kind", "tag", "text"]
TEXT_OR_SCRIPT = (("kind", "text"), ("tag", "script"))


def _rows(nodes: DataFrame, flags: dict, **more) -> DataFrame:
    """One scan of the node table: the texts, the scripts and the rows that
    have a flag, with the flags as columns and what else is asked for."""
    wanted = F.lit(False)
    for col, value in TEXT_OR_SCRIPT:
        wanted = wanted | F.coalesce(F.col(col) == value, F.lit(False))
    for cond in flags.values():
        wanted = wanted | cond
    return nodes.filter(wanted).select(*SPOT, *[c.alias(n) for n, c in {**flags, **more}.items()])


def _one(sel: str) -> Column:
    return dom.compound_pred(dom.parse_selector(sel)[0][0][1])


# ---------------------------------------------------------------------------
# google_web
# ---------------------------------------------------------------------------
GOOGLE_REDIRECT_RE = r"^/url\?q=([^&]+)"


def clean_google_url(c: Column) -> Column:
    """de-track ``/url?q=...``; a bad escape gives NULL (row dropped)."""
    m = F.regexp_extract(c, GOOGLE_REDIRECT_RE, 1)
    return F.when(c.rlike(GOOGLE_REDIRECT_RE), decode_uri_component(m)).otherwise(c)


def _google_web(nodes: DataFrame, options: dict | None = None):
    src = F.coalesce(F.col("attrs")["src"], F.lit(""))
    flags = {
        "cont": _one(".MjjYud"), "rso": _one("#rso"), "link": _one("a"), "h3": _one("h3"),
        "snip1": _one('[data-sncf*="1"]'), "snip2": _one('[data-snf="nke7rc"]'), "snip3": _one(".VwiC3b"),
        "img": _one("img:not(.XNo5Ab)") & (src.startswith("http") | (src.startswith("data:image") & (F.length(src) > 200))),
        "sugg1": _one(".oIk2Cb"), "sugg2": _one(".ouy7Mc")}
    col = F.col
    rows = _rows(nodes, flags, href=F.col("attrs")["href"], src=src)
    # what lies above: F4 the container's place, F5 `a h3` with the link around it, F11 links
    around = F.max(F.when(col("link"), F.struct("close_pos", "href"))).over(dom._before())
    last = F.last(F.when(col("link"), F.struct("close_pos", "href")), ignorenulls=True).over(dom._before())
    rows = rows.withColumns({
        "in_rso": dom.inside(col("rso")), "title": col("h3") & dom.inside(col("link")),
        "first": col("link") & dom.inside(col("sugg1")), "second": col("link") & dom.inside(col("sugg2")),
        # links nest in broken pages only; then the outermost stands for one that has ended
        "link_href": F.when(last["close_pos"] > col("open_pos"), last["href"]).otherwise(around["href"])})
    rows = dom.with_text(rows, col("title") | col("snip1") | col("snip2") | col("snip3") | col("first") | col("second"))

    # F5/F8/F9 per container: the first title, the first snippet of each strategy, the first usable image
    res = rows.withColumns({
        "t": dom.next_one(col("title"), "content", "link_href"), "thumb": dom.next_one(col("img"), "src"),
        **{f"s{i}": dom.next_one(col(f"snip{i}"), "content_noscript") for i in (1, 2, 3)},
        "page_rso": F.max(col("cont") & col("in_rso")).over(Window.partitionBy("page_id"))})
    res = res.filter(col("cont") & (col("in_rso") | ~col("page_rso")) & col("t").isNotNull()).select(
        "page_id", "open_pos", js_trim("t.content").alias("title"), clean_google_url(F.coalesce("t.link_href", F.lit(""))).alias("url"),
        # the first strategy that is there wins, also with an empty text
        js_collapse_ws(F.coalesce(*[F.col(f"s{i}.content_noscript") for i in (1, 2, 3)], F.lit(""))).alias("content"),
        col("thumb.src").alias("thumbnail"))
    res = res.filter((col("title") != "") & col("url").isNotNull() & col("url").startswith("http"))
    res = _dedupe_first(res, "url", "open_pos")
    res = _rank(res, "open_pos").select(
        "page_id", "rank", "url", "title", "content", F.lit(None).cast(FIELDS_TYPE).alias("fields"),
        F.when(col("thumbnail") != "", col("thumbnail")).alias("thumbnail"))

    # the second selector only where the first gives no text
    given = F.coalesce(F.max(col("first") & (js_trim("content") != "")).over(Window.partitionBy("page_id")), F.lit(False))
    links = rows.filter(col("first") | col("second")).withColumn("given", given)
    return res, _ordered_texts(links, F.when(col("given"), col("first")).otherwise(col("second")))


# ---------------------------------------------------------------------------
# google_news
# ---------------------------------------------------------------------------
def decode_news_link(link: Column) -> Column:
    """payload after the first /read/ (else /articles/) up to '?',
    base64url bytes, from 'http' up to byte 0xD2, read as UTF-8; any failure
    -> the link."""
    after = lambda mark: F.substring(link, F.locate(mark, link) + len(mark), F.lit(1 << 30))
    after_read, after_art = after("/read/"), after("/articles/")
    part = F.when(F.locate("/read/", link) > 0, after_read).when(
        F.locate("/articles/", link) > 0, after_art)
    part = F.substring_index(part, "?", 1)
    raw = base64url_to_latin1(part)
    at = F.locate("http", raw)
    tail = F.when(at > 0, F.substring(raw, at, F.lit(1 << 30)))
    cut = F.substring_index(tail, "Ò", 1)
    decoded = latin1_to_utf8(cut)
    return F.when((part.isNotNull()) & (part != "") & decoded.isNotNull(), decoded).otherwise(link)


def _google_news(nodes: DataFrame, options: dict | None = None):
    col = F.col
    flags = {"cand": _one('a[href^="./read/"]'), "by": _one("[data-n-tid]"), "at": _one("time"), "img": _one("img"),
             "box": F.col("kind").isin("el", "doc")}
    rows = _rows(nodes, flags, href=F.col("attrs")["href"], src=F.coalesce(F.col("attrs")["src"], F.lit("")))
    rows = dom.with_text(rows, col("cand") | col("by") | col("at"))
    link = F.concat(F.lit("https://news.google.com"), F.expr("substring(href, 2)"))
    title = js_trim("content")
    rows = rows.withColumn("title", F.when(col("cand") & (F.length(title) >= 10), title))
    rows = rows.withColumn("url", F.when(col("title").isNotNull(), decode_news_link(link)))
    # F15 the first of each link; F16/F17 what comes first inside each element
    rows = rows.withColumns({
        "keep": col("url").isNotNull() & (F.row_number().over(Window.partitionBy("page_id", "url").orderBy("open_pos")) == 1),
        "by_first": dom.next_one(col("by"), "content"), "at_first": dom.next_one(col("at"), "content"), "img_first": dom.next_one(col("img"), "src")})
    # the walk: up to five elements above; the document keeps candidates that have none
    up = dom.pair_up(rows.select("page_id", "open_pos", "close_pos", "node_id", "kind", "box", "keep", "url", "title", "by_first", "at_first", "img_first"),
                     col("keep"), col("box"), ["kind", "by_first", "at_first", "img_first"], nearest=5)

    def pick(value, good, levels=5):
        ok = (col("up.kind") == "el") & (col("level") <= levels) & good
        return F.min_by(F.when(ok, value), F.when(ok, col("level")))
    by, at, img = js_trim("up.by_first.content"), js_trim("up.at_first.content"), col("up.img_first.src")
    res = up.groupBy("page_id", "node_id", "open_pos", "url", "title").agg(
        pick(by, by != "").alias("source"), pick(at, at != "").alias("pub_time"), pick(img, img.startswith("http"), 3).alias("thumbnail"))
    res = res.withColumn("content", F.concat_ws(" / ", "source", "pub_time"))
    res = _rank(res, "open_pos").select(
        "page_id", "rank", "url", "title", "content", F.lit(None).cast(FIELDS_TYPE).alias("fields"), "thumbnail")
    return res, _empty_suggestions(nodes.sparkSession)


# ---------------------------------------------------------------------------
# anbima_debentures
# ---------------------------------------------------------------------------
# Card label (lower-cased) -> output key.
DEBENTURE_FIELDS = [
    ("emissor", "emissor"),
    ("remuneração", "remuneracao"),
    ("data de vencimento", "vencimento"),
    ("duration", "duration"),
    ("setor", "setor"),
    ("data da emissão", "emissao"),
    ("pu par", "pu_par"),
    ("pu indicativo", "pu_indicativo"),
]
DEBENTURE_KEYS = [k for _, k in DEBENTURE_FIELDS]


#: What the cards are made of, for a page in a row (``nodes.page_index``).
DEBENTURE_INDEX = {
    "card": Indexed("li", ("list-item__container",), holds=("head", "link", "list")),
    "head": Indexed("h2", ("list-item__title",), holds=("link", "card")),
    "link": Indexed("a", attrs=("href",), holds=("texts",)),
    "list": Indexed("dl", holds=("dt", "dd")),
    "dt": Indexed("dt", holds=("texts",)),
    "dd": Indexed("dd", holds=("texts",)),
}


def _ranked_cards(nodes: DataFrame) -> DataFrame:
    """The cards with their rank in the page, of a node table or a page index."""
    return _indexed_cards(nodes) if "node_id" not in nodes.columns else _rank(_debenture_cards(nodes), "pos")


def _indexed_cards(pages: DataFrame) -> DataFrame:
    """As ``_debenture_cards``, of the pages of an index, with ``rank``: each
    page is one row up to its cards."""
    col = F.col

    def inside(name, of):
        return F.slice(col(name), of[f"{name}_from"] + 1, of[f"{name}_to"] - of[f"{name}_from"])

    def content(of):
        return F.array_join(inside("texts", of), "")

    def first(name, of):
        return F.when(of[f"{name}_from"] < of[f"{name}_to"], F.get(col(name), of[f"{name}_from"]))
    fmap = F.create_map(*[x for lab, key in DEBENTURE_FIELDS for x in (F.lit(lab), F.lit(key))])

    # each step is a list of its own, so nothing is worked out twice; F19: a list's first cells
    cells = F.transform("list", lambda dl: F.struct(first("dt", dl).alias("dt"), first("dd", dl).alias("dd")))
    cells = F.transform(cells, lambda c: F.struct(F.lower(js_trim(content(c["dt"]))).alias("label"), js_trim(F.coalesce(content(c["dd"]), F.lit(""))).alias("value")))
    fields = F.transform(cells, lambda c: F.struct(fmap[c["label"]].alias("key"), F.when(c["value"] == "-", F.lit("")).otherwise(c["value"]).alias("text")))
    rows = pages.select("*", F.filter("head", lambda h: h["card_from"] < h["card_to"]).alias("around"), fields.alias("fields"))

    def link_of(card, i):
        # the first link that lies in a heading: of one inside the card, or any if a heading lies around the card
        heads = F.filter(inside("head", card), lambda h: h["link_from"] < h["link_to"])
        around = F.exists("around", lambda h: (h["card_from"] <= i) & (i < h["card_to"]))
        return F.struct(F.when(around, first("link", card)).otherwise(F.get(col("link"), F.get(heads, F.lit(0))["link_from"])).alias("a"),
                        F.slice("fields", card["list_from"] + 1, card["list_to"] - card["list_from"]).alias("fields"))
    cards = F.transform(F.transform("card", link_of), lambda c: F.struct(
        c["a"]["href"].alias("href"), F.split(js_trim(content(c["a"])), f"[{JS_WS_CLASS}]")[0].alias("title"), c["fields"].alias("fields")))
    cards = F.filter(cards, lambda c: (c["title"] != "") & (F.coalesce(c["href"], F.lit("")) != ""))
    rows = rows.select("page_id", F.posexplode(cards).alias("at", "card"))
    # last duplicate label wins
    last = lambda k: F.try_element_at(F.filter("card.fields", lambda f: f["key"] == k), F.lit(-1))["text"]
    return rows.select("page_id", (col("at") + 1).alias("rank"), "card.href", "card.title", *[last(k).alias(k) for k in DEBENTURE_KEYS])


def _debenture_cards(nodes: DataFrame) -> DataFrame:
    """One row per card: page_id, pos, href, title (ticker) and the value of
    each known key, from one scan of the node table."""
    col = F.col
    flags = {"card": _one("li.list-item__container"), "head": _one("h2.list-item__title"), "link": _one("a"),
             "list": _one("dl"), "dt": _one("dt"), "dd": _one("dd")}
    rows = _rows(nodes, flags, href=F.col("attrs")["href"])
    rows = dom.with_text(rows, col("link") | col("dt") | col("dd"), in_head=col("head"))
    rows = rows.withColumn("link", col("link") & col("in_head"))
    # a card's first link, a list's first cells
    rows = rows.withColumns({"a": dom.next_one(col("link"), "href", "content"), "label": dom.next_one(col("dt"), "content"),
                             "value": dom.next_one(col("dd"), "content")})
    # each list with the cards around it, each card with itself
    listed = col("list") & col("label").isNotNull()
    up = dom.pair_up(rows.select("page_id", "node_id", "open_pos", "close_pos", "card", "list", "a", "label", "value"),
                     listed, col("card"), [F.col("node_id").alias("cid")], itself=col("card"))
    fmap = F.create_map(*[x for lab, key in DEBENTURE_FIELDS for x in (F.lit(lab), F.lit(key))])
    value = js_trim(F.coalesce("value.content", F.lit("")))
    up = up.withColumn("key", F.when(listed, fmap[F.lower(js_trim("label.content"))])).withColumn("text", F.when(value == "-", F.lit("")).otherwise(value))
    own = col("node_id") == col("up.cid")
    # last duplicate label wins
    cards = up.groupBy("page_id", "up.cid").agg(
        F.max(F.when(own, col("open_pos"))).alias("pos"), F.first(F.when(own, col("a")), ignorenulls=True).alias("a"),
        *[F.max_by(F.when(col("key") == k, col("text")), F.when(col("key") == k, col("open_pos"))).alias(k) for k in DEBENTURE_KEYS])
    ticker = F.split(js_trim("a.content"), f"[{JS_WS_CLASS}]")[0]
    return cards.select("page_id", "pos", col("a.href").alias("href"), ticker.alias("title"), *DEBENTURE_KEYS).filter(
        (col("title") != "") & (F.coalesce("href", F.lit("")) != ""))


def _anbima(nodes: DataFrame, options: dict | None = None):
    known = F.filter(F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).alias("value")) for k in DEBENTURE_KEYS]), lambda x: x["value"].isNotNull())
    res = _ranked_cards(nodes).select(
        "page_id", "rank", F.col("href").alias("url"), "title",
        F.lit(None).cast("string").alias("content"), F.map_from_entries(known).alias("fields"),
        F.lit(None).cast("string").alias("thumbnail"))
    return res, _empty_suggestions(nodes.sparkSession)


def debenture_table(nodes: DataFrame) -> DataFrame:
    """the card fields as typed columns (absent field -> NULL)."""
    return _ranked_cards(nodes).select(
        "page_id", "rank", F.col("href").alias("url"), F.col("title").alias("ticker"), *DEBENTURE_KEYS)


# ---------------------------------------------------------------------------
# base (F1-F3)
# ---------------------------------------------------------------------------
BASE_SELECTORS = {"is_result": "results_selector", "is_url": "url_selector", "is_title": "title_selector",
                  "is_content": "content_selector", "is_thumb": "thumbnail_selector", "is_sugg": "suggestion_selector"}


def _base(nodes: DataFrame, options: dict | None = None):
    given = {name: (options or {}).get(key) or "" for name, key in BASE_SELECTORS.items()}
    spark = nodes.sparkSession
    if not (given["is_result"] and given["is_url"] and given["is_title"]):
        return _empty_results(spark), _empty_suggestions(spark)
    used = {name: sel for name, sel in given.items() if sel}
    col = F.col
    wanted = (F.col("kind") == "text") | F.coalesce(F.col("tag") == "script", F.lit(False)) | dom.any_compound(*used.values())
    rows = dom.mark(nodes.filter(wanted), **used).select(
        *SPOT, F.col("attrs")["href"].alias("href"), F.col("attrs")["src"].alias("src"),
        *[F.col(n) if n in used else F.lit(False).alias(n) for n in BASE_SELECTORS])
    rows = dom.with_text(rows, col("is_url") | col("is_title") | col("is_content") | col("is_sugg"))
    res = rows.withColumns({
        "u": dom.next_one(col("is_url"), "href", "content"), "t": dom.next_one(col("is_title"), "content"),
        "c": dom.next_one(col("is_content"), "content"), "th": dom.next_one(col("is_thumb"), "src")})
    url = F.when(F.coalesce("u.href", F.lit("")) != "", col("u.href")).otherwise(js_trim("u.content"))
    res = res.filter("is_result").select(
        "page_id", "open_pos", url.alias("url"), js_trim("t.content").alias("title"), js_trim(F.coalesce("c.content", F.lit(""))).alias("content"),
        F.when(col("th.src") != "", col("th.src")).alias("thumbnail")).filter((col("url") != "") & (col("title") != ""))
    res = _rank(res, "open_pos").select("page_id", "rank", "url", "title", "content", F.lit(None).cast(FIELDS_TYPE).alias("fields"), "thumbnail")
    sugg = _ordered_texts(rows, col("is_sugg")) if given["is_sugg"] else _empty_suggestions(spark)
    return res, sugg


for _name, _function in (("google_web", _google_web), ("google_news", _google_news), ("base", _base), ("anbima_debentures", _anbima)):
    PROFILES[_name].extract = _function
PROFILES["anbima_debentures"].index = DEBENTURE_INDEX


# Character references of letters, '.', '/', '-' and '_'.
ENCODED_RE = "&(#|period;|sol;|lowbar;|UnderBar;)"


def prefilter_condition(profile: Profile) -> Column | None:
    """Rule 1 of the plan: a native necessary condition on raw html. The
    literals are attribute text, which may also be written with character
    references; of those that stand for a character of a literal, numeric ones
    and the names below exist, so any of them lets a page through."""
    if not profile.prefilter:
        return None
    cond = F.col("html").rlike(ENCODED_RE)
    for lit in profile.prefilter:
        cond = cond | F.col("html").contains(lit)
    return cond


def profile_nodes(pages: DataFrame, profile: Profile, prefilter: bool = True,
                  materialize: bool = True) -> DataFrame:
    """The node table of the pages, or, for a profile with an index, the index
    of its pages, which is made as it is read (``nodes.page_index``)."""
    src = pages.select("page_id", "html")
    cond = prefilter_condition(profile) if prefilter else None
    if cond is not None:
        src = src.filter(cond)
    if profile.index is not None and ids_differ(pages):
        return page_index(src, profile.index)
    return node_table(src, "nodes", materialize)


def extract_nodes(nodes: DataFrame, profile_name: str, options: dict | None = None):
    """A registered profile's function on the node table."""
    profile = get_profile(profile_name)
    if profile is None:
        raise ValueError(f"Unknown profile: {profile_name}. Available: {', '.join(list_profiles())}")
    return profile.extract(nodes, options)


def extract(pages: DataFrame, profile_name: str, options: dict | None = None,
            prefilter: bool = True, materialize: bool = True):
    """F: ``pages(page_id, html, ...)`` -> (results, suggestions)."""
    profile = get_profile(profile_name)
    if profile is None:
        raise ValueError(f"Unknown profile: {profile_name}. Available: {', '.join(list_profiles())}")
    if profile_name == "base":
        o = options or {}
        if not (o.get("results_selector") and o.get("url_selector") and o.get("title_selector")):
            spark = pages.sparkSession
            return _empty_results(spark), _empty_suggestions(spark)
    return profile.extract(profile_nodes(pages, profile, prefilter, materialize), options)
