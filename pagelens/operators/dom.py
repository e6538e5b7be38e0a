"""Selection and navigation on the node table.

Everything here is DataFrame work keyed by ``page_id``. Subtrees are intervals
that nest, so one pass over a page in document order answers what would else
be a range join:

* a compound selector (tag, ``.class``, ``#id``, attribute tests, ``:not``) is
  a filter on element rows;
* "has an ancestor that matches" is a running maximum: of the matches that
  began before, the one that ends last must end after the node (``inside``);
* "first match in the container" is the nearest one that begins after it, a
  running value in backward order, if it begins before the container ends
  (``next_one``);
* "which containers is it in" (``pair_up``, the interval join) counts how many
  containers are open at each place; the one at each depth is the last that
  opened there. It makes one row for each pair that exists and none beside;
* a subtree's text is the ordered concatenation of its text nodes (``with_text``).

All windows share the partitioning by page: a query over one page table needs
one shuffle, however many steps it takes, and linear rows at any depth of tags.

Selectors are small strings; the compiler below only covers the forms the
profiles use (and users may pass to the base profile).
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelens.functions.text import js_collapse_ws, js_trim

KEY = ["page_id", "node_id"]


# ---------------------------------------------------------------------------
# selector compiler (CSS subset)
# ---------------------------------------------------------------------------
@dataclass
class Compound:
    tag: str | None = None
    ids: list = field(default_factory=list)
    classes: list = field(default_factory=list)
    attrs: list = field(default_factory=list)      # (name, op, value)
    nots: list = field(default_factory=list)       # Compound
    nth: list = field(default_factory=list)        # (a, b, from the end): place among siblings is a*n + b

    def tag_only(self) -> bool:
        return self.tag is not None and not (self.ids or self.classes or self.attrs or self.nots or self.nth)


_TOKEN = re.compile(
    r"""\s*(?:
        (?P<comb>[>+~,])
      | (?P<tag>\*|[A-Za-z][A-Za-z0-9-]*)
      | \.(?P<cls>-?[_A-Za-z][_A-Za-z0-9-]*)
      | \#(?P<id>-?[_A-Za-z0-9][_A-Za-z0-9-]*)
      | \[\s*(?P<an>[^\s~|^$*=\]]+)\s*(?:(?P<op>[~|^$*]?=)\s*(?:"(?P<dq>[^"]*)"|'(?P<sq>[^']*)'|(?P<bare>[^\]\s]+))\s*)?\]
      | :(?P<place>first-child|last-child|only-child)
      | :nth-(?P<last>last-)?child\((?P<nth>[^)]*)\)
      | :not\((?P<not>[^)]*)\)
    )""", re.X)
_NTH = re.compile(r"(?:(?P<a>[+-]?\d*)n)?\s*(?P<b>[+-]?\s*\d+)?", re.I)


def _nth(text: str) -> tuple[int, int]:
    """``an+b`` of a structural pseudo-class."""
    text = text.strip().lower()
    if text in ("odd", "even"):
        return 2, int(text == "odd")
    m = _NTH.fullmatch(text)
    if not m or (m.group("a") is None and m.group("b") is None):
        raise ValueError(f"unsupported place: {text!r}")
    a = m.group("a")
    a = 0 if a is None else int(a + "1") if a in ("", "+", "-") else int(a)
    return a, int((m.group("b") or "0").replace(" ", ""))


def _parse_compound_list(text: str):
    """-> list of groups, each a list of (combinator, Compound)."""
    groups, chain, cur, comb = [], [], None, " "
    pos = 0
    text = text.strip()
    while pos < len(text):
        m = _TOKEN.match(text, pos)
        if not m:
            raise ValueError(f"unsupported selector: {text!r} at {pos}")
        ws = m.group(0)[: len(m.group(0)) - len(m.group(0).lstrip())]
        if ws and cur is not None and m.group("comb") is None:
            chain.append((comb, cur))
            cur, comb = None, " "
        pos = m.end()
        if m.group("comb"):
            c = m.group("comb")
            if cur is not None:
                chain.append((comb, cur))
                cur = None
            if c == ",":
                groups.append(chain)
                chain, comb = [], " "
            else:
                comb = c
            continue
        if cur is None:
            cur = Compound()
        if m.group("tag"):
            cur.tag = None if m.group("tag") == "*" else m.group("tag").lower()
        elif m.group("cls"):
            cur.classes.append(m.group("cls"))
        elif m.group("id"):
            cur.ids.append(m.group("id"))
        elif m.group("an"):
            val = m.group("dq") if m.group("dq") is not None else (
                m.group("sq") if m.group("sq") is not None else m.group("bare"))
            cur.attrs.append((m.group("an").lower(), m.group("op"), val))
        elif m.group("place"):
            if m.group("place") != "last-child":
                cur.nth.append((0, 1, False))
            if m.group("place") != "first-child":
                cur.nth.append((0, 1, True))
        elif m.group("nth") is not None:
            cur.nth.append((*_nth(m.group("nth")), m.group("last") is not None))
        elif m.group("not") is not None:
            inner = _parse_compound_list(m.group("not"))
            if len(inner) != 1 or len(inner[0]) != 1:
                raise ValueError(":not() takes one compound selector")
            cur.nots.append(inner[0][0][1])
    if cur is not None:
        chain.append((comb, cur))
    if chain:
        groups.append(chain)
    return groups


def parse_selector(sel: str):
    return _parse_compound_list(sel)


def compound_pred(c: Compound) -> Column:
    """A compound selector as a filter on element rows."""
    p = F.col("kind") == "el"
    if c.tag:
        p = p & (F.col("tag") == c.tag)
    for i in c.ids:
        p = p & (F.col("attrs")["id"] == i)
    for k in c.classes:
        p = p & F.array_contains("classes", k)
    for name, op, val in c.attrs:
        a = F.col("attrs")[name]
        if op is None:
            p = p & a.isNotNull()
        elif op == "=":
            p = p & (a == val)
        elif op == "^=":
            p = p & (a.startswith(val) if val else F.lit(False))
        elif op == "$=":
            p = p & (a.endswith(val) if val else F.lit(False))
        elif op == "*=":
            p = p & (a.contains(val) if val else F.lit(False))
        elif op == "~=":
            p = p & F.array_contains(F.split(a, r"\s+"), val)
        elif op == "|=":
            p = p & ((a == val) | a.startswith(val + "-"))
    for step, first, from_end in c.nth:
        off = (F.col("_siblings") - F.col("_place") + 1 if from_end else F.col("_place")) - first
        p = p & ((off == 0) if step == 0 else ((off % step == 0) & (off * (1 if step > 0 else -1) >= 0)))
    for n in c.nots:
        p = p & ~F.coalesce(compound_pred(n), F.lit(False))
    return F.coalesce(p, F.lit(False))


def _needs_siblings(groups) -> bool:
    return any(comb in "+~" or c.nth or any(n.nth for n in c.nots) for g in groups for comb, c in g)


def elements(nodes: DataFrame) -> DataFrame:
    return nodes.filter(F.col("kind") == "el")


# ---------------------------------------------------------------------------
# one pass in document order
# ---------------------------------------------------------------------------
def _before(*by, order=("open_pos",)):
    return Window.partitionBy("page_id", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)


def _upto(*by, order=("open_pos",)):
    return Window.partitionBy("page_id", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)


def inside(cond: Column) -> Column:
    """D3: whether a row lies strictly inside an element of which ``cond``
    holds. Rows are the nodes of whole pages, or those that matter: the
    elements of ``cond`` and the rows that are asked about."""
    return F.coalesce(F.max(F.when(cond, F.col("close_pos"))).over(_before()) > F.col("open_pos"), F.lit(False))


def next_one(cond: Column, *cols) -> Column:
    """D4 + D5: struct of the first row in document order of which ``cond``
    holds that lies inside the row's element; NULL when none does."""
    w = _before(order=(F.desc("open_pos"),))
    found = F.last(F.when(cond, F.struct(F.col("open_pos").alias("pos"), *cols)), ignorenulls=True).over(w)
    return F.when(found["pos"] < F.col("close_pos"), found)


def pair_up(rows: DataFrame, inner: Column, outer: Column, cols, nearest: int | None = None, itself: Column | None = None) -> DataFrame:
    """The interval join of one page table with itself: every row of ``inner``
    with every element of ``outer`` that it lies strictly inside, as the input
    columns, ``up`` (a struct of the element's ``cols``) and ``level`` (1: the
    nearest). ``nearest`` keeps that many levels; elements of ``outer`` for
    which ``itself`` holds count as inside themselves too."""
    # the page stays a column of its own: then Spark knows the partitioning further on
    columns = [c for c in rows.columns if c != "page_id"]
    own = F.struct(*columns)
    at = lambda pos, turn, step: F.struct(F.col(pos).alias("pos"), F.lit(turn).alias("turn"), F.lit(step).alias("step"))
    wide = outer & (F.col("close_pos") > F.col("open_pos"))
    events = [F.when(inner, at("open_pos", 0, 0)), F.when(wide, at("open_pos", 1, 1)), F.when(wide, at("close_pos", 0, -1))]
    if itself is not None:
        events.append(F.when(wide & itself, at("open_pos", 2, 0)))
    rows = rows.filter(F.coalesce(inner, F.lit(False)) | F.coalesce(wide, F.lit(False)))
    ev = rows.select("page_id", F.explode(F.filter(F.array(*events), lambda x: x.isNotNull())).alias("_at"), own.alias("_in"), F.struct(*cols).alias("_up"))
    step, order = F.col("_at.step"), ("_at.pos", "_at.turn")
    # how many are open; of a row's two roles the inner one comes first, so it is not inside itself
    ev = ev.withColumn("_open", F.sum("_at.step").over(_upto(order=order))).filter(step >= 0)
    low = F.lit(1) if nearest is None else F.greatest(F.lit(1), F.col("_open") - (nearest - 1))
    depth = F.when(step == 1, F.array("_open")).when(F.col("_open") > 0, F.sequence(low.cast("long"), F.col("_open")))
    ev = ev.select("page_id", "_at", "_in", "_open", F.when(step == 1, F.col("_up")).alias("_up"), F.explode(depth).alias("_depth"))
    ev = ev.withColumn("up", F.last("_up", ignorenulls=True).over(_upto("_depth", order=order)))
    return ev.filter(step == 0).select("page_id", *[F.col("_in")[c].alias(c) for c in columns], "up", (F.col("_open") - F.col("_depth") + 1).alias("level"))


def with_text(rows: DataFrame, targets: Column, **within: Column) -> DataFrame:
    """The rows that are no texts, each with ``content``: the texts of its
    subtree in document order, if ``targets`` holds of it (else empty), and
    ``content_noscript`` without the text of scripts. The rows hold the texts
    and the script elements of the pages. ``within`` adds columns: whether a row
    lies strictly inside an element of which the condition holds (``inside``,
    in the same pass)."""
    columns = [c for c in rows.columns if c not in ("page_id", "text")]
    is_text = F.col("kind") == "text"
    own = F.when(~is_text, F.struct(*columns))
    at = lambda pos, step: F.struct(F.col(pos).alias("pos"), F.lit(step).alias("step"))
    wide = F.coalesce(targets, F.lit(False)) & (F.col("close_pos") > F.col("open_pos"))
    events = F.when(wide, F.array(at("open_pos", 1), at("close_pos", -1))).otherwise(F.array(at("open_pos", 0)))
    around = {"_script": (F.col("kind") == "el") & (F.col("tag") == "script"), **within}
    ends = {f"_end_{name}": F.when(cond, F.col("close_pos")) for name, cond in around.items()}
    ev = rows.select("page_id", "node_id", "open_pos", "text", F.explode(events).alias("_at"), is_text.alias("_is_text"), own.alias("_own"), *[c.alias(n) for n, c in ends.items()])
    order = ("_at.pos", "_at.step")
    # an element has begun before whatever ends it, so its two places count once here
    ev = ev.withColumns({
        "_open": F.sum("_at.step").over(_upto(order=order)),
        **{name: F.coalesce(F.max(f"_end_{name}").over(_before(order=order)) > F.col("open_pos"), F.lit(False)) for name in around}})
    # texts that no target holds go
    ev = ev.filter((F.col("_at.step") >= 0) & (~F.col("_is_text") | (F.col("_open") > 0)))
    own = F.when(F.col("_own").isNotNull(), F.struct(*[F.col("_own")[c].alias(c) for c in columns], *within)) if within else F.col("_own")
    columns = [*columns, *within]
    ev = ev.select("page_id", "node_id", "_at", "_is_text", "_open", own.alias("_own"), F.when(F.col("_is_text"), F.struct("open_pos", "text", "_script")).alias("_piece"))
    depth = F.when(F.col("_is_text"), F.sequence(F.lit(1).cast("long"), F.col("_open"))) \
        .when(F.col("_at.step") == 1, F.array("_open")).otherwise(F.array(F.lit(0).cast("long")))
    ev = ev.select("page_id", "node_id", "_at", "_is_text", "_own", "_piece", F.explode(depth).alias("_depth"))
    holder = F.last(F.when(F.col("_at.step") == 1, F.col("node_id")), ignorenulls=True).over(_upto("_depth", order=order))
    ev = ev.withColumn("_of", F.when(F.col("_is_text"), holder).otherwise(F.col("node_id")))
    done = ev.groupBy("page_id", "_of").agg(
        F.first("_own", ignorenulls=True).alias("_own"), F.sort_array(F.collect_list("_piece")).alias("_p"))
    joined = lambda parts: F.array_join(F.transform(parts, lambda x: x["text"]), "")
    return done.select("page_id", *[F.col("_own")[c].alias(c) for c in columns], joined(F.col("_p")).alias("content"), joined(F.filter("_p", lambda x: ~x["_script"])).alias("content_noscript"))


def any_compound(*selectors) -> Column:
    """Whether a row matches any compound of the selectors: the rows that
    ``mark`` needs."""
    out = F.lit(False)
    for sel in selectors:
        groups = parse_selector(sel)
        if _needs_siblings(groups):
            return F.col("kind") == "el"
        for g in groups:
            for _, c in g:
                out = out | compound_pred(c)
    return out


def mark(rows: DataFrame, **selectors) -> DataFrame:
    """A boolean column for each selector, all in one pass. The rows are
    whole pages, or hold at least ``any_compound`` of the selectors."""
    columns = rows.columns
    parsed = {name: parse_selector(sel) for name, sel in selectors.items()}
    if any(_needs_siblings(g) for g in parsed.values()):
        w = Window.partitionBy("page_id", "parent_id", "kind")
        rows = rows.withColumn("_place", F.row_number().over(w.orderBy("open_pos"))).withColumn("_siblings", F.count("*").over(w))
    for name, groups in parsed.items():
        found = F.lit(False)
        for i, chain in enumerate(groups):
            flag = None
            for k, (comb, c) in enumerate(chain):
                cond = compound_pred(c)
                if flag is not None and comb == " ":
                    cond = cond & inside(F.col(flag))
                elif flag is not None and comb == ">":
                    up = rows.filter(F.col(flag)).select("page_id", F.col("node_id").alias("parent_id"), F.lit(True).alias("_child"))
                    rows = rows.join(up, ["page_id", "parent_id"], "left")
                    cond = cond & F.coalesce("_child", F.lit(False))
                elif flag is not None:
                    w = Window.partitionBy("page_id", "parent_id", "kind").orderBy("open_pos")
                    seen = F.lag(flag).over(w) if comb == "+" else F.max(flag).over(w.rowsBetween(Window.unboundedPreceding, -1))
                    cond = cond & F.coalesce(seen, F.lit(False))
                flag = f"_{name}_{i}_{k}"
                rows = rows.withColumn(flag, cond).drop("_child")
            found = found | F.col(flag)
        rows = rows.withColumn(name, found)
    return rows.select(*columns, *selectors)


def select(nodes: DataFrame, sel: str) -> DataFrame:
    """Element rows matching ``sel`` (each node once)."""
    rows = nodes.filter(any_compound(sel))
    return mark(rows, _hit=sel).filter("_hit").select(*nodes.columns)


# ---------------------------------------------------------------------------
# navigation between two tables
# ---------------------------------------------------------------------------
def within(matches: DataFrame, containers: DataFrame, cid: str = "cid", nearest: int | None = None) -> DataFrame:
    """Matches that lie inside a container, one row per (container, match)
    with the container's ``cid``. ``containers`` has ``page_id``, ``cid`` and
    the interval. The match is selected on the whole tree first, so an ancestor
    part of the selector may lie outside the container."""
    spot = ["page_id", "open_pos", "close_pos"]
    a = matches.select(*spot, F.struct(*matches.columns).alias("_m"), F.lit(None).cast("int").alias("_c"))
    b = containers.select(*spot, F.lit(None).cast(a.schema["_m"].dataType).alias("_m"), F.col(cid).alias("_c"))
    pairs = pair_up(a.unionByName(b), F.col("_m").isNotNull(), F.col("_c").isNotNull(), ["_c"], nearest)
    return pairs.select(*[F.col("page_id") if c == "page_id" else F.col("_m")[c].alias(c) for c in matches.columns], F.col("up._c").alias(cid), "level")


def first_within(matches: DataFrame, containers: DataFrame, cols, cid: str = "cid") -> DataFrame:
    """D4 + D5: per container the first match in document order: ``page_id``,
    ``cid`` and the requested match columns."""
    spot = ["page_id", "open_pos", "close_pos"]
    a = matches.select(*spot, F.struct(*cols).alias("_m"), F.lit(None).cast("int").alias("_c"))
    b = containers.select(*spot, F.lit(None).cast(a.schema["_m"].dataType).alias("_m"), F.col(cid).alias("_c"))
    # of a node with both roles the container stands first in backward order
    w = Window.partitionBy("page_id").orderBy(F.desc("open_pos"), F.col("_m").isNotNull()).rowsBetween(Window.unboundedPreceding, -1)
    found = F.last(F.when(F.col("_m").isNotNull(), F.struct("open_pos", "_m")), ignorenulls=True).over(w)
    both = a.unionByName(b).withColumn("_f", found)
    return both.filter(F.col("_c").isNotNull() & (F.col("_f.open_pos") < F.col("close_pos"))).select("page_id", F.col("_c").alias(cid), "_f._m.*")


def closest(nodes: DataFrame, df: DataFrame, tag: str, name: str) -> DataFrame:
    """``df`` with ``name``, the id of the nearest ancestor-or-self with
    ``tag``; rows without one are absent."""
    own = df.filter(F.col("tag") == tag).withColumn(name, F.col("node_id"))
    up = within(df.filter(F.col("tag") != tag), elements(nodes).filter(F.col("tag") == tag).withColumn("cid", F.col("node_id")), "cid", nearest=1)
    return own.unionByName(up.withColumnRenamed("cid", name).select(*own.columns))


def attr(name: str) -> Column:
    """``.attr(name)``; NULL when missing."""
    return F.col("attrs")[name]


def text_nodes(nodes: DataFrame, drop_tags=()) -> DataFrame:
    """(page_id, open_pos, close_pos, text) of texts outside ``drop_tags``."""
    is_text = F.col("kind") == "text"
    if drop_tags:
        banned = (F.col("kind") == "el") & F.col("tag").isin(*drop_tags)
        nodes = nodes.select("page_id", "open_pos", "close_pos", "kind", "tag", "text").filter(is_text | banned).withColumn("_out", inside(banned)).filter(~F.col("_out"))
    return nodes.filter(is_text).select("page_id", "open_pos", "close_pos", "text")


def _joined() -> Column:
    return F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("open_pos", "text"))), lambda x: x["text"]), "").alias("text")


def subtree_text(nodes: DataFrame, targets: DataFrame, tid: str = "tid", drop_tags=()) -> DataFrame:
    """D6/D7 raw: ``targets(page_id, tid, open_pos, close_pos)`` ->
    ``(page_id, tid, text)`` with the text of all text nodes below the target
    in document order. Targets without any text node are absent (callers
    left-join and coalesce to '')."""
    pairs = within(text_nodes(nodes, drop_tags), targets.select("page_id", tid, "open_pos", "close_pos").dropDuplicates(["page_id", tid]), tid)
    return pairs.groupBy("page_id", tid).agg(_joined())


def page_text(nodes: DataFrame, drop_tags=()) -> DataFrame:
    """Text of the whole document per page: (page_id, text)."""
    return text_nodes(nodes, drop_tags).groupBy("page_id").agg(_joined())


def page_texts(nodes: DataFrame, sel: str) -> DataFrame:
    """Per document row (one a page, unless ids repeat), in one aggregate:
    ``text`` of the whole document and ``first_text`` of the first element that
    matches ``sel`` (NULL when none does): (page_id, text, first_text)."""
    is_text = F.col("kind") == "text"
    rows = mark(nodes.filter(is_text | (F.col("kind") == "doc") | any_compound(sel)), _hit=sel)
    per = rows.groupBy("page_id").agg(
        F.sort_array(F.collect_list(F.when(is_text, F.struct("open_pos", "text")))).alias("_t"),
        F.min(F.when(F.col("_hit"), F.struct("open_pos", "close_pos"))).alias("_at"), F.count_if(F.col("kind") == "doc").cast("int").alias("_docs"))
    per = per.withColumn("_doc", F.explode(F.array_repeat(F.lit(1), F.col("_docs"))))
    joined = lambda texts: F.array_join(F.transform(texts, lambda x: x["text"]), "")
    low, high = F.col("_at.open_pos"), F.col("_at.close_pos")
    first = joined(F.filter("_t", lambda x: (x["open_pos"] > low) & (x["open_pos"] < high)))
    return per.select("page_id", joined(F.col("_t")).alias("text"), F.when(low.isNotNull(), first).alias("first_text"))


def _with_empty(targets: DataFrame, r: DataFrame, tid: str) -> DataFrame:
    return targets.select("page_id", tid).join(r, ["page_id", tid], "left").select(
        "page_id", tid, F.coalesce("text", F.lit("")).alias("text"))


def text_trim(nodes, targets, tid="tid", keep_empty=False) -> DataFrame:
    """``.text().trim()``. Targets without text nodes are absent unless
    ``keep_empty`` (then they get '')."""
    r = subtree_text(nodes, targets, tid)
    if keep_empty:
        r = _with_empty(targets, r, tid)
    return r.withColumn("text", js_trim("text"))


def text_clean(nodes, targets, tid="tid", keep_empty=False) -> DataFrame:
    """Text without script, whitespace collapsed, trimmed."""
    r = subtree_text(nodes, targets, tid, drop_tags=("script",))
    if keep_empty:
        r = _with_empty(targets, r, tid)
    return r.withColumn("text", js_collapse_ws("text"))


def walk_up(nodes: DataFrame, df: DataFrame, k: int) -> DataFrame:
    """``df`` with each of its first k ancestors: ``cid`` and ``level``
    (1 = parent)."""
    return within(df, elements(nodes).withColumn("cid", F.col("node_id")), "cid", nearest=k)


def table_rows(nodes: DataFrame) -> DataFrame:
    """Every ``table//tr`` with at least two direct ``td`` children.
    A row of a nested table is listed once per enclosing table. Output:
    page_id, table_id, table_pos, tr_id, tr_pos, cell0, cell1 (their texts),
    cell1_class."""
    rows = nodes.filter((F.col("kind") == "text") | F.col("tag").isin("table", "tr", "td", "script")).select(
        "page_id", "node_id", "parent_id", "open_pos", "close_pos", "kind", "tag", F.col("attrs")["class"].alias("cls"), "text")
    rows = with_text(rows, F.col("tag") == "td")
    # cells meet at their row's id, rows and tables stand for themselves
    key = F.when(F.col("tag") == "td", F.col("parent_id")).otherwise(F.col("node_id"))
    own = F.when(F.col("tag").isin("tr", "table"), F.struct("open_pos", "close_pos", "tag"))
    rows = rows.groupBy("page_id", key.alias("node_id")).agg(
        F.max(own).alias("own"), F.sort_array(F.collect_list(F.when(F.col("tag") == "td", F.struct("open_pos", "content", "cls")))).alias("cells"))
    rows = rows.filter(F.col("own").isNotNull()).select("page_id", "node_id", "own.*", "cells")
    full = (F.col("tag") == "tr") & (F.size("cells") >= 2)
    pairs = pair_up(rows, full, F.col("tag") == "table", ["node_id", "open_pos"])
    return pairs.select(
        "page_id", F.col("up.node_id").alias("table_id"), F.col("up.open_pos").alias("table_pos"),
        F.col("node_id").alias("tr_id"), F.col("open_pos").alias("tr_pos"), F.get("cells", F.lit(0))["content"].alias("cell0"),
        F.get("cells", F.lit(1))["content"].alias("cell1"), F.coalesce(F.get("cells", F.lit(1))["cls"], F.lit("")).alias("cell1_class"))
