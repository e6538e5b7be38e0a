"""Parse pages into the node table.

Two steps. Python splits: one regex tokenizer per Arrow batch turns the html of
a page into a stream of tags and texts, and notes which tag ends which start tag
where all tags of the page pair by plain depth, or where the only fault is that
end tags are left out (``pair_by_rank``). Spark builds the tree: of those pages
in place, row by row; of the others by windows keyed by the page that match the
brackets of the stream (``structure_sql``). One row per element or text node::

    nodes(page_id long, node_id int, parent_id int, open_pos int, close_pos int,
          kind string, tag string, attrs map<string,string>,
          classes array<string>, text string)

Node 0 of every page is the document (kind 'doc'); its ``attrs`` carry the
split time in ms (E14). A node's id is the number of its token. A subtree is
the interval between ``open_pos`` (odd) and ``close_pos`` (even); document
order is ``open_pos``. Elements that end together have one ``close_pos``; of
these the one with the largest ``open_pos`` lies innermost. Texts and void
elements have ``close_pos = open_pos``.

Which brackets match (the parser's rule):

1. An end tag pairs with the latest start tag of its name that is still
   without one, in the same table (list items: at the same list depth). End
   tags without a partner are ignored.
2. Two pairs that cross exchange their ends, so intervals always nest.
3. A block or a list, table, ``html`` or ``body`` without an end tag ends with
   the innermost pair around it.
4. Any other element without an end tag ends there too, or before that where
   a start tag beside it ends it: ``RANKS`` orders head and table sections,
   rows, cells, list items, paragraphs, links and the rest; a start tag ends
   all that stand at its rank (``SELF``) or above. A block ends paragraphs,
   links and inline elements; a section, row, cell or item ends its like.

Every step is a window over the page's tokens: linear rows at any depth. Where
all tags of a page pair by plain depth (``nested_sql`` says it in SQL) the rules
change nothing; where pairs do not cross and only elements of rule 4 lack an end
tag, one stack gives what the rules say. Only the other pages take the longer
way, with its shuffles.
``page_id`` must identify a page.
"""

from __future__ import annotations

import re
import time
from bisect import bisect_left, bisect_right
from dataclasses import dataclass
from functools import lru_cache, partial
from html import unescape as _unescape
from itertools import compress

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# HTML void elements, block elements, and elements whose content
# is text only.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr keygen".split())
BLOCKS = frozenset((
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup main menu nav ol pre section summary table ul"
).split())
CONTAINERS = BLOCKS | {"html", "body", "select"}    # rule 3
LISTS = ("ul", "ol", "dl", "select")
ITEMS = ("li", "dt", "dd", "option", "optgroup")
RAW_TEXT = frozenset(("title", "textarea"))
#: Rule 4: rank of an element without an end tag, and from which rank on a start tag ends others.
RANKS = {**dict.fromkeys(("head", "caption", "colgroup", "thead", "tbody", "tfoot"), 1), "tr": 2, "td": 3, "th": 3,
         **dict.fromkeys(ITEMS, 4), "p": 5, "a": 6}
INLINE = 7
ENDS = {**{t: r for t, r in RANKS.items() if t != "head"}, **dict.fromkeys([*BLOCKS, "hr"], 5), "head": 2, "body": 1, "html": 1}

# Written node tables are sorted by (kind, tag) inside each page bucket and
# use small row groups, so a selector's tag/kind filter skips row groups by
# their min/max statistics instead of decoding every node.
NODE_SORT = ("kind", "tag", "page_id")
NODE_ROW_GROUP = 4 * 1024 * 1024

# Rows of the tag stream in a task of page-keyed work.
NODES_PER_TASK = 250_000

NODE_COLS = ["page_id", "node_id", "parent_id", "open_pos", "close_pos", "kind", "tag", "attrs", "classes", "text"]

TAG_SCHEMA = T.StructType([
    T.StructField("page_id", T.LongType()),
    T.StructField("seq", T.IntegerType()),
    T.StructField("kind", T.StringType()),          # doc, open, close, void, text
    T.StructField("tag", T.StringType()),
    T.StructField("attrs", T.MapType(T.StringType(), T.StringType())),
    T.StructField("classes", T.ArrayType(T.StringType())),
    T.StructField("text", T.StringType()),
    # pages that the splitter paired: the element around, and the tag that ends it (of the document: the last token)
    T.StructField("parent", T.IntegerType()),
    T.StructField("stop", T.IntegerType()),
    T.StructField("nested", T.BooleanType()),
])

ARROW_SCHEMA = pa.schema([
    ("page_id", pa.int64()), ("seq", pa.int32()), ("kind", pa.string()), ("tag", pa.string()),
    ("attrs", pa.map_(pa.string(), pa.string())), ("classes", pa.list_(pa.string())), ("text", pa.string()),
    ("parent", pa.int32()), ("stop", pa.int32()), ("nested", pa.bool_()),
])


# ---------------------------------------------------------------------------
# splitting
# ---------------------------------------------------------------------------
# One master pattern: comment, markup declaration / processing instruction,
# end tag, start tag (quoted values may hold '>'), text run, lone '<'.
_TOKEN_RE = re.compile(r"""
    <!--.*?(?:--!?>|\Z)
  | <[!?][^>]*>?
  | </(?P<end>[a-zA-Z][^\t\n\r\f />\x00]*)[^>]*>?
  | <(?P<start>[a-zA-Z][^\t\n\r\f />\x00]*)(?P<attrs>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>
  | [^<]+
  | <
""", re.S | re.X)
# HTML's attribute rules: a name runs to white space, '/', '>' or '=' (but may
# begin with '='); a value is quoted, or runs to white space or '>'.
_ATTR_RE = re.compile(r"""
    (?P<name>[^\t\n\f\r />][^\t\n\f\r />=]*)
    (?P<value>[\t\n\f\r ]*=[\t\n\f\r ]*(?:"(?P<double>[^"]*)"|'(?P<single>[^']*)'|(?P<plain>[^\t\n\f\r >]*)))?
""", re.X)
_RAW_END = {t: re.compile(rf"</{t}(?=[\t\n\r\f />])", re.I) for t in ("script", "style")}
_RCDATA_END = {t: re.compile(rf"</{t}(?=[\t\n\r\f />])", re.I) for t in RAW_TEXT}


def _attrs(raw: str):
    out = []
    for m in _ATTR_RE.finditer(raw):
        v = None
        if m.group("value") is not None:
            v = next(x for x in (m.group("double"), m.group("single"), m.group("plain")) if x is not None)
            if "&" in v:
                v = _unescape(v)
        out.append((m.group("name").lower(), v))
    return out


#: Attribute texts up to this length are read once for each time they recur.
KNOWN_CHARS = 200
_known_attrs = lru_cache(4096)(lambda raw: tuple(_attrs(raw)))


@lru_cache(4096)
def _known_names(attrs: tuple):
    return _by_name(attrs)


def _by_name(attrs):
    """Of each attribute the first value, and the classes."""
    first = {}
    for k, v in attrs:
        first.setdefault(k, "" if v is None else v)
    return first, (first.get("class") or "").split()


@lru_cache(4096)
def _known_tag(name: str):
    tag = name.lower()
    return tag, tag in VOID, _RAW_END.get(tag) or _RCDATA_END.get(tag)


# Comments, elements of text only with their content, all else up to the next '>'.
_NAME_ENDS = r"(?=[\t\n\r\f />])"
_COMMENT = "<!--.*?--!?>"
_PIECES = re.compile(f"({_COMMENT}|" + "".join(
    rf"<(?i:{t}){_NAME_ENDS}[^>]*>.*?</(?i:{t}){_NAME_ENDS}[^>]*>|" for t in (*_RAW_END, *_RCDATA_END)) + "<[^>]*>)", re.S)
_COMMENT_RE = re.compile(_COMMENT, re.S)
_TEXT_ONLY_RE = re.compile(f"<(/?)({'|'.join((*_RAW_END, *_RCDATA_END))}){_NAME_ENDS}", re.I)
_NO_TAG, _NO_TOKEN = (), ""


def _plain_piece(piece: str):
    """What a piece of a page is: (kind, tag, attributes, text); a list of these
    for an element of text only; ``_NO_TAG`` for the end tag of a void element;
    ``_NO_TOKEN`` for what lies between pieces of one text; None if the piece
    and the token that begins there do not end together."""
    if piece.startswith(("<!", "<?")):
        return _NO_TOKEN if not piece.startswith("<!--") or _COMMENT_RE.fullmatch(piece) else None
    m = _TOKEN_RE.match(piece)
    which = m.lastgroup
    if which == "end" and m.end() == len(piece):
        tag, void, _ = _known_tag(m.group("end"))
        return _NO_TAG if void else ("close", tag, None, None)
    if which != "attrs":
        return None
    name, raw = m.group("start", "attrs")
    tag, void, closer = _known_tag(name)
    token = "void" if void else "open", tag, (_known_attrs(raw) if len(raw) <= KNOWN_CHARS else _attrs(raw)) if raw else (), None
    if closer is None:
        return token if m.end() == len(piece) else None
    e = closer.search(piece, m.end())
    if e is None or piece.find(">", e.end()) != len(piece) - 1:
        return None
    body = piece[m.end():e.start()]
    text = [("text", None, None, _unescape(body) if tag in RAW_TEXT and "&" in body else body)] if body else []
    return [token, *text, ("close", tag, None, None)]


_known_piece = lru_cache(4096)(_plain_piece)


def _any_piece(piece: str):
    return (_known_piece if len(piece) <= KNOWN_CHARS else _plain_piece)(piece)


def _plain_pieces(html: str):
    """The texts of a page and the pieces between them; None where these do not
    tell the tokens: '>' in a quoted value, '<' in a text, what never ends."""
    # what would be looked for up to the end of the page, time and again
    if html.rfind("<!--") > max(html.rfind("-->"), html.rfind("--!>")):
        return None
    ends = {}
    for m in _TEXT_ONLY_RE.finditer(html):
        ends[m[2].lower()] = m[1]
    if not all(ends.values()):
        return None
    last = html.rfind(">") + 1
    pieces = _PIECES.split(html[:last])
    pieces[-1] += html[last:]
    if "<!" in pieces[-1] or "<?" in pieces[-1]:
        return None
    found = list(map(_known_piece if len(max(pieces, key=len)) <= KNOWN_CHARS else _any_piece, pieces[1::2]))
    return None if None in found else (pieces[::2], found)


def _plain_tokens(texts, found):
    pending = ""
    for text, piece in zip(texts, [*found, _NO_TAG]):
        if text:
            pending += _unescape(text) if "&" in text else text
        if piece is _NO_TOKEN:
            continue
        if pending:
            yield "text", None, None, pending
            pending = ""
        if type(piece) is list:
            yield from piece
        elif piece:
            yield piece


def split_tags(html: str):
    """(kind, tag, attributes, text) of the tags and texts of a page, in order;
    texts around a comment are one. The content of script, style, title and
    textarea is text."""
    plain = _plain_pieces(html)
    if plain is not None:
        yield from _plain_tokens(*plain)
        return
    pos, n, last = 0, len(html), html.rfind(">")
    match = _TOKEN_RE.match
    pending = []                                       # adjacent text pieces
    while pos < n:
        if pos > last and not html.startswith(("<!", "<?"), pos):
            # no tag can end from here on: what is left is text
            rest = html[pos:]
            pending.append(_unescape(rest) if "&" in rest else rest)
            break
        m = match(html, pos)
        pos = m.end()
        which = m.lastgroup                            # end, attrs (of a start tag) or none
        if which is None:
            tok = m.group()
            # a comment, declaration or instruction has no text, unless it never ends
            if tok[0] != "<" or not tok.startswith(("<!", "<?")) or (tok.startswith("<!--") and not tok.endswith(">")):
                pending.append(_unescape(tok) if "&" in tok else tok)
            continue
        if pending:
            yield "text", None, None, "".join(pending) if len(pending) > 1 else pending[0]
            pending = []
        if which == "end":
            tag, void, _ = _known_tag(m.group("end"))
            if not void:
                yield "close", tag, None, None
            continue
        name, raw = m.group("start", "attrs")
        tag, void, closer = _known_tag(name)
        yield ("void" if void else "open"), tag, (_known_attrs(raw) if len(raw) <= KNOWN_CHARS else _attrs(raw)) if raw else (), None
        if closer is not None:
            e = closer.search(html, pos)
            body = html[pos:e.start() if e else n]
            if body:
                yield "text", None, None, _unescape(body) if tag in RAW_TEXT and "&" in body else body
            gt = html.find(">", e.end()) if e else -1
            if e:
                yield "close", tag, None, None
            pos = n if gt < 0 else gt + 1
    if pending:
        yield "text", None, None, "".join(pending)


def page_tags(html: str | None):
    """Rows (seq, kind, tag, attrs, classes, text) of one page; row 0 is the
    document. A page whose split breaks off keeps the rows made so far and says
    so: the document's attributes get ``parse_error``."""
    t0 = time.perf_counter()
    rows = [(0, "doc", "#document", {}, None, None)]
    try:
        for kind, tag, attrs, text in split_tags(html or ""):
            classes = None
            if attrs is not None:
                known = type(attrs) is tuple           # short ones, which recur
                attrs, classes = _known_names(attrs) if known else _by_name(attrs)
            rows.append((len(rows), kind, tag, attrs, classes, text))
    except Exception as e:  # noqa: BLE001 - reported with the page
        rows[0][3]["parse_error"] = f"{type(e).__name__}: {e}"
    rows[0][3]["parse_ms"] = f"{(time.perf_counter() - t0) * 1000.0:.3f}"
    return rows


def pair_by_depth(rows):
    """Of the rows of a page (``page_tags``) the element around each and the
    end tag of each start tag; None if the tags do not all pair by plain depth."""
    around, stops, inside = [None] + [0] * (len(rows) - 1), [None] * len(rows), [0]
    for seq, kind, tag, *_ in rows[1:]:
        if kind == "close":
            start = inside.pop()
            if not inside or rows[start][2] != tag:
                return None
            stops[start] = seq
            continue
        around[seq] = inside[-1]
        if kind == "open":
            inside.append(seq)
    stops[0] = len(rows) - 1
    return (around, stops) if len(inside) == 1 else None


def pair_by_rank(rows):
    """As ``pair_by_depth``, of pages where some elements of rule 4 have no end
    tag and nothing else is amiss; None of pages with end tags without a partner,
    with pairs that cross, with open blocks or with no end tag at all."""
    stops, starts, waiting = [None] * len(rows), {}, {}
    tables, lists = [0], 0
    # rule 1: pairs by name, in the same table; items at the same depth of lists
    for seq, kind, tag, *_ in rows[1:]:
        if kind not in ("open", "close"):
            continue
        step = 1 if kind == "open" else -1
        if tag == "table":
            place = -1
        else:
            place = tables[-1]
        if tag in LISTS:
            lists += step
            if lists < 0:
                return None
        key = (place, lists if tag in ITEMS else 0, tag)
        if kind == "open":
            waiting.setdefault(key, []).append(seq)
            if tag == "table":
                tables.append(seq)
        else:
            if not waiting.get(key):
                return None
            start = waiting[key].pop()
            stops[start], starts[seq] = seq, start
            if tag == "table":
                if tables.pop() != start:
                    return None
    if not starts:
        return None
    # rule 4: of each level the pair around and the elements without an end tag that are open, by rank
    around, last = [None] + [0] * (len(rows) - 1), len(rows) - 1
    levels = [[0]]
    for seq, kind, tag, *_ in rows[1:]:
        level = levels[-1]
        if kind == "close":
            if level[0] != starts[seq]:
                return None                            # pairs cross
            for free in level[1:]:
                stops[free] = seq
            levels.pop()
            continue
        if kind != "text":
            ends = ENDS.get(tag, INLINE + 1)
            while len(level) > 1 and RANKS.get(rows[level[-1]][2], INLINE) >= ends:
                stops[level.pop()] = seq
        around[seq] = level[-1]
        if kind == "open":
            if stops[seq] is not None:
                levels.append([seq])
            elif tag in CONTAINERS:
                return None
            else:
                level.append(seq)
    if len(levels) > 1:
        return None
    for free in levels[0][1:]:
        stops[free] = last + 1
    stops[0] = last
    return around, stops


def pair_by_rules(rows):
    """As ``pair_by_depth``, of any page: what ``structure_sql`` says, step by step."""
    n = len(rows)
    # 1: pairs by name, in the same table; items at the same depth of lists
    tables = lists = least_tables = least_lists = 0
    inner, sums, lows, before = {}, {}, {}, {}
    pairs, ends = [False] * n, [False] * n
    for seq, kind, tag, *_ in rows:
        step = 1 if kind == "open" else -1 if kind == "close" else 0
        if not step:
            continue
        if tag == "table":
            tables += step
            least_tables = min(least_tables, tables)
            if step > 0:
                inner[tables - least_tables] = seq
        if tag in LISTS:
            lists += step
            least_lists = min(least_lists, lists)
        key = (-1 if tag == "table" else inner.get(tables - least_tables, 0), lists - least_lists if tag in ITEMS else 0, tag)
        total = sums[key] = sums.get(key, 0) + step
        low = lows.get(key, 0)
        lows[key] = min(low, total)
        ends[seq] = step < 0 and total >= low
        level = total - low if step > 0 else total + 1 - low if ends[seq] else -1
        start = before.get((key, level))
        if step < 0 and start is not None:
            pairs[start] = True
        before[key, level] = seq if step > 0 else None
    # 2, 3: blocks without an end tag end with the pair around them
    d, depth, blocks, paired_blocks = 0, 0, {}, {}
    opens, at = [False] * n, []                        # (level, seq, role): 0 node, 1 opener, 2 end
    for seq, kind, tag, *_ in rows:
        d += 1 if pairs[seq] else -1 if ends[seq] else 0
        own = d + 1 if ends[seq] else d
        loose = kind == "open" and not pairs[seq] and tag in CONTAINERS
        blocks[own] = blocks.get(own, 0) + loose
        if pairs[seq]:
            paired_blocks[own] = blocks[own]
        if kind == "close":
            closes = 1 + blocks[own] - paired_blocks.get(own, 0) if ends[seq] else 0
            depth -= closes
            at.extend((depth + x, seq, 2) for x in range(1, closes + 1))
        elif pairs[seq] or loose:
            opens[seq] = True
            at.append((depth, seq, 0))
            depth += 1
            at.append((depth, seq, 1))
        else:
            at.append((depth, seq, 0))
    # 4: what is open at the level, by rank, and what ends it
    ranks = range(1, INLINE + 1)
    around, stops = [None] * n, [None] * n
    state: dict = {}
    for level, seq, role in at:
        opener, free, ended = state.get(level) or state.setdefault(level, [[None], {}, {}])
        if role == 1:
            opener[0] = seq
        elif role == 0:
            kind, tag = rows[seq][1:3]
            if kind != "text":
                for r in range(ENDS.get(tag, INLINE + 1), INLINE + 1):
                    ended[r] = seq
            alive = [free[r] for r in ranks if r in free and free[r] > (opener[0] or 0) and free[r] >= ended.get(r, 0)]
            around[seq] = max([*([] if opener[0] is None else opener), *alive], default=0)
            if kind == "open" and not opens[seq]:
                free[RANKS.get(tag, INLINE)] = seq
    state = {}
    for level, seq, role in reversed(at):
        end, by = state.get(level) or state.setdefault(level, [[None], {}])
        if role == 2:
            end[0] = seq
            continue
        kind, tag = rows[seq][1:3]
        if role == 1:
            stops[seq] = n if end[0] is None else end[0]
            continue
        if kind == "open" and not opens[seq]:
            stops[seq] = min([n, *([] if end[0] is None else end), *([by[r]] if (r := RANKS.get(tag, INLINE)) in by else [])])
        if kind != "text":
            for r in range(ENDS.get(tag, INLINE + 1), INLINE + 1):
                by[r] = seq
    around[0], stops[0] = None, n - 1
    return around, stops


class _Columns:
    """Column buffers for one Arrow batch. Nested columns are kept as flat
    value lists plus offsets and assembled with ``from_arrays`` (no
    per-row Python objects for lists and maps)."""

    SCALARS = ("page_id", "seq", "kind", "tag", "text", "parent", "stop", "nested")

    def __init__(self):
        self.s = {n: [] for n in self.SCALARS}
        self.attr_off, self.attr_k, self.attr_v, self.attr_null = [0], [], [], []
        self.cls_off, self.cls_v, self.cls_null = [0], [], []
        self.n = 0

    def add(self, pid, columns, nested):
        """Columns of a page's rows, the last two the element around and the end of each."""
        seqs, kinds, tags, attrs, classes, texts, parents, stops = columns
        s, n = self.s, len(seqs)
        s["page_id"].extend([pid] * n)
        s["nested"].extend([nested] * n)
        for name, values in (("seq", seqs), ("kind", kinds), ("tag", tags), ("text", texts), ("parent", parents), ("stop", stops)):
            s[name].extend(values)
        keys, found, offsets = self.attr_k, self.attr_v, self.attr_off
        for a in attrs:
            if a:
                keys.extend(a)
                found.extend(a.values())
            offsets.append(len(keys))
        names, offsets = self.cls_v, self.cls_off
        for c in classes:
            if c:
                names.extend(c)
            offsets.append(len(names))
        self.attr_null.extend([a is None for a in attrs])
        self.cls_null.extend([c is None for c in classes])
        self.n += n

    def batch(self):
        f = ARROW_SCHEMA.field
        arrays = {n: pa.array(self.s[n], type=f(n).type) for n in self.SCALARS}
        arrays["attrs"] = pa.MapArray.from_arrays(
            pa.array(self.attr_off, type=pa.int32()), pa.array(self.attr_k, type=pa.string()), pa.array(self.attr_v, type=pa.string()),
            mask=pa.array(self.attr_null, type=pa.bool_()))
        arrays["classes"] = pa.ListArray.from_arrays(
            pa.array(self.cls_off, type=pa.int32()), pa.array(self.cls_v, type=pa.string()),
            mask=pa.array(self.cls_null, type=pa.bool_()))
        return pa.RecordBatch.from_arrays([arrays[n] for n in ARROW_SCHEMA.names], schema=ARROW_SCHEMA)


def _batches(it, max_rows=65536, max_chars=1 << 24, ends=True):
    cols, chars = _Columns(), 0
    for batch in it:
        for pid, html in zip(batch.column("page_id").to_pylist(), batch.column("html")):
            html = html.as_py()
            rows = page_tags(html)
            chars += len(html or "")
            nested = pair_by_depth(rows)
            around, stops = nested or pair_by_rank(rows) or ([None] * len(rows), [None] * len(rows))
            columns = [*zip(*rows), around, stops]
            if nested and not ends:
                stay = [kind != "close" for kind in columns[1]]
                columns = [list(compress(c, stay)) for c in columns]
            for at in range(0, len(columns[0]), max_rows):
                cols.add(pid, columns if len(columns[0]) <= max_rows else [c[at:at + max_rows] for c in columns], nested is not None)
                if cols.n >= max_rows:
                    yield cols.batch()
                    cols, chars = _Columns(), 0
            if chars >= max_chars and cols.n:
                yield cols.batch()
                cols, chars = _Columns(), 0
    if cols.n:
        yield cols.batch()


def _batches_without_ends(it):
    return _batches(it, ends=False)


def to_tags(pages: DataFrame, html_col: str = "html", ends: bool = True) -> DataFrame:
    """The tag stream. ``pages`` needs ``page_id`` and the html column; only
    those two columns are handed to Python (column pruning reaches the scan).
    Without ``ends`` the end tags of nested pages, whose place their start tags
    tell, are left out."""
    from pagelens.session import ensure_parallel, ship_package
    ship_package(pages.sparkSession)
    src = ensure_parallel(pages.select("page_id", pages[html_col].alias("html")))
    return src.mapInArrow(_batches if ends else _batches_without_ends, TAG_SCHEMA)


# ---------------------------------------------------------------------------
# pages in a row each
# ---------------------------------------------------------------------------
@dataclass
class Indexed:
    """Elements of a page index: those of a tag that have the classes, with the
    values of ``attrs`` and, for each name in ``holds``, which entries of that
    name (or of ``texts``) lie strictly inside."""

    tag: str
    classes: tuple = ()
    attrs: tuple = ()
    holds: tuple = ()


def _index_schema(spec: dict[str, Indexed]):
    ranges = lambda e: [(f"{h}{end}", pa.int32()) for h in e.holds for end in ("_from", "_to")]
    return pa.schema([("page_id", pa.int64()), ("texts", pa.list_(pa.string())),
                      *[(name, pa.list_(pa.struct([*[(a, pa.string()) for a in e.attrs], *ranges(e)]))) for name, e in spec.items()]])


def index_page(rows, stops, spec: dict[str, Indexed], by_tag: dict):
    """The texts of a page and, by name, a list of columns of its elements."""
    found: dict = {name: [] for name in spec}
    texts, at_text = [], []
    for seq, kind, tag, _, classes, text in rows:
        if kind == "text":
            texts.append(text)
            at_text.append(seq)
        elif tag in by_tag and kind != "close":
            for name, need in by_tag[tag]:
                if not need or need.issubset(classes):
                    found[name].append(seq)
    out = {}
    for name, e in spec.items():
        seqs = found[name]
        columns = [[rows[i][3].get(a) for i in seqs] for a in e.attrs]
        ends = [i if stops[i] is None else stops[i] for i in seqs]
        for h in e.holds:
            inner = at_text if h == "texts" else found[h]
            columns += [bisect_right(inner, i) for i in seqs], [bisect_left(inner, i) for i in ends]
        out[name] = len(seqs), columns
    return texts, out


def _index_batches(it, spec, max_rows=65536, max_chars=1 << 24):
    schema, by_tag = _index_schema(spec), {}
    for name, e in spec.items():
        by_tag.setdefault(e.tag, []).append((name, frozenset(e.classes)))

    def empty():
        return [], [0], [], {name: ([0], [[] for _ in range(len(e.attrs) + 2 * len(e.holds))]) for name, e in spec.items()}

    def batch():
        arrays = [pa.array(ids, pa.int64()), pa.ListArray.from_arrays(pa.array(text_at, pa.int32()), pa.array(texts, pa.string()))]
        for name, (at, columns) in found.items():
            kind = schema.field(name).type.value_type
            values = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kind)], fields=list(kind))
            arrays.append(pa.ListArray.from_arrays(pa.array(at, pa.int32()), values))
        return pa.RecordBatch.from_arrays(arrays, schema=schema)

    (ids, text_at, texts, found), chars = empty(), 0
    for b in it:
        for pid, html in zip(b.column("page_id").to_pylist(), b.column("html")):
            html = html.as_py()
            rows = page_tags(html)
            _, stops = pair_by_depth(rows) or pair_by_rank(rows) or pair_by_rules(rows)
            page, columns = index_page(rows, stops, spec, by_tag)
            chars += len(html or "")
            ids.append(pid)
            texts.extend(page)
            text_at.append(len(texts))
            for name, (n, values) in columns.items():
                at, held = found[name]
                at.append(at[-1] + n)
                for c, v in zip(held, values):
                    c.extend(v)
            if len(texts) >= max_rows or chars >= max_chars:
                yield batch()
                (ids, text_at, texts, found), chars = empty(), 0
    if ids:
        yield batch()


def page_index(pages: DataFrame, spec: dict[str, Indexed]) -> DataFrame:
    """Pages in a row each, for a profile that looks at few kinds of elements
    and reads them once: ``page_id``, the ``texts`` of the page and, for each
    name of ``spec``, its elements, all in document order. An element tells by
    ranges what lies in it, so the texts of a subtree, the first match inside
    and the pairs of nested elements are slices of these lists: no rows of the
    node table are written, shuffled or sorted. Ids are unique (``ids_differ``);
    pages without one are dropped."""
    from pyspark.sql.pandas.types import from_arrow_schema

    from pagelens.session import ensure_parallel, ship_package
    ship_package(pages.sparkSession)
    src = ensure_parallel(pages.select("page_id", "html").filter("page_id IS NOT NULL"))
    return src.mapInArrow(partial(_index_batches, spec=spec), from_arrow_schema(_index_schema(spec)))


def ids_differ(pages: DataFrame) -> bool:
    """Whether no page id repeats: as the plan tells (ids that are the keys of
    an aggregate), else by counting them."""
    ids = pages.select("page_id").filter("page_id IS NOT NULL")
    if not ids._jdf.queryExecution().optimizedPlan().distinctKeys().isEmpty():
        return True
    return ids.groupBy("page_id").count().filter("count > 1").isEmpty()


# ---------------------------------------------------------------------------
# the tree
# ---------------------------------------------------------------------------
def _case(values: dict, default) -> str:
    """SQL: a number for each tag."""
    of: dict = {}
    for tag, v in sorted(values.items()):
        of.setdefault(v, []).append(tag)
    return "CASE " + " ".join(f"WHEN tag IN ({_list(tags)}) THEN {v}" for v, tags in sorted(of.items())) + f" ELSE {default} END"


def _list(tags) -> str:
    return ", ".join(f"'{t}'" for t in sorted(tags))


def structure_sql(source: str, keys=("page_id",), carry=()) -> str:
    """SQL that builds the tree of the tag stream ``source``: one row for each
    node with ``parent_id``, ``open_pos`` and ``close_pos``.
    ``keys`` identify a page (none inside a table function, which sees one);
    ``carry`` are further columns to hand on."""
    k, more = "".join(f"{c}, " for c in keys), "".join(f", {c}" for c in carry)

    def over(*parts, order="seq", frame="ROWS UNBOUNDED PRECEDING"):
        p = ", ".join([*keys, *parts])
        return f"OVER ({'PARTITION BY ' + p if p else ''}{f' ORDER BY {order} {frame}' if order else ''})"

    before = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    ranks = range(1, INLINE + 1)
    alive = [f"CASE WHEN u{r} > coalesce(o, 0) AND u{r} >= coalesce(c{r}, 0) THEN u{r} END" for r in ranks]
    ends = ", ".join(f"CASE WHEN rank = {r} THEN n{r} END" for r in ranks)
    return f"""
WITH tokens AS (
  SELECT {k}seq, kind, tag{more}, CASE kind WHEN 'open' THEN 1 WHEN 'close' THEN -1 ELSE 0 END AS step FROM {source}),
-- depth of tables and of lists; a count never falls below the least so far
sums AS (
  SELECT *, sum(IF(tag = 'table', step, 0)) {over()} AS st, sum(IF(tag IN ({_list(LISTS)}), step, 0)) {over()} AS sl,
         max(seq) {over(order=None)} AS last_seq FROM tokens),
depths AS (
  SELECT *, st - least(0, min(st) {over()}) AS tables, sl - least(0, min(sl) {over()}) AS lists FROM sums),
-- the table that a token lies in; tables themselves pair in the page
placed AS (
  SELECT *, IF(tag = 'table', -1, coalesce(max(IF(kind = 'open' AND tag = 'table', seq, NULL)) {over('tables')}, 0)) AS place,
         IF(tag IN ({_list(ITEMS)}), lists, 0) AS item FROM depths),
-- 1: pairs by name
named AS (SELECT *, sum(step) {over('place', 'item', 'tag')} AS sn FROM placed),
least_named AS (SELECT *, least(0, coalesce(min(sn) {over('place', 'item', 'tag', frame=before)}, 0)) AS low FROM named),
levelled AS (
  SELECT *, kind = 'close' AND sn >= low AS ends, CASE kind WHEN 'open' THEN sn - low WHEN 'close' THEN IF(sn >= low, sn + 1 - low, -1) END AS level FROM least_named),
paired AS (
  SELECT *, kind = 'open' AND coalesce(lead(kind) {over('place', 'item', 'tag', 'level', frame='')}, '') = 'close' AS pairs FROM levelled),
-- 2: depth by pairs of any name
paired_depth AS (SELECT *, sum(IF(pairs, 1, IF(ends, -1, 0))) {over()} AS d FROM paired),
-- 3: blocks without an end tag end with the pair around them
loose AS (
  SELECT *, kind = 'open' AND NOT pairs AND tag IN ({_list(CONTAINERS)}) AS loose, IF(ends, d + 1, d) AS own FROM paired_depth),
loose_sums AS (SELECT *, sum(IF(loose, 1, 0)) {over('own')} AS blocks FROM loose),
closing AS (SELECT *, IF(ends, 1 + blocks - coalesce(max(IF(pairs, blocks, NULL)) {over('own')}, 0), 0) AS closes FROM loose_sums),
nested AS (SELECT *, sum(IF(pairs OR loose, 1, -closes)) {over()} AS depth FROM closing),
-- an element stands in the level around it and opens one; an end closes one or more
roles AS (
  SELECT {k}seq, kind, tag{more}, last_seq, pairs OR loose AS opens, {_case(RANKS, INLINE)} AS rank, {_case(ENDS, INLINE + 1)} AS ends_from,
         explode(CASE WHEN kind = 'close' THEN transform(slice(sequence(1, greatest(closes, 1)), 1, int(closes)), x -> struct(int(depth + x) AS level, 'end' AS role))
                      WHEN pairs OR loose THEN array(struct(int(depth - 1) AS level, 'node' AS role), struct(int(depth) AS level, 'opener' AS role))
                      ELSE array(struct(int(depth) AS level, 'node' AS role)) END) AS at
  FROM nested),
levels AS (
  SELECT {k}seq, kind, tag{more}, last_seq, opens, rank, ends_from, at.level AS level, at.role AS role,
         at.role = 'node' AND kind = 'open' AND NOT opens AS free FROM roles),
-- 4: what is open at the level, by rank, and what ends it
opened AS (
  SELECT *, max(IF(role = 'opener', seq, NULL)) {over('level')} AS o,
         {', '.join(f"max(IF(free AND rank = {r}, seq, NULL)) {over('level', frame=before)} AS u{r}" for r in ranks)},
         {', '.join(f"max(IF(role = 'node' AND kind <> 'text' AND ends_from <= {r}, seq, NULL)) {over('level')} AS c{r}" for r in ranks)} FROM levels),
ended AS (
  SELECT *, min(IF(role = 'end', seq, NULL)) {over('level', order='seq DESC', frame=before)} AS n0,
         {', '.join(f"min(IF(role = 'node' AND kind <> 'text' AND ends_from <= {r}, seq, NULL)) {over('level', order='seq DESC', frame=before)} AS n{r}" for r in ranks)} FROM opened),
ends_of AS (
  SELECT {k}seq, kind, tag{more}, last_seq, role, IF(role = 'node', greatest(o, {', '.join(alive)}), NULL) AS parent,
         CASE WHEN role = 'opener' THEN coalesce(n0, last_seq + 1) WHEN free THEN coalesce(least(n0, {ends}), last_seq + 1) END AS stop
  FROM ended WHERE role <> 'end')
SELECT {k}{_node('max(parent)', 'max(stop)')}{"".join(f", any_value({c}) AS {c}" for c in carry)}
FROM ends_of GROUP BY {k}seq, kind, tag, last_seq"""


def _node(parent: str, stop: str) -> str:
    """SQL: the columns of a node from its token, its parent's and the one that ends it."""
    return f"""seq AS node_id, IF(kind = 'doc', NULL, coalesce({parent}, 0)) AS parent_id, IF(kind = 'doc', 0, 2 * seq + 1) AS open_pos,
       CASE WHEN kind = 'doc' THEN 2 * last_seq + 4 WHEN kind = 'open' THEN 2 * {stop} ELSE 2 * seq + 1 END AS close_pos,
       CASE WHEN kind IN ('open', 'void') THEN 'el' ELSE kind END AS kind, tag"""


def nested_sql(source: str) -> str:
    """SQL that builds the tree of pages whose tags all pair by plain depth,
    and says of the others that they do not (``broken``)."""
    return f"""
WITH sums AS (
  SELECT *, sum(step) OVER (PARTITION BY page_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS d,
         sum(step) OVER (PARTITION BY page_id) AS total, max(seq) OVER (PARTITION BY page_id) AS last_seq
  FROM (SELECT page_id, seq, kind, tag, CASE kind WHEN 'open' THEN 1 WHEN 'close' THEN -1 ELSE 0 END AS step FROM {source})),
-- a start tag is a node in the level around it and opens one, which its end tag ends
roles AS (
  SELECT page_id, seq, kind, tag, total, last_seq, inline(CASE kind
    WHEN 'open' THEN array(struct(d AS level, 'node' AS role), struct(d + 1 AS level, 'opener' AS role))
    WHEN 'close' THEN array(struct(d + 2 AS level, 'end' AS role)) ELSE array(struct(d + 1 AS level, 'node' AS role)) END) FROM sums),
opened AS (
  SELECT *, max(IF(role = 'opener', seq, NULL)) OVER (PARTITION BY page_id, level ORDER BY seq ROWS UNBOUNDED PRECEDING) AS o,
         last_value(IF(role = 'opener', tag, NULL)) IGNORE NULLS OVER (PARTITION BY page_id, level ORDER BY seq ROWS UNBOUNDED PRECEDING) AS name FROM roles),
merged AS (
  SELECT page_id, IF(role = 'end', o, seq) AS seq, max(IF(role = 'node', kind, NULL)) AS kind, max(IF(role = 'node', tag, NULL)) AS tag,
         max(IF(role = 'node', o, NULL)) AS parent, max(IF(role = 'end', seq, NULL)) AS stop, max(last_seq) AS last_seq,
         max(total) <> 0 OR max(role = 'end' AND NOT (name <=> tag)) AS broken
  FROM opened WHERE role <> 'opener' GROUP BY page_id, IF(role = 'end', o, seq))
SELECT page_id, {_node('parent', 'stop')}, max(broken) OVER (PARTITION BY page_id) AS broken FROM merged"""


def _with_ends(tags: DataFrame) -> DataFrame:
    """The narrow stream with the end tags that nested pages were written without."""
    ends = tags.filter("nested AND kind = 'open'").selectExpr("page_id", "stop AS seq", "'close' AS kind", "tag")
    return tags.filter("NOT nested OR kind <> 'close'").select("page_id", "seq", "kind", "tag").unionByName(ends)


def build_tree(tags: DataFrame, cut=None) -> DataFrame:
    """Tag stream -> node table. Pages that the splitter paired need no shuffle. For the others
    the windows run over four narrow columns; the rest of each tag is joined to
    its node at the end. ``cut`` materialises a table that is read twice; the
    stream is then a written one, and pages whose ids repeat are built as one
    page by windows. Pages without an id are dropped."""
    spark, tags = tags.sparkSession, tags.filter("page_id IS NOT NULL")
    # a few MB of a written table are millions of rows: never one for the driver to collect and send
    one, some = tags, None
    if cut:
        some = cut(tags.filter("kind = 'doc'").groupBy("page_id").count().filter("count > 1").select("page_id"))
        if some.isEmpty():
            some = None
        else:
            one, some = tags.join(some.hint("merge"), "page_id", "left_anti"), tags.join(some.hint("merge"), "page_id", "left_semi")
    # few bytes, much work: a fixed number of partitions, or AQE would merge them by size
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    place = _node("parent", "stop").replace("last_seq", "stop")
    # without a cut ids are not known to be unique: then a page by the rules may be two of one id
    paired = "coalesce(parent, stop) IS NOT NULL" if cut else "nested"
    tree = spark.sql(f"SELECT page_id, {place}, attrs, classes, text FROM {{tags}} WHERE {paired} AND kind <> 'close'", tags=one).select(*NODE_COLS)
    left = one.filter(f"NOT ({paired})")
    if cut and some is None and left.isEmpty():
        return tree
    wide, narrow, ruled = left, left.select("page_id", "seq", "kind", "tag"), None
    if some is not None:
        tokens = _with_ends(some)
        nested = cut(spark.sql(nested_sql("{tags}"), tags=tokens.repartition(parts, "page_id")))
        narrow = narrow.unionByName(tokens.join(nested.filter("broken").select("page_id").distinct().hint("merge"), "page_id", "left_semi"))
        wide, ruled = left.unionByName(some), nested.filter("NOT broken").drop("broken")
    by_rules = spark.sql(structure_sql("{tags}"), tags=narrow.repartition(parts, "page_id"))
    ruled = by_rules if ruled is None else ruled.unionByName(by_rules)
    wide = wide.filter("kind <> 'close'").select("page_id", F.col("seq").alias("node_id"), "attrs", "classes", "text")
    ruled = wide.hint("merge").join(ruled.hint("merge"), ["page_id", "node_id"]).select(*NODE_COLS)
    return tree.unionByName(cut(ruled) if cut else ruled)


def to_nodes(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """D1, without a cut between the two steps (``node_table`` has one)."""
    return build_tree(to_tags(pages, html_col))


class _HtmlTags:
    def eval(self, html: str):
        yield from page_tags(html)


def register_sql(spark: SparkSession, pages: DataFrame | None = None) -> None:
    """SQL table functions for LATERAL joins: ``html_tags(html)``, the stream,
    and ``html_nodes(html)``, the node table of one page. Spark runs the latter
    once for each distinct html, as windows keyed by it: every token carries its
    page's html. With ``pages`` (an ``html`` column) the function answers for
    the htmls of that table, and for no others: each distinct one is split and
    built once by ``node_table``, and the LATERAL join meets it by digest."""
    from pagelens.session import ship_package, write_table
    ship_package(spark)
    rows = "seq int, kind string, tag string, attrs map<string,string>, classes array<string>, text string"
    spark.udtf.register("html_tags", F.udtf(_HtmlTags, returnType=rows).asDeterministic())
    digest = "sha2(coalesce(html, ''), 256)"
    body = structure_sql("html_tags(html)", keys=(), carry=("attrs", "classes", "text"))
    if pages is not None:
        htmls = pages.selectExpr(f"{digest} AS digest", "html").groupBy("digest").agg(F.any_value("html").alias("html"))
        htmls = write_table(htmls.withColumn("page_id", F.monotonically_increasing_id()), "htmls")
        htmls.select("page_id", "digest").createOrReplaceTempView("pagelens_htmls")
        node_table(htmls, "html_nodes").createOrReplaceTempView("pagelens_html_nodes")
        body = f"""SELECT /*+ MERGE(h, n) */ {", ".join(f"n.{c}" for c in NODE_COLS[1:])}
FROM pagelens_htmls h JOIN pagelens_html_nodes n ON n.page_id = h.page_id WHERE h.digest = {digest.replace("html,", "html_nodes.html,")}"""
    spark.sql(f"""
CREATE OR REPLACE TEMPORARY FUNCTION html_nodes(html STRING)
RETURNS TABLE (node_id INT, parent_id INT, open_pos INT, close_pos INT, kind STRING, tag STRING,
               attrs MAP<STRING, STRING>, classes ARRAY<STRING>, text STRING)
RETURN {body}""")


def parse_time(nodes: DataFrame) -> DataFrame:
    """Time per page in ms that splitting took (not deterministic)."""
    return nodes.filter(F.col("kind") == "doc").select(
        "page_id", F.col("attrs")["parse_ms"].cast("double").alias("parse_ms"))


def parse_errors(nodes: DataFrame) -> DataFrame:
    """(page_id, message) of pages whose split broke off."""
    return nodes.filter((F.col("kind") == "doc") & F.col("attrs")["parse_error"].isNotNull()).select(
        "page_id", F.col("attrs")["parse_error"].alias("message"))


def node_table(src: DataFrame, name: str = "nodes", materialize: bool = True, deal: bool = True) -> DataFrame:
    """D1 plus the lineage cuts used by multi-branch plans: the tag stream is
    written (Python runs once), and so are the nodes of the pages that take the
    longer way; those of nested pages are read from the stream in place.

    ``spark.pagelens.nodeLayout`` picks the physical layout: ``plain``
    (default) is that, dealt out by page in partitions of about ``NODES_PER_TASK``
    stream rows, so that page-keyed work shuffles once for each query and a task's
    memory does not grow with the table (Spark merges partitions by their bytes,
    and a few MB of nodes are millions of rows; without ``deal`` it does so, which
    suits a few short branches that meet in joins); ``bucketed`` writes all of it as a table bucketed by ``page_id`` (sorted
    by kind, tag), so that page-keyed windows, joins and aggregates downstream
    need no shuffle at all - the better layout when shuffles cross a network;
    on one machine the extra sorts cost more than the shuffles they replace."""
    from pagelens.session import node_buckets, write_bucketed, write_table
    if not materialize:
        return to_nodes(src)
    spark = src.sparkSession
    tags = write_table(to_tags(src, ends=False), f"{name}-tags")
    nodes = build_tree(tags, lambda t: write_table(t, f"{name}-ruled"))
    if spark.conf.get("spark.pagelens.nodeLayout", "plain") == "bucketed":
        buckets = node_buckets(spark)
        return write_bucketed(nodes.repartition(buckets, "page_id"), name.replace("-", "_"), buckets=buckets, sort_by=NODE_SORT, row_group_bytes=NODE_ROW_GROUP)
    if not deal:
        return nodes
    return nodes.repartition(max(spark.sparkContext.defaultParallelism, tags.count() // NODES_PER_TASK), "page_id")
