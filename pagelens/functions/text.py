"""JS-compatible string helpers as native Column expressions.

Spark's ``trim`` strips only spaces and Java's ``\\s`` misses NBSP and the
other Unicode spaces that JavaScript's ``trim()`` and ``\\s`` cover, so the
class is spelled out. ``\\x{..}`` escapes are understood by both Java regex
(Spark) and RE2 (DuckDB), which keeps Spark code and SQL oracles aligned.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The JavaScript WhiteSpace + LineTerminator set (ECMA-262),
# i.e. what String.prototype.trim() and the regex class \s match.
JS_WS_CLASS = (
    r"\t\n\x{0B}\f\r \x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
)
JS_WS = "\t\n\x0b\f\r \xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
# Java asks the parts of a class one after the other: visible ASCII, most of a
# text, is told first (intersection and union are not in RE2).
JS_WS_RUN_RE = rf"[[^!-~]&&[{JS_WS_CLASS}]]+"
JS_WORD_RE = rf"[!-~[^{JS_WS_CLASS}]]+"


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def js_trim(c) -> Column:
    """``String.prototype.trim``."""
    return F.btrim(col_(c), F.lit(JS_WS))


def js_collapse_ws(c) -> Column:
    """``text.replace(/\\s+/g, ' ').trim()``."""
    return js_trim(F.regexp_replace(col_(c), JS_WS_RUN_RE, " "))


def or_absent(c) -> Column:
    """JS ``x || undefined``: the empty string counts as absent."""
    c = col_(c)
    return F.when(c == "", F.lit(None)).otherwise(c)


def decode_uri_component(c) -> Column:
    """``decodeURIComponent``: '+' stays '+'; malformed escapes and escapes
    that are no UTF-8 give NULL (the JS call throws; callers drop such rows).
    The decoder marks invalid bytes by U+FFFD, so a mark that the input did
    not write itself shows them."""
    c = col_(c)
    out = F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))
    mark = "\ufffd"
    marks = F.length(out) - F.length(F.replace(out, F.lit(mark), F.lit("")))
    own = F.length(c) - F.length(F.replace(c, F.lit(mark), F.lit(""))) + F.regexp_count(c, F.lit("(?i)%EF%BF%BD"))
    return F.when(marks == own, out)


def base64url_to_latin1(c) -> Column:
    """Decode a base64url payload; the bytes come back as a Latin-1 string so
    byte searches (``indexOf``) are plain string searches. Like a lenient
    decoder: it ends at '=', other foreign characters are skipped, and a last
    character that makes no byte is dropped."""
    b64 = F.substring_index(F.translate(col_(c), "-_", "+/"), "=", 1)
    b64 = F.regexp_replace(b64, "[^A-Za-z0-9+/]", "")
    b64 = F.when(F.length(b64) % 4 == 1, F.left(b64, F.length(b64) - 1)).otherwise(b64)
    return F.decode(F.unbase64(b64), "ISO-8859-1")


def latin1_to_utf8(c) -> Column:
    """Re-read a Latin-1 byte string as UTF-8, invalid sequences -> U+FFFD
    (as Buffer.toString('utf-8') does)."""
    return F.make_valid_utf8(F.encode(col_(c), "ISO-8859-1").cast("string"))


def url_host(c) -> Column:
    """Host of an absolute URL (NULL when not parsable)."""
    return F.try_parse_url(col_(c), F.lit("HOST"))


def word_count(c) -> Column:
    """Number of whitespace-separated tokens."""
    return F.regexp_count(col_(c), F.lit(JS_WORD_RE))
