"""License scan with ordered signature rules, in DataFrame functions only.

A text becomes its words, each written ``<word>``, so that one regular
expression over whole words needs no look-around and the number of ``<``
before a match is the index of its first word. A rule has a tier (0 is the
strongest kind of evidence), a label, a keyword and a regular expression. Only
texts that hold a rule's keyword are matched against it. Detections are sorted
by (start, longest first, tier, rule order); one fold with the furthest end
per tier drops every detection that lies inside one of an equal or stronger
tier. All of it happens within the row: no shuffle, no key, and hot sources
are spread as the scan is.
"""

from __future__ import annotations

import json
import re
import re._parser as P
from collections import Counter
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from pagelens.llm import common, license_bodies
from pagelens.llm.secret_rules import MAX_SET, _exact as exact_strings

# License names as word sequences, the SPDX form, and the label.
NAMES = [
    ("mit", "mit", "mit"), ("mit no attribution", "mit 0", "mit-0"), ("apache", "apache 2 0", "apache"),
    ("apache software", "apache 1 1", "apache-1.1"), ("gnu general public", "gpl 3 0", "gpl"),
    ("gnu lesser general public", "lgpl 3 0", "lgpl"), ("gnu library general public", "lgpl 2 0", "lgpl"),
    ("gnu affero general public", "agpl 3 0", "agpl"), ("gnu free documentation", "gfdl 1 3", "gfdl"),
    ("mozilla public", "mpl 2 0", "mpl"), ("eclipse public", "epl 2 0", "epl"),
    ("eclipse distribution", "edl 1 0", "edl"), ("common development and distribution", "cddl 1 0", "cddl"),
    ("common public", "cpl 1 0", "cpl"), ("ibm public", "ipl 1 0", "ipl"), ("european union public", "eupl 1 2", "eupl"),
    ("bsd", "bsd 3 clause", "bsd"), ("bsd 2 clause", "bsd 2 clause", "bsd-2"), ("bsd 3 clause", "bsd 3 clause", "bsd-3"),
    ("simplified bsd", "bsd 2 clause freebsd", "bsd-2"), ("new bsd", "bsd 3 clause clear", "bsd-3"),
    ("zero clause bsd", "0bsd", "0bsd"), ("isc", "isc", "isc"), ("zlib", "zlib", "zlib"), ("boost software", "bsl 1 0", "boost"),
    ("artistic", "artistic 2 0", "artistic"), ("perl artistic", "artistic 1 0 perl", "artistic"),
    ("python software foundation", "psf 2 0", "psf"), ("postgresql", "postgresql", "postgresql"), ("php", "php 3 01", "php"),
    ("ruby", "ruby", "ruby"), ("openssl", "openssl", "openssl"), ("x11", "x11", "x11"), ("ncsa", "ncsa", "ncsa"),
    ("w3c software", "w3c", "w3c"), ("unlicense", "unlicense", "unlicense"), ("wtfpl", "wtfpl", "wtfpl"),
    ("microsoft public", "ms pl", "ms-pl"), ("microsoft reciprocal", "ms rl", "ms-rl"), ("sil open font", "ofl 1 1", "ofl"),
    ("open software", "osl 3 0", "osl"), ("academic free", "afl 3 0", "afl"), ("educational community", "ecl 2 0", "ecl"),
    ("vim", "vim", "vim"), ("latex project public", "lppl 1 3c", "lppl"), ("server side public", "sspl 1 0", "sspl"),
    ("business source", "busl 1 1", "busl"), ("elastic", "elastic 2 0", "elastic"),
    ("open database", "odbl 1 0", "odbl"), ("open data commons attribution", "odc by 1 0", "odc-by"),
    ("community data", "cdla permissive 2 0", "cdla"), ("creative commons attribution", "cc by 4 0", "cc-by"),
    ("creative commons attribution sharealike", "cc by sa 4 0", "cc-by-sa"),
    ("creative commons attribution noncommercial", "cc by nc 4 0", "cc-by-nc"),
    ("creative commons attribution noderivatives", "cc by nd 4 0", "cc-by-nd"),
    ("creative commons attribution noncommercial sharealike", "cc by nc sa 4 0", "cc-by-nc-sa"),
    ("creative commons attribution noncommercial noderivatives", "cc by nc nd 4 0", "cc-by-nc-nd"),
    ("creative commons zero", "cc0 1 0", "cc0"),
]
# Notices that name no license of the table.
NOTICES = [
    ("public-domain", 2, "<domain>", "<(?:in|into|to)><the><public><domain>"),
    ("all-rights-reserved", 2, "<rights>", "<all><rights><reserved>"),
    ("copyright", 3, "<copyright>", "<copyright>(?:<c>)?<(?:19|20)[0-9]{2}>"),
    ("spdx", 2, "<spdx>", "<spdx><license><identifier><[^>]+>"),
    ("proprietary", 2, "<proprietary>", "<proprietary><and><confidential>"),
    ("no-warranty", 3, "<warranty>", "<without><warranty><of><any><kind>"),
    ("as-is", 3, "<provided>", "<provided><as><is>"),
]
BASE = [("mit", "<mit><license>"), ("apache", "<apache><license>"), ("gpl", "<general><public><license>")]
#: Weight of evidence by tier: an identifier, a grant or body, a name or shared sentence, a notice.
CONFIDENCE = (0.95, 0.9, 0.6, 0.3)
VERSION = "(?:<(?:version|v)>)?(?:<v?[0-9]+>(?:<[0-9]+>)?)?"
SCHEMA = "array<struct<tier:int,label:string,keyword:string,regex:string>>"


def _words(phrase: str) -> str:
    return "".join(f"<{w}>" for w in phrase.split())


def rules() -> list[dict]:
    """About 390 signatures in order: by license its identifier, grants and
    name, then sentences of license bodies, then notices."""
    out = []

    def rule(tier, label, keyword, regex):
        out.append({"tier": tier, "label": label, "keyword": keyword, "regex": regex})

    for name, spdx, label in NAMES:
        full, ident = _words(name), _words(spdx)
        body = full if name.endswith(("unlicense", "wtfpl")) else full + "<licen[sc]e>"
        rule(0, label, "<identifier>" + ident, "<spdx><license><identifier>" + ident + "(?:<only>|<or><later>)?")
        rule(1, label, full, "<licen[sc]ed><under>(?:<the>)?(?:<terms><of>(?:<the>)?)?" + full + "(?:<licen[sc]e>)?" + VERSION)
        rule(1, label, full, "<(?:released|distributed|available|published|provided|offered)><under>(?:<the>)?(?:<terms><of>(?:<the>)?)?" + full + "(?:<licen[sc]e>)?" + VERSION)
        rule(2, label, full, body + VERSION)
        if len(spdx.split()) > 1:
            rule(1, label, ident, "<licen[sc]ed><under>(?:<the>)?" + ident)
    for body_rule in license_bodies.rules():
        rule(*body_rule)
    for label, tier, keyword, regex in NOTICES:
        rule(tier, label, keyword, regex)
    return out


def spaced(text: Column) -> Column:
    """The words of a text, lower-cased, with one space between."""
    # lower() also maps the Kelvin sign to k; no phrase depends on it
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.trim(F.regexp_replace(low, "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", " "))


def needed(regex: str) -> list[frozenset[str]]:
    """Sets of plain strings: the words of every match hold one of each set.
    Only what the regex cannot do without counts, no optional part."""
    out, now = [], {""}
    for op, arg in [*P.parse(regex), (None, None)]:
        one = exact_strings([(op, arg)])
        if one and "" not in one and len(now) * len(one) <= MAX_SET:
            now = {a + b for a in now for b in one}
            continue
        out.append(frozenset(s.replace("><", " ").strip("<>") for s in now))
        now = one if one and "" not in one else {""}
    return [x for x in out if "" not in x]


def gate(table) -> list[str]:
    """Plain strings of which every text with a detection has one: the stem of
    all words for a license where a rule cannot match without it, else what
    most other rules need too, else the longest; the longest word of its
    keyword for a rule without such strings."""
    sets = [needed(r["regex"]) for r in table]
    shared = Counter(x for own in sets for x in set(own))
    stems = {"licen"}
    for r, own in zip(table, sets):
        if any(all("licen" in s for s in x) for x in own):
            continue
        if own:
            stems |= max(own, key=lambda x: (shared[x], min(map(len, x)), sorted(x)))
        else:
            stems.add(max(re.findall(r"[^<>]+", r["keyword"]), key=len))
    return sorted(s for s in stems if not any(t != s and t in s for t in stems))


_FOUND = "struct<start:int,size:int,tier:int,rule:int,label:string>"


def count_words(s: str) -> str:
    return f"(length({s}) - length(replace({s}, '<', '')))"


def spans_sql(words: str, regex: str, fields: str) -> str:
    """SQL: array of structs (start word, end word, ...) of all matches."""
    hits = f"""filter(zip_with(split({words}, {regex}, -1), regexp_extract_all({words}, {regex}, 0),
        (gap, hit) -> struct(cast({count_words('gap')} as int) as skip, cast({count_words('hit')} as int) as len)), m -> m.len is not null)"""
    return common.running(hits, _FOUND, "0", lambda at, m: f"{at} + {m}.skip + {m}.len", lambda a, b: f"{a} + {b}",
                          lambda at, m: f"struct({at} + {m}.skip as start, -{m}.len as size, {fields})")


def detect(df: DataFrame, text_col: str = "text", out: str = "license", table=None) -> DataFrame:
    """Append ``out``: struct(n_words, base, kept).

    ``base`` holds the places of the base phrases, ``kept`` the detections of
    all rules after suppression, both as (start, size = -words, tier, rule,
    label). Null text is empty: no words, no detections. Texts are read
    whole. Repeated rows stay as they are; an empty table stays empty;
    detections of equal interval and tier go to the earlier rule."""
    table = rules() if table is None else table
    out = common.fresh(df.columns, out)
    plain, w, r, hits = (common.fresh(df.columns + [out], x) for x in ("_plain", "_words", "_rules", "_hits"))
    listed = [x | {"rule": i} for i, x in enumerate(table)]
    literal = F.from_json(F.lit(json.dumps(listed)), SCHEMA.replace("tier:int", "tier:int,rule:int"))
    base = "concat(" + ", ".join(
        f"if(contains({w}, '{p}'), {spans_sql(w, repr(p), f'2 as tier, -1 as rule, {label!r} as label')}, cast(array() as array<struct<start:int,size:int,tier:int,rule:int,label:string>>))"
        for label, p in BASE) + ")"
    every = f"""array_sort(array_distinct(flatten(transform(filter({r}, x -> contains({w}, x.keyword)),
        x -> {spans_sql(w, 'x.regex', 'x.tier as tier, x.rule as rule, x.label as label')}))))"""
    # for each tier the furthest end of the detections of its own or a stronger one
    far = common.running(every, f"struct<inside:boolean,d:{_FOUND}>", "array(0, 0, 0, 0)",
                         lambda e, d: f"transform({e}, (at, i) -> if(i >= {d}.tier, greatest(at, {d}.start - {d}.size), at))",
                         lambda a, b: f"zip_with({a}, {b}, (x, y) -> greatest(x, y))",
                         lambda e, d: f"struct({e}[{d}.tier] >= {d}.start - {d}.size as inside, {d} as d)")
    kept = f"transform(filter({far}, x -> not x.inside), x -> x.d)"
    gated = df.withColumn(plain, spaced(F.col(text_col)))
    # a few plain searches decide whether a text needs any rule at all
    some = reduce(lambda x, y: x | y, [F.contains(F.col(plain), F.lit(k)) for k in gate(table)])
    gated = gated.withColumns({w: F.when(some, F.concat(F.lit("<"), F.replace(F.col(plain), F.lit(" "), F.lit("><")), F.lit(">"))), r: F.when(some, literal)})
    gated = gated.withColumn(hits, F.expr(f"if({r} is null, null, named_struct('base', {base}, 'kept', {kept}))"))
    empty = "cast(array() as array<struct<start:int,size:int,tier:int,rule:int,label:string>>)"
    return gated.withColumn(out, F.expr(
        f"named_struct('n_words', cast(if({plain} = '', 0, octet_length({plain}) - octet_length(replace({plain}, ' ', '')) + 1) as bigint), 'base', coalesce({hits}.base, {empty}), 'kept', coalesce({hits}.kept, {empty}))")).drop(plain, w, r, hits)


def query(spark, sf_dir: str) -> DataFrame:
    found = detect(common.documents(spark, sf_dir).select("doc_id", "text"))
    doubt = ", ".join(str(round(1 - c, 4)) for c in CONFIDENCE)
    scored = found.selectExpr(
        "doc_id", "license.n_words as n_words", "cast(size(license.base) as bigint) as n_base",
        "cast(array_min(transform(license.base, x -> x.start)) as bigint) as first_word",
        "cast(array_max(transform(license.base, x -> x.start)) as bigint) as last_word",
        "array_join(array_sort(array_distinct(transform(license.base, x -> x.label))), ',') as base_labels",
        "array_join(array_sort(array_distinct(transform(concat(license.base, license.kept), x -> x.label))), ',') as labels",
        # evidence of different labels adds up; of one label the strongest counts
        f"""1 - aggregate(transform(array_distinct(transform(concat(license.base, license.kept), x -> x.label)),
              l -> array_min(transform(filter(concat(license.base, license.kept), x -> x.label = l), x -> x.tier))),
            cast(1.0 as double), (p, t) -> p * array({doubt})[t]) as score""")
    return scored.withColumn("score", F.round("score", 6))


def oracle() -> str:
    """DuckDB SQL for the query: every rule on every text that has its
    keyword; a detection goes where one of an equal or stronger tier that
    comes earlier in the order holds it."""
    q = lambda x: "'" + x.replace("'", "''") + "'"
    table = ", ".join(f"({k}, {r['tier']}, {q(r['label'])}, {q(r['keyword'])}, {q(r['regex'])})" for k, r in enumerate(rules()))
    base = ", ".join(f"(-1, 2, {q(label)}, {q(p)}, {q(p)})" for label, p in BASE)
    doubt = " ".join(f"WHEN {t} THEN {round(1 - c, 4)}" for t, c in enumerate(CONFIDENCE))
    return f"""
WITH w AS (
  SELECT doc_id, regexp_replace(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', ' ', 'g'), '^ | $', '', 'g') AS p FROM documents),
m AS (SELECT doc_id, CASE WHEN p = '' THEN '' ELSE '<' || replace(p, ' ', '><') || '>' END AS w FROM w),
r(rule, tier, label, keyword, regex) AS (VALUES {base}, {table}),
g AS (SELECT doc_id, rule, tier, label, regex, regexp_extract_all(w, regex) AS hits, regexp_split_to_array(w, regex) AS gaps FROM m JOIN r ON contains(w, keyword)),
u AS (SELECT doc_id, rule, tier, label, regex, unnest(hits) AS hit, unnest(gaps[1:len(hits)]) AS gap, generate_subscripts(hits, 1) AS i FROM g),
c AS (SELECT *, length(hit) - length(replace(hit, '<', '')) AS size, length(gap) - length(replace(gap, '<', '')) AS skip FROM u),
d AS (SELECT doc_id, rule, tier, label, size, sum(size + skip) OVER (PARTITION BY doc_id, rule, label ORDER BY i) AS stop FROM c),
e AS (SELECT doc_id, rule, tier, label, size, stop - size AS start, stop FROM d),
k AS (
  SELECT x.doc_id, x.label, x.tier FROM e x WHERE x.rule >= 0 AND NOT EXISTS (
    SELECT 1 FROM e y WHERE y.rule >= 0 AND y.doc_id = x.doc_id AND y.tier <= x.tier AND y.start <= x.start AND y.stop >= x.stop
      AND (y.start, -y.size, y.tier, y.rule) < (x.start, -x.size, x.tier, x.rule))
  UNION ALL SELECT doc_id, label, tier FROM e WHERE rule < 0),
best AS (SELECT doc_id, label, min(tier) AS tier FROM k GROUP BY ALL),
s AS (SELECT doc_id, string_agg(label, ',' ORDER BY label) AS labels, 1 - product(CASE tier {doubt} END) AS score FROM best GROUP BY doc_id),
b AS (SELECT doc_id, count(*) AS n, min(start) AS a, max(start) AS z, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM e WHERE rule < 0 GROUP BY doc_id)
SELECT m.doc_id, length(w) - length(replace(w, '<', '')) AS n_words, coalesce(n, 0) AS n_base, CAST(a AS BIGINT) AS first_word, CAST(z AS BIGINT) AS last_word,
  coalesce(b.labels, '') AS base_labels, coalesce(s.labels, '') AS labels, round(coalesce(score, 0.0), 6) AS score
FROM m LEFT JOIN s USING (doc_id) LEFT JOIN b USING (doc_id)"""


ORACLE = oracle()
