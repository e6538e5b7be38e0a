"""Secret scan over a trigram inverted index, in DataFrame functions only.

Each rule's regex gives a Boolean query of the trigrams that every match must
hold. The index has a posting (trigram, document) for each trigram that the
rules ask for; the postings of a clause are intersected by counting them for
each document, and a document with a whole clause is a candidate of the rule.
Candidates are joined to the texts and verified by the regex; rules without
mandatory trigrams are run on every text. Spans are code points.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame, functions as F

from pagelens.llm import common
from pagelens.llm.secret_rules import BASE, RULES, clauses, trigram_query

MARK = "[SECRET]"
_SPAN = "array<struct<start:int,kind:int,end:int>>"


def _one_of(strings) -> str:
    """A regex for any of the strings, branching on first characters."""
    tree = defaultdict(list)
    for s in sorted(strings):
        tree[s[:1]].append(s[1:])
    quote = lambda c: c if c.isalnum() or c == "_" else "\\" + c
    parts = [quote(c) + (_one_of(rest) if any(rest) else "") for c, rest in tree.items()]
    return parts[0] if len(parts) == 1 else "(?:" + "|".join(parts) + ")"


def plan(rules=RULES):
    """([(rule, clause, trigrams)], rules that scan fully)."""
    listed, full = [], []
    for k, (_, regex, _, _) in enumerate(rules):
        own = clauses(trigram_query(regex))
        if any(not c for c in own):
            full.append(k)
        else:
            listed += [(k, i, sorted(c)) for i, c in enumerate(own)]
    return listed, full


def index(docs: DataFrame, trigrams, id_col="doc_id", text_col="text") -> DataFrame:
    """Postings (gram, doc), one for each document and asked trigram. Rows of
    one id count as one document here; each is verified by itself."""
    present = F.array_distinct(F.regexp_extract_all(F.lower(F.col(text_col)), F.lit("(?=(" + _one_of(trigrams) + "))"), 1))
    return docs.select(F.col(id_col).alias("doc"), F.explode(present).alias("gram"))


def candidates(docs: DataFrame, rules=RULES, id_col="doc_id", text_col="text") -> DataFrame | None:
    """(doc, rules): which rules may match in a document."""
    listed, _ = plan(rules)
    if not listed:
        return None
    spark = docs.sparkSession
    rows = ", ".join(f"({k}, {i}, {len(c)}, {_quoted(g)})" for k, i, c in listed for g in c)
    asked = spark.sql(f"SELECT * FROM VALUES {rows} AS t(rule, clause, need, gram)")     # as many rows as the rules have trigrams
    postings = index(docs, {g for _, _, c in listed for g in c}, id_col, text_col)
    whole = (postings.join(F.broadcast(asked), "gram").groupBy("doc", "rule", "clause", "need").agg(F.count_distinct("gram").alias("n"))
             .where("n = need"))
    return whole.groupBy("doc").agg(F.collect_set("rule").alias("rules"))


def _quoted(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def spans_of(text: str, regex: str, kind: int, group: int, least: int) -> str:
    """SQL: spans of all leftmost non-overlapping matches that are long
    enough. The gaps between matches place them."""
    r = _quoted(regex)
    hits = f"""filter(zip_with(split({text}, {r}, -1), arrays_zip(regexp_extract_all({text}, {r}, 0), regexp_extract_all({text}, {r}, {group})),
      (gap, hit) -> struct(length(gap) as gap, length(hit.`0`) as len, length(hit.`1`) as val)), m -> m.len is not null)"""
    rows = common.running(hits, "struct<start:int,kind:int,end:int,val:int>", "0", lambda at, m: f"{at} + {m}.gap + {m}.len", lambda a, b: f"{a} + {b}",
                          lambda at, m: f"struct({at} + {m}.gap as start, {kind} as kind, {at} + {m}.gap + {m}.len as end, {m}.val as val)")
    return f"transform(filter({rows}, m -> m.val >= {least}), m -> struct(m.start as start, m.kind as kind, m.end as end))"


#: A quick test that holds wherever a rule has a span, for rules run on all texts.
QUICK = {"hex": "[0-9a-f]{24}"}


def scan(docs: DataFrame, rules=RULES, id_col="doc_id", text_col="text", out="spans") -> DataFrame:
    """Append ``out``: array of (start, kind number, end), by start, kind.

    Null and empty texts have no spans. Ids may be null or repeat: candidates
    of an id hold for all its rows, and each row is verified by its own text,
    so repeated rows give equal spans. Whole texts are searched. An empty
    table stays empty; ``out`` is lengthened if the input has it."""
    _, full = plan(rules)
    out = common.fresh(docs.columns, out)
    t, c, d = (common.fresh(docs.columns + [out], x) for x in ("_text", "_rules", "_doc"))
    found = candidates(docs, rules, id_col, text_col)
    rows = docs.withColumn(t, F.coalesce(F.col(text_col), F.lit("")))
    if found is None:
        rows = rows.withColumn(c, F.lit(None).cast("array<int>"))
    else:
        # null ids join too; the candidates' side of a partition is hashed, so texts are not sorted
        side = found.select(F.col("doc").alias(d), F.col("rules").alias(c)).hint("shuffle_hash")
        rows = rows.join(side, F.col(id_col).eqNullSafe(F.col(d)), "left").drop(d)
    none = f"cast(array() as {_SPAN})"
    each = []
    for k, (kind, regex, group, least) in enumerate(rules):
        test = f"{t} rlike {_quoted(QUICK.get(kind, regex))}" if k in full else f"array_contains({c}, {k})"
        each.append(f"if({test}, {spans_of(t, regex, k, group, least)}, {none})")
    return rows.withColumn(out, F.array_sort(F.expr("concat(" + ",\n".join(each) + ")"))).drop(t, c)


def redacted(text: str, spans: str, mark: str = MARK) -> Column:
    """The text (a column's name) with every span, or run of overlapping spans,
    replaced. What is kept is cut out block by block, and within the block's
    own text, so that no cut counts code points from the start of the text."""
    gaps = common.running(spans, "struct<from:int,to:int>", "0", lambda at, s: f"greatest({at}, {s}.end)", lambda a, b: f"greatest({a}, {b})",
                          lambda at, s: f"struct({at} as from, {s}.start as to)")
    kept = f"""transform(array(filter({gaps}, r_g -> r_g.to >= r_g.from)), r_gaps -> transform(array(cast(greatest(32, sqrt(size(r_gaps))) as int)), r_n -> flatten(transform(
        sequence(0, greatest(size(r_gaps) - 1, 0) div r_n), r_i -> transform(array(slice(r_gaps, cast(r_i * r_n as int) + 1, r_n)), r_part -> transform(
          array(substring({text}, r_part[0].from + 1, element_at(r_part, -1).to - r_part[0].from)),
          r_here -> transform(r_part, r_g -> substring(r_here, r_g.from - r_part[0].from + 1, r_g.to - r_g.from)))[0])[0])))[0])[0]"""
    rest = f"substring({text}, aggregate({spans}, 0, (at, s) -> greatest(at, s.end)) + 1)"
    return F.expr(f"if(size({spans}) = 0, {text}, array_join(concat({kept}, array({rest})), {_quoted(mark)}))")


def redact(docs: DataFrame, id_col="doc_id", text_col="text", chars_col: str | None = None) -> DataFrame:
    """Every row with its secrets replaced; ``chars_col``, if there, gets the
    new number of code points. Columns and rows are kept."""
    name = common.fresh(docs.columns, "_spans")
    found = scan(docs, id_col=id_col, text_col=text_col, out=name)
    has = F.size(name) > 0
    new = redacted(f"`{text_col}`", f"`{name}`")
    cols = []
    for x in docs.columns:
        if x == text_col:
            cols.append(new.alias(x))
        elif x == chars_col:
            cols.append(F.when(has, F.length(new)).otherwise(F.col(x)).cast(docs.schema[x].dataType).alias(x))
        else:
            cols.append(F.col(x))
    return found.select(*cols)


def query(spark, sf_dir: str) -> DataFrame:
    found = scan(common.documents(spark, sf_dir).select("doc_id", "text"))
    names = F.array(*[F.lit(k) for k, *_ in RULES])
    text = lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{BASE[k]}")
    base = F.array_join(F.transform(F.filter("spans", lambda s: s["kind"] < len(BASE)), text), ",")
    return found.select("doc_id", count(0), count(1), count(2), F.sha2(base.cast("binary"), 256).alias("base_sha256"),
                        F.array_join(F.transform("spans", text), ",").alias("spans"))


def oracle() -> str:
    """DuckDB SQL for the query: every rule on every text, spans placed by
    the gaps between matches."""
    q = lambda x: "'" + x.replace("'", "''") + "'"
    parts = []
    for k, (kind, regex, group, least) in enumerate(RULES):
        r = q(regex)
        parts.append(f"""
  SELECT doc_id, {k} AS kind, {q(kind)} AS name, stop - length(hit) AS s, stop AS e FROM (
    SELECT doc_id, hit, val, sum(length(gap) + length(hit)) OVER (PARTITION BY doc_id ORDER BY i) AS stop FROM (
      SELECT doc_id, unnest(hits) AS hit, unnest(vals) AS val, unnest(gaps[1:len(hits)]) AS gap, generate_subscripts(hits, 1) AS i FROM (
        SELECT doc_id, regexp_extract_all(text, {r}, 0) AS hits, regexp_extract_all(text, {r}, {group}) AS vals, regexp_split_to_array(text, {r}) AS gaps
        FROM documents WHERE regexp_matches(text, {r}))))
  WHERE length(val) >= {least}""")
    return f"""
WITH spans AS ({" UNION ALL ".join(parts)}),
per AS (
  SELECT doc_id, count(*) FILTER (kind = 0) AS a, count(*) FILTER (kind = 1) AS c, count(*) FILTER (kind = 2) AS h,
    string_agg(name || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT), ',' ORDER BY s, kind, e) FILTER (kind < {len(BASE)}) AS base,
    string_agg(name || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT), ',' ORDER BY s, kind, e) AS every FROM spans GROUP BY doc_id)
SELECT d.doc_id, coalesce(a, 0) AS n_assign, coalesce(c, 0) AS n_access, coalesce(h, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(every, '') AS spans
FROM documents d LEFT JOIN per USING (doc_id)"""


ORACLE = oracle()
