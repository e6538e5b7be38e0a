"""Ranked lexical search for many queries at once, with shared sub-queries.

1. Queries are dealt into blocks by the min-hash of their term sets, so that
   queries with common terms meet. In each block the shared term sets are
   mined: terms that occur in exactly the same queries are one set; then, over
   several rounds, two sets that stand near each other in at least two queries
   are joined to a new set. What comes out is a DAG: leaves are sets of terms,
   inner nodes the union of two sets, and a query is a list of disjoint nodes.
2. One pass over the texts keeps of each document its length and the counts of
   query terms, as a compact table; sums over it give N, L and each df.
3. A second pass over that table takes documents in batches: leaf accumulators
   (documents x sets) are filled from the counts, inner ones are the sum of
   their two children, each computed once, and a query's scores are the sum of
   its nodes. Each task hands on its best documents of each query; a ranked
   window, which Spark cuts to k rows before the shuffle, merges them.

All arithmetic behind the weights is in 64-bit integers, so the order of sums
cannot change a score. Blocks are taken in groups whose (query, term) pairs
fit ``GROUP_PAIRS``: that bounds the broadcast; more queries mean more passes.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from pagelens.llm import common

K = 10
BLOCK = 256                # queries mined together
REACH = 8                  # two sets further apart in a query are not joined
GROUP_PAIRS = 1 << 19      # (query, term) pairs broadcast at once
BATCH_CELLS = 1 << 21      # accumulator cells held at once
#: A-Z to a-z, digits and all non-ASCII bytes kept, every other byte to a space
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
PLAN = "block int, items array<long>, terms array<string>, leaf array<int>, left array<int>, right array<int>, starts array<int>, nodes array<int>"
HITS = "doc long, n long, terms array<int>, counts array<int>"


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


# ---------------------------------------------------------------- mining

def mine(queries: list[set], reach: int = REACH):
    """Shared term sets of a block: (terms, leaf of each term, left, right,
    nodes of each query). Nodes below the number of leaves are leaves; node
    ``leaves + i`` is the union of ``left[i]`` and ``right[i]``."""
    users = defaultdict(list)
    for q, terms in enumerate(queries):
        for t in terms:
            users[t].append(q)
    classes = defaultdict(list)
    for t in sorted(users):
        classes[tuple(users[t])].append(t)
    # frequent sets first: queries with a common core then begin alike
    order = sorted(classes, key=lambda c: (-len(c), c))
    terms, leaf, lists = [], [], [[] for _ in queries]
    for i, c in enumerate(order):
        terms += classes[c]
        leaf += [i] * len(classes[c])
        for q in c:
            lists[q].append(i)
    left, right = [], []
    shared = [[x for x in nodes if len(order[x]) > 1] for nodes in lists]
    alone = [[x for x in nodes if len(order[x]) == 1] for nodes in lists]
    while True:
        pairs = Counter((a, b) for nodes in shared for i, a in enumerate(nodes) for b in nodes[i + 1:i + 1 + reach])
        where = defaultdict(list)
        best = {p for p, n in pairs.items() if n > 1}
        for q, nodes in enumerate(shared):
            for i, a in enumerate(nodes):
                for b in nodes[i + 1:i + 1 + reach]:
                    if (a, b) in best:
                        where[a, b].append(q)
        made, used = {}, [set() for _ in shared]
        for p in sorted(best, key=lambda p: (-pairs[p], p)):
            free = [q for q in where[p] if p[0] not in used[q] and p[1] not in used[q]]
            if len(free) > 1:
                made[p] = len(order) + len(left)
                left.append(p[0])
                right.append(p[1])
                for q in free:
                    used[q].update(p)
                    shared[q][shared[q].index(p[0])] = made[p]
                    shared[q].remove(p[1])
        if not made:
            return terms, leaf, left, right, [a + b for a, b in zip(shared, alone)]


def _mine_block(batches):
    items, sets, block = [], [], 0
    for b in batches:
        items += b.column(0).to_pylist()
        sets += [set(x) for x in b.column(1).to_pylist()]
        block = b.column(2)[0].as_py() if b.num_rows else block
    if not items:
        return
    terms, leaf, left, right, nodes = mine(sets)
    starts = np.cumsum([0] + [len(x) for x in nodes]).tolist()
    row = [block, items, terms, leaf, left, right, starts, [x for n in nodes for x in n]]
    kinds = [pa.int32(), pa.list_(pa.int64()), pa.list_(pa.string()), *[pa.list_(pa.int32())] * 5]
    yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds)],
                                     names=["block", "items", "terms", "leaf", "left", "right", "starts", "nodes"])


def _term_sets(batches):
    for b in batches:
        found = [sorted({t.decode("utf-8", "surrogatepass") for t in terms_of(x.as_py())}) for x in b.column(1)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.string()))], names=["item", "terms"])


def plan_queries(items: DataFrame, id_col="item_id", text_col="text", block: int = BLOCK) -> DataFrame:
    """One row per block of queries: its terms and its DAG, as a written table.

    Rows of one id are one query (all their terms, once each); a query without
    terms has no results and is left out; a null id is a query of its own."""
    rows = items.select(F.col(id_col).cast("long").alias("item"), F.col(text_col).cast("string").alias("text"))
    sets = (rows.mapInArrow(_term_sets, "item long, terms array<string>").groupBy("item")
            .agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("terms")))).alias("terms"))
            .where(F.size("terms") > 0))
    least = F.slice(F.array_sort(F.transform("terms", lambda t: F.xxhash64(t))), 1, 2)
    sets = common.written(sets.withColumn("near", least), "search-queries")
    blocks = max(1, -(-sets.count() // block))
    dealt = sets.repartitionByRange(blocks, "near", "item").select("item", "terms", F.spark_partition_id().alias("block"))
    return common.written(dealt.mapInArrow(_mine_block, PLAN), "search-plan")


# ---------------------------------------------------------------- passes

class _Block:
    """A block's DAG over the group's term numbers."""

    def __init__(self, row, number: dict):
        self.items = np.array([-1 if x is None else x for x in row["items"]], np.int64)
        self.null = np.array([x is None for x in row["items"]])
        leaf = np.array(row["leaf"], np.int64)
        self.leaf = np.full(len(number), -1, np.int64)
        self.leaf[[number[t.encode("utf-8", "surrogatepass")] for t in row["terms"]]] = leaf
        self.leaves = int(leaf.max()) + 1
        left, right = np.array(row["left"], np.int64), np.array(row["right"], np.int64)
        self.size = self.leaves + len(left)
        level = np.zeros(self.size, np.int64)
        for i, (a, b) in enumerate(zip(left.tolist(), right.tolist())):
            level[self.leaves + i] = 1 + max(level[a], level[b])
        self.steps = [(np.flatnonzero(level == k), left[np.flatnonzero(level == k) - self.leaves],
                       right[np.flatnonzero(level == k) - self.leaves]) for k in range(1, int(level.max()) + 1)]
        self.starts, self.nodes = np.array(row["starts"][:-1], np.int64), np.array(row["nodes"], np.int64)
        #: cells per document: accumulators, a query's nodes, and its scores
        self.width = self.size + len(self.nodes) + len(self.items)

    def scores(self, doc, term, value, docs: int) -> np.ndarray:
        """Queries x documents, from (document, term, value) triples."""
        acc = np.zeros((self.size, docs), np.int64)
        at = self.leaf[term]
        own = at >= 0
        np.add.at(acc, (at[own], doc[own]), value[own])
        for to, a, b in self.steps:
            acc[to] = acc[a] + acc[b]
        return np.add.reduceat(acc[self.nodes], self.starts, axis=0)


def _read(shared):
    """(document, its terms, counts of query terms) of each text with a term."""
    def run(batches):
        number = shared.value
        for b in batches:
            docs, lengths, ids, counts, offsets = [], [], [], [], [0]
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                words = terms_of(text.as_py())
                if not words:
                    continue
                seen = Counter(words)
                hits = sorted((number[w], c) for w, c in seen.items() if w in number)
                docs.append(doc)
                lengths.append(len(words))
                ids += [h[0] for h in hits]
                counts += [h[1] for h in hits]
                offsets.append(len(ids))
            at = pa.array(offsets, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(docs, pa.int64()), pa.array(lengths, pa.int64()), pa.ListArray.from_arrays(at, pa.array(ids, pa.int32())),
                 pa.ListArray.from_arrays(at, pa.array(counts, pa.int32()))], names=["doc", "n", "terms", "counts"])
    return run


def _best(item, score, doc, null, k):
    """Positions of each item's first k by falling score, then rising id; null ids last."""
    order = np.lexsort((doc, null, -score, item))
    item = item[order]
    first = np.flatnonzero(np.r_[True, item[1:] != item[:-1]]) if len(item) else np.zeros(0, np.int64)
    rank = np.arange(len(item)) - np.repeat(first, np.diff(np.r_[first, len(item)]))
    return order[rank < k]


def _rank(shared, k: int):
    def run(batches):
        plan, weight, total, all_terms = shared.value
        number = {}
        for row in plan:
            for t in row["terms"]:
                number.setdefault(t.encode("utf-8", "surrogatepass"), len(number))
        blocks = [_Block(row, number) for row in plan]
        none = np.zeros(0, np.int64)
        held = [(none, none, none, none.astype(bool)) for _ in blocks]
        step = max(1, BATCH_CELLS // max(b.width for b in blocks))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                b = batch.slice(at, step)
                terms = b.column(2)
                size = pc.list_value_length(terms).to_numpy(zero_copy_only=False)
                doc = np.repeat(np.arange(b.num_rows), size)
                term, tf = (b.column(j).flatten().to_numpy().astype(np.int64) for j in (2, 3))
                # the product of both counts may leave 64 bits; the quotient does not
                m = 10 + np.array([90 * total * n // all_terms for n in b.column(1).to_pylist()], np.int64)
                value = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[doc]))
                null = b.column(0).is_null().to_numpy(zero_copy_only=False)
                ids = b.column(0).fill_null(-1).to_numpy()
                for i, x in enumerate(blocks):
                    s = x.scores(doc, term, value, b.num_rows)
                    item, score, found, nil = held[i]
                    least = np.zeros(len(x.items), np.int64)      # what the k-th best has so far
                    if len(item):
                        last = np.flatnonzero(np.r_[item[1:] != item[:-1], True])
                        full = np.bincount(item, minlength=len(least))[item[last]] >= k
                        least[item[last][full]] = score[last][full]
                    q, d = np.nonzero((s > 0) & (s >= least[:, None]))
                    item, score = np.r_[item, q], np.r_[score, s[q, d]]
                    found, nil = np.r_[found, ids[d]], np.r_[nil, null[d]]
                    keep = _best(item, score, found, nil, k)
                    held[i] = item[keep], score[keep], found[keep], nil[keep]
        for x, (item, score, found, nil) in zip(blocks, held):
            yield pa.RecordBatch.from_arrays(
                [pa.array(x.items[item], pa.int64(), mask=x.null[item]), pa.array(found, pa.int64(), mask=nil), pa.array(score, pa.int64())],
                names=["item_id", "doc_id", "score"])
    return run


def search(docs: DataFrame, items: DataFrame, k: int = K, id_col="doc_id", text_col="text", item_col="item_id",
           query_col="text", block: int = BLOCK, group_pairs: int = GROUP_PAIRS) -> DataFrame:
    """(item_id, rank, doc_id, score): each query's ``k`` best documents.

    Rows of documents are ranked one by one, also those with the same id or
    text; equal scores rank by ascending id, null ids last. Null and empty
    texts have no terms: such documents and queries do not appear and are not
    counted. Empty tables give an empty result. Ids are whole numbers; others
    are an error. Extra columns are not read."""
    spark = docs.sparkSession
    common.ready(spark)
    for df, c in ((docs, id_col), (items, item_col)):
        if df.schema[c].dataType.typeName() not in ("byte", "short", "integer", "long"):
            raise TypeError(f"column {c} must hold whole numbers")
    plan = plan_queries(items, item_col, query_col, block)
    sizes = sorted((r["block"], r["pairs"]) for r in plan.select("block", F.size("terms").alias("pairs")).collect())
    texts = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    groups, held = [], 0
    for number, pairs in sizes:
        if not groups or held + pairs > group_pairs:
            groups.append([])
            held = 0
        groups[-1].append(number)
        held += pairs
    found = None
    for numbers in groups:
        rows = [r.asDict() for r in plan.where(F.col("block").isin(numbers)).orderBy("block").collect()]
        vocabulary: dict = {}
        for r in rows:
            for t in r["terms"]:
                vocabulary.setdefault(t.encode("utf-8", "surrogatepass"), len(vocabulary))
        hits = common.written(texts.mapInArrow(_read(common.broadcast(spark, vocabulary)), HITS), "search-hits")
        total, length = hits.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = np.zeros(len(vocabulary), np.int64)
        for r in hits.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
            df[r["term"]] = r["count"]
        weight = np.array([math.floor(1000 * math.log((2 * total + 2) / (2 * int(x) + 1))) for x in df], np.int64)
        best = hits.mapInArrow(_rank(common.broadcast(spark, (rows, weight, total, length)), k), "item_id long, doc_id long, score long")
        found = best if found is None else found.unionByName(best)
    if found is None:
        found = spark.createDataFrame([], "item_id long, doc_id long, score long")
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("item_id", "rank", "doc_id", "score"))


def query(spark, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet")
    return search(common.documents(spark, sf_dir), items)


_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

ORACLE = f"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id,
         regexp_extract_all(translate(text, '{_UPPER}', '{_UPPER.lower()}'), '{_TERM}') AS terms FROM documents),
t AS (SELECT row, unnest(terms) AS term FROM d WHERE len(terms) > 0),
n AS (SELECT row, any_value(doc_id) AS doc_id, CAST(any_value(len(terms)) AS BIGINT) AS n FROM d WHERE len(terms) > 0 GROUP BY row),
s AS (SELECT CAST(count(*) AS BIGINT) AS total, CAST(sum(n) AS BIGINT) AS length FROM n),
q AS (
  SELECT DISTINCT item_id, term FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_UPPER.lower()}'), '{_TERM}')) AS term FROM benchmark)),
tf AS (SELECT row, term, CAST(count(*) AS BIGINT) AS tf FROM t WHERE term IN (SELECT term FROM q) GROUP BY row, term),
w AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * total + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS w
  FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), s),
c AS (
  SELECT tf.row, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * n * total) // length)))) AS c
  FROM tf JOIN w USING (term) JOIN n USING (row), s),
r AS (SELECT q.item_id, n.doc_id, CAST(sum(c) AS BIGINT) AS score FROM q JOIN c USING (term) JOIN n USING (row) GROUP BY q.item_id, row, n.doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM r WHERE score > 0)
WHERE rank <= {K}
"""
