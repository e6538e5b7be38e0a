"""Near duplicates by SimHash with bit-sliced comparison.

A text's fingerprint is the majority, bit by bit, of the XXH64 hashes of its
word shingles. Distinct fingerprints within ``radius`` bits are linked, and
linked ones form groups.

Search. 64 bits are cut into radius + m blocks; two fingerprints within the
radius agree on at least m whole blocks, so every link is found among rows
that share the values of some m blocks. m grows with the number of distinct
fingerprints, so that these buckets stay small. A bucket above ``BLOCK`` rows
is cut into chunks, and pairs of chunks are compared in tasks of their own.

Comparison. A task stores fingerprints as 64 vertical bit planes packed into
machine words and compares all lanes at once, with one pivot or, for many
small buckets together, with the lanes t places on: carry-save counters add
the differing planes, and a word of lanes is abandoned as soon as all its
lanes exceed the radius. In a large bucket, lanes that are linked leave it and
become pivots in turn (a search from neighbour to neighbour). Either way a
bucket gives fewer links than it has rows, and no linked text is missed.

Groups. Links form a forest per bucket; star contraction over written tables
joins them across buckets.
"""

from __future__ import annotations

import itertools
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pagelens.llm import common

SHINGLE, RADIUS = 4, 4
BLOCK = 4096
SEED = 42
_ONE = np.uint64(1)


# ---------------------------------------------------------------- fingerprints

def fingerprint(text: str, width: int = SHINGLE) -> int:
    """Words are runs of what is not ASCII white space, A-Z lower-cased;
    shingles count as often as they occur; fewer words than ``width`` are one
    shingle; no words give 0."""
    from xxhash import xxh64_intdigest
    words = text.encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    if n <= width:
        return xxh64_intdigest(joined, SEED)
    ends = list(itertools.accumulate(map(len, words)))
    ends = [e + i for i, e in enumerate(ends)]
    starts = [0] + [e + 1 for e in ends[:-1]]
    h = np.fromiter((xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, ends[width - 1:])), np.uint64, n - width + 1)
    ones = np.zeros(64, np.int64)
    for lo in range(0, len(h), 1 << 16):      # bit counts of a bounded slice
        part = h[lo:lo + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(sum(1 << int(i) for i in np.flatnonzero(2 * ones > len(h))))


def fingerprints(docs: DataFrame, id_col="doc_id", text_col="text", width: int = SHINGLE, keep=()) -> DataFrame:
    """(id, fp) and the columns in ``keep``; fp is the signed view of 64 bits."""
    common.ready(docs.sparkSession)

    @F.arrow_udf("long")
    def fp(texts: pa.Array) -> pa.Array:
        return pa.array(np.array([fingerprint(t.as_py() or "", width) for t in texts], np.uint64).view(np.int64), pa.int64())

    return docs.select(F.col(id_col).alias("id"), fp(F.col(text_col)).alias("fp"), *keep)


# ---------------------------------------------------------------- comparison

def planes_of(values: np.ndarray) -> np.ndarray:
    """64 vertical bit planes; lane i is bit i % 64 of word i // 64."""
    n = len(values)
    bits = np.zeros((-(-n // 64) * 64, 64), np.uint8)
    bits[:n] = np.unpackbits(values.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view("<u8").reshape(64, -1)


def lanes_of(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word, bit) of every set lane."""
    return np.nonzero(np.unpackbits(words.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))


def packed(lanes: np.ndarray) -> np.ndarray:
    """Booleans as words of lanes."""
    wide = np.zeros(-(-len(lanes) // 64) * 64, bool)
    wide[:len(lanes)] = lanes
    return np.packbits(wide, bitorder="little").view("<u8")


def within(diff, live: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(words, lanes) whose distance is at most ``radius``. ``diff(i, at)``
    gives the differing lanes of plane i at some words. Three planes at a time
    are added by a carry-save step into counter planes that saturate in
    ``over``; words without a lane left are abandoned."""
    width = max(1, int(radius).bit_length())
    at = np.flatnonzero(live)
    live = live[at]
    count = np.zeros((width, len(at)), np.uint64)
    over = np.zeros(len(at), np.uint64)

    def add(level, plane):
        nonlocal over
        while level < width:
            plane, count[level] = count[level] & plane, count[level] ^ plane
            level += 1
        over = over | plane

    for lo in range(0, 64, 3):
        if not len(at):
            break
        d = [diff(i, at) for i in range(lo, min(lo + 3, 64))]
        if len(d) == 3:
            half = d[0] ^ d[1]
            add(0, half ^ d[2])
            add(1, (d[0] & d[1]) | (half & d[2]))
        else:
            add(0, d[0])
        if lo % 12 == 9:
            some = (live & ~over) != 0
            if not some.all():
                at, live, over, count = at[some], live[some], over[some], count[:, some]
    # the counter is exact where it has not run over: compare with the radius
    above, equal = over.copy(), ~np.zeros(len(at), np.uint64)
    for level in range(width - 1, -1, -1):
        if radius >> level & 1:
            equal &= count[level]
        else:
            above |= equal & count[level]
            equal &= ~count[level]
    hit = live & ~above
    some = hit != 0
    return at[some], hit[some]


class Planes:
    """One bucket, for comparing a pivot with all its live lanes."""

    def __init__(self, values: np.ndarray):
        self.planes = planes_of(values)
        self.live = packed(np.ones(len(values), bool)).copy()

    def near(self, pivot: int, radius: int) -> np.ndarray:
        """Live lanes within ``radius`` bits of the pivot."""
        full = ~np.uint64(0)
        at, hit = within(lambda i, at: self.planes[i][at] ^ full if pivot >> i & 1 else self.planes[i][at], self.live, radius)
        w, b = lanes_of(hit)
        return at[w] * 64 + b

    def drop(self, lanes: np.ndarray) -> None:
        np.bitwise_and.at(self.live, lanes // 64, ~(_ONE << (lanes % 64).astype(np.uint64)))


def links(values: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """A forest of the links among the distinct fingerprints of one bucket."""
    planes, out = Planes(values), []
    done = np.zeros(len(values), bool)
    for first in range(len(values)):
        if done[first]:
            continue
        done[first] = True
        planes.drop(np.array([first]))
        queue = [first]
        while queue:
            p = queue.pop()
            found = planes.near(int(values[p]), radius)
            if len(found):
                planes.drop(found)
                done[found] = True
                queue.extend(found.tolist())
                out.extend((p, int(q)) for q in found)
    return out


def links_of_many(values: np.ndarray, bucket: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """The same for many small buckets that stand one after the other, none
    above 64 rows: all lanes are compared with the lanes t places on, for
    every t, where both are of one bucket."""
    planes = planes_of(values)
    after = np.concatenate([planes[:, 1:], np.zeros((64, 1), np.uint64)], axis=1)
    root, out = {}, []

    def find(x):
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    for t in range(1, min(64, len(values))):
        same = np.zeros(len(values), bool)
        same[:-t] = bucket[t:] == bucket[:-t]
        if not same.any():
            break
        down, up = np.uint64(t), np.uint64(64 - t)
        at, hit = within(lambda i, at: planes[i][at] ^ ((planes[i][at] >> down) | (after[i][at] << up)), packed(same), radius)
        w, b = lanes_of(hit)
        for i in (at[w] * 64 + b).tolist():
            a, c = find(i), find(i + t)
            if a != c:                 # one link fewer than a group has rows
                root[max(a, c)] = min(a, c)
                out.append((i, i + t))
    return out


def _compare(radius: int, batch_rows: int = 1 << 15):
    """Rows (bucket, fp) sorted by bucket; gives links (a, b)."""
    def run(batches):
        small, small_rows = [], 0

        def batch(values, pairs):
            a, b = (np.array(x, np.int64) for x in zip(*pairs)) if pairs else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            return pa.RecordBatch.from_arrays([pa.array(values[a].view(np.int64)), pa.array(values[b].view(np.int64))], names=["a", "b"])

        def flush():
            nonlocal small, small_rows
            values = np.concatenate(small)
            which = np.repeat(np.arange(len(small)), [len(x) for x in small])
            small, small_rows = [], 0
            return batch(values, links_of_many(values, which, radius))

        def close(held):
            nonlocal small_rows
            values = np.unique(np.concatenate(held)).view(np.uint64)
            if 1 < len(values) <= 64:
                small.append(values)
                small_rows += len(values)
                if small_rows >= batch_rows:
                    yield flush()
            elif len(values) > 64:
                yield batch(values, links(values, radius))

        held_key, held = None, []
        for b in batches:
            keys = b.column(0).to_numpy(zero_copy_only=False)
            fps = b.column(1).to_numpy(zero_copy_only=False)
            cut = np.flatnonzero(keys[1:] != keys[:-1]) + 1
            for lo, hi in zip([0, *cut.tolist()], [*cut.tolist(), len(keys)]):
                if hi == lo:
                    continue
                if held and keys[lo] != held_key:
                    yield from close(held)
                    held = []
                held_key = keys[lo]
                held.append(fps[lo:hi])
        if held:
            yield from close(held)
        if small:
            yield flush()
    return run


def scheme(n: int, radius: int) -> int:
    """How many blocks must agree: the fewest shuffled rows plus comparisons,
    a row costing about as much as a thousand comparisons."""
    def cost(m):
        bits = 64 * m / (radius + m)
        return comb(radius + m, m) * (1000 + n / 2 ** (bits + 1))
    return min(range(1, 5), key=cost)


def bucket_columns(radius: int, m: int):
    """One bucket key per choice of m blocks: a hash of the choice and of the
    bits in its blocks."""
    edges = [round(64 * i / (radius + m)) for i in range(radius + m + 1)]
    masks = [sum(1 << b for b in range(lo, hi)) for lo, hi in zip(edges, edges[1:])]
    out = []
    for k, chosen in enumerate(itertools.combinations(masks, m)):
        mask = sum(chosen)
        signed = mask - (1 << 64) if mask >> 63 else mask
        out.append(F.xxhash64(F.lit(k), F.col("fp").bitwiseAND(F.lit(signed).cast("long"))))
    return out


def link_table(distinct: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """Links (a, b) among distinct fingerprints ``fp``, at most one per row
    and bucket; every pair within the radius is connected by them."""
    n = distinct.count()
    keyed = distinct.select("fp", F.explode(F.array(*bucket_columns(radius, scheme(n, radius)))).alias("bucket"))
    big = keyed.groupBy("bucket").agg(F.count("*").alias("rows")).where(F.col("rows") > block)
    # chunks of a large bucket: each row meets each chunk once
    chunks = F.ceil(F.col("rows") / (block // 2)).cast("int")
    mine = F.pmod(F.xxhash64("fp", "bucket"), chunks).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), chunks - 1), lambda j: F.xxhash64("bucket", F.least(mine, j), F.greatest(mine, j)))
    dealt = (keyed.join(big, "bucket", "left")
             .select("fp", F.explode(F.when(F.col("rows").isNull(), F.array("bucket")).otherwise(pairs)).alias("bucket")))
    tasks = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (dealt.select("bucket", "fp").repartition(tasks, "bucket").sortWithinPartitions("bucket")
            .mapInArrow(_compare(radius), "a long, b long").distinct())


# ---------------------------------------------------------------- groups

def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node with a link; root is the group's smallest
    node. Alternates: each node sends its larger neighbours, then its smaller
    ones, to the smallest it knows (large star, small star), until nothing
    changes. Every round is a written table; a hub's neighbours are joined to
    its minimum, never collected."""
    now = common.written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links")
    if now.isEmpty():
        return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    seen = None
    while True:
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").select(F.explode(F.array(
            F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v").where("u <> v").distinct())
        now = common.written(small, "links")
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == seen:
            break
        seen = state
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def classes(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(fp, component) for every distinct fingerprint; the component is the
    smallest id of its group (null only where all its ids are null)."""
    one = common.written(prints.groupBy("fp").agg(F.min("id").alias("least")), "simhash-distinct")
    comp = common.written(components(link_table(one.select("fp"), radius)), "simhash-components")
    rooted = one.join(comp, one["fp"] == comp["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    best = rooted.groupBy("root").agg(F.min("least").alias("component"))
    return rooted.join(best, "root").select("fp", "component")


def near_duplicates(docs: DataFrame, id_col="doc_id", text_col="text", width: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """(id, fingerprint, component_id) of every row.

    Null texts are empty; texts without words have fingerprint 0 and are
    linked like any other. Null ids take part; a group's component is its
    smallest id that is not null. Repeated rows share their group; an empty
    table stays empty; other columns are not read."""
    prints = common.written(fingerprints(docs, id_col, text_col, width), "simhash")
    found = classes(prints, radius)
    return (prints.join(found, "fp")
            .select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id")))


def keep_one(docs: DataFrame, id_col="doc_id", text_col="text", width: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One row of each group: the one with the smallest id (null ids last),
    of equal ids the first in the table. Columns are unchanged."""
    u, f = common.fresh(docs.columns, "_row"), common.fresh(docs.columns + ["_row"], "_fp")
    common.ready(docs.sparkSession)

    @F.arrow_udf("long")
    def fp(texts: pa.Array) -> pa.Array:
        return pa.array(np.array([fingerprint(t.as_py() or "", width) for t in texts], np.uint64).view(np.int64), pa.int64())

    # row numbers must not change between the passes below: written once
    table = common.written(docs.withColumns({u: F.monotonically_increasing_id(), f: fp(F.col(text_col))}), "simhash-rows")
    prints = table.select(F.col(id_col).alias("id"), F.col(f).alias("fp"), F.col(u).alias("row"))
    one = common.written(prints.groupBy("fp").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("least")), "simhash-distinct")
    comp = common.written(components(link_table(one.select("fp"), radius)), "simhash-components")
    kept = (one.join(comp, one["fp"] == comp["node"], "left").groupBy(F.coalesce("root", "fp").alias("root"))
            .agg(F.min("least").alias("least")).select(F.col("least.row").alias("_kept")))
    return table.join(kept, table[u] == F.col("_kept"), "left_semi").select(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(common.documents(spark, sf_dir))
