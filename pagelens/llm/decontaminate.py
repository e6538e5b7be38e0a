"""Benchmark decontamination by greedy string tiling.

1. Seeds: every run of ``seed`` words of a benchmark item is a 64-bit
   Karp-Rabin hash; an item of fewer words is one run. A Bloom filter of fixed
   size holds them all.
2. Each document's runs are hashed the same way, in one pass over whole texts.
   Documents with runs in the filter give their distinct hashes and the
   stretches of words that those runs cover. Any match of at least ``seed``
   words, or of a whole shorter item, lies inside one stretch, so nothing else
   of the text is needed.
3. Hashes are joined to the items' seeds, but only to their rarer ones: of the
   seeds of an item, those held by most documents are left out as long as they
   alone could not cover enough of it, so every leak shares one of the rest and
   a lead-in common to many documents and items makes no pairs.
4. Pairs (document, item) are dealt evenly. A pair whose shared seeds could
   cover enough of the item is tiled: running Karp-Rabin finds matches of a search length
   that falls from long to ``seed``, every hash match is compared word by
   word and extended, and the longest matches are marked first, so that no
   word of either side lies in two tiles. Order does not matter, so reordered
   passages are found. A pair whose tiles cover at least ``coverage`` of the
   item's words is a leak.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pagelens.llm import common

SEED, COVERAGE = 5, 0.5
FILTER_BITS = 1 << 26        # 8 MB, whatever the benchmark
# Scripts without spaces between words: each character is a word.
_UNSPACED = ("\u0e01-\u0e3a\u0e40-\u0e4e\u0e81-\u0ece\u0edc-\u0edf\u1000-\u103f\u1050-\u108f\u1780-\u17d3\u3005-\u3007\u3041-\u3096\u309d-\u309f\u30a1-\u30fa\u30fc-\u30ff"
             "\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff")
_WORD, _SPACED = re.compile(rf"[^\W{_UNSPACED}]+|[{_UNSPACED}]"), re.compile(r"\w+")
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_WORDS_KEPT = 200_000


class _Hashes(dict):
    """64-bit hash of each word; emptied when large."""

    def __missing__(self, word):
        from xxhash import xxh64_intdigest
        if len(self) > _WORDS_KEPT:
            self.clear()
        self[word] = h = xxh64_intdigest(word.encode("utf-8", "surrogatepass"), 7)
        return h


_hashes = _Hashes()


def word_hashes(words: list[str]) -> np.ndarray:
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))


def rolling(h: np.ndarray, n: int) -> np.ndarray:
    """Karp-Rabin hashes of all runs of n words, modulo 2^64."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        if n <= 16:
            out = h[:m].copy()
            for i in range(1, n):
                out = out * _BASE + h[i:i + m]
            return out
        # longer runs from two halves
        left = rolling(h, n // 2)[:m]
        right = rolling(h[n // 2:], n - n // 2)[:m]
        return left * np.uint64(pow(int(_BASE), n - n // 2, 1 << 64)) + right


def words_of(text: str | None) -> list[str]:
    text = text or ""
    return (_SPACED if text.isascii() else _WORD).findall(text.lower())


def tiles(doc: list[list[str]], item: list[str], least: int) -> list[tuple[int, int, int, int]]:
    """Greedy string tiling of the stretches of a document against an item:
    (stretch, start in it, start in the item, length), longest first. Of equal
    lengths the earliest in the document, then in the item, is marked first."""
    dh, ih = [word_hashes(d) for d in doc], word_hashes(item)
    dmark, imark = [np.zeros(len(d), bool) for d in doc], np.zeros(len(item), bool)
    out = []
    length = max(least, min(len(item), max(map(len, doc), default=0)))
    while True:
        free = lambda mark, n: np.flatnonzero(np.convolve(mark, np.ones(n, int), "valid") == 0) if len(mark) >= n else np.zeros(0, int)
        where: dict[int, list[int]] = {}
        hashes = rolling(ih, length)
        for p in free(imark, length).tolist():
            where.setdefault(int(hashes[p]), []).append(p)
        found = []
        if where:
            wanted = np.fromiter(where, np.uint64, len(where))
            for k, d in enumerate(doc):
                h = rolling(dh[k], length)
                open_ = free(dmark[k], length)
                open_ = open_[np.isin(h[open_], wanted)] if len(open_) else open_
                for q in open_.tolist():
                    for p in where[int(h[q])]:
                        n = 0
                        while (q + n < len(d) and p + n < len(item) and d[q + n] == item[p + n] and not dmark[k][q + n] and not imark[p + n]):
                            n += 1
                        if n >= length:
                            found.append((-n, k, q, p))
        again = False
        for neg, k, q, p in sorted(found):
            n = -neg
            if dmark[k][q:q + n].any() or imark[p:p + n].any():
                again = True          # what is left of it shows in the next scan
                continue
            dmark[k][q:q + n] = True
            imark[p:p + n] = True
            out.append((k, q, p, n))
        if again:
            continue
        if length == least or imark.all():
            return out
        length = max(least, length // 2)


# ---------------------------------------------------------------- on Spark

def _places(h: np.ndarray):
    """Two bits of the filter for each hash."""
    with np.errstate(over="ignore"):
        x = h * np.uint64(0xD6E8FEB86659FD93)
    return (x >> np.uint64(20)) % np.uint64(FILTER_BITS), (x ^ (x >> np.uint64(37))) % np.uint64(FILTER_BITS)


def _item_seeds(seed: int):
    def run(batches):
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                w = words_of(t)
                h = rolling(word_hashes(w), min(seed, len(w))) if w else np.zeros(0, np.uint64)
                one, two = _places(h)
                yield pa.RecordBatch.from_arrays([
                    pa.array([i] * len(h), b.column(0).type), pa.array([len(w)] * len(h), pa.int32()), pa.array(h.view(np.int64)),
                    pa.array(np.arange(len(h), dtype=np.int32)), pa.array(one.astype(np.int64)), pa.array(two.astype(np.int64))],
                    names=["item", "words", "hash", "at", "one", "two"])
    return run


def _whole_lines(text: str, n: int) -> np.ndarray:
    """Where in the text's words a line of exactly n words begins."""
    sizes = np.array([len(words_of(x)) for x in text.splitlines()], int)
    return (np.cumsum(sizes) - sizes)[sizes == n]


def _stretches(shared, lengths: list[int], seed: int, lines: bool):
    """``lengths``: how many words the seeds have. With ``lines``, seeds of
    fewer than ``seed`` words count only where they are a whole line."""
    names = ["row", "id", "seeds", "stretches"]

    def run(batches):
        bits = shared.value
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part, out = b.slice(lo, 512), []
                for row, i, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2)):
                    w = words_of(t.as_py())
                    hashes, starts, ends, of_words = [], [], [], word_hashes(w)
                    for n in lengths:
                        h = rolling(of_words, n)
                        one, two = _places(h)
                        hit = (bits[one >> np.uint64(3)] >> (one & np.uint64(7)).astype(np.uint8)) & (bits[two >> np.uint64(3)] >> (two & np.uint64(7)).astype(np.uint8)) & np.uint8(1)
                        at = np.flatnonzero(hit)
                        if lines and n < seed and len(at):
                            at = np.intersect1d(at, _whole_lines(t.as_py(), n))
                        hashes.append(h[at])
                        starts.append(at)
                        ends.append(at + n)
                    start, end = np.concatenate(starts), np.concatenate(ends)
                    if not len(start):
                        continue
                    # runs that touch or overlap are one stretch
                    order = np.argsort(start, kind="stable")
                    start, end = start[order], np.maximum.accumulate(end[order])
                    cut = np.flatnonzero(start[1:] > end[:-1])
                    spans = zip(start[np.concatenate([[0], cut + 1])].tolist(), end[np.concatenate([cut, [len(end) - 1]])].tolist())
                    out.append((row, i, np.unique(np.concatenate(hashes)).view(np.int64), [" ".join(w[s:e]) for s, e in spans]))
                cols = list(zip(*out)) or [[]] * 4
                yield pa.RecordBatch.from_arrays([
                    pa.array(list(cols[0]), pa.int64()), pa.array(list(cols[1]), part.column(1).type),
                    pa.array(list(cols[2]), pa.list_(pa.int64())), pa.array(list(cols[3]), pa.list_(pa.string()))], names=names)
    return run


def _covered(places: np.ndarray, n: int) -> int:
    """How many words runs of n words from these (ascending) places cover."""
    return int(np.minimum(np.diff(places), n).sum()) + n if len(places) else 0


def _rare(seed: int, coverage: float):
    """The seeds of each item that a leak must share one of: all but the most
    frequent, which together cover too few of its words."""
    def run(batches):
        for b in batches:
            items, hashes = [], []
            for item, words, places in zip(*(c.to_pylist() for c in b.columns)):
                n = min(seed, words)
                order = sorted(places, key=lambda x: (-x["df"], x["hash"], x["at"]))
                taken, covered, k = np.zeros(words, bool), 0, 0
                for k, x in enumerate(order):
                    part = taken[x["at"]:x["at"] + n]
                    covered += n - int(part.sum())
                    if covered >= coverage * words:
                        break
                    part[:] = True
                keep = {x["hash"] for x in order[k:]}
                items += [item] * len(keep)
                hashes += keep
            yield pa.RecordBatch.from_arrays([pa.array(hashes, pa.int64()), pa.array(items, b.column(0).type)], names=["hash", "item"])
    return run


def _tile(seed: int, coverage: float):
    names = ["row", "id", "item", "n_tiles", "n_matched", "coverage"]

    def run(batches):
        for b in batches:
            out = []
            for row, i, item, seeds, stretches, text in zip(*(b.column(k) if k == 3 else b.column(k).to_pylist() for k in range(6))):
                words = words_of(text)
                least = max(1, min(seed, len(words)))
                shared = np.isin(rolling(word_hashes(words), least).view(np.int64), seeds.values.to_numpy())
                if _covered(np.flatnonzero(shared), least) < coverage * len(words):
                    continue
                found = tiles([s.split(" ") for s in stretches], words, least)
                n = sum(x[3] for x in found)
                if words and n >= coverage * len(words):
                    out.append((row, i, item, len(found), n, n / len(words)))
            cols = list(zip(*out)) or [[]] * 6
            kinds = [pa.int64(), b.column(1).type, b.column(2).type, pa.int32(), pa.int32(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, kinds)], names=names)
    return run


def _leaks(docs: DataFrame, bench: DataFrame, seed: int, coverage: float, lines: bool = False) -> DataFrame:
    """(row, id, item, n_tiles, n_matched, coverage); docs has row, id, text."""
    spark = docs.sparkSession
    common.ready(spark)
    kind, item_kind = docs.schema["id"].dataType.simpleString(), bench.schema["item"].dataType.simpleString()
    seeds = common.written(bench.mapInArrow(_item_seeds(seed), f"item {item_kind}, words int, hash long, at int, one long, two long"), "item-seeds")
    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    # set words of the filter: at most FILTER_BITS / 32 rows, whatever the benchmark
    place = seeds.select(F.explode(F.array("one", "two")).alias("p"))
    for r in place.groupBy(F.shiftright("p", 5).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 31 as int))")).alias("b")).toLocalIterator():
        bits[4 * r["w"]:4 * r["w"] + 4] |= np.frombuffer(int(r["b"]).to_bytes(4, "little"), np.uint8)
    # at most ``seed`` numbers
    lengths = sorted(r[0] for r in seeds.select(F.least("words", F.lit(seed))).distinct().collect())
    if not lengths:
        return spark.createDataFrame([], f"row long, id {kind}, item {item_kind}, n_tiles int, n_matched int, coverage double")
    held = common.written(docs.select("row", "id", "text").mapInArrow(
        _stretches(common.broadcast(spark, bits), lengths, seed, lines), f"row long, id {kind}, seeds array<long>, stretches array<string>"), "doc-stretches")
    common_first = held.select(F.explode("seeds").alias("hash")).groupBy("hash").agg(F.count("*").alias("df"))
    # one item's seeds are one row: as long as its text
    rare = (seeds.join(common_first, "hash", "left")
            .groupBy("item", "words").agg(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "hash", "at")).alias("places"))
            .mapInArrow(_rare(seed, coverage), f"hash long, item {item_kind}"))
    pairs = held.select("row", F.explode("seeds").alias("hash")).join(rare, "hash").select("row", "item").distinct()
    texts = bench.select(F.col("item").alias("of"), "text")
    full = (pairs.join(held.select("row", "id", "seeds", "stretches"), "row").join(texts, F.col("item").eqNullSafe(F.col("of")))
            .select("row", "id", "item", "seeds", "stretches", "text"))
    # dealt by count: a few bytes may be much work
    dealt = full.repartition(4 * spark.sparkContext.defaultParallelism, "row", "item")
    return dealt.mapInArrow(_tile(seed, coverage), f"row long, id {kind}, item {item_kind}, n_tiles int, n_matched int, coverage double")


def _items(bench: DataFrame, text_col: str) -> DataFrame:
    """(item, text): the distinct texts, numbered. Written, so that the numbers stay."""
    texts = bench.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")).distinct()
    return common.written(texts.select(F.monotonically_increasing_id().alias("item"), "text"), "items")


def leaks(docs: DataFrame, bench: DataFrame, id_col="doc_id", text_col="text", item_col="item_id", item_text="text",
          seed: int = SEED, coverage: float = COVERAGE) -> DataFrame:
    """(id, item, n_tiles, n_matched, coverage) of every leak.

    Words are runs of word characters, lower-cased; in scripts without spaces
    each character is one. Null and empty texts leak nothing; an item of fewer
    than ``seed`` words leaks as a whole only. Every text of an item id, null
    or repeated, is an item of its own; repeated rows of the benchmark count
    once, repeated documents give repeated pairs; null ids, of either side, are
    reported as null. An empty table on either side gives no pairs. Other
    columns are not read."""
    data = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    items = _items(bench, item_text)
    names = (bench.select(F.col(item_col).alias("name"), F.coalesce(F.col(item_text), F.lit("")).alias("text")).distinct()
             .join(items, "text").select("item", "name"))
    found = _leaks(data, items, seed, coverage).join(names, "item")
    return found.select(F.col("id").alias(id_col), F.col("name").alias(item_col), "n_tiles", "n_matched", "coverage")


def clean(docs: DataFrame, bench: DataFrame, text_col="text", item_col="item_id", item_text="text", seed: int = SEED, coverage: float = COVERAGE) -> DataFrame:
    """Documents that leak no item; columns unchanged. An item of fewer than
    ``seed`` words ("yes", a name) stands in many ordinary documents: it takes
    out only those that have it as a whole line (``str.splitlines``), with no
    other word in that line; ``leaks`` reports it anywhere. Rows are told apart
    by the hash of their texts, so equal texts go together. ``item_col`` is not
    read: every text of the benchmark is an item."""
    name = common.fresh(docs.columns, "_text")
    data = docs.select(F.monotonically_increasing_id().alias("row"), F.col(text_col).alias("text"), F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256).alias("id"))
    bad = _leaks(data, _items(bench, item_text), seed, coverage, lines=True).select(F.col("id").alias(name)).distinct()
    text = F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256)
    return docs.join(bad, text == F.col(name), "left_anti")


def query(spark, sf_dir: str) -> DataFrame:
    bench = spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet")
    return leaks(common.documents(spark, sf_dir), bench)
