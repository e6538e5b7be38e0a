"""Language-model scores by prediction by partial matching.

The trie holds, for every context of up to ``order`` bytes of the training
texts, how often each byte followed. Escapes are estimated by method C (as
many escape counts as distinct followers), and a byte that a longer context
has seen is excluded from the shorter one after an escape. Since whatever
follows a context also follows its suffix, exclusion needs one sum per
context: the count, in the suffix, of the context's own followers. So a whole
batch of positions is scored at once by table look-ups, from the longest
context down.

Counts cover all training texts. Each task sorts its own grams of order + 1
bytes and hands on sums; shorter contexts are marginal sums of the longest.
The order is the same at every size and no count is pruned. A trie of at most
``MAX_PAIRS`` (context, byte) pairs is broadcast. Of a larger one, the low
levels that fit are broadcast (order 1 has at most 65,536 pairs on any corpus)
and the upper ones stay a table: the distinct grams of each slice of texts are
dealt by the end of their context, beside all counts of contexts with that
end, and their probabilities are joined back to the slices.

The unigram base score takes word counts of the same training texts: frequent
words from a broadcast of bounded size, all others by a join.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from pagelens.llm import common

ORDER, MAX_PAIRS = 5, 1 << 21
FREQUENT = 300_000        # words in the broadcast, about
FLUSH_WORDS = 400_000     # words a task holds before it hands on sums
SLICE = 1 << 19           # positions scored at once: tables and slice share the cache
COUNTED = 1 << 20         # positions counted at once
TEXTS = 1 << 24           # bytes of texts whose grams are looked up together
BUCKET = 1 << 18          # pairs of a large trie in a bucket, about
END = 0                   # byte that ends a text


# ---------------------------------------------------------------- grams

def grams_of(data: list[bytes], order: int):
    """Gram of ``order`` context bytes and the next byte, for every byte of
    every text and its end, and where each text begins. A text starts in a
    context of zeros."""
    lengths = np.array([len(x) + 1 for x in data], np.int64)
    joined = np.frombuffer(b"".join(b"\0" * order + x + b"\0" for x in data), np.uint8)
    starts = np.cumsum(lengths + order) - (lengths + order)
    stop = np.cumsum(lengths)
    at = np.repeat(starts - (stop - lengths), lengths) + np.arange(int(stop[-1]) if len(stop) else 0)
    code = np.zeros(len(at), np.uint64)
    wide = joined.astype(np.uint64)
    for j in range(order + 1):
        code = (code << np.uint64(8)) | wide[at + j]
    return code, stop - lengths


def pieces(texts, order: int, size: int = SLICE):
    """Bounded work: (texts' bytes, their numbers); a long text comes in parts
    that carry ``order`` bytes of what went before."""
    group, numbers, total = [], [], 0
    for i, x in enumerate(texts):
        if total and total + len(x) > size:
            yield group, numbers
            group, numbers, total = [], [], 0
        group.append(x)
        numbers.append(i)
        total += len(x) + 1
    if group:
        yield group, numbers


def _count_grams(order: int):
    def run(batches):
        keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

        def batch(k, c):
            return pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(c)], names=["gram", "n"])

        for b in batches:
            texts = [(t.as_py() or "").encode("utf-8", "surrogatepass") for t in b.column(0)]
            for group, _ in pieces(texts, order, COUNTED):
                k, c = np.unique(grams_of(group, order)[0], return_counts=True)
                both, where = np.unique(np.concatenate([keys, k]), return_inverse=True)
                counts = np.bincount(where, weights=np.concatenate([counts, c]).astype(float), minlength=len(both)).astype(np.int64)
                keys = both
                if len(keys) > 1_000_000:
                    yield batch(keys, counts)
                    keys, counts = keys[:0], counts[:0]
        yield batch(keys, counts)
    return run


def _slices(size: int):
    """Appends the row number of the first of each run of rows of about ``size`` bytes."""
    def run(batches):
        at, total = None, 0
        for b in batches:
            out = []
            for row, n in zip(b.column(0).to_pylist(), pc.fill_null(pc.binary_length(b.column(3)), 0).to_pylist()):
                if at is None or total + n > size:
                    at, total = row, 0
                total += n
                out.append(at)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.int64())], names=["row", "id", "held_out", "text", "slice"])
    return run


def _slice_grams(order: int):
    """The distinct grams of each slice; one that is read in parts may repeat some."""
    def run(batches):
        at, keys = None, np.zeros(0, np.uint64)

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), at or 0)), pa.array(keys.view(np.int64))], names=["slice", "gram"])

        for b in batches:
            number = b.column(0).to_numpy()
            for part in np.split(np.arange(len(number)), np.flatnonzero(np.diff(number)) + 1):
                if not len(part):
                    continue
                if at != int(number[part[0]]):
                    yield batch()
                    at, keys = int(number[part[0]]), keys[:0]
                texts = [(t.as_py() or "").encode("utf-8", "surrogatepass") for t in b.column(1).slice(part[0], len(part))]
                for group, _ in pieces(texts, order, COUNTED):
                    keys = np.union1d(keys, grams_of(group, order)[0])
        yield batch()
    return run


def _count_words(batches):
    def batch(acc):
        return pa.RecordBatch.from_arrays([pa.array(list(acc.keys()), pa.binary()), pa.array(list(acc.values()), pa.int64())], names=["token", "n"])

    acc: Counter = Counter()
    for b in batches:
        for t in b.column(0):
            acc.update((t.as_py() or "").encode("utf-8", "surrogatepass").lower().split())
            acc[b""] += 1                      # the end
            if len(acc) > FLUSH_WORDS:
                yield batch(acc)
                acc = Counter()
    yield batch(acc)


# ---------------------------------------------------------------- model

class _Table:
    """Row number by 64-bit key: open addressing, looked up by the array."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        bits = max(4, (len(keys) * 4 // 3 + 1).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.row = np.full(1 << bits, -1, np.int32)
        todo = np.arange(len(keys), dtype=np.int32)
        slot = self._slot(keys)
        while len(todo):
            free = self.row[slot] < 0
            self.row[slot[free]] = todo[free]             # of several, the last stays
            rest = self.row[slot] != todo
            todo, slot = todo[rest], (slot[rest] + 1) & self.mask

    def _slot(self, keys):
        with np.errstate(over="ignore"):
            x = keys * np.uint64(0x9E3779B97F4A7C15)
            x ^= x >> np.uint64(29)
            return ((x * np.uint64(0xBF58476D1CE4E5B9)) >> self.shift).astype(np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row numbers; -1 where a key is not there."""
        if not len(self.keys):
            return np.full(len(keys), -1, np.int32)
        slot = self._slot(keys)
        row = self.row[slot]
        out = np.where(self.keys[row] == keys, row, -1)    # an empty slot reads the last key: its row is -1 all the same
        open_ = np.flatnonzero((row >= 0) & (out < 0))
        while len(open_):
            slot_ = slot[open_] = (slot[open_] + 1) & self.mask
            row = self.row[slot_]
            hit = (row >= 0) & (self.keys[row] == keys[open_])
            out[open_[hit]] = row[hit]
            open_ = open_[~hit & (row >= 0)]
        return out


def score_texts(texts: list[bytes], order: int, log10) -> np.ndarray:
    """log10 probability of each text with its end, of the grams' ``log10``."""
    out = np.zeros(len(texts))
    for group, numbers in pieces(texts, order):
        code, start = grams_of(group, order)
        if len(code) > 2 * SLICE:         # one very long text
            out[numbers] = sum(float(log10(code[i:i + SLICE]).sum()) for i in range(0, len(code), SLICE))
        else:
            out[numbers] = np.add.reduceat(log10(code), start)
    return out


class Model:
    """Trie of one order from its complete (gram, count) pairs. With ``low``, a
    model of a lower order: its levels, and above them the pairs of some
    contexts, complete for each end of ``low.order`` + 1 bytes."""

    def __init__(self, order: int, grams: np.ndarray, counts: np.ndarray, low: Model | None = None):
        self.order = order
        keys, counts = grams.astype(np.uint64), counts.astype(np.int64)
        self.levels: list = [None] * (order + 1)
        above = None            # the level above: keys, context of each, and the level
        for k in range(order, -1, -1):
            if low is not None and k == low.order:
                up_keys, up_ctx, up = above
                inside = low.counts[low.levels[k]["pairs"].find(up_keys & np.uint64((1 << (8 * (k + 1))) - 1))] if len(up_keys) else np.zeros(0)
                up["own"] = np.bincount(up_ctx, weights=inside, minlength=len(up["total"]))
                self.levels[:k + 1] = low.levels
                return
            if k < order:
                mask = np.uint64((1 << (8 * (k + 1))) - 1)
                keys, where = np.unique(keys & mask, return_inverse=True)
                counts = np.bincount(where, weights=counts, minlength=len(keys))
                del where
            else:
                at = np.argsort(keys)
                keys, counts = keys[at], counts[at]
                del at
                self.counts = counts
            context, ctx_of = np.unique(keys >> np.uint64(8), return_inverse=True)
            ctx_of = ctx_of.astype(np.int32)
            total = np.bincount(ctx_of, weights=counts, minlength=len(context))
            kinds = np.bincount(ctx_of, minlength=len(context)).astype(float)
            level = self.levels[k] = {
                "pairs": _Table(keys), "count": counts.astype(np.float32), "contexts": _Table(context), "total": total, "kinds": kinds,
                "first": np.log10(counts / (total + kinds)[ctx_of]).astype(np.float32) if len(keys) else np.zeros(0, np.float32)}
            if above is not None:
                up_keys, up_ctx, up = above
                inside = counts[level["pairs"].find(up_keys & mask)] if len(up_keys) else np.zeros(0)
                up["own"] = np.bincount(up_ctx, weights=inside, minlength=len(up["total"]))
            above = keys, ctx_of, level

    def log10(self, code: np.ndarray) -> np.ndarray:
        """log10 probability of the last byte of each gram, given the rest."""
        out = np.zeros(len(code))
        at = np.arange(len(code))
        # of the context above: follower counts here, and how many (0: none seen)
        own, kinds = np.zeros(len(code)), np.zeros(len(code))
        for k in range(self.order, -1, -1):
            level = self.levels[k]
            mask = np.uint64((1 << (8 * (k + 1))) - 1) if k < 7 else ~np.uint64(0)
            keys = code[at] & mask if k < self.order else code
            pair = level["pairs"].find(keys)
            plain = (pair >= 0) & (kinds == 0)
            out[at[plain]] += level["first"][pair[plain]]
            rest = np.flatnonzero(~plain)
            at, pair, own, kinds, keys = at[rest], pair[rest], own[rest], kinds[rest], keys[rest]
            if not len(at):
                return out
            ctx = level["contexts"].find(keys >> np.uint64(8))
            known = ctx >= 0
            total = np.where(known, level["total"][ctx] - own, 0.0) if len(level["total"]) else np.zeros(len(at))
            fresh = np.where(known, level["kinds"][ctx] - kinds, 0.0) if len(level["total"]) else np.zeros(len(at))
            hit = pair >= 0
            out[at[hit]] += np.log10(level["count"][pair[hit]] / (total[hit] + fresh[hit])) if hit.any() else 0
            # escape; where nothing new could follow it costs nothing
            miss = ~hit
            some = miss & (fresh > 0)
            out[at[some]] += np.log10(fresh[some] / (total[some] + fresh[some]))
            own = np.where(known, level["own"][ctx], 0.0)[miss] if k and len(level["total"]) else np.zeros(int(miss.sum()))
            kinds = np.where(known, level["kinds"][ctx], 0.0)[miss] if len(level["total"]) else np.zeros(int(miss.sum()))
            at = at[miss]
        out[at] -= np.log10(256 - kinds)      # any byte that no context has seen
        return out

    def score(self, texts: list[bytes]) -> np.ndarray:
        """log10 probability of each text with its end."""
        return score_texts(texts, self.order, self.log10)


# ---------------------------------------------------------------- on Spark

def count_grams(docs: DataFrame, text_col="text", order: int = ORDER) -> DataFrame:
    """(gram, n) of all texts."""
    common.ready(docs.sparkSession)
    return common.written(docs.select(F.col(text_col).alias("text")).mapInArrow(_count_grams(order), "gram long, n long")
                          .groupBy("gram").agg(F.sum("n").alias("n")), "ppm-grams")


def fitting(top: DataFrame, order: int, max_pairs: int = MAX_PAIRS):
    """(order, grams, counts) of the levels that can be broadcast: all, or
    those below the first with more than ``max_pairs`` pairs."""
    while order > 1 and top.count() > max_pairs:
        order -= 1
        top = common.written(top.groupBy(F.col("gram").bitwiseAND(F.lit((1 << (8 * (order + 1))) - 1)).alias("gram")).agg(F.sum("n").alias("n")), "ppm-grams")
    got = top.toArrow()
    return order, got["gram"].to_numpy().view(np.uint64), got["n"].to_numpy()


def train(docs: DataFrame, text_col="text", order: int = ORDER, max_pairs: int = MAX_PAIRS):
    """(order, grams, counts) of all texts: the trie to broadcast, of a lower
    order if that of ``order`` has more than ``max_pairs`` pairs."""
    return fitting(count_grams(docs, text_col, order), order, max_pairs)


def _low(shared) -> Model:
    key, *trie = shared.value
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Model(*trie)
    return _loaded[key]


def _scores_by_table(data: DataFrame, top: DataFrame, order: int, low) -> DataFrame:
    """(row, score) with a trie too large for a broadcast. ``data``: row, text
    and slice; ``top``: the counts; ``low``: (order, grams, counts) of the
    levels that are broadcast."""
    shared = common.broadcast(data.sparkSession, (common.token(), *low))
    end = (1 << (8 * (low[0] + 1))) - 1
    buckets = max(1, top.count() // BUCKET)
    # contexts with one end of low order + 1 bytes are complete in their bucket, at all upper levels
    bucket = F.pmod(F.xxhash64(F.shiftrightunsigned("gram", 8).bitwiseAND(F.lit(end))), F.lit(buckets)).alias("bucket")
    grams = common.written(data.select("slice", "text").mapInArrow(_slice_grams(order), "slice long, gram long"), "ppm-slice-grams")

    def look_up(pairs, asked):
        model = Model(order, pairs["gram"].to_numpy().view(np.uint64), pairs["n"].to_numpy(), _low(shared))
        code = asked["gram"].to_numpy().view(np.uint64)
        found = [model.log10(code[i:i + SLICE]) for i in range(0, len(code), SLICE)]
        return pa.table({"gram": asked["gram"], "p": pa.array(np.concatenate(found) if found else np.zeros(0))})

    def add_up(texts, known):
        keys, at = np.unique(known["gram"].to_numpy().view(np.uint64), return_index=True)
        p = known["p"].to_numpy()[at]
        data = [(t.as_py() or "").encode("utf-8", "surrogatepass") for t in texts["text"]]
        return pa.table({"row": texts["row"], "score": pa.array(score_texts(data, order, lambda code: p[np.searchsorted(keys, code)]))})

    chance = (top.select(bucket, "gram", "n").groupBy("bucket").cogroup(grams.select("gram").distinct().select(bucket, "gram").groupBy("bucket"))
              .applyInArrow(look_up, "gram long, p double"))
    known = grams.join(common.written(chance, "ppm-chances"), "gram")
    return (data.select("slice", "row", "text").groupBy("slice").cogroup(known.select("slice", "gram", "p").groupBy("slice"))
            .applyInArrow(add_up, "row long, score double"))


class _Frequent(dict):
    def __missing__(self, word):
        return 0


_loaded: dict = {}


def _score(shared):
    names = ["row", "id", "held_out", "n_tokens", "n_known", "base", "score", "rare"]
    def run(batches):
        key, order, grams, counts, words, freq = shared.value
        if key not in _loaded:
            _loaded.clear()
            _loaded[key] = None if grams is None else Model(order, grams, counts), _Frequent(zip(words, freq.tolist()))
        model, known = _loaded[key]
        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                part = b.slice(lo, 1024)
                texts = [(t.as_py() or "").encode("utf-8", "surrogatepass") for t in part.column(3)]
                n, n_known, base, ends, tokens, times = [], [], [], [0], [], []
                for x in texts:
                    w = x.lower().split()
                    w.append(b"")
                    c = np.fromiter(map(known.__getitem__, w), np.int64, len(w))
                    seen = c > 0
                    rare = Counter([w[i] for i in np.flatnonzero(~seen).tolist()])
                    n.append(len(w))
                    n_known.append(int(seen.sum()))
                    base.append(float(np.log10(c[seen] + 0.5).sum()))
                    tokens.extend(rare.keys())
                    times.extend(rare.values())
                    ends.append(len(tokens))
                pairs = pa.StructArray.from_arrays([pa.array(tokens, pa.binary()), pa.array(times, pa.int64())], names=["token", "n"])
                yield pa.RecordBatch.from_arrays([
                    part.column(0), part.column(1), part.column(2), pa.array(n, pa.int64()), pa.array(n_known, pa.int64()),
                    pa.array(base, pa.float64()), pa.nulls(len(texts), pa.float64()) if model is None else pa.array(model.score(texts), pa.float64()),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)], names=names)
    return run


def score(docs: DataFrame, held_out, id_col="doc_id", text_col="text", order: int = ORDER, max_pairs: int = MAX_PAIRS) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score).

    ``held_out`` is a condition on the input; rows where it is not true train.
    Null texts are empty: one token (the end) and the probability of ending at
    once. ``max_pairs`` bounds the broadcast and changes no result. Repeated rows train and score each by itself. Without training rows
    bytes are uniform and every base term is 0. An empty table stays empty;
    other columns are not read."""
    spark = docs.sparkSession
    common.ready(spark)
    data = docs.select(F.col(id_col).alias("id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(text_col).alias("text"))
    training = data.where(~F.col("held_out"))
    counts = common.written(training.select("text").mapInArrow(_count_words, "token binary, n long")
                            .groupBy("token").agg(F.sum("n").alias("c")), "ppm-words")
    size = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    total, vocabulary = int(size[0]), int(size[1])
    # the least count with which the words from there up fit the broadcast: one row per power of two to the driver
    steps = counts.groupBy(F.floor(F.log2("c") * 4).cast("int").alias("step")).agg(F.count("*").alias("n"), F.min("c").alias("c")).collect()
    least, held = 0, 0
    for r in sorted(steps, key=lambda r: -r["step"]):
        held += r["n"]
        if held > FREQUENT:
            break
        least = r["c"]
    frequent = counts.where(F.col("c") >= least).toArrow() if least else counts.limit(0).toArrow()
    top = count_grams(training, "text", order)
    trie = low = fitting(top, order, max_pairs)
    data = data.select(F.monotonically_increasing_id().alias("row"), "id", "held_out", "text")
    kind = data.schema["id"].dataType.simpleString()
    by_table = low[0] < order
    if by_table:
        trie = order, None, None
        data = common.written(data.mapInArrow(_slices(TEXTS), f"row long, id {kind}, held_out boolean, text string, slice long"), "ppm-slices")
    shared = common.broadcast(spark, (common.token(), *trie, frequent["token"].to_pylist(), frequent["c"].to_numpy()))
    rows = common.written(data.select("row", "id", "held_out", "text").mapInArrow(
        _score(shared), f"row long, id {kind}, held_out boolean, n_tokens long, n_known long, base double, score double, rare array<struct<token:binary,n:long>>"), "ppm-scores")
    rare = (rows.select("row", F.explode("rare").alias("r")).select("row", "r.token", "r.n").join(counts, "token", "left")
            .groupBy("row").agg(F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("more"),
                                F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("add")))
    if by_table:
        rows = rows.drop("score").join(common.written(_scores_by_table(data, top, order, low), "ppm-sums"), "row")
    norm = math.log10(total + 0.5 * (vocabulary + 1))
    return (rows.drop("rare").join(rare, "row", "left").select(
        F.col("id").alias(id_col), "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("add", F.lit(0.0)) - F.col("n_tokens") * norm).alias("base_score"), "score"))


def query(spark, sf_dir: str) -> DataFrame:
    return score(common.documents(spark, sf_dir), common.crc_of_id(modulus=5) == 1)
