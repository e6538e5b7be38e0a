"""Toxicity by maximum-scoring segments.

Training (labelled rows only, one of each group of copies: a passage that is
copied a hundred times is one observation, not a hundred):

1. Every word gives features: the word itself and its prefixes of 4 to 8
   characters (invented or inflected abuse shares stems). A document counts a
   feature log2(1 + occurrences) times, so that one document that repeats a
   word does not make it a class marker.
2. A feature's weight is its log-odds between toxic and clean documents under
   an informative Dirichlet prior (the prior of a feature is its share of all
   labelled text), less one posterior standard deviation. Features whose
   z-value stays under ``min_z`` carry no weight.
3. A word takes the weight of its feature with the largest z; a word without
   one costs ``gap``. A uniform negative drift makes the segment statistics of
   Karlin and Altschul apply.

Scoring: one linear scan (Ruzzo and Tompa) finds all maximal-scoring segments.
A word that recurs within one excursion of the running score counts less each
time; where the running score has fallen back to zero, counting starts anew, so
a passage that returns later in the text weighs what it weighed before. Every
maximal segment lies in one excursion. A segment's E-value is
K n exp(-lambda S), with lambda from the score distribution of clean training
text and K from its maxima, both under the same weights; n is the number of
distinct runs of three words, since repeated text is no further chance. The
document's p-value is the smallest of the sum statistics over its r best
distinct segments (multiplicity-corrected), and the score is the posterior of
label 1 under the bound -e p ln p of the Bayes factor and the training prior.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pagelens.llm import common

WORD = re.compile(r"\w+")
PREFIXES = (4, 5, 6, 7, 8)
MAX_FEATURES = 50_000      # bound of the broadcast model
MAX_TRAIN_ROWS = 30_000    # bound of the labelled sample (expected size)
FLUSH = 300_000            # features a task holds before it hands on partial sums
THRESHOLD = 0.7
MIN_E = 1e-280
MIN_Z, MIN_WEIGHT = 3.0, 1.0
TAIL = 0.99                # quantile of clean texts at which K is fitted, beside the mean
MOST = 2.0                 # most that one document counts a feature


@dataclass
class Model:
    """Bounded by MAX_FEATURES entries."""

    weights: dict[str, tuple[float, float]] = field(default_factory=dict)  # feature -> (weight, z)
    gap: float = 0.1
    lam: float = 1.0
    log_k: float = 0.0
    prior: float = 0.1
    alpha: float = 1e-3


def features(text: str):
    """Distinct features of a text with their damped counts."""
    words = Counter(WORD.findall(text.lower()))
    out: Counter = Counter()
    for w, n in words.items():
        out["=" + w] += n
        for k in PREFIXES:
            if len(w) < k:
                break
            out[w[:k]] += n
    return {f: min(math.log2(1 + n), MOST) for f, n in out.items()}


def sketches(text: str) -> list[int]:
    """Three min-hashes of the five-word shingles: copies agree in them."""
    from xxhash import xxh64_intdigest
    words = text.lower().split()
    h = np.array([xxh64_intdigest(" ".join(words[i:i + 5]).encode("utf-8", "surrogatepass"), 1) for i in range(max(1, len(words) - 4))], np.uint64)
    out = []
    with np.errstate(over="ignore"):
        for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9):
            x = h * np.uint64(m)
            out.append(int((x ^ (x >> np.uint64(31))).min().astype(np.int64)))
    return out


def word_weight(word: str, weights: dict, gap: float) -> float:
    best = weights.get("=" + word)
    for k in PREFIXES:
        if len(word) < k:
            break
        x = weights.get(word[:k])
        if x is not None and (best is None or abs(x[1]) > abs(best[1])):
            best = x
    return best[0] if best is not None else -gap


class _Cache(dict):
    """Weights of words; emptied when large, so that memory stays bounded."""

    def __init__(self, model: Model):
        self.model = model

    def __missing__(self, word):
        if len(self) > 200_000:
            self.clear()
        self[word] = v = word_weight(word, self.model.weights, self.model.gap)
        return v


def segments(weights: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end exclusive, score), in linear
    time: only positions with positive weight open or extend a segment, and
    each candidate keeps a link to the nearest one on its left that starts
    lower, so the search never walks the list again."""
    cum = np.cumsum(weights)
    pos = np.flatnonzero(weights > 0)
    stack: list[list] = []  # [start, end, left sum, right sum, link]
    for p in pos.tolist():
        right = float(cum[p])
        start, left = p, right - float(weights[p])
        j = len(stack) - 1
        while True:
            while j >= 0 and stack[j][2] >= left:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= right:
                stack.append([start, p + 1, left, right, j])
                break
            start, left = stack[j][0], stack[j][2]
            link = stack[j][4]
            del stack[j:]
            j = link
    return [(s, e, r - l) for s, e, l, r, _ in stack]


def damped(words: list[str], w: np.ndarray) -> np.ndarray:
    """Weights in which the k-th occurrence of a word in one excursion of the
    running score gains log2((k + 1) / k) of its weight."""
    w = w.copy()
    at = np.flatnonzero(w > 0)
    # between two positive places the running score only falls
    falls = np.add.reduceat(w, at) - w[at] if len(at) else at
    seen: Counter = Counter()
    run = 0.0
    for i, x, fall in zip(at.tolist(), w[at].tolist(), falls.tolist()):
        seen[words[i]] += 1
        k = seen[words[i]]
        if k > 1:
            x *= math.log2((k + 1) / k)
            w[i] = x
        run += x + fall
        if run <= 0:
            run = 0.0
            seen.clear()
    return w


def places(words: list[str]) -> int:
    """Distinct runs of three words: how many places a segment could have by
    chance. A text and its copies in a row have the same few."""
    if len(words) < 3:
        return len(words)
    number: dict[str, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.uint64, len(words))
    with np.errstate(over="ignore"):
        m = np.uint64(0x9E3779B97F4A7C15)
        runs = (ids[:-2] * m + ids[1:-1]) * m + ids[2:]
    return len(np.unique(runs))


def scan(text: str | None, cache: _Cache):
    """(words, damped weights, segments) of a whole text."""
    words = WORD.findall((text or "").lower())
    if not words:
        return words, np.zeros(0), []
    w = damped(words, np.fromiter(map(cache.__getitem__, words), np.float64, len(words)))
    return words, w, segments(w)


def p_value(n: int, segs, model: Model) -> float:
    """Chance that clean text of n places has segments as good as these."""
    if not segs:
        return 1.0
    shift = model.log_k + math.log(max(n, 1))
    norm = sorted((model.lam * s - shift for _, _, s in segs), reverse=True)
    best, total = 1.0, 0.0
    for r, x in enumerate(norm, 1):
        if r > 1 and x <= 0:
            break
        total += x
        if r == 1:
            p = -math.expm1(-math.exp(-min(total, 600.0))) if total > -6 else 1.0
        else:
            logp = -total + (r - 1) * math.log(max(total, 1e-9)) - math.lgamma(r + 1) - math.lgamma(r)
            p = math.exp(max(min(logp, 0.0), -600.0)) if total > r else 1.0
        best = min(best, p * 2 ** r / 2)
    return min(max(best, MIN_E), 1.0)


def posterior(p: float, prior: float) -> float:
    bound = -math.e * p * math.log(p) if p < 1 / math.e else 1.0
    odds = prior / (1 - prior) / max(bound, 1e-300)
    return odds / (1 + odds)


def score_text(text: str | None, model: Model, cache: _Cache):
    """(score, significant segments as word intervals with E-values)."""
    words, _, segs = scan(text, cache)
    n = places(words) if segs else 0
    # a passage that recurs is one piece of evidence
    p = p_value(n, list({tuple(words[s:e]): (s, e, x) for s, e, x in segs}.values()), model)
    shift = model.log_k + math.log(max(n, 1))
    found = [(s, e, math.exp(min(shift - model.lam * x, 600.0))) for s, e, x in segs]
    return posterior(p, model.prior), [x for x in found if x[2] <= model.alpha]


def weigh(rows, n_toxic: float, n_clean: float, alpha0: float = 100.0, min_z: float = MIN_Z, min_weight: float = MIN_WEIGHT):
    """Feature weights from (feature, toxic count, clean count); ``n_toxic``
    and ``n_clean`` are the most that a feature could have, so that a class of
    longer texts does not raise every common word. A weight must matter, not
    only be certain: small shifts of a whole language carry none."""
    total = n_toxic + n_clean
    out = {}
    for f, t, c in rows:
        a = 0.5 + alpha0 * (t + c) / max(total, 1.0)
        t, c = t + a, c + a
        nt, nc = n_toxic + 2 * a + 1, n_clean + 2 * a + 1
        delta = math.log(t / (nt - t)) - math.log(c / (nc - c))
        sd = math.sqrt(1 / t + 1 / c)
        z = delta / sd
        if z >= min_z and delta - sd >= min_weight:
            out[f] = (delta - sd, z)
        elif z <= -min_z and delta + sd <= -min_weight:
            out[f] = (max(delta + sd, -2.0), z)
    return out


def solve_lambda(scores: dict[float, float]) -> float:
    """The positive root of sum p(s) exp(lambda s) = 1."""
    total = sum(scores.values())
    f = lambda lam: sum(p / total * math.exp(min(lam * s, 700)) for s, p in scores.items()) - 1
    if not any(s > 0 for s in scores):
        return 1.0
    lo, hi = 1e-6, 1e-3
    while f(hi) < 0 and hi < 64:
        lo, hi = hi, hi * 2
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if f(mid) < 0 else (lo, mid)
    return lo


# ---------------------------------------------------------------- on Spark

def _count_features(batches):
    """Per flush: (feature, fold, label, damped count) partial sums."""
    def rows(acc):
        keys = list(acc)
        return pa.RecordBatch.from_arrays([
            pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()),
            pa.array([k[2] for k in keys], pa.int32()), pa.array([acc[k] for k in keys], pa.float64())],
            names=["feature", "fold", "label", "n"])

    acc: Counter = Counter()
    for b in batches:
        for text, fold, label in zip(b.column(0), b.column(1).to_pylist(), b.column(2).to_pylist()):
            for f, n in features(text.as_py() or "").items():
                acc[f, fold, label] += n
            if len(acc) >= FLUSH:
                yield rows(acc)
                acc = Counter()
    yield rows(acc)


def _background(models):
    """Of clean training documents: the word-score histogram (kind 0) and each
    document's places and best segment (kind 1)."""
    def run(batches):
        caches = [_Cache(m) for m in models.value]
        for b in batches:
            hist: Counter = Counter()
            kind, x, y = [], [], []
            for text, fold in zip(b.column(0), b.column(1).to_pylist()):
                words, w, segs = scan(text.as_py(), caches[fold])
                if words:
                    for value, n in zip(*(v.tolist() for v in np.unique(np.round(w, 2), return_counts=True))):
                        hist[value] += n
                    kind.append(1), x.append(float(places(words))), y.append(max((s for *_, s in segs), default=0.0))
            yield pa.RecordBatch.from_arrays([
                pa.array([0] * len(hist) + kind, pa.int32()), pa.array([*hist.keys(), *x], pa.float64()),
                pa.array([*map(float, hist.values()), *y], pa.float64())], names=["kind", "x", "y"])
    return run


def _sketch(text: str):
    @F.arrow_udf("array<long>")
    def sketch(texts: pa.Array) -> pa.Array:
        return pa.array([sketches(t.as_py() or "") for t in texts], pa.list_(pa.int64()))
    return sketch(text)


def _without_copies(table: DataFrame) -> DataFrame:
    """Rows of the bounded sample whose id is the smallest of its class with
    each of its sketches."""
    left = table.select("id", "label", "k")
    for j in range(3):
        least = left.groupBy("label", F.col("k")[j].alias("kj")).agg(F.min("id").alias("id")).select("id")
        left = left.join(F.broadcast(least), "id", "left_semi")
    return table.join(F.broadcast(left.select("id")), "id", "left_semi").select("text", "fold", "label")


def train(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", label_col="toxic",
          max_rows: int = MAX_TRAIN_ROWS, min_z: float = MIN_Z, gap: float = 0.1, usable=None) -> Model:
    """Fit the model on labelled rows that ``usable`` (a condition on the id)
    admits, at most about ``max_rows`` of them by a hash of the id.

    Weights that calibrate a document come from the other half of the sample
    (cross-fitting); weights that score new text come from all of it."""
    spark = docs.sparkSession
    common.ready(spark)
    rows = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    if usable is not None:
        rows = rows.where(usable)
    rows = rows.groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("label"))
    h = F.pmod(F.xxhash64("id"), F.lit(1 << 30))
    share = min(1.0, max_rows / max(1, rows.count()))
    sample = rows.where(h < F.lit(int(share * (1 << 30)))).withColumn("fold", F.pmod(F.xxhash64(F.lit("fold"), "id"), F.lit(2)).cast("int"))
    # the sample is bounded by max_rows, so its ids may be broadcast; a
    # repeated id counts once
    table = common.written(
        docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
        .join(F.broadcast(sample), "id").groupBy("id", "fold", "label").agg(F.min("text").alias("text"))
        .select("id", "fold", "label", "text", _sketch("text").alias("k")), "toxicity-sample")
    table = common.written(_without_copies(table), "toxicity-train")
    sums = common.written(
        table.select("text", "fold", "label").mapInArrow(_count_features, "feature string, fold int, label int, n double")
        .groupBy("feature").agg(*[
            F.sum(F.when((F.col("fold") == f) & (F.col("label") == y), F.col("n")).otherwise(0.0)).alias(f"n{f}{y}")
            for f in (0, 1) for y in (0, 1)]), "toxicity-features")
    counted = table.groupBy("fold", "label").count().collect()
    docs_of = {(r["fold"], r["label"]): r["count"] for r in counted}
    n = {f"n{f}{y}": MOST * docs_of.get((f, y), 0) for f in (0, 1) for y in (0, 1)}
    # a feature of fewer than two toxic and six clean counts cannot reach min_z
    rough = sums.where((F.col("n01") + F.col("n11") >= 2) | (F.col("n00") + F.col("n10") >= 6))
    t, c = F.col("n01") + F.col("n11") + 0.5, F.col("n00") + F.col("n10") + 0.5
    nt, nc = n["n01"] + n["n11"] + 1.0, n["n00"] + n["n10"] + 1.0
    z = F.abs(F.log(t / nt) - F.log(c / nc)) / F.sqrt(1 / t + 1 / c)
    best = rough.withColumn("z", z).where(F.col("z") >= min_z * 0.6).orderBy(F.desc("z"), "feature").limit(MAX_FEATURES).collect()
    def half(f):
        return weigh(((r["feature"], r[f"n{f}1"], r[f"n{f}0"]) for r in best), n[f"n{f}1"], n[f"n{f}0"], min_z=min_z)
    whole = weigh(((r["feature"], r["n01"] + r["n11"], r["n00"] + r["n10"]) for r in best), n["n01"] + n["n11"], n["n00"] + n["n10"], min_z=min_z)
    model = Model(whole, gap)
    crossed = common.broadcast(spark, [Model(half(1), gap), Model(half(0), gap)])
    clean = table.where("label = 0").select("text", "fold")
    back = common.written(clean.mapInArrow(_background(crossed), "kind int, x double, y double"), "toxicity-background")
    hist = {r["x"]: r["n"] for r in back.where("kind = 0").groupBy("x").agg(F.sum("y").alias("n")).collect()}
    if hist and any(s > 0 for s in hist):
        model.lam = solve_lambda(hist)
        top = F.lit(model.lam) * F.col("y") - F.log("x")
        mean, tail = back.where("kind = 1").agg(F.avg(top), F.percentile_approx(top, TAIL, 10_000)).first()
        # K from the mean of the maxima and from their tail; the stricter holds
        model.log_k = max(float(mean) - 0.5772156649, float(tail) + math.log(-math.log(TAIL)))
    toxic = docs_of.get((0, 1), 0) + docs_of.get((1, 1), 0)
    model.prior = (toxic + 1) / (sum(docs_of.values()) + 2)
    return model


def score_column(spark, model: Model, text="text"):
    """Column: struct(score, passages) of a text column; null text is ''."""
    common.ready(spark)
    shared = common.broadcast(spark, model)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("e_value", pa.float64())]))

    @F.arrow_udf("score double, passages array<struct<start int, end int, e_value double>>")
    def toxicity(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = shared.value
        cache = _Cache(m)
        for batch in batches:
            scores, found = [], []
            for x in batch:
                s, segs = score_text(x.as_py(), m, cache)
                scores.append(s)
                found.append([dict(start=a, end=b, e_value=e) for a, b, e in segs])
            yield pa.StructArray.from_arrays([pa.array(scores, pa.float64()), pa.array(found, kind)], names=["score", "passages"])

    return toxicity(F.col(text) if isinstance(text, str) else text)


def score(docs: DataFrame, model: Model, text_col="text", out="toxicity") -> DataFrame:
    """Append ``out``: struct(score, passages).

    Null and empty texts score the value of a text without evidence (the
    training prior). Equal texts score alike; repeated rows stay. A passage is
    reported at every place where it recurs apart from itself, and text that
    repeats does not lower the score. An empty table gives an empty table. ``out`` is lengthened if the input has it."""
    return docs.withColumn(common.fresh(docs.columns, out), score_column(docs.sparkSession, model, text_col))


def reject_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text_col="text") -> DataFrame:
    """Documents whose score stays below ``threshold``; columns unchanged."""
    return docs.where(score_column(docs.sparkSession, model, text_col)["score"] < threshold)


def fitted(spark, sf_dir: str) -> Model:
    """The model of the held-out protocol: crc32(id) mod 3 is not 1."""
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")
    return train(common.documents(spark, sf_dir), labels, usable=common.crc_of_id() != 1)


def query(spark, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir).select("doc_id", "text")
    t = score_column(spark, fitted(spark, sf_dir))
    return (docs.select("doc_id", (common.crc_of_id() == 1).alias("held_out"), t.alias("t"))
            .select("doc_id", "held_out", F.col("t.score").alias("score"),
                    (F.col("t.score") >= THRESHOLD).cast("int").alias("predicted"),
                    F.size("t.passages").alias("n_passages")))
