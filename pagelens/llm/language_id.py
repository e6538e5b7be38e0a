"""Language identification by string kernels.

The kernel of two texts counts the n-grams (1 to 4 bytes of UTF-8, lower case,
whatever is no letter or mark as one space) that both hold: presence, not
frequency, blended over all lengths, and normalised. The n-grams that count
are those of at least two landmarks.

Landmarks are a fixed number of training texts, dealt evenly to the languages.
Nyström: with C the landmarks' kernel matrix and k(x) a text's kernels with
them, C^(-1/2) k(x) stands for the text. One ridge regression for each language
against the rest, all languages weighing alike, gives its linear score; both
steps fold into one matrix A (landmarks x languages). Texts are scored in
batches: presence (texts x n-grams) times landmarks' presence (n-grams x
landmarks), normalised, times A.

The score is the softmax of the linear scores, its scale fitted on rows that
the fit left out. Training takes at most about ``max_rows`` rows, as many of
each language, by a hash of the id, and one of each group of equal texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window, functions as F

from pagelens.llm import common

LONGEST = 4                # bytes of the longest n-gram
LANDMARKS = 256            # in all
MAX_ROWS = 8_000           # bound of the training sample (expected size)
LANDMARK_BYTES = 8_192     # longer texts are no landmarks: bounds the n-grams that count
PIECE = 1 << 20            # bytes whose n-grams are made at once
CELLS = 1 << 25            # presence cells held at once
COLUMNS = 1 << 14          # n-grams multiplied at once
RIDGE = (1e-4, 1e-3, 1e-2, 1e-1, 1.0)
SCALES = tuple(2.0 ** k for k in range(0, 8))
UNKNOWN = "und"
_OTHER = regex.compile(r"[^\p{L}\p{M}]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def normalised(text: str | None) -> bytes:
    return (" " + _OTHER.sub(" ", (text or "").lower()).strip() + " ").encode("utf-8", "surrogatepass")


def has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


def grams(data: bytes) -> Iterator[np.ndarray]:
    """Codes of all n-grams, an array for each length; the length is part of
    the code, so codes of different lengths never meet."""
    wide = np.frombuffer(data, np.uint8).astype(np.uint64)
    code = np.ones(len(wide), np.uint64)
    for k in range(LONGEST):
        if len(wide) <= k:
            return
        code = (code[:len(wide) - k] << np.uint64(8)) | wide[k:]
        yield code


class Vocabulary:
    """Numbers of n-grams by a hash table: one probe answers nearly always."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        bits = max(8, int(8 * max(1, len(codes))).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.zeros(1 << bits, np.uint64)     # no code is 0
        self.number = np.full(1 << bits, -1, np.int64)
        slot = self._slot(codes)
        left = np.arange(len(codes))
        while len(left):
            free = self.keys[slot[left]] == 0
            first = np.unique(slot[left][free], return_index=True)[1]
            put = left[free][first]
            self.keys[slot[put]] = codes[put]
            self.number[slot[put]] = put
            left = np.setdiff1d(left, put, assume_unique=True)
            slot[left] = (slot[left] + 1) & self.mask

    def _slot(self, codes):
        with np.errstate(over="ignore"):
            return ((codes * _MIX) >> self.shift).astype(np.int64)

    def find(self, codes: np.ndarray) -> np.ndarray:
        """Numbers of those codes that the vocabulary holds (in no order)."""
        slot, out = self._slot(codes), []
        while len(codes):
            key = self.keys[slot]
            out.append(self.number[slot[key == codes]])
            go = (key != codes) & (key != 0)
            codes, slot = codes[go], (slot[go] + 1) & self.mask
        return np.concatenate(out) if out else np.zeros(0, np.int64)


def presence(row: np.ndarray, data: bytes, vocabulary: Vocabulary) -> None:
    """Marks in ``row`` the n-grams that the text holds."""
    for at in range(0, max(1, len(data)), PIECE):
        for code in grams(data[at:at + PIECE + LONGEST - 1]):
            row[vocabulary.find(code)] = 1


@dataclass
class Model:
    """Bounded by LANDMARKS and the n-grams of LANDMARK_BYTES each."""

    labels: list[str]
    codes: np.ndarray          # n-grams that count
    bits: np.ndarray           # their presence in the landmarks, packed
    landmarks: int
    weights: np.ndarray        # landmarks x languages
    bias: np.ndarray
    scale: float = 8.0


class Scorer:
    def __init__(self, model: Model):
        self.model = model
        self.vocabulary = Vocabulary(model.codes)
        self.rows = max(1, CELLS // max(1, len(model.codes)))
        own = np.zeros(model.landmarks)
        for _, part in self._parts():
            own += part.sum(axis=0)
        self.norm = np.sqrt(np.maximum(own, 1))

    def _parts(self):
        for at in range(0, len(self.model.codes), COLUMNS):
            yield at, np.unpackbits(self.model.bits[at:at + COLUMNS], axis=1, count=self.model.landmarks).astype(np.float32)

    def kernels(self, texts: list[bytes]) -> np.ndarray:
        """Normalised kernels of texts with the landmarks."""
        out = np.zeros((len(texts), self.model.landmarks))
        for first in range(0, len(texts), self.rows):
            some = texts[first:first + self.rows]
            has = np.zeros((len(some), len(self.model.codes)), np.uint8)
            for row, data in zip(has, some):
                presence(row, data, self.vocabulary)
            k = np.zeros((len(some), self.model.landmarks), np.float32)
            for at, part in self._parts():
                k += has[:, at:at + COLUMNS].astype(np.float32) @ part
            size = np.sqrt(np.maximum(has.sum(axis=1, dtype=np.int64), 1))
            out[first:first + self.rows] = k / size[:, None] / self.norm
        return out

    def predict(self, texts: list[bytes]):
        """(number of the best language, its share) for each text."""
        if not self.model.labels:
            return np.zeros(len(texts), np.int64), np.zeros(len(texts))
        share = softmax(self.model.scale * (self.kernels(texts) @ self.model.weights + self.model.bias))
        best = share.argmax(axis=1)
        return best, share[np.arange(len(texts)), best]


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def ridge(k: np.ndarray, y: np.ndarray, landmark_kernel: np.ndarray, penalty: float, classes: int):
    """Nyström features of ``k``, one-versus-rest ridge regression in which
    every language weighs the same, folded back to weights of landmarks."""
    values, vectors = np.linalg.eigh(landmark_kernel)
    good = values > values[-1] * 1e-9
    root = vectors[:, good] / np.sqrt(values[good])
    z = k @ root
    target = np.where(y[:, None] == np.arange(classes), 1.0, -1.0)
    share = 1.0 / np.bincount(y, minlength=classes)[y] / len(np.unique(y))
    mean_z, mean_t = share @ z, share @ target
    zc = (z - mean_z) * np.sqrt(share)[:, None]
    tc = (target - mean_t) * np.sqrt(share)[:, None]
    w = np.linalg.solve(zc.T @ zc + penalty * np.eye(z.shape[1]), zc.T @ tc)
    return root @ w, mean_t - mean_z @ w


def solve(k: np.ndarray, y: np.ndarray, landmark_kernel: np.ndarray, classes: int):
    """(weights, bias, scale): penalty and scale by the likelihood of every
    fourth row, which the trial fits leave out."""
    held = np.arange(len(y)) % 4 == 3
    best = (np.inf, RIDGE[1], 8.0)
    if held.any() and len(np.unique(y[~held])) > 1:
        for penalty in RIDGE:
            w, b = ridge(k[~held], y[~held], landmark_kernel, penalty, classes)
            for scale in SCALES:
                p = softmax(scale * (k[held] @ w + b))[np.arange(held.sum()), y[held]]
                best = min(best, (float(-np.log(np.maximum(p, 1e-12)).mean()), penalty, scale))
    w, b = ridge(k, y, landmark_kernel, best[1], classes)
    return w, b, best[2]


# ---------------------------------------------------------------- on Spark

def _distinct_grams(batches):
    """(n-gram, landmark), each pair once."""
    for b in batches:
        for number, text in zip(b.column(0).to_pylist(), b.column(1)):
            codes = [np.unique(c) for c in grams(normalised(text.as_py()))]
            codes = np.concatenate(codes) if codes else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(codes.view(np.int64)), pa.array(np.full(len(codes), number, np.int32))], names=["code", "landmark"])


def _kernel_rows(shared):
    def run(batches):
        scorer = Scorer(shared.value)
        for b in batches:
            k = scorer.kernels([normalised(x.as_py()) for x in b.column(2)])
            rows = pa.FixedSizeListArray.from_arrays(pa.array(k.ravel()), scorer.model.landmarks).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), rows], names=["id", "lang", "k"])
    return run


def train(docs: DataFrame, usable=None, id_col="doc_id", text_col="text", lang_col="lang", max_rows: int = MAX_ROWS,
          landmarks: int = LANDMARKS) -> Model:
    """Fit on rows with a language that ``usable`` (a condition on the id) admits.

    Without such rows the model knows no language. Each language has a
    landmark at least, so with more languages than ``landmarks`` there are as
    many landmarks as languages. Rows without a letter teach
    nothing. Equal texts of a language count once; among rows with one id the
    hash alone decides, so the sample does not depend on the partitions."""
    spark = docs.sparkSession
    common.ready(spark)
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    if usable is not None:
        rows = rows.where(usable)
    rows = rows.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"))
    found = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not found:
        return Model([], np.zeros(0, np.uint64), np.zeros((0, 0), np.uint8), 0, np.zeros((0, 0)), np.zeros(0))
    labels = sorted(found)
    each = max(1, max_rows // len(labels))
    h = F.pmod(F.xxhash64("id"), F.lit(1 << 30))
    wanted = F.lit(False)
    for lang in labels:                             # the hash's share that gives about ``each`` rows
        wanted = wanted | ((F.col("lang") == lang) & (h < int(min(1.0, each / found[lang]) * (1 << 30))))
    sample = common.written(rows.where(wanted).groupBy("lang", F.xxhash64("text").alias("same")).agg(F.min("text").alias("text"), F.min("id").alias("id")), "language-sample")
    # landmarks: the first of each language by another hash of the id
    short = F.octet_length("text") <= LANDMARK_BYTES
    order = Window.partitionBy("lang").orderBy(F.xxhash64(F.lit("landmark"), "id"), "same")
    chosen = common.written(
        sample.where(short).withColumn("place", F.row_number().over(order)).where(F.col("place") <= max(1, landmarks // len(labels)))
        .select((F.row_number().over(Window.orderBy("lang", "place")) - 1).cast("int").alias("landmark"), "text"), "language-landmarks")
    count = chosen.count()
    pairs = chosen.mapInArrow(_distinct_grams, "code long, landmark int")
    counted = pairs.groupBy("code").agg(F.collect_list("landmark").alias("of")).where((F.size("of") > 1) | F.lit(count == 1)).toArrow()
    codes, of = counted.column("code").combine_chunks(), counted.column("of").combine_chunks()
    size = np.diff(of.offsets.to_numpy())
    has = np.zeros((len(codes), count), np.uint8)
    has[np.repeat(np.arange(len(codes)), size), of.flatten().to_numpy()] = 1
    codes = codes.to_numpy().view(np.uint64)
    model = Model(labels, codes, np.packbits(has, axis=1), count, np.zeros((count, len(labels))), np.zeros(len(labels)))
    if count == 0 or len(labels) == 1:
        return model
    norm = np.sqrt(np.maximum(has.sum(axis=0, dtype=np.int64), 1))
    wide = has.astype(np.float32)
    landmark_kernel = (wide.T @ wide).astype(np.float64) / norm[:, None] / norm
    got = sample.select("id", "lang", "text").mapInArrow(_kernel_rows(common.broadcast(spark, model)), "id string, lang string, k array<double>")
    got = got.orderBy(F.xxhash64(F.lit("fold"), "id"), "lang").toArrow()
    k = got.column("k").combine_chunks().flatten().to_numpy().reshape(len(got), count)
    y = np.array([labels.index(x) for x in got.column("lang").to_pylist()], np.int64)
    model.weights, model.bias, model.scale = solve(k, y, landmark_kernel, len(labels))
    return model


def predict_column(spark, model: Model, text="text"):
    """Column: struct(lang, score). Null, empty and letterless texts are
    ``und`` with score 0; equal texts get equal results."""
    common.ready(spark)
    shared = common.broadcast(spark, model)

    @F.arrow_udf("lang string, score double")
    def language(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(shared.value)
        known = scorer.model.labels
        for batch in batches:
            langs, scores = [UNKNOWN] * len(batch), np.zeros(len(batch))
            at, held, total = [], [], 0

            def flush():
                best, share = scorer.predict(held)
                for i, j, s in zip(at, best.tolist(), share.tolist()):
                    langs[i], scores[i] = known[j], s

            for i, x in enumerate(batch):
                text = x.as_py()
                if known and has_letter(text):
                    held.append(normalised(text))
                    at.append(i)
                    total += len(held[-1])
                    if total >= PIECE:
                        flush()
                        at, held, total = [], [], 0
            if held:
                flush()
            yield pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["lang", "score"])

    return language(F.col(text) if isinstance(text, str) else text)


def identify(docs: DataFrame, model: Model, text_col="text", out="language") -> DataFrame:
    """Append ``out``: struct(lang, score), score 0 to 1. Repeated rows stay,
    an empty table gives an empty table, ``out`` is lengthened if the input
    has it; other columns are not read."""
    return docs.withColumn(common.fresh(docs.columns, out), predict_column(docs.sparkSession, model, text_col))


def fitted(spark, sf_dir: str) -> Model:
    """The model of the held-out protocol: crc32(id) mod 4 is not 2."""
    return train(common.documents(spark, sf_dir), usable=common.crc_of_id(modulus=4) != 2)


def query(spark, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir).select("doc_id", "text")
    found = docs.select("doc_id", (common.crc_of_id(modulus=4) == 2).alias("held_out"), predict_column(spark, fitted(spark, sf_dir)).alias("l"))
    return found.select("doc_id", "held_out", F.col("l.lang").alias("lang_pred"), F.col("l.score").alias("score"))
