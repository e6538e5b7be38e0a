"""Document fingerprints by winnowing.

Every k-gram of code points has a rolling hash; of each window of w
consecutive hashes the smallest is kept, the rightmost among equals, with its
position. Two texts that share a passage of at least w + k - 1 code points
share a fingerprint (hash), and the positions say where.

The registered query compares each document with its successor by doc_id. The
ids are cut into parts of near-equal counts by quantiles; one exchange deals
texts by part, with the first document of the next part as a look-ahead row;
each task streams its sorted part and holds two documents at a time.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pagelens.llm import common

GRAM, WINDOW = 32, 16
_BASE = np.uint64(0x9E3779B97F4A7C15)
_POS_BITS = 20
_POS = np.uint64((1 << _POS_BITS) - 1)
_NONE = (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def gram_hashes(codes: np.ndarray, gram: int) -> np.ndarray:
    """Polynomial hash of every ``gram`` codes, by doubling, then mixed."""
    h, size, power = codes.astype(np.uint64) + np.uint64(1), 1, _BASE
    parts, rest = [], gram
    offset, out, out_power = 0, None, np.uint64(1)
    with np.errstate(over="ignore"):
        n = len(codes) - gram + 1
        while True:
            if rest & 1:          # take this block size into the gram
                part = h[offset:offset + n]
                out = part.copy() if out is None else out * power + part
                offset += size
            rest >>= 1
            if not rest:
                break
            h = h[:-size] * power + h[size:]
            size, power = size * 2, power * power
        out ^= out >> np.uint64(32)
        out *= np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(29)
    return out


def winnow(text: str, gram: int = GRAM, window: int = WINDOW):
    """(hashes, positions) of a text. A text shorter than a gram is one gram
    of its own length; fewer grams than a window are one window; an empty text
    has none."""
    n = len(text)
    if not n:
        return _NONE
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    h = gram_hashes(codes, min(gram, n))
    w, m = min(window, len(h)), len(h)
    picked, step = [], (1 << _POS_BITS) - w
    for lo in range(0, max(1, m - w + 1), step):
        part = h[lo:lo + step + w - 1]
        # smallest hash first, of equals the rightmost: its position counts down
        key = (part & ~_POS) | (_POS - np.arange(len(part), dtype=np.uint64))
        size = 1
        while size * 2 <= w:
            key = np.minimum(key[:-size], key[size:])
            size *= 2
        if size < w:
            key = np.minimum(key[:size - w], key[w - size:])
        pos = (_POS - (key & _POS)).astype(np.int64)
        picked.append(pos[np.concatenate([[True], pos[1:] != pos[:-1]])] + lo)
    pos = picked[0] if len(picked) == 1 else np.unique(np.concatenate(picked))
    return h[pos], pos


def encode(fp) -> str:
    """Hex: 16 digits of the hash and 8 of the position for each entry."""
    out = np.zeros(len(fp[0]), dtype=[("h", ">u8"), ("p", ">u4")])
    out["h"], out["p"] = fp
    return out.tobytes().hex()


def likeness(a, b) -> float:
    """Jaccard similarity of the hash sets; two empty sets are alike."""
    x, y = np.unique(a[0]), np.unique(b[0])
    if not len(x) and not len(y):
        return 1.0
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both)


def fingerprints(docs: DataFrame, id_col="doc_id", text_col="text", gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """(id, hash, position), one row per fingerprint of a whole text: the
    table to join for shared passages. Null and empty texts have none; equal
    texts have equal rows; repeated rows repeat."""
    common.ready(docs.sparkSession)
    data = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches):
        for b in batches:
            for lo in range(0, max(b.num_rows, 1), 512):
                part = b.slice(lo, 512)
                found = [winnow(t or "", gram, window) for t in part.column(1).to_pylist()]
                rows = np.repeat(np.arange(len(found)), [len(f[0]) for f in found])
                h = np.concatenate([f[0] for f in found]) if found else _NONE[0]
                p = np.concatenate([f[1] for f in found]) if found else _NONE[1]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows)), pa.array(h.view(np.int64)), pa.array(p)], names=["id", "hash", "position"])

    kind = data.schema["id"].dataType.simpleString()
    return data.mapInArrow(run, f"id {kind}, hash long, position long").withColumnRenamed("id", id_col)


def _successors(gram: int, window: int):
    """Rows (part, ahead, id, text) sorted; each but the look-ahead ones gives
    a result with the next row's text."""
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def result(id_, text, fp, following, next_fp):
        half = len(text) // 2
        edited = text[:len(text) - half] + following[:half]
        e = winnow(edited, gram, window)
        return (id_, len(text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), encode(fp), encode(e),
                likeness(fp, e), likeness(fp, next_fp))

    def run(batches):
        held, rows, size = None, [], 0
        for b in batches:
            for part, ahead, id_, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3)):
                text = text.as_py() or ""
                if held and held[0] != part:
                    held = None
                if ahead and held is None:
                    continue
                fp = winnow(text, gram, window)
                if held:
                    rows.append(result(*held[1:], text, fp))
                    size += len(rows[-1][3]) + len(rows[-1][4])
                held = None if ahead else (part, id_, text, fp)
                if size > 16_000_000 or len(rows) >= 2000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)
                    rows, size = [], 0
        cols = list(zip(*rows)) or [[]] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, kinds)], names=names)
    return run, ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def compare_successors(docs: DataFrame, id_col="doc_id", text_col="text", gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """Fingerprints of each text and of its edited text (last half replaced by
    the head of the next document by id; the last takes the first).

    Ids are longs; null ids come first; rows of one id follow by text. Null
    texts are empty. Repeated rows each have a result. One row is its own
    successor; an empty table has no result. Only the two columns are read."""
    spark = docs.sparkSession
    common.ready(spark)
    least = -(1 << 63)
    slim = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(least)).alias("key"))
    parts = max(2, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    # one value per part: bounded by the number of parts, whatever the input
    cuts = slim.agg(F.percentile_approx("key", [i / parts for i in range(1, parts)], 100 * parts)).first()[0]
    cuts = sorted(set(cuts or []))
    steps = [1 << i for i in range(max(1, len(cuts)).bit_length() - 1, -1, -1)]
    # how many cuts are not above the key, by binary search
    part = F.lit(0)
    if cuts:
        literal = F.array(*[F.lit(c) for c in cuts])
        part = F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0),
                           lambda at, s: F.when(at + s > len(cuts), at).when(F.element_at(literal, at + s) <= F.col("key"), at + s).otherwise(at))
    firsts = sorted((r["part"], r["key"]) for r in slim.withColumn("part", part).groupBy("part").agg(F.min("key").alias("key")).collect())
    before = {key: firsts[i - 1][0] for i, (_, key) in enumerate(firsts)}
    head = spark.createDataFrame([(k, p) for k, p in before.items()], "head long, to int")
    rows = (docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(least)).alias("key"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
            .withColumn("part", part)
            .join(F.broadcast(head), F.col("key") == F.col("head"), "left")      # one row per part
            .withColumn("dest", F.explode(F.when(F.col("to").isNull(), F.array(F.struct(F.col("part").alias("part"), F.lit(0).alias("ahead"))))
                                          .otherwise(F.array(F.struct(F.col("part").alias("part"), F.lit(0).alias("ahead")), F.struct(F.col("to").alias("part"), F.lit(1).alias("ahead")))))))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = (rows.select("dest.part", "dest.ahead", "id", "text").repartition(tasks, "part")
             .sortWithinPartitions("part", "ahead", F.col("id").asc_nulls_first(), "text"))
    run, schema = _successors(gram, window)
    return dealt.mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    return compare_successors(common.documents(spark, sf_dir))
