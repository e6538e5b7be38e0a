"""Vector bin packing of training examples into sequences.

A sequence has three capacities: tokens, segments and loss-bearing tokens. It
is filled greedily by the dot-product heuristic: of the examples that fit, the
one whose demand vector (in shares of the capacities) has the largest dot
product with what is left. Each task packs its own partition as a stream: a
window of open examples is held, sequences are filled from it one after the
other, and memory is bounded by the window. Nothing is shuffled.

With ``cut=True`` (plain documents) whole capacities of a long document become
sequences of their own, what no whole example fills is filled with the head of
an open one, and a sequence that stays under-full (its segments are used up, or
it is a partition's last) goes out as sequences whose lengths are powers of two,
which need no padding.
"""

from __future__ import annotations

import os
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from pagelens.llm import common

TOKENS, SEGMENTS, WINDOW, END_ID = 2048, 64, 512, 1


@dataclass
class Limits:
    tokens: int = TOKENS
    segments: int = SEGMENTS
    loss: int = TOKENS
    window: int = WINDOW
    cut: bool = True


class Packer:
    """Streaming packer. ``add`` takes (key, tokens, loss-bearing tokens);
    finished sequences come out as lists of (key, start, length). Loss of a
    part is the part's share of the tail: an example's first tokens are those
    without loss (prompt, or the first token of a document)."""

    def __init__(self, limits: Limits):
        self.l = limits
        n = 2 * limits.window
        self.key = np.zeros(n, np.int64)
        self.start = np.zeros(n, np.int64)
        self.need = np.zeros((n, 3), np.int64)     # tokens, segments, loss
        self.n = 0
        self.cap = np.array([limits.tokens, limits.segments, limits.loss], np.int64)

    def add(self, key: int, tokens: int, loss: int):
        l = self.l
        start = 0
        if tokens > l.tokens or loss > l.loss:
            if not l.cut:
                # larger than a sequence: a sequence of its own, reported whole
                yield [(key, 0, tokens)]
                return
            while tokens - start > l.tokens:
                take = min(l.tokens, self._within(start, tokens, loss))
                yield [(key, start, take)]
                start += take
        if tokens - start <= 0:
            return
        self._push(key, start, tokens - start, self._loss(start, tokens, tokens, loss))
        if self.n >= 2 * l.window:
            while self.n > l.window:
                yield from self._out(self._fill())

    def finish(self):
        while self.n:
            yield from self._out(self._fill())

    def _out(self, seq):
        used = sum(x[2] for x in seq)
        if self.l.cut and used < self.l.tokens:
            yield from _powers(seq, used)
        else:
            yield seq

    @staticmethod
    def _loss(start, stop, tokens, loss):
        """Loss-bearing tokens in [start, stop): they are the last ``loss``."""
        return max(0, stop - max(start, tokens - loss))

    def _within(self, start, tokens, loss):
        """Most tokens from ``start`` whose loss stays in its capacity."""
        free = max(0, tokens - loss - start)
        return max(1, free + self.l.loss)

    def _push(self, key, start, tokens, loss):
        i = self.n
        self.key[i], self.start[i] = key, start
        self.need[i] = tokens, 1, loss
        self.n += 1

    def _drop(self, i):
        j = self.n - 1
        if i != j:
            self.key[i], self.start[i], self.need[i] = self.key[j], self.start[j], self.need[j]
        self.n = j

    def _fill(self):
        left, seq = self.cap.copy(), []
        scale = 1.0 / (self.cap.astype(float) ** 2)
        while self.n and left[1] > 0 and left[0] > 0:
            need = self.need[:self.n]
            fits = (need <= left).all(axis=1)
            if not fits.any():
                if self.l.cut:
                    i = int(np.argmax(need[:, 0]))
                    tokens, _, loss = need[i].tolist()
                    take = min(int(left[0]), max(0, tokens - loss) + int(left[2]), tokens)
                    if take > 0:
                        key, start = int(self.key[i]), int(self.start[i])
                        seq.append((key, start, take))
                        self._drop(i)
                        if tokens > take:
                            self._push(key, start + take, tokens - take, min(loss, tokens - take))
                break
            score = np.where(fits, need @ (left * scale), -1.0)
            i = int(np.argmax(score))
            seq.append((int(self.key[i]), int(self.start[i]), int(need[i, 0])))
            left -= need[i]
            self._drop(i)
        return seq


def _powers(seq, used):
    """Cut the parts of an under-full sequence into sequences of powers of two."""
    parts = list(seq)[::-1]
    while used:
        room = 1 << (used.bit_length() - 1)
        used -= room
        out = []
        while room:
            key, start, length = parts.pop()
            take = min(room, length)
            out.append((key, start, take))
            if take < length:
                parts.append((key, start + take, length - take))
            room -= take
        yield out


def _task_base() -> int:
    c = TaskContext.get()
    return (c.partitionId() if c else 0) << 36


_encoders: dict = {}


def _pack_documents(shared, limits: Limits, end_id: int, with_ids: bool):
    names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_length"] + ["ids"] * with_ids

    def run(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"     # one core per task
        from pagelens.llm.tokens import Encoder
        json = shared.value
        key = zlib.crc32(json.encode())
        if key not in _encoders:                 # kept by the worker between tasks
            _encoders.clear()
            _encoders[key] = Encoder(json)
        enc = _encoders[key]
        pack, seq_id = Packer(limits), _task_base()
        held: dict[int, list] = {}               # document -> [id, ids, tokens not yet out]
        rows: list = [[] for _ in names]

        def put(seqs):
            nonlocal seq_id
            for seq in seqs:
                offset, total = 0, sum(x[2] for x in seq)
                for k, start, n in seq:
                    doc = held[k]
                    ids = doc[1][start:start + n]
                    row = (doc[0], start, n, zlib.crc32(ids.astype("<u4").tobytes()), len(doc[1]), seq_id, offset, total)
                    for c, v in zip(rows, row):
                        c.append(v)
                    if with_ids:
                        rows[-1].append(ids)
                    offset += n
                    doc[2] -= n
                    if not doc[2]:
                        del held[k]
                seq_id += 1

        def flush():
            kinds = [id_type] + [pa.int64()] * 7
            arrays = [pa.array(c, t) for c, t in zip(rows, kinds)]
            if with_ids:
                off = np.concatenate([[0], np.cumsum([len(x) for x in rows[-1]])]).astype(np.int32)
                flat = np.concatenate(rows[-1]) if rows[-1] else np.zeros(0, np.int32)
                arrays.append(pa.ListArray.from_arrays(pa.array(off), pa.array(flat.astype(np.int32))))
            for c in rows:
                c.clear()
            return pa.RecordBatch.from_arrays(arrays, names=names)

        at, id_type = 0, pa.int64()
        for b in batches:
            id_type = b.column(0).type
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                texts = [x or "" for x in part.column(1).to_pylist()]
                for i, ids in zip(part.column(0).to_pylist(), enc.encode(texts)):
                    ids = np.append(ids, np.int32(end_id))
                    held[at] = [i, ids, len(ids)]
                    put(pack.add(at, len(ids), len(ids) - 1))
                    at += 1
                if len(rows[0]) >= 4096:
                    yield flush()
        put(pack.finish())
        yield flush()
    return run


def pack_documents(docs: DataFrame, tokenizer_file: str, id_col="doc_id", text_col="text", limits: Limits | None = None,
                   end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """Tokenise whole texts, end each with ``end_id`` and pack them.

    One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset, sequence_length and, on request, the ids. A null or empty text is
    the end id alone; a null id stays null; repeated rows are packed each by
    itself; a text of any length is cut at the capacity; an empty table gives
    no pieces. Other columns are not read, so their names cannot clash.
    Loss-bearing: every token of a document but its first."""
    spark = docs.sparkSession
    common.ready(spark)
    with open(tokenizer_file, encoding="utf-8") as f:     # read by the driver; about 2 MB
        shared = common.broadcast(spark, f.read())
    data = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = data.schema["id"].dataType.simpleString()
    schema = (f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_length long"
              + ", ids array<int>" * with_ids)
    out = data.mapInArrow(_pack_documents(shared, limits or Limits(), end_id, with_ids), schema)
    return out.withColumnRenamed("id", id_col)


def _pack_items(limits: Limits):
    def run(batches):
        pack, seq_id, held = Packer(limits), _task_base(), {}
        names = ["id", "sequence_id", "offset", "sequence_length"]

        def put(seqs, id_type):
            nonlocal seq_id
            out = []
            for seq in seqs:
                offset, total = 0, sum(x[2] for x in seq)
                for k, _, n in seq:
                    out.append((held.pop(k), seq_id, offset, total))
                    offset += n
                seq_id += 1
            cols = list(zip(*out)) or [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, [id_type] + [pa.int64()] * 3)], names=names)

        at, id_type = 0, pa.int64()
        for b in batches:
            id_type = b.column(0).type
            done = []
            for i, n, loss in zip(*(c.to_pylist() for c in b.columns)):
                n = max(int(n or 0), 0)
                held[at] = i
                if n:
                    done.extend(pack.add(at, n, min(max(int(loss or 0), 0), n)))
                else:
                    done.append([(at, 0, 0)])
                at += 1
            yield put(done, id_type)
        yield put(list(pack.finish()), id_type)
    return run


def pack_examples(examples: DataFrame, id_col: str, tokens_col: str, loss_col: str, limits: Limits | None = None) -> DataFrame:
    """Pack whole examples (instruction data) by their token and loss counts:
    id, sequence_id, offset, sequence_length. Loss-bearing tokens are taken to
    be an example's last. Null counts are 0; an example without tokens, and
    one larger than a capacity, is a sequence of its own; repeated rows are
    packed each by itself."""
    common.ready(examples.sparkSession)
    limits = limits or Limits()
    limits = Limits(limits.tokens, limits.segments, limits.loss, limits.window, cut=False)
    data = examples.select(F.col(id_col).alias("id"), F.col(tokens_col).cast("long").alias("n"), F.col(loss_col).cast("long").alias("l"))
    kind = data.schema["id"].dataType.simpleString()
    return (data.mapInArrow(_pack_items(limits), f"id {kind}, sequence_id long, offset long, sequence_length long")
            .withColumnRenamed("id", id_col))


def tokenizer_file() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def query(spark, sf_dir: str) -> DataFrame:
    return pack_documents(common.documents(spark, sf_dir), tokenizer_file(), with_ids=False)
