"""Token ids of whole texts for a word-based tokenizer file, with a bounded
cache of word ids.

The file's tokenizer lower-cases, splits words from numbers and marks, and
encodes each word by itself. So the ids of a text are the ids of its words in
order, and words recur. Texts of plain Latin letters go by words; all others
(and texts with the tokenizer's own markers) go to the tokenizer whole, so
that the ids are always the tokenizer's.
"""

from __future__ import annotations

import re

import numpy as np

# printable ASCII, tab, line ends and the Latin-1 letters: here lower-casing,
# composition and the letter class of Python and of the tokenizer agree
_PLAIN = re.compile(r"[\t\n\r\x20-\x7EÀ-ÖØ-öø-ÿ]*")
_LETTER = "a-zß-öø-ÿ"
_WORD = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[0-9]|[^\t\n\r\x20{_LETTER}0-9]+")
MAX_WORDS = 800_000   # words in the cache before it is emptied
RUN = 400_000         # words looked up at once


class _Words(dict):
    """Number of each word; new words are numbered and noted."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word):
        self[word] = n = len(self)
        self.new.append(word)
        return n


class Encoder:
    def __init__(self, tokenizer_json: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        for t, i in vocab.items():
            self.ends[i] = t.endswith("</w>")
        self._clear()

    def _clear(self):
        self.words = _Words()
        self.start = np.zeros(1 << 16, np.int64)
        self.length = np.zeros(1 << 16, np.int32)
        self.pool = np.zeros(1 << 18, np.int32)
        self.known = self.used = 0

    def _learn(self) -> None:
        """Ids of the new words: encoded together, cut where a token ends one."""
        new = self.words.new
        if not new:
            return
        joined = [" ".join(new[k:k + 500]) for k in range(0, len(new), 500)]
        ids = np.concatenate([np.asarray(x.ids, np.int32) for x in self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)])
        stop, n = np.flatnonzero(self.ends[ids]) + 1, len(new)
        if len(stop) != n:
            raise ValueError("the tokenizer does not end each word with one marked token")
        while self.known + n > len(self.start):
            self.start, self.length = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.length))
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        begin = np.concatenate([[0], stop[:-1]])
        self.start[self.known:self.known + n] = begin + self.used
        self.length[self.known:self.known + n] = stop - begin
        self.pool[self.used:self.used + len(ids)] = ids
        self.used += len(ids)
        self.known += n
        new.clear()

    def _known(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, end of each word in them)."""
        if len(self.words) > MAX_WORDS:
            self._clear()
        at = np.fromiter(map(self.words.__getitem__, words), np.int64, len(words))
        self._learn()
        n = self.length[at]
        stop = np.cumsum(n, dtype=np.int64)
        total = int(stop[-1]) if len(stop) else 0
        return self.pool[np.repeat(self.start[at] - (stop - n), n) + np.arange(total)], stop

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """One int32 array per text."""
        out: list = [None] * len(texts)
        held, words = [], []

        def flush():
            ids, stop = self._known(words)
            stop = np.concatenate([[0], stop])
            lo = 0
            for i, n in held:
                out[i] = ids[stop[lo]:stop[lo + n]]
                lo += n
            held.clear()
            words.clear()

        for i, t in enumerate(texts):
            if "<|" in t or not _PLAIN.fullmatch(t):
                out[i] = np.asarray(self.tokenizer.encode(t, add_special_tokens=False).ids, np.int32)
                continue
            w = _WORD.findall(t.lower())
            if len(w) > RUN:      # a huge text by itself
                out[i] = np.concatenate([self._known(w[k:k + RUN])[0] for k in range(0, len(w), RUN)])
                continue
            held.append((i, len(w)))
            words += w
            if len(words) > RUN:
                flush()
        flush()
        return out
