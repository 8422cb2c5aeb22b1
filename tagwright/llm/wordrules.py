"""Quality rules on words and a logistic regression over hashed word and character n-grams.

The rules count words, symbols, repeated lines and words in repeated five-word windows. The regression sees the shares
of hashed words, word pairs and runs of three bytes, is trained on labelled quality rows outside the held-out fold, and gets its
probabilities from a fitted logistic curve. A text is kept if it breaks no rule and reaches the probability threshold.

A null text is empty: no word, so the rules fail it. Repeated rows are judged alike, one by one; an empty table gives no
rows; only id and text are read for scoring. Without labels of both kinds the probability is 0.5 and the rules decide.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from .common import Words, map_texts, mix, platt, sigmoid
from .quality import labelled_sample


@dataclass(frozen=True)
class RuleSettings:
    window: int = 5
    min_words: int = 10
    repeat_percent: int = 20
    threshold: float = 0.3
    bits: int = 16
    sample_rows: int = 2000  # labelled rows used for training, at most half of them of one label
    longest: int = 60_000  # characters of a row that is used for training; scoring has no limit
    epochs: int = 12
    rate: float = 2.0
    seed: int = 3


_BLANKS = " \t\n\x0b\x0c\r"


def repeated_words(words: list[bytes], window: int) -> int:
    """Words that lie in a window of words found twice or more."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    windows = list(zip(*(words[i : n + i] for i in range(window))))
    if len(set(windows)) == n:
        return 0
    often = Counter(windows)
    total, done = 0, 0
    for i, w in enumerate(windows):
        if often[w] > 1:
            total += i + window - max(i, done)
            done = i + window
    return total


def counts(text: str, window: int = 5) -> tuple[int, int, int, int, int]:
    """Words, characters in words, symbols, repeated lines, words in repeated windows."""
    words = text.encode().split()  # bytes are split at exactly the six ASCII blanks
    chars = len(text) - sum(map(text.count, _BLANKS))
    symbols = sum(map(text.count, "#*$%&|<>"))
    lines = text.split("\n")
    again = 0
    if len(lines) > 1:
        seen = set()
        for line in lines:
            if line in seen:
                again += 1
            elif line.strip(_BLANKS):
                seen.add(line)
    return len(words), chars, symbols, again, repeated_words(words, window)


def hashed(texts: list[str], bits: int):
    """Bucket numbers and starts: of words, of word pairs inside a text, and of runs of three bytes that begin in it."""
    w = Words([t.encode() for t in texts])
    shift = np.uint64(64 - bits)
    word = (w.hashes >> shift).astype(np.int32)
    pair = np.zeros(len(word), dtype=np.int32)
    if len(word) > 1:
        pair[1:] = (mix(w.hashes[:-1] * np.uint64(0x9E3779B97F4A7C15) + w.hashes[1:] + np.uint64(1)) >> shift).astype(np.int32)
        pair[1:][w.hashes[:-1] == w.hashes[1:]] = 0  # a word said twice is one feature, whatever the word
    first_word = w.first[:-1][np.diff(w.first) > 0]
    pair[first_word] = word[first_word]  # a first word has no pair; it counts twice
    d = w.data.astype(np.uint32)
    three = np.zeros(len(d), dtype=np.int32)
    if len(d) > 2:
        h = d[:-2] | d[1:-1] << np.uint32(8) | d[2:] << np.uint32(16)
        three[:-2] = ((h * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits)).astype(np.int32)
    # runs that reach past the text are left out
    until = np.maximum(w.text_start[1:] - 3, w.text_start[:-1])
    return word, pair, three, w.first, w.text_start[:-1], until


@dataclass
class NgramModel:
    weights: np.ndarray  # 3 x buckets: words, pairs, bytes
    offset: float
    slope: float
    shift: float
    bits: int

    def raw(self, texts: list[str]) -> np.ndarray:
        word, pair, three, first, begin, until = hashed(texts, self.bits)
        out = np.full(len(texts), self.offset)
        n = np.maximum(np.diff(first), 1)
        for row, ids in ((0, word), (1, pair)):
            total = np.concatenate([[0], np.cumsum(self.weights[row][ids], dtype=np.float64)])
            out += (total[first[1:]] - total[first[:-1]]) / n
        total = np.concatenate([[0], np.cumsum(self.weights[2][three], dtype=np.float64)])
        return out + (total[until] - total[begin]) / np.maximum(until - begin, 1)

    def score(self, texts: list[str]) -> np.ndarray:
        return sigmoid(self.slope * self.raw(texts) + self.shift)


def fit_ngrams(rows: list[tuple[str, int]], settings: RuleSettings = RuleSettings()) -> NgramModel:
    model = NgramModel(np.zeros((3, 1 << settings.bits)), 0.0, 0.0, 0.0, settings.bits)
    label = np.asarray([q for _, q in rows])
    if len(set(label.tolist())) < 2:
        return model
    ready = []
    for text, q in rows:
        word, pair, three, _, begin, until = hashed([text], settings.bits)
        parts = []
        for ids in (word, pair, three[begin[0] : until[0]]):
            ids, n = np.unique(ids, return_counts=True)
            parts.append((ids, n / max(1, n.sum())))
        ready.append((parts, q))
    random = np.random.default_rng(settings.seed)
    left_out = np.arange(len(rows)) % 4 == 0  # for the logistic curve
    train = np.flatnonzero(~left_out)
    squares = np.full(model.weights.shape, 1e-4)
    for _ in range(settings.epochs):
        for i in random.permutation(train):
            parts, q = ready[i]
            z = model.offset + sum(float(model.weights[k][ids] @ share) for k, (ids, share) in enumerate(parts))
            g = q - sigmoid(np.asarray(z))
            model.offset += 0.02 * g
            for k, (ids, share) in enumerate(parts):
                step = g * share
                squares[k][ids] += step * step
                model.weights[k][ids] += settings.rate * 0.1 * step / np.sqrt(squares[k][ids])
    held = np.flatnonzero(left_out).tolist()
    raw = np.concatenate([model.raw([rows[i][0] for i in held[j : j + 100]]) for j in range(0, len(held), 100)])
    model.slope, model.shift = platt(raw, label[left_out])
    model.weights = model.weights.astype(np.float32)
    return model


def train(documents: DataFrame, labels: DataFrame, settings: RuleSettings = RuleSettings()) -> NgramModel:
    return fit_ngrams(labelled_sample(documents, labels, settings.sample_rows, settings.longest), settings)


def judge(
    df: DataFrame, model: NgramModel, id_col: str = "doc_id", text_col: str = "text", settings: RuleSettings = RuleSettings()
) -> DataFrame:
    """Per document the counts, whether they break a rule, the probability of good quality, and whether it is kept."""
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

    def work():
        def each(texts: list[str]) -> list:
            c = np.asarray([counts(t, settings.window) for t in texts], dtype=np.int64).reshape(-1, 5)
            failed = (c[:, 0] < settings.min_words) | (100 * c[:, 4] > settings.repeat_percent * c[:, 0])
            p = model.score(texts)
            return [*c.T, failed, p, ~failed & (p >= settings.threshold)]

        return each

    fields = ", ".join(f"{n} long" for n in names) + ", base_failed boolean, score double, kept boolean"
    return map_texts(df, id_col, text_col, fields, work)
