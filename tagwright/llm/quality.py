"""Document quality by a linear-chain conditional random field over lines.

Every line has a hidden label, good or bad. Emission features describe the line and its two neighbours: length, shares
of letter, digit, symbol, upper-case and blank characters, word lengths, repeated words. Weights of emissions and of the
four label pairs are fitted by gradient steps on the log likelihood, with the document's label on all its lines.
Forward-backward gives the probability that a line is good; the mean over lines, weighted by their length, goes through
a fitted logistic curve and is the score.

A null text is empty, and an empty text is one empty line, which is scored like any other. Repeated rows get equal
scores; an empty table gives no rows. Without labels of both kinds every score is 0.5. Only id and text are read for
scoring.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, crc_mod, keep_rows, map_texts, mix, platt, sigmoid, spread_sample, texts_by_id

_KIND = np.zeros(256, dtype=np.uint8)
_KIND[[*range(97, 123)]] = 1  # lower-case letter
_KIND[[*range(65, 91)]] = 2  # upper-case letter
_KIND[[*range(48, 58)]] = 3  # digit
_KIND[[ord(c) for c in "#*$%&|<>"]] = 4  # symbol
_KIND[[ord(c) for c in "!?"]] = 5
_KIND[[ord(c) for c in ".,;:'\"()-"]] = 6  # ordinary punctuation
_KIND[0x80:0xC0] = 7  # inside a letter beyond ASCII
_KIND[0xC0:] = 1
_KIND[[0x20, 9, 11, 12, 13]] = 8
_KIND[10] = 9
N_KINDS = 10
N_BASE = 14


@dataclass(frozen=True)
class QualitySettings:
    sample_rows: int = 2000  # labelled rows used for fitting, at most half of them of one label
    longest: int = 60_000  # characters of a row that is used for fitting; scoring has no limit
    steps: int = 100
    rate: float = 0.3
    decay: float = 1e-3
    threshold: float = 0.3


def line_features(texts: list[str | bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines of the texts, their lengths in bytes, and the first line of each text and of the end."""
    words = Words([t if isinstance(t, bytes) else t.encode() for t in texts])
    data, text_start = words.data, words.text_start
    # a line ends at each \n and at the blank that follows every text
    ends = np.flatnonzero(data == 10)
    ends = np.union1d(ends, text_start[1:] - 1)
    starts = np.concatenate([[0], ends[:-1] + 1])
    length = ends - starts
    first = np.searchsorted(starts, text_start)
    n = len(starts)
    counts = np.zeros((n, N_KINDS))
    kind = _KIND[data]
    for k in range(1, 9):
        total = np.concatenate([[0], np.cumsum(kind == k, dtype=np.int64)])
        counts[:, k] = total[ends] - total[starts]
    one = np.maximum(length, 1)[:, None]
    out = np.zeros((n, N_BASE))
    out[:, 0] = np.log1p(length)
    out[:, 1:8] = counts[:, [1, 2, 3, 4, 5, 6, 8]] / one
    line = np.searchsorted(starts, words.start, side="right") - 1  # of each word
    n_words = np.bincount(line, minlength=n)
    some = np.maximum(n_words, 1)
    out[:, 8] = np.log1p(n_words)
    out[:, 9] = np.bincount(line, weights=words.end - words.start, minlength=n) / some
    if len(line):
        h = words.hashes
        again = np.zeros(len(h), dtype=bool)
        again[1:] = (h[1:] == h[:-1]) & (line[1:] == line[:-1])
        out[:, 10] = np.bincount(line, weights=again, minlength=n) / some
        own = np.unique(mix(h ^ (line.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))), return_index=True)[1]
        out[:, 11] = np.bincount(line[own], minlength=n) / some
        last = data[words.end - 1]
        out[:, 12] = np.bincount(line, weights=_KIND[last] >= 4, minlength=n) / some
    out[:, 13] = length == 0
    return out, length, first


def with_neighbours(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The features of each line beside those of the lines before and after it in the same text, and a constant."""
    n, d = x.shape
    out = np.zeros((n, 3 * d + 3))
    out[:, :d] = x
    out[1:, d : 2 * d] = x[:-1]
    out[:-1, 2 * d : 3 * d] = x[1:]
    begins, closes = first[:-1], first[1:] - 1
    out[begins, d : 2 * d] = 0
    out[closes, 2 * d : 3 * d] = 0
    out[begins, 3 * d] = 1
    out[closes, 3 * d + 1] = 1
    out[:, 3 * d + 2] = 1
    return out


def forward_backward(emission: np.ndarray, pair: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probability that each line is good, and the expected number of each label pair over all texts.

    ``emission`` is the score of "good" of each line (that of "bad" is 0), ``pair[a, b]`` of label b after label a.
    All texts advance together, one line at a time; sums are kept normal at every line.
    """
    n = len(emission)
    grow = np.exp(np.clip(emission, -30, 30))
    f = np.ones((n, 2))
    f[:, 1] = grow
    b = np.ones((n, 2))
    step = np.exp(pair)
    sizes = np.diff(first)
    order = np.argsort(-sizes, kind="stable")
    begin, sizes = first[:-1][order], sizes[order]
    at = begin
    f[at] /= f[at].sum(1, keepdims=True)
    longest = int(sizes[0]) if len(sizes) else 0
    live = np.searchsorted(-sizes, -np.arange(longest), side="left")  # texts with more than t lines
    for t in range(1, longest):
        at = begin[: live[t]] + t
        f[at] *= f[at - 1] @ step
        f[at] /= f[at].sum(1, keepdims=True)
    expected = np.zeros((2, 2))
    for t in range(longest - 1, 0, -1):
        at = begin[: live[t]] + t
        here = b[at].copy()
        here[:, 1] *= grow[at]
        both = f[at - 1][:, :, None] * step[None] * here[:, None, :]
        expected += (both / both.sum((1, 2), keepdims=True)).sum(0)
        back = here @ step.T
        b[at - 1] = back / back.sum(1, keepdims=True)
    p = f * b
    return p[:, 1] / p.sum(1), expected


def _scan(steps: np.ndarray, start: np.ndarray) -> np.ndarray:
    """``start @ steps[0] @ .. @ steps[t]`` for every t, each made to sum to one.

    The steps are laid out as blocks of about their square root: the products of all blocks are formed side by side,
    carried from block to block, and followed inside all blocks side by side.
    """
    n = len(steps)
    width = max(1, int(np.sqrt(n)))
    blocks = -(-n // width)
    held = np.tile(np.eye(2), (blocks * width, 1, 1))
    held[:n] = steps
    held = held.reshape(blocks, width, 2, 2)
    whole = np.tile(np.eye(2), (blocks, 1, 1))
    for j in range(width):
        whole = whole @ held[:, j]
        whole /= whole.sum((1, 2), keepdims=True)
    at = np.empty((blocks, 2))
    for k in range(blocks):
        at[k] = start
        start = start @ whole[k]
        start = start / start.sum()
    out = np.empty((blocks, width, 2))
    for j in range(width):
        at = (at[:, None] @ held[:, j])[:, 0]
        at /= at.sum(1, keepdims=True)
        out[:, j] = at
    return out.reshape(-1, 2)[:n]


def long_marginals(emission: np.ndarray, pair: np.ndarray) -> np.ndarray:
    """Probability that each line of one text is good, as :func:`forward_backward`, without a step for every line."""
    n = len(emission)
    own = np.ones((n, 2))
    own[:, 1] = np.exp(np.clip(emission, -30, 30))
    step = np.exp(pair)
    f, b = np.empty((n, 2)), np.empty((n, 2))
    f[0], b[-1] = own[0] / own[0].sum(), 0.5
    f[1:] = _scan(step[None] * own[1:, None, :], f[0])
    b[:-1] = _scan((step[None] * own[1:, None, :])[::-1].transpose(0, 2, 1), b[-1])[::-1]
    p = f * b
    return p[:, 1] / p.sum(1)


LONG = 512  # lines of a text that is worked on by itself
STEP_LINES = 1 << 15  # lines whose features are held at once


def marginals(emission: np.ndarray, pair: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Probability that each line is good."""
    sizes = np.diff(first)
    out = np.empty(len(emission))
    short = np.repeat(sizes <= LONG, sizes)
    if short.any():
        begins = np.concatenate([[0], np.cumsum(sizes[sizes <= LONG])])
        out[short] = forward_backward(emission[short], pair, begins)[0]
    for t in np.flatnonzero(sizes > LONG).tolist():
        out[first[t] : first[t + 1]] = long_marginals(emission[first[t] : first[t + 1]], pair)
    return out


def line_runs(texts: list[str]) -> Iterator[tuple[list[bytes], list[int]]]:
    """The texts in runs of about ``STEP_LINES`` lines, and whose each part is; only a longer text is cut, between lines."""
    run, owners, held = [], [], 0
    for i, text in enumerate(texts):
        raw = text.encode()
        cuts = [-1]
        if raw.count(b"\n") >= STEP_LINES:
            cuts += np.flatnonzero(np.frombuffer(raw, np.uint8) == 10)[STEP_LINES - 1 :: STEP_LINES].tolist()
        for a, b in zip(cuts, [*cuts[1:], len(raw)]):
            part = raw[a + 1 : b]
            lines = part.count(b"\n") + 1
            if held and held + lines > STEP_LINES:
                yield run, owners
                run, owners, held = [], [], 0
            run.append(part)
            owners.append(i)
            held += lines
    if run:
        yield run, owners


@dataclass
class LineField:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    pair: np.ndarray
    slope: float = 1.0
    offset: float = 0.0

    def lines(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores of "good" of all lines, their lengths, and the first line of each text and of the end.

        A line's score is the sum of what its own features, those of the line before and those of the line after give.
        Features are held for a bounded number of lines, three sums for each line of the step.
        """
        d = len(self.mean)
        three = self.weights[: 3 * d].reshape(3, d).T
        sums, lengths, sizes = [], [], np.zeros(len(texts), dtype=np.int64)
        for run, owners in line_runs(texts):
            x, length, first = line_features(run)
            sums.append(((x - self.mean) / self.scale) @ three)
            lengths.append(length)
            np.add.at(sizes, owners, np.diff(first))
        first = np.concatenate([[0], np.cumsum(sizes)])
        own, before, after = np.concatenate(sums).T
        begins, closes = first[:-1], first[1:] - 1
        emission = own + self.weights[3 * d + 2]
        emission[1:] += before[:-1]
        emission[:-1] += after[1:]
        emission[begins[1:]] -= before[begins[1:] - 1]
        emission[closes[:-1]] -= after[closes[:-1] + 1]
        emission[begins] += self.weights[3 * d]
        emission[closes] += self.weights[3 * d + 1]
        return emission, np.concatenate(lengths), first

    def raw(self, texts: list[str]) -> np.ndarray:
        """Log odds of the length-weighted mean of the lines' probabilities."""
        emission, length, first = self.lines(texts)
        good = marginals(emission, self.pair, first)
        weight = length + 1.0
        total = np.add.reduceat(good * weight, first[:-1]) / np.add.reduceat(weight, first[:-1])
        total = np.clip(total, 1e-6, 1 - 1e-6)
        return np.log(total / (1 - total))

    def score(self, texts: list[str]) -> np.ndarray:
        return sigmoid(self.slope * self.raw(texts) + self.offset)


def labelled_sample(
    documents: DataFrame, labels: DataFrame, rows: int, longest: int, folds: int = 5, held_out: int = 0
) -> list[tuple[str, int]]:
    """At most ``rows`` labelled texts, at most half of each label, outside the held-out fold.

    The rows are picked by hash from the labels alone, so no text is moved to pick them; their number bounds the
    broadcast.
    """
    usable = labels.where(F.col("quality").isin(0, 1) & (crc_mod("doc_id", folds) != held_out))
    usable = usable.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("_most"))
    usable = usable.where("quality = _most").select("doc_id", "quality")
    picked = [
        (r["doc_id"], r["quality"])
        for q in (0, 1)
        for r in spread_sample(usable.where(F.col("quality") == q), "doc_id", rows // 2).collect()
    ]
    short = documents.where(F.length("text") <= longest)
    return texts_by_id(short, "doc_id", "text", picked, "int")


def fit_lines(rows: list[tuple[str, int]], settings: QualitySettings = QualitySettings()) -> LineField:
    """Gradient steps on the mean log likelihood of the lines' labels, then the logistic curve."""
    texts, label = [t for t, _ in rows], np.asarray([q for _, q in rows])
    d = 3 * N_BASE + 3
    if len(set(label.tolist())) < 2:
        return LineField(np.zeros(N_BASE), np.ones(N_BASE), np.zeros(d), np.zeros((2, 2)))
    # a hundred texts at a time: the arrays over their characters are the largest of the fit
    runs = [texts[i : i + 100] for i in range(0, len(texts), 100)]
    parts = [line_features(r) for r in runs]
    x = np.concatenate([p[0] for p in parts])
    first = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(p[2]) for p in parts]))])
    mean, scale = x.mean(0), x.std(0) + 1e-3
    field = LineField(mean, scale, np.zeros(d), np.zeros((2, 2)))
    x = with_neighbours((x - mean) / scale, first)
    sizes = np.diff(first)
    y = np.repeat(label, sizes).astype(float)
    # every text counts the same, however many lines it has
    weight = np.repeat(1.0 / sizes, sizes)
    observed = np.array([[((label == 0) * (sizes - 1)).sum(), 0.0], [0.0, ((label == 1) * (sizes - 1)).sum()]])
    moments = [np.zeros_like(field.weights), np.zeros_like(field.pair)]
    squares = [np.zeros_like(field.weights), np.zeros_like(field.pair)]
    for step in range(1, settings.steps + 1):
        good, expected = forward_backward(x @ field.weights, field.pair, first)
        gradients = (
            x.T @ ((y - good) * weight) / len(texts) - settings.decay * field.weights,
            (observed - expected) / max(len(y), 1) - settings.decay * field.pair,
        )
        for i, (g, w) in enumerate(zip(gradients, (field.weights, field.pair))):
            moments[i] = 0.9 * moments[i] + 0.1 * g
            squares[i] = 0.99 * squares[i] + 0.01 * g * g
            w += settings.rate * 0.3 * (moments[i] / (1 - 0.9**step)) / (np.sqrt(squares[i] / (1 - 0.99**step)) + 1e-8)
    field.slope, field.offset = platt(np.concatenate([field.raw(r) for r in runs]), label)
    return field


def fit_quality(documents: DataFrame, labels: DataFrame, settings: QualitySettings = QualitySettings()) -> LineField:
    return fit_lines(labelled_sample(documents, labels, settings.sample_rows, settings.longest), settings)


def score_documents(
    df: DataFrame, field: LineField, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3
) -> DataFrame:
    """Per document its score, from 0 to 1, and whether it reaches the threshold."""

    def work():
        def each(texts: list[str]) -> list:
            s = field.score(texts)
            return [s, (s >= threshold).astype(np.int32)]

        return each

    return map_texts(df, id_col, text_col, "score double, predicted int", work)


def keep_good(df: DataFrame, field: LineField, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The documents that reach the threshold, with all their columns."""
    return keep_rows(df, text_col, lambda: lambda texts: field.score(texts) >= threshold)
