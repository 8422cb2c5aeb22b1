"""Language identification by averaged hashed subword embeddings.

Letters are lower-cased, other characters become word boundaries. Runs of two, three and four characters are hashed to
embeddings; their mean goes through a linear softmax. Both are trained by stochastic gradient descent. Since both are linear, a text is
scored with the product of the two: one number per run and language. A temperature and rejection thresholds are set on
rows left out of training, one threshold for each class of length: ``slack`` log odds below the least sure of the rightly
named rows of that class. A text of a language that was not learnt has less than that, unless it is much like a learnt one.

A text that is null, empty or without a letter is ``und`` with score 0, and so is every text if no language could be
learnt. Repeated rows get equal results; an empty table gives none; only id and text are read for prediction.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import crc_mod, keep_rows, map_texts, texts_by_id

UNKNOWN = "und"
_MULTIPLY = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], dtype=np.uint32)


@dataclass(frozen=True)
class LanguageSettings:
    sample_rows: int = 1600  # rows used for training and calibration, over all languages
    longest: int = 30_000  # characters of a row that is used for training; prediction has no limit
    bits: int = 15
    dimensions: int = 12
    epochs: int = 4
    rate: float = 1.0
    classes: tuple[int, ...] = (50, 200)  # letters where the next class of length begins
    slack: float = 2.0  # log odds; the rows left out are too few to show the least sure of all rows
    seed: int = 5


_PLAIN = np.zeros(0x250, dtype=np.uint32)
for _c in range(0x250):
    _s = chr(_c).lower()
    _PLAIN[_c] = ord(_s[0]) if chr(_c).isalpha() else 0


def _letters(text: str) -> np.ndarray:
    """Code points, lower-cased; 0 for what is no letter."""
    c = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    if len(c) and c.max() >= len(_PLAIN):
        far = np.flatnonzero(c >= len(_PLAIN))
        out = _PLAIN[np.minimum(c, len(_PLAIN) - 1)]
        values, back = np.unique(c[far], return_inverse=True)
        lower = np.array([ord(chr(v).lower()[0]) if chr(v).isalpha() else 0 for v in values.tolist()], dtype=np.uint32)
        out[far] = lower[back]
        return out
    return _PLAIN[c]


def grams(texts: list[str], bits: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Hashed runs of two, three and four characters (one array each, over all texts), starts, letters per text."""
    parts = []
    for t in texts:
        parts += [_letters(t), np.zeros(4, dtype=np.uint32)]  # so that no run spans two texts unseen
    c = np.concatenate([np.zeros(1, dtype=np.uint32), *parts])
    sizes = np.fromiter((len(p) for p in parts), dtype=np.int64, count=len(parts)).reshape(-1, 2).sum(1)
    start = np.concatenate([[0], np.cumsum(sizes)])
    n = len(c) - 4
    out = []
    h = c[:n] * _MULTIPLY[0]
    for k in range(1, 4):
        h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D) + c[k : n + k] * _MULTIPLY[k]
        out.append(((h * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits)).astype(np.int32))
    return out, start, c[: n + 1] != 0


@dataclass
class LanguageModel:
    languages: list[str]
    table: np.ndarray  # language x hash
    offset: np.ndarray
    temperature: float
    thresholds: np.ndarray  # one for each class of length
    classes: tuple[int, ...]
    bits: int

    def logits(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Scores of the languages, and the number of letters of each text."""
        hashed, start, letter = grams(texts, self.bits)
        n = len(letter) - 1
        begin, end = np.minimum(start[:-1], n), np.minimum(start[1:], n)
        held = np.concatenate([[0], np.cumsum(letter, dtype=np.int64)])
        letters = held[np.minimum(end + 1, n + 1)] - held[begin]
        # a run counts if its second character is a letter: blanks alone say nothing
        live = letter[1 : n + 1]
        weight = np.concatenate([[0], np.cumsum(live, dtype=np.int64)])
        count = np.maximum(3 * (weight[end] - weight[begin]), 1)
        out = np.empty((len(texts), len(self.languages)))
        for i, row in enumerate(self.table):
            total = np.zeros(n + 1)
            np.cumsum((row[hashed[0]] + row[hashed[1]] + row[hashed[2]]) * live, dtype=np.float64, out=total[1:])
            out[:, i] = (total[end] - total[begin]) / count + self.offset[i]
        return out, letters

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The likeliest language of each text, its probability, and whether that is too low for the length of the text."""
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), dtype=bool)
        z, letters = self.logits(texts)
        p = probabilities(z / self.temperature)
        best, has = p.argmax(1), letters > 0
        names = [self.languages[b] if h else UNKNOWN for b, h in zip(best.tolist(), has.tolist())]
        score = np.where(has, p[np.arange(len(best)), best], 0.0)
        return names, score, ~has | (score < self.thresholds[np.searchsorted(self.classes, letters, side="right")])


def probabilities(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def language_sample(documents: DataFrame, settings: LanguageSettings) -> list[tuple[str, str]]:
    """A bounded sample of texts with a language, outside the held-out fold, the same number of each language if there are enough."""
    usable = documents.where(
        F.col("text").isNotNull() & F.col("lang").isNotNull() & (crc_mod("doc_id", 3) != 1)
        & (F.length("text") <= settings.longest) & (F.col("lang") != UNKNOWN)
    )
    names = usable.select("lang").distinct().count()
    if not names:
        return []
    # ids first: a sample of texts would bring that many texts from every partition together
    order = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64(F.lit(29), "doc_id"), "doc_id"))
    ranked = usable.select("doc_id", "lang").withColumn("_rank", order)
    picked = ranked.where(F.col("_rank") <= max(1, settings.sample_rows // names)).select("doc_id", "lang").limit(settings.sample_rows)
    return texts_by_id(usable, "doc_id", "text", [tuple(r) for r in picked.collect()], "string")


def fit_language(rows: list[tuple[str, str]], settings: LanguageSettings = LanguageSettings()) -> LanguageModel:
    languages = sorted({name for _, name in rows})
    if not languages:
        return LanguageModel([], np.zeros((0, 1 << settings.bits)), np.zeros(0), 1.0, np.zeros(len(settings.classes) + 1), settings.classes, settings.bits)
    random = np.random.default_rng(settings.seed)
    place = {name: i for i, name in enumerate(languages)}
    # short cuts of the texts are examples too, so that short texts are judged well
    examples = []
    for text, name in rows:
        examples.append((text, place[name]))
        size = int(random.integers(12, 200))
        at = int(random.integers(0, max(1, len(text) - size)))
        examples.append((text[at : at + size], place[name]))
    left_out = np.arange(len(examples)) // 2 % 5 == 0  # for calibration
    embedding = random.normal(0, 0.1, (1 << settings.bits, settings.dimensions))
    output = random.normal(0, 0.1, (settings.dimensions, len(languages)))
    offset = np.zeros(len(languages))
    ready = []
    for i, (text, label) in enumerate(examples):
        if left_out[i]:
            continue
        hashed, _, letter = grams([text], settings.bits)
        live = letter[1:]
        ids, n = np.unique(np.concatenate([h[live] for h in hashed]), return_counts=True)
        if len(ids):
            ready.append((ids, n / n.sum(), label))
    total, done = settings.epochs * max(1, len(ready)), 0
    for _ in range(settings.epochs):
        for i in random.permutation(len(ready)):
            ids, share, label = ready[i]
            rate = settings.rate * (1 - done / total) + 0.01
            hidden = share @ embedding[ids]
            z = hidden @ output + offset
            p = np.exp(z - z.max())
            p /= p.sum()
            p[label] -= 1
            back = output @ p
            output -= rate * np.outer(hidden, p)
            offset -= rate * 0.1 * p
            # a mean of many runs moves each a little; the root keeps rare runs learning
            embedding[ids] -= rate * 4 * np.sqrt(share)[:, None] * back[None, :]
            done += 1
    table = (embedding @ output).T.astype(np.float32).copy()
    model = LanguageModel(languages, table, offset, 1.0, np.zeros(len(settings.classes) + 1), settings.classes, settings.bits)
    held = [e for e, out in zip(examples, left_out) if out]
    return calibrated(model, held, settings)


def calibrated(model: LanguageModel, held: list[tuple[str, int]], settings: LanguageSettings) -> LanguageModel:
    """Temperature by the likelihood of the rows left out, then the rejection thresholds."""
    if not held:
        return model
    z, letters = model.logits([t for t, _ in held])
    label = np.asarray([i for _, i in held])[letters > 0]
    z, letters = z[letters > 0], letters[letters > 0]
    if not len(z):
        return model

    def loss(t: float) -> float:
        s = z / t
        s = s - s.max(1, keepdims=True)
        return float((np.log(np.exp(s).sum(1)) - s[np.arange(len(s)), label]).mean())

    model.temperature = min(np.geomspace(0.1, 10, 60), key=loss)
    p = probabilities(z / model.temperature)
    right, p = p.argmax(1) == label, np.clip(p.max(1), 1e-9, 1 - 1e-9)
    odds, size = np.log(p / (1 - p)), np.searchsorted(settings.classes, letters, side="right")
    for k in range(len(model.thresholds)):
        # a class without enough rows takes all
        own = right & (size == k) if (right & (size == k)).sum() >= 20 else right
        if own.any():
            model.thresholds[k] = 1 / (1 + np.exp(settings.slack - odds[own].min()))
    return model


def train(documents: DataFrame, settings: LanguageSettings = LanguageSettings()) -> LanguageModel:
    return fit_language(language_sample(documents, settings), settings)


def identify(df: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document the language, its probability, and whether that is below the threshold."""

    def work():
        def each(texts: list[str]) -> list:
            names, p, rejected = model.predict(texts)
            return [pa.array(names, type=pa.string()), p, pa.array(rejected, type=pa.bool_())]

        return each

    return map_texts(df, id_col, text_col, "lang_pred string, score double, rejected boolean", work)


def keep_identified(df: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """The documents whose language is not rejected, with all their columns."""

    return keep_rows(df, text_col, lambda: lambda texts: ~model.predict(texts)[2])
