"""Personal data by fixed patterns and a semi-Markov conditional random field.

The patterns (``base_spans``) are exact and always count. The field adds spans that they miss, such as a phone number
without a plus sign or an address written ``name @ host.org``. It works on runs of tokens around digits and ``@``.
A segment is either one outside token or an entity of at most ``max_tokens`` tokens; its features see the whole span (number of
digits, their grouping, Luhn, octets, the shape of an address, both neighbours, a cue word before), and dynamic
programming over all segmentations picks boundaries and types together. Weights are fitted by gradient steps on the log
likelihood, on examples made from templates and on runs of a bounded number of documents, labelled by the patterns.

Null and empty texts have no span. Repeated rows are searched one by one, an empty table gives no rows, and only the id
and the text are read. Long texts cost time in proportion: every scan moves on, and segments are bounded.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, spread_sample, texts_by_id

KINDS = ("email", "ip", "card", "phone")
_RANK = {k: i for i, k in enumerate(KINDS)}

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_HAS_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def octets(text: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in text.split("."))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the fixed patterns by start, then kind; leftmost and non-overlapping within each kind."""
    out, at, done = [], text.find("@"), 0
    while at >= 0:
        found = _DOMAIN.match(text, at + 1)
        if found:
            start = at
            while start > done and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                out.append(("email", start, found.end()))
                done = found.end()
        at = text.find("@", max(at + 1, done))
    if _HAS_DIGIT.search(text):
        out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if octets(m[0])]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14:
                d = _digits(m[0])
                if 14 <= len(d) <= 19 and luhn(d):
                    out.append(("card", m.start(), m.end()))
        if "+" in text:
            out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 10 <= len(_digits(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[1], _RANK[s[0]], s[2]))


# ---- the field ------------------------------------------------------------------------------------------------------

_TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|\s+|.", re.S)
_TRIGGER = re.compile(r"[0-9]+|@")
_RUN_GAP, _RUN_SIDE = 6, 40  # characters between triggers of one run, and around it
_IN_ENTITY = re.compile(r"[A-Za-z0-9._%+@() -]+")
CUES = {
    "email": ("mail", "email", "contact"), "ip": ("ip", "host", "server", "address"),
    "card": ("card", "visa", "mastercard", "payment"), "phone": ("phone", "tel", "call", "mobile", "fax"),
}


@dataclass(frozen=True)
class PiiSettings:
    max_tokens: int = 12
    sample_documents: int = 300  # documents with patterns, for fitting
    epochs: int = 6
    rate: float = 0.3
    seed: int = 7


def runs_of(text: str) -> list[tuple[int, int]]:
    """Character runs that can hold an entity: seven digits or an ``@`` close together, with what stands around."""
    out: list[list[int]] = []
    for m in _TRIGGER.finditer(text):
        size = m.end() - m.start() if m[0] != "@" else 7
        if out and m.start() - out[-1][1] <= _RUN_GAP:
            out[-1][1] = m.end()
            out[-1][2] += size
        else:
            out.append([m.start(), m.end(), size])
    return [(max(0, a - _RUN_SIDE), min(len(text), b + _RUN_SIDE)) for a, b, n in out if n >= 7]


_GROUPS = re.compile(r"[0-9]+")


@lru_cache(maxsize=20_000)
def span_features(span: str, left: str, right: str, cue: str) -> tuple[str, ...]:
    """Names of the features of a whole span; the same for all types, which have weights of their own."""
    groups = [len(g) for g in _GROUPS.findall(span)]
    digits = sum(groups)
    f = ["bias"]
    size = "0" if not digits else "1-6" if digits < 7 else "7-9" if digits < 10 else "10-13" if digits < 14 else "14-15" if digits < 16 else "16" if digits == 16 else "17-19" if digits < 20 else "20+"
    f.append(f"digits={size}")
    f.append(f"groups={min(len(groups), 6)}")
    f.append("shape=" + re.sub(r"[A-Za-z]+", "a", re.sub(r"[0-9]+", "0", span))[:16])
    if groups:
        f.append("longest=" + ("1-3" if max(groups) < 4 else "4" if max(groups) == 4 else "5-8" if max(groups) < 9 else "9+"))
    if digits >= 12:
        f.append("luhn" if luhn(_digits(span)) else "noluhn")
        f.append(f"luhn,{size}" if luhn(_digits(span)) else f"noluhn,{size}")
    name, at, host = span.partition("@")
    if at:
        good = bool(re.fullmatch(r"[A-Za-z0-9._%+-]+ ?", name) and re.fullmatch(r" ?[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}", host))
        f.append("address" if good else "noaddress")
    parts = span.split(".")
    if len(parts) == 4 and all(p.isdigit() and p.isascii() for p in parts):
        f.append("octets" if octets(span) else "nooctets")
    if span[0] == "+":
        f.append("plus")
    if "(" in span or ")" in span:
        f.append("closed" if re.fullmatch(r"[^()]*(\([0-9]+\)[^()]*)?", span) else "unclosed")
    f.append("letters" if re.search(r"[A-Za-z]", span) else "noletters")
    f.append("starts=" + _class(span[0]))
    f.append("ends=" + _class(span[-1]))
    f.append("left=" + _class(left))
    f.append("right=" + _class(right))
    if cue:
        f.append("cue=" + cue)
    return tuple(f)


def _class(c: str) -> str:
    return "none" if not c else "digit" if "0" <= c <= "9" else "letter" if c.isalpha() else "blank" if c.isspace() else c


_CUE = {w: k for k, words in CUES.items() for w in words}


class SpanField:
    """Segment scores and dynamic programming. ``weights``: feature -> one number per kind; ``follow``: weight of an entity right after one."""

    def __init__(self, max_tokens: int, weights: dict[str, np.ndarray] | None = None, follow: float = 0.0):
        self.max_tokens, self.weights, self.follow = max_tokens, weights or {}, follow

    def segments(self, text: str) -> tuple[list[int], list[tuple[int, int, tuple[str, ...]]]]:
        """Token boundaries, and all candidate segments (first token, end token, features)."""
        cut, kinds, cue = [0], [], ""
        cues = []
        for m in _TOKEN.finditer(text):
            cut.append(m.end())
            word = m[0]
            kinds.append("d" if "0" <= word[0] <= "9" else "s" if word.isspace() else "a" if word[0].isalpha() and word.isascii() else word if len(word) == 1 else "x")
            cues.append(cue)
            if word[0].isalpha():
                cue = _CUE.get(word.lower(), "")
        out, n = [], len(kinds)
        for i in range(n):
            if kinds[i] not in ("d", "a", "+", "("):
                continue
            digits, at = 0, False
            for j in range(i, min(n, i + self.max_tokens)):
                k = kinds[j]
                piece = text[cut[j] : cut[j + 1]]
                if k == "d":
                    digits += len(piece)
                elif k == "@":
                    at = True
                elif k == "s" and piece != " " or k == "x" or not _IN_ENTITY.fullmatch(piece) or k == "a" and digits and not at:
                    if not (k == "a" and j - i < 4):
                        break
                if k in ("d", "a") and (at or digits >= 7 and kinds[i] != "a"):
                    left, right = text[cut[i] - 1] if i else "", text[cut[j + 1]] if j + 1 < n else ""
                    out.append((i, j + 1, span_features(text[cut[i] : cut[j + 1]], left, right, cues[i])))
        return cut, out

    def scores(self, features: tuple[str, ...]) -> np.ndarray:
        total = np.zeros(len(KINDS))
        for f in features:
            w = self.weights.get(f)
            if w is not None:
                total += w
        return total

    def forward(self, n: int, segments: list, scores: list[np.ndarray]):
        """Log sums over segmentations of the tokens before each place, by whether the last segment is an entity."""
        ends: list[list[int]] = [[] for _ in range(n + 1)]
        for s, (_, j, _) in enumerate(segments):
            ends[j].append(s)
        a = np.full((n + 1, 2), -np.inf)
        a[0, 0] = 0.0
        for t in range(1, n + 1):
            a[t, 0] = np.logaddexp(a[t - 1, 0], a[t - 1, 1])
            for s in ends[t]:
                i = segments[s][0]
                before = np.logaddexp(a[i, 0], a[i, 1] + self.follow)
                a[t, 1] = np.logaddexp(a[t, 1], before + np.logaddexp.reduce(scores[s]))
        return a

    def backward(self, n: int, segments: list, scores: list[np.ndarray]):
        begins: list[list[int]] = [[] for _ in range(n + 1)]
        for s, (i, _, _) in enumerate(segments):
            begins[i].append(s)
        b = np.full((n + 1, 2), -np.inf)
        b[n] = 0.0
        for t in range(n - 1, -1, -1):
            for y in (0, 1):
                total = b[t + 1, 0]
                for s in begins[t]:
                    j = segments[s][1]
                    total = np.logaddexp(total, self.follow * y + np.logaddexp.reduce(scores[s]) + b[j, 1])
                b[t, y] = total
        return b

    def best(self, text: str) -> list[tuple[str, int, int]]:
        """The best segmentation's entities."""
        cut, segments = self.segments(text)
        if not segments:
            return []
        n = len(cut) - 1
        best = [[0.0, -np.inf] for _ in range(n + 1)]
        back: list[list] = [[None, None] for _ in range(n + 1)]
        ends: list[list[tuple]] = [[] for _ in range(n + 1)]
        for i, j, f in segments:
            s = self.scores(f)
            k = int(s.argmax())
            if s[k] > -8:
                ends[j].append((i, float(s[k]), k))
        for t in range(1, n + 1):
            y = 0 if best[t - 1][0] >= best[t - 1][1] else 1
            best[t][0], back[t][0] = best[t - 1][y], (t - 1, y, None)
            for i, s, k in ends[t]:
                y = 0 if best[i][0] >= best[i][1] + self.follow else 1
                v = best[i][y] + (self.follow if y else 0.0) + s
                if v > best[t][1]:
                    best[t][1], back[t][1] = v, (i, y, k)
        out, t, y = [], n, 0 if best[n][0] >= best[n][1] else 1
        while t:
            i, before, k = back[t][y]
            if k is not None:
                out.append((KINDS[k], cut[i], cut[t]))
            t, y = i, before
        return out[::-1]

    def fit(self, examples: list[tuple[str, list[tuple[str, int, int]]]], epochs: int, rate: float, seed: int) -> SpanField:
        """Gradient steps (with sums of squares, Adagrad) on the log likelihood of the labelled segmentations."""
        squares: dict[str, np.ndarray] = {}
        prepared = []
        for text, spans in examples:
            cut, segments = self.segments(text)
            place = {c: t for t, c in enumerate(cut)}
            gold = {(place.get(a), place.get(b)): _RANK[k] for k, a, b in spans}
            found = [gold.get((i, j), -1) for i, j, _ in segments]
            if segments and sum(g >= 0 for g in found) == len(gold):  # otherwise the labels cannot be segments
                prepared.append((len(cut) - 1, segments, found))
        order = np.random.default_rng(seed)
        for _ in range(epochs):
            for e in order.permutation(len(prepared)):
                n, segments, found = prepared[e]
                scores = [self.scores(f) for _, _, f in segments]
                a, b = self.forward(n, segments, scores), self.backward(n, segments, scores)
                z = np.logaddexp(a[n, 0], a[n, 1])
                for s, (i, j, f) in enumerate(segments):
                    before = np.logaddexp(a[i, 0], a[i, 1] + self.follow)
                    g = -np.exp(np.clip(before + scores[s] + b[j, 1] - z, -50, 0))
                    if found[s] >= 0:
                        g[found[s]] += 1
                    if np.abs(g).max() < 1e-4:
                        continue
                    for name in f:
                        w = self.weights.setdefault(name, np.zeros(len(KINDS)))
                        q = squares.setdefault(name, np.full(len(KINDS), 1e-2))
                        q += g * g
                        w += rate * (g - 1e-4 * w) / np.sqrt(q)
        return self


def template_examples(seed: int, count: int = 240) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Texts around made-up spans, also in forms that the patterns miss, and around numbers that are none."""
    r = np.random.default_rng(seed)
    pick = lambda *x: x[r.integers(len(x))]
    num = lambda n: "".join(str(r.integers(10)) for _ in range(n))
    word = lambda: "".join(pick("ba", "ke", "ti", "ro", "mun", "sel", "da", "vi") for _ in range(r.integers(1, 4)))

    def card(n: int) -> str:
        d = pick("4", "5", "3", "6") + num(n - 2)
        return next(d + c for c in "0123456789" if luhn(d + c))

    def spaced(d: str, by: str) -> str:
        return by.join(d[i : i + 4] for i in range(0, len(d), 4))

    out = []
    for i in range(count):
        kind = pick("email", "ip", "card", "phone", "none", "none")
        octet = lambda: str(r.integers(256))
        if kind == "email":
            s = pick("{w}.{w2}@{h}.com", "{w}{n}@{h}.example.org", "{w} @ {h}.com", "{w}@{h}.co.uk").format(w=word(), w2=word(), n=num(2), h=word())
        elif kind == "ip":
            s = ".".join(octet() for _ in range(4))
        elif kind == "card":
            d = card(int(pick(16, 16, 16, 15, 19)))
            s = pick(d, spaced(d, " "), spaced(d, "-"), spaced(d, "."))
        elif kind == "phone":
            s = pick("+{a} ({b}) {c}-{d}", "({b}) {c}-{d}", "+{a} {b} {c} {d}", "{b}-{c}-{d}", "+{a}{b}{c}{d}", "({b}) {c} {d}").format(a=r.integers(1, 99), b=num(3), c=num(3), d=num(4))
        else:
            s = pick(
                f"20{num(2)}-{num(2)}-{num(2)}", num(8), f"{num(3)}.{num(3)},{num(2)}", num(12), f"{num(5)}-{num(4)}", num(22),
                f"{octet()}.{octet()}.{octet()}", f"{r.integers(256, 999)}.{octet()}.{octet()}.{octet()}", f"{num(2)}:{num(2)}:{num(2)} {num(4)}",
                next(d for d in (num(16) for _ in range(99)) if not luhn(d)), f"{word()}@{word()}", f"{num(4)} {num(4)}", f"v{num(1)}.{num(1)}.{num(3)}.{num(4)}", f"{num(4)}-{num(4)}", f"{num(3)} {num(3)} {num(2)}",
            )
        cue = pick("", "", pick(*CUES[kind]) + pick(" ", ": ") if kind in CUES else word() + " ")
        before = f"{word()} {word()}{pick(' ', ', ', chr(10))}{cue}"
        text = before + s + pick(" ", ". ", ", ", "\n") + word()
        out.append((text, [(kind, len(before), len(before) + len(s))] if kind in CUES else []))
    return out


def document_examples(texts: list[str], most: int = 400) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Runs of documents, labelled by the patterns; runs in which patterns of two kinds overlap are left out."""
    out = []
    for text in texts:
        spans = base_spans(text)
        for a, b in runs_of(text)[:20]:
            held = [(k, s - a, e - a) for k, s, e in spans if a <= s and e <= b]
            clear = all(x[2] <= y[1] for x, y in zip(held, held[1:]))
            if clear and not any(s < a < e or s < b < e for _, s, e in spans) and b - a < 400:
                out.append((text[a:b], held))
        if len(out) >= most:
            break
    return out


def fit_field(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: PiiSettings = PiiSettings()) -> SpanField:
    """Fitted on templates and on a bounded sample of documents that hold ten digits or an ``@``."""
    given = df.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").cast("string").alias("_text"))
    with_data = given.where("_id is not null and _text rlike '[0-9]{4}|@' and length(_text) < 20000")
    # ids first: a sample of texts would bring that many texts from every partition together
    ids = [(r["_id"], 0) for r in spread_sample(with_data.select("_id"), "_id", settings.sample_documents).collect()]
    texts = [t for t, _ in texts_by_id(with_data, "_id", "_text", ids, "int")]
    examples = template_examples(settings.seed) + document_examples(texts)
    return SpanField(settings.max_tokens).fit(examples, settings.epochs, settings.rate, settings.seed)


def all_spans(text: str, field: SpanField) -> tuple[list, list]:
    """Pattern spans, and these with the field's spans that touch none of them."""
    base = base_spans(text)
    added = []
    if "@" in text or _HAS_DIGIT.search(text):
        for a, b in runs_of(text):
            added += [(k, s + a, e + a) for k, s, e in field.best(text[a:b])]
    if not added:
        return base, base
    added = sorted(set(added), key=lambda s: (s[1], -s[2]))
    taken = sorted((s, e) for _, s, e in base)
    out, at, reach, last = list(base), 0, 0, 0
    for k, s, e in added:
        while at < len(taken) and taken[at][0] < e:
            reach = max(reach, taken[at][1])
            at += 1
        if s >= reach and s >= last:
            out.append((k, s, e))
            last = e
    return base, sorted(out, key=lambda s: (s[1], _RANK[s[0]], s[2]))


def written(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def find_spans(
    df: DataFrame, field: SpanField, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per document: pattern spans by kind, the digest of their places, and all spans as ``kind:start:end``."""

    def work():
        def each(texts: list[str]) -> list:
            found = [all_spans(t, field) for t in texts]
            counts = [np.asarray([sum(s[0] == k for s in b) for b, _ in found], dtype=np.int64) for k in KINDS]
            return [
                *counts,
                [hashlib.sha256(written(b).encode()).hexdigest() for b, _ in found],
                [written(s) for _, s in found],
                np.asarray([len(s) - len(b) for b, s in found], dtype=np.int64),
            ]

        return each

    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return map_texts(df, id_col, text_col, f"{counts}, base_sha256 string, spans string, n_added long", work)


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with every run of overlapping spans replaced by the kind of its first, in brackets."""
    out, at = [], 0
    for i, (k, s, e) in enumerate(spans):
        if s >= at:
            out += [text[at:s], f"[{k.upper()}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])
