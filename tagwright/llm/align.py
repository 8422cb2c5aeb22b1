"""Alignment of two tokenizations of one text by divide and conquer at shared cuts.

Both tokenizations are sequences of byte ranges of the same bytes; a *cut* is a byte offset where a token of each ends.
An interval of the two sequences is split at a cut near its middle: the middle end of the first sequence, and then its
neighbours on both sides in turn, are located in the second one by bisection until one is shared. Both halves are split
again. An interval without a cut inside is a leaf, and leaves are the groups. The intervals of all texts of a step are
split together, level by level, as arrays.

Inside a group every boundary starts another overlap, so the links of a text are the pieces between consecutive ends of
either sequence. Per text the distinct linked id pairs and how often each is linked are kept; a pair's count is the number
of rows whose text holds it.

The counts come back to the texts by joins with slices of the pair table: slice k holds the ids of the first vocabulary
with ``hash % slices = k``, and their number is set by the measured size of the table, so that a slice has about
``slice_rows`` pairs and may be broadcast. One slice or many, the plan is the same: every pair of every text meets its
count in the task that reads it, and only one sum per text and slice is shuffled. No pair is dropped.

Texts that are null, empty, or whose bytes differ from a blank and the text after either tokenization have no tokens:
zeros, and an empty string for the digest of groups. Strings of special tokens inside texts are plain text. Repeated rows
count one by one. An empty table gives no rows. Only id and text are read, so further columns cannot clash. Texts are
worked on in steps of bounded bytes, one text at least; memory follows the longest text.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from .common import map_texts


@dataclass(frozen=True)
class AlignSettings:
    bytes_bpe: str = field(default_factory=lambda: public_tokenizers.path("byte_bpe_50k.json"))
    pieces: str = field(default_factory=lambda: public_tokenizers.path("piece_bpe_32k.model"))
    step_bytes: int = 512 << 10  # text that is worked on at once, one text at least
    slice_rows: int = 2_000_000  # pairs of a slice of the pair table, the most that is broadcast at once


@dataclass(frozen=True)
class Vocabulary:
    """A tokenizer: ids of texts, and the bytes that each id stands for."""

    encode: Callable[[list[str]], list[list[int]]]
    bytes_of: list[bytes]


def byte_alphabet() -> dict[str, int]:
    """Letter -> byte of byte-level vocabularies: printable Latin-1 letters stand for themselves, other bytes come after 255."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


@lru_cache(2)
def byte_vocabulary(path: str) -> Vocabulary:
    """The byte-level vocabulary of a ``tokenizers`` file, run by tiktoken, which gives the same ids in less time."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    special = {t.content for t in library.get_added_tokens_decoder().values()}
    letter = byte_alphabet()
    entries = {t: i for t, i in library.get_vocab(with_added_tokens=True).items()}
    bytes_of = [b""] * (max(entries.values()) + 1)
    for t, i in entries.items():
        bytes_of[i] = t.encode() if t in special else bytes(letter[c] for c in t)
    ranks = {bytes_of[i]: i for t, i in entries.items() if t not in special}
    coder = tiktoken.Encoding("pairs", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return Vocabulary(lambda texts: [coder.encode_ordinary(t) for t in texts], bytes_of)


@lru_cache(2)
def piece_vocabulary(path: str) -> Vocabulary:
    """The pieces of a ``sentencepiece`` model; it puts a blank before the text itself."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)

    def meant(i: int) -> bytes:
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            return bytes([int(piece[3:-1], 16)])
        return piece.replace("▁", " ").encode()

    bytes_of = [meant(i) for i in range(model.get_piece_size())]
    return Vocabulary(lambda texts: model.encode(texts, num_threads=1), bytes_of)


class Sequences:
    """Token sequences of several texts end to end: ids, byte ends (over all texts), and the first token of each text."""

    def __init__(self, ids: list[list[int]], length_of: np.ndarray):
        self.first = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int64)
        self.ids = np.fromiter(chain.from_iterable(ids), dtype=np.int64, count=int(self.first[-1]))
        self.ends = np.cumsum(length_of[self.ids])


def shared_cuts(a: Sequences, b: Sequences) -> np.ndarray:
    """The tokens of ``a``, in order, whose ends are ends of ``b`` too.

    The ends of a text's two sequences are the same at its last token. An interval is (low, high): the tokens of ``a``
    with numbers in [low, high) may end at a cut; its ``b`` tokens are [b_low, b_high).
    """
    low, high = a.first[:-1], a.first[1:] - 1  # the last token of a text ends at a cut
    b_low, b_high = b.first[:-1], b.first[1:] - 1
    found = [high[a.first[1:] > a.first[:-1]]]
    low, high, b_low, b_high = (x[high >= low] for x in (low, high, b_low, b_high))
    while len(low):
        some = (high > low) & (b_high > b_low)
        low, high, b_low, b_high = (x[some] for x in (low, high, b_low, b_high))
        middle = (low + high) // 2
        cut = np.full(len(low), -1, dtype=np.int64)
        place = np.zeros(len(low), dtype=np.int64)
        open_, step = np.arange(len(low)), 0
        while len(open_):
            # middle, middle + 1, middle - 1, middle + 2 ... as long as one side is inside the interval
            away = (step + 1) // 2
            at = middle[open_] + (away if step % 2 else -away)
            inside = (at >= low[open_]) & (at < high[open_])
            asked, at = open_[inside], at[inside]
            end = a.ends[at]
            near = np.searchsorted(b.ends, end)
            hit = (near >= b_low[asked]) & (near < b_high[asked])
            hit[hit] = b.ends[near[hit]] == end[hit]
            cut[asked[hit]], place[asked[hit]] = at[hit], near[hit]
            more = (cut[open_] < 0) & ((middle[open_] + away + 1 < high[open_]) | (middle[open_] - away >= low[open_]))
            open_, step = open_[more], step + 1
        split = cut >= 0
        cut, place = cut[split], place[split]
        found.append(cut)
        low, high = np.concatenate([low[split], cut + 1]), np.concatenate([cut, high[split]])
        b_low, b_high = np.concatenate([b_low[split], place + 1]), np.concatenate([place, b_high[split]])
    return np.sort(np.concatenate(found))


@dataclass
class Groups:
    """Groups of all texts: the number of a group's first token in both sequences (and the end), and of a text's first group."""

    a: np.ndarray
    b: np.ndarray
    first: np.ndarray


def groups_of(a: Sequences, b: Sequences) -> Groups:
    last = shared_cuts(a, b)
    a_start = np.concatenate([[0], last + 1])
    b_start = np.concatenate([[0], np.searchsorted(b.ends, a.ends[last]) + 1])
    return Groups(a_start, b_start, np.searchsorted(a_start, a.first))


def links_of(a: Sequences, b: Sequences) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The linked tokens of both sequences, and the text of each link: one link for each piece between consecutive ends."""
    merged = np.sort(np.concatenate([2 * a.ends, 2 * b.ends + 1]), kind="stable")  # even: an end of the first sequence
    first = merged % 2 == 0
    new = np.ones(len(merged), dtype=bool)
    new[1:] = merged[1:] // 2 != merged[:-1] // 2
    x = (np.cumsum(first) - first)[new]
    y = (np.cumsum(~first) - ~first)[new]
    return x, y, np.repeat(np.arange(len(a.first) - 1), np.diff(np.searchsorted(x, a.first)))


class GroupWriter:
    """Groups as text, ``a1,a2|b1;a3|b2,b3``, from a table of ids that already carry their separators."""

    def __init__(self, n_a: int, n_b: int):
        self.n_a, self.n_b = n_a, n_b
        self.words = [
            *[b"%d," % i for i in range(n_a)], *[b"%d|" % i for i in range(n_a)],
            *[b"%d," % i for i in range(n_b)], *[b"%d;" % i for i in range(n_b)],
        ]

    def texts(self, a: Sequences, b: Sequences, g: Groups) -> list[bytes]:
        size_a, size_b = np.diff(g.a), np.diff(g.b)
        which = np.empty(len(a.ids) + len(b.ids), dtype=np.int64)
        word_a = a.ids.copy()
        word_a[g.a[1:] - 1] += self.n_a
        word_b = b.ids + 2 * self.n_a
        word_b[g.b[1:] - 1] += self.n_b
        which[np.arange(len(a.ids)) + np.repeat(g.b[:-1], size_a)] = word_a
        which[np.arange(len(b.ids)) + np.repeat(g.a[1:], size_b)] = word_b
        edge = (g.a + g.b)[g.first].tolist()
        listed = list(map(self.words.__getitem__, which.tolist()))
        return [b"".join(listed[i:j])[:-1] for i, j in zip(edge, edge[1:])]


FIELDS = (
    "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>"
)


def align(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", s: AlignSettings = AlignSettings()) -> DataFrame:
    """Per row its id, the numbers of tokens, groups and links, the digest of the groups, and the distinct linked id pairs
    (first id * ids of the second vocabulary + second id) with how often each is linked."""

    def work():
        first, second = byte_vocabulary(s.bytes_bpe), piece_vocabulary(s.pieces)
        n_b = len(second.bytes_of)
        length_a, length_b = (np.array([len(x) for x in v.bytes_of], dtype=np.int64) for v in (first, second))
        writer = GroupWriter(len(first.bytes_of), n_b)

        def each(texts: list[str]) -> list:
            spaced = [" " + t for t in texts]
            ids_a = first.encode(spaced)
            ids_b = second.encode(texts)
            for i, t in enumerate(spaced):
                raw = t.encode()
                if len(raw) == 1 or any(
                    b"".join(map(v.bytes_of.__getitem__, x)) != raw for v, x in ((first, ids_a[i]), (second, ids_b[i]))
                ):
                    ids_a[i], ids_b[i] = [], []
            a, b = Sequences(ids_a, length_a), Sequences(ids_b, length_b)
            g = groups_of(a, b)
            digests = [hashlib.sha256(t).hexdigest() if t else "" for t in writer.texts(a, b, g)]
            x, y, owner = links_of(a, b)
            pair = a.ids[x] * n_b + b.ids[y]
            order = np.argsort(pair, kind="stable")
            order = order[np.argsort(owner[order], kind="stable")]
            pair, owner = pair[order], owner[order]
            new = np.ones(len(pair), dtype=bool)
            new[1:] = (pair[1:] != pair[:-1]) | (owner[1:] != owner[:-1])
            at = np.flatnonzero(new)
            times = np.diff(np.append(at, len(pair)))
            offsets = pa.array(np.searchsorted(owner[at], np.arange(len(texts) + 1)).astype(np.int32))
            return [
                np.diff(a.first), np.diff(b.first), np.diff(g.first),
                np.bincount(owner, minlength=len(texts)).astype(np.int64), digests,
                pa.ListArray.from_arrays(offsets, pa.array(pair[at])),
                pa.ListArray.from_arrays(offsets, pa.array(times.astype(np.int32))),
            ]

        return each

    return map_texts(df, id_col, text_col, FIELDS, work, s.step_bytes)


def pair_counts(aligned: DataFrame, n_b: int) -> DataFrame:
    """``pair, n, best``: the number of rows that hold an id pair linked, and whether that is the highest of its first id."""
    counts = aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n"))
    counts = written(counts.withColumn("id", F.floor(F.col("pair") / n_b)), "pairs")
    highest = counts.groupBy("id").agg(F.max("n").alias("most"))
    return counts.join(highest, "id").select("id", "pair", "n", (F.col("n") == F.col("most")).cast("long").alias("best"))


def link_counts(aligned: DataFrame, counts: DataFrame, slice_rows: int) -> DataFrame:
    """``row, n_best, count_sum``: the links of a row with the best count of their first id, and the sum over all links."""
    slices = max(1, -(-counts.count() // slice_rows))
    held = aligned.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("row", "p.pairs", "p.times")
    sums = None
    for k in range(slices):
        chosen = F.broadcast(counts.where(F.pmod(F.xxhash64("id"), F.lit(slices)) == k).drop("id"))
        met = held.join(chosen, F.col("pairs") == F.col("pair")).groupBy("row").agg(
            F.sum(F.col("times") * F.col("best")).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum")
        )
        sums = met if sums is None else sums.unionAll(met)
    return sums.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def align_documents(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: AlignSettings = AlignSettings()
) -> DataFrame:
    """Per row its id, numbers of tokens, groups and links, links with the best count, the sum of counts, and the digest."""
    n_b = len(piece_vocabulary(settings.pieces).bytes_of)
    aligned = align(df, id_col, text_col, settings).withColumn("row", F.monotonically_increasing_id())
    aligned = written(aligned.withColumnRenamed(id_col, "_id"), "aligned")
    sums = link_counts(aligned, written(pair_counts(aligned, n_b), "counts"), settings.slice_rows)
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")]
    return aligned.drop("pairs", "times").join(sums, "row", "left").select(
        F.col("_id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", *zero, "groups_sha256"
    )
