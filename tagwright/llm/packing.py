"""Token sequences of bounded length by cost-balanced packing.

A document is its token ids and one closing id. It is cut into pieces of ``capacity`` ids, which are sequences of their
own, and one shorter rest. Rests are collected in blocks. In a block the sequences are set by the token total; rests go,
the dearest first, to the sequence with the lowest cost so far that has room, where the cost of a piece is
``linear * n + quadratic * n^2``. A rest that fits nowhere is cut at the largest room. What is left of a block joins
the next one, and what is left of a task is cut into sequences whose lengths are powers of two, which need no padding.
So no sequence is padded at all.

Packing goes on inside the tasks of the scan, without a shuffle; a task holds one block. A task that is run again reads
the same rows in the same order and gives the same sequences. Null and empty texts are the closing id alone; repeated
rows are packed one by one; an empty table gives no rows. Only the id and the text are read.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import chunks, release, texts_of


@dataclass(frozen=True)
class PackSettings:
    tokenizer: str = field(default_factory=lambda: public_tokenizers.path("word_bpe_49k.json"))
    closing_id: int = 1
    capacity: int = 2048
    block: int = 256  # sequences
    linear: float = 1.0
    quadratic: float = 1.0 / 2048
    cached_bytes: int = 48 << 20  # words whose ids a Python worker remembers, twice: those of now and those of before


class WordEncoder:
    """Ids of texts, by words between ASCII blanks: the vocabulary's splits never cross one, so words stand alone.

    Words are remembered in two tables. When the one in use is full it becomes the one of before, from which words are
    taken over when they are met again; so frequent words stay and rare ones are forgotten.
    """

    ENTRY = 150  # bytes of an entry besides the word and its ids

    def __init__(self, path: str, cached_bytes: int):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.cached_bytes = cached_bytes
        self.words: dict[bytes, bytes] = {}
        self.before: dict[bytes, bytes] = {}
        self.held = 0

    def keep(self, found: dict[bytes, bytes]) -> None:
        self.words.update(found)
        self.held += sum(map(len, found)) + sum(map(len, found.values())) + self.ENTRY * len(found)

    def learn(self, new: set[bytes]) -> None:
        """Encode new words, a thousand in one text with blanks between; a token belongs to the word it starts in."""
        listed = sorted(new)
        for i in range(0, len(listed), 1000):
            run = [w.decode() for w in listed[i : i + 1000]]
            begins = np.cumsum([0, *(len(w) + 1 for w in run)])
            found = self.tokenizer.encode(" ".join(run), add_special_tokens=False)
            ids = np.asarray(found.ids, dtype="<u4")
            starts = np.fromiter((o[0] for o in found.offsets), dtype=np.int64, count=len(ids))
            cut = np.searchsorted(starts, begins).tolist()
            data = ids.tobytes()
            self.keep({w: data[4 * cut[j] : 4 * cut[j + 1]] for j, w in enumerate(listed[i : i + 1000])})

    def __call__(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        if self.held > self.cached_bytes:
            self.before, self.words, self.held = self.words, {}, 0
        split = [_words(t) for t in texts]
        new = {w for w in set().union(*split) if w not in self.words}
        again = {w: self.before[w] for w in new if w in self.before}
        self.keep(again)
        self.learn(new - again.keys())
        known = self.words
        return [b"".join(map(known.__getitem__, words)) for words in split]


_STOP = re.compile(rb"(?<=[a-z])(?=[.,](?:[ \t-\r]|$))")


def _words(text: str) -> list[bytes]:
    """Runs of a text that are encoded alone: it is split at ASCII blanks, and before a full stop or comma that follows
    a letter and ends a word, where the vocabulary splits too. ASCII letters are lower-cased as it does, unless the
    text may hold a special token, which is looked up as written."""
    data = text.encode()
    return _STOP.sub(b" ", data if b"<|" in data else data.lower()).split()


@lru_cache(maxsize=4)
def _encoder(path: str, cached_bytes: int) -> WordEncoder:
    return WordEncoder(path, cached_bytes)


@dataclass
class Piece:
    doc: object
    ids: bytes  # of the whole document
    start: int
    length: int


def place(pieces: list[Piece], sequences: int, s: PackSettings) -> tuple[list[list[Piece]], list[Piece]]:
    """Pieces to ``sequences`` sequences, and what is left when all are full."""
    room = np.full(sequences, s.capacity, dtype=np.int64)
    cost = np.zeros(sequences)
    held: list[list[Piece]] = [[] for _ in range(sequences)]
    queue = [(-p.length, i, p) for i, p in enumerate(pieces)]
    heapq.heapify(queue)
    count, left = len(queue), []
    while queue:
        _, _, p = heapq.heappop(queue)
        fits = room >= p.length
        at = int(np.argmin(np.where(fits, cost, np.inf))) if sequences else 0
        if not sequences or not fits[at]:
            at = int(np.argmax(room)) if sequences else 0
            if not sequences or room[at] == 0:
                left.append(p)
                continue
            n = int(room[at])
            heapq.heappush(queue, (n - p.length, count, Piece(p.doc, p.ids, p.start + n, p.length - n)))
            count += 1
            p = Piece(p.doc, p.ids, p.start, n)
        held[at].append(p)
        room[at] -= p.length
        cost[at] += s.linear * p.length + s.quadratic * p.length**2
    return held, left


def powers(pieces: list[Piece]) -> list[list[Piece]]:
    """The pieces in order, cut into sequences whose lengths are the powers of two that make up the total."""
    total, out, i, used = sum(p.length for p in pieces), [], 0, 0
    for size in (1 << b for b in range(total.bit_length() - 1, -1, -1) if total >> b & 1):
        sequence = []
        while size:
            n = min(size, pieces[i].length - used)
            sequence.append(Piece(pieces[i].doc, pieces[i].ids, pieces[i].start + used, n))
            size, used = size - n, used + n
            if used == pieces[i].length:
                i, used = i + 1, 0
        out.append(sequence)
    return out


def pack(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: PackSettings | None = None,
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece: where it starts in its document, its length, and its sequence and offset there."""
    s = settings or PackSettings()
    given = df.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").cast("string").alias("_text"))
    id_field = given.schema["_id"].dataType.simpleString()
    names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(s.tokenizer, s.cached_bytes)
        closing = np.asarray([s.closing_id], dtype="<u4").tobytes()
        number = TaskContext.get().partitionId() << 33
        id_type = None

        def rows(sequences: list[list[Piece]]) -> pa.RecordBatch:
            nonlocal number
            out: list[tuple] = []
            for sequence in sequences:
                offset = 0
                for p in sequence:
                    ids = p.ids[4 * p.start : 4 * (p.start + p.length)]
                    row = (p.doc, p.start, p.length, zlib.crc32(ids), len(p.ids) // 4, number, offset)
                    out.append((*row, np.frombuffer(ids, dtype="<u4")) if with_ids else row)
                    offset += p.length
                number += 1
            types = [id_type] + [pa.int64()] * 6 + [pa.list_(pa.int64())] * with_ids
            return pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in out], type=t) for i, t in enumerate(types)], names=names
            )

        rests: list[Piece] = []
        held = 0
        for batch in batches:
            id_type = batch.schema.field("_id").type
            for part in chunks(batch, "_text"):
                full = []
                for doc, ids in zip(part.column("_id").to_pylist(), encode(texts_of(part, "_text"))):
                    ids += closing
                    n = len(ids) // 4
                    whole = n // s.capacity * s.capacity
                    full += [[Piece(doc, ids, i, s.capacity)] for i in range(0, whole, s.capacity)]
                    if n > whole:
                        rests.append(Piece(doc, ids, whole, n - whole))
                        held += n - whole
                    if held >= s.block * s.capacity:
                        sequences, rests = place(rests, held // s.capacity, s)
                        held = sum(p.length for p in rests)
                        full += sequences
                if full:
                    yield rows(full)
        if rests:
            sequences, rests = place(rests, held // s.capacity, s)
            yield rows(sequences + powers(rests))
        release()

    return given.mapInArrow(
        run,
        f"`{id_col}` {id_field}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, "
        "offset long" + ", ids array<long>" * with_ids,
    )
