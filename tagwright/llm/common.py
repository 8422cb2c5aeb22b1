"""What the operators share: Arrow batches in and out, hashes of words and n-grams, samples of labelled rows."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK_BYTES = 4 << 20  # text bytes that are worked on at once inside a task
KEEP_BYTES = 1 << 19  # the same where rows are only kept or dropped: arrays over the characters take fifty times as much


def chunks(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in runs of about ``limit`` bytes of text, one row at least."""
    if batch.num_rows == 0:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    run = np.cumsum(sizes, dtype=np.int64) // limit
    ends = np.append(np.flatnonzero(np.diff(run)) + 1, batch.num_rows)
    start = 0
    for end in ends.tolist():
        yield batch.slice(start, end - start)
        start = end


def release() -> None:
    """Give freed memory back at the end of a task. Spark keeps its Python workers for the stages that follow."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not in every C library
    if trim:
        trim(0)


def texts_of(batch: pa.RecordBatch, column: str) -> list[str]:
    """The texts of a batch; null is the empty text."""
    return [t if t is not None else "" for t in batch.column(column).to_pylist()]


def map_texts(
    df: DataFrame, id_col: str, text_col: str, fields: str, work: Callable[[], Callable[[list[str]], list]],
    limit: int = CHUNK_BYTES,
) -> DataFrame:
    """One row per input row: the id and what ``work()`` gives for its text.

    ``work`` is called once per task and returns a function from a list of texts to a list of columns, in the order
    of ``fields`` (a DDL list). A list has about ``limit`` bytes, one text at least. Only the id and the text are read, so further columns cannot clash.
    """
    given = df.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").cast("string").alias("_text"))
    id_type = given.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = work()
        for batch in batches:
            for part in chunks(batch, "_text", limit):
                columns = each(texts_of(part, "_text"))
                yield pa.RecordBatch.from_arrays(
                    [part.column("_id"), *[c if isinstance(c, pa.Array) else pa.array(c) for c in columns]], names=names
                )
        release()

    schema = f"`{id_col}` {id_type}, {fields}"
    names = [id_col, *[f.strip().split()[0] for f in fields.split(",")]]
    return given.mapInArrow(run, schema)


def keep_rows(df: DataFrame, text_col: str, work: Callable[[], Callable[[list[str]], np.ndarray]]) -> DataFrame:
    """The rows, unchanged and with all columns, for whose text ``work()`` gives true. No shuffle and no join.

    ``work`` is called as by :func:`map_texts`, with lists of about ``KEEP_BYTES``.
    """
    place = df.columns.index(text_col)
    given = df.toDF(*[f"c{i}" for i in range(len(df.columns))])  # names may clash
    name = f"c{place}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = work()
        for batch in batches:
            for part in chunks(batch, name, KEEP_BYTES):
                yield part.filter(pa.array(np.asarray(each(texts_of(part, name)), dtype=bool)))
        release()

    return given.mapInArrow(run, given.schema).toDF(*df.columns)


def crc_mod(column: str, n: int):
    """crc32 of the id as text, modulo n."""
    return F.crc32(F.col(f"`{column}`").cast("string").cast("binary")) % n


def spread_sample(df: DataFrame, key: str, rows: int) -> DataFrame:
    """At most ``rows`` rows, those with the smallest hashes of the key: the same rows however the table is cut."""
    return df.orderBy(F.xxhash64(F.lit(29), F.col(f"`{key}`")), F.col(f"`{key}`")).limit(rows)


def texts_by_id(df: DataFrame, id_col: str, text_col: str, picked: list[tuple], label: str) -> list[tuple]:
    """(text, label) of the rows whose ids were picked, one row an id. The number of ids bounds broadcast and result."""
    if not picked:
        return []
    spark = df.sparkSession
    id_type = df.schema[id_col].dataType.simpleString()
    chosen = F.broadcast(spark.createDataFrame(picked, f"_picked {id_type}, _label {label}"))
    found = df.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").cast("string").alias("_text")).join(
        chosen, F.col("_id") == F.col("_picked")
    )
    rows = found.select("_id", "_text", "_label").dropDuplicates(["_id"]).orderBy("_id").collect()
    return [(r["_text"], r["_label"]) for r in rows]


# ---- hashes inside a task -------------------------------------------------------------------------------------------

_U = np.uint64
_ROLL = _U(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of a 64-bit value over all bits."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_LETTER = mix(np.arange(1, 257, dtype=np.uint64) * _ROLL)
BLANK = np.zeros(256, dtype=bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _ROLL, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of several texts at once.

    ``hashes`` has one 64-bit hash per word, ``first`` the number of the first word of each text (and of the end).
    """

    def __init__(self, texts: list[bytes]):
        # every text is followed by one blank, so that no word spans two texts
        data = np.frombuffer(b" ".join([*texts, b""]), dtype=np.uint8)
        self.data = data
        sizes = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
        self.text_start = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        blank = BLANK[data]
        edge = np.flatnonzero(np.diff(np.concatenate([[True], blank, [True]])))
        self.start, self.end = edge[::2], edge[1::2]
        self.first = np.searchsorted(self.start, self.text_start)
        if len(self.start):
            inside = ~blank
            lengths = self.end - self.start
            place = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            value = _LETTER[data[inside]] * _powers(int(lengths.max()))[place]
            self.hashes = mix(np.add.reduceat(value, np.cumsum(lengths) - lengths) + lengths.astype(np.uint64))
        else:
            self.hashes = np.zeros(0, dtype=np.uint64)

    def owner(self) -> np.ndarray:
        """The number of the text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def sums(values: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between consecutive entries of ``start``; empty runs give 0."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.float64)])
    return total[start[1:]] - total[start[:-1]]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def platt(raw: np.ndarray, label: np.ndarray, steps: int = 200) -> tuple[float, float]:
    """Slope and offset that turn raw scores into probabilities, by Newton steps with smoothed targets."""
    up, down = float((label == 1).sum()), float((label == 0).sum())
    target = np.where(label == 1, (up + 1) / (up + 2), 1 / (down + 2))
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = sigmoid(a * raw + b)
        g = p - target
        w = np.maximum(p * (1 - p), 1e-6)
        h = np.array([[(w * raw * raw).sum() + 1e-3, (w * raw).sum()], [(w * raw).sum(), w.sum() + 1e-3]])
        da, db = np.linalg.solve(h, [(g * raw).sum(), g.sum()])
        a, b = a - np.clip(da, -1, 1), b - np.clip(db, -1, 1)
        if abs(da) + abs(db) < 1e-6:
            break
    return max(a, 1e-3), b


def replace_texts(df: DataFrame, text_col: str, work: Callable[[], Callable[[str], str]]) -> DataFrame:
    """All rows and columns, with every text that is not null replaced by what ``work()`` gives for it."""
    place = df.columns.index(text_col)
    given = df.toDF(*[f"c{i}" for i in range(len(df.columns))])  # names may clash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = work()
        for batch in batches:
            for part in chunks(batch, f"c{place}"):
                texts = [None if t is None else each(t) for t in part.column(place).to_pylist()]
                yield part.set_column(place, part.schema.field(place), pa.array(texts, type=pa.string()))
        release()

    return given.mapInArrow(run, given.schema).toDF(*df.columns)
