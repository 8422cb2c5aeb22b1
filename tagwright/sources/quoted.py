"""Delimited files with quoted fields, read by many tasks although a quoted field may hold line breaks.

A line begins a record unless it lies inside quotes, and that depends on everything before it in the file. But a line can
only be in one of two states, and what it does to the state is a function of its own text: keep it, set it or turn it.
These functions compose. So every range of the file is read once to find the function of all its lines; a prefix scan over
the ranges, one row each, gives the state every range starts in; and the second reading cuts each range into records by
itself. Only the record that crosses a border is put together from the pieces of its ranges.

Quotes count where a field begins with one; a doubled quote is a quote; text after a closing quote, up to the separator,
belongs to the field. ``\\r\\n`` reads as ``\\n``. A record is parsed by Spark's own CSV parser. A file whose last quote is
never closed is one record from there on.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import written

KEEP, OUT, IN, TURN = 0, 1, 2, 3  # what a line does to "inside quotes": nothing, ends outside, ends inside, turns it


def patterns(delimiter: str) -> tuple[str, str]:
    """Lines that end inside quotes if they begin outside, and if they begin inside."""
    d = re.escape(delimiter)
    inside = '(?:[^"]|"")*'
    rest = f'(?:[^"{d}][^{d}]*)?'  # text behind a closing quote
    field = f'(?:"{inside}"{rest}|[^"{d}][^{d}]*|)'
    opened = f'(?:{field}{d})*"{inside}'
    return f"(?s)^{opened}$", f'(?s)^{inside}(?:"{rest}{d}{opened})?$'


def effects(lines: pa.Array, delimiter: str) -> np.ndarray:
    """What each line does to the state."""
    from_outside, from_inside = patterns(delimiter)
    out = np.full(len(lines), KEEP, dtype=np.int8)
    asked = np.flatnonzero(pc.match_substring(lines, '"').to_numpy(zero_copy_only=False))
    if len(asked):
        some = lines.take(pa.array(asked))
        a = pc.match_substring_regex(some, from_outside).to_numpy(zero_copy_only=False)
        b = pc.match_substring_regex(some, from_inside).to_numpy(zero_copy_only=False)
        out[asked] = np.select([a & b, a & ~b, ~a & b], [IN, TURN, KEEP], OUT)
    return out


def states(effect: np.ndarray, start: bool) -> np.ndarray:
    """Whether each line begins inside quotes, and the state after the last one."""
    n = len(effect)
    fixed = np.maximum.accumulate(np.where((effect == OUT) | (effect == IN), np.arange(n), -1)) if n else np.zeros(0, int)
    turns = np.cumsum(effect == TURN)
    base = np.where(fixed >= 0, effect[fixed] == IN, start)
    after = base ^ ((turns - np.where(fixed >= 0, turns[fixed], 0)) % 2 == 1)
    return np.concatenate([[start], after]).astype(bool)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """``value, file, block``: the lines of the files, in order inside each range of bytes."""
    return spark.read.option("lineSep", "\n").text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")
    )


def _ranges_in(batch: pa.RecordBatch) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """The parts of a batch that lie in one range; a task reads its ranges one after the other."""
    file, block = (pc.dictionary_encode(batch.column(c)).indices.to_numpy() for c in ("file", "block"))
    cuts = np.flatnonzero((np.diff(file) != 0) | (np.diff(block) != 0)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
        if b > a:
            yield (batch.column("file")[a].as_py(), batch.column("block")[a].as_py()), batch.slice(a, b - a)


def range_effects(lines: DataFrame, delimiter: str) -> DataFrame:
    """``file, block, effect``: what all lines of a range together do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple, list[bool]] = {}
        for batch in batches:
            for key, part in _ranges_in(batch):
                effect = effects(part.column("value"), delimiter)
                found[key] = [bool(states(effect, s)[-1]) for s in found.get(key, [False, True])]
        ends = {(False, True): KEEP, (False, False): OUT, (True, True): IN, (True, False): TURN}
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([k[0] for k in found], pa.string()), pa.array([k[1] for k in found], pa.int64()),
                pa.array([ends[tuple(v)] for v in found.values()], pa.int32()),
            ],
            names=["file", "block", "effect"],
        )

    return lines.mapInArrow(run, "file string, block long, effect int")


def starting_states(ranges: DataFrame) -> DataFrame:
    """``file, block, inside``: whether a range begins inside quotes. A prefix scan over one row per range."""
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    fixed = F.col("effect").isin(OUT, IN)
    run = F.coalesce(F.sum(fixed.cast("int")).over(before), F.lit(0))
    base = F.coalesce(F.last(F.when(fixed, F.col("effect") == IN), ignorenulls=True).over(before), F.lit(False))
    turns = F.coalesce(F.sum((F.col("effect") == TURN).cast("int")).over(before), F.lit(0))
    counted = ranges.select("file", "block", "effect", run.alias("run"), base.alias("base"), turns.alias("turns"))
    # turns since the range that fixed the state
    first = F.min("turns").over(Window.partitionBy("file", "run"))
    return counted.select("file", "block", (F.col("base") != ((F.col("turns") - first) % 2 == 1)).alias("inside"))


def records(spark: SparkSession, path: str, delimiter: str) -> DataFrame:
    """``heading, record``: the records of the files; the first one of each file is its heading."""
    lines = _lines(spark, path)
    starts = written(starting_states(range_effects(lines, delimiter)), "ranges")
    placed = lines.join(F.broadcast(starts), ["file", "block"])  # one row per range of bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, inside, head, held, opening = None, False, False, [], False

        def rows(kind: str, texts: pa.Array) -> Iterator[pa.RecordBatch]:
            """Records that are not empty; the first of a file is its heading."""
            nonlocal opening
            texts = texts.filter(pc.not_equal(texts, "")) if kind == "whole" else texts
            n = len(texts)
            if n:
                columns = [pa.array([v] * n, t) for v, t in zip((*key, kind), (pa.string(), pa.int64(), pa.string()))]
                heading = pa.array([opening] + [False] * (n - 1))
                opening = False
                yield pa.RecordBatch.from_arrays([*columns, heading, texts], names=["file", "block", "kind", "heading", "record"])

        def joined() -> pa.Array:
            return pa.array(["\n".join(held)], pa.string())

        def rest() -> Iterator[pa.RecordBatch]:
            """What is held when a range ends: a record without its end, or lines inside the record of another range."""
            if held:
                yield from rows(("middle" if inside else "tail") if head else ("head" if inside else "whole"), joined())

        for batch in batches:
            for at, part in _ranges_in(batch):
                if at != key:
                    yield from rest()
                    key, inside, held, opening = at, part.column("inside")[0].as_py(), [], at[1] == 0
                    head = inside
                value = part.column("value")
                state = states(effects(value, delimiter), inside)
                begins = np.flatnonzero(~state[:-1])
                held += value[: int(begins[0]) if len(begins) else len(value)].to_pylist()
                if len(begins):
                    if held:
                        yield from rows("tail" if head else "whole", joined())
                    head = False
                    # all records of this part but the last, which may go on
                    lists = pa.ListArray.from_arrays(pa.array(begins.astype(np.int32)), value[: int(begins[-1])])
                    yield from rows("whole", pc.binary_join(lists, "\n"))
                    held = value[int(begins[-1]) :].to_pylist()
                inside = bool(state[-1])
        yield from rest()

    fields = "file string, block long, kind string, heading boolean, record string"
    cut = written(placed.mapInArrow(run, fields), "records")
    # a record that crosses borders: its head, the ranges inside it, its tail
    order = Window.partitionBy("file").orderBy("block", F.col("kind") == "head").rowsBetween(Window.unboundedPreceding, 0)
    pieces = cut.where("kind <> 'whole'").withColumn("n", F.sum((F.col("kind") == "head").cast("int")).over(order))
    listed = F.array_sort(F.collect_list(F.struct("block", "record")))
    crossing = pieces.groupBy("file", "n").agg(F.bool_or("heading").alias("heading"), listed.alias("_l"))
    crossing = crossing.select("heading", F.array_join("_l.record", "\n").alias("record"))
    found = cut.where("kind = 'whole'").select("heading", "record").unionAll(crossing)
    return found.select("heading", F.regexp_replace("record", r"\r(?=\n|\z)", "").alias("record"))


def scan_quoted(spark: SparkSession, path: str, delimiter: str) -> DataFrame:
    """Rows of quoted delimited files with a heading each; columns as strings, named by the first file's heading."""
    options = {"sep": delimiter, "quote": '"', "escape": '"'}
    names = spark.read.options(header=True, multiLine=True, **options).csv(path).columns  # reads the first record
    fields = ", ".join(f"c{i} string" for i in range(len(names)))
    rows = records(spark, path, delimiter).where(~F.col("heading"))
    return rows.select(F.from_csv("record", fields, options).alias("r")).select("r.*").toDF(*names)
