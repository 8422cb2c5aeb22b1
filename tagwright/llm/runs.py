"""Periodic runs of words, found with a suffix automaton whose link tree gives access to last occurrences.

The automaton grows word by word. Its suffix links form a tree; the path from the newest state to the root stands for all
suffixes of what was read, and every state on it now ends last at the newest word. The path before that consists of
segments with one last end each. A segment with last end e whose suffixes have lengths in (low, high] says: for every
such length, the suffix of that length ended at e before and nowhere in between. So with d = newest - e, low < d <= high
holds exactly if the last 2d words are a square of a d-word root that is no power itself. Squares of one d that end at
consecutive words are one run: it begins with the first square and is extended while squares go on.

The path is walked and recoloured by ``access`` in a link-cut tree (splay trees over the segments), so a word costs
O(log n) segments, amortized. A state that is cloned is inserted between its two neighbours by ``cut`` and ``link``.

A run that is looked for has at least ``least`` words and ``times`` periods, so each of its words occurs ``times`` times
in it at least. Words that occur less often in a stretch are in none of its runs; the text is cut there until nothing
changes, and only what is left goes through an automaton. That drops no run and leaves ordinary prose nearly untouched.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_texts

FIELDS = (
    "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
)


@dataclass(frozen=True)
class RunSettings:
    least: int = 6  # words of a run
    times: int = 4  # periods of a run


class LinkedAutomaton:
    """Suffix automaton over word numbers; its suffix links are kept in a link-cut tree that knows last ends."""

    def __init__(self):
        # state 0 is the root, the empty suffix; number -1 means none
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.size = [0]  # words of the longest string of the state
        # splay nodes, one per state: deeper states of a segment are on the right
        self.left, self.right, self.above = [-1], [-1], [-1]
        self.end = [-1]  # last end, valid at the root of a splay tree; pushed down lazily
        self.read = 0
        self.newest = 0

    def _state(self, size: int, moves: dict, end: int) -> int:
        self.next.append(moves)
        self.link.append(-1)
        self.size.append(size)
        self.left.append(-1)
        self.right.append(-1)
        self.above.append(-1)
        self.end.append(end)
        return len(self.size) - 1

    def _splay(self, x: int) -> None:
        left, right, above = self.left, self.right, self.above
        while True:
            p = above[x]
            if p < 0 or (left[p] != x and right[p] != x):
                return
            g = above[p]
            inner = g >= 0 and (left[g] == p or right[g] == p)
            # first turn the parent if the three are in line
            first = p if inner and ((left[g] == p) == (left[p] == x)) else x
            for node in ((first, x) if inner else (x,)):
                q = above[node]
                r = above[q]
                if left[q] == node:
                    c = right[node]
                    left[q] = c
                    right[node] = q
                else:
                    c = left[node]
                    right[q] = c
                    left[node] = q
                if c >= 0:
                    above[c] = q
                above[q] = node
                above[node] = r
                if r >= 0:
                    if left[r] == q:
                        left[r] = node
                    elif right[r] == q:
                        right[r] = node

    def _root_of(self, x: int) -> int:
        left, right, above = self.left, self.right, self.above
        p = above[x]
        while p >= 0 and (left[p] == x or right[p] == x):
            x, p = p, above[p]
        return x

    def _to_top(self, x: int) -> None:
        """Splay ``x``; the last end moves with the top of the tree."""
        end = self.end[self._root_of(x)]
        self._splay(x)
        self.end[x] = end

    def segments(self, x: int, end: int) -> list[tuple[int, int, int]]:
        """Recolour the path from ``x`` to the root with ``end``: (low, high, last end) of each segment before."""
        found = []
        left, right, above, size, link = self.left, self.right, self.above, self.size, self.link
        below, at = -1, x
        while at >= 0:
            self._to_top(at)
            old = self.end[at]
            rest = right[at]
            if rest >= 0:  # what is deeper keeps its last end as a segment of its own
                self.end[rest] = old
            right[at] = below
            top = at
            while left[top] >= 0:
                top = left[top]
            found.append((size[link[top]] if link[top] >= 0 else 0, size[at], old))
            if top != at:
                self._splay(top)  # pays for the walk to the top; it has no deeper segment's end to keep
                self._splay(at)
            below = at
            at = above[at]
        self._splay(x)
        self.end[x] = end
        return found

    def _cut(self, x: int) -> int:
        """Separate ``x`` from the state above it; returns the last end of ``x``."""
        self._to_top(x)
        end = self.end[x]
        upper = self.left[x]
        if upper >= 0:
            self.above[upper] = self.above[x]
            self.end[upper] = end
            self.left[x] = -1
        self.above[x] = -1
        return end

    def append(self, word: int) -> list[tuple[int, int, int]]:
        """Read a word; the segments of its path before it was recoloured, the state of the whole text left out."""
        moves, link, size = self.next, self.link, self.size
        new = self._state(self.read + 1, {}, self.read)
        p = self.newest
        while p >= 0 and word not in moves[p]:
            moves[p][word] = new
            p = link[p]
        if p < 0:
            link[new] = 0
        else:
            q = moves[p][word]
            if size[q] == size[p] + 1:
                link[new] = q
            else:
                end = self._cut(q)
                clone = self._state(size[p] + 1, dict(moves[q]), end)
                link[clone], link[q], link[new] = link[q], clone, clone
                # the clone ends where q does, and stands between q and what was above it
                self.above[clone] = link[clone]
                self.above[q] = clone
                while p >= 0 and moves[p].get(word) == q:
                    moves[p][word] = clone
                    p = link[p]
        self.above[new] = link[new]
        at = link[new]
        found = self.segments(at, self.read)
        self.newest = new
        self.read += 1
        return found


def runs_of(words: list, least: int = 6, times: int = 4) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of a list of words, by start and period; no word is left out."""
    automaton, number, going, out = LinkedAutomaton(), {}, {}, []

    def close(d: int, start: int, end: int) -> None:
        if end - start >= max(least, times * d):
            out.append((start, end - start, d))

    for i, word in enumerate(words):
        squares = set()
        for low, high, end in automaton.append(number.setdefault(word, len(number))):
            d = i - end
            if end >= 0 and low < d <= high:
                squares.add(d)
        for d in [d for d in going if d not in squares]:
            close(d, going.pop(d), i)
        for d in squares:
            going.setdefault(d, i - 2 * d + 1)
    for d, start in going.items():
        close(d, start, len(words))
    return sorted(out, key=lambda r: (r[0], r[2]))


def stretches(words: list, least: int, times: int) -> Iterator[tuple[int, int]]:
    """(start, end) of the parts that may hold a run: in each, every word occurs ``times`` times."""
    todo = [(0, len(words))]
    while todo:
        start, end = todo.pop()
        if end - start < max(least, times):
            continue
        part = words[start:end]
        counts = Counter(part)
        if min(counts.values()) >= times:
            yield start, end
            continue
        begin = start
        for i, n in enumerate(map(counts.__getitem__, part), start):
            if n < times:
                if i - begin >= least:
                    todo.append((begin, i))
                begin = i + 1
        if end - begin >= least:
            todo.append((begin, end))


def all_runs(words: list, s: RunSettings = RunSettings()) -> list[tuple[int, int, int]]:
    """The runs of a text: as :func:`runs_of`, on the stretches that may hold any."""
    out = []
    for start, end in stretches(words, s.least, s.times):
        out += [(start + a, n, d) for a, n, d in runs_of(words[start:end], s.least, s.times)]
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words without those that a run holds after its first period."""
    if not runs:
        return words
    change = [0] * (len(words) + 1)
    for start, length, d in runs:
        change[start + d] += 1
        change[start + length] -= 1
    kept, depth = [], 0
    for word, step in zip(words, change):
        depth += step
        if not depth:
            kept.append(word)
    return kept


def find_runs(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: RunSettings = RunSettings()
) -> DataFrame:
    """Per row its id, the number of runs of its text, its longest run, and digests of all runs and of the collapsed text.

    Rows stand alone: no shuffle, and a lost task is read again. Null and empty texts have no run; repeated rows all come
    back with the same values; ties for the longest run go to the smallest start, then the smallest period. An empty table
    gives no rows. Only id and text are read, so further columns cannot clash. A very long text takes memory in
    proportion to its longest stretch.
    """

    def work():
        def each(texts: list[str]) -> list:
            columns: list[list] = [[] for _ in range(7)]
            for text in texts:
                words = text.encode().split()  # at ASCII blanks
                runs = all_runs(words, settings)
                best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
                listed = "".join(f"{a},{n},{d}\n" for a, n, d in runs)
                values = (
                    len(runs), *((best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4),
                    hashlib.sha256(listed.encode()).hexdigest(),
                    hashlib.sha256(b" ".join(collapsed(words, runs))).hexdigest(),
                )
                for column, value in zip(columns, values):
                    column.append(value)
            kinds = [pa.int64()] * 5 + [pa.string()] * 2
            return [pa.array(column, type=kind) for column, kind in zip(columns, kinds)]

        return each

    return map_texts(df, id_col, text_col, FIELDS, work)


def with_periods(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, text``: with h the crc32 of the id, texts with h % 10 = 0 are made periodic from word floor(h / 10) % n on.

    A null id changes nothing.
    """
    h = F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary"))
    given = df.select(F.col(f"`{id_col}`").alias(id_col), F.col(f"`{text_col}`").alias("_text"), h.alias("_h"))
    words: Column = F.filter(F.split("_text", r"[ \x09-\x0D]+"), lambda w: w != "")
    with_words = given.withColumn("_w", F.when(F.col("_h") % 10 == 0, words)).withColumn("_n", F.size("_w"))
    g = F.floor(F.col("_h") / 10)
    placed = with_words.withColumn("_a", F.when(F.col("_n") > 0, g % F.col("_n"))).withColumn(
        "_p", 1 + F.floor((F.col("_n") - F.col("_a")) / (3 + g % 8))
    )
    ahead = F.slice("_w", F.lit(1), F.col("_a").cast("int"))
    root = F.slice("_w", F.col("_a").cast("int") + 1, F.col("_p").cast("int"))
    rest = F.col("_n") - F.col("_a")
    times = F.ceil(rest / F.col("_p")).cast("int")
    around = F.slice(F.flatten(F.array_repeat(root, times)), F.lit(1), rest.cast("int"))
    made = F.array_join(F.concat(ahead, around), " ")
    return placed.select(F.col(id_col), F.when(F.col("_n") > 0, made).otherwise(F.col("_text")).alias("text"))
