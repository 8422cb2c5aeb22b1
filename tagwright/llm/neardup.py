"""Near duplicates by fast similarity sketching, banding and exact verification.

A document's set is its distinct shingles of ``words`` words, ASCII letters lower-cased; with fewer words the whole
sequence is one shingle, and without words the set is empty and linked with nothing. Two documents are linked if
``100 * |intersection| >= percent * |union|``; the groups are the connected components of these links.

Sketch: ``size`` coordinates. In round i every shingle is hashed to a coordinate and a value, and a coordinate keeps the
smallest value of the first round that reaches it. From round ``size`` on, round i throws all shingles at coordinate
i - size, so every coordinate is filled after twice as many rounds; large sets fill theirs in the first few. Two sets
agree in a coordinate with the probability of their similarity, and the number of agreements is concentrated as that of
independent draws. Coordinates are hashed in bands; documents that share a band are candidates.

Documents with equal sets are one class with the smallest id as its name; only one row of each class goes on, under a
number of its own, so that neither repeated rows nor several sets of one id count twice. In a band all members are
compared with one of them, the member with most companions over all its bands. Components of the links found so are
formed. Where bands still span several components, pairs across them are compared that share a rare shingle, or that
share a band and have few enough rare shingles to be linked without (``remaining``), unless size or sketch rule it out. Bands and sketch test together lose a link at
the threshold with a probability of about 1e-6. All links are confirmed on the full sets.

Defined cases: null text is empty; rows that share an id count as one document with several sets, all in one group;
a null id is a group of its own for each text. An empty table gives no rows. Only id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from .common import Words, chunks, map_texts, mix, texts_of

_U = np.uint64
_GOLD = _U(0x9E3779B97F4A7C15)
EVEN_BITS = 0x5555555555555555


@dataclass(frozen=True)
class NearSettings:
    words: int = 3
    percent: int = 85
    size: int = 120  # coordinates of a sketch; four longs hold two bits of each
    rows: int = 5  # coordinates of a band
    differing: int = 32  # two-bit coordinates in which a linked pair may differ
    rare: int = 16  # documents that share a shingle which counts as rare
    share: int = 512  # pairs of one set that are confirmed beside one copy of it

    @staticmethod
    def at_80() -> NearSettings:
        """Five words and 80 percent: shorter bands and a wider sketch test for the same safety."""
        return NearSettings(words=5, percent=80, rows=4, differing=40)


def shingles(texts: list[str], words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, sorted within each text, and where each text's begin (and the end)."""
    w = Words([t.encode().lower() for t in texts])
    count = np.diff(w.first)
    n = len(w.hashes)
    value = np.zeros(n, dtype=np.uint64)
    # whole shingles, at their first word
    for k in range(words):
        part = w.hashes[k:] if k else w.hashes
        value[: n - k if n >= k else 0] = mix(value[: n - k] * _GOLD + part[: n - k] + _U(k + 1)) if n > k else value[:0]
    owner = w.owner()
    left = w.first[1:][owner] - np.arange(n) if n else np.zeros(0, dtype=np.int64)  # words from here to the text's end
    keep = left >= words
    short = np.flatnonzero((count > 0) & (count < words))
    for t in short.tolist():  # few words: the whole sequence
        h = np.zeros(1, dtype=np.uint64)
        for k, x in enumerate(w.hashes[w.first[t] : w.first[t + 1]]):
            h = mix(h * _GOLD + x + _U(k + 101))
        value[w.first[t]] = h[0]
        keep[w.first[t]] = True
    value, owner = value[keep], owner[keep]
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    first = np.ones(len(value), dtype=bool)
    first[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    value, owner = value[first], owner[first]
    return value, np.searchsorted(owner, np.arange(len(texts) + 1))


def sketch(value: np.ndarray, start: np.ndarray, size: int) -> np.ndarray:
    """One row of ``size`` coordinates per set (rows of empty sets mean nothing)."""
    sets = len(start) - 1
    out = np.zeros(sets * size, dtype=np.uint64)
    filled = np.zeros(sets * size, dtype=bool)
    counts = np.diff(start)
    live = np.flatnonzero(counts > 0)
    elements, owner = value, np.repeat(np.arange(sets), counts)
    for i in range(2 * size):
        if not len(live):
            break
        h = mix(elements ^ mix(np.full(1, i + 1, dtype=np.uint64) * _GOLD))
        at = (h >> _U(40)) % _U(size) if i < size else np.full(len(h), i - size, dtype=np.uint64)
        place = owner * size + at.astype(np.int64)
        open_ = ~filled[place]
        place, h = place[open_], h[open_]
        order = np.lexsort((h & _U(0xFFFFFFFFFF), place))
        place, h = place[order], h[order]
        first = np.ones(len(place), dtype=bool)
        first[1:] = place[1:] != place[:-1]
        out[place[first]] = mix((h[first] & _U(0xFFFFFFFFFF)) + mix(np.full(1, i, dtype=np.uint64)))
        filled[place[first]] = True
        done = filled.reshape(sets, size)[live].all(1)
        if done.any():
            live = live[~done]
            still = np.zeros(sets, dtype=bool)
            still[live] = True
            keep = still[owner]
            elements, owner = elements[keep], owner[keep]
    return out.reshape(sets, size)


def sketches(df: DataFrame, s: NearSettings, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: size of its set, two hashes that name the set, the hashes of its bands, two bits of each coordinate."""
    bands = s.size // s.rows

    def work():
        salt = mix(np.arange(1, bands + 1, dtype=np.uint64) * _GOLD)

        def each(texts: list[str]) -> list:
            value, start = shingles(texts, s.words)
            n = np.diff(start)
            sums = set_hashes(value, start)
            c = sketch(value, start, s.size)
            band = np.tile(salt, (len(texts), 1))
            for k in range(s.rows):
                band = mix(band * _GOLD + c[:, k::s.rows][:, :bands])
            flat = pa.array(band.view(np.int64)[n > 0].ravel())
            offsets = pa.array(np.concatenate([[0], np.cumsum((n > 0) * bands)]).astype(np.int32))
            two = (c >> _U(17)) & _U(3)
            quarter = s.size // 4
            bits = [
                (two[:, q * quarter : (q + 1) * quarter] << (_U(2) * np.arange(quarter, dtype=np.uint64))).sum(1, dtype=np.uint64).view(np.int64)
                for q in range(4)
            ]
            return [n.astype(np.int64), *sums, pa.ListArray.from_arrays(offsets, flat), *bits]

        return each

    fields = "n long, h1 long, h2 long, bands array<long>, s0 long, s1 long, s2 long, s3 long"
    return map_texts(df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")), "id", "text", fields, work)


def set_hashes(value: np.ndarray, start: np.ndarray) -> list[np.ndarray]:
    """Two hashes of each set."""
    sums = []
    for k in (1, 2):
        total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(mix(value * _GOLD + _U(k)))])
        sums.append((total[start[1:]] - total[start[:-1]]).view(np.int64))
    return sums


def sets_of(df: DataFrame, words: int) -> DataFrame:
    """``id``, ``text`` -> ``id``, the size and two hashes that name its set, and its sorted shingle hashes."""

    def work():
        def each(texts: list[str]) -> list:
            value, start = shingles(texts, words)
            held = pa.ListArray.from_arrays(pa.array(start.astype(np.int32)), pa.array(value.view(np.int64)))
            return [np.diff(start).astype(np.int64), *set_hashes(value, start), held]

        return each

    return map_texts(df, "id", "text", "n long, h1 long, h2 long, held array<long>", work)


def sieved(df: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose ``id`` may be one of ``ids``, without a shuffle of the rows.

    The ids' hashes set bits of 2^20 words of 64 bits, which bounds what is broadcast. Rows of other ids pass with the
    share of bits that are set, so a join has to follow; it finds the rows of all ``ids`` here, however many these are.
    """
    word, bit = F.shiftrightunsigned(F.xxhash64("id"), 44), F.shiftrightunsigned(F.xxhash64("id"), 38).bitwiseAND(F.lit(63))
    mask = F.expr("shiftleft(1L, cast(_bit as int))")
    words = ids.select(word.alias("_w"), bit.alias("_bit")).groupBy("_w").agg(F.bit_or(mask).alias("_mask"))
    met = df.withColumn("_word", word).withColumn("_bit", bit).join(F.broadcast(words), F.col("_word") == F.col("_w"))
    return met.where(F.col("_mask").bitwiseAND(mask) != 0).select(*df.columns)


def one_row_sets(given: DataFrame, needed: DataFrame, repeated: DataFrame, words: int) -> DataFrame:
    """``id`` (the number of a set) and ``held``, one row for each of ``needed``.

    An id with one row has the set of that row. Of the ``repeated`` ids all rows are read, and the set says which is which.
    """
    given = sieved(given, needed.select(F.col("name").alias("id")))
    once = needed.join(repeated, needed["name"] == repeated["id"], "left_anti").select(F.col("id").alias("_set"), F.col("name").alias("id"))
    once = given.join(once, "id").select(F.col("_set").alias("id"), "text")
    again = needed.join(repeated.withColumnRenamed("id", "name"), "name", "left_semi")
    # no semi join here: it would be moved below the sieve and take all texts through a shuffle
    many = sets_of(given.join(again.select(F.col("name").alias("id")).distinct(), "id").select("id", "text"), words)
    many = many.withColumnRenamed("id", "name").join(again, ["name", "n", "h1", "h2"])
    return sets_of(once, words).select("id", "held").unionAll(many.select("id", "held").dropDuplicates(["id"]))


def linked(pairs: DataFrame, sets: DataFrame, percent: int, share: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough.

    The sets of the b of one a come to one task in parts of about ``share``, after one copy of the set of a, and are
    read one by one; so a set with very many partners is neither copied to each of them nor gathered with them.
    """
    counts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / share).alias("parts"))
    placed = pairs.join(counts, "a").select("a", "b", F.pmod(F.xxhash64("b"), "parts").alias("part"))
    placed = written(placed, "placed")  # read for the heads, the partners and the sieve
    heads = placed.select(F.col("a").alias("id"), "a", "part", F.lit(None).cast("long").alias("b")).distinct()
    asked = heads.unionAll(placed.select(F.col("b").alias("id"), "a", "part", "b"))
    rows = sieved(sets, asked.select("id")).join(asked, "id").select("a", "part", "b", "held")
    ordered_rows = rows.repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = np.zeros(0, dtype=np.int64)
        for batch in batches:
            keep = []
            for b, held in zip(batch.column("b").to_pylist(), batch.column("held")):
                x = held.values.to_numpy()
                if b is None:
                    head = x.copy()
                    keep.append(False)
                    continue
                # each is distinct in itself, so equal neighbours after sorting are the intersection
                z = np.concatenate([head, x])
                z.sort(kind="stable")
                common = int((z[1:] == z[:-1]).sum())
                keep.append(100 * common >= percent * (len(z) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, type=pa.bool_()))

    return ordered_rows.select("a", "b", "held").mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """All nodes of the edges but the smallest of each component, with that one: alternating large and small stars.

    A large star links the greater neighbours of a node with its smallest one, a small star the lesser ones. Both keep
    components; when nothing changes, every node is linked with its component's smallest. A hub is split by adaptive joins.
    """
    current, before = written(edges.where("a != b").selectExpr("greatest(a, b) as u", "least(a, b) as v").distinct(), "edges"), None
    while True:
        around = current.unionAll(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = around.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select("u", F.col("m").alias("v")).unionAll(small.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")))
        current = written(small.distinct(), "edges")
        state = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    return current.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("id"), F.col("m").alias("component"))


def ordered(a: str, b: str) -> list:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def other(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(c).alias(f"o_{c}") for c in df.columns])


def alike(s: NearSettings):
    """Whether sizes and sketches of a row and of its ``o_`` columns allow a link."""
    x = [F.col(f"s{i}").bitwiseXOR(F.col(f"o_s{i}")) for i in range(4)]
    differ = sum(F.bit_count((v.bitwiseOR(F.shiftright(v, 1))).bitwiseAND(F.lit(EVEN_BITS))) for v in x)
    return (100 * F.least("n", "o_n") >= s.percent * F.greatest("n", "o_n")) & (differ <= s.differing)


SKETCH = ["n", "s0", "s1", "s2", "s3"]


def star_pairs(entries: DataFrame, leaders: DataFrame, names: DataFrame, s: NearSettings) -> DataFrame:
    """Members of bands with the leader of the band, where size and sketch allow a link."""
    facts = names.select("id", *SKETCH)
    pairs = entries.join(leaders, "band").where("id != leader").select("id", F.col("leader").alias("o_id")).distinct()
    both = pairs.join(facts, "id").join(other(facts), "o_id")
    return both.where(alike(s)).select(*ordered("id", "o_id")).distinct()


def remaining(members: DataFrame, names: DataFrame, sets: DataFrame, s: NearSettings) -> DataFrame:
    """Pairs of different components that can still be linked; every link between them is among these pairs.

    Two such documents share a band, and that band spans several components. A shingle is rare if at most ``rare`` of
    these documents have it. Ordered from the rarest on, the first shingle that two linked documents share is among the
    first ``n - percent of n + 1`` of both. So a linked pair either shares a rare shingle there, which at most ``rare``
    documents do, or shares no rare shingle at all: then neither's rare ones are in the intersection, which bounds it.
    Only pairs of the second kind are looked for in the bands.
    """
    possible = (F.col("component") != F.col("o_component")) & alike(s)
    tokens = sieved(sets, members.select("id")).join(members.select("id").distinct(), "id").select("id", F.explode("held").alias("token"))
    seldom = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") <= s.rare)
    held = written(tokens.join(seldom, "token"), "rare")
    facts = members.select("id", "component").distinct().join(names.select("id", *SKETCH, "bands"), "id")
    counts = held.groupBy("id").agg(F.count(F.lit(1)).alias("r"))
    facts = written(facts.join(counts, "id", "left").na.fill(0, ["r"]), "facts")
    common = [*SKETCH, "component", "r"]

    place = F.row_number().over(Window.partitionBy("id").orderBy("df", "token"))
    first = held.withColumn("place", place).where("df > 1").join(facts, "id")
    first = first.where(100 * (F.col("place") - 1) <= (100 - s.percent) * F.col("n")).select("id", "token", *common)
    sharing = first.join(other(first), (F.col("token") == F.col("o_token")) & (F.col("id") < F.col("o_id")) & possible)

    most = F.least(F.col("n") - F.col("r"), F.col("o_n") - F.col("o_r"))
    enough = 100 * most >= s.percent * (F.col("n") + F.col("o_n") - most)
    # no partner can make up for too many rare shingles
    able = members.select("band", "id", "main").join(facts, "id").where(100 * (F.col("n") - F.col("r")) >= s.percent * F.col("n"))
    outside = other(able.where("component != main"))
    # a pair that shares several bands is taken in one of them
    once = F.array_min(F.array_intersect("bands", "o_bands")) == F.col("band")
    together = outside.join(
        able,
        (F.col("band") == F.col("o_band")) & ((F.col("component") == F.col("main")) | (F.col("id") < F.col("o_id"))) & possible & enough & once,
    )
    return sharing.select(*ordered("id", "o_id")).unionAll(together.select(*ordered("id", "o_id"))).distinct()


def near_duplicates(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: NearSettings = NearSettings()
) -> DataFrame:
    """Per row its id, the size of its set, the smallest id of its group, and whether that is its own."""
    s = settings
    given = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    sketched = written(sketches(given, s, "id", "text"), "sketches")
    full = sketched.where("n > 0 and id is not null")
    # the number of a set is that of the written row
    classes = full.groupBy("h1", "h2", "n").agg(F.min("id").alias("name")).withColumn("set", F.monotonically_increasing_id())
    classes = written(classes, "classes")
    named = full.select("id", "n", "h1", "h2").join(classes, ["h1", "h2", "n"]).select("id", "name")
    own = full.join(classes.select(F.col("name").alias("id")).distinct(), "id", "left_semi")  # of names only
    own = own.join(classes, ["h1", "h2", "n"]).where("id = name").drop("id").withColumnRenamed("set", "id")
    names = written(own.dropDuplicates(["id"]), "names")

    in_band = names.select("id", F.explode("bands").alias("band"))
    shared = in_band.groupBy("band").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    entries = written(in_band.join(shared, "band"), "entries")
    company = entries.groupBy("id").agg(F.sum("members").alias("company"))
    leaders = entries.join(company, "id").groupBy("band").agg(
        F.max(F.struct("company", (-F.col("id")).alias("minus"))).alias("top")
    )
    leaders = written(leaders.select("band", (-F.col("top.minus")).alias("leader")), "leaders")
    stars = written(star_pairs(entries, leaders, names, s), "stars")
    needed = written(names.select("id", "name", "n", "h1", "h2").join(entries.select("id").distinct(), "id", "left_semi"), "needed")
    repeated = sketched.where("id is not null").groupBy("id").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("id")
    sets = written(one_row_sets(given, needed, written(repeated, "repeated"), s.words), "sets")
    first = written(linked(stars, sets, s.percent, s.share), "links")
    groups = components(first)

    # bands that still span several components
    placed = entries.join(groups, "id", "left").select("band", "id", F.coalesce("component", "id").alias("component"))
    torn = placed.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low != high")
    main = leaders.join(groups, leaders["leader"] == groups["id"], "left").select(
        "band", F.coalesce("component", "leader").alias("main")
    )
    members = written(placed.join(torn.join(main, "band").select("band", "main"), "band"), "members")
    rest = remaining(members, names, sets, s).join(stars, ["a", "b"], "left_anti")
    second = linked(written(rest, "rest"), sets, s.percent, s.share)

    # from the numbers of sets back to ids; rows of one id with several sets hold these together
    edges = first.unionAll(second)
    for side in ("a", "b"):
        edges = edges.join(classes.select(F.col("set").alias(side), F.col("name").alias(f"_{side}")), side).drop(side)
    edges = edges.select(*ordered("_a", "_b")).unionAll(named.where("id != name").select(F.col("name").alias("a"), F.col("id").alias("b")).join(
        classes.select(F.col("name").alias("b")), "b", "left_semi").select("a", "b"))
    final = components(edges)
    found = sketched.select("id", "n", "h1", "h2").join(classes.drop("set"), ["h1", "h2", "n"], "left")
    result = found.join(final.withColumnRenamed("id", "name"), "name", "left")
    component = F.coalesce("component", "name", "id")
    return result.select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )


def drop_near_duplicates(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: NearSettings = NearSettings()
) -> DataFrame:
    """The rows, with all their columns, that are the one kept of their group; rows that repeat a whole row go too."""
    kept = near_duplicates(df, id_col, text_col, settings).where("kept").select(F.col(id_col).alias("_kept")).distinct()
    own = df.where(F.col(f"`{id_col}`").isNotNull())
    one = own.join(kept, F.col(f"`{id_col}`").cast("long") == F.col("_kept"), "left_semi")
    return one.dropDuplicates([id_col]).unionAll(df.where(F.col(f"`{id_col}`").isNull()))
