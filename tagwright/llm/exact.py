"""Exact duplicates by deterministic block naming, with DataFrame functions alone.

A text without its ASCII blanks is cut into blocks of ``block`` bytes. Distinct blocks are sorted and get integer names;
then adjacent names of a document are paired, the distinct pairs are sorted and named in turn, and so on until every
document has one name. Documents finish at the level their number of blocks sets, so (level, name) is an identity: equal
texts have the same one, and different texts never have, because two names of a level are equal only if what they stand
for is equal.

Blocks are sorted by two 64-bit hashes. That these tell all blocks apart is not assumed but checked on the blocks
themselves: if two different blocks share both hashes, other seeds are taken and all blocks are named anew. So block
contents travel once, only the distinct ones of each map task, and never meet the documents again. Names are positions in
``BUCKETS`` sorted buckets, (position * BUCKETS + bucket): unique, the same in every run, and no bucket holds a block twice,
so a group of copies of any size adds one row to it. The rows of such a group meet its name in a join whose skewed
partitions adaptive execution splits.

Of equal texts the row with the most code points in the original text stays, then the one with the smallest id, a null id
last; of rows that also share the id exactly one. Null and empty texts and texts of blanks are one group of equal texts.
Repeated rows all come back. An empty table gives no rows. Only id and text are read, so further columns cannot clash.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written

BLANKS = " \t\n\x0b\f\r"
BUCKETS = 1 << 16


@dataclass(frozen=True)
class NamingSettings:
    block: int = 4096  # bytes
    hash_bits: int = 64  # of each of the two hashes; fewer make collisions, for tests


def squeezed(text: str) -> Column:
    """The text without ASCII blanks; null is the empty text."""
    return F.translate(F.coalesce(F.col(text), F.lit("")), BLANKS, "")


def _fingerprint(block: Column, seed: int, bits: int) -> list[Column]:
    """Two hashes of a block, of ``bits`` bits."""
    first, second = F.xxhash64(F.lit(2 * seed), block), F.xxhash64(F.lit(2 * seed + 1), block)
    return [F.shiftrightunsigned(h, 64 - bits) if bits < 64 else h for h in (first, second)]


def sorted_names(distinct: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``name`` to distinct rows: the position in the sorted bucket of the row, made unique by the bucket's number."""
    bucket = F.pmod(F.xxhash64(*keys), F.lit(BUCKETS))
    place = F.row_number().over(Window.partitionBy("_bucket").orderBy(*keys)).cast("long")
    return distinct.withColumn("_bucket", bucket).withColumn("name", place * BUCKETS + F.col("_bucket")).drop("_bucket")


def _blocks(s: NamingSettings) -> Column:
    """The blocks of ``bytes``, one at least."""
    last = F.greatest(F.lit(0), F.ceil(F.octet_length("bytes") / s.block).cast("int") - 1)
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.substring("bytes", i * s.block + 1, F.lit(s.block)))


def block_names(given: DataFrame, s: NamingSettings) -> tuple[DataFrame, DataFrame]:
    """``row, id, n_chars, sha, blocks`` (the fingerprints of a row's blocks), and ``h1, h2, name`` for each distinct block."""
    cut = given.select("id", "text", squeezed("text").cast("binary").alias("bytes"))
    seed = 0
    while True:
        blocks = cut.select(F.explode(_blocks(s)).alias("block"))
        h1, h2 = _fingerprint(F.col("block"), seed, s.hash_bits)
        distinct = blocks.select(h1.alias("h1"), h2.alias("h2"), "block").distinct()
        counted = written(distinct.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")), "blocks")
        if counted.where("n > 1").isEmpty():
            break
        seed += 1  # two blocks look alike under these hashes

    def prints(block: Column) -> Column:
        h1, h2 = _fingerprint(block, seed, s.hash_bits)
        return F.struct(h1.alias("h1"), h2.alias("h2"))

    rows = cut.select(
        F.monotonically_increasing_id().alias("row"), "id", F.coalesce(F.length("text"), F.lit(0)).alias("n_chars"),
        F.sha2("bytes", 256).alias("sha"), F.transform(_blocks(s), prints).alias("blocks"),
    )
    return written(rows, "rows"), written(sorted_names(counted.select("h1", "h2"), ["h1", "h2"]), "names")


def identities(given: DataFrame, s: NamingSettings) -> DataFrame:
    """``row, id, n_chars, sha, level, name`` for ``id, text``: two rows have the same level and name if their texts are equal."""
    rows, names = block_names(given, s)
    single = F.size("blocks") == 1
    # rows with one block have their identity; only the others go on
    found = rows.where(single).select("row", F.col("blocks")[0]["h1"].alias("h1"), F.col("blocks")[0]["h2"].alias("h2"))
    found = found.join(names, ["h1", "h2"]).select("row", F.lit(0).alias("level"), "name")
    most = rows.agg(F.max(F.size("blocks"))).first()[0] or 0
    at = rows.where(~single).select("row", F.posexplode("blocks").alias("place", "b"))
    at = at.select("row", "place", "b.h1", "b.h2").join(names, ["h1", "h2"]).select("row", "place", "name")
    level = 0
    while most > 1:
        level, most = level + 1, (most + 1) // 2
        halves = at.select("row", F.shiftright("place", 1).alias("place"), "name", (F.col("place") % 2).alias("half"))
        pairs = halves.groupBy("row", "place").agg(
            F.max(F.when(F.col("half") == 0, F.col("name"))).alias("left"),
            F.coalesce(F.max(F.when(F.col("half") == 1, F.col("name"))), F.lit(0)).alias("right"),  # 0 is no name
        )
        pairs = written(pairs, "pairs")
        named = sorted_names(pairs.select("left", "right").distinct(), ["left", "right"])
        at = pairs.join(named, ["left", "right"]).select("row", "place", "name")
        width = written(at.groupBy("row").agg(F.max("place").alias("last"), F.max("name").alias("name")), "width")
        found = found.unionAll(width.where("last = 0").select("row", F.lit(level), "name"))
        at = written(at.join(width.where("last > 0").select("row"), "row", "left_semi"), "level") if most > 1 else at
    return rows.drop("blocks").join(found, "row")


def exact_groups(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: NamingSettings = NamingSettings()
) -> DataFrame:
    """Per row its id, the id of the row of its group that stays, the group's size, whether the row stays, and the digest."""
    given = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    named = written(identities(given, settings), "identities")
    best = F.min(F.struct((-F.col("n_chars")).alias("minus"), F.isnull("id").alias("last"), "id", "row"))
    groups = named.groupBy("level", "name").agg(F.count(F.lit(1)).alias("group_size"), best.alias("best"))
    return named.join(groups, ["level", "name"]).select(
        F.col("id").alias(id_col), F.col("best.id").alias("keep_id"), "group_size",
        (F.col("row") == F.col("best.row")).alias("kept"), F.col("sha").alias("text_sha256"),
    )


def groups_sql() -> str:
    """What :func:`exact_groups` gives for ``documents``, in DuckDB's SQL."""
    return r"""
with texts as (
  select doc_id, length(coalesce(text, '')) as n,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as t from documents),
placed as (
  select doc_id, t, count(*) over (partition by t) as group_size,
         first_value(doc_id) over w as keep_id, row_number() over w as place
  from texts window w as (partition by t order by n desc, doc_id))
select doc_id, keep_id, group_size, place = 1 as kept, sha256(t) as text_sha256 from placed
"""
