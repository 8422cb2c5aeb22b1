"""Exact top-k search over binary codes by incremental multi-index hashing.

A vector's code is the signs of its values, bit i for value i (0 for what is not above zero, missing or no number).
Codes are cut into ``segments`` parts. Two codes that differ in at most ``segments * (s + 1) - 1`` bits differ in at
most s bits in some part. So in round s (the first takes all s up to
``start``) every unfinished query looks up, in each part, all values that differ from its own in exactly s bits. What it meets is verified by the full distance. A query is finished when its k-th best distance
is at most the distance covered; the others go on with s + 1.

A pair that shares several lookups is taken at the first only: lowest s, then lowest part. Equal codes are one entry
with its k + 1 smallest ids, and equal queries ask once, so copies cost nothing. Ties go to the smaller id; a row is
not its own neighbour. Null vectors have no code: they neither ask nor are found. Rows that share an id and a code count once. With
fewer than k other rows, all of them are returned. An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import written


@dataclass(frozen=True)
class SearchSettings:
    k: int = 10
    bits: int = 64
    segments: int = 4  # parts of 16 bits
    start: int = 2  # the first round looks up all values within this radius, as each radius alone is little work

    @property
    def part(self) -> int:
        return self.bits // self.segments


def sign_codes(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", bits: int = 64) -> DataFrame:
    """``id`` and ``code``, a long whose bits are the signs of the values; a vector of more than ``bits`` is an error."""
    v = F.col(f"`{vector_col}`")
    bit = lambda i: F.when((v[i] > 0) & ~F.isnan(v[i]), F.lit(1 << i if i < 63 else -(1 << 63))).otherwise(F.lit(0))
    code = sum((F.when(F.size(v) > i, bit(i)).otherwise(F.lit(0)) for i in range(1, bits)), F.when(F.size(v) > 0, bit(0)).otherwise(F.lit(0)))
    code = F.when(F.size(v) > bits, F.raise_error(F.lit(f"a vector has more than {bits} values"))).otherwise(code)
    return df.where(v.isNotNull() & F.col(f"`{id_col}`").isNotNull()).select(
        F.col(f"`{id_col}`").cast("long").alias("id"), code.cast("long").alias("code")
    )


def _masks(part: int, s: int) -> np.ndarray:
    return np.array([sum(1 << b for b in c) for c in combinations(range(part), s)], dtype=np.int64)


def lookups(queries: DataFrame, radii: range, x: SearchSettings) -> DataFrame:
    """For every query code, part and mask of as many bits as the radii say, the value to look up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks, low = np.concatenate([_masks(x.part, s) for s in radii]), (1 << x.part) - 1
        step = max(1, 500_000 // (len(masks) * x.segments))
        for batch in batches:
            codes, worst = batch.column("asked").to_numpy(), batch.column("worst").to_numpy()
            for i in range(0, len(codes), step):
                c, w = codes[i : i + step], worst[i : i + step]
                for j in range(x.segments):
                    own = (c.view(np.uint64) >> np.uint64(j * x.part)).astype(np.int64) & low
                    value = (own[:, None] ^ masks[None]).ravel()
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(value * x.segments + j), pa.array(np.repeat(c, len(masks))),
                            pa.array(np.repeat(w, len(masks))),
                        ],
                        names=["place", "asked", "worst"],
                    )

    return queries.select("asked", "worst").mapInArrow(run, "place long, asked long, worst long")


def first_ids(codes: DataFrame, n: int) -> DataFrame:
    """Each code with its ``n`` smallest ids. The ranking is cut to n rows a code before the shuffle."""
    rank = F.row_number().over(Window.partitionBy("code").orderBy("id"))
    return codes.distinct().withColumn("_rank", rank).where(F.col("_rank") <= n).groupBy("code").agg(
        F.sort_array(F.collect_list("id")).alias("ids")
    )


def top_k(codes: DataFrame, queries: DataFrame, settings: SearchSettings = SearchSettings()) -> DataFrame:
    """``codes``, ``queries``: id, code -> query_id, rank from 1, neighbor_id, distance."""
    x, keep = settings, settings.k + 1
    low = (1 << x.part) - 1
    held = written(first_ids(codes, keep), "codes")
    parts = F.array(*[
        F.shiftrightunsigned("code", j * x.part).bitwiseAND(F.lit(low)) * x.segments + j for j in range(x.segments)
    ])
    index = written(held.select(F.explode(parts).alias("place"), "code"), "index")
    spark = codes.sparkSession
    asked = written(queries.select(F.col("code").alias("asked")).distinct().withColumn("worst", F.lit(x.bits + 1).cast("long")), "asked")
    best, finished = None, []
    for s in range(min(x.start, x.part), x.part + 1):
        radii = range(s + 1) if best is None else range(s, s + 1)
        d = [F.bit_count(F.shiftrightunsigned(F.col("asked").bitwiseXOR(F.col("code")), j * x.part).bitwiseAND(F.lit(low))) for j in range(x.segments)]
        segment = F.col("place") % x.segments
        radius = F.element_at(F.array(*d), (segment + 1).cast("int"))
        new = F.lit(True)
        for j in range(x.segments):  # the pair's first meeting: no part is closer, and no earlier part as close
            new = new & (d[j] >= radius) & ((segment <= j) | (d[j] > radius))
        distance = F.bit_count(F.col("asked").bitwiseXOR(F.col("code")))
        # the optimiser takes the lookups to be as few as the queries and would send them to every task
        met = lookups(asked, radii, x).join(index.hint("merge"), "place").where(new & (distance <= F.col("worst")))
        met = met.select("asked", "code", distance.alias("distance"))
        # at most k + 1 codes of a query can matter, whatever their ids; equal distances all stay until ids decide
        close = F.rank().over(Window.partitionBy("asked").orderBy("distance"))
        met = met.withColumn("_close", close).where(F.col("_close") <= keep).drop("_close")
        rows = met.join(held, "code").select("asked", "distance", F.explode("ids").alias("id"))
        if best is not None:
            rows = rows.unionByName(best.join(asked.select("asked"), "asked", "left_semi"))
        order = F.row_number().over(Window.partitionBy("asked").orderBy("distance", "id"))
        best = written(rows.withColumn("_order", order).where(F.col("_order") <= keep).drop("_order"), "best")
        covered = x.segments * (s + 1) - 1
        state = best.groupBy("asked").agg(F.max("distance").alias("last"), F.count(F.lit(1)).alias("n"))
        state = asked.select("asked").join(state, "asked", "left")
        done = (F.col("n") == keep) & (F.col("last") <= covered)
        if s == x.part:
            done = F.lit(True)
        state = written(state.withColumn("done", F.coalesce(done, F.lit(False))), "state")
        finished.append(best.join(state.where("done").select("asked"), "asked", "left_semi"))
        asked = state.where("not done").select("asked", F.when(F.col("n") == keep, F.col("last")).otherwise(F.lit(x.bits + 1)).cast("long").alias("worst"))
        if asked.isEmpty():
            break
    found = finished[0]
    for f in finished[1:]:
        found = found.unionByName(f)
    lists = found.groupBy("asked").agg(F.sort_array(F.collect_list(F.struct("distance", "id"))).alias("near"))
    own = queries.select(F.col("id").alias("query_id"), "code").distinct().join(lists, F.col("code") == F.col("asked"))
    others = F.slice(F.filter("near", lambda n: n["id"] != F.col("query_id")), 1, x.k)
    return own.select("query_id", F.posexplode(others).alias("_at", "n")).select(
        "query_id", (F.col("_at") + 1).alias("rank"), F.col("n.id").alias("neighbor_id"), F.col("n.distance").cast("int").alias("distance")
    )


def search_sql(k: int = 10, bits: int = 64, step: int = 50) -> str:
    """The same rows in DuckDB, by comparing every query with every row."""
    return f"""
with codes as (
  select distinct vec_id as id,
         array_to_string(list_transform(range(1, {bits + 1}), lambda i: case when embedding[i] > 0 then '1' else '0' end), '') as code
  from embeddings where embedding is not null and vec_id is not null),
pairs as (
  select q.id as query_id, c.id as neighbor_id, hamming(q.code, c.code) as distance
  from codes q, codes c where q.id % {step} = 0 and q.id <> c.id),
ranked as (
  select *, row_number() over (partition by query_id order by distance, neighbor_id) as rank from pairs)
select query_id, cast(rank as integer) as rank, neighbor_id, cast(distance as integer) as distance
from ranked where rank <= {k}"""
