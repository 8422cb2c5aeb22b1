"""Running totals over a whole table without bringing a group into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written


def running_totals(df: DataFrame, group: list[str], order: list[Column], values: dict[str, Column]) -> DataFrame:
    """Adds for every entry of ``values`` its sum over the rows of the group up to and including this one.

    A window over the group would sort all its rows in one task. Here the rows are range-partitioned by group and
    order, summed inside each range, and the sums of the ranges before are added. ``order`` must be total.
    """
    given = df.select("*", *[v.alias(f"_v{i}") for i, v in enumerate(values.values())])
    keys = [F.col(f"`{c}`") for c in group]
    # the ranges come from a sample; they are written once so that all readers see the same ones
    ranges = written(
        given.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id()), "ranges"
    )
    per_range = ranges.groupBy(*keys, "_range").agg(
        *[F.sum(f"_v{i}").alias(f"_t{i}") for i in range(len(values))]
    )
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_range.select(  # at most one row per range and group
        *[k.alias(f"_g{i}") for i, k in enumerate(keys)],
        F.col("_range").alias("_r"),
        *[F.coalesce(F.sum(f"_t{i}").over(earlier), F.lit(0)).alias(f"_o{i}") for i in range(len(values))],
    )
    same = F.col("_range") == F.col("_r")
    for i, k in enumerate(keys):
        same &= k.eqNullSafe(F.col(f"_g{i}"))
    inside = Window.partitionBy("_range", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = ranges.select("*", *[F.sum(f"_v{i}").over(inside).alias(f"_s{i}") for i in range(len(values))]).join(
        offsets, same
    )
    for i, name in enumerate(values):
        out = out.withColumn(name, F.col(f"_s{i}") + F.col(f"_o{i}"))
    return out.select(*[F.col(f"`{c}`") for c in df.columns], *[F.col(f"`{n}`") for n in values])
