"""The k smallest rows of a group without sorting the table: radix selection.

The rows are counted by the first digit of their order; the digit in which the k-th row falls is known from these counts,
and only the rows with that digit are looked at again, by their next digit, until few are left. What is found is the
order value of the k-th row. Whether a row is selected is then a comparison with it, made where the row is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

FEW = 10_000  # rows of a group that are put in order at last


def kth_rows(df: DataFrame, group: str, digits: Sequence[Column], order: Sequence[Column], k: int) -> dict[object, Row]:
    """Per value of ``group`` the order values ``o0, o1 ..`` of its k-th row; groups with fewer rows are left out.

    ``digits`` refine ``order`` from the left: rows with a smaller digit come first. Ties of the whole order count as
    rows in any order. One row per group comes to the driver; there are as many groups as the caller has splits.
    """
    if k < 1:
        return {}
    names = [f"d{i}" for i in range(len(digits))]
    rows = df.select(
        F.col(group).alias("g"), *[d.alias(n) for d, n in zip(digits, names)], *[o.alias(f"o{i}") for i, o in enumerate(order)]
    )
    spark, open_ = df.sparkSession, None  # open_: group, the digits so far, rows still to be passed
    kinds = dict(rows.dtypes)
    for i, name in enumerate(names):
        running = Window.partitionBy("g").orderBy(name)  # one row per value of a digit
        counted = rows.groupBy("g", name).agg(F.count(F.lit(1)).alias("n"))
        upto = counted.withColumn("upto", F.sum("n").over(running))
        wanted = F.lit(k) if open_ is None else F.col("left")
        if open_ is not None:
            upto = upto.join(F.broadcast(spark.createDataFrame([(r["g"], r["left"]) for r in open_], f"g {kinds['g']}, left long")), "g")
        hit = upto.where((F.col("upto") >= wanted) & (F.col("upto") - F.col("n") < wanted))
        open_ = hit.select("g", name, "n", (wanted - F.col("upto") + F.col("n")).cast("long").alias("left")).collect()
        if not open_:
            return {}
        chosen = spark.createDataFrame([(r["g"], r[name]) for r in open_], f"g {kinds['g']}, {name} {kinds[name]}")
        rows = rows.join(F.broadcast(chosen), ["g", name])
        if max(r["n"] for r in open_) <= FEW:
            break
    left = spark.createDataFrame([(r["g"], r["left"]) for r in open_], f"g {kinds['g']}, left long")
    placed = rows.withColumn("_r", F.row_number().over(Window.partitionBy("g").orderBy(*[f"o{i}" for i in range(len(order))])))
    found = placed.join(F.broadcast(left), "g").where(F.col("_r") == F.col("left"))
    return {r["g"]: r for r in found.select("g", *[f"o{i}" for i in range(len(order))]).collect()}
