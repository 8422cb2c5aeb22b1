"""Accuracy by level, by confidence bucket and by coverage, from a prediction table.

A prediction table has ``Predicted <level>`` and ``Actual <level>`` for every level, and ``L<d> Confidence`` and
``L<d> Margin`` for every depth d.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .running import running_totals


def _right(levels) -> list[Column]:
    """Per depth, whether this and all levels above are right. Nulls compare as the text ``None``."""

    def text(name: str) -> Column:
        return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit("None"))

    hits = [text(f"Predicted {c}") == text(f"Actual {c}") for c in levels]
    return [reduce(lambda a, b: a & b, hits[:d]) for d in range(1, len(hits) + 1)]


def correct_flags(pred: DataFrame, levels) -> DataFrame:
    """Adds ``L<d> Correct``."""
    return pred.withColumns({f"L{d} Correct": ok for d, ok in enumerate(_right(levels), 1)})


def _accuracies(levels) -> list[Column]:
    return [F.avg(ok.cast("double")).alias(f"L{d} Accuracy") for d, ok in enumerate(_right(levels), 1)]


def accuracy_by_level(pred: DataFrame, levels) -> DataFrame:
    """One row: the share of rows with all levels down to d right, for each d."""
    return pred.agg(*_accuracies(levels))


def headline(pred: DataFrame, levels, split_col: str | None = None) -> DataFrame:
    """Accuracy per split, over all rows (``all``), and its deviation across splits (``std across splits``)."""
    names = [f"L{d} Accuracy" for d in range(1, len(levels) + 1)]
    if not split_col:
        return accuracy_by_level(pred, levels).select(F.lit("all").alias("split"), *[F.col(f"`{n}`") for n in names])
    rolled = (
        pred.withColumn("_s", F.col(f"`{split_col}`")).rollup("_s")
        .agg(F.grouping("_s").alias("_all"), *_accuracies(levels))
        .select(
            F.when(F.col("_all") == 1, "all").otherwise(F.col("_s").cast("string")).alias("split"),
            "_all", *[F.col(f"`{n}`") for n in names],
        )
    )
    spread = rolled.where("_all = 0").agg(*[F.stddev_samp(f"`{n}`").alias(n) for n in names])
    return rolled.drop("_all").unionByName(spread.select(F.lit("std across splits").alias("split"), "*"))


def split_metrics(pred: DataFrame, levels, split_col: str) -> DataFrame:
    """Rows and accuracies per candidate and split."""
    return pred.groupBy("candidate", F.col(f"`{split_col}`")).agg(F.count("*").alias("n_rows"), *_accuracies(levels))


def grid_results(metrics: DataFrame, candidates: DataFrame, n_splits: int, split_col: str) -> DataFrame:
    """Candidates with splits done, rows, mean and deviation of each accuracy, and whether all splits are done."""
    names = [c for c in metrics.columns if c.endswith("Accuracy")]
    done = metrics.groupBy("candidate").agg(
        F.count_distinct(F.col(f"`{split_col}`")).alias("splits_done"),
        F.sum("n_rows").alias("n_rows"),
        *[F.avg(f"`{n}`").alias(n) for n in names],
        *[F.stddev_samp(f"`{n}`").alias(f"{n} std") for n in names],
    )
    return candidates.join(done, "candidate", "left").withColumn(
        "complete", F.coalesce(F.col("splits_done") == n_splits, F.lit(False))
    )


def sort_results(results: DataFrame, metric: str) -> DataFrame:
    return results.orderBy(F.desc(f"`{metric}`"), "candidate")


def best_candidate(results: DataFrame, metric: str) -> DataFrame:
    """The complete candidate with the highest metric, the lowest number on ties; none complete is an error."""
    if metric not in results.columns:
        raise KeyError(f"{metric!r} is not in {results.columns}")
    rank = F.struct(F.col(f"`{metric}`"), -F.col("candidate"))
    row = F.struct(*[F.col(f"`{c}`") for c in results.columns])
    best = results.agg(F.max_by(row, F.when(F.col("complete"), rank)).alias("_best"))
    none = F.raise_error(F.lit("no candidate has finished every split"))
    return best.select(F.when(F.col("_best").isNull(), none.cast(results.schema)).otherwise(F.col("_best")).alias("_best")).select("_best.*")


# ---- confidence buckets ---------------------------------------------------------------------------------------

def n_buckets(width: float) -> int:
    return math.ceil(1.0 / width - 1e-9)


def bucket_of(confidence: Column, width: float) -> Column:
    """Bucket index of a confidence; the top bucket holds 1."""
    inside = F.least(F.greatest(confidence, F.lit(0.0)), F.lit(1.0))
    index = F.floor(inside / width + F.lit(1e-12)).cast("int")
    return F.greatest(F.least(index, F.lit(n_buckets(width) - 1)), F.lit(0))


def bucket_label(index: Column, width: float) -> Column:
    labels = [f"{i * width:.2f}-{min((i + 1) * width, 1.0):.2f}" for i in range(n_buckets(width))]
    return F.get(F.array(*map(F.lit, labels)), index)


def _by_depth(pred: DataFrame, levels, *keep: Column) -> DataFrame:
    """One row per prediction and depth: ``depth, confidence, ok``."""
    each = F.array(*[
        F.struct(
            F.lit(d).alias("depth"), F.col(f"`L{d} Confidence`").cast("double").alias("confidence"),
            ok.cast("double").alias("ok"),
        )
        for d, ok in enumerate(_right(levels), 1)
    ])
    return pred.select(*keep, F.inline(each))


def cumulative_from_top(buckets: DataFrame) -> DataFrame:
    """Adds coverage and accuracy of all items at or above a bucket. ``depth, index, n, hits, total`` per bucket."""
    down = Window.partitionBy("depth").orderBy(F.desc("index")).rowsBetween(Window.unboundedPreceding, 0)
    n, hits = F.sum("n").over(down), F.sum("hits").over(down)
    return buckets.withColumns(
        {
            "cumulative_coverage": n / F.greatest(F.col("total"), F.lit(1)),
            "cumulative_accuracy": F.when(n > 0, hits / n),
        }
    )


def bucket_tables(pred: DataFrame, levels, width: float = 0.1) -> DataFrame:
    """Items, share, accuracy and mean confidence per depth and bucket, also for empty buckets, and the cumulative
    view from the top bucket down. One pass over the predictions for all depths."""
    counted = (
        _by_depth(pred, levels)
        .groupBy("depth", bucket_of(F.col("confidence"), width).alias("index"))
        .agg(F.count("*").alias("n"), F.sum("ok").alias("hits"), F.avg("confidence").alias("mean_confidence"))
    )
    spine = (
        pred.sparkSession.range(1)
        .select(F.explode(F.sequence(F.lit(1), F.lit(len(levels)))).alias("depth"))
        .select("depth", F.explode(F.sequence(F.lit(0), F.lit(n_buckets(width) - 1))).alias("index"))
    )
    filled = (
        spine.join(counted, ["depth", "index"], "left")
        .withColumn("n", F.coalesce("n", F.lit(0)))
        .withColumn("hits", F.coalesce("hits", F.lit(0.0)))
        .withColumn("total", F.sum("n").over(Window.partitionBy("depth")))  # one row per bucket
    )
    i = F.col("index")
    return cumulative_from_top(filled).select(
        F.concat(F.lit("L"), F.col("depth")).alias("level"),
        bucket_label(i, width).alias("bucket"),
        (i * F.lit(float(width))).alias("lower"),
        F.least((i + 1) * F.lit(float(width)), F.lit(1.0)).alias("upper"),
        F.col("n").alias("n_items"),
        (F.col("n") / F.greatest(F.col("total"), F.lit(1))).alias("share_of_items"),
        F.when(F.col("n") > 0, F.col("hits") / F.col("n")).alias("accuracy"),
        "mean_confidence", "cumulative_coverage", "cumulative_accuracy",
    )


def bucket_table(pred: DataFrame, levels, depth: int, width: float = 0.1) -> DataFrame:
    return bucket_tables(pred, levels, width).where(F.col("level") == f"L{depth}")


def split_bucket_accuracy(pred: DataFrame, levels, depth: int, width: float, split_col: str = "fold") -> DataFrame:
    """Accuracy and items per split and bucket; buckets without items are left out."""
    return (
        _by_depth(pred, levels, F.col(f"`{split_col}`").alias("split"))
        .where(F.col("depth") == depth)
        .groupBy("split", bucket_of(F.col("confidence"), width).alias("bucket"))
        .agg(F.avg("ok").alias("accuracy"), F.count("*").alias("n_items"))
        .withColumn("bucket_label", bucket_label(F.col("bucket"), width))
    )


def accept_boundary(tables: DataFrame, target: float) -> DataFrame:
    """Per level the lowest bucket whose accuracy from the top down still meets the target, with its coverage.

    A level that never meets it is left out.
    """
    meets = tables.where(F.col("cumulative_accuracy") >= target)
    return meets.groupBy("level").agg(
        F.min("lower").alias("lower"),
        F.min_by("bucket", "lower").alias("bucket"),
        F.min_by("cumulative_coverage", "lower").alias("coverage"),
    )


def coverage_curve(pred: DataFrame, levels, key: str) -> DataFrame:
    """``depth, key, coverage, accuracy``: items by falling confidence, the share kept and its accuracy so far."""
    each = _by_depth(pred, levels, F.col(f"`{key}`"))
    order = [F.desc("confidence"), F.col(f"`{key}`")]
    run = running_totals(each, ["depth"], order, {"rank": F.lit(1), "hits": F.col("ok")})
    sizes = each.groupBy("depth").agg(F.count(F.lit(1)).alias("n"))  # not the last rank, which would place all rows again
    return run.join(F.broadcast(sizes), "depth").select(  # one row per depth
        "depth", F.col(f"`{key}`"), F.col("rank"), (F.col("rank") / F.col("n")).alias("coverage"),
        (F.col("hits") / F.col("rank")).alias("accuracy"),
    )


def coverage_at(curve: DataFrame, targets=(0.9, 0.95)) -> DataFrame:
    """The largest coverage whose accuracy still meets each target."""
    each = curve.select("depth", "coverage", "accuracy", F.explode(F.array(*map(F.lit, targets))).alias("target"))
    return each.where("accuracy >= target").groupBy("depth", "target").agg(F.max("coverage").alias("coverage"))
