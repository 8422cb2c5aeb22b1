"""Scores and predictions with joins and windows only, a row per document and class: what the library's are compared with."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagwright.operators.bayes import class_params, prefixes

SALTS = 16


def joint_log_likelihood(docs: DataFrame, sums: DataFrame, params: DataFrame) -> DataFrame:
    """``split, doc, code, depth, class, parent, jll`` for every document and class.

    The result has documents x classes rows by definition: it is for a look inside, :mod:`.scoring` predicts without.
    ``docs``: ``split, doc, rs``; every class of the split gets the part of the likelihood that needs no term, and the
    sparse sums are added by one aggregation. Copies of the class table meet the documents of one salt each.
    """
    copies = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    placed = docs.withColumn("_salt", F.pmod(F.xxhash64("doc"), F.lit(SALTS)).cast("int"))
    per_class = params.select("split", "code", "const", "prior", copies.alias("_salt"))
    spine = placed.join(per_class, ["split", "_salt"]).select(
        "split", "doc", "code", (F.col("rs") * F.col("const") + F.col("prior")).alias("v")
    )
    sparse = sums.select("split", "doc", "code", F.col("s_0").alias("v"))
    added = spine.unionByName(sparse).groupBy("split", "doc", "code").agg(F.sum("v").alias("jll"))
    return added.join(params.select("split", "code", "depth", "class", "parent"), ["split", "code"])


def log_softmax(scores: DataFrame, group, value: str = "jll", name: str = "lp") -> DataFrame:
    """Adds ``value`` minus the log of the summed exponentials of its group."""
    w = Window.partitionBy(*group)
    shifted = scores.withColumn("_z", F.col(value) - F.max(value).over(w))
    return shifted.withColumn(name, F.col("_z") - F.log(F.sum(F.exp("_z")).over(w))).drop("_z")


def flat_proba(jll: DataFrame) -> DataFrame:
    """Class probabilities per document and level."""
    return log_softmax(jll, ["split", "doc", "depth"]).withColumn("proba", F.exp("lp")).drop("lp")


def flat_predict(jll: DataFrame) -> DataFrame:
    """The most likely class per document and level, the first in label order on ties."""
    best = F.min_by("class", F.struct(-F.col("jll"), F.col("code")))
    return jll.groupBy("split", "doc", "depth").agg(best.alias("class"))


def path_scores(jll: DataFrame, depth: int, mode: str) -> DataFrame:
    """``split, doc, path, score``: the log score of every path seen in training.

    ``independent`` normalises each level over all its classes, ``conditional`` over the children of one parent,
    ``flattened`` uses the deepest level alone.
    """
    if mode == "flattened":
        deepest = jll.where(F.col("depth") == depth)
        return log_softmax(deepest, ["split", "doc"], name="score").select(
            "split", "doc", F.col("class").alias("path"), "score"
        )
    if mode not in ("independent", "conditional"):
        raise ValueError("mode is 'independent', 'conditional' or 'flattened'")
    siblings = ["parent"] if mode == "conditional" else []
    lp = log_softmax(jll, ["split", "doc", "depth", *siblings])
    # a path is the chain of its classes: walk from the root to the leaves, one level per step
    at = [
        lp.where(F.col("depth") == d).select("split", "doc", "class", "parent", F.col("lp").alias(f"lp{d}"))
        for d in range(1, depth + 1)
    ]
    walk = at[0].select("split", "doc", F.col("class").alias("path"), F.col("lp1").alias("score"))
    for d in range(2, depth + 1):
        walk = (
            at[d - 1].withColumnRenamed("class", "next")
            .join(walk.withColumnRenamed("path", "parent"), ["split", "doc", "parent"])
            .select("split", "doc", F.col("next").alias("path"), (F.col("score") + F.col(f"lp{d}")).alias("score"))
        )
    return walk


def predict_path(scores: DataFrame) -> DataFrame:
    """``split, doc, path``: the path with the highest score, the first in label order on ties."""
    best = F.min_by("path", F.struct(-F.col("score"), F.col("path")))
    return scores.groupBy("split", "doc").agg(best.alias("path"))


def prefix_mass(scores: DataFrame, depth: int) -> DataFrame:
    """``split, doc, depth, class, mass``: summed score of all paths below a class."""
    return (
        prefixes(scores, depth)
        .groupBy("split", "doc", "depth", "class").agg(F.sum(F.exp("score")).alias("mass"))
    )


def prefix_confidence(mass: DataFrame, predicted: DataFrame) -> DataFrame:
    """``split, doc, depth, confidence, margin`` of the predicted path's prefix at every depth.

    The margin is the distance to the largest other prefix, or the confidence itself if there is no other.
    """
    chosen = F.col("class") == F.slice("path", F.lit(1), F.col("depth"))
    confidence = F.max(F.when(chosen, F.col("mass")))
    other = F.coalesce(F.max(F.when(~chosen, F.col("mass"))), F.lit(0.0))
    return (
        mass.join(predicted, ["split", "doc"])
        .groupBy("split", "doc", "depth")
        .agg(confidence.alias("confidence"), (confidence - other).alias("margin"))
    )


def prefix_margin(mass: DataFrame, predicted: DataFrame) -> DataFrame:
    return prefix_confidence(mass, predicted).drop("confidence")


def predictions_by_rows(
    docs: DataFrame, sums: DataFrame, classes: DataFrame, depth: int, alpha: float, fit_prior: bool, mode: str
) -> DataFrame:
    """``split, doc, path, confidence, margin`` (arrays by depth) with joins and windows only.

    Exact for any number of classes; :mod:`.scoring` computes the same from one row per document.
    """
    params = class_params(classes, alpha, fit_prior)
    scores = path_scores(joint_log_likelihood(docs, sums, params), depth, mode)
    predicted = predict_path(scores)
    by_depth = F.array_sort(F.collect_list(F.struct("depth", "confidence", "margin")))
    rows = prefix_confidence(prefix_mass(scores, depth), predicted)
    return (
        rows.groupBy("split", "doc").agg(by_depth.alias("_d"))
        .join(predicted, ["split", "doc"])
        .select("split", "doc", "path", F.col("_d.confidence").alias("confidence"), F.col("_d.margin").alias("margin"))
    )
