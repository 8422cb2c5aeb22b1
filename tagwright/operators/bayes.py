"""Multinomial naive Bayes per level of a category tree, as counts, joins and windows.

A *class* at depth d is the first d labels of a path, so one label under two parents is two classes. Tables:

``vocabulary``  split, term, df, total, idf, tid          ``tid`` is what a term is called in the joins of a prediction
``classes``     split, code, depth, class, parent, n, total, n_features   numbered by depth, then in label order
``weights``     split, tid, code, fc                      feature sums, zeros left out
``sums``        split, doc, code, s_0 .. s_k              per class: sum of x * ln(1 + fc / alpha_i)

The log-likelihood of a class is ``s + row_sum * (ln alpha - log_norm) + prior``; only ``s`` depends on the terms,
and it is zero unless document and class share one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .product import sums_by_document


def path_of(levels) -> Column:
    """The label path of a row; a missing label is the label ``None``."""
    return F.array(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("None")) for c in levels])


def prefixes(df: DataFrame, depth: int) -> DataFrame:
    """One row per prefix of ``path``, as ``depth`` and ``class``."""
    every = F.array(*[
        F.struct(F.lit(d).alias("depth"), F.slice("path", 1, d).alias("class")) for d in range(1, depth + 1)
    ])
    return df.withColumn("_p", F.explode(every)).select("*", "_p.depth", "_p.class").drop("_p", "path")


def class_counts(docs: DataFrame, depth: int) -> DataFrame:
    """``split, depth, class, n`` from ``split, path``. Counted per path first, then summed over the prefixes."""
    per_path = docs.groupBy("split", "path").agg(F.count("*").alias("n"))
    return prefixes(per_path, depth).groupBy("split", "depth", "class").agg(F.sum("n").alias("n"))


def class_term_counts(rows: DataFrame, depth: int) -> DataFrame:
    """``split, depth, class, term, fc`` from ``split, path, term, x``: sums of the feature values, zeros dropped."""
    checked = rows.withColumn(
        "x", F.when(F.col("x") >= 0, F.col("x")).otherwise(F.raise_error(F.lit("negative feature value")))
    )
    per_path = checked.groupBy("split", "path", "term").agg(F.sum("x").alias("fc"))
    return (
        prefixes(per_path, depth)
        .groupBy("split", "depth", "class", "term").agg(F.sum("fc").alias("fc"))
        .where("fc <> 0")
    )


def path_index(docs: DataFrame, depth: int) -> DataFrame:
    """``split, depth, class, parent``: the distinct prefixes, each with the prefix above it."""
    return (
        prefixes(docs.select("split", "path").distinct(), depth)
        .distinct()
        .withColumn("parent", F.slice("class", F.lit(1), F.col("depth") - 1))
    )


def class_totals(classes: DataFrame, term_counts: DataFrame, n_features: DataFrame) -> DataFrame:
    """Adds ``total`` and ``n_features``; a class without any term has total 0."""
    totals = term_counts.groupBy("split", "depth", "class").agg(F.sum("fc").alias("total"))
    return (
        classes.join(totals, ["split", "depth", "class"], "left")
        .withColumn("total", F.coalesce("total", F.lit(0.0)))
        .join(F.broadcast(n_features), "split")  # one row per split
    )


def log_norm(alpha: float) -> Column:
    return F.log(F.col("total") + alpha * F.col("n_features"))


def nb_priors(classes: DataFrame, fit_prior: bool = True) -> DataFrame:
    """Adds ``prior``: unsmoothed log share of the level, or uniform."""
    level = Window.partitionBy("split", "depth")  # as many rows as the tree has classes
    prior = F.log("n") - F.log(F.sum("n").over(level)) if fit_prior else -F.log(F.count("*").over(level))
    return classes.withColumn("prior", prior)


def class_params(classes: DataFrame, alpha: float, fit_prior: bool) -> DataFrame:
    """Adds ``const`` and ``prior``, all that a document without known terms needs."""
    if alpha <= 0:
        raise ValueError("alpha is a positive number")
    return nb_priors(classes, fit_prior).withColumn("const", F.log(F.lit(float(alpha))) - log_norm(alpha))


def coded(classes: DataFrame) -> DataFrame:
    """Adds ``code``: the position of the class in its split, by depth and then in label order."""
    order = Window.partitionBy("split").orderBy("depth", "class")  # as many rows as the tree has classes
    return classes.withColumn("code", F.row_number().over(order) - 1)


def keyed(vocabulary: DataFrame) -> DataFrame:
    """Adds ``tid``, what a term is called in the joins of a prediction; null there means a term outside the vocabulary."""
    return vocabulary.withColumn("tid", F.col("term"))


# ---- scoring --------------------------------------------------------------------------------------------------

def row_sums(docs: DataFrame, x: DataFrame) -> DataFrame:
    """``split, doc, rs`` for every document, 0 without a known term."""
    sums = x.groupBy("split", "doc").agg(F.sum("x").alias("rs"))
    return docs.select("split", "doc").join(sums, ["split", "doc"], "left").withColumn(
        "rs", F.coalesce("rs", F.lit(0.0))
    )


def lookup_term_weights(x: DataFrame, weights: DataFrame, alphas=(1.0,)) -> DataFrame:
    """``split, doc, code, s_0 ..``: the sparse product of documents and class weights, one sum per alpha."""
    names = [f"s_{i}" for i in range(len(alphas))]
    lists = sums_by_document(x, weights, alphas).select("split", "doc", F.explode(F.arrays_zip("codes", *names)).alias("_f"))
    return lists.select("split", "doc", F.col("_f.codes").alias("code"), *[f"_f.{n}" for n in names])
