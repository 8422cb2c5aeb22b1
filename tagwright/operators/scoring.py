"""Predictions from one row per document: Spark multiplies terms with class weights, a small array step scores the classes.

A document is scored against all classes at once, because the softmax needs them together. One row per document and
class would be documents x classes rows through the engine; here the sparse product (:mod:`.product`) ends with the sums
of a part's documents as arrays inside a task, and they are scored there. Steps are cut by the cells they fill, so a task
holds the same for long and short texts.

The class table goes along with the tasks: it is the label tree, a row per label, and a task must hold one score per
class of a document anyway. The weights stay behind.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from .product import Part, lists, multiplied, with_terms

# Cells of the dense score arrays per step, at least one document: the memory of a task, not what it computes.
STEP_CELLS = 500_000
QUALITY = ("n_tokens", "n_known")


@dataclass
class Level:
    """Classes of one depth, in label order, so that siblings, and the paths below a class, are neighbours."""

    at: slice               # columns of the score array
    n: np.ndarray
    total: np.ndarray
    n_features: float
    siblings: np.ndarray    # first class of each group of siblings
    family: np.ndarray      # group of every class
    of_path: np.ndarray     # class of every path
    first_path: np.ndarray  # first path below each class


    def shares(self, jll: np.ndarray, among_siblings: bool) -> np.ndarray:
        """Log probability of every class, among its siblings or in the whole level."""
        if among_siblings:
            return log_shares(jll, self.siblings, self.family)
        return log_shares(jll, np.array([0]), np.zeros(len(self.n), int))


class Tree:
    """Classes of one split as arrays."""

    def __init__(self, classes: list, depth: int):
        classes = sorted(classes, key=lambda r: r.code)
        self.size = len(classes)
        by_depth = [[r for r in classes if r.depth == d] for d in range(1, depth + 1)]
        paths = [tuple(r["class"]) for r in by_depth[-1]]
        self.levels = []
        for d, level in enumerate(by_depth, 1):
            place = {tuple(r["class"]): i for i, r in enumerate(level)}
            eldest = np.array([i == 0 or r.parent != level[i - 1].parent for i, r in enumerate(level)])
            of_path = np.array([place[p[:d]] for p in paths])
            self.levels.append(
                Level(
                    slice(level[0].code, level[0].code + len(level)),
                    np.array([r.n for r in level], float),
                    np.array([r.total for r in level], float),
                    float(level[0].n_features),
                    np.flatnonzero(eldest),
                    np.cumsum(eldest) - 1,
                    of_path,
                    np.flatnonzero(np.r_[True, of_path[1:] != of_path[:-1]]),
                )
            )

    def likelihoods(self, sums: np.ndarray, rs: np.ndarray, alpha: float, fit_prior: bool) -> list[np.ndarray]:
        """Joint log likelihood of every class, one documents x classes array per level."""
        out = []
        for level in self.levels:
            classes = len(level.n)
            prior = np.log(level.n) - np.log(level.n.sum()) if fit_prior else np.full(classes, -np.log(classes))
            const = np.log(alpha) - np.log(level.total + alpha * level.n_features)
            out.append(sums[:, level.at] + rs[:, None] * const + prior)
        return out

    def scores(self, likelihoods: list[np.ndarray], mode: str) -> np.ndarray:
        """Log score of every path, documents x paths."""
        out = 0.0
        deepest_only = mode == "flattened"
        for level, jll in zip(self.levels, likelihoods):
            if deepest_only and level is not self.levels[-1]:
                continue
            shares = level.shares(jll, among_siblings=mode == "conditional")
            out = out + shares[:, level.of_path]
        return out

    def best(self, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best path, and per depth the mass of its prefix and the distance to the largest other prefix."""
        best = scores.argmax(axis=1)
        mass_of_path = np.exp(scores)
        confidence, margin = [], []
        for level in self.levels:
            mass = np.add.reduceat(mass_of_path, level.first_path, axis=1)
            mine = np.take_along_axis(mass, level.of_path[best][:, None], axis=1)[:, 0]
            confidence.append(mine)
            if mass.shape[1] == 1:
                margin.append(mine)
                continue
            second, first = np.partition(mass, -2, axis=1)[:, -2:].T
            margin.append(mine - np.where(mine == first, second, first))
        return best, np.stack(confidence, 1), np.stack(margin, 1)


def log_shares(scores: np.ndarray, starts: np.ndarray, group_of: np.ndarray) -> np.ndarray:
    """Log of the share of each column in its group; groups are neighbouring columns, ``starts`` their first."""
    return scores - np.logaddexp.reduceat(scores, starts, axis=1)[:, group_of]


def _rows(values: np.ndarray) -> pa.ListArray:
    """A list per row of a two-dimensional array."""
    return lists(np.ascontiguousarray(values).ravel(), np.full(len(values), values.shape[1]))


def _predictions(candidates: list, alphas: list[float]):
    def score(tree: Tree, docs: pa.Table, sums: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        rs = docs.column("rs").to_numpy()
        quality = [c for c in QUALITY if c in docs.column_names]
        beside = {c: docs.column(c).combine_chunks() for c in ("split", "doc", *quality)}
        for candidate, alpha, fit_prior, mode in candidates:
            likelihoods = tree.likelihoods(sums[alphas.index(alpha)], rs, alpha, fit_prior)
            best, confidence, margin = tree.best(tree.scores(likelihoods, mode))
            columns = {
                "candidate": pa.array(np.full(len(docs), candidate, np.int32)), "split": beside["split"], "doc": beside["doc"],
                "code": pa.array((best + tree.levels[-1].at.start).astype(np.int32)),
                "confidence": _rows(confidence), "margin": _rows(margin), **{c: beside[c] for c in quality},
            }
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return score


def _values(what: str, alpha: float, fit_prior: bool):
    """One array per document: ``jll`` or ``proba`` of every class, ``best`` class per level, or a mode's path scores."""

    def score(tree: Tree, docs: pa.Table, sums: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        likelihoods = tree.likelihoods(sums[0], docs.column("rs").to_numpy(), alpha, fit_prior)
        if what == "jll":
            values = np.hstack(likelihoods)
        elif what == "proba":
            values = np.exp(np.hstack([lv.shares(jll, False) for jll, lv in zip(likelihoods, tree.levels)]))
        elif what == "best":
            values = np.stack([jll.argmax(1) + lv.at.start for jll, lv in zip(likelihoods, tree.levels)], 1).astype(float)
        else:
            values = tree.scores(likelihoods, what)
        beside = [docs.column(c).combine_chunks() for c in ("split", "doc")]
        yield pa.RecordBatch.from_arrays([*beside, _rows(values)], names=["split", "doc", "values"])

    return score


def _in_steps(trees, score):
    """Scores of a part with whole sums, cut into steps so that the dense arrays stay small."""

    def finish(part: Part) -> Iterator[pa.RecordBatch]:
        if not len(part.docs):
            return
        tree = trees.value[part.docs.column("split")[0].as_py()]
        step = max(1, STEP_CELLS // tree.size)
        for low in range(0, len(part.docs), step):
            sums = [s[:, : tree.size] for s in part.some(low, low + step)]
            yield from score(tree, part.docs.slice(low, step), sums)

    return finish


def _trees(model, depth: int) -> dict[int, Tree]:
    """Class arrays per split."""
    classes: dict[int, list] = {}
    for r in model.classes.collect():  # the label tree
        classes.setdefault(r.split, []).append(r)
    return {s: Tree(rows, depth) for s, rows in classes.items()}


def _scored(docs: DataFrame, x: DataFrame, model, alphas: list[float], depth: int, score, columns: str) -> DataFrame:
    """What ``score`` gives for every document, beside ``split, doc`` and the counts of its tokens if ``x`` has them."""
    quality = [
        F.sum("words").alias("n_tokens"), F.sum(F.when(F.col("tid").isNotNull(), F.col("words"))).alias("n_known")
    ] if "words" in x.columns else []
    ready = with_terms(x, docs, F.sum("x").alias("rs"), *quality).fillna(0, ["rs", *[q for q in QUALITY if quality]])
    held = _trees(model, depth)
    size = max(t.size for t in held.values())
    trees = docs.sparkSession.sparkContext.broadcast(held)
    schema = columns.format(doc=ready.schema["doc"].dataType.simpleString())
    schema += "".join(f", {c} bigint" for c in QUALITY if quality)
    return multiplied(ready, model.weights, alphas, size, _in_steps(trees, score), schema)


def predict(docs: DataFrame, x: DataFrame, model, candidates: list, depth: int) -> DataFrame:
    """``candidate, split, doc, path, confidence, margin[, n_tokens, n_known]`` for every document and candidate.

    ``docs``: ``split, doc``; ``x``: ``split, doc, tid, x``, and for the last two columns ``words``, with the terms
    outside the vocabulary as rows without a value; ``candidates``: ``(id, alpha, fit_prior, mode)``, which share the
    features and the counts.
    """
    listed = [(c[0], float(c[1]), bool(c[2]), c[3]) for c in candidates]
    alphas = list(dict.fromkeys(c[1] for c in listed))
    scored = _scored(
        docs, x, model, alphas, depth, _predictions(listed, alphas),
        "candidate int, split int, doc {doc}, code int, confidence array<double>, margin array<double>",
    )
    quality = [c for c in QUALITY if c in scored.columns]
    paths = model.classes.where(F.col("depth") == depth).select("split", "code", F.col("class").alias("path"))
    return scored.join(paths, ["split", "code"]).select(
        "candidate", "split", "doc", "path", "confidence", "margin", *quality
    )


def class_values(
    docs: DataFrame, x: DataFrame, model, what: str, alpha: float, fit_prior: bool, depth: int,
    called: Column | None = None,
) -> DataFrame:
    """The scores themselves, for a look inside: documents x classes rows by definition.

    ``what``: ``jll`` or ``proba`` of every class, the ``best`` class of every level, or the path scores of a mode,
    as ``split, doc, depth, class, value`` (no value for ``best``). ``called``: what a class is called there, its labels
    by default; it is made once for each class and not for each of the rows.
    """
    arrays = _scored(
        docs, x, model, [float(alpha)], depth, _values(what, float(alpha), fit_prior), "split int, doc {doc}, values array<double>"
    )
    names = model.classes.select("split", "code", "depth", (F.col("class") if called is None else called).alias("class"))
    if called is not None:
        names = written(names, "names")
    if what == "best":
        rows = arrays.select("split", "doc", F.explode(F.col("values").cast("array<int>")).alias("code"))
        return rows.join(names, ["split", "code"]).select("split", "doc", "depth", "class")
    if what not in ("jll", "proba"):
        first = Window.partitionBy("split")  # as many rows as the tree has classes
        names = names.where(F.col("depth") == depth).withColumn("code", F.col("code") - F.min("code").over(first))
    return (
        arrays.select("split", "doc", F.posexplode("values").alias("code", "value"))
        .join(names, ["split", "code"])
        .select("split", "doc", "depth", "class", "value")
    )
