"""Fitting and predicting: from documents to class tables, and from class tables to a prediction table.

A fit covers any number of splits in one job. Every table has a ``split`` column; a deployed model is split 0 with
nothing held out.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lists import CleaningSettings
from ..operators import bayes, features as ft, scoring
from ..operators.joins import attach_names
from ..operators.splits import train_splits
from ..session import written
from ..sources import store
from .prepare import clean_dataframe
from .settings import ModelSettings


@dataclass
class Model:
    """Fitted tables. Alpha, prior and mode are not in them: they are applied at prediction."""

    settings: ModelSettings
    levels: list[str]
    vocabulary: DataFrame  # split, term, df, total, idf, tid
    weights: DataFrame     # split, tid, code, fc
    classes: DataFrame     # split, code, depth, class, parent, n, total, n_features

    @property
    def depth(self) -> int:
        return len(self.levels)

    def valid_paths(self) -> DataFrame:
        """One row per path, a column per level."""
        deepest = self.classes.where(F.col("depth") == self.depth)
        return deepest.select("split", *[F.col("class")[i].alias(c) for i, c in enumerate(self.levels)])


@dataclass
class Documents:
    """Documents to fit on. A row names its group by number; the group holds the path and the splits it is tested in.

    The term table, the largest of all, then carries one number per row instead of two arrays. There are as many
    groups as the tree has paths, times the combinations of splits.
    """

    rows: DataFrame    # doc, text, grp
    groups: DataFrame  # grp, path, tests, n


def documents(df: DataFrame, key: str, text_col: str, levels, tests: Column | None = None) -> Documents:
    """Documents of an item table with a unique ``key``. ``tests``: the splits a row is held out in, none by default."""
    held = tests if tests is not None else F.array().cast("array<int>")
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    full = df.select(F.col(f"`{key}`").alias("doc"), text.alias("text"), bayes.path_of(levels).alias("path"), held.alias("tests"))
    sizes = full.groupBy("path", "tests").agg(F.count("*").alias("n"))
    groups = written(sizes.withColumn("grp", F.monotonically_increasing_id()), "groups")  # numbered once, then read
    return Documents(full.join(groups.drop("n"), ["path", "tests"]).select("doc", "text", "grp"), groups)


def terms_of(rows: DataFrame, settings: ModelSettings, quality: bool = True) -> DataFrame:
    """The term table of documents (``doc, text[, grp]``), once for all splits."""
    return ft.term_frequencies(rows, settings, [c for c in ("grp",) if c in rows.columns], quality)


def _training(docs: Documents, splits: list[int], n_splits: int) -> DataFrame:
    """``grp, split, path, n`` for every split a group trains in."""
    wanted = F.array_intersect(train_splits(n_splits), F.array(*[F.lit(s) for s in splits]))
    return docs.groups.select("grp", "path", "n", F.explode(wanted).alias("split"))


def held_out(df: DataFrame, docs: Documents, splits: list[int]) -> DataFrame:
    """Rows with a ``grp``, once per split they are tested in."""
    wanted = F.array_intersect("tests", F.array(*[F.lit(s) for s in splits]))
    return df.join(docs.groups.select("grp", F.explode(wanted).alias("split")), "grp").drop("grp")


@dataclass
class Terms:
    """What a fit counts before it looks at classes."""

    table: DataFrame       # doc, grp, term, tf[, words]
    kept: DataFrame        # grp, split, path, n: the groups a split trains on, with the rows of the path
    cells: DataFrame       # split, path, term, df, tf
    vocabulary: DataFrame  # split, term, df, total, idf


def learn_terms(
    docs: Documents, settings: ModelSettings, terms: DataFrame | None = None, n_splits: int = 1,
    splits: list[int] | None = None,
) -> Terms:
    """The vocabulary of every split, from its training rows without the paths that have too few of them.

    Documents and occurrences are counted per group before they are copied to the splits.
    """
    splits = list(range(n_splits)) if splits is None else splits
    if terms is None:
        terms = written(terms_of(docs.rows, settings, quality=False), "terms")
    training = _training(docs, splits, n_splits)
    per_path = training.groupBy("split", "path").agg(F.sum("n").alias("n")).where(
        F.col("n") >= settings.rare_path_threshold
    )
    kept = written(training.drop("n").join(per_path, ["split", "path"]), "kept")
    paths = kept.select("split", "path", "n").distinct()
    n_docs = written(paths.groupBy("split").agg(F.sum("n").alias("n_docs")), "n_docs")
    if n_docs.count() < len(splits):
        raise ValueError(f"rare_path_threshold={settings.rare_path_threshold} leaves no training rows")
    counted = ft.document_cells(terms.where("tf > 0"), settings.binary, ["grp"])
    cells = written(counted.join(kept.drop("n"), "grp").drop("grp"), "cells")
    return Terms(terms, kept, cells, written(ft.term_vocabulary(cells, n_docs, settings), "vocabulary"))


def fit(
    docs: Documents, settings: ModelSettings, levels, terms: DataFrame | None = None, n_splits: int = 1,
    splits: list[int] | None = None,
) -> Model:
    """Fit all splits. ``terms`` is the term table of the documents if it is at hand.

    Counts are sums of the cells. Only TF-IDF values, whose norm depends on the vocabulary of the split, are computed
    per document and split.
    """
    depth = len(levels)
    learned = learn_terms(docs, settings, terms, n_splits, splits)
    kept, vocabulary = learned.kept, learned.vocabulary
    paths = kept.select("split", "path", "n").distinct()
    if settings.vectorizer_kind == "count":
        rows = learned.cells.join(vocabulary.select("split", "term"), ["split", "term"]).select(
            "split", "path", "term", F.col("tf").cast("double").alias("x")
        )
    else:
        train = learned.table.where("tf > 0").select("doc", "grp", "term", "tf").join(kept.drop("n", "path"), "grp")
        summed = ft.features(train, vocabulary, settings).groupBy("split", "grp", "term").agg(F.sum("x").alias("x"))
        rows = summed.join(kept.select("split", "grp", "path"), ["split", "grp"])

    counts = written(bayes.class_term_counts(rows, depth), "counts")
    n_features = vocabulary.groupBy("split").agg(F.count("*").alias("n_features"))
    sizes = (
        bayes.prefixes(paths, depth)
        .groupBy("split", "depth", "class").agg(F.sum("n").alias("n"))
        .withColumn("parent", F.slice("class", F.lit(1), F.col("depth") - 1))
    )
    classes = written(bayes.coded(bayes.class_totals(sizes, counts, n_features)), "classes")
    vocabulary = bayes.keyed(vocabulary)
    weights = written(
        counts.join(classes.select("split", "depth", "class", "code"), ["split", "depth", "class"])
        .join(vocabulary.select("split", "term", "tid"), ["split", "term"])
        .select("split", "tid", "code", "fc"),
        "weights",
    )
    return Model(settings, list(levels), vocabulary, weights, classes)


def predict(
    model: Model, docs: DataFrame, terms: DataFrame, candidates: list[tuple] | None = None
) -> DataFrame:
    """``candidate, split, doc, path, confidence, margin, n_tokens, n_known``.

    ``docs``: ``split, doc``; ``terms``: their term table. ``candidates``: ``(id, alpha, fit_prior, mode)``, the
    model's own settings by default; all of them use the same counts.
    """
    s = model.settings
    candidates = candidates or [(0, s.alpha, s.fit_prior, s.prediction_mode)]
    x = ft.features(terms, model.vocabulary, s, unknown=True).select("split", "doc", "tid", "x", "words")
    return scoring.predict(docs, x, model, candidates, model.depth)


def class_values(
    model: Model, docs: DataFrame, terms: DataFrame, what: str, alpha: float | None = None,
    fit_prior: bool | None = None, called: Column | None = None,
) -> DataFrame:
    """``split, doc, depth, class, value``: see :func:`.scoring.class_values`."""
    s = model.settings
    x = ft.features(terms, model.vocabulary, s).select("split", "doc", "tid", "x")
    return scoring.class_values(
        docs, x, model, what, s.alpha if alpha is None else alpha, s.fit_prior if fit_prior is None else fit_prior,
        model.depth, called,
    )


def prediction_table(
    predicted: DataFrame, items: DataFrame, key: str, levels, id_cols=(), actual_cols=(), text_cols=(),
    split_col: str | None = None,
) -> DataFrame:
    """The fixed column order: identifiers, [split], [actual labels], predicted labels, confidences, margins, input
    quality, [texts]."""
    depth = len(levels)
    oov = F.when(F.col("n_tokens") > 0, 1 - F.col("n_known") / F.col("n_tokens")).otherwise(F.lit(1.0))
    beside = items.select(
        F.col(f"`{key}`").alias("_doc"),
        *[F.col(f"`{c}`") for c in dict.fromkeys(id_cols) if c in items.columns],
        *[F.col(f"`{c}`").alias(f"Actual {c}") for c in actual_cols],
        *[F.col(f"`{c}`").alias(f"_text_{c}") for c in text_cols if c in items.columns],
    )
    return predicted.join(beside, F.col("doc") == F.col("_doc")).select(
        *(["candidate"] if split_col else []),
        *[F.col(f"`{c}`") for c in dict.fromkeys(id_cols) if c in items.columns],
        *([F.col("split").alias(split_col)] if split_col else []),
        *[F.col(f"`Actual {c}`") for c in actual_cols],
        *[F.col("path")[i].alias(f"Predicted {c}") for i, c in enumerate(levels)],
        *[F.col("confidence")[i].alias(f"L{i + 1} Confidence") for i in range(depth)],
        *[F.col("margin")[i].alias(f"L{i + 1} Margin") for i in range(depth)],
        "n_tokens", "n_known", oov.alias("oov_rate"),
        *[F.col(f"`_text_{c}`").alias(c) for c in text_cols if c in items.columns],
    )


def batch_predict(
    model: Model, items: DataFrame, key: str, cleaned_col: str, id_cols=(), text_cols=()
) -> DataFrame:
    """Predictions of a saved model for new items. No row is dropped; labels are carried along if all are there."""
    text = F.coalesce(F.col(f"`{cleaned_col}`"), F.lit(""))
    rows = items.select(F.col(f"`{key}`").alias("doc"), text.alias("text"))
    terms = terms_of(rows, model.settings).withColumn("split", F.lit(0))
    predicted = predict(model, rows.select(F.lit(0).alias("split"), "doc"), terms)
    labelled = all(c in items.columns for c in model.levels)
    return prediction_table(
        predicted, items, key, model.levels, id_cols, model.levels if labelled else (), text_cols
    )


def predict_items(
    model: Model, vocabulary: DataFrame, items: DataFrame, key: str, text_col: str, cleaned_col: str,
    english: DataFrame, good_tokens: DataFrame, settings: CleaningSettings | None = None, id_cols=(),
    lookup: DataFrame | None = None, names=(),
) -> DataFrame:
    """Clean new items with the frozen vocabulary of a model and predict every one of them, with names if there is a
    lookup. Accuracy and bucket tables follow from the result when the items carry labels."""
    done = clean_dataframe(
        items, text_col, cleaned_col, english, good_tokens, settings, vocabulary, drop_empty=False
    )
    cleaned = written(done.items, "cleaned")  # read for the terms and for the columns beside the predictions
    pred = batch_predict(model, cleaned, key, cleaned_col, id_cols, [text_col, cleaned_col])
    return attach_names(pred, lookup, model.levels, names) if lookup is not None else pred


def predict_saved(
    spark: SparkSession, folder: str, items: DataFrame, key: str, text_col: str, cleaned_col: str, id_cols=(), names=()
) -> DataFrame:
    """As ``predict_items``, with nothing but a model folder that holds its cleaning state."""
    model, _, lookup, manifest = store.read_model(spark, folder)
    if not manifest.get("has_cleaning_state"):
        raise ValueError(f"the model in {folder} was stored without its cleaning state")
    state = store.read_cleaning(spark, f"{folder}/cleaning")
    return predict_items(
        model, state.vocabulary, items, key, text_col, cleaned_col, state.english, state.good_tokens, state.settings,
        id_cols, lookup, names,
    )
