"""Cross-validation of a grid of candidates, all splits of a candidate group in one job, resumable."""

from __future__ import annotations

import json
import os
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluation as ev
from ..operators import joins
from ..operators.filters import keep_columns
from ..operators.splits import id_hash_sample, make_splits
from ..session import written
from ..sources import store
from ..sources.runlog import RunLog
from .model import documents, fit, held_out, predict, prediction_table, terms_of
from .settings import ModelSettings, SplitSettings, candidates_frame


def candidate_groups(candidates: list[ModelSettings]) -> dict[str, list[int]]:
    """Candidates by feature key; a group shares features and counts."""
    groups: dict[str, list[int]] = {}
    for i, c in enumerate(candidates):
        groups.setdefault(c.feature_key(), []).append(i)
    return groups


def pending_work(spark: SparkSession, n_candidates: int, n_splits: int, done: DataFrame | None) -> DataFrame:
    """``candidate, split`` pairs without a result."""
    every = spark.range(n_candidates).select(
        F.col("id").cast("int").alias("candidate"),
        F.explode(F.sequence(F.lit(0), F.lit(n_splits - 1))).alias("split"),
    )
    return every if done is None else every.join(done.select("candidate", "split"), ["candidate", "split"], "left_anti")


def cross_validate(
    items: DataFrame, key: str, cleaned_col: str, levels, candidates: list[ModelSettings], cv: SplitSettings,
    id_cols=(), pending: dict[int, set[int]] | None = None,
) -> list[DataFrame]:
    """One prediction table per group of candidates that share features; together all pending (candidate, split).

    Splits are made on all items. Per split, rare paths leave the training part only, and vocabulary and counts come
    from the training part only; every held-out row is predicted.
    """
    pending = pending or {i: set(range(cv.n_splits)) for i in range(len(candidates))}
    placed = make_splits(items, cv, key, levels[-1])
    docs = documents(placed, key, cleaned_col, levels, F.col("tests"))
    out = []
    for members in candidate_groups(candidates).values():
        splits = sorted(set().union(*[pending.get(i, set()) for i in members]))
        if not splits:
            continue
        base = candidates[members[0]]
        terms = written(terms_of(docs.rows, base), "terms")
        model = fit(docs, base, levels, terms, cv.n_splits, splits)
        predicted = predict(
            model, held_out(docs.rows.select("doc", "grp"), docs, splits), held_out(terms, docs, splits),
            [(i, candidates[i].alpha, candidates[i].fit_prior, candidates[i].prediction_mode) for i in members],
        )
        wanted = [
            (F.col("candidate") == i) & F.col("split").isin(sorted(pending.get(i, set()))) for i in members
        ]
        keep = wanted[0]
        for w in wanted[1:]:
            keep |= w
        out.append(
            prediction_table(predicted.where(keep), items, key, levels, [key, *id_cols], levels, split_col=cv.split_col)
        )
    return out


class Evaluation:
    """An evaluation folder: settings, the evaluated items, and one partition of predictions per (candidate, split)."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.config = store.read_json(spark, f"{self.folder}/config.json")
        self.cv = SplitSettings(**self.config["cv"])
        self.columns = self.config["columns"]
        self.candidates = [ModelSettings.from_dict(c) for c in self.config["candidates"]]

    @property
    def levels(self) -> list[str]:
        return self.columns["levels"]

    @property
    def items(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/items")

    @classmethod
    def create(
        cls, items: DataFrame, candidates: list[ModelSettings], cv: SplitSettings, folder: str, *, key: str,
        text_col: str, cleaned_col: str, levels, names=(), id_cols=(), sample_frac: float | None = None,
        sample_seed: int = 0, source: dict | None = None, cleaning: dict | None = None,
    ) -> "Evaluation":
        """Store the items and settings. ``sample_frac`` keeps about that share of the items, by key."""
        hashed = cv.cv_type == "oof" and cv.fold_method == "id_hash"
        kept = keep_columns(
            items, [key, *id_cols, cv.fold_key_col, *levels, *names, text_col, cleaned_col],
            required=[key, *levels, text_col, cleaned_col, *([cv.fold_key_col] if hashed else [])],
        )
        if sample_frac is not None and sample_frac < 1:
            kept = id_hash_sample(kept, cv.fold_key_col if cv.fold_key_col in kept.columns else key, sample_frac, sample_seed)
        spark = items.sparkSession
        kept.write.parquet(f"{folder}/items")  # an existing evaluation is not overwritten
        config = {
            "cv": asdict(cv), "candidates": [c.as_dict() for c in candidates],
            "columns": {
                "key": key, "text_col": text_col, "cleaned_col": cleaned_col, "levels": list(levels),
                "names": [n for n in names if n in items.columns], "id_cols": list(id_cols),
            },
            "sample_frac": sample_frac, "sample_seed": sample_seed if sample_frac is not None else None,
            "source": source, "cleaning": cleaning,
        }
        store.write_json(spark, config, f"{folder}/config.json")
        return cls(spark, folder)

    @classmethod
    def open(
        cls, spark: SparkSession, folder: str, candidates: list[ModelSettings] | None = None,
        cv: SplitSettings | None = None,
    ) -> "Evaluation":
        """Resume: the split settings must agree, new candidates are appended."""
        found = cls(spark, folder)
        if cv is not None and cv.relevant() != found.cv.relevant():
            raise ValueError(f"split settings differ: saved {found.cv.relevant()}, given {cv.relevant()}")
        have = {json.dumps(c.working(), sort_keys=True) for c in found.candidates}
        new = [c for c in candidates or [] if json.dumps(c.working(), sort_keys=True) not in have]
        if new:
            found.candidates += new
            found.config["candidates"] = [c.as_dict() for c in found.candidates]
            store.write_json(spark, found.config, f"{found.folder}/config.json")
        return found

    @property
    def log(self) -> RunLog:
        return RunLog(self.spark, f"{self.folder}/predictions")

    def _results(self) -> DataFrame | None:
        return self.log.results()

    def pending(self) -> DataFrame:
        """Pairs without a result, by the log alone."""
        return pending_work(self.spark, len(self.candidates), self.cv.n_splits, self.log.finished())

    def run(self) -> DataFrame:
        """Predict every pending pair; each group of candidates is written by one job and committed when it is whole.

        Several writers may run at once: a pair belongs to the one that commits it first. A run that dies leaves no result.
        """
        pending: dict[int, set[int]] = {}
        for row in self.pending().collect():  # candidates x splits
            pending.setdefault(row.candidate, set()).add(row.split)
        if pending:
            c, log, run = self.columns, self.log, RunLog.new_run()
            for table in cross_validate(
                self.items, c["key"], c["cleaned_col"], self.levels, self.candidates, self.cv, c["id_cols"], pending
            ):
                log.write(run, table.withColumnRenamed(self.cv.split_col, "split"))
            # pairs without a held-out row are finished too
            log.commit(run, [(candidate, s) for candidate, splits in pending.items() for s in splits])
        return self.results()

    def predictions(self, candidate: int, with_text: bool = True) -> DataFrame:
        """Out-of-sample predictions of a candidate in order of split and key."""
        c = self.columns
        pred = self._results().where(F.col("candidate") == candidate).drop("candidate")
        others = [F.col(f"`{n}`") for n in pred.columns if n not in ("split", c["key"])]
        pred = pred.select(F.col(f"`{c['key']}`"), F.col("split").alias(self.cv.split_col), *others)
        if with_text:
            pred = joins.attach_text(pred, self.items.select(c["key"], c["text_col"], c["cleaned_col"]), c["key"])
        return pred.orderBy(self.cv.split_col, c["key"])

    def split_metrics(self) -> DataFrame:
        return ev.split_metrics(
            self._results().withColumnRenamed("split", self.cv.split_col), self.levels, self.cv.split_col
        )

    def results(self) -> DataFrame:
        frame = candidates_frame(self.spark, self.candidates)
        return ev.grid_results(self.split_metrics(), frame, self.cv.n_splits, self.cv.split_col)

    def best(self, metric: str) -> tuple[int, ModelSettings]:
        row = ev.best_candidate(self.results(), metric).first()
        return row.candidate, self.candidates[row.candidate]

    def headline(self, candidate: int) -> DataFrame:
        return ev.headline(self.predictions(candidate, False), self.levels, self.cv.split_col)

    def export(self, candidate: int, folder: str | None = None) -> str:
        """The candidate's predictions as delimited text, with names, and a settings file beside them."""
        c = self.columns
        pred = self.predictions(candidate)
        if c["names"]:
            pred = joins.attach_names(
                pred, joins.distinct_lookup(self.items, self.levels, c["names"]), self.levels, c["names"]
            )
        kind = "oof" if self.cv.cv_type == "oof" else "holdout"
        path = os.path.join(folder or f"{self.folder}/best", f"{kind}_predictions")
        record = {
            "evaluation": self.folder, "candidate": candidate, "cv": asdict(self.cv),
            "n_folds": self.cv.n_folds if kind == "oof" else None, "level_columns": self.levels,
            "hyperparameters": self.candidates[candidate].as_dict(), "sample_frac": self.config["sample_frac"],
            "cleaning": self.config["cleaning"], "source": self.config["source"],
        }
        return store.write_predictions(pred, path, record)
