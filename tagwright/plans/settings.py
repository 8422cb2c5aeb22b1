"""Model and evaluation settings, and the grid of candidates.

Each setting is declared once: its default, what values it takes, and what it acts on. Validation, the key of shared
features, the columns of the candidate table and the settings that must agree on resuming are read off that table.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FEATURES, MODEL = "features", "model"  # what a setting acts on: the counts, or only what is made of them


def setting(default, takes: str, check: Callable | None = None, acts_on: str = MODEL, only: dict | None = None):
    """A declared setting. ``only``: the values of other settings under which it has any effect."""
    return field(default=default, metadata={"takes": takes, "check": check, "acts_on": acts_on, "only": only or {}})


def _number(value, kind=(int, float)) -> bool:
    return isinstance(value, kind) and not isinstance(value, bool)


def _one_of(*values):
    return lambda v: v in values


class Declared:
    """Reads the declarations of a settings class."""

    @classmethod
    def names(cls) -> list[str]:
        return [f.name for f in fields(cls)]

    def _check(self) -> None:
        wrong = [
            f"{f.name} is {f.metadata['takes']}, not {getattr(self, f.name)!r}" for f in fields(self)
            if f.metadata["check"] and self._works(f) and not f.metadata["check"](getattr(self, f.name))
        ]
        if wrong:
            raise ValueError("; ".join(wrong))

    def _works(self, f) -> bool:
        return all(getattr(self, name) == value for name, value in f.metadata["only"].items())

    def working(self, acts_on: str | None = None) -> dict:
        """The settings that change the result, by name: those under whose conditions something happens."""
        chosen = [f for f in fields(self) if acts_on in (None, f.metadata["acts_on"])]
        return {f.name: getattr(self, f.name) for f in chosen if self._works(f)}


_TFIDF = {"vectorizer_kind": "tfidf"}


# Names and defaults of the settings below are an interface.
@dataclass(frozen=True)
class ModelSettings(Declared):
    """Features, naive Bayes and rare-path settings of one candidate."""

    vectorizer_kind: str = setting("tfidf", "'tfidf' or 'count'", _one_of("tfidf", "count"), FEATURES)
    max_features: int | None = setting(None, "a number of terms or None", None, FEATURES)
    ngram_range: tuple[int, int] = setting((1, 2), "(lo, hi) with 1 <= lo <= hi", lambda r: 1 <= r[0] <= r[1], FEATURES)
    min_df: int | float = setting(2, "a row count, or a share below 1", lambda v: not isinstance(v, float) or v < 1, FEATURES)
    max_df: int | float = setting(0.95, "a share, or a row count above 1", lambda v: not _number(v, int) or v > 1, FEATURES)
    stop_words: str | tuple[str, ...] | None = setting("english", "'english', a list or None", None, FEATURES)
    sublinear_tf: bool = setting(True, "true or false", None, FEATURES, _TFIDF)
    binary: bool = setting(False, "true or false", None, FEATURES)
    norm: str | None = setting("l2", "'l1', 'l2' or None", _one_of("l1", "l2", None), FEATURES, _TFIDF)
    use_idf: bool = setting(True, "true or false", None, FEATURES, _TFIDF)
    ordered_bigrams: bool = setting(True, "true or false", None, FEATURES)
    token_pattern: str = setting("whitespace", "the name of a pattern or a pattern", None, FEATURES)
    alpha: float = setting(0.001, "a positive number", lambda v: _number(v) and v > 0)
    fit_prior: bool = setting(True, "true or false")
    prediction_mode: str = setting(
        "conditional", "'independent', 'conditional' or 'flattened'", _one_of("independent", "conditional", "flattened")
    )
    rare_path_threshold: int = setting(5, "at least 1", lambda v: int(v) >= 1, FEATURES)

    def __post_init__(self):
        for name, value in vars(self).items():
            if isinstance(value, list):
                object.__setattr__(self, name, tuple(value))
        self._check()
        if not self.ordered_bigrams and 2 not in range(self.ngram_range[0], self.ngram_range[1] + 1):
            raise ValueError("without ordered bigrams ngram_range has to take in 2")

    def as_dict(self) -> dict:
        """For JSON: a range is a list there."""
        return {n: list(v) if n == "ngram_range" else v for n, v in ((n, getattr(self, n)) for n in self.names())}

    @classmethod
    def from_dict(cls, values: dict) -> ModelSettings:
        """From a stored dict; names that are no settings are passed over."""
        return cls(**{n: values[n] for n in cls.names() if n in values})

    def feature_key(self) -> str:
        """Candidates with the same key share features and counts."""
        return json.dumps(self.working(FEATURES), sort_keys=True)


def candidate_grid(spec: dict, grid_search: bool) -> list[ModelSettings]:
    """The candidates of a settings dict. Lists are searched, tuples are single values; every setting must be named.

    Candidates grow setting by setting in the order of the declarations. Where a setting has no effect, because of a
    value chosen before, its first value stands for all; so no two candidates come to the same model.
    """
    grown: list[dict] = [{}]
    for f in fields(ModelSettings):
        if f.name not in spec:
            raise KeyError(f"setting {f.name} is missing")
        given = spec[f.name]
        values = list({repr(v): v for v in given}.values()) if isinstance(given, list) else [given]
        if f.name == "ngram_range" and not all(isinstance(v, (list, tuple)) for v in values):
            raise ValueError("ngram_range is a tuple (lo, hi), or a list of such tuples to search")
        if len(values) != 1 and not grid_search:
            raise ValueError(f"without a grid search {f.name} has one value, not {len(values)}")
        grown = [
            {**chosen, f.name: v} for chosen in grown
            for v in (values if all(chosen[n] == needed for n, needed in f.metadata["only"].items()) else values[:1])
        ]
    unknown = sorted(set(spec) - set(ModelSettings.names()))
    if unknown:
        raise KeyError(f"no such settings: {unknown}")
    return [ModelSettings(**chosen) for chosen in grown]


_OOF, _HOLDOUT = {"cv_type": "oof"}, {"cv_type": "repeated_holdout"}


# Names and defaults of the settings below are an interface.
@dataclass(frozen=True)
class SplitSettings(Declared):
    """How an evaluation splits the items."""

    cv_type: str = setting("oof", "'oof' or 'repeated_holdout'", _one_of("oof", "repeated_holdout"))
    n_folds: int = setting(5, "at least 2", lambda v: v >= 2, only=_OOF)
    fold_method: str = setting("id_hash", "'id_hash' or 'stratified'", _one_of("id_hash", "stratified"), only=_OOF)
    fold_key_col: str = setting("ID", "a column", only={**_OOF, "fold_method": "id_hash"})
    fold_seed: int = setting(0, "a number", only=_OOF)
    n_repeats: int = setting(5, "a number", only=_HOLDOUT)
    test_size: float = setting(0.2, "between 0 and 1", lambda v: 0 < v < 1, only=_HOLDOUT)
    holdout_seed: int = setting(42, "a number", only=_HOLDOUT)

    def __post_init__(self):
        object.__setattr__(self, "cv_type", self.cv_type.lower())
        self._check()

    @property
    def folds(self) -> bool:
        return self.cv_type == "oof"

    @property
    def n_splits(self) -> int:
        return self.n_folds if self.folds else self.n_repeats

    @property
    def split_col(self) -> str:
        return "fold" if self.folds else "repeat"

    def relevant(self) -> dict:
        """The settings that matter for this kind of split; they must agree when an evaluation is resumed."""
        return self.working()


def candidates_frame(spark: SparkSession, candidates: list[ModelSettings]) -> DataFrame:
    """One row of settings per candidate, as text."""
    names = ModelSettings.names()

    def row(number: int, c: ModelSettings) -> tuple:
        values = c.as_dict()
        return (number, *(None if values[n] is None else str(values[n]) for n in names), c.feature_key())

    schema = "candidate int, " + ", ".join(f"{n} string" for n in [*names, "key"])
    return spark.createDataFrame([row(i, c) for i, c in enumerate(candidates)], schema)


def varying_settings(frame: DataFrame) -> DataFrame:
    """``setting, n_values`` for the setting columns with more than one value."""
    names = [c for c in frame.columns if c not in ("candidate", "key")]
    counted = frame.agg(*[F.count_distinct(F.coalesce(F.col(n), F.lit("\x00"))).alias(n) for n in names])
    return counted.unpivot([], names, "setting", "n_values").where("n_values > 1")
