"""Writing and reading data sets, vocabularies, models, predictions and evaluation results.

Everything is a folder of Parquet or text files plus a JSON document, written by Spark, so any shared file system
will do. No code is stored.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from ..functions.lists import CleaningSettings
from .scan import DELIMITER, scan_delimited


def write_json(spark: SparkSession, value: Any, path: str) -> None:
    text = json.dumps(value, indent=2, sort_keys=True, default=str)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_json(spark: SparkSession, path: str) -> Any:
    return json.loads(spark.read.text(path, wholetext=True).first().value)


# ---- data sets ------------------------------------------------------------------------------------------------

def write_delimited(df: DataFrame, path: str, delimiter: str = DELIMITER) -> None:
    (
        df.write.mode("overwrite").option("header", True).option("sep", delimiter)
        .option("quote", '"').option("escape", '"').option("emptyValue", "").option("nullValue", "")
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    )


def write_dataset(
    folder: str, cleaned: DataFrame, vocabulary: DataFrame, metadata: dict, raw: DataFrame | None = None,
    delimiter: str = DELIMITER,
) -> dict:
    """Raw and cleaned items as delimited text, the vocabulary, and what is known about them."""
    files = {"cleaned": "cleaned_data.txt", "vocabulary": "vocabulary.txt"}
    if raw is not None:
        files["raw"] = "raw_data.txt"
        write_delimited(raw, f"{folder}/{files['raw']}", delimiter)
    write_delimited(cleaned, f"{folder}/{files['cleaned']}", delimiter)
    write_vocabulary(vocabulary, f"{folder}/{files['vocabulary']}")
    record = {**metadata, "files": files, "delimiter": delimiter}
    write_json(cleaned.sparkSession, record, f"{folder}/metadata.json")
    return record


def latest_folder(spark: SparkSession, parent: str) -> str:
    """The sub-folder of ``parent`` with the highest name that starts with a date; names are time stamps."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(parent)
    listed = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(root)
    names = sorted(
        s.getPath().getName() for s in listed if s.isDirectory() and s.getPath().getName().split("_")[-2:][0][:8].isdigit()
    )
    if not names:
        raise FileNotFoundError(f"no dated folder in {parent}")
    return f"{parent}/{names[-1]}"


def read_dataset(spark: SparkSession, folder: str, name: str | None = None) -> tuple[DataFrame, DataFrame, dict]:
    """Cleaned items, vocabulary and metadata. ``name="latest"`` picks the newest folder below ``folder``."""
    if name is not None:
        folder = latest_folder(spark, folder) if name.lower() == "latest" else f"{folder}/{name}"
    meta = read_json(spark, f"{folder}/metadata.json")
    items = scan_delimited(spark, f"{folder}/{meta['files']['cleaned']}", meta["delimiter"])
    if meta.get("cleaned_col"):
        items = items.fillna("", [meta["cleaned_col"]])
    return items, read_vocabulary(spark, f"{folder}/{meta['files']['vocabulary']}"), meta


def write_vocabulary(vocabulary: DataFrame, path: str) -> None:
    """``word<TAB>descriptions`` with a header. Words hold no whitespace, so nothing is quoted."""
    (
        vocabulary.select("word", "descriptions").write.mode("overwrite")
        .option("header", True).option("sep", "\t").option("quote", "").option("escape", "").csv(path)
    )


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    return (
        spark.read.option("header", True).option("sep", "\t").option("quote", "").option("escape", "")
        .schema("word string, descriptions bigint").csv(path)
    )


# ---- the state of cleaning ------------------------------------------------------------------------------------

@dataclass
class CleaningState:
    """All that cleaning depends on beside the items. Stored with a data set or a model, so that new items are cleaned
    as the training items were."""

    settings: CleaningSettings
    english: DataFrame      # word
    good_tokens: DataFrame  # term
    vocabulary: DataFrame   # word, descriptions


def write_cleaning(state: CleaningState, folder: str) -> None:
    for name, column in (("english", "word"), ("good_tokens", "term")):
        getattr(state, name).select(column).distinct().write.mode("overwrite").parquet(f"{folder}/{name}")
    state.vocabulary.select("word", "descriptions").write.mode("overwrite").parquet(f"{folder}/vocabulary")
    write_json(state.vocabulary.sparkSession, state.settings.as_dict(), f"{folder}/settings.json")


def read_cleaning(spark: SparkSession, folder: str) -> CleaningState:
    settings = CleaningSettings.from_dict(read_json(spark, f"{folder}/settings.json"))
    return CleaningState(settings, *(spark.read.parquet(f"{folder}/{n}") for n in ("english", "good_tokens", "vocabulary")))


# ---- models ---------------------------------------------------------------------------------------------------

TABLES = ("vocabulary", "weights", "classes")


def model_shape(model) -> dict:
    """What a model consists of, by size."""
    per_level = {
        r.depth: r["count"] for r in model.classes.groupBy("depth").count().collect()  # one row per level
    }
    return {
        "n_features": model.vocabulary.count(),
        "levels": model.levels,
        "n_paths": per_level.get(model.depth, 0),
        "classes": [per_level.get(d, 0) for d in range(1, model.depth + 1)],
    }


def fingerprint(shape: dict) -> str:
    return hashlib.sha256(json.dumps(shape, sort_keys=True).encode()).hexdigest()[:16]


def write_model(
    model, folder: str, cleaning_vocabulary: DataFrame | None = None, lookup: DataFrame | None = None,
    metadata: dict | None = None, cleaning: dict | None = None, state: CleaningState | None = None,
) -> dict:
    """The model's tables and a manifest; with ``state`` also all that is needed to clean new items (``cleaning/``)."""
    spark = model.classes.sparkSession
    if state is not None:
        write_cleaning(state, f"{folder}/cleaning")
    for table in TABLES:
        getattr(model, table).write.mode("overwrite").parquet(f"{folder}/{table}")
    if cleaning_vocabulary is not None:
        cleaning_vocabulary.write.mode("overwrite").parquet(f"{folder}/cleaning_vocabulary")
    if lookup is not None:
        lookup.distinct().write.mode("overwrite").parquet(f"{folder}/lookup")
    shape = model_shape(model)
    manifest = {
        "fingerprint": fingerprint(shape), **shape, "settings": model.settings.as_dict(),
        "training": metadata or {}, "cleaning": cleaning or {},
        "has_cleaning_vocabulary": cleaning_vocabulary is not None, "has_lookup": lookup is not None,
        "has_cleaning_state": state is not None,
    }
    write_json(spark, manifest, f"{folder}/manifest.json")
    return manifest


def read_model(spark: SparkSession, folder: str, verify: bool = True):
    """The model, the cleaning vocabulary, the name lookup and the manifest; tables that do not fit the manifest are
    an error."""
    from ..plans.model import Model
    from ..plans.settings import ModelSettings

    manifest = read_json(spark, f"{folder}/manifest.json")
    tables = {t: spark.read.parquet(f"{folder}/{t}") for t in TABLES}
    model = Model(ModelSettings.from_dict(manifest["settings"]), manifest["levels"], **tables)
    if verify and fingerprint(model_shape(model)) != manifest["fingerprint"]:
        raise ValueError(f"the model in {folder} does not match its manifest")
    words = spark.read.parquet(f"{folder}/cleaning_vocabulary") if manifest["has_cleaning_vocabulary"] else None
    lookup = spark.read.parquet(f"{folder}/lookup") if manifest["has_lookup"] else None
    return model, words, lookup, manifest


# ---- predictions ----------------------------------------------------------------------------------------------

def write_predictions(pred: DataFrame, path: str, record: dict) -> str:
    """Comma-separated predictions, and a JSON document beside them."""
    write_delimited(pred, f"{path}.csv", ",")
    write_json(pred.sparkSession, record, f"{path}.json")
    return f"{path}.csv"


def exists(spark: SparkSession, path: str) -> bool:
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(found)


def union_splits(tables: list[DataFrame]) -> DataFrame:
    """Split results one below the other, by column name."""
    out = tables[0]
    for table in tables[1:]:
        out = out.unionByName(table)
    return out
