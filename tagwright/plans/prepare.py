"""Preparation of an item table: filters, cleaning, and the counts that go with them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.lists import CleaningSettings
from ..operators.cleaning import Cleaned, clean_items
from ..operators.features import ngram_stats
from ..operators.filters import drop_blank_text, drop_missing_labels, labels_present
from ..operators.joins import apply_blacklist
from ..session import written
from ..sources import scan


def cleaning_settings(
    spark: SparkSession, units: str | None = None, colors=(), sizes: str | None = None, **values
) -> CleaningSettings:
    """Settings with lists read from files; what is not given keeps its default. Patterns are made on the driver."""
    if units:
        values["units"] = scan.unit_list(scan.scan_units(spark, units))
    if colors:
        values["colors"] = [t for path in colors for t in scan.term_list(scan.scan_terms(spark, path))]
    if sizes:
        values["sizes"] = scan.term_list(scan.scan_terms(spark, sizes))
    return CleaningSettings(**values)


def clean_dataframe(
    df: DataFrame, text_col: str, cleaned_col: str, english: DataFrame, good_tokens: DataFrame,
    settings: CleaningSettings | None = None, vocabulary: DataFrame | None = None, drop_empty: bool = True,
) -> Cleaned:
    """Clean the items. ``drop_empty`` drops blank texts before and emptied ones after (training); prediction keeps
    every row."""
    kept = drop_blank_text(df, text_col) if drop_empty else df
    done = clean_items(kept, text_col, cleaned_col, english, good_tokens, settings, vocabulary)
    return done._replace(items=drop_blank_text(done.items, cleaned_col)) if drop_empty else done


def _added_up(*rows: DataFrame) -> DataFrame:
    """One-row frames side by side: their union, summed per column."""
    stacked = rows[0]
    for row in rows[1:]:
        stacked = stacked.unionByName(row, allowMissingColumns=True)
    return stacked.agg(*[F.sum(c).alias(c) for c in stacked.columns])


def prepare_items(
    items: DataFrame, text_col: str, cleaned_col: str, english: DataFrame, good_tokens: DataFrame,
    settings: CleaningSettings | None = None, vocabulary: DataFrame | None = None,
    blacklist: DataFrame | None = None, blacklist_col: str | None = None, levels=(), drop_empty: bool = True,
) -> tuple[Cleaned, DataFrame]:
    """Blacklist, label filter and cleaning. Returns the cleaned items and one row of counts.

    The steps that drop rows are counted in two aggregations, one over the input and one over the result.
    """
    listed = items
    if blacklist is not None:
        if blacklist_col is None:
            raise ValueError("name the column the blacklist is matched with")
        listed = written(apply_blacklist(items, blacklist, blacklist_col), "listed")
    labelled = drop_missing_labels(listed, levels) if levels else listed
    done = clean_dataframe(
        labelled, text_col, cleaned_col, english, good_tokens, settings, vocabulary, drop_empty
    )
    out = written(done.items, "prepared")
    has_label = labels_present(levels) if levels else F.lit(True)
    blank = tx.is_blank(F.col(f"`{text_col}`").cast("string")) if drop_empty else F.lit(False)
    before = listed.agg(
        F.count("*").alias("listed"),
        F.count_if(~has_label).alias("missing_label_dropped"),
        F.count_if(has_label & blank).alias("blank_raw_dropped"),
    )
    seen = _added_up(
        items.agg(F.count("*").alias("raw_rows")), before, out.agg(F.count("*").alias("cleaned_rows"))
    )
    dropped = F.col("listed") - F.col("missing_label_dropped") - F.col("blank_raw_dropped") - F.col("cleaned_rows")
    counts = seen.select(
        "raw_rows",
        (F.col("raw_rows") - F.col("listed")).alias("blacklisted_dropped"),
        "missing_label_dropped",
        "blank_raw_dropped",
        dropped.alias("emptied_by_cleaning_dropped"),
        "cleaned_rows",
        (F.col("raw_rows") - F.col("cleaned_rows")).alias("total_dropped"),
    )
    return done._replace(items=out), counts


def blacklist_prepared(
    prepared: DataFrame, counts: DataFrame, blacklist: DataFrame, column: str
) -> tuple[DataFrame, DataFrame]:
    """A blacklist on an already prepared set, with the counts brought up to date."""
    out = written(apply_blacklist(prepared, blacklist, column), "listed")
    updated = _added_up(counts, out.agg(F.count("*").alias("_left"))).select(
        "raw_rows",
        (F.col("blacklisted_dropped") + F.col("cleaned_rows") - F.col("_left")).alias("blacklisted_dropped"),
        "missing_label_dropped", "blank_raw_dropped", "emptied_by_cleaning_dropped",
        F.col("_left").alias("cleaned_rows"),
        (F.col("raw_rows") - F.col("_left")).alias("total_dropped"),
    )
    return out, updated


def item_statistics(prepared: DataFrame, cleaned_col: str) -> DataFrame:
    return ngram_stats(prepared, cleaned_col)
