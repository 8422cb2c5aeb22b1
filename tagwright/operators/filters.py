"""Row filters and column selections. Each that drops rows has a counting twin, or returns counts lazily."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..session import written
from .running import running_totals


def project_items(df: DataFrame, *more: Column) -> DataFrame:
    """Item columns from the joined source tables: upper case, ``;`` as space, and a joined product line that is null
    if one of its parts is. Expects ``id, cono, product, descrip, vendor, prodcat, unspsc, prodline``."""
    return df.select(
        F.col("id").alias("ID"),
        F.col("cono").alias("Cono"),
        F.upper("product").alias("Product ID"),
        F.upper(F.replace("descrip", F.lit(";"), F.lit(" "))).alias("FullDesc"),
        F.upper("vendor").alias("Vendor"),
        F.upper("prodcat").alias("Prodcat"),
        F.upper("unspsc").alias("UNSPSC"),
        F.concat("cono", F.lit("_"), F.upper("vendor"), F.lit("_"), F.upper("prodline")).alias("Prodline"),
        *more,
    )


def filter_current(
    df: DataFrame, flag: str, companies: tuple[str, list] | None = None, present: tuple[str, ...] = (),
    label: str | None = None, labelled: bool | None = None,
) -> DataFrame:
    """Current rows, of the given companies, with the given columns present, with or without a label."""
    keep = F.col(flag) == 1
    if companies:
        keep &= F.col(companies[0]).isin(companies[1])
    for column in present:
        keep &= F.col(column).isNotNull()
    if label and labelled is not None:
        keep &= F.col(label).isNotNull() if labelled else F.col(label).isNull()
    return df.where(keep)


def _require(df: DataFrame, columns) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise KeyError(f"columns {missing} are not in {df.columns}")


def labels_present(levels) -> Column:
    """All level columns have a label."""
    return reduce(lambda a, b: a & b, [~tx.is_blank(F.col(f"`{c}`").cast("string")) for c in levels])


def drop_missing_labels(df: DataFrame, levels) -> DataFrame:
    _require(df, levels)
    return df.where(labels_present(levels))


def drop_blank_text(df: DataFrame, text_col: str) -> DataFrame:
    _require(df, [text_col])
    return df.where(~tx.is_blank(F.col(f"`{text_col}`").cast("string")))


def keep_columns(df: DataFrame, columns, required=()) -> DataFrame:
    """The named columns that exist, once each, in order; ``required`` ones must exist."""
    _require(df, required)
    return df.select([F.col(f"`{c}`") for c in dict.fromkeys(columns) if c in df.columns])


def row_number_id(df: DataFrame, key: str, name: str = "_row") -> DataFrame:
    """A row number from 0 in key order, the same on every run."""
    return running_totals(df, [], [F.col(f"`{key}`")], {name: F.lit(1)}).withColumn(name, F.col(name) - 1)


def path_counts(df: DataFrame, levels) -> DataFrame:
    """Rows per full path; null labels are a group of their own."""
    return df.groupBy([F.col(f"`{c}`") for c in levels]).agg(F.count("*").alias("n"))


def filter_rare_paths(df: DataFrame, levels, threshold: int) -> DataFrame:
    """Rows whose full path has at least ``threshold`` rows.

    Counted first and joined back, so a path with a third of all rows is combined before the shuffle; a window over
    the path would bring those rows into one task.
    """
    _require(df, levels)
    frequent = path_counts(df, levels).where(F.col("n") >= threshold)
    # written, so that the join knows the size of the tree before it decides to shuffle the rows
    kept = written(frequent.select([F.col(f"`{c}`").alias(f"_p{i}") for i, c in enumerate(levels)]), "kept")
    same = reduce(
        lambda a, b: a & b, [df[f"`{c}`"].eqNullSafe(kept[f"_p{i}"]) for i, c in enumerate(levels)]
    )
    return df.join(kept, same, "left_semi")


def rare_path_info(df: DataFrame, levels, threshold: int) -> DataFrame:
    """One row: rows and distinct paths before and after the rare-path filter."""
    kept = F.col("n") >= threshold
    total = F.coalesce(F.sum("n"), F.lit(0))
    after = F.coalesce(F.sum(F.when(kept, F.col("n"))), F.lit(0))
    return path_counts(df, levels).agg(
        F.lit(threshold).alias("rare_path_threshold"),
        total.alias("rows_before"),
        (total - after).alias("rows_dropped"),
        after.alias("rows_after"),
        F.count("*").alias("paths_before"),
        F.count_if(kept).alias("paths_after"),
    )


def duplicate_count(df: DataFrame, column: str) -> DataFrame:
    """One row: the rows whose key occurs more than once."""
    sizes = df.groupBy(F.col(f"`{column}`")).agg(F.count("*").alias("n"))
    return sizes.agg(F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("duplicates"))


def sample_rows(df: DataFrame, key: str, n: int = 15, seed: int = 0) -> DataFrame:
    """``n`` rows in an order given by key and seed."""
    return df.orderBy(F.sha1(F.concat_ws("|", F.lit(str(seed)), F.col(f"`{key}`").cast("string"))), key).limit(n)
