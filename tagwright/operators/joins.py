"""Joins of items with the category tree, blacklists, names and texts.

No side is broadcast by hint here: the optimiser does it for sides it knows to be small (written tables carry their
file size, and adaptive execution re-checks after each shuffle) and splits skewed keys otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..session import written
from .filters import filter_current, project_items


def flatten_hierarchy(tree: DataFrame, depth: int = 4, flag: str | None = None) -> DataFrame:
    """``id, name, parent_id, level`` rows as one row per full path: ``Level d ID`` and ``Level d Name``."""
    current = tree.where(F.col(flag) == 1) if flag else tree
    paths = None
    for d in range(1, depth + 1):
        nodes = current.where(F.col("level") == d).select(
            F.col("id").alias(f"Level {d} ID"), F.col("name").alias(f"Level {d} Name"),
            F.col("parent_id").alias("_parent"),
        )
        if paths is None:
            paths = nodes.drop("_parent")
        else:
            paths = paths.join(nodes, F.col(f"Level {d - 1} ID") == F.col("_parent"), "left").drop("_parent")
    return paths.where(F.col(f"Level {depth} ID").isNotNull())


def _base_items(sku: DataFrame, master: DataFrame, stock: DataFrame, companies, warehouses, labelled: bool) -> DataFrame:
    """Items with their master record, and a product line where a warehouse of the list stocks them.

    The conditions on the stock table belong to the join: an item without such a warehouse stays, an item in two of
    them appears twice.
    """
    sku = filter_current(sku, "st_row_current", label="category_id", labelled=labelled)
    master = filter_current(master, "st_row_current", ("cono", companies), present=("descrip",)).select(
        "product", "descrip", "prodcat", "unspsc"
    )
    stock = stock.where(
        (F.col("st_row_current") == 1) & (F.col("cono") == 1) & F.upper("whse").isin(warehouses)
    ).select("product", "prodline")
    return sku.drop("st_row_current").join(master, "product").join(stock, "product", "left")


def labeled_items(
    sku: DataFrame, master: DataFrame, stock: DataFrame, paths: DataFrame,
    companies=(1, 55), warehouses=("ZDAT", "FC"), depth: int = 4,
) -> DataFrame:
    """Labelled items with their category path. ``sku``: ``id, cono, product, category_id, vendor, st_row_current``;
    ``master``: ``product, cono, descrip, prodcat, unspsc, st_row_current``; ``stock``: ``product, cono, whse,
    prodline, st_row_current``; ``paths`` from :func:`flatten_hierarchy`."""
    base = _base_items(sku, master, stock, list(companies), list(warehouses), True)
    items = project_items(base, F.col("category_id").alias("category_l4_id"))
    return items.join(paths, F.col("category_l4_id") == F.col(f"Level {depth} ID"))


def unlabeled_items(
    sku: DataFrame, master: DataFrame, stock: DataFrame, companies=(1, 55), warehouses=("ZDAT", "FC")
) -> DataFrame:
    """The same items without a label and without a path."""
    return project_items(_base_items(sku, master, stock, list(companies), list(warehouses), False))


def apply_blacklist(df: DataFrame, items: DataFrame, column: str) -> DataFrame:
    """Rows whose trimmed key is not in ``items`` (column ``item``); rows without a key stay."""
    if column not in df.columns:
        raise KeyError(f"{column!r} is not in {df.columns}")
    key = tx.strip_space(F.col(f"`{column}`").cast("string"))
    # a null key matches nothing; it is replaced by the row's own hash so that such rows spread over the tasks
    spread = F.concat(F.lit("\x00"), F.xxhash64(F.struct("*")).cast("string"))
    return (
        df.withColumn("_key", F.coalesce(key, spread))
        .join(items.select(F.col("item").alias("_key")), "_key", "left_anti")
        .drop("_key")
    )


def distinct_lookup(df: DataFrame, levels, names) -> DataFrame:
    """Distinct rows of level identifiers and names."""
    return df.select([F.col(f"`{c}`") for c in [*levels, *names]]).distinct()


def attach_names(pred: DataFrame, lookup: DataFrame, levels, names) -> DataFrame:
    """``Predicted <name>`` behind the predicted identifiers; one name per identifier, null where none is known."""
    out = pred
    added = []
    for level, name in zip(levels, names):
        if level not in lookup.columns or name not in lookup.columns:
            continue
        one = (
            lookup.where(F.col(f"`{level}`").isNotNull() & F.col(f"`{name}`").isNotNull())
            .groupBy(F.col(f"`{level}`").alias("_id")).agg(F.min(f"`{name}`").alias(f"Predicted {name}"))
        )
        # written, so that the join knows the size of the names before it decides to shuffle the predictions
        out = out.join(written(one, "names"), F.col(f"`Predicted {level}`") == F.col("_id"), "left").drop("_id")
        added.append(f"Predicted {name}")
    at = pred.columns.index(f"Predicted {levels[-1]}") + 1
    order = pred.columns[:at] + added + pred.columns[at:]
    return out.select([F.col(f"`{c}`") for c in order])


def attach_text(pred: DataFrame, texts: DataFrame, key: str) -> DataFrame:
    """Raw and cleaned text back beside the predictions."""
    return pred.join(texts, key, "left")
