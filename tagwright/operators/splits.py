"""Folds, samples and holdouts that depend on the item key only, never on the order or partitioning of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from .running import running_totals
from .selection import kth_rows


def _halves(*parts: Column) -> tuple[Column, Column]:
    """First 8 bytes of the SHA-1 of the parts joined by ``|``, as two unsigned 32-bit numbers."""
    digest = F.sha1(F.concat_ws("|", *parts))
    return tuple(F.conv(F.substring(digest, at, 8), 16, 10).cast("bigint") for at in (1, 9))


def hash_modulo(n: int, *parts: Column) -> Column:
    """The 64-bit hash modulo ``n``, in long arithmetic on its halves."""
    high, low = _halves(*parts)
    return ((high % n * (2**32 % n) + low % n) % n).cast("int")


def hash_share(*parts: Column) -> Column:
    """The 64-bit hash divided by 2 to the 64."""
    high, low = _halves(*parts)
    whole = high.cast("decimal(20,0)") * F.lit(2**32).cast("decimal(20,0)") + low.cast("decimal(20,0)")
    return whole.cast("double") / F.lit(2.0**64)


def fold_key(column: Column) -> Column:
    """The trimmed key; a blank one is an error, because it would put all such rows into one fold."""
    key = tx.strip_space(column.cast("string"))
    bad = key.isNull() | F.lower(key).isin("", "nan", "none", "<na>")
    return F.when(bad, F.raise_error(F.lit("blank fold key"))).otherwise(key)


def id_hash_fold(column: Column, n_folds: int = 5, seed: int = 0) -> Column:
    return hash_modulo(n_folds, F.lit(str(seed)), fold_key(column))


def id_hash_folds(df: DataFrame, key: str, n_folds: int = 5, seed: int = 0, name: str = "fold") -> DataFrame:
    """Adds the fold of every row, a function of its key and the seed."""
    return df.withColumn(name, id_hash_fold(F.col(f"`{key}`"), n_folds, seed))


def id_hash_sample(df: DataFrame, key: str, share: float, seed: int = 0) -> DataFrame:
    """About ``share`` of the rows, chosen by key."""
    if not 0 < share <= 1:
        raise ValueError("the share is in (0, 1]")
    place = hash_share(F.lit("sample"), F.lit(str(seed)), fold_key(F.col(f"`{key}`")))
    return df.where(place < F.lit(float(share)))


def stratified_folds(
    df: DataFrame, label: str, key: str, n_folds: int = 5, seed: int = 0, name: str = "fold"
) -> DataFrame:
    """Deals the rows of each label to the folds in turn, in an order and from a start given by hashes of the seed."""
    text = F.col(f"`{label}`").cast("string")
    start = hash_modulo(n_folds, F.lit(str(seed)), F.coalesce(text, F.lit("None")))
    order = [F.sha1(F.concat_ws("|", F.lit(str(seed)), F.col(f"`{key}`"))), F.col(f"`{key}`")]
    dealt = running_totals(df, [label], order, {name: F.lit(1)})
    return dealt.withColumn(name, ((F.col(name) - 1 + start) % n_folds).cast("int"))


def holdout_size(n_rows: int, test_size: float) -> int:
    """Rows held out per repeat: half to even, as Python rounds."""
    return round(test_size * n_rows)


def holdout_tests(df: DataFrame, key: str, n_repeats: int, test_size: float, seed: int) -> Column:
    """The repeats in which a row of ``df`` is held out: per repeat exactly the share asked for, those with the smallest hashes.

    The last hash of every repeat is found by radix selection over the keys; then each row is judged by itself.
    """
    held = holdout_size(df.count(), test_size)

    def digest(repeat: Column) -> Column:
        return F.sha1(F.concat_ws("|", (repeat + seed).cast("string"), F.col(f"`{key}`")))

    every = df.select(F.col(f"`{key}`"), F.explode(F.sequence(F.lit(0), F.lit(n_repeats - 1))).alias("_repeat"))
    every = every.select("_repeat", F.col(f"`{key}`").alias("_key"), digest(F.col("_repeat")).alias("_hash"))
    parts = [F.substring("_hash", at, 3) for at in (1, 4, 7)]
    last = kth_rows(every, "_repeat", parts, [F.col("_hash"), F.col("_key")], held)
    if held >= 1 and not last:
        return F.array().cast("array<int>")  # no rows
    kind = df.schema[key].dataType
    tests = [
        F.when(
            (digest(F.lit(r)) < row["o0"]) | ((digest(F.lit(r)) == row["o0"]) & (F.col(f"`{key}`") <= F.lit(row["o1"]).cast(kind))),
            F.lit(r),
        )
        for r, row in sorted(last.items())
    ]
    return F.array_compact(F.array(*tests)) if tests else F.array().cast("array<int>")


def holdout_splits(df: DataFrame, key: str, n_repeats: int, test_size: float, seed: int) -> DataFrame:
    """``key, repeat`` of the held-out rows."""
    tests = holdout_tests(df, key, n_repeats, test_size, seed)
    return df.select(F.col(f"`{key}`"), F.explode(tests).alias("repeat"))


def make_splits(df: DataFrame, settings, key: str, label: str) -> DataFrame:
    """Adds ``tests``: the splits in which the row is held out. It trains in all others.

    Made once on all rows, so every candidate is tested on the same ones. ``key`` is the unique row key; identifier
    folds hash the column named in the settings.
    """
    if settings.cv_type == "oof":
        if settings.fold_method == "id_hash":
            folds = id_hash_folds(df, settings.fold_key_col, settings.n_folds, settings.fold_seed, "_fold")
        else:
            folds = stratified_folds(df, label, key, settings.n_folds, settings.fold_seed, "_fold")
        return folds.withColumn("tests", F.array("_fold")).drop("_fold")
    return df.withColumn("tests", holdout_tests(df, key, settings.n_repeats, settings.test_size, settings.holdout_seed))


def train_splits(n_splits: int) -> Column:
    """The splits a row trains in."""
    return F.array_except(F.sequence(F.lit(0), F.lit(n_splits - 1)), F.col("tests"))
