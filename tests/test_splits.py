import hashlib

import pytest
from pyspark.sql import functions as F

from tagwright.operators import splits
from tagwright.plans.settings import SplitSettings


def test_fold_is_a_function_of_the_trimmed_key(spark):
    ids = ["I8IGTHF0H3HT", "S-7657976", "CB7451", " 00892502046 ", "é"]
    df = spark.createDataFrame([(i,) for i in ids], "id string")
    for seed in (0, 7):
        got = {r.id: r.fold for r in splits.id_hash_folds(df, "id", 5, seed).collect()}
        for i in ids:
            digest = hashlib.sha1(f"{seed}|{i.strip()}".encode()).digest()
            assert got[i] == int.from_bytes(digest[:8], "big") % 5


@pytest.mark.parametrize("key", [None, " ", "nan", "<NA>"])
def test_blank_keys_are_refused(spark, key):
    df = spark.createDataFrame([(key,)], "id string")
    with pytest.raises(Exception, match="blank fold key"):
        splits.id_hash_folds(df, "id").collect()
    with pytest.raises(Exception, match="blank fold key"):
        splits.id_hash_sample(df, "id", 0.5).collect()


def test_sample_does_not_depend_on_other_rows(spark):
    df = spark.range(20_000).select(F.format_string("I%06d", "id").alias("id"))
    sample = {r.id for r in splits.id_hash_sample(df, "id", 0.2).collect()}
    assert 0.18 < len(sample) / 20_000 < 0.22
    third = df.where("cast(substr(id, 2) as int) % 3 = 0")
    again = {r.id for r in splits.id_hash_sample(third, "id", 0.2).collect()}
    assert again == {i for i in sample if int(i[1:]) % 3 == 0}
    with pytest.raises(ValueError):
        splits.id_hash_sample(df, "id", 0)


def test_strata_are_dealt_evenly(spark):
    df = spark.range(102).select("id", F.when(F.col("id") < 100, F.col("id") % 5).otherwise(9).cast("string").alias("label"))
    got = splits.stratified_folds(df, "label", "id", 5, 1).groupBy("label", "fold").count().collect()
    sizes = {}
    for r in got:
        sizes.setdefault(r.label, []).append(r["count"])
    assert all(sizes[str(k)] == [4] * 5 for k in range(5))
    assert sorted(sizes["9"]) == [1, 1]  # fewer members than folds


def test_holdout_takes_exactly_the_share(spark):
    df = spark.range(1005).select(F.col("id").cast("string").alias("id"))
    held = splits.holdout_splits(df, "id", 3, 0.2, 42).groupBy("repeat").count().collect()
    assert {r["repeat"]: r["count"] for r in held} == {0: 201, 1: 201, 2: 201}
    assert splits.holdout_size(25, 0.1) == 2 and splits.holdout_size(35, 0.1) == 4  # half to even


def test_make_splits_kinds(spark):
    df = spark.range(60).select(F.col("id").cast("string").alias("ID"), (F.col("id") % 3).cast("string").alias("l"))
    for cv in (
        SplitSettings(n_folds=4), SplitSettings(n_folds=4, fold_method="stratified"),
        SplitSettings("repeated_holdout", n_repeats=4, test_size=0.25),
    ):
        placed = splits.make_splits(df, cv, "ID", "l")
        rows = placed.select(F.size("tests").alias("t"), F.size(splits.train_splits(4)).alias("n")).collect()
        assert len(rows) == 60 and all(r.t + r.n == 4 for r in rows)
        if cv.cv_type == "oof":
            assert all(r.t == 1 for r in rows)
        else:
            assert sum(r.t for r in rows) == 60
