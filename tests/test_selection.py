"""Radix selection against sorting."""

import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tagwright.operators import features as ft
from tagwright.operators import selection, splits
from tagwright.plans.settings import ModelSettings


@pytest.mark.parametrize("few", [10_000, 2])
def test_kth_rows_are_those_of_a_sort(spark, monkeypatch, few):
    monkeypatch.setattr(selection, "FEW", few)
    rng = random.Random(few)
    rows = [(g, rng.randrange(6), "".join(rng.choice("abé") for _ in range(rng.randint(0, 5)))) for g in (1, 2, 3) for _ in range(60 * g)]
    df = spark.createDataFrame(rows, "grp int, n int, t string")
    digits, order = [F.col("n"), F.substring("t", 1, 1), F.substring("t", 1, 2)], [F.col("n"), F.col("t")]
    for k in (1, 17, 60, 61, 200):
        found = selection.kth_rows(df, "grp", digits, order, k)
        by_group = {g: sorted((n, t.encode()) for h, n, t in rows if h == g) for g in (1, 2, 3)}
        assert {g: (r["o0"], r["o1"].encode()) for g, r in found.items()} == {g: v[k - 1] for g, v in by_group.items() if len(v) >= k}
    assert selection.kth_rows(df, "grp", digits, order, 0) == {}
    assert selection.kth_rows(df.where("n < 0"), "grp", digits, order, 5) == {}


def test_largest_terms_by_split_with_ties(spark):
    cells = [(s, f"t{i:02d}", 5, 5 + (i % 3) * (s + 1)) for s in (0, 1) for i in range(12 if s else 5)]
    df = spark.createDataFrame(cells, "split int, term string, df long, tf long")
    n_docs = spark.createDataFrame([(0, 100), (1, 100)], "split int, n_docs long")
    settings = replace(ModelSettings(), min_df=1, max_df=1.0, max_features=7)
    got = sorted((r.split, r.term) for r in ft.term_vocabulary(df, n_docs, settings).collect())
    best = [sorted([c for c in cells if c[0] == s], key=lambda c: (-c[3], c[1]))[:7] for s in (0, 1)]
    assert got == sorted((c[0], c[1]) for part in best for c in part)


def test_holdouts_move_no_row(spark):
    df = spark.range(500).selectExpr("concat('k', id) as id", "repeat('x', 100) as text")
    tests = df.withColumn("tests", splits.holdout_tests(df, "id", 4, 0.25, 3))
    assert "Exchange" not in tests._jdf.queryExecution().executedPlan().toString()
    counts = tests.select(F.explode("tests").alias("r")).groupBy("r").count().collect()
    assert sorted((r["r"], r["count"]) for r in counts) == [(i, 125) for i in range(4)]
    empty = df.where("id = 'none'")
    assert empty.withColumn("tests", splits.holdout_tests(empty, "id", 2, 0.25, 3)).count() == 0
