import numpy as np
import pytest

from tagwright.operators import evaluation as ev

LEVELS = ["a", "b"]


@pytest.fixture(scope="module")
def pred(spark):
    rows = [
        (1, 0, "x", "x", "p", "p", 1.0, 0.95), (2, 0, "x", "x", "p", "q", 0.9, 0.3), (3, 1, "y", "x", "p", "p", 0.3, 0.3),
        (4, 1, None, None, "q", "q", 0.05, -0.1),
    ]
    names = ["id", "fold", "Predicted a", "Actual a", "Predicted b", "Actual b", "L1 Confidence", "L2 Confidence"]
    schema = "id int, fold int, pa string, aa string, pb string, ab string, c1 double, c2 double"
    return spark.createDataFrame(rows, schema).toDF(*names)


def test_flags_are_cumulative(pred):
    got = [(r["L1 Correct"], r["L2 Correct"]) for r in ev.correct_flags(pred, LEVELS).orderBy("id").collect()]
    assert got == [(True, True), (True, False), (False, False), (True, True)]
    assert tuple(ev.accuracy_by_level(pred, LEVELS).first()) == (0.75, 0.5)


def test_headline(pred):
    got = {r.split: (r[1], r[2]) for r in ev.headline(pred, LEVELS, "fold").collect()}
    assert got["0"] == (1.0, 0.5) and got["1"] == (0.5, 0.5) and got["all"] == (0.75, 0.5)
    assert got["std across splits"] == (pytest.approx(np.std([1, 0.5], ddof=1)), 0.0)
    assert ev.headline(pred, LEVELS).first().split == "all"


def test_buckets(pred):
    table = {r.bucket: r for r in ev.bucket_table(pred, LEVELS, 1, 0.1).collect()}
    assert len(table) == 10 and table["0.50-0.60"].n_items == 0 and table["0.50-0.60"].accuracy is None
    assert table["0.90-1.00"].n_items == 2 and table["0.90-1.00"].cumulative_accuracy == 1.0
    assert table["0.30-0.40"].n_items == 1  # 0.3 / 0.1 is just below 3 in floating point
    assert table["0.00-0.10"].cumulative_coverage == 1.0
    assert [r.bucket for r in ev.bucket_table(pred, LEVELS, 2, 0.3).orderBy("lower").collect()][-1] == "0.90-1.00"
    low = ev.bucket_table(pred, LEVELS, 2, 0.5).orderBy("lower").first()
    assert low.n_items == 3  # a negative confidence counts as 0


def test_boundary(pred):
    tables = ev.bucket_tables(pred, LEVELS, 0.1)
    got = {r.level: (r.bucket, r.coverage) for r in ev.accept_boundary(tables, 0.75).collect()}
    assert got["L1"] == ("0.00-0.10", 1.0) and got["L2"] == ("0.40-0.50", 0.25)
    assert ev.accept_boundary(tables, 1.1).count() == 0


def test_coverage_curve(pred):
    curve = ev.coverage_curve(pred, LEVELS, "id").where("depth = 1").orderBy("rank").collect()
    assert [(r.id, r.coverage, round(r.accuracy, 4)) for r in curve] == [
        (1, 0.25, 1.0), (2, 0.5, 1.0), (3, 0.75, 0.6667), (4, 1.0, 0.75)
    ]
    at = ev.coverage_at(ev.coverage_curve(pred, LEVELS, "id")).where("depth = 1").collect()
    assert {(r.target, r.coverage) for r in at} == {(0.9, 0.5), (0.95, 0.5)}


def test_best_needs_a_complete_candidate(spark):
    rows = [(0, True, 0.5), (1, True, 0.7), (2, True, 0.7), (3, False, 0.9)]
    results = spark.createDataFrame(rows, "candidate int, complete boolean, acc double").withColumnRenamed("acc", "L1 Accuracy")
    assert ev.best_candidate(results, "L1 Accuracy").first().candidate == 1
    with pytest.raises(Exception, match="no candidate has finished"):
        ev.best_candidate(results.where("not complete"), "L1 Accuracy").collect()
    with pytest.raises(KeyError):
        ev.best_candidate(results, "L9 Accuracy")


def test_coverage_curve_places_its_rows_once(spark):
    pred = spark.range(50).selectExpr(
        "id", "'a' as `Actual x`", "if(id % 3 = 0, 'b', 'a') as `Predicted x`", "(id % 10) / 10.0 as `L1 Confidence`"
    )
    curve = ev.coverage_curve(pred, ["x"], "id")
    plan = curve._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(_range#") == 1
    rows = sorted(curve.collect(), key=lambda r: r["rank"])
    assert [r["rank"] for r in rows] == list(range(1, 51)) and rows[-1].coverage == 1.0
    assert [r.id for r in rows[:5]] == [9, 19, 29, 39, 49] and rows[-1].accuracy == pytest.approx(33 / 50)
