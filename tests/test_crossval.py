from dataclasses import replace

import pytest

from pyspark.sql import functions as F

from tagwright.operators import evaluation as ev
from tagwright.operators import joins
from tagwright.plans import crossval as cv
from tagwright.plans import model as pm
from tagwright.plans.prepare import prepare_items
from tagwright.plans.settings import ModelSettings, SplitSettings, candidate_grid, candidates_frame, varying_settings
from tagwright.sources import store

from test_model import LEVELS, ROWS

BASE = ModelSettings(vectorizer_kind="count", ngram_range=(1, 1), rare_path_threshold=2, stop_words=None)


@pytest.fixture(scope="module")
def items(spark):
    df = spark.createDataFrame(ROWS, "ID string, t string, l1 string, l2 string, l3 string")
    return df.selectExpr("*", "t as c", "concat('name ', l1) as n1", "concat('name ', l2) as n2", "concat('name ', l3) as n3").repartition(4)


def test_grid():
    spec = {**BASE.as_dict(), "ngram_range": (1, 2)}
    with pytest.raises(KeyError):
        candidate_grid({**spec, "other": 1}, True)
    with pytest.raises(KeyError):
        candidate_grid({k: v for k, v in spec.items() if k != "alpha"}, True)
    with pytest.raises(ValueError):
        candidate_grid({**spec, "alpha": [1.0, 0.1]}, False)
    with pytest.raises(ValueError):
        candidate_grid({**spec, "ngram_range": [1, 2]}, True)
    grid = candidate_grid({**spec, "alpha": [1.0, 0.1], "norm": ["l1", "l2"], "ngram_range": [(1, 1), (1, 2)]}, True)
    assert len(grid) == 4  # the norm does nothing for counts
    assert len(cv.candidate_groups(grid)) == 2


@pytest.mark.parametrize("bad", [
    {"vectorizer_kind": "x"}, {"prediction_mode": "x"}, {"alpha": 0}, {"ngram_range": (2, 1)}, {"min_df": 1.0},
    {"max_df": 1}, {"rare_path_threshold": 0}, {"ngram_range": (1, 1), "ordered_bigrams": False}, {"norm": "l3"},
])
def test_settings_are_checked(bad):
    with pytest.raises(ValueError):
        ModelSettings(**bad)


def test_varying_settings(spark):
    frame = candidates_frame(spark, [BASE, replace(BASE, alpha=0.5), replace(BASE, alpha=2.0)])
    assert [tuple(r) for r in varying_settings(frame).collect()] == [("alpha", 3)]


@pytest.mark.parametrize("kind", ["count", "tfidf"])
def test_splits_in_one_job_equal_separate_fits(spark, items, kind):
    base = replace(BASE, vectorizer_kind=kind)
    settings = SplitSettings(n_folds=3)
    got = store.union_splits(cv.cross_validate(items, "ID", "c", LEVELS, [base], settings))
    together = {(r.fold, r.ID): (r["Predicted l3"], round(r["L3 Confidence"], 9), r.n_known) for r in got.collect()}
    assert len(together) == len(ROWS)
    from tagwright.operators.splits import id_hash_folds

    folds = id_hash_folds(items, "ID", 3)
    for f in range(3):
        model = pm.fit(pm.documents(folds.where(f"fold <> {f}"), "ID", "c", LEVELS), base, LEVELS)
        alone = pm.batch_predict(model, folds.where(f"fold = {f}"), "ID", "c", ["ID"])
        for r in alone.collect():
            assert together[f, r.ID] == (r["Predicted l3"], round(r["L3 Confidence"], 9), r.n_known)


def test_evaluation_is_resumable(spark, items, tmp_path):
    grid = [BASE, replace(BASE, alpha=0.5, prediction_mode="flattened")]
    settings = SplitSettings(n_folds=3)
    columns = dict(key="ID", text_col="t", cleaned_col="c", levels=LEVELS, names=["n1", "n2", "n3"])
    folder = str(tmp_path / "evaluation_1")
    run = cv.Evaluation.create(items, grid, settings, folder, **columns)
    assert run.pending().count() == 6
    results = {r.candidate: r for r in run.run().collect()}
    assert results[0].complete and results[1].complete and results[0].n_rows == len(ROWS)
    assert run.pending().count() == 0

    with pytest.raises(ValueError):
        cv.Evaluation.open(spark, folder, cv=SplitSettings(n_folds=4))
    again = cv.Evaluation.open(spark, folder, [*grid, replace(BASE, ngram_range=(1, 2))], settings)
    assert len(again.candidates) == 3 and again.pending().count() == 3
    again.run()
    assert again.pending().count() == 0
    best, chosen = again.best("L3 Accuracy")
    assert chosen == again.candidates[best]

    table = again.predictions(best)
    assert table.columns[:5] == ["ID", "fold", "Actual l1", "Actual l2", "Actual l3"]
    assert table.columns[-5:] == ["n_tokens", "n_known", "oov_rate", "t", "c"]
    order = [(r.fold, r.ID) for r in table.select("fold", "ID").collect()]
    assert order == sorted(order) and len(order) == len(ROWS)
    assert again.headline(best).count() == 5

    path = again.export(best)
    back = spark.read.option("header", True).csv(path)
    assert back.count() == len(ROWS) and back.where("`Predicted n3` <> concat('name ', `Predicted l3`)").count() == 0
    assert back.columns[5:11] == ["Predicted l1", "Predicted l2", "Predicted l3", "Predicted n1", "Predicted n2", "Predicted n3"]
    assert store.read_json(spark, path.replace(".csv", ".json"))["n_folds"] == 3


def test_sampled_and_holdout(spark, items, tmp_path):
    settings = SplitSettings("repeated_holdout", n_repeats=2, test_size=0.25)
    run = cv.Evaluation.create(
        items, [BASE], settings, str(tmp_path / "e"), key="ID", text_col="t", cleaned_col="c", levels=LEVELS,
        sample_frac=0.5,
    )
    n = run.items.count()
    assert 100 < n < 200
    run.run()
    counts = {r["repeat"]: r["count"] for r in run.predictions(0).groupBy("repeat").count().collect()}
    assert counts == {0: round(0.25 * n), 1: round(0.25 * n)}


def test_model_round_trip(spark, items, tmp_path):
    model = pm.fit(pm.documents(items, "ID", "c", LEVELS), BASE, LEVELS)
    lookup = items.select("l3", "n3")
    words = spark.createDataFrame([("w1", 3)], "word string, descriptions bigint")
    store.write_model(model, str(tmp_path / "m"), words, lookup, {"rows": len(ROWS)})
    back, vocabulary, names, manifest = store.read_model(spark, str(tmp_path / "m"))
    assert vocabulary.count() == 1 and names.count() == 6 and manifest["training"]["rows"] == len(ROWS)
    assert manifest["classes"] == [3, 4, 7] and manifest["n_paths"] == 7
    one = pm.batch_predict(model, items, "ID", "c", ["ID"]).orderBy("ID").collect()
    assert one == pm.batch_predict(back, items, "ID", "c", ["ID"]).orderBy("ID").collect()
    manifest["fingerprint"] = "0" * 16
    store.write_json(spark, manifest, str(tmp_path / "m" / "manifest.json"))
    with pytest.raises(ValueError):
        store.read_model(spark, str(tmp_path / "m"))


def test_from_raw_items_to_named_predictions(spark, tmp_path):
    kinds = [("BALL VALVE", "v", "v1"), ("GATE VALVE", "v", "v2"), ("NITRILE GLOVE", "g", "g1"), ("LEATHER GLOVE", "g", "g2")]
    rows = [(f"i{n}", f"X{n}Z {kinds[n % 4][0]} {n % 5 + 1} INCHES", *kinds[n % 4][1:]) for n in range(80)]
    raw = spark.createDataFrame(rows, "id string, descr string, a string, b string").withColumn("bn", F.upper("b"))
    english = spark.createDataFrame([(w,) for w in "ball gate nitrile leather valve glove".split()], "word string")
    none = spark.createDataFrame([], "term string")
    done, counts = prepare_items(raw, "descr", "clean", english, none, levels=["a", "b"])
    assert counts.first().cleaned_rows == 80
    base = replace(BASE, rare_path_threshold=5)
    model = pm.fit(pm.documents(done.items, "id", "clean", ["a", "b"]), base, ["a", "b"])
    lookup = joins.distinct_lookup(raw, ["a", "b"], ["bn"]).withColumn("an", F.upper("a"))
    store.write_model(model, str(tmp_path / "m"), done.vocabulary, lookup)
    model, words, names, _ = store.read_model(spark, str(tmp_path / "m"))
    new = spark.createDataFrame([("n1", "QQ9 BALL VALVE 2 FEET", "v", "v1"), ("n2", "", "g", "g1")], "id string, descr string, a string, b string")
    pred = pm.predict_items(
        model, words, new, "id", "descr", "clean", english, none, id_cols=["id"], lookup=names, names=["an", "bn"]
    )
    got = {r.id: r for r in pred.collect()}
    assert got["n1"].clean == "BALL VALVE <SIZE>FT" and got["n1"]["Predicted b"] == "v1" and got["n1"]["Predicted bn"] == "V1"
    assert got["n2"].clean == "" and got["n2"].oov_rate == 1.0
    assert pred.columns[3:7] == ["Predicted a", "Predicted b", "Predicted an", "Predicted bn"]
    assert ev.accuracy_by_level(pred, ["a", "b"]).first()[1] >= 0.5
