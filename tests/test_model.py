"""Naive Bayes against a dense computation in numpy."""

from collections import Counter
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

import by_rows
from tagwright.operators import bayes, features as ft
from tagwright.plans import model as pm
from tagwright.plans.settings import ModelSettings
from tagwright.session import written

LEVELS = ["l1", "l2", "l3"]
# "x" occurs under two parents; C has an only child at every level
PATHS = [
    ("A", "A1", "x"), ("A", "A1", "y"), ("A", "A2", "x"), ("B", "B1", "p"), ("B", "B1", "q"), ("B", "B1", "r"),
    ("C", "C1", "only"),
]
SETTINGS = ModelSettings(rare_path_threshold=1, stop_words=None)
CANDIDATES = [(0, 0.001, True, "conditional"), (1, 0.5, False, "independent"), (2, 0.5, True, "flattened")]


def _rows(n=300, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        k = i % 7 if i < 7 else int(rng.integers(0, 7))
        words = [f"w{j}" for j in rng.integers(0, 30, rng.integers(0, 12))] + [f"w{k * 3}"] * int(rng.integers(0, 3))
        rows.append((f"d{i:03d}", " ".join(words), *PATHS[k]))
    return rows


ROWS = _rows()


class Dense:
    """The same model with dense matrices, one column per n-gram."""

    def __init__(self, rows, settings):
        def grams(text):
            w = text.split()
            return w + [f"{a} {b}" for a, b in zip(w, w[1:])]

        counts = [Counter(grams(r[1])) for r in rows]
        df = Counter(g for c in counts for g in c)
        n = len(rows)
        self.vocabulary = sorted(g for g, d in df.items() if settings.min_df <= d <= settings.max_df * n)
        place = {g: i for i, g in enumerate(self.vocabulary)}
        self.x = np.zeros((n, len(place)))
        for i, c in enumerate(counts):
            for g, tf in c.items():
                if g in place:
                    value = float(tf)
                    if settings.vectorizer_kind == "tfidf":
                        value = (1 + np.log(tf)) * (np.log((1 + n) / (1 + df[g])) + 1)
                    self.x[i, place[g]] = value
        if settings.vectorizer_kind == "tfidf":
            norm = np.sqrt((self.x**2).sum(1, keepdims=True))
            self.x /= np.where(norm == 0, 1, norm)
        self.labels = [r[2:] for r in rows]
        self.paths = sorted(set(self.labels))

    def jll(self, depth, alpha, prior, keep=None):
        labels = [label[:depth] for label in self.labels]
        classes = sorted(set(labels)) if keep is None else keep
        columns = []
        members = sum(label in classes for label in labels)
        for c in classes:
            mask = np.array([label == c for label in labels])
            fc = self.x[mask].sum(0)
            log_prior = np.log(mask.sum() / members) if prior else -np.log(len(classes))
            columns.append(self.x @ (np.log(fc + alpha) - np.log(fc.sum() + alpha * fc.size)) + log_prior)
        return classes, np.stack(columns, 1)

    def scores(self, alpha, prior, mode):
        def normed(z):
            z = z - z.max(1, keepdims=True)
            return z - np.log(np.exp(z).sum(1, keepdims=True))

        total = np.zeros((len(self.labels), len(self.paths)))
        for d in (1, 2, 3):
            if mode == "flattened" and d < 3:
                continue
            classes, jll = self.jll(d, alpha, prior)
            if mode == "conditional":  # one model per parent, fitted on the rows below it
                lp = np.zeros_like(jll)
                for parent in {c[:-1] for c in classes}:
                    children = [c for c in classes if c[:-1] == parent]
                    lp[:, [classes.index(c) for c in children]] = normed(self.jll(d, alpha, prior, children)[1])
            else:
                lp = normed(jll)
            total += lp[:, [classes.index(p[:d]) for p in self.paths]]
        return total


@pytest.fixture(scope="module")
def fitted(spark):
    df = spark.createDataFrame(ROWS, "id string, t string, l1 string, l2 string, l3 string")
    docs = pm.documents(df, "id", "t", LEVELS)
    out = {}
    for kind in ("tfidf", "count"):
        settings = replace(SETTINGS, vectorizer_kind=kind)
        terms = written(pm.terms_of(docs.rows, settings), "terms")
        out[kind] = (pm.fit(docs, settings, LEVELS, terms), terms.withColumn("split", F.lit(0)))
    asked = docs.rows.select(F.lit(0).alias("split"), "doc")
    return df, asked, out


def _predicted(model, asked, terms, **options):
    pred = pm.predict(model, asked, terms, CANDIDATES, **options).toPandas()
    return pred.sort_values(["candidate", "doc"]).reset_index(drop=True)


@pytest.mark.parametrize("kind", ["tfidf", "count"])
def test_predictions_match_dense(fitted, kind):
    _, asked, models = fitted
    dense = Dense(ROWS, replace(SETTINGS, vectorizer_kind=kind))
    got = _predicted(models[kind][0], asked, models[kind][1])
    for candidate, alpha, prior, mode in CANDIDATES:
        scores = dense.scores(alpha, prior, mode)
        mine = got[got.candidate == candidate]
        best = scores.argmax(1)
        assert [tuple(p) for p in mine.path] == [dense.paths[b] for b in best]
        for d in (1, 2, 3):
            mass = {}
            for j, p in enumerate(dense.paths):
                mass[p[:d]] = mass.get(p[:d], 0) + np.exp(scores[:, j])
            for i in range(0, len(ROWS), 17):
                chosen = dense.paths[best[i]][:d]
                rest = max(m[i] for c, m in mass.items() if c != chosen)
                assert mine.confidence.iloc[i][d - 1] == pytest.approx(mass[chosen][i], rel=1e-9)
                assert mine.margin.iloc[i][d - 1] == pytest.approx(mass[chosen][i] - rest, rel=1e-7, abs=1e-12)
        if mode != "independent":
            np.testing.assert_allclose(np.exp(scores).sum(1), 1)


def test_predictions_match_those_by_rows(fitted):
    _, asked, models = fitted
    model, terms = models["tfidf"]
    one = _predicted(model, asked, terms)
    x = ft.features(terms, model.vocabulary, model.settings).select("split", "doc", "tid", "x")
    for candidate, alpha, prior, mode in CANDIDATES:
        sums = bayes.lookup_term_weights(x, model.weights, [alpha])
        rows = by_rows.predictions_by_rows(bayes.row_sums(asked, x), sums, model.classes, 3, alpha, prior, mode)
        other = {r.doc: r for r in rows.collect()}
        mine = one[one.candidate == candidate]
        assert [tuple(p) for p in mine.path] == [tuple(other[d].path) for d in mine.doc]
        for column in ("confidence", "margin"):
            np.testing.assert_allclose(np.stack(mine[column]), np.stack([other[d][column] for d in mine.doc]), atol=1e-9)


def test_likelihood_matches_dense(fitted):
    _, asked, models = fitted
    model, terms = models["count"]
    dense = Dense(ROWS, replace(SETTINGS, vectorizer_kind="count"))
    for alpha, prior in ((1.0, True), (0.1, False), (0.001, True)):
        classes, jll = dense.jll(2, alpha, prior)
        rows = pm.class_values(model, asked, terms, "jll", alpha, prior).where("depth = 2").collect()
        got = {(r.doc, tuple(r["class"])): r.value for r in rows}
        for i in range(0, len(ROWS), 23):
            for j, c in enumerate(classes):
                assert got[ROWS[i][0], c] == pytest.approx(jll[i, j], rel=1e-9)


def test_classes_are_prefixes_and_paths_are_ordered(fitted):
    _, _, models = fitted
    model = models["count"][0]
    assert sorted(tuple(r)[1:] for r in model.valid_paths().collect()) == sorted(PATHS)
    third = [tuple(r["class"]) for r in model.classes.where("depth = 3").orderBy("code").collect()]
    assert third == sorted(PATHS)
    assert model.classes.where("depth = 2").count() == 4


def test_document_without_known_terms_gets_the_prior(spark, fitted):
    _, _, models = fitted
    new = spark.createDataFrame([("n1", ""), ("n2", None), ("n3", "unseen words")], "id string, t string")
    pred = pm.batch_predict(models["tfidf"][0], new, "id", "t", ["id"], ["t"]).orderBy("id").collect()
    assert [r.id for r in pred] == ["n1", "n2", "n3"]
    assert [(r.n_tokens, r.n_known, r.oov_rate) for r in pred] == [(0, 0, 1.0), (0, 0, 1.0), (2, 0, 1.0)]
    assert len({tuple(r[f"Predicted {c}"] for c in LEVELS) for r in pred}) == 1


def test_column_order_and_labels(fitted):
    df, _, models = fitted
    pred = pm.batch_predict(models["tfidf"][0], df, "id", "t", ["id"], ["t"])
    assert pred.columns == [
        "id", "Actual l1", "Actual l2", "Actual l3", "Predicted l1", "Predicted l2", "Predicted l3", "L1 Confidence",
        "L2 Confidence", "L3 Confidence", "L1 Margin", "L2 Margin", "L3 Margin", "n_tokens", "n_known", "oov_rate", "t",
    ]
    assert pred.count() == len(ROWS)


def test_rare_paths_and_bad_input(spark, fitted):
    df, _, _ = fitted
    docs = pm.documents(df, "id", "t", LEVELS)
    with pytest.raises(ValueError):
        pm.fit(docs, replace(SETTINGS, rare_path_threshold=1000), LEVELS)
    rows = spark.createDataFrame([(0, ["a"], "t", -1.0)], "split int, path array<string>, term string, x double")
    with pytest.raises(Exception, match="negative feature"):
        bayes.class_term_counts(rows, 1).collect()
    with pytest.raises(ValueError):
        bayes.class_params(rows, 0.0, True)


def test_classes_are_named_once_and_not_per_row(fitted):
    _, asked, models = fitted
    model, terms = models["count"]
    found = pm.class_values(model, asked, terms, "conditional", called=F.array_join("class", "|"))
    assert "array_join" not in found._jdf.queryExecution().optimizedPlan().toString()
    named = {(r.doc, r["class"]): r.value for r in found.collect()}
    plain = pm.class_values(model, asked, terms, "conditional").collect()
    assert len(named) == len(plain) and named == pytest.approx({(r.doc, "|".join(r["class"])): r.value for r in plain})
