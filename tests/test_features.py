from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagwright.operators import features as ft
from tagwright.operators.running import running_totals
from tagwright.plans.settings import ModelSettings

DOCS = [("a", "Red  RED bolt"), ("b", "the bolt red"), ("c", ""), ("d", "nut <SIZE>IN bolt nut")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "doc string, text string")


def test_tokens(docs):
    def tokens(*args):
        return {r.doc: r.t for r in docs.select("doc", ft.tokenize(F.col("text"), *args).alias("t")).collect()}

    assert tokens("whitespace")["d"] == ["nut", "<size>in", "bolt", "nut"]
    assert tokens("sklearn")["d"] == ["nut", "size", "in", "bolt", "nut"]
    assert tokens("whitespace", "english")["b"] == ["bolt", "red"]
    assert tokens("whitespace", ["bolt"])["b"] == ["the", "red"]
    assert tokens(r"b(\w+)")["a"] == ["olt"]


def test_ngrams_cross_removed_stop_words(docs):
    grams = ft.ngrams(ft.tokenize(F.col("text"), "whitespace", ["bolt"]), 1, 3)
    got = {r.doc: r.g for r in docs.select("doc", grams.alias("g")).collect()}
    assert got["d"] == ["nut", "<size>in", "nut", "nut <size>in", "<size>in nut", "nut <size>in nut"]
    assert got["c"] == [] and got["a"] == ["red", "red", "red red"]


def test_folded_bigrams(spark):
    df = spark.createDataFrame([("b a",), ("a b",), ("c b a",), ("z",)], "t string")
    assert [r[0] for r in df.select(ft.fold_bigrams(F.col("t"))).collect()] == ["a b", "a b", "c b a", "z"]


def _features(docs, **settings):
    s = ModelSettings(stop_words=None, **{"ngram_range": (1, 1), "min_df": 1, "max_df": 1.0, **settings})
    tf = ft.term_frequencies(docs, s).withColumn("split", F.lit(0))
    n = docs.agg(F.lit(0).alias("split"), F.count("*").alias("n_docs"))
    vocabulary = ft.term_vocabulary(ft.document_cells(tf, s.binary, ["split"]), n, s)
    x = {(r.doc, r.term): r.x for r in ft.features(tf, vocabulary, s).collect()}
    return x, {r.term: (r.df, r.total) for r in vocabulary.collect()}


def test_vocabulary_limits(docs):
    assert _features(docs, vectorizer_kind="count")[1]["red"] == (2, 3)
    assert _features(docs, vectorizer_kind="count", binary=True)[1]["red"] == (2, 2)
    assert set(_features(docs, min_df=2)[1]) == {"red", "bolt"}
    assert set(_features(docs, min_df=0.6)[1]) == {"bolt"}  # 3 of 4 documents
    assert "bolt" not in _features(docs, max_df=0.7)[1]
    assert "bolt" not in _features(docs, max_df=2)[1]
    assert set(_features(docs, max_features=3)[1]) == {"bolt", "nut", "red"}  # totals 3, 2, 3
    assert set(_features(docs, max_features=2, min_df=1)[1]) == {"bolt", "red"}


def test_tfidf_by_hand(docs):
    idf = {t: np.log(5 / (1 + d)) + 1 for t, d in {"red": 2, "bolt": 3, "nut": 1, "<size>in": 1}.items()}
    raw = {"nut": (1 + np.log(2)) * idf["nut"], "<size>in": idf["<size>in"], "bolt": idf["bolt"]}
    l2 = np.sqrt(sum(v * v for v in raw.values()))
    x, _ = _features(docs)
    for term, value in raw.items():
        assert x["d", term] == pytest.approx(value / l2, rel=1e-12)
    x, _ = _features(docs, norm="l1", sublinear_tf=False, use_idf=False)
    assert x["d", "nut"] == pytest.approx(0.5) and x["a", "red"] == pytest.approx(2 / 3)
    x, _ = _features(docs, norm=None, sublinear_tf=False, use_idf=False)
    assert x["a", "red"] == 2.0
    x, _ = _features(docs, norm=None, binary=True)
    assert x["a", "red"] == pytest.approx(idf["red"])


def test_statistics(spark):
    df = spark.createDataFrame([("a b a b",), ("b c",), (None,), ("",)], "t string")
    assert ft.ngram_stats(df, "t").first().asDict() == {
        "unique_unigrams": 3, "unique_bigrams": 3, "unique_unigrams_plus_bigrams": 6
    }
    assert ft.ngram_stats(df, "t", 0.05).first().unique_unigrams == 3
    assert [tuple(r) for r in ft.top_tokens(df, "t", 2).collect()] == [("b", 3), ("a", 2)]


def test_running_totals_over_one_hot_group(spark):
    df = spark.range(5000).select(
        F.when(F.col("id") % 3 == 0, "small").otherwise("hot").alias("g"), "id", (F.col("id") % 7).alias("v")
    )
    out = running_totals(df, ["g"], [F.desc("id")], {"place": F.lit(1), "sum": F.col("v")}).toPandas()
    out = out.sort_values(["g", "id"], ascending=[True, False])
    assert (out.place == out.groupby("g").cumcount() + 1).all()
    assert (out["sum"] == out.groupby("g").v.cumsum()).all()
    assert len(out) == 5000


@pytest.mark.parametrize("lo, hi", [(1, 2), (2, 2), (1, 3), (2, 4)])
@pytest.mark.parametrize("ordered", [True, False])
def test_terms_are_counted_in_tasks_without_a_row_per_token(spark, lo, hi, ordered):
    random = np.random.default_rng(lo * 10 + hi)
    words = ["a", "B", "the", "ä", "ccc", "😀", "z-z"]
    texts = [(i % 30, " ".join(random.choice(words, random.integers(0, 12)))) for i in range(60)]  # an id has two texts
    texts += [(90, None), (91, "the the"), (None, "a b a b")]
    expected = Counter()
    for doc, text in texts:
        tokens = [t for t in (text or "").lower().split() if t != "the"]
        for t in tokens:
            expected[doc, t] += 0
        for n in range(lo, hi + 1):
            for i in range(len(tokens) - n + 1):
                gram = tokens[i : i + n]
                expected[doc, " ".join(sorted(gram) if n == 2 and not ordered else gram)] += 1
    settings = ModelSettings(stop_words=("the",), ngram_range=(lo, hi), ordered_bigrams=ordered)
    got = ft.term_frequencies(spark.createDataFrame(texts, "doc int, text string"), settings, quality=True)
    rows = [tuple(r) for r in got.select("doc", "term", "tf").collect()]
    assert sorted(map(str, rows)) == sorted(str((d, t, n)) for (d, t), n in expected.items())
    single = Counter((d, t) for d, x in texts for t in (x or "").lower().split() if t != "the")
    assert {(r.doc, r.term): r.words for r in got.where("words > 0").collect()} == dict(single)
    assert "Generate" not in got._jdf.queryExecution().executedPlan().toString()
    plain = ft.term_frequencies(spark.createDataFrame(texts, "doc int, text string"), settings)
    assert sorted(str(tuple(r)) for r in plain.collect()) == sorted(str(r) for r in rows if r[2])
