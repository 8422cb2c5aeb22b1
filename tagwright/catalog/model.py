"""Queries over tokens, features, naive Bayes, grids and cross-validation."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import bayes
from ..operators import evaluation as ev
from ..operators import filters
from ..operators import features as ft
from ..plans import crossval as cv
from ..plans import model as pm
from ..functions.lists import CleaningSettings
from ..operators.cleaning import clean_items
from ..plans.settings import ModelSettings, SplitSettings, candidate_grid, candidates_frame
from ..session import scratch_path, written
from ..sources import store
from . import fixtures as fx
from .registry import query

# Stop words of the queries, so that both engines use one list.
STOPS = ("the", "and", "of", "to", "in", "is", "it", "on", "x")
SETTINGS = ModelSettings(stop_words=STOPS, rare_path_threshold=2, alpha=0.01)
COUNTS = replace(SETTINGS, vectorizer_kind="count", ngram_range=(1, 1), min_df=3)
_STOPS_SQL = "(" + ", ".join(f"'{w}'" for w in STOPS) + ")"


# ---- SQL of the same -------------------------------------------------------------------------------------------

def _terms_sql(source: str, bigrams: bool, folded: bool = False) -> str:
    """``toks(doc, i, t)`` after stop words, and ``tf(doc, term, tf)``."""
    pair = "least(t, n) || ' ' || greatest(t, n)" if folded else "t || ' ' || n"
    more = f"""union all select doc, {pair} from (
        select doc, t, lead(t) over (partition by doc order by i) as n from toks) where n is not null""" if bigrams else ""
    return rf"""
    raw as (select id as doc, unnest(regexp_extract_all(lower(descr), '\S+')) as t,
            generate_subscripts(regexp_extract_all(lower(descr), '\S+'), 1) as i from {source}),
    toks as (select * from raw where t not in {_STOPS_SQL}),
    tf as (select doc, term, count(*) as tf from (select doc, t as term from toks {more}) group by doc, term)"""


def _kept_sql(source: str, levels: int, threshold: int) -> str:
    """``kept(doc, l1 ..)``: the documents of frequent paths."""
    cols = ", ".join(f"l{d}" for d in range(1, levels + 1))
    return f"kept as (select id as doc, {cols} from {source} qualify count(*) over (partition by {cols}) >= {threshold})"


def _vocabulary_sql(min_df: int) -> str:
    return f"""
    train as (select tf.* from tf where doc in (select doc from kept)),
    n as (select count(*) as n from kept),
    vocabulary as (select term, count(*) as df, sum(tf) as total, ln((1 + n.n) / (1 + count(*))) + 1 as idf
        from train, n group by term, n.n having count(*) >= {min_df} and count(*) <= 0.95 * n.n)"""


_COUNT_X = "x as (select doc, term, cast(tf as double) as x from tf join vocabulary using (term))"
_TFIDF_X = """
    w as (select doc, term, (1 + ln(tf)) * idf as w from tf join vocabulary using (term)),
    x as (select doc, term, w / sqrt(sum(w * w) over (partition by doc)) as x from w)"""


def _fit_sql(levels: int, alpha: float, prior: bool = True) -> str:
    """``cls(depth, class, parent, n, prior, const)`` and ``fc(depth, class, term, fc)``."""
    prefix = " union all ".join(
        f"select doc, {d} as depth, concat_ws('|', {', '.join(f'l{i}' for i in range(1, d + 1))}) as class, "
        + (f"concat_ws('|', {', '.join(f'l{i}' for i in range(1, d))})" if d > 1 else "''")
        + " as parent from kept"
        for d in range(1, levels + 1)
    )
    log_prior = (
        "ln(count(*)) - ln(sum(count(*)) over (partition by depth))" if prior else "-ln(count(*) over (partition by depth))"
    )
    return f"""
    pre as ({prefix}),
    fc as (select depth, class, term, sum(x) as fc from pre join x using (doc) group by depth, class, term),
    size as (select depth, class, parent, count(*) as n, {log_prior} as prior from pre group by depth, class, parent),
    tot as (select depth, class, sum(fc) as total from fc group by depth, class),
    cls as (select s.depth, s.class, s.parent, s.n, coalesce(t.total, 0) as total,
        (select count(*) from vocabulary) as n_features, s.prior,
        ln({alpha}) - ln(coalesce(t.total, 0) + {alpha} * (select count(*) from vocabulary)) as const
        from size s left join tot t using (depth, class))"""


def _jll_sql(alpha: float, source: str) -> str:
    """``jll(doc, depth, class, parent, jll)`` for all documents and classes."""
    return f"""
    rs as (select id as doc, coalesce(sum(x), 0) as rs from {source} left join x on x.doc = id group by id),
    s as (select doc, depth, class, sum(x * ln(1 + fc / {alpha})) as s from x join fc using (term)
          group by doc, depth, class),
    jll as (select r.doc, c.depth, c.class, c.parent, coalesce(s.s, 0) + r.rs * c.const + c.prior as jll
            from rs r join cls c on true left join s on s.doc = r.doc and s.depth = c.depth and s.class = c.class)"""


def _path_sql(levels: int, mode: str) -> str:
    """``score(doc, path, score)`` and, for prefixes, ``cls`` by name."""
    group = {"conditional": "doc, depth, parent", "independent": "doc, depth", "flattened": "doc, depth"}[mode]
    lp = f"""
    z as (select *, jll - max(jll) over (partition by {group}) as z from jll),
    lp as (select doc, depth, class, z - ln(sum(exp(z)) over (partition by {group})) as lp from z)"""
    if mode == "flattened":
        return f"{lp}, score as (select doc, class as path, lp as score from lp where depth = {levels})"
    return f"""{lp},
    score as (select lp.doc, p.class as path, sum(lp.lp) as score from cls p
        join lp on lp.depth <= p.depth and (lp.class = p.class or starts_with(p.class, lp.class || '|'))
        where p.depth = {levels} group by lp.doc, p.class)"""


def _best_sql(levels: int) -> str:
    """``best(doc, path)`` and ``conf(doc, depth, confidence, margin)``."""
    prefixes = " union all ".join(
        f"select doc, path, score, {d} as depth, array_to_string(string_split(path, '|')[1:{d}], '|') as class from score"
        for d in range(1, levels + 1)
    )
    return f"""
    best as (select doc, path from score qualify row_number() over (partition by doc order by score desc, path) = 1),
    mass as (select doc, depth, class, sum(exp(score)) as mass from ({prefixes}) group by doc, depth, class),
    conf as (select m.doc, m.depth,
        max(mass) filter (class = array_to_string(string_split(b.path, '|')[1:m.depth], '|')) as confidence,
        max(mass) filter (class = array_to_string(string_split(b.path, '|')[1:m.depth], '|'))
        - coalesce(max(mass) filter (class <> array_to_string(string_split(b.path, '|')[1:m.depth], '|')), 0) as margin
        from mass m join best b using (doc) group by m.doc, m.depth)"""


def _items_sql(body: str, upto: str = "best", mode: str = "conditional", prior: bool = True) -> str:
    """The whole chain over the items, as far as it is needed."""
    parts = [
        _terms_sql("items", True), _kept_sql("items", 4, 2), _vocabulary_sql(2), _TFIDF_X, _fit_sql(4, 0.01, prior),
        _jll_sql(0.01, "items"), _path_sql(4, mode), _best_sql(4),
    ]
    n = {"x": 4, "fit": 5, "jll": 6, "score": 7, "best": 8}[upto]
    return fx.with_views("items", body="," + ", ".join(parts[:n]) + " " + body)


def _docs_sql(body: str, parts: list[str]) -> str:
    return fx.with_views("docs", body="," + ", ".join(parts) + " " + body)


_DOC_FEATURES = [_terms_sql("docs", False), _kept_sql("docs", 2, 2), _vocabulary_sql(3)]

# ---- the same in Spark -----------------------------------------------------------------------------------------


def _docs(spark, folder):
    return pm.documents(fx.docs(spark, folder), "id", "descr", fx.DOC_LEVELS)


def _items(spark, folder):
    return pm.documents(fx.items(spark, folder), "id", "descr", fx.LEVELS)


def _key(column="class"):
    return F.array_join(column, "|")


def _fitted(spark, folder, settings=SETTINGS):
    """The documents to predict, their terms, and the model fitted on them."""
    docs = _items(spark, folder)
    terms = written(pm.terms_of(docs.rows, settings), "terms")
    asked = docs.rows.select(F.lit(0).alias("split"), "doc")
    return asked, terms.withColumn("split", F.lit(0)), pm.fit(docs, settings, fx.LEVELS, terms)


def _learned(spark, folder, settings):
    """The documents, their terms, and the vocabulary learned from them, without a model."""
    docs = _docs(spark, folder)
    terms = written(pm.terms_of(docs.rows, settings), "terms")
    asked = docs.rows.select(F.lit(0).alias("split"), "doc")
    return asked, terms.withColumn("split", F.lit(0)), pm.learn_terms(docs, settings, terms).vocabulary


def _round(name, digits=6):
    return F.round(F.col(name), digits).alias(name)


# ---- tokens and features ---------------------------------------------------------------------------------------

@query("tokenize", fx.with_views("docs", body=rf"""
    , t as (select id as doc, unnest(regexp_extract_all(lower(descr), '[\p{{L}}\p{{N}}_]{{2,}}')) as token from docs)
    select doc, token, count(*) as n from t where token not in {_STOPS_SQL} group by doc, token"""))
def tokenize(spark, folder):
    tokens = ft.tokenize(F.col("text"), "sklearn", STOPS)
    return _docs(spark, folder).rows.select("doc", F.explode(tokens).alias("token")).groupBy("doc", "token").agg(
        F.count("*").alias("n")
    )


@query("ngrams", _docs_sql("""
    select term, cast(sum(tf) as bigint) as tf, count(*) as df from tf group by term""", [_terms_sql("docs", True)]))
def ngrams(spark, folder):
    terms = ft.term_frequencies(_docs(spark, folder).rows.select("doc", "text"), SETTINGS)
    return terms.groupBy("term").agg(F.sum("tf").alias("tf"), F.count("*").alias("df"))


@query("fold_bigrams", fx.with_views("items", body=f"""
    , {_terms_sql('items', True, True)} select doc, term, tf from tf"""))
def fold_bigrams(spark, folder):
    folded = replace(SETTINGS, ordered_bigrams=False)
    return ft.term_frequencies(_items(spark, folder).rows.select("doc", "text"), folded)


@query("term_vocabulary", _docs_sql("""
    select term, df, cast(total as bigint) as total, round(idf, 6) as idf from vocabulary
    order by total desc, term limit 2000""", _DOC_FEATURES))
def term_vocabulary(spark, folder):
    vocabulary = _learned(spark, folder, replace(COUNTS, max_features=2000))[2]
    return vocabulary.select("term", "df", "total", _round("idf"))


@query("count_features", _docs_sql("select doc, term, x from x", [*_DOC_FEATURES, _COUNT_X]))
def count_features(spark, folder):
    _, terms, vocabulary = _learned(spark, folder, COUNTS)
    return ft.count_features(terms, vocabulary, COUNTS).select("doc", "term", "x")


@query("tfidf_features", _docs_sql("select doc, term, round(x, 6) as x from x", [*_DOC_FEATURES, _TFIDF_X]))
def tfidf_features(spark, folder):
    settings = replace(SETTINGS, ngram_range=(1, 1), min_df=3)
    _, terms, vocabulary = _learned(spark, folder, settings)
    return ft.features(terms, vocabulary, settings).select("doc", "term", _round("x"))


@query("input_quality", _docs_sql("""
    , k as (select doc, count(*) as n_tokens, count(v.term) as n_known
            from toks left join vocabulary v on v.term = t group by doc)
    select id as doc, coalesce(n_tokens, 0) as n_tokens, coalesce(n_known, 0) as n_known,
           case when coalesce(n_tokens, 0) > 0 then round(1 - n_known / n_tokens, 6) else 1.0::double end as oov_rate
    from docs left join k on k.doc = id""", _DOC_FEATURES))
def input_quality(spark, folder):
    asked, terms, vocabulary = _learned(spark, folder, COUNTS)
    return ft.input_quality(asked, terms, vocabulary).select("doc", "n_tokens", "n_known", _round("oov_rate"))


# ---- counts ----------------------------------------------------------------------------------------------------

@query("class_counts", _items_sql("select depth, class, n from cls", "fit"))
def class_counts(spark, folder):
    frequent = filters.filter_rare_paths(fx.items(spark, folder), fx.LEVELS, 2)
    docs = frequent.select(F.lit(0).alias("split"), bayes.path_of(fx.LEVELS).alias("path"))
    return bayes.class_counts(docs, 4).select("depth", _key().alias("class"), "n")


@query("class_term_counts", _items_sql("select depth, class, term, round(fc, 6) as fc from fc", "fit"))
def class_term_counts(spark, folder):
    model = _fitted(spark, folder)[2]
    classes = model.classes.select("split", "depth", "code", "class")
    terms = model.vocabulary.select("split", "tid", "term")
    return model.weights.join(classes, ["split", "code"]).join(terms, ["split", "tid"]).select(
        "depth", _key().alias("class"), "term", _round("fc")
    )


@query("class_totals", _items_sql("""
    select depth, class, round(total, 6) as total, n_features, round(ln(total + 0.01 * n_features), 6) as log_norm
    from cls""", "fit"))
def class_totals(spark, folder):
    classes = _fitted(spark, folder)[2].classes
    return classes.select(
        "depth", _key().alias("class"), _round("total"), "n_features", F.round(bayes.log_norm(0.01), 6).alias("log_norm")
    )


@query("path_index", fx.with_views("items", body="""
    select distinct 1 as depth, l1 as class, '' as parent from items
    union all select distinct 2, concat_ws('|', l1, l2), l1 from items
    union all select distinct 3, concat_ws('|', l1, l2, l3), concat_ws('|', l1, l2) from items
    union all select distinct 4, concat_ws('|', l1, l2, l3, l4), concat_ws('|', l1, l2, l3) from items"""))
def path_index(spark, folder):
    docs = fx.items(spark, folder).select(F.lit(0).alias("split"), bayes.path_of(fx.LEVELS).alias("path"))
    index = bayes.path_index(docs, 4)
    return index.select("depth", _key().alias("class"), _key("parent").alias("parent"))


@query("nb_priors", _items_sql("select depth, class, round(prior, 6) as prior from cls", "fit"))
def nb_priors(spark, folder):
    classes = _fitted(spark, folder)[2].classes
    return bayes.nb_priors(classes).select("depth", _key().alias("class"), _round("prior"))


@query("nb_fit", _items_sql("""
    select depth, class, parent, n, round(const, 6) as const, round(prior, 6) as prior from cls""", "fit", prior=False))
def nb_fit(spark, folder):
    classes = _fitted(spark, folder)[2].classes
    return bayes.class_params(classes, 0.01, False).select(
        "depth", _key().alias("class"), _key("parent").alias("parent"), "n", _round("const"), _round("prior")
    )


# ---- scores ----------------------------------------------------------------------------------------------------

@query("lookup_term_weights", _items_sql("select doc, depth, class, round(s, 4) as s from s", "jll"))
def lookup_term_weights(spark, folder):
    _, terms, model = _fitted(spark, folder)
    x = ft.features(terms, model.vocabulary, SETTINGS)
    names = model.classes.select("split", "depth", "code", "class")
    return bayes.lookup_term_weights(x, model.weights, [0.01]).join(names, ["split", "code"]).select(
        "doc", "depth", _key().alias("class"), F.round("s_0", 4).alias("s")
    )


def _values(spark, folder, what):
    asked, terms, model = _fitted(spark, folder)
    return pm.class_values(model, asked, terms, what, called=_key())


@query("nb_joint_log_likelihood", _items_sql("select doc, depth, class, round(jll, 4) as jll from jll", "jll"))
def nb_joint_log_likelihood(spark, folder):
    return _values(spark, folder, "jll").select("doc", "depth", "class", F.round("value", 4).alias("jll"))


@query("nb_flat_proba", _items_sql("""
    , z as (select *, exp(jll - max(jll) over (partition by doc, depth)) as e from jll)
    select doc, depth, class, round(e / sum(e) over (partition by doc, depth), 6) as proba from z""", "jll"))
def nb_flat_proba(spark, folder):
    return _values(spark, folder, "proba").select("doc", "depth", "class", F.round("value", 6).alias("proba"))


@query("nb_flat_predict", _items_sql("""
    select doc, depth, class from jll qualify row_number() over (partition by doc, depth order by jll desc, class) = 1""",
    "jll"))
def nb_flat_predict(spark, folder):
    return _values(spark, folder, "best").select("doc", "depth", "class")


def _mode(mode):
    @query(f"mode_{mode}", _items_sql("select doc, path, round(score, 4) as score from score", "score", mode))
    def run(spark, folder):
        return _values(spark, folder, mode).select("doc", F.col("class").alias("path"), F.round("value", 4).alias("score"))

    return run


for _name in ("independent", "conditional", "flattened"):
    _mode(_name)


def _predicted(spark, folder, candidates=None, settings=SETTINGS):
    asked, terms, model = _fitted(spark, folder, settings)
    return pm.predict(model, asked, terms, candidates)


@query("predict_path", _items_sql("select doc, path from best"))
def predict_path(spark, folder):
    return _predicted(spark, folder).select("doc", _key("path").alias("path"))


def _by_depth(predicted, *columns):
    zipped = F.arrays_zip("confidence", "margin")
    return predicted.select("*", F.posexplode(zipped).alias("at", "v")).select(
        *columns, (F.col("at") + 1).alias("depth"), F.col("v.confidence").alias("confidence"), F.col("v.margin").alias("margin")
    )


@query("prefix_confidence", _items_sql("select doc, depth, round(confidence, 6) as confidence from conf"))
def prefix_confidence(spark, folder):
    return _by_depth(_predicted(spark, folder), "doc").select("doc", "depth", _round("confidence"))


@query("prefix_margin", _items_sql("select doc, depth, round(margin, 6) as margin from conf", mode="independent"))
def prefix_margin(spark, folder):
    predicted = _predicted(spark, folder, [(0, 0.01, True, "independent")])
    return _by_depth(predicted, "doc").select("doc", "depth", _round("margin"))


_WIDE = ", ".join(
    f"max({name}) filter (depth = {d}) as {name[0]}{d}" for name in ("confidence", "margin") for d in (1, 2, 3, 4)
)
_TABLE_SQL = f"""
    , wide as (select doc, {_WIDE} from conf group by doc),
    k as (select doc, count(*) as n_tokens, count(v.term) as n_known
          from toks left join vocabulary v on v.term = t group by doc)
    select i.id, {", ".join(f"i.l{d} as actual_{d}" for d in (1, 2, 3, 4))},
           {", ".join(f"string_split(b.path, '|')[{d}] as predicted_{d}" for d in (1, 2, 3, 4))},
           {", ".join(f"round({n}{d}, 6) as {n}{d}" for n in "cm" for d in (1, 2, 3, 4))}, n_tokens, n_known,
           round(1 - n_known / n_tokens, 6) as oov_rate, i.descr
    from items i join best b on b.doc = i.id join wide w on w.doc = i.id join k on k.doc = i.id"""


def _table_columns(table_):
    return table_.selectExpr(
        "id", *[f"`Actual l{d}` as actual_{d}" for d in (1, 2, 3, 4)],
        *[f"`Predicted l{d}` as predicted_{d}" for d in (1, 2, 3, 4)],
        *[f"round(`L{d} Confidence`, 6) as c{d}" for d in (1, 2, 3, 4)],
        *[f"round(`L{d} Margin`, 6) as m{d}" for d in (1, 2, 3, 4)],
        "n_tokens", "n_known", "round(oov_rate, 6) as oov_rate", "descr",
    )


@query("prediction_table", _items_sql(_TABLE_SQL))
def prediction_table(spark, folder):
    model = _fitted(spark, folder)[2]
    items = fx.items(spark, folder)
    return _table_columns(pm.batch_predict(model, items, "id", "descr", ["id"], ["descr"]))


@query("batch_predict", _items_sql(_TABLE_SQL))
def batch_predict(spark, folder):
    """As ``prediction_table``, through a saved and re-read model."""
    path = scratch_path(spark, "model")
    store.write_model(_fitted(spark, folder)[2], path)
    model = store.read_model(spark, path)[0]
    return _table_columns(pm.batch_predict(model, fx.items(spark, folder), "id", "descr", ["id"], ["descr"]))


@query("predict_items")
def predict_items(spark, folder):
    """Items cleaned and fitted, the model stored with its cleaning state, raw items predicted from the folder alone."""
    from .cleaning import english_words, good_tokens

    settings, path = CleaningSettings(), scratch_path(spark, "model")
    english, good = written(english_words(spark, folder), "english"), written(good_tokens(spark, folder), "good")
    items = fx.items(spark, folder)
    done = clean_items(items, "descr", "cleaned", english, good, settings)
    model = pm.fit(pm.documents(done.items, "id", "cleaned", fx.LEVELS), SETTINGS, fx.LEVELS)
    store.write_model(model, path, state=store.CleaningState(settings, english, good, done.vocabulary))
    table_ = pm.predict_saved(spark, path, items, "id", "descr", "cleaned", ["id"])
    return table_.select(*[F.col(f"`{c}`").alias(c.replace(" ", "_")) for c in table_.columns])


@query("write_model", _items_sql("""
    select 'vocabulary' as part, null as class, term, df as n, round(idf, 6) as value from vocabulary
    union all select 'classes', class, null, n, round(total, 6) from cls
    union all select 'weights', class, term, depth, round(fc, 6) from fc""", "fit"))
def write_model(spark, folder):
    """The tables of a stored model as they are read again, one below the other."""
    path = scratch_path(spark, "model")
    store.write_model(_fitted(spark, folder)[2], path)
    model = store.read_model(spark, path)[0]
    nothing, long = F.lit(None).cast("string"), "bigint"
    classes = model.classes.select("split", "code", "depth", _key().alias("class"))
    weights = model.weights.join(classes, ["split", "code"]).join(model.vocabulary.select("split", "tid", "term"), ["split", "tid"])
    columns = ["part", "class", "term", "n", "value"]
    return (
        model.vocabulary.select(F.lit("vocabulary"), nothing, "term", F.col("df").cast(long), F.round("idf", 6)).toDF(*columns)
        .unionAll(model.classes.select(F.lit("classes"), _key(), nothing, F.col("n").cast(long), F.round("total", 6)).toDF(*columns))
        .unionAll(weights.select(F.lit("weights"), "class", "term", F.col("depth").cast(long), F.round("fc", 6)).toDF(*columns))
    )


@query("write_predictions", _items_sql("select doc as id, path from best"))
def write_predictions(spark, folder):
    predicted = _predicted(spark, folder).select(F.col("doc").alias("id"), _key("path").alias("path"))
    written_to = store.write_predictions(predicted, scratch_path(spark, "predictions"), {"n_folds": None})
    return spark.read.option("header", True).csv(written_to)


_CANDIDATES = [(0, 0.5, False, "conditional"), (1, 0.01, True, "flattened"), (2, 1.0, True, "independent")]


def _reuse_sql() -> str:
    """Three candidates over the same features."""
    shared = [_terms_sql("items", True), _kept_sql("items", 4, 2), _vocabulary_sql(2), _TFIDF_X]
    each = [
        f"select {i} as candidate, doc, path from (with {', '.join([_fit_sql(4, a, p), _jll_sql(a, 'items'), _path_sql(4, m)])} "
        "select doc, path from score qualify row_number() over (partition by doc order by round(score, 9) desc, path) = 1)"
        for i, a, p, m in _CANDIDATES
    ]
    return fx.with_views("items", body="," + ", ".join(shared) + " " + " union all ".join(each))


@query("reuse_counts", _reuse_sql())
def reuse_counts(spark, folder):
    """Three candidates that differ in alpha, prior and mode, from one pass over the counts."""
    return _predicted(spark, folder, _CANDIDATES).select("candidate", "doc", _key("path").alias("path"))


# ---- grids and cross-validation --------------------------------------------------------------------------------

def _grid():
    spec = {**SETTINGS.as_dict(), "ngram_range": (1, 2), "stop_words": STOPS}
    spec.update(alpha=[0.01, 0.5], prediction_mode=["conditional", "flattened"])
    return candidate_grid(spec, True)


_GRID_SQL = """
    select * from (values (0, '0.01', 'conditional'), (1, '0.01', 'flattened'), (2, '0.5', 'conditional'),
                          (3, '0.5', 'flattened')) v(candidate, alpha, prediction_mode)"""


def _cv_sql(mode: str = "conditional") -> str:
    """Five folds over the items with count features, each a separate fit, stacked: ``oof``.

    The whole chain once per fold; DuckDB runs it as one query."""
    folds = []
    views = ["hashed as (select *, cast(('0x' || substr(sha1(concat('0|', id)), 1, 16)) as ubigint) % 5 as fold from items)"]
    for f in range(5):
        chain = [
            _kept_sql("(select * from hashed where fold <> %d)" % f, 4, 2), _vocabulary_sql(3), _COUNT_X,
            _fit_sql(4, 0.01), _jll_sql(0.01, "(select * from hashed where fold = %d)" % f), _path_sql(4, mode),
            "best as (select doc, path from score qualify row_number() over (partition by doc order by score desc, path) = 1)",
        ]
        # all documents are looked up in the vocabulary of the fold; training reads the kept ones only
        folds.append(f"select * from (with {', '.join(chain)} select {f} as fold, doc, path from best)")
    views.append(_terms_sql("items", False).strip())
    views.append("oof as (" + " union all ".join(folds) + ")")
    return fx.with_views("items", body="," + ", ".join(views))


def _cv_tables(spark, folder, candidates=(COUNTS,), pending=None):
    return store.union_splits(
        cv.cross_validate(
            fx.items(spark, folder), "id", "descr", fx.LEVELS, list(candidates), SplitSettings(fold_key_col="id"),
            pending=pending,
        )
    )


@query("cross_validate", _cv_sql() + """
    select cast(fold as int) as fold, doc as id, string_split(path, '|')[1] as predicted_1,
           string_split(path, '|')[2] as predicted_2, string_split(path, '|')[3] as predicted_3,
           string_split(path, '|')[4] as predicted_4 from oof""")
def cross_validate(spark, folder):
    return _cv_tables(spark, folder).selectExpr(
        "fold", "id", *[f"`Predicted l{d}` as predicted_{d}" for d in (1, 2, 3, 4)]
    )


_FLAGS = ", ".join(
    "avg(case when " + " and ".join(f"string_split(path, '|')[{i}] = l{i}" for i in range(1, d + 1)) + " then 1.0 else 0.0 end)"
    f' as "L{d} Accuracy"'
    for d in range(1, 5)
)
_STD = ", ".join(f'round(stddev_samp("L{d} Accuracy"), 6) as "L{d} Accuracy"' for d in range(1, 5))
_ROUNDED = ", ".join(f'round("L{d} Accuracy", 6) as "L{d} Accuracy"' for d in range(1, 5))


@query("headline", _cv_sql() + f"""
    , joined as (select oof.fold, path, l1, l2, l3, l4 from oof join items on id = doc),
    per as (select cast(fold as varchar) as split, {_FLAGS} from joined group by fold)
    select split, {_ROUNDED} from per union all select 'all', {_ROUNDED} from (select {_FLAGS} from joined)
    union all select 'std across splits', {_STD} from per""")
def headline(spark, folder):
    table_ = ev.headline(_cv_tables(spark, folder), fx.LEVELS, "fold")
    return table_.select("split", *[_round(f"L{d} Accuracy") for d in range(1, 5)])


@query("split_metrics", fx.with_views("preds", body="""
    select candidate, fold, count(*) as n_rows,
           round(avg(case when coalesce(predicted_1, 'None') = actual_1 then 1.0 else 0.0 end), 6) as "L1 Accuracy",
           round(avg(case when coalesce(predicted_1, 'None') = actual_1 and coalesce(predicted_2, 'None') = actual_2
                     then 1.0 else 0.0 end), 6) as "L2 Accuracy"
    from preds group by candidate, fold"""))
def split_metrics(spark, folder):
    return ev.split_metrics(fx.predictions(spark, folder), fx.PRED_LEVELS, "fold").select(
        "candidate", "fold", "n_rows", _round("L1 Accuracy"), _round("L2 Accuracy")
    )


_METRICS_SQL = """
    , m as (select candidate, fold, count(*) as n_rows,
           avg(case when coalesce(predicted_1, 'None') = actual_1 then 1.0 else 0.0 end) as a1 from preds
           where not (candidate = 2 and fold = 4) group by candidate, fold),
    r as (select candidate, count(distinct fold) as splits_done, cast(sum(n_rows) as bigint) as n_rows, avg(a1) as a1,
          stddev_samp(a1) as s1 from m group by candidate)"""


def _results(spark, folder):
    pred = fx.predictions(spark, folder).where("not (candidate = 2 and fold = 4)")
    metrics = ev.split_metrics(pred, fx.PRED_LEVELS, "fold")
    return ev.grid_results(metrics, candidates_frame(spark, _grid()), 5, "fold")


@query("grid_results", fx.with_views("preds", body=f"""{_METRICS_SQL}
    select c.candidate, c.alpha, c.prediction_mode, r.splits_done, r.n_rows, round(r.a1, 6) as a1, round(r.s1, 6) as s1,
           coalesce(r.splits_done = 5, false) as complete
    from ({_GRID_SQL}) c left join r using (candidate)"""))
def grid_results(spark, folder):
    return _results(spark, folder).selectExpr(
        "candidate", "alpha", "prediction_mode", "splits_done", "n_rows", "round(`L1 Accuracy`, 6) as a1",
        "round(`L1 Accuracy std`, 6) as s1", "complete",
    )


@query("best_candidate", fx.with_views("preds", body=f"""{_METRICS_SQL}
    select candidate, round(a1, 6) as a1 from r where splits_done = 5 order by a1 desc, candidate limit 1"""))
def best_candidate(spark, folder):
    return ev.best_candidate(_results(spark, folder), "L1 Accuracy").selectExpr(
        "candidate", "round(`L1 Accuracy`, 6) as a1"
    )


@query("sort_results", fx.with_views("preds", body=f"""{_METRICS_SQL}
    select row_number() over (order by a1 desc, candidate) as place, candidate from r"""))
def sort_results(spark, folder):
    ordered = ev.sort_results(_results(spark, folder).where("splits_done > 0"), "L1 Accuracy")
    place = F.row_number().over(Window.orderBy(F.desc("L1 Accuracy"), "candidate"))  # one row per candidate
    return ordered.select(place.cast("bigint").alias("place"), "candidate")
