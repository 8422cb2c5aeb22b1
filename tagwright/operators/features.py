"""Tokens, n-grams, vocabulary, and count or TF-IDF features as long tables.

All tables carry a ``split`` column: cross-validation runs every split in one job, and a single model is split 0.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..session import placed, written
from .selection import kth_rows

TOKENS_AT_ONCE = 1 << 18  # of whole documents, counted together inside a task
# none of these finds a token with a space, so an n-gram tells its words
PATTERNS = {"whitespace": rf"[^{tx.SPACE}]+", "sklearn": rf"[{tx.WORD}]{{2,}}"}


def stop_word_list(stop_words) -> list[str]:
    """A list as given, Spark's English list for ``"english"``, or none."""
    if stop_words is None:
        return []
    return sorted(StopWordsRemover.loadDefaultStopWords("english")) if stop_words == "english" else list(stop_words)


def tokenize(text: Column, pattern: str = "whitespace", stop_words=None) -> Column:
    """Lower-case tokens of ``text`` without stop words. A pattern with a group yields the group."""
    group = 1 if pattern not in PATTERNS and re.compile(pattern).groups else 0
    found = F.regexp_extract_all(
        F.lower(F.coalesce(text, F.lit(""))), F.lit(PATTERNS.get(pattern, pattern)), F.lit(group)
    )
    stops = stop_word_list(stop_words)
    return F.filter(found, lambda t: ~t.isin(stops)) if stops else found


def ngrams(tokens: Column, lo: int, hi: int) -> Column:
    """All n-grams with ``lo <= n <= hi``, joined by one space.

    The n-grams are the (n-1)-grams zipped with the tokens n-1 places on, so the token array is built a fixed number
    of times, whatever the length of the text.
    """
    grams, current = [], tokens
    for n in range(1, hi + 1):
        if n > 1:
            left = F.greatest(F.size(tokens) - (n - 1), F.lit(0))
            current = F.zip_with(
                F.slice(current, F.lit(1), left), F.slice(tokens, F.lit(n), left), lambda a, b: F.concat_ws(" ", a, b)
            )
        if n >= lo:
            grams.append(current)
    return F.concat(*grams)


def fold_bigrams(term: Column) -> Column:
    """Two-word terms with their words in order, so that ``A B`` and ``B A`` are one feature."""
    parts = F.split(term, " ")
    return F.when(F.size(parts) == 2, F.array_join(F.array_sort(parts), " ")).otherwise(term)


def _distinct_grams(texts: pa.ListArray, owner: np.ndarray, lo: int, hi: int, stops: list[str], folded: bool):
    """Per n its ``owner, term, count`` arrays: the distinct n-grams of every owner. Texts are lists of tokens."""
    lengths = pc.list_value_length(texts).to_numpy(zero_copy_only=False)
    named = pc.dictionary_encode(pc.list_flatten(texts))
    order = pc.sort_indices(named.dictionary).to_numpy()
    tokens, rank = named.dictionary.take(pa.array(order)), np.empty(len(order), dtype=np.int64)
    rank[order] = np.arange(len(order))
    code, text = rank[named.indices.to_numpy()], np.repeat(np.arange(len(texts)), lengths)
    live = ~pc.is_in(tokens, value_set=pa.array(stops, pa.string())).to_numpy(zero_copy_only=False)[code]
    code, text = code[live], text[live]
    size = len(tokens)
    begin, gram, names = np.arange(len(code)), code, tokens  # where a gram begins, its number, and the name of each number
    for n in range(1, hi + 1):
        if n > 1:
            begin, gram = begin[begin < len(code) - (n - 1)], gram[begin < len(code) - (n - 1)]
            whole = text[begin] == text[begin + n - 1]
            begin, gram = begin[whole], gram[whole]
            left, right = gram, code[begin + n - 1]
            gram = left * size + right
            if folded and n == 2:  # tokens are numbered in their order
                counted = np.minimum(left, right) * size + np.maximum(left, right)
            else:
                counted = gram
            span = len(names) * size
        else:
            counted, span = gram, size
        if n >= lo or n == 1:
            pairs, count = np.unique(owner[text[begin]] * span + counted, return_counts=True)
            of, found = pairs // max(span, 1), pairs % max(span, 1)
            yield n, of, _named(found, names, tokens, n), count
        if 1 < n < hi:
            found, gram = np.unique(gram, return_inverse=True)
            names = _named(found, names, tokens, n)


def _named(found: np.ndarray, names: pa.Array, tokens: pa.Array, n: int) -> pa.Array:
    if n == 1:
        return tokens.take(pa.array(found))
    last = max(len(tokens), 1)
    return pc.binary_join_element_wise(names.take(pa.array(found // last)), tokens.take(pa.array(found % last)), " ")


def _counted(lo: int, hi: int, stops: list[str], folded: bool, quality: bool):
    """The function for ``mapInArrow``: rows of ``.., _t`` (the token lists of a document) to ``.., term, tf[, words]``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = batch.column("_t")
            texts = np.concatenate([[0], np.cumsum(pc.list_value_length(every).to_numpy(zero_copy_only=False))])
            held = pc.list_value_length(pc.list_flatten(every)).to_numpy(zero_copy_only=False)
            run_of = np.concatenate([[0], np.cumsum(held, dtype=np.int64)])[texts[1:]] // TOKENS_AT_ONCE
            cuts = [0, *(np.flatnonzero(np.diff(run_of)) + 1).tolist(), len(batch)]
            for a, b in zip(cuts, cuts[1:]):
                part, beside = every.slice(a, b - a), batch.slice(a, b - a).drop_columns(["_t"])
                owner = np.repeat(np.arange(b - a), np.diff(texts[a : b + 1]))
                for n, of, term, count in _distinct_grams(pc.list_flatten(part), owner, lo, hi, stops, folded):
                    if n < lo and not quality:
                        continue
                    none = np.zeros_like(count)
                    values = [pa.array(count if n >= lo else none)]
                    if quality:
                        values.append(pa.array(count if n == 1 else none))
                    columns = [*beside.take(pa.array(of)).columns, term, *values]
                    names = [*beside.schema.names, "term", "tf", "words"][: len(columns)]
                    yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def term_frequencies(docs: DataFrame, settings, keep=(), quality: bool = False) -> DataFrame:
    """``doc, *keep, term, tf[, words]`` from ``doc, *keep, text``.

    ``words`` counts the occurrences as a single token. The texts are partitioned by document and brought together as
    one row each, which moves the short side; a task then counts the n-grams of many documents at once by numbers of
    their tokens. With a token pattern of one's own an n-gram may be spelled in two ways, so terms are grouped there.
    """
    lo, hi = settings.ngram_range
    if settings.token_pattern in PATTERNS:
        rows = placed(docs, "doc").select("doc", *keep, tokenize(F.col("text"), settings.token_pattern).alias("_t"))
        given = rows.groupBy("doc", *keep).agg(F.collect_list("_t").alias("_t"))
        beside = [f"`{c}` {given.schema[c].dataType.simpleString()}" for c in ("doc", *keep)]
        schema = ", ".join([*beside, "term string", "tf long", *(["words long"] if quality else [])])
        stops = stop_word_list(settings.stop_words)
        return given.mapInArrow(_counted(lo, hi, stops, not settings.ordered_bigrams, quality), schema)
    tokens = tokenize(F.col("text"), settings.token_pattern, settings.stop_words)
    rows = placed(docs, "doc").select("doc", *keep, tokens.alias("_t"))
    grams = ngrams(F.col("_t"), lo, hi)
    if not settings.ordered_bigrams:
        grams = F.transform(grams, fold_bigrams)
    by = ["doc", *keep, "term"]
    if not quality:
        return rows.select("doc", *keep, F.explode(grams).alias("term")).groupBy(*by).agg(F.count("*").alias("tf"))
    if lo == 1 and settings.ordered_bigrams:
        # the tokens come first among the n-grams, so a position tells them apart
        placed_grams = rows.select("doc", *keep, F.size("_t").alias("_n"), F.posexplode(grams).alias("_i", "term"))
        return placed_grams.groupBy(*by).agg(
            F.count("*").alias("tf"), F.count_if(F.col("_i") < F.col("_n")).alias("words")
        )
    as_term = F.transform(grams, lambda t: F.struct(t.alias("term"), F.lit(1).alias("tf"), F.lit(0).alias("w")))
    as_word = F.transform("_t", lambda t: F.struct(t.alias("term"), F.lit(0).alias("tf"), F.lit(1).alias("w")))
    return rows.select("doc", *keep, F.inline(F.concat(as_term, as_word))).groupBy(*by).agg(
        F.sum("tf").alias("tf"), F.sum("w").alias("words")
    )


def term_vocabulary(cells: DataFrame, n_docs: DataFrame, settings) -> DataFrame:
    """``split, term, df, total, idf`` of the terms to keep.

    ``cells``: ``split, term, df, tf`` partial counts. ``n_docs``: ``split, n_docs``, one row per split.
    """
    lo, hi = settings.min_df, settings.max_df
    n = F.col("n_docs")
    kept = (
        cells.groupBy("split", "term").agg(F.sum("df").alias("df"), F.sum("tf").alias("total"))
        .join(F.broadcast(n_docs), "split")  # one row per split
        .where(
            (F.col("df") >= (F.lit(lo) * n if isinstance(lo, float) else F.lit(lo)))
            & (F.col("df") <= (F.lit(hi) * n if isinstance(hi, float) else F.lit(hi)))
        )
        .withColumn("idf", F.log((n + 1) / (F.col("df") + 1)) + 1)
        .drop("n_docs")
    )
    if settings.max_features is None:
        return kept
    kept = written(kept, "terms_kept")
    digits = [-F.col("total"), *[F.substring("term", 1, n) for n in (1, 2, 4, 8)]]
    last = kth_rows(kept, "split", digits, [-F.col("total"), F.col("term")], settings.max_features)
    if not last:
        return kept
    cuts = kept.sparkSession.createDataFrame(
        [(s, -r["o0"], r["o1"]) for s, r in last.items()], f"split {dict(kept.dtypes)['split']}, _total long, _term string"
    )
    above = (F.col("total") > F.col("_total")) | ((F.col("total") == F.col("_total")) & (F.col("term") <= F.col("_term")))
    # a split with fewer terms has no cut
    return kept.join(F.broadcast(cuts), "split", "left").where(F.coalesce(above, F.lit(True))).drop("_total", "_term")


def document_cells(tf: DataFrame, binary: bool, keep=()) -> DataFrame:
    """``*keep, term, df, tf`` partial counts of a term table: documents, and occurrences (documents if binary)."""
    occurrences = F.count("*") if binary else F.sum("tf")
    return tf.groupBy(*keep, "term").agg(F.count("*").alias("df"), occurrences.alias("tf"))


def _raw_weight(settings) -> Column:
    tf = F.lit(1.0) if settings.binary else F.col("tf").cast("double")
    if settings.vectorizer_kind == "count":
        return tf
    x = F.log(tf) + 1 if settings.sublinear_tf else tf
    return x * F.col("idf") if settings.use_idf else x


def features(tf: DataFrame, vocabulary: DataFrame, settings, unknown: bool = False) -> DataFrame:
    """``tf`` rows of vocabulary terms with their feature value ``x``, and their number if terms have one.

    ``unknown`` keeps the other rows too, without a value: prediction counts them in the same pass.
    """
    numbered = vocabulary.drop("df", "total", "reach")
    if unknown:
        known = tf.join(numbered, ["split", "term"], "left")
        known = known.withColumn("x", F.when((F.col("tf") > 0) & F.col("idf").isNotNull(), _raw_weight(settings)))
    else:
        known = tf.where("tf > 0").join(numbered, ["split", "term"]).withColumn("x", _raw_weight(settings))
    known = known.drop("idf", "tf")
    if settings.vectorizer_kind == "count" or settings.norm is None:
        return known
    row = Window.partitionBy("split", "doc")  # the terms of one document
    size = F.sum(F.abs("x")).over(row) if settings.norm == "l1" else F.sqrt(F.sum(F.col("x") * F.col("x")).over(row))
    return known.withColumn("x", F.col("x") / size)


def count_features(tf: DataFrame, vocabulary: DataFrame, settings) -> DataFrame:
    """Occurrences per document and vocabulary term, or 1 if binary."""
    value = F.lit(1.0) if settings.binary else F.col("tf").cast("double")
    known = tf.where("tf > 0").join(vocabulary.select("split", "term"), ["split", "term"])
    return known.withColumn("x", value).drop("tf")


def input_quality(docs: DataFrame, words: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``split, doc, n_tokens, n_known, oov_rate`` for every document, also those without a token.

    ``docs``: ``split, doc``; ``words``: ``split, doc, term, words`` with the occurrences as a single token. A
    document without tokens is unknown as a whole.
    """
    known = vocabulary.select("split", "term", F.lit(True).alias("_known"))
    counted = (
        words.where("words > 0")
        .join(known, ["split", "term"], "left")
        .groupBy("split", "doc")
        .agg(
            F.sum("words").alias("n_tokens"),
            F.coalesce(F.sum(F.when(F.col("_known"), F.col("words"))), F.lit(0)).alias("n_known"),
        )
    )
    share = 1 - F.col("n_known") / F.col("n_tokens")
    return (
        docs.select("split", "doc").join(counted, ["split", "doc"], "left")
        .fillna(0, ["n_tokens", "n_known"])
        .withColumn("oov_rate", F.when(F.col("n_tokens") > 0, share).otherwise(F.lit(1.0)))
    )


def ngram_stats(df: DataFrame, text_col: str, approximate: float | None = None) -> DataFrame:
    """One row: distinct words, distinct adjacent pairs, and their sum.

    ``approximate`` is the relative error of a sketch, which needs no shuffle of the pairs.
    """
    parts = tx.words(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))
    grams = df.select(F.explode(ngrams(parts, 1, 2)).alias("gram"))
    pair = F.col("gram").contains(" ")
    if approximate:
        counted = grams.agg(
            F.approx_count_distinct(F.when(~pair, F.col("gram")), approximate).alias("unique_unigrams"),
            F.approx_count_distinct(F.when(pair, F.col("gram")), approximate).alias("unique_bigrams"),
        )
    else:
        counted = grams.distinct().agg(
            F.count_if(~pair).alias("unique_unigrams"), F.count_if(pair).alias("unique_bigrams")
        )
    return counted.withColumn(
        "unique_unigrams_plus_bigrams", F.col("unique_unigrams") + F.col("unique_bigrams")
    )


def top_tokens(df: DataFrame, text_col: str, n: int = 25) -> DataFrame:
    """The ``n`` most frequent words, ties in word order."""
    return (
        df.select(F.explode(tx.words(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))).alias("token"))
        .groupBy("token").agg(F.count("*").alias("count"))
        .orderBy(F.desc("count"), "token").limit(n)
    )
