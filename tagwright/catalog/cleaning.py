"""Queries over the cleaning steps."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from ..functions import lists
from ..functions import text as tx
from ..functions.lists import CleaningSettings
from ..functions.patterns import unit_patterns
from ..operators import cleaning as cl
from ..operators import features as ft
from ..plans import prepare
from ..session import written
from . import fixtures as fx
from .registry import query, table

# English words of the queries: words of the English documents. Good tokens: the part types.
_ENGLISH_SQL = """
    select distinct w as word from (
        select unnest(regexp_extract_all(lower(text), '[a-z]+')) as w from documents where lang = 'en')
    where length(w) > 2"""
_UPPER_ITEMS = "select id, upper(descr) as text from items"
# DuckDB writes the capital of ß as one letter, Spark and Python as two
_UPPER_DOCS = "select doc_id, upper(replace(text, 'ß', 'ss')) as text from documents"
_SQUEEZE = r"trim(regexp_replace({}, '\s+', ' ', 'g'))"


def english_words(spark, folder):
    found = table(spark, folder, "documents").where("lang = 'en'").select(
        F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("word")
    )
    return found.where("length(word) > 2").distinct()


def good_tokens(spark, folder):
    return table(spark, folder, "part").select(F.upper("p_type").alias("term")).distinct()


def _upper_items(spark, folder):
    return fx.items(spark, folder).select("id", cl.upper_text(F.col("descr")).alias("text"))


def _upper_docs(spark, folder):
    return fx.documents(spark, folder).select("doc_id", cl.upper_text(F.col("text")).alias("text"))


def _texts(df):
    """Distinct texts with their copies, as the corpus steps take them."""
    return written(cl.distinct_texts(df, "text"), "texts")


def _back(df, done, key):
    """The texts of the corpus steps beside the rows they came from."""
    steps = written(done.select(F.col("id").alias("_id"), F.col("text").alias("_text")), "done")
    keyed = df.select(F.col(key), cl.text_id(F.col("text")).alias("_id"))
    return keyed.join(steps, "_id", "left").select(key, F.col("_text").alias("text"))


# ---- corpus counts --------------------------------------------------------------------------------------------

_PIECES = f"""
    , t as ({_UPPER_DOCS}),
    b as (select doc_id, text, regexp_extract_all(text, '\\S+') as parts,
                 len(regexp_extract_all(substr(text, 1, 24), '\\S+')) as k,
                 length(text) > 25 and substr(text, 25, 1) = ' ' and substr(text, 24, 1) <> ' '
                   and substr(text, 26, 1) <> ' ' and regexp_matches(substr(text, 1, 24), '\\S')
                   and regexp_matches(substr(text, 26), '\\S') as at_boundary
          from t),
    counts as (select word, count(*) as n from (
        select unnest(case when at_boundary then list_concat(parts[1:k - 1], parts[k + 2:]) else parts end) as word
        from b) group by word)"""


@query("boundary_word_counts", fx.with_views("docs", body=f"{_PIECES} select word, n from counts"))
def boundary_word_counts(spark, folder):
    return cl.boundary_word_counts(_texts(_upper_docs(spark, folder)))


@query("clean_03_repair_split", fx.with_views("docs", body=f"""{_PIECES},
    p as (select *, parts[k] as l, parts[k + 1] as r from b where at_boundary),
    f as (select doc_id from p join counts j on j.word = l || r
          left join counts a on a.word = l left join counts c on c.word = r
          where j.n >= 3 and j.n >= least(coalesce(a.n, 0), coalesce(c.n, 0)))
    select b.doc_id, case when f.doc_id is null then text else substr(text, 1, 24) || substr(text, 26) end as text
    from b left join f using (doc_id)"""))
def clean_03_repair_split(spark, folder):
    docs = _upper_docs(spark, folder)
    start = _texts(docs)
    pairs = written(cl.split_pairs(start), "pairs")
    return _back(docs, cl.repair_split_words(start, pairs), "doc_id")


@query("word_document_counts", fx.with_views("docs", body=f"""
    , t as ({_UPPER_DOCS})
    select word, count(*) as descriptions from (
        select distinct doc_id, trim(w, '.,;:!?"''()[]{{}}') as word
        from (select doc_id, unnest(regexp_extract_all(text, '\\S+')) as w from t)) group by word"""))
def word_document_counts(spark, folder):
    return cl.word_document_counts(_texts(_upper_docs(spark, folder)), strip=True)


@query("learn_vocabulary", fx.with_views("docs", body=f"""
    , t as ({_UPPER_DOCS})
    select word, count(*) as descriptions from (
        select distinct doc_id, unnest(regexp_extract_all(text, '\\S+')) as word from t)
    group by word having count(*) >= 5 or contains(word, '<')"""))
def learn_vocabulary(spark, folder):
    return cl.learn_vocabulary(_texts(_upper_docs(spark, folder)), 5)


# ---- single steps ---------------------------------------------------------------------------------------------

@query("clean_01_upper", _UPPER_DOCS)
def clean_01_upper(spark, folder):
    return _upper_docs(spark, folder)


@query("clean_04_markers", fx.with_views("items", body=rf"""
    , t as ({_UPPER_ITEMS}), p as (select '\(DV\)|\[DV\]|\(DC\)|\[DC\]|\(BP\)|\(R-[^)\]]*\)' as p)
    select id, case when regexp_matches(text, p) then {_SQUEEZE.format("regexp_replace(text, p, ' ', 'g')")}
                    else text end as text from t, p"""))
def clean_04_markers(spark, folder):
    return _upper_items(spark, folder).withColumn("text", cl.remove_markers(F.col("text"), lists.MARKERS))


_BARE = """trim(w, '.,;:!?"''()[]{}')"""
_IN_VOCABULARY = """({0} in (select word from english) or {0} like '%ies' and concat(left({0}, length({0}) - 3), 'y') in
    (select word from english) or {0} like '%es' and left({0}, length({0}) - 2) in (select word from english)
    or {0} like '%s' and left({0}, length({0}) - 1) in (select word from english))"""
_FIRST_WORDS = rf"""
    , english as ({_ENGLISH_SQL}), good as (select distinct lower(p_type) as term from part),
    t as ({_UPPER_ITEMS}),
    fw as (select id, text, regexp_extract(text, '\S+') as w from t),
    seen as (select word, count(*) as n from (select distinct id, {_BARE} as word
             from (select id, unnest(regexp_extract_all(text, '\S+')) as w from t)) group by word),
    d as (select w, {_BARE} as bare, lower({_BARE}) as c, count(*) as descriptions from fw where w <> '' group by w),
    parts as (select distinct c, unnest(string_split(c, '-')) as p from d),
    hyphen as (select c from parts where length(p) >= 3 group by c
               having bool_and({_IN_VOCABULARY.format('p')})),
    cuts as (select distinct c, unnest(range(3, length(c) - 2)) as i from d),
    joined as (select distinct c from (select c, left(c, i) as h, substr(c, i + 1) as r from cuts)
               where h in (select word from english) and {_IN_VOCABULARY.format('r')}),
    f as (select *, length(c) > 2 and regexp_full_match(replace(c, '-', ''), '\p{{L}}+') as letters from d),
    decided as (select w, descriptions, case
        when length(c) > 2 and not regexp_matches(c, '\d') and c in (select word from english) then 'real word'
        when c in (select term from good) then 'good token'
        when letters and (case when contains(c, '-') then c in (select c from hyphen)
             else {_IN_VOCABULARY.format('c')} or c in (select c from joined) end) then 'word form'
        when regexp_full_match(replace(bare, '-', ''), '\p{{L}}+')
             and bare in (select word from seen where n >= 50) then 'common abbreviation' end as reason from f)"""


def _decisions(spark, folder, texts, settings=None):
    return cl.first_word_decisions(
        texts, written(english_words(spark, folder), "english"), good_tokens(spark, folder),
        settings or CleaningSettings(),
    )


@query("clean_05_first_word", fx.with_views("items", body=rf"""{_FIRST_WORDS}
    select id, case when w = '' or reason is not null then text
                    else regexp_extract(text, '(?s)^\s*\S+\s*(.*)$', 1) end as text
    from fw left join decided using (w)"""))
def clean_05_first_word(spark, folder):
    items = _upper_items(spark, folder)
    start = _texts(items)
    removed = written(_decisions(spark, folder, start).where("reason is null").select("word"), "removed")
    return _back(items, cl.strip_first_word(start, removed), "id")


@query("first_word_report", fx.with_views("items", body=f"""{_FIRST_WORDS}
    , kept as (select 'kept' as kind, reason as word, cast(sum(descriptions) as bigint) as descriptions from decided
               where reason in ('word form', 'common abbreviation') group by reason),
    removed as (select 'removed' as kind, {_BARE} as word, cast(sum(descriptions) as bigint) as descriptions
                from decided where reason is null group by 2 order by 3 desc, 2 limit 25)
    select * from kept union all select * from removed"""))
def first_word_report(spark, folder):
    decisions = written(_decisions(spark, folder, _texts(_upper_items(spark, folder))), "decisions")
    kept, removed = cl.first_word_report(decisions)
    kinds = [
        kept.select(F.lit("kept").alias("kind"), F.col("reason").alias("word"), "descriptions"),
        removed.select(F.lit("removed").alias("kind"), "word", "descriptions"),
    ]
    return kinds[0].unionByName(kinds[1])


_DOC_WORDS_SQL = """
    select distinct lower(w) as c from (select unnest(regexp_extract_all(text, '[a-zA-Z-]+')) as w from documents)"""


@query("word_form", f"""
    with english as ({_ENGLISH_SQL}), d as (select c from ({_DOC_WORDS_SQL}) where length(c) > 2 and
        regexp_full_match(replace(c, '-', ''), '[a-z]+')),
    parts as (select c, unnest(string_split(c, '-')) as p from d where contains(c, '-')),
    hyphen as (select c from parts where length(p) >= 3 group by c having bool_and({_IN_VOCABULARY.format('p')})),
    cuts as (select c, unnest(range(3, length(c) - 2)) as i from d where not contains(c, '-')),
    joined as (select distinct c from (select c, left(c, i) as h, substr(c, i + 1) as r from cuts)
               where h in (select word from english) and {_IN_VOCABULARY.format('r')})
    select c as word from d
    where c in (select c from hyphen) or c in (select c from joined)
       or not contains(c, '-') and {_IN_VOCABULARY.format('c')}""")
def word_form(spark, folder):
    words = table(spark, folder, "documents").select(
        F.explode(F.regexp_extract_all("text", F.lit("[a-zA-Z-]+"), F.lit(0))).alias("w")
    ).select(F.lower("w").alias("clean")).distinct()
    english = written(english_words(spark, folder), "english")
    return cl.english_readings(words, english).where("word_form").select(F.col("clean").alias("word"))


@query("word_list_semi_join", f"""
    with english as ({_ENGLISH_SQL}), d as ({_DOC_WORDS_SQL})
    select c as word from d where c in (select word from english) and length(c) > 2""")
def word_list_semi_join(spark, folder):
    words = table(spark, folder, "documents").select(
        F.explode(F.regexp_extract_all("text", F.lit("[a-zA-Z-]+"), F.lit(0))).alias("w")
    ).select(F.lower("w").alias("clean")).distinct()
    english = written(english_words(spark, folder), "english")
    return cl.english_readings(words, english).where("real").select(F.col("clean").alias("word"))


@query("measurement")
def measurement(spark, folder):
    patterns = unit_patterns(lists.UNITS)
    words = fx.items(spark, folder).select(F.explode(tx.words(F.upper("descr"))).alias("word")).distinct()
    return cl.with_measurement(words, patterns).select("word", "measurement")


def _marked_term(term: str) -> str:
    """A term as RE2 finds it between word marks: every run of word characters stands between \\x01 and \\x02."""
    import re

    runs = re.split(r"([A-Z0-9<>]+)", term)
    return "".join(
        f"\\x01{r}\\x02" if i % 2 else "".join("\\s+" if ch == " " else re.escape(ch) for ch in r)
        for i, r in enumerate(runs)
    )


_COLOR_PATTERN = "|".join(_marked_term(t) for t in sorted(lists.default_colors(), key=lambda t: (-len(t), t)))


@query("clean_06_colors", fx.with_views("items", body=f"""
    , t as (select id, regexp_replace(upper(descr), '([A-Z0-9<>]+)', chr(1) || '\\1' || chr(2), 'g') as text from items)
    select id, regexp_replace(regexp_replace(text, '{_COLOR_PATTERN}', '<COLOR>', 'g'), '[\\x01\\x02]', '', 'g') as text
    from t"""))
def clean_06_colors(spark, folder):
    return _upper_items(spark, folder).withColumn("text", cl.replace_colors(F.col("text"), lists.default_colors()))


@query("clean_07_units")
def clean_07_units(spark, folder):
    patterns = unit_patterns(lists.UNITS)
    return tx.apply_steps(_upper_items(spark, folder), "text", cl.standardize_units(patterns))


@query("clean_08_glue")
def clean_08_glue(spark, folder):
    patterns = unit_patterns(lists.UNITS)
    return tx.apply_steps(_upper_items(spark, folder), "text", cl.glue_units(patterns))


@query("clean_09_sizes")
def clean_09_sizes(spark, folder):
    patterns = unit_patterns(lists.UNITS)
    return tx.apply_steps(_upper_items(spark, folder), "text", cl.replace_sizes(lists.default_sizes(), patterns))


# a mark between two letters goes: pairs may share a letter, so the even and the odd ones are taken in turn
_MARK = r"([\p{L}\p{Nl}\p{No}])[.'’]([\p{L}\p{Nl}\p{No}])"
_MARK_SQL = _MARK.replace("'", "''")
_JOINED = f"regexp_replace(regexp_replace(text, '{_MARK_SQL}', '\\1\\2', 'g'), '{_MARK_SQL}', '\\1\\2', 'g')"


@query("clean_10_punctuation", rf"""
    with t as ({_UPPER_DOCS})
    select doc_id, replace(regexp_replace(text, '(<[A-Z]+>)|[^\p{{L}}\p{{N}}_\s]|_', '\1', 'g'), '><', '> <') as text
    from t""")
def clean_10_punctuation(spark, folder):
    return _upper_docs(spark, folder).withColumn("text", cl.remove_punctuation(F.col("text"), "delete"))


@query("clean_10_punctuation_space", rf"""
    with t as ({_UPPER_DOCS}),
    kept as (select doc_id, regexp_replace(text, '(<[A-Z]+>)|[^\p{{L}}\p{{N}}_\s]|_', chr(1) || '\1', 'g') as text from (
        select doc_id, {_JOINED} as text from t))
    select doc_id, replace(replace(replace(text, chr(1) || '<', '<'), chr(1), ' '), '><', '> <') as text from kept""")
def clean_10_punctuation_space(spark, folder):
    return _upper_docs(spark, folder).withColumn("text", cl.remove_punctuation(F.col("text"), "space"))


@query("clean_11_rare_words", fx.with_views("docs", body=rf"""
    , t as ({_UPPER_DOCS}), words as (select doc_id, unnest(regexp_extract_all(text, '\S+')) as w,
        generate_subscripts(regexp_extract_all(text, '\S+'), 1) as i from t),
    vocabulary as (select w from (select distinct doc_id, w from words) group by w having count(*) >= 5)
    select t.doc_id, coalesce(k.text, '') as text from t left join (
        select doc_id, string_agg(w, ' ' order by i) as text from words
        where contains(w, '<') or w in (select w from vocabulary) group by doc_id) k using (doc_id)"""))
def clean_11_rare_words(spark, folder):
    docs = _upper_docs(spark, folder)
    start = _texts(docs)
    vocabulary = written(cl.learn_vocabulary(start, 5), "vocabulary")
    return _back(docs, cl.remove_rare_words(start, vocabulary), "doc_id")


_PLACED = "regexp_replace(upper(descr), '[0-9]+', ' <SIZE> '{})"


@query("clean_12_collapse", fx.with_views("items", body=rf"""
    , t as (select id, unnest(regexp_extract_all({_PLACED.format(", 'g'")}, '\S+')) as w,
        generate_subscripts(regexp_extract_all({_PLACED.format(", 'g'")}, '\S+'), 1) as i from items),
    p as (select *, lag(w) over (partition by id order by i) as before from t)
    select id, string_agg(w, ' ' order by i) as text from p
    where not (w in ('<SIZE>', '<COLOR>') and coalesce(before, '') = w) group by id"""))
def clean_12_collapse(spark, folder):
    placed = fx.items(spark, folder).selectExpr("id", _PLACED.format("") + " as text")
    return placed.withColumn(
        "text", cl.tidy_spaces(cl.collapse_repeats(F.col("text"), lists.PLACEHOLDERS))
    )


@query("clean_13_tidy", f"select doc_id, {_SQUEEZE.format('text')} as text from documents")
def clean_13_tidy(spark, folder):
    return table(spark, folder, "documents").select("doc_id", cl.tidy_spaces(F.col("text")).alias("text"))


@query("append_markers", fx.with_views("loose", body=r"""
    , v as (select id, descr, nullif(trim(regexp_replace(upper(l2), '[^0-9A-Za-z]+', '_', 'g'), '_'), '') as a,
            nullif(trim(regexp_replace(upper(id), '[^0-9A-Za-z]+', '_', 'g'), '_'), '') as b from loose)
    select id, case when descr = '' then '' else trim(concat(descr, ' ', coalesce('TYPE_' || a, 'TYPE_None'),
        case when length(b) >= 3 then ' KEY3_' || left(b, 3) else '' end,
        case when length(b) >= 5 then ' KEY5_' || left(b, 5) else '' end)) end as descr from v"""))
def append_markers(spark, folder):
    fields = {"l2": "TYPE", "id": {"prefix": "KEY", "levels": [5, 3]}}
    return cl.append_markers(fx.loose_items(spark, folder), "descr", fields, True).select("id", "descr")


@query("step_changes", fx.with_views("items", body=rf"""
    , s as (select upper(descr) as b, trim(regexp_replace(upper(descr), '\(DV\)', '', 'g')) as a from items)
    select count(*) filter (a <> b) as changed, count(*) as rows,
           count(*) filter (a <> b) / greatest(count(*), 1) as share from s"""))
def step_changes(spark, folder):
    before = _upper_items(spark, folder)
    after = before.withColumn("after", cl.remove_markers(F.col("text"), lists.MARKERS))
    return cl.step_changes(after, "text", "after")


# ---- the whole job --------------------------------------------------------------------------------------------

@query("clean_items")
def clean_items(spark, folder):
    return cl.clean_items(
        fx.items(spark, folder).select("id", "descr"), "descr", "cleaned", english_words(spark, folder),
        good_tokens(spark, folder),
    ).items


def _every(spark, folder, n):
    """A blacklist of the items whose key is divisible by ``n``."""
    return fx.items(spark, folder).where(f"cast(substr(id, 3) as int) % {n} = 0").select(F.col("id").alias("item"))


def _prepared(spark, folder):
    return prepare.prepare_items(
        fx.loose_items(spark, folder), "descr", "cleaned", english_words(spark, folder), good_tokens(spark, folder),
        replace(CleaningSettings(), min_word_descriptions=5), blacklist=_every(spark, folder, 50), blacklist_col="id",
        levels=fx.LEVELS,
    )


@query("prepare_items")
def prepare_items(spark, folder):
    return _prepared(spark, folder)[0].items


# every description holds a size, and its placeholder is always kept: cleaning empties none
_PREPARED_SQL = f"""
    , k as (select *, cast(substr(id, 3) as int) as k, {' or '.join(f"trim(coalesce({c}, '')) = ''" for c in fx.LEVELS)}
            as unlabelled, trim(coalesce(descr, '')) = '' as blank from loose),
    listed as (select * from k where k % 50 <> 0),
    done as (select * from listed where not unlabelled and not blank)"""
_PREPARED_COUNTS_SQL = """
    select (select count(*) from k) as raw_rows, (select count(*) from k) - (select count(*) from listed) {more} as
           blacklisted_dropped, (select count(*) from listed where unlabelled) as missing_label_dropped,
           (select count(*) from listed where not unlabelled and blank) as blank_raw_dropped,
           0::bigint as emptied_by_cleaning_dropped, (select count(*) from {left}) as cleaned_rows,
           (select count(*) from k) - (select count(*) from {left}) as total_dropped"""


@query("prepare_counts", fx.with_views("loose", body=_PREPARED_SQL + _PREPARED_COUNTS_SQL.format(more="", left="done")))
def prepare_counts(spark, folder):
    return _prepared(spark, folder)[1]


@query("blacklist_prepared", fx.with_views("loose", body=f"""{_PREPARED_SQL}
    select id, descr, l1, l2, l3, l4 from done where k % 20 <> 0"""))
def blacklist_prepared(spark, folder):
    done, counts = _prepared(spark, folder)
    left, _ = prepare.blacklist_prepared(done.items, counts, _every(spark, folder, 20), "id")
    return left.select("id", "descr", *fx.LEVELS)


@query("blacklist_prepared_counts", fx.with_views("loose", body=f"""{_PREPARED_SQL},
    kept as (select * from done where k % 20 <> 0)""" + _PREPARED_COUNTS_SQL.format(
        more="+ (select count(*) from done) - (select count(*) from kept)", left="kept")))
def blacklist_prepared_counts(spark, folder):
    done, counts = _prepared(spark, folder)
    return prepare.blacklist_prepared(done.items, counts, _every(spark, folder, 20), "id")[1]


@query("ngram_stats", r"""
    with t as (select doc_id, unnest(regexp_extract_all(text, '\S+')) as w,
               generate_subscripts(regexp_extract_all(text, '\S+'), 1) as i from documents),
    p as (select w, lead(w) over (partition by doc_id order by i) as x from t)
    select count(distinct w) as unique_unigrams, count(distinct case when x is not null then w || ' ' || x end)
           as unique_bigrams, count(distinct w) + count(distinct case when x is not null then w || ' ' || x end)
           as unique_unigrams_plus_bigrams from p""")
def ngram_stats(spark, folder):
    return ft.ngram_stats(fx.documents(spark, folder), "text")


@query("top_tokens", r"""
    select token, count(*) as count from (select unnest(regexp_extract_all(text, '\S+')) as token from documents)
    group by token order by count(*) desc, token limit 25""")
def top_tokens(spark, folder):
    return ft.top_tokens(fx.documents(spark, folder), "text")
