import pytest
from pyspark.sql import functions as F

from tagwright.functions import lists
from tagwright.operators import filters, joins
from tagwright.plans.prepare import cleaning_settings
from tagwright.sources import scan, store


def _file(tmp_path, name, text):
    path = tmp_path / name
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_delimited_quoting_and_nulls(spark, tmp_path):
    path = _file(tmp_path, "items.txt", 'id|t\n1|NA\n2|None\n3|""\n4|"a ""b"" |c"\n0005|nan\n')
    got = {r.id: r.t for r in scan.scan_delimited(spark, path).collect()}
    assert got == {"1": "NA", "2": None, "3": None, "4": 'a "b" |c', "0005": None}
    path = _file(tmp_path, "raw.txt", 'id|t\n1|"T" HANDLE\n2|3/4" PIPE\n')
    got = {r.id: r.t for r in scan.scan_delimited(spark, path, quoted=False).collect()}
    assert got == {"1": '"T" HANDLE', "2": '3/4" PIPE'}


def test_sources_and_records(spark, tmp_path):
    _file(tmp_path, "pull.sql", "select 1 as `a b`, cast(null as int) as n")
    df, record = scan.load_source(spark, query="pull", query_folder=str(tmp_path))
    assert df.dtypes == [("a b", "string"), ("n", "string")] and tuple(df.first()) == ("1", None)
    assert record["type"] == "sql" and len(record["query_sha256"]) == 16
    with pytest.raises(FileNotFoundError):
        scan.load_source(spark, query="absent", query_folder=str(tmp_path))
    with pytest.raises(ValueError):
        scan.load_source(spark)


def test_blacklist_files(spark, tmp_path):
    csv = _file(tmp_path, "b.csv", '﻿<ID>,Level\n "S-1" ,x\nS-2,y\n\nS-1,z\n')
    assert sorted(r.item for r in scan.scan_blacklist(spark, csv).collect()) == ["S-1", "S-2"]
    txt = _file(tmp_path, "b.txt", "S-1,kept whole\nS-2\n")
    assert sorted(r.item for r in scan.scan_blacklist(spark, txt, has_header=False).collect()) == ["S-1,kept whole", "S-2"]


def test_term_and_unit_lists(spark, tmp_path):
    terms = _file(tmp_path, "t.csv", "Color,x\nforest   green,1\n\"Red\",2\nRED\n\n")
    assert sorted(r.term for r in scan.scan_terms(spark, terms).collect()) == ["COLOR", "FOREST GREEN", "RED"]
    units = _file(tmp_path, "u.txt", "# comment\n\n> gr = Grade\nft = feet, ~foot , ~'\nKPA =\n")
    got = scan.unit_list(scan.scan_units(spark, units))
    assert got == [
        {"abbrev": "FT", "prefix": False, "forms": [("FEET", False), ("FOOT", True), ("'", True)]},
        {"abbrev": "GR", "prefix": True, "forms": [("GRADE", False)]},
        {"abbrev": "KPA", "prefix": False, "forms": []},
    ]
    lines = [f"{'>' * u['prefix']}{u['abbrev']} = " + ", ".join("~" * n + form for form, n in u["forms"]) for u in lists.UNITS]
    everything = scan.scan_units(spark, _file(tmp_path, "all.txt", "\n".join(lines)))
    key = lambda u: u["abbrev"]
    assert sorted(scan.unit_list(everything), key=key) == sorted(lists.UNITS, key=key)
    with pytest.raises(Exception, match="expected 'ABBREVIATION"):
        scan.scan_units(spark, _file(tmp_path, "bad.txt", "FT feet\n")).collect()
    settings = cleaning_settings(spark, units=units, colors=[terms], sizes=terms, field_width=30)
    assert settings.colors == ["COLOR", "FOREST GREEN", "RED"] == settings.sizes and settings.field_width == 30
    assert [u["abbrev"] for u in settings.units] == ["FT", "GR", "KPA"] and settings.markers == lists.MARKERS
    words = _file(tmp_path, "w.txt", " Ball\nball\n\n")
    assert [r.word for r in scan.scan_words(spark, words).collect()] == ["ball"]


def test_vocabulary_round_trip(spark, tmp_path):
    rows = [("<SIZE>IN", 3), ('A"B', 2), ("\\", 1), ("#1", 1)]
    store.write_vocabulary(spark.createDataFrame(rows, "word string, descriptions bigint"), str(tmp_path / "v"))
    assert sorted(tuple(r) for r in store.read_vocabulary(spark, str(tmp_path / "v")).collect()) == sorted(rows)


def test_dataset_round_trip(spark, tmp_path):
    items = spark.createDataFrame([("1", ' a "b" | c ', ""), ("2", None, "X")], "id string, raw string, clean string")
    vocabulary = spark.createDataFrame([("X", 1)], "word string, descriptions bigint")
    for stamp in ("20260101_000000", "20260202_000000"):
        store.write_dataset(str(tmp_path / stamp), items, vocabulary, {"cleaned_col": "clean", "stamp": stamp}, raw=items)
    got, words, meta = store.read_dataset(spark, str(tmp_path), "latest")
    assert meta["stamp"] == "20260202_000000" and words.count() == 1
    assert sorted(map(tuple, got.collect())) == [("1", ' a "b" | c ', ""), ("2", None, "X")]


def test_blacklist_join_keeps_rows_without_a_key(spark):
    df = spark.createDataFrame([(" a ", 1), ("b", 2), (None, 3)], "k string, v int")
    listed = spark.createDataFrame([("a",)], "item string")
    assert sorted(r.v for r in joins.apply_blacklist(df, listed, "k").collect()) == [2, 3]
    with pytest.raises(KeyError):
        joins.apply_blacklist(df, listed, "missing")


def test_tree_and_fan_out(spark):
    tree = spark.createDataFrame(
        [("a", "A", None, 1, 1), ("b", "B", "a", 2, 1), ("c", "C", "a", 2, 0), ("d", "D", None, 1, 1)],
        "id string, name string, parent_id string, level int, st_row_current int",
    )
    paths = joins.flatten_hierarchy(tree, 2, "st_row_current")
    assert [tuple(r) for r in paths.collect()] == [("a", "A", "b", "B")]
    sku = spark.createDataFrame(
        [("1", 1, "p1", "b", "v"), ("2", 1, "p2", "b", None), ("3", 1, "p3", None, "v")],
        "id string, cono int, product string, category_id string, vendor string",
    ).withColumn("st_row_current", F.lit(1))
    master = spark.createDataFrame(
        [(p, 1, "x;y", "c", "u") for p in ("p1", "p2", "p3")], "product string, cono int, descrip string, prodcat string, unspsc string"
    ).withColumn("st_row_current", F.lit(1))
    stock = spark.createDataFrame(
        [("p1", 1, "zdat", "l1"), ("p1", 1, "FC", "l2"), ("p2", 1, "else", "l3")],
        "product string, cono int, whse string, prodline string",
    ).withColumn("st_row_current", F.lit(1))
    got = joins.labeled_items(sku, master, stock, paths, depth=2).collect()
    assert {(r.ID, r.FullDesc, r.Prodline, r["Level 2 Name"]) for r in got} == {
        ("1", "X Y", "1_V_L1", "B"), ("1", "X Y", "1_V_L2", "B"), ("2", "X Y", None, "B")
    }
    assert len(got) == 3
    assert [r.ID for r in joins.unlabeled_items(sku, master, stock).collect()] == ["3"]


def test_rare_paths_group_nulls(spark):
    df = spark.createDataFrame([("a", None)] * 3 + [("a", "b")] * 2, "l1 string, l2 string")
    assert filters.filter_rare_paths(df, ["l1", "l2"], 3).count() == 3
    assert filters.rare_path_info(df, ["l1", "l2"], 3).first().asDict() == {
        "rare_path_threshold": 3, "rows_before": 5, "rows_dropped": 2, "rows_after": 3, "paths_before": 2, "paths_after": 1
    }
    with pytest.raises(KeyError):
        filters.keep_columns(df, ["l1"], required=["id"])


def test_cleaning_state_survives_storing(spark, tmp_path):
    from dataclasses import replace

    from tagwright.functions.lists import CleaningSettings
    from tagwright.operators.cleaning import clean_items
    from tagwright.sources import store

    settings = replace(CleaningSettings(), min_word_descriptions=1, append_fields={"v": "VEND"})
    items = spark.createDataFrame([("hammer 2 in blk", "a"), ("steel bolt 1/2 x 3 inch", None)], "t string, v string")
    english, good = spark.createDataFrame([("hammer",)], "word string"), spark.createDataFrame([("bolt",)], "term string")
    done = clean_items(items, "t", "c", english, good, settings)
    store.write_cleaning(store.CleaningState(settings, english, good, done.vocabulary), str(tmp_path / "s"))
    state = store.read_cleaning(spark, str(tmp_path / "s"))
    assert state.settings == settings
    again = clean_items(items, "t", "c", state.english, state.good_tokens, state.settings, state.vocabulary)
    assert sorted(again.items.collect(), key=str) == sorted(done.items.collect(), key=str)
