"""Queries over sources, filters, joins and splits."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import functions as F

from ..operators import filters, joins, splits
from ..plans.crossval import pending_work
from ..session import scratch_path, written
from ..sources import scan, store
from ..sources.runlog import RunLog
from . import fixtures as fx
from .registry import query, table

# ---- sources and sinks ----------------------------------------------------------------------------------------


@query("scan_query", """
    select cast(p_partkey as varchar) as p_partkey, p_name, cast(p_size as varchar) as p_size from part""")
def scan_query(spark, folder):
    table(spark, folder, "part").createOrReplaceTempView("part_for_scan")
    return scan.scan_query(spark, "select p_partkey, p_name, p_size from part_for_scan")


def _delimited_items(spark, folder, quoted=True):
    path = scratch_path(spark, "delimited")
    store.write_delimited(fx.items(spark, folder), path)
    return path


@query("scan_delimited", fx.with_views("items", body="select * from items"))
def scan_delimited(spark, folder):
    return scan.scan_delimited(spark, _delimited_items(spark, folder))


_MARKED = """
    select cast(l_orderkey as string) as k, cast(l_linenumber as string) as n,
           case when l_linenumber = 1 then 'NULL' when l_linenumber = 2 then 'nan' when l_linenumber = 3 then 'NA'
                when l_linenumber = 4 then '' when l_linenumber = 5 then '<NA>' else l_returnflag end as v
    from lineitem"""


@query("null_markers", f"""
    select k, n, case when v in ('', 'NULL', 'null', 'None', 'nan', 'NaN', '<NA>') then null else v end as v
    from ({_MARKED})""")
def null_markers(spark, folder):
    lines = table(spark, folder, "lineitem")
    return scan.null_markers(spark.sql(_MARKED.replace("from lineitem", "from {lineitem}"), lineitem=lines))


@query("load_source", fx.with_views("items", body="select id, descr, l1 from items"))
def load_source(spark, folder):
    found, record = scan.load_source(spark, path=_delimited_items(spark, folder), query="not used")
    assert record["type"] == "file"
    return found.select("id", "descr", "l1")


@query("load_source_query", "select cast(o_orderkey as varchar) as o_orderkey, o_orderstatus from orders")
def load_source_query(spark, folder):
    """The rows of a named SQL text, found in a folder of such texts."""
    table(spark, folder, "orders").createOrReplaceTempView("orders_to_load")
    with tempfile.TemporaryDirectory() as texts:
        with open(os.path.join(texts, "orders.sql"), "w", encoding="utf-8") as f:
            f.write("select o_orderkey, o_orderstatus from orders_to_load")
        found, record = scan.load_source(spark, query="orders", query_folder=texts)
    assert record["type"] == "sql" and len(record["query_sha256"]) == 16
    return found


@query("to_string_frame", """
    select cast(o_orderkey as varchar) as o_orderkey, cast(o_custkey as varchar) as o_custkey, o_orderstatus
    from orders""")
def to_string_frame(spark, folder):
    return scan.to_string_frame(table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"))


def _blacklist_file(spark, folder):
    path = scratch_path(spark, "blacklist") + ".csv"
    listed = fx.items(spark, folder).where("cast(substr(id, 3) as int) % 50 = 0")
    listed.select(F.concat(F.lit('" '), "id", F.lit('",'), "l4").alias("<ID>")).write.option("header", True).option(
        "sep", "\x01"
    ).option("quote", "").option("ignoreLeadingWhiteSpace", False).csv(path)
    return path


@query("scan_blacklist", fx.with_views("items", body="""
    select distinct id as item from items where cast(substr(id, 3) as int) % 50 = 0"""))
def scan_blacklist(spark, folder):
    return scan.scan_blacklist(spark, _blacklist_file(spark, folder))


@query("scan_terms", """
    select distinct upper(concat(p_name, ' ', p_type)) as term from part""")
def scan_terms(spark, folder):
    path = scratch_path(spark, "terms") + ".txt"
    table(spark, folder, "part").select(
        F.concat(F.lit('  "'), "p_name", F.lit("   "), "p_type", F.lit('" '))
    ).write.text(path)
    return scan.scan_terms(spark, path)


@query("scan_units", """
    select distinct upper(replace(p_brand, '#', '')) as abbrev, p_size = 7 as prefix,
           concat(upper(p_name), ':false,', upper(p_type), ':true') as forms
    from part""")
def scan_units(spark, folder):
    path = scratch_path(spark, "units") + ".txt"
    line = F.concat(
        F.when(F.col("p_size") == 7, ">").otherwise(""), F.replace("p_brand", F.lit("#"), F.lit("")), F.lit(" = "),
        "p_name", F.lit(" ,, ~"), "p_type",
    )
    lines = table(spark, folder, "part").select(line.alias("value"))
    lines.unionByName(spark.sql("select '# comment' as value union all select '  '")).write.text(path)
    text = F.transform("forms", lambda f: F.concat(f["form"], F.lit(":"), f["number_only"].cast("string")))
    return scan.scan_units(spark, path).select(
        "abbrev", "prefix", F.concat_ws(",", text).alias("forms")
    ).distinct()


@query("write_dataset", fx.with_views("items", body="select id, descr, l1, l4 from items"))
def write_dataset(spark, folder):
    path = scratch_path(spark, "dataset")
    data = fx.items(spark, folder).select("id", "descr", "l1", "l4")
    words = data.select(F.explode(F.split("descr", " ")).alias("word")).groupBy("word").agg(
        F.count("*").alias("descriptions")
    )
    record = store.write_dataset(path, data, words, {"cleaned_col": "descr"})
    return spark.read.option("header", True).option("sep", "|").csv(f"{path}/{record['files']['cleaned']}")


@query("read_dataset", fx.with_views("loose", body="""
    select id, coalesce(case when trim(descr) = '' then null else descr end, '') as descr from loose"""))
def read_dataset(spark, folder):
    path = scratch_path(spark, "dataset")
    data = fx.loose_items(spark, folder).select("id", F.when(F.trim("descr") != "", F.col("descr")).alias("descr"))
    words = data.groupBy("descr").agg(F.count("*").alias("descriptions")).select(
        F.lit("word").alias("word"), "descriptions"
    )
    store.write_dataset(f"{path}/20260101", data, words, {"cleaned_col": "descr"})
    return store.read_dataset(spark, path, "latest")[0]


@query("write_vocabulary", """
    select lower(p_name) as word, count(*) as descriptions from part group by all""")
def write_vocabulary(spark, folder):
    path = scratch_path(spark, "vocabulary")
    words = table(spark, folder, "part").groupBy(F.lower("p_name").alias("word")).agg(
        F.count("*").alias("descriptions")
    )
    store.write_vocabulary(words, path)
    return store.read_vocabulary(spark, path)


@query("write_split_result", fx.with_views("preds", body="""
    select candidate, fold as split, count(*) as n, cast(sum(num) as bigint) as ids from preds group by all"""))
def write_split_result(spark, folder):
    """Two writers for overlapping pairs: the second one's rows count only where the first has claimed nothing."""
    log, pred = RunLog(spark, scratch_path(spark, "results")), fx.predictions(spark, folder).withColumnRenamed("fold", "split")
    first, second = log.new_run(), log.new_run()
    log.write(first, pred.where("candidate <> 2"))
    log.write(second, pred.where("candidate > 0"))
    log.commit(first, [(c, s) for c in (0, 1) for s in range(5)])
    log.commit(second, [(c, s) for c in (1, 2) for s in range(5)])
    rows = log.results().select(F.col("candidate").cast("int").alias("candidate"), F.col("split").cast("int").alias("split"), "num")
    return rows.groupBy("candidate", "split").agg(F.count("*").alias("n"), F.sum("num").alias("ids"))


@query("pending_work", fx.with_views("preds", body="""
    select cast(c.c as int) as candidate, cast(s.s as int) as split
    from range(4) c(c) join range(5) s(s) on true
    anti join (select distinct candidate, fold from preds where conf_1 < 2 and candidate <> 2) d
      on d.candidate = c.c and d.fold = s.s"""))
def pending(spark, folder):
    """What a log without candidate 2 leaves to do; its pairs come from the rows that were written."""
    log, run = RunLog(spark, scratch_path(spark, "results")), RunLog.new_run()
    pred = fx.predictions(spark, folder).where("candidate <> 2").withColumnRenamed("fold", "split")
    log.write(run, pred)
    log.commit(run, [(r["candidate"], r["split"]) for r in pred.select("candidate", "split").distinct().collect()])
    return pending_work(spark, 4, 5, log.finished())


# ---- projections and filters ----------------------------------------------------------------------------------

@query("project_items", fx.with_views("master", body="""
    select product as "ID", cono as "Cono", upper(product) as "Product ID",
           upper(replace(descrip, ';', ' ')) as "FullDesc", upper(prodcat) as "Vendor", upper(prodcat) as "Prodcat",
           upper(unspsc) as "UNSPSC",
           case when prodcat is null or descrip is null then null
                else concat(cast(cono as varchar), '_', upper(prodcat), '_', upper(descrip)) end as "Prodline"
    from master"""))
def project_items(spark, folder):
    master = fx.sources(spark, folder)[1]
    return filters.project_items(
        master.selectExpr(
            "product as id", "cono", "product", "descrip", "prodcat as vendor", "prodcat", "unspsc", "descrip as prodline"
        )
    )


@query("filter_current", fx.with_views("master", body="""
    select product, cono, descrip from master where st_row_current = 1 and cono in (1, 55) and descrip is not null"""))
def filter_current(spark, folder):
    master = fx.sources(spark, folder)[1]
    return filters.filter_current(master, "st_row_current", ("cono", [1, 55]), ("descrip",)).select(
        "product", "cono", "descrip"
    )


@query("drop_missing_labels", fx.with_views("loose", body="""
    select id, l1, l2, l3, l4 from loose
    where l1 is not null and l2 is not null and trim(l1) <> '' and trim(l2) <> ''"""))
def drop_missing_labels(spark, folder):
    return filters.drop_missing_labels(fx.loose_items(spark, folder), fx.LEVELS).select("id", *fx.LEVELS)


@query("drop_blank_text", fx.with_views("loose", body="select id, descr from loose where trim(descr) <> ''"))
def drop_blank_text(spark, folder):
    return filters.drop_blank_text(fx.loose_items(spark, folder), "descr").select("id", "descr")


@query("keep_columns", fx.with_views("items", body="select id, l1, l2, descr from items"))
def keep_columns(spark, folder):
    return filters.keep_columns(
        fx.items(spark, folder), ["id", "missing", "id", "l1", "l2", "l1", "descr"], required=["id"]
    )


@query("row_number_id", fx.with_views("preds", body="""
    select id, row_number() over (order by id) - 1 as _row from preds"""))
def row_number_id(spark, folder):
    return filters.row_number_id(fx.predictions(spark, folder).select("id"), "id")


# ---- joins ----------------------------------------------------------------------------------------------------

_PATHS = """
    select a.id as "Level 1 ID", a.name as "Level 1 Name", b.id as "Level 2 ID", b.name as "Level 2 Name",
           c.id as "Level 3 ID", c.name as "Level 3 Name", d.id as "Level 4 ID", d.name as "Level 4 Name"
    from tree a
    left join tree b on b.parent_id = a.id and b.level = 2 and b.st_row_current = 1
    left join tree c on c.parent_id = b.id and c.level = 3 and c.st_row_current = 1
    left join tree d on d.parent_id = c.id and d.level = 4 and d.st_row_current = 1
    where a.level = 1 and a.st_row_current = 1 and d.id is not null"""

_BASE = """
    select s.id as "ID", s.cono as "Cono", upper(s.product) as "Product ID",
           upper(replace(m.descrip, ';', ' ')) as "FullDesc", upper(s.vendor) as "Vendor",
           upper(m.prodcat) as "Prodcat", upper(m.unspsc) as "UNSPSC",
           cast(s.cono as varchar) || '_' || upper(s.vendor) || '_' || upper(w.prodline) as "Prodline"{more}
    from sku s join master m on s.product = m.product
    left join stock w on s.product = w.product and w.st_row_current = 1 and w.cono = 1 and upper(w.whse) in ('ZDAT', 'FC')
    where s.st_row_current = 1 and m.st_row_current = 1 and m.cono in (1, 55) and m.descrip is not null
      and s.category_id is {null}"""


@query("flatten_hierarchy", fx.with_views("tree", body=_PATHS))
def flatten_hierarchy(spark, folder):
    return joins.flatten_hierarchy(written(fx.tree(spark, folder), "tree"), 4, "st_row_current")


@query("labeled_items", fx.with_views("tree", "sku", "master", "stock", body=f"""
    , base as ({_BASE.format(more=', s.category_id as category_l4_id', null='not null')}), paths as ({_PATHS})
    select * from base join paths on category_l4_id = "Level 4 ID" """))
def labeled_items(spark, folder):
    paths = written(joins.flatten_hierarchy(written(fx.tree(spark, folder), "tree"), 4, "st_row_current"), "paths")
    return joins.labeled_items(*fx.sources(spark, folder), paths)


@query("unlabeled_items", fx.with_views("sku", "master", "stock", body=_BASE.format(more="", null="null")))
def unlabeled_items(spark, folder):
    return joins.unlabeled_items(*fx.sources(spark, folder))


@query("apply_blacklist", fx.with_views("items", body="""
    select id, descr from items where cast(substr(id, 3) as int) % 50 <> 0"""))
def apply_blacklist(spark, folder):
    listed = written(scan.scan_blacklist(spark, _blacklist_file(spark, folder)), "listed")
    padded = fx.items(spark, folder).select(F.concat(F.lit(" "), "id").alias("padded"), "id", "descr")
    return joins.apply_blacklist(padded, listed, "padded").drop("padded")


_LOOKUP_SQL = """select l1 as one, min(name) as name from (
    select distinct l_returnflag as l1, concat('flag ', l_returnflag, l_linestatus) as name from lineitem) group by l1"""


@query("attach_names", fx.with_views("preds", body=f"""
    select p.id, p.predicted_1, p.predicted_2, n.name from preds p left join ({_LOOKUP_SQL}) n on n.one = p.predicted_1"""))
def attach_names(spark, folder):
    lookup = table(spark, folder, "lineitem").select(
        F.col("l_returnflag").alias("one"), F.concat(F.lit("flag "), "l_returnflag", "l_linestatus").alias("n1")
    )
    lookup = joins.distinct_lookup(lookup, ["one"], ["n1"])
    pred = fx.predictions(spark, folder).select("id", "Predicted one", "Predicted two")
    named = joins.attach_names(pred, lookup, ["one"], ["n1"])
    return named.selectExpr("id", "`Predicted one` as predicted_1", "`Predicted two` as predicted_2", "`Predicted n1` as name")


@query("attach_text", fx.with_views("items", body="""
    select i.id, i.l1, d.text from items i left join documents d on cast(d.doc_id as varchar) = substr(i.id, 3)"""))
def attach_text(spark, folder):
    texts = table(spark, folder, "documents").select(F.concat(F.lit("P-"), F.col("doc_id").cast("string")).alias("id"), "text")
    return joins.attach_text(fx.items(spark, folder).select("id", "l1"), texts, "id")


@query("distinct_lookup", fx.with_views("items", body="select distinct l1, l2, l4 from items"))
def distinct_lookup(spark, folder):
    return joins.distinct_lookup(fx.items(spark, folder), ["l1", "l2"], ["l4"])


# ---- rare paths and duplicates --------------------------------------------------------------------------------

@query("filter_rare_paths", fx.with_views("loose", body="""
    select id, l1, l2, l3, l4 from loose qualify count(*) over (partition by l1, l2, l3, l4) >= 5"""))
def filter_rare_paths(spark, folder):
    return filters.filter_rare_paths(fx.loose_items(spark, folder), fx.LEVELS, 5).select("id", *fx.LEVELS)


@query("rare_path_info", fx.with_views("loose", body="""
    , sizes as (select count(*) as n from loose group by l1, l2, l3, l4)
    select 5 as rare_path_threshold, cast(sum(n) as bigint) as rows_before,
           cast(coalesce(sum(n) filter (n < 5), 0) as bigint) as rows_dropped,
           cast(coalesce(sum(n) filter (n >= 5), 0) as bigint) as rows_after,
           count(*) as paths_before, count(*) filter (n >= 5) as paths_after from sizes"""))
def rare_path_info(spark, folder):
    return filters.rare_path_info(fx.loose_items(spark, folder), fx.LEVELS, 5)


@query("duplicate_count", """
    select cast(coalesce(sum(n), 0) as bigint) as duplicates
    from (select count(*) as n from lineitem group by l_orderkey having count(*) > 1)""")
def duplicate_count(spark, folder):
    return filters.duplicate_count(table(spark, folder, "lineitem"), "l_orderkey")


@query("sample_rows", fx.with_views("items", body="""
    select id, descr from items order by sha1(concat('0|', id)), id limit 15"""))
def sample_rows(spark, folder):
    return filters.sample_rows(fx.items(spark, folder), "id").select("id", "descr")


# ---- splits ---------------------------------------------------------------------------------------------------

_HASH = "cast(('0x' || substr(sha1({}), 1, 16)) as ubigint)"


@query("id_hash_folds", fx.with_views("preds", body=f"""
    select id, cast({_HASH.format("concat('0|', cast(id as varchar))")} % 5 as int) as fold from preds"""))
def id_hash_folds(spark, folder):
    return splits.id_hash_folds(fx.predictions(spark, folder).select("id"), "id")


@query("id_hash_sample", fx.with_views("preds", body=f"""
    select id from preds
    where cast({_HASH.format("concat('sample|0|', cast(id as varchar))")} as double) / 18446744073709551616.0 < 0.2"""))
def id_hash_sample(spark, folder):
    return splits.id_hash_sample(fx.predictions(spark, folder).select("id"), "id", 0.2)


@query("stratified_folds", fx.with_views("items", body=f"""
    select id, l4, cast((row_number() over (partition by l4 order by sha1(concat('1|', id)), id) - 1
           + {_HASH.format("concat('1|', l4)")} % 5) % 5 as int) as fold from items"""))
def stratified_folds(spark, folder):
    return splits.stratified_folds(fx.items(spark, folder).select("id", "l4"), "l4", "id", 5, 1)


@query("holdout_splits", fx.with_views("items", body="""
    , every as (select id, cast(r as int) as repeat from items join range(3) t(r) on true)
    select id, repeat from every
    qualify row_number() over (partition by repeat order by sha1(concat(cast(repeat + 42 as varchar), '|', id)), id)
            <= (select round_even(0.2 * count(*), 0) from items)"""))
def holdout_splits(spark, folder):
    return splits.holdout_splits(fx.items(spark, folder), "id", 3, 0.2, 42)


@query("make_splits", fx.with_views("docs", body=f"""
    , folds as (select id, cast({_HASH.format("concat('0|', id)")} % 5 as int) as fold from docs)
    select id, cast(s as int) as split, fold = s as held_out from folds join range(5) t(s) on true"""))
def make_splits(spark, folder):
    from ..plans.settings import SplitSettings

    placed = splits.make_splits(fx.docs(spark, folder), SplitSettings(fold_key_col="id"), "id", "l2")
    trained = placed.select("id", F.explode(splits.train_splits(5)).alias("split"), F.lit(False).alias("held_out"))
    tested = placed.select("id", F.explode("tests").alias("split"), F.lit(True).alias("held_out"))
    return trained.unionByName(tested)
