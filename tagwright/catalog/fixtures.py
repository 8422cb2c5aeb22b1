"""Views over the given tables, stated once as SQL that Spark and DuckDB both read.

``items`` turns parts into item descriptions with codes, markers, units, sizes and colours, under a four-level path
whose last level is an only child. ``docs`` are the documents with a two-level path. ``sku``, ``master``, ``stock``
and ``tree`` are the source tables the item pull joins. ``preds`` is a prediction table over all order lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import placed
from .registry import table

ITEMS = """
select concat('P-', cast(p_partkey as string)) as id,
       concat(case when p_partkey % 4 = 0 then concat('X', cast(p_partkey as string), ' ')
                   when p_partkey % 4 = 1 then '(DV) ' else '' end,
              p_name, ' ', replace(p_brand, '#', ' '), ' ', cast(p_size as string),
              case when p_partkey % 3 = 0 then ' INCHES' when p_partkey % 3 = 1 then ' FOOT' else '-MM' end,
              case when p_partkey % 5 = 0 then concat(' 1/2 X ', cast(p_size as string)) else '' end,
              case when p_partkey % 7 = 0 then ' BLK XL' else '' end) as descr,
       p_brand as l1, concat(p_brand, '/', p_type) as l2,
       concat(p_brand, '/', p_type, '/', case when p_size <= 25 then 'S' else 'B' end) as l3,
       concat(p_brand, '/', p_type, '/', case when p_size <= 25 then 'S' else 'B' end, '/only') as l4
from part
"""

# unlabelled where the key ends in 9, a blank label where it ends in 8, a blank text where it ends in 77
LOOSE_ITEMS = """
select id,
       case when cast(substr(id, 3) as int) % 100 = 77 then '  ' else descr end as descr,
       case when cast(substr(id, 3) as int) % 10 = 9 then null else l1 end as l1,
       case when cast(substr(id, 3) as int) % 10 = 9 then null
            when cast(substr(id, 3) as int) % 10 = 8 then ' ' else l2 end as l2,
       l3, l4
from items
"""

DOCS = """
select cast(doc_id as string) as id, text as descr, lang as l1, concat(lang, '/', source) as l2 from documents
"""

TREE = """
select distinct l1 as id, concat('name ', l1) as name, cast(null as string) as parent_id, 1 as level,
       1 as st_row_current from items
union all select distinct l2, concat('name ', l2), l1, 2, 1 from items
union all select distinct l3, concat('name ', l3), l2, 3, 1 from items
union all select distinct l4, concat('name ', l4), l3, 4, 1 from items
union all select distinct l4, 'old name', l3, 4, 0 from items
union all select distinct concat(l1, '/bare'), 'no children', l1, 2, 1 from items
"""

SKU = """
select id, case when cast(substr(id, 3) as int) % 3 = 0 then 55 else 1 end as cono,
       concat('pn-', substr(id, 3)) as product,
       case when cast(substr(id, 3) as int) % 10 = 9 then null else l4 end as category_id,
       case when cast(substr(id, 3) as int) % 12 = 0 then null
            else concat('vend', cast(cast(substr(id, 3) as int) % 7 as string)) end as vendor,
       case when cast(substr(id, 3) as int) % 11 = 0 then 0 else 1 end as st_row_current
from items
"""

MASTER = """
select concat('pn-', substr(id, 3)) as product,
       case when cast(substr(id, 3) as int) % 13 = 0 then 2 when cast(substr(id, 3) as int) % 4 = 0 then 55 else 1 end as cono,
       case when cast(substr(id, 3) as int) % 17 = 0 then null else replace(descr, 'X ', ';') end as descrip,
       concat('cat', l1) as prodcat, concat('4618', substr(id, 3)) as unspsc,
       case when cast(substr(id, 3) as int) % 19 = 0 then 0 else 1 end as st_row_current
from items
"""

STOCK = """
select distinct concat('pn-', cast(l_partkey as string)) as product,
       case when l_suppkey % 4 = 3 then 2 else 1 end as cono,
       case when l_suppkey % 3 = 0 then 'zdat' when l_suppkey % 3 = 1 then 'FC' else 'other' end as whse,
       concat('pl', cast(l_suppkey % 5 as string)) as prodline,
       case when l_suppkey % 7 = 0 then 0 else 1 end as st_row_current
from lineitem
"""

PREDS = """
select concat(cast(l_orderkey as string), '-', cast(l_linenumber as string), '-', cast(l_partkey as string), '-',
              cast(l_suppkey as string), '-', cast(cast(l_quantity as int) as string)) as id,
       cast(l_orderkey * 10 + l_linenumber as bigint) as num,
       cast(l_orderkey % 5 as int) as fold,
       cast(l_suppkey % 3 as int) as candidate,
       l_returnflag as actual_1, concat(l_returnflag, '/', l_linestatus) as actual_2,
       case when l_linenumber = 5 then null when l_partkey % 7 = 0 then 'Z' else l_returnflag end as predicted_1,
       case when l_linenumber = 5 then null when l_partkey % 7 = 0 then 'Z/Z'
            when l_suppkey % 5 = 0 then 'N/F' else concat(l_returnflag, '/', l_linestatus) end as predicted_2,
       cast(((l_orderkey * 37 + l_linenumber * 11) % 997) as double) / cast(1100.0 as double) as conf_1,
       cast(((l_orderkey * 37 + l_linenumber * 11) % 997) as double) / cast(2200.0 as double) as conf_2
from lineitem
"""

LEVELS = ["l1", "l2", "l3", "l4"]
DOC_LEVELS = ["l1", "l2"]
PRED_LEVELS = ["one", "two"]


def items(spark: SparkSession, folder: str) -> DataFrame:
    return spark.sql(ITEMS.replace("from part", "from {part}"), part=placed(table(spark, folder, "part"), "p_partkey"))


def _over_items(spark: SparkSession, folder: str, text: str) -> DataFrame:
    return spark.sql(text.replace("from items", "from {items}"), items=items(spark, folder))


def loose_items(spark: SparkSession, folder: str) -> DataFrame:
    return _over_items(spark, folder, LOOSE_ITEMS)


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """The texts, spread over the cores: a file may be one range for the reader, and what follows is heavy per byte."""
    return placed(table(spark, folder, "documents"), "doc_id")


def docs(spark: SparkSession, folder: str) -> DataFrame:
    return spark.sql(DOCS.replace("from documents", "from {documents}"), documents=documents(spark, folder))


def tree(spark: SparkSession, folder: str) -> DataFrame:
    return _over_items(spark, folder, TREE)


def sources(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    stock = spark.sql(STOCK.replace("from lineitem", "from {lineitem}"), lineitem=table(spark, folder, "lineitem"))
    return _over_items(spark, folder, SKU), _over_items(spark, folder, MASTER), stock


def predictions(spark: SparkSession, folder: str) -> DataFrame:
    """``preds`` under the column names of a prediction table."""
    lines = spark.sql(PREDS.replace("from lineitem", "from {lineitem}"), lineitem=table(spark, folder, "lineitem"))
    return lines.selectExpr(
        "id", "num", "fold", "candidate", "actual_1 as `Actual one`", "actual_2 as `Actual two`",
        "predicted_1 as `Predicted one`", "predicted_2 as `Predicted two`",
        "conf_1 as `L1 Confidence`", "conf_2 as `L2 Confidence`",
    )


def with_views(*names: str, body: str) -> str:
    """``body`` behind the named views as common table expressions."""
    texts = {
        "items": ITEMS, "loose": LOOSE_ITEMS, "docs": DOCS, "tree": TREE, "sku": SKU, "master": MASTER,
        "stock": STOCK, "preds": PREDS,
    }
    needs_items = {"loose", "tree", "sku", "master"} & set(names)
    order = (["items"] if needs_items and "items" not in names else []) + list(names)
    views = ", ".join(f"{n} as ({texts[n].strip()})" for n in order)
    return f"with {views} {body.strip()}"  # a body may begin with a comma and more views
