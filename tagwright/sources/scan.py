"""Reading items, lists and words. Every item column is a string, so that identifiers keep their form."""

from __future__ import annotations

import hashlib
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from .quoted import scan_quoted

# The strings read as null. "NA" and "N/A" are values.
NULL_MARKERS = ("", "NULL", "null", "None", "nan", "NaN", "<NA>")
DELIMITER = "|"


def to_string_frame(df: DataFrame) -> DataFrame:
    """Every column as string, null stays null."""
    return df.select([F.col(f"`{c}`").cast("string").alias(c) for c in df.columns])


def null_markers(df: DataFrame, markers=NULL_MARKERS) -> DataFrame:
    """The listed strings become null in every column."""
    return df.select(
        [F.when(~F.col(f"`{c}`").isin(*markers), F.col(f"`{c}`")).alias(c) for c in df.columns]
    )


def read_query(name: str, folder: str) -> str:
    """The SQL text called ``name``: ``name.sql``, ``name.txt`` or ``name``."""
    for candidate in (f"{name}.sql", f"{name}.txt", name):
        path = os.path.join(folder, candidate)
        if os.path.isfile(path):
            with open(path, encoding="utf-8") as f:
                return f.read()
    raise FileNotFoundError(f"no query {name!r} in {folder}")


def scan_query(spark: SparkSession, sql: str) -> DataFrame:
    """Rows of a SQL text, all strings. The rows stay distributed."""
    return to_string_frame(spark.sql(sql))


def scan_delimited(spark: SparkSession, path: str, delimiter: str = DELIMITER, quoted: bool = True) -> DataFrame:
    """Delimited text with a header. ``quoted=False`` reads ``"`` as an ordinary character (an inch mark).

    A quoted field may hold a line break; both kinds of files are read by many tasks (:mod:`.quoted`).
    """
    if quoted:
        return null_markers(scan_quoted(spark, path, delimiter))
    reader = spark.read.option("header", True).option("sep", delimiter).option("inferSchema", False)
    return null_markers(reader.option("quote", "").option("escape", "").csv(path))


def load_source(
    spark: SparkSession,
    path: str | None = None,
    query: str | None = None,
    query_folder: str = ".",
    delimiter: str = DELIMITER,
    quoted: bool = True,
) -> tuple[DataFrame, dict]:
    """The rows and where they came from. A file wins over a query."""
    if path is not None:
        record = {"type": "file", "path": path, "delimiter": delimiter, "quoted": quoted}
        return scan_delimited(spark, path, delimiter, quoted), record
    if query is None:
        raise ValueError("give a file or a query")
    sql = read_query(query, query_folder)
    record = {
        "type": "sql",
        "query_name": query,
        "query_sha256": hashlib.sha256(sql.encode()).hexdigest()[:16],
        "query_text": sql,
    }
    return scan_query(spark, sql), record


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """``line``: the lines of a text file, without a byte order mark."""
    return spark.read.text(path).select(F.regexp_replace("value", "^\ufeff", "").alias("line"))


def _first_field(path: str) -> Column:
    """The whole line, or the first field if the file or folder is called ``.csv``."""
    csv = path.lower().rstrip("/").endswith(".csv")
    return F.split_part("line", F.lit(","), F.lit(1)) if csv else F.col("line")


def scan_blacklist(spark: SparkSession, path: str, has_header: bool = True) -> DataFrame:
    """``item``: distinct first fields, trimmed and unquoted. A header is skipped in each file of the folder."""
    # a separator that ends no field: every line arrives whole, and the reader knows which line is a header
    read = (
        spark.read.option("header", has_header).option("sep", "\x01").option("quote", "")
        .schema("line string").csv(path)
        .select(F.regexp_replace("line", "^\ufeff", "").alias("line"))
    )
    item = tx.strip_space(F.btrim(tx.strip_space(_first_field(path)), F.lit('"')))
    return read.select(item.alias("item")).where("item <> ''").distinct()


def scan_terms(spark: SparkSession, path: str) -> DataFrame:
    """``term``: first fields in upper case, inner spaces squeezed, no blanks, no repeats. A heading is a term."""
    raw = tx.strip_space(_first_field(path))
    term = tx.squeeze(F.upper(F.btrim(raw, F.lit('"'))))
    return _lines(spark, path).select(term.alias("term")).where("term <> ''").distinct()


def scan_words(spark: SparkSession, path: str) -> DataFrame:
    """``word``: a word list, one per line, in lower case."""
    word = F.lower(tx.strip_space(F.col("line")))
    return _lines(spark, path).select(word.alias("word")).where("word <> ''").distinct()


def scan_units(spark: SparkSession, path: str) -> DataFrame:
    """``abbrev, prefix, forms``: unit lines ``[>]ABBR = form, ~form``; a line without ``=`` is an error."""
    line = tx.strip_space(F.col("line"))
    head = tx.strip_space(F.split_part("line", F.lit("="), F.lit(1)))
    rest = F.regexp_replace("line", "(?s)^[^=]*=", "")
    forms = F.filter(
        F.transform(F.split(rest, ","), lambda f: tx.squeeze(F.upper(f))), lambda f: f != ""
    )
    return (
        _lines(spark, path)
        .select(line.alias("line"))
        .where("line <> '' and not startswith(line, '#')")
        .withColumn(
            "line",
            F.when(F.col("line").contains("="), F.col("line")).otherwise(
                F.raise_error(F.concat(F.lit("expected 'ABBREVIATION = form, form', got "), "line"))
            ),
        )
        .select(
            F.upper(tx.strip_space(F.ltrim(head, F.lit(">")))).alias("abbrev"),
            head.startswith(">").alias("prefix"),
            F.transform(
                forms,
                lambda f: F.struct(
                    tx.strip_space(F.ltrim(f, F.lit("~"))).alias("form"), f.startswith("~").alias("number_only")
                ),
            ).alias("forms"),
        )
    )


def term_list(terms: DataFrame) -> list[str]:
    """The terms for a pattern. A pattern is made on the driver; the lists are settings, kept by hand."""
    return sorted(r.term for r in terms.collect())


def unit_list(units: DataFrame) -> list[dict]:
    """The unit table as the dicts the pattern builder takes; a setting too."""
    return [
        {"abbrev": r.abbrev, "prefix": r.prefix, "forms": [(f.form, f.number_only) for f in r.forms]}
        for r in sorted(units.collect())
    ]
