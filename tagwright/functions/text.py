"""Word-level column expressions.

Python's and Java's regular expressions disagree on what a space, digit or word character is. The classes below
name the Unicode sets explicitly, so a pattern means the same here as it does in Python's ``re`` on ``str``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Character sets, written to go inside [...].
SPACE = r"\s\x1c-\x1f\x85\p{Z}"
DIGIT = r"\p{Nd}"
WORD = r"\p{L}\p{N}_"
# Characters taken off both ends of a word before it is looked up.
EDGE_PUNCTUATION = ".,;:!?\"'()[]{}"

_NON_SPACE_RUN = rf"[^{SPACE}]+"


def words(text: Column) -> Column:
    """Whitespace-separated words of ``text``, in order."""
    return F.regexp_extract_all(text, F.lit(_NON_SPACE_RUN), F.lit(0))


def squeeze(text: Column) -> Column:
    """Runs of whitespace become one space, none at the ends."""
    return F.btrim(F.regexp_replace(text, rf"[{SPACE}]+", " "))


def strip_space(text: Column) -> Column:
    """Whitespace of any kind off both ends."""
    return F.regexp_replace(text, rf"^[{SPACE}]+|[{SPACE}]+\z", "")


def is_blank(text: Column) -> Column:
    """Null, empty or only whitespace."""
    return text.isNull() | ~text.rlike(rf"[^{SPACE}]")


def strip_edges(word: Column) -> Column:
    """``word`` without the punctuation at its ends."""
    return F.btrim(word, F.lit(EDGE_PUNCTUATION))


def first_word(text: Column) -> Column:
    """First whitespace-separated word, empty if there is none."""
    return F.regexp_extract(text, rf"[^{SPACE}]+", 0)


def after_first_word(text: Column) -> Column:
    """What follows the first word and the spaces after it; inner and trailing spaces stay."""
    return F.regexp_extract(text, rf"(?s)^[{SPACE}]*[^{SPACE}]+[{SPACE}]*(.*)\z", 1)


def rewrite(text: Column, pattern: str, replacement: Callable[[Column], Column]) -> Column:
    """Replace every match of ``pattern`` by ``replacement(match)``, a column expression over the matched text.

    ``regexp_replace`` can only put groups back; this is the form for replacements that need a lookup or a
    condition. The text between the matches and the matches themselves are two arrays that are zipped together.
    The pattern must not match the empty string. ``text`` is read several times, so it should be a plain column.
    """
    gaps = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.zip_with(
        gaps, found, lambda gap, match: F.concat(gap, F.coalesce(replacement(match), F.lit("")))
    )
    return F.when(text.rlike(pattern), F.array_join(pieces, "")).otherwise(text)


Step = Callable[[Column], Column]


def apply_steps(df: DataFrame, column: str, steps: list[Step]) -> DataFrame:
    """Run the steps one after the other over ``column``.

    One projection per step: a step that reads its input several times then reads a finished value, where a nested
    expression would compute the steps before it again for every reading.
    """
    for step in steps:
        df = df.withColumn(column, step(F.col(column)))
    return df
