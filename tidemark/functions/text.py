"""Column functions for names and for arrays kept as text. All of them stay in the JVM."""

from __future__ import annotations

from string import ascii_letters

from pyspark.sql import Column
from pyspark.sql import functions as F

# Results depend on these exact patterns.
# ``[^a-zA-Z\s]``, each character by itself: Java looks those up in one table, in a quarter of the time that it
# takes to try ranges and classes one after the other.
NOT_NAME_CHARACTERS = rf"[^{ascii_letters} \t\n\x0B\f\r]"
NAME_SEPARATOR = r"\s+"
ARRAY_BRACKETS = r"^\[|\]$"
ARRAY_QUOTES = "\"'"
ARRAY_SEPARATOR = ","
PARTS_OF_NULL = -1
SCORE_FILLED = 1.0
SCORE_BLANK = 0.0


def cleaned_name(name: Column) -> Column:
    """The name without anything but ASCII letters and white space; nothing is put in its place."""
    return F.regexp_replace(name, NOT_NAME_CHARACTERS, "")


def part_count(name: Column) -> Column:
    """Number of pieces between runs of white space, blank outer pieces included; -1 for NULL."""
    return F.coalesce(F.size(F.split(name, NAME_SEPARATOR)), F.lit(PARTS_OF_NULL))


def filled_score(name: Column) -> Column:
    """1.0 for a name with at least one character, 0.0 for an empty or missing one."""
    filled = F.coalesce(F.length(name), F.lit(0)) > 0
    return F.when(filled, SCORE_FILLED).otherwise(SCORE_BLANK)


def array_from_text(text: Column) -> Column:
    """Array of strings from text such as ``["a","b"]``.

    One bracket at each end and every quote go, and the rest is cut at commas: blanks after a
    comma stay, a quoted comma cuts too, ``[]`` gives one empty element. Empty or missing text
    gives an empty array. For real JSON use ``conform(..., mode="json")``.
    """
    bare = F.translate(F.regexp_replace(text, ARRAY_BRACKETS, ""), ARRAY_QUOTES, "")
    no_elements = F.array().cast("array<string>")
    return F.when(F.length(text) > 0, F.split(bare, ARRAY_SEPARATOR)).otherwise(no_elements)
