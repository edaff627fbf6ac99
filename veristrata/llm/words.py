"""Words, fields and lines of texts as Spark expressions.

A word is a longest run of Unicode letters or digits, compared in lower case.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: white space as in str.isspace() of Python, as a regular-expression class body.
SPACE = r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def words(text: Column) -> Column:
    """The text's words in order, in lower case; null for null. Case changes after splitting, as it may add marks."""
    spaced = F.lower(F.trim(F.regexp_replace(text, r"[^\p{L}\p{N}]+", " ")))
    return F.when(spaced == "", F.array().cast("array<string>")).otherwise(F.split(spaced, " "))


def lines_form(line: Column) -> Column:
    """A line as it is compared: lower case, trimmed, one space for white space, one 0 for digits."""
    spaced = F.regexp_replace(F.lower(line), f"[{SPACE}]+", " ")
    return F.regexp_replace(F.trim(spaced), "[0-9]+", "0")
