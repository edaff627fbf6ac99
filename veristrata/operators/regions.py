"""Regions of indented lines in texts (gaps and islands over lines).

A line is part of a region when it begins with a tab or with at least ``least`` blanks and tabs; blank lines continue a
region and begin none. Regions are folded inside each text by a higher-order aggregate: no explode, no shuffle, no window.

Defined cases. Null and empty texts have no regions. Offsets count code points; a region's end is where the first line
after it begins, or one beyond the text's end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: a line that is blank but for white space.
BLANK = r"^[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]*$"
_STATE = "struct<at:int,start:int,found:array<struct<start_offset:int,end_offset:int>>>"


def regions(text: Column, least: int = 2) -> Column:
    """array<struct<start_offset, end_offset>> of a text's regions."""
    lead = F.regexp_extract
    none = F.lit(None).cast("int")
    empty = F.from_json(F.lit('{"at":0,"found":[]}'), _STATE)

    def step(acc: Column, line: Column) -> Column:
        indent = F.length(lead(line, r"^[ \t]*", 0))
        blank = line.rlike(BLANK)
        indented = (indent > 0) & (line.startswith("\t") | (indent >= least))
        goes_on = indented | (blank & acc["start"].isNotNull())
        start = F.when(goes_on, F.coalesce(acc["start"], F.when(blank, none).otherwise(acc["at"])))
        ended = ~goes_on & acc["start"].isNotNull()
        found = F.when(ended, F.concat(acc["found"], F.array(F.struct(acc["start"].alias("start_offset"), acc["at"].alias("end_offset"))))).otherwise(acc["found"])
        return F.struct((acc["at"] + F.length(line) + 1).alias("at"), start.alias("start"), found.alias("found")).cast(_STATE)

    def finish(acc: Column) -> Column:
        return F.when(acc["start"].isNotNull(), F.concat(acc["found"], F.array(F.struct(acc["start"].alias("start_offset"), acc["at"].alias("end_offset"))))).otherwise(acc["found"])

    return F.when(text.isNotNull(), F.aggregate(F.split(text, "\n"), empty, step, finish))


def region_rows(texts: DataFrame, key: str, text_col: str, least: int = 2) -> DataFrame:
    """key, start_offset, end_offset of every region."""
    return texts.select(key, F.explode(regions(F.col(text_col), least)).alias("r")).select(key, "r.start_offset", "r.end_offset")


def inside(found: Column, start: Column, end: Column) -> Column:
    """Whether [start, end) lies wholly in one of the regions."""
    return F.exists(found, lambda r: (r["start_offset"] <= start) & (end <= r["end_offset"]))


#: Measured points (least indent, code pairs caught, real pairs lost).
FRONTIER = ((1, 2478, 50), (2, 2478, 50), (4, 316, 50), (8, 118, 0), (13, 0, 0))


def recommended_indent() -> int:
    """The broadest indent that lost no real pair and still caught some."""
    return min(indent for indent, caught, lost in FRONTIER if caught and not lost)
