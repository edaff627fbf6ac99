"""P1: records that differ only in the form of their text.

Method: canonical text -> 64-bit hash -> partition-merged Bloom filters of once- and repeatedly-seen hashes.
Only rows whose hash may be repeated are shuffled, by a 128-bit hash of the canonical text, for exact grouping;
all other rows are singletons and never move. The hashes are written once, divided into ranges of the hash space of
RANGE rows at most (on average), and each range has its own filter at the full number of bits a row, built, broadcast
and used in its turn. So a filter's size is bounded and its rate of false repeats the same at any number of rows.

Defined cases. Null and empty texts and texts of fewer than three words have no canonical form: they are never
copies (in the collapsed result they stay records of their own). Rows with one id are one record and don't count
as copies of each other; a null id is no record. Where deliveries of one id differ in text, each text counts for
it. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veristrata.llm import bloom
from veristrata.llm.words import words
from veristrata.operators.skew import join_group_facts
from veristrata.session import written

MIN_WORDS = 3
#: Rows of a range of hashes: 16 bits each make a filter of 32 MB.
RANGE = 1 << 24
#: What divides fields, and the form of one field (name: one word).
DIVIDERS = r"[;|\n\r\x{85}\x{2028}\x{2029}]"
FIELD = r"(?s)^[\s\p{Z}]*[\p{L}\p{N}]+[\s\p{Z}]*[:=].*[\p{L}\p{N}].*$"


def canonical(text: Column) -> Column:
    """The text's words in order, or the sorted set of its fields if it is made only of two or more; null below three words."""
    pieces = F.filter(F.split(text, DIVIDERS), lambda p: p.rlike(r"[^\s\p{Z}]"))
    fields = F.array_sort(F.array_distinct(F.transform(pieces, lambda p: F.array_join(words(p), " "))))
    as_words = words(text)
    made_of_fields = text.rlike("[:=]") & (F.size(pieces) >= 2) & F.forall(pieces, lambda p: p.rlike(FIELD))
    form = F.when(made_of_fields, F.concat(F.lit("\n"), F.array_join(fields, "\n"))).otherwise(F.array_join(as_words, " "))
    return F.when(F.size(as_words) >= MIN_WORDS, form)


def _hashed(claims: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = claims.select(F.col(id_col).alias("id"), canonical(F.col(text_col)).alias("form")).where("id IS NOT NULL AND form IS NOT NULL")
    return rows.select("id", F.xxhash64("form").alias("h1"), F.xxhash64(F.lit(7), F.col("form")).alias("h2"))


def _split(claims: DataFrame, id_col: str, text_col: str, range_rows: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Possible repeats (id, h1, h2), sure singletons, and the exact groups of the former: h1, h2, first_id, n_copies."""
    n_ranges = -(-max(claims.count(), 1) // range_rows)
    part = F.pmod(F.shiftright("h1", 20), F.lit(n_ranges)).cast("int")  # other bits than those the filter takes places from
    hashed = written(_hashed(claims, id_col, text_col).withColumn("part", part), "form-hashes", "part")
    repeats, singles = [], []
    for r in range(n_ranges):
        own = hashed.where(F.col("part") == r).drop("part")
        bits, held = bloom.repeated_filter(own, "h1", range_rows if n_ranges > 1 else own.count())
        repeats.append(bloom.only_possible_repeats(own, "h1", bits, held))
        singles.append(bloom.only_possible_repeats(own, "h1", bits, held, keep=False))
    some = reduce(DataFrame.unionByName, repeats).distinct()
    groups = some.groupBy("h1", "h2").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("n_copies"))
    return some, reduce(DataFrame.unionByName, singles), groups


def copies(claims: DataFrame, id_col: str = "id", text_col: str = "text", range_rows: int = RANGE) -> DataFrame:
    """One row for every record that has a copy: claim_id, first_id (the smallest id of its set)."""
    repeats, _, groups = _split(claims, id_col, text_col, range_rows)
    return join_group_facts(repeats, groups.where("n_copies > 1"), ["h1", "h2"], "n_copies").select(F.col("id").alias("claim_id"), "first_id")


def collapsed(claims: DataFrame, id_col: str = "id", text_col: str = "text", range_rows: int = RANGE) -> DataFrame:
    """One row per distinct form: first_id, n_copies. Records without a form are rows of their own."""
    _, single, groups = _split(claims, id_col, text_col, range_rows)
    formless = claims.where(canonical(F.col(text_col)).isNull()).select(F.col(id_col).alias("id")).where("id IS NOT NULL").distinct()
    return groups.select("first_id", "n_copies").unionByName(single.select(F.col("id").alias("first_id"), F.lit(1).cast("long").alias("n_copies"))).unionByName(formless.select(F.col("id").alias("first_id"), F.lit(1).cast("long").alias("n_copies")))
