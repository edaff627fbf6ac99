"""Readers of exported corpora: Markdown posts with front matter, conversations with turns, CSV sheets and label files.

Files are read whole, one row a file, and taken apart with built-in expressions; a conversation's turns are an explode of
its marker matches. Front matter and turns work on any column of texts, so tables of exported texts go the same way.

Defined cases. Texts without front matter have an empty map. Bytes that aren't UTF-8 become U+FFFD. A conversation
without markers has no turns; empty turns are dropped but count in the numbering.
"""

from __future__ import annotations

import os
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veristrata.functions import text as T

#: Source types by who speaks; a type that ends in _other is somebody else's.
TESTIMONY, MACHINE, OTHER = ("forum_comment", "forum_submission", "chat_user"), ("chat_assistant",), "_other"

_FRONT = r"(?s)\A---\n(.*?)\n---\n"
_FIELDS = "struct<open:boolean,fields:array<struct<key:string,value:string>>>"
_MARKER = r"(?m)^###\s+(\S+.*?)\s*$"
_SCHEMA = "uri string, content string, source_type string, meta map<string,string>"


def front_matter(text: Column) -> Column:
    """map<string,string> of the flat ``key: value`` lines between leading --- lines; the first line that is neither ends it."""
    lines = F.split(F.regexp_extract(text, _FRONT, 1), "\n")
    start = F.from_json(F.lit('{"open":true,"fields":[]}'), _FIELDS)

    def step(acc: Column, line: Column) -> Column:
        body = T.strip(line)
        skipped = (body == "") | body.startswith("#")
        stops = line.rlike(r"^[ \t-]") | ~F.contains(line, F.lit(":"))
        key, value = T.strip(F.regexp_extract(line, r"^([^:]*):", 1)), T.strip(F.regexp_extract(line, r"(?s)^[^:]*:(.*)$", 1))
        bare = F.regexp_replace(value, r"^[\"']+|[\"']+$", "")
        fields = F.when(acc["open"] & ~skipped & ~stops, F.concat(acc["fields"], F.array(F.struct(key.alias("key"), bare.alias("value"))))).otherwise(acc["fields"])
        return F.struct((acc["open"] & (skipped | ~stops)).alias("open"), fields.alias("fields")).cast(_FIELDS)

    found = F.aggregate(lines, start, step, lambda acc: acc["fields"])
    # a repeated key: the last one counts
    last = F.filter(found, lambda x, i: ~F.exists(F.slice(found, i + 2, F.greatest(F.size(found) - i - 1, F.lit(0))), lambda y: y["key"] == x["key"]))
    return F.map_from_entries(last)


def body(text: Column) -> Column:
    return T.strip(F.regexp_replace(text, _FRONT, ""))


def turns(texts: DataFrame, key: str, text_col: str) -> DataFrame:
    """key, turn (number of its marker), role (user, assistant), content of every turn that isn't empty."""
    marked = F.regexp_replace(F.col(text_col), _MARKER, "\x01$1\x02")
    pieces = texts.select(key, F.posexplode(F.slice(F.split(marked, "\x01"), 2, 1 << 30)).alias("turn", "piece"))
    label, rest = F.lower(F.substring_index("piece", "\x02", 1)), F.regexp_replace("piece", r"(?s)^[^\x02]*\x02", "")
    role = F.when(label.endswith("user"), "user").when(label.endswith("assistant"), "assistant")
    content = T.strip(F.replace(F.regexp_replace(rest, r"(?m)^\*\*Timestamp\*\*:.*$", ""), F.lit("---"), F.lit("")))
    return pieces.select(key, "turn", role.alias("role"), content.alias("content")).where("role IS NOT NULL AND content <> ''")


def speaker(source_type: Column) -> Column:
    """testimony, machine, third_party or neither."""
    return F.when(source_type.endswith(OTHER), "third_party").when(source_type.isin(*TESTIMONY), "testimony").when(source_type.isin(*MACHINE), "machine").otherwise("neither")


def _files(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").load(folder).select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def posts(spark: SparkSession, folder: str, kind: str, author: str | None = None) -> DataFrame:
    """uri, content, source_type, meta of a folder of Markdown posts; posts of another author have the type kind_other."""
    own = _files(spark, folder).select("path", "text", front_matter(F.col("text")).alias("meta"))
    foreign = F.col("meta")["author"].isNotNull() & (F.col("meta")["author"] != F.lit(author)) if author else F.lit(False)
    stem = F.regexp_extract("path", r"([^/]+)\.md$", 1)
    return own.select(F.concat(F.lit(f"forum://{kind}/"), stem).alias("uri"), body(F.col("text")).alias("content"), F.when(foreign, kind + OTHER).otherwise(kind).alias("source_type"), "meta").where("content <> ''")


def conversations(spark: SparkSession, folder: str) -> DataFrame:
    """uri, content, source_type, meta: one row a turn; the uri counts all markers of the file."""
    own = _files(spark, folder).withColumn("meta", front_matter(F.col("text")))
    own = own.withColumn("conv", F.coalesce(F.col("meta")["Conversation ID"], F.regexp_extract("path", r"([^/]+)\.md$", 1)))
    keyed = own.select(F.struct("conv", "meta").alias("k"), "text")
    uri = F.format_string("chat://%s/%04d", "k.conv", "turn")
    return turns(keyed, "k", "text").select(uri.alias("uri"), "content", F.concat(F.lit("chat_"), F.col("role")).alias("source_type"), F.col("k.meta").alias("meta"))


def corpus(spark: SparkSession, root: str, author: str | None = None, limit: int | None = None) -> DataFrame:
    """The whole export: comments, submissions, conversation turns. limit: the first ones in that order, then by uri."""
    parts = []
    for rank, (folder, read) in enumerate((("forum/comments", lambda p: posts(spark, p, "forum_comment", author)), ("forum/submissions", lambda p: posts(spark, p, "forum_submission", author)), ("chat", lambda p: conversations(spark, p)))):
        if os.path.isdir(f"{root}/{folder}"):
            parts.append(read(f"{root}/{folder}").withColumn("rank", F.lit(rank)))
    if not parts:
        return spark.createDataFrame([], _SCHEMA)
    whole = reduce(DataFrame.unionByName, parts)
    return (whole if limit is None else whole.orderBy("rank", "uri").limit(limit)).drop("rank")


def stats(corpus_rows: DataFrame) -> DataFrame:
    """source_type, speaker, n_docs, n_bytes."""
    return corpus_rows.groupBy("source_type").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.octet_length("content")).alias("n_bytes")).select("source_type", speaker(F.col("source_type")).alias("speaker"), "n_docs", "n_bytes")


def sheet(spark: SparkSession, path: str) -> DataFrame:
    """A CSV label sheet with a header; quoted fields may hold line breaks."""
    return spark.read.csv(path, header=True, multiLine=True, escape='"')


def labels(spark: SparkSession, path: str) -> DataFrame:
    """pair, a, b, label, rationale of a label file {"pairs": [...]}."""
    schema = "pairs array<struct<pair:string,a:string,b:string,label:string,rationale:string>>"
    return spark.read.json(path, multiLine=True, schema=schema).select(F.inline("pairs"))
