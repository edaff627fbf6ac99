"""Text functions on small examples."""

import pytest
from pyspark.sql import functions as F

from veristrata.functions import text as T


def values(spark, expression, *texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r["v"] for r in rows.select("i", expression(F.col("t")).alias("v")).orderBy("i").collect()]


def test_stems(spark):
    pairs = {"boxes": "box", "glasses": "glass", "cities": "city", "passes": "pass", "glass": "glass", "claims": "claim", "quickly": "quick", "running": "run", "making": "mak", "forcing": "force", "copied": "copy", "stopped": "stop", "charged": "charg", "forced": "force", "the": "the", "calling": "call"}
    assert values(spark, T.stem, *pairs) == list(pairs.values())


def test_polarity_counts_distinct_negators(spark):
    assert values(spark, T.polarity, "It works.", "It does not work.", "Not now, not ever.", "No one never left.", None) == [False, True, True, None, None]


def test_shape_and_tokens(spark):
    assert values(spark, T.shape, "  A (quoted) — “thing”… here! ", None) == ["a quoted “thing” here", None]
    assert values(spark, T.tokens, "Don't STOP the 2 tests", "", None) == [["don", "stop", "2", "tests"], [], None]


@pytest.mark.parametrize("path, want", [("/a/./b//c", "/a/b/c"), ("/a/../b", "/b"), ("/../x", "/x"), ("../x", "../x"), ("a/../../x", "../x"), ("", ""), ("/", "/"), ("a/b/..", "a")])
def test_canonical_path(spark, path, want):
    assert values(spark, T.canonical_path, path) == [want]


def test_within_needs_a_whole_part(spark):
    row = spark.range(1).select(T.path_within(F.lit("/a/b"), F.lit("/a")).alias("x"), T.path_within(F.lit("/ab"), F.lit("/a")).alias("y"), T.path_within(F.lit("../x"), F.lit("x")).alias("z")).first()
    assert tuple(row) == (True, False, False)


def test_json_strings_match_python(spark):
    import json

    texts = ['a"b\\c', "line\nbreak\t\r", "\x00\x1b\x1f\x7f", "é中𝒳", ""]
    assert values(spark, T.json_string, *texts) == [json.dumps(t, ensure_ascii=False) for t in texts]
