"""p4 and p6: sentence units and repeated lines."""

import time

import pytest

from veristrata.llm import sentences, site_lines


def cut(text, fragment=False):
    return [text[a:b] for a, b in sentences.units(text, fragment)]


@pytest.mark.parametrize(
    "text, want",
    [
        ("Dr. Smith came at 3.5 p.m. and left. He was late.", 2), ("The answer was no. He left at once.", 2), ("It was in the sec. Then it stopped.", 2), ("She lives on King St. The house is blue.", 2),
        ("We asked for vitamin C. The clinic had none.", 2), ("See no. 5 and fig. 3 there.", 1), ("J. R. Smith met St. Mary.", 1), ("これは文です。次の文。", 2), ("यह वाक्य है। दूसरा वाक्य।", 2),
        ("He said: \"Stop. Now.\" and left.", 1), ("Am 3. Mai kam er. Dann ging er.", 2), ("# Title\n- one\n- two\n\nA line\nwrapped here.", 4), ("你好吗？很好！", 2), ("ประโยคแรก ประโยคสอง", 2), ("", 0), (" \n ", 0), (None, 0),
    ],
)
def test_counts(text, want):
    assert len(sentences.units(text)) == want


def test_edges_of_units():
    assert cut("# Title\n1. One item\n\n(All of it.) Next one!") == ["Title", "One item", "(All of it.)", "Next one!"]
    assert cut("half a sentence) goes on. Then", True)[-1] == "Then"


def test_many_brackets_take_linear_time():
    start = time.time()
    assert len(sentences.units("a (b. c) " * 20_000)) == 1
    assert time.time() - start < 5


def test_units_of_records(spark):
    rows = spark.createDataFrame([("r", "One. Two.", 1), ("r", "One. Two.", 1), (None, "One.", 1), ("n", None, 1), ("e", "", 1)], "id string, content string, start_offset int")
    got = sorted(tuple(r) for r in sentences.sentence_units(rows, "sources", "content").collect())
    assert got == [("sources", "r", 0, 4), ("sources", "r", 5, 9)]
    assert sentences.sentence_units(rows.limit(0), "sources", "content").isEmpty()


def lines(spark):
    rows = [(f"c{i:02d}", f"Own text {'x' * i}\nShare  this NOW {i}\n***", '{"source_uri":"u1"}') for i in range(12)]
    rows += [(f"d{i:02d}", f"Other {'y' * i}", '{"source_uri":"u2"}') for i in range(30)]
    rows += [("c00", rows[0][1], rows[0][2]), ("two", "share this now 5\nShare this now 6", '{"source_uri":"u1"}'), ("n", None, '{"source_uri":"u1"}'), ("m", "Share this now 1", None), ("u", "Share this now 1", '{"source_uri":"u9"}'), (None, "Share this now 1", '{"source_uri":"u1"}'), ("only", "Share this now 9", '{"source_uri":"u1"}')]
    claims = spark.createDataFrame([(*r, 0) for r in rows], "id string, text string, meta string, source_type int")
    return claims, spark.createDataFrame([("u1", "forum", "x"), ("u2", "wiki", "x"), (None, "forum", "x"), ("u3", None, "x")], "uri string, source_type string, id string")


def test_repeated_lines(spark):
    got = {tuple(r) for r in site_lines.found(*lines(spark)).collect()}
    assert got == {(f"c{i:02d}", 2) for i in range(12)} | {("two", 1), ("two", 2), ("only", 1)}
    tested = site_lines.lines(*lines(spark)).collect()
    assert [(r["inside"], r["outside"], r["significant"]) for r in tested] == [(14, 0, True)] and tested[0]["p"] < 1e-6


def test_cleaning_keeps_all_else(spark):
    out = {r["claim_id"]: (r["text"], r["n_removed"]) for r in site_lines.cleaned(*lines(spark)).collect()}
    assert out["c03"] == ("Own text xxx\n***", 1) and out["two"] == ("", 2) and out["only"] == ("", 1) and out["n"] == (None, 0) and out["m"] == ("Share this now 1", 0)
    assert len(out) == 47


def test_p_values_are_close_in_the_far_tail(spark):
    import math

    from pyspark.sql import functions as F

    for g2, p in [(r["g2"], r["p"]) for r in spark.range(1, 60).selectExpr("CAST(id AS DOUBLE) * 3 AS g2").select("g2", site_lines.p_value(F.col("g2")).alias("p")).collect()]:
        assert abs(p / math.erfc(math.sqrt(g2 / 2)) - 1) < 1e-3


def test_a_hot_type_without_lines(spark):
    claims, sources = lines(spark)
    assert site_lines.found(claims.limit(0), sources).isEmpty() and site_lines.found(claims, sources.limit(0)).isEmpty()
    assert site_lines.cleaned(claims, sources.limit(0)).where("n_removed > 0").isEmpty()
