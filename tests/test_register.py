"""SQL functions give what the columns give."""

from pyspark.sql import functions as F

from veristrata.functions import text as T
from veristrata.functions.register import register


def test_functions(spark):
    register(spark)
    texts = ["The  “index” keeps: it's (all)!", "", None, " short ", "A sentence that is long enough, surely.", "with a control \x00 character in it"]
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").createOrReplaceTempView("vs_texts")
    got = spark.sql("SELECT i, vs_tokens(t) AS a, vs_shape(t) AS b, vs_is_proposition(t) AS c FROM vs_texts ORDER BY i").collect()
    t = F.col("t")
    want = spark.table("vs_texts").select("i", T.tokens(t).alias("a"), T.shape(t).alias("b"), T.is_proposition(t).alias("c")).orderBy("i").collect()
    assert got == want
    rows = spark.sql("SELECT i, s.* FROM vs_texts, LATERAL vs_segments(t) s WHERE i IN (1, 2, 4)").collect()
    assert [tuple(r) for r in rows] == [(4, 0, 0, 39, texts[4])]
