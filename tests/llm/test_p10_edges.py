"""Reading levels on odd inputs, and against held-out grades."""

from veristrata.llm import reading
from veristrata.session import table

D = "/root/testdata/sf0.01"
DOCS, LABELS = "doc_id long, text string, level int", "doc_id long, rater string, grade double, text string"


def test_defined_cases(spark):
    docs = spark.createDataFrame([(1, "easy words here", 0), (2, "hard tractable lemma", 0), (None, "easy words", 0), (4, None, 0), (5, "", 0), (1, "easy words here", 0), (6, "word " * 20000, 0)], DOCS)
    labels = spark.createDataFrame([(1, "r", 1.0, ""), (2, "r", 5.0, ""), (2, None, 9.0, ""), (None, "r", 3.0, ""), (4, "r", None, "")], LABELS)
    out = reading.levels(docs, labels, keep="text").collect()
    assert len(out) == 7 and all(1 <= r["level"] <= 5 for r in out)
    by = {r["text"]: r for r in out}
    assert by["easy words here"]["level"] < by["hard tractable lemma"]["level"] and by[None]["n_words"] == by[""]["n_words"] == 0
    none = reading.levels(docs, labels.limit(0)).collect()
    assert len(none) == 7 and all(r["level"] is None for r in none)
    assert reading.levels(docs.limit(0), labels).isEmpty()


def test_held_out_grades(spark):
    """Every third graded document is left out of the fit."""
    documents, labels = table(spark, D, "documents"), table(spark, D, "reading_labels")
    out = reading.levels(documents, labels.where("pmod(xxhash64(doc_id), 3) <> 0"))
    held = reading.grades(labels).where("pmod(xxhash64(doc_id), 3) = 0").join(out, "doc_id").selectExpr("corr(level, grade) AS r", "count(*) AS n").first()
    assert held["n"] > 20 and held["r"] > 0.7, held
