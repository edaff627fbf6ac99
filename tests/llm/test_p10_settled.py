"""The alternation goes on until levels stop changing, and reaches documents far from the graded ones."""

import random

from veristrata.llm import reading


def test_documents_without_graded_words_get_levels(spark):
    """Hop by hop: graded words a/h, then b/i, then c/j; documents of the last kind share no word with graded ones."""
    rng, docs, labels = random.Random(3), [], []
    pick = lambda kind: [f"{kind}{rng.randrange(12)}" for _ in range(9)]
    for n in range(240):
        hard, step = n % 2, n // 60
        kinds = [("a", "h"), ("a", "h"), ("b", "i"), ("c", "j")][step][hard], [("a", "h"), ("b", "i"), ("c", "j"), ("c", "j")][step][hard]
        docs.append((n, " ".join(pick(kinds[0]) + pick(kinds[1]) + pick("both"))))
        if step == 0:
            labels.append((n, "r", 5 if hard else 1))
    out = reading.levels(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, rater string, grade int"))
    level = {r["doc_id"]: r["level"] for r in out.collect()}
    assert len(level) == 240
    for step in range(4):
        easy, hard = ([level[n] for n in range(step * 60 + k, step * 60 + 60, 2)] for k in (0, 1))
        assert max(easy) + 1 < min(hard), step
