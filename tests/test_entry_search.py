"""entry() runs and ranks as BM25 computed one text after the other."""

import math
import re
from collections import Counter

import __spark_entry__
from veristrata.functions.text import FUNCTION_WORDS
from veristrata.operators import segment
from veristrata.plans import text_queries
from veristrata.session import table

D = "/root/testdata/sf0.001"


def words(text):
    return [w for w in re.findall("[a-z0-9]+", text.lower()) if w not in FUNCTION_WORDS]


def propositions(spark):
    out = {}
    for r in table(spark, D, "documents").select("doc_id", "text").collect():
        for n, (a, b) in enumerate(segment.spans(r["text"])):
            body = r["text"][a:b]
            if len(body) >= 25 and not re.search(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f\x85\x9f]", body) and any(c.isalpha() for c in body):
                out[r["doc_id"], n] = (a, b, body)
    return out


def test_entry_is_the_whole_ranking(spark):
    texts = propositions(spark)
    counts = {k: Counter(words(v[2])) for k, v in texts.items()}
    mean = sum(sum(c.values()) for c in counts.values()) / len(counts)
    score = Counter()
    for t in sorted(set(words(text_queries.QUESTION))):
        df = sum(1 for c in counts.values() if c[t])
        for k, c in counts.items():
            score[k] += math.log((len(texts) - df + 0.5) / (df + 0.5) + 1) * c[t] * 2.5 / (c[t] + 1.5 * (0.25 + 0.75 * sum(c.values()) / mean))
    want = {k: s for k, s in score.items() if s > 0}
    rows = __spark_entry__.entry(spark).collect()
    got = {(r["doc_id"], r["ordinal"]): r["score"] for r in rows}
    assert len(rows) == len(got) > 0 and got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-5 for k in want)
    assert [r["score"] for r in rows] == sorted((r["score"] for r in rows), reverse=True)
    assert all((r["start_offset"], r["end_offset"], r["text"]) == texts[r["doc_id"], r["ordinal"]] for r in rows)


def test_term_stats_count_every_term(spark):
    df, tf = Counter(), Counter()
    for _, _, body in propositions(spark).values():
        tf.update(words(body))
        df.update(set(words(body)))
    got = __spark_entry__.queries()["bm25_term_stats"](spark, D).collect()
    assert {r["term"]: (r["df"], r["tf"]) for r in got} == {t: (df[t], tf[t]) for t in tf}
