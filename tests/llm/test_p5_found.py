"""p5_found against a plain comparison of all windows."""

import random
from collections import defaultdict

import pytest

import __spark_entry__
from veristrata.llm import shared_spans
from veristrata.session import table

D = "/root/testdata/sf0.001"


def plain(rows, tab):
    texts, where, out = {}, defaultdict(set), set()
    for i, t in rows:
        if i is not None and t is not None:
            texts[i] = min(t, texts.get(i, t))
    for i, t in texts.items():
        for a in range(len(t) - 79):
            where[t[a : a + 80]].add(i)
    for i, t in texts.items():
        shared = [False] * (len(t) + 1)
        for a in range(len(t) - 79):
            if len(where[t[a : a + 80]]) > 1:
                shared[a : a + 80] = [True] * 80
        start = None
        for p, s in enumerate(shared):
            if s and start is None:
                start = p
            elif not s and start is not None:
                out.add((tab, i, start, p))
                start = None
    return out


def rows(df):
    got = [tuple(r) for r in df.collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_registered_query_is_whole(spark):
    want = plain(table(spark, D, "claims").select("id", "text").collect(), "claims") | plain(table(spark, D, "sources").select("id", "content").collect(), "sources")
    assert want and rows(__spark_entry__.queries()["p5_found"](spark, D)) == want


@pytest.mark.parametrize("hot", [2, shared_spans.HOT])
def test_edges_do_not_depend_on_the_size(spark, hot):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("ab 𝒳é") for _ in range(n))
    parts = [word(n) for n in (79, 80, 81, 200)] + ["=" * 100]
    data = [(f"r{i}", word(rng.randrange(60)) + rng.choice(parts) + word(rng.randrange(60)) + rng.choice(parts)) for i in range(60)]
    once = word(150)
    data += [("twice", once + "|" + once), ("again", data[0][1]), ("again", data[0][1]), (None, data[1][1]), ("null", None), ("empty", ""), ("alone", word(300))]
    df = spark.createDataFrame(data, "id string, text string")
    assert rows(shared_spans.spans(df, "claims", "text", hot)) == plain(data, "claims")
