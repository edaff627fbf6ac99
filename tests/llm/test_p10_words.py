"""Each distinct word has its own difficulty."""

import zlib

from veristrata.llm import reading


def test_words_do_not_share_a_difficulty(spark):
    mask, first, pair, i = (1 << 18) - 1, {}, None, 0
    while pair is None:
        word = f"w{i}"
        bucket = zlib.crc32(word.encode()) & mask
        pair = (first[bucket], word) if bucket in first else None
        first[bucket] = word
        i += 1
    easy, other = pair
    docs = [(n, f"{easy} the{n % 7} a{n % 5}" if n < 20 else f"hard the{n % 7} a{n % 5}", "x") for n in range(40)] + [(100, other, "x"), (101, "neverseen", "x"), (102, "", "x"), (103, None, "x")]
    labels = [(n, "r", 1 if n < 20 else 5) for n in range(40)]
    out = reading.levels(spark.createDataFrame(docs, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, rater string, grade int"))
    got = {r["doc_id"]: (round(r["level"], 6), r["n_words"]) for r in out.collect()}
    assert len(got) == 44 and got[0][0] < 2 and got[39][0] > 4
    assert got[100] == got[101] and got[102] == got[103] == (got[100][0], 0)
