"""p8 and p9: exact token ids, whole containers."""

import os
from collections import Counter

import pytest

from veristrata.llm import containers, encode

TEXTS = ["Hello world, hello worlds!", "", None, "  \n\n\t x", "<|endoftext|> is text", "don't we'll I'm", "日本語のテキスト。สวัสดี", "a" * 5000, "​﻿\x00é\U0001f600" * 3, "x", "Hello world, hello worlds!", "1234567890 " * 50]


@pytest.fixture(scope="module")
def ranks():
    path = f"{encode.TOKENIZERS}/{encode.VOCABULARY}"
    if not os.path.exists(path):
        pytest.skip("no vocabulary here")
    return encode.load_ranks(path)


def documents(spark, texts=TEXTS):
    return spark.createDataFrame([(i if i else None, t, [7], i) for i, t in enumerate(texts)], "doc_id long, text string, ids array<int>, n_tokens int")


def test_ids_are_exact(spark, ranks):
    import tiktoken

    whole = tiktoken.Encoding("whole", pat_str=encode.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for frequent in (0, 5, encode.FREQUENT):
        got = {r["doc_id"]: list(r["ids"]) for r in encode.encoded(documents(spark), frequent=frequent).collect()}
        assert got == {i if i else None: whole.encode_ordinary(t) if t else [] for i, t in enumerate(TEXTS)}
    counts = {r["doc_id"]: r["n_tokens"] for r in encode.encoded(documents(spark), only_count=True).collect()}
    assert counts == {i: len(x) for i, x in got.items()}
    assert encode.encoded(documents(spark).limit(0)).isEmpty()


def test_merging_is_byte_pair_merging(ranks):
    merge = encode.merger(ranks)
    for word in (" records", "zyzzyva", "ß", " 12345", "\n\n\n", "qqqqqqq"):
        assert merge(word) == encode.merge_plainly(word.encode(), ranks)


def test_the_cut_takes_no_more_words_than_named(spark):
    counts = spark.createDataFrame([(f"w{i}", n) for i, n in enumerate([1000, 900, 65, 64, 64, 64, 3, 3, 2, 2])], "word string, n long")
    for frequent in range(12):
        least = encode.least_count(counts, frequent)
        assert counts.where(f"n >= {least}").count() <= frequent
    assert encode.least_count(counts, 10) == 2 and encode.least_count(counts, 9) == 3 and encode.least_count(counts, 6) == 64


def test_lexicon_holds_what_it_was_given():
    entries = {b"a": [1], b"ab": [1, 2], b"abc": [3], b"xbc": [4], b"zz": [5, 6]}
    lexicon = encode.Lexicon.compile(entries)
    words = [*entries, b"", b"b", b"abcd", b"zzz"]
    numbers = lexicon.numbers(words)
    assert [lexicon.outputs(n) if n >= 0 else None for n in numbers.tolist()] == [entries.get(w) for w in words]


def test_containers(spark):
    sizes = [(i % 50 if i % 7 else None, n) for i, n in enumerate([0, 1, 5, 9, 10, 11, 25, 100] * 40)]
    items = spark.createDataFrame(sizes, "doc_id long, n_tokens long")
    specs = spark.createDataFrame([(1, 10, "x"), (2, 64, "x"), (3, 0, "x"), (4, None, "x"), (None, 10, "x"), (1, 10, "x")], "spec_id long, capacity long, doc_id string")
    rows = containers.assigned(items, specs, len(sizes)).collect()
    for spec, capacity in ((1, 10), (2, 64)):
        own = [r for r in rows if r["spec_id"] == spec]
        load = Counter()
        for r in own:
            load[r["container_id"]] += r["n_tokens"]
        assert max(load.values()) <= capacity and sum(load.values()) == sum(n for _, n in sizes)
        assert Counter((r["doc_id"], r["n_tokens"]) for r in own if r["piece_no"] == 0 and r["start_token"] == 0 and 0 < r["n_tokens"] < capacity) == Counter((d, n) for d, n in sizes if 0 < n < capacity)
    assert {r["spec_id"] for r in rows} == {1, 2}
    assert containers.assigned(items.limit(0), specs, 0).isEmpty() and containers.assigned(items, specs.limit(0), 9).isEmpty()


def test_little_space_is_left():
    import random

    rng = random.Random(1)
    sizes = [min(512, int(rng.lognormvariate(4, 1)) + 1) for _ in range(6000)]
    groups = containers.fill(sizes, 512)
    assert sorted(i for g in groups for i in g) == list(range(len(sizes))) and all(sum(sizes[i] for i in g) <= 512 for g in groups)
    assert sum(sizes) / (len(groups) * 512) > 0.98


def test_many_capacities(spark):
    items = spark.createDataFrame([(1, 5), (2, 3)], "doc_id long, n_tokens long")
    specs = spark.createDataFrame([(i, 10) for i in range(1100)], "spec_id long, capacity long")
    assert containers.assigned(items, specs, 2).groupBy("spec_id").count().where("count = 2").count() == 1100
