"""Words are named without a regex over the texts, and short tasks of the passes don't walk through all loaded modules."""

import gc
import hashlib
import time

import pyarrow as pa
import regex

from veristrata.llm import reading

ODD = ["", None, "  ", "Don’t don't DON’T", "İSTANBUL K ΑΣ aΣ ΟΔΟΣ’Σ x", "École éCOLE " * 40, "É" * 70 + "a", "A\x00b\x1fc\x85d\xa0e_f", "ǅ ß ẞ ﬁ Ⅷ ² ½", "一二三，四五六。" * 30, "a­b é x"]


def batch(texts):
    return pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.string()), pa.nulls(len(texts), pa.string())], names=["doc_id", "text", "kept"])


def named(texts):
    return [x for b in reading._items(iter([batch(texts)])) for x in b.column(1).to_pylist()]


def expected(texts):
    words = [{w.lower() for w in regex.findall(r"[\p{L}\p{N}]+", t or "")} for t in texts]
    return [sorted(int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little", signed=True) for w in own) for own in words]


def test_words_of_odd_texts(monkeypatch):
    texts = ODD + [f"{a}{b}" for a in ODD if a for b in ODD if b] + [f"a{chr(i)}B {chr(i)}" for i in range(1, 0x3000)]
    assert [sorted(x) for x in named(texts)] == expected(texts)
    monkeypatch.setattr(reading, "_KNOWN", 7)
    assert [sorted(x) for x in named(texts)] == expected(texts)


def test_naming_costs_less_than_finding_words():
    texts = [" ".join(f"Word{(i * 31 + j * j) % 997}, and" for j in range(300)) for i in range(200)]
    find = regex.compile(r"[\p{L}\p{N}]+").findall

    held, took = batch(texts), ([], [])
    for _ in range(9):
        for run, own in zip((lambda: list(reading._items(iter([held]))), lambda: [find(t) for t in texts]), took, strict=True):
            began = time.thread_time()
            run()
            own.append(time.thread_time() - began)
    assert min(took[0]) < 0.8 * min(took[1])


def test_modules_are_set_aside_in_workers(spark):
    assert spark.sparkContext.parallelize([0], 1).mapPartitions(lambda part: [(len(reading._own(iter(()))), gc.get_freeze_count())]).first()[1] > 10_000


def test_levels_of_documents_without_words():
    import numpy as np

    s = np.array([1, np.nan, 3], np.float32)
    at, items = np.array([0, 0, 2, 2, 5, 5]), np.array([0, 1, 0, 2, 2], np.int32)
    level, n = reading._levels_of(at, items, s, 1.0, 0.5)
    assert n.tolist() == [0, 1, 0, 3, 0]
    assert np.allclose(level, [0, 0, 0, 4 / 2.5, 0])
