"""Segments: examples, and offsets that always give the text back."""

import random

import pytest

from veristrata.operators import segment


def cut(text):
    return [text[a:b] for a, b in segment.spans(text)]


@pytest.mark.parametrize(
    "text, want",
    [
        ("One thing. Another thing! A third?", ["One thing.", "Another thing!", "A third?"]),
        ("Dr. Smith arrived. He was late.", ["Dr. Smith arrived.", "He was late."]),
        ("Wait... what happened? Nothing.", ["Wait...", "what happened?", "Nothing."]),
        ('He said "no." Then he left.', ['He said "no."', "Then he left."]),
        ("", []),
        (" \n\t ", []),
        ("no terminator here", ["no terminator here"]),
        ("See e.g. the doc.", ["See e.", "g. the doc."]),
        ("It ends on dr.", []),
        ("First para here.\n\n---\n\nSecond para here.", ["First para here.", "Second para here."]),
        ("```python\nx = 1\n```\nProse here.", ["x = 1", "Prose here."]),
        ("## Why so?\n\nBecause it is.", ["Why so?", "Because it is."]),
        ("a # b - c 3 * 4 -", ["a # b - c 3 * 4 -"]),
        ("- a\n- b", ["- a\n- b"]),
        ("One\x00two. Three\x85four", ["One", "two.", "Three", "four"]),
        (None, []),
    ],
)
def test_examples(text, want):
    assert cut(text) == want


def test_offsets_are_exact_and_in_order():
    rng = random.Random(1)
    for _ in range(3000):
        text = "".join(rng.choice(["a", "dr", ".", "!", "\n", " ", "# ", "---", "\x00", ")", "é", "𝒳", " "]) for _ in range(rng.randrange(25)))
        last = 0
        for a, b in segment.spans(text):
            assert last <= a < b <= len(text) and text[a:b] == text[a:b].strip()
            last = b


def test_rows_of_a_table(spark):
    rows = spark.createDataFrame([("u1", "One. Two.", 5), ("u2", None, 6), ("u3", "", 7), ("u1", "One. Two.", 5)], "uri string, content string, ordinal int")
    got = sorted(tuple(r) for r in segment.segments(rows).collect())
    assert got == [("u1", 0, 0, 4, "One."), ("u1", 0, 0, 4, "One."), ("u1", 1, 5, 9, "Two."), ("u1", 1, 5, 9, "Two.")]
