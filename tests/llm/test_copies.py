"""p1 and p2: small cases, edges, and equality with comparing all pairs."""

import random

import pytest

from veristrata.llm import bloom, form_copies, near_copies

SCHEMA = "id string, text string, n int, h1 int"


def claims(spark, *rows):
    return spark.createDataFrame([(i, t, 0, 0) for i, t in rows], SCHEMA)


ROWS = [
    ("b", "The index, keeps RECORDS"), ("a", "the  index\tkeeps records!"), ("a", "the  index\tkeeps records!"), ("c", "keeps the index records"),
    ("f2", "b: two x; a = one"), ("f1", "a: one\nb: two x"), ("f3", "a: one b: two x"), ("s", "two words"), ("t", "Two words"), ("n", None), ("e", ""), (None, "the index keeps records"),
    ("l1", "word " * 30000), ("l2", "Word\n" * 30000),
]


@pytest.mark.parametrize("range_rows", [4, 1 << 24])
def test_copies_of_form(spark, range_rows):
    df = claims(spark, *ROWS)
    got = {tuple(r) for r in form_copies.copies(df, range_rows=range_rows).collect()}
    assert got == {("a", "a"), ("b", "a"), ("f1", "f1"), ("f2", "f1"), ("l1", "l1"), ("l2", "l1")}
    whole = {r["first_id"]: r["n_copies"] for r in form_copies.collapsed(df, range_rows=range_rows).collect()}
    assert whole == {"a": 2, "f1": 2, "l1": 2, "c": 1, "f3": 1, "s": 1, "t": 1, "n": 1, "e": 1}


def test_no_copies_in_an_empty_table(spark):
    df = claims(spark, *ROWS).limit(0)
    assert form_copies.copies(df).isEmpty() and form_copies.collapsed(df).isEmpty()


def test_filters_of_ranges_stay_sharp(spark):
    """Far more rows than one small filter takes: with a filter per range next to nothing but repeats is kept."""
    n, kept = 60_000, 0
    h = spark.range(n).selectExpr("xxhash64(id) AS h1")
    for part in range(12):
        own = h.where(f"pmod(shiftright(h1, 20), 12) = {part}")
        bits, held = bloom.repeated_filter(own, "h1", 1)
        kept += bloom.only_possible_repeats(own, "h1", bits, held).count()
    assert kept < n // 100


def pairs_by_sets(sets, num=7, den=10):
    out = set()
    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            common = len(sets[a] & sets[b])
            if common * den >= (len(sets[a] | sets[b])) * num:
                out.add((a, b))
    return out


def corpus():
    rng = random.Random(2)
    out = []
    for family in range(12):
        base = [f"w{rng.randrange(40)}" for _ in range(rng.randrange(8, 30))]
        for k in range(9):
            own = base[:]
            for _ in range(rng.randrange(3)):
                own[rng.randrange(len(own))] = f"x{rng.randrange(9)}"
            out.append((f"c{family:02d}-{k}", " ".join(own)))
    return out + [("n", None), ("e", ""), ("short", "a b c d e f g"), ("d1", out[0][1]), ("d2", out[0][1].upper() + "!"), ("d1", out[0][1]), (None, out[0][1])]


def word_sets(rows):
    out = {}
    for i, t in rows:
        w = (t or "").lower().replace("!", "").split()
        if i and len(w) >= 8:
            out[i] = {*zip(w, w[1:])}
    return out


@pytest.mark.parametrize("hot, expand", [(2, 1000), (200, 1)])
def test_near_copies_equal_all_pairs(spark, monkeypatch, hot, expand):
    rows = corpus()
    monkeypatch.setattr(near_copies.links, "__defaults__", ((7, 10), hot))
    groups = spark.createDataFrame([("g1", '["A", "b ","c","c"]', 9), ("g2", '["a","B","c"]', 9), ("g3", '["z"]', 9), ("g4", "[]", 9), ("g5", None, 9), ("g6", "no json", 9)], "id string, members string, k1 int")
    got = {tuple(r) for r in near_copies.record_pairs(claims(spark, *rows), groups, expand).collect()}
    want = {("claims", a, b) for a, b in pairs_by_sets(word_sets(rows))} | {("peer_groups", "g1", "g2")}
    if expand == 1:  # the smallest id of each text stands for it in all other pairs
        rep = {i: min(j for j, u in rows if j and u == t) for i, t in rows if i and t}
        stars = {("claims", rep[i], i) for i in word_sets(rows) if rep[i] != i}
        want = {x for x in want if x[0] != "claims" or (rep[x[1]], rep[x[2]]) == x[1:]} | stars
        assert len(stars) > 3
    assert got == want and len(want) > 60


def test_classes_and_empty_tables(spark):
    rows, none = corpus(), spark.createDataFrame([], "id string, members string")
    out = {r["id"]: r for r in near_copies.record_classes(claims(spark, *rows), none).collect()}
    sets = word_sets(rows)
    assert set(out) == set(sets)
    for i, r in out.items():
        same = [j for j in sets if sets[j] == sets[i]]
        assert (r["class_id"], r["n_copies"]) == (min(same), len(same))
    assert near_copies.record_pairs(spark.createDataFrame([], SCHEMA), none).isEmpty()


def test_word_pairs_are_linear(spark):
    import time

    texts = spark.createDataFrame([(str(i), " ".join(f"w{j}" for j in range(20_000))) for i in range(4)], "id string, text string")
    start = time.time()
    assert near_copies.word_pairs(texts, "text").selectExpr("sum(size(elements)) AS n").first()["n"] == 4 * 19_999
    assert time.time() - start < 20
