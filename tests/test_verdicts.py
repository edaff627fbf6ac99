"""Relations between claims, against plain Python over all pairs."""

import random

from __spark_entry__ import queries
from veristrata.functions.text import FUNCTION_WORDS, NEGATORS
from veristrata.operators import verdicts


def tables(spark, claims, one_source=True):
    rows = [(i, t, "unexamined") for i, t in claims]
    ce = [(i, f"e{i}") for i, _ in claims]
    ev = [(f"e{i}", "s" if one_source else f"s{i}") for i, _ in claims]
    return spark.createDataFrame(rows, "id string, text string, state string"), spark.createDataFrame(ce, "claim_id string, evidence_id string"), spark.createDataFrame(ev, "id string, source_id string")


def relations(spark, claims, one_source=True):
    return {r["claim_id"]: (r["relation"], r["n_peers"]) for r in verdicts.verdicts(*tables(spark, claims, one_source)).collect()}


def test_a_negated_claim_of_one_source_contradicts(spark):
    claims = [("a", "The pipeline stores every record."), ("b", "The pipeline does not store every record."), ("c", "Something else entirely happens here.")]
    assert relations(spark, claims) == {"a": ("contradicted", 1), "b": ("contradicted", 1), "c": ("inconclusive", 0)}
    assert relations(spark, claims, one_source=False)["a"] == ("inconclusive", 0)


def test_copies_and_containers_attest_nothing(spark):
    claims = [("a", "Use the tool to read text"), ("b", "Use the tool to read text"), ("c", "Use the tool to read text with more words")]
    assert set(relations(spark, claims).values()) == {("inconclusive", 0)}
    claims = [("a", "The corpus compiles offline."), ("b", "The corpus compiles offline without network access.")]
    assert relations(spark, claims)["a"] == ("attested", 1)


def test_nothing_normalises_to_no_relation(spark):
    claims = [("a", "Это не то."), ("b", "But that is not what it was."), ("c", None), ("d", "")]
    assert {r for r, _ in relations(spark, claims).values()} == {"inconclusive"}


def test_equal_to_all_pairs(spark):
    rng = random.Random(4)
    words = "red blue green copy copies copied root path index stop stopped".split() + ["not", "the", "no"]
    claims = [(f"c{i:03d}", " ".join(rng.choice(words) for _ in range(rng.randrange(1, 7))) + rng.choice([".", "!", ""])) for i in range(150)]
    norm = {r["claim_id"]: r for r in verdicts.normalised(tables(spark, claims)[0]).collect()}
    seq = {i: norm[i]["seq"].split() for i, _ in claims}
    text = dict(claims)

    def run(a, b):
        return any(b[k : k + len(a)] == a for k in range(len(b) - len(a) + 1))

    want = {(x, y) for x in seq for y in seq if x != y and seq[x] and seq[y] and seq[x][0] == seq[y][0] and seq[x] != seq[y] and run(seq[x], seq[y]) and text[x].strip() not in text[y].strip()}
    frame = verdicts.normalised(tables(spark, claims)[0])
    assert {tuple(r) for r in verdicts.attestations(frame).collect()} == want and want
    for i, t in claims:
        negs = {w for w in "".join(c if c.isalnum() else " " for c in t.lower()).split() if w in NEGATORS}
        assert norm[i]["polarity"] == {0: False, 1: True}.get(len(negs))
        assert not set(seq[i]) & set(FUNCTION_WORDS)


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_ngrams_meet_as_hashes_and_are_never_sorted(spark):
    """Texts beside every n-gram ran a heap of 750 MB out of memory at 0.1 GB of claims."""
    claims = [(f"c{i}", f"Record {i} keeps its own path {i % 3}") for i in range(30)]
    runs = verdicts.sequence_runs(verdicts.normalised(tables(spark, claims)[0]))
    assert {kind for _, kind in runs.dtypes} == {"bigint"}
    assert "ShuffledHashJoin" in plan_of(runs) and "SortMergeJoin" not in plan_of(runs)


def test_a_run_anywhere_in_the_peer_attests(spark):
    """Against plain Python over all pairs, for leads of every length."""
    rng = random.Random(6)
    words = [f"w{i}" for i in range(6)]
    claims = [(f"c{i:03d}", " ".join(rng.choice(words) for _ in range(rng.randrange(1, 24)))) for i in range(60)]
    for i in range(60):  # runs of them with other ends and beginnings
        own = claims[i][1].split()
        start, end = sorted(rng.sample(range(len(own) + 1), 2))
        claims.append((f"r{i:03d}", " ".join(own[start:end]) + rng.choice([".", "!"])))
    seq = {i: t.rstrip(".!").split() for i, t in claims}
    text = dict(claims)

    def run(a, b):
        return any(b[k : k + len(a)] == a for k in range(len(b) - len(a) + 1))

    want = {(x, y) for x in seq for y in seq if seq[x] != seq[y] and run(seq[x], seq[y]) and text[x] not in text[y]}
    norm = verdicts.normalised(tables(spark, claims)[0])
    got = [tuple(r) for r in verdicts.attestations(norm, anywhere=True).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert any(seq[x][0] != seq[y][0] for x, y in want) and {1, 2, 4, 8} <= {1 << (len(seq[x]).bit_length() - 1) for x, _ in want}


def attesting(spark, tmp_path, query):
    """The query's rows over two claims, the first of which is a run in the middle of the second."""
    claims = [("a", "compiles offline."), ("b", "The corpus compiles offline without network access.")]
    spark.createDataFrame(claims, "id string, text string").write.mode("overwrite").parquet(f"{tmp_path}/claims.parquet")
    return {tuple(r) for r in queries()[query](spark, str(tmp_path)).collect()}


def test_attestations_find_a_run_in_the_middle(spark, tmp_path):
    assert attesting(spark, tmp_path, "attestations") == {("a", "b")}


def test_supported_claims_count_peers_with_the_run_in_the_middle(spark, tmp_path):
    assert attesting(spark, tmp_path, "supported_claims") == {("a", 1)}


def test_supported_claims_sort_no_ngrams(spark, tmp_path):
    spark.createDataFrame([("a", "compiles offline.")], "id string, text string").write.parquet(f"{tmp_path}/claims.parquet")
    plan = plan_of(queries()["supported_claims"](spark, str(tmp_path)))
    assert "ShuffledHashJoin [lead" in plan
