"""The audit notices each kind of tampering and invents none."""

import hashlib

from veristrata.operators import audit, graph


def store(spark, **changes):
    content = "The index keeps every record.\x00 It holds."
    data = {
        "sources": [("s1", "u1", hashlib.sha256(content.encode()).hexdigest(), content)],
        "evidence": [("e1", "s1", 0, 29, "The index keeps every record.")],
        "claims": [("c1", "The index keeps every record.", "supported", None), ("c2", "nothing found", "unresolved", "i1")],
        "claim_evidence": [("c1", "e1")],
        "investigations": [("i1",)],
        "evaluations": [("v1", "c1", "attested", "g1", "")],
        "peer_groups": [("g1", '["c2"]')],
    } | changes
    kinds = {
        "sources": "id string, uri string, checksum string, content string", "evidence": "id string, source_id string, start_offset int, end_offset int, text string",
        "claims": "id string, text string, state string, investigation_id string", "claim_evidence": "claim_id string, evidence_id string", "investigations": "id string",
        "evaluations": "id string, subject_id string, relation string, attested_by string, contradicted_by string", "peer_groups": "id string, members string",
    }
    return {k: spark.createDataFrame(v, kinds[k]) for k, v in data.items()}


def report(t, closure=False):
    checks = {
        "checksums": audit.checksums(t["sources"]).where("NOT ok"), "spans": audit.spans(t["claim_evidence"], t["evidence"], t["sources"]).where("NOT ok"),
        "texts": audit.text_mismatches(t["claims"], t["claim_evidence"], t["evidence"], t["sources"]), "dangling": audit.dangling_edges(t["claim_evidence"], t["evidence"], t["sources"]),
        "orphans": audit.orphans(t["claims"], t["claim_evidence"]), "unresolved": audit.unresolved_without_investigation(t["claims"], t["investigations"]),
        "unevaluated": audit.state_without_evaluation(t["claims"], t["evaluations"]), "groups": audit.missing_groups(t["evaluations"], t["peer_groups"]),
        "empty": audit.empty_groups(t["evaluations"], t["peer_groups"]), "members": audit.missing_members(t["evaluations"], t["peer_groups"], t["claims"]),
    }
    if closure:
        checks["stale"] = audit.stale_dependents(t["claims"], graph.dependencies(t["evaluations"], t["peer_groups"]))
    return {r["check_name"] for r in audit.summary(checks).collect() if r["n_found"] and r["check_name"] != "clean"}


def test_a_sound_store_is_clean(spark):
    assert report(store(spark), closure=True) == set()


def test_tampering(spark):
    base = "The index keeps every record."
    assert report(store(spark, evidence=[("e1", "s1", 0, 28, base)])) == {"spans", "texts"}
    assert report(store(spark, sources=[("s1", "u1", "00", base)])) == {"checksums"}
    assert report(store(spark, claims=[("c1", "edited", "supported", None), ("c2", "x", "unresolved", None)])) == {"texts", "unresolved"}
    assert report(store(spark, claim_evidence=[("c9", "e1")])) == {"orphans"}
    assert report(store(spark, evidence=[("e1", "gone", 0, 29, base)])) == {"dangling"}
    assert report(store(spark, evaluations=[("v1", "c2", "attested", "g1, g2", "")])) == {"unevaluated", "groups"}
    assert report(store(spark, peer_groups=[("g1", "[]")])) == {"empty"}
    assert report(store(spark, peer_groups=[("g1", '["c2","c3"]')])) == {"members"}


def test_closure_passes_through_states_and_cycles(spark):
    claims = spark.createDataFrame([("a", "retracted"), ("b", "inconclusive"), ("c", "supported"), ("d", "superseded"), ("e", "supported"), ("f", "supported")], "id string, state string")
    deps = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "b"), ("c", "d"), ("d", "e")], "support string, dependent string")
    assert {r["claim_id"] for r in audit.stale_dependents(claims, deps).collect()} == {"c", "e"}
    moved = {r["claim_id"]: (r["level"], r["outcome"]) for r in graph.revision(claims, deps, ("retracted",)).collect()}
    assert moved == {"b": (1, "moved"), "c": (2, "moved"), "d": (3, "refused")}
