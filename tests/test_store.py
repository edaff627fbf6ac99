"""Exports, compile, store, streaming and the command line on a small corpus."""

import hashlib
import json

import pytest

from veristrata import __main__ as cli
from veristrata.operators import ask
from veristrata.operators.compile import compile_corpus
from veristrata.sources import exports
from veristrata.store import Rejected, StaleVersion, Store
from veristrata.streaming.ingest import ingest

SHARED = "Every record keeps the place where it was found."


@pytest.fixture(scope="module")
def corpus(tmp_path_factory):
    root = tmp_path_factory.mktemp("corpus")
    posts = root / "forum" / "comments"
    posts.mkdir(parents=True)
    (posts / "a1.md").write_text(f"---\nauthor: me\n# note\nid: 'a1'\nid: a2\n- list\nlate: x\n---\n\n{SHARED} The audit reads it again later.\n")
    (posts / "b2.md").write_text(f"---\nauthor: you\n---\n{SHARED} Short one.\n")
    (posts / "c3.md").write_bytes(b"no front matter, \xff but a long enough sentence here.")
    talk = root / "chat" / "x"
    talk.mkdir(parents=True)
    (talk / "t.md").write_text(f"---\nConversation ID: t9\n---\n### Me User\n**Timestamp**: now\n{SHARED}\n\n---\n### System\nskip\n### The Assistant\n\n### Assistant\nAn answer that is long enough to count.\n")
    return root


def test_export_reader(spark, corpus):
    rows = {r["uri"]: r for r in exports.corpus(spark, str(corpus), "me").collect()}
    assert set(rows) == {"forum://forum_comment/a1", "forum://forum_comment/b2", "forum://forum_comment/c3", "chat://t9/0000", "chat://t9/0003"}
    assert rows["forum://forum_comment/a1"]["meta"] == {"author": "me", "id": "a2"} and rows["forum://forum_comment/a1"]["source_type"] == "forum_comment"
    assert rows["forum://forum_comment/b2"]["source_type"] == "forum_comment_other" and "�" in rows["forum://forum_comment/c3"]["content"]
    assert rows["chat://t9/0000"]["content"] == SHARED and rows["chat://t9/0003"]["source_type"] == "chat_assistant"
    assert [r["uri"] for r in exports.corpus(spark, str(corpus), "me", 2).collect()] == ["forum://forum_comment/a1", "forum://forum_comment/b2"]


def test_ids_by_hand(spark):
    done = compile_corpus(spark.createDataFrame([("u", SHARED, "document")], "uri string, content string, source_type string"))
    sha = lambda x: hashlib.sha256(("veristrata/v1\0" + json.dumps(x, separators=(",", ":"), sort_keys=True, ensure_ascii=False)).encode()).hexdigest()
    src = "src-" + sha({"content": SHARED, "source_type": "document", "uri": "u"})
    ev = "ev-" + sha({"end_offset": len(SHARED), "meta": {}, "source_id": src, "start_offset": 0, "text": SHARED})
    clm = "clm-" + sha({"evidence_ids": [ev], "investigation_id": None, "meta": {"ordinal": 0, "origin": "extracted", "source_uri": "u"}, "state": "unexamined", "text": SHARED, "valid_time": None})
    assert [tuple(r) for r in done.claim_evidence.collect()] == [(clm, ev)] and done.sources.first()["id"] == src


def test_miner_needs_three_sources(spark, corpus):
    done = compile_corpus(exports.corpus(spark, str(corpus), "me"))
    mined = done.mined.collect()
    assert [m["text"] for m in mined] == ["The sentence shape 'every record keeps the place where it was found' occurs in 3 distinct sources."]
    assert done.edges.count() == 3 and compile_corpus(exports.corpus(spark, str(corpus), "me"), 4).mined.isEmpty()


def test_store_and_command_line(spark, corpus, tmp_path, capsys):
    path = str(tmp_path / "store")
    assert cli.main(["build", "--store", path, "--corpus", str(corpus), "--author", "me"]) == 0
    first = Store(spark, path)
    assert first.version == 1 and first.matches_recorded()
    assert cli.main(["audit", "--store", path]) == 0 and cli.main(["verify", "--store", path]) == 0
    assert cli.main(["query", "--store", path, "where was the record found"]) == 0 and "forum://forum_comment/a1[0:48]" in capsys.readouterr().out
    assert cli.main(["query", "--store", path, "zyzzyva"]) == 1
    # the same corpus again adds nothing and changes no digest
    again = first.commit(compile_corpus(exports.corpus(spark, str(corpus), "me")).tables())
    assert again.manifest["root"] == first.manifest["root"] and again.table("claims").count() == first.table("claims").count()
    with pytest.raises(StaleVersion):
        first.commit({})
    assert Store(spark, path, 1).matches_recorded() and again.diff(Store(spark, path, 1)).isEmpty()
    bad = spark.createDataFrame([("e", "nowhere", 0, 1, "x")], "id string, source_id string, start_offset int, end_offset int, text string")
    with pytest.raises(Rejected):
        again.commit({"evidence": bad})
    source = again.table("sources").first()["id"]
    with pytest.raises(Rejected):
        again.commit({"evidence": spark.createDataFrame([("e", source, 0, 1, "not the text")], bad.schema)})
    assert Store(spark, path).version == 2


def test_absence(spark):
    claims = spark.createDataFrame([("a", "The index keeps records."), ("b", None)], "id string, text string")
    assert ask.absence("the index", "t", claims).isEmpty()
    one, two = (ask.absence("zyzzyva quux", t, claims).first() for t in ("t1", "t2"))
    assert one["id"] == two["id"] and one["searched"] == ["quux", "zyzzyva"]


def test_streams_give_what_a_batch_gives(spark, tmp_path):
    rows = [(f"u{i}", f"Sentence number {i} is long enough to be a claim. {SHARED}", "document") for i in range(6)]
    frame = spark.createDataFrame(rows, "uri string, content string, source_type string")
    for i in range(3):
        frame.where(f"uri IN ('u{2 * i}', 'u{2 * i + 1}')").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    for _ in range(2):  # a second run from an old checkpoint sends everything again
        ingest(spark, str(tmp_path / "in"), str(tmp_path / "store"), str(tmp_path / f"check{_}"), 1).awaitTermination()
    got = {r["id"] for r in Store(spark, str(tmp_path / "store")).table("claims").select("id").collect()}
    assert got == {r["id"] for r in compile_corpus(frame).claims.select("id").collect()} and len(got) == 12
