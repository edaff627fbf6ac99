"""python -m veristrata build|query|audit|verify: a store from an export, questions, and checks.

Exit codes: 0 fine, 1 the audit found something or the question has no answer, 2 wrong use.
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame

from veristrata.operators import ask, audit
from veristrata.operators.compile import compile_corpus
from veristrata.session import local_session
from veristrata.sources import exports
from veristrata.store import Store


def build(args) -> int:
    spark = local_session()
    corpus = exports.corpus(spark, args.corpus, args.author, args.limit)
    store = Store(spark, args.store)
    tables = compile_corpus(corpus).tables()
    sealed = store.commit({k: v for k, v in tables.items()})
    print(json.dumps({"version": sealed.version, "root": sealed.manifest["root"]} | {t: sealed.table(t).count() for t in tables}))
    return 0


def query(args) -> int:
    spark = local_session()
    store = Store(spark, args.store, args.version)
    rows = ask.ask(args.question, *(store.table(t) for t in ("claims", "claim_evidence", "evidence", "sources")), limit=args.limit).collect()
    for row in rows:
        print(json.dumps(row.asDict(), ensure_ascii=False))
    return 0 if rows else 1


def checks(store: Store) -> dict[str, DataFrame]:
    claims, links, evidence, sources = (store.table(t) for t in ("claims", "claim_evidence", "evidence", "sources"))
    edges = store.table("claim_edges") if store.has("claim_edges") else None
    return {
        "source_checksums": audit.checksums(sources).where("NOT ok"),
        "span_mismatches": audit.spans(links, evidence, sources).where("NOT ok"),
        "claim_texts": audit.text_mismatches(claims, links, evidence, sources),
        "dangling_edges": audit.dangling_edges(links, evidence, sources),
        "orphans": audit.orphans(claims, links, edges),
    }


def run_audit(args) -> int:
    store = Store(local_session(), args.store, args.version)
    report = {r["check_name"]: r["n_found"] for r in audit.summary(checks(store)).collect()}
    report["matches_recorded"] = int(store.matches_recorded())
    print(json.dumps(report))
    return 0 if report["clean"] and report["matches_recorded"] else 1


def verify(args) -> int:
    same = Store(local_session(), args.store, args.version).matches_recorded()
    print(json.dumps({"matches_recorded": same}))
    return 0 if same else 1


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="veristrata", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    for name, run in (("build", build), ("query", query), ("audit", run_audit), ("verify", verify)):
        own = commands.add_parser(name)
        own.set_defaults(run=run)
        own.add_argument("--store", required=True)
        if name == "build":
            own.add_argument("--corpus", required=True)
            own.add_argument("--author")
            own.add_argument("--limit", type=int)
        else:
            own.add_argument("--version", type=int)
        if name == "query":
            own.add_argument("question")
            own.add_argument("--limit", type=int, default=5)
    args = parser.parse_args(argv)
    return args.run(args)


if __name__ == "__main__":
    sys.exit(main())
