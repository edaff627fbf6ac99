"""A versioned store of compiled tables in one folder.

Every commit writes new files and, last, the manifest that names them; a commit that dies before that changes nothing,
and readers of an older version keep their files. Records are content-addressed, so appending is insert-or-ignore and
any batch can be sent again. A commit checks what it adds: evidence must be its source's text at its offsets, and every
reference must be held. Rejected rows raise before anything is written.

The manifest holds, for each version, the files of each table, the Merkle root over all ids and the digest of states.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veristrata.operators import digests
from veristrata.operators.records import slices

KEYS = {"sources": ["id"], "evidence": ["id"], "claims": ["id"], "claim_evidence": ["claim_id", "evidence_id"], "claim_edges": ["from_id", "to_id", "relation"], "evaluations": ["id"], "peer_groups": ["id"], "investigations": ["id"]}
#: table -> (column, table it names)
REFERENCES = {"evidence": [("source_id", "sources")], "claim_evidence": [("claim_id", "claims"), ("evidence_id", "evidence")], "claim_edges": [("from_id", "claims"), ("to_id", "claims")], "evaluations": [("subject_id", "claims")]}
ID_TABLES = ("sources", "evidence", "claims", "evaluations", "peer_groups", "investigations")


class Rejected(ValueError):
    """Rows that a commit may not hold."""


class StaleVersion(RuntimeError):
    """The store has moved on since this version was opened."""


class Store:
    """The store at path, at one version (the last one unless given)."""

    def __init__(self, spark: SparkSession, path: str, version: int | None = None) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = hadoop(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._path = hadoop
        self.version = self._last() if version is None else version
        self.manifest = self._read(self.version) if self.version else {"version": 0, "tables": {}, "root": digests.empty_root(), "state_digest": None}

    # ---- manifests

    def _last(self) -> int:
        folder = self._path(f"{self.path}/manifests")
        if not self._fs.exists(folder):
            return 0
        return max((int(s.getPath().getName().removesuffix(".json")) for s in self._fs.listStatus(folder) if s.getPath().getName().endswith(".json")), default=0)

    def _read(self, version: int) -> dict:
        stream = self._fs.open(self._path(f"{self.path}/manifests/{version}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _publish(self, manifest: dict) -> None:
        """Write beside and rename: two writers of one version can't both succeed."""
        target = self._path(f"{self.path}/manifests/{manifest['version']}.json")
        beside = self._path(f"{self.path}/manifests/.{uuid.uuid4().hex}")
        out = self._fs.create(beside, False)
        out.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
        out.close()
        if self._fs.exists(target) or not self._fs.rename(beside, target):
            self._fs.delete(beside, False)
            raise StaleVersion(f"version {manifest['version']} was written by another commit")

    def check_fresh(self) -> None:
        if self._last() != self.version:
            raise StaleVersion(f"opened at version {self.version}, the store is at {self._last()}")

    # ---- tables

    def table(self, name: str) -> DataFrame:
        files = self.manifest["tables"].get(name)
        if not files:
            raise KeyError(f"no table {name} at version {self.version}")
        return self.spark.read.option("mergeSchema", "true").parquet(*(f"{self.path}/{f}" for f in files))

    def has(self, name: str) -> bool:
        return bool(self.manifest["tables"].get(name))

    def _new_rows(self, name: str, rows: DataFrame) -> DataFrame:
        rows = rows.dropDuplicates(KEYS[name])
        return rows.join(self.table(name).select(*KEYS[name]), KEYS[name], "left_anti") if self.has(name) else rows

    def _verify(self, added: dict[str, DataFrame]) -> None:
        def whole(name: str) -> DataFrame | None:
            parts = [df for df in (self.table(name) if self.has(name) else None, added.get(name)) if df is not None]
            return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True) if parts else None

        for name, rows in added.items():
            for column, target in REFERENCES.get(name, []):
                named = rows.select(column).where(F.col(column).isNotNull())
                held = whole(target)
                missing = named if held is None else named.join(held.select(F.col("id").alias(column)), column, "left_anti")
                if not missing.isEmpty():
                    raise Rejected(f"{name}.{column} names {target} that the store doesn't hold, such as {missing.first()[0]!r}")
        if "evidence" in added:
            content = whole("sources").select(F.col("id").alias("source_id"), "content")
            span = slices(F.col("content"), F.col("start_offset"), F.col("end_offset"))
            wrong = added["evidence"].join(content, "source_id").where((F.col("end_offset") < F.col("start_offset")) | ~span.eqNullSafe(F.col("text")))
            if not wrong.isEmpty():
                raise Rejected(f"evidence {wrong.first()['id']!r} isn't its source's text")

    def commit(self, tables: dict[str, DataFrame], replace: tuple[str, ...] = ()) -> Store:
        """Append the new rows of tables (whole tables where named in replace) and seal; returns the store at its new version."""
        self.check_fresh()
        files = {k: list(v) for k, v in self.manifest["tables"].items()}
        added: dict[str, DataFrame] = {}
        for name, rows in tables.items():
            new = rows.dropDuplicates(KEYS[name]) if name in replace else self._new_rows(name, rows)
            part = f"tables/{name}/{self.version + 1}-{uuid.uuid4().hex}"
            new.write.option("compression", "zstd").parquet(f"{self.path}/{part}")
            added[name] = self.spark.read.parquet(f"{self.path}/{part}")
            files[name] = [part] if name in replace else files.get(name, []) + [part]
        self._verify(added)
        manifest = {"version": self.version + 1, "tables": files}
        sealed = Store.__new__(Store)
        sealed.__dict__.update(self.__dict__, version=manifest["version"], manifest=manifest)
        manifest["root"], manifest["state_digest"] = sealed.digests()
        self._publish(manifest)
        return sealed

    # ---- identity

    def digests(self) -> tuple[str, str | None]:
        """Root over all ids, the number of edges and the state digest, and that digest, from the tables as they are."""
        state = digests.state_digest(self.table("claims")) if self.has("claims") else None
        ids = [self.table(t).select("id") for t in ID_TABLES if self.has(t)]
        n_edges = self.table("claim_edges").count() if self.has("claim_edges") else 0
        facts = self.spark.createDataFrame([("schema:1",), (f"edges:{n_edges}",), (f"state:{state}",)], "id string")
        return digests.merkle_root(digests.union_ids(facts, *ids)), state

    def matches_recorded(self) -> bool:
        """Whether the tables still give the recorded root and digest."""
        return (self.manifest["root"], self.manifest["state_digest"]) == self.digests()

    def diff(self, other: Store, name: str = "claims") -> DataFrame:
        """id, change between this version and another one."""
        return digests.diff(self.table(name), other.table(name))
