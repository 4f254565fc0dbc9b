"""A table of rows by file that is replaced file by file: copy on write, with a manifest for each version."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..staging import file_system


class CommitConflict(RuntimeError):
    """Another writer committed the version first."""


@dataclass(frozen=True)
class Manifest:
    """One version: the folder of each bucket that has rows, and the last batch of each stream that it holds."""

    version: int
    buckets: dict[str, str] = field(default_factory=dict)
    batches: dict[str, int] = field(default_factory=dict)
    schema: str = ""


class FileTable:
    """Rows keyed by ``key`` below ``path``; ``replace`` puts new rows in place of all rows of the same keys.

    Keys are dealt to ``buckets`` by a hash. A replacement reads and rewrites the buckets of its keys alone, into new folders; then it
    writes the next manifest. A manifest is written whole beside its place and moved there, and a move never overwrites, so of two writers of one
    version one fails, and a writer that dies before the move leaves the old version as it was. Readers open one manifest, and with it one version. ``vacuum``
    deletes manifests and folders that no kept version names.

    The number of buckets is fixed when the table is made; a manifest has one entry for each, whatever the rows.
    """

    def __init__(self, spark: SparkSession, path: str, key: str = "file", buckets: int = 64):
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets

    def _manifest(self, version: int) -> str:
        return f"{self.path}/_versions/{version:012d}.json"

    def versions(self) -> list[int]:
        """Versions that can be read, ascending."""
        fs, folder = file_system(self.spark, f"{self.path}/_versions")
        if not fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith((".", "_")))

    def manifest(self, version: int | None = None) -> Manifest:
        known = self.versions()
        if version is None:
            if not known:
                return Manifest(0)
            version = known[-1]
        if version not in known:
            raise ValueError(f"{self.path} has no version {version}")
        return Manifest(**json.loads(self.spark.read.text(self._manifest(version), wholetext=True).first()[0]))

    def _commit(self, new: Manifest) -> None:
        fs, final = file_system(self.spark, self._manifest(new.version))
        _, draft = file_system(self.spark, f"{self.path}/_versions/.{uuid.uuid4().hex}")
        out = fs.create(draft)
        out.write(bytearray(json.dumps(new.__dict__, sort_keys=True).encode()))
        out.close()
        if fs.exists(final) or not fs.rename(draft, final):
            fs.delete(draft, False)
            raise CommitConflict(f"version {new.version} of {self.path} exists")

    def _read(self, folders: list[str], schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{f}" for f in folders])

    def read(self, version: int | None = None) -> DataFrame | None:
        """All rows of a version, the newest without a number; None of a table that has none yet."""
        m = self.manifest(version)
        if not m.schema:
            return None
        if not m.buckets:
            return self.spark.createDataFrame([], m.schema)
        return self._read(sorted(set(m.buckets.values())), m.schema)

    def lookup(self, *keys: str) -> DataFrame | None:
        """Rows of these keys; only their buckets are read."""
        m = self.manifest()
        if not m.schema:
            return None
        asked = self.spark.createDataFrame([(k,) for k in keys], "k string").select(self._bucket("k")).distinct().collect()
        folders = [m.buckets[str(r[0])] for r in asked if str(r[0]) in m.buckets]
        rows = self._read(folders, m.schema) if folders else self.spark.createDataFrame([], m.schema)
        return rows.where(F.col(self.key).isin(*keys))

    def _bucket(self, column: str):
        return F.pmod(F.xxhash64(column), F.lit(self.buckets)).cast("int").alias("bucket")

    def replace(self, rows: DataFrame, keys: DataFrame | None = None, stream: str = "", batch: int | None = None) -> int:
        """Put ``rows`` in place of all rows of their keys and of ``keys`` (for files that have no rows any more); returns the version.

        A ``batch`` of a ``stream`` that the table holds already changes nothing. A null key is a key of its own. ``rows`` must have the table's
        columns, whose order and nullability don't matter.
        """
        old = self.manifest()
        if batch is not None and old.batches.get(stream, -1) >= batch:
            return old.version
        schema = old.schema or ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
        if old.schema:
            rows = rows.select(*self.spark.createDataFrame([], old.schema).columns)
        gone = rows.select(self.key) if keys is None else rows.select(self.key).unionByName(keys.select(self.key))
        gone = gone.distinct()
        touched = sorted(r[0] for r in gone.select(self._bucket(self.key)).distinct().collect())
        if not touched and old.version:
            return old.version
        held = [old.buckets[str(b)] for b in touched if str(b) in old.buckets]
        fresh = rows
        if held:
            kept = self._read(held, schema).alias("o").join(gone.alias("g"), F.expr(f"o.`{self.key}` <=> g.`{self.key}`"), "left_anti")
            fresh = kept.unionByName(rows)
        folder = f"data-{uuid.uuid4().hex}"
        # One more hash inside a bucket spreads a large one over tasks; files of a bucket share its folder.
        dealt = fresh.withColumn("bucket", self._bucket(self.key)).repartition("bucket", F.xxhash64(self.key))
        dealt.write.partitionBy("bucket").option("compression", "zstd").parquet(f"{self.path}/{folder}")
        fs, made = file_system(self.spark, f"{self.path}/{folder}")
        written = {s.getPath().getName().removeprefix("bucket=") for s in fs.listStatus(made) if s.isDirectory()}
        buckets = {b: f for b, f in old.buckets.items() if int(b) not in touched} | {b: f"{folder}/bucket={b}" for b in written}
        batches = old.batches | ({stream: batch} if batch is not None else {})
        self._commit(Manifest(old.version + 1, buckets, batches, schema))
        return old.version + 1

    def vacuum(self, keep: int = 1) -> int:
        """Delete all but the newest ``keep`` versions, and what no kept one needs; returns how many folders went. Not beside a writer."""
        fs, root = file_system(self.spark, self.path)
        known = self.versions()
        kept = [self.manifest(v) for v in known[-keep:]]
        for v in known[:-keep]:
            fs.delete(file_system(self.spark, self._manifest(v))[1], False)
        used = {f for m in kept for f in m.buckets.values()}
        count = 0
        for top in fs.listStatus(root) if fs.exists(root) else []:
            name = top.getPath().getName()
            if not name.startswith("data-"):
                continue
            parts = [s.getPath() for s in fs.listStatus(top.getPath()) if s.isDirectory()]
            stale = [p for p in parts if f"{name}/{p.getName()}" not in used]
            for p in [top.getPath()] if len(stale) == len(parts) else stale:
                fs.delete(p, True)
            count += len(stale)
        return count
