"""Sharding by size-tiered compaction with a versioned manifest (operator 10).

A dataset is a folder of immutable Parquet shards and manifests. Arrivals are appended as small
shards; compaction merges shards of one size tier into the next, up to a target size, and splits
those far beyond it; every change writes the next manifest under a temporary name and commits it
by a rename that fails if that version exists. Readers take the newest manifest and read the
shards it names, so they see whole versions only. The folder lies wherever Hadoop's file system
API reaches; that the rename is one step is a property of HDFS and of local disks. On an object
store without it, writers must take turns.
"""

from __future__ import annotations

import json
import re
import time
import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class Conflict(RuntimeError):
    """Another writer committed the version first."""


@dataclass(frozen=True)
class Shard:
    name: str
    bytes: int


class ShardedDataset:
    """Shards in `folder`. Tier t holds shards of `small` * `fan_in` ** t bytes and more; `fan_in`
    shards of a tier are merged, until shards reach `target` bytes."""

    def __init__(self, spark: SparkSession, folder: str, *, target: int = 128 << 20, small: int = 4 << 20, fan_in: int = 4):
        self.spark, self.folder, self.target, self.small, self.fan_in = spark, folder.rstrip("/"), target, small, fan_in
        self.jvm = spark.sparkContext._jvm
        self.fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.fs.mkdirs(self._path("_manifests"))

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def versions(self) -> list[int]:
        found = (re.fullmatch(r"v(\d{10})\.json", s.getPath().getName()) for s in self.fs.listStatus(self._path("_manifests")))
        return sorted(int(m[1]) for m in found if m)

    def manifest(self, version: int | None = None) -> dict:
        """The newest manifest, or that of a version; an empty one before the first."""
        known = self.versions()
        if not known:
            return {"version": 0, "schema": None, "shards": []}
        at = self.fs.open(self._path(f"_manifests/v{known[-1] if version is None else version:010d}.json"))
        try:
            return json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(at, "UTF-8"))
        finally:
            at.close()

    def _commit(self, old: dict, shards: list[Shard], schema: dict) -> dict:
        new = {"version": old["version"] + 1, "schema": schema, "shards": [vars(s) for s in sorted(shards, key=lambda s: s.name)]}
        temporary, final = self._path(f"_manifests/.{uuid.uuid4().hex}"), self._path(f"_manifests/v{new['version']:010d}.json")
        out = self.fs.create(temporary, False)
        try:
            out.write(bytearray(json.dumps(new).encode()))
        finally:
            out.close()
        hadoop = self.jvm.org.apache.hadoop.fs
        strict = self.spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 1)
        strict[0] = getattr(hadoop, "Options$Rename").NONE
        context = hadoop.FileContext.getFileContext(final.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        try:  # unlike FileSystem's rename, this one never replaces a file
            context.rename(temporary, final, strict)
        except Py4JJavaError as e:
            self.fs.delete(temporary, False)
            if "FileAlreadyExistsException" in e.java_exception.getClass().getName():
                raise Conflict(f"version {new['version']} exists") from e
            raise
        return new

    def _write(self, df: DataFrame) -> list[Shard]:
        """Writes df's partitions as shards of a new subfolder; failed attempts leave none there."""
        run = uuid.uuid4().hex
        # Row groups are what a shard that turns out too long can be split at.
        df.write.option("parquet.block.size", str(max(1 << 16, self.target // 2))).parquet(f"{self.folder}/{run}")
        return [Shard(f"{run}/{s.getPath().getName()}", s.getLen()) for s in self.fs.listStatus(self._path(run)) if s.getPath().getName().endswith(".parquet") and s.getLen()]

    def append(self, df: DataFrame) -> dict:
        """Adds df's rows: each of its partitions arrives as a shard."""
        old = self.manifest()
        schema = old["schema"] or df.schema.jsonValue()
        if StructType.fromJson(schema).simpleString() != df.schema.simpleString():
            raise ValueError(f"arrivals have the schema {df.schema.simpleString()}")
        return self._commit(old, [Shard(**s) for s in old["shards"]] + self._write(df), schema)

    def tier(self, size: int) -> int:
        t, bound = 0, self.small
        while size >= bound:
            t, bound = t + 1, bound * self.fan_in
        return t

    def compact(self) -> dict:
        """Merges full tiers, smallest first, until none is full or can shrink, and splits shards of
        twice the target and more; each merge is a version.

        The shards of a tier are read with partitions of the merged size, so a merge moves no
        rows between executors: a task reads a few shards and writes one. A shard is split between
        its row groups, likewise.
        """
        now, done = self.manifest(), set()
        while True:
            tiers: dict[int, list[Shard]] = {}
            for s in (Shard(**s) for s in now["shards"]):
                if s.bytes >= 2 * self.target:
                    tiers.setdefault(-1, []).append(s)
                elif s.bytes < self.target // 2:
                    tiers.setdefault(self.tier(s.bytes), []).append(s)
            full = [t for t in sorted(tiers) if t not in done and (t < 0 or len(tiers[t]) >= self.fan_in)]
            if not full:
                return now
            t, runs = full[0], tiers[full[0]]
            size = self.target if t < 0 else min(self.target, max(self.fan_in * max(s.bytes for s in runs), self.small))
            made = self._write(self._read(runs, now["schema"], size))
            if t < 0:
                done.add(t)
            if len(made) <= len(runs) if t < 0 else len(made) >= len(runs):
                # One row group each, or the session's own partition size forbids larger ones.
                self.fs.delete(self._path(made[0].name.split("/")[0]), True)
                done.add(t)
                continue
            gone = {s.name for s in runs}
            now = self._commit(now, [s for s in (Shard(**s) for s in now["shards"]) if s.name not in gone] + made, now["schema"])

    def _read(self, shards: list[Shard], schema: dict | None, size: int | None = None) -> DataFrame:
        kind = StructType.fromJson(schema) if schema else StructType()
        if not shards:
            return self.spark.createDataFrame([], kind)
        session = self.spark
        if size:
            session = self.spark.newSession()
            session.conf.set("spark.sql.files.maxPartitionBytes", str(size))
            session.conf.set("spark.sql.files.openCostInBytes", "0")
            session.conf.set("spark.sql.files.minPartitionNum", "1")
        return session.read.schema(kind).parquet(*[f"{self.folder}/{s.name}" for s in shards])

    def read(self, version: int | None = None) -> DataFrame:
        m = self.manifest(version)
        return self._read([Shard(**s) for s in m["shards"]], m["schema"])

    def sweep(self, keep: int = 2, orphan_seconds: int = 86_400) -> int:
        """Deletes all manifests but the newest `keep` and the shards that only those deleted name.

        Shards that no manifest names go once they are `orphan_seconds` old: younger ones may be a
        writer's that has not committed yet. Readers of older versions than those kept lose them.
        Returns how many shards went.
        """
        known = self.versions()
        expired, kept = known[:-keep], known[-keep:]
        named = {s["name"] for v in kept for s in self.manifest(v)["shards"]}
        past = {s["name"] for v in expired for s in self.manifest(v)["shards"]}
        gone, young = 0, int(time.time() * 1000) - 1000 * orphan_seconds
        for run in self.fs.listStatus(self._path("")):
            name = run.getPath().getName()
            if not run.isDirectory() or name == "_manifests":
                continue
            files = {f"{name}/{s.getPath().getName()}" for s in self.fs.listStatus(run.getPath()) if s.getPath().getName().endswith(".parquet")}
            if not named & files and (past & files or run.getModificationTime() < young):
                self.fs.delete(run.getPath(), True)
                gone += len(files)
        for v in expired:
            self.fs.delete(self._path(f"_manifests/v{v:010d}.json"), False)
        return gone


def shard(docs: DataFrame, folder: str, *, target: int = 128 << 20, small: int = 4 << 20, fan_in: int = 4) -> DataFrame:
    """Appends docs to a dataset in `folder`, compacts it and reads the committed version back.

    Returns for each row doc_id, n_bytes (of its text; a null text has none), text_sha256 (of
    the stored text in UTF-8; null for a null one), shard and version. All columns of docs are
    stored as they are, whatever their names; null ids and repeated rows stay; an empty table
    commits a version without rows.
    """
    data = ShardedDataset(docs.sparkSession, folder, target=target, small=small, fan_in=fan_in)
    data.append(docs)
    now = data.compact()
    data.sweep(keep=1)  # a new folder, so nobody reads the versions before
    name = F.concat_ws("/", F.element_at(F.split(F.input_file_name(), "/"), -2), F.element_at(F.split(F.input_file_name(), "/"), -1))
    return data.read().select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        F.sha2(F.encode("text", "UTF-8"), 256).alias("text_sha256"),
        name.alias("shard"),
        F.lit(now["version"]).cast("long").alias("version"),
    )
