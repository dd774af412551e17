"""Size-tiered shards with a versioned manifest.

Arrivals are appended as small immutable shard files.  Shards belong to tiers
by size, each ``FANOUT`` times as large as the one below; when a tier holds
``FANOUT`` shards or more, all of its shards are merged into files near the
target size, which Spark's own packing of small files into tasks does without a
shuffle: a task reads the shards that fill one target file and writes it.
Shards at the top tier are never rewritten, so a row is copied once a tier.

What a dataset holds is said by its newest manifest alone: a Parquet table of
the live shards, published under the next version number by one rename that
fails if that number exists.  An append that loses the race adds its shards to
the winner's manifest and tries again; a merge that loses it is given up.  A
writer that dies leaves files that no manifest names; readers keep the version
they opened.  Retired shards stay until ``vacuum`` removes what the kept
versions don't name.  Files that no manifest has ever named may belong to a
writer that is still at work, so ``vacuum`` leaves them until they are older
than ``GRACE_HOURS``.

Only DataFrame operations and file-system renames run; rows aren't dealt by any
key, so no key can be hot.

Defined results: rows are kept as they are (nulls, ties, repeated rows, any
columns); an empty append commits a version without new shards; an empty
dataset reads as no rows of the given schema; appends of another schema fail.
"""

from __future__ import annotations

import time
import uuid
from collections import Counter
from contextlib import contextmanager
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TARGET_BYTES, FANOUT, TIERS = 512 << 20, 4, 4
#: The longest that a writer may take from its first file to its commit.
GRACE_HOURS = 24.0
#: How often an append tries to commit.
TRIES = 100
_MANIFEST = "path string, bytes long, n_rows long, run string"


@contextmanager
def _packed(spark: SparkSession, size: int):
    """Reads pack files into tasks of ``size`` bytes."""
    wanted = {"spark.sql.files.maxPartitionBytes": str(size), "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


@dataclass
class ShardedDataset:
    """A sharded table at ``path``, a folder that all machines share."""

    spark: SparkSession
    path: str
    target_bytes: int = TARGET_BYTES
    fanout: int = FANOUT
    tiers: int = TIERS

    def _fs(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def versions(self) -> list[int]:
        fs, where = self._fs(f"{self.path}/manifests")
        return sorted(int(f.getPath().getName()) for f in fs.listStatus(where) if f.getPath().getName().isdigit()) if fs.exists(where) else []

    def manifest(self, version: int | None = None) -> DataFrame:
        """The live shards of a version (the newest by default): path, bytes, n_rows, run."""
        known = self.versions()
        if not known:
            return self.spark.range(0).select(*(F.lit(None).cast(t).alias(n) for n, t in (x.split() for x in _MANIFEST.split(", "))))
        return self.spark.read.schema(_MANIFEST).parquet(f"{self.path}/manifests/{known[-1] if version is None else version:010d}")

    def _publish(self, rows: DataFrame, version: int) -> None:
        """Commit ``rows`` as the next version in one step, or raise if another writer was first."""
        staged = f"{self.path}/manifests/.{uuid.uuid4().hex}"
        rows.coalesce(1).write.parquet(staged)
        jvm = self.spark._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(jvm.org.apache.hadoop.fs.Path(self.path).toUri(), self.spark._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        none[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        try:
            context.rename(jvm.org.apache.hadoop.fs.Path(staged), jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifests/{version:010d}"), none)
        except Py4JJavaError:
            self._fs(staged)[0].delete(jvm.org.apache.hadoop.fs.Path(staged), True)
            raise

    def _shards(self, run: str) -> DataFrame:
        """What a finished run wrote: sizes from the file system's listing, counts from the files' footers."""
        fs, where = self._fs(f"{self.path}/shards/{run}")
        if not any(f.getPath().getName().startswith("part-") for f in fs.listStatus(where)):
            return self.manifest().where("false")
        rows = self.spark.read.parquet(f"{self.path}/shards/{run}")
        found = rows.groupBy(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("bytes")).agg(F.count("*").alias("n_rows"))
        return found.withColumn("run", F.lit(run))

    def _write(self, df: DataFrame) -> str:
        run = uuid.uuid4().hex
        df.write.option("compression", "zstd").parquet(f"{self.path}/shards/{run}")
        return run

    def append(self, arrivals: DataFrame) -> int:
        """Write the arrivals as small shards and commit them; returns the version."""
        run = self._write(arrivals)
        for left in range(TRIES, 0, -1):
            known = self.versions()
            base = known[-1] if known else 0
            try:
                self._publish(self.manifest(base or None).unionByName(self._shards(run)), base + 1)
            except Py4JJavaError as e:
                # Another writer has this number: its shards and ours both count.
                if left == 1 or "FileAlreadyExists" not in str(e.java_exception):
                    raise
            else:
                return base + 1
        raise AssertionError

    def _tiered(self, version: int | None = None) -> DataFrame:
        """The manifest with each shard's tier: 0 the smallest, ``tiers`` done."""
        full = self.target_bytes / 2
        steps = F.floor(F.log(F.lit(full) / F.greatest(F.col("bytes"), F.lit(1))) / F.log(F.lit(float(self.fanout)))) + 1
        tier = F.when(F.col("bytes") >= full, F.lit(self.tiers)).otherwise(F.greatest(F.lit(0), F.lit(self.tiers) - steps))
        return self.manifest(version).withColumn("tier", tier.cast("int"))

    def compact(self) -> int | None:
        """Merge the lowest tier that is full, with the tiers below it; returns the new version, or None if none is."""
        known = self.versions()
        if not known:
            return None
        tiered = self._tiered(known[-1])
        # One row per shard, not per document: file names that the driver has to hand to the scan anyway.
        shards = [(r["tier"], r["path"], r["bytes"]) for r in tiered.select("tier", "path", "bytes").toLocalIterator()]
        held = Counter(t for t, _, _ in shards if t < self.tiers)
        due = min((t for t, n in held.items() if n >= self.fanout), default=None)
        if due is None:
            return None
        merged = [(path, size) for t, path, size in shards if t <= due]
        # Never more files than the bytes call for, however the session packs them: each merge leaves fewer shards.
        files = max(1, -(-sum(b for _, b in merged) // self.target_bytes))
        with _packed(self.spark, self.target_bytes):
            run = self._write(self.spark.read.parquet(*(p for p, _ in merged)).coalesce(files))
        kept = tiered.where(F.col("tier") > due).drop("tier")
        self._publish(kept.unionByName(self._shards(run)), known[-1] + 1)
        return known[-1] + 1

    def compact_fully(self) -> int:
        """Compact until no tier is full; returns the number of merges."""
        n = 0
        while self.compact() is not None:
            n += 1
        return n

    def read(self, version: int | None = None, schema=None) -> DataFrame:
        paths = [r["path"] for r in self.manifest(version).select("path").toLocalIterator()]
        if not paths:
            fields = schema.fields if schema is not None else []
            return self.spark.range(0).select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in fields))
        return self.spark.read.parquet(*paths)

    def vacuum(self, keep: int = 1, grace_hours: float = GRACE_HOURS) -> int:
        """Delete what the newest ``keep`` manifests don't name; returns the number of runs deleted.

        Runs named by an older manifest were committed, so they are retired and go at once, with that manifest.
        Runs and staged manifests that no manifest names go when they are older than ``grace_hours``.
        """
        known = self.versions()
        # One row per shard, which the driver has to handle anyway; read without an exchange.
        named = {v: {r["run"] for r in self.manifest(v).select("run").toLocalIterator()} for v in known}
        live = set().union(*(named[v] for v in known[-keep:]))
        retired = set().union(*(named[v] for v in known[:-keep])) - live
        stale = 1000 * (time.time() - 3600 * grace_hours)
        fs, where = self._fs(f"{self.path}/shards")
        gone = 0
        for f in fs.listStatus(where) if fs.exists(where) else []:
            run = f.getPath().getName()
            # The newest file counts, as a folder's own time stands still while its files grow.
            if run in retired or (run not in live and self._newest(fs, f) < stale):
                fs.delete(f.getPath(), True)
                gone += 1
        for v in known[:-keep]:
            fs.delete(self._fs(f"{self.path}/manifests/{v:010d}")[1], True)
        fs, where = self._fs(f"{self.path}/manifests")
        for f in fs.listStatus(where) if fs.exists(where) else []:
            if f.getPath().getName().startswith(".") and f.isDirectory() and self._newest(fs, f) < stale:
                fs.delete(f.getPath(), True)
        return gone

    def _newest(self, fs, status) -> int:
        """The time in milliseconds at which anything below was last written."""
        newest, files = status.getModificationTime(), fs.listFiles(status.getPath(), True)
        while files.hasNext():
            newest = max(newest, files.next().getModificationTime())
        return newest
