"""Stored corpora: built once, published as versions, opened by many.

A version is a folder of Parquet tables:

* ``rail``: the words of each document in order;
* ``postings``: term, document, tf and positions, a file for each part of the
  rail, sorted by (term, document), so that a question reads the pages of its
  terms, and a term with very many documents is spread over all files;
* ``vocabulary``: term, tf, df and the folded form;
* ``doc_stats``: tokens and width of each document;
* ``totals``: one row of corpus scalars.

A build writes beside the versions and is published by one rename, which fails
if another build took the number.  Readers keep the version they opened; older
ones go with ``retire`` after a time of grace.
"""

from __future__ import annotations

import atexit
import contextlib
import hashlib
import shutil
import tempfile
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .corpus import Corpus, StoredCorpus, folded, total_row

TABLES = ("rail", "postings", "vocabulary", "doc_stats", "totals")
#: Bytes a core below which a table may well be read in fewer tasks than there are cores.
SPREAD_BYTES = 2 << 20
#: Bytes of the rail whose postings are sorted at once.
PART_BYTES = 3 << 20


def spread(df: DataFrame) -> DataFrame:
    """A table too small to be read by all cores is dealt out to them, any other is left alone."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * SPREAD_BYTES else df


def _fs(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def shared_folder(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; in local runs without one a folder of our own, elsewhere an error."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="lexigrain-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(root)
        root = spark.sparkContext.getCheckpointDir()
    return root.rstrip("/")


def kept(df: DataFrame, name: str) -> DataFrame:
    """A small table written to the shared folder and read again; it goes when the driver's program ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)

    def remove() -> None:
        with contextlib.suppress(Exception):
            fs, where = _fs(spark, path)
            fs.delete(where, True)

    atexit.register(remove)
    return spark.read.schema(df.schema).parquet(path)


def versions(spark: SparkSession, path: str) -> list[int]:
    fs, where = _fs(spark, f"{path}/versions")
    return sorted(int(f.getPath().getName()) for f in fs.listStatus(where) if f.getPath().getName().isdigit()) if fs.exists(where) else []


def _inverted(rail: DataFrame, keep: list[str]) -> DataFrame:
    """The terms of each row of the rail with their positions, found by sorting the row's own words: nothing travels."""
    # Behind generators, so that each step is worked out once, whatever uses it.
    placed = F.filter(F.transform("words", lambda w, i: F.struct(w.alias("term"), i.alias("pos"))), lambda x: x["term"].isNotNull())
    rows = rail.select("doc_id", *keep, "dl", F.explode(F.array(F.sort_array(placed))).alias("t")).where(F.size("t") > 0)
    rows = rows.select("doc_id", *keep, "dl", F.explode(F.array(F.struct(F.col("t.term").alias("w"), F.col("t.pos").alias("p")))).alias("t"))
    rows = rows.select("doc_id", *keep, "dl", F.col("t.w").alias("w"), F.col("t.p").alias("p"))
    begins = F.filter(F.sequence(F.lit(0), F.size("w") - 1), lambda i: (i == 0) | (F.get("w", i) != F.get("w", i - 1)))
    rows = rows.select("doc_id", *keep, "dl", "w", "p", F.explode(F.array(begins)).alias("b"))
    run = lambda i, k: F.struct(F.get("w", i).alias("term"), F.slice("p", i + 1, F.coalesce(F.get("b", k + 1), F.size("w")) - i).alias("positions"))
    rows = rows.select("doc_id", *keep, "dl", F.explode(F.transform("b", run)).alias("x"))
    return rows.select("x.term", "doc_id", *keep, "dl", F.size("x.positions").cast("long").alias("tf"), "x.positions")


def held(rail: DataFrame, keep: list[str]) -> DataFrame:
    """term, doc_id, the kept columns, dl, tf, positions; rows of one id that are alike in these are one document."""
    again = rail.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    if again.isEmpty():
        return _inverted(rail, keep)
    alone = _inverted(rail.join(again, "doc_id", "left_anti"), keep)
    twice = _inverted(rail.join(again, "doc_id", "left_semi"), keep).groupBy("term", "doc_id", *keep, "dl")
    return alone.unionByName(twice.agg(F.sum("tf").alias("tf"), F.sort_array(F.flatten(F.collect_list("positions"))).alias("positions")))


def build(corpus: Corpus, path: str) -> int:
    """Write the corpus as a new version under ``path`` and publish it; returns its number."""
    spark = corpus.documents.sparkSession
    staged = f"{path}/building-{uuid.uuid4().hex}"
    keep = list(corpus.keep)
    Corpus(spread(corpus.documents.select("doc_id", *keep, "text")), corpus.keep, corpus.chain).rail.write.option("compression", "zstd").option("parquet.block.size", 2 * PART_BYTES).parquet(f"{staged}/rail")
    rail = spark.read.parquet(f"{staged}/rail")
    # The rail is read in parts small enough to be sorted in memory, whatever the session reads at once.
    apart = spark.newSession()
    apart.conf.set("spark.sql.files.maxPartitionBytes", PART_BYTES)
    held(apart.read.parquet(f"{staged}/rail"), keep).sortWithinPartitions("term", "doc_id").write.option("compression", "zstd").parquet(f"{staged}/postings")
    postings = spark.read.parquet(f"{staged}/postings")
    terms = postings.groupBy("term").agg(F.sum("tf").alias("tf"), F.count("*").alias("df")).withColumn("plain", folded(F.col("term")))
    terms.repartitionByRange("term").sortWithinPartitions("term").write.parquet(f"{staged}/vocabulary")
    rail.select("doc_id", *keep, F.col("dl").alias("doc_tokens"), F.size("words").cast("long").alias("doc_width")).write.parquet(f"{staged}/doc_stats")
    total_row(spark.read.parquet(f"{staged}/doc_stats")).write.parquet(f"{staged}/totals")
    jvm = spark._jvm.org.apache.hadoop.fs
    fs, _ = _fs(spark, path)
    fs.mkdirs(jvm.Path(f"{path}/versions"))
    context = jvm.FileContext.getFileContext(jvm.Path(path).toUri(), spark._jsc.hadoopConfiguration())
    none = spark.sparkContext._gateway.new_array(jvm.Options.Rename, 1)
    none[0] = jvm.Options.Rename.NONE
    while True:
        known = versions(spark, path)
        number = known[-1] + 1 if known else 1
        try:
            context.rename(jvm.Path(staged), jvm.Path(f"{path}/versions/{number:010d}"), none)
        except Py4JJavaError as e:
            # Another build took the number; ours is the next one.
            if "FileAlreadyExists" not in str(e.java_exception):
                raise
        else:
            return number


def open_stored(spark: SparkSession, path: str, documents: DataFrame, keep: tuple[str, ...] = ("lang", "source", "year"), version: int | None = None) -> StoredCorpus:
    """The newest version (or the one named) as a corpus; ``documents`` gives the texts for concordances."""
    known = versions(spark, path)
    if not known or (version is not None and version not in known):
        raise ValueError(f"{path} has no such version")
    where = f"{path}/versions/{known[-1] if version is None else version:010d}"
    return StoredCorpus(documents, keep, None, None, {t: spark.read.parquet(f"{where}/{t}") for t in TABLES})


def retire(spark: SparkSession, path: str, keep: int = 1, grace_hours: float = 1.0) -> int:
    """Delete all but the newest ``keep`` versions, and builds that were never published, once they are older than ``grace_hours``."""
    stale, gone = 1000 * (time.time() - 3600 * grace_hours), 0
    older = {f"{v:010d}" for v in versions(spark, path)[:-keep]}
    for folder in (path, f"{path}/versions"):
        fs, where = _fs(spark, folder)
        for f in fs.listStatus(where) if fs.exists(where) else []:
            name = f.getPath().getName()
            if (name in older or name.startswith("building-")) and f.getModificationTime() < stale:
                fs.delete(f.getPath(), True)
                gone += 1
    return gone


_known: dict[tuple[str, str], str] = {}


def shared(spark: SparkSession, documents: DataFrame, corpus: Corpus, name: str = "letters") -> StoredCorpus:
    """The stored form of a corpus over file tables, built by the first query of an application that asks for it.

    It is named by the tables' files with their sizes and times, so that changed files are another corpus, and it is
    deleted when the driver's program ends.
    """
    fs_of = lambda p: _fs(spark, p)
    files = []
    for p in sorted(documents.inputFiles()):
        fs, where = fs_of(p)
        status = fs.getFileStatus(where)
        files.append((p, status.getLen(), status.getModificationTime()))
    stamp = hashlib.sha256(repr((name, files)).encode()).hexdigest()[:32]
    key = (spark.sparkContext.applicationId, stamp)
    if key not in _known:
        path = f"{shared_folder(spark)}/corpus-{stamp}-{uuid.uuid4().hex[:8]}"
        build(corpus, path)
        _known[key] = path

        def remove() -> None:
            # A stopped session can't delete any more; its local folder goes with the folder of our own.
            with contextlib.suppress(Exception):
                fs, where = _fs(spark, path)
                fs.delete(where, True)

        atexit.register(remove)
    return open_stored(spark, _known[key], documents, corpus.keep)
