"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_open: list[Workspace] = []


def shared_root(spark: SparkSession) -> str:
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


#: Bytes a core below which a table may well be read in fewer tasks than there are cores.
SPREAD_BYTES = 2 << 20


def spread(df: DataFrame) -> DataFrame:
    """``df`` for costly work on each row: a table too small to be read by all cores is dealt out to them, any other is left alone."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * SPREAD_BYTES else df


class Workspace:
    """A folder of Parquet tables that cut lineage: a lost executor rereads them instead of recomputing.

    Results may read from it, so what its user doesn't drop or remove goes when the driver's program ends.
    """

    def __init__(self, spark: SparkSession, purpose: str):
        self.spark = spark
        self.path = f"{shared_root(spark)}/{purpose}-{uuid.uuid4().hex}"
        _open.append(self)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.path}/{name}")
        return self.read(name, df)

    def read(self, name: str, like: DataFrame) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(f"{self.path}/{name}")

    def drop(self, name: str) -> None:
        """Delete a table that nothing reads any more."""
        delete_path(self.spark, f"{self.path}/{name}")

    def remove(self) -> None:
        """Delete the whole folder."""
        delete_path(self.spark, self.path)
        if self in _open:
            _open.remove(self)


@atexit.register
def _remove_all() -> None:
    for work in list(_open):
        # A stopped session can't delete any more; its local folder goes with the folder of our own.
        with contextlib.suppress(Exception):
            work.remove()


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
