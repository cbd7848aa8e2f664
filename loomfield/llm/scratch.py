"""Intermediate tables in the folder that driver and executors share.

Lineage is cut by writing Parquet below ``spark.checkpoint.dir``, never by keeping blocks on
executors, so that losing an executor costs a re-read and not a recomputation. Where the session
names no such folder one is made and set once if the session is on one machine (tests); on a
cluster that is an error, as a folder of the driver's is not the executors'.
"""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Spark deletes the files of an execution's shuffles when it ends
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by the session, or one of our own when none is named and all runs on this machine."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="loomfield-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


class Scratch:
    """Tables of one operator call; what the result reads lives until the session ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        atexit.register(self.drop)

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and read it back; nobody reads the shuffles of that job again, so their files go with it."""
        path = f"{self.root}/{name}"
        before = self.spark.conf.get(CLEANUP, "false")
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.mode("overwrite").parquet(path)
        finally:
            self.spark.conf.set(CLEANUP, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str = "") -> None:
        """Delete one table, or all of them; a stopped session leaves nothing to delete with."""
        context = self.spark.sparkContext
        if context._jsc is None:
            return
        try:
            jvm = context._jvm
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # noqa: BLE001  the gateway may be gone at exit
            return


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
