"""Scratch tables in the folder that all executors share.

A written table cuts lineage: what is lost with an executor is read again, not recomputed.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: So many rows, at least, are worth a task of their own.
ROWS_PER_FILE = 25_000


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share. On a cluster it is the one in spark.checkpoint.dir, which must be set; only in local mode,
    as in tests, a temporary folder is made for the session, and deleted when the process ends."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        made = tempfile.mkdtemp(prefix="ontolith-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        folder = "file://" + made
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


_made: list[str] = []


def clear(spark: SparkSession) -> None:
    """Deletes all scratch tables that this process has made. Results that were not written or collected can no longer be read."""
    while _made:
        _delete(spark, _made.pop())


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


class Scratch:
    """Tables written under one fresh folder of the shared one."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        _made.append(self.root)

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def write(self, df: DataFrame, table: str, rows: int | None = None, **options: str) -> DataFrame:
        """Writes and reads again. rows: an upper bound, if known; a small table then is few files."""
        few = None if rows is None else -(-rows // ROWS_PER_FILE)
        if few is not None and few < int(self.spark.conf.get("spark.sql.shuffle.partitions")):
            df = df.coalesce(max(1, few))
        df.write.options(**options).parquet(self.path(table))
        return self.read(table, df)

    def read(self, table: str, like: DataFrame) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(self.path(table))

    def drop(self, *tables: str) -> None:
        for table in tables:
            _delete(self.spark, self.path(table))
