"""Written tables in the cluster's shared folder, used to cut lineage."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir``.

    Only on a local master that names none (tests, a laptop) is a local folder
    made and kept in the session's settings; executors could not read it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-limnos-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nothing has used before."""
    return f"{shared_dir(spark)}/limnos/{name}-{uuid.uuid4().hex}"


class Scope:
    """The tables that were staged within a ``scope``, so that they can be deleted together."""

    def __init__(self) -> None:
        self.paths: list[str] = []

    def drop(self, spark: SparkSession) -> None:
        """Delete the tables of this scope, which nothing may still read."""
        hadoop = spark.sparkContext._jsc.hadoopConfiguration()
        while self.paths:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.paths.pop())
            at.getFileSystem(hadoop).delete(at, True)


_scope: ContextVar[Scope | None] = ContextVar("scope", default=None)


@contextmanager
def scope() -> Iterator[Scope]:
    """What this thread stages within the block, but not what it stages in a scope within it, belongs to the scope.

    Nothing is deleted by itself: a result of the block may read it. Write what
    is to stay, then call ``drop``. Tables staged by others are never touched.
    """
    own = Scope()
    token = _scope.set(own)
    try:
        yield own
    finally:
        _scope.reset(token)


def stage(df: DataFrame, name: str, *partition_by: str, group_rows: int | None = None) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Later steps read files instead of repeating the plan, survive the loss of
    executors, and get true sizes for the choice of a broadcast. Readers decode
    up to 4,096 rows of a row group at once and writers hold a hundred at least;
    where rows have megabytes, ``group_rows`` bounds the rows of a group.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if group_rows:
        writer = writer.option("parquet.block.row.count.limit", group_rows)
    if own := _scope.get():
        own.paths.append(path)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
