"""Tables written between steps to the folder that all executors share; they cut lineage and survive lost executors."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

DIR_KEY = "spark.checkpoint.dir"


def scratch_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names. Where it is unset a local folder serves, on one machine alone; a
    cluster must name a shared one."""
    where = spark.conf.get(DIR_KEY, None)
    if not where:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.conf.get("spark.master", "")):
            raise ValueError(f"{DIR_KEY} must name a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set(DIR_KEY, where)
    return where.rstrip("/")


#: The open scopes, innermost last: what is written goes with the innermost.
_scopes: list[list[str]] = []


#: How Parquet is written whose rows hold tiles of a megabyte and more: readers take a whole row group of such rows at
#: once, and writers close pages by their rows, not before a hundred of them.
TILE_ROWS = {"parquet.block.row.count.limit": 16, "parquet.page.row.count.limit": 4, "parquet.enable.dictionary": False}


def written(df: DataFrame, name: str, **options) -> DataFrame:
    """``df`` written as Parquet under ``scratch_dir`` and read again; it goes when the ``scope`` it was written in ends."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    df.write.options(compression="zstd", **options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Deletes folders in whatever file system they are; those that are gone do no harm."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """What is ``written`` within is deleted at the end, after an error too: results are to be written out within."""
    _scopes.append([])
    try:
        yield
    finally:
        remove(spark, _scopes.pop())


def settled(spark: SparkSession, make: Callable[[], DataFrame], name: str, before: DataFrame | None = None) -> DataFrame:
    """``written(make(), name)``, after which all else that ``make`` wrote is deleted, and so is the table ``before``, if
    it was the last result of this function: its last reader is done."""
    with scope(spark):
        result = make()
        path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
        result.write.option("compression", "zstd").parquet(path)
    if _scopes:
        _scopes[-1].append(path)
    done = spark.read.schema(result.schema).parquet(path)
    done._settled_at = path
    if getattr(before, "_settled_at", None):
        remove(spark, [before._settled_at])
    return done
