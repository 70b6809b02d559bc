"""Tables written to the cluster's shared folder: they cut lineage and survive lost executors."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

DIR_KEY = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``. Where that is unset, a new local one, on one machine alone: executors
    elsewhere would not see it, so a cluster must name a shared folder."""
    where = spark.conf.get(DIR_KEY, None)
    if not where:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.conf.get("spark.master", "")):
            raise ValueError(f"{DIR_KEY} must name a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set(DIR_KEY, where)
    return where.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: The open scopes, innermost last: what is materialized goes with the innermost.
_scopes: list[list[str]] = []


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as Parquet to the shared folder and reads it again; it goes when the ``scope`` it was written in ends."""
    spark = df.sparkSession
    path = new_path(spark, name)
    if _scopes:
        _scopes[-1].append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Deletes folders in whatever file system they are; those that are gone do no harm."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """What is materialized within is deleted at the end, after an error too: results are to be written out within."""
    _scopes.append([])
    try:
        yield
    finally:
        remove(spark, _scopes.pop())


def settled(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> tuple[DataFrame, str]:
    """The result of ``make``, written, and its folder; all else that ``make`` materialized is deleted."""
    path = new_path(spark, name)
    with scope(spark):
        result = make()
        result.write.option("compression", "zstd").parquet(path)
    if _scopes:
        _scopes[-1].append(path)
    return spark.read.schema(result.schema).parquet(path), path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
