"""Intermediate tables in the shared folder that spark.checkpoint.dir names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where it is unset, a temporary one on a single machine (tests); on a
    cluster the executors would not see it, so that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="basketwise-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back: worked out once, and safe from lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    release(spark)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished phases now: it does so when the driver collects garbage."""
    jvm = getattr(spark, "_jvm", None)
    if jvm is not None:
        jvm.System.gc()


def _files(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def listed(spark: SparkSession, path: str) -> list[tuple[str, float]]:
    """(name, seconds since 1970 of its last change) of what lies in a folder; nothing where there is none."""
    where, files = _files(spark, path)
    return [(x.getPath().getName(), x.getModificationTime() / 1000) for x in files.listStatus(where)] if files.exists(where) else []


def lengths(spark: SparkSession, path: str) -> dict[str, int]:
    """Bytes of the data files in a folder by name: a listing, contents stay unread. Nothing where there is no folder."""
    where, files = _files(spark, path)
    found = files.listStatus(where) if files.exists(where) else []
    return {n: x.getLen() for x in found if not (n := x.getPath().getName()).startswith(("_", "."))}


def removed(spark: SparkSession, path: str) -> None:
    where, files = _files(spark, path)
    files.delete(where, True)
