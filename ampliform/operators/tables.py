"""Intermediate tables: computed once, kept as Parquet in the session's shared folder, read back without lineage.

A frame that is read back has its real size, so the planner can broadcast what is small, and no plan or constraint of
the frames before it, so loops plan in constant time. The folder is the one that ``spark.checkpoint.dir`` names. It is
removed when the application ends; loops discard what they no longer need themselves.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share. Only a local session, as in tests, may leave it unset."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not path:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="spark-checkpoint-")
        sc.setCheckpointDir(path)
    return path


def _path(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def own_folder(spark: SparkSession) -> str:
    """This application's part of the shared folder."""
    path = f"{shared_folder(spark)}/tables-{spark.sparkContext.applicationId}"
    fs, at = _path(spark, path)
    if not fs.exists(at):
        fs.mkdirs(at)
        fs.deleteOnExit(at)
    return path


def cut(df: DataFrame, by: str | None = None) -> DataFrame:
    """``df`` computed once, with its lineage cut; with ``by``, in folders by that column, so a part is read alone."""
    spark = df.sparkSession
    path = f"{own_folder(spark)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path, partitionBy=by)
    out = spark.read.schema(df.schema).parquet(path)
    out.kept_at = path
    return out


def discard(*frames: DataFrame) -> None:
    """Deletes the tables behind frames of ``cut`` that nothing reads any more."""
    for df in frames:
        if path := getattr(df, "kept_at", None):
            fs, at = _path(df.sparkSession, path)
            fs.delete(at, True)
