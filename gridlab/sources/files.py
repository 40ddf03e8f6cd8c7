"""Parquet in and out. A dataset is a directory; only a directory that this library wrote is overwritten."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

MARK = "_GRIDLAB"


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def _file(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def write(df: DataFrame, path: str, overwrite: bool = False, max_records: int | None = None) -> None:
    """Raises if the path exists, unless overwrite is given and the library wrote it."""
    spark = df.sparkSession
    fs, where = _file(spark, path)
    _, mark = _file(spark, f"{path}/{MARK}")
    if overwrite and fs.exists(where) and not fs.exists(mark):
        raise FileExistsError(f"{path} wasn't written by this library")
    writer = df.write.mode("overwrite" if overwrite else "errorifexists")
    if max_records:
        writer = writer.option("maxRecordsPerFile", max_records)
    writer.parquet(path)
    fs.create(mark).close()


def disk_size(spark: SparkSession, path: str) -> int:
    fs, where = _file(spark, path)
    return fs.getContentSummary(where).getLength()


def is_table(spark: SparkSession, path: str) -> bool:
    """A path that ends in .parquet or is a directory."""
    fs, where = _file(spark, path)
    return path.endswith(".parquet") or (fs.exists(where) and fs.getFileStatus(where).isDirectory())


def named(path: str, suffix: str) -> str:
    """The path with the suffix; `test` in a directory that is named alone."""
    path = f"{path}test" if path.endswith("/") else path
    return path if path.endswith(suffix) else path + suffix


def remove_scratch(spark: SparkSession, path: str) -> None:
    """Remove a directory that holds nothing but Parquet parts and marks of a write; anything else is left and an error."""
    fs, where = _file(spark, path)
    if not fs.exists(where):
        return
    held = list(fs.listStatus(where))
    odd = [f.getPath().getName() for f in held if f.isDirectory() or not f.getPath().getName().startswith(("part-", "_", "."))]
    if odd:
        raise ValueError(f"{path} holds {odd[:3]}")
    fs.delete(where, True)
