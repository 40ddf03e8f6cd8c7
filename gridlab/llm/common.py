"""Helpers shared by the training-data operators: scratch tables and skew-safe joins."""

from __future__ import annotations

import atexit
import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of an Arrow batch sent to a Python worker: bounds a worker's memory when texts are long.
ARROW_ROWS = 1000
#: A key is hot when it holds more than 1 / HOT_SHARE of all rows, so at most HOT_SHARE keys are hot.
HOT_SHARE = 1024
#: Bytes of text a bucket of a bucketed table is to hold, and the most buckets that Spark allows by default.
BUCKET_BYTES, MOST_BUCKETS = 64_000_000, 100_000

_roots: dict[str, str] = {}


def tune(spark: SparkSession) -> None:
    """Keep Arrow batches small; long documents would otherwise fill a Python worker.

    Plans read the setting when they run, so it can't be put back before; a smaller value that the session has stays.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    held = int(spark.conf.get(name))
    if held <= 0 or held > ARROW_ROWS:
        spark.conf.set(name, str(ARROW_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """This application's folder below spark.checkpoint.dir, which every executor can read.

    Only a local master may run without that setting; a folder under /tmp serves there.
    """
    conf = spark.sparkContext.getConf()
    base = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if conf.get("spark.master", "local").split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file:///tmp/checkpoints"
    app = spark.sparkContext.applicationId
    if app not in _roots:
        _roots[app] = f"{base.rstrip('/')}/gridlab-{app}"
        atexit.register(_remove, spark, _roots[app])
    return _roots[app]


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the JVM may have gone before the interpreter
        return


class Scratch:
    """Intermediate tables as Parquet in the shared folder.

    They cut lineage: a lost executor costs a re-read, not a recomputation. `drop` removes those whose
    readers have finished; the rest go when the application ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self.paths: dict[int, str] = {}
        self.n = 0

    def save(self, df: DataFrame, name: str) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n:03d}-{name}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        return out

    def bucketed(self, df: DataFrame, by: str, text_bytes: int) -> DataFrame:
        """df as a table bucketed by a column, so that joins and groups on it don't move its rows.

        Buckets follow the size of the text. The catalogue entry goes at once: the plan holds files and buckets.
        """
        n = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(text_bytes / BUCKET_BYTES))
        name = f"gridlab_{uuid.uuid4().hex}"
        path = f"{self.root}/{name}"
        try:
            df.write.bucketBy(min(n, MOST_BUCKETS), by).option("path", path).option("compression", "uncompressed").saveAsTable(name)
            out = self.spark.table(name)
        finally:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.paths[id(out)] = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            _remove(self.spark, self.paths.pop(id(t)))

    def clear(self) -> None:
        _remove(self.spark, self.root)
        self.paths.clear()


def join_unique(left: DataFrame, right: DataFrame, on: str, n_left: int, weight: str) -> DataFrame:
    """Inner join of many left rows with one right row a key, safe for hot keys.

    `right[weight]` counts the left rows of its key. Keys above n_left / HOT_SHARE rows, of which there are
    fewer than HOT_SHARE, are broadcast and their left rows are never shuffled; the others shuffle as usual.
    """
    limit = max(n_left // HOT_SHARE, 1)
    hot = F.broadcast(right.filter(F.col(weight) > limit))
    cold = right.filter(F.col(weight) <= limit)
    rest = left.join(hot.select(on), on, "left_anti")
    return left.join(hot, on).unionByName(rest.join(cold, on))


def text_bytes(docs: DataFrame, text_col: str) -> int:
    return docs.agg(F.sum(F.octet_length(F.col(f"`{text_col}`").cast("string")))).first()[0] or 0


def row_key(*cols: str) -> Column:
    """128 bits, as hex, of the columns' values; null differs from every value. Rows with one key are repeated rows."""
    parts = [F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), c), F.lit("null")) for c in (F.col(c).cast("string") for c in cols)]
    return F.md5(F.concat(*parts))


def keep_rows(docs: DataFrame, key: Column, verdicts: DataFrame, once: bool) -> DataFrame:
    """The rows of docs whose key is kept, all columns unchanged; with once, one row of each key.

    verdicts is a saved table (key, n, kept) with one row a key, n counting its rows in docs. Rows of keys that hold
    more than a HOT_SHARE-th of all rows are decided, and with once combined, before any shuffle.
    """
    keyed = docs.withColumn("__key", key)
    verdicts = verdicts.withColumnRenamed("key", "__key")
    limit = max((verdicts.agg(F.sum("n")).first()[0] or 0) // HOT_SHARE, 1)
    hot, cold = verdicts.filter(F.col("n") > limit), verdicts.filter(F.col("n") <= limit)
    many = keyed.join(F.broadcast(hot.filter("kept").select("__key")), "__key")
    few = keyed.join(F.broadcast(hot.select("__key")), "__key", "left_anti").join(cold.filter("kept").select("__key"), "__key")
    if once:
        many = many.groupBy("__key").agg(F.first(F.struct(*[F.col(f"`{c}`") for c in docs.columns])).alias("__row")).select("__row.*")
        few = few.withColumn("__at", F.row_number().over(Window.partitionBy("__key").orderBy("__key"))).filter(F.col("__at") == 1)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return many.select(*columns).unionByName(few.select(*columns))
