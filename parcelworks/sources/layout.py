"""The register's layout for analysis: tables bucketed by holding, headers also partitioned by village."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelworks.session import shared_dir


def bucketed(rows: DataFrame, name: str, key: str = "khata_id", buckets: int | None = None, partition: str | None = None, folder: str | None = None, **options: str) -> tuple[DataFrame, str]:
    """The table, and its name: ``rows`` as Parquet files dealt into ``buckets`` by the key's hash and sorted by it.

    Joins, aggregations and windows by the key on tables of as many buckets need no exchange. ``partition`` names a column
    that makes folders, which filters on it skip. The number of buckets is that of shuffle partitions if not given:
    tables that are to be joined need the same. A table is made of one shuffle by the key, which a plan that has its rows
    by the key already does without. The table lies in ``folder``, the shared one if not given, and goes when the
    interpreter ends; ``options`` are those of Spark's Parquet writer.
    """
    spark = rows.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"{name}_{uuid.uuid4().hex}"
    folder = folder or shared_dir(spark)
    writer = rows.repartition(buckets, key).write.format("parquet").bucketBy(buckets, key).sortBy(key).options(path=f"{folder}/{table}", **options)
    (writer.partitionBy(partition) if partition else writer).saveAsTable(table)
    atexit.register(drop, spark, table, folder)
    return read(spark, table, key), table


def buckets_for(spark: SparkSession, size: int, each: int = 8 << 20) -> int:
    """Buckets for ``size`` bytes of source files: one for each ``each`` bytes, as many as tasks can run at once at least. A
    task's rows do not grow with the input, whatever the number of shuffle partitions is, so its sorts stay in memory."""
    return max(spark.sparkContext.defaultParallelism, size // each)


def read(spark: SparkSession, table: str, key: str = "khata_id") -> DataFrame:
    """A table that bucketed() has made. The key is renamed to itself with a mark, so that a union of such tables is known
    to have its rows by the key still (attributes of different tables do not compare otherwise)."""
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")  # joins by the key and more need no exchange either
    rows = spark.table(table)
    return rows.select(*[F.col(c).alias(c, metadata={"bucketed": True}) if c == key else F.col(c) for c in rows.columns])


def drop(spark: SparkSession, table: str, folder: str | None = None) -> None:
    """Remove a table that bucketed() has made in ``folder``, with its files."""
    try:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder or shared_dir(spark)}/{table}")
        spark.sql(f"DROP TABLE IF EXISTS {table}")
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the session is gone; the folder's owner clears it
        return


def signature(spark: SparkSession, *paths: str) -> tuple:
    """What tells a change of files: their names, lengths and times."""
    out = []
    for name in paths:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        files = fs.listFiles(path, True)
        while files.hasNext():
            f = files.next()
            out.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return tuple(sorted(out))
