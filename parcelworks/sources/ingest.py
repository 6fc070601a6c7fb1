"""Landing zone: scan, admission, content deduplication, storage keys."""

from __future__ import annotations

import math
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Media types that are admitted, and the greatest size.
MIME = {"pdf": "application/pdf", "jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "tif": "image/tiff", "tiff": "image/tiff"}
MOST_BYTES = 60 * 1024 * 1024

REGISTER = ("villages", "documents", "khata_records", "khasra_parcels", "ownership_details", "audit_logs")


def load_register(spark: SparkSession, folder: str, names: tuple[str, ...] = REGISTER) -> dict[str, DataFrame]:
    """The register's tables in a folder of Parquet tables."""
    return {n: spark.read.parquet(f"{folder}/{n}") for n in names}


def load_register_jdbc(spark: SparkSession, url: str, properties: dict, names: tuple[str, ...] = REGISTER, split_by: dict[str, str] | None = None, partitions: int | None = None) -> dict[str, DataFrame]:
    """The register's tables in a relational database; filters and columns are pushed down to it.

    ``split_by`` names a number, date or timestamp column of a table, by which it is read in ``partitions`` ranges at a
    time (as many as shuffle partitions if not given). The database itself tells the column's ends; rows that come
    outside them meanwhile, and nulls, are in the outer ranges, so none is lost. Other tables are read in one piece.
    """
    return {n: _jdbc(spark, url, properties, n, (split_by or {}).get(n), partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))) for n in names}


def _jdbc(spark: SparkSession, url: str, properties: dict, table: str, column: str | None, partitions: int) -> DataFrame:
    if column is None or partitions < 2:
        return spark.read.jdbc(url, table, properties=properties)
    named = next((c for c in spark.read.jdbc(url, table, properties=properties).columns if c.lower() == column.lower()), column)
    quoted = spark.sparkContext._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(url).quoteIdentifier(named)
    low, high = spark.read.jdbc(url, f"(SELECT MIN({quoted}) AS low_end, MAX({quoted}) AS high_end FROM {table}) ends", properties=properties).first()
    if low is None or low == high:
        return spark.read.jdbc(url, table, properties=properties)
    whole = lambda end, up: str(math.ceil(end) if up else math.floor(end)) if isinstance(end, (int, float, Decimal)) else str(end)
    options = {"partitionColumn": column, "lowerBound": whole(low, False), "upperBound": whole(high, True), "numPartitions": str(partitions)}
    return spark.read.format("jdbc").options(**properties, **options).option("url", url).option("dbtable", table).load()


def scan_manifest(spark: SparkSession, path: str) -> DataFrame:
    """path, length, modified, mime, content_hash of every file below ``path``, empty ones too.

    Files are judged by name and length first: those that admit() rejects have no content_hash, and not a byte of them is
    read, however large they are. Spark's file sources pass over empty files, so these come from a listing of their own.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    seen = files.select("path", "length", F.col("modificationTime").alias("modified"), _mime("path").alias("mime"))  # no content: nothing is read
    rejected = seen.where(_reason().isNotNull()).withColumn("content_hash", F.lit(None).cast("string"))
    return manifest(admissible(files)).unionByName(rejected).unionByName(empty_files(spark, path))


def empty_files(spark: SparkSession, path: str) -> DataFrame:
    """Manifest rows of the files without content below ``path``; hidden ones are left out, as Spark does."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    listed = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(where, True)
    found = []
    while listed.hasNext():
        file = listed.next()
        if file.getLen() == 0 and not file.getPath().getName().startswith(("_", ".")):
            found.append((file.getPath().toString(), 0, file.getModificationTime()))
    rows = spark.createDataFrame(found, "path string, length long, ms long")
    return rows.select("path", "length", F.timestamp_millis("ms").alias("modified"), _mime("path").alias("mime"), F.lit(None).cast("string").alias("content_hash"))


def _mime(path: str) -> Column:
    kinds = F.create_map(*[F.lit(x) for kv in MIME.items() for x in kv])
    return F.element_at(kinds, F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1)))


def admissible(files: DataFrame) -> DataFrame:
    """The rows of a binaryFile source that admit() would let in: by length, which the source checks before it opens a
    file, and by name."""
    return files.where((F.col("length") > 0) & (F.col("length") <= MOST_BYTES)).where(_mime("path").isNotNull())


def manifest(files: DataFrame) -> DataFrame:
    """Manifest rows with the digest of the contents, which are read for it."""
    return files.select("path", "length", F.col("modificationTime").alias("modified"), _mime("path").alias("mime"), F.sha2("content", 256).alias("content_hash"))


def _reason() -> Column:
    return F.when(F.col("mime").isNull() | ~F.col("mime").isin(*set(MIME.values())), "unsupported type").when(F.col("length") == 0, "empty").when(F.col("length") > MOST_BYTES, "too large")


def admit(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Admitted rows, and rejected ones with their reason (S3)."""
    rows = found.withColumn("reject_reason", _reason())
    return rows.where("reject_reason is null").drop("reject_reason"), rows.where("reject_reason is not null")


def dedup_by_hash(new: DataFrame, existing: DataFrame | None = None, order: str = "document_id") -> DataFrame:
    """``new`` with duplicate_of: the earliest document with the same content, among the existing ones first (S4). A null
    content_hash is like no other. Firsts are found by an aggregation and joined, so no content is gathered in a task."""
    first = new.groupBy("content_hash").agg(F.min(order).alias("first_new"))
    rows = new.join(first, "content_hash", "left")
    if existing is not None:
        known = existing.groupBy("content_hash").agg(F.min(order).alias("known"))
        rows = rows.join(known, "content_hash", "left")
    else:
        rows = rows.withColumn("known", F.lit(None).cast(dict(new.dtypes)[order]))
    original = F.coalesce("known", "first_new")
    return rows.select(*new.columns, "known", "first_new").withColumn("duplicate_of", F.when(original != F.col(order), original)).drop("first_new", "known")


def with_storage_key(rows: DataFrame, suffix: str = "pdf") -> DataFrame:
    """storage_key yyyy/MM/dd/id.ext and the preview key of the first page."""
    key = F.concat_ws("/", F.date_format("created_at", "yyyy/MM/dd"), F.concat(F.col("document_id").cast("string"), F.lit(f".{suffix}")))
    return rows.withColumns({"storage_key": key, "preview_key": F.concat(F.col("document_id").cast("string"), F.lit("/page-1"))})
