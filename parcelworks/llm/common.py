"""Helpers that several operators share."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch; texts may be long, so it is far below Spark's 10,000.
ARROW_ROWS = 1000


def tune(spark: SparkSession) -> None:
    """Keep Arrow batches of long texts small enough for a Python worker, and no shuffle files beyond the job they serve."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir, or in tests a temporary one."""
    folder = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder


def save(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: cuts the lineage and survives lost executors.

    The table is removed by drop(), or when the driver's interpreter ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/parcelworks-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    atexit.register(_drop, spark, path)
    made = spark.read.schema(df.schema).parquet(path)
    made._saved_at = path
    return made


def drop(saved: DataFrame) -> None:
    """Remove a table that save() has written and that nothing reads any more."""
    _drop(saved.sparkSession, saved._saved_at)


def _drop(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session is gone; the folder's owner clears it
        return


def light(saved: DataFrame, megabytes: int) -> bool:
    """Whether the files of a table that save() has written are that small together, so that it may be broadcast."""
    spark = saved.sparkSession
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(saved._saved_at)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(where).getLength() <= megabytes << 20


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % modulus


class Hashes(dict):
    """Word (bytes) -> its 64-bit hash as 8 bytes. Emptied by trim() before it grows large."""

    def __missing__(self, word: bytes) -> bytes:
        made = self[word] = xxhash.xxh3_64_intdigest(word).to_bytes(8, "little")
        return made

    def trim(self, most: int = 400_000) -> None:
        if len(self) > most:
            self.clear()

    def array(self, words: list) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.__getitem__, words)), np.uint64)


def words_of(text: str | None) -> list[bytes]:
    """Words of the text with A-Z lowered, split at code points 9-13 and 32 and nowhere else."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, element by element."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``k`` words; of the whole sequence when it is shorter; none of none."""
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    k = min(k, n)
    out = np.full(n - k + 1, k, np.uint64)
    for j in range(k):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + words[j : n - k + 1 + j])
    return np.unique(out)


def lists(values: np.ndarray, lengths: list[int], kind=None) -> pa.ListArray:
    """An Arrow list column from its flat values and the length of each row."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32), pa.int32()), pa.array(values, kind))


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets of an Arrow list column without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = column.offsets.to_numpy()
    return column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]], offsets - offsets[0]


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Connected components of ``edges`` (a, b: long) as (node, root), root the least node.

    Alternates the large-star and the small-star step until the edges stand still; the number of rounds grows with
    the logarithm of the longest chain. Each round is a saved table. The least neighbour of each node is found by an
    aggregation that combines before it shuffles, and saved, so that the join which tells the neighbours has plain tables
    on both sides: Spark deals the edges of a node with many neighbours to several tasks there.
    """
    now = save(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    seen = None
    while True:
        both = now.union(now.select("b", "a"))
        least = save(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
        large = save(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "large")
        drop(least)
        drop(now)
        least = save(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a").alias("a"), F.col("m").alias("b")))).alias("e"))
        now = save(small.select("e.*").where("a <> b").distinct(), name)
        drop(least)
        drop(large)
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if state == seen:
            break
        seen = state
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b"), F.col("b")).distinct())
