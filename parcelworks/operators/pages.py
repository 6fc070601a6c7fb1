"""Deep pages of an ordered table: ranges written once in order, so that a page reads the one or two ranges it lies in."""

from __future__ import annotations

import itertools
from bisect import bisect_right

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Pages:
    """Pages of rows in a total order.

    ``build`` deals the rows into ranges of the order, one folder each, and counts them; page n then lies at a known place
    of a known range. Nothing before it is read or sorted, whichever page it is.
    """

    def __init__(self, rows: DataFrame, order: list[Column], counts: list[int]):
        self.rows, self.order = rows, order
        self.before = [0, *itertools.accumulate(counts)]

    @classmethod
    def build(cls, rows: DataFrame, order: list[Column], path: str, ranges: int | None = None) -> Pages:
        """Write ``rows`` to ``path`` in ``ranges`` ranges (as many as shuffle partitions if not given) and make pages of them.

        Ties of ``order`` are split by all columns, so that pages are the same each time and share no row.
        """
        spark = rows.sparkSession
        whole = [*order, *[F.col(c).asc_nulls_first() for c, kind in rows.dtypes if not kind.startswith("map")]]
        dealt = rows.repartitionByRange(ranges or int(spark.conf.get("spark.sql.shuffle.partitions")), *whole)
        dealt.withColumn("range_", F.spark_partition_id()).write.mode("errorifexists").partitionBy("range_").parquet(path)
        made = spark.read.schema(T.StructType([*rows.schema.fields, T.StructField("range_", T.IntegerType())])).parquet(path)
        counts = {r.range_: r.n for r in made.groupBy("range_").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each range
        return cls(made, whole, [counts.get(i, 0) for i in range(max(counts, default=-1) + 1)])

    def __len__(self) -> int:
        return self.before[-1]

    def page(self, number: int, size: int = 20) -> DataFrame:
        """The rows of a page, in order; pages count from 1. Beyond the last there are none."""
        start = (max(number, 1) - 1) * size
        end = min(start + size, len(self))
        if start >= end:
            return self.rows.drop("range_").limit(0)
        first, last = bisect_right(self.before, start) - 1, bisect_right(self.before, end - 1) - 1
        ranges = self.rows.where(F.col("range_").between(first, last))
        return ranges.orderBy("range_", *self.order).offset(start - self.before[first]).limit(end - start).drop("range_")
