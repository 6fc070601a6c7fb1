"""Deep pages against a plain offset, and registers read from databases in ranges."""

import pytest
from pyspark.sql import functions as F

from parcelworks.operators import register
from parcelworks.operators.pages import Pages
from parcelworks.plans import catalogue
from parcelworks.sources import ingest

DATA = "/root/testdata/sf0.001"


def test_pages_equal_an_offset(spark, tmp_path):
    routed = catalogue._register(spark, DATA)[4].select("khata_id", "final_score", "approval_status", "created_at", "village_code")
    order = register.queue_order("confidence", "pending")
    pages = Pages.build(register.by_review_state(routed, "pending"), order, str(tmp_path / "queue"), ranges=7)
    want = [r.khata_id for r in register.by_review_state(routed, "pending").orderBy(*order).collect()]
    assert len(pages) == len(want) > 200
    for n in (1, 2, 5, len(want) // 20, len(want) // 20 + 1, len(want) // 20 + 2, 10_000):
        found = pages.page(n)
        assert [r.khata_id for r in found.collect()] == want[20 * (n - 1) : 20 * n]
    deep = pages.page(len(want) // 20 - 1)
    assert "PartitionFilters: [isnotnull(range_" in deep._jdf.queryExecution().executedPlan().toString()
    assert [r.khata_id for r in pages.page(3, size=7).collect()] == want[14:21]


def test_pages_of_ties_repeats_and_none(spark, tmp_path):
    rows = spark.createDataFrame([(None if n % 11 == 0 else n % 3, n // 2) for n in range(100)], "score int, id int")
    pages = Pages.build(rows, [F.col("score")], str(tmp_path / "a"), ranges=5)
    whole = [tuple(r) for n in range(1, 12) for r in pages.page(n, 10).collect()]
    assert sorted(whole, key=str) == sorted(map(tuple, rows.collect()), key=str) and [s for s, _ in whole] == sorted((s for s, _ in whole), key=lambda s: (s is not None, s or 0))
    none = Pages.build(rows.limit(0), [F.col("score")], str(tmp_path / "b"))
    assert len(none) == 0 and none.page(1).collect() == [] and none.page(1).columns == ["score", "id"]


@pytest.mark.parametrize("kind", ["long", "timestamp", "double"])
def test_databases_are_read_in_ranges(spark, tmp_path, kind):
    url, driver = f"jdbc:derby:{tmp_path}/db", {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    n = F.when(F.col("id") % 50 != 7, F.col("id") * 3 - 100)
    key = {"long": n, "timestamp": F.timestamp_seconds(n * 1000 + 1_700_000_000), "double": n / 7}[kind]
    rows = spark.range(400).select(F.col("id").alias("nr"), key.alias("k"))
    rows.repartition(1).write.jdbc(f"{url};create=true", "khata_records", properties=driver)
    rows.limit(0).write.jdbc(url, "villages", properties=driver)
    found = ingest.load_register_jdbc(spark, url, driver, ("khata_records", "villages"), {"khata_records": "k", "villages": "k"}, 5)
    table = found["khata_records"]
    assert table.rdd.getNumPartitions() == 5 and found["villages"].count() == 0
    assert sorted(map(str, table.collect())) == sorted(map(str, rows.select(F.col("nr").alias("nr"), "k").collect()))
    sizes = [r.n for r in table.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert len(sizes) == 5 and max(sizes) < 200
    assert ingest.load_register_jdbc(spark, url, driver, ("khata_records",))["khata_records"].rdd.getNumPartitions() == 1
