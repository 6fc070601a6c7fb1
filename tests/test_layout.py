"""The bucketed register: plans without exchanges by holding, folders by village, and a layout that follows its files."""

import re
import shutil

import pytest
from pyspark.sql import functions as F

from parcelworks.operators import merge, register, rules
from parcelworks.plans import catalogue, fixtures
from parcelworks.sources import layout
from parcelworks.streaming.chain import settings

DATA = "/root/testdata/sf0.001"
#: All rule queries but two: the ledger's appends, and ids that are minted by the villages' states first.
RULES = [n for n in catalogue.queries() if re.match(r"v\d\d|o01", n) and "ledger" not in n and "ulpin" not in n]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", RULES)
def test_rules_need_no_exchange_by_holding(spark, name):
    with settings(spark, {"spark.sql.autoBroadcastJoinThreshold": "-1"}):  # as where no side is small
        assert "hashpartitioning(khata_id" not in plan(catalogue.queries()[name](spark, DATA))


def test_reports_of_unlaid_tables_are_the_same(spark):
    khata, parcels, owners = catalogue.load(spark, DATA, "v_khata", "v_parcels", "v_owners")
    plain = [d.repartition(3).select(*[F.expr(c) for c in d.columns]) for d in (khata, parcels, owners)]
    rows = lambda k, p, o: sorted(map(str, rules.report(k, rules.all_findings(k, p, o)).select("khata_id", "findings", "critical", "math_failed", "first_critical", "final_score").collect()))
    assert rows(khata, parcels, owners) == rows(*plain)


def test_a_village_is_a_folder(spark):
    khata = catalogue.load(spark, DATA, "v_khata")[0]
    found = register.by_village(khata, "V3")
    assert re.search(r"PartitionFilters: \[[^]]*village_code[^]]*V3", plan(found)) and "village_code" not in re.search(r"PushedFilters: \[[^]]*\]", plan(found))[0]
    assert {r.village_code for r in found.collect()} == {"V3"} and found.count() == khata.where(F.col("village_code") == "V3").count() > 0


def test_layout_follows_its_files(spark, tmp_path):
    folder = str(tmp_path / "sf")
    shutil.copytree(DATA, folder)
    first = fixtures.load(spark, folder, "v_parcels")[0]
    n, made = first.count(), len(fixtures._MADE)
    assert fixtures.load(spark, folder, "v_parcels")[0].count() == n and len(fixtures._MADE) == made  # made once
    half = spark.read.parquet(f"{DATA}/lineitem.parquet").where("l_orderkey % 2 = 0")
    shutil.rmtree(f"{folder}/lineitem.parquet") if (tmp_path / "sf/lineitem.parquet").is_dir() else (tmp_path / "sf/lineitem.parquet").unlink()
    half.write.parquet(f"{folder}/lineitem.parquet")
    assert fixtures.load(spark, folder, "v_parcels")[0].count() == half.count() < n and len(fixtures._MADE) == made + 1


def test_bucketed_tables(spark):
    rows = spark.createDataFrame([(k % 7 if k % 5 else None, k, "a" if k % 2 else None) for k in range(100)], "khata_id long, n int, part string")
    table, name = layout.bucketed(rows, "test", buckets=3, partition="part")
    assert sorted(map(str, table.select(*rows.columns).collect())) == sorted(map(str, rows.collect()))
    other, name2 = layout.bucketed(rows.limit(0), "test", buckets=3)
    with settings(spark, {"spark.sql.autoBroadcastJoinThreshold": "-1"}):
        assert "Exchange" not in plan(table.join(other, "khata_id").groupBy("khata_id").count())
        assert "Exchange" not in plan(table.select("khata_id").union(other.select("khata_id")).groupBy("khata_id").count())
    assert other.count() == 0
    for n in (name, name2):
        layout.drop(spark, n)
        assert not spark.catalog.tableExists(n)


def test_buckets_follow_the_input_alone(spark):
    """with few shuffle partitions a bucket's rows, and what their sorts spill, grew with the input."""
    assert int(spark.conf.get("spark.sql.shuffle.partitions")) < layout.buckets_for(spark, 3 << 30) == (3 << 30) // (8 << 20)


def test_parcels_are_dealt_once(spark, monkeypatch):
    """the numbering of parcels and their files share one shuffle."""
    seen, real = {}, layout.bucketed
    monkeypatch.setattr(layout, "bucketed", lambda rows, name, **how: (seen.setdefault(name, (rows, how["buckets"])), real(rows, name, **how))[1])
    monkeypatch.setattr(fixtures, "_MADE", {})
    with settings(spark, {"spark.sql.shuffle.partitions": "7"}):
        fixtures.load(spark, DATA, "v_parcels")
        rows, buckets = seen["v_parcels"]
        assert plan(rows.repartition(buckets, "khata_id")).count("Exchange hashpartitioning") == 1


def test_a_feature_is_parsed_once(spark):
    """the export's check took each field from the text anew."""
    assert "get_json_object" not in plan(catalogue.queries()["s07_geojson_export"](spark, DATA))


def test_decisions_on_corrected_records_need_no_exchange(spark):
    """full outer joins, and joins by holding and row, dealt laid out details anew."""
    with settings(spark, {"spark.sql.autoBroadcastJoinThreshold": "-1"}):
        assert "Exchange" not in plan(catalogue.queries()["c05_c06_decide_corrected"](spark, DATA))


def test_a_review_reads_its_ledger_and_decisions_once(spark):
    """The ledger so far and the decisions were made anew for each part that reads them."""
    khata, parcels, owners, corrections = catalogue.load(spark, DATA, "v_khata", "v_parcels", "v_owners", "v_parcel_corr")
    counted = spark.sparkContext.accumulator(0)

    def counting(batches):
        for batch in batches:
            counted.add(batch.num_rows)
            yield batch

    log = catalogue._route_ledger(catalogue._reported(spark, DATA)[4])
    audit = log.mapInArrow(counting, log.schema)
    report = merge.verify(khata, parcels, owners, catalogue._all_requests(khata), corrections, catalogue._owner_corr(owners), audit, keep=fixtures.keeper(spark, DATA))[2]
    assert report.count() == khata.count() == counted.value
