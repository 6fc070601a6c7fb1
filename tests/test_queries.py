"""Every registered query of the register against its SQL in DuckDB, and streams against batches."""

import json
import math

import duckdb
import pytest
from pyspark.sql import functions as F

from parcelworks.operators import ledger, register
from parcelworks.plans import catalogue
from parcelworks.sources import export, ingest
from parcelworks.streaming import jobs

DATA = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents")


@pytest.fixture(scope="module")
def sql():
    made = duckdb.connect()
    for t in TABLES:
        made.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return made


def same(rows):
    text = lambda v: None if v is None or (isinstance(v, float) and math.isnan(v)) else f"{v:.7g}" if isinstance(v, float) else str(v)
    return sorted([tuple(str(text(v)) for v in r) for r in rows])


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_against_sql(spark, sql, name):
    found = catalogue.queries()[name](spark, DATA)
    columns = sorted(found.columns)
    want = sql.execute(catalogue.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert same(tuple(r) for r in found.select(*columns).collect()) == same(tuple(r[i] for i in at) for r in want.fetchall())


def test_suppression_by_definition(spark):
    rows = catalogue.load(spark, DATA, "v_tokens")[0].where("doc_id < 200").collect()
    kept = {(r.doc_id, r.tok) for r in catalogue.queries()["e01_suppress_overlaps"](spark, DATA).where("doc_id < 200").collect()}

    def iou(a, b):
        h, w = min(a.ymax, b.ymax) - max(a.ymin, b.ymin), min(a.xmax, b.xmax) - max(a.xmin, b.xmin)
        both = max(h, 0) * max(w, 0)
        return both / ((a.ymax - a.ymin) * (a.xmax - a.xmin) + (b.ymax - b.ymin) * (b.xmax - b.xmin) - both) if h > 0 and w > 0 else 0

    pages: dict = {}
    for r in sorted(rows, key=lambda r: (-r.confidence, r.tok)):
        mine = pages.setdefault((r.doc_id, r.page), [])
        if all(iou(r, k) <= 0.6 for k in mine):
            mine.append(r)
    assert kept == {(r.doc_id, r.tok) for page in pages.values() for r in page}


def test_ledger_grows_and_shows_a_break(spark):
    rows = spark.createDataFrame([(1, k, f"f{k}", None, str(k), "u", "PATWARI", f"2024-01-0{k} 10:00:00") for k in (1, 2, 3)], "khata_id long, log_id long, field_name string, raw_value string, corrected_value string, modified_by_user_id string, role string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    none = rows.limit(0).withColumns({"prev_hash": F.lit(""), "entry_hash": F.lit("")})
    first = ledger.append(none, rows.where("log_id < 3"))
    whole = first.unionByName(ledger.append(first, rows.where("log_id = 3")))
    assert ledger.verify(whole).first().intact
    forged = whole.withColumn("corrected_value", F.when(F.col("log_id") == 2, F.lit("9")).otherwise(F.col("corrected_value")))
    found = ledger.verify(forged).first()
    assert (found.intact, found.broken_at, found.broken_field) == (False, 2, "f2")


def test_files_and_streams(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for name, content in (("a.pdf", b"one"), ("b.pdf", b"one"), ("c.png", b"two"), ("d.txt", b"no"), ("e.pdf", b"")):
        (folder / name).write_bytes(content)
    ok, bad = ingest.admit(ingest.scan_manifest(spark, str(folder)))
    assert ok.count() == 3 and {r.reject_reason for r in bad.collect()} == {"unsupported type", "empty"}
    listed = spark.createDataFrame([("x", 0, "image/png"), ("y", ingest.MOST_BYTES + 1, "image/png"), ("z", 1, None)], "path string, length long, mime string")
    assert {r.path: r.reject_reason for r in ingest.admit(listed)[1].collect()} == {"x": "empty", "y": "too large", "z": "unsupported type"}
    seen: list = []
    jobs.write_batches(jobs.stream_ingest(spark, str(folder)), lambda batch, n: seen.extend(r.content_hash for r in batch.collect()), str(tmp_path / "c1"), available_now=True).awaitTermination()
    assert len(seen) == len(set(seen)) == 2


def test_route_and_status_streams(spark, tmp_path):
    khata, parcels, owners = catalogue.load(spark, DATA, "v_khata", "v_parcels", "v_owners")
    khata.where("khata_id < 300").write.parquet(str(tmp_path / "khata"))
    source = spark.readStream.schema(khata.schema).parquet(str(tmp_path / "khata"))
    jobs.stream_route(source, parcels, owners, str(tmp_path / "out"), str(tmp_path / "c2"), available_now=True).awaitTermination()
    got = same(spark.read.parquet(str(tmp_path / "out")).select("khata_id", "approval_status", "critical").collect())
    assert got == same(catalogue.queries()["v14_route"](spark, DATA).where("khata_id < 300").select("khata_id", "approval_status", "critical").collect())
    events = spark.read.parquet(f"{DATA}/events.parquet").select(F.col("user_id").alias("document_id"), F.col("event_type").alias("status"), F.col("ts").cast("timestamp").alias("ts"), "event_id")
    events.write.parquet(str(tmp_path / "events"))
    stream = jobs.stream_status(spark.readStream.schema(events.schema).parquet(str(tmp_path / "events")))
    stream.writeStream.outputMode("update").format("memory").queryName("latest").option("checkpointLocation", str(tmp_path / "c3")).trigger(availableNow=True).start().awaitTermination()
    assert same(spark.table("latest").select("document_id", "status").collect()) == same(register.latest_status(events).select("document_id", "status").collect())


def test_dead_letters(spark):
    ok, bad = jobs.dead_letters(spark.createDataFrame([(1, None), (2, "x" * 2000)], "id int, error string"))
    assert [r.id for r in ok.collect()] == [1] and len(bad.first().error) == 1000


def test_register_is_read_from_folders_and_databases(spark, tmp_path):
    villages, owners = catalogue.load(spark, DATA, "v_villages", "v_owners")
    villages.write.parquet(str(tmp_path / "villages"))
    owners.write.parquet(str(tmp_path / "ownership_details"))
    found = ingest.load_register(spark, str(tmp_path), ("villages", "ownership_details"))
    assert same(found["villages"].collect()) == same(villages.collect()) and found["ownership_details"].count() == owners.count()
    url, driver = f"jdbc:derby:{tmp_path}/register", {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    villages.write.jdbc(f"{url};create=true", "villages", properties=driver)
    table = ingest.load_register_jdbc(spark, url, driver, ("villages",))["villages"]
    assert same(table.select(*villages.columns).collect()) == same(villages.collect())
    assert "PushedFilters" in table.where("village_code = 'V3'")._jdf.queryExecution().executedPlan().toString()


def test_exports_are_written(spark, tmp_path):
    rows = catalogue.queries()["s06_csv_export"](spark, DATA)
    assert rows.columns == list(export.CSV_COLUMNS)
    export.export_csv(rows, str(tmp_path / "one"), single_file=True)
    (path,) = (tmp_path / "one").glob("*.csv")
    content = path.read_bytes()
    assert content.startswith("\ufeffstate,district,tehsil,village_code,village_name,khata_number,fasli_year,".encode()) and content.count(b"\n") == rows.count() + 1
    assert b'""' not in content  # nulls are empty
    numbers = [line.split(",")[5] for line in content.decode().splitlines()[1:]]
    assert numbers == sorted(numbers)
    export.export_csv(rows, str(tmp_path / "many"))
    assert spark.read.csv(str(tmp_path / "many"), header=True).count() == rows.count()
    khata, parcels, owners, _, routed = catalogue._reported(spark, DATA)
    features = export.geojson_lines(routed, parcels, owners, catalogue.load(spark, DATA, "v_villages")[0], only_approved=False)
    export.export_geojson(features, str(tmp_path / "geo"))
    first = json.loads(spark.read.text(str(tmp_path / "geo")).first()[0])
    assert first["type"] == "Feature" and list(first["properties"]["owners"][0]) == ["name", "name_en", "relation", "relative", "share_pct"] and len(first["properties"]) == 15
