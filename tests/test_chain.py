"""The ledger as a keyed stream: restarts, replays, a ledger to go on from, sources that deliver twice."""

import os
import random

import pytest
from pyspark.sql import functions as F

from parcelworks.operators import ledger
from parcelworks.plans import catalogue
from parcelworks.streaming import chain, jobs

SCHEMA = "khata_id long, field_name string, raw_value string, corrected_value string, modified_by_user_id string, role string, ts timestamp, reason string"
DATA = "/root/testdata/sf0.001"


def entries(spark, day, rows):
    made = spark.createDataFrame([(k, f, None, v, "u", "PATWARI", None, None) for k, f, v in rows], SCHEMA)
    return made.withColumn("ts", F.lit(f"2024-01-{day:02d} 10:00:00").cast("timestamp")).coalesce(1)


def run(spark, folder, **more):
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    query = chain.stream_ledger(source, f"{folder}/out", f"{folder}/state", available_now=True, **more)
    query.awaitTermination()
    return query


def rows_of(df):
    return sorted((r.khata_id, r.log_id, r.field_name, r.prev_hash, r.entry_hash) for r in df.collect())


def test_chain_over_restarts_equals_one_append(spark, tmp_path):
    rng, days = random.Random(2), {}
    for day in (1, 2, 3):
        days[day] = [(k, f"f{day}.{j}", str(j)) for k in range(6) if rng.random() < 0.7 or k == 4 for j in range(rng.randint(1, 4))]
    days[2].append((None, "lost", "1"))  # of no holding: in no chain
    days[3] += [(4, "same", "x"), (4, "same", "x")]  # two equal entries are two
    entries(spark, 1, days[1]).write.parquet(f"{tmp_path}/in")
    run(spark, tmp_path)
    for day in (2, 3):  # each run is a restart: the heads come from the state, not from the table
        entries(spark, day, days[day]).write.mode("append").parquet(f"{tmp_path}/in")
        query = run(spark, tmp_path)
        assert [p.numInputRows for p in query.recentProgress if p.numInputRows] == [len(days[day])]
        assert [s.description for s in query.lastProgress.sources] == [f"FileStreamSource[file:{tmp_path}/in]"]
    out = spark.read.parquet(f"{tmp_path}/out")
    none = out.limit(0)
    new = spark.read.schema(SCHEMA).parquet(f"{tmp_path}/in").where("khata_id is not null")
    want = ledger.append(none, ledger.numbered(none, new, "ts", "field_name", "corrected_value"))
    assert rows_of(out) == rows_of(want)
    assert ledger.verify(out).where("not intact").count() == 0 and out.columns[:8] == [c.split()[0] for c in SCHEMA.split(", ")]


def test_a_batch_that_was_cut_off_gives_equal_hashes(spark, tmp_path):
    entries(spark, 1, [(k, "a", "1") for k in range(4)]).write.parquet(f"{tmp_path}/in")
    run(spark, tmp_path)
    entries(spark, 2, [(k, "b", "2") for k in range(2, 6)]).write.mode("append").parquet(f"{tmp_path}/in")
    run(spark, tmp_path)
    before = rows_of(spark.read.parquet(f"{tmp_path}/out"))
    for name in ("1", ".1.crc"):  # as if the driver had died before the second batch was told to be done
        if os.path.exists(f"{tmp_path}/state/commits/{name}"):
            os.remove(f"{tmp_path}/state/commits/{name}")
    run(spark, tmp_path)
    assert rows_of(spark.read.parquet(f"{tmp_path}/out")) == before


def test_chain_goes_on_from_a_ledger(spark, tmp_path):
    none = spark.createDataFrame([], SCHEMA).withColumns({"log_id": F.lit(0).cast("long"), "prev_hash": F.lit(""), "entry_hash": F.lit("")})
    old = entries(spark, 1, [(k, f, "1") for k in (1, 2) for f in ("a", "b")])
    so_far = ledger.append(none, ledger.numbered(none, old, "field_name"))
    entries(spark, 5, [(k, "c", "2") for k in (2, 3)]).write.parquet(f"{tmp_path}/in")
    run(spark, tmp_path, before=so_far)
    both = so_far.unionByName(spark.read.parquet(f"{tmp_path}/out"))
    found = {r.khata_id: (r.entries_checked, r.intact) for r in ledger.verify(both).collect()}
    assert found == {1: (2, True), 2: (3, True), 3: (1, True)}
    assert {(r.khata_id, r.log_id) for r in spark.read.parquet(f"{tmp_path}/out").collect()} == {(2, 3), (3, 1)}


def test_numbered_source_that_delivers_twice(spark, tmp_path):
    columns = SCHEMA + ", batch long"

    def put(batch, day, rows):
        entries(spark, day, rows).withColumn("batch", F.lit(batch).cast("long")).write.mode("append").parquet(f"{tmp_path}/in")

    def go():
        source = spark.readStream.schema(columns).parquet(f"{tmp_path}/in")
        chain.stream_ledger(source, f"{tmp_path}/out", f"{tmp_path}/state", sequence="batch", available_now=True).awaitTermination()
        return {(r.khata_id, r.log_id, r.field_name) for r in spark.read.parquet(f"{tmp_path}/out").collect()}

    put(0, 1, [(1, "a", "1"), (2, "a", "1")])
    put(0, 1, [(1, "a", "1")])  # twice before it is read
    assert go() == {(1, 1, "a"), (2, 1, "a")}
    put(0, 1, [(1, "a", "1"), (2, "a", "1")])  # and again afterwards
    put(1, 2, [(1, "b", "1")])
    assert go() == {(1, 1, "a"), (2, 1, "a"), (1, 2, "b")}


def test_routed_batches_are_chained_once(spark, tmp_path):
    khata, parcels, owners = catalogue.load(spark, DATA, "v_khata", "v_parcels", "v_owners")

    def route():
        source = spark.readStream.schema(khata.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/khata")
        jobs.stream_route(source, parcels, owners, f"{tmp_path}/routed", f"{tmp_path}/c1", available_now=True).awaitTermination()
        jobs.stream_route_ledger(spark, f"{tmp_path}/routed", f"{tmp_path}/ledger", f"{tmp_path}/c2", available_now=True).awaitTermination()
        return spark.read.parquet(f"{tmp_path}/ledger")

    khata.where("khata_id < 100").coalesce(1).write.parquet(f"{tmp_path}/khata")
    first = rows_of(route())
    for name in os.listdir(f"{tmp_path}/c1/commits"):  # the batch is routed again: other files, equal rows
        os.remove(f"{tmp_path}/c1/commits/{name}")
    khata.where("khata_id between 90 and 120").coalesce(1).write.mode("append").parquet(f"{tmp_path}/khata")
    log = route()
    assert len(first) == khata.where("khata_id < 100").count() and set(first) < set(rows_of(log))
    assert log.count() == len(first) + khata.where("khata_id between 90 and 120").count()
    assert ledger.verify(log).where("not intact").count() == 0
    want = {(r.khata_id, r.reason) for r in catalogue.queries()["v14_k01_route_ledger"](spark, DATA).where("khata_id <= 120").collect()}
    assert {(r.khata_id, r.reason) for r in log.collect()} == want


def test_settings_are_put_back(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    with pytest.raises(ValueError), chain.settings(spark, chain.STORE | {"spark.parcelworks.test": "1"}):
        assert spark.conf.get("spark.parcelworks.test") == "1"
        raise ValueError
    assert spark.conf.get(name, None) == before and spark.conf.get("spark.parcelworks.test", None) is None


def test_proof_finds_edits_losses_and_orders(spark):
    none = spark.createDataFrame([], SCHEMA).withColumns({"log_id": F.lit(0).cast("long"), "prev_hash": F.lit(""), "entry_hash": F.lit("")})
    rows = [(k, f, "1") for k in range(8) for f in "abc"]
    chain_ = ledger.append(none, ledger.numbered(none, entries(spark, 1, rows), "field_name"))
    proof = ledger.proof(chain_)
    assert proof.schema.simpleString() == spark.createDataFrame([], ledger.PROOF).schema.simpleString()
    two = F.col("log_id") == 2
    moved = chain_.withColumn("log_id", F.when((F.col("khata_id") == 3) & (F.col("log_id") < 3), 3 - F.col("log_id")).otherwise(F.col("log_id")))  # two entries change places
    after = moved.where(~((F.col("khata_id") == 2) & two)).withColumn("raw_value", F.when((F.col("khata_id") == 1) & two, "x").otherwise(F.col("raw_value")))
    after = after.where("khata_id <> 4").union(after.where("khata_id = 5 and log_id = 3"))  # a lost chain, a repeated row
    more = ledger.append(chain_, ledger.numbered(chain_, entries(spark, 2, [(6, "d", "2"), (9, "a", "2")]), "field_name"))
    found = {r.khata_id: (r.state, r.entries, r.intact) for r in ledger.verify_since(after.unionByName(more), proof).collect()}
    assert found == {0: ("same", 3, None), 1: ("altered", 3, False), 2: ("altered", 2, False), 3: ("altered", 3, False), 4: ("lost", 0, None), 5: ("grown", 4, False), 6: ("grown", 4, True), 7: ("same", 3, None), 9: ("new", 1, True)}
    assert {r.state for r in ledger.verify_since(chain_, proof).collect()} == {"same"}
    assert ledger.verify_since(chain_.limit(0), proof.limit(0)).count() == 0
