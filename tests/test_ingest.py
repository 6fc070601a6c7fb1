"""Landing zone: admission before reading, contents seen in earlier runs, dead letters of a stream."""

import os

from pyspark.sql import functions as F

from parcelworks.sources import ingest
from parcelworks.streaming import jobs

TEXTS = "id string, area string, at string, note string"


def put(folder, *files):
    folder.mkdir(parents=True, exist_ok=True)
    for name, content in files:
        (folder / name).write_bytes(content)


def test_rejected_files_are_never_read(spark, tmp_path):
    put(tmp_path / "in", ("a.pdf", b"one"), ("b.PNG", b"two"), ("c.txt", b"no"), ("d.pdf", b""), (".hidden.pdf", b""))
    with open(tmp_path / "in/huge.pdf", "wb") as f:  # 3 GB without content on the disk: Spark could not read it as one value
        f.truncate(3 << 30)
    os.chmod(tmp_path / "in/c.txt", 0o000)
    found = ingest.scan_manifest(spark, str(tmp_path / "in"))
    ok, bad = ingest.admit(found)
    assert sorted((r.path.rsplit("/", 1)[1], r.mime, len(r.content_hash)) for r in ok.collect()) == [("a.pdf", "application/pdf", 64), ("b.PNG", "image/png", 64)]
    assert sorted((r.path.rsplit("/", 1)[1], r.length, r.reject_reason) for r in bad.collect()) == [("c.txt", 2, "unsupported type"), ("d.pdf", 0, "empty"), ("huge.pdf", 3 << 30, "too large")]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert f"LessThanOrEqual(length,{ingest.MOST_BYTES})" in plan and "GreaterThan(length,0)" in plan
    stream = jobs.stream_ingest(spark, str(tmp_path / "in"))
    seen = []
    jobs.write_batches(stream, lambda batch, n: seen.extend(r.path for r in batch.collect()), str(tmp_path / "c"), available_now=True).awaitTermination()
    assert sorted(p.rsplit("/", 1)[1] for p in seen) == ["a.pdf", "b.PNG"]


def test_contents_of_earlier_runs_are_told(spark, tmp_path):
    folder, target = tmp_path / "in", str(tmp_path / "out")
    before = spark.createDataFrame([("doc-9", b"old"), ("doc-7", b"old"), ("x", None)], "document_id string, content binary").select("document_id", F.when(F.col("content").isNotNull(), F.sha2("content", 256)).alias("content_hash"))

    def run():
        jobs.stream_documents(spark, str(folder), target, str(tmp_path / "c"), before, available_now=True).awaitTermination()
        return {r.path.rsplit("/", 1)[1]: r.duplicate_of and r.duplicate_of.rsplit("/", 1)[-1] for r in spark.read.parquet(target).collect()}

    put(folder, ("a.pdf", b"one"), ("b.pdf", b"one"), ("c.pdf", b"two"), ("d.pdf", b"old"), ("e.txt", b"one"))
    for n, name in enumerate("ba"):  # the earlier file is the first, whatever its name
        os.utime(folder / f"{name}.pdf", (1_000_000 + n, 1_000_000 + n))
    first = run()
    assert first == {"a.pdf": "b.pdf", "b.pdf": None, "c.pdf": None, "d.pdf": "doc-7"}
    put(folder, ("f.pdf", b"two"), ("g.pdf", b"three"), ("h.pdf", b"one"))
    second = run()  # a restart: the first run's contents come from the state
    assert second == first | {"f.pdf": "c.pdf", "g.pdf": None, "h.pdf": "b.pdf"}
    for name in ("1", ".1.crc"):
        if os.path.exists(tmp_path / "c/commits" / name):
            os.remove(tmp_path / "c/commits" / name)
    assert run() == second and spark.read.parquet(target).count() == 7  # a batch that comes again changes nothing


def test_dead_letters_land_once(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    rows = [("1", "2.50", "2024-01-01 10:00:00", "fine"), ("2", "wide", "2024-01-01 10:00:00", "area"), ("x", None, "then", "both"), (None, "1", None, "no id"), ("5", "x" * 3000, None, "long")]
    schema = "id long, area decimal(12,4), at timestamp, note string, error string"
    counts = {}

    def run():
        texts = spark.readStream.schema(TEXTS).option("maxFilesPerTrigger", 1).parquet(source)
        sound = jobs.typed(texts, {"id": "long", "area": "decimal(12,4)", "at": "timestamp"}, ("id",))
        jobs.stream_with_dead_letters(sound, target, str(tmp_path / "c"), available_now=True, counted=lambda n, seen: counts.__setitem__(n, (seen["rows"], seen["failed"]))).awaitTermination()
        read = lambda bad: {r.note: r for r in jobs.letters(spark, target, bad, schema).collect()}
        return read(False), read(True)

    spark.createDataFrame(rows, TEXTS).coalesce(1).write.parquet(source)
    good, bad = run()
    assert set(good) == {"fine"} and good["fine"].area == 2.5 and good["fine"].error is None and good["fine"].batch == 0
    assert {n: r.error[:60] for n, r in bad.items() if n != "long"} == {"area": "area is no decimal(12,4): wide", "both": "id is no long: x; at is no timestamp: then", "no id": "id is missing"}
    assert len(bad["long"].error) == 1000 and bad["area"].id == 2 and counts == {0: (5, 4)}
    spark.createDataFrame([("9", "1", None, "later"), ("z", "1", None, "late and bad")], TEXTS).coalesce(1).write.mode("append").parquet(source)
    for name in os.listdir(tmp_path / "c/commits"):  # the first batch comes again, and then a new one
        os.remove(tmp_path / "c/commits" / name)
    good, bad = run()
    assert set(good) == {"fine", "later"} and set(bad) == {"area", "both", "no id", "long", "late and bad"} and counts == {0: (5, 4), 1: (2, 1)}
    assert spark.read.parquet(target).count() == 7
