"""Continuous ingest, routing, progress and dead letters as Structured Streaming jobs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from parcelworks.operators import rules
from parcelworks.sources.ingest import admissible, manifest
from parcelworks.streaming import chain, seen

#: What the ledger reads of a routed holding.
ROUTED = "khata_id long, committable boolean, final_score double, review_reason string, routed_at timestamp, batch long"
FILES = "path string, modificationTime timestamp, length long, content binary"


def stream_ingest(spark: SparkSession, path: str, delay: str = "1 day") -> DataFrame:
    """New files' manifest rows, admitted by name and length before a byte is read, and without repeats of a content within
    the watermark (R1). stream_documents() knows repeats of any age."""
    files = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", "true").load(path)
    return manifest(admissible(files)).withWatermark("modified", delay).dropDuplicatesWithinWatermark(["content_hash"])


def stream_documents(spark: SparkSession, path: str, target: str, checkpoint: str, before: DataFrame | None = None, available_now: bool = False) -> StreamingQuery:
    """New files' manifest rows with duplicate_of, appended once each to the Parquet table ``target``.

    The first file of each content is kept in keyed state, partitioned by the content's digest, for good: a file that comes
    back after any time, in a later run too, is told as a duplicate of the first. ``before`` is a register of documents
    (content_hash, document_id) to begin with. Within a batch the earliest file is the first, then the least path.
    """
    files = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", "true").load(path)
    with chain.settings(spark, chain.STORE):
        writer = seen.told(manifest(admissible(files)), before).writeStream.format("parquet").outputMode("append").option("path", target).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if available_now else writer).start()


def write_batches(stream: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Run ``work`` on each micro-batch; it must be idempotent for a batch id, since a batch can come again."""
    writer = stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def stream_route(headers: DataFrame, parcels: DataFrame, owners: DataFrame, target: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Validate and route each arriving batch of headers against the detail tables, one folder for each batch, and chain a
    ledger row for each holding behind those of earlier batches in ``target``-ledger (R2).

    ``routed_at`` is the batch's own time, which the checkpoint keeps: a batch that comes again replaces itself with equal
    rows. The ledger is stream_route_ledger(), run over what the batch has added: it reads the new rows and the state of
    their holdings, not the ledger.
    """

    def work(batch: DataFrame, number: int) -> None:
        mine = lambda d: d.join(batch.select("khata_id"), "khata_id", "left_semi")
        found = rules.all_findings(batch, mine(parcels), mine(owners))
        rules.route(rules.report(batch, found)).write.mode("overwrite").parquet(f"{target}/batch={number}")
        stream_route_ledger(batch.sparkSession, target, f"{target}-ledger", f"{checkpoint}-ledger", available_now=True).awaitTermination()

    return write_batches(headers.withColumn("routed_at", F.current_timestamp()), work, checkpoint, available_now)


def stream_route_ledger(spark: SparkSession, routed: str, target: str, checkpoint: str, before: DataFrame | None = None, available_now: bool = False) -> StreamingQuery:
    """Chain a ledger row for each holding that stream_route() has routed to the folder ``routed``, into the table ``target``.

    Heads are kept in keyed state (streaming.chain); ``before`` is a ledger to go on from. A batch that has been routed
    again is told by its number and not chained twice.
    """
    rows = spark.readStream.schema(ROUTED).parquet(routed)
    return chain.stream_ledger(rules.route_log(rows, F.col("routed_at"), "batch"), target, checkpoint, before, "batch", available_now)


def stream_status(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Latest status of each document, for update mode."""
    order = F.struct("ts", "event_id")
    return events.withWatermark("ts", delay).groupBy("document_id").agg(F.max_by("status", order).alias("status"), F.max("ts").alias("since"))


def dead_letters(rows: DataFrame, error: str = "error") -> tuple[DataFrame, DataFrame]:
    """Sound rows, and failed ones with a message of at most 1,000 characters."""
    bad = F.col(error).isNotNull()
    return rows.where(~bad).drop(error), rows.where(bad).withColumn(error, F.substring(error, 1, 1000))


def typed(rows: DataFrame, kinds: dict[str, str], required: tuple[str, ...] = ()) -> DataFrame:
    """The text columns of ``kinds`` as these types, and ``error``: null, or which values are no such type or missing.

    No value stops the job: what cannot be read is null in its column and named in ``error``, with the text as it came.
    """
    made = {c: F.try_to_timestamp(c) if kind == "timestamp" else F.col(c).try_cast(kind) for c, kind in kinds.items()}
    wrong = [F.when(F.col(c).isNotNull() & made[c].isNull(), F.concat(F.lit(f"{c} is no {kind}: "), F.col(c))) for c, kind in kinds.items()]
    wrong += [F.when(F.col(c).isNull(), F.lit(f"{c} is missing")) for c in required]
    message = F.concat_ws("; ", *wrong)
    return rows.select(*[made.get(c, F.col(c)).alias(c) for c in rows.columns], F.when(message != "", message).alias("error"))


def stream_with_dead_letters(rows: DataFrame, target: str, checkpoint: str, error: str = "error", available_now: bool = False, counted: Callable[[int, dict], None] | None = None) -> StreamingQuery:
    """Write a stream whose failed rows have an ``error`` to two places under one checkpoint.

    Each batch is one pass: ``target``/failed=false/batch=n gets the sound rows and failed=true the others, with messages
    of at most 1,000 characters, so that no row is in both or in neither; a batch that comes again replaces itself. The
    pass counts as it writes: ``counted`` gets the batch's number and {rows, failed}, after the batch is written.
    letters() reads either place.
    """

    def work(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        watch = Observation()
        bad = F.col(error).isNotNull()
        both = batch.withColumns({error: F.substring(error, 1, 1000), "failed": bad, "batch": F.lit(number).cast("long")})
        both = both.observe(watch, F.count(F.lit(1)).alias("rows"), F.count_if("failed").alias("failed"))
        with chain.settings(spark, {"spark.sql.sources.partitionOverwriteMode": "static"}):
            for part in ("false", "true"):  # what an attempt before has left of this batch
                old = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{target}/failed={part}/batch={number}")
                old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)
            both.write.mode("append").partitionBy("failed", "batch").parquet(target)
        if counted:
            counted(number, watch.get)

    return write_batches(rows, work, checkpoint, available_now)


def letters(spark: SparkSession, target: str, failed: bool, schema: str) -> DataFrame:
    """The sound or the failed rows that stream_with_dead_letters() has written; ``schema`` is that of the stream's rows."""
    return spark.read.schema(f"{schema}, failed boolean, batch long").parquet(target).where(F.col("failed") == failed).drop("failed")
