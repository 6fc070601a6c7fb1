"""The ledger as a keyed stream: the state store holds the head of each holding's chain, so a batch costs what is new in it."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from parcelworks.operators import ledger

STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
HEAD = "log_id long, entry_hash string, sequence long"


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """The settings hold inside only; a query that starts inside keeps them."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


class Chain(StatefulProcessor):
    """Hashes the new entries of a holding behind its head, which is all that the state holds of it: one row for each key.

    Rows of a key come in any order; those of one batch are put in order here, which the size of a batch bounds
    (maxFilesPerTrigger or maxBytesPerTrigger of the source).
    """

    def __init__(self, columns: list[str]):
        self.columns = columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.head = handle.getValueState("head", HEAD)

    def handleInitialState(self, key, initialState, timerValues) -> None:  # noqa: N802, N803
        self.head.update((initialState["log_id"], initialState["entry_hash"], -1))

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        log_id, prev, last = self.head.get() if self.head.exists() else (0, ledger.GENESIS, -1)
        seen, now = set(), last
        for row in sorted(rows, key=lambda r: (r["sequence_"], r["ts"], r["entry_"])):
            if row["sequence_"] >= 0:  # of a numbered source: what has been chained before is passed over
                if row["sequence_"] <= last or (row["sequence_"], row["entry_"]) in seen:
                    continue
                seen.add((row["sequence_"], row["entry_"]))
                now = row["sequence_"]
            log_id += 1
            made = hashlib.sha256(row["entry_"].replace(f'"prev":"{ledger.OPEN}"', f'"prev":"{prev}"', 1).encode()).hexdigest()
            yield Row(**{c: row[c] for c in self.columns}, log_id=log_id, prev_hash=prev, entry_hash=made)
            prev = made
        self.head.update((log_id, prev, now))

    def close(self) -> None:
        pass


def chained(entries: DataFrame, before: DataFrame | None = None, sequence: str | None = None) -> DataFrame:
    """The streamed entries with log_id, prev_hash and entry_hash, each behind its holding's latest (K1).

    ``entries`` has the columns of ledger.ENTRY and maybe others, which are kept; rows with a null khata_id are left out,
    since they belong to no chain. ``before`` is the ledger so far, whose heads the chains go on from; it is read once,
    when the stream first starts. ``sequence`` names a column of numbers that ascend with the batches of the source: a
    batch that the source delivers again is told by its number and chained once. Start the query inside
    settings(spark, STORE).
    """
    text = ledger.iso_timestamp(F.col("ts").cast("timestamp"))
    entry = ledger.canonical(*[text if c == "ts" else F.col(c) for c in ledger.ENTRY], F.lit(ledger.OPEN))
    kept = [c for c in entries.columns if c != sequence]
    number = F.col(sequence).cast("long") if sequence else F.lit(-1).cast("long")
    rows = entries.where("khata_id is not null").select(*kept, number.alias("sequence_"), entry.alias("entry_"))
    made = T.StructType([*[entries.schema[c] for c in kept], T.StructField("log_id", T.LongType()), T.StructField("prev_hash", T.StringType()), T.StructField("entry_hash", T.StringType())])
    initial = None
    if before is not None:
        initial = before.groupBy("khata_id").agg(F.max("log_id").alias("log_id"), F.max_by("entry_hash", F.struct("ts", "log_id")).alias("entry_hash")).groupBy("khata_id")
    return rows.groupBy("khata_id").transformWithState(Chain(kept), made, "Append", "None", initial)


def stream_ledger(entries: DataFrame, target: str, checkpoint: str, before: DataFrame | None = None, sequence: str | None = None, available_now: bool = False) -> StreamingQuery:
    """Chain the streamed entries and append them to the Parquet table ``target``, each once.

    Neither the ledger nor its heads are read again: a batch reads its new rows and the state of their keys, however long
    the ledger has grown. State and output of a batch are committed together with its number, so that a batch that is
    cut off runs again from the heads it began with and gives the same hashes.
    """
    with settings(entries.sparkSession, STORE):
        writer = chained(entries, before, sequence).writeStream.format("parquet").outputMode("append").option("path", target).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if available_now else writer).start()
