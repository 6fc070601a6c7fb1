"""Contents that have been seen before, in keyed state: the first document of each content, for good."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


class FirstSeen(StatefulProcessor):
    """Tells of each row the first one of its content; the state of a content is the first one's name, one short text.

    Rows of a batch are taken by time and path. A row that is itself the first has no duplicate_of; so has the same path
    when it is delivered again.
    """

    def __init__(self, columns: list[str]):
        self.columns = columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.first = handle.getValueState("first", "name string")

    def handleInitialState(self, key, initialState, timerValues) -> None:  # noqa: N802, N803
        self.first.update((initialState["document_id"],))

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        first = self.first.get()[0] if self.first.exists() else None
        held = list(rows)  # short rows; a batch's size bounds them (maxFilesPerTrigger)
        if first is None:
            first = min(held, key=lambda r: (r["modified"], r["path"]))["path"]
            self.first.update((first,))
        for row in held:
            yield Row(**{c: row[c] for c in self.columns}, duplicate_of=None if row["path"] == first else first)

    def close(self) -> None:
        pass


def told(rows: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """Streamed manifest rows (path, modified, content_hash and others) with duplicate_of.

    ``before`` is (content_hash, document_id): of several documents of a content the least counts. Rows without a
    content_hash are left out; they are like no other. Start the query inside chain.settings(spark, chain.STORE).
    """
    made = T.StructType([*rows.schema.fields, T.StructField("duplicate_of", T.StringType())])
    initial = None
    if before is not None:
        initial = before.where("content_hash is not null").groupBy("content_hash").agg(F.min(F.col("document_id").cast("string")).alias("document_id")).groupBy("content_hash")
    return rows.where("content_hash is not null").groupBy("content_hash").transformWithState(FirstSeen(rows.columns), made, "Append", "None", initial)
