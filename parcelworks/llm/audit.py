"""Filter interaction audit: a sparse document-term matrix decides word filters, and all orders of the filters are compared."""

from __future__ import annotations

import hashlib
import itertools
import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from parcelworks.llm.common import save, tune

#: Words of a shard of the matrix: what one row of the table of shards holds at most, but for a single longer document.
SHARD_WORDS = 1_500_000
#: Groups of words that are numbered apart from each other.
BUCKETS = 1 << 14
#: Thresholds of the filters: least words, least distinct words in 100, most capitals in 100 code points, characters.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, SYMBOLS = 100, 80, 10, "#$%&*|"
LETTERS = "ABCDE"


class _Ids(dict):
    """Word -> its number, in the order of first sight."""

    def __missing__(self, word: bytes) -> int:
        made = self[word] = len(self)
        return made


class _Shard:
    """Rows of word counts in compressed sparse form, over a dictionary of its own. A row's numbers ascend, and are kept as
    the steps from one to the next."""

    def __init__(self):
        self.ids = _Ids()
        self.rows, self.made, self.found, self.words = [], [], [], 0

    def add(self, row: pa.Array, made: tuple, words: list[bytes]) -> None:
        self.rows.append(row)
        self.made.append(made)
        self.found.append(np.fromiter(map(self.ids.__getitem__, words), np.int32, len(words)))
        self.words += len(words)

    def batch(self, number: int, names: list[str], more: list[pa.Field]) -> pa.RecordBatch:
        whole = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
        lengths = np.array([len(f) for f in self.found])
        cells, counts = np.unique((np.repeat(np.arange(len(lengths)), lengths) << 32) | np.concatenate(self.found), return_counts=True)
        starts = np.searchsorted(cells, np.arange(len(lengths) + 1) << 32)
        local = (cells & 0xFFFFFFFF).astype(np.int32)
        steps = np.diff(local, prepend=np.int32(0))
        firsts = starts[:-1][np.diff(starts) > 0]
        steps[firsts] = local[firsts]
        rows = pa.concat_arrays(self.rows)
        rows = pa.StructArray.from_arrays([*rows.flatten(), *[pa.array([m[i] for m in self.made], f.type) for i, f in enumerate(more)]], names=[*names, *[f.name for f in more]])
        columns = [pa.array([number], pa.int64()), whole(pa.array(list(self.ids), pa.binary())), whole(rows), whole(pa.array(starts, pa.int32())), pa.array([_pack(steps)], pa.binary()), pa.array([_pack(counts)], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=["shard", "words", "rows", "starts", "steps", "counts"])


def _pack(values: np.ndarray) -> bytes:
    """Ints as their four planes of bytes, of which the upper ones are nearly all zero, compressed; the number of ints before them."""
    planes = np.ascontiguousarray(values.astype("<i4").view(np.uint8).reshape(-1, 4).T)
    return len(values).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(planes.tobytes(), asbytes=True)


def _unpack(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    planes = np.frombuffer(pa.Codec("zstd").decompress(data[8:], 4 * n, asbytes=True), np.uint8) if n else np.empty(0, np.uint8)
    return np.ascontiguousarray(planes.reshape(4, n).T).view("<i4").ravel()


def _sharded(note: Callable[[bytes], tuple], more: list[pa.Field]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, shard, names = TaskContext.get().partitionId() << 32, _Shard(), []
        for batch in batches:
            names = batch.schema.names[1:]
            rows = pa.StructArray.from_arrays(batch.columns[1:], names=names)
            for i, text in enumerate(batch.column(0).to_pylist()):
                words = text.split() if text else []  # bytes: at 9-13 and 32 and nowhere else
                if shard.rows and shard.words + len(words) > SHARD_WORDS:
                    yield shard.batch(number, names, more)
                    number, shard = number + 1, _Shard()
                shard.add(rows.slice(i, 1), note(text or b""), words)
        if shard.rows:
            yield shard.batch(number, names, more)

    return run


def document_terms(docs: DataFrame, text_col: str = "text", note: Callable[[bytes], tuple] = lambda text: (), notes: str = "", each: Callable[[pa.Table], pa.Table] | None = None, made: Callable[[T.StructType], T.StructType] | None = None) -> tuple[DataFrame, DataFrame]:
    """The document-term matrix of ``docs``: shards in compressed sparse row form, and the dictionary.

    Words are maximal runs of `[^\\x20\\x09-\\x0D]`, case kept; a null text has none and is an empty row. Shards are
    (shard, rows, starts, indices, counts): document ``rows[i]``, a struct of the columns of ``docs`` but its text and of
    what ``note`` says of the text's bytes (``notes`` names its values and their types), has the
    words ``indices[starts[i] : starts[i + 1]]`` (little-endian longs, each once) as often as ``counts`` says there
    (little-endian ints). The dictionary is (word binary, word_id long): ids are unique, and the same in every
    run: a bucket, told by the word's hash, 40 bits up, and the rank among the words there.

    Tasks count with dictionaries of their own, so that a word is shuffled once for each shard and not once for each
    document: the words of all shards are sorted into buckets and numbered there, and each shard gets its words' ids back.
    A word that is in every text weighs no more than the number of shards; what a shard holds is bounded.

    With ``each``, a function of a shard, what that returns stands in the shards' place, without the shard being moved
    again; ``made`` tells its schema from that of the structs in ``rows``.
    """
    tune(docs.sparkSession)
    others = docs.drop(text_col)
    noted = T.StructType.fromDDL(notes) if notes else T.StructType([])
    rows = T.StructType([*[T.StructField(f.name, f.dataType, True) for f in others.schema], *noted])
    matrix = lambda indices, *more: T.StructType([T.StructField("shard", T.LongType()), *more, T.StructField("rows", T.ArrayType(rows)), T.StructField("starts", T.ArrayType(T.IntegerType())), T.StructField(indices, T.BinaryType()), T.StructField("counts", T.BinaryType())])
    texts = docs.select(F.col(text_col).cast("binary").alias("the text"), *others.columns)
    local = save(texts.mapInArrow(_sharded(note, list(to_arrow_schema(noted))), matrix("steps", T.StructField("words", T.ArrayType(T.BinaryType())))), "shards")
    words = local.select("shard", F.posexplode("words").alias("at", "word")).withColumn("bucket", F.pmod(F.xxhash64("word"), F.lit(BUCKETS)).cast("int"))
    rank = F.dense_rank().over(Window.partitionBy("bucket").orderBy("word")) - 1
    numbered = words.select("shard", "at", "word", (F.shiftleft(F.col("bucket").cast("long"), 40) + rank).alias("word_id"))
    shards = local.drop("words").groupBy("shard").cogroup(numbered.select("shard", "at", "word_id").groupBy("shard")).applyInArrow(_translated(each), made(rows) if made else matrix("indices"))
    return shards, numbered.select("word", "word_id").distinct()


def _translated(each: Callable[[pa.Table], pa.Table] | None) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(shards: pa.Table, told: pa.Table) -> pa.Table:
        """The shard with global word numbers; ``told`` has as many rows as the shard has words."""
        starts = np.array(shards.column("starts")[0].as_py())
        local = np.cumsum(_unpack(shards.column("steps")[0].as_py()), dtype=np.int64)
        local -= np.repeat(np.concatenate([[0], local])[starts[:-1]], np.diff(starts))  # where the row before ended
        ids = np.empty(told.num_rows, "<i8")
        ids[told.column("at").to_numpy()] = told.column("word_id").to_numpy()
        cells = [pa.array([ids[local].tobytes()], pa.binary()), pa.array([_unpack(shards.column("counts")[0].as_py()).tobytes()], pa.binary())]
        made = pa.table([*[shards.column(c) for c in ("shard", "rows", "starts")], *cells], names=["shard", "rows", "starts", "indices", "counts"])
        return each(made) if each else made

    return run


def row_sums(shard: pa.Table) -> pa.Table:
    """Each document's columns, and n_words and n_distinct: the sum and the number of the nonzero entries of its row."""
    rows, starts = shard.column("rows")[0].values, np.array(shard.column("starts")[0].as_py())
    sums = np.concatenate([[0], np.cumsum(np.frombuffer(shard.column("counts")[0].as_buffer(), "<i4"), dtype=np.int64)])
    return pa.table([*rows.flatten(), pa.array(np.diff(sums[starts])), pa.array(np.diff(starts).astype(np.int64))], names=[*[f.name for f in rows.type], "n_words", "n_distinct"])


def summed(rows: T.StructType) -> T.StructType:
    """The schema of what row_sums() makes."""
    return T.StructType([*rows.fields, T.StructField("n_words", T.LongType()), T.StructField("n_distinct", T.LongType())])


#: Bytes that go on a code point, capitals, and the characters that fail D.
_GO_ON, _CAPITALS, _SYMBOLS = bytes(range(0x80, 0xC0)), bytes(range(ord("A"), ord("Z") + 1)), SYMBOLS.encode()


def _noted(text: bytes) -> tuple[bool, bool, bytes]:
    """Whether the text fails C and D, and a digest that equal texts share."""
    without = lambda gone: len(text.translate(None, gone))
    return (len(text) - without(_CAPITALS)) * 100 > without(_GO_ON) * MOST_CAPITALS, without(_SYMBOLS) < len(text), hashlib.sha256(text).digest()


def flagged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(doc_id, part, A, B, C, D, E): which of the five filters each row of ``docs`` fails, whatever the others say.

    A: under LEAST_WORDS words; B: too few distinct words; C: too many capitals; D: holds one of SYMBOLS; E: identical to
    the text of a smaller id, anywhere in the table. A null text is the empty one (it fails A, and E behind another empty
    one), a null part the empty string. A null id is neither smaller nor larger than any; rows that repeat an id and a
    text do not fail E because of each other. Rows are kept as they are, repeated ones too; an empty table gives none.
    """
    rows = docs.select(F.col(text_col).alias("text"), F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"))
    sums, _ = document_terms(rows, "text", _noted, "C boolean, D boolean, copy binary", row_sums, summed)
    flags = save(sums.select("doc_id", "part", (F.col("n_words") < LEAST_WORDS).alias("A"), (F.col("n_distinct") * 100 < F.col("n_words") * LEAST_DISTINCT).alias("B"), "C", "D", "copy"), "flags")
    first = save(flags.groupBy("copy").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("copy", "first"), "first")
    return flags.join(first, "copy", "left").select("doc_id", "part", "A", "B", "C", "D", F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)).alias("E"))


def interactions(rows: DataFrame, flags: str = LETTERS) -> DataFrame:
    """What each filter does at each step of every order of the filters, for each part.

    ``rows`` is (part, good, toxic booleans, and a boolean column for each letter of ``flags``: the filter is failed).
    Rows are counted by part and set of failed filters first; the orders are compared on these counts, of which a part
    has 2^n at most. Returns part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
    shapley; all orders of a part that has rows, zeros included.
    """
    failed = sum((F.col(x).cast("int") * (1 << i) for i, x in enumerate(flags)), F.lit(0)).alias("failed")
    counted = rows.groupBy("part", failed).agg(F.count(F.lit(1)).alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic"))
    steps = [("".join(order), k + 1, sum(1 << flags.index(x) for x in order[:k]), 1 << flags.index(order[k])) for order in itertools.permutations(flags) for k in range(len(flags))]
    listed = F.from_json(F.lit(json.dumps([dict(zip(("filter_order", "step", "earlier", "own"), s, strict=True)) for s in steps])), "array<struct<filter_order:string,step:int,earlier:int,own:int>>")
    every = counted.select("part", "failed", "n", "good", "toxic", F.inline(listed))
    hit = lambda mask: F.col("failed").bitwiseAND(mask) != 0
    fails, gone = hit(F.col("own")), hit(F.col("earlier"))
    total = lambda test, n="n": F.sum(F.when(test, F.col(n)).otherwise(0))
    orders_first = F.lit(len(steps) // len(flags)) / F.bit_count("failed")  # the orders in which a filter is the first of those failed
    return every.groupBy("part", "filter_order", "step").agg(
        total(~gone & ~fails).alias("kept"), total(~gone & fails).alias("removed"), total(gone & fails).alias("redundant"), total(F.col("failed") == F.col("own")).alias("unique_fails"),
        total(~gone & fails, "good").alias("good_lost"), total(~gone & fails, "toxic").alias("toxic_lost"),
        F.sum(F.when(fails, F.col("n") * orders_first.cast("long")).otherwise(0)).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, **columns: str) -> DataFrame:
    """interactions() of the five filters over ``docs``, with the losses that ``labels`` (doc_id, quality, toxic) shows.

    A document is good or toxic if any label row of its id says 1; without a label, or with a null id, neither.
    """
    said = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    said = save(said.where("good or toxic"), "labels")
    rows = flagged(docs, **columns).join(said, "doc_id", "left")
    return interactions(rows.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")}))
