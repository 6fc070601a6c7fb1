"""Vector bin packing of tokenised documents into sequences."""

from __future__ import annotations

import json
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema

from parcelworks.llm.common import tune

#: Characters of a stretch that is remembered at most: with the number of stretches this bounds a task's memory.
LONGEST = 64
#: Examples weighed against each other for a sequence; what is left of them goes on to the next batch.
POOL = 512


class Tokenizer:
    """Ids of a byte-level BPE tokenizers file as little-endian unsigned 32-bit integers.

    A text without runs of white space is cut at single spaces and line ends, where the tokenizer always cuts too, and
    each stretch is encoded once and remembered; other texts are encoded whole. A file whose ids follow its merges gives
    the ranks of tiktoken's faster merging; any other file, and texts that spell a special token, go to tokenizers.
    """

    def __init__(self, path: str, most: int = 300_000):
        from tokenizers import Tokenizer as Library

        self.library, self.most = Library.from_file(path), most
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.seen: dict[str, bytes] = {}
        with open(path, encoding="utf-8") as file:
            self.fast = _ranked(json.load(file), self.special)
        self.line = self._ids("\n")

    def _ids(self, text: str) -> bytes:
        ids = self.fast.encode_ordinary(text) if self.fast else self.library.encode(text, add_special_tokens=False).ids
        return array("I", ids).tobytes()

    def ids(self, text: str) -> bytes:
        if not text:
            return b""
        if any(s in text for s in self.special):
            return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()
        words = text.split()
        if not text.count(" ") + text.count("\n") == len(words) - 1 == len(text) - sum(map(len, words)):
            return self._ids(text)
        return self.line.join([self._line(x) for x in text.split("\n")])

    def _line(self, line: str) -> bytes:
        parts = line.replace(" ", "\0 ").split("\0") if "\0" not in line else [line]
        try:
            return b"".join(map(self.seen.__getitem__, parts))
        except KeyError:
            if len(self.seen) > self.most:
                self.seen = {}
            for x in parts:
                if x not in self.seen:
                    self.seen[x] = self._ids(x)
            out = b"".join(map(self.seen.__getitem__, parts))
            for x in parts:
                if len(x) > LONGEST:
                    self.seen.pop(x, None)
            return out


def _ranked(file: dict, special: list[str]):
    """A tiktoken encoding of the same vocabulary, if the file is byte-level BPE with ids in the order of its merges."""
    import tiktoken

    model, pre = file["model"], file.get("pre_tokenizer") or {}
    merges = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model.get("merges", [])]
    ids = [model["vocab"][m] for m in merges]
    plain = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not file.get("normalizer")
    if model.get("type") != "BPE" or not plain or model.get("dropout") or model.get("ignore_merges") or ids != sorted(set(ids)):
        return None
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(printable))}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
    pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""  # fixed: what ByteLevel cuts by
    return tiktoken.Encoding("ranked", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


class Packer:
    """Fills one sequence after another from a pool of examples.

    An example demands tokens, one segment and loss-bearing tokens. The next one for a sequence is that whose demand, as
    shares of the limits, has the greatest dot product with what the sequence has left; among those that fit, and if
    none fits, the best one is cut where the first limit is reached. So a sequence ends full, or at its limit of
    segments or loss tokens. Loss tokens of a piece are those it holds; they are taken to lie at an example's end.
    """

    def __init__(self, limits: tuple[int, int, int]):
        self.limits = np.array(limits, np.int64)
        self.keys: list = []
        self.demand = np.empty((0, 3), np.int64)  # tokens, segments (one), loss tokens still to place
        self.start = np.empty(0, np.int64)
        self.sequence, self.left, self.offset = 0, self.limits.copy(), 0

    def add(self, keys: list, tokens: np.ndarray, loss: np.ndarray) -> None:
        self.keys += keys
        self.demand = np.concatenate([self.demand, np.stack([tokens, np.ones_like(tokens), loss], 1)])
        self.start = np.concatenate([self.start, np.zeros(len(keys), np.int64)])

    def _next(self) -> None:
        self.sequence, self.left, self.offset = self.sequence + 1, self.limits.copy(), 0

    def run(self, keep: int) -> Iterator[tuple]:
        """Pieces (key, start, length, sequence, offset) until at most ``keep`` examples are left in the pool."""
        share = 1.0 / self.limits.astype(float) ** 2
        live = np.ones(len(self.keys), bool)
        remaining = len(self.keys)
        while remaining > keep:
            if self.left[0] <= 0 or self.left[1] <= 0:
                self._next()
            whole = (self.demand <= self.left).all(axis=1) & live
            among = whole if whole.any() else live
            score = np.where(among, self.demand @ (share * self.left), -1.0)
            i = int(score.argmax())
            tokens, _, loss = self.demand[i]
            if whole[i]:
                length, used = tokens, loss
            else:  # cut: as many tokens as the room, and the loss tokens at the end only as far as their limit
                length = min(tokens, self.left[0], tokens - loss + self.left[2])
                if length <= 0:
                    self._next()
                    continue
                used = max(0, length - (tokens - loss))
            yield self.keys[i], int(self.start[i]), int(length), self.sequence, self.offset
            self.offset += int(length)
            self.left -= np.array([length, 1, used])
            self.demand[i] -= (length, 0, used)
            self.start[i] += length
            if self.demand[i, 0] == 0:
                live[i] = False
                remaining -= 1
        self.keys = [k for k, on in zip(self.keys, live, strict=True) if on]
        self.demand, self.start = self.demand[live], self.start[live]


PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary())])


def pack(docs: DataFrame, tokenizer: str, limit: int = 1024, end_id: int = 0, max_segments: int = 64, max_loss: int | None = None, id_col: str = "doc_id", text_col: str = "text", loss_from: str | None = None, with_ids: bool = False, carried: tuple[str, ...] = ()) -> DataFrame:
    """Tokenise ``docs`` and pack them into sequences of at most ``limit`` tokens.

    A document is its ids and ``end_id``; a null or empty text is ``end_id`` alone, so each row has at least one piece,
    repeated rows included. ``loss_from`` names a column with the number of leading tokens that bear no loss (null:
    none); by default all bear it. A sequence holds at most ``limit`` tokens, ``max_segments`` pieces and ``max_loss``
    loss-bearing tokens (default: ``limit``). Returns a row for each piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset, and with ``with_ids`` the piece's ids as little-endian unsigned 32-bit integers. ``carried`` columns
    of the row stand behind these in each of its pieces.

    Packing needs no shuffle: every task packs its own rows from a bounded pool, and numbers its sequences from the
    partition's number on, so a task that is run again gives the same ones. Only a task's last sequence can be short.
    """
    tune(docs.sparkSession)
    limits = (limit, max_segments, max_loss or limit)
    free = F.coalesce(F.col(loss_from).cast("long"), F.lit(0)) if loss_from else F.lit(0)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), free.cast("long").alias("free"), *[F.col(c).alias(f"carried{i}") for i, c in enumerate(carried)])
    schema = pa.schema([*PIECES, *to_arrow_schema(source.select(*[f"carried{i}" for i in range(len(carried))]).schema)]) if carried else PIECES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Tokenizer(tokenizer)
        base = TaskContext.get().partitionId() << 32
        packer, end = Packer(limits), np.uint32(end_id).tobytes()

        def out(keep: int) -> Iterator[pa.RecordBatch]:
            rows: list[tuple] = []
            for (doc, ids, *more), start, length, sequence, offset in packer.run(keep):
                piece = ids[4 * start : 4 * (start + length)]
                rows.append((doc, start, length, zlib.crc32(piece), len(ids) // 4, base + sequence, offset, piece if with_ids else None, *more))
                if len(rows) == 4096:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        for batch in batches:
            for at in range(0, batch.num_rows, POOL):
                part = batch.slice(at, POOL)
                keys = [(d, made.ids(t or "") + end, *more) for d, t, *more in zip(*(part.column(c).to_pylist() for c in (0, 1, *range(3, part.num_columns))), strict=True)]
                tokens = np.array([len(k[1]) // 4 for k in keys], np.int64)
                packer.add(keys, tokens, np.maximum(tokens - np.maximum(part.column(2).to_numpy(), 0), 0))
                yield from out(32)
        yield from out(0)

    found = source.mapInArrow(run, from_arrow_schema(schema))
    found = found.withColumnsRenamed({f"carried{i}": c for i, c in enumerate(carried)})
    return found if with_ids else found.drop("ids")
