"""SentencePiece BPE encoding from a table of the last token of every prefix, and decoding."""

from __future__ import annotations

import hashlib
import heapq
import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelworks.llm.common import tune

SPACE = "▁"
#: Characters of a unit that is remembered at most, and of all on average: with the number of units this bounds a worker's memory.
LONGEST, MEAN = 64, 12
#: Encoded by the library as well: a model that normalises its input or has no dummy prefix shows in other ids.
PROBE = " a  \ufb01\u2460A\u030a\u3000\t\nx "


class Encoder:
    """Encodes as the sentencepiece library does for a BPE model with byte fallback and no normalisation but the space mark.

    A text falls apart into units where two characters meet that stand side by side in no piece, since no merge reaches
    across: before a space mark, and before the signs that no piece has behind a letter. Of a unit, each prefix has one last token: the match of the automaton that ends there, is the
    encoding of its own text, and is compatible with the last token of what stands before it (merging the two texts as
    one gives just these two). Ids are then recovered from the end backwards. Units are remembered up to a bound: the
    latest, and those used since ``most`` others came.
    """

    def __init__(self, path: str, most: int = 400_000):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        self.begin, self.end, self.unknown = model.bos_id(), model.eos_id(), model.unk_id()
        self.bytes = [-1] * 256
        self.text = [""] * len(ids)  # what each id decodes to; a byte above 127 as a lone surrogate
        self.rank: dict[str, float] = {}
        self.id: dict[str, int] = {}
        for i in ids:
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                b = int(piece[3:5], 16)
                self.bytes[b] = i
                self.text[i] = chr(b) if b < 128 else chr(0xDC00 + b)
            elif model.is_unknown(i):
                self.text[i] = " ⁇ "
            elif not model.is_control(i) and not model.is_unused(i):
                self.rank[piece], self.id[piece], self.text[i] = -model.get_score(i), i, piece
        if any(SPACE in p.lstrip(SPACE) for p in self.id):
            raise ValueError("a piece has a space mark after another character: units would not be independent")
        self.parts = re.compile(_cuts({pair for piece in self.id for pair in zip(piece, piece[1:], strict=False)}))
        self.pairs: dict[tuple[str, str], bool] = {}
        self.automaton = ahocorasick.Automaton()
        self.split: dict[str, tuple[str, str]] = {}  # the last merge of each piece that merging can reach
        self.order: dict[str, int] = {}  # when a piece is merged; characters are there from the start
        place = {r: i for i, r in enumerate(sorted(set(self.rank.values())), 1)}  # equal scores: the leftmost merge first
        for piece in self.id:
            if len(piece) == 1:
                self.order[piece] = 0
            elif self._merge(piece, self.split) == [piece]:
                self.order[piece] = place[self.rank[piece]]
            else:
                continue
            self.automaton.add_word(piece, piece)
        self.automaton.make_automaton()
        self.most, self.seen, self.old, self.held = most, {}, {}, 0
        if self.ids(PROBE) != array("I", model.encode(PROBE, add_bos=True, add_eos=True)).tobytes():
            raise ValueError("the model does not take texts as they are")

    def _merge(self, text: str, split: dict | None = None) -> list[str]:
        """BPE by its definition: the best-ranked pair of neighbours first, of equal ones the leftmost."""
        parts = list(text)
        left, right = list(range(-1, len(parts) - 1)), [*range(1, len(parts)), -1]
        queue: list = []

        def offer(i: int) -> None:
            if i >= 0 and right[i] >= 0 and (rank := self.rank.get(parts[i] + parts[right[i]])) is not None:
                heapq.heappush(queue, (rank, i, parts[i] + parts[right[i]]))

        for i in range(len(parts)):
            offer(i)
        while queue:
            _, i, piece = heapq.heappop(queue)
            j = right[i] if parts[i] else -1
            if j < 0 or parts[i] + parts[j] != piece:
                continue
            if split is not None and piece == text:
                split[text] = (parts[i], parts[j])
            parts[i], parts[j], right[i] = piece, "", right[j]
            if right[j] >= 0:
                left[right[j]] = i
            offer(left[i])
            offer(i)
        return [p for p in parts if p]

    def _compatible(self, a: str, b: str) -> bool:
        if (known := self.pairs.get((a, b))) is None:
            if len(self.pairs) > 500_000:
                self.pairs.clear()
            known = self.pairs[a, b] = self._apart(a, b)
        return known

    def _apart(self, a: str, b: str) -> bool:
        """Whether merging a + b gives a and b: undo their merges, latest first, and look for a merge across that would
        have come before the one undone (a merge within a, being further left, wins over an equal one across; one across
        wins over an equal one within b)."""
        order, split = self.order, self.split
        limit = 1 << 60
        while True:
            if 0 < order.get(a + b, limit) < limit:
                return False
            x, y = order[a], order[b]
            if not x and not y:
                return True
            if x > y:
                limit, a = x, split[a][1]
            else:
                limit, b = y + 1, split[b][0]

    def units(self, units: list[str]) -> list[bytes]:
        """Ids of each unit, found in one pass over all of them joined by a character that is no piece.

        ``last`` is the table of prefixes: the last token of the prefix that ends there, or True where nothing before
        counts (a unit's start, or behind a character that is no piece and is spelled in bytes).
        """
        joined = "\0".join(units)
        last: list = [None] * (len(joined) + 1)
        last[0] = True
        for c in [c for c in set(joined) if c not in self.id]:
            at = joined.find(c)
            while at >= 0:
                last[at + 1] = True
                at = joined.find(c, at + 1)
        compatible = self._compatible
        for at, piece in self.automaton.iter(joined):
            at += 1
            if last[at] is None and (before := last[at - len(piece)]) and (before is True or compatible(before, piece)):
                last[at] = piece
        out: list[bytes] = []
        ids: list[int] = []
        end, within = len(joined), len(units) - 1
        left = len(units[within])
        while True:
            if not left:  # the start of a unit
                ids.reverse()
                out.append(array("I", ids).tobytes())
                if not within:
                    return out[::-1]
                ids, end, within = [], end - 1, within - 1
                left = len(units[within])
                continue
            token = last[end]
            if token is True:
                token = joined[end - 1]
                spelled = [self.bytes[b] for b in token.encode("utf-8", "surrogatepass")]
                ids += [self.unknown] if -1 in spelled else spelled[::-1]
            else:
                ids.append(self.id[token])
            end -= len(token)
            left -= len(token)

    def ids(self, text: str | None) -> bytes:
        """Begin id, the text's ids and end id, as little-endian unsigned 32-bit integers."""
        head, tail = array("I", [self.begin]).tobytes(), array("I", [self.end]).tobytes()
        if not text:
            return head + tail
        units = self.parts.findall(SPACE + text.replace(" ", SPACE))  # the last is empty
        found = list(map(self.seen.get, units[:-1]))
        if None in found:
            if len(self.seen) > self.most or self.held > MEAN * self.most:
                self.old, self.seen, self.held = self.seen, {}, 0
            old = self.old
            made = {u: old.get(u) for u, x in zip(units, found, strict=False) if x is None}
            new = [u for u, x in made.items() if x is None]
            made.update(zip(new, self.units(new), strict=True) if new else ())
            found = [made[u] if x is None else x for u, x in zip(units, found, strict=False)]
            kept = [x for x in made.items() if len(x[0]) <= LONGEST]
            self.seen.update(kept)
            self.held += sum(len(u) for u, _ in kept)
        return head + b"".join(found) + tail

    def decode(self, ids: bytes) -> str:
        """The text of the ids, as the library's decode(ids): controls vanish, bytes join into characters."""
        out = "".join(map(self.text.__getitem__, memoryview(ids).cast("I")))
        if out.startswith(SPACE):
            out = out[1:]
        out = out.replace(SPACE, " ")
        return out if out.isascii() else out.encode("utf-8", "surrogateescape").decode("utf-8", "replace")


def _cuts(neighbours: set[tuple[str, str]]) -> str:
    """A pattern that finds the units of a text, given the characters that stand side by side in pieces.

    Of the characters that are no letters, those without neighbours are units of their own, and a unit ends before those
    that follow just each other and space marks. Characters beyond the first 128 that no piece has beside others are taken
    as letters are.
    """
    signs = {c for c in {c for pair in neighbours for c in pair} | set(map(chr, range(128))) if not c.isalpha() and c != SPACE}
    while late := {b for a, b in neighbours if b in signs and a != SPACE and a not in signs}:
        signs -= late
    alone = signs - {c for pair in neighbours for c in pair}
    signs, alone = ("".join(map(re.escape, sorted(x))) for x in (signs - alone, alone))
    start = f"{SPACE}*[{signs}]*" if signs else f"{SPACE}*"
    return f"[{alone}]|{start}[^{signs}{alone}{SPACE}]*"


@lru_cache(maxsize=2)
def _encoder(path: str, changed: int) -> Encoder:
    """The encoder of a model, which the tasks of a Python worker share, with the units it remembers."""
    return Encoder(path)


def encode_decode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", outputs: bool = False) -> DataFrame:
    """Encode each text with begin and end ids and decode the ids again.

    A null or empty text has the begin and end ids only and decodes to the empty text. Rows are kept as they are, also
    repeated ones and such with a null id. Returns doc_id, n_tokens, ids_sha256, decoded_sha256; with ``outputs`` also
    ids array<int> and decoded string.
    """
    tune(docs.sparkSession)
    kind = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if outputs else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(model, os.stat(model).st_mtime_ns)
        for batch in batches:
            ids = [encoder.ids(t) for t in batch.column(1).to_pylist()]
            decoded = [encoder.decode(x) for x in ids]
            columns = {"doc_id": batch.column(0), "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()), "ids_sha256": [hashlib.sha256(x).hexdigest() for x in ids], "decoded_sha256": [hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in decoded]}
            if outputs:
                columns |= {"ids": pa.array([list(memoryview(x).cast("I")) for x in ids], pa.list_(pa.int32())), "decoded": decoded}
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, pa.string()) for c in columns.values()], names=list(columns))

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, kind)
