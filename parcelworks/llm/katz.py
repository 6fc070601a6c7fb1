"""Katz backoff language model: Good-Turing discounted counts of all words, pairs and trigrams, normalised backoff weights.

The tables of pairs and trigrams are partitioned by the last word of the context, v of (u, v, w): a cell then has all that
a token of its contexts asks for, P(w | u v), P(w | v) and both backoff weights, so nothing is joined n-gram by n-gram. The
pairs of a hot word v, which would make a cell too large, are counted beforehand and its cells are cut by u as well.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelworks.llm.common import Hashes, drop, mix, save, tune, words_of

#: Words of which at least one in 2**HEAD tokens is have numbers, known to every task: at most 2**HEAD, whatever the corpus.
#: All others are named by their hashes, and their counts come by a join.
HEAD = 22
#: Tokens of a chunk of texts, about; training tokens of a cell, on average. A word is hot if it would fill a cell alone,
#: or is more than one in SHARE of all tokens, so that no word holds up one of many tasks.
CHUNK, CELL, SHARE = 1 << 19, 1 << 19, 256
#: Counts up to this are discounted by Good-Turing.
K = 5

END = xxhash.xxh3_64_intdigest(b" end")  # no word holds a space
#: Keys of words: a head word's is its number, another one's its hash with the top bit set; those of what stands before a
#: text's first token and before that.
TOP, START, NONE = np.uint64(1 << 63), np.uint64(1 << 62), np.uint64((1 << 62) + 1)


def discounts(n: dict[int, int]) -> list[float]:
    """d[r] for counts r = 1..K by Katz's rule from the counts of counts; where that is not within (0, 1), (r - 1/2) / r."""
    out = [1.0]
    tail = (K + 1) * n.get(K + 1, 0) / n[1] if n.get(1) else 1.0
    for r in range(1, K + 1):
        d = 0.0
        if n.get(r) and tail < 1:
            d = ((r + 1) * n.get(r + 1, 0) / n[r] / r - tail) / (1 - tail)
        out.append(d if 0 < d < 1 else (r - 0.5) / r)
    return out


def unseen_types(n: dict[int, int]) -> float:
    """How many words the training texts have missed, estimated from those met once and twice (Chao); at least one."""
    once, twice = n.get(1, 0), n.get(2, 0)
    return max(1.0, once * once / (2 * twice) if twice else once * (once - 1) / 2)


@dataclass
class Stats:
    """What all tasks know: the head's words (sorted hashes, their numbers) and counts by number, the corpus' figures, the
    discounts of each order, and of hot words (sorted numbers) the scale and backoff weight of their pairs."""

    hashes: np.ndarray
    numbers: np.ndarray
    counts: np.ndarray
    tokens: int
    vocabulary: int
    cells: int
    unseen: float  # probability of one unseen word
    unigram_scale: float
    discount: list[list[float]] = field(default_factory=list)
    hot: np.ndarray = field(default_factory=lambda: np.empty(0, np.uint64))
    hot_scale: np.ndarray = field(default_factory=lambda: np.empty(0))
    hot_alpha: np.ndarray = field(default_factory=lambda: np.empty(0))

    def discounted(self, counts: np.ndarray, order: int) -> np.ndarray:
        table = np.array(self.discount[order - 1])
        return np.where(counts <= K, table[np.minimum(counts, K).astype(np.int64)], 1.0) * counts

    def word(self, counts: np.ndarray) -> np.ndarray:
        """P(w) of words with these training counts; of each word that did not occur, an equal share of what is left."""
        return np.where(counts > 0, self.discounted(counts, 1) * self.unigram_scale, self.unseen)


def weights(c: np.ndarray, p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of contexts that occur ``c`` times: the factor that makes discounted counts probabilities, and the backoff weight.

    ``p`` sums the discounted counts of what follows, ``q`` its probabilities one order lower. At least the weight of one
    more token is left for backing off. A context that does not occur backs off with a weight of 1.
    """
    seen = c > 0
    c = np.where(seen, c, 1.0)
    scale = np.where(seen, np.minimum(1.0, c * c / (c + 1) / np.maximum(p, 1e-300)) / c, 0.0)
    return scale, np.where(seen, (1 - p * scale) / np.maximum(1 - q, 1e-12), 1.0)


def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each key in a sorted table, and whether it is there."""
    if not len(table):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(mix(a) + b * np.uint64(0x9E3779B97F4A7C15))


def _alike(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A place of each different key, by key, and the number of the key at each place."""
    order = np.argsort(keys)
    new = np.append(True, np.diff(keys[order]) != 0) if len(keys) else np.empty(0, bool)
    number = np.empty(len(keys), np.int64)
    number[order] = np.cumsum(new) - 1
    return order[new], number


def _tokens(texts: list, hashes: Hashes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens of the texts, each text's end token included, and the number of tokens of each text."""
    parts, sizes = [], []
    for text in texts:
        hashes.trim()
        words = words_of(text)
        parts.append(b"".join(map(hashes.__getitem__, words)))
        sizes.append(len(words) + 1)
    end = END.to_bytes(8, "little")
    return np.frombuffer(end.join([*parts, b""]), np.uint64), np.array(sizes, np.int64)


def _packed(*arrays: np.ndarray) -> bytes:
    """Arrays as compressed bytes, the bytes of equal weight next to each other."""
    press = zstandard.ZstdCompressor(level=1)
    parts = [press.compress(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T).tobytes() if len(a) else b"") for a in arrays]
    return b"".join([np.array([len(arrays), *(x for a, p in zip(arrays, parts, strict=True) for x in (len(a), len(p)))], np.uint32).tobytes(), *parts])


def _unpacked(data: bytes, kinds: list) -> list[np.ndarray]:
    head = np.frombuffer(data, np.uint32, 1 + 2 * len(kinds))
    at, out, press = head.nbytes, [], zstandard.ZstdDecompressor()
    for kind, n, size in zip(kinds, head[1::2].tolist(), head[2::2].tolist(), strict=True):
        raw = np.frombuffer(press.decompress(data[at : at + size], max(1, n * np.dtype(kind).itemsize)), np.uint8)
        out.append(np.ascontiguousarray(raw.reshape(-1, n).T).view(kind).reshape(n) if n else np.empty(0, kind))
        at += size
    return out


CHUNKS = pa.schema([("chunk", pa.int64()), ("docs", pa.list_(pa.int64())), ("train", pa.list_(pa.bool_())), ("sizes", pa.list_(pa.int32())), ("codes", pa.binary()), ("words", pa.list_(pa.int64())), ("times", pa.list_(pa.int32()))])


def _encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as chunks: the hashes of a chunk's different words, how often each is in training texts, and for each token the
    place of its word there."""
    hashes, chunk = Hashes(), TaskContext.get().partitionId() << 20
    held: list[tuple] = []

    def flush() -> pa.RecordBatch:
        tokens, sizes = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
        docs, train = ([x for h in held for x in h[i]] for i in (2, 3))
        at, codes = _alike(tokens)
        times = np.bincount(codes, np.repeat(train, sizes), len(at)).astype(np.int64)
        rank = np.argsort(-np.bincount(codes))  # frequent words first: small codes
        place = np.empty(len(at), np.uint32)
        place[rank] = np.arange(len(at), dtype=np.uint32)
        values = [[chunk], [docs], [train], [sizes.tolist()], [_packed(place[codes])]]
        listed = [pa.ListArray.from_arrays(pa.array([0, len(at)], pa.int32()), pa.array(x)) for x in (tokens[at][rank].view(np.int64), times[rank].astype(np.int32))]
        return pa.RecordBatch.from_arrays([*(pa.array(v, f.type) for v, f in zip(values, CHUNKS)), *listed], schema=CHUNKS)

    for batch in batches:
        tokens, sizes = _tokens(batch.column(1).to_pylist(), hashes)
        held.append((tokens, sizes, batch.column(0).to_pylist(), batch.column(2).to_pylist()))
        if sum(len(h[0]) for h in held) > CHUNK:
            yield flush()
            held, chunk = [], chunk + 1
    if any(len(h[1]) for h in held):
        yield flush()


class Chunk:
    """A chunk's tokens: for each its key, its word's training count, its text's place in the chunk, whether that is trained
    on, and the keys of the two words before it."""

    def __init__(self, s: Stats, chunk: pa.RecordBatch):
        cell = lambda name: chunk.column(chunk.schema.get_field_index(name))[0]
        column = lambda name: cell(name).values.to_numpy(zero_copy_only=False) if cell(name).is_valid else np.empty(0, np.int64)
        self.number, self.docs, self.trained, self.sizes = cell("chunk").as_py(), cell("docs").values, column("train").astype(bool), column("sizes").astype(np.int64)
        self.hashes = column("words").view(np.uint64)
        codes = _unpacked(cell("codes").as_py(), [np.uint32])[0]
        at, near = _find(s.hashes, self.hashes)
        keys, counts = self.hashes | TOP, np.zeros(len(self.hashes), np.int64)
        keys[near] = s.numbers[at[near]]
        counts[near] = s.counts[keys[near].astype(np.int64)]
        self.far = np.flatnonzero(~near)  # words that the head lacks: their counts are told
        told = chunk.schema.get_field_index("word_counts") >= 0
        if told and len(self.far):
            counts[self.far] = column("word_counts")
        self.codes, self.w, self.n = codes, keys[codes], counts[codes]
        self.text = np.repeat(np.arange(len(self.sizes)), self.sizes)
        self.train = self.trained[self.text]
        starts = np.cumsum(self.sizes) - self.sizes
        self.v = np.append(START, self.w[:-1])
        self.v[starts] = START
        self.u = np.append(NONE, self.v[:-1])
        self.u[starts] = NONE
        self.is_hot = _hot(s, self.v)
        hot = np.flatnonzero(self.is_hot)
        pairs = _pair(self.v[hot], self.w[hot])
        at, self.pair = _alike(pairs)  # the different pairs behind a hot word, by key, and that of each such token
        self.pair_keys, self.pair_at = pairs[at], hot[at]
        self.pair_times = np.bincount(self.pair, self.train[hot], len(at)).astype(np.int64)
        self.pair_counts = column("pair_counts")[self.pair] if told and len(hot) else np.empty(0, np.int64)


def _hot(s: Stats, v: np.ndarray) -> np.ndarray:
    return _find(s.hot, v)[1] if len(s.hot) else np.zeros(len(v), bool)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1)


def _asked(s: Stats):
    """What a chunk must be told: counts of the words that the head lacks, and of the pairs behind hot words, which come with
    how often they occur in the chunk's training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _chunks(batches):
            c = Chunk(s, row)
            n, m = len(c.far), len(c.pair_keys)
            none = np.zeros(n, np.int64)
            columns = (np.full(n + m, c.number), np.append(np.arange(n), np.arange(m)).astype(np.int32), np.append(none, c.v[c.pair_at].view(np.int64)), np.append(c.hashes[c.far], c.hashes[c.codes[c.pair_at]]).view(np.int64), np.append(none, c.pair_times), np.arange(n + m) >= n)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["chunk", "at", "v", "word", "n", "hot"])

    return run


def cell_of(s: Stats, v: np.ndarray, u: np.ndarray) -> np.ndarray:
    """The cell of each token: by v, and for a hot v by u too."""
    h = mix(v + np.uint64(7))
    return ((np.where(_hot(s, v), mix(h + u), h) if len(s.hot) else h) % np.uint64(s.cells)).astype(np.uint32)


#: What a cell gets from a chunk: the different v and how often each occurs, u, w, which of them are hashes, the training
#: counts of w behind hashes, the training counts of pairs behind a hot v, and 2 * text + trained.
MESSAGE = [np.uint64, np.uint32, np.uint32, np.uint64, np.uint32, np.uint64, np.uint32, np.uint64, np.uint32]
OTHER = np.uint32(0xFFFFFFFF)  # stands for a key that follows in the list of those that do not fit 32 bits


def _dealt(s: Stats, scoring: bool):
    """Chunks as messages to cells, of training tokens only or (``scoring``) of all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _chunks(batches):
            c = Chunk(s, row)
            pairs = np.zeros(len(c.w), np.uint64)
            pairs[c.is_hot] = c.pair_counts.astype(np.uint64)
            of = slice(None) if scoring else np.flatnonzero(c.train)
            v, u, w, n, pairs, hot = c.v[of], c.u[of], c.w[of], c.n[of], pairs[of], c.is_hot[of]
            cells = cell_of(s, v, u)
            order = np.argsort(cells.astype(np.uint64) << np.uint64(32) | mix(v) >> np.uint64(32))  # tokens of one v in a run
            cells, v, u, w, n, pairs, hot = (x[order] for x in (cells, v, u, w, n, pairs, hot))
            code = (2 * c.text + c.train)[of][order].astype(np.uint32)
            far_u, far_w = u >= OTHER, w >= OTHER
            near_u, near_w = (np.where(far, OTHER, x).astype(np.uint32) for far, x in ((far_u, u), (far_w, w)))
            new = np.append(True, v[1:] != v[:-1])
            ends = np.flatnonzero(np.diff(cells, append=np.uint32(s.cells))) + 1
            start, out = 0, []
            for end in ends.tolist():
                at = slice(start, end)
                new[start] = True
                heads = start + np.flatnonzero(new[at])
                runs = np.diff(heads, append=end).astype(np.uint32)
                message = _packed(v[heads], runs, near_u[at], u[at][far_u[at]], near_w[at], w[at][far_w[at]], n[at][far_w[at]].astype(np.uint32), pairs[at][hot[at]], code[at] if scoring else code[:0])
                out.append((int(cells[start]), c.number, message))
                start = end
                if len(out) == 512 or end == ends[-1]:
                    yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate((pa.int32(), pa.int64(), pa.binary()))], names=["cell", "chunk", "message"])
                    out = []

    return run


class Cell:
    """The n-gram tables of one cell, and the tokens that they are asked for.

    Each token has u, v, w, the training count of w, and ``pair`` and ``gram``, its pair's and its trigram's places in the
    tables; a pair has ``c2``, a trigram ``c3``, and a context the sum over what follows it.
    """

    def __init__(self, s: Stats, table: pa.Table):
        self.s = s
        messages = [_unpacked(m, MESSAGE) for m in table.column("message").to_pylist()]
        join = lambda i: np.concatenate([m[i] for m in messages])
        heads, runs = join(0), join(1)
        at, number = _alike(heads)
        self.words = heads[at]  # the different v
        self.word = np.repeat(number, runs)
        v = np.repeat(heads, runs)
        u, w = (short.astype(np.uint64) for short in (join(2), join(4)))
        u[u == OTHER] = join(3)
        far = w == OTHER
        w[far] = join(5)
        n = np.zeros(len(w), np.int64)
        n[far] = join(6)
        n[~far] = s.counts[w[~far].astype(np.int64)]
        code = join(8)
        train = (code & 1).astype(float) if len(code) else np.ones(len(w))
        self.sent, self.chunks, self.texts = [len(m[2]) for m in messages], table.column("chunk").to_numpy(), code >> 1
        at, self.gram = _alike(_pair(_pair(v, w), u))
        self.c3 = np.bincount(self.gram, train)
        self.u, self.v, self.w, self.n, self.v_at = u[at], v[at], w[at], n[at], self.word[at]
        self.longer = self.v != START  # the others are pairs at a text's start, and no trigrams
        self.pair_at, self.pair = _alike(_pair(self.v, self.w))
        self.c2 = np.bincount(self.pair, self.c3)
        self.hot = _hot(s, self.v)
        if self.hot.any():
            told = np.zeros(len(v))
            told[_hot(s, v)] = join(7)
            self.c2[self.pair[self.hot]] = told[at][self.hot]

    def count_counts(self) -> pa.Table:
        """How many pairs (order 2) and trigrams (3) occur n times, n up to K + 1; pairs behind hot words left out."""
        made = [np.bincount(np.minimum(x, K + 2).astype(np.int64), minlength=K + 3)[1 : K + 2] for x in (self.c2[~self.hot[self.pair_at]], self.c3[self.longer])]
        return pa.table({"ngram": np.repeat([2, 3], K + 1).astype(np.int32), "n": np.tile(np.arange(1, K + 2), 2), "times": np.concatenate(made).astype(np.int64)})

    def solve(self) -> None:
        """Probabilities of pairs and trigrams, of the modelled ones and of those that back off, order by order."""
        s, c2, c3 = self.s, self.c2, self.c3
        of, size = self.v_at[self.pair_at], len(self.words)
        p1, d2 = s.word(self.n[self.pair_at]), s.discounted(c2, 2)
        scale, self.alpha2 = weights(np.bincount(self.v_at, c3, size), np.bincount(of, d2, size), np.bincount(of, np.where(c2 > 0, p1, 0.0), size))
        place, hot = _find(s.hot, self.words)
        if hot.any():
            scale[hot], self.alpha2[hot] = s.hot_scale[place[hot]], s.hot_alpha[place[hot]]
        self.p2 = np.where(c2 > 0, d2 * scale[of], self.alpha2[of] * p1)
        self.context_at, of = _alike(_pair(self.u, self.v))
        low, d3 = self.p2[self.pair], s.discounted(c3, 3)
        scale, self.alpha3 = weights(np.bincount(of, c3), np.bincount(of, d3), np.bincount(of, np.where(c3 > 0, low, 0.0)))
        self.p3 = np.where(self.longer, np.where(c3 > 0, d3 * scale[of], self.alpha3[of] * low), low)

    def scores(self) -> pa.Table:
        """For each chunk that asked: the texts' places and the sums of their tokens' logs in this cell (few tokens each, so 32
        bits are enough for a part)."""
        self.solve()
        logs, start, out = np.log10(self.p3)[self.gram], 0, []
        for size in self.sent:
            text = self.texts[start : start + size]
            total = np.bincount(text, logs[start : start + size])
            there = np.flatnonzero(np.bincount(text))
            out.append(_packed(there.astype(np.uint32), total[there].astype(np.float32)))
            start += size
        return pa.table({"chunk": self.chunks, "parts": pa.array(out, pa.binary())})

    def tables(self) -> pa.Table:
        """The cell's part of the model: its pairs and trigrams with their probabilities, its contexts with their weights."""
        self.solve()

        def part(order: int, at: np.ndarray, u: bool, w: bool, **figures: np.ndarray) -> pa.Table:
            names = {"u": u, "v": True, "w": w}
            keys = {k: pa.array(_named(self.s, getattr(self, k)[at])) if on else pa.nulls(len(at), pa.int64()) for k, on in names.items()}
            return pa.table({"ngram": pa.array(np.full(len(at), order, np.int32)), **keys, **{k: pa.array(figures[k]) if k in figures else pa.nulls(len(at), pa.float64()) for k in ("n", "log_p", "log_alpha")}})

        pairs, grams, contexts = self.c2 > 0, np.flatnonzero((self.c3 > 0) & self.longer), (self.v[self.context_at] != START) & (self.alpha3 != 1)
        first = np.empty(len(self.words), np.int64)
        first[self.v_at] = np.arange(len(self.v_at))
        return pa.concat_tables([
            part(2, self.pair_at[pairs], False, True, n=self.c2[pairs], log_p=np.log10(self.p2[pairs])),
            part(3, grams, True, True, n=self.c3[grams], log_p=np.log10(self.p3[grams])),
            part(1, first, False, False, log_alpha=np.log10(self.alpha2)),
            part(2, self.context_at[contexts], True, False, log_alpha=np.log10(self.alpha3[contexts])),
        ])


def _named(s: Stats, keys: np.ndarray) -> np.ndarray:
    """Keys of words as the lower 63 bits of their hashes; START has a name of its own."""
    hashes = np.empty(len(s.hashes), np.uint64)
    hashes[s.numbers] = s.hashes
    out = keys.copy()
    near = keys < len(hashes)
    out[near] = hashes[keys[near].astype(np.int64)]
    return np.where(keys == START, keys, out & (TOP - np.uint64(1))).view(np.int64)


FIGURES = "chunk long, docs array<long>, sizes array<long>, known array<long>, base array<double>"


def _figures(s: Stats):
    """Of the texts of a chunk: ids, tokens, those of them known from training, and the add-one scores."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _chunks(batches):
            c = Chunk(s, row)
            total = lambda x, c=c: np.bincount(c.text, x, len(c.sizes))
            base = np.log10((c.n + 1.0) / (s.tokens + s.vocabulary + 1.0))
            values = (c.docs, pa.array(c.sizes), pa.array(total(c.n > 0).astype(np.int64)), pa.array(total(base)))
            yield pa.RecordBatch.from_arrays([pa.array([c.number]), *(pa.ListArray.from_arrays(pa.array([0, len(c.sizes)], pa.int32()), x) for x in values)], names=["chunk", "docs", "sizes", "known", "base"])

    return run


def _summed(table: pa.Table) -> pa.Table:
    """A chunk's texts with their figures, and the sum of what the cells say of each."""
    own = table.filter(table.column("docs").is_valid())
    docs, sizes, known, base = (own.column(c)[0].values for c in ("docs", "sizes", "known", "base"))
    score = np.zeros(len(docs))
    for parts in table.column("parts").to_pylist():
        if parts is not None:
            at, value = _unpacked(parts, [np.uint32, np.float32])
            score[at] += value
    return pa.table({"doc_id": docs, "n_tokens": sizes, "n_known": known, "base_score": base, "score": score})


class Katz:
    """A model of the n-grams up to order 3 of the texts that are trained on, and the scores of all texts under it.

    With c counts and d discounts: P(w) = d c(w) / N for a known word, and what is left is shared equally by the words that
    the training texts have missed, as many as Chao's estimate says; an unknown word is one of these. Of an n-gram that
    occurs P(w | h) = d c(h w) / c(h), and else alpha(h) P(w | h'), where h' is h without its first word and alpha(h) =
    (1 - sum of the n-grams' probabilities) / (1 - sum of P(w | h') over them); so each context's probabilities sum to 1.
    Every n-gram counts, those that occur once too. The log of a text's probability sums over its words and its end.

    ``docs`` is (id, text, ...) and ``train`` a condition on its columns (null: false). Null texts count as empty; rows that
    repeat an id are trained on and scored each on its own; without training texts every token has a probability of 1.
    """

    def __init__(self, docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text"):
        tune(docs.sparkSession)
        source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
        encoded = save(source.mapInArrow(_encoded, "chunk long, docs array<long>, train array<boolean>, sizes array<int>, codes binary, words array<long>, times array<int>"), "encoded")
        counts = encoded.select(F.explode(F.arrays_zip(F.col("words").alias("key"), F.col("times").alias("n"))).alias("e")).select("e.*").where("n > 0")
        self.words = save(counts.groupBy("key").agg(F.sum("n").alias("n")), "word_counts")
        self.stats = s = self._unigrams()
        pairs = self._tell(encoded)
        dealt = self.chunks.mapInArrow(_dealt(s, False), "cell int, chunk long, message binary")
        times = dealt.groupBy("cell").applyInArrow(lambda t: Cell(s, t).count_counts(), "ngram int, n long, times long")
        times = times.union(pairs.where(F.col("n").between(1, K + 1)).groupBy("n").agg(F.count(F.lit(1)).alias("times")).select(F.lit(2), "n", "times"))
        found = {(r.ngram, r.n): r.times for r in times.groupBy("ngram", "n").agg(F.sum("times").alias("times")).collect()}
        s.discount += [discounts({n: found.get((order, n), 0) for n in range(1, K + 2)}) for order in (2, 3)]
        self._hot_weights(pairs)
        drop(pairs)

    def _unigrams(self) -> Stats:
        tokens, vocabulary = self.words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
        n = {r.n: r.c for r in self.words.where(F.col("n") <= K + 1).groupBy("n").agg(F.count(F.lit(1)).alias("c")).collect()}
        d = discounts(n)
        left = sum(n.get(r, 0) * r * (1 - d[r]) for r in range(1, K + 1)) / max(tokens, 1)
        scale = 1.0
        if left <= 0:  # nothing was discounted: make room for one token
            scale = left = tokens / (tokens + 1) if tokens else 1.0
            left = 1 - scale if tokens else 1.0
        head = self.words.where(F.col("n") >= tokens / 2**HEAD).toArrow()
        hashes, counts = head.column("key").to_numpy().view(np.uint64), head.column("n").to_numpy()
        rank = np.lexsort((hashes, -counts))
        numbers = np.empty(len(rank), np.uint32)
        numbers[rank] = np.arange(len(rank), dtype=np.uint32)
        order = np.argsort(hashes)
        ending = _find(hashes[order], np.array([END], np.uint64))
        end = int(order[ending[0][0]]) if ending[1][0] else -1
        texts = int(counts[end]) if end >= 0 else 0
        most = min(CELL, tokens / SHARE)
        hot = np.flatnonzero(counts[rank] > most).astype(np.uint64)  # an end is no context; a start is, as often
        hot = np.append(hot[hot != numbers[end]] if end >= 0 else hot, START if texts > most else []).astype(np.uint64)
        return Stats(hashes[order], numbers[order], counts[rank], tokens, vocabulary, max(1, -(-tokens // CELL)), left / unseen_types(n), scale / max(tokens, 1), [d], hot)

    def _tell(self, encoded: DataFrame) -> DataFrame:
        """Make ``chunks``: ``encoded`` with the counts that each chunk asks for. Returns the pairs behind hot words with
        their training counts: (v, word, n)."""
        asked = save(encoded.drop("times").mapInArrow(_asked(self.stats), "chunk long, at int, v long, word long, n long, hot boolean"), "asked")
        pairs = save(asked.where("hot").groupBy("v", "word").agg(F.sum("n").alias("n")), "hot_pairs")
        told = asked.where("not hot").select("chunk", "at", "hot", "word").join(self.words.withColumnRenamed("key", "word"), "word", "left").drop("word")
        if len(self.stats.hot):
            told = told.unionByName(asked.where("hot").select("chunk", "at", "hot", "v", "word").join(pairs, ["v", "word"]).drop("v", "word"))
        listed = lambda on: F.array_sort(F.collect_list(F.when(on, F.struct("at", F.coalesce("n", F.lit(0)).alias("n")))))
        told = save(told.groupBy("chunk").agg(listed(~F.col("hot")).alias("w"), listed(F.col("hot")).alias("p")).select("chunk", F.col("w.n").alias("word_counts"), F.col("p.n").alias("pair_counts")), "told")
        drop(asked)
        self.chunks = save(encoded.drop("times").join(told, "chunk", "left"), "chunks")
        drop(encoded)
        drop(told)
        return pairs

    def _hot_weights(self, pairs: DataFrame) -> None:
        s = self.stats
        if not len(s.hot):
            return
        dealt = lambda n, order: F.when(n <= K, F.element_at(F.array(*[F.lit(x) for x in s.discount[order - 1]]), n.cast("int") + 1)).otherwise(1.0) * n
        behind = pairs.where("n > 0").join(self.words.select(F.col("key").alias("word"), F.col("n").alias("word_n")), "word")
        sums = behind.groupBy("v").agg(F.sum("n").alias("c"), F.sum(dealt(F.col("n"), 2)).alias("p"), F.sum(dealt(F.col("word_n"), 1) * s.unigram_scale).alias("q")).collect()  # a row for each hot word
        by_word = {r.v: r for r in sums}
        rows = [by_word[int(x)] for x in s.hot]
        s.hot_scale, s.hot_alpha = weights(*(np.array([r[k] for r in rows], float) for k in ("c", "p", "q")))

    def score(self) -> DataFrame:
        """The id, n_tokens (end included), n_known (tokens seen in training), base_score (add-one) and score, both log10.

        A token is scored by its trigram, else by backing off to its pair, else to the word, in the cell of its context.
        """
        s = self.stats
        dealt = self.chunks.mapInArrow(_dealt(s, True), "cell int, chunk long, message binary")
        parts = dealt.groupBy("cell").applyInArrow(lambda t: Cell(s, t).scores(), "chunk long, parts binary")
        rows = self.chunks.mapInArrow(_figures(s), FIGURES).unionByName(parts, allowMissingColumns=True)
        return rows.groupBy("chunk").applyInArrow(_summed, "doc_id long, n_tokens long, n_known long, base_score double, score double")

    def tables(self) -> DataFrame:
        """The model's tables, to be written with partitionBy("ngram"): (ngram, u, v, w, n, log_p, log_alpha).

        A row with a w is a pair or trigram; one without is a context of ``ngram`` words, its backoff weight in log_alpha.
        Words are named by the lower 63 bits of their hashes.
        """
        s = self.stats
        dealt = self.chunks.mapInArrow(_dealt(s, False), "cell int, chunk long, message binary")
        made = dealt.groupBy("cell").applyInArrow(lambda t: Cell(s, t).tables(), "ngram int, u long, v long, w long, n double, log_p double, log_alpha double")
        return made.dropDuplicates(["ngram", "u", "v", "w"])  # pairs of hot words are in several cells
