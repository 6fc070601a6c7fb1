"""Secret scans over a trigram inverted index."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from re import _parser as parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from parcelworks.llm.common import tune


@dataclass(frozen=True)
class Rule:
    """A kind of secret: its pattern, and the least length of a group (0: the match) for a match to count."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


#: The base rules, in the order in which equal starts are listed, then the added ones.
BASE = (
    Rule("assign", r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]+", 0, 16),
)
ADDED = (
    Rule("private_key", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----[A-Za-z0-9+/=\s]+(?:-----END (?:[A-Z]+ )*PRIVATE KEY-----)?"),
    Rule("hub_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{20,}"),
    Rule("web_token", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
)


# A query is None (any document may match), a trigram, or ("and" | "or", queries).


def trigram_query(pattern: str):
    """What trigrams a text must hold, lower-cased, if the pattern matches in it; None if there are none that must be.

    Built from the parsed pattern: each part has the set of texts it can be (as long as they are few) and a query.
    """
    texts, query = _sequence(list(parser.parse(pattern)))
    return _both([query, _any_of(texts)])


def _both(queries: list):
    queries = [q for q in dict.fromkeys(queries) if q is not None]
    return None if not queries else queries[0] if len(queries) == 1 else ("and", tuple(queries))


def _either(queries: list):
    queries = list(dict.fromkeys(queries))
    return None if None in queries else queries[0] if len(queries) == 1 else ("or", tuple(queries))


def _any_of(texts: set[str] | None):
    """The query of a part that is one of ``texts``."""
    if not texts:
        return None
    return _either([_both([t[i : i + 3] for i in range(len(t) - 2)]) for t in sorted(texts)])


def _sequence(parts: list) -> tuple[set[str] | None, object]:
    """Possible texts of consecutive parts (None: too many to tell), and the query of what is known to be there."""
    run, queries, whole = {""}, [], True
    for part in parts:
        texts, query = _part(part)
        queries.append(query)
        joined = {a + b for a in run for b in texts} if texts is not None and len(texts) * len(run) <= 64 else None
        if joined is None:
            queries.append(_any_of(run))
            run, whole = texts if texts is not None and len(texts) <= 64 else {""}, False
        else:
            run = joined
    if not whole:
        queries.append(_any_of(run))
    return run if whole else None, _both(queries)


def _part(part) -> tuple[set[str] | None, object]:
    kind, value = str(part[0]), part[1]
    if kind == "LITERAL":
        return {chr(value).lower()}, None
    if kind == "IN":
        chars: set[str] = set()
        for k, v in value:
            if str(k) == "LITERAL":
                chars.add(chr(v).lower())
            elif str(k) == "RANGE" and v[1] - v[0] < 16:
                chars |= {chr(c).lower() for c in range(v[0], v[1] + 1)}
            else:
                return None, None
        return (chars, None) if len(chars) <= 16 else (None, None)
    if kind == "SUBPATTERN":
        return _sequence(list(value[3]))
    if kind == "AT":
        return {""}, None
    if kind == "BRANCH":
        found = [_sequence(list(b)) for b in value[1]]
        if all(t is not None for t, _ in found):
            return set().union(*(t for t, _ in found)), None
        return None, _either([_both([q, _any_of(t)]) for t, q in found])
    if kind in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
        low, high, inner = value
        texts, query = _sequence(list(inner))
        if (low, high) == (0, 1):
            return ({""} | texts if texts is not None else None), None
        if low == high == 1:
            return texts, query
        return None, (_both([query, _any_of(texts)]) if low else None)
    return None, None


def _trigrams(query) -> set[str]:
    return set() if query is None else {query} if isinstance(query, str) else set().union(*map(_trigrams, query[1]))


def _candidates(query, postings: Callable[[str], np.ndarray], n: int) -> np.ndarray:
    """Rows that a query lets through: intersections and unions of postings."""
    if query is None:
        return np.arange(n)
    if isinstance(query, str):
        return postings(query)
    out = None
    for q in query[1]:
        rows = _candidates(q, postings, n)
        out = rows if out is None else (np.intersect1d(out, rows, True) if query[0] == "and" else np.union1d(out, rows))
    return out


class Index:
    """Postings of the trigrams that a set of queries asks for, over the texts of one batch, by lower-cased bytes."""

    def __init__(self, queries: list):
        self.codes = {t: _code(t) for q in queries for t in _trigrams(q) if t.isascii()}
        self.wanted = np.zeros(1 << 24, bool)
        self.wanted[list(self.codes.values())] = True
        self.rows = self.found = np.empty(0, np.int64)

    def fill(self, texts: list[str]) -> None:
        raw = [t.encode("utf-8", "surrogatepass").lower() for t in texts]
        data = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint32)
        ends = np.cumsum([len(r) for r in raw])
        code = (data[:-2] << 16 | data[1:-1] << 8 | data[2:]) if len(data) > 2 else np.empty(0, np.uint32)
        at = np.flatnonzero(self.wanted[code])
        row = np.searchsorted(ends, at, side="right")
        inside = at + 2 < ends[row] if len(at) else np.empty(0, bool)
        pairs = np.unique(code[at[inside]].astype(np.int64) << 32 | row[inside])
        self.found, self.rows = pairs >> 32, pairs & 0xFFFFFFFF

    def postings(self, trigram: str) -> np.ndarray:
        if not trigram.isascii():
            raise ValueError("trigrams beyond ASCII are not indexed")
        code = self.codes[trigram]
        return self.rows[np.searchsorted(self.found, code) : np.searchsorted(self.found, code, side="right")]


def _code(trigram: str) -> int:
    a, b, c = trigram.encode("ascii")
    return a << 16 | b << 8 | c


def _ascii(query):
    """The query without trigrams beyond ASCII (which lower differently in bytes)."""
    if query is None or isinstance(query, str):
        return query if query is None or query.isascii() else None
    parts = [_ascii(q) for q in query[1]]
    return _both(parts) if query[0] == "and" else _either(parts)


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = BASE + ADDED, redact: str | None = None, text_col: str = "text", out: str = "secrets") -> DataFrame:
    """Add ``out`` array<struct<kind, start, end>> to the rows: code points, end exclusive, by start, then by rule.

    For each rule the matches of its pattern are taken leftmost and without overlap; those whose group is too short are
    dropped. A rule's trigram query picks the batch's texts to verify; a rule without mandatory trigrams scans them all.
    With ``redact`` the text is also rewritten: each span, overlapping ones as one, gives way to that string. Null and
    empty texts have no secrets and stay as they are. All columns of ``docs`` are kept (one named ``out`` is replaced).
    """
    tune(docs.sparkSession)
    columns = [c for c in docs.columns if c != out]
    source = docs.select(*columns)
    span = T.StructType().add("kind", T.StringType()).add("start", T.LongType()).add("end", T.LongType())
    kind = T.StructType([*source.schema.fields, T.StructField(out, T.ArrayType(span))])
    at = columns.index(text_col)
    spans_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = [_ascii(trigram_query(r.pattern)) for r in rules]
        patterns = [re.compile(r.pattern) for r in rules]
        index = Index(queries)
        for batch in batches:
            texts = batch.column(at).to_pylist()
            plain = [t or "" for t in texts]
            index.fill(plain)
            spans: list[list] = [[] for _ in plain]
            for order, (rule, pattern, query) in enumerate(zip(rules, patterns, queries, strict=True)):
                for row in _candidates(query, index.postings, len(plain)):
                    for m in pattern.finditer(plain[row]):
                        if m.end(rule.group) - m.start(rule.group) >= rule.least:
                            spans[row].append((m.start(), order, m.end()))
            for s in spans:
                s.sort()
            made = pa.array([[{"kind": rules[o].kind, "start": a, "end": b} for a, o, b in s] for s in spans], spans_type)
            arrays = list(batch.columns)
            if redact is not None:
                arrays[at] = pa.array([_redacted(t, s, redact) if s else t for t, s in zip(texts, spans, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([*arrays, made], names=[*columns, out])

    return source.mapInArrow(run, kind)


def _redacted(text: str, spans: list, mark: str) -> str:
    out, end = [], 0
    for a, _, b in spans:
        if a >= end:
            out += [text[end:a], mark]
        end = max(end, b)
    return "".join([*out, text[end:]])
