"""Toxicity: a learned lexicon's trie intersected with Levenshtein automata, and context windows that tell quotation from abuse."""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelworks.llm.common import Hashes, save, shingle_hashes, tune, words_of

#: Bound of the labelled sample that is fitted on, and of the terms that may become the lexicon.
SAMPLE, TERMS = 8000, 4096
#: Lengths of the stems that are counted, and the length that a whole term has at most.
STEM_FROM, STEM_TO, TERM_TO = 4, 12, 40
#: Toxic documents that a term is in at least, and the likelihood ratio (G squared) that tells it from chance.
LEAST_DOCS, LEAST_RATIO = 3, 20.0
#: Words on either side that make a hit's context, and code points that a quotation spans at most.
WINDOW, QUOTATION = 8, 400

# Words of reporting and of address in the languages at hand, and digits and signs that stand for letters.
REPORTING = frozenset("said says say called call calls wrote writes quote quotes quoted quoting word words term terms slur slurs allegedly reported sagte sagt nannte schrieb zitat wort begriff dit disait appelé écrit cité mot terme dijo dice llamó escribió cita palabra término".split())
ADDRESS = frozenset("you your yours you're u ur yourself du dich dir dein deine ihr euch tu toi ton ta vous votre tú te ti usted vosotros".split())
STANDS_FOR = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "\u00ad": "", "\u200b": "", "\u200c": "", "\u200d": ""}

TOKEN = re.compile("[^\\W_]+(?:[@$*\u00ad\u200b-\u200d]+[^\\W_]+)*")
MARKS = re.compile('["“”„«»\n]')
_SIGNS, _RUN = str.maketrans(STANDS_FOR), re.compile(r"(.)\1{2,}")
#: Context flags of a hit: inside a quotation, near a word of reporting, near a word of address, near another hit.
QUOTED, REPORTED, ADDRESSED, CROWDED = 1, 2, 4, 8


def folded(token: str) -> str:
    """The token as it is looked up: lowered, signs and digits among letters read as letters, long runs of a letter as one."""
    low = token.lower()
    if not low.isalpha() and not low.isdigit():
        low = low.translate(_SIGNS)
    return _RUN.sub(r"\1", low) if len(low) > 2 else low


def edits_of(term: str) -> int:
    """Edits that a misspelling of the term may have: none under 5 letters, one, and two from 9 letters on."""
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


class Automaton:
    """The Levenshtein automata of all terms, intersected with the trie of the terms, made deterministic as words need it.

    A position is (node of the trie, edits so far, letter that a swap still awaits); a state is the set of positions that
    a prefix of a word can be at, and has one number. Terms are (text, whole): a whole term is met at the end of a word, a
    stem by any word that begins with it. Substitution, insertion, deletion and a swap of neighbours are one edit each.
    """

    def __init__(self, terms: Iterable[tuple[str, bool]]):
        self.terms = list(terms)
        self.next: list[dict[str, int]] = [{}]
        self.most, self.whole, self.stem = [0], [-1], [-1]
        for number, (text, whole) in enumerate(self.terms):
            node, most = 0, edits_of(text)
            self.most[0] = max(self.most[0], most)
            for c in text:
                if c not in self.next[node]:
                    self.next[node][c] = len(self.next)
                    self.next.append({})
                    self.most.append(0)
                    self.whole.append(-1)
                    self.stem.append(-1)
                node = self.next[node][c]
                self.most[node] = max(self.most[node], most)
            (self.whole if whole else self.stem)[node] = number
        self._forget()

    def __getstate__(self):
        return self.terms

    def __setstate__(self, terms):
        self.__init__(terms)

    def _forget(self) -> None:
        self.numbers: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.steps: list[dict[str, int]] = []
        self.ends: list[tuple] = []  # hits of the words that end here
        self.begins: list[tuple] = []  # hits of all words that come by here
        self.dead = self._number(frozenset())
        self.start = self._number(self._closed({(0, ""): 0}))

    def _closed(self, at: dict[tuple[int, str], int]) -> frozenset:
        """With the positions that letters missing from the word lead to; each position with its fewest edits."""
        todo = list(at.items())
        while todo:
            (node, awaits), edits = todo.pop()
            if awaits or at.get((node, "")) != edits:
                continue
            for child in self.next[node].values():
                if edits < self.most[child] and edits + 1 < at.get((child, ""), 99):
                    at[child, ""] = edits + 1
                    todo.append(((child, ""), edits + 1))
        return frozenset((node, edits, awaits) for (node, awaits), edits in at.items())

    def _number(self, state: frozenset) -> int:
        if state in self.numbers:
            return self.numbers[state]
        found = lambda of: tuple((of[node], edits) for node, edits, awaits in state if not awaits and of[node] >= 0 and edits <= edits_of(self.terms[of[node]][0]))
        self.sets.append(state)
        self.steps.append({})
        self.ends.append(found(self.whole))
        self.begins.append(found(self.stem))
        made = self.numbers[state] = len(self.sets) - 1
        return made

    def _step(self, state: int, c: str) -> int:
        at: dict[tuple[int, str], int] = {}

        def reach(node: int, edits: int, awaits: str = "") -> None:
            if edits <= self.most[node] and edits < at.get((node, awaits), 99):
                at[node, awaits] = edits

        for node, edits, awaits in self.sets[state]:
            if awaits:
                if awaits == c:
                    reach(node, edits)
                continue
            reach(node, edits + 1)
            for letter, child in self.next[node].items():
                if letter == c:
                    reach(child, edits)
                else:
                    reach(child, edits + 1)
                    if c in self.next[child]:
                        reach(self.next[child][c], edits + 1, letter)
        made = self.steps[state][c] = self._number(self._closed(at))
        return made

    def match(self, word: str, exact: bool = False) -> tuple[tuple[int, int], ...]:
        """(term, edits) of the terms that the word meets, each with its fewest edits; the exact ones alone if there are any."""
        if len(self.sets) > 100_000:
            self._forget()
        state, best = self.start, {}
        for c in word:
            state = self.steps[state].get(c, -1) if c in self.steps[state] else self._step(state, c)
            if state == self.dead:
                break
            for term, edits in self.begins[state]:
                best[term] = min(edits, best.get(term, 99))
        for term, edits in self.ends[state]:
            best[term] = min(edits, best.get(term, 99))
        sharp = [t for t, e in best.items() if e == 0]
        return tuple((t, 0) for t in sharp) if sharp else () if exact else tuple(best.items())


def quotations(text: str) -> tuple[list[int], list[int]]:
    """Starts and ends of the quotations: pairs of marks in one line, QUOTATION code points apart at most."""
    starts, ends, opened = [], [], {}
    for m in MARKS.finditer(text):
        mark, at = m[0], m.start()
        if mark == "\n":
            opened.clear()
            continue
        kind = '"' if mark == '"' else "«" if mark in "«»" else "“"
        if kind in opened and (kind == '"' or mark in "”»" or (mark == "“" and opened[kind][1] == "„")):
            begin = opened.pop(kind)[0]
            if at - begin <= QUOTATION:
                starts.append(begin)
                ends.append(at)
            elif kind == '"':
                opened[kind] = (at, mark)  # the mark before stood alone
        elif mark not in "”»":
            opened[kind] = (at, mark)
    return starts, ends


def hits(text: str, matched: dict[str, tuple]) -> Counter:
    """How often each (term, misspelt, context flags) occurs; ``matched`` has the tokens that meet terms.

    The context is WINDOW words on either side, quotations those of the line.
    """
    tokens = list(TOKEN.finditer(text))
    at = [i for i, m in enumerate(tokens) if m[0] in matched]
    order = np.array([], int)
    starts, ends = quotations(text)
    if starts:
        order = np.argsort(starts, kind="stable")
    begins, closes = [starts[i] for i in order], np.maximum.accumulate([ends[i] for i in order]) if len(order) else []
    out: Counter = Counter()
    for i in at:
        begin, end = tokens[i].span()
        k = bisect_right(begins, begin) - 1
        flags = QUOTED if k >= 0 and closes[k] >= end else 0
        near = {m[0].lower() for m in tokens[max(0, i - WINDOW) : i + WINDOW + 1]}
        flags |= REPORTED * (not near.isdisjoint(REPORTING)) | ADDRESSED * (not near.isdisjoint(ADDRESS))
        flags |= CROWDED * (bisect_right(at, i + WINDOW) - bisect_left(at, i - WINDOW) > 1)
        for term, edits in matched[tokens[i][0]]:
            out[term, edits > 0, flags] += 1
    return out


class Matcher:
    """Looks up the tokens of texts; tokens that meet nothing are remembered, within a bound."""

    def __init__(self, automaton: Automaton, most: int = 300_000):
        self.automaton, self.clean, self.met, self.most = automaton, set(), {}, most

    def matched(self, tokens: set[str]) -> dict[str, tuple]:
        if len(self.clean) > self.most or len(self.met) > self.most:
            self.clean, self.met = set(), {}
        out = {}
        for token in tokens - self.clean:
            found = self.met.get(token)
            if found is None:
                found = self.automaton.match(folded(token))
                if not found:
                    self.clean.add(token)
                    continue
                self.met[token] = found
            out[token] = found
        return out


class Model:
    """Lexicon with severities, weights of contexts, and the logistic curve from a text's evidence to a probability."""

    def __init__(self, lexicon: Lexicon, weights: np.ndarray, contexts: np.ndarray, curve: np.ndarray, prior: float):
        self.lexicon, self.weights, self.contexts, self.curve, self.prior = lexicon, weights, contexts, curve, prior

    def score(self, found: Counter, n_words: int) -> float:
        if self.curve is None:
            return self.prior
        z = float(self.curve @ [1.0, *_features(found, n_words, self.weights, self.contexts)])
        return 1 / (1 + math.exp(-z)) if z > -700 else 0.0


class Lexicon:
    """Terms (text, whole) with severities: the log-odds of toxic documents that the term shows, at its lower bound.

    Of a stem and a longer term that nearly all its toxic documents hold, the longer one stays, which tells misspellings
    better; of a term and a stem of it that says as much, the stem.
    """

    def __init__(self, counted: list[tuple[str, int, int]], toxic: int, clean: int):
        found, longer = [], Counter()
        for text, a, b in counted:
            odds, ratio = evidence(a, b, toxic, clean)
            if a >= LEAST_DOCS and ratio >= LEAST_RATIO and odds > 0.1:
                found.append((text, a, odds))
                form = text.lstrip("=")
                for n in range(STEM_FROM, len(form) + (text[0] == "=")):
                    longer[form[:n]] = max(longer[form[:n]], a)
        best: dict[str, float] = {}
        self.terms, self.severity = [], []
        for text, a, odds in sorted(found, key=lambda x: (len(x[0].lstrip("=")), x)):
            whole, form = text[0] == "=", text.lstrip("=")
            before = max((best[form[:n]] for n in range(STEM_FROM, len(form) + whole) if form[:n] in best), default=0.0)
            if odds <= before + 0.1 or (not whole and longer[form] >= 0.9 * a):
                continue
            if not whole:
                best[form] = odds
            self.terms.append((form, whole))
            self.severity.append(odds)
        self.automaton = Automaton(self.terms)


def evidence(a: int, b: int, toxic: int, clean: int) -> tuple[float, float]:
    """Lower bound (one in twenty) of the log-odds of a term in ``a`` of ``toxic`` and ``b`` of ``clean`` documents, and G squared."""
    odds = math.log((a + 0.5) / (toxic + 1)) - math.log((b + 0.5) / (clean + 1))
    share = toxic / max(1, toxic + clean)
    ratio = 2 * sum(x * math.log(x / e) for x, e in ((a, (a + b) * share), (b, (a + b) * (1 - share))) if x)
    return odds - 1.645 * math.sqrt(1 / (a + 0.5) + 1 / (b + 0.5)), ratio


def _features(found: Counter, n_words: int, weights: np.ndarray, contexts: np.ndarray) -> tuple[float, float, float]:
    """Evidence of all hits, its share of the words, and the strongest hit."""
    total = most = 0.0
    for (term, misspelt, flags), n in found.items():
        one = weights[term, int(misspelt)] * contexts[flags]
        total += one * n
        most = max(most, one)
    return math.log1p(total), math.log1p(100 * total / (n_words + 50)), most


def _misspelt(lexicon: Lexicon, docs: list[tuple[int, Counter]]) -> np.ndarray:
    """Weights of each term, exact and misspelt. A misspelling starts at the term's severity, less for the doubt, and what
    the sample's documents without the term itself show draws it down (or leaves it)."""
    n = np.array([sum(1 for y, _ in docs if y == k) + 1.0 for k in (0, 1)])
    seen = np.zeros((len(lexicon.terms), 2))
    for y, found in docs:
        sharp = {t for t, wrong, _ in found if not wrong}
        for t in {t for t, wrong, _ in found if wrong} - sharp:
            seen[t, y] += 1
    out = np.zeros((len(lexicon.terms), 2))
    for t, s in enumerate(lexicon.severity):
        doubt = 2.0  # documents that the prior counts for
        rates = [(seen[t, 0] + doubt * math.exp(-s)) / (n[0] + doubt), (seen[t, 1] + doubt) / (n[1] + doubt)]
        rates[1] = min(rates[1], max(rates[0] * math.exp(s), 1e-9))
        out[t] = s, 0.8 * max(0.0, min(s, math.log(rates[1] / rates[0]))) if seen[t, 0] > 3 * max(1.0, seen[t, 1]) or seen[t].sum() else 0.8 * s
    return out


def _contexts(docs: list[tuple[int, Counter]]) -> np.ndarray:
    """A factor for each set of context flags: naive Bayes over the hits of toxic and clean documents, drawn towards what
    is held before any is seen (quoted and reported hits are mostly no abuse, address and crowds are)."""
    prior, strength = {QUOTED: (0.1, 0.5), REPORTED: (0.1, 0.25), ADDRESSED: (0.3, 0.2), CROWDED: (0.4, 0.3)}, 20.0
    total, seen = [0.0, 0.0], {f: [0.0, 0.0] for f in prior}
    for y, found in docs:
        for (_, misspelt, flags), n in found.items():
            if not misspelt:
                total[y] += math.log1p(n)  # a document that repeats itself is no crowd of witnesses
                for f in prior:
                    if flags & f:
                        seen[f][y] += math.log1p(n)
    says = {}
    for f, (toxic, clean) in prior.items():
        p1, p0 = (seen[f][1] + strength * toxic) / (total[1] + strength), (seen[f][0] + strength * clean) / (total[0] + strength)
        says[f] = math.log(p1 / p0)
    return np.array([math.exp(min(0.5, max(-1.6, sum(says[f] for f in says if flags & f)))) for flags in range(16)])


def _curve(x: np.ndarray, labels: np.ndarray, ridge: float = 0.05, rounds: int = 100) -> np.ndarray:
    """Offset and slopes of the logistic curve, by Newton steps; smoothed targets, slopes not below zero."""
    good, bad = int(labels.sum()), int(len(labels) - labels.sum())
    target = np.where(labels == 1, (good + 1) / (good + 2), 1 / (bad + 2))
    free = np.ones(x.shape[1] + 1, bool)
    while True:
        full = np.column_stack([np.ones(len(x)), x])[:, free]
        a = np.zeros(full.shape[1])
        a[0] = math.log((good + 1) / (bad + 1))
        pull = ridge * np.r_[0.0, np.ones(full.shape[1] - 1)]
        loss = lambda v: float(np.logaddexp(0, full @ v).sum() - target @ (full @ v) + (pull * v * v).sum() / 2)  # noqa: E731, B023
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(full @ a, -500, 500)))
            step = np.linalg.solve((full * (p * (1 - p))[:, None]).T @ full + np.diag(pull + 1e-9), full.T @ (target - p) - pull * a)
            size = 1.0
            while size > 1e-6 and loss(a + size * step) > loss(a):
                size /= 2
            a = a + size * step
            if np.abs(size * step).max() < 1e-8:
                break
        if (a[1:] >= 0).all():
            out = np.zeros(len(free))
            out[free] = a
            return out
        free[np.flatnonzero(free)[1 + int(np.argmin(a[1:]))]] = False


def _terms(text: str | None) -> set[str]:
    """The stems of the text's words and, marked by =, the words."""
    words = {folded(t) for t in set(TOKEN.findall(text or ""))}
    out = {"=" + w for w in words if len(w) <= TERM_TO}
    for n in range(STEM_FROM, STEM_TO + 1):
        out.update([w[:n] for w in words if len(w) > n])
    return out


def sample_of(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, text, label, half): at most ``sample`` of the labelled rows, those of least hash of their id, and one of each
    set of near copies, told by the least hash of five words: copies are one witness."""
    chosen = labels.where("doc_id is not null and label in (0, 1)").groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.max(F.coalesce("text", F.lit(""))).alias("text"), F.max("label").cast("int").alias("label"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for batch in batches:
            sketch = []
            for text in batch.column(1).to_pylist():
                made = shingle_hashes(hashes.array(words_of(text)), 5)
                sketch.append(int(made[0].astype(np.int64)) if len(made) else 0)
                hashes.trim()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sketch, pa.int64())], names=["doc_id", "text", "label", "sketch"])

    seen = save(rows.select("doc_id", "text", "label").mapInArrow(run, "doc_id long, text string, label int, sketch long"), "labelled")
    one = seen.groupBy("sketch").agg(F.min("doc_id").alias("doc_id"))
    return seen.join(one, ["sketch", "doc_id"]).select("doc_id", "text", "label", F.pmod(F.xxhash64("sketch", F.lit(7)), F.lit(2)).cast("int").alias("half"))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Lexicon, weights and curve from at most ``sample`` of the labelled rows.

    ``docs`` is (doc_id, text), ``labels`` (doc_id, label 0 or 1); other labels and null ids are left out, an id with
    several labels counts with the greatest. Terms are counted by Spark; the driver gets the TERMS that tell most at most,
    and the counted hits of the sample's documents. The curve is fitted to hits of lexicons that have not seen the
    document: those of the other half. With one class only, the prior is all there is to say.
    """
    tune(docs.sparkSession)
    rows = save(sample_of(docs, labels, sample), "sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, list[int]] = {}

        def told() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), *[pa.array([c[i] for c in seen.values()], pa.int64()) for i in range(4)]], names=["term", "a0", "b0", "a1", "b1"])
            seen.clear()
            return made

        for batch in batches:
            for text, label, half in zip(*(batch.column(c).to_pylist() for c in (0, 1, 2)), strict=True):
                for term in _terms(text):
                    seen.setdefault(term, [0, 0, 0, 0])[2 * half + 1 - label] += 1
                if len(seen) > 200_000:
                    yield told()
        if seen:
            yield told()

    sizes = {(r.half, r.label): r.n for r in rows.groupBy("half", "label").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, clean = [[sizes.get((h, y), 0) for h in (0, 1)] for y in (1, 0)]
    prior = (sum(toxic) + 1) / (sum(toxic) + sum(clean) + 2)
    if not sum(toxic) or not sum(clean):
        return Model(Lexicon([], 0, 0), np.zeros((0, 2)), np.ones(16), None, prior)
    terms = rows.select("text", "label", "half").mapInArrow(count, "term string, a0 long, b0 long, a1 long, b1 long").groupBy("term").agg(*[F.sum(c).alias(c) for c in ("a0", "b0", "a1", "b1")])
    a, b = F.col("a0") + F.col("a1"), F.col("b0") + F.col("b1")
    tells = (a + 0.5) / (sum(toxic) + 1) / ((b + 0.5) / (sum(clean) + 1))
    counted = terms.where(a >= LEAST_DOCS).where(tells > 1.5).orderBy((a * F.log(tells)).desc(), "term").limit(TERMS).collect()
    whole = Lexicon([(r.term, r.a0 + r.a1, r.b0 + r.b1) for r in counted], sum(toxic), sum(clean))
    parts = [Lexicon([(r.term, *((r.a0, r.b0) if h == 0 else (r.a1, r.b1))) for r in counted], toxic[h], clean[h]) for h in (0, 1)]
    found = _found(rows, [whole, *parts])
    weights = _misspelt(whole, [(y, f[0]) for y, _, _, f in found])
    contexts = _contexts([(y, f[0]) for y, _, _, f in found])
    own = [_misspelt(part, [(y, f[1 + h]) for y, half, _, f in found if half == h]) for h, part in enumerate(parts)]
    x = np.array([_features(f[2 - half], n, own[1 - half], contexts) for _, half, n, f in found])
    return Model(whole, weights, contexts, _curve(x, np.array([y for y, *_ in found])), prior)


def _found(rows: DataFrame, lexicons: list[Lexicon]) -> list[tuple[int, int, int, list[Counter]]]:
    """(label, half, words, hits by each lexicon) of the sample's documents, in the order of their ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matchers = [Matcher(x.automaton) for x in lexicons]
        for batch in batches:
            made, n_words = [], []
            for text in batch.column(1).to_pylist():
                tokens = TOKEN.findall(text)
                n_words.append(len(tokens))
                rows = []
                for k, m in enumerate(matchers):
                    if met := m.matched(set(tokens)):
                        rows += [v for (term, misspelt, flags), n in sorted(hits(text, met).items()) for v in (k, term, int(misspelt), flags, n)]
                made.append(np.array(rows, np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(n_words, pa.int64()), pa.array(made, pa.binary())], names=["doc_id", "label", "half", "n", "hits"])

    out = []
    for r in sorted(rows.mapInArrow(run, "doc_id long, label int, half int, n long, hits binary").collect(), key=lambda r: r.doc_id):
        found = [Counter() for _ in lexicons]
        for k, term, misspelt, flags, n in np.frombuffer(r.hits, np.int32).reshape(-1, 5).tolist():
            found[k][term, bool(misspelt), flags] = n
        out.append((r.label, r.half, r.n, found))
    return out


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, n_hits, n_misspelt, n_quoted): the probability of label 1 from the whole text.

    Null and empty texts have no hits and score as such. Rows are kept as they are, repeated ones and such with a null
    id too; an empty table gives none.
    """
    tune(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(model.lexicon.automaton)
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                tokens = TOKEN.findall(text or "")
                met = matcher.matched(set(tokens))
                found = hits(text, met) if met else Counter()
                each = [(n, wrong, flags & QUOTED) for (_, wrong, flags), n in found.items()]
                rows.append((model.score(found, len(tokens)), sum(n for n, _, _ in each), sum(n for n, wrong, _ in each if wrong), sum(n for n, _, q in each if q)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r[0] for r in rows], pa.float64()), *[pa.array([r[i] for r in rows], pa.int64()) for i in (1, 2, 3)]], names=["doc_id", "score", "n_hits", "n_misspelt", "n_quoted"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, score double, n_hits long, n_misspelt long, n_quoted long")
