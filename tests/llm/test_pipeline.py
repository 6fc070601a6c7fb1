"""The pipeline's stages against what each must do to its own input."""

import re
import zlib

import corpus_pipeline
from parcelworks.llm import secrets_scan

DATA = "/root/testdata/sf0.01"


def words(text):
    return (text or "").encode().lower().split()


def test_stages_of_odd_rows(spark):
    """Nulls in any column, empty and long texts, repeated rows and ids, columns that operators use, and no rows."""
    kind = "doc_id long, text string, lang string, source string, n_chars long, row string, score double, secrets string, block long, title string"
    long = "some words that go on " * 20_000
    rows = [(1, long), (2, long), (2, long), (3, None), (None, None), (None, "a text with password = abcdefghijkl0123"), (4, ""), (5, ""), (6, "token: abcdefghijkl0123 and more")]
    rows = [(i, t, None, None, None, "r", None, "s", None, "t") for i, t in rows]
    for docs in (spark.createDataFrame(rows, kind), spark.createDataFrame([], kind)):
        kept = docs
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, kept, DATA)
            assert out.columns == kept.columns
            kept = spark.createDataFrame(out.collect(), kind)
            if name.startswith("n-gram") and docs.count():
                assert [r.doc_id for r in kept.where("text like 'some%'").collect()] in ([1], [])
        assert not kept.where("text like '%abcdefghijkl0123%'").count()
        assert {r.doc_id for r in corpus_pipeline.STAGES[-1][1](spark, kept, DATA).collect()} == {r.doc_id for r in kept.collect()}


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kinds = docs.dtypes
    texts = {r.doc_id: r.text for r in docs.collect()}
    outputs = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, DATA)
        assert docs.dtypes == kinds
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        outputs.append({r.doc_id: r for r in docs.collect()})
    good, single, clean = outputs
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    held = [i for i in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((i in good) == (labels[i] == 1) for i in held) / len(held) > 0.9
    sets = {i: {tuple(w[j : j + 5]) for j in range(len(w) - 4)} or ({tuple(w)} if w else set()) for i in good for w in [words(texts[i])]}
    ids = sorted(sets, key=lambda i: len(sets[i]))
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for at, i in enumerate(ids):
        for j in ids[at + 1 :]:
            if 80 * len(sets[j]) > 100 * len(sets[i]):
                break
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    assert set(single) == {i for i in ids if find(i) == i}
    for i, r in clean.items():
        for rule in secrets_scan.BASE:
            assert not any(len(m.group(rule.group)) >= rule.least for m in re.finditer(rule.pattern, r.text))
        assert r.n_chars == len(r.text)
    assert set(clean) == set(single) and {i for i in clean if clean[i].text != texts[i]}
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, DATA).collect()
    assert {p.doc_id for p in pieces} == set(clean)
    total = {p.doc_id: p.doc_tokens for p in pieces}
    assert sum(p.length for p in pieces) == sum(total.values())
