"""The operators as named queries over whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelworks.llm import audit, html_text, jaccard, katz, packing, quality, secrets_scan, sentencepiece_bpe, topk, toxicity, urls, whitening, winnow
from parcelworks.llm.common import fold, save


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = save(topk.quantised(_read(spark, sf_dir, "embeddings")), "vectors")
    return topk.top_k(vectors.where("vec_id % 50 = 0"), vectors, 5)


def op2_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join_groups(_read(spark, sf_dir, "documents"), k=3, num=90, den=100, links=True)


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(_read(spark, sf_dir, "pages"))


def op4_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    out = fold(F.col("doc_id"), 7) == 2
    model = katz.Katz(docs, ~out)
    return model.score().select("doc_id", out.alias("held_out"), "n_tokens", "n_known", F.lit(model.stats.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def classifier(spark: SparkSession, sf_dir: str) -> quality.Classifier:
    labels = _read(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label")).where(fold(F.col("doc_id"), 5) != 0)
    return quality.train(_read(spark, sf_dir, "documents").select("doc_id", "text"), labels)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.score(_read(spark, sf_dir, "documents"), classifier(spark, sf_dir))
    return scored.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's label is the quality label of the document that the last number of its path names (its article)."""
    pages = _read(spark, sf_dir, "pages")
    host, path = urls.host_and_path(F.col("url"))
    named = F.expr("try_cast(regexp_extract(path, '([0-9]+)[^0-9]*$', 1) as bigint)")
    of_page = pages.select(F.col("page_id").cast("long").alias("page_id"), path.alias("path")).select("page_id", named.alias("doc_id"))
    labels = of_page.join(_read(spark, sf_dir, "labels"), "doc_id").select("page_id", F.col("quality").alias("label"))
    return urls.judge(pages, labels)


def op7_winnow(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = winnow.fingerprinted(_read(spark, sf_dir, "documents"))
    return made.select("doc_id", "n_chars", "edited_sha256", winnow.printed(F.col("marks")).alias("fingerprint"), winnow.printed(F.col("edited_marks")).alias("edited_fingerprint"), "near_edited", "near_next")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def pack_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as instruction data: only the assistant's tokens bear loss, and a sequence holds at most 1,024
    tokens, six turns and 640 loss-bearing tokens. A null text is empty; a null or unknown role bears no loss; rows keep
    their conv_id and turn as they are, null or repeated ones too."""
    turns = _read(spark, sf_dir, "conversations")
    free = F.when(F.col("role") == "assistant", 0).otherwise((1 << 31) - 1)
    packed = packing.pack(turns.select("conv_id", "turn", "text", free.alias("free")), tokenizer("byte_bpe_50k.json"), limit=1024, max_segments=6, max_loss=640, id_col="conv_id", loss_from="free", carried=("turn",))
    return packed.select(F.col("doc_id").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *[c for c in packed.columns if c not in ("doc_id", "turn")])


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_bpe.encode_decode(_read(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets_scan.find_secrets(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("secrets", lambda s: s["kind"].isin(*[r.kind for r in secrets_scan.BASE]))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans"))


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    labels = _read(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label")).where(fold(F.col("doc_id"), 5) != 0)
    scored = toxicity.score(docs, toxicity.train(docs, labels))
    return scored.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_hits", "n_misspelt", "n_quoted")


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(whitening.quantised(_read(spark, sf_dir, "embeddings")), 4)


def op13_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (op1_topk, op2_jaccard, op3_html, op4_katz, op5_quality, op6_urls, op7_winnow, op8_packing, op9_sentencepiece, op10_secrets, op11_toxicity, op12_whitening, op13_audit, pack_conversations)}

ORACLE_SQL = {
    "op1_topk": """
WITH v AS (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
e AS (SELECT row, vec_id, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM v),
s AS (
  SELECT q.row AS q_row, q.vec_id AS query_id, c.row, c.vec_id, CAST(sum(q.x * c.x) AS BIGINT) AS score
  FROM e q JOIN e c ON q.i = c.i AND q.vec_id <> c.vec_id
  WHERE q.vec_id % 50 = 0 GROUP BY ALL),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY q_row ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 5""",
    "op2_jaccard": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents WHERE doc_id IS NOT NULL),
s AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: concat(w[i], ' ', w[i + 1], ' ', w[i + 2])) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y, o = c.n AND o = d.n AS same FROM p JOIN n c ON c.doc_id = x JOIN n d ON d.doc_id = y WHERE 100 * o >= 90 * (c.n + d.n - o)),
e AS (SELECT x, y, same FROM l UNION ALL SELECT y, x, same FROM l),
r AS (SELECT doc_id, doc_id AS root FROM w UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.doc_id),
c AS (SELECT doc_id, min(root) AS component_id FROM r GROUP BY 1),
k AS (SELECT x AS doc_id, count(*) AS links, count(*) FILTER (WHERE same) AS same FROM e GROUP BY 1)
SELECT c.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id, CAST(1 + coalesce(k.same, 0) AS BIGINT) AS copies, CAST(coalesce(k.links, 0) AS BIGINT) AS n_links
FROM c LEFT JOIN n ON n.doc_id = c.doc_id LEFT JOIN k ON k.doc_id = c.doc_id""",
    "op13_audit": r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT row, doc_id, part, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM d),
k AS (SELECT text, min(doc_id) AS first FROM d GROUP BY 1),
l AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY 1),
f AS (
  SELECT part, coalesce(l.good, 0) AS good, coalesce(l.toxic, 0) AS toxic,
    CAST(len(w) < 100 AS INT) + 2 * CAST(100 * len(list_distinct(w)) < 80 * len(w) AS INT)
    + 4 * CAST(100 * length(regexp_replace(w.text, '[^A-Z]', '', 'g')) > 10 * length(w.text) AS INT)
    + 8 * CAST(regexp_matches(w.text, '[#$%&*|]') AS INT) + 16 * CAST(coalesce(w.doc_id > k.first, false) AS INT) AS failed
  FROM w JOIN k ON k.text = w.text LEFT JOIN l ON l.doc_id = w.doc_id),
c AS (SELECT part, failed, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY 1, 2),
p AS (
  SELECT CAST('' AS VARCHAR) AS filter_order, 0 AS used, 0 AS step
  UNION ALL
  SELECT filter_order || letter, used | bit, step + 1 FROM p, (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS v(letter, bit) WHERE used & bit = 0),
o AS (SELECT filter_order FROM p WHERE step = 5),
s AS (
  SELECT o.filter_order, p.step, CAST(1 << (ascii(substr(o.filter_order, p.step, 1)) - 65) AS INT) AS own, p.used - CAST(1 << (ascii(substr(o.filter_order, p.step, 1)) - 65) AS INT) AS earlier
  FROM o JOIN p ON p.step BETWEEN 1 AND 5 AND starts_with(o.filter_order, p.filter_order)),
r AS (
  SELECT part, filter_order, CAST(step AS INT) AS step,
    CAST(sum(n) FILTER (WHERE failed & (earlier | own) = 0) AS BIGINT) AS kept,
    CAST(sum(n) FILTER (WHERE failed & earlier = 0 AND failed & own <> 0) AS BIGINT) AS removed,
    CAST(sum(n) FILTER (WHERE failed & earlier <> 0 AND failed & own <> 0) AS BIGINT) AS redundant,
    CAST(sum(n) FILTER (WHERE failed = own) AS BIGINT) AS unique_fails,
    CAST(sum(good) FILTER (WHERE failed & earlier = 0 AND failed & own <> 0) AS BIGINT) AS good_lost,
    CAST(sum(toxic) FILTER (WHERE failed & earlier = 0 AND failed & own <> 0) AS BIGINT) AS toxic_lost, any_value(own) AS own
  FROM c, s GROUP BY ALL),
z AS (SELECT part, filter_order, step, coalesce(kept, 0) AS kept, coalesce(removed, 0) AS removed, coalesce(redundant, 0) AS redundant, coalesce(unique_fails, 0) AS unique_fails, coalesce(good_lost, 0) AS good_lost, coalesce(toxic_lost, 0) AS toxic_lost, own FROM r)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM z""",
}
