"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinrank.llm import (bpe, conversation, decontaminate, exact_dedup, lexical_search, line_dedup, lm_score, quality, simhash,
                         token_count, topk, toxicity, warc)
from kinrank.llm.shared import held_out, table, written


def _tokenizer(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents", "doc_id", "text"),
                                        table(spark, sf_dir, "benchmark", "item_id", "text"))
    hit = decontaminate.n_hit()
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
                        (hit > 0).alias("contaminated"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    labels = table(spark, sf_dir, "labels", "doc_id", "quality")
    model = quality.fit(docs, quality.sample(labels, "quality", held_out(3)))
    return quality.scores(docs, model).select("doc_id", held_out(3).alias("held_out"), "score",
                                              (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(table(spark, sf_dir, "documents", "doc_id", "text"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = line_dedup.dedup_lines(table(spark, sf_dir, "documents", "doc_id", "text", "source"))
    count = [F.col(f"_{c}").cast("long").alias(c) for c in ("n_lines", "n_boilerplate", "n_removed")]
    return cleaned.select("doc_id", *count, F.col("_whole_copy").alias("whole_copy"), F.sha2("text", 256).alias("text_sha256"))


def op5_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.integer_vectors(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))
    return topk.top_k(vectors, F.col("vec_id") % 100 == 0)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.token_counts(table(spark, sf_dir, "documents", "doc_id", "text"),
                                    _tokenizer("byte_bpe_50k.json"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    labels = table(spark, sf_dir, "labels", "doc_id", "toxic")
    model = toxicity.fit(docs, toxicity.sample(labels, "toxic", held_out(3)))
    return toxicity.toxic_passages(docs, model).select(
        "doc_id", held_out(3).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"),
        F.col("n_passages").cast("long").alias("n_passages"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures = written(warc.round_trip(table(spark, sf_dir, "pages", "page_id", "url", "html")).select(
        "capture", warc.page_id_of(F.col("metadata")).cast("long").alias("page_id"),
        F.col("response.payload_bytes").alias("payload_bytes"),
        F.col("response.payload_digest").alias("payload_digest"), F.col("response.type").alias("record_type"),
        F.col("response.refers_to").alias("target")))
    original = captures.select(F.col("capture").alias("target"), F.col("page_id").alias("refers_to"))
    return captures.join(original, "target", "left").select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents", "doc_id", "text"), _tokenizer("word_bpe_49k.json"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(table(spark, sf_dir, "documents", "doc_id", "text"),
                                 table(spark, sf_dir, "benchmark", "item_id", "text"))


def op12_conversation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    return conversation.with_all_ids(conversation.digest(conversation.repair(conversation.damaged(rows))), rows)


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.classes(table(spark, sf_dir, "documents", "doc_id", "text"), "largest")


QUERIES = {f.__name__: f for f in (
    op1_decontamination, op2_quality, op3_lm_score, op4_line_dedup, op5_exact_topk, op6_token_counts, op7_toxicity,
    op8_warc, op9_simhash, op10_bpe, op11_lexical_search, op12_conversation, op13_exact_dedup)}

_TOPK_SQL = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 1024)) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, x.vec_id, list_dot_product(q.v, x.v)::BIGINT AS score
      FROM e q JOIN e x ON q.vec_id <> x.vec_id AND len(q.v) = len(x.v) WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM p)
SELECT query_id, n::INTEGER AS rank, vec_id, score FROM r WHERE n <= 10"""

_B32 = "||".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (((b[{(5 * i) // 8 + 1}] * 256 + b[{min((5 * i) // 8 + 2, 20)}]) "
    f">> {16 - 5 - (5 * i) % 8}) & 31), 1)" for i in range(32))
_WARC_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS hex FROM p),
b AS (SELECT *, list_transform(range(20), lambda i: ('0x' || substr(hex, 1 + 2 * i, 2))::INTEGER) AS b FROM h),
f AS (SELECT *, min(page_id) OVER (PARTITION BY hex) AS first FROM b)
SELECT page_id, payload_bytes, {_B32} AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to FROM f"""

_DECONTAMINATION_SQL = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM documents),
bw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM benchmark),
bg AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM bw WHERE len(w) > 0)),
ns AS (SELECT DISTINCT n FROM bg),
dg AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, ns WHERE len(w) >= n)),
m AS (SELECT dg.doc_id, dg.i, dg.n, bg.item_id FROM dg JOIN bg ON dg.n = bg.n AND dg.g = bg.g),
hw AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS k FROM m) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items
       FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY doc_id)
SELECT dw.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hw USING (doc_id) LEFT JOIN it USING (doc_id)"""

ORACLE = {
    "op1_decontamination": _DECONTAMINATION_SQL,
    "op4_line_dedup": line_dedup.line_dedup_sql(),
    "op5_exact_topk": _TOPK_SQL,
    "op8_warc": _WARC_SQL,
    "op11_lexical_search": lexical_search.search_sql(),
    "op12_conversation": conversation.repair_sql(),
    "op13_exact_dedup": exact_dedup.exact_dedup_sql(),
}
