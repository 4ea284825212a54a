"""One query per operator over its whole table, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from factlake.llm import (
    bpe,
    divergence,
    extraction,
    lines,
    mining,
    packing,
    quality,
    repeats,
    secrets,
    sharding,
    simhash,
    topk,
    winnow,
)
from factlake.llm.common import sha256_hex, table

SPECIAL_ID = 50256


def quality_rules(spark: SparkSession, sf_dir: str) -> list[quality.Rule]:
    return quality.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = quality_rules(spark, sf_dir)
    counts = F.col("counts")
    return quality.judged(docs, rules, "counts", "kept").select(
        "doc_id",
        *[counts[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines")],
        counts["n_repeat_words"].alias("n_repeat_words"),
        quality.base_failed(counts).alias("base_failed"),
        "kept",
    )


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", simhash.hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id"
    )


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    spans = F.col("spans")

    def of_kind(*kinds: str):
        return F.filter(spans, lambda s: s["kind"].isin(*kinds))

    return docs.select("doc_id", secrets.secret_spans(F.col("text")).alias("spans")).select(
        "doc_id",
        *[F.size(of_kind(k)).cast("bigint").alias(f"n_{k}") for k in secrets.BASE_KINDS],
        sha256_hex(secrets.written(of_kind(*secrets.BASE_KINDS))).alias("base_sha256"),
        secrets.written(spans).alias("spans"),
    )


def op4_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_groups(table(spark, sf_dir, "documents"))


def op5_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    text = extraction.main_text(F.col("html"), extraction.fit(pages)).alias("text")
    return pages.select("page_id", "url", text).select(
        "*", F.length("text").cast("bigint").alias("n_chars")
    )


def op1_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = repeats.without_repeats(table(spark, sf_dir, "documents"))
    return done.select(
        "doc_id", "n_bytes", "n_removed", "n_spans", sha256_hex(F.col("kept")).alias("kept_sha256")
    )


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    done = bpe.round_trip(F.col("text"), path, public_tokenizers.PATTERN).alias("done")
    return table(spark, sf_dir, "documents").select("doc_id", done).select("doc_id", "done.*")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.quantised(table(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors, F.col("vec_id") % 100 == 0)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = mining.quantised(table(spark, sf_dir, "embeddings").withColumn("label", label))
    return mining.hard_negatives(vectors, F.col("vec_id") % 100 == 0)


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = winnow.contamination(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    )
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        sha256_hex(F.array_join("items", ",")).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(
        table(spark, sf_dir, "documents"),
        public_tokenizers.path("byte_bpe_50k.tiktoken"),
        public_tokenizers.PATTERN,
        special=SPECIAL_ID,
    )


QUERIES = {
    "op10_quality_rules": op10_quality_rules,
    "op4_lines": op4_lines,
    "op5_extraction": op5_extraction,
    "op1_repeats": op1_repeats,
    "op2_bpe": op2_bpe,
    "op3_sharding": op3_sharding,
    "op7_topk": op7_topk,
    "op8_secrets": op8_secrets,
    "op9_simhash": op9_simhash,
    "op6_packing": op6_packing,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_decontamination": op12_decontamination,
    "op13_divergence": op13_divergence,
}
ORACLES: dict[str, str] = {
    "op7_topk": """
        WITH rows AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS x
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scored AS (
            SELECT q.vec_id AS query_id, c.vec_id,
                   list_inner_product(q.x, c.x)::BIGINT AS score
            FROM rows q JOIN rows c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id
        ), ranked AS (
            SELECT *, row_number() OVER (
                PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank
            FROM scored
        )
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
    """,
    "op11_hard_negatives": """
        WITH rows AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x,
                   CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label
            FROM embeddings
            WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scored AS (
            SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same,
                   list_inner_product(a.x, r.x)::BIGINT AS score
            FROM rows a JOIN rows r ON a.vec_id % 100 = 0 AND a.vec_id <> r.vec_id
        ), positives AS (
            SELECT anchor_id, vec_id AS positive_id, score AS positive_score
            FROM scored WHERE same
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
        )
        SELECT p.anchor_id, positive_id, vec_id AS negative_id, positive_score,
               score AS negative_score,
               row_number() OVER (PARTITION BY p.anchor_id, positive_id
                                  ORDER BY score DESC, vec_id)::INT AS rank
        FROM positives p JOIN scored s ON p.anchor_id = s.anchor_id AND NOT same
         AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
        QUALIFY rank <= 5
    """,
    "op12_decontamination": r"""
        WITH item_words AS (
            SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
            FROM benchmark WHERE text IS NOT NULL
        ), spans AS (
            SELECT DISTINCT item_id, least(len(w), 10) AS n,
                   unnest([array_to_string(w[i : i + least(len(w), 10) - 1], ' ')
                           for i in range(1, len(w) - least(len(w), 10) + 2)]) AS span
            FROM item_words WHERE len(w) > 0
        ), docs AS (
            SELECT row_number() OVER () AS r, doc_id,
                   regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
            FROM documents
        ), starts AS (
            SELECT r, n, w, unnest(range(1, len(w) - n + 2)) AS i
            FROM docs, (SELECT DISTINCT n FROM spans) WHERE len(w) >= n
        ), hits AS (
            SELECT r, i, s.n, item_id
            FROM starts d JOIN spans s ON d.n = s.n AND s.span = array_to_string(w[i : i + d.n - 1], ' ')
        ), covered AS (
            SELECT r, count(DISTINCT place) AS n_hit
            FROM (SELECT r, unnest(range(i, i + n)) AS place FROM hits) GROUP BY r
        ), items AS (
            SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
            FROM (SELECT DISTINCT r, item_id::VARCHAR AS id FROM hits) GROUP BY r
        )
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit,
               coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AS contaminated
        FROM docs LEFT JOIN covered USING (r) LEFT JOIN items USING (r)
    """,
    "op13_divergence": r"""
        WITH docs AS (
            SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang,
                   coalesce(source, '') AS source,
                   regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
            FROM documents
        ), terms AS (
            SELECT r, lang, source, unnest(w) AS term FROM docs
        ), kept AS (
            SELECT lang, term, count(*) AS n FROM terms
            GROUP BY lang, term HAVING count(DISTINCT r) >= 3
        ), langs AS (
            SELECT lang, sum(n) + count(*) AS total FROM kept GROUP BY lang
        ), groups AS (
            SELECT DISTINCT lang, source FROM docs
        ), found AS (
            SELECT lang, source, term, count(*) AS c FROM terms GROUP BY ALL
        ), counts AS (
            SELECT lang, source, term, k.n, coalesce(c, 0) AS c
            FROM groups JOIN kept k USING (lang) LEFT JOIN found USING (lang, source, term)
        ), shares AS (
            SELECT lang, source, term, c,
                   1 + 1000000000::HUGEINT * (c + 1)
                       // sum(c + 1) OVER (PARTITION BY lang, source) AS p,
                   1 + 1000000000::HUGEINT * (n + 1) // total AS q
            FROM counts JOIN langs USING (lang)
        ), pairs AS (
            SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
            FROM shares a JOIN shares b
              ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
            GROUP BY ALL
        ), rows AS (
            SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
            FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
            LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
            UNION ALL
            SELECT lang, source, 'term', term, (p - q) * (p - q) // q
            FROM shares WHERE c > 0 AND p > q
        )
        SELECT lang, source, part, item, value::BIGINT AS value,
               row_number() OVER (PARTITION BY lang, source, part
                                  ORDER BY value DESC, item)::INT AS rank
        FROM rows QUALIFY part = 'pair' OR rank <= 200
    """,
}
