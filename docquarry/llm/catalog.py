"""The queries of this package, each over its whole table, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry import scratch
from docquarry.llm import exact_dedup, hnsw, line_dedup, lm, mixing, packing, quality, simhash, token_files, toxicity
from docquarry.llm.tokens import vocabulary_file
from docquarry.session import spread


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_copies(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.embedding_dedup(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_docs(spark, sf_dir), vocabulary_file("byte_bpe_50k.json"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    to = scratch.new_path(spark, "token-files")
    token_files.write_tokens(_docs(spark, sf_dir), vocabulary_file("word_bpe_49k.json"), to)
    return token_files.read_digests(spark, to)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_dedup(_docs(spark, sf_dir)).select("doc_id", "fingerprint", "component_id")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.line_dedup(_docs(spark, sf_dir))
    return found.select(
        F.col("row.doc_id").alias("doc_id"),
        F.col("n_lines").cast("long").alias("n_lines"),
        F.size("removed_lines").cast("long").alias("n_removed"),
        F.array_join(F.col("removed_lines").cast("array<string>"), ",").alias("removed"),
        F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"),
    )


def op9_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(_docs(spark, sf_dir))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_docs(spark, sf_dir)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_quality": op2_quality,
    "op3_toxicity": op3_toxicity,
    "op4_embedding_dedup": op4_embedding_dedup,
    "op5_packing": op5_packing,
    "op6_token_files": op6_token_files,
    "op7_simhash": op7_simhash,
    "op8_line_dedup": op8_line_dedup,
    "op9_lm": op9_lm,
    "op10_exact_dedup": op10_exact_dedup,
}

SQL = {
    "op1_mixing": r"""
        WITH d AS (
          SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
        ), s AS (
          SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
        ), r AS (
          SELECT source, source_size, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS w, CAST(3 * source_size AS DOUBLE) AS cap FROM s
        ), l AS (
          SELECT *, row_number() OVER (ORDER BY cap / w, source NULLS LAST) AS k,
                 (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
                 / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r
        ), t AS (
          SELECT source, source_size, CASE WHEN source_size = 0 THEN 0.0 ELSE least(cap, coalesce(w * (SELECT arg_min(level, k) FROM l WHERE cap / w >= level), cap)) END AS target FROM l
        ), q AS (
          SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN least(target / source_size, 3.0) ELSE 0.0 END AS rate,
                 CAST('0x' || substr(md5('7:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) / CAST(1::BIGINT << 52 AS DOUBLE) AS u
          FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
        )
        SELECT doc_id, size, source_size, CAST(target AS DOUBLE) AS target, CAST((floor(rate) + CAST(u < rate - floor(rate) AS INT)) * size AS BIGINT) AS taken FROM q
    """,
    "op4_embedding_dedup": r"""
        WITH RECURSIVE v AS (
          SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
          WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
        ), p AS (
          SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.98
        ), reach(node, root) AS (
          SELECT vec_id, vec_id FROM v UNION SELECT p.b, r.root FROM reach r JOIN p ON p.a = r.node
        ), n AS (
          SELECT a, count(*) AS n_links FROM p GROUP BY a
        ), c AS (
          SELECT node, min(root) AS root FROM reach GROUP BY node
        )
        SELECT vec_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, coalesce(root, vec_id) AS component_id, coalesce(root, vec_id) = vec_id AS kept
        FROM embeddings LEFT JOIN n ON a = vec_id LEFT JOIN c ON node = vec_id
    """,
    "op8_line_dedup": r"""
        WITH docs AS (
          SELECT doc_id, text, left(md5(coalesce(text, '')), 15) AS digest,
                 string_split(regexp_replace(replace(coalesce(text, ''), chr(31), chr(31) || '0'), '(\n|[.!?] +)', '\1' || chr(31) || '1', 'g'), chr(31) || '1') AS l FROM documents
        ), w AS (
          SELECT doc_id, digest, unnest(range(0, len(l) - 2)) AS p, l FROM (SELECT DISTINCT doc_id, digest, l FROM docs) WHERE len(l) >= 3
        ), h AS (
          SELECT doc_id, digest, p, trim(l[p + 1], ' ' || chr(10)) || chr(10) || trim(l[p + 2], ' ' || chr(10)) || chr(10) || trim(l[p + 3], ' ' || chr(10)) AS h FROM w
        ), later AS (
          SELECT doc_id, digest, p, row_number() OVER (PARTITION BY h ORDER BY doc_id NULLS LAST, digest, p) AS n FROM h
        ), gone AS (
          SELECT DISTINCT doc_id, digest, unnest([p, p + 1, p + 2]) AS i FROM later WHERE n > 1
        ), lists AS (
          SELECT doc_id, digest, list(i ORDER BY i) AS r FROM gone GROUP BY ALL
        )
        SELECT docs.doc_id, CAST(len(l) AS BIGINT) AS n_lines, CAST(coalesce(len(r), 0) AS BIGINT) AS n_removed,
               coalesce(array_to_string(r, ','), '') AS removed,
               sha256(CASE WHEN r IS NULL THEN text ELSE replace(coalesce(array_to_string(list_filter(l, lambda x, i: NOT list_contains(r, i - 1)), ''), ''), chr(31) || '0', chr(31)) END) AS text_sha256
        FROM docs LEFT JOIN lists ON docs.digest = lists.digest AND docs.doc_id IS NOT DISTINCT FROM lists.doc_id
    """,
    "op10_exact_dedup": r"""
        WITH n AS (
          SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
        )
        SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
               doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
        FROM n
    """,
}
