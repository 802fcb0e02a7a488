"""The given tables in the roles the operators expect."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.stemmer import stems_sql
from tessera.functions.text import STOPWORDS
from tessera.sources.io import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """benchmark as questions: (query_id, text)."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as chunks: (chunk_id, content, element_type, document_id)."""
    return spread(table(spark, sf_dir, "documents")).select(
        F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"), F.col("lang").alias("element_type"), F.col("source").alias("document_id")
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding", "label")


def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors asked for: every vec_id divisible by 50."""
    return vectors(spark, sf_dir).where("chunk_id % 50 = 0").select(F.col("chunk_id").alias("query_id"), "embedding")


# ── the same in DuckDB ─────────────────────────────────────────────────────

STOPS = "[" + ", ".join(f"'{w}'" for w in STOPWORDS) + "]"


def sql_list(values) -> str:
    return "[" + ", ".join("'" + str(v).replace("'", "''") + "'" for v in values) + "]"


def sql_words(text: str) -> str:
    """Lower-case words without stopwords as a DuckDB expression; stems_sql() has the stems."""
    return rf"list_filter(regexp_extract_all(lower({text}), '[\p{{L}}\p{{N}}]+'), lambda w: NOT list_contains({STOPS}, w))"


DOC_WORDS = f"docw AS (SELECT doc_id AS chunk_id, {sql_words('text')} AS w FROM documents)"

INDEX = f"""
{DOC_WORDS},
qw AS (SELECT item_id AS query_id, {sql_words('text')} AS w FROM benchmark),
wl AS (SELECT DISTINCT word FROM (SELECT unnest(w) AS word FROM docw UNION ALL SELECT unnest(w) AS word FROM qw)),
{stems_sql('wl')},
stats AS (SELECT count(*) AS n_chunks, avg(len(w)) AS avgdl FROM docw),
terms AS (SELECT chunk_id, dl, stem AS term FROM (SELECT chunk_id, len(w) AS dl, unnest(w) AS word FROM docw) JOIN stems USING (word)),
postings AS (SELECT term, chunk_id, count(*)::INTEGER AS tf, any_value(dl)::INTEGER AS dl FROM terms GROUP BY term, chunk_id),
dfs AS (SELECT term, count(*) AS df FROM postings GROUP BY term),
raws AS (SELECT term, df, ln(n_chunks - df + 0.5) - ln(df + 0.5) AS raw FROM dfs, stats),
idfs AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raws) ELSE raw END AS idf FROM raws),
qterms AS (SELECT query_id, stem AS term, count(*) AS qtf FROM (SELECT query_id, unnest(w) AS word FROM qw) JOIN stems USING (word) GROUP BY ALL)"""

BM25 = """
bm25_s AS (
  SELECT query_id, chunk_id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
  FROM postings JOIN qterms USING (term) JOIN idfs USING (term), stats GROUP BY query_id, chunk_id),
bm25 AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INTEGER AS rank, chunk_id, score
  FROM bm25_s WHERE score > 0)"""

FTS = """
fts_s AS (SELECT query_id, chunk_id, round(sum(tf) * 0.1, 6) AS score FROM postings JOIN qterms USING (term) GROUP BY query_id, chunk_id),
fts AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INTEGER AS rank, chunk_id, score FROM fts_s)"""

KNN = """
vq AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 50 = 0 AND embedding IS NOT NULL),
knn_s AS (SELECT query_id, vec_id AS chunk_id, round(list_cosine_similarity(q, embedding::DOUBLE[]), 6) AS score
          FROM vq, embeddings WHERE embedding IS NOT NULL),
knn AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INTEGER AS rank, chunk_id, score FROM knn_s)"""
