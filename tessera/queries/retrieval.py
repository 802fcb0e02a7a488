"""Queries: lexical and dense retrieval, fusion, reranking, ranking metrics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import analyze_col
from tessera.operators import dense, fusion, lexical, metrics
from tessera.operators.dense import Filters
from tessera.operators.index_store import LexicalStore
from tessera.sources.scratch import folder

from .tables import BM25, DOC_WORDS, FTS, INDEX, KNN, corpus, questions, stems_sql, table, vector_queries, vectors

K = 10
TOP = 50


def _index(spark: SparkSession, sf_dir: str) -> lexical.Index:
    return lexical.build_index(corpus(spark, sf_dir))


def _bm25(spark, d, k=TOP, index=None) -> DataFrame:
    return lexical.bm25_topk(questions(spark, d), index or _index(spark, d), k)


def _kept_up(spark, d) -> DataFrame:
    """The index of all documents but every tenth, reached by batches: a first load with some stale texts, their corrections and the rest, a compaction, deletions."""
    store, chunks = LexicalStore(spark, folder(spark, "lexical")), corpus(spark, d).select("chunk_id", "content")
    stale = F.when(F.col("chunk_id") % 3 == 1, F.concat(F.lit("stale words before "), "content")).otherwise(F.col("content"))
    store.apply(0, chunks.where("chunk_id % 3 < 2").withColumn("content", stale))
    store.apply(1, chunks.where("chunk_id % 3 > 0"))
    store.compact()
    store.vacuum()  # nobody reads the generation before
    store.apply(2, delete=chunks.where("chunk_id % 10 = 7").select("chunk_id"))
    return store.postings()


def _fts(spark, d, k=TOP, index=None) -> DataFrame:
    return lexical.fts_topk(questions(spark, d), index or _index(spark, d), k)


def _arms(spark, d) -> DataFrame:
    index = lexical.stored(_index(spark, d))
    cols = ["query_id", "arm", "rank", "chunk_id", "score"]
    bm25, fts = _bm25(spark, d, index=index).withColumn("arm", F.lit("bm25")), _fts(spark, d, index=index).withColumn("arm", F.lit("fts"))
    return bm25.select(*cols).union(fts.select(*cols))


def qrels(spark, d) -> DataFrame:
    """Documents that hold a benchmark passage whole."""
    return metrics.holders(corpus(spark, d), questions(spark, d))


def flagship(spark, d) -> DataFrame:
    ndcg = metrics.ndcg_qrels(_bm25(spark, d), qrels(spark, d), K)
    return ndcg.agg(F.count(F.lit(1)).alias("queries"), F.round(F.avg("ndcg"), 6).alias("mean_ndcg"))


def _candidates(spark, d) -> DataFrame:
    q, c = questions(spark, d), corpus(spark, d)
    ranked = _bm25(spark, d, 20).join(q.withColumnRenamed("text", "query"), "query_id")
    return ranked.join(c.select("chunk_id", "content"), "chunk_id").select("query_id", "rank", "chunk_id", "query", "content", "score")


def _prefiltered(spark, d) -> DataFrame:
    f = Filters(element_types=("en", "de"), document_ids=("src0", "src1", "src2"))
    return dense.prefilter(corpus(spark, d), f).select("chunk_id", "document_id", "element_type")


def _postfiltered(spark, d) -> DataFrame:
    f = Filters(min_score=0.2, min_tokens=3)
    ranked = dense.knn(vector_queries(spark, d), vectors(spark, d), dense.fetch_depth(f, K))
    ranked = ranked.join(vectors(spark, d).select("chunk_id", F.col("label").alias("token_count")), "chunk_id")
    return dense.postfilter(ranked, f, K).select("query_id", "rank", "chunk_id", "score", "token_count")


def _recall(spark, d) -> DataFrame:
    """Of the index, against the exact search over the same queries and vectors, with the shares of pairs it looked at and scored."""
    asked, index = vector_queries(spark, d), dense.build_ann(vectors(spark, d), K)
    recall = dense.ann_recall(dense.knn(asked, vectors(spark, d), K), dense.ann_knn(asked, index, K), K)
    both = recall.crossJoin(F.broadcast(dense.ann_effort(asked, index, K)))  # one row each
    return both.select(F.round("recall", 6).alias("recall"), "queries", F.round("looked_at", 6).alias("looked_at"), F.round("scored", 6).alias("scored"))


def _ann(spark, d) -> DataFrame:
    return dense.ann_knn(vector_queries(spark, d), dense.build_ann(vectors(spark, d), K), K)


def _eval_rows(spark, d) -> DataFrame:
    """Ten best texts per question; golds, by id: the question's own passage alone, with its first half and itself again, with one that nothing holds."""
    top = _candidates(spark, d).where("rank <= 10")
    got = top.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "content"))), lambda x: x["content"]).alias("retrieved"))
    half = F.substring("text", F.lit(1), F.floor(F.length("text") / 2).cast("int"))
    gold = F.when(F.col("query_id") % 3 == 0, F.array("text")).when(F.col("query_id") % 3 == 1, F.array("text", half, "text")).otherwise(F.array("text", F.lit("no such words at all")))
    return questions(spark, d).join(got, "query_id", "left").select("query_id", F.coalesce("retrieved", F.array().cast("array<string>")).alias("retrieved"), gold.alias("gold"))


def _hops(spark, d) -> DataFrame:
    gold = questions(spark, d).select("query_id", F.array("text", F.substring("text", 1, 40)).alias("evidence"))
    return metrics.multihop_metrics(_candidates(spark, d).select("query_id", "rank", "content"), gold)


def _replies(spark, d) -> tuple[DataFrame, DataFrame]:
    """Model replies made of the questions: three score lines, a failed call for every seventh."""
    q = questions(spark, d)
    reply = F.concat(F.lit("[1] "), F.expr("query_id % 11"), F.lit("\n[3] "), F.expr("query_id % 7"), F.lit(".5\nnoise\n[3] 12\n[5]: 4"))
    replies = q.select("query_id", F.when(F.col("query_id") % 7 != 3, reply).alias("reply"))
    cands = fusion.rrf(_arms(spark, d), top_k=6).withColumn("dense_score", F.lit(0.25).cast("double"))
    return replies, cands


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "flagship_bm25_ndcg": flagship,
    "lx1_analyze": lambda s, d: corpus(s, d).select("chunk_id", analyze_col("content").alias("t")).select("chunk_id", F.size("t").alias("n_tokens"), F.md5(F.array_join("t", " ")).alias("tokens_md5")),
    "lx2_inverted_index": lambda s, d: _index(s, d).postings,
    "lx2_kept_up_index": _kept_up,
    "lx3_bm25_idf": lambda s, d: lexical.bm25_idf(_index(s, d)).select("term", "df", F.round("idf", 6).alias("idf")),
    "lx4_bm25_topk": lambda s, d: _bm25(s, d, K),
    "lx4_bm25_effort": lambda s, d: lexical.bm25_effort(questions(s, d), _index(s, d), K),
    "lx5_fts_topk": lambda s, d: _fts(s, d, K),
    "dn1_exact_knn": lambda s, d: dense.knn(vector_queries(s, d), vectors(s, d), K),
    "dn2_prefilter": _prefiltered,
    "dn3_postfilter": _postfiltered,
    "dn4_ann_knn": _ann,
    "dn5_ann_recall": _recall,
    "fu1_rrf": lambda s, d: fusion.rrf(_arms(s, d), top_k=K),
    "fu2_weighted_fusion": lambda s, d: fusion.weighted_fusion(_arms(s, d), {"bm25": 0.7, "fts": 0.3}, K),
    "rr1_rerank": lambda s, d: fusion.rerank(_candidates(s, d), K).select("query_id", "rank", "chunk_id", "rerank_score"),
    "rr2_parse_scores": lambda s, d: fusion.parse_scores(*_replies(s, d)),
    "rm1_labels": lambda s, d: metrics.label(_eval_rows(s, d)).select("query_id", F.array_join("labels", "").alias("labels")),
    "rm10_retrieval_metrics": lambda s, d: metrics.retrieval_metrics(_eval_rows(s, d), K),
    "rm11_ndcg_qrels": lambda s, d: metrics.ndcg_qrels(_bm25(s, d), qrels(s, d), K),
    "rm12_multihop_metrics": _hops,
    "sr3_qrels_benchmark": lambda s, d: qrels(s, d).groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_set("chunk_id")), lambda x: x.cast("string")), ",").alias("relevant")),
}

_CANDS = "cands AS (SELECT b.query_id, b.rank, b.chunk_id, q.text AS query, d.text AS content, b.score FROM bm25 b JOIN benchmark q ON q.item_id = b.query_id JOIN documents d ON d.doc_id = b.chunk_id WHERE b.rank <= 20)"
_ARMS = "arms AS (SELECT query_id, 'bm25' AS arm, rank, chunk_id, score FROM bm25 WHERE rank <= 50 UNION ALL SELECT query_id, 'fts', rank, chunk_id, score FROM fts WHERE rank <= 50)"
_QRELS = "qrels AS (SELECT item_id AS query_id, doc_id AS chunk_id FROM benchmark b JOIN documents d ON contains(d.text, b.text) WHERE length(b.text) > 0)"
_RRF = """
rrf_s AS (SELECT query_id, chunk_id, round(sum(1 / (60 + rank)), 6) AS rrf_score, min(struct_pack(arm := arm, rank := rank)) AS f FROM arms GROUP BY ALL),
rrf AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, f)::INTEGER AS rank, chunk_id, rrf_score FROM rrf_s)"""
_SET = r"list_distinct(list_filter(regexp_split_to_array(lower({}), '\s+'), lambda w: w <> ''))"
_NDCG = """
top AS (SELECT query_id, chunk_id, rank FROM bm25 WHERE rank <= 10),
gain AS (SELECT query_id, sum(1 / log2(rank + 1)) AS dcg FROM top JOIN qrels USING (query_id, chunk_id) GROUP BY query_id),
need AS (SELECT query_id, count(*) AS n FROM (SELECT DISTINCT * FROM qrels) GROUP BY query_id),
ndcg AS (SELECT query_id, round(coalesce(dcg, 0) / list_sum(list_transform(range(1, least(n, 10) + 1), lambda i: 1 / log2(i + 1))), 6) AS ndcg
         FROM need LEFT JOIN gain USING (query_id))"""


def _jaccard(a: str, b: str) -> str:
    return f"(CASE WHEN len({a}) + len({b}) = 0 THEN 0 ELSE len(list_intersect({a}, {b})) / (len({a}) + len({b}) - len(list_intersect({a}, {b}))) END)"


_LABELS = f"""
golds AS (SELECT item_id AS query_id, unnest(CASE item_id % 3 WHEN 0 THEN [text] WHEN 1 THEN [text, substr(text, 1, length(text) // 2), text] ELSE [text, 'no such words at all'] END) AS gold FROM benchmark),
gsets AS (SELECT query_id, gold, {_SET.format('gold')} AS g FROM golds),
sets AS (SELECT query_id, rank, {_SET.format('content')} AS r FROM cands WHERE rank <= 10),
pairs AS (SELECT query_id, rank, r, gold, {_jaccard('r', 'g')} >= 0.5 AS near FROM sets JOIN gsets USING (query_id)),
lab AS (SELECT query_id, rank, any_value(r) AS r, max(near::INTEGER) AS l FROM pairs GROUP BY query_id, rank),
per AS (SELECT query_id, list(l ORDER BY rank) AS labels, list_distinct(flatten(list(r))) AS seen FROM lab GROUP BY query_id),
fnd AS (SELECT query_id, count(DISTINCT gold) FILTER (near) AS found FROM pairs GROUP BY query_id),
evalrows AS (SELECT query_id, coalesce(any_value(labels), []) AS labels, coalesce(max(found), 0) / count(DISTINCT gold) AS recall,
               avg(CASE WHEN len(g) > 0 AND len(list_intersect(g, coalesce(seen, []))) >= 0.5 * len(g) THEN 1.0 ELSE 0.0 END) AS covered
             FROM gsets LEFT JOIN per USING (query_id) LEFT JOIN fnd USING (query_id) GROUP BY query_id)"""
_DCG = "coalesce(list_sum(list_transform(range(1, len({0}) + 1), lambda i: {0}[i] / log2(i + 1))), 0)"


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


ORACLES: dict[str, str] = {
    "flagship_bm25_ndcg": _with(INDEX, BM25, _QRELS, _NDCG) + "SELECT count(*) AS queries, round(avg(ndcg), 6) AS mean_ndcg FROM ndcg",
    "lx1_analyze": _with(DOC_WORDS, "wl AS (SELECT DISTINCT unnest(w) AS word FROM docw)", stems_sql("wl")) + """
, p AS (SELECT chunk_id, string_agg(stem, ' ' ORDER BY pos) AS t FROM (SELECT chunk_id, unnest(w) AS word, unnest(range(len(w))) AS pos FROM docw) JOIN stems USING (word) GROUP BY chunk_id)
SELECT chunk_id, len(w)::INTEGER AS n_tokens, md5(CASE WHEN w IS NOT NULL THEN coalesce(t, '') END) AS tokens_md5 FROM docw LEFT JOIN p USING (chunk_id)""",
    "lx2_inverted_index": _with(INDEX) + "SELECT term, chunk_id, tf, dl FROM postings",
    "lx2_kept_up_index": _with(INDEX) + "SELECT term, chunk_id, tf, dl FROM postings WHERE chunk_id % 10 <> 7",
    "lx3_bm25_idf": _with(INDEX.replace(" AS (SELECT", " AS MATERIALIZED (SELECT")) + "SELECT term, df, round(idf, 6) AS idf FROM idfs",
    "lx4_bm25_topk": _with(INDEX, BM25) + "SELECT * FROM bm25 WHERE rank <= 10",
    "lx5_fts_topk": _with(INDEX, FTS) + "SELECT * FROM fts WHERE rank <= 10",
    "dn1_exact_knn": _with(KNN) + "SELECT * FROM knn WHERE rank <= 10",
    "dn2_prefilter": "SELECT doc_id AS chunk_id, source AS document_id, lang AS element_type FROM documents WHERE lang IN ('en', 'de') AND source IN ('src0', 'src1', 'src2')",
    "dn3_postfilter": _with(KNN) + """
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rank)::INTEGER AS rank, chunk_id, score, label AS token_count
FROM knn JOIN embeddings ON vec_id = chunk_id WHERE rank <= 20 AND score >= 0.2 AND label >= 3
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank) <= 10""",
    "fu1_rrf": _with(INDEX, BM25, FTS, _ARMS, _RRF) + "SELECT query_id, rank, chunk_id, rrf_score FROM rrf WHERE rank <= 10",
    "fu2_weighted_fusion": _with(INDEX, BM25, FTS, _ARMS) + """
, n AS (SELECT *, CASE arm WHEN 'bm25' THEN 0.7 ELSE 0.3 END * ((score - min(score) OVER w)
               / CASE WHEN max(score) OVER w > min(score) OVER w THEN max(score) OVER w - min(score) OVER w ELSE 1 END) AS part
        FROM arms WINDOW w AS (PARTITION BY query_id, arm)),
s AS (SELECT query_id, chunk_id, round(sum(part), 6) AS score, min(struct_pack(arm := arm, rank := rank)) AS f FROM n GROUP BY ALL)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, f)::INTEGER AS rank, chunk_id, score FROM s
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, f) <= 10""",
    "rr1_rerank": _with(INDEX, BM25, _CANDS) + f"""
, w AS (SELECT query_id, rank, chunk_id, {_SET.format('query')} AS q, {_SET.format('content')} AS c FROM cands),
s AS (SELECT query_id, rank, chunk_id, CASE WHEN len(q) > 0 THEN round(len(list_intersect(q, c)) / len(q), 4) ELSE 0 END AS rerank_score FROM w)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, rank)::INTEGER AS rank, chunk_id, rerank_score FROM s
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, rank) <= 10""",
    "rr2_parse_scores": _with(INDEX, BM25, FTS, _ARMS, _RRF) + """
SELECT query_id, rank, chunk_id,
       CASE WHEN query_id % 7 = 3 THEN rrf_score WHEN rank = 1 THEN least((query_id % 11) / 10, 1.0) WHEN rank = 3 THEN 1.0 WHEN rank = 5 THEN 0.4 ELSE 0.5 END::DOUBLE AS rerank_score
FROM rrf WHERE rank <= 6""",
    "rm1_labels": _with(INDEX, BM25, _CANDS, _LABELS) + "SELECT query_id, array_to_string(labels, '') AS labels FROM evalrows",
    "rm10_retrieval_metrics": _with(INDEX, BM25, _CANDS, _LABELS) + f"""
SELECT query_id,
  round_even(CASE WHEN len(labels) > 0 THEN list_sum(labels) / len(labels) ELSE 0 END, 4) AS context_precision,
  round_even(covered::DOUBLE, 4) AS context_recall,
  coalesce(list_max(labels), 0)::DOUBLE AS hit_rate,
  round_even(CASE WHEN list_contains(labels, 1) THEN 1 / list_position(labels, 1) ELSE 0 END, 4) AS mrr,
  round_even(CASE WHEN list_contains(labels, 1) THEN {_DCG.format('labels')} / {_DCG.format("list_reverse_sort(labels)")} ELSE 0 END, 4) AS ndcg_at_10,
  round_even(coalesce(list_sum(labels), 0) / 10, 4) AS precision_at_10,
  round_even(recall::DOUBLE, 4) AS recall_at_10,
  (recall = 1)::DOUBLE AS full_support_at_10
FROM evalrows""",
    "rm11_ndcg_qrels": _with(INDEX, BM25, _QRELS, _NDCG) + "SELECT query_id, ndcg FROM ndcg",
    "rm12_multihop_metrics": _with(INDEX, BM25, _CANDS) + """
, f AS (SELECT item_id AS query_id, unnest(list_distinct([regexp_replace(text, '[ \\n]', '', 'g'), regexp_replace(substr(text, 1, 40), '[ \\n]', '', 'g')])) AS fact FROM benchmark),
n AS (SELECT query_id, count(*) AS n FROM f GROUP BY query_id),
h AS (SELECT f.query_id, fact, min(rank) AS rank FROM f JOIN cands c ON c.query_id = f.query_id AND rank <= 10 AND contains(regexp_replace(content, '[ \\n]', '', 'g'), fact) GROUP BY ALL),
p AS (SELECT query_id, sum(1 / rank) AS ap, min(rank) AS first, count(*) AS found FROM h GROUP BY query_id)
SELECT query_id, (coalesce(first, 99) <= 10)::DOUBLE AS hits_at_10, (coalesce(first, 99) <= 4)::DOUBLE AS hits_at_4,
       round(coalesce(ap, 0) / least(n, 10), 6) AS map_at_10, round(coalesce(1 / first, 0), 6) AS mrr_at_10, (coalesce(found, 0) = n)::DOUBLE AS full_support
FROM n LEFT JOIN p USING (query_id)""",
    "sr3_qrels_benchmark": _with(_QRELS) + "SELECT query_id, array_to_string(list(DISTINCT chunk_id ORDER BY chunk_id), ',') AS relevant FROM qrels GROUP BY query_id",
}
