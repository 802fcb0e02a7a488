"""Ranking and answer metrics as column expressions and small aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.sources.scratch import kept, small_or_shuffled

JACCARD = 0.5


def _r4(c: Column) -> Column:
    return F.bround(c, 4)


# ── over (query_id, retrieved ARRAY<STRING> in rank order, gold ARRAY<STRING>) ──


def labels_col(retrieved: str = "retrieved", gold: str = "gold") -> Column:
    """RM1: per retrieved text, 1 if its word set has Jaccard >= 0.5 with any gold context's."""

    def labels(got: Column, golds: Column) -> Column:
        near = lambda r: F.exists(golds, lambda g: T.jaccard_col(r, g) >= JACCARD)
        return F.transform(got, lambda r: F.when(near(r), 1).otherwise(0))

    return T.bind(labels, F.transform(retrieved, T.word_set_col), F.transform(gold, T.word_set_col))


def label(rows: DataFrame) -> DataFrame:
    """RM1: rows with the column labels."""
    return rows.withColumn("labels", labels_col())


def context_precision(labels: str = "labels") -> Column:
    """RM2: share of retrieved texts that are relevant."""
    s = F.aggregate(labels, F.lit(0), lambda a, x: a + x)
    return F.when(F.size(labels) > 0, s / F.size(labels)).otherwise(0.0)


def context_recall(retrieved: str = "retrieved", gold: str = "gold") -> Column:
    """RM3: share of gold contexts of whose words at least half were retrieved anywhere; 1 without gold."""

    def share(seen: Column, golds: Column) -> Column:
        covered = lambda w: (F.size(w) > 0) & (F.size(F.array_intersect(w, seen)) >= 0.5 * F.size(w))
        return F.size(F.filter(golds, covered)) / F.size(golds)

    seen = F.array_distinct(F.flatten(F.transform(retrieved, T.word_set_col)))
    return F.when(F.size(gold) <= 0, 1.0).otherwise(T.bind(share, seen, F.transform(gold, T.word_set_col)))


def hit_rate(labels: str = "labels") -> Column:
    """RM4: 1 if anything relevant was retrieved."""
    return F.coalesce(F.array_max(labels), F.lit(0)).cast("double")


def mrr(labels: str = "labels") -> Column:
    """RM5: 1 / rank of the first relevant text."""
    at = F.array_position(labels, 1)
    return F.when(at > 0, 1 / at).otherwise(0.0)


def _dcg(values: Column) -> Column:
    return F.aggregate(F.transform(values, lambda x, i: x / F.log2(i + 2.0)), F.lit(0.0), lambda a, x: a + x)


def ndcg_at_k(k: int, labels: str = "labels") -> Column:
    """RM6: the ideal is made of the retrieved labels themselves."""
    top = F.slice(labels, 1, k)
    ideal = F.slice(F.sort_array(labels, asc=False), 1, k)
    return F.when(_dcg(ideal) > 0, _dcg(top) / _dcg(ideal)).otherwise(0.0)


def precision_at_k(k: int, labels: str = "labels") -> Column:
    """RM7: relevant among the first k, over k even if fewer were returned."""
    return F.aggregate(F.slice(labels, 1, k), F.lit(0), lambda a, x: a + x) / F.lit(k)


def _found(k: int, retrieved: str, gold: str) -> Column:

    def found(got: Column, golds: Column) -> Column:
        return F.filter(golds, lambda g: F.exists(got, lambda r: T.jaccard_col(r, g) >= JACCARD))

    golds = F.transform(F.array_distinct(gold), T.word_set_col)
    return T.bind(found, F.transform(F.slice(retrieved, 1, k), T.word_set_col), golds)


def recall_at_k(k: int, retrieved: str = "retrieved", gold: str = "gold") -> Column:
    """RM8: share of distinct gold contexts found in the first k; 1 without gold."""
    n = F.size(F.array_distinct(gold))
    return F.when(F.size(gold) <= 0, 1.0).otherwise(F.size(_found(k, retrieved, gold)) / n)


def full_support_at_k(k: int, retrieved: str = "retrieved", gold: str = "gold") -> Column:
    """RM9: 1 if every gold context is found in the first k."""
    n = F.size(F.array_distinct(gold))
    return F.when(F.size(gold) <= 0, 1.0).otherwise((F.size(_found(k, retrieved, gold)) == n).cast("double"))


def retrieval_metrics(rows: DataFrame, k: int = 10) -> DataFrame:
    """RM10: all eight, rounded to 4 places, from one array of labels."""
    rows = label(rows)
    cols = {
        "context_precision": context_precision(),
        "context_recall": context_recall(),
        "hit_rate": hit_rate(),
        "mrr": mrr(),
        f"ndcg_at_{k}": ndcg_at_k(k),
        f"precision_at_{k}": precision_at_k(k),
        f"recall_at_{k}": recall_at_k(k),
        f"full_support_at_{k}": full_support_at_k(k),
    }
    return rows.select("query_id", *[_r4(c).alias(n) for n, c in cols.items()])


def ndcg_qrels(ranked: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
    """RM11: binary gain, each document once, ideal from the judgements. qrels: (query_id, chunk_id).

    Every judged query gets a row, 0 if nothing relevant was ranked.
    """
    qrels = qrels.select("query_id", "chunk_id").distinct()
    once = ranked.groupBy("query_id", "chunk_id").agg(F.min("rank").alias("rank"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    top = once.withColumn("rank", place).where(F.col("rank") <= k)
    gain = top.join(qrels, ["query_id", "chunk_id"]).groupBy("query_id").agg(F.sum(1 / F.log2(F.col("rank") + 1.0)).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(k)).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1.0))
    need = qrels.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    return need.join(gain, "query_id", "left").select("query_id", F.round(F.coalesce(F.col("dcg"), F.lit(0.0)) / ideal, 6).alias("ndcg"))


def multihop_metrics(ranked: DataFrame, gold: DataFrame) -> DataFrame:
    """RM12: evidence found as a substring, white space aside: hits@10, hits@4, MAP@10, MRR@10, full support.

    ranked: (query_id, rank, content); gold: (query_id, evidence ARRAY<STRING>).
    """
    bare = lambda c: F.regexp_replace(c, r"[ \n]", "")
    facts = gold.select("query_id", F.posexplode(F.array_distinct(F.transform("evidence", bare))).alias("i", "fact"))
    top = ranked.where("rank <= 10").select("query_id", "rank", bare(F.col("content")).alias("content"))
    first = facts.join(top, "query_id").where(F.contains("content", "fact")).groupBy("query_id", "i").agg(F.min("rank").alias("rank"))
    new = first.groupBy("query_id", "rank").agg(F.count(F.lit(1)).alias("new"))
    per = new.groupBy("query_id").agg(F.sum(F.col("new") / F.col("rank")).alias("ap"), F.min("rank").alias("first"), F.sum("new").alias("found"))
    need = facts.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    out = need.join(per, "query_id", "left")
    return out.select(
        "query_id",
        (F.coalesce("first", F.lit(99)) <= 10).cast("double").alias("hits_at_10"),
        (F.coalesce("first", F.lit(99)) <= 4).cast("double").alias("hits_at_4"),
        F.round(F.coalesce("ap", F.lit(0.0)) / F.least("n", F.lit(10)), 6).alias("map_at_10"),
        F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("mrr_at_10"),
        (F.coalesce("found", F.lit(0)) == F.col("n")).cast("double").alias("full_support"),
    )


def answer_metrics(rows: DataFrame) -> DataFrame:
    """GM11: one metrics map per row of (question, answer, contexts, gold_answer, answer_facts); absent golds leave their keys out."""
    gold = F.coalesce(F.length("gold_answer"), F.lit(0)) > 0
    facts = F.coalesce(F.size("answer_facts"), F.lit(0)) > 0
    recall = T.fact_recall_col("answer", "answer_facts")
    values = {
        "faithfulness": _r4(T.faithfulness_col("answer", "contexts")),
        "answer_relevance": _r4(T.relevance_col("question", "answer")),
        "hallucination_score": T.hallucination_col("answer", "contexts"),
        "answer_correctness": F.when(gold, _r4(T.correctness_col("answer", "gold_answer"))),
        "answer_fact_recall": F.when(facts, _r4(recall)),
        "answer_fact_recall_all": F.when(facts, (recall == 1).cast("double")),
    }
    table = F.create_map(*[x for k, c in values.items() for x in (F.lit(k), c)])
    return rows.withColumn("metrics", F.map_filter(table, lambda k, v: v.isNotNull()))


#: Words of the run that leads from a passage to the documents that may hold it.
ANCHOR = 4
#: Passages without a whole word that meet every chunk at a time.
BARE_BLOCK = 200


def holders(chunks: DataFrame, passages: DataFrame) -> DataFrame:
    """(query_id, chunk_id): chunks (chunk_id, content) whose content contains a passage (query_id, text), as written.

    The words inside a passage, all but its first and last, stand whole in whatever
    holds it. Its first ANCHOR of them, hashed, meet the chunks' runs of as many words
    in an equi-join; `contains` then decides. Passages with fewer words inside use
    their longest one. Every chunk is read once for the keys of both kinds, its words
    hashed once each. Passages with no word inside meet every chunk, in blocks of
    BARE_BLOCK of them.
    """
    asked = kept(passages.where("length(text) > 0").select("query_id", "text", F.split("text", r"\s+").alias("_w")), "passages")
    n = F.size("_w") - 2
    longest = F.array_max(F.transform(F.slice("_w", 2, n), lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    hashed = lambda words: F.transform(words, lambda w: F.xxhash64(w))
    run = lambda h, i: F.xxhash64(*[F.element_at(h, i + j) for j in range(ANCHOR)])
    own = F.when(n >= ANCHOR, run(hashed(F.slice("_w", 2, ANCHOR)), F.lit(1))).otherwise(F.xxhash64(longest))
    anchors = kept(asked.where(n > 0).select("query_id", own.alias("_key"), (n >= ANCHOR).alias("_long")), "anchors")
    sizes = {r["_long"]: r["count"] for r in anchors.groupBy("_long").count().collect()}
    found = None
    if sizes:
        runs = lambda h: F.when(F.size(h) >= ANCHOR, F.transform(F.sequence(F.lit(1), F.size(h) - ANCHOR + 1), lambda i: run(h, i))).otherwise(F.array().cast("array<long>"))
        kinds = [kind for is_long, kind in ((True, runs), (False, lambda h: h)) if is_long in sizes]
        keys = T.bind(lambda h: F.array_distinct(F.concat(*[k(h) for k in kinds])), hashed(F.split("content", r"\s+")))
        hits = chunks.select("chunk_id", F.explode(keys).alias("_key")).join(small_or_shuffled(anchors.select("query_id", "_key"), sum(sizes.values())), "_key")
        found = hits.select("query_id", "chunk_id").distinct()
        found = chunks.select("chunk_id", "content").join(found, "chunk_id").join(small_or_shuffled(asked.select("query_id", "text")), "query_id").where("contains(content, text)").select("query_id", "chunk_id")
    bare = asked.where(n <= 0).select("query_id", "text")
    blocks = -(-bare.count() // BARE_BLOCK)
    for b in range(blocks):
        block = [tuple(r) for r in bare.where(F.pmod(F.xxhash64("query_id", "text"), F.lit(blocks)) == b).collect()]
        table = F.array(*[F.struct(F.lit(q).alias("query_id"), F.lit(t).alias("text")) for q, t in block])
        met = chunks.select("chunk_id", F.explode(F.filter(table, lambda x: F.contains(F.col("content"), x["text"]))).alias("_q")).select("_q.query_id", "chunk_id")
        found = met if found is None else found.unionByName(met)
    if found is None:
        found = asked.select("query_id").crossJoin(chunks.select("chunk_id").limit(0))
    return found
