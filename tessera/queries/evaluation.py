"""Queries: single ranking metrics, eval runs and experiments, golden-set construction."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import golden, metrics, stats

from tessera.sources.scratch import kept, small_or_shuffled

from .answers import _F, _PRESENT, _QA, qa, sql_f1, sql_fact, sql_norm
from .retrieval import _CANDS, _LABELS, _QRELS, _bm25, _eval_rows, _with, qrels
from .tables import BM25, INDEX, corpus, questions, sql_list, table

# ── runs made of the labels ────────────────────────────────────────────────


def _runs(s, d) -> tuple[DataFrame, DataFrame]:
    """Run a: the labels as metrics; run b: another judge of quality, on most of the samples."""
    t = table(s, d, "labels").where("quality is not null and toxic is not null")
    cell = lambda q: F.create_map(F.lit("quality"), q.cast("double"), F.lit("hallucination_rate"), F.col("toxic").cast("double"))
    a = t.select(F.col("doc_id").alias("sample_index"), cell(F.col("quality")).alias("metrics"))
    b = t.where("doc_id % 10 <> 7").select(F.col("doc_id").alias("sample_index"), F.map_concat(cell((F.col("doc_id") % 3 > 0).cast("int")), F.create_map(F.lit("extra"), F.lit(1.0))).alias("metrics"))
    return a, b


_RUNS = """
ra AS (SELECT doc_id AS i, unnest(['quality', 'hallucination_rate']) AS metric, unnest([quality, toxic])::DOUBLE AS v FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL),
rb AS (SELECT doc_id AS i, unnest(['quality', 'hallucination_rate', 'extra']) AS metric, unnest([(doc_id % 3 > 0)::INTEGER, toxic, 1])::DOUBLE AS v FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL AND doc_id % 10 <> 7),
prs AS (SELECT ra.metric, ra.i AS sample_index, ra.v AS a, rb.v AS b FROM ra JOIN rb ON ra.i = rb.i AND ra.metric = rb.metric)"""


def _samples(s, d) -> DataFrame:
    a, b = _runs(s, d)
    failed = F.when(F.col("sample_index") % 17 == 0, "timeout")
    return a.withColumn("run_id", F.lit("a")).unionByName(b.withColumn("run_id", F.lit("b"))).withColumn("error", failed)


_SAMPLES = "smp AS (SELECT 'a' AS run_id, i, metric, v, i % 17 = 0 AS failed FROM ra UNION ALL SELECT 'b', i, metric, v, i % 17 = 0 FROM rb)"


def _boot(src: str, iterations: int) -> str:
    """Resampled means of src(metric, value, ord)."""
    return f"""
cnt AS (SELECT metric, count(*) AS n, avg(value) AS observed FROM {src} GROUP BY metric),
drw AS (SELECT metric, value, it.range AS block, md5('{stats.SEED}|' || metric || '|' || ord || '|' || it.range) AS bits FROM {src}, range(0, {-(-iterations // 8)}) it),
wgt AS (SELECT metric, value, block * 8 + j AS iter, len(list_filter({sql_list(stats.POISSON)}, lambda p: p <= substr(bits, 4 * j + 1, 4))) AS times
        FROM drw, (SELECT unnest(range(0, 8)) AS j) WHERE block * 8 + j < {iterations}),
mns AS (SELECT metric, iter, round(coalesce(sum(value * times) / nullif(sum(times), 0), any_value(observed)), 12) AS mean FROM wgt JOIN cnt USING (metric) GROUP BY metric, iter)"""


_P = """
pv AS (SELECT metric, n, observed, CASE WHEN n < 2 OR observed = 0 THEN 1.0 ELSE
         least(1.0, 2 * (SELECT count(*) FROM mns WHERE mns.metric = cnt.metric AND CASE WHEN observed > 0 THEN mean <= 0 ELSE mean >= 0 END) / 1000) END::DOUBLE AS p FROM cnt),
bst AS (SELECT metric, n, p < 1 - 0.95::DOUBLE AS significant, round(p, 6) AS p_value FROM pv)"""
_DIFFS = "dif AS (SELECT metric, b - a AS value, sample_index AS ord FROM prs)"
_DIFF = """
mm AS (SELECT metric, round_even(avg(v), 4) AS a FROM ra GROUP BY metric), mb AS (SELECT metric, round_even(avg(v), 4) AS b FROM rb GROUP BY metric),
dm AS (SELECT metric, a, b, round(b - a, 6) AS delta, CASE WHEN a <> 0 THEN round((b - a) / abs(a) * 100, 2) END AS pct_change,
       CASE WHEN a = b THEN 'tie' WHEN (metric = 'hallucination_rate' AND b < a) OR (metric <> 'hallucination_rate' AND b > a) THEN 'B' ELSE 'A' END AS winner
       FROM mm JOIN mb USING (metric))"""


def _means(run: DataFrame) -> DataFrame:
    return run.select(F.explode("metrics").alias("metric", "value")).groupBy("metric").agg(F.bround(F.avg("value"), 4).alias("value"))


def _ex3(s, d):
    return stats.bootstrap(stats.pair(*_runs(s, d)))


def _ex6(s, d):
    m = stats.aggregate_run(_samples(s, d)).select("run_id", "metric", F.col("mean").alias("value"))
    return stats.api_gate(m, {"quality": 0.7, "hallucination_rate": 0.1, "ghost": 0.2})


_LIMITS = {"quality": 0.5, "hallu": 0.5, "ghost": 0.1}


def _ex7(s, d):
    m = stats.aggregate_run(_samples(s, d)).where("run_id = 'b'").select(F.when(F.col("metric") == "quality", 0).otherwise(1).alias("ord"), "metric", F.col("mean").alias("value"))
    return stats.ci_gate(m, _LIMITS)


def _ci_values(s, d):
    return _runs(s, d)[0].select(F.explode("metrics").alias("metric", "value"), F.col("sample_index").alias("ord"))


def _answer_rows(s, d):
    rows = qa(s, d)
    return rows.select(F.col("query_id").alias("ord"), F.when(F.col("query_id") % 50 == 0, "no verdict").alias("judge_error"), F.when(F.col("query_id") % 50 > 0, T.token_f1_col("question", "gold")).alias("f1"), F.length("gold").cast("double").alias("chars"))


_ANSWER_ROWS = f"""
ar AS (SELECT query_id AS ord, query_id % 50 = 0 AS je, CASE WHEN query_id % 50 > 0 THEN {sql_f1('x', 'y')} END AS f1, length(gold)::DOUBLE AS chars FROM nt),
lng AS (SELECT 'f1' AS metric, f1 AS value, ord FROM ar WHERE f1 IS NOT NULL UNION ALL SELECT 'chars', chars, ord FROM ar)"""
_CI = """
rnk AS (SELECT metric, mean, row_number() OVER (PARTITION BY metric ORDER BY mean) AS k FROM mns),
ends AS (SELECT metric, max(CASE WHEN k = 51 THEN mean END) AS low, max(CASE WHEN k = 1950 THEN mean END) AS high FROM rnk GROUP BY metric),
ci AS (SELECT metric, n, round(observed, 6) AS mean, round(low, 6) AS low, round(high, 6) AS high FROM cnt JOIN ends USING (metric))"""


def _two_answers(s, d):
    rows = qa(s, d)
    a = rows.select(F.col("query_id").alias("question"), T.token_f1_col("question", "gold").alias("f1"))
    b = rows.where("query_id % 3 > 0").select(F.col("query_id").alias("question"), T.token_f1_col("answer", "gold").alias("f1"))
    return a, b


def _bench(s, d):
    v = table(s, d, "embeddings").where("embedding is not null")
    mode = F.when(F.col("vec_id") % 2 == 0, "even").otherwise("odd")
    return v.select(mode.alias("mode"), F.lit("first").alias("metric"), F.floor(F.col("vec_id") / 2).alias("pos"), F.round(F.col("embedding")[0].cast("double"), 6).alias("value"))


_BENCH = "bn AS (SELECT CASE WHEN vec_id % 2 = 0 THEN 'even' ELSE 'odd' END AS mode, 'first' AS m, vec_id // 2 AS pos, round(embedding[1]::DOUBLE, 6) AS value FROM embeddings WHERE embedding IS NOT NULL)"


def _requests(s, d):
    e = table(s, d, "events")
    return e.select(F.col("event_type").alias("config"), F.col("event_type").alias("mode"), F.col("value").alias("ttft_ms"), (F.col("value") * 10).alias("total_ms"), F.col("user_id").alias("chars"), F.col("value").alias("latency_ms"), F.when(F.col("value") > 200, "slow").alias("error"))


def _speedup(s, d):
    e = table(s, d, "events").select(F.when(F.col("event_type") == "view", "hit").when(F.col("event_type") == "error", "miss").alias("mode"), F.col("value").alias("latency_ms"))
    return stats.cache_speedup(e)


def _run_detail(s, d):
    runs = table(s, d, "orders").select(F.col("o_orderkey").cast("string").alias("run_id"), F.col("o_orderpriority").alias("name"), F.col("o_orderstatus").alias("status"))
    samples = table(s, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("run_id"), (F.col("l_linenumber") * 100_000_000 + F.col("l_partkey") * 1000 + F.col("l_suppkey")).alias("sample_index"), F.col("l_quantity").alias("score"))
    key = "7"
    return stats.run_detail(runs, samples, key)


# ── golden sets over the documents ─────────────────────────────────────────


def _chunks(s, d) -> DataFrame:
    return corpus(s, d).select("chunk_id", "content", "document_id", F.col("document_id").alias("document_name"), T.est_tokens_col("content").alias("token_count"))


def _sampled(s, d, n=30):
    return golden.sample_chunks(_chunks(s, d), n)


_SAMPLED = """
gch AS (SELECT doc_id AS chunk_id, text AS content, source AS document_name, ('0x' || substr(md5('42|' || doc_id), 1, 8))::BIGINT AS h FROM documents WHERE greatest(1, length(text) // 4) >= 60),
gsm AS (SELECT * FROM gch ORDER BY h, chunk_id LIMIT 60),
gnm AS (SELECT *, row_number() OVER (ORDER BY chunk_id) - 1 AS n FROM gsm)"""


def paragraphs(s, d) -> DataFrame:
    """Lines of the documents as paragraphs."""
    rows = table(s, d, "documents").select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("pos", "content"))
    return rows.select((F.col("doc_id") * 10_000 + F.col("pos")).alias("chunk_id"), "content", F.lit("paragraph").alias("element_type"), F.col("source").alias("document_name"))


_PARAS = "par AS (SELECT doc_id * 10000 + unnest(range(0, len(string_split(text, chr(10))))) AS chunk_id, unnest(string_split(text, chr(10))) AS content, source AS document_name FROM documents WHERE text IS NOT NULL)"


def _qa_replies(s, d) -> DataFrame:
    q = questions(s, d)
    line = F.to_json(F.struct(F.col("text").alias("question"), F.when(F.col("query_id") % 4 > 0, F.substring("text", 1, 10)).alias("answer"), F.array((F.col("query_id") % 4).cast("int"), F.lit(1)).alias("chunks")))
    return q.select(F.floor(F.col("query_id") / 4).cast("int").alias("batch"), F.col("query_id"), F.concat(F.lit("```json\n"), line, F.lit(",\nnot json\n```")).alias("reply"))


def _assembled(s, d) -> DataFrame:
    replies = _qa_replies(s, d)
    lines = golden.parse_qa(replies.select("batch", "reply")).withColumn("pos", F.xxhash64("question")).withColumn("pos", F.length("question"))
    batches = corpus(s, d).select(F.floor(F.col("chunk_id") / 4).cast("int").alias("batch"), (F.col("chunk_id") % 4).cast("int").alias("idx"), "chunk_id", F.col("document_id").alias("document_name"))
    return golden.assemble_samples(lines, batches, 20).select("sample_index", "question", F.array_join(F.transform("source_chunk_ids", lambda x: x.cast("string")), ",").alias("chunks"), F.array_join("source_documents", ",").alias("documents"))


def _drafts(s, d) -> DataFrame:
    """A draft per benchmark passage that a document holds: its first two words as the fact."""
    held = qrels(s, d).groupBy("query_id").agg(F.min("chunk_id").alias("gold_id"))
    rows = questions(s, d).join(held, "query_id")
    words = lambda a, n: F.array_join(F.slice(F.split("text", r"\s+"), a, n), " ")
    fact = F.when(F.col("query_id") % 3 == 0, words(3, 6)).when(F.col("query_id") % 3 == 1, F.lit("nowhere said")).otherwise(words(1, 1))
    question = F.when(F.col("query_id") % 2 == 0, F.concat(F.lit("What of "), words(1, 1))).otherwise(F.concat(F.lit("Is it "), words(3, 6)))
    return kept(rows.select(F.col("query_id").alias("draft_id"), question.alias("question"), F.lit("yes").alias("answer"), F.array(F.array(fact)).alias("facts"), "gold_id"), "drafts")


def _multi_drafts(s, d) -> DataFrame:
    words = lambda a, n: F.array_join(F.slice(F.split("text", r"\s+"), a, n), " ")
    facts = F.when(F.col("query_id") % 2 == 0, F.array(F.array(words(1, 5)), F.array(words(6, 5)))).otherwise(F.array(F.array(words(1, 5)), F.array(F.lit("nowhere said"))))
    return questions(s, d).select(F.col("query_id").alias("draft_id"), F.when(F.col("query_id") % 5 == 0, words(1, 5)).otherwise(F.lit("Which two?")).alias("question"), facts.alias("facts"))


def _records(s, d) -> DataFrame:
    drafts = _drafts(s, d)
    golds = corpus(s, d).select(F.col("chunk_id").alias("gold_id"), F.col("content").alias("gold"))
    text = F.when(F.col("draft_id") % 7 == 0, F.lit("not in the corpus")).otherwise(F.col("gold"))
    return drafts.join(golds, "gold_id").select("draft_id", "question", "answer", F.array(text).alias("gold_contexts"), "facts")


def _fact_holders(s, d) -> DataFrame:
    drafts = _drafts(s, d).select(F.col("draft_id").alias("fact_id"), F.col("gold_id").alias("passage_id"), F.col("facts")[0].alias("wordings"))
    passages = corpus(s, d).join(small_or_shuffled(kept(drafts.select(F.col("passage_id").alias("chunk_id")).distinct(), "gold-ids")), "chunk_id").select(F.col("chunk_id").alias("passage_id"), "content")
    return golden.fact_holders(drafts, corpus(s, d), golden.near_dupes(corpus(s, d), passages))


def _accepted(s, d) -> DataFrame:
    return table(s, d, "documents").select(F.col("doc_id").alias("ord"), F.col("source").alias("document_name"))


def _golden_samples(s, d) -> DataFrame:
    return questions(s, d).select(F.col("query_id").alias("sample_id"), (F.col("query_id") % 3).alias("document_name"), F.floor(F.col("query_id") / 2).alias("gold_id"))


def _revised(s, d) -> DataFrame:
    q = questions(s, d)
    samples = q.select(F.col("query_id").alias("line"), F.col("text").alias("question"), F.substring("text", 1, 5).alias("gold_answer"), F.array(F.lit("keep me"), F.lit("drop me")).alias("gold_contexts"))
    drops = q.where("query_id % 10 = 0").select(F.col("query_id").alias("line"))
    none = F.lit(None).cast("string")
    patches = q.where("query_id % 4 = 1").select(F.col("query_id").alias("line"), F.when(F.col("query_id") % 8 == 1, "new question").alias("question"), none.alias("gold_answer"), F.when(F.col("query_id") % 8 == 1, "drop").otherwise("me").alias("drop_context"))
    return golden.revise(samples, drops, patches).withColumn("gold_contexts", F.array_join("gold_contexts", "|"))


def _rm(name: str, c) -> Callable:
    return lambda s, d: metrics.label(_eval_rows(s, d)).select("query_id", F.bround(c().cast("double"), 4).alias(name))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "rm2_context_precision": _rm("v", metrics.context_precision),
    "rm3_context_recall": _rm("v", metrics.context_recall),
    "rm4_hit_rate": _rm("v", metrics.hit_rate),
    "rm5_mrr": _rm("v", metrics.mrr),
    "rm6_ndcg": _rm("v", lambda: metrics.ndcg_at_k(10)),
    "rm7_precision": _rm("v", lambda: metrics.precision_at_k(10)),
    "rm8_recall": _rm("v", lambda: metrics.recall_at_k(10)),
    "rm9_full_support": _rm("v", lambda: metrics.full_support_at_k(10)),
    "ex1_aggregate_run": lambda s, d: stats.aggregate_run(_samples(s, d)),
    "ex1_run_counts": lambda s, d: stats.run_counts(_samples(s, d)),
    "ex2_pair": lambda s, d: stats.pair(*_runs(s, d)),
    "ex3_bootstrap": _ex3,
    "ex4_diff_metrics": lambda s, d: stats.diff_metrics(*[_means(r) for r in _runs(s, d)]),
    "ex5_experiment": lambda s, d: stats.experiment(*_runs(s, d)),
    "ex6_api_gate": _ex6,
    "ex7_ci_gate": _ex7,
    "ex9_bootstrap_ci": lambda s, d: stats.bootstrap_ci(_ci_values(s, d)),
    "ex10_summarize_answers": lambda s, d: stats.summarize_answers(_answer_rows(s, d), ["f1"], ["chars"]),
    "ex11_compare_answers": lambda s, d: stats.compare_answers(*_two_answers(s, d), ["f1"]),
    "ex12_summarize_bench": lambda s, d: stats.summarize_bench(_bench(s, d)),
    "ex12_compare_bench": lambda s, d: stats.compare_bench(*[_bench(s, d).where(f"mode = '{m}'").select("metric", "pos", "value") for m in ("even", "odd")]),
    "ex13_protocol_candidates": lambda s, d: stats.protocol_candidates(qrels(s, d), _bm25(s, d, 100)),
    "ex14_sweep_report": lambda s, d: stats.sweep_report(_requests(s, d)),
    "ex15_latency_table": lambda s, d: stats.latency_table(_requests(s, d)),
    "ex15_cache_speedup": _speedup,
    "ex16_catalogue": lambda s, d: stats.catalogue(table(s, d, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_orderdate").alias("created_at")), "run_id"),
    "ex16_run_detail": _run_detail,
    "gs1_sample_chunks": lambda s, d: _sampled(s, d).select("chunk_id", "document_name", "token_count"),
    "gs2_batch_prompts": lambda s, d: golden.batch_prompts(_sampled(s, d).withColumnRenamed("chunk_id", "ord")).select("batch", F.md5("prompt").alias("prompt_md5")),
    "gs3_parse_qa": lambda s, d: golden.parse_qa(_qa_replies(s, d).select("batch", "reply")).select("batch", "pos", "question", "answer", F.array_join(F.transform("chunks", lambda x: x.cast("string")), ",").alias("chunks")),
    "gs4_assemble_samples": _assembled,
    "gs5_passage_pool": lambda s, d: golden.passage_pool(paragraphs(s, d)).select("chunk_id", "document_name"),
    "gs6_near_dupes": lambda s, d: golden.near_dupes(paragraphs(s, d), questions(s, d).select(F.col("query_id").alias("passage_id"), F.col("text").alias("content"))),
    "gs7_fact_holders": _fact_holders,
    "gs8_check_single": lambda s, d: golden.check_single(_drafts(s, d), corpus(s, d).select("chunk_id", "content")).select("draft_id", "reason"),
    "gs9_check_multi": lambda s, d: golden.check_multi(_multi_drafts(s, d), corpus(s, d).select("chunk_id", "content")).select("draft_id", "reason"),
    "gs10_check_records": lambda s, d: golden.check_records(_records(s, d), corpus(s, d).select("chunk_id", "content")),
    "gs11_rejection_report": lambda s, d: golden.rejection_report(table(s, d, "documents").select(F.col("source").alias("document_name"), F.when(F.length("text") < 400, "malformed").when(F.col("lang") != "en", "fact also stated elsewhere").alias("reason"))),
    "gs12_split_dev_test": lambda s, d: golden.split_dev_test(_accepted(s, d), 100),
    "gs13_make_pairs": lambda s, d: golden.make_pairs(_golden_samples(s, d), 30),
    "gs15_revise": _revised,
}

_WORDS_SET = r"list_distinct(list_filter(regexp_split_to_array(lower({}), '\s+'), lambda w: w <> ''))"
#: Drafts of golden rows, what states their facts, and the near-duplicates of their passages, by plain comparison of all with all.
_GOLD_FACTS = f"""
{_QRELS},
hel AS (SELECT query_id, min(chunk_id) AS gold_id FROM qrels GROUP BY query_id),
wds AS (SELECT item_id AS draft_id, gold_id, regexp_split_to_array(text, '\\s+') AS w FROM benchmark JOIN hel ON query_id = item_id),
dra AS (SELECT draft_id, gold_id, CASE draft_id % 3 WHEN 0 THEN array_to_string(w[3:8], ' ') WHEN 1 THEN 'nowhere said' ELSE w[1] END AS fact,
          CASE WHEN draft_id % 2 = 0 THEN 'What of ' || w[1] ELSE 'Is it ' || array_to_string(w[3:8], ' ') END AS question FROM wds),
hay AS MATERIALIZED (SELECT doc_id AS chunk_id, {sql_fact('text')} AS hay FROM documents),
ned AS (SELECT draft_id, gold_id, {sql_fact('fact')} AS needle, {sql_fact('question')} AS asked, length(trim(fact)) < 2 AS short FROM dra),
hld AS (SELECT draft_id, gold_id, chunk_id FROM ned, hay WHERE contains(hay, needle) AND {_PRESENT}),
sts AS MATERIALIZED (SELECT doc_id AS chunk_id, {_WORDS_SET.format('text')} AS w FROM documents),
shr AS (SELECT gold_id, chunk_id, count(*) AS n FROM (SELECT gold_id, unnest(w) AS x FROM sts JOIN (SELECT DISTINCT gold_id FROM dra) ON chunk_id = gold_id) JOIN (SELECT chunk_id, unnest(w) AS x FROM sts) USING (x) GROUP BY ALL),
nea AS (SELECT gold_id, shr.chunk_id FROM shr JOIN sts g ON g.chunk_id = gold_id JOIN sts c ON c.chunk_id = shr.chunk_id WHERE round(n / (len(g.w) + len(c.w) - n), 6) >= 0.5),
els AS (SELECT draft_id, gold_id, chunk_id FROM hld WHERE NOT EXISTS (SELECT 1 FROM nea WHERE nea.gold_id = hld.gold_id AND nea.chunk_id = hld.chunk_id)),
jud AS (SELECT draft_id, short, EXISTS (SELECT 1 FROM hld WHERE hld.draft_id = ned.draft_id AND hld.chunk_id = ned.gold_id) AS own,
          EXISTS (SELECT 1 FROM els WHERE els.draft_id = ned.draft_id) AS other, {_PRESENT.replace('hay', 'asked')} AS told FROM ned),
rsn AS (SELECT draft_id, own, CASE WHEN short THEN 'malformed fact' WHEN NOT own THEN 'fact not in its passage' WHEN other THEN 'fact also stated elsewhere' WHEN told THEN 'question contains its answer' END AS reason FROM jud)"""

_E = (INDEX, BM25, _CANDS, _LABELS)
_RM = {
    "rm2_context_precision": "CASE WHEN len(labels) > 0 THEN list_sum(labels) / len(labels) ELSE 0 END",
    "rm3_context_recall": "covered",
    "rm4_hit_rate": "coalesce(list_max(labels), 0)",
    "rm5_mrr": "CASE WHEN list_contains(labels, 1) THEN 1 / list_position(labels, 1) ELSE 0 END",
    "rm6_ndcg": "CASE WHEN list_contains(labels, 1) THEN list_sum(list_transform(range(1, len(labels) + 1), lambda i: labels[i] / log2(i + 1))) / list_sum(list_transform(range(1, list_sum(labels)::BIGINT + 1), lambda i: 1 / log2(i + 1))) ELSE 0 END",
    "rm7_precision": "coalesce(list_sum(labels), 0) / 10",
    "rm8_recall": "recall",
    "rm9_full_support": "CASE WHEN recall = 1 THEN 1 ELSE 0 END",
}

ORACLES: dict[str, str] = {k: _with(*_E) + f"SELECT query_id, round_even(({v})::DOUBLE, 4) AS v FROM evalrows" for k, v in _RM.items()} | {
    "ex1_aggregate_run": _with(_RUNS, _SAMPLES) + "SELECT run_id, metric, round_even(avg(v), 4) AS mean, count(v) AS n FROM smp WHERE NOT failed GROUP BY ALL",
    "ex1_run_counts": _with(_RUNS, _SAMPLES) + "SELECT run_id, count(DISTINCT i) AS total, count(DISTINCT CASE WHEN NOT failed THEN i END) AS passed, count(DISTINCT CASE WHEN failed THEN i END) AS failed FROM smp GROUP BY run_id",
    "ex2_pair": _with(_RUNS) + "SELECT metric, sample_index, a, b FROM prs",
    "ex3_bootstrap": _with(_RUNS, _DIFFS, _boot("dif", 1000), _P) + "SELECT * FROM bst",
    "ex4_diff_metrics": _with(_RUNS, _DIFF) + "SELECT * FROM dm",
    "ex5_experiment": _with(_RUNS, _DIFFS, _boot("dif", 1000), _P, _DIFF) + "SELECT metric, a, b, delta, pct_change, winner, n, significant, p_value FROM dm LEFT JOIN bst USING (metric)",
    "ex6_api_gate": _with(_RUNS, _SAMPLES) + """
, m AS (SELECT run_id, metric, round_even(avg(v), 4) AS value FROM smp WHERE NOT failed GROUP BY ALL),
l AS (SELECT * FROM (VALUES (0, 'quality', 0.7), (1, 'hallucination_rate', 0.1), (2, 'ghost', 0.2)) AS t(ord, name, threshold)),
g AS (SELECT r.run_id, ord, name, coalesce(value, 0) < threshold AS bad FROM (SELECT DISTINCT run_id FROM m) r CROSS JOIN l LEFT JOIN m ON m.run_id = r.run_id AND m.metric = l.name)
SELECT run_id, NOT bool_or(bad) AS passed, coalesce(string_agg(CASE WHEN bad THEN name END, ',' ORDER BY ord), '') AS failures FROM g GROUP BY run_id""",
    "ex7_ci_gate": _with(_RUNS, _SAMPLES) + """
, m AS (SELECT CASE WHEN metric = 'quality' THEN 0 ELSE 1 END AS ord, metric, round_even(avg(v), 4) AS value FROM smp WHERE NOT failed AND run_id = 'b' GROUP BY ALL),
l AS (SELECT * FROM (VALUES ('quality', 0.5::DOUBLE), ('hallu', 0.5::DOUBLE), ('ghost', 0.1::DOUBLE)) AS t(name, threshold)),
b AS (SELECT l.*, m.metric, m.value FROM l LEFT JOIN m ON starts_with(m.metric, l.name) QUALIFY row_number() OVER (PARTITION BY name ORDER BY metric <> name, ord, metric) = 1)
SELECT name, metric, value, threshold, CASE WHEN metric IS NULL THEN 'NOT PRODUCED' WHEN value >= threshold THEN 'PASS' ELSE 'FAIL' END AS status FROM b""",
    "ex9_bootstrap_ci": _with(_RUNS, "val AS (SELECT metric, v AS value, i AS ord FROM ra)", _boot("val", 2000), _CI) + "SELECT * FROM ci",
    "ex10_summarize_answers": _with(_QA, _F.format(sql_norm("question"), sql_norm("gold")), _ANSWER_ROWS, _boot("lng", 2000), _CI) + """
, srt AS (SELECT list(chars ORDER BY chars) AS c FROM ar)
SELECT metric, n, mean, low, high, CASE WHEN metric = 'chars' THEN (SELECT c[floor(len(c) * 0.5)::BIGINT + 1] FROM srt) END AS p50,
       CASE WHEN metric = 'chars' THEN (SELECT c[floor(len(c) * 0.95)::BIGINT + 1] FROM srt) END AS p95, (SELECT count(*) FROM ar WHERE je) AS judge_errors FROM ci""",
    "ex11_compare_answers": _with(_QA, f"nt AS (SELECT query_id, {sql_norm('question')} AS x, {sql_norm('gold')} AS y, {sql_norm('answer')} AS z FROM qa)",
        f"prs AS (SELECT 'f1' AS metric, query_id AS sample_index, {sql_f1('x', 'y')} AS a, {sql_f1('z', 'y')} AS b FROM nt WHERE query_id % 3 > 0)", _DIFFS, _boot("dif", 1000), _P) + """
SELECT metric, (SELECT round(avg(a), 6) FROM prs) AS mean_a, (SELECT round(avg(b), 6) FROM prs) AS mean_b, (SELECT round(avg(b - a), 6) FROM prs) AS delta, n, significant, p_value FROM bst""",
    "ex12_summarize_bench": _with(_BENCH, "val AS (SELECT mode || '/' || m AS metric, value, pos AS ord FROM bn)", _boot("val", 2000), _CI) + """
SELECT split_part(metric, '/', 1) AS mode, split_part(metric, '/', 2) AS metric, n, mean, low, high, (SELECT round(quantile_cont(value, 0.5), 6) FROM bn WHERE mode = split_part(ci.metric, '/', 1)) AS p50 FROM ci""",
    "ex12_compare_bench": _with(_BENCH, "prs AS (SELECT e.m AS metric, e.pos AS sample_index, e.value AS a, o.value AS b FROM bn e JOIN bn o ON e.pos = o.pos AND e.mode = 'even' AND o.mode = 'odd')", _DIFFS, _boot("dif", 1000), _P) + """
SELECT metric, (SELECT round(avg(a), 6) FROM prs) AS mean_a, (SELECT round(avg(b), 6) FROM prs) AS mean_b, (SELECT round(avg(b - a), 6) FROM prs) AS delta, n, significant, p_value FROM bst""",
    "ex13_protocol_candidates": _with(INDEX, BM25, _QRELS) + """
, p AS (SELECT DISTINCT query_id, chunk_id, 0 AS part, 0 AS at_ FROM qrels
        UNION ALL SELECT query_id, chunk_id, 1, rank FROM bm25 b WHERE rank <= 100 AND NOT EXISTS (SELECT 1 FROM qrels q WHERE q.query_id = b.query_id AND q.chunk_id = b.chunk_id))
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY part, at_, chunk_id)::INTEGER AS rank, chunk_id FROM p""",
    "ex14_sweep_report": """
SELECT event_type AS config, round(quantile_cont(value, 0.5) FILTER (value <= 200), 4) AS ttft_ms, round(quantile_cont(value * 10, 0.5) FILTER (value <= 200), 4) AS total_ms,
       round(quantile_cont(user_id, 0.5) FILTER (value <= 200), 4)::DOUBLE AS chars, count(*) FILTER (value <= 200) AS n, count(*) FILTER (value > 200) AS failures,
       round(round(quantile_cont(value * 10, 0.5) FILTER (value <= 200), 4) / nullif(round(quantile_cont(user_id, 0.5) FILTER (value <= 200), 4), 0), 4) AS ms_per_char
FROM events GROUP BY event_type""",
    "ex15_latency_table": """
WITH l AS (SELECT event_type AS mode, list(value ORDER BY value) AS v, avg(value) AS m, sum(value) AS s FROM events GROUP BY event_type)
SELECT mode, len(v)::BIGINT AS n, v[least(floor(len(v) * 0.5), len(v) - 1)::BIGINT + 1] AS p50, v[least(floor(len(v) * 0.95), len(v) - 1)::BIGINT + 1] AS p95,
       v[least(floor(len(v) * 0.99), len(v) - 1)::BIGINT + 1] AS p99, round(m, 4) AS mean, v[1] AS min, v[-1] AS max, round(len(v) / (s / 1000), 4) AS qps FROM l""",
    "ex15_cache_speedup": """
SELECT round(quantile_cont(value, 0.5) FILTER (event_type = 'view'), 4) AS hit_p50, round(quantile_cont(value, 0.5) FILTER (event_type = 'error'), 4) AS miss_p50,
       round(quantile_cont(value, 0.5) FILTER (event_type = 'error') / quantile_cont(value, 0.5) FILTER (event_type = 'view'), 4) AS speedup FROM events""",
    "ex16_catalogue": "SELECT o_orderkey AS run_id, o_orderdate AS created_at FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 50",
    "ex16_run_detail": "SELECT o_orderkey::VARCHAR AS run_id, o_orderpriority AS name, o_orderstatus AS status, l_linenumber::BIGINT * 100000000 + l_partkey * 1000 + l_suppkey AS sample_index, l_quantity AS score FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderkey = 7",
    "gs1_sample_chunks": _with(_SAMPLED) + "SELECT chunk_id, document_name, greatest(1, length(content) // 4)::INTEGER AS token_count FROM gsm",
    "gs2_batch_prompts": _with(_SAMPLED) + "SELECT (n // 4)::INTEGER AS batch, md5(string_agg('[' || (n % 4) || '] (' || document_name || ')' || chr(10) || content, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY n)) AS prompt_md5 FROM gnm GROUP BY n // 4",
    "gs3_parse_qa": "SELECT (item_id // 4)::INTEGER AS batch, 1 AS pos, text AS question, substr(text, 1, 10) AS answer, (item_id % 4) || ',1' AS chunks FROM benchmark WHERE item_id % 4 > 0",
    "gs4_assemble_samples": """
WITH q AS (SELECT item_id // 4 AS batch, length(text) AS pos, text AS question, [item_id % 4, 1] AS ch FROM benchmark WHERE item_id % 4 > 0),
f AS (SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY lower(question) ORDER BY batch, pos) = 1),
c AS (SELECT batch, pos, question, unnest(range(0, 2)) AS k, unnest(ch) AS idx FROM f),
j AS (SELECT c.batch, c.pos, c.question, string_agg(doc_id::VARCHAR, ',' ORDER BY k, doc_id) AS chunks, array_to_string(list_sort(list_distinct(list(source))), ',') AS documents
      FROM c JOIN documents d ON d.doc_id // 4 = c.batch AND d.doc_id % 4 = c.idx GROUP BY ALL)
SELECT (row_number() OVER (ORDER BY batch, pos) - 1)::INTEGER AS sample_index, question, chunks, documents FROM j QUALIFY row_number() OVER (ORDER BY batch, pos) <= 20""",
    "gs5_passage_pool": _with(_PARAS) + f"""
SELECT chunk_id, document_name FROM par WHERE length(content) BETWEEN 150 AND 511 AND NOT regexp_matches(content, '{golden.JUNK}')
  AND content IN (SELECT content FROM par GROUP BY content HAVING count(*) = 1)""",
    "gs6_near_dupes": _with(_PARAS) + r"""
, p AS (SELECT item_id AS passage_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda w: w <> '')) AS p FROM benchmark),
c AS (SELECT chunk_id, list_distinct(list_filter(regexp_split_to_array(lower(content), '\s+'), lambda w: w <> '')) AS c FROM par),
i AS (SELECT passage_id, chunk_id, count(*) AS shared FROM (SELECT passage_id, unnest(p) AS w FROM p) JOIN (SELECT chunk_id, unnest(c) AS w FROM c) USING (w) GROUP BY ALL),
j AS (SELECT passage_id, chunk_id, round(shared / (len(p) + len(c) - shared), 6) AS jaccard FROM i JOIN p USING (passage_id) JOIN c USING (chunk_id))
SELECT * FROM j WHERE jaccard >= 0.5""",
    "gs7_fact_holders": _with(_GOLD_FACTS) + "SELECT DISTINCT draft_id AS fact_id, gold_id AS passage_id, chunk_id FROM els",
    "gs8_check_single": _with(_GOLD_FACTS) + "SELECT draft_id, reason FROM rsn",
    "gs9_check_multi": f"""
WITH w AS (SELECT item_id AS draft_id, regexp_split_to_array(text, '\\s+') AS w FROM benchmark),
f AS (SELECT draft_id, unnest([0, 1]) AS k, unnest([array_to_string(w[1:5], ' '), CASE WHEN draft_id % 2 = 0 THEN array_to_string(w[6:10], ' ') ELSE 'nowhere said' END]) AS fact,
        CASE WHEN draft_id % 5 = 0 THEN array_to_string(w[1:5], ' ') ELSE 'Which two?' END AS question FROM w),
n AS (SELECT draft_id, k, question, {sql_fact('fact')} AS needle, {sql_fact('question')} AS asked FROM f),
h AS MATERIALIZED (SELECT doc_id AS chunk_id, {sql_fact('text')} AS hay FROM documents),
b AS (SELECT draft_id FROM (SELECT draft_id, chunk_id, count(DISTINCT k) AS m FROM n, h WHERE contains(hay, needle) AND {_PRESENT} GROUP BY ALL) WHERE m = 2),
t AS (SELECT draft_id, any_value(question) AS question, bool_or({_PRESENT.replace('hay', 'asked')}) AS told FROM n GROUP BY draft_id)
SELECT draft_id, CASE WHEN length(trim(question)) = 0 THEN 'malformed' WHEN told THEN 'question contains an answer' WHEN draft_id IN (SELECT draft_id FROM b) THEN 'one chunk states both facts' END AS reason FROM t""",
    "gs10_check_records": _with(_GOLD_FACTS) + "SELECT draft_id, CASE WHEN draft_id % 7 = 0 THEN 'gold context not in corpus' WHEN NOT own THEN 'fact not in its passage' ELSE reason END AS reason FROM rsn",
    "gs11_rejection_report": "SELECT source AS document_name, CASE WHEN length(text) < 400 THEN 'malformed' WHEN lang <> 'en' THEN 'fact also stated elsewhere' ELSE 'kept' END AS reason, count(*) AS n FROM documents GROUP BY ALL",
    "gs12_split_dev_test": """
WITH a AS (SELECT doc_id AS ord, source AS document_name FROM documents),
r AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY document_name ORDER BY ord) <= floor(100 / (SELECT count(DISTINCT document_name) FROM a))),
s AS (SELECT *, row_number() OVER (PARTITION BY document_name ORDER BY ('0x' || substr(md5('42|' || ord), 1, 8))::BIGINT, ord) AS i, count(*) OVER (PARTITION BY document_name) AS n FROM r)
SELECT ord, document_name, CASE WHEN i <= round_even(0.3 * n, 0) THEN 'dev' ELSE 'test' END AS split FROM s""",
    "gs13_make_pairs": """
WITH s AS (SELECT item_id AS sample_id, item_id % 3 AS doc, item_id // 2 AS gold FROM benchmark),
r AS (SELECT *, row_number() OVER (ORDER BY ('0x' || substr(md5('42|' || sample_id), 1, 8))::BIGINT, sample_id) AS i, count(*) OVER () AS size FROM s),
p AS (SELECT DISTINCT least(x.sample_id, y.sample_id) AS a, greatest(x.sample_id, y.sample_id) AS b, x.doc = y.doc AS within
      FROM r x, range(1, 8) AS st(step), r y WHERE y.i = (x.i + step - 1) % x.size + 1 AND x.gold <> y.gold),
t AS (SELECT *, row_number() OVER (PARTITION BY within ORDER BY ('0x' || substr(md5('42|' || a || '|' || b), 1, 8))::BIGINT, a, b) AS i FROM p),
n AS (SELECT (row_number() OVER (ORDER BY within DESC, i) - 1)::INTEGER AS pair, a, b, within FROM t WHERE i <= 15)
SELECT pair, a, b, within, ['comparison', 'conjunction', 'bridge'][pair % 3 + 1] AS style FROM n""",
    "gs15_revise": """
SELECT item_id AS line, CASE WHEN item_id % 8 = 1 THEN 'new question' ELSE text END AS question, substr(text, 1, 5) AS gold_answer,
       CASE WHEN item_id % 8 = 1 THEN 'keep me' ELSE 'keep me|drop me' END AS gold_contexts, CASE WHEN item_id % 4 = 1 THEN item_id END AS revised_from_v1
FROM benchmark WHERE item_id % 10 <> 0""",
}
