"""Model calls, answer assembly, judges."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def complete(df: DataFrame, prompt_col: str, fn: Callable[[list[str]], list[str]], batch: int = 8) -> DataFrame:
    """MD1: df with reply, prompt_tokens, completion_tokens and error. A failed batch is data, not a failed task.

    fn takes a list of prompts and returns as many replies; it is called inside
    tasks, on batches of rows, and has to be picklable.
    """

    @F.pandas_udf("struct<reply: string, error: string>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in parts:
            prompts, out = s.tolist(), []
            for i in range(0, len(prompts), batch):
                group = prompts[i : i + batch]
                try:
                    got = list(fn(group))
                    if len(got) != len(group):
                        raise ValueError(f"{len(got)} replies to {len(group)} prompts")
                    out += [(r, None) for r in got]
                except Exception as e:
                    out += [(None, f"{type(e).__name__}: {e}")] * len(group)
            yield pd.DataFrame(out, columns=["reply", "error"])

    size = lambda c: F.ceil(F.coalesce(F.length(c), F.lit(0)) / 4).cast("int")
    out = df.withColumn("_r", run(prompt_col)).withColumn("reply", F.col("_r.reply")).withColumn("error", F.col("_r.error")).drop("_r")
    return out.withColumn("prompt_tokens", size(prompt_col)).withColumn("completion_tokens", size("reply"))


def format_context(ranked: DataFrame, max_chars: int | None = None) -> DataFrame:
    """AS1: (query_id, context): numbered chunks with source and page, in rank order."""
    text = F.col("content") if max_chars is None else F.substring("content", 1, max_chars)
    row = F.struct("rank", F.coalesce("document_name", F.lit("Unknown")).alias("doc"), F.coalesce(F.col("page_number").cast("string"), F.lit("?")).alias("page"), text.alias("text"))
    listed = F.array_sort(F.collect_list(row))
    piece = lambda x: F.concat(F.lit("["), x["rank"].cast("string"), F.lit("] (Source: "), x["doc"], F.lit(", Page: "), x["page"], F.lit(")\n"), x["text"])
    return ranked.groupBy("query_id").agg(F.array_join(F.transform(listed, piece), "\n\n---\n\n").alias("context"))


def seen_texts(ranked: DataFrame, max_chars: int | None = None) -> DataFrame:
    """AS2: (query_id, seen): the chunk texts as the prompt carries them."""
    text = F.col("content") if max_chars is None else F.substring("content", 1, max_chars)
    return ranked.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", text.alias("text")))), lambda x: x["text"]).alias("seen"))


SNIPPET = 200


def citations(answers: DataFrame, ranked: DataFrame) -> DataFrame:
    """AS3: (query_id, position, chunk_id, content_snippet): chunks an answer's [n] marks name, in order of first mention."""
    marks = answers.select("query_id", F.posexplode(F.regexp_extract_all("answer", F.lit(r"\[(\d+)\]"), F.lit(1))).alias("pos", "n"))
    marks = marks.select("query_id", "pos", F.expr("try_cast(n as int)").alias("rank"))
    first = marks.join(ranked.select("query_id", "rank", "chunk_id", "content"), ["query_id", "rank"]).groupBy("query_id", "chunk_id").agg(
        F.min("pos").alias("pos"), F.first("content").alias("content")
    )
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("pos"))
    snippet = F.when(F.length("content") > SNIPPET, F.concat(F.substring("content", 1, SNIPPET), F.lit("..."))).otherwise(F.col("content"))
    return first.select("query_id", place.alias("position"), "chunk_id", snippet.alias("content_snippet"))


# ── judges ─────────────────────────────────────────────────────────────────


def rubric_score_col(reply: Column | str) -> Column:
    """The `SCORE:` of a reply as an integer in 1..5, 3 if there is none."""
    reply = F.col(reply) if isinstance(reply, str) else reply
    n = F.regexp_extract(reply, r"(?im)^\s*score:\s*(\d{1,6})", 1).try_cast("int")
    return F.when(n.isNotNull(), F.least(F.greatest(n, F.lit(1)), F.lit(5))).otherwise(3)


def rubric_reasoning_col(reply: Column | str) -> Column:
    """What follows `REASONING:`."""
    reply = F.col(reply) if isinstance(reply, str) else reply
    return F.trim(F.regexp_extract(reply, r"(?is)reasoning:\s*(.*)\z", 1))


def permuted_contexts(rows: DataFrame, permutations: int = 3, seed: int = 42) -> DataFrame:
    """(sample_id, permutation, contexts): context paragraphs in a seeded order per permutation."""
    from tessera.functions.text import hash_int

    many = rows.withColumn("permutation", F.explode(F.sequence(F.lit(0), F.lit(permutations - 1))))
    keyed = F.transform("contexts", lambda c, i: F.struct(hash_int(F.lit(seed), F.col("permutation"), F.col("sample_id"), i).alias("h"), c.alias("c")))
    return many.select("sample_id", "permutation", F.transform(F.array_sort(keyed), lambda x: x["c"]).alias("contexts"))


def judge_faithfulness(replies: DataFrame) -> DataFrame:
    """JG2: (sample_id, reply, answer_words, context_words) per permutation -> score, variance, warning.

    A failed call scores 3; an answer over three times as long as its context loses a point.
    """
    score = F.when(F.col("reply").isNull(), 3).otherwise(rubric_score_col("reply"))
    per = replies.withColumn("s", score).groupBy("sample_id").agg(
        F.avg("s").alias("mean"), F.var_pop("s").alias("variance"), F.max("answer_words").alias("a"), F.max("context_words").alias("c")
    )
    long = F.col("a") > 3 * F.greatest("c", F.lit(1))
    mean = F.when(long, F.greatest(F.col("mean") - 1, F.lit(1.0))).otherwise(F.col("mean"))
    return per.select("sample_id", F.bround((mean - 1) / 4, 4).alias("score"), F.bround("variance", 4).alias("variance"), (F.col("variance") > 1).alias("warning"))


def judge_relevance(replies: DataFrame) -> DataFrame:
    """JG3: (sample_id, reply) -> (s - 1) / 4; a failed call scores 3."""
    score = F.when(F.col("reply").isNull(), 3).otherwise(rubric_score_col("reply"))
    return replies.select("sample_id", ((score - 1) / 4).alias("relevance"))


# Verdict words and what they are worth.
CORRECTNESS = {"correct": 1.0, "partial": 0.5, "incorrect": 0.0}
FAITHFULNESS = {"faithful": 1.0, "minor": 0.5, "unfaithful": 0.0}


def parse_verdicts(replies: DataFrame, list_key: str = "verdicts") -> DataFrame:
    """JG4: (batch_id, pos, item, correctness, faithfulness, error) from bare, wrapped or fenced JSON lists.

    A reply without a readable list gives one row with an error; an unknown label
    is an error of its row.
    """
    item = "struct<item: string, correctness: string, faithfulness: string>"
    span = F.regexp_extract("reply", r"(?s)(\[.*\])", 1)
    wrapped = F.from_json(F.regexp_extract("reply", r"(?s)(\{.*\})", 1), f"struct<`{list_key}`: array<{item}>>")[list_key]
    rows = replies.select("batch_id", F.coalesce(F.from_json(span, f"array<{item}>"), wrapped).alias("list"))
    out = rows.select("batch_id", F.posexplode_outer("list").alias("pos", "v"))
    worth = lambda c, table: F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), F.lower(F.trim(c)))
    out = out.select("batch_id", "pos", "v.item", worth(F.col("v.correctness"), CORRECTNESS).alias("correctness"), worth(F.col("v.faithfulness"), FAITHFULNESS).alias("faithfulness"))
    bad = F.when(F.col("pos").isNull(), "no list").when(F.col("correctness").isNull() | F.col("faithfulness").isNull(), "unknown label")
    return out.withColumn("error", bad)


def align_verdicts(items: DataFrame, verdicts: DataFrame) -> DataFrame:
    """JG5: items (batch_id, number, ...) with their verdicts.

    Verdicts go by the digits of their item; if a batch has as many verdicts as
    items but other numbers, they go by position. An item left over is a judge_error.
    """
    v = verdicts.where("error is null").withColumn("number", F.regexp_extract(F.coalesce("item", F.lit("")), r"(\d+)", 1).try_cast("int"))
    own = items.groupBy("batch_id").agg(F.sort_array(F.collect_list("number")).alias("want"))
    have = v.groupBy("batch_id").agg(F.sort_array(F.collect_list("number")).alias("have"), F.count(F.lit(1)).alias("n"))
    mode = own.join(have, "batch_id", "left").select(
        "batch_id", ((F.col("n") == F.size("want")) & (F.coalesce("have", F.array().cast("array<int>")) != F.col("want"))).alias("by_position")
    )
    place = F.row_number().over(Window.partitionBy("batch_id").orderBy("number"))
    v_place = F.row_number().over(Window.partitionBy("batch_id").orderBy("pos"))
    key = F.when(F.coalesce("by_position", F.lit(False)), F.col("place")).otherwise(F.col("number"))
    left = items.withColumn("place", place).join(mode, "batch_id", "left").withColumn("key", key)
    right = v.withColumn("place", v_place).join(mode, "batch_id", "left").withColumn("key", key)
    right = right.groupBy("batch_id", "key").agg(F.min_by("correctness", "pos").alias("correctness"), F.min_by("faithfulness", "pos").alias("faithfulness"))
    out = left.join(right, ["batch_id", "key"], "left").drop("key", "place", "by_position")
    return out.withColumn("judge_error", F.when(F.col("correctness").isNull(), "no verdict"))


def rows_to_judge(rows: DataFrame, everything: bool = False) -> DataFrame:
    """JG6: rows with context that have no judge_correctness yet, or all with context."""
    with_context = F.coalesce(F.size("contexts"), F.lit(0)) > 0
    return rows.where(with_context if everything else with_context & F.col("judge_correctness").isNull())
