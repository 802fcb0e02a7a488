"""Golden sets: sampling, drafting, fairness checks, splits, revision."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import bind, fact_present_col, fact_text_col, hash_int, jaccard_col, word_set_col
from tessera.sources.scratch import kept, small_or_shuffled

GROUP, LEAST_TOKENS = 4, 60
# Fixed value: citations, preprints and links mark a paragraph as junk.
JUNK = r"(?i)et al\.|arXiv|doi\.org|https?://|\[\d+\]\s*[A-Z][a-z]+, [A-Z]\."
NEAR = 0.5
STYLES = ("comparison", "conjunction", "bridge")


def sample_chunks(chunks: DataFrame, n: int, seed: int = 42, document_ids: list | None = None) -> DataFrame:
    """GS1: ceil(n/2)*4 chunks of at least 60 tokens, in an order only the seed and the ids decide."""
    rows = chunks.where(F.col("token_count") >= LEAST_TOKENS)
    if document_ids is not None:
        rows = rows.where(F.col("document_id").isin(document_ids))
    return rows.withColumn("_h", hash_int(F.lit(seed), "chunk_id")).orderBy("_h", "chunk_id").limit(-(-n // 2) * GROUP).drop("_h")


def batch_prompts(chunks: DataFrame, size: int = GROUP) -> DataFrame:
    """GS2: (batch, prompt) of a bounded sample (ord, document_name, content): groups of size, numbered."""
    numbered = chunks.withColumn("_n", F.row_number().over(Window.orderBy("ord")) - 1)  # a sample of bounded size
    batch = F.floor(F.col("_n") / size).cast("int")
    piece = F.concat(F.lit("["), (F.col("_n") % size).cast("string"), F.lit("] ("), F.col("document_name"), F.lit(")\n"), F.col("content"))
    per = numbered.groupBy(batch.alias("batch")).agg(F.array_sort(F.collect_list(F.struct("_n", piece.alias("t")))).alias("l"))
    return per.select("batch", F.array_join(F.transform("l", lambda x: x["t"]), "\n\n---\n\n").alias("prompt"))


def parse_qa(replies: DataFrame) -> DataFrame:
    """GS3: (batch, reply) -> (batch, pos, question, answer, chunks): JSON lines with both question and answer, fences ignored."""
    lines = replies.select("batch", F.posexplode(F.split("reply", "\n")).alias("pos", "line"))
    line = F.regexp_replace("line", r"^\s*,?\s*|\s*,?\s*$", "")
    lines = lines.where(~line.startswith("```")).withColumn("j", F.from_json(line, "question string, answer string, chunks array<int>"))
    return lines.where("length(j.question) > 0 and length(j.answer) > 0").select("batch", "pos", "j.question", "j.answer", "j.chunks")


def assemble_samples(qa: DataFrame, batches: DataFrame, n: int) -> DataFrame:
    """GS4: samples with their chunks. qa: parse_qa; batches: (batch, idx, chunk_id, document_name).

    The first of equal questions stays, indices name chunks of the own batch, a
    sample that cites none goes, the first n stay.
    """
    first = qa.withColumn("_n", F.row_number().over(Window.partitionBy(F.lower("question")).orderBy("batch", "pos"))).where("_n = 1").drop("_n")
    cited = first.select("batch", "pos", "question", "answer", F.posexplode("chunks").alias("at", "idx")).join(batches, ["batch", "idx"])
    per = cited.groupBy("batch", "pos", "question", "answer").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("at", "chunk_id"))), lambda x: x["chunk_id"]).alias("source_chunk_ids"),
        F.array_sort(F.collect_set("document_name")).alias("source_documents"),
    )
    top = per.orderBy("batch", "pos").limit(n)
    return top.select((F.row_number().over(Window.orderBy("batch", "pos")) - 1).alias("sample_index"), "question", "answer", "source_chunk_ids", "source_documents")


def passage_pool(chunks: DataFrame) -> DataFrame:
    """GS5: paragraphs of 150 to 511 characters, unique in the corpus, free of citations and links."""
    fit = F.length("content").between(150, 511) & ~F.col("content").rlike(JUNK) & (F.col("element_type") == "paragraph")
    once = chunks.groupBy(F.md5("content").alias("_md5")).agg(F.count(F.lit(1)).alias("_copies"))
    rows = chunks.where(fit).withColumn("_md5", F.md5("content")).join(once, "_md5")
    return rows.where("_copies = 1").drop("_md5", "_copies")


def near_dupes(chunks: DataFrame, passages: DataFrame, least: float = NEAR) -> DataFrame:
    """GS6: (passage_id, chunk_id, jaccard) of word sets, at least 0.5 alike.

    Prefix and positional filter: words are ordered by rarity, those of no passage first.
    Sets that are alike share one of the first words of each, as many as the bound
    allows to differ, and behind the first that they share both are long enough for what
    the bound asks of the two sizes. Only words of passages are joined, as numbers; sets
    are made once and stored.
    """
    sets = lambda df, key: kept(df.select(key, word_set_col("content").alias("w")).where("size(w) > 0"), "word-sets")
    c, p = sets(chunks, "chunk_id"), sets(passages, "passage_id")
    asked = kept(p.select(F.explode("w").alias("word")).distinct(), "passage-words")
    asked = small_or_shuffled(asked)
    freq = c.select(F.explode("w").alias("word")).join(asked, "word").groupBy("word").agg(F.count(F.lit(1)).alias("f"))
    # numbered from the rarest by ranges, without one task for all words
    freq = kept(freq.repartitionByRange("f", "word").sortWithinPartitions("f", "word").select("word", F.monotonically_increasing_id().alias("word_no")), "word-numbers")
    numbered = small_or_shuffled(freq)

    def firsts(side: DataFrame, key: str, n: str, at: str) -> DataFrame:
        """The rarest words of each set with their places: |x & y| >= least * |x|, so one of the first n - ceil(least * n) + 1 is shared."""
        words = side.select(key, F.size("w").alias(n), F.explode("w").alias("word")).join(numbered, "word").select(key, n, "word_no")
        own = Window.partitionBy(key)
        # words of no passage stand before the others
        place = F.col(n) - F.count(F.lit(1)).over(own) + F.row_number().over(own.orderBy("word_no")) - 1
        return words.withColumn(at, place.cast("int")).where(F.col(at) <= F.col(n) - F.ceil(F.col(n) * least))

    met = firsts(c, "chunk_id", "nc", "ic").join(small_or_shuffled(kept(firsts(p, "passage_id", "np", "ip"), "passage-firsts")), "word_no")
    left = F.least(F.col("nc") - F.col("ic"), F.col("np") - F.col("ip"))
    met = kept(met.where(left * (1 + least) >= (F.col("nc") + F.col("np")) * least).select("passage_id", "chunk_id").distinct(), "near-candidates")
    both = c.withColumnRenamed("w", "c").join(small_or_shuffled(met), "chunk_id").join(small_or_shuffled(p.withColumnRenamed("w", "p")), "passage_id")
    return both.select("passage_id", "chunk_id", F.round(jaccard_col(F.col("c"), F.col("p")), 6).alias("jaccard")).where(F.col("jaccard") >= least)


#: Words of the run that leads from a fact to the chunks that may state it.
ANCHOR = 4


def facts_in(facts: DataFrame, chunks: DataFrame) -> DataFrame:
    """(fact_id, chunk_id): chunks that state a fact in any wording. facts: (fact_id, wordings).

    A wording stands as a whole term, so its words are words of the chunk, one after
    the other: its first ANCHOR of them (all, if fewer) join the two. A wording that is
    one word is decided by that, of others the whole wording then decides.
    """
    words = lambda c: F.regexp_extract_all(c, F.lit("[0-9a-z]+"), F.lit(0))
    needles = facts.select("fact_id", F.explode(F.transform("wordings", fact_text_col)).alias("needle")).where("needle != ''").distinct()
    needles = needles.withColumn("_w", F.slice(words(F.col("needle")), 1, ANCHOR))
    needles = kept(needles.select("fact_id", "needle", F.size("_w").alias("k"), F.array_join("_w", " ").alias("key")), "fact-needles")
    sizes = [r["k"] for r in needles.select("k").distinct().collect()]  # at most ANCHOR + 1
    hay = kept(chunks.select("chunk_id", fact_text_col("content").alias("hay")), "fact-texts")
    found = []
    if runs := [k for k in sizes if k]:
        met = hay.select("chunk_id", F.explode(bind(lambda w: _runs(w, runs), words(F.col("hay")))).alias("key"))
        met = met.join(small_or_shuffled(needles.where("k > 0")), "key")
        met = kept(met.select("fact_id", "chunk_id", "needle", (F.col("needle") == F.col("key")).alias("whole"), "k"), "fact-candidates")
        found.append(met.where("whole and k = 1").select("fact_id", "chunk_id"))
        open_ = met.where("NOT (whole and k = 1)").select("fact_id", "chunk_id", "needle")
        found.append(_stated(hay.join(small_or_shuffled(open_), "chunk_id")))
    if 0 in sizes:  # wordings without an ASCII word: few, checked against every chunk
        bare = needles.where("k = 0").select("fact_id", "needle")
        found.append(_stated(hay.join(small_or_shuffled(bare), F.contains("hay", "needle"))))
    return reduce(DataFrame.unionByName, found or [needles.select("fact_id").crossJoin(chunks.select("chunk_id")).limit(0)]).distinct()


def _runs(words: Column, lengths: list[int]) -> Column:
    """Runs of so many words, up to ANCHOR; some are null where the words end."""
    joined = lambda a, b, skip: F.zip_with(a, F.slice(b, skip + 1, F.greatest(F.size(b) - skip, F.lit(0))), lambda x, y: F.concat(x, F.lit(" "), y))

    def of(pairs: Column) -> Column:
        some = {1: F.array_distinct(words), 2: pairs, 3: joined(pairs, words, 2), 4: joined(pairs, pairs, 2)}
        return F.concat(*[some[k] for k in lengths])

    return of(words) if lengths == [1] else bind(of, joined(words, words, 1))


def _stated(rows: DataFrame) -> DataFrame:
    whole = F.concat(F.lit(r"(?<![0-9a-z])\Q"), F.col("needle"), F.lit(r"\E(?![0-9a-z])"))
    return rows.where(F.contains("hay", "needle") & F.regexp_like("hay", whole)).select("fact_id", "chunk_id")


def fact_holders(facts: DataFrame, chunks: DataFrame, near: DataFrame) -> DataFrame:
    """GS7: holders of a fact outside the near-duplicates of its passage. facts: (fact_id, passage_id, wordings)."""
    held = facts_in(facts.select("fact_id", "wordings"), chunks).join(facts.select("fact_id", "passage_id"), "fact_id")
    return held.join(near.select("passage_id", "chunk_id"), ["passage_id", "chunk_id"], "left_anti").select("fact_id", "passage_id", "chunk_id")


def _has(text: str, wordings: Column) -> Column:
    return fact_present_col(text, wordings)


def check_single(drafts: DataFrame, chunks: DataFrame) -> DataFrame:
    """GS8: drafts (draft_id, question, answer, facts, gold_id) with reason, null if fair; the first reason that applies.

    Facts are judged in order: copied from the passage, stated nowhere else,
    not in the question. chunks: (chunk_id, content).
    """
    drafts = kept(drafts, "drafts")
    ids = kept(drafts.select("gold_id").distinct(), "gold-ids")
    golds = chunks.select(F.col("chunk_id").alias("gold_id"), F.col("content").alias("_gold")).join(small_or_shuffled(ids), "gold_id", "left_semi")
    rows = drafts.join(kept(golds, "gold-texts"), "gold_id", "left")
    n = F.coalesce(F.size("facts"), F.lit(0))
    bad_shape = (F.coalesce(F.length(F.trim("question")), F.lit(0)) == 0) | (F.coalesce(F.length("answer"), F.lit(0)) == 0) | ~n.between(1, 2)
    golds = rows.select(F.col("gold_id").alias("passage_id"), F.col("_gold").alias("content")).distinct()
    near = near_dupes(chunks, golds)
    each = rows.where(~bad_shape).select("draft_id", "gold_id", "question", "_gold", F.posexplode("facts").alias("at", "fact"))
    each = each.withColumn("fact_id", F.concat_ws("/", F.col("draft_id").cast("string"), F.col("at").cast("string")))
    first = each.select("fact_id", F.col("gold_id").alias("passage_id"), F.slice("fact", 1, 1).alias("wordings"))
    elsewhere = fact_holders(first, chunks, near).select("fact_id").distinct().withColumn("elsewhere", F.lit(True))
    each = each.join(elsewhere, "fact_id", "left")
    malformed = F.exists("fact", lambda w: F.coalesce(F.length(F.trim(w)), F.lit(0)) < 2)
    reason = (
        F.when(malformed, "malformed fact")
        .when(~_has("_gold", F.slice("fact", 1, 1)), "fact not in its passage")
        .when(F.coalesce("elsewhere", F.lit(False)), "fact also stated elsewhere")
        .when(_has("question", F.col("fact")), "question contains its answer")
    )
    firsts = each.withColumn("r", reason).where("r is not null").groupBy("draft_id").agg(F.min_by("r", "at").alias("r"))
    return rows.join(firsts, "draft_id", "left").withColumn("reason", F.when(bad_shape, "malformed").otherwise(F.col("r"))).select(*drafts.columns, "reason")


def check_multi(drafts: DataFrame, chunks: DataFrame) -> DataFrame:
    """GS9: drafts (draft_id, question, facts of both passages) with reason, null if fair."""
    each = drafts.select("draft_id", "question", F.size("facts").alias("n"), F.posexplode("facts").alias("at", "fact"))
    each = each.withColumn("fact_id", F.concat_ws("/", F.col("draft_id").cast("string"), F.col("at").cast("string")))
    told = each.groupBy("draft_id").agg(F.bool_or(_has("question", F.col("fact"))).alias("told"))
    held = facts_in(each.select("fact_id", F.slice("fact", 1, 1).alias("wordings")), chunks).join(each.select("fact_id", "draft_id", "n"), "fact_id")
    both = held.groupBy("draft_id", "chunk_id").agg(F.count_distinct("fact_id").alias("m"), F.max("n").alias("n")).where("m = n").select("draft_id").distinct().withColumn("both", F.lit(True))
    out = drafts.join(told, "draft_id", "left").join(both, "draft_id", "left")
    reason = (
        F.when(F.coalesce(F.length(F.trim("question")), F.lit(0)) == 0, "malformed")
        .when(F.col("told"), "question contains an answer")
        .when(F.col("both"), "one chunk states both facts")
    )
    return out.withColumn("reason", reason).select(*drafts.columns, "reason")


def check_records(rows: DataFrame, chunks: DataFrame) -> DataFrame:
    """GS10: finished rows (draft_id, question, answer, gold_contexts, facts) checked again: (draft_id, reason).

    Every gold text must be a chunk; facts belong to the first passage that states
    them; every passage must own one; then the single- or two-hop checks apply.
    """
    golds = rows.select("draft_id", F.posexplode("gold_contexts").alias("g", "content"))
    found = golds.join(chunks.groupBy("content").agg(F.min("chunk_id").alias("chunk_id")), "content", "left")
    lost = found.where("chunk_id is null").select("draft_id").distinct().withColumn("lost", F.lit(True))
    facts = rows.select("draft_id", F.posexplode("facts").alias("at", "fact"))
    owner = facts.join(found, "draft_id").where(_has("content", F.slice("fact", 1, 1))).groupBy("draft_id", "at").agg(F.min("g").alias("g"))
    stray = facts.join(owner, ["draft_id", "at"], "left_anti").select("draft_id").distinct().withColumn("stray", F.lit(True))
    idle = golds.join(owner.select("draft_id", "g").distinct(), ["draft_id", "g"], "left_anti").select("draft_id").distinct().withColumn("idle", F.lit(True))
    one = rows.where(F.size("gold_contexts") == 1).join(found.where("g = 0").select("draft_id", F.col("chunk_id").alias("gold_id")), "draft_id")
    single = check_single(one.select("draft_id", "question", "answer", "facts", "gold_id"), chunks).select("draft_id", F.col("reason").alias("r1"))
    multi = check_multi(rows.where(F.size("gold_contexts") > 1).select("draft_id", "question", "facts"), chunks).select("draft_id", F.col("reason").alias("r2"))
    out = rows.select("draft_id")
    for part in (lost, stray, idle, single, multi):
        out = out.join(part, "draft_id", "left")
    reason = F.when(F.col("lost"), "gold context not in corpus").when(F.col("stray"), "fact not in its passage").when(F.col("idle"), "passage contributes no fact")
    return out.select("draft_id", reason.otherwise(F.coalesce("r1", "r2")).alias("reason"))


def rejection_report(checked: DataFrame) -> DataFrame:
    """GS11: (document_name, reason, n); kept drafts under the reason `kept`."""
    return checked.groupBy("document_name", F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def split_dev_test(accepted: DataFrame, n: int, dev_fraction: float = 0.3, seed: int = 42) -> DataFrame:
    """GS12: the first n / documents accepted of each document, a seeded share of each in dev."""
    docs = accepted.agg(F.count_distinct("document_name").alias("d"))
    place = F.row_number().over(Window.partitionBy("document_name").orderBy("ord"))
    rows = accepted.withColumn("_i", place).crossJoin(F.broadcast(docs)).where(F.col("_i") <= F.floor(F.lit(n) / F.col("d")))  # one row
    own = Window.partitionBy("document_name")
    shuffled = F.row_number().over(own.orderBy(hash_int(F.lit(seed), "ord"), "ord"))
    count = F.count(F.lit(1)).over(own)
    split = F.when(shuffled <= F.bround(F.lit(dev_fraction) * count), "dev").otherwise("test")
    return rows.withColumn("split", split).drop("_i", "d")


def make_pairs(samples: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """GS13: n unordered pairs of (sample_id, document_name, gold_id) with different golds: half within a document, half across.

    Pairs are joined on seeded hash buckets: each sample meets as many others as
    n / samples asks for, not all of them.
    """
    size = samples.count()
    span = max(2, min(size, 4 * (-(-n // max(size, 1)) + 1)))
    order = F.row_number().over(Window.orderBy(hash_int(F.lit(seed), "sample_id"), "sample_id"))  # golden sets are small
    ranked = samples.withColumn("i", order)
    a = ranked.select(*[F.col(c).alias(f"{c}_a") for c in ("sample_id", "document_name", "gold_id", "i")])
    a = a.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(span - 1)))).withColumn("i_b", (F.col("i_a") + F.col("step") - 1) % size + 1)
    b = ranked.select(*[F.col(c).alias(f"{c}_b") for c in ("sample_id", "document_name", "gold_id", "i")])
    both = a.join(b, "i_b").where("gold_id_a != gold_id_b")
    pair = both.select(F.least("sample_id_a", "sample_id_b").alias("a"), F.greatest("sample_id_a", "sample_id_b").alias("b"), (F.col("document_name_a") == F.col("document_name_b")).alias("within")).distinct()
    place = F.row_number().over(Window.partitionBy("within").orderBy(hash_int(F.lit(seed), "a", "b"), "a", "b"))
    half = F.when(F.col("within"), F.lit(n - n // 2)).otherwise(F.lit(n // 2))
    top = pair.withColumn("i", place).where(F.col("i") <= half)
    number = F.row_number().over(Window.orderBy(F.desc("within"), "i")) - 1
    style = F.element_at(F.array(*[F.lit(s) for s in STYLES]), (number % len(STYLES) + 1).cast("int"))
    return top.select(number.alias("pair"), "a", "b", "within", style.alias("style"))


def revise(samples: DataFrame, drops: DataFrame, patches: DataFrame) -> DataFrame:
    """GS15: samples (line, question, gold_answer, gold_contexts) without dropped lines, patched columns replaced.

    patches: (line, question, gold_answer, drop_context); a context filter never
    empties the list. revised_from_v1 is the line of a patched row.
    """
    left = samples.join(drops.select("line").distinct(), "line", "left_anti")
    p = patches.select("line", F.col("question").alias("_q"), F.col("gold_answer").alias("_a"), F.col("drop_context").alias("_d"), F.lit(True).alias("_p"))
    rows = left.join(p, "line", "left")
    fewer = F.filter("gold_contexts", lambda c: F.col("_d").isNull() | ~F.contains(c, F.col("_d")))
    return rows.select(
        "line", F.coalesce("_q", "question").alias("question"), F.coalesce("_a", "gold_answer").alias("gold_answer"),
        F.when(F.size(fewer) > 0, fewer).otherwise(F.col("gold_contexts")).alias("gold_contexts"), F.when(F.col("_p"), F.col("line")).alias("revised_from_v1"),
    )
