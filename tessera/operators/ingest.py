"""Ingestion: layout, chunking, enrichment, embedding, catalogue."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import est_tokens_col

TITLE, HEADING, HEADING_CHARS = 1.4, 1.15, 200
MIN_CHARS = 10
SIZE, OVERLAP = 512, 50
# Where a sentence ends, and the separator ladder, coarse to fine.
SENTENCE = re.compile(r"(?<=[.!?])\s+")
SEPARATORS = ("\n\n", "\n", ". ", "! ", "? ", "; ", ", ", " ", "")


def classify_blocks(spans: DataFrame) -> DataFrame:
    """IG1: blocks of decoded spans (doc, page, block, line, span, text, size, bold) with element type and section path.

    A block is compared with its document's mean font size over non-blank spans.
    Page and block order one document's window, nothing wider.
    """
    solid = spans.where(F.trim("text") != "")
    mean = solid.groupBy("doc").agg(F.avg("size").alias("mean_size"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "span", "text"))), lambda s: s["text"]), " ")
    per = solid.groupBy("doc", "page", "block").agg(F.trim(text).alias("content"), F.max("size").alias("size"), F.bool_or("bold").alias("bold"))
    per = per.where(F.length("content") >= 2).join(mean, "doc")
    kind = (
        F.when(F.col("size") >= TITLE * F.col("mean_size"), "title")
        .when((F.col("size") >= HEADING * F.col("mean_size")) | (F.col("bold") & (F.length("content") < HEADING_CHARS)), "heading")
        .otherwise("paragraph")
    )
    per = per.withColumn("element_type", kind)
    upto = Window.partitionBy("doc").orderBy("page", "block").rowsBetween(Window.unboundedPreceding, 0)
    section = F.last(F.when(F.col("element_type") != "paragraph", F.col("content")), ignorenulls=True).over(upto)
    return per.select("doc", "page", "block", "content", "element_type", section.alias("section_path"))


def drop_short(elements: DataFrame, least: int = MIN_CHARS) -> DataFrame:
    """IG2: elements with at least ten characters between blanks."""
    return elements.where(F.length(F.regexp_replace("content", r"^\s+|\s+$", "")) >= least)


def spans_over(sizes: np.ndarray, most: int, overlap: int, glue: int) -> Iterator[tuple[int, int]]:
    """(first, end) of runs of pieces that fill up to most, each begun with those of the run before that fit into overlap.

    Ends and beginnings are binary searches in running sums. A new piece counts with its
    glue, one carried over without; a run takes at least one new piece.
    """
    plain = np.concatenate([[0], np.cumsum(sizes)])
    glued = plain + glue * np.arange(len(plain))
    first = taken = 0
    while taken < len(sizes):
        room = most - (plain[taken] - plain[first])
        end = max(taken + 1, int(np.searchsorted(glued, glued[taken] + room, "right")) - 1)
        yield first, end
        back = int(np.searchsorted(plain, plain[end] - overlap, "left"))
        first, taken = max(back, first), end


def split_recursive(text: str, size: int = SIZE, overlap: int = OVERLAP, ladder: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Split at the coarsest separator present; what is still too long goes one rung down."""
    rung = next((i for i, s in enumerate(ladder) if s == "" or s in text), len(ladder) - 1)
    sep = ladder[rung]
    pieces = text.split(sep) if sep else text
    out = []
    for first, end in spans_over(np.fromiter(map(len, pieces), np.int64, len(pieces)), size, overlap, len(sep)):
        joined = sep.join(pieces[first:end])
        out += split_recursive(joined, size, overlap, ladder[1:]) if len(joined) > size and len(ladder) > 1 else [joined]
    return out


def pieces_col(text: Column, size: int, overlap: int) -> Column:
    @F.pandas_udf("array<string>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: [p for p in map(str.strip, split_recursive(t, size, overlap)) if p] if t else [])

    return run(text)


def chunk_recursive(elements: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """IG3: chunks of (doc_id, ordinal, content, ...), numbered through each document."""
    elements = drop_short(elements)
    rows = elements.withColumn("pieces", pieces_col(F.col("content"), size, overlap))
    rows = rows.select(*[c for c in elements.columns if c != "content"], F.posexplode("pieces").alias("_pos", "content"))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("ordinal", "_pos")) - 1
    return rows.withColumn("chunk_index", place).withColumn("token_count", est_tokens_col("content")).drop("_pos")


def chunk_hierarchical(
    elements: DataFrame, parent: tuple[int, int] = (1024, 100), child: tuple[int, int] = (256, 30), least: int = MIN_CHARS
) -> DataFrame:
    """IG4: parents and their children in one numbering; a child carries its parent's index and text, a parent lists its children.

    (doc_id, chunk_index, level, content, parent_index, parent_content, children)
    """
    parents = chunk_recursive(elements, *parent).select("doc_id", F.col("chunk_index").alias("_parent"), "content")
    kids = parents.withColumn("pieces", pieces_col(F.col("content"), *child))
    kids = kids.select("doc_id", "_parent", F.col("content").alias("parent_content"), F.posexplode("pieces").alias("_pos", "content"))
    kids = kids.where(F.length("content") >= least).select("doc_id", "_parent", (F.col("_pos") + 1).alias("_pos"), "content", "parent_content")
    both = parents.select("doc_id", "_parent", F.lit(0).alias("_pos"), "content", F.lit(None).cast("string").alias("parent_content")).unionByName(kids)
    both = both.withColumn("chunk_index", F.row_number().over(Window.partitionBy("doc_id").orderBy("_parent", "_pos")) - 1)
    own = Window.partitionBy("doc_id", "_parent")
    top = F.min("chunk_index").over(own)
    children = F.array_sort(F.collect_list(F.when(F.col("_pos") > 0, F.col("chunk_index"))).over(own))
    is_child = F.col("_pos") > 0
    return both.select(
        "doc_id", "chunk_index", F.when(is_child, "child").otherwise("parent").alias("level"), "content",
        F.when(is_child, top).alias("parent_index"), "parent_content", F.when(~is_child, children).alias("children"),
    )


def sentence_runs(text: str, words: int = 190, overlap: int = 60) -> list[str]:
    """Runs of whole sentences of up to words words, or of one longer sentence; each begins with the last of the run before, up to overlap words."""
    sentences = [s for s in SENTENCE.split(text.strip()) if s]
    ends = [0, *np.cumsum([len(s.split()) for s in sentences]).tolist()]
    return [" ".join(sentences[a:b]) for a, b in _sentence_spans(ends, words, overlap)]


def _sentence_spans(ends: list[int], words: int, overlap: int) -> Iterator[tuple[int, int]]:
    """(first, end) from the running word counts: where a run ends and the next begins are both places in them."""
    first, last = 0, len(ends) - 1
    while first < last:
        end = max(first + 1, bisect_right(ends, ends[first] + words) - 1)
        yield first, end
        if end == last:
            return
        first = min(end, max(first + 1, bisect_left(ends, ends[end] - overlap)))


def sentence_windows(docs: DataFrame, words: int = 190, overlap: int = 60) -> DataFrame:
    """IG6: (doc_id, window_index, content)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [sentence_runs(t.as_py() or "", words, overlap) for t in b.column(1)]
            n = np.array([len(x) for x in found], np.int64)
            doc = b.column(0).take(pa.array(np.repeat(np.arange(len(n)), n)))
            index = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            yield pa.RecordBatch.from_arrays([doc, pa.array(index.astype(np.int32)), pa.array([w for x in found for w in x], pa.string())], names=["doc_id", "window_index", "content"])

    return docs.select("doc_id", "content").mapInArrow(run, f"doc_id {kind}, window_index int, content string")


PROMPT_CHARS = 8000


def enrich(chunks: DataFrame, docs: DataFrame, complete: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """IG7: the model's context sentence put before each chunk; the chunk alone where the call failed.

    complete(df, prompt column) adds the columns reply and error (see MD1).
    """
    doc = F.when(F.length("_doc") > PROMPT_CHARS, F.concat(F.substring("_doc", 1, PROMPT_CHARS), F.lit("\n...[truncated]"))).otherwise(F.col("_doc"))
    full = docs.select(F.col("doc_id").alias("_id"), F.col("content").alias("_doc"))
    rows = chunks.join(full, chunks["doc_id"] == F.col("_id"))
    prompt = F.concat(F.lit("Situate the chunk in its document in one or two sentences.\n\nDocument:\n"), doc, F.lit("\n\nChunk:\n"), F.col("content"))
    done = complete(rows.withColumn("prompt", prompt).drop("_doc", "_id"), "prompt")
    ctx = F.nullif(F.trim("reply"), F.lit(""))
    text = F.coalesce(F.concat(ctx, F.lit("\n\n"), F.col("content")), F.col("content"))
    return done.withColumn("contextual_summary", ctx).withColumn("content", text).withColumn("token_count", est_tokens_col("content")).drop("prompt", "reply", "error")


def hashing_embedder(dim: int = 64) -> Callable[[list[str]], list[list[float]]]:
    """A deterministic embedder for tests: signed feature hashing of words, unit length."""

    def embed_texts(texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), dim), np.float32)
        for i, t in enumerate(texts):
            for w in (t or "").lower().split():
                h = int.from_bytes(hashlib.md5(w.encode()).digest()[:8], "little")
                out[i, h % dim] += 1 if h >> 63 else -1
        size = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, size, out=out, where=size > 0).tolist()

    return embed_texts


def embed(df: DataFrame, text_col: str, fn: Callable[[list[str]], list[list[float]]], dim: int, batch: int = 32) -> DataFrame:
    """IG8: one vector per text in batches; a zero vector where the call fails or falls short."""

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            texts, out = s.fillna("").tolist(), []
            for i in range(0, len(texts), batch):
                group = texts[i : i + batch]
                try:
                    got = list(fn(group))
                except Exception:  # a failed call is data, not a failed task
                    got = []
                got = [list(v) if v is not None and len(v) == dim else [0.0] * dim for v in got[: len(group)]]
                out += got + [[0.0] * dim] * (len(group) - len(got))
            yield pd.Series(out)

    return df.withColumn("embedding", run(text_col))


def list_documents(docs: DataFrame, chunks: DataFrame, status: str | None = None, limit: int = 100) -> DataFrame:
    """IG9: documents with chunk counts, newest first; none of a completed one means failed."""
    counts = chunks.groupBy("document_id").agg(F.count(F.lit(1)).alias("chunk_count"))
    rows = docs.join(counts, docs["doc_id"] == counts["document_id"], "left").drop("document_id")
    rows = rows.withColumn("chunk_count", F.coalesce("chunk_count", F.lit(0)))
    failed = (F.col("status") == "completed") & (F.col("chunk_count") == 0)
    rows = rows.withColumn("error_message", F.when(failed, "No text chunks extracted")).withColumn("status", F.when(failed, "failed").otherwise(F.col("status")))
    if status is not None:
        rows = rows.where(F.col("status") == status)
    return rows.orderBy(F.desc("created_at"), "doc_id").limit(limit)


def delete_documents(docs: DataFrame, chunks: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """IG10: what is left of documents and chunks, and (table, deleted) counts. ids: (doc_id)."""
    gone = ids.select("doc_id").distinct()
    left_docs = docs.join(gone, "doc_id", "left_anti")
    left_chunks = chunks.join(gone.withColumnRenamed("doc_id", "document_id"), "document_id", "left_anti")
    a = docs.join(gone, "doc_id", "left_semi").agg(F.lit("documents").alias("table"), F.count(F.lit(1)).alias("deleted"))
    b = chunks.join(gone.withColumnRenamed("doc_id", "document_id"), "document_id", "left_semi").agg(F.lit("chunks").alias("table"), F.count(F.lit(1)).alias("deleted"))
    return left_docs, left_chunks, a.union(b)
