"""UD1-UD3: the scalars as SQL functions, pluggable models by name, the chunker as a table function."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import guard, ingest

_models: dict[tuple[str, str], Callable] = {}
KINDS = ("embedder", "scorer", "completion")


def register_model(kind: str, name: str, fn: Callable) -> None:
    """UD2: make a model callable by name; IG8, RR1 and MD1 run it."""
    if kind not in KINDS:
        raise ValueError(f"unknown kind {kind!r}")
    _models[kind, name] = fn


def model(kind: str, name: str) -> Callable:
    if (kind, name) not in _models:
        raise KeyError(f"no {kind} named {name!r}")
    return _models[kind, name]


def _inlined(spark: SparkSession, name: str, args: str, returns: str, expr: str) -> None:
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {returns} RETURN {expr}")


def register_sql(spark: SparkSession) -> None:
    """UD1: SQL functions that Catalyst inlines, and the Arrow-fed ones that it cannot."""
    words = "array_distinct(filter(split(lower({}), '\\\\s+'), w -> w != ''))"
    a, b = words.format("a"), words.format("b")
    both = f"size(array_intersect({a}, {b}))"
    _inlined(spark, "jaccard", "a STRING, b STRING", "DOUBLE", f"coalesce(try_divide({both}, size({a}) + size({b}) - {both}), 0.0D)")
    dot = "aggregate(zip_with({}, {}, (x, y) -> x * y), 0.0D, (s, v) -> s + v)"
    _inlined(spark, "cosine", "a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE", f"{dot.format('a', 'b')} / nullif(sqrt({dot.format('a', 'a')}) * sqrt({dot.format('b', 'b')}), 0.0D)")
    _inlined(spark, "est_tokens", "t STRING", "INT", "greatest(1, cast(floor(length(t) / 4) as int))")
    redacted = "t"
    quote = lambda s: "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"
    for _, mark, pattern in guard.PII:
        redacted = f"regexp_replace({redacted}, {quote(guard.UNICODE + pattern)}, {quote(mark)})"
    _inlined(spark, "pii_redact", "t STRING", "STRING", redacted)
    hits = "filter(array(" + ", ".join(f"if(t rlike {quote(p)}, {w}D, null)" for _, w, p in guard.INJECTION) + "), w -> w is not null)"
    conf = f"array_max({hits}) + 0.1D * (aggregate({hits}, 0.0D, (s, w) -> s + w) - array_max({hits}))"
    _inlined(spark, "injection_confidence", "t STRING", "DOUBLE", f"if(size({hits}) = 0, 0.0D, bround(least(1.0D, {conf}), 4))")
    _register_arrow(spark)
    spark.udtf.register("chunk_text", chunk_text_udtf())


def _register_arrow(spark: SparkSession) -> None:
    """token_f1 and fact_present, whose plans are too long to inline as SQL text."""
    marks, table = re.compile(T.CITATION), str.maketrans("", "", T.PUNCTUATION)

    def tokens(t: str | None) -> list[str]:
        return re.sub(r"\b(?:a|an|the)\b", " ", marks.sub(" ", (t or "").lower()).translate(table)).split()

    def f1(a: str | None, b: str | None) -> float:
        x, y = tokens(a), tokens(b)
        same = sum((Counter(x) & Counter(y)).values())
        return 2 * same / (len(x) + len(y)) if same else 0.0

    def spelled(t: str | None) -> str:
        t = (t or "").lower().translate(str.maketrans("−–×₂", "--x2", "*®™©")).replace(", and ", " and ")
        for pattern, with_ in ((r"(?<=\d),(?=\d{3})", ""), (r"(\d+)\.0+(?!\d)", r"\1"), (r"(\d+\.\d*?[1-9])0+(?!\d)", r"\1"), (r"\s*(?:°\s*c\b|degrees? celsius)", "°c")):
            t = re.sub(pattern, with_, t)
        return " ".join(t.split())

    def stated(answer: str | None, wording: str | None) -> bool:
        needle = spelled(wording)
        return bool(needle) and re.search(rf"(?<![0-9a-z]){re.escape(needle)}(?![0-9a-z])", spelled(answer)) is not None

    def token_f1(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([f1(x, y) for x, y in zip(a, b)], dtype="float64")

    def fact_present(answer: pd.Series, wording: pd.Series) -> pd.Series:
        return pd.Series([stated(a, w) for a, w in zip(answer, wording)], dtype="bool")

    spark.udf.register("token_f1", F.pandas_udf(token_f1, "double"))
    spark.udf.register("fact_present", F.pandas_udf(fact_present, "boolean"))


def chunk_text_udtf() -> Any:
    """UD3: SELECT * FROM docs, LATERAL chunk_text(text, 512, 50)."""

    class ChunkText:
        def eval(self, text: str, size: int, overlap: int) -> Iterator[tuple]:
            n = 0
            for piece in ingest.split_recursive(text or "", size, overlap) if text else []:
                if piece.strip():
                    yield n, piece.strip()
                    n += 1

    return F.udtf(ChunkText, returnType="chunk_index int, content string")
