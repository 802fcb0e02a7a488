"""Guardrails: personal data, prompt injection, groundedness. Patterns run as column expressions over whole tables."""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Kinds of personal data, their placeholders and patterns.
PII = [
    ("email", "[EMAIL_REDACTED]", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"),
    ("phone_us", "[PHONE_REDACTED]", r"(?<!\d)(?:\+?1[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b"),
    ("phone_intl", "[PHONE_REDACTED]", r"(?<!\d)\+\d{1,3}[-.\s]?\d{2,4}[-.\s]?\d{4,10}\b"),
    ("ssn", "[SSN_REDACTED]", r"\b\d{3}-\d{2}-\d{4}\b"),
    ("credit_card", "[CC_REDACTED]", r"\b(?:\d{4}[-\s]?){3}\d{4}\b"),
    ("ipv4", "[IP_REDACTED]", r"\b(?:(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\.){3}(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\b"),
]
# Injection patterns and their weights.
INJECTION = [
    ("ignore_instructions", 0.95, r"(?i)\b(?:ignore|disregard|forget|override)\s+(?:all\s+)?(?:(?:previous|prior|above|earlier|your|the)\s+){1,2}(?:instructions|prompts|rules|constraints|guidelines)"),
    ("role_impersonation", 0.85, r"(?i)(?:\byou\s+are\s+now\b|\bact\s+as\b|\bpretend\s+(?:to\s+be|you\s+are)\b|\bnew\s+instruction|\bsystem\s*:\s*|\bassistant\s*:\s*|<\|?system\|?>|<<SYS>>)"),
    ("prompt_leak", 0.80, r"(?i)\b(?:show|reveal|print|repeat|output|display)\s+(?:me\s+)?(?:your|the|system|initial|original|hidden)\s+(?:(?:system|initial|original|hidden)\s+)?(?:prompt|instructions|rules|message)"),
    ("jailbreak", 0.90, r"(?i)\b(?:(?-i:DAN)|do\s+anything\s+now|unrestricted\s+mode|no\s+restrictions|bypass\s+(?:safety|filter)|developer\s+mode|jailbreak\w*)\b"),
    ("delimiter_injection", 0.85, r"(?i)(?:```(?:system|instruction)|---\s*(?:NEW|OVERRIDE)|\[INST\]|\[/INST\]|<\|im_start\|>|<\|endoftext\|>)"),
    ("encoding_trick", 0.70, r"(?i)\b(?:base64|rot13|hex|decode|eval|exec)\s*[\(:]"),
    ("multi_step", 0.45, r"(?i)\b(?:after\s+(?:answering|that|this)|then\s+(?:ignore|do|execute|run|forget)|but\s+(?:first|before\s+that))\b"),
]
LEVELS = [(0.85, "critical"), (0.70, "high"), (0.50, "medium")]
THRESHOLD = 0.5
#: Java's \d, \w, \s and \b know ASCII only unless told otherwise.
UNICODE = "(?U)"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def pii_scan(df: DataFrame, col: str) -> DataFrame:
    """GD1: df with pii: array of (type, original, start, end), offsets in code points of the raw text.

    Only texts in which the JVM finds a pattern (GD3) are sent to Python for the offsets.
    """
    patterns = [(name, re.compile(p)) for name, _, p in PII]

    @F.pandas_udf("array<struct<type: string, original: string, start: int, end: int>>")
    def spans(s: pd.Series) -> pd.Series:
        found = lambda t: [{"type": n, "original": m.group(), "start": m.start(), "end": m.end()} for n, p in patterns for m in p.finditer(t)]
        return pd.Series([found(t) if t else [] for t in s], dtype=object)

    return df.withColumn("pii", spans(F.when(contains_pii_col(col), _col(col))))


def pii_counts_col(c: Column | str) -> Column:
    """Matches per kind on the raw text, all in the JVM."""
    return F.create_map(*[x for name, _, p in PII for x in (F.lit(name), F.coalesce(F.regexp_count(_col(c), F.lit(UNICODE + p)), F.lit(0)))])


def pii_redact_col(c: Column | str) -> Column:
    """GD2: patterns replaced one after the other, each on what the ones before left."""
    return reduce(lambda acc, p: F.regexp_replace(acc, UNICODE + p[2], p[1].replace("$", r"\$")), PII, _col(c))


def contains_pii_col(c: Column | str) -> Column:
    """GD3: any pattern matches."""
    return F.coalesce(reduce(lambda a, b: a | b, [_col(c).rlike(UNICODE + p) for _, _, p in PII]), F.lit(False))


def injection(df: DataFrame, col: str, threshold: float = THRESHOLD) -> DataFrame:
    """GD4: matched pattern names, confidence, risk_level, is_injection."""
    hits = F.filter(
        F.array(*[F.when(F.col(col).rlike(p), F.struct(F.lit(w).alias("weight"), F.lit(n).alias("name"))) for n, w, p in INJECTION]), lambda h: h.isNotNull()
    )
    df = df.withColumn("_hits", hits)
    top = F.array_max(F.transform("_hits", lambda h: h["weight"]))
    total = F.aggregate("_hits", F.lit(0.0), lambda a, h: a + h["weight"])
    conf = F.bround(F.least(F.lit(1.0), top + 0.1 * (total - top)), 4)
    df = df.withColumn("confidence", F.when(F.size("_hits") > 0, conf).otherwise(0.0))
    level = reduce(lambda acc, lv: acc.when(F.col("confidence") >= lv[0], lv[1]), LEVELS[1:], F.when(F.col("confidence") >= LEVELS[0][0], LEVELS[0][1])).otherwise("low")
    return (
        df.withColumn("risk_level", level)
        .withColumn("is_injection", F.col("confidence") >= threshold)
        .withColumn("matched", F.transform("_hits", lambda h: h["name"]))
        .drop("_hits")
    )


def check_input(df: DataFrame, col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """GD5: redact, then look for injections in the redacted text; blocked with the reason."""
    out = injection(df.withColumn("redacted", pii_redact_col(col)), "redacted", threshold)
    why = F.format_string("Prompt injection detected (confidence %.2f): %s", F.col("confidence"), F.array_join("matched", ", "))
    return out.withColumn("blocked", F.col("is_injection")).withColumn("reason", F.when(F.col("is_injection"), why))


def redact_output(df: DataFrame, col: str = "answer") -> DataFrame:
    """GD6: answers as they are stored."""
    return df.withColumn("pii_found", contains_pii_col(col)).withColumn(col, pii_redact_col(col))


CHUNK_CHARS, ANSWER_CHARS = 500, 2000


def groundedness_prompt_col(answer: Column | str, contexts: Column | str) -> Column:
    parts = F.array_join(F.transform(_col(contexts), lambda c: F.substring(c, 1, CHUNK_CHARS)), "\n---\n")
    return F.concat(F.lit("Rate 0 to 10 how far the context supports the answer. Reply with JSON {\"score\": n}.\n\nContext:\n"), parts, F.lit("\n\nAnswer:\n"), F.substring(_col(answer), 1, ANSWER_CHARS))


def groundedness(replies: DataFrame, threshold: float = 0.7) -> DataFrame:
    """GD7: (answer, contexts, reply) -> score in 0..1, grounded. A failed call (null reply) lets the answer pass."""
    number = F.regexp_extract("reply", r"(\d+(?:\.\d+)?)", 1).try_cast("double")
    json = F.get_json_object(F.regexp_extract("reply", r"(?s)(\{.*\})", 1), "$.score").try_cast("double")
    raw = F.coalesce(json, number, F.lit(5.0))
    empty = (F.coalesce(F.length(F.trim("answer")), F.lit(0)) == 0) | (F.coalesce(F.size("contexts"), F.lit(0)) <= 0)
    score = F.when(empty | F.col("reply").isNull(), 1.0).otherwise(F.least(F.greatest(raw, F.lit(0.0)), F.lit(10.0)) / 10)
    return replies.withColumn("score", score).withColumn("grounded", F.col("score") >= threshold)
