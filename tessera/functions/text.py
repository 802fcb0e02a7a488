"""Text scalars: analyser, token sets, answer normalisation, hashes. All but the analyser are inlined by Catalyst."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import cache, reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.stemmer import Stems

# Common English function words.
STOPWORDS = (
    "a about above after again against all am an and any are as at be because been before being below between both but by can did do does doing don down "
    "during each few for from further had has have having he her here hers him his how i if in into is it its just me more most my no nor not now of off on "
    "once only or other our out over own same she should so some such than that the their them then there these they this those through to too under until "
    "up very was we were what when where which while who whom why will with you your"
).split()
WORD = r"[\p{L}\p{N}]+"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bind(fn: Callable[..., Column], *cols: Column) -> Column:
    """fn of columns that are computed once per row, however often fn uses them (also inside lambdas)."""
    row = F.struct(*[c.alias(f"c{i}") for i, c in enumerate(cols)])
    return F.element_at(F.transform(F.array(row), lambda s: fn(*[s[f"c{i}"] for i in range(len(cols))])), 1)


def string_array(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


class Analyzer:
    """LX1 in a worker: terms of lower-case texts, each distinct word stemmed once."""

    def __init__(self):
        self.words, self.stops, self.stems = re.compile(r"[^\W_]+").findall, frozenset(STOPWORDS), Stems()

    def terms(self, lowered: str) -> list[str]:
        return [self.stems[w] for w in self.words(lowered) if w not in self.stops]


@cache
def analyzer() -> Analyzer:
    """The worker's own, which remembers stems from one batch to the next."""
    return Analyzer()


def analyze_col(text: Column | str) -> Column:
    """LX1: lower-case words without stopwords, stemmed (Snowball English), one per position."""

    @F.pandas_udf("array<string>")
    def run(s: pd.Series) -> pd.Series:
        terms = analyzer().terms
        return pd.Series([None if t is None else terms(t) for t in s], dtype=object)

    return run(F.lower(col(text)))


def est_tokens_col(text: Column | str, empty_is_zero: bool = False) -> Column:
    """IG5: about four characters per token, at least one; the cost variant gives 0 for empty text."""
    n = F.greatest(F.lit(1), F.floor(F.length(col(text)) / 4).cast("int"))
    return F.when(F.coalesce(F.length(col(text)), F.lit(0)) == 0, 0).otherwise(n) if empty_is_zero else n


def word_set_col(text: Column | str) -> Column:
    """Distinct lower-case words between white space."""
    return F.array_distinct(F.filter(F.split(F.lower(col(text)), r"\s+"), lambda w: w != ""))


def jaccard_col(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays of distinct words, 0 for two empty ones."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return F.when(either > 0, both / either).otherwise(F.lit(0.0))


def cosine_col(a: Column | str, b: Column | str) -> Column:
    """Cosine similarity of two arrays of numbers as doubles."""
    a, b = col(a).cast("array<double>"), col(b).cast("array<double>")
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, v: u * v), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def hash_int(*parts: Column | str) -> Column:
    """Seeded hash that every SQL engine agrees on: the first 32 bits of an MD5, as a long."""
    text = F.concat_ws("|", *[col(p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


# ── answers ────────────────────────────────────────────────────────────────

# ASCII punctuation and the typographic marks dropped with it.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" + "“”‘’–—−…•×"
# Function words that make no claim.
CLAIM_STOPWORDS = (
    "is are was were be been being of to in on for and or with by as at from that this "
    "these those it its which what who how why when where does do did has have had not no "
    "can could will would than then there their they them we our you your i he she his her "
    "also such into about over per each both any all some more most other only so if but "
    "based according provided context documents document answer question information"
).split()
# The patterns answers are read with.
CITATION = r"\[\d+(?:\s*,\s*\d+)*\]"
SOURCES_SECTION = r"(?is)\n[\s#*]*(?:sources(?:\s+used)?|references)[\s*]*:.*\z"
ABSTENTION = (
    r"(?i)(?:do(?:es)?n'?t|do(?:es)? not) have (?:enough|sufficient) information"
    r"|not (?:enough|sufficient) information"
    r"|(?:context|documents?|chunks?|sources?)\b[^.]{0,40}(?:do(?:es)?n'?t|do(?:es)? not) "
    r"(?:contain|provide|include|mention|specify|state|say)"
    r"|cannot (?:be )?(?:answered|determined|answer|determine)"
)


def norm_tokens_col(text: Column | str) -> Column:
    """GM1: lower-case tokens without citation markers, punctuation and articles."""
    t = F.regexp_replace(F.lower(F.coalesce(col(text), F.lit(""))), CITATION, " ")
    t = F.translate(t, PUNCTUATION, "")
    t = F.regexp_replace(t, r"(?U)\b(?:a|an|the)\b", " ")
    return F.filter(F.split(t, r"(?U)\s+"), lambda w: w != "")


def strip_sources_col(answer: Column | str) -> Column:
    """GM2: the answer without its closing list of sources."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(col(answer), F.lit("")), SOURCES_SECTION, ""), r"^\s+|\s+$", "")


def claim_words_col(answer: Column | str) -> Column:
    """GM3: content words of the sentences that do not decline to answer."""
    sentences = F.split(strip_sources_col(answer), r"(?<=[.!?])\s+")
    claims = F.array_join(F.filter(sentences, lambda s: ~s.rlike(ABSTENTION)), " ")
    return F.filter(norm_tokens_col(claims), lambda w: ~w.isin(CLAIM_STOPWORDS))


def abstained_col(answer: Column | str) -> Column:
    """GM3: something was said, and none of it is a claim."""
    said = F.regexp_replace(F.coalesce(col(answer), F.lit("")), r"\s+", "") != ""
    return said & (F.size(claim_words_col(answer)) == 0)


def token_f1_arrays(pred: Column, ref: Column) -> Column:
    """F1 of two token arrays with multiplicity; 0 if either is empty."""
    count = lambda tokens, w: F.size(F.filter(tokens, lambda x: x == w))
    same = F.aggregate(F.array_distinct(pred), F.lit(0), lambda s, w: s + F.least(count(pred, w), count(ref, w)))
    return F.when(same > 0, 2.0 * same / (F.size(pred) + F.size(ref))).otherwise(F.lit(0.0))


def token_f1_col(pred: Column | str, ref: Column | str) -> Column:
    """GM4: token F1 of two texts."""
    return bind(token_f1_arrays, norm_tokens_col(pred), norm_tokens_col(ref))


def faithfulness_col(answer: Column | str, contexts: Column | str) -> Column:
    """GM5: share of the answer's claim words found in its contexts."""
    contexts = F.coalesce(col(contexts), F.array().cast("array<string>"))

    def share(words: Column, known: Column, said: Column) -> Column:
        found = F.size(F.filter(words, lambda w: F.array_contains(known, w)))
        none = F.size(contexts) == 0
        return F.when(said == "", 0.0).when(F.size(words) == 0, 1.0).when(none, 0.0).otherwise(found / F.size(words))

    return bind(share, claim_words_col(answer), F.array_distinct(norm_tokens_col(F.array_join(contexts, " "))), strip_sources_col(answer))


def _f1_or_zero(a: Column | str, b: Column | str, pred: Column, ref: Column) -> Column:
    given = (F.coalesce(F.length(col(a)), F.lit(0)) > 0) & (F.coalesce(F.length(col(b)), F.lit(0)) > 0)
    return F.when(given, token_f1_col(pred, ref)).otherwise(F.lit(0.0))


def relevance_col(question: Column | str, answer: Column | str) -> Column:
    """GM6: token F1 of question and answer."""
    return _f1_or_zero(question, answer, col(question), strip_sources_col(answer))


def correctness_col(answer: Column | str, gold: Column | str) -> Column:
    """GM7: token F1 of answer and gold answer."""
    return _f1_or_zero(answer, gold, strip_sources_col(answer), col(gold))


def hallucination_col(answer: Column | str, contexts: Column | str) -> Column:
    """GM10: 1 - faithfulness, rounded to 4 places."""
    return F.bround(1 - faithfulness_col(answer, contexts), 4)


def fact_text_col(text: Column | str) -> Column:
    """GM8: one spelling for the ways a fact is written (4,000 and 4000, 2.450 and 2.45, degrees Celsius, ...)."""
    t = F.translate(F.lower(F.coalesce(col(text), F.lit(""))), "−–×₂*®™©", "--x2")
    steps = [
        (r", and ", " and "),
        (r"(?<=\d),(?=\d{3})", ""),
        (r"(\d+)\.0+(?!\d)", "$1"),
        (r"(\d+\.\d*?[1-9])0+(?!\d)", "$1"),
        (r"\s*(?:°\s*c\b|degrees? celsius)", "°c"),
        (r"\s+", " "),
    ]
    return F.trim(reduce(lambda acc, s: F.regexp_replace(acc, *s), steps, t))


def fact_present_col(answer: Column | str, wordings: Column | str) -> Column:
    """GM8: any wording of the fact stands in the answer as a whole term."""

    def any_stands(hay: Column) -> Column:
        def stands(needle: Column) -> Column:
            return (needle != "") & F.regexp_like(hay, F.concat(F.lit(r"(?<![0-9a-z])\Q"), needle, F.lit(r"\E(?![0-9a-z])")))

        return F.coalesce(F.exists(F.transform(col(wordings), fact_text_col), stands), F.lit(False))

    return bind(any_stands, fact_text_col(answer))


def fact_recall_col(answer: Column | str, facts: Column | str) -> Column:
    """GM9: share of the facts that the answer states; 1 without facts."""
    said = strip_sources_col(answer)
    found = F.size(F.filter(col(facts), lambda f: fact_present_col(said, f)))
    return F.when(F.coalesce(F.size(col(facts)), F.lit(0)) <= 0, 1.0).otherwise(found / F.size(col(facts)))
