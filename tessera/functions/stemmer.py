"""English stemming after the published Snowball definition (Porter 2), as Python for workers and as DuckDB SQL for oracles.

A word's stem depends on the word alone, so a worker stems each distinct word once
and remembers it.
"""

from __future__ import annotations

import re

# The algorithm's letters, endings and exceptions as published.
VOWELS = "aeiouy"
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
LI_AFTER = "cdeghkmnrt"
REGION_STARTS = ("gener", "commun", "arsen")
WHOLE = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
KEPT_AFTER_PLURAL = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
STEP_2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate",
    "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble",
    "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
STEP_3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion")

_V, _C = f"[{VOWELS}]", f"[^{VOWELS}]"
#: Up to the first consonant behind a vowel: what stands before a region.
_BEFORE_REGION = f"^{_C}*{_V}+{_C}"
#: A short syllable at the end.
_SHORT = f"(?:^{_V}{_C}|{_C}{_V}[^{VOWELS}wxY])$"
#: One of some endings; the leftmost match is the longest.
_ONE_OF = lambda ends: f"(?:{'|'.join(ends)})$"

_region, _short, _vowel = re.compile(_BEFORE_REGION), re.compile(_SHORT), re.compile(_V)
_y = re.compile(f"({_V})y")
_starts = re.compile(f"^(?:{'|'.join(REGION_STARTS)})")
_plural = re.compile(_ONE_OF(("sses", "ied", "ies", "us", "ss", "s")))
_past = re.compile(_ONE_OF(("eedly", "eed", "ingly", "edly", "ing", "ed")))
_2, _3, _4 = (re.compile(_ONE_OF(ends)) for ends in (STEP_2, STEP_3, STEP_4))
_double = re.compile(_ONE_OF(DOUBLES))
_apostrophe = re.compile("(?:'s'|'s|')$")


def _regions(w: str) -> tuple[int, int]:
    """Where the regions R1 and R2 begin."""
    m = _starts.match(w) or _region.match(w)
    if not m:
        return len(w), len(w)
    n = _region.match(w[m.end() :])
    return m.end(), m.end() + n.end() if n else len(w)


def stem(word: str) -> str:
    """The stem of a lower-case word."""
    if len(word) <= 2:
        return word
    if word in WHOLE:
        return WHOLE[word]
    w = word.removeprefix("'")
    w = _y.sub(r"\1Y", "Y" + w[1:] if w.startswith("y") else w)
    r1, r2 = _regions(w)
    w = _apostrophe.sub("", w)
    if m := _plural.search(w):
        end, base = m[0], w[: m.start()]
        if end == "sses":
            w = base + "ss"
        elif end in ("ied", "ies"):
            w = base + ("i" if len(base) > 1 else "ie")
        elif end == "s" and _vowel.search(base[:-1]):
            w = base
    if w in KEPT_AFTER_PLURAL:
        return w
    if m := _past.search(w):
        end, base = m[0], w[: m.start()]
        if end.startswith("eed"):
            w = base + "ee" if m.start() >= r1 else w
        elif _vowel.search(base):
            if base.endswith(("at", "bl", "iz")):
                w = base + "e"
            elif _double.search(base):
                w = base[:-1]
            else:
                w = base + "e" if len(base) <= r1 and _short.search(base) else base
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in VOWELS:
        w = w[:-1] + "i"
    if (m := _2.search(w)) and m.start() >= r1:
        end, base = m[0], w[: m.start()]
        if (end != "li" or base[-1:] in tuple(LI_AFTER)) and (end != "ogi" or base.endswith("l")):
            w = base + STEP_2[end]
    if (m := _3.search(w)) and m.start() >= (r2 if m[0] == "ative" else r1):
        w = w[: m.start()] + STEP_3[m[0]]
    if (m := _4.search(w)) and m.start() >= r2 and (m[0] != "ion" or w[: m.start()].endswith(("s", "t"))):
        w = w[: m.start()]
    last = len(w) - 1
    if w.endswith("e") and (last >= r2 or last >= r1 and not _short.search(w[:-1])) or w.endswith("ll") and last >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


class Stems(dict):
    """Stem of each word, remembered while they are few."""

    LIMIT = 250_000

    def __missing__(self, word: str) -> str:
        if len(self) >= self.LIMIT:
            self.clear()
        self[word] = s = stem(word)
        return s


# ── the same in DuckDB ─────────────────────────────────────────────────────


def _cases(expr: str, values: dict[str, str]) -> str:
    return f"CASE {expr} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in values.items()) + " END"


def stems_sql(words: str) -> str:
    """CTEs that end in stems(word, stem) for words, a CTE with a column word without apostrophes. A stage holds the word so far as w."""
    cut = "left(w, len(w) - len(e))"
    ending = lambda ends, name, source: f"{name} AS (SELECT *, regexp_extract(w, '{_ONE_OF(ends)}') AS e FROM {source})"
    short = lambda x: f"regexp_matches({x}, '{_SHORT}')"
    in_r1, in_r2 = "len(w) - len(e) >= r1", "len(w) - len(e) >= r2"
    return f"""
st_y AS (SELECT word, regexp_replace(regexp_replace(word, '^y', 'Y'), '({_V})y', '\\1Y', 'g') AS w FROM {words}),
st_1 AS (SELECT *, len(regexp_extract(w, '^(?:{'|'.join(REGION_STARTS)})')) AS named, len(regexp_extract(w, '{_BEFORE_REGION}')) AS found FROM st_y),
st_2 AS (SELECT word, w, CASE WHEN named > 0 THEN named WHEN found > 0 THEN found ELSE len(w) END AS r1 FROM st_1),
st_3 AS (SELECT *, len(regexp_extract(substr(w, r1 + 1), '{_BEFORE_REGION}')) AS more FROM st_2),
st_r AS (SELECT word, w, r1, CASE WHEN more > 0 THEN r1 + more ELSE len(w) END AS r2 FROM st_3),
{ending(("sses", "ied", "ies", "us", "ss", "s"), "st_4", "st_r")},
st_a AS (SELECT word, r1, r2, CASE
    WHEN e = 'sses' THEN {cut} || 'ss'
    WHEN e IN ('ied', 'ies') THEN {cut} || CASE WHEN len(w) > 4 THEN 'i' ELSE 'ie' END
    WHEN e = 's' AND regexp_matches(left(w, len(w) - 2), '{_V}') THEN {cut} ELSE w END AS w FROM st_4),
{ending(("eedly", "eed", "ingly", "edly", "ing", "ed"), "st_5", "st_a")},
st_b AS (SELECT word, w AS plural, r1, r2, CASE
    WHEN e = '' THEN w
    WHEN e LIKE 'eed%' THEN CASE WHEN {in_r1} THEN {cut} || 'ee' ELSE w END
    WHEN NOT regexp_matches({cut}, '{_V}') THEN w
    WHEN regexp_matches({cut}, '(?:at|bl|iz)$') THEN {cut} || 'e'
    WHEN regexp_matches({cut}, '{_ONE_OF(DOUBLES)}') THEN left(w, len(w) - len(e) - 1)
    WHEN len(w) - len(e) <= r1 AND {short(cut)} THEN {cut} || 'e'
    ELSE {cut} END AS w FROM st_5),
st_c AS (SELECT word, plural, r1, r2, CASE WHEN len(w) > 2 THEN regexp_replace(w, '({_C})[yY]$', '\\1i') ELSE w END AS w FROM st_b),
{ending(STEP_2, "st_6", "st_c")},
st_d AS (SELECT word, plural, r1, r2, CASE
    WHEN e = '' OR NOT {in_r1} OR e = 'li' AND NOT regexp_matches({cut}, '[{LI_AFTER}]$') OR e = 'ogi' AND {cut} NOT LIKE '%l' THEN w
    ELSE {cut} || {_cases('e', STEP_2)} END AS w FROM st_6),
{ending(STEP_3, "st_7", "st_d")},
st_e AS (SELECT word, plural, r1, r2, CASE
    WHEN e = '' OR NOT {in_r1} OR e = 'ative' AND NOT {in_r2} THEN w ELSE {cut} || {_cases('e', STEP_3)} END AS w FROM st_7),
{ending(STEP_4, "st_8", "st_e")},
st_f AS (SELECT word, plural, r1, r2, CASE
    WHEN e = '' OR NOT {in_r2} OR e = 'ion' AND NOT regexp_matches({cut}, '[st]$') THEN w ELSE {cut} END AS w FROM st_8),
st_g AS (SELECT word, plural, CASE
    WHEN w LIKE '%e' AND (len(w) > r2 OR len(w) > r1 AND NOT {short('left(w, len(w) - 1)')}) OR w LIKE '%ll' AND len(w) > r2 THEN left(w, len(w) - 1)
    ELSE w END AS w FROM st_f),
stems AS (SELECT word, CASE WHEN len(word) <= 2 THEN word
    WHEN word IN ({', '.join(f"'{k}'" for k in WHOLE)}) THEN {_cases('word', WHOLE)}
    WHEN plural IN ({', '.join(f"'{k}'" for k in KEPT_AFTER_PLURAL)}) THEN plural
    ELSE replace(w, 'Y', 'y') END AS stem FROM st_g)"""
