"""HTML extraction by consensus host paths.

Each page scores its containers by the unlinked text of the blocks right below
them, text in an article or main element more, most of all against what follows the only
one on the page (longer talk behind an article does not outweigh it); the generalised path (tags and classes, digits masked) of its best one is
its vote. Spark counts the votes per host, and every page is extracted again from
the elements on its host's best winning path: a path wins if at least SHARE of the
host's votes are for it (so a host has at most 1 / SHARE of them). A page without
any of them falls back to its own best container.

Within the container, menus, headers, footers, sidebars, notices, adverts, forms,
comments and their like are left out by tag, role and whole class names. What
stands around the container counts for nothing, and neither does the name of an
element that holds the article or, with a heading, most of the page's text. A page's
heading right before the container belongs to it.

Defined results: null html gives the empty text; a null url is a host of its
own; repeated rows give repeated rows; an empty table gives no rows; extra
columns play no part. Whole pages are read, whatever their length.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.sources.scratch import kept

from .common import small_or_shuffled

#: Share of a host's votes that makes a path one of its winners.
SHARE = 0.02
#: Prose beside a container, relative to its own, that moves the choice to its parent: of like elements, of unnamed ones.
LIKE, OTHER = 0.15, 0.3
#: What the text of an article or main element counts for; of the only one on a page, beside what follows it.
STRONG, LONE = 3.0, 8.0

#: Attributes of a tag: a quote opens a value only right after "=".
_ATTRS = r"(?:=\s*(?:\"[^\"]*\"|'[^']*')|[^>])*+"
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)"
    r"|<(?P<raw>script|style|noscript|template|svg|iframe|object|select|textarea|title|math|canvas|video|audio)(?=[\s/>])" + _ATTRS + r">.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>" + _ATTRS + r")>"
    r"|<[!?][^>]*>",
    re.DOTALL | re.IGNORECASE,
)
#: What closes a script, a comment or the like; a tag or comment that the page ends in.
_CLOSED = re.compile(r"<!--.*-->|<!\[CDATA\[.*\]\]>|<([a-z]+)\b.*</\1\s*>", re.DOTALL | re.IGNORECASE)
_UNENDED = re.compile(r"</?[a-zA-Z][^>]*\Z|<!--.*\Z", re.DOTALL)
_ATTR = re.compile(r"([^\s=/>\"'<]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split()
)
_ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split()
)
#: An element that ends open ones of the named tags, up to a boundary.
_ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_BOUNDARY = frozenset("ul ol dl table menu body html article section div".split())
_PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre dd dt td th figcaption".split())
_OUT_TAGS = frozenset("nav footer aside button dialog menu head".split())
_OUT_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog".split())
_COMMENTS = frozenset("comment comments commentlist disqus reply replies respond".split())
_OUT_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert alerts newsletter "
    "subscribe subscription signup share sharing social related recommended recommendations sidebar sidebars widget widgets menu nav navbar navigation breadcrumb "
    "breadcrumbs footer masthead topbar pagination pager popup modal overlay login search toolbar copyright".split()
)
#: Words that change nothing in a class name beside one of those above.
_NEUTRAL = frozenset(
    "area articles bar block body bottom box button buttons column container content desktop entry fixed form global group icons inner item items layer left links list "
    "main message mobile module n outer page panel placeholder post posts primary region right row secondary section site slot sticky story text thread title top unit wrap wrapper zone article".split()
)
_GOOD_WORDS = frozenset("article content entry post story body text main".split())
#: What an element is: nothing special, part of the frame by name, a page header, part of the frame in any case.
PLAIN, SOFT, HEAD, HARD = range(4)


def kind_of(tag: str, found: dict[str, str]) -> int:
    role = found.get("role", "").lower()
    if tag in _OUT_TAGS or "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "").lower():
        return HARD
    kind = SOFT if role in _OUT_ROLES or tag in ("form", "fieldset") else HEAD if tag == "header" else PLAIN
    if tag in ("html", "body", "main"):
        return kind
    for name in f"{found.get('class', '')} {found.get('id', '')}".split():
        words = {w.lower() for w in _WORDS.findall(name)}
        if words & _COMMENTS and words <= _COMMENTS | _OUT_WORDS | _NEUTRAL:
            return HARD
        if words & _OUT_WORDS and words <= _OUT_WORDS | _NEUTRAL and tag != "article":
            kind = max(kind, SOFT)
        elif "header" in words and words <= _NEUTRAL - {"article", "post", "entry", "story", "content", "section"} | {"header"}:
            kind = max(kind, HEAD)
    return kind


class Page:
    """Elements in document order as columns (tag, parent, path, kind, ...), and the blocks of text between their tags."""

    def __init__(self, source: str):
        self.tag, self.parent, self.path, self.kind, self.good, self.link = [""], [0], [0], [PLAIN], [1.0], [False]
        self.paths: dict[tuple[int, str], int] = {}
        self.labels = [(0, "")]
        #: element, text, characters of it in links
        self.blocks: list[tuple[int, str, int]] = []
        self._read(source)
        self._weigh()

    def _add(self, tag: str, attrs: str, parent: int) -> int:
        found = {k.lower(): (v or "").strip("\"'") for k, v in _ATTR.findall(attrs)} if attrs.strip(" /") else {}
        names = found.get("class", "")
        label = tag + "".join(sorted("." + re.sub(r"\d+", "N", c) for c in names.split()))
        key = (self.path[parent], label)
        if key not in self.paths:
            self.paths[key] = len(self.labels)
            self.labels.append(key)
        words = {w.lower() for w in _WORDS.findall(f"{names} {found.get('id', '')}")} if found else ()
        strong = tag in ("article", "main") or found.get("role") == "main" or found.get("itemprop") == "articleBody"
        self.tag.append(tag)
        self.parent.append(parent)
        self.path.append(self.paths[key])
        self.kind.append(kind_of(tag, found))
        self.good.append(STRONG if strong else 1.5 if _GOOD_WORDS.intersection(words) else 1.0)
        self.link.append(self.link[parent] or tag == "a")
        return len(self.tag) - 1

    def _read(self, source: str) -> None:
        stack, parts, linked, at = [0], [], 0, 0
        end, m = source.rfind(">") + 1, None  # no tag can end behind it
        tag_of, open_ = self.tag, Counter()

        def flush() -> None:
            nonlocal linked
            text = " ".join(entities.unescape("".join(parts)).split()) if parts else ""
            if text:
                k = stack[-1]
                while tag_of[k] in _INLINE:
                    k = self.parent[k]
                self.blocks.append((k, text, linked))
            parts.clear()
            linked = 0

        def close(k: int) -> None:
            open_.subtract(tag_of[x] for x in stack[k:])
            del stack[k:]

        for m in _TOKEN.finditer(source, 0, end):
            if m.start() > at:
                piece = source[at : m.start()]
                parts.append(piece)
                if self.link[stack[-1]]:
                    linked += len(piece.strip())
            at = m.end()
            tag = (m["tag"] or "").lower()
            if not tag:
                continue
            if tag in _VOID:
                if tag in ("br", "hr"):
                    parts.append(" ")
                continue
            if m["end"]:
                if tag in _INLINE:
                    k = len(stack) - 1
                    while k and tag_of[stack[k]] in _INLINE and tag_of[stack[k]] != tag:
                        k -= 1
                    if tag_of[stack[k]] == tag:
                        close(k)
                elif open_[tag] > 0:
                    flush()
                    k = len(stack) - 1
                    while tag_of[stack[k]] != tag:
                        k -= 1
                    close(k)
                elif tag == "p":
                    flush()
                continue
            if tag not in _INLINE:
                flush()
                if tag in _ENDS_P:
                    k = len(stack) - 1
                    while k and tag_of[stack[k]] in _INLINE:
                        k -= 1
                    if tag_of[stack[k]] == "p":
                        close(k)
                ends = _ENDS.get(tag, ())
                for k in range(len(stack) - 1, 0, -1) if ends else ():
                    if tag_of[stack[k]] in ends:
                        close(k)
                    elif tag_of[stack[k]] in _BOUNDARY:
                        break
            stack.append(self._add(tag, m["attrs"], stack[-1]))
            open_[tag] += 1
        # what follows an unclosed script or comment is part of it, and an unended tag is no text
        hides = m and at == end and (m["raw"] or m.group().startswith(("<!--", "<![CDATA[")))
        if not hides or _CLOSED.fullmatch(m.group()):
            parts.append(_UNENDED.sub("", source[at:]))
        flush()

    def _weigh(self) -> None:
        """prose: unlinked text in an element; out: it is in the page's frame; score: as a container."""
        n = len(self.tag)
        prose, holds, heads = [0] * n, [False] * n, [False] * n
        weights = [max(0, len(text) - 2 * linked) for _, text, linked in self.blocks]
        for (k, _, _), w in zip(self.blocks, weights):
            prose[k] += w
        for k in range(n - 1, 0, -1):
            p = self.parent[k]
            prose[p] += prose[k]
            holds[p] |= holds[k] or self.good[k] == STRONG
            heads[p] |= heads[k] or self.tag[k] == "h1"
        for k in range(n):
            if self.kind[k] in (SOFT, HEAD) and (holds[k] or (self.kind[k] == SOFT and heads[k] and 2 * prose[k] >= prose[0])):
                self.kind[k] = PLAIN
        #: article or main around an element, itself included
        self.around = around = [0] * n
        self.out = out = [False] * n
        for k in range(1, n):
            p = self.parent[k]
            around[k] = k if self.good[k] == STRONG else around[p]
            out[k] = out[p] or self.kind[k] in (SOFT, HARD) or (self.kind[k] == HEAD and not around[k])
        self.score, self.prose = [0.0] * n, [0] * n
        for (k, _, _), w in zip(self.blocks, weights):
            if not out[k] and w:
                self.prose[k] += w
                holder = self.parent[k] if self.tag[k] in _PARAGRAPHS else k
                self.score[holder] += w
                if holder:
                    self.score[self.parent[holder]] += w / 3
        for k in range(n - 1, 0, -1):
            self.prose[self.parent[k]] += self.prose[k]

    def best(self) -> int | None:
        """The best container: by score, then the article around it, or its parent where like elements beside it hold prose too."""
        worth = lambda k: 0.0 if self.out[k] else self.score[k] * self.good[k]
        at = max(range(len(self.tag)), key=worth)
        strong = [k for k in range(1, len(self.tag)) if self.around[k] == k and not self.around[self.parent[k]] and not self.out[k]]
        if len(strong) == 1 and strong[0] < at and not self.around[at]:  # text behind the page's only article
            own = max((k for k in range(strong[0], len(self.tag)) if self.around[k]), key=worth)
            at = own if LONE / STRONG * worth(own) >= worth(at) else at
        if self.out[at] or not self.score[at]:
            return None
        at = self.around[at] or at
        like: dict[tuple[int, int], int] = defaultdict(int)
        for k in range(1, len(self.tag)):
            if not self.out[k]:
                like[self.parent[k], self.path[k]] += self.prose[k]
        while at and self.tag[at] not in ("body", "html"):
            p, own = self.parent[at], self.prose[at]
            unnamed = self.good[at] == 1.0 and "." not in self.labels[self.path[at]][1]
            if like[p, self.path[at]] - own < LIKE * own and not (unnamed and self.prose[p] - own >= OTHER * own):
                break
            at = self.around[p] or p
        return at

    def path_of(self, k: int) -> str:
        labels, at = [], self.path[k]
        while at:
            at, label = self.labels[at]
            labels.append(label)
        return "/".join(reversed(labels))

    def on(self, path: str) -> set[int]:
        """The elements on a path."""
        at = 0
        for label in path.split("/"):
            at = self.paths.get((at, label), -1)
        return {k for k, p in enumerate(self.path) if p == at} if at > 0 else set()

    def text_in(self, chosen: set[int]) -> list[str]:
        """Blocks inside the chosen elements that are no part of the frame, and the heading before the first of them."""
        state = [0] * len(self.tag)  # 0: outside, 1: inside and kept, 2: inside and left out
        for k in range(len(self.tag)):
            up = state[self.parent[k]]
            if k in chosen:
                state[k] = up or 1
            elif up == 1:
                frame = self.kind[k] in (SOFT, HARD) or (self.kind[k] == HEAD and not self.around[k] and self.tag[min(chosen)] in ("", "html", "body"))
                state[k] = 2 if frame else 1
            else:
                state[k] = up
        inside = [i for i, (k, _, _) in enumerate(self.blocks) if state[k] == 1]
        if not inside:
            return []
        if any(self.tag[self.blocks[i][0]] == "h1" for i in inside):
            heads = []
        else:
            heads = [i for i in range(inside[0]) if self._own_head(self.blocks[i][0])]
        return [self.blocks[i][1] for i in heads[-1:] + inside]

    def _own_head(self, k: int) -> bool:
        """An h1 outside the frame, or in a plain header of an element named as content."""
        if self.tag[k] != "h1":
            return False
        p = self.parent[k]
        header = self.tag[p] == "header" and self.good[self.parent[p]] > 1 and not self.out[self.parent[p]]
        return header or not self.out[k]


def main_text(source: str | None, paths: list[str] | None) -> str:
    """The text under the first of the winning paths that the page has, else under its best container."""
    page = Page(source or "")
    for path in paths or ():
        texts = page.text_in(page.on(path))
        if texts:
            return " ".join(texts)
    best = page.best()
    return " ".join(page.text_in({best or 0}))


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        votes: dict[tuple, int] = defaultdict(int)
        for host, source in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            page = Page(source or "")
            best = page.best()
            if best:
                votes[host, page.path_of(best)] += 1
        rows = list(votes.items())
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k, _ in rows], pa.string()), pa.array([k[1] for k, _ in rows], pa.string()), pa.array([v for _, v in rows], pa.int64())], names=["host", "path", "votes"]
        )


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        text = [main_text(page, paths) for page, paths in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def host_of(url):
    return F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)


def winning_paths(pages: DataFrame) -> DataFrame:
    """(host, paths): each host's container paths with at least SHARE of its votes, best first."""
    votes = pages.select(host_of(F.col("url")).alias("host"), "html").mapInArrow(_votes, "host string, path string, votes long")
    votes = kept(votes.groupBy("host", "path").agg(F.sum("votes").alias("votes")), "html-votes")
    most = votes.groupBy("host").agg(F.sum("votes").alias("_all"))
    won = votes.join(small_or_shuffled(most), "host").where(F.col("votes") >= F.col("_all") * SHARE)
    best_first = F.array_sort(F.collect_list(F.struct((-F.col("votes")).alias("votes"), "path")))
    return won.groupBy("host").agg(F.transform(best_first, lambda x: x["path"]).alias("paths"))


def op8_extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages."""
    winners = kept(winning_paths(pages), "html-paths").withColumnRenamed("host", "_host")
    rows = pages.select("page_id", "url", "html").withColumn("host", host_of(F.col("url")))
    rows = rows.join(small_or_shuffled(winners), F.col("host") == F.col("_host"), "left").select("page_id", "url", "html", "paths")
    kind = pages.schema["page_id"].dataType.simpleString()
    return rows.mapInArrow(_texts, f"page_id {kind}, url string, text string, n_chars long")
