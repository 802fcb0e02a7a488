"""Operators without SQL against plain versions of their whole results."""

import random
import zlib
from collections import Counter, defaultdict
from html.parser import HTMLParser

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import html, recurrent, sharding
from tessera.llm.common import whole_hash


@pytest.fixture(scope="module")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


# ── language model ─────────────────────────────────────────────────────────


def _log_softmax(x):
    return x - x.max() - np.log(np.exp(x - x.max()).sum())


def _walked(net, symbols):
    """ln P of one document, a word at a time in double precision."""
    embed, recur, classes, words = (p.astype(np.float64) for p in net.parts())
    h, before, total = np.zeros(recurrent.HIDDEN), recurrent.END, 0.0
    for s in symbols:
        xr, xz, xc = np.split(embed[before], 3)
        br, bz, bc = np.split(h @ recur, 3)
        r, z = 1 / (1 + np.exp(-(xr + br))), 1 / (1 + np.exp(-(xz + bz)))
        h = (1 - z) * h + z * np.tanh(xc + r * bc)
        c, w = divmod(s, recurrent.PER_CLASS)
        total += _log_softmax(h @ classes[:-1] + classes[-1])[c] + _log_softmax(h @ words[c, :-1] + words[c, -1])[w]
        before = s
    return total


def test_lm_scores_word_by_word(documents):
    texts = {r.doc_id: (r.text or "").encode().lower().split() for r in documents.collect()}
    learned = {i for i in texts if zlib.crc32(str(i).encode()) % 5 != 1}
    counts = Counter(w for i in learned for w in texts[i])
    common = sorted(counts, key=lambda w: (-counts[w], w))[: recurrent.N_CLASSES * recurrent.PER_CLASS - 2]
    symbol = {w: k for k, w in enumerate(common, 2)}
    far = [w for w in counts if w not in symbol]
    rest = sum(counts[w] + 0.5 for w in far) + 0.5  # unknown words share the last half
    train = documents.where(F.col("doc_id").isin(list(learned)))
    net = recurrent.trained(train, recurrent.vocabulary(recurrent.word_counts(train), len(learned)))
    got = {r.doc_id: r.score for r in recurrent.op6_recurrent(documents).collect()}
    assert got.keys() == texts.keys()
    for i in sorted(texts)[:60]:
        seq = [symbol.get(w, recurrent.OTHER) for w in texts[i]] + [recurrent.END]
        own = sum(np.log10((counts[w] + 0.5) / rest) for w in texts[i] if w not in symbol)
        assert got[i] == pytest.approx(_walked(net, seq) / np.log(10) + own, rel=1e-4)


# ── sharding ───────────────────────────────────────────────────────────────


def _dealt(rows, n_shards, bucket, many, seed):
    """row number -> (shard, slot) by lists; rows: (number, part, key of the first permutation, key of the second, doc_id)."""
    parts = defaultdict(list)
    for r in rows:
        parts[r[1]].append(r)
    n = len(rows)
    targets = np.array([n // n_shards + (k < n % n_shards) for k in range(n_shards)])
    supers = sorted({p // many for p in parts})
    sizes = np.array([sum(len(parts[p]) for p in parts if p // many == s) for s in supers])
    top = sharding.communication_matrix(sizes, targets, [seed + 1, 0])
    shards = defaultdict(list)
    for s, quota in zip(supers, top):
        own = sorted(p for p in parts if p // many == s)
        matrix = sharding.communication_matrix(np.array([len(parts[p]) for p in own]), quota, [seed + 2, s + 1])
        for p, counts in zip(own, matrix):
            ranked = iter(sorted(parts[p], key=lambda r: (r[2], r[4])))
            for k, c in enumerate(counts):
                shards[k] += [next(ranked) for _ in range(c)]
            assert next(ranked, None) is None
    return {r[0]: (k, slot) for k, got in shards.items() for slot, r in enumerate(sorted(got, key=lambda r: (r[3], r[4])))}


def test_shards_as_dealt_by_hand(documents, monkeypatch):
    bucket, many, seed = 16, 4, sharding.SEED
    monkeypatch.setattr(sharding, "BUCKET_ROWS", bucket)
    monkeypatch.setattr(sharding, "SUPER", many)
    docs = documents.unionByName(documents.limit(30)).withColumn("row", F.monotonically_increasing_id()).cache()
    n = docs.count()
    hashed = docs.select("row", "doc_id", "text", whole_hash(docs, "row").alias("h")).collect()
    seen, copies = Counter(), []
    for r in sorted(hashed, key=lambda r: r.row):
        copies.append((r.row, r.doc_id, r.h, seen[r.h]))
        seen[r.h] += 1
    keyed = docs.sparkSession.createDataFrame(copies, "row long, doc_id long, h long, copy long").select(
        "row", F.pmod(F.xxhash64("h", "copy", F.lit(seed)), F.lit(-(-n // bucket))), F.xxhash64("h", "copy", F.lit(seed + 3)), F.shiftrightunsigned(F.xxhash64("h", "copy", F.lit(seed + 4)), 1), "doc_id"
    )
    want = _dealt([tuple(r) for r in keyed.collect()], 7, bucket, many, seed)
    text = {r.row: (r.text or "").encode() for r in hashed}
    got = sharding.assign(docs, 7, row="row").collect()
    # equal rows may bear each other's numbers
    place = Counter((r.doc_id, r.shard, r.slot) for r in got)
    assert place == Counter((r.doc_id, *want[r.row]) for r in hashed)
    assert all((r["size"], r.text_crc32) == (len(text[r._row]) + 16, zlib.crc32(text[r._row])) for r in got)


# ── HTML ───────────────────────────────────────────────────────────────────


class _Tree(HTMLParser):
    """Well-formed pages as (label, path, children); a child is a string or an element."""

    def __init__(self, source):
        super().__init__()
        self.root = ("", (), [], {})
        self.stack = [self.root]
        self.feed(source)

    def handle_starttag(self, tag, attrs):
        names = sorted("." + "".join("N" if c.isdigit() else c for c in w) for w in dict(attrs).get("class", "").split())
        label = tag + "".join(names)
        node = (tag, (*self.stack[-1][1], label), [], dict(attrs))
        self.stack[-1][2].append(node)
        self.stack.append(node)

    def handle_endtag(self, tag):
        self.stack.pop()

    def handle_data(self, text):
        self.stack[-1][2].append(text)


def _nodes(node):
    yield node
    for c in node[2]:
        if not isinstance(c, str):
            yield from _nodes(c)


def _texts(node):
    for c in node[2]:
        if isinstance(c, str):
            yield c
        elif html.kind_of(c[0], c[3]) == html.PLAIN:
            yield from _texts(c)


def test_votes_and_choice_by_hand(spark):
    """Two templates a host and stray pages: the votes are counted and the texts taken from trees by hand."""
    rng = random.Random(12)
    words = lambda n: " ".join(rng.choice("alpha beta gamma delta omega sigma".split()) for _ in range(n))
    pages, votes, choice = [], defaultdict(Counter), {}
    for i in range(240):
        host = f"h{rng.randrange(3)}.example"
        first = rng.random() < 0.8
        # most pages hold more text in the article; every seventh more beside it, where only few votes fall
        long, short = words(rng.randrange(40, 80)), words(rng.randrange(3, 8))
        stray = i % 7 == 0
        cls = f"story s{rng.randrange(9)}" if first else "entry"
        inner = short if stray else long
        beside = f"<div class='zz{'q' * (i % 60)}'><p>{long}</p></div>" if stray else ""
        body = f"<div class='{cls}'><p>{inner}</p><div class='share-links'><p>{words(5)}</p></div></div>{beside}"
        pages.append((i, f"http://{host}/{i}", f"<html><body><div class='ad'><p>{words(30)}</p></div>{body}</body></html>"))
        path = "html/body/div.sN.story" if first else "html/body/div.entry"
        votes[host][f"html/body/div.zz{'q' * (i % 60)}" if stray else path] += 1
        choice[i] = host
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    want = {}
    for host, found in votes.items():
        won = [(-v, p) for p, v in found.items() if v >= html.SHARE * sum(found.values())]
        want[host] = [p for _, p in sorted(won)]
    assert all(len(w) == 2 for w in want.values())
    assert {r.host: r.paths for r in html.winning_paths(df).collect()} == want
    got = {r.page_id: r.text for r in html.op8_extract(df).collect()}
    for i, _, source in pages:
        tree = _Tree(source)
        for path in want[choice[i]]:
            held = [n for n in _nodes(tree.root) if "/".join(n[1]) == path]
            if held:
                assert got[i] == " ".join(" ".join(t for n in held for t in _texts(n)).split())
                break
