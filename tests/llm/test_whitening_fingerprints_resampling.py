"""Whitening, fingerprints and importance resampling against plain versions, and on odd rows."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from tessera.llm import fingerprints, importance, whitening
from tessera.llm.common import plain_words, shingle_strings

ODD = "doc_id long, text string, lang string, source string, n_chars int, _row int, row string, guard int, bucket int, weight double, _at int, hash int"


def _odd(i, text):
    return (i, text, "en", "s", 1, 2, "r", 3, 4, 5.0, 6, 7)


# ── whitening ──────────────────────────────────────────────────────────────


def _plain_whitening(vectors, k=8):
    x = np.array([[math.floor(1024 * c) + 100_000 for c in v] for v in vectors], dtype=object)
    n, s = len(x), x.sum(0)
    y = ((n * x - s) / n).astype(float)
    v = y.T @ y / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    return n, [int(d) for d in ((n * x - s) ** 2).sum(1)], y @ u / np.sqrt(e), e / np.trace(v)


def _compare(got, ids, vectors):
    n, deviation, w, explained = _plain_whitening(vectors)
    at = {i: k for k, i in enumerate(ids)}
    assert len(got) == len(ids) * w.shape[1]
    mine = np.zeros_like(w)
    for r in got:
        mine[at[r.vec_id], r.component - 1] = r.whitened
        assert r.n == n and r.deviation == deviation[at[r.vec_id]]
        assert abs(r.explained / explained[r.component - 1] - 1) < 1e-9 and r.identity_error < 1e-9
    assert np.abs(np.abs(mine) - np.abs(w)).max() < 1e-8
    signs = np.sign((mine * w).sum(0))
    assert np.abs(mine - w * signs).max() < 1e-8


def test_whitening_against_a_dense_solver(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = [r for r in table.collect() if r.embedding is not None and all(c is not None and math.isfinite(c) for c in r.embedding)]
    _compare(whitening.op11_whitening(table).collect(), [r.vec_id for r in rows], [r.embedding for r in rows])


def test_inertia_counts():
    rng = np.random.default_rng(3)
    for n in (1, 2, 7, 30):
        a = rng.normal(size=(n, n))
        a = a + a.T
        e = np.linalg.eigvalsh(a)
        for shift in (-2.0, 0.0, 0.7, float((e[0] + e[-1]) / 2)):
            assert whitening.above(a, shift) == (e > shift).sum()
    assert whitening.above(np.array([[0.0, 1.0], [1.0, 0.0]]), 0.0) == 1


@pytest.mark.parametrize("spectrum", [[9, 9, 9, 9, 9, 9, 1, 1, 1, 1, 1, 1], [1000, 1, 0.999999, 0.5, 0.25, 0.1, 0.01, 1e-3, 1e-4, 0, 0, 0], [5, 4.0000001, 4, 3, 2, 1.5, 1.2, 1.1, 1.0999, 1.0998, 0.1, 0], [3, 2]])
def test_feast_on_ties_and_gaps(spark, spectrum):
    n = len(spectrum)
    u, _ = np.linalg.qr(np.random.default_rng(8).normal(size=(n, n)))
    v = (u * np.array(spectrum, float)) @ u.T
    values, vectors = whitening.feast(spark, (v + v.T) / 2, 8)
    want = [e for e in sorted(spectrum, reverse=True)[:8] if e > whitening.TINY * sum(spectrum)]
    assert np.allclose(values, want, rtol=1e-9, atol=1e-12)
    assert np.abs(v @ vectors - vectors * values).max() < 1e-12 * max(spectrum)
    assert np.abs(vectors.T @ vectors - np.eye(len(want))).max() < 1e-12


def test_whitening_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    good = [(1, [1.0, 2.0, 0.5]), (2, [0.5, -1.0, 0.25]), (3, [0.25, 0.0, 0.0]), (3, [0.25, 0.0, 0.0]), (None, [1.0, 1.0, 1.0]), (7, [0.75, 0.5])]
    bad = [(4, None), (5, [nan, 1.0, 1.0]), (6, [inf, 0.0, 0.0]), (8, [None, 0.0, 0.0])]
    schema = "vec_id long, embedding array<double>, x int, w string, n int"
    got = whitening.op11_whitening(spark.createDataFrame([(*r, 1, "w", 2) for r in good + bad], schema)).collect()
    n, deviation, w, _ = _plain_whitening([[*v, 0.0][:3] for _, v in good])
    assert len(got) == 18 and {r.vec_id for r in got} == {1, 2, 3, 7, None} and {r.component for r in got} == {1, 2, 3}
    assert sorted(r.deviation for r in got if r.component == 1) == sorted(deviation)
    assert np.allclose(sorted(abs(r.whitened) for r in got), sorted(np.abs(w).ravel()))
    for rows in ([], bad, [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, []), (2, [])]):
        assert whitening.op11_whitening(spark.createDataFrame([(*r, 1, "w", 2) for r in rows], schema)).count() == 0
    huge = whitening.op11_whitening(spark.createDataFrame([(1, [1e300, 1.0]), (2, [-1e300, 2.0]), (3, [0.0, 3.0])], "vec_id long, embedding array<double>")).collect()
    assert {r.deviation for r in huge if r.vec_id in (1, 2)} == {whitening.LONG}


# ── fingerprints ───────────────────────────────────────────────────────────


def _plain_likeness(a, b):
    a, b = (set(shingle_strings(plain_words(t.encode()), 5)) for t in (a, b))
    return len(a & b) / len(a | b) if a | b else 1.0


def _edited(text, following):
    m = len(text) // 3
    return text[: len(text) - m] + following[:m]


def test_fingerprints_against_the_texts(spark, sf):
    table = spark.read.parquet(f"{sf}/documents.parquet")
    rows = sorted(((r.doc_id, r.text or "") for r in table.collect()), reverse=True)
    following = dict(zip([i for i, _ in rows], [t for _, t in rows[1:] + rows[:1]]))
    text, got = dict(rows), {r.doc_id: r for r in fingerprints.op12_fingerprints(table).collect()}
    assert len(got) == len(rows) == table.count()
    errors = []
    for i, r in got.items():
        edited = _edited(text[i], following[i])
        assert r.n_chars == len(text[i]) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        errors += [r.near_edited - _plain_likeness(text[i], edited), r.near_next - _plain_likeness(text[i], following[i])]
        assert 0 <= r.near_edited <= 1 and len(r.fingerprint) == len(r.edited_fingerprint) == fingerprints.BINS * fingerprints.BITS // 4
    assert np.sqrt(np.mean(np.square(errors))) < 0.03 and np.abs(np.mean(errors)) < 0.01
    by_text = {}
    for i, r in got.items():
        by_text.setdefault(text[i], set()).add(r.fingerprint)
    assert all(len(f) == 1 for f in by_text.values())
    alone = fingerprints.fingerprints(table).collect()
    assert all(got[r.doc_id].fingerprint == r.fingerprint for r in alone)
    pairs = spark.createDataFrame([(r.fingerprint, r.edited_fingerprint, r.near_edited) for r in got.values()] + [(None, "00", None)], "a string, b string, near double")
    assert pairs.where(~F_equal(fingerprints.likeness()("a", "b"))).count() == 0


def F_equal(col):
    from pyspark.sql import functions as F

    return col.eqNullSafe(F.col("near"))


def _plain_minima(scheme, text):
    from tessera.llm.common import shingle_hashes, word_hashes

    words, _ = word_hashes([text])
    least = {}
    for h in shingle_hashes(words, 5).tolist():
        b = h >> int(scheme.shift)
        least[b] = min(h, least.get(b, h))
    return least


def test_bins_and_densification_one_by_one(monkeypatch):
    scheme, rng = fingerprints.Scheme(64, 4), random.Random(4)
    texts = [b"", b"!?", b"one", b"one two three four"] + [" ".join(f"w{rng.randrange(400)}" for _ in range(n)).encode() for n in (5, 6, 9, 40, 200, 3000)]
    least = scheme.minima(texts)
    full = scheme.densified(least)
    for row, done, text in zip(least, full, texts):
        want = _plain_minima(scheme, text)
        assert {b: h for b, h in enumerate(row.tolist()) if h != 2**64 - 1} == want
        for b in range(64) if want else ():
            source = next(x for x in ([b] if b in want else []) + scheme.order[b].tolist() if x in want)
            assert done[b] == want[source]
    monkeypatch.setattr(fingerprints, "PIECE", 100)  # long texts in pieces give the same bins
    assert (scheme.minima(texts) == least).all()


def test_likeness_is_unbiased():
    rng = random.Random(6)
    for bits in (1, 2, 4, 8):
        scheme, errors = fingerprints.Scheme(256, bits), []
        for _ in range(40):
            base = [f"w{rng.randrange(10**6)}" for _ in range(600)]
            other = base[:300] + [f"x{rng.randrange(10**6)}" for _ in range(300)]
            a, b = " ".join(base), " ".join(other)
            found = scheme.likeness(scheme.digits([a.encode()]), scheme.digits([b.encode()]))[0]
            errors.append(found - _plain_likeness(a, b))
        assert abs(np.mean(errors)) < 0.03
    packed = scheme.packed(scheme.digits([b"a b c d e f g"])[0])
    assert (scheme.unpacked(packed)[0] == scheme.digits([b"a b c d e f g"])[0]).all()
    with pytest.raises(ValueError):
        fingerprints.Scheme(100, 4)


def test_fingerprints_of_odd_rows(spark, monkeypatch):
    long = " ".join(f"w{i % 977}x{i % 31}" for i in range(300_000))
    rows = [_odd(1, None), _odd(2, ""), _odd(3, "ünï \x85 ab"), _odd(5, "five of us here now"), _odd(5, "five of us here now"), _odd(5, "another five"), _odd(9, long), _odd(None, "nameless"), _odd(None, "nameless")]
    got = fingerprints.op12_fingerprints(spark.createDataFrame(rows, ODD)).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    zero = "0" * (fingerprints.BINS * fingerprints.BITS // 4)
    assert by[1][0].fingerprint == by[2][0].fingerprint == zero and by[2][0].near_next == 1.0 and by[1][0].near_next == 0.0
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert by[3][0].edited_sha256 == sha("ünï \x85 ab"[:6]) and by[3][0].n_chars == 8
    assert by[1][0].edited_sha256 == sha("") == by[2][0].edited_sha256
    assert sorted(r.near_next for r in by[None])[1] == 1.0  # its copy comes next
    last = {r.edited_sha256 for r in by[None]}
    assert sha("nameless"[:6] + long[:2]) in last and sha("nameless"[:6] + "na") in last
    assert fingerprints.op12_fingerprints(spark.createDataFrame([], ODD)).count() == 0
    one = fingerprints.op12_fingerprints(spark.createDataFrame([_odd(4, "abc def")], ODD)).first()
    assert one.edited_sha256 == sha("abc dab") and one.near_next == 1.0


def test_ranges_of_a_hot_key_are_many(spark):
    docs = spark.range(4000).selectExpr("cast(null as long) as doc_id", "'same text' as text")
    placed = fingerprints.neighboured(docs)
    sizes = [r["count"] for r in placed.groupBy("range").count().collect()]
    assert len(sizes) >= 3 and max(sizes) < 2500
    assert fingerprints.op12_fingerprints(docs).where("near_next = 1").count() == 4000


# ── importance resampling ──────────────────────────────────────────────────


def _plain_resampling(docs, target, grams, buckets, percent, least):
    def features(text):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, grams + 1) for i in range(len(w) - k + 1)]

    own, theirs = [features(t) for _, t in docs], [features(t) for t in target]
    s, t = np.zeros(buckets), np.zeros(buckets)
    for _, f in own:
        np.add.at(s, f, 1)
    for _, f in theirs:
        np.add.at(t, f, 1)
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.sum() + buckets) / ((s[b] + 1) * (t.sum() + buckets)))) for b in range(buckets)]
    out = []
    for (i, _), (n, f) in zip(docs, own):
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        out.append([i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    enough = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2]))
    drawn = {id(r): k + 1 for k, r in enumerate(enough[: len(enough) * percent // 100])}
    return sorted(str((r[0], r[2], r[3], r[4], drawn.get(id(r)))) for r in out)


@pytest.mark.parametrize("grams", [1, 2, 3])
def test_resampling_against_a_plain_version(spark, grams):
    rng = random.Random(grams)
    words = ["Red", "green", "BLUE", "añil", "x9", "naïve", "İstanbul", "日本"]
    text = lambda n: "".join(rng.choice(words) + rng.choice([" ", ", ", "\n\n", "-", "\x7f", "_"]) for _ in range(n))
    docs = [(i, text(rng.randrange(60))) for i in range(120)] + [(7, text(25)), (7, text(25)), (None, text(30)), (None, None), (500, ""), (501, " .. ")]
    docs += [(900, "alpha beta gamma"), (900, "alpha beta gamma")] * 3
    target = [text(40), None, "", "Alpha, beta?"]
    a, b = spark.createDataFrame([_odd(*d) for d in docs], ODD), spark.createDataFrame([(k, t, 1) for k, t in enumerate(target)], "item_id long, text string, bucket int")
    got = importance.resampled(a, b, percent=30, grams=grams, buckets=50, least=10).collect()
    assert sorted(str((r.doc_id, r.n_features, r.weight, r.score, r.rank)) for r in got) == _plain_resampling(docs, target, grams, 50, 30, 10)


def test_overlapped_spans_are_whole_runs():
    plain = importance.collapsed(b"  The cat--sat\ton THE mat9 ")
    assert plain == b"the cat sat on the mat9"
    two = [m[0] for m in importance.patterns(2)[1].finditer(plain, overlapped=True)]
    assert two == [b"the cat", b"cat sat", b"sat on", b"on the", b"the mat9"]


def test_resampling_of_empty_tables(spark):
    docs, items = spark.createDataFrame([_odd(1, "a b c " * 10), _odd(2, None)], ODD), spark.createDataFrame([], "item_id long, text string")
    assert importance.op13_importance(docs.limit(0), items).count() == 0
    got = {r.doc_id: r for r in importance.op13_importance(docs, items).collect()}
    assert got[1].n_features == 30 and got[2].weight == 0 and got[1].rank is None


def test_numbering_by_ranges(spark):
    from pyspark.sql import functions as F

    from tessera.llm.common import in_order

    rows = spark.range(5000).select(F.pmod(F.xxhash64("id"), F.lit(50)).alias("k"), "id")
    got = sorted((r.at, r.k, r.id) for r in in_order(rows, [F.desc("k"), F.asc("id")], "at").collect())
    assert [g[0] for g in got] == list(range(5000)) and [g[1:] for g in got] == sorted([g[1:] for g in got], key=lambda g: (-g[0], g[1]))
