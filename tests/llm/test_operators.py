"""Each operator against a brute-force version, an exact round trip or held-out accuracy."""

import random
from itertools import combinations

import duckdb
import numpy as np
import pytest
import xxhash

from tessera.llm import decontaminate, html, knn, licenses, mixing, queries, quality, recurrent, sharding, simhash, substrings, windows
from tessera.llm.common import plain_words, shingle_strings, word_hashes


@pytest.fixture(scope="module")
def tables(spark, sf):
    return {t: spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels", "benchmark", "embeddings", "pages")}


def _duck(sf, sql):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    return con.execute(sql).fetchall(), [d[0] for d in con.description]


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, sf, name):
    rows, names = _duck(sf, queries.ORACLES[name])
    got = queries.QUERIES[name](spark, sf)
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(str, map(tuple, got.select(*names).collect()))) == sorted(map(str, rows))


# ── mixing ─────────────────────────────────────────────────────────────────


def test_schedule_spreads_every_source(spark):
    rows = spark.createDataFrame([(i, i, s, n, f"{i:08x}") for i, (s, n) in enumerate([("a", 900_000), ("b", 500_000), ("c", 400_000)])], "doc_id long, _hash long, source string, size long, _key string")
    sources = mixing.targets(rows).cache()
    slots = sorted((r.slot, r.sid) for r in mixing.schedule(sources).collect())
    quota = {r.sid: r.quota for r in sources.collect()}
    total = sum(quota.values())
    seen = dict.fromkeys(quota, 0)
    for m, (_, sid) in enumerate(slots, 1):
        seen[sid] += 1
        for s, q in quota.items():
            assert abs(seen[s] - m * q / total) < 6
    assert {s: -(-q // mixing.BLOCK_WORDS) for s, q in quota.items()} == seen


def test_mix_takes_whole_blocks_once(tables):
    slices, _ = mixing.mix(mixing.sized(tables["documents"]), 64)
    rows = slices.groupBy("sid", "block").agg({"slot": "count", "n_words": "sum"}).collect()
    assert all(r["sum(n_words)"] <= 64 for r in rows)


def test_mixed_documents_hold_the_words_taken(spark, tables):
    out = {}
    for r in mixing.mixed_documents(tables["documents"]).select("doc_id", "text").collect():
        out[r.doc_id] = out.get(r.doc_id, 0) + len(r.text.encode().split())
    assert out == {r.doc_id: r.taken for r in mixing.op1_mixing(tables["documents"]).collect() if r.taken}


def test_mixed_documents_come_in_the_order_of_their_slots(spark):
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(300)), "ab"[i % 2]) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    slot = {r.doc_id: r.first_slot for r in mixing.op1_mixing(docs).collect() if r.taken}
    order = list(dict.fromkeys(r.doc_id for r in mixing.mixed_documents(docs).collect()))
    assert [slot[i] for i in order] == sorted(slot[i] for i in order)
    first = [r % 2 for r in order[:40]]
    assert 5 < sum(first) < 35  # the sources take turns


def test_rows_of_one_id_are_many_buckets(spark, monkeypatch):
    """A third of all rows without an id: the stream still has each word once, and no bucket holds them all."""
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 64)
    rows = [(None if i % 3 == 0 else i, "w " * (i % 7), "a") for i in range(1500)]
    sized = mixing.kept(mixing.sized(spark.createDataFrame(rows, "doc_id long, text string, source string")), "t")
    seen = []
    real = mixing.running_start
    monkeypatch.setattr(mixing, "running_start", lambda df, *a: seen.append(df) or real(df, *a))
    got = sorted((r.start, r.size) for r in mixing.placed(sized, mixing.targets(sized)).collect())
    assert len(got) == 1500 and got[0][0] == 0 and sum(n for _, n in got) == sum(i % 7 for i in range(1500))
    filled = [g for g in got if g[1]]
    assert all(a + n == b for (a, n), (b, _) in zip(filled, filled[1:]))
    assert seen[0].groupBy("_bucket").count().agg({"count": "max"}).first()[0] < 150


def test_golden_points_do_not_overflow(spark):
    ids = [0, 1, 2, 2**32 - 1, 2**32, 5 * 10**10 + 7]
    got = [r[0] for r in spark.createDataFrame([(i,) for i in ids], "i long").select(mixing.golden_point(mixing.F.col("i"))).collect()]
    assert got == [i * mixing.GOLDEN % 2**32 for i in ids]


# ── near-dedup ─────────────────────────────────────────────────────────────


def _slow_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    runs = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64(r, seed=42).intdigest() for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _slow_components(ids, links):
    root = {i: i for i in ids}

    def up(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = up(a), up(b)
        root[max(a, b)] = min(a, b)
    return {i: up(i) for i in ids}


def test_simhash_against_all_pairs(tables):
    texts = {r.doc_id: r.text for r in tables["documents"].collect()}
    fps = {i: _slow_fingerprint(t) for i, t in texts.items()}
    want = _slow_components(fps, [(a, b) for a, b in combinations(fps, 2) if (fps[a] ^ fps[b]).bit_count() <= 3])
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op3_simhash(tables["documents"]).collect()}
    assert got == {i: (f"{fps[i]:016x}", want[i]) for i in fps}


def test_near_links_in_a_hot_group(spark, monkeypatch):
    monkeypatch.setattr(simhash, "GROUP", 16)
    rng = random.Random(1)
    base = rng.getrandbits(64)
    fps = list({base ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(7))) for _ in range(150)} | {rng.getrandbits(64) for _ in range(50)})
    signed = [f - 2**64 if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    roots = {r.node: r.root for r in simhash.components(simhash.near_links(df)).collect()}
    want = _slow_components(signed, [(a, b) for a, b in combinations(signed, 2) if ((a ^ b) & (2**64 - 1)).bit_count() <= 3])
    assert {f: roots.get(f, f) for f in signed} == want


@pytest.mark.parametrize("n", [1, 2, 31, 200, 1500])
@pytest.mark.parametrize("groups", [1, 4, 400])
def test_gray_index_against_all_pairs(n, groups):
    rng = np.random.default_rng(n)
    centre = rng.integers(0, 2**63, 5, dtype=np.uint64)
    flips = np.bitwise_xor.reduce(np.uint64(1) << rng.integers(0, 64, (n, 4), dtype=np.uint64), axis=1)
    fps = np.unique(centre[rng.integers(0, 5, n)] ^ flips)
    group = rng.integers(0, groups, len(fps))
    root = np.arange(len(fps))
    i, j = np.nonzero(np.triu((np.bitwise_count(fps[:, None] ^ fps) <= 3) & (group[:, None] == group), 1))
    simhash.unite(root, i, j)
    got = simhash.near_roots(group, fps)
    assert len(set(zip(root, got))) == len(set(root)) == len(set(got))


def test_hierarchy_carries_what_its_entries_share():
    rng = np.random.default_rng(6)
    fps, group = rng.integers(0, 2**63, 300, dtype=np.uint64), np.sort(rng.integers(0, 9, 300))
    levels = simhash.hierarchy(group, fps)
    assert len(levels[-1].group) == len(set(group))
    for above, below in zip(levels[1:], levels):
        ends = np.r_[above.starts[1:], len(below.group)]
        for k, (s, e) in enumerate(zip(above.starts, ends)):
            assert e - s <= simhash.FAN and set(below.group[s:e]) == {above.group[k]}
            assert above.both[k] == np.bitwise_and.reduce(below.both[s:e]) and above.any_[k] == np.bitwise_or.reduce(below.any_[s:e])


@pytest.mark.parametrize("n", [10, 1 << 23, 1 << 32])
def test_block_masks_lose_no_pair(n):
    masks = [m & (2**64 - 1) for m in simhash.block_masks(n)]
    rng = random.Random(n)
    for _ in range(500):
        flip = sum(1 << b for b in rng.sample(range(64), 3))
        assert any(flip & m == 0 for m in masks)


# ── kNN ────────────────────────────────────────────────────────────────────


def test_top_k_against_all_pairs(spark):
    rng = np.random.default_rng(3)
    x = np.vstack([rng.normal(c, 0.3, (150, 8)) for c in (-1, 0, 2)]).round(2)
    x[:140] = x[0]
    df = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "vec_id long, embedding array<double>")
    q = np.floor(1024 * x)
    got = knn.top_k(df, 5, 10).collect()
    for query in range(0, len(x), 10):
        score = q @ q[query]
        order = [i for i in sorted(range(len(x)), key=lambda i: (-score[i], i)) if i != query][:5]
        assert [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r.rank) if r.query_id == query] == [(i, score[i]) for i in order]


def test_top_k_takes_rows_as_candidates(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [0.0, 1.0]), (100, [0.0, 1.0]), (100, [0.0, 2.0])]
    got = knn.op4_topk(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    one = 1024**2
    assert [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r.rank) if r.query_id == 0] == [(1, one), (1, 0), (100, 0), (100, 0)]
    hundred = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == 100)
    assert hundred == sorted([(1, 100, 2 * one), (2, 1, one), (3, 0, 0), (4, 1, 0), (1, 1, 2 * one), (2, 100, 2 * one), (3, 0, 0), (4, 1, 0)])


def test_top_k_over_many_chunks_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(knn, "CHUNK", 16)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 6)).round(1)
    x[:130] = x[0]
    df = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "vec_id long, embedding array<double>")
    q = np.floor(1024 * x)
    got = knn.top_k(df, 7, 4).collect()
    for query in range(0, 400, 4):
        score = q @ q[query]
        order = [i for i in sorted(range(400), key=lambda i: (-score[i], i)) if i != query][:7]
        assert [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r.rank) if r.query_id == query] == [(i, score[i]) for i in order]


# ── quality and language model ─────────────────────────────────────────────


def test_quality_on_held_out_labels(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = quality.op5_quality(docs, labels).where("held_out").join(labels, "doc_id").select("predicted", "quality", "score").collect()
    assert len(got) > 40 and sum(r.predicted == r.quality for r in got) / len(got) > 0.95


def test_quality_against_a_plain_fit(tables):
    """The distributed sums give the ridge and isotonic fit of all rows at once."""
    docs, labels = tables["documents"], tables["labels"]
    rows = quality._training(docs, labels, "quality").collect()
    x, y, fold = np.array([r.x for r in rows]), np.array([r.y for r in rows]), np.array([r.fold for r in rows])
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    z = quality.fourier((x[fold != 1] - mean) / scale)
    w = np.linalg.solve(z.T @ z + quality.RIDGE * len(z) * np.eye(z.shape[1]), z.T @ y[fold != 1])
    model = quality.fit(docs, labels)
    assert model.fourier(x) @ model.weights == pytest.approx(quality.fourier((x - mean) / scale) @ w, abs=1e-5)
    raw = np.round(quality.fourier((x[fold == 1] - mean) / scale) @ w * quality.BINS / 2) * 2 / quality.BINS
    order = np.argsort(raw, kind="stable")
    at, value = quality.isotonic(raw[order], y[fold == 1][order], np.ones(len(order)))
    want = np.interp(model.raw(x), at, value)
    assert np.mean(np.abs(model.score(x) - want)) < 0.02


def test_isotonic_pools_violators():
    at, value = quality.isotonic(np.array([0.0, 1.0, 2.0, 3.0]), np.array([0.0, 1.0, 0.0, 1.0]), np.ones(4))
    assert value.tolist() == [0.0, 0.5, 1.0] and at.tolist() == [0.0, 1.5, 3.0]


def test_accepted_follows_the_scores(tables):
    docs, labels = tables["documents"], tables["labels"]
    want = {r.doc_id for r in quality.op5_quality(docs, labels).collect() if r.predicted}
    assert {r.doc_id for r in quality.accepted(docs, labels).collect()} == want


def test_lm_counts_and_base_score(tables):
    import zlib
    from collections import Counter

    texts = {r.doc_id: (r.text or "").encode().lower().split() for r in tables["documents"].collect()}
    out = {i for i in texts if zlib.crc32(str(i).encode()) % 5 == 1}
    seen = Counter(w for i, t in texts.items() if i not in out for w in t)
    end, total = len(texts) - len(out), sum(seen.values()) + len(texts) - len(out)
    norm = total + 0.5 * (len(seen) + 2)
    got = {r.doc_id: r for r in recurrent.op6_recurrent(tables["documents"]).collect()}
    assert got.keys() == texts.keys()
    for i, t in texts.items():
        want = sum(np.log10((seen[w] + 0.5) / norm) for w in t) + np.log10((end + 0.5) / norm)
        assert got[i].base_score == pytest.approx(want)
        assert (got[i].held_out, got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (i in out, len(t) + 1, sum(w in seen for w in t) + 1, total)


def test_lm_beats_counts_on_held_out_text(spark):
    got = recurrent.op6_recurrent(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out").collect()
    assert sum(r.score for r in got) > sum(r.base_score for r in got)


def test_lm_tail_words_by_shuffle(tables, monkeypatch):
    """A small head sends most words through the join: the base score must not change."""
    want = {r.doc_id: r.base_score for r in recurrent.op6_recurrent(tables["documents"]).collect()}
    monkeypatch.setattr(recurrent, "HEAD", 50)
    got = {r.doc_id: r.base_score for r in recurrent.op6_recurrent(tables["documents"]).collect()}
    assert got == pytest.approx(want)


def test_lm_is_a_distribution_and_learns():
    rng = np.random.default_rng(0)
    net = recurrent.new_net(np.ones(300))
    seqs = [np.tile([5, 9, 17, 40], 20 + i % 7)[: 60 + i] for i in range(200)]
    h = rng.normal(size=(3, recurrent.HIDDEN)).astype(np.float32)
    every = np.arange(recurrent.N_CLASSES * recurrent.PER_CLASS)
    for row in h:
        assert np.exp(recurrent.log_probs(net, np.tile(row, (len(every), 1)), every)).sum() == pytest.approx(1, abs=1e-3)
    before = recurrent.score_sequences(net, [s.astype(np.int16) for s in seqs]).sum()
    recurrent.train_lanes(net, iter([np.asarray(s, np.int64) for s in seqs]))
    assert recurrent.score_sequences(net, [s.astype(np.int16) for s in seqs]).sum() > before / 2


def test_lm_lanes_score_as_one_by_one():
    net = recurrent.new_net(np.ones(300))
    rng = np.random.default_rng(1)
    seqs = [rng.integers(0, 300, n).astype(np.int16) for n in (1, 5, 80, 3, 200, 64, 65)]
    alone = [recurrent.score_sequences(net, [s])[0] for s in seqs]
    assert recurrent.score_sequences(net, seqs) == pytest.approx(alone, rel=1e-4)


def test_lm_gradient():
    rng = np.random.default_rng(2)
    net = recurrent.new_net(np.ones(200))
    for p in net.parts():
        p += rng.normal(0, 0.05, p.shape).astype(np.float32)
    seq = rng.integers(0, 200, (6, 4))
    live, h = np.ones((5, 4), bool), np.zeros((4, recurrent.HIDDEN), np.float32)
    fresh = np.zeros((5, 4), bool)
    fresh[0], fresh[2, 1], live[4, 2] = True, True, False
    window = lambda: recurrent.train_window(net, seq[:-1], seq[1:], live, fresh, h)
    grads, _, loss = window()
    for p, g in zip(net.parts(), grads):
        at = np.unravel_index(np.argmax(np.abs(g)), g.shape)
        old = p[at]
        p[at] = old + 1e-2
        up = window()[2]
        p[at] = old - 1e-2
        down = window()[2]
        p[at] = old
        assert (up - down) / 2e-2 == pytest.approx(float(g[at]), rel=0.05)
    assert loss > 0


# ── passages, containment ──────────────────────────────────────────────────


def _words(rng, n):
    return [f"{rng.choice('bcdfg')}{rng.randrange(3000)}" for _ in range(n)]


def test_planted_passages_are_found_and_no_others(spark):
    rng = random.Random(5)
    passages = [_words(rng, n) for n in (51, 60, 90, 300)]
    short = _words(rng, 35)
    rows, planted = [], {}
    for i in range(120):
        body = _words(rng, rng.randrange(30, 400))
        at = rng.randrange(len(body))
        if i % 3 == 0:
            p = i // 3 % len(passages)
            body[at:at] = passages[p]
            planted.setdefault(p, set()).add(i)
        elif i % 3 == 1:
            body[at:at] = short
        rows.append((i, " ".join(body)))
    rows += [(500, rows[7][1].upper()), (501, rows[8][1])]
    got = substrings.op7_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    links = [(r.doc_id, r.keep_id) for r in got]
    long_enough = {i for i, t in rows if len(t.split()) >= 50}
    whole = {(500, 7), (501, 8)} if {7, 8} <= long_enough else set()
    root = _slow_components([i for i, _ in rows], links)
    for p, ids in planted.items():
        assert len({root[i] for i in ids}) == 1
    clean = {i for i, _ in rows} - set().union(*planted.values()) - {x for pair in whole for x in pair}
    assert not clean & {x for pair in links for x in pair}
    assert {tuple(sorted(x)) for x in whole} <= {tuple(sorted(x)) for x in links}


def test_edited_passage_is_found(spark):
    rng = random.Random(9)
    p = _words(rng, 120)
    q = list(p)
    q[60] = "edited"
    rows = [(1, " ".join(_words(rng, 80) + p)), (2, " ".join(q + _words(rng, 90))), (3, " ".join(_words(rng, 200)))]
    got = substrings.op7_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {frozenset((r.doc_id, r.keep_id)) for r in got} == {frozenset((1, 2))}


def _slow_tree(g, first, length):
    """Places of the nodes of a Cartesian tree that span length or more."""
    if len(g) < length:
        return set()
    c = int(g.argmin())
    return {first + c} | _slow_tree(g[:c], first, length) | _slow_tree(g[c + 1 :], first + c + 1, length)


def test_compact_windows_are_the_nodes_of_the_trees():
    rng = np.random.default_rng(4)
    sizes = [200, 9, 10, 1, 47, 500, 3]
    g = rng.permutation(sum(sizes)).astype(np.uint64) + np.uint64(1)
    last = np.cumsum(sizes)
    want = set()
    for size, end in zip(sizes, last):
        want |= _slow_tree(g[end - size : end], end - size, 10)
    assert set(substrings.compact_windows(g, np.repeat(last, sizes), 10)) == want


def test_containment_against_brute_force(spark):
    rng = random.Random(2)
    items = [(k, " ".join(_words(rng, n))) for k, n in enumerate((1, 3, 5, 6, 9, 17, 40, 64, 200))]
    rows = []
    for i in range(150):
        body = _words(rng, rng.randrange(3, 900))
        if i % 2:
            t = items[rng.randrange(len(items))][1].split()
            if len(t) > 20 and i % 4 == 1:
                t[rng.randrange(2)] = "edit"
            at = rng.randrange(len(body))
            body[at:at] = t
        rows.append((i, " ".join(body)))
    rows += [(200, items[0][1]), (201, items[1][1].title() + "!")]
    # an item of fewer words than five is one shingle of its own width, and looked up among the runs of that width
    sets = lambda t, n: set(shingle_strings(plain_words(t.encode()), n)) if len(t.split()) >= n else set()
    width = lambda s: min(5, len(s.split()))
    want = {(i, k) for i, t in rows for k, s in items if len(sets(s, width(s)) & sets(t, width(s))) >= 0.8 * len(sets(s, width(s)))}
    assert {k for _, k in want} >= {0, 1} and len({i for i, k in want if k == 1}) > 2
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.op10_decontaminate(docs, bench).collect()}
    assert got == want
    assert {r.doc_id for r in decontaminate.decontaminated(docs, bench).collect()} == {i for i, _ in rows} - {i for i, _ in want}


def test_short_items_are_found_in_long_documents(spark):
    docs = spark.createDataFrame([(1, "it has Two words, in it"), (2, "two or words"), (3, "WORDS"), (4, "alpha beta gamma delta")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "two words"), (2, "words"), (3, "beta gamma delta"), (4, "delta alpha")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.op10_decontaminate(docs, items).collect()}
    assert got == {(1, 1), (1, 2), (2, 2), (3, 2), (4, 3)}


def test_scattered_items_are_mostly_found(spark):
    """Five-word runs of an item spread over a document lie outside the guarantee of the bands; the README has the share found."""
    rng = random.Random(12)
    items, rows = [], []
    for k in range(60):
        t = _words(rng, 24)
        items.append((k, " ".join(t)))
        body = []
        for at in range(20):
            body += t[at : at + 5] + _words(rng, 20)
        rows.append((k, " ".join(body)))
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = sum(r.doc_id == r.item_id for r in decontaminate.op10_decontaminate(docs, bench).collect())
    print("scattered items found:", found, "of 60")
    assert found >= 30


def test_notices_are_a_table(spark):
    docs = spark.createDataFrame([(1, "x " * 9 + "this little text may be used by all")], "doc_id long, text string")
    own = spark.createDataFrame([(7, "Own-1.0", "This little text may be used by all.")], "notice_id int, license string, text string")
    assert [(r.doc_id, r.license, r.containment) for r in licenses.op2_licenses(docs, own).collect()] == [(1, "Own-1.0", 1.0)]
    full = spark.createDataFrame([(i, "intro words here " + t) for i, (_, t) in enumerate(licenses.NOTICES)], "doc_id long, text string")
    assert {i for i, _ in enumerate(licenses.NOTICES)} <= {r.doc_id for r in licenses.op2_licenses(full).collect() if r.notice_id == r.doc_id}


def test_bands_reach_the_promised_probability():
    for unit in (1, 2, 4, 64, 1024):
        q = unit // 2 + 1 if unit > 1 else 1
        shared = windows.SIMILARITY * q
        j = shared / (2 * unit + q - shared)
        assert (1 - j) ** windows.bands_for(unit) <= windows.MISS


def test_items_beyond_a_block_are_searched_too(spark, monkeypatch):
    monkeypatch.setattr(windows, "BLOCK_ITEMS", 2)
    rng = random.Random(8)
    items = [(k, " ".join(_words(rng, 12))) for k in range(7)]
    docs = spark.createDataFrame([(k, "x y " + t) for k, t in items], "doc_id long, text string")
    got = decontaminate.op10_decontaminate(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(k, k) for k, _ in items}


# ── HTML ───────────────────────────────────────────────────────────────────


def test_host_consensus_picks_the_article(spark):
    page = (
        "<html><head><title>T</title><style>p{}</style></head><body><nav><a href=x>Home</a></nav><div class='ad-slot'>Buy</div>"
        "<div class='wrap'><div class='post n12'><h1>Head &amp; line</h1><p>First <b>bold<br><p>second\n text &lt;ok&gt;</p><ul><li>a</li><li>b</li></ul></div>"
        "<div class='comments'><p>A long reader comment that goes on and on and on for many more words than the text</p></div></div>"
        "<script>var t='</p>';</script><form><p>Name</p></form><footer>(c)</footer></body></html>"
    )
    rows = [(i, f"http://h.example/{i}", page.replace("n12", f"n{i}")) for i in range(3)]
    rows.append((9, "http://h.example/9", "<html><body><div class='wrap'><div class='post n7'><p>Short.</p></div></div><div class='strange'><p>Something else entirely that is longer than the post itself is</p></div></body>"))
    got = {r.page_id: r.text for r in html.op8_extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[0] == "Head & line First bold second text <ok> a b"
    assert got[9] == "Short."


def test_pages_lose_their_frame_only(tables):
    from html import unescape
    import re

    for r in html.op8_extract(tables["pages"]).join(tables["pages"].select("page_id", "html"), "page_id").collect():
        article = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        article = re.sub(r"</?(?:p|h1|br)>", " ", article)
        assert r.text == " ".join(unescape(re.sub(r"<[^>]*>", "", article)).split())
        assert r.n_chars == len(r.text)


FRAMES = {
    "article": "<body><nav><a href=/>Home</a></nav><div class='ad'>{junk}</div><article>{body}</article><footer>(c)</footer></body>",
    "with-sidebar": "<body><div class='layout with-sidebar'><article>{body}</article><aside>{junk}</aside></div></body>",
    "form": "<body><form action=/go><input name=q><article>{body}</article></form></body>",
    "post": "<body><header class='site-header'><h1>Site</h1></header><div id=page><div class='post-body'>{body}<div class='share-buttons'>Share</div></div>"
    "<div class='sidebar'><p>{junk}</p></div><div id='comments'><div class='content'><p>{junk}</p></div></div></div></body>",
    "main": "<body><div role=navigation>menu</div><main>{body}<section class='newsletter-signup'><p>{junk}</p></section></main><div class='cookie-notice'>{junk}</div></body>",
    "discussion": "<body><article>{body}</article><div id=discussion><p>{junk}</p><p>{junk}</p><p>{junk}</p></div></body>",
    "columns": "<body><div class='content'><div class='row'>{body}</div></div><div class=footer>{junk}</div></body>",
}


@pytest.mark.parametrize("name", FRAMES)
def test_text_survives_the_frame(spark, name):
    """An exact round trip: known blocks in a frame of menus, notices, adverts and comments come out, and nothing else."""
    rng = random.Random(name)
    rows, want = [], {}
    for i in range(6):
        blocks = [" ".join(_words(rng, rng.randrange(4, 40))) + "." for _ in range(rng.randrange(1, 6))]
        want[i] = " ".join(["Head & <line>", *blocks])
        body = "<h1>Head &amp; &lt;line&gt;</h1>" + "".join(f"<p title=don't>{b.replace(' ', chr(10) + ' ', 1)}<!-- x --></p>" for b in blocks)
        junk = " ".join(_words(rng, 60))
        rows.append((i, f"http://{name}.example/{i}", FRAMES[name].format(body=body, junk=junk)))
    got = {r.page_id: r.text for r in html.op8_extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want


def test_html_parts_that_are_text():
    assert html.main_text("<p title=don't>hello first</p><p>it's fine</p><p>third</p>", None) == "hello first it's fine third"
    assert html.main_text("<article><p>one</p><div class='related-work'><p>two</p></div><div class='related-posts'>x</div></article>", None) == "one two"
    assert html.main_text("<p>a</p><script>var x=1; <b>", None) == "a"
    assert html.main_text("a < b <i>c</i> d", None) == "a < b c d"


def test_teasers_do_not_stand_for_the_post():
    card = "<article><h2>Other</h2><p>" + "teaser " * 12 + "</p></article>"
    post = " ".join(f"w{i}" for i in range(90))
    assert html.main_text(f"<body><div class=post><p>{post}</p></div><div>{card * 3}</div></body>", None) == post
    assert html.main_text(f"<body><div class=post><p>{post}</p></div><div>{card}</div></body>", None) == post


def test_deep_pages_stay_small():
    assert html.main_text("<div>" * 8000 + "<p>x</p>", None) == "x"
    assert html.main_text("<div a=\"" * 8000, None) == ""


# ── sharding ───────────────────────────────────────────────────────────────


def test_shards_are_exact_gapless_and_repeatable(tables):
    got = sharding.op9_sharding(tables["documents"]).collect()
    again = sharding.op9_sharding(tables["documents"].repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
    assert set(slots) == set(range(40)) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_repeated_rows_are_dealt_apart(spark):
    docs = spark.createDataFrame([(1, "same text")] * 900 + [(i, f"text {i}") for i in range(2, 102)], "doc_id long, text string").repartition(5)
    got = sharding.op9_sharding(docs).collect()
    count = [0] * 40
    same = [0] * 40
    for r in got:
        count[r.shard] += 1
        same[r.shard] += r.doc_id == 1
    assert set(count) == {25} and min(same) > 15
    again = sharding.op9_sharding(docs.repartition(3)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_shards_over_many_super_partitions(tables, monkeypatch):
    monkeypatch.setattr(sharding, "BUCKET_ROWS", 4)
    monkeypatch.setattr(sharding, "SUPER", 5)
    got = sharding.assign(tables["documents"], 7).groupBy("shard").count().collect()
    n = tables["documents"].count()
    assert sorted(r["count"] for r in got) == sorted(n // 7 + (k < n % 7) for k in range(7))


def test_communication_matrix_is_hypergeometric():
    sizes, shards = np.array([30, 50, 20, 10]), np.array([28, 28, 27, 27])
    draws = np.array([sharding.communication_matrix(sizes, shards, [s]) for s in range(2000)])
    assert (draws.sum(2) == sizes).all() and (draws.sum(1) == shards).all()
    mean = sizes[:, None] * shards / sizes.sum()
    n = sizes.sum()
    var = mean * (n - shards) / n * (n - sizes[:, None]) / (n - 1)
    assert np.abs(draws.mean(0) - mean).max() < 0.2 and np.abs(draws.var(0) / var - 1).max() < 0.15


def test_large_hypergeometric_draws(monkeypatch):
    monkeypatch.setattr(sharding, "NUMPY_MOST", 100)
    rng = np.random.default_rng(1)
    x = np.array([sharding.hypergeometric(400, 600, 50, rng) for _ in range(300)])
    assert x.mean() == pytest.approx(20, abs=0.8) and x.var() == pytest.approx(50 * 0.24 * 950 / 999, rel=0.35)


def test_edited_passage_is_found_beside_shorter_quotes(spark):
    rng = random.Random(31)
    rows, pairs = [], []
    for t in range(40):
        p = _words(rng, 60)
        q = list(p)
        q[30] = "edited"
        pairs.append(frozenset((100 * t, 100 * t + 1)))
        rows += [(100 * t, " ".join(_words(rng, 150) + p + _words(rng, 50))), (100 * t + 1, " ".join(_words(rng, 140) + q + _words(rng, 60)))]
        for m in range(5):
            rows += [(100 * t + 10 + m, " ".join(_words(rng, 25 + m) + p[:30] + _words(rng, 25)))]
            rows += [(100 * t + 20 + m, " ".join(_words(rng, 25 + m) + p[31:] + _words(rng, 25)))]
    got = substrings.op7_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    found = {frozenset((r.doc_id, r.keep_id)) for r in got}
    assert found == set(pairs)


def test_exact_passage_is_found_beside_another_with_the_leader(spark):
    rng = random.Random(32)
    rows, pairs = [], []
    for t in range(20):
        p1, p2, p3 = (_words(rng, n) for n in (60, 50, 60))
        pairs.append(frozenset((10 * t + 1, 10 * t + 2)))
        rows += [(10 * t, " ".join(p1 + _words(rng, 5) + p2[3:47] + _words(rng, 5) + p3))]
        rows += [(10 * t + 1, " ".join(p1 + _words(rng, 90) + p2 + _words(rng, 30))), (10 * t + 2, " ".join(_words(rng, 40) + p2 + _words(rng, 80) + p3))]
    got = substrings.op7_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert set(pairs) <= {frozenset((r.doc_id, r.keep_id)) for r in got}


def test_every_training_document_trains(spark):
    docs = spark.range(9000).selectExpr("id as doc_id", "concat('a w', id % 7, ' b') as text")
    counts = recurrent.word_counts(docs)
    assert recurrent.trained(docs, recurrent.vocabulary(counts, 9000)).seen == 9000 * 4


def test_lm_does_not_depend_on_the_partitions(tables):
    docs = tables["documents"]
    want = {r.doc_id: r.score for r in recurrent.op6_recurrent(docs).collect()}
    got = {r.doc_id: r.score for r in recurrent.op6_recurrent(docs.repartition(7)).collect()}
    assert got == pytest.approx(want, rel=1e-5)


def test_lm_weights_meet_in_a_tree(spark, monkeypatch):
    monkeypatch.setattr(recurrent, "TRAIN_TASK_ROWS", 50)
    docs = spark.range(400).selectExpr("id as doc_id", "concat('a w', id % 7, ' b') as text")
    vocab = recurrent.vocabulary(recurrent.word_counts(docs), 400)
    flat = recurrent.trained(docs, vocab)
    monkeypatch.setattr(recurrent, "FAN_IN", 2)
    tree = recurrent.trained(docs, vocab)
    assert flat.seen == tree.seen == 1600
    assert np.abs(flat.flat() - tree.flat()).max() < 1e-5


def _slow_links(texts, length=50):
    """Pairs of texts that share length words, by comparison of all runs."""
    runs = {}
    for i, t in texts.items():
        w = plain_words(t.encode())
        for at in range(len(w) - length + 1):
            runs.setdefault(tuple(w[at : at + length]), set()).add(i)
    return [sorted(s) for s in runs.values() if len(s) > 1]


def test_exact_passages_against_all_runs(spark):
    """No run of 50 words that two texts share joins texts which the links leave apart."""
    rng = random.Random(77)
    lines = [_words(rng, n) for n in (12, 20, 30, 44, 49, 50, 51, 70, 120)]
    rows = []
    for i in range(260):
        body = _words(rng, rng.randrange(20, 120))
        for _ in range(rng.randrange(4)):
            line = lines[min(rng.randrange(9), rng.randrange(9))]
            cut = rng.randrange(0, len(line) // 2) if rng.random() < 0.4 else 0
            at = rng.randrange(len(body))
            body[at:at] = line[cut:] if rng.random() < 0.5 else line[: len(line) - cut]
        if i % 10 == 0:
            body += ["echo"] * rng.randrange(20, 80) + ["more"] * rng.randrange(20, 60)
        rows.append((i, " ".join(body)))
    got = substrings.op7_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    root = _slow_components([i for i, _ in rows], [(r.doc_id, r.keep_id) for r in got])
    for together in _slow_links(dict(rows)):
        assert len({root[i] for i in together}) == 1


def test_triples_of_a_leader_with_half_a_passage(spark):
    """The leader shares 60 words with M, and the first 44 only of the 50 that M and N share."""
    rng = random.Random(78)
    rows, pairs = [], set()
    for t in range(60):
        p, q = _words(rng, 60), _words(rng, 50)
        rows += [(3 * t, " ".join(p + _words(rng, 3) + q[:44])), (3 * t + 1, " ".join(p + _words(rng, 60) + q)), (3 * t + 2, " ".join(_words(rng, 90) + q + _words(rng, 40)))]
        pairs.add(frozenset((3 * t + 1, 3 * t + 2)))
    got = substrings.op7_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert pairs <= {frozenset((r.doc_id, r.keep_id)) for r in got}


def test_recall_of_edited_passages(spark):
    """Passages of 50 to 120 words with one word put in, left out or replaced; the README has the share found."""
    rng = random.Random(79)
    rows, pairs = [], set()
    for t in range(200):
        p = _words(rng, rng.randrange(50, 121))
        q, at = list(p), rng.randrange(len(p))
        q[at : at + rng.randrange(2)] = ["edited"] * rng.randrange(1, 2)
        rows += [(2 * t, " ".join(_words(rng, 60) + p + _words(rng, 60))), (2 * t + 1, " ".join(_words(rng, 60) + q + _words(rng, 60)))]
        pairs.add(frozenset((2 * t, 2 * t + 1)))
    got = {frozenset((r.doc_id, r.keep_id)) for r in substrings.op7_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    print("edited passages found:", len(got & pairs), "of", len(pairs))
    assert got <= pairs and len(got) >= 0.9 * len(pairs)


@pytest.mark.parametrize("tile", [None, 150])
def test_edited_line_is_found_among_many_holders_of_the_line(spark, monkeypatch, tile):
    """Pairs that share four words on either side of a common line, one with a word of the line replaced; 300 other texts hold the line."""
    if tile:
        monkeypatch.setattr(substrings, "TILE", tile)
    rng = random.Random(81)
    line = _words(rng, 44)
    rows = [(1000 + i, " ".join(_words(rng, 60) + line + _words(rng, 60))) for i in range(300)]
    pairs = set()
    for t in range(40):
        a, b, edited = _words(rng, 4), _words(rng, 4), line[:21] + [f"edited{t}"] + line[22:]
        rows += [(2 * t + i, " ".join(_words(rng, 60) + a + x + b + _words(rng, 60))) for i, x in enumerate((line, edited))]
        pairs.add(frozenset((2 * t, 2 * t + 1)))
    got = {frozenset((r.doc_id, r.keep_id)) for r in substrings.op7_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == pairs


def test_places_looked_up_are_those_compared():
    rng = np.random.default_rng(82)
    base = rng.integers(1, 2**16, (4, 91)).astype(np.uint16)
    near = base[rng.integers(0, 4, 600)]
    for row in near:
        at, n = rng.integers(0, 91), rng.integers(0, 40)
        row[at : at + n] = rng.integers(1, 2**16, len(row[at : at + n]))
        if rng.random() < 0.5:
            row[at + 1 :] = row[at:-1].copy()
        if rng.random() < 0.2:
            row[rng.integers(50, 91) :] = 0
    codes = np.ascontiguousarray(near.T)
    index, found = substrings.Near(codes), 0
    for i in range(600):
        want = substrings.alike(codes, i)
        assert substrings.alike(codes, i, index).tolist() == want.tolist()
        found += len(want)
    assert 600 < found < 600 * 600


def test_word_hashes_are_of_the_plain_words():
    texts = [b"One two, THREE-four", None, b"", b"  .. ", "wört two".encode(), b"four three"]
    got, counts = word_hashes(texts)
    words = [w for t in texts for w in plain_words(t)]
    assert counts.tolist() == [len(plain_words(t)) for t in texts]
    assert len({(w, h) for w, h in zip(words, got.tolist())}) == len(set(words)) == len(set(got.tolist()))


def test_near_copies_are_not_linked_each_with_all(spark):
    """Copies of one text, each with edits of its own: twice the copies give less than three times the rows, not four times, and every one is linked."""
    rng = random.Random(83)
    base, counts = _words(rng, 700), []
    for m in (30, 60):
        rows = []
        for i in range(m):
            text = list(base)
            for at in rng.sample(range(700), 14):
                text[at] = f"own{i}x{at}"
            rows.append((i, " ".join(text)))
        got = substrings.op7_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        root = _slow_components([i for i, _ in rows], [(r.doc_id, r.keep_id) for r in got])
        assert len(set(root.values())) == 1
        counts.append(len(got))
    assert counts[1] < 3 * counts[0]


@pytest.mark.parametrize("many", [None, 2])
def test_pairs_of_places_connect_all_that_are_alike(monkeypatch, many):
    if many:
        for name in ("MANY", "INDEXED", "FEW"):
            monkeypatch.setattr(substrings, name, many)
        monkeypatch.setattr(substrings, "BLOCK", 7)
    rng = np.random.default_rng(84)
    for trial in range(12):
        near = rng.integers(1, 2**16, (5, 91)).astype(np.uint16)[rng.integers(0, 5, 150)]
        for row in near:
            for _ in range(rng.integers(0, 4)):
                at = rng.integers(0, 91)
                row[at : at + 5] = rng.integers(1, 2**16, len(row[at : at + 5]))
            if rng.random() < 0.3:
                row[50:] = row[49:-1].copy()
            row[45] = 7
        key, n, open_ = rng.permutation(150), rng.integers(50, 99, 150), rng.random(150) < 0.6
        pairs = [x for a, b in substrings.joined(key, n, open_, near) for x in zip(a.tolist(), b.tolist())]
        assert len(pairs) <= open_.sum()
        closed = [(int(i), int(np.flatnonzero(~open_)[0])) for i in np.flatnonzero(~open_)]
        order = np.lexsort((key, n)).tolist()
        codes = np.ascontiguousarray(near.T)
        want = [(i, int(j)) for i in order for j in substrings.alike(codes, i) if i != j]
        assert all(i in substrings.alike(codes, j) or j in substrings.alike(codes, i) for i, j in pairs)
        assert _parts(150, pairs + closed) == _parts(150, want + closed)


def _parts(n, links):
    root = _slow_components(range(n), links)
    parts = {}
    for i in range(n):
        parts.setdefault(root[i], set()).add(i)
    return {frozenset(x) for x in parts.values()}
