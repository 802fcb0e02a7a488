"""The pipeline's stages and their composition against plain versions of the same decisions."""

from itertools import combinations

import corpus_pipeline
from tessera.llm import quality
from tessera.llm.common import plain_words, shingle_strings

from .test_operators import _slow_components, _slow_fingerprint


def test_run_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    good = {r.doc_id for r in quality.op5_quality(docs, labels).collect() if r.predicted}
    rows = {r.doc_id: r for r in docs.collect() if r.doc_id in good}
    fps = {i: _slow_fingerprint(r.text) for i, r in rows.items()}
    first = _slow_components(fps, [(a, b) for a, b in combinations(fps, 2) if (fps[a] ^ fps[b]).bit_count() <= 3])
    sets = lambda t: set(shingle_strings(plain_words((t or "").encode()), 5))
    leaks = [sets(t) for t in items]
    kept = {i: r for i, r in rows.items() if first[i] == i}
    kept = {i: r for i, r in kept.items() if not any(s and len(s & sets(r.text)) >= 0.8 * len(s) for s in leaks)}
    sizes = {i: len((r.text or "").encode().split()) for i, r in kept.items()}
    per = {}
    for i, r in kept.items():
        per[r.source] = per.get(r.source, 0) + sizes[i]
    want = {s: (3, 1, 2)[k % 3] for k, s in enumerate(sorted(per))}
    target, open_, left = {}, dict(want), 1.5 * sum(per.values())
    while open_:
        share = {s: left * w / sum(open_.values()) for s, w in open_.items()}
        over = {s for s in open_ if share[s] > 2 * per[s]}
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 2 * per[s]
            left -= target[s]
            del open_[s]

    out = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in out} <= set(kept)
    taken = {}
    for r in out:
        taken[r.source] = taken.get(r.source, 0) + len(r.text.encode().split())
    assert all(abs(taken[s] - target[s]) <= 1 for s in target)
    for r in out:
        assert r.text == kept[r.doc_id].text or set(r.text.split()) <= set(kept[r.doc_id].text.split())
    counts = [sum(r.shard == k for r in out) for k in range(40)]
    assert max(counts) - min(counts) <= 1


def test_stages_keep_the_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).columns == docs.columns


def test_near_dedup_keeps_a_row_of_every_group(spark):
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(80))
    rows = [(None, text(1), "a"), (None, text(2), "a"), (None, text(2), "b"), (3, text(3), "a"), (3, text(4), "a"), (5, text(5), "a"), (5, text(6), "a"), (1, text(6), "a"), (None, text(3), "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = [(r.doc_id, r.text) for r in corpus_pipeline.near_dedup(spark, docs, "").collect()]
    assert sorted(got, key=str) == sorted([(None, text(1)), (None, text(2)), (3, text(3)), (3, text(4)), (5, text(5)), (1, text(6))], key=str)
