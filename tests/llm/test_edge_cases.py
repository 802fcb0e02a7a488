"""Nulls, empty and very long texts, ties, repeated rows, empty tables, clashing names: every operator and stage."""

import pytest

import corpus_pipeline
from tessera.llm import decontaminate, html, knn, licenses, mixing, quality, recurrent, sharding, simhash, substrings

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _hash int, _key string, shard string, size double, _turn int, score int, key int, Slot int"
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))


def _row(i, text, source="a"):
    return (i, text, "en", source, None if text is None else len(text), 1, "k", "s", 1.0, 2, 3, 4, 5)


@pytest.fixture(scope="module")
def docs(spark):
    rows = [_row(1, None), _row(2, ""), _row(3, " \n\t "), _row(4, "one two three four five six", None), _row(5, "one two three four five six"), _row(5, "one two three four five six")]
    rows += [_row(6, LONG, "b"), _row(7, LONG + " tail", "b"), _row(None, "nameless words here", "c"), _row(9, "Ünïcode \x85 wörds\x0bsplit", None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 0, 0), (2, 1, 0), (2, 0, 0), (4, 1, None), (6, 1, 0), (None, 1, 1), (9, None, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    rows = [(1, None), (2, ""), (3, "ONE two, three four five six!"), (3, "ONE two, three four five six!"), (None, "nameless words here")]
    return spark.createDataFrame(rows, "item_id long, text string")


def test_operators_take_odd_rows(spark, docs, labels, benchmark):
    n = docs.count()
    one = {r.doc_id: r for r in mixing.op1_mixing(docs).collect()}
    assert len(mixing.op1_mixing(docs).collect()) == n and one[1].taken == 0 and one[6].size == 60_000
    assert licenses.op2_licenses(docs).count() == 0
    three = simhash.op3_simhash(docs).collect()
    assert len(three) == n
    assert {r.doc_id for r in three if r.fingerprint == "0" * 16} == {1, 2, 3}
    assert all(r.component_id == 1 for r in three if r.doc_id in (1, 2, 3))
    five = quality.op5_quality(docs, labels).collect()
    assert len(five) == n and all(0 <= r.score <= 1 for r in five)
    six = recurrent.op6_recurrent(docs).collect()
    assert len(six) == n and {r.n_tokens for r in six if r.doc_id in (1, 2, 3)} == {1}
    seven = substrings.op7_substrings(docs).collect()
    assert {(r.doc_id, r.keep_id) for r in seven} == {(7, 6)}
    nine = sharding.op9_sharding(docs).collect()
    assert len(nine) == n and {r.text_crc32 for r in nine if r.doc_id == 1} == {0}
    ten = decontaminate.op10_decontaminate(docs, benchmark).collect()
    assert sorted((r.doc_id or -1, r.item_id or -1) for r in ten) == [(-1, -1), (4, 3), (5, 3), (5, 3)]


def test_operators_take_empty_tables(spark, docs, labels, benchmark):
    none, no_labels, no_items = docs.limit(0), labels.limit(0), benchmark.limit(0)
    assert mixing.op1_mixing(none).count() == 0
    assert licenses.op2_licenses(none).count() == 0
    assert simhash.op3_simhash(none).count() == 0
    assert quality.op5_quality(none, no_labels).count() == 0
    assert {r.score for r in quality.op5_quality(docs, no_labels).collect()} == {0.5}
    assert recurrent.op6_recurrent(none).count() == 0
    assert substrings.op7_substrings(none).count() == 0
    assert sharding.op9_sharding(none).count() == 0
    assert decontaminate.op10_decontaminate(docs, no_items).count() == 0
    assert decontaminate.op10_decontaminate(none, benchmark).count() == 0
    assert knn.op4_topk(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert html.op8_extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_knn_odd_vectors(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [nan, 1.0]), (5, [None, 1.0]), (None, [1.0, 1.0]), (6, [0.5]), (7, [1e18, 1.0]), (100, [float("inf"), 0.0]), (200, [1.0, 1.0])]
    got = knn.op4_topk(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).where("score < 9000000000000000000").collect()
    ranks = {q: [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r.rank) if r.query_id == q and r.vec_id != 7] for q in (0, 200)}
    assert ranks[0] == [(1, 1024**2), (2, 1024**2), (200, 1024**2), (6, 1024 * 512)]
    assert ranks[200] == [(0, 1024**2), (1, 1024**2), (2, 1024**2), (6, 1024 * 512)]
    assert {r.query_id for r in got} == {0, 200}


def test_html_odd_pages(spark):
    rows = [(1, None, None), (2, "http://h/a", ""), (3, "http://h/b", "<p>x</p>"), (3, "http://h/b", "<p>x</p>"), (None, "nonsense", "plain &amp; text"), (5, "http://h/c", "<div " * 2000 + "<p>y")]
    got = html.op8_extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == 6
    text = {r.page_id: r.text for r in got}
    assert text[1] == "" and text[2] == "" and text[3] == "x" and text[None] == "plain & text"


def test_stages_take_odd_rows(spark, docs, labels, benchmark, tmp_path):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    benchmark.write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        for rows in (docs, docs.limit(0)):
            out = stage(spark, rows, str(tmp_path))
            if name != corpus_pipeline.STAGES[-1][0]:
                assert out.columns == docs.columns
            out.collect()
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_lose_no_row_and_no_value(spark):
    """Rows equal in doc_id and text but unlike elsewhere, repeated and null ids: what the stages keep."""
    rows = [(1, "a b c", "x"), (1, "a b c", "y"), (None, "d e f g", "x"), (3, "h i j", "x"), (3, "h i j", "x"), (5, None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    shards = sharding.sharded_documents(docs)
    assert sorted(map(str, map(tuple, shards.select(*docs.columns).collect()))) == sorted(map(str, rows))
    mixed = [tuple(r) for r in mixing.mixed_documents(docs).collect()]
    words = lambda rows, key: {k: sum(len((r[1] or "").split()) for r in rows if r[2] == k) for k in key}
    taken = {}
    for r in mixing.mix(mixing.sized(docs))[0].collect():
        taken[r.source] = taken.get(r.source, 0) + r.n_words
    assert words(mixed, "xy") == taken and set(mixed) <= {r for r in rows} | {r for r in mixed if r[1] not in [x[1] for x in rows]}
    three = [(3, "A", "s"), (5, "A", "s"), (5, "B", "s"), (None, "C", "s")]
    kept = simhash.deduplicated(spark.createDataFrame(three, "doc_id long, text string, source string")).collect()
    assert sorted(map(str, map(tuple, kept))) == sorted(map(str, [(3, "A", "s"), (5, "B", "s"), (None, "C", "s")]))
