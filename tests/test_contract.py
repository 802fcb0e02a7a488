"""The driver's contract, and plans as they are meant."""

import contextlib
import io as stdio

import duckdb
import pytest

import __spark_entry__ as E
from tessera.queries import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
RUN = "lx4_bm25_topk dn1_exact_knn fu1_rrf rm10_retrieval_metrics gm5_faithfulness gd4_injection ex3_bootstrap gs6_near_dupes tr4_rollup tr7_waterfall an1_latency ca1_cache_lookup st1_rate_limit".split()


def plan(df):
    out = stdio.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def test_every_oracle_has_its_query():
    assert set(ORACLES) <= set(QUERIES) and set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("name", RUN)
def test_query_matches_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    want = con.execute(ORACLES[name])
    names = [d[0] for d in want.description]
    got = QUERIES[name](spark, sf)
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(str, map(tuple, got.select(*names).collect()))) == sorted(map(str, want.fetchall()))


def test_entry(spark):
    assert E.entry(spark).count() == 1


def test_plans(spark, sf):
    bm25 = plan(QUERIES["lx4_bm25_topk"](spark, sf))
    assert "WindowGroupLimit" in bm25 and "CartesianProduct" not in bm25
    dn2 = plan(QUERIES["dn2_prefilter"](spark, sf))
    pushed = dn2.split("PushedFilters")[1].split("\n")[0]
    assert "In(lang" in pushed and "In(source" in pushed and "text" not in dn2.split("ReadSchema")[1].split("\n")[0]
