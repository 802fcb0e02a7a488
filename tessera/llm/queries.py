"""The registered queries of this folder: thin calls of the operators with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.sources.io import spread

from . import decontaminate, fingerprints, html, importance, knn, licenses, mixing, quality, recurrent, sharding, simhash, substrings, whitening
from .oracles import contained_sql


def _on(operator: Callable[..., DataFrame], *tables: str) -> Callable[[SparkSession, str], DataFrame]:
    """operator over the tables, the first of them dealt to all cores where its files are few."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        first, *others = [spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables]
        return operator(spread(first), *others)

    return run


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": _on(mixing.op1_mixing, "documents"),
    "op2_licenses": _on(licenses.op2_licenses, "documents"),
    "op3_simhash": _on(simhash.op3_simhash, "documents"),
    "op4_topk": _on(knn.op4_topk, "embeddings"),
    "op5_quality": _on(quality.op5_quality, "documents", "labels"),
    "op6_recurrent": _on(recurrent.op6_recurrent, "documents"),
    "op7_substrings": _on(substrings.op7_substrings, "documents"),
    "op8_extract": _on(html.op8_extract, "pages"),
    "op9_sharding": _on(sharding.op9_sharding, "documents"),
    "op10_decontaminate": _on(decontaminate.op10_decontaminate, "documents", "benchmark"),
    "op11_whitening": _on(whitening.op11_whitening, "embeddings"),
    # its two passes number the rows of the scan alike, so nothing is dealt between
    "op12_fingerprints": lambda spark, sf_dir: fingerprints.op12_fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet")),
    "op13_importance": _on(importance.op13_importance, "documents", "benchmark"),
}

ORACLES: dict[str, str] = {
    "op1_mixing": mixing.ORACLE,
    "op2_licenses": contained_sql(
        "(VALUES " + ", ".join("({}, '{}', '{}')".format(i, n, t.replace("'", "''")) for i, (n, t) in enumerate(licenses.NOTICES)) + ") AS t(id, name, text)",
        "doc_id, name AS license, id AS notice_id, shingles, shared, shared / shingles AS containment, first_word",
    ),
    "op4_topk": knn.ORACLE,
    "op10_decontaminate": contained_sql(
        "(SELECT DISTINCT item_id AS id, '' AS name, text FROM benchmark) AS t",
        "doc_id, id AS item_id, shingles AS item_shingles, shared, shared / shingles AS containment, first_word",
    ),
    "op13_importance": importance.ORACLE,
}
